"""Files put together by hand, apart from the engine's writer."""


def build_pdf(sources, *, junk="", header="%PDF-1.7\n", eol=" \n", trailer=None, tail=None, startxref=None, order=None):
    """sources: number to the text of an indirect object, or a list of object bodies from 1."""
    if isinstance(sources, list):
        sources = {k: f"{k} 0 obj\n{body}\nendobj\n" for k, body in enumerate(sources, 1)}
    out = junk + header
    offsets = {}
    for number in order or sources:
        offsets[number] = len(out) - len(junk)
        out += sources[number]
    at = len(out) - len(junk)
    size = max(sources) + 1
    out += "xref\n"
    out += f"0 1\n0000000000 65535 f{eol}"
    for number in sorted(sources):
        generation = int(sources[number].split()[1])
        out += f"{number} 1\n{offsets[number]:010d} {generation:05d} n{eol}"
    out += (trailer or (lambda n: f"trailer\n<< /Size {n} /Root 1 0 R >>\n"))(size)
    start = at if startxref is None else startxref
    out += (tail or (lambda n: f"startxref\n{n}\n%%EOF\n"))(start)
    return out.encode("latin-1")


PAGE = "<< /Type /Page /Parent {parent} 0 R /MediaBox [0 0 612 792] /Resources << >> {more} >>"


def tree(*bodies):
    return build_pdf(["<< /Type /Catalog /Pages 2 0 R >>", *bodies])
