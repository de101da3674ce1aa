"""Tagged content and the structure tree above it."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any, NamedTuple, Protocol

from .content import ContentStream
from .values import Name, PdfError, PdfString, Ref


class StructureError(PdfError):
    layer = "structure"


class Sink(Protocol):
    def reserve(self) -> Ref: ...

    def write(self, ref: Ref, value: Any) -> None: ...


class Element:
    def __init__(self, kind: str, parent: Element | None, entries: dict[str, Any]):
        self.kind, self.parent, self.entries = kind, parent, entries
        self.children: list[Element | tuple[TaggedStream, int]] = []


class TaggedStream:
    """A page's content in which every item belongs to an element."""

    def __init__(self, tree: StructureTree, page: Ref, content: ContentStream):
        self.tree, self.page, self.content = tree, page, content
        self.owners: list[Element] = []  # by marked-content id
        self._inside = False

    def item(self, element: Element, draw: Callable[[ContentStream], Any]) -> TaggedStream:
        if self._inside:
            raise StructureError("content items shall not be nested (R-14.7.5.1.1-6)")
        self.tree.require(element)
        mcid = len(self.owners)
        self.owners.append(element)
        element.children.append((self, mcid))
        self._inside = True
        try:
            self.content.op("BDC", Name(element.kind), {"MCID": mcid})
            draw(self.content)
            self.content.op("EMC")
        finally:
            self._inside = False
        return self

    def artifact(self, draw: Callable[[ContentStream], Any], subtype: str | None = None) -> TaggedStream:
        if subtype is None:
            self.content.op("BMC", Name("Artifact"))
        else:
            self.content.op("BDC", Name("Artifact"), {"Subtype": Name(subtype)})
        draw(self.content)
        self.content.op("EMC")
        return self

    def finish(self) -> bytes:
        return self.content.finish()


class Built(NamedTuple):
    root: Ref
    mark_info: dict[str, Any]
    keys: dict[TaggedStream, int]


class StructureTree:
    def __init__(self):
        self._known: set[int] = set()
        self._elements: list[Element] = []
        self._roots: list[Element] = []
        self._streams: list[TaggedStream] = []

    def element(
        self, kind: str, parent: Element | None = None, *, title: str | None = None, alt: str | None = None,
        actual_text: str | None = None, lang: str | None = None, extra: dict[str, Any] | None = None,
    ) -> Element:
        if not kind:
            raise StructureError("an element shall have a type (R-14.7.2-20)")
        if parent is not None:
            self.require(parent)
        texts = {"T": title, "Alt": alt, "ActualText": actual_text, "Lang": lang}
        told = {k: PdfString(v.encode()) for k, v in texts.items() if v is not None}
        made = Element(kind, parent, {"extra": dict(extra or {}), "texts": told})
        self._known.add(id(made))
        self._elements.append(made)
        (self._roots if parent is None else parent.children).append(made)
        return made

    def stream(self, page: Ref, content: ContentStream | None = None) -> TaggedStream:
        made = TaggedStream(self, page, content or ContentStream())
        self._streams.append(made)
        return made

    def require(self, element: Element) -> None:
        if id(element) not in self._known:
            raise StructureError("the element belongs to another tree")

    def finish(self, sink: Sink) -> Built:
        """Write root, elements and parent tree; numbers go to the root, then the elements from the top down."""
        if not self._roots:
            raise StructureError("a structure tree shall have children (R-14.7.2-3)")
        root_ref = sink.reserve()
        ordered: list[Element] = []
        waiting = list(reversed(self._roots))
        while waiting:
            at = waiting.pop()
            ordered.append(at)
            waiting.extend(c for c in reversed(at.children) if isinstance(c, Element))
        refs = {id(e): sink.reserve() for e in ordered}
        for element in ordered:
            sink.write(refs[id(element)], self._entries(element, refs, root_ref))
        keys: dict[TaggedStream, int] = {}
        numbers: list[Any] = []
        for stream in self._streams:
            if stream.owners:
                keys[stream] = len(keys)
                owners = sink.reserve()
                sink.write(owners, [refs[id(e)] for e in stream.owners])
                numbers += [keys[stream], owners]
        root: dict[str, Any] = {"Type": Name("StructTreeRoot"), "K": _one_or_all([refs[id(e)] for e in self._roots])}
        if numbers:
            root["ParentTree"] = sink.reserve()
            sink.write(root["ParentTree"], {"Nums": numbers})
            root["ParentTreeNextKey"] = len(keys)
        sink.write(root_ref, root)
        return Built(root_ref, {"Marked": True}, keys)

    def _entries(self, element: Element, refs: dict[int, Ref], root_ref: Ref) -> dict[str, Any]:
        pages = list(dict.fromkeys(c[0].page.number for c in element.children if not isinstance(c, Element)))
        kids: list[Any] = []
        page = None
        for child in element.children:
            if isinstance(child, Element):
                kids.append(refs[id(child)])
                continue
            stream, mcid = child
            page = page or stream.page
            kids.append(mcid if len(pages) == 1 else {"Type": Name("MCR"), "Pg": stream.page, "MCID": mcid})
        parent = root_ref if element.parent is None else refs[id(element.parent)]
        out = {**element.entries["extra"], "Type": Name("StructElem"), "S": Name(element.kind), "P": parent}
        if len(pages) == 1:
            out["Pg"] = page
        if kids:
            out["K"] = _one_or_all(kids)
        return out | element.entries["texts"]


def _one_or_all(items: list[Any]) -> Any:
    return items[0] if len(items) == 1 else items
