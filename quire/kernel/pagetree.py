"""The page tree: walk, inheritance, rules and counts."""

from __future__ import annotations

from typing import Any, NamedTuple

from .values import Ref, get

INHERITABLE = ("Resources", "MediaBox", "CropBox", "Rotate")
REQUIRED = ("Resources", "MediaBox")
MAX_DEPTH = 256

DUPLICATE = "R-7.7.3.2-4 / R-7.7.3.3-3"
PARENT = "R-7.7.3.3-5"
REQUIRED_ATTRIBUTE = "R-7.7.3.4-2"
ROTATION = "R-7.7.3.3-28"
EMPTY_CONTENTS = "R-7.7.3.3-26"


class Page(NamedTuple):
    index: int
    ref: Ref | None
    dict: dict[str, Any]
    ancestors: list[dict[str, Any]]  # nearest first


class Node(NamedTuple):
    ref: Ref | None
    dict: dict[str, Any]
    count: int


class PageTree(NamedTuple):
    pages: list[Page]
    nodes: list[Node]  # children before parents
    duplicates: list[Ref]
    reached: bool


def read_page_tree(reader) -> PageTree:
    """Walk from the catalog's /Pages; whatever has no array /Kids is a page.

    A reference met before is a duplicate and not walked again; nothing is
    walked deeper than 256 levels.
    """
    catalog = reader.catalog()
    root = get(catalog, "Pages") if isinstance(catalog, dict) else None
    if not isinstance(reader.resolve(root), dict):
        return PageTree([], [], [], False)
    pages: list[Page] = []
    nodes: list[Node] = []
    duplicates: list[Ref] = []
    seen: set[Ref] = set()
    # Nodes that are entered: what is left of the kids, their ancestors, and the node with the pages before it.
    waiting: list[tuple] = [(iter([root]), [], None)]
    while waiting:
        left, ancestors, node = waiting[-1]
        for value in left:
            ref = value if isinstance(value, Ref) else None
            if ref is not None:
                if ref in seen:
                    duplicates.append(ref)
                    continue
                seen.add(ref)
            entries = reader.resolve(value)
            if not isinstance(entries, dict) or len(ancestors) > MAX_DEPTH:
                continue
            kids = entries.get("Kids")
            if kids is not None:
                kids = reader.resolve(kids)
            if isinstance(kids, list):
                waiting.append((iter(kids), [entries, *ancestors], (ref, entries, len(pages))))
                break
            pages.append(Page(len(pages), ref, entries, ancestors))
        else:
            waiting.pop()
            if node is not None:
                ref, entries, before = node
                nodes.append(Node(ref, entries, len(pages) - before))
    return PageTree(pages, nodes, duplicates, True)


def inherited(page: Page, key: str) -> Any:
    """The page's value, or for an inheritable key the nearest ancestor's; whole, never merged."""
    value = page.dict.get(key)
    if value is not None or key not in INHERITABLE:
        return value
    for entries in page.ancestors:
        value = entries.get(key)
        if value is not None:
            return value
    return None


def rotation_is_valid(value: Any) -> bool:
    return isinstance(value, int) and not isinstance(value, bool) and value % 90 == 0


def check_page_tree(reader, tree: PageTree | None = None) -> list[tuple[str, str, int | None]]:
    """Every broken rule as (clause, message, object number), in a fixed order."""
    tree = tree or read_page_tree(reader)
    if not tree.reached:
        return []
    found = [(DUPLICATE, f"{r.number} {r.generation} R is referenced more than once", r.number) for r in tree.duplicates]
    parent_of: dict[Ref, Ref] = {}
    for node in tree.nodes:
        if node.ref is not None:
            kids = reader.resolve(get(node.dict, "Kids"))
            parent_of.update([(kid, node.ref) for kid in kids if isinstance(kid, Ref)])
    for what, items in (("node", tree.nodes), ("page", tree.pages)):
        for item in items:
            expected = parent_of.get(item.ref) if item.ref is not None else None
            if expected is None:
                continue
            own = get(item.dict, "Parent")
            problem = None
            if own is None:
                problem = "has no /Parent"
            elif not isinstance(own, Ref):
                problem = "has a direct /Parent"
            elif own.number != expected.number:
                problem = f"names object {own.number} as its /Parent but hangs below object {expected.number}"
            if problem:
                found.append((PARENT, f"{what} {item.ref.number} {item.ref.generation} R {problem}", item.ref.number))
    for page in tree.pages:
        number = page.ref.number if page.ref else None
        for key in REQUIRED:
            if inherited(page, key) is None:
                found.append((REQUIRED_ATTRIBUTE, f"page {page.index} has no /{key} and inherits none", number))
        rotate = inherited(page, "Rotate")
        if rotate is not None and not rotation_is_valid(reader.resolve(rotate)):
            found.append((ROTATION, f"page {page.index} is rotated by no multiple of 90", number))
        contents = get(page.dict, "Contents")
        if contents is not None and reader.resolve(contents) == []:
            found.append((EMPTY_CONTENTS, f"page {page.index} has an empty /Contents array", number))
    return found


def count_corrections(reader, tree: PageTree | None = None) -> dict[Ref, tuple[dict[str, Any], int]]:
    """Nodes whose /Count isn't the number of pages below: reference to (dictionary, count)."""
    tree = tree or read_page_tree(reader)
    out = {}
    for node in tree.nodes:
        if node.ref is None:
            continue
        declared = reader.resolve(get(node.dict, "Count"))
        if isinstance(declared, bool) or not isinstance(declared, int) or declared != node.count:
            out[node.ref] = (node.dict, node.count)
    return out


def with_count(entries: dict[str, Any], count: int) -> dict[str, Any]:
    return {**entries, "Count": count}
