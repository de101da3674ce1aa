"""Editing as an overlay over a parsed file."""

from __future__ import annotations

from typing import Any

from . import pagetree, writer
from .files import Document, parse
from .values import Name, Ref, Refusal, WriteError, references

_FIXED_TRAILER = ("Size", "Prev")


class Editor:
    """Changes, deletions and trailer edits; the file below stays as it is."""

    def __init__(self, document: Document | None, version: str):
        self.document, self.version = document, version
        self._changed: dict[tuple[int, int], Any] = {}
        self._deleted: set[tuple[int, int]] = set()
        self._set: dict[str, Any] = {}
        self._removed: set[str] = set()
        self._referenced: set[int] | None = None

    @classmethod
    def open(cls, data: bytes) -> Editor:
        return cls.of(parse(data))

    @classmethod
    def of(cls, document: Document) -> Editor:
        return cls(document, document.header_version)

    @classmethod
    def create(cls, version: str = "1.7") -> Editor:
        """A new document: the catalog is object 1, the page tree's root object 2."""
        made = cls(None, version)
        made._changed[1, 0] = {"Type": Name("Catalog"), "Pages": Ref(2)}
        made._changed[2, 0] = {"Type": Name("Pages"), "Kids": [], "Count": 0}
        made._set["Root"] = Ref(1)
        return made

    catalog_ref, pages_ref = Ref(1), Ref(2)

    def get(self, number: int, generation: int = 0) -> Any:
        key = (number, generation)
        if key in self._deleted:
            return None
        if key in self._changed:
            return self._changed[key]
        return self.document.get(*key) if self.document else None

    def resolve(self, value: Any) -> Any:
        return self.get(*value) if isinstance(value, Ref) else value

    def catalog(self) -> Any:
        return self.resolve(self.trailer().get("Root"))

    def trailer(self) -> dict[str, Any]:
        base = self.document.trailer if self.document else {"Size": 3}
        return {k: v for k, v in base.items() if k not in self._removed} | self._set

    def page_tree(self) -> pagetree.PageTree:
        return pagetree.read_page_tree(self)

    def pages(self) -> list[pagetree.Page]:
        return self.page_tree().pages

    def page_attribute(self, index: int, key: str) -> Any:
        pages = self.pages()
        if not 0 <= index < len(pages):
            raise IndexError(f"there is no page {index}")
        return self.resolve(pagetree.inherited(pages[index], key))

    def set(self, number: int, value: Any, generation: int = 0) -> None:
        if number < 1:
            raise WriteError("object numbers begin at 1")
        self._deleted.discard((number, generation))
        self._changed[number, generation] = value
        if self._referenced is not None:
            self._referenced.update(r.number for r in references(value))

    def delete(self, number: int, generation: int = 0) -> None:
        self._changed.pop((number, generation), None)
        self._deleted.add((number, generation))

    def allocate(self, value: Any) -> Ref:
        """A reference to a new object: the first number that nothing defines or refers to."""
        if self._referenced is None:
            self._referenced = {r.number for r in references(self.trailer())}
            for _, _, own in self.document.collect() if self.document else ():
                self._referenced.update(r.number for r in references(own))
            for own in self._changed.values():
                self._referenced.update(r.number for r in references(own))
        known = set(self.document.entries) if self.document else {0}
        taken = self._referenced | known | {n for n, _ in self._changed} | {n for n, _ in self._deleted}
        number = max([1, self.document.size if self.document else 3, *(n + 1 for n in known)])
        while number in taken:
            number += 1
        self.set(number, value)
        return Ref(number)

    def set_trailer_entry(self, key: str, value: Any) -> None:
        if key in _FIXED_TRAILER:
            raise WriteError(f"/{key} is computed")
        self._removed.discard(key)
        self._set[key] = value

    def remove_trailer_entry(self, key: str) -> None:
        if key in (*_FIXED_TRAILER, "Root"):
            raise WriteError(f"/{key} can't be removed")
        self._set.pop(key, None)
        self._removed.add(key)

    def changed(self) -> list[tuple[int, int, Any]]:
        """(number, generation, value) of what was set or allocated, by number."""
        return [(n, g, v) for (n, g), v in sorted(self._changed.items(), key=lambda item: item[0])]

    def deleted(self) -> list[tuple[int, int]]:
        """(number, generation of the free entry) of what was deleted, by number."""
        return [(n, g + 1) for n, g in sorted(self._deleted)]

    @property
    def dirty(self) -> bool:
        return bool(self._changed or self._deleted or self._removed or self._set)

    def _settle_page_tree(self) -> None:
        """Refuse a broken page tree; make wrong counts right, each under its own generation."""
        tree = self.page_tree()
        broken = pagetree.check_page_tree(self, tree)
        if broken:
            raise Refusal(broken)
        for ref, (entries, count) in pagetree.count_corrections(self, tree).items():
            self.set(ref.number, pagetree.with_count(entries, count), ref.generation)

    def save(self, *, version: str | None = None, xref: writer.Form = "table", object_streams: bool = False) -> bytes:
        if self.document:
            self.document.require_history()
        self._settle_page_tree()
        gone = {n for n, _ in self._deleted}
        merged = {n: (n, g, v) for n, g, v in (self.document.collect() if self.document else ()) if n not in gone}
        merged |= {n: (n, g, v) for n, g, v in self.changed()}
        return writer.write_file(list(merged.values()), self.trailer(), version=version or self.version, xref=xref, object_streams=object_streams)

    def append_update(self, *, xref: writer.Form = "table") -> bytes:
        if self.document is None:
            raise WriteError("a created document has no file to update")
        self._settle_page_tree()
        return writer.append_update_to(self.document, self.changed(), self.deleted(), xref=xref, trailer=self.trailer())
