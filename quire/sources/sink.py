"""Writing: object rows to files, and updates behind files."""

from __future__ import annotations

import uuid
from pathlib import Path

from pyspark.sql import DataFrame

from ..kernel import cosjson, writer
from ..kernel.editor import Editor
from ..kernel.values import PdfError
from .arrow import map_groups, map_rows

FILE = "file_id string, content binary, error string"


def assemble(objects: DataFrame, trailers: DataFrame, *, xref: writer.Form = "table", object_streams: bool = False, version: str = "1.7") -> DataFrame:
    """Files from objects (file_id, object_number, generation, cos) and trailers (file_id, trailer).

    A group is one file, which has to fit in a task's memory to be written.
    A file that can't be written has its error and no content.
    """
    rows = objects.select("file_id", "object_number", "generation", "cos").join(trailers.select("file_id", "trailer"), "file_id")

    def work(key, found):
        try:
            values = [(r["object_number"], r["generation"], cosjson.loads(r["cos"])) for r in found]
            content = writer.write_file(values, cosjson.loads(found[0]["trailer"]), version=version, xref=xref, object_streams=object_streams)
        except PdfError as error:
            return [(*key, None, str(error))]
        return [(*key, content, None)]

    return map_groups(rows, ["file_id"], FILE, work)


def apply_edits(files: DataFrame, edits: DataFrame, *, mode: str = "append", xref: writer.Form = "table") -> DataFrame:
    """Apply edits (file_id, edits) to files (file_id, content); ``mode`` is append or save.

    ``edits`` is an array of structs (action, object_number, generation, cos)
    in order; actions are set, delete and allocate.  Gather the edits of each
    file first.  The join shuffles each file once at most; a file without
    edits stays as it is.
    """
    joined = files.select("file_id", "content").join(edits.select("file_id", "edits"), "file_id", "left")

    def work(file_id, content, steps):
        if not steps:
            yield file_id, content, None
            return
        try:
            editor = Editor.open(bytes(content or b""))
            for s in steps:
                if s["action"] == "set":
                    editor.set(s["object_number"], cosjson.loads(s["cos"]), s["generation"] or 0)
                elif s["action"] == "delete":
                    editor.delete(s["object_number"], s["generation"] or 0)
                else:
                    editor.allocate(cosjson.loads(s["cos"]))
            yield file_id, editor.append_update(xref=xref) if mode == "append" else editor.save(xref=xref), None
        except Exception as error:  # noqa: BLE001 - a file's fault is its own
            yield file_id, None, str(error) if isinstance(error, PdfError) else f"{type(error).__name__}: {error}"

    return map_rows(joined, FILE, work)


def write_files(files: DataFrame, folder: str, *, name: str = "name") -> DataFrame:
    """Store (name, content) as files below a folder that every worker has mounted; return (name, n_bytes).

    A file is written beside its place and moved there, so a task that runs
    twice leaves one whole file.
    """

    def work(own, content):
        target = Path(folder) / own
        target.parent.mkdir(parents=True, exist_ok=True)
        part = target.with_name(f".{target.name}.{uuid.uuid4().hex}")
        part.write_bytes(content or b"")
        part.replace(target)
        yield own, len(content or b"")

    return map_rows(files.select(name, "content"), "name string, n_bytes long", work)


def write_table(files: DataFrame, path: str) -> None:
    """Store written files as a table of (file_id, content)."""
    files.select("file_id", "content").write.mode("overwrite").parquet(path)
