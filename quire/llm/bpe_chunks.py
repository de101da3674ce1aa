"""Byte-level BPE encoding and decoding by overlapping chunks.

A text is cut into chunks that overlap their successor.  Each chunk is split
into pre-tokens on its own; the split of a chunk is sure of a boundary unless
it lies in the last few characters, where text beyond the chunk could change
it.  Splitting runs forward only, so once two chunks share a boundary inside
their overlap they agree from there on: the stitch cuts at the first such
boundary, and the pieces between cuts are encoded.  Where an overlap shares no
boundary (a pre-token longer than the overlap) the next chunk is split anew
from the last cut, which is exact and touches only the chunks concerned.

Chunks of a long text are rows of their own, which separate tasks split and
encode.  Where a stretch holds a code point on which splitters differ (see
``vocab``), the library encodes that stretch and only safe gaps are boundaries.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left, bisect_right
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vocab
from .common import arrow_rows, partitions, pick

#: Characters at a chunk's end whose split the next character could change: "'ll" and a look-ahead.
UNSURE = 4
CHUNK_CHARS, OVERLAP = 512, 64


def ends_of(split, text: str, start: int) -> list[int]:
    """Ends of the pre-tokens of a text that begins at ``start``, and the start."""
    return list(accumulate(map(len, split(text)), initial=start))


def cuts_of(split, text: str, chunk_chars: int, overlap: int) -> list[int]:
    """Cut points from 0 to the text's length that are pre-token boundaries.

    Behind white space no cut is made: a run of white space gives its last
    character away only if text follows, so a piece must not end in one.
    """
    size = len(text)
    cuts, stop = [0], chunk_chars + overlap
    if size <= stop:
        return [0, size]
    held = ends_of(split, text[:stop], 0)
    start = 0
    while stop < size:
        start += chunk_chars
        sure = stop - UNSURE
        stop = min(size, start + chunk_chars + overlap)
        own = ends_of(split, text[start:stop], start)
        known = set(own[: bisect_right(own, sure)])
        window = held[bisect_left(held, start) : bisect_right(held, sure)]
        shared = next((e for e in window if e in known and not text[e - 1].isspace()), None)
        if shared is None:
            held = ends_of(split, text[cuts[-1] : stop], cuts[-1])
        else:
            cuts.append(shared)
            held = own
    cuts.append(size)
    return cuts


def encode_settled(bpe: vocab.Bpe, text: str, chunk_chars: int, overlap: int) -> bytes:
    cuts = cuts_of(bpe.split, text, chunk_chars, overlap)
    ids: list[int] = []
    for a, b in zip(cuts, cuts[1:]):
        ids += bpe.core.encode_ordinary(text[a:b])
    return np.array(ids, "<u4").tobytes()


def encode_text(bpe: vocab.Bpe, text: str, chunk_chars: int, overlap: int) -> bytes:
    """Encode one text through chunks, stitches and pieces; only stretches of odd code points go to the library."""
    if not bpe.classes.odd(text):
        return encode_settled(bpe, text, chunk_chars, overlap)
    out, settled = [], []
    for part in vocab.stretches(text):
        if bpe.classes.odd(part):
            out += [encode_settled(bpe, "".join(settled), chunk_chars, overlap), np.array(bpe.whole(part), "<u4").tobytes()]
            settled = []
        else:
            settled.append(part)
    return b"".join([*out, encode_settled(bpe, "".join(settled), chunk_chars, overlap)])


def boundaries(bpe: vocab.Bpe, text: str, last: bool) -> np.ndarray:
    """0 and the sure boundaries of a chunk after which it can be cut; its end too if it is the last."""
    if bpe.classes.odd(text):
        ends = [0, *(m.start() for m in vocab.SAFE_GAP.finditer(text))]
    else:
        ends = [e for e in ends_of(bpe.split, text, 0) if not e or not text[e - 1].isspace()]
    if last:
        return np.unique([*ends, len(text)])
    return np.array([e for e in ends if e <= len(text) - UNSURE])


def encode(
    docs: DataFrame,
    rank_file: str,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    chunk_chars: int = CHUNK_CHARS,
    overlap: int = OVERLAP,
    task_chars: int = 1 << 16,
) -> DataFrame:
    """Return (id, n_tokens, ids): ids as little-endian unsigned 32-bit integers.

    One row for each input row; a null or empty text has no ids.  Texts up to
    ``task_chars`` are chunked, stitched and encoded inside one task.  Longer
    ones are dealt out in chunks of that size to separate tasks, which split
    and encode them and return the boundaries inside the overlaps; the stitch
    reads those and joins the ids between cuts.
    """
    work = pick(docs, id=id_col, text=text_col)
    schema = f"`{id_col}` long, n_tokens long, ids binary"

    def short_rows():
        bpe = vocab.rank_bpe(rank_file)

        def one(row):
            ids = encode_text(bpe, row["text"] or "", chunk_chars, overlap)
            yield row["id"], len(ids) // 4, ids

        return one

    length = F.coalesce(F.char_length("text"), F.lit(0))
    short = arrow_rows(work.where(length <= task_chars), schema, short_rows)
    long = encode_long(work.where(length > task_chars), rank_file, schema, id_col, task_chars, overlap)
    return short.unionByName(long)


def encode_long(work: DataFrame, rank_file: str, schema: str, id_col: str, chunk_chars: int, overlap: int) -> DataFrame:
    """Encode texts of several chunks with a task for each chunk."""
    spark = work.sparkSession
    numbered = work.withColumn("row", F.monotonically_increasing_id())

    def cut_rows():
        def one(row):
            text = row["text"]
            for k, a in enumerate(range(0, len(text), chunk_chars)):
                end = a + chunk_chars + overlap
                yield row["row"], row["id"], k, a, len(text), end >= len(text) and a + chunk_chars >= len(text), text[a:end]

        return one

    chunks = arrow_rows(numbered, "row long, id long, k int, start long, size long, last boolean, chunk string", cut_rows)
    dealt = chunks.repartition(partitions(spark), "row", "k")

    def piece_rows():
        bpe = vocab.rank_bpe(rank_file)

        def one(row):
            text, start = row["chunk"], row["start"]
            ends = boundaries(bpe, text, row["last"])
            head, tail = ends[ends <= overlap], ends[-1:] if row["last"] else ends[ends >= chunk_chars]
            first = int(head[1]) if start and len(head) > 1 else 0
            marks = np.unique(np.concatenate([head[head >= first], tail])).astype(np.int64)
            ids, counts, at = [], [], first
            for mark in marks[marks > first]:
                ids.append(encode_text(bpe, text[at:mark], CHUNK_CHARS, OVERLAP))
                at = int(mark)
                counts.append(sum(map(len, ids[-1:])))
            offsets = np.cumsum([0, *counts]).tolist()
            known = (marks[marks >= first] + start).tolist()
            yield row["row"], row["id"], row["k"], start, row["size"], known, offsets, b"".join(ids), text

        return one

    pieces = arrow_rows(
        dealt,
        "row long, id long, k int, start long, size long, marks array<long>, offsets array<long>, ids binary, chunk string",
        piece_rows,
    )

    def join(table: pa.Table) -> pa.Table:
        bpe = vocab.rank_bpe(rank_file)
        rows = sorted(table.to_pylist(), key=lambda r: r["k"])
        whole = True
        out: list[bytes] = []
        at = 0
        for r, after in zip(rows, [*rows[1:], None]):
            place = dict(zip(r["marks"], r["offsets"]))
            shared = [m for m in r["marks"] if m >= after["start"] and m in set(after["marks"])] if after else [r["size"]]
            if at not in place or not shared or shared[0] not in place:
                whole = False
                break
            out.append(r["ids"][place[at] : place[shared[0]]])
            at = shared[0]
        if not whole:  # an overlap without a shared boundary: this text is split in one go
            text = "".join(r["chunk"][:chunk_chars] for r in rows)
            out = [encode_text(bpe, text, CHUNK_CHARS, OVERLAP)]
        ids = b"".join(out)
        return pa.table({id_col: [rows[0]["id"]], "n_tokens": [len(ids) // 4], "ids": pa.array([ids], pa.binary())})

    return pieces.groupBy("row").applyInArrow(join, schema)


def decode(encoded: DataFrame, rank_file: str, *, id_col: str = "doc_id") -> DataFrame:
    """Return (id, decoded): the concatenated raw bytes of the ids."""

    def rows():
        bpe = vocab.rank_bpe(rank_file)

        def one(row):
            yield row["id"], bpe.decode(row["ids"] or b"")

        return one

    return arrow_rows(pick(encoded, id=id_col, ids="ids"), f"`{id_col}` long, decoded binary", rows)


def encode_decode_digests(docs: DataFrame, rank_file: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Return (id, n_tokens, ids_sha256, decoded_sha256) for each row."""
    encoded = encode(docs, rank_file, id_col=id_col, text_col=text_col)

    def rows():
        bpe = vocab.rank_bpe(rank_file)

        def one(row):
            ids = row["ids"]
            yield row["id"], row["n_tokens"], hashlib.sha256(ids).hexdigest(), hashlib.sha256(bpe.decode(ids)).hexdigest()

        return one

    return arrow_rows(
        pick(encoded, id=id_col, n_tokens="n_tokens", ids="ids"),
        f"`{id_col}` long, n_tokens long, ids_sha256 string, decoded_sha256 string",
        rows,
    )
