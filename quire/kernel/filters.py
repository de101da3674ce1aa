"""Stream filters: FlateDecode with its predictors, and nothing else."""

from __future__ import annotations

import zlib
from typing import Any

import numpy as np

from .values import FilterError, Name, Ref, Stream, get


def adler32(data: bytes) -> int:
    return zlib.adler32(data)


def inflate(data: bytes) -> bytes:
    """Strict zlib data: one whole stream with a right checksum and nothing behind it."""
    decoder = zlib.decompressobj()
    try:
        out = decoder.decompress(data) + decoder.flush()
    except zlib.error as error:
        raise FilterError(f"FlateDecode: {error}") from None
    if not decoder.eof:
        raise FilterError("FlateDecode: the data is cut off")
    if decoder.unused_data:
        raise FilterError("FlateDecode: bytes follow the end of the data")
    return out


DEFAULT_PREDICTOR = {"Predictor": 1, "Colors": 1, "BitsPerComponent": 8, "Columns": 1}


def apply_predictor(data: bytes, parms: dict[str, int]) -> bytes:
    p = {**DEFAULT_PREDICTOR, **parms}
    predictor = p["Predictor"]
    if predictor == 1:
        return data
    if min(p["Colors"], p["BitsPerComponent"], p["Columns"]) < 1:
        raise FilterError("predictor parameters shall be positive")
    row = (p["Colors"] * p["BitsPerComponent"] * p["Columns"] + 7) // 8
    if predictor == 2:
        return _undo_tiff(data, row, p)
    if 10 <= predictor <= 15:
        return _undo_png(data, row, max(1, (p["Colors"] * p["BitsPerComponent"] + 7) // 8))
    raise FilterError(f"predictor {predictor} is unknown")


def _undo_tiff(data: bytes, row: int, p: dict[str, int]) -> bytes:
    if p["BitsPerComponent"] != 8:
        raise FilterError("the TIFF predictor is read for 8 bits only")
    if len(data) % row:
        raise FilterError("the data is no whole number of rows")
    pixels = np.frombuffer(data, np.uint8).reshape(-1, p["Columns"], p["Colors"])
    return np.cumsum(pixels, axis=1, dtype=np.uint8).tobytes()


def _undo_png(data: bytes, row: int, step: int) -> bytes:
    if len(data) % (row + 1):
        raise FilterError("the data is no whole number of rows")
    lines = np.frombuffer(data, np.uint8).reshape(-1, row + 1)
    if (lines[:, 0] == 0).all():
        return lines[:, 1:].tobytes()
    if (lines[:, 0] == 2).all():  # the usual case: running sums down the columns
        return np.cumsum(lines[:, 1:], axis=0, dtype=np.uint8).tobytes()
    above = np.zeros(row, np.uint8)
    out = np.empty((len(lines), row), np.uint8)
    for k, line in enumerate(lines):
        tag, body = int(line[0]), line[1:]
        if tag == 0:
            above = body
        elif tag == 1:  # a running sum along each byte of a pixel
            padded = np.zeros(-(-row // step) * step, np.uint8)
            padded[:row] = body
            above = np.cumsum(padded.reshape(-1, step), axis=0, dtype=np.uint8).ravel()[:row]
        elif tag == 2:
            above = body + above
        elif tag in (3, 4):
            above = _undo_sequential(tag, body.tolist(), above.tolist(), step)
        else:
            raise FilterError(f"PNG row filter {tag} is unknown")
        out[k] = above
    return out.tobytes()


def _undo_sequential(tag: int, body: list[int], above: list[int], step: int) -> np.ndarray:
    now: list[int] = []
    for i, value in enumerate(body):
        left = now[i - step] if i >= step else 0
        up = above[i]
        if tag == 3:
            guess = (left + up) // 2
        else:
            corner = above[i - step] if i >= step else 0
            guess = paeth(left, up, corner)
        now.append((value + guess) & 0xFF)
    return np.array(now, np.uint8)


def paeth(left: int, up: int, corner: int) -> int:
    """The neighbour nearest to left + up - corner; ties go left, up, corner."""
    from_left, from_up = abs(up - corner), abs(left - corner)
    from_corner = abs(left + up - 2 * corner)
    if from_left <= from_up and from_left <= from_corner:
        return left
    return up if from_up <= from_corner else corner


def png_rows(data: bytes, columns: int, tags: tuple[int, ...] = (2,)) -> bytes:
    """PNG rows of 8-bit samples, one byte a pixel; row k is filtered by ``tags[k % len(tags)]``, the last is filled with zeros."""
    rows = np.frombuffer(data + b"\0" * (-len(data) % columns), np.uint8).reshape(-1, columns)
    left, above = np.zeros_like(rows), np.zeros_like(rows)
    left[:, 1:], above[1:] = rows[:, :-1], rows[:-1]
    corner = np.zeros_like(rows)
    corner[1:, 1:] = rows[:-1, :-1]
    a, b, c = (x.astype(np.int16) for x in (left, above, corner))
    far = [np.abs(b - c), np.abs(a - c), np.abs(a + b - 2 * c)]  # how far a + b - c is from a, b and c
    nearest = np.where((far[0] <= far[1]) & (far[0] <= far[2]), a, np.where(far[1] <= far[2], b, c))
    guesses = (np.zeros_like(a), a, b, (a + b) // 2, nearest)
    tag = np.array(tags, np.uint8)[np.arange(len(rows)) % len(tags)]
    guess = np.choose(tag[:, None], guesses).astype(np.uint8) if len(rows) else rows
    return np.hstack([tag[:, None], rows - guess]).tobytes()


def tiff_rows(data: bytes, columns: int, colors: int) -> bytes:
    """Rows of 8-bit samples as differences along each component; the last is filled with zeros."""
    row = columns * colors
    pixels = np.frombuffer(data + b"\0" * (-len(data) % row), np.uint8).reshape(-1, columns, colors)
    out = pixels.copy()
    out[:, 1:] -= pixels[:, :-1]
    return out.tobytes()


def decode_stream(stream: Stream, resolve=lambda value: value) -> bytes:
    """Undo a stream's filters in order."""
    names = resolve(get(stream.dict, "Filter"))
    names = [] if names is None else names if isinstance(names, list) else [names]
    parms = resolve(get(stream.dict, "DecodeParms"))
    parms = parms if isinstance(parms, list) else [parms]
    data = stream.raw
    for k, name in enumerate(names):
        name = resolve(name)
        if not isinstance(name, Name):
            raise FilterError("a filter shall be a name")
        if name != "FlateDecode":
            raise FilterError(f"the filter {name} isn't supported")
        own = resolve(parms[k]) if k < len(parms) else None
        data = apply_predictor(inflate(data), _integers(own, resolve))
    return data


def _integers(parms: Any, resolve) -> dict[str, int]:
    if parms is None:
        return {}
    if not isinstance(parms, dict):
        raise FilterError("decode parameters shall be a dictionary")
    out = {}
    for key in DEFAULT_PREDICTOR:
        value = resolve(get(parms, key))
        if value is None:
            continue
        if not isinstance(value, int) or isinstance(value, (bool, Ref)):
            raise FilterError(f"/{key} shall be an integer")
        out[key] = value
    return out


def encode_stream(data: bytes, filter_name: str | None = None) -> tuple[bytes, dict[str, Any]]:
    """Bytes and dictionary entries of a new stream; only the identity is written."""
    if filter_name is not None:
        raise FilterError(f"{filter_name} isn't written; pass no filter")
    return data, {}
