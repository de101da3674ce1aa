"""A second reader of zlib data, in plain Python and apart from the library, to compare the library with."""

from __future__ import annotations

import zlib

from .values import FilterError

# The order of code-length codes, and length and distance codes as rules.
ORDER = (16, 17, 18, 0, 8, 7, 9, 6, 10, 5, 11, 4, 12, 3, 13, 2, 14, 1, 15)


def _ranges(first: int, codes: int, group: int) -> list[tuple[int, int]]:
    """(base, extra bits): ``group`` codes for each number of extra bits, after twice as many without any."""
    out, base = [], first
    for k in range(codes):
        bits = max(0, k // group - 1)
        out.append((base, bits))
        base += 1 << bits
    return out


LENGTHS = [*_ranges(3, 28, 4), (258, 0)]
DISTANCES = _ranges(1, 30, 2)


class _Bits:
    def __init__(self, data: bytes, at: int):
        self.data, self.at, self.held, self.n = data, at, 0, 0

    def need(self, count: int) -> None:
        while self.n < count:
            if self.at >= len(self.data):
                raise FilterError("inflate: the data is cut off")
            self.held |= self.data[self.at] << self.n
            self.at += 1
            self.n += 8

    def take(self, count: int) -> int:
        self.need(count)
        value = self.held & ((1 << count) - 1)
        self.held >>= count
        self.n -= count
        return value

    def symbol(self, codes: dict[tuple[int, int], int]) -> int:
        """The symbol whose code, sent highest bit first, comes next."""
        code = 0
        for size in range(1, 16):
            code = code << 1 | self.take(1)
            found = codes.get((size, code))
            if found is not None:
                return found
        raise FilterError("inflate: no code fits")


def canonical(sizes: list[int]) -> dict[tuple[int, int], int]:
    """(size, code) to symbol, codes of a size in the order of their symbols; over-full sets are refused."""
    code, out = 0, {}
    for size in range(1, 16):
        code <<= 1
        for symbol, own in enumerate(sizes):
            if own == size:
                out[size, code] = symbol
                code += 1
        if code > 1 << size:
            raise FilterError("inflate: more codes than fit")
    return out


FIXED = canonical([8] * 144 + [9] * 112 + [7] * 24 + [8] * 8), canonical([5] * 30)


def _dynamic(bits: _Bits):
    n_lengths, n_distances, n_sizes = bits.take(5) + 257, bits.take(5) + 1, bits.take(4) + 4
    own = [0] * 19
    for k in range(n_sizes):
        own[ORDER[k]] = bits.take(3)
    codes, sizes = canonical(own), []
    while len(sizes) < n_lengths + n_distances:
        symbol = bits.symbol(codes)
        if symbol < 16:
            sizes.append(symbol)
        elif symbol == 16:
            if not sizes:
                raise FilterError("inflate: nothing to repeat")
            sizes += sizes[-1:] * (3 + bits.take(2))
        else:
            sizes += [0] * (3 + bits.take(3) if symbol == 17 else 11 + bits.take(7))
    if len(sizes) > n_lengths + n_distances:
        raise FilterError("inflate: too many code sizes")
    return canonical(sizes[:n_lengths]), canonical(sizes[n_lengths:])


def inflate(data: bytes) -> bytes:
    """Whole zlib data: header, blocks and checksum, and nothing behind them."""
    if len(data) < 2 or data[0] & 15 != 8 or (data[0] << 8 | data[1]) % 31 or data[1] & 32:
        raise FilterError("inflate: no zlib header")
    bits, out = _Bits(data, 2), bytearray()
    last = 0
    while not last:
        last, kind = bits.take(1), bits.take(2)
        if kind == 0:
            bits.held = bits.n = 0
            size, check = bits.take(16), bits.take(16)
            if size ^ check != 0xFFFF or bits.at + size > len(data):
                raise FilterError("inflate: a stored block is damaged")
            out += data[bits.at : bits.at + size]
            bits.at += size
            continue
        if kind == 3:
            raise FilterError("inflate: no such block")
        literals, distances = FIXED if kind == 1 else _dynamic(bits)
        while (symbol := bits.symbol(literals)) != 256:
            if symbol < 256:
                out.append(symbol)
                continue
            if symbol - 257 >= len(LENGTHS):
                raise FilterError("inflate: no such length")
            base, extra = LENGTHS[symbol - 257]
            length = base + bits.take(extra)
            code = bits.symbol(distances)
            if code >= len(DISTANCES):
                raise FilterError("inflate: no such distance")
            base, extra = DISTANCES[code]
            back = base + bits.take(extra)
            if back > len(out):
                raise FilterError("inflate: a distance goes before the start")
            for _ in range(length):
                out.append(out[-back])
    if data[bits.at :] != zlib.adler32(out).to_bytes(4, "big"):
        raise FilterError("inflate: wrong checksum, or bytes behind the end")
    return bytes(out)


def differs(data: bytes, library) -> bool:
    """Whether the two readers disagree, on the bytes or on whether there are any."""

    def result(reader):
        try:
            return reader(data)
        except FilterError:
            return None

    return result(inflate) != result(library)
