"""Byte-level BPE over public vocabulary files.

Splitting needs the class of a character only: letter, number, white space or
other.  Unicode tables of different age disagree on some code points, so the
class of every code point outside a few settled ranges is asked from both
splitters once, by probes, and remembered.  Where they agree, and that is
nearly everywhere, the merges of the rank file give the library's ids.  A text
with a code point on which they disagree is cut at single spaces between
settled characters, which are boundaries for any splitter, and only the
stretches that hold such a code point go to the library.
"""

from __future__ import annotations

import base64
import json
import re
from functools import cached_property, lru_cache

import numpy as np
import regex
import tiktoken
from public_tokenizers import PATTERN
from tokenizers import Tokenizer

#: Code points outside these ranges are probed.
UNSETTLED = re.compile("[^\x01-՗‐-⁤₠-€、-ヾ一-龥가-힣]")
#: The gaps at which every splitter cuts: one space between settled characters that aren't white space.
SAFE_GAP = re.compile(r"(?<=[!-~¡-՗一-龥가-힣]) (?=[!-~¡-՗一-龥가-힣])")
#: White space around a single space, where pieces can't be cut apart.
WIDE_GAP = re.compile(r"\s (?:\s|\Z)")

MEMO_ENTRIES = 300_000
MEMO_CHARS = 48
#: One character of each class, in the order of their numbers.
PROBES = ("a", "1", "!", "\n")


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of every byte in byte-level vocabulary files."""
    shown = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def ranks_of_json(path: str) -> tuple[dict[bytes, int], dict[str, int]]:
    """Ranks and special tokens of a byte-level BPE file.

    The ids are ranks only where the k-th merge makes the id after the 256
    bytes and k earlier merges; this is checked, not assumed.
    """
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    model, alphabet = spec["model"], byte_alphabet()
    if model["type"] != "BPE" or (spec["pre_tokenizer"] or {}).get("type") != "ByteLevel" or spec["normalizer"]:
        raise ValueError(f"{path} is not a plain byte-level BPE file")
    vocabulary = model["vocab"]
    for k, merge in enumerate(model["merges"]):
        left, right = merge.split(" ") if isinstance(merge, str) else merge
        if vocabulary[left + right] != 256 + k:
            raise ValueError(f"{path}: merge {k} is out of order")
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    return {bytes(alphabet[c] for c in text): i for text, i in vocabulary.items() if text not in special}, special


def ranks_of_file(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}


class Memo(dict):
    """Piece to value; forgets everything when full, which bounds it."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, piece: str):
        value = self.make(piece)
        if len(piece) <= MEMO_CHARS:
            if len(self) >= MEMO_ENTRIES:
                self.clear()
            self[piece] = value
        return value


class Classes:
    """Whether two splitters agree on the class of a code point; each is asked once.

    A splitter here tells from a two-character string whether both characters
    are in one pre-token.
    """

    def __init__(self, *joins):
        self.joins = joins
        self.known: dict[str, bool] = {}

    def __call__(self, char: str) -> bool:
        agreed = self.known.get(char)
        if agreed is None:
            told = {tuple(join(p + char) for p in PROBES) for join in self.joins}
            agreed = self.known[char] = len(told) == 1 and sum(next(iter(told))) == 1
        return agreed

    def odd(self, text: str) -> bool:
        """Whether the text holds a code point on which the splitters differ."""
        if not UNSETTLED.search(text):
            return False
        return not all(map(self, set(UNSETTLED.findall(text))))


def regex_joins(split):
    return lambda pair: len(split(pair)) == 1


def library_joins(path: str):
    return lambda pair: len(library(path).pre_tokenizer.pre_tokenize_str(pair)) == 1


def rank_joins():
    """The splitter of the rank library, through a vocabulary in which every probe merges with the next byte."""
    ranks = {bytes([b]): b for b in range(256)}
    for p in PROBES:
        for b in (0, *range(128, 256)):
            ranks[p.encode() + bytes([b])] = len(ranks)
    core = tiktoken.Encoding("probe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})._core_bpe
    return lambda pair: any(i > 255 for i in core.encode_ordinary(pair))


def stretches(text: str) -> list[str]:
    """The text cut before every safe gap."""
    first, *rest = SAFE_GAP.split(text)
    return [first, *[" " + x for x in rest]]


class Bpe:
    """Ids of texts as little-endian unsigned 32-bit integers.

    ``whole`` is the library's own function from a text to its ids;
    ``classes`` compares its splitter with the one used here.
    """

    def __init__(self, ranks: dict[bytes, int], special: dict[str, int], whole, classes: Classes):
        self.core = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})._core_bpe
        self.split = regex.compile(PATTERN).findall
        self.special = special
        self.special_split = re.compile("(" + "|".join(map(re.escape, special)) + ")").split if special else None
        self.whole = whole
        self.classes = classes
        self.ranks = ranks

    @cached_property
    def tokens(self) -> dict[int, bytes]:
        return {i: token for token, i in self.ranks.items()}

    def merge(self, pre_token: str) -> list[int]:
        return self.core.encode_single_piece(pre_token.encode())

    def encode(self, text: str) -> bytes:
        """Special strings become their ids where the vocabulary file has any."""
        if self.special_split is None:
            return self.encode_plain(text)
        parts = self.special_split(text)
        if len(parts) == 1:
            return self.encode_plain(text)
        return b"".join(
            np.array([self.special[p]], "<u4").tobytes() if i % 2 else self.encode_plain(p) for i, p in enumerate(parts)
        )

    def encode_plain(self, text: str) -> bytes:
        if not self.classes.odd(text):
            return np.array(self.core.encode_ordinary(text), "<u4").tobytes()
        ids: list[int] = []
        for part in stretches(text):
            ids += self.whole(part) if self.classes.odd(part) else self.core.encode_ordinary(part)
        return np.array(ids, "<u4").tobytes()

    def pieces(self, text: str) -> list[str]:
        """Parts whose pre-tokens are those of the text; not for texts with odd code points."""
        if not text:
            return []
        if WIDE_GAP.search(text):
            return self.split(text)
        first, *rest = text.split(" ")
        return [first, *[" " + x for x in rest]] if first else [" " + x for x in rest]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(maxsize=4)
def library(path: str) -> Tokenizer:
    return Tokenizer.from_file(path)


@lru_cache(maxsize=4)
def json_bpe(path: str) -> Bpe:
    """As ``tokenizers`` encodes, without added special tokens; the library is loaded where a code point needs it."""
    ranks, special = ranks_of_json(path)
    plain = lambda text: library(path).encode(text, add_special_tokens=False).ids
    classes = Classes(library_joins(path), rank_joins(), regex_joins(regex.compile(PATTERN).findall))
    return Bpe(ranks, special, plain, classes)


@lru_cache(maxsize=4)
def rank_bpe(path: str) -> Bpe:
    """As ``tiktoken`` encodes ordinary text."""
    ranks = ranks_of_file(path)
    encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return Bpe(ranks, {}, encoding.encode_ordinary, Classes(rank_joins(), regex_joins(regex.compile(PATTERN).findall)))
