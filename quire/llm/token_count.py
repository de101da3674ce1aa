"""Token counts by the whole-token shortcut.

Offline, on the driver, every vocabulary string is tried: it counts as a whole
token if it is valid UTF-8, the split pattern keeps it as one pre-token and the
library encodes it alone to exactly its own id.  The proven strings (at most
the vocabulary, so a bounded broadcast) then count one token wherever they
appear as a pre-token; only the other pre-tokens are merged.
"""

from __future__ import annotations

import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import vocab
from .common import arrow_rows, pick


def prove_whole_tokens(path: str) -> frozenset[str]:
    """Vocabulary strings that encode alone as one token, by trying each."""
    ranks, _ = vocab.ranks_of_json(path)
    split = regex.compile(vocab.PATTERN).fullmatch
    candidates: list[tuple[str, int]] = []
    pattern = regex.compile(vocab.PATTERN)
    for token, rank in ranks.items():
        try:
            text = token.decode()
        except UnicodeDecodeError:
            continue
        if split(text) and pattern.match(text).end() == len(text):
            candidates.append((text, rank))
    encoded = vocab.library(path).encode_batch([t for t, _ in candidates], add_special_tokens=False)
    return frozenset(text for (text, rank), e in zip(candidates, encoded) if e.ids == [rank])


class Counter:
    """Tokens of a text; counts whole tokens directly and merges the rest."""

    def __init__(self, path: str, whole: frozenset[str]):
        self.bpe = vocab.json_bpe(path)
        self.whole = whole
        self.memo = vocab.Memo(self._count_piece)

    def _count_piece(self, piece: str) -> int:
        if piece in self.whole:
            return 1
        whole, merge = self.whole, self.bpe.merge
        return sum(1 if p in whole else len(merge(p)) for p in self.bpe.split(piece))

    def count(self, text: str) -> int:
        parts = self.bpe.special_split(text) if self.bpe.special_split else [text]
        total = len(parts) // 2
        for part in parts[::2]:
            if not self.bpe.classes.odd(part):
                total += self._count_plain(part)
                continue
            for stretch in vocab.stretches(part):
                total += len(self.bpe.whole(stretch)) if self.bpe.classes.odd(stretch) else self._count_plain(stretch)
        return total

    def _count_plain(self, text: str) -> int:
        return sum(map(self.memo.__getitem__, self.bpe.pieces(text)))


def count_tokens(
    spark: SparkSession, docs: DataFrame, tokenizer_json: str, *, id_col: str = "doc_id", text_col: str = "text", limit: int = 512
) -> DataFrame:
    """Return (id, n_bytes, n_tokens, over_limit), one row for each input row.

    A null or empty text has no bytes and no tokens.  Repeated rows repeat;
    other columns are not read.  Special strings inside texts are what the
    library takes them for.  Texts are counted whole; one text is in memory at
    a time besides its Arrow batch.
    """
    proven = spark.sparkContext.broadcast(prove_whole_tokens(tokenizer_json))

    def rows():
        counter = Counter(tokenizer_json, proven.value)

        def one(row):
            text = row["text"] or ""
            yield row["id"], len(text.encode()), counter.count(text)

        return one

    counted = arrow_rows(pick(docs, id=id_col, text=text_col), f"`{id_col}` long, n_bytes long, n_tokens long", rows)
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
