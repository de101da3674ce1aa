import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quire.llm import packing
from quire.llm.catalog import BPE_JSON
from quire.llm.common import Scratch


def bins_of(rows, capacity):
    bins = defaultdict(list)
    for length, sequence, offset in rows:
        bins[sequence].append((offset, length))
    for content in bins.values():
        at = 0
        for offset, length in sorted(content):
            assert offset == at
            at += length
        assert at <= capacity
    return bins


@pytest.mark.parametrize(("n", "high"), [(0, 2047), (1, 5), (3000, 2048), (20000, 1200)])
def test_sequences_are_valid_and_few(spark, n, high):
    rng = random.Random(n)
    lengths = [min(high, 1 + int(rng.lognormvariate(6.3, 0.9))) for _ in range(n)]
    items = spark.createDataFrame(list(enumerate(lengths)), "item long, length long")
    got = packing.pack(spark, items).collect()
    assert sorted(r["item"] for r in got) == list(range(n))
    bins = bins_of([(lengths[r["item"]], r.sequence_id, r.offset) for r in got], 2048)
    least = -(-sum(lengths) // 2048)
    assert len(bins) <= least * 1.01 + 1


class FewTables(Scratch):
    def keep(self, df, name):
        assert self.count < 40, "the levels don't end"
        return super().keep(df, name)


@pytest.mark.parametrize("kind", ["single", "pairs", "copies", "small"])
def test_levels_end_where_no_bin_is_full(spark, kind):
    rng = random.Random(7)
    lengths = {
        "single": [1100] * 5000,
        "pairs": [rng.randrange(700, 1001) for _ in range(9000)],
        "copies": [1500] * 6000 + [rng.randrange(1, 2048) for _ in range(6000)],
        "small": [100] * 9000,
    }[kind]
    items = spark.createDataFrame(list(enumerate(lengths)), "item long, length long")
    got = packing.pack(spark, items, scratch=FewTables(spark, "packing")).collect()
    assert sorted(r["item"] for r in got) == list(range(len(lengths)))
    bins = bins_of([(lengths[r["item"]], r.sequence_id, r.offset) for r in got], 2048)
    whole = packing.Solution([], [])
    packing.best_fit(whole, sorted(range(len(lengths)), key=lambda i: -lengths[i]), lengths, 2048)
    assert len(bins) <= len(whole.bins) * 1.01 + 1


def test_crossover_keeps_every_item_once():
    rng = random.Random(2)
    sizes = [rng.randrange(1, 101) for _ in range(300)]
    parents = []
    for _ in range(2):
        order = list(range(300))
        rng.shuffle(order)
        parents.append(packing.Solution([], []))
        packing.best_fit(parents[-1], order, sizes, 100)
    child = packing.crossover(*parents, sizes, 100, rng)
    assert sorted(i for b in child.bins for i in b) == list(range(300))
    assert child.room == [100 - sum(sizes[i] for i in b) for b in child.bins]
    assert min(child.room) >= 0


def best_fit_decreasing(sizes, capacity):
    whole = packing.Solution([], [])
    packing.best_fit(whole, sorted(range(len(sizes)), key=lambda i: -sizes[i]), sizes, capacity)
    return whole


@pytest.mark.parametrize("decreasing", [True, False])
def test_crossover_beats_best_fit_decreasing(decreasing):
    rng = random.Random(3)
    sizes = []
    for _ in range(200):  # three items fill a bin exactly, and best-fit decreasing doesn't find them
        a = rng.randrange(780, 1000)
        b = rng.randrange(512, (2048 - a) // 2 + 1)
        sizes += [a, b, 2048 - a - b]
    plain = len(best_fit_decreasing(sizes, 2048).bins)
    first = packing.evolve(sizes, 2048, [], 1, 0, decreasing=decreasing)
    found = packing.evolve(sizes, 2048, [], 1, packing.GENERATIONS, decreasing=decreasing)
    assert plain > 220 and len(first.bins) > 220
    assert len(found.bins) <= 210
    assert sorted(i for b in found.bins for i in b) == list(range(600))
    assert found.room == [2048 - sum(sizes[i] for i in b) for b in found.bins] and min(found.room) >= 0


def test_evolution_is_no_worse_than_its_elite():
    rng = random.Random(4)
    sizes = [rng.randrange(200, 700) for _ in range(200)]
    first = packing.evolve(sizes, 1000, [], 1, 0)
    later = packing.evolve(sizes, 1000, [first], 2, 30)
    assert len(later.bins) <= len(first.bins)


def test_documents(spark, sf):
    extra = spark.createDataFrame(
        [(-1, None), (-2, ""), (-3, "x " * 2047), (-4, "x " * 2048), (-5, "the " * 9000), (-5, "the " * 9000)], "doc_id long, text string"
    )
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").unionByName(extra)
    library = Tokenizer.from_file(BPE_JSON)
    got = packing.pack_documents(spark, docs.withColumn("piece", F.lit("clash")), BPE_JSON).collect()
    bins_of([(r.length, r.sequence_id, r.offset) for r in got], 2048)
    pieces = defaultdict(list)
    for r in got:
        pieces[r.doc_id].append(r)
    for doc_id, text in docs.distinct().collect():
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        own = sorted({(r.piece, r.start, r.length, r.ids_crc32) for r in pieces[doc_id]})
        at = 0
        for k, (piece, start, length, crc) in enumerate(own):
            assert (piece, start) == (k, at)
            assert length == 2048 or k == 0
            assert crc == zlib.crc32(ids[start : start + length].tobytes())
            at += length
        assert at == len(ids)
    assert len(pieces[-5]) == 2 * len({r.piece for r in pieces[-5]})
    assert len(got) == sum(map(len, pieces.values()))
