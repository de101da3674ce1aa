import random

import numpy as np
import pytest

from quire.llm import common, minhash, near_dedup
from quire.llm.near_dedup import near_duplicates


def brute(rows, width, percent):
    """Components by comparing every pair of sets of word tuples."""
    sets = {}
    for i, text in rows:
        words = (text or "").encode().lower().split()
        n = min(width, len(words))
        sets[i] = {tuple(words[k : k + n]) for k in range(len(words) - n + 1)} if words else set()
    label = {i: i for i in sets}

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            shared = len(sets[a] & sets[b])
            if shared and 100 * shared >= percent * (len(sets[a]) + len(sets[b]) - shared):
                one, two = sorted((find(a), find(b)))
                label[two] = one
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


def check(spark, rows, width=4):
    table = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, node string, n int")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_duplicates(spark, table, width=width).collect()}
    assert got == brute(rows, width, 80)


def words(rng, n):
    return [rng.choice("alpha beta Gamma delta eps zeta eta theta iota kappa".split()) + str(rng.randrange(400)) for _ in range(n)]


def edited(rng, base, changes):
    out = list(base)
    for _ in range(changes):
        out[rng.randrange(len(out))] = "edit%d" % rng.randrange(10**6)
    return out


def test_edges(spark):
    text = "One two\tthree\nfour five six"
    rows = [
        (9, text), (3, text.lower()), (4, text.upper()), (5, None), (6, ""), (7, " \n"), (8, "one two"), (2, "ONE  two"),
        (11, "one two three"), (12, "ünï x"), (13, "ÜNÏ x"), (14, "one\x0btwo"), (15, "one\xa0two"),
    ]
    check(spark, rows)


@pytest.mark.parametrize("rows_held", [None, 3])
def test_groups_of_near_copies(spark, rows_held, monkeypatch):
    if rows_held:  # every key beyond the third is shuffled, and small groups are split
        monkeypatch.setattr(common.hot_join, "__kwdefaults__", {**common.hot_join.__kwdefaults__, "rows": rows_held})
        monkeypatch.setattr(near_dedup, "PART_ROWS", 8)
        monkeypatch.setattr(near_dedup, "PAIR_ROWS", 8)
    rng = random.Random(3)
    rows = []
    for size, changes in ((2, 1), (5, 3), (40, 5), (120, 6), (60, 9)):
        base = words(rng, 150)
        rows += [" ".join(edited(rng, base, rng.randrange(changes + 1))) for _ in range(size)]
    passage = words(rng, 60)
    rows += [" ".join(words(rng, rng.randrange(20, 120)) + passage) for _ in range(60)]
    chain = words(rng, 200)
    for _ in range(12):  # each is near the one before, and the ends are far apart
        chain = edited(rng, chain, 3)
        rows.append(" ".join(chain))
    rng.shuffle(rows)
    check(spark, list(enumerate(rows)))


@pytest.mark.parametrize("width", [4, 5])
def test_documents(spark, sf, width):
    table = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in table.collect()]
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_duplicates(spark, table, width=width).collect()}
    assert got == brute(rows, width, 80)


def test_repeated_and_no_rows(spark):
    table = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, "x")], "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.component_id, r.kept) for r in near_duplicates(spark, table).collect())
    assert got == [(-1, 1, False), (1, 1, True), (1, 1, True), (2, 2, True)]
    assert near_duplicates(spark, table.limit(0)).count() == 0


@pytest.mark.parametrize("similarity", [0.2, 0.5, 0.8])
def test_signatures_estimate_similarity(similarity):
    rng = np.random.default_rng(5)
    circulant = minhash.Circulant(64, 4)
    seen = []
    for _ in range(40):
        n = 600
        shared = round(2 * n * similarity / (1 + similarity))
        pool = rng.integers(0, 2**63, 2 * n - shared, dtype=np.uint64)
        a, b = np.sort(pool[:n]), np.sort(pool[n - shared :])
        seen.append((circulant.signature(a) == circulant.signature(b)).mean())
    assert abs(np.mean(seen) - similarity) < 0.02
