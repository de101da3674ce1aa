import random

import numpy as np
import pytest

from quire.llm import quality

GOOD = "the of and to in is that for was with house river morning people window letter walked slowly under bright".split()


def text(rng, good):
    words = [rng.choice(GOOD) for _ in range(rng.randrange(30, 200))]
    if good:
        return " ".join(words).capitalize() + "."
    kind = rng.randrange(3)
    if kind == 0:
        return " ".join(w + rng.choice(("###", "***", "&&&")) for w in words)
    return " ".join(words[:1] * 80) if kind == 1 else " ".join(words).upper().replace(" ", "!! ")


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(5)
    rows = []
    for i in range(1500):
        good = rng.random() < 0.8
        source = "spam.example" if not good and rng.random() < 0.7 else rng.choice(("a", "b", "c"))
        rows.append((i, text(rng, good), "en", source, int(good)))
    docs = spark.createDataFrame([(*r[:4], "x") for r in rows], "doc_id long, text string, lang string, source string, y string")
    labels = spark.createDataFrame([(r[0], r[4]) for r in rows if r[0] % 3 == 0], "doc_id long, quality int")
    return docs, labels, {r[0]: r[4] for r in rows}


def test_held_out_accuracy(spark, corpus):
    docs, labels, truth = corpus
    got = quality.classify(spark, docs, labels, keep_cols=("text",)).collect()
    assert len(got) == len(truth)
    assert all(0 <= r.quality_p <= 1 and r.text for r in got)
    unseen = [r for r in got if r.doc_id % 3]
    assert np.mean([r.keep == bool(truth[r.doc_id]) for r in unseen]) > 0.97


def test_views_exchange_labels():
    rng = np.random.default_rng(0)
    y = (rng.random(3000) < 0.5).astype(float)
    clear = np.stack([y * 4 + rng.normal(size=3000)], 1)
    noisy = np.stack([y * 2 + rng.normal(size=3000) * 1.2], 1)
    few = slice(0, 200)
    views, pool = [clear[few], noisy[few]], quality.ArrayPool([clear[200:2000], noisy[200:2000]])
    alone = quality.co_train(views, y[few], pool, rounds=0)
    both = quality.co_train(views, y[few], pool)
    test = [clear[2000:], noisy[2000:]]
    right = lambda m: np.mean((m.combine(*m.view_logits(test)) > 0) == (y[2000:] > 0))
    assert right(both) > 0.96
    assert right(both) >= right(alone) - 0.01


def test_shapes_see_whole_words():
    views = quality.Views()
    head = "中文没有空格" * 100
    shapes = [views.content(head + tail)[: quality.SHAPES] for tail in ("", "#1!", "#1?", "#1?" * 200 + "|")]
    assert len({s.tobytes() for s in shapes}) == len(shapes)
    assert all(len(k) <= 256 for k in views.shapes)
    a, b = (views.content(f"river {w} house")[quality.SHAPES :][: quality.WORDS] for w in ("window", "morning"))
    assert (a != b).any() and np.array_equal(a, views.content("RIVER Window house")[quality.SHAPES :][: quality.WORDS])


def test_all_unlabelled_rows_are_asked(spark):
    rng = np.random.default_rng(1)
    y = (rng.random(4000) < 0.5).astype(float)
    views = [np.stack([y * 4 - 2 + rng.normal(size=4000) * 0.3], 1).astype(np.float16).astype(float) for _ in range(2)]
    model = quality.co_train([v[:400] for v in views], y[:400], quality.ArrayPool([v[:0] for v in views]))
    rows = [(i, *(v[i].astype(np.float16).tobytes() for v in views)) for i in range(4000)] + [(7, *(v[7].astype(np.float16).tobytes() for v in views))] * 50
    table = spark.createDataFrame([(i, bytearray(a), bytearray(b)) for i, a, b in rows], "id long, content binary, meta binary")
    taken = [{1, 2, 3}, set()]
    stored = quality.StoredPool(table).sure(model, taken, 0, 300)
    arrays = quality.ArrayPool(views).sure(model, taken, 0, 300)
    assert sorted(r[:3] for r in stored) == sorted(r[:3] for r in arrays)
    for view, label in ((0, 0), (0, 1), (1, 0), (1, 1)):
        ids = [r[2] for r in stored if r[:2] == (view, label)]
        assert len(ids) == len(set(ids)) == 300 and max(ids) > 3500 and min(ids) < 500
        assert np.mean(y[ids] == label) > 0.95
    assert not {r[2] for r in stored if r[0] == 1} & {1, 2, 3}


def test_accuracy_on_labels_that_no_fit_saw(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf.replace('0.001', '0.01')}/{t}.parquet") for t in ("documents", "labels"))
    got = {r.doc_id: r.keep for r in quality.classify(spark, docs, labels.where("xxhash64(doc_id) % 10 < 6")).collect()}
    unseen = [(r.doc_id, r.quality) for r in labels.where("xxhash64(doc_id) % 10 >= 6").collect()]
    assert len(unseen) > 80
    assert np.mean([got[i] == bool(q) for i, q in unseen]) > 0.97


def test_edges(spark, corpus):
    docs, labels, _ = corpus
    odd = spark.createDataFrame([(1, None, None, None), (1, None, None, None), (2, "", "", ""), (None, "x " * 100_000, "en", "a")], docs.drop("y").schema)
    model = quality.fit(spark, docs, labels)
    assert quality.score(spark, odd, model).count() == 4
    twice = labels.union(labels.limit(30).selectExpr("doc_id", "0 AS quality"))
    assert quality.classify(spark, docs.limit(20), twice).count() == 20
    for no_labels in (labels.limit(0), labels.where("quality = 1")):
        rows = quality.classify(spark, docs.limit(20), no_labels).collect()
        assert len(rows) == 20 and all(r.keep and r.quality_p is None for r in rows)
    assert quality.classify(spark, docs.limit(0), labels).count() == 0
