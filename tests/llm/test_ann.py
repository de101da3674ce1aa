import numpy as np

from quire.llm import ann, centroids


def brute(rows, k=20, every=20):
    rows = {i: np.array(v, np.float64) for i, v in rows if v is not None and None not in v and np.isfinite(v).all() and any(v)}
    ids = np.array(sorted(rows))
    table = np.stack([rows[i] for i in ids]) if rows else None
    out = {}
    for q in ids[ids % every == 0]:
        scores = table @ rows[q]
        order = [j for j in np.lexsort((ids, -scores)) if ids[j] != q][:k]
        out[int(q)] = [(int(ids[j]), scores[j]) for j in order]
    return out


def searched(spark, rows, **options):
    table = spark.createDataFrame([(i, v, "c") for i, v in rows], "vec_id long, embedding array<float>, q string")
    out = {}
    for r in sorted(ann.search(spark, table, **options).collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(out[r.query_id])
    return out


def test_recall_on_the_table(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    want, got = brute(rows), searched(spark, rows)
    assert set(want) == set(got)
    hits = sum(len({i for i, _ in want[q]} & {i for i, _ in got[q]}) for q in want)
    assert hits >= 0.95 * sum(map(len, want.values()))
    exact = {i: np.array(v, np.float64) for i, v in rows}
    for q, found in got.items():
        assert len(found) == 20
        assert all(abs(exact[q] @ exact[i] - s) < 1e-12 for i, s in found)


def test_copies_ties_and_bad_rows(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=6).astype(np.float32).tolist()) for i in range(200)]
    rows += [(1000 + i, rows[7][1]) for i in range(300)] + [(2000, None), (2020, [None] * 6), (2040, [0.0] * 6)]
    rows += [(2060, [float("nan")] + [1.0] * 5), (2080, [float("inf")] + [1.0] * 5), (2100, [1.0, 2.0]), rows[0], rows[20]]
    want = brute([r for r in rows if r[0] != 2100])
    got = searched(spark, rows, ratio=1e9)
    assert {q: [i for i, _ in f] for q, f in got.items()} == {q: [i for i, _ in f] for q, f in want.items()}


def test_few_and_no_rows(spark):
    assert searched(spark, []) == {}
    assert searched(spark, [(0, [1.0])]) == {}
    assert searched(spark, [(0, [1.0]), (3, [2.0]), (5, [-1.0])]) == {0: [(3, 2.0), (5, -1.0)]}


def test_graph_meets_the_lists_within_the_ratio():
    rng = np.random.default_rng(1)
    centers, points = rng.normal(size=(300, 16)), rng.normal(size=(200, 16))
    met, true = centroids.Graph(centers).search(points, 1.2), centroids.distances(points, centers)
    wanted = true <= true.min(1, keepdims=True) * 1.2
    assert (np.isfinite(met) & wanted).sum() >= 0.98 * wanted.sum()
    assert np.allclose(met[np.isfinite(met)], true[np.isfinite(met)])


def test_lists_are_balanced():
    rng = np.random.default_rng(2)
    sample = np.concatenate([rng.normal(size=(1500, 8)) * 0.2, rng.normal(size=(300, 8)) + 4])
    centers = centroids.balanced_centroids(sample, 12)
    sizes = np.bincount(centroids.distances(sample, centers).argmin(1), minlength=12)
    assert sizes.max() <= 3 * sizes.mean()


def test_border_vectors_are_replicated():
    centers = np.array([[0.0, 0.0], [10.0, 0.0], [0.0, 10.0]])
    graph = centroids.Graph(centers)
    points = np.array([[5.02, 0.0], [0.1, 0.0], [9.0, 0.0], [5.0, 5.0]])
    lists = ann.lists_of(graph, graph.search(points, ann.BORDER))
    assert [sorted(x) for x in lists] == [[0, 1], [0], [1], [0, 1, 2]]


def test_shards_are_bounded():
    sizes = {0: 10, 1: ann.SHARD_ROWS * 2 + 1, 2: ann.SHARD_ROWS - 5, 3: 5, 4: 1}
    first, parts = ann.deal(sizes)
    assert parts == {0: 1, 1: 3, 2: 1, 3: 1, 4: 1}
    filled = {}
    for j, n in sizes.items():
        for p in range(parts[j]):
            filled[first[j] + p] = filled.get(first[j] + p, 0) + -(-n // parts[j])
    assert max(filled.values()) <= ann.SHARD_ROWS
