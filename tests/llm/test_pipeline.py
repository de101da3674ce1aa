from collections import defaultdict

import corpus_pipeline
from quire.llm.common import read_table
from tests.llm.test_line_dedup import brute as brute_lines
from tests.llm.test_near_dedup import brute as brute_copies


def test_stages_against_brute_force(spark, sf):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_classifier", "line_dedup", "minhash_near_dedup", "best_fit_packing"]
    docs = read_table(spark, sf, "documents")
    columns = docs.columns
    quality = {r.doc_id: r.quality for r in read_table(spark, sf, "labels").collect()}

    good = corpus_pipeline.keep_good(spark, docs, sf).persist()
    assert good.columns == columns
    kept = {r.doc_id for r in good.collect()}
    right = [(i in kept) == bool(q) for i, q in quality.items()]
    assert sum(right) >= 0.95 * len(right)

    cut = corpus_pipeline.drop_boilerplate(spark, good, sf).persist()
    assert cut.columns == columns
    want = brute_lines([(r.doc_id, r.text, r.source) for r in good.collect()], spare=True)
    rows = cut.collect()
    assert {r.doc_id: r.text for r in rows} == {i: t for i, [(t, _, _)] in want.items()}
    assert all(r.n_chars == len(r.text) for r in rows)

    single = corpus_pipeline.drop_near_copies(spark, cut, sf).persist()
    assert single.columns == columns
    components = brute_copies([(r.doc_id, r.text) for r in rows], 5, 80)
    assert sorted(r.doc_id for r in single.collect()) == sorted(i for i, (_, _, k) in components.items() if k)

    packed = corpus_pipeline.pack(spark, single, sf).collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in single.collect()}
    filled = defaultdict(int)
    for r in packed:
        filled[r.sequence_id] += r.length
    assert max(filled.values()) <= 2048
    assert len(filled) <= 1.02 * sum(filled.values()) / 2048 + 2
    for table in (good, cut, single):
        table.unpersist()


def test_run_and_edges(spark, sf, tmp_path):
    assert {"doc_id", "piece", "sequence_id", "offset"} <= set(corpus_pipeline.run(spark, sf).columns)
    docs = read_table(spark, sf, "documents")
    odd = spark.createDataFrame([(1, None, None, None, None), (1, None, None, None, None), (2, "", "", "", 0), (None, "x", "en", "s", 1)], docs.schema)
    for table in (docs.limit(0), odd):
        n = table.count()
        for _, stage in corpus_pipeline.STAGES[:-1]:
            table = stage(spark, table, sf)
            assert table.count() <= n and table.columns == docs.columns
        packed = corpus_pipeline.pack(spark, table, sf).collect()
        assert len(packed) == table.count()
        assert n == 0 or ({r.doc_id for r in packed} == {None, 1, 2} and {r.length for r in packed} == {1, 2})
