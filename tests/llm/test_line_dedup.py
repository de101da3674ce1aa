import random
from collections import Counter, defaultdict

import pytest

from quire.llm.line_dedup import dedup_lines


def brute(rows, ratio=5, least=2, spare=False):
    pages, total = Counter(), Counter()
    for _, text, host in rows:
        total[host] += 1
        for line in {x.strip(" ") for x in (text or "").split("\n")} - {""}:
            pages[host, line] += 1
    same = Counter((host, text) for _, text, host in rows if text is not None)
    out = defaultdict(list)
    for i, text, host in rows:
        if text is None:
            out[i].append((None, 0, 0))
            continue
        lines = text.split("\n")
        bad = lambda x: pages[host, x] >= least and pages[host, x] * 100 > total[host] * ratio  # noqa: B023, E731
        kept = [x for x in lines if not x.strip(" ") or not bad(x.strip(" "))]
        if spare and (same[host, text] >= least and same[host, text] * 100 > total[host] * ratio or not any(x.strip(" ") for x in kept)):
            kept = lines
        out[i].append(("\n".join(kept), len(lines), len(lines) - len(kept)))
    return out


@pytest.mark.parametrize("spare", [False, True])
@pytest.mark.parametrize("broadcast_rows", [50_000, 3, 0])
def test_against_brute_force(spark, sf, broadcast_rows, spare):
    rng = random.Random(1)
    rows = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    for i in range(300):
        body = [f"own line {rng.randrange(10**6)} of page {i}" for _ in range(rng.randrange(1, 6))]
        if rng.random() < 0.3:
            body.insert(0, " Home | About ")
        if rng.random() < 0.04:
            body.append("rare line")
        rows.append((10_000 + i, "\n".join(body), rng.choice(["big", "big", None])))
    rows += [(20_000 + i, "a copied page\nwith two lines", "big") for i in range(60)]
    rows += [(1, None, "big"), (2, "", "big"), (6, "x" * 300_000 + "\nHome | About", "big"), (6, "lone\nlone", "one page"), (7, None, "null only"), (3, "\n\n", None), (4, "Home | About", "big"), (5, "Home | About\nHome | About\nand text that is longer than both", "big")]
    table = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, source string, line string")
    got = defaultdict(list)
    for r in dedup_lines(spark, table, broadcast_rows=broadcast_rows, spare_copies=spare).collect():
        got[r.doc_id].append((r.text, r.n_lines, r.n_dropped))
    want = brute(rows, spare=spare)
    assert {k: sorted(v, key=str) for k, v in got.items()} == {k: sorted(v, key=str) for k, v in want.items()}
    assert any(d for v in got.values() for *_, d in v)


@pytest.mark.parametrize("broadcast_rows", [50_000, 0])
def test_short_pages_lose_their_frame(spark, broadcast_rows):
    frame = "All rights are reserved by the owners of this site."
    rows = [(i, f"own line {i}\n{frame}", "a") for i in range(50)]
    rows += [(100 + i, "a copied page\nwith two lines", "a") for i in range(20)] + [(200, "a copied page\nand more", "a"), (201, frame, None), (202, frame + "\n\na copied page", "a")]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r.text for r in dedup_lines(spark, table, spare_copies=True, broadcast_rows=broadcast_rows).collect()}
    want = {i: f"own line {i}" for i in range(50)} | {100 + i: "a copied page\nwith two lines" for i in range(20)} | {200: "and more", 201: frame, 202: frame + "\n\na copied page"}
    assert got == want


def test_empty_table(spark):
    assert dedup_lines(spark, spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0
