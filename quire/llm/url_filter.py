"""URL filter by a tree of path templates for each host; DataFrame operations only.

Paths become segments with typed wildcards (numbers, numbered files, hashes).
Level by level, a node of a host's tree whose children are many and mostly
seen once is variable: its literal children become one wildcard.  Then
branches that differ in one segment only and whose labelled shares don't
differ more than chance are merged.  Each remaining template has a smoothed
purity, the share of bad pages among its labelled ones drawn towards a prior;
templates over the threshold are rejected with all pages that they cover.

The tree has as many levels as the deepest path, and a level costs the work
of the paths that reach it.

Labels come from the rules (a page that a rule blocks is bad, one that a rule
allows is good), where no rule fits from the labels given, and without any of
them from host names that hold a seed word.  The tree is built on distinct typed paths of a host with their counts,
which partial sums combine before any shuffle.  Sums and decisions are small
tables; the only join of all pages is with their path's verdict.  Hosts, nodes
and paths that very many rows share are joined by ``common.hot_join``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, hot_join, pick

#: Rules (host and path) and their verdicts.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))

#: Words of host names that label a page bad where no rule fits.
SEED_WORDS = (
    "adult", "bet", "bets", "betting", "casino", "cialis", "escort", "gambling", "jackpot", "loan", "loans", "lottery",
    "payday", "pharmacy", "pill", "pills", "poker", "porn", "replica", "slots", "viagra", "xxx",
)

#: A node is variable with this many literal children at least, and fewer than two pages for each.
MANY_CHILDREN = 10
#: Labelled pages that a branch needs to be compared with its siblings, and the squared deviations that count as chance.
BRANCH_LABELS, CHANCE = 3, 4.0
#: Weight and value of the prior, and the purity from which a template is rejected.
PRIOR_WEIGHT, PRIOR, REJECT = 4.0, 0.1, 0.5


def parse(url: Column) -> tuple[Column, Column]:
    """Host and path, both empty for null or where there is no ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), upper, lower)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def matching_rule(host: Column, path: Column, rules) -> Column:
    """Struct (length, rule, verdict) of the longest rule that fits, else null."""
    fits = []
    for rule, verdict in rules:
        r_host, _, r_path = rule.partition("/")
        ok = ((host == r_host) | F.endswith(host, F.lit("." + r_host))) & F.startswith(path, F.lit("/" + r_path))
        fits.append(F.when(ok, F.struct(F.lit(len(rule)).alias("length"), F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))))
    if not fits:
        return F.lit(None).cast("struct<length:int,rule:string,verdict:string>")
    return F.array_max(F.array(*fits))


def typed_segments(path: Column) -> Column:
    segments = F.filter(F.split(path, "/", -1), lambda x: x != "")
    return F.transform(
        segments,
        lambda x: F.when(x.rlike("^[0-9]+$"), "{n}")
        .when(x.rlike(r"^[0-9]+\.[a-z]+$"), F.concat(F.lit("{n}."), F.regexp_extract(x, r"\.([a-z]+)$", 1)))
        .when(x.rlike("^[0-9a-f-]{8,}$"), "{h}")
        .otherwise(x),
    )


def judge(
    spark: SparkSession, pages: DataFrame, *, labels: DataFrame | None = None, rules=RULES, seeds=SEED_WORDS, id_col: str = "page_id",
    url_col: str = "url", label_col: str = "bad",
) -> DataFrame:
    """Return (id, host, path, rule, verdict, template), one row for each input row.

    ``rule`` is the longest rule that fits, ties to the later in text order,
    else null; a rule's verdict stands, else the template's does.  A null url
    or one without ``://`` has an empty host and path, and is allowed unless
    the templates of the empty host say otherwise.  ``labels`` has ids with a
    boolean; of several for an id true wins.  Other columns aren't read.
    """
    scratch = Scratch(spark, "url-filter")
    host, path = parse(F.col("url"))
    split = pick(pages, id=id_col, url=url_col).select("id", host.alias("host"), path.alias("path"))
    fit = split.withColumn("fit", matching_rule(F.col("host"), F.col("path"), rules)).withColumn("typed", typed_segments(F.col("path")))
    seeded = F.arrays_overlap(F.split("host", "[.-]"), F.array(*[F.lit(w) for w in seeds])) if seeds else F.lit(False)
    told = F.lit(None).cast("boolean")
    if labels is not None:
        known = pick(labels, l_id=id_col, told=label_col).where("l_id is not null and told is not null").groupBy("l_id").agg(F.max("told").alias("told"))
        fit = scratch.keep(fit.join(known, F.col("id") == F.col("l_id"), "left").drop("l_id"), "labelled")
        told = F.col("told")
    free = F.col("fit").isNull()
    bad = (F.col("fit.verdict") == "block") | (free & F.coalesce(told, seeded))
    good = (F.col("fit.verdict") == "allow") | (free & ~F.coalesce(told, F.lit(True)))
    one = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    paths = fit.groupBy("host", "typed").agg(F.count(F.lit(1)).alias("n"), one(bad).alias("bad"), one(good).alias("good"))
    paths = scratch.keep(paths.withColumn("segments", F.col("typed")), "paths")
    tree = _levels(scratch, paths, "typed", _generalise)
    templates = tree.groupBy("host", "segments").agg(*[F.sum(c).alias(c) for c in ("n", "bad", "good")])
    templates = scratch.keep(templates.withColumn("merged", F.col("segments")), "templates")
    templates = _levels(scratch, templates, "segments", _merge)
    purity = (F.sum("bad").cast("double") + PRIOR_WEIGHT * PRIOR) / (F.sum(F.col("bad") + F.col("good")).cast("double") + PRIOR_WEIGHT)
    verdicts = templates.groupBy(F.col("host").alias("v_host"), F.col("merged").alias("v_merged")).agg(
        F.when(purity >= REJECT, "block").otherwise("allow").alias("said"), F.count(F.lit(1)).alias("held")
    )
    by_template = hot_join(scratch, templates, scratch.keep(verdicts, "verdicts"), {"host": "v_host", "merged": "v_merged"}, "held", cheap=True)
    sizes = tree.groupBy(F.col("host").alias("s_host"), F.col("segments").alias("s_segments")).agg(F.count(F.lit(1)).alias("paths"))
    by_template = by_template.join(sizes, (F.col("host") == F.col("s_host")) & (F.col("segments") == F.col("s_segments")))
    by_template = scratch.keep(by_template.select("s_host", "s_segments", "merged", "said", "paths"), "said")
    by_path = hot_join(scratch, tree, by_template, {"host": "s_host", "segments": "s_segments"}, "paths", cheap=True)
    template = F.concat(F.lit("/"), F.array_join("merged", "/")).alias("template")
    by_path = scratch.keep(by_path.select(F.col("host").alias("t_host"), F.col("typed").alias("t_typed"), template, "said", "n"), "by_path")
    joined = hot_join(scratch, fit, by_path, {"host": "t_host", "typed": "t_typed"}, "n", how="left", cheap=True)
    return joined.select(
        F.col("id").alias(id_col), "host", "path", F.col("fit.rule").alias("rule"), F.coalesce("fit.verdict", "said").alias("verdict"), "template"
    )


def _levels(scratch: Scratch, rows: DataFrame, path: str, step) -> DataFrame:
    """Apply ``step`` to the levels of ``path`` one by one; rows that don't reach a level are done."""
    depth = rows.agg(F.max(F.size(path))).first()[0] or 0
    done = None
    for level in range(depth):
        ended = rows.where(F.size(path) <= level)
        done = ended if done is None else done.unionByName(ended)
        rows = scratch.keep(step(scratch, rows.where(F.size(path) > level), level), f"{step.__name__}{level}")
    return rows if done is None else done.unionByName(rows)


def _generalise(scratch: Scratch, tree: DataFrame, level: int) -> DataFrame:
    """Make wildcards of the literal segments under variable nodes of one level."""
    segment = F.get("segments", F.lit(level))
    literal = F.when(~F.startswith(segment, F.lit("{")), segment)
    nodes = tree.withColumns({"prefix": F.array_join(F.slice("segments", 1, level), "/"), "own": literal})
    children = nodes.where("own is not null").groupBy("host", "prefix", "own").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("paths"))
    variable = (
        children.groupBy(F.col("host").alias("v_host"), F.col("prefix").alias("v_prefix"))
        .agg(F.count(F.lit(1)).alias("children"), F.sum("n").alias("pages"), F.sum("paths").alias("v_paths"))
        .where((F.col("children") >= MANY_CHILDREN) & (F.col("children") * 2 > F.col("pages")))
    )
    variable = scratch.keep(variable.select("v_host", "v_prefix", "v_paths"), "variable")
    joined = hot_join(scratch, nodes, variable, {"host": "v_host", "prefix": "v_prefix"}, "v_paths", how="left", cheap=True)
    wide = F.col("v_host").isNotNull() & F.col("own").isNotNull()
    return joined.select("host", "typed", "n", "bad", "good", F.when(wide, _put("segments", level, "{*}")).otherwise(F.col("segments")).alias("segments"))


def _put(column: str, level: int, value: str) -> Column:
    return F.transform(column, lambda x, i: F.when(i == level, F.lit(value)).otherwise(x))


def _merge(scratch: Scratch, templates: DataFrame, level: int) -> DataFrame:
    """Merge branches of one level whose labelled shares are alike."""
    named = templates.withColumns({"frame": _put("merged", level, "{~}"), "labelled": F.col("bad") + F.col("good")})
    branches = named.groupBy("host", "frame", "merged").agg(
        F.sum("bad").alias("bad"), F.sum("labelled").alias("labelled"), F.count(F.lit(1)).alias("held")
    )
    known = scratch.keep(branches.where(F.col("labelled") >= BRANCH_LABELS), "known")
    pools = known.groupBy(F.col("host").alias("p_host"), F.col("frame").alias("p_frame")).agg(
        F.sum("bad").cast("double").alias("b"), F.sum("labelled").cast("double").alias("m"), F.count(F.lit(1)).alias("branches")
    )
    gap = F.col("bad") * F.col("m") - F.col("b") * F.col("labelled")
    on = {"host": "p_host", "frame": "p_frame"}
    alike = hot_join(scratch, known, scratch.keep(pools, "pools"), on, "branches", cheap=True).where(
        gap * gap <= CHANCE * (F.col("b") * (F.col("m") - F.col("b"))) * F.col("labelled")
    )
    alike = scratch.keep(alike.select("host", "frame", "merged", "held"), "alike")
    twins = alike.groupBy(F.col("host").alias("p_host"), F.col("frame").alias("p_frame")).agg(F.count(F.lit(1)).alias("twins")).where("twins > 1")
    chosen = hot_join(scratch, alike, scratch.keep(twins, "twins"), on, "twins", how="left_semi", cheap=True)
    chosen = scratch.keep(chosen.select(F.col("host").alias("c_host"), F.col("merged").alias("c_merged"), "held"), "chosen")
    joined = hot_join(scratch, named, chosen, {"host": "c_host", "merged": "c_merged"}, "held", how="left", cheap=True)
    return joined.select(
        "host", "segments", "n", "bad", "good", F.when(F.col("c_host").isNotNull(), F.col("frame")).otherwise(F.col("merged")).alias("merged")
    )


def oracle(rules=RULES, seeds=SEED_WORDS) -> str:
    """DuckDB SQL of :func:`judge` over the table pages."""
    fits = []
    for rule, verdict in rules:
        r_host, _, r_path = rule.partition("/")
        fits.append(
            f"CASE WHEN (host = '{r_host}' OR ends_with(host, '.{r_host}')) AND starts_with(path, '/{r_path}') "
            f"THEN {{'length': {len(rule)}, 'rule': '{rule}', 'verdict': '{verdict}'}} END"
        )
    words = ", ".join(f"'{w}'" for w in seeds)
    return f"""WITH RECURSIVE rests AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
split AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM rests),
fit AS (SELECT *, list_max(list_filter([{", ".join(fits)}], lambda x: x IS NOT NULL)) AS fit,
  list_transform(list_filter(string_split(path, '/'), lambda x: x <> ''), lambda x:
    CASE WHEN regexp_matches(x, '^[0-9]+$') THEN '{{n}}'
         WHEN regexp_matches(x, '^[0-9]+\\.[a-z]+$') THEN '{{n}}.' || regexp_extract(x, '\\.([a-z]+)$', 1)
         WHEN regexp_matches(x, '^[0-9a-f-]{{8,}}$') THEN '{{h}}' ELSE x END) AS typed FROM split),
paths AS (SELECT host, typed, count(*) AS n,
  sum(CASE WHEN fit.verdict = 'block' OR (fit IS NULL AND list_has_any(regexp_split_to_array(host, '[.-]'), [{words}])) THEN 1 ELSE 0 END) AS bad,
  sum(CASE WHEN fit.verdict = 'allow' THEN 1 ELSE 0 END) AS good FROM fit GROUP BY host, typed),
steps(level, host, typed, n, bad, good, segments) AS (
  SELECT 0, host, typed, n, bad, good, typed FROM paths
  UNION ALL
  SELECT level + 1, host, typed, n, bad, good,
    CASE WHEN own IS NOT NULL AND children >= {MANY_CHILDREN} AND children * 2 > pages THEN segments[1:level] || ['{{*}}'] || segments[level + 2:] ELSE segments END
  FROM (SELECT *, count(DISTINCT own) OVER (PARTITION BY host, prefix) AS children,
          sum(CASE WHEN own IS NOT NULL THEN n END) OVER (PARTITION BY host, prefix) AS pages
        FROM (SELECT *, array_to_string(segments[1:level], '/') AS prefix,
                CASE WHEN NOT starts_with(segments[level + 1], '{{') THEN segments[level + 1] END AS own
              FROM steps WHERE len(typed) > level))),
tree AS (SELECT * FROM steps WHERE level = len(typed)),
merges(level, host, segments, bad, good, merged) AS (
  SELECT 0, host, segments, sum(bad)::DOUBLE, sum(good)::DOUBLE, segments FROM tree GROUP BY host, segments
  UNION ALL
  SELECT level + 1, host, segments, bad, good,
    CASE WHEN alike AND count(DISTINCT CASE WHEN alike THEN merged END) OVER (PARTITION BY host, frame) > 1 THEN frame ELSE merged END
  FROM (SELECT *, known AND (own_bad * m - b * own) * (own_bad * m - b * own) <= {CHANCE} * (b * (m - b)) * own AS alike
    FROM (SELECT *, sum(CASE WHEN known THEN bad END) OVER (PARTITION BY host, frame) AS b,
            sum(CASE WHEN known THEN bad + good END) OVER (PARTITION BY host, frame) AS m
      FROM (SELECT *, own >= {BRANCH_LABELS} AS known
        FROM (SELECT *, sum(bad) OVER (PARTITION BY host, merged) AS own_bad, sum(bad + good) OVER (PARTITION BY host, merged) AS own
          FROM (SELECT *, merged[1:level] || ['{{~}}'] || merged[level + 2:] AS frame FROM merges WHERE len(segments) > level)))))),
merged AS (SELECT * FROM merges WHERE level = len(segments)),
verdicts AS (SELECT host, merged, CASE WHEN (sum(bad) + {PRIOR_WEIGHT * PRIOR}) / (sum(bad + good) + {PRIOR_WEIGHT}) >= {REJECT}
  THEN 'block' ELSE 'allow' END AS said FROM merged GROUP BY host, merged),
by_path AS (SELECT t.host, t.typed, v.merged, v.said FROM tree t JOIN merged m ON t.host = m.host AND t.segments = m.segments
  JOIN verdicts v ON v.host = m.host AND v.merged = m.merged)
SELECT page_id, f.host, path, fit.rule AS rule, coalesce(fit.verdict, said) AS verdict, '/' || array_to_string(merged, '/') AS template
FROM fit f LEFT JOIN by_path b ON f.host = b.host AND f.typed = b.typed"""
