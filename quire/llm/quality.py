"""Quality classifier by co-training on two views.

One classifier sees the text's content (its words, their shapes and a few
ratios), the other the page's metadata (source, language, length, layout).
Both start from the same labelled sample.  In each round each view scores
every unlabelled document, judged by its probability after calibration on
held-out labels, and hands some of those that it is sure of to the other view:
a uniform sample of all of them, for each class.  At the end each view is
calibrated again and every document is scored by both: their evidence adds up,
beyond the prior that they share.

The fit is bounded (``labelled_rows``, chosen by a hash of the id, and what is
handed over); rounds and scoring see every document whole.  Feature vectors
are computed once and kept in the shared folder for the rounds.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, hash_sample, pick, to_batch
from .minhash import mix64

LABELLED_ROWS = 8_000
ROUNDS = 4
#: Calibrated probability from which a view is sure, and rows that it may hand over in a round for each class.
SURE, HANDED = 0.97, 400
HELD_OUT = 0.25
#: Documents below this combined probability of good quality are rejected.
KEEP = 0.5

SHAPES, WORDS = 256, 256
CONTENT_STATS = 10
SOURCES, LANGS, LENGTHS = 64, 16, 24
META_STATS = 3

#: Letters become x or X, digits d; other bytes stay, and bytes of longer characters count as letters.
_SHAPE = bytes(
    ord("x") if 97 <= b <= 122 or b >= 128 else ord("X") if 65 <= b <= 90 else ord("d") if 48 <= b <= 57 else b for b in range(256)
)
_REPEAT = re.compile(rb"(.)\1+", re.S)


class _Shapes(dict):
    """Hash bucket of a word's whole shape, runs counted once; only short words are remembered."""

    def __missing__(self, shape: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(_REPEAT.sub(rb"\1", shape)) % SHAPES
        if len(shape) <= 256:
            if len(self) >= 200_000:
                self.clear()
            self[shape] = value
        return value


class Views:
    """Feature vectors of a document: content, metadata."""

    def __init__(self):
        self.shapes = _Shapes()

    def content(self, text: str) -> np.ndarray:
        out = np.zeros(SHAPES + WORDS + CONTENT_STATS)
        data = text.encode()
        shaped = data.translate(_SHAPE)
        words = shaped.split()
        n = len(words)
        if not n:
            out[SHAPES + WORDS] = 1
            return out
        own = data.lower().split()
        shapes = np.fromiter(map(self.shapes.__getitem__, words), np.int64, n)
        hashed = np.fromiter(map(zlib.crc32, own), np.uint32, n) % WORDS
        out[:SHAPES] = np.sqrt(np.bincount(shapes, minlength=SHAPES) / n)
        out[SHAPES : SHAPES + WORDS] = np.sqrt(np.bincount(hashed, minlength=WORDS) / n)
        size = len(data)
        letters, upper, digits = (shaped.count(c) for c in (b"x", b"X", b"d"))
        distinct = len(set(own))
        marks = size - letters - upper - digits - sum(map(data.count, (b" ", b"\n", b"\t", b"\r")))
        out[SHAPES + WORDS :] = (
            0, upper / size, digits / size, 4 * marks / size, min(1, size / n / 20), distinct / n, distinct / n**0.5 / 20,
            min(1, data.count(b"|") / n), min(1, data.count(b"!") / n), min(1, np.log1p(n) / 12),
        )
        return out

    def metadata(self, text: str, source: str | None, lang: str | None) -> np.ndarray:
        out = np.zeros(SOURCES + LANGS + LENGTHS + META_STATS)
        out[xxhash.xxh3_64_intdigest((source or "").encode()) % SOURCES] = 1
        out[SOURCES + xxhash.xxh3_64_intdigest((lang or "").encode()) % LANGS] = 1
        chars, lines = len(text), text.count("\n") + 1
        out[SOURCES + LANGS + min(LENGTHS - 1, chars.bit_length())] = 1
        out[-META_STATS:] = min(1, np.log1p(lines) / 10), min(1, np.log1p(chars / lines) / 12), text.count("\n\n") / lines
        return out


def _descend(
    x: np.ndarray, targets: np.ndarray, weigh: np.ndarray, penalty: np.ndarray, towards: np.ndarray, rounds: int, start: np.ndarray | None = None
) -> np.ndarray:
    """Penalised logistic regression by Newton steps that are halved until the loss falls."""

    def loss(w):
        z = x @ w
        return (weigh * (np.logaddexp(0, z) - targets * z)).sum() + 0.5 * (penalty * (w - towards) ** 2).sum()

    w = towards.copy() if start is None else start
    held = loss(w)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
        gradient = x.T @ (weigh * (p - targets)) + penalty * (w - towards)
        curve = (x * (weigh * p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(curve, gradient)
        for _ in range(30):
            tried = loss(w - step)
            if tried <= held:
                break
            step = step / 2
        else:
            break
        w, gain, held = w - step, held - tried, tried
        if gain < 1e-7 * (1 + abs(held)):
            break
    return w


def fit_logistic(x: np.ndarray, y: np.ndarray, start: np.ndarray | None = None, ridge: float = 1.0, rounds: int = 12) -> np.ndarray:
    """Weights and, last, the intercept; both classes weigh the same.  ``start`` has weights to begin from."""
    x = np.hstack([x, np.ones((len(x), 1))])
    balance = np.where(y > 0, len(y) / max(1, 2 * (y > 0).sum()), len(y) / max(1, 2 * (y <= 0).sum()))
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    return _descend(x, y, balance, penalty, np.zeros(x.shape[1]), rounds, start)


def logits(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return x @ w[:-1] + w[-1]


def calibrate(scores: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Scale and shift that make logits into log-odds of held-out labels (Platt)."""
    targets = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
    x = np.stack([scores, np.ones(len(scores))], 1)
    a, b = _descend(x, targets, np.ones(len(scores)), np.array([1e-2, 1e-6]), np.array([1.0, 0.0]), 40)
    return max(float(a), 0.0), float(b)


class CoTrained:
    """Weights and calibration of both views, and the prior log-odds."""

    def __init__(self, weights: list[np.ndarray], scales: list[tuple[float, float]], prior: float):
        self.weights, self.scales, self.prior = weights, scales, prior

    def view_logits(self, views: list[np.ndarray]) -> list[np.ndarray]:
        return [a * logits(x, w) + b for x, w, (a, b) in zip(views, self.weights, self.scales)]

    def combine(self, content: np.ndarray, meta: np.ndarray) -> np.ndarray:
        return content + meta - self.prior


class ArrayPool:
    """Unlabelled rows in memory."""

    def __init__(self, views: list[np.ndarray]):
        self.views = views

    def sure(self, model: CoTrained, taken: list[set], turn: int, handed: int) -> list[tuple]:
        """(view, label, key, content, meta) of at most ``handed`` rows, drawn from all that a view is sure of, for each view and label."""
        out = []
        found = _sure_rows(model, self.views, np.arange(len(self.views[0])), taken, turn)
        for view, label, rows, draws in found:
            for i in rows[np.argsort(draws, kind="stable")][:handed].tolist():
                out.append((view, label, i, self.views[0][i], self.views[1][i]))
        return out


class StoredPool:
    """Unlabelled rows as a written table (id, content, meta); all are scored in every round, few are collected."""

    def __init__(self, rows: DataFrame):
        self.rows = rows

    def sure(self, model: CoTrained, taken: list[set], turn: int, handed: int) -> list[tuple]:
        """As :meth:`ArrayPool.sure`.

        The first pass counts the sure rows; the second brings those whose
        draw is below twice the wanted share, so what is collected is bounded
        whatever the size of the table.
        """
        shared = self.rows.sparkSession.sparkContext.broadcast((model, taken))

        def find(bars: dict | None):
            def run(batches):
                model, taken = shared.value
                for batch in batches:
                    ids = batch.column(0).to_numpy()
                    views = [_stacked(batch.column(k).to_pylist()) for k in (1, 2)]
                    out = []
                    for view, label, rows, draws in _sure_rows(model, views, ids, taken, turn):
                        if bars is None:
                            out.append((view, label, len(rows), None, None, None, None))
                            continue
                        for i, draw in zip(rows.tolist(), draws.tolist()):
                            if draw < bars.get((view, label), 0):
                                out.append((view, label, 1, int(ids[i]), draw, batch.column(1)[i].as_py(), batch.column(2)[i].as_py()))
                    yield to_batch(out, schema)

            return run

        names = "view int, label int, n long, id long, draw double, content binary, meta binary"
        schema = pa.schema([(n.split()[0], {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "binary": pa.binary()}[n.split()[1]]) for n in names.split(", ")])
        counts = self.rows.mapInArrow(find(None), names).groupBy("view", "label").agg(F.sum("n").alias("n")).collect()
        bars = {(r["view"], r["label"]): 2 * handed / r["n"] for r in counts if r["n"]}
        drawn = self.rows.mapInArrow(find(bars), names)
        drawn = drawn.groupBy("view", "label", "id").agg(F.min("draw").alias("draw"), F.min(F.struct("content", "meta")).alias("row"))  # an id counts once
        found: dict[tuple, list] = {}
        for r in sorted(drawn.collect(), key=lambda r: (r["draw"], r["id"])):
            found.setdefault((r["view"], r["label"]), []).append((r["id"], *(_stacked([r["row"][k]])[0] for k in ("content", "meta"))))
        return [(view, label, *row) for (view, label), rows in sorted(found.items()) for row in rows[:handed]]


def _stacked(vectors: list) -> np.ndarray:
    return np.frombuffer(b"".join(map(bytes, vectors)), np.float16).reshape(len(vectors), -1).astype(np.float64)


def _sure_rows(model: CoTrained, views: list[np.ndarray], keys: np.ndarray, taken: list[set], turn: int):
    """(view, label, rows, draws): rows that a view is sure of and hasn't handed over, each with a uniform draw."""
    if not len(keys):
        return
    for view, z in enumerate(model.view_logits(views)):
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        draws = mix64(keys.astype(np.int64).view(np.uint64) ^ mix64(np.array([2 * turn + view + 1], np.uint64))) / 2.0**64
        fresh = ~np.isin(keys, np.fromiter(taken[1 - view], np.int64, len(taken[1 - view])))
        for label, sure in ((1, p), (0, 1 - p)):
            rows = np.flatnonzero((sure >= SURE) & fresh)
            yield view, label, rows, draws[rows]


def co_train(labelled: list[np.ndarray], y: np.ndarray, pool: ArrayPool | StoredPool, *, rounds: int = ROUNDS) -> CoTrained | None:
    """Fit both views; None where the labels don't hold both classes on either side of the split."""
    held = np.arange(len(y)) % round(1 / HELD_OUT) == 0
    if min((y[held] > 0).sum(), (y[held] <= 0).sum(), (y[~held] > 0).sum(), (y[~held] <= 0).sum()) < 2:
        return None
    prior = float(np.log(y.sum() / (len(y) - y.sum())))
    x = [v[~held] for v in labelled]
    gained: list[dict[int, tuple]] = [{}, {}]  # key to features and pseudo-label, for each view

    def fitted(start: list) -> CoTrained:
        weights, scales = [], []
        for k in (0, 1):
            extra = list(gained[k].values())
            rows = np.concatenate([x[k], np.stack([f for f, _ in extra])]) if extra else x[k]
            weights.append(fit_logistic(rows, np.concatenate([y[~held], [float(label) for _, label in extra]]), start[k]))
            scales.append(calibrate(logits(labelled[k][held], weights[k]), y[held]))
        return CoTrained(weights, scales, prior)

    model = fitted([None, None])
    for turn in range(rounds):
        handed = pool.sure(model, [set(g) for g in gained], turn, HANDED)
        if not handed:
            break
        for view, label, key, *features in handed:
            gained[1 - view][key] = (features[1 - view], label)
        model = fitted(model.weights)
    return model


def features(work: DataFrame) -> DataFrame:
    """(id, content, meta) of rows (id, text, source, lang), in half precision."""

    def run(batches):
        views = Views()
        schema = pa.schema([("id", pa.int64()), ("content", pa.binary()), ("meta", pa.binary())])
        for batch in batches:
            out = []
            for key, text, source, lang in zip(*(batch.column(k).to_pylist() for k in range(4))):
                made = views.content(text or ""), views.metadata(text or "", source, lang)
                out.append((key, *(v.astype(np.float16).tobytes() for v in made)))
            yield to_batch(out, schema)

    return work.select("id", "text", "source", "lang").mapInArrow(run, "id long, content binary, meta binary")


def fit(
    spark: SparkSession, docs: DataFrame, labels: DataFrame, *, labelled_rows: int = LABELLED_ROWS,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", label_col: str = "quality",
) -> CoTrained | None:
    """Co-train on at most ``labelled_rows`` labelled documents and all others.

    A repeated id is one document here; of contradicting labels the worse holds.
    """
    scratch = Scratch(spark, "quality")
    known = pick(labels, s_id=id_col, y=label_col).where("s_id is not null and y is not null")
    known = known.select("s_id", F.when(F.col("y") > 0, 1).otherwise(0).alias("y"))
    total = known.count()
    if not total:
        return None
    known = scratch.keep(hash_sample(known, "s_id", labelled_rows, total).groupBy("s_id").agg(F.min("y").alias("y")), "known")
    work = pick(docs, id=id_col, text=text_col, source=source_col, lang=lang_col).where("id is not null")
    rows = scratch.keep(features(work), "features")
    taught = rows.join(F.broadcast(known), F.col("id") == F.col("s_id"))  # at most labelled_rows ids
    taught = taught.groupBy("id", "y").agg(F.min(F.struct("content", "meta")).alias("row")).collect()
    if not taught:
        return None
    taught.sort(key=lambda r: (xxhash.xxh3_64_intdigest(r["id"].to_bytes(8, "little", signed=True)), r["y"]))
    views = [_stacked([r["row"][k] for r in taught]) for k in ("content", "meta")]
    other = rows.join(F.broadcast(known.select("s_id")), F.col("id") == F.col("s_id"), "left_anti")
    model = co_train(views, np.array([float(r["y"]) for r in taught]), StoredPool(other))
    scratch.drop(rows, known)
    return model


def score(
    spark: SparkSession, docs: DataFrame, model: CoTrained | None, *, id_col: str = "doc_id", text_col: str = "text",
    source_col: str = "source", lang_col: str = "lang", keep_cols: tuple[str, ...] = (),
) -> DataFrame:
    """Return (id, content_p, meta_p, quality_p, keep, *keep_cols), one row for each input row.

    The probabilities are calibrated: of the content view, the metadata view
    and both.  A null text is an empty one; null source and language are
    values of their own.  Without a model (no labels, or labels of one class)
    every probability is null and every document is kept.
    """
    work = docs.select(
        F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), F.col(f"`{source_col}`").alias("source"),
        F.col(f"`{lang_col}`").alias("lang"), *[F.col(f"`{c}`").alias(f"k_{i}") for i, c in enumerate(keep_cols)],
    )
    named = [F.col(f"k_{i}").alias(c) for i, c in enumerate(keep_cols)]
    head = [F.col("id").alias(id_col), "content_p", "meta_p", "quality_p", "keep"]
    if model is None:
        nothing = F.lit(None).cast("double")
        return work.withColumns({"content_p": nothing, "meta_p": nothing, "quality_p": nothing, "keep": F.lit(True)}).select(*head, *named)
    shared = spark.sparkContext.broadcast(model)
    extra = [f for f in work.schema.fields if f.name.startswith("k_")]
    schema = "id long, content_p double, meta_p double, quality_p double, keep boolean" + "".join(f", {f.name} {f.dataType.simpleString()}" for f in extra)

    def run(batches):
        views = Views()
        model = shared.value
        odds = lambda z: 1 / (1 + np.exp(-np.clip(z, -500, 500)))
        for batch in batches:
            for a in range(0, batch.num_rows, 1024):
                part = batch.slice(a, 1024)
                rows = [(t or "", s, g) for t, s, g in zip(*(part.column(k).to_pylist() for k in (1, 2, 3)))]
                content = np.stack([views.content(t) for t, _, _ in rows])
                meta = np.stack([views.metadata(*r) for r in rows])
                c, m = model.view_logits([content, meta])
                both = odds(model.combine(c, m))
                made = [pa.array(odds(c)), pa.array(odds(m)), pa.array(both), pa.array(both >= KEEP)]
                names = ["id", "content_p", "meta_p", "quality_p", "keep", *[f.name for f in extra]]
                yield pa.RecordBatch.from_arrays([part.column(0), *made, *[part.column(4 + i) for i in range(len(extra))]], names=names)

    return work.mapInArrow(run, schema).select(*head, *named)


def classify(spark: SparkSession, docs: DataFrame, labels: DataFrame, **columns) -> DataFrame:
    """Fit on the labels and score every document; see :func:`fit` and :func:`score`."""
    return score(spark, docs, fit(spark, docs, labels), **columns)
