"""Quality classifier: Bradley-Terry scores learned from preference pairs, thresholded by a score quantile."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import free_name, text_bytes, written

FEATURES = (
    "log_words", "word_length", "long_words", "distinct", "log_distinct_rate", "same_as_last", "same_as_last_but_one", "upper", "digits",
    "symbols", "bars", "bangs", "stops", "commas", "lines", "line_words", "other_bytes", "top_word", "symbol_words", "upper_words",
)
SYMBOLS = b"#$%&*+<=>@\\^_`{}~/[]"
BLOCK = 1 << 22


def _count(text: bytes, of: bytes) -> int:
    return len(text) - len(text.translate(None, of))


def features(text: bytes) -> list[float]:
    """Measures of a whole text that see neither its language, source nor id."""
    found = text.split()
    n, size = len(found), len(text) or 1
    if not n:
        return [0.0] * len(FEATURES)
    counts: dict[bytes, int] = {}
    for w in found:
        counts[w] = counts.get(w, 0) + 1
    last = sum(map(bytes.__eq__, found, found[1:]))
    but_one = sum(map(bytes.__eq__, found, found[2:]))
    lengths = np.fromiter(map(len, found), np.int64, n)
    lines = text.count(b"\n") + 1
    upper = _count(text, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")
    symbols = _count(text, SYMBOLS)
    stops = text.count(b".") + text.count(b"?")
    bangs = text.count(b"!")
    other = size - len(text.translate(None, bytes(range(128, 256))))
    return [
        math.log1p(n), float(lengths.mean()), float((lengths > 18).mean()), len(counts) / n, math.log(len(counts)) / math.log(n) if n > 1 else 1.0,
        last / n, but_one / n, upper / size, _count(text, b"0123456789") / size, symbols / size, text.count(b"|") / n, bangs / n, stops / n,
        text.count(b",") / n, lines / n, math.log1p(n / lines), other / size, max(counts.values()) / n, min(1.0, symbols / n), min(4.0, upper / n),
    ]


def feature_table(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, x array<double>) of each whole text; null and empty texts have all zeros."""

    def run(batches):
        for batch in batches:
            rows = [features(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.float64()))], names=["doc_id", "x"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes(text).alias("text")).mapInArrow(run, "doc_id long, x array<double>")


def held_out() -> Column:
    """True for the quarter of documents whose labels are never learned from; false for a null doc_id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    slope: float
    offset: float
    quantile_score: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -6, 6) @ self.weight

    def score(self, x: np.ndarray) -> np.ndarray:
        """0 to 1: the chance of label 1 by the pairwise margin."""
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margin(x) + self.offset, -30, 30)))


#: Margins of a label are summed in so many bins, and pairs counted by the means of their bins: what that leaves out of
#: a pair's loss is of the square of a bin's width.
BINS = 2048
#: Bins of a step of the search for a score's place; four steps tell doubles of this range apart to 1e-12.
PLACES = 4096


def _binned(z: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The bin of each row's margin, those of label 1 after those of label 0."""
    far = 6 * np.abs(weight).sum() + 1e-9  # no margin is beyond
    return np.clip((z @ weight + far) * (BINS / (2 * far)), 0, BINS - 1).astype(int) + BINS * y


def _pair_weights(passed: Callable, d: int, ridge: float, rounds: int) -> np.ndarray:
    """Newton's method on the mean loss of every pair of a label 1 and a label 0. A round takes two passes over the rows:
    sums by bin, which give what each bin pulls and bends, and the squares of the rows weighted by that."""
    w = np.zeros(d)
    for _ in range(rounds):

        def sums(z: np.ndarray, y: np.ndarray, w=w) -> np.ndarray:
            at = _binned(z, y, w)
            return np.concatenate([np.bincount(at, c, 2 * BINS) for c in (None, *z.T)])

        got = passed(sums, 2 * BINS * (d + 1)).reshape(d + 1, 2 * BINS)
        n, mean = got[0], got[1:].T / np.maximum(got[0], 1)[:, None]
        bad, good = np.flatnonzero(n[:BINS]), BINS + np.flatnonzero(n[BINS:])
        gap = np.clip((mean[good] @ w)[:, None] - (mean[bad] @ w)[None], -30, 30)
        miss = np.outer(n[good] / n[good].sum(), n[bad] / n[bad].sum()) / (1 + np.exp(gap))  # of all pairs, that lie the other way round
        bend = miss / (1 + np.exp(-gap))
        share = np.zeros(2 * BINS)
        share[good], share[bad] = bend.sum(1) / n[good], bend.sum(0) / n[bad]

        def squares(z: np.ndarray, y: np.ndarray, w=w, share=share) -> np.ndarray:
            return ((z * share[_binned(z, y, w)][:, None]).T @ z).ravel()

        cross = mean[good].T @ bend @ mean[bad]
        hessian = passed(squares, d * d).reshape(d, d) - cross - cross.T + ridge * np.eye(d)
        step = np.linalg.solve(hessian, ridge * w - miss.sum(1) @ mean[good] + miss.sum(0) @ mean[bad])
        w = w - step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _line(passed: Callable, weight: np.ndarray, ridge: float = 1e-3, rounds: int = 30) -> tuple[float, float]:
    """(offset, slope) of the logistic regression of the label on the margin."""
    w = np.zeros(2)
    for _ in range(rounds):

        def sums(z: np.ndarray, y: np.ndarray, w=w) -> np.ndarray:
            m = z @ weight
            p = 1 / (1 + np.exp(-np.clip(w[0] + w[1] * m, -30, 30)))
            q = p * (1 - p)
            return np.array([(p - y).sum(), ((p - y) * m).sum(), q.sum(), (q * m).sum(), (q * m * m).sum()])

        a, b, c, e, f = passed(sums, 5)
        step = np.linalg.solve(np.array([[c, e], [e, f]]) + ridge * np.eye(2), np.array([a, b]) + ridge * w)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(w[1])


def _placed(passed: Callable, value: Callable[[np.ndarray], np.ndarray], place: int, low: float, high: float) -> float:
    """The place-th smallest (from 0) of all rows' values within low and high, or up to 1e-12 below it."""
    for _ in range(4):
        edges = np.linspace(low, high, PLACES + 1)
        counts = passed(lambda z, y, edges=edges: np.bincount(np.searchsorted(edges, value(z), "right"), minlength=PLACES + 2), PLACES + 2)
        k = int(np.searchsorted(np.cumsum(counts), place, "right"))
        if k > PLACES:
            return high
        low, high = float(edges[max(k - 1, 0)]), float(edges[max(k, 1)])
    return low


def _learned(passed: Callable, n: int, rate: float, mean: np.ndarray, scale: np.ndarray, ridge: float, rounds: int = 30) -> Model:
    """The model of n rows, of which passed(f, size) gives the sum of f(z, y), arrays of that size, over all."""
    weight = _pair_weights(passed, len(mean), ridge / 60_000, rounds)
    offset, slope = _line(passed, weight)
    model = Model(mean, scale, weight, slope, offset, 0.0)
    at = _placed(passed, lambda z: np.clip(slope * (z @ weight) + offset, -30, 30), n - round(n * rate), -30.0, 30.0)
    model.quantile_score = float(1 / (1 + np.exp(-at)))
    return model


def _constant(rate: float) -> Model:
    d = len(FEATURES)
    rate = min(max(rate, 1e-6), 1 - 1e-6)
    return Model(np.zeros(d), np.ones(d), np.zeros(d), 1.0, math.log(rate / (1 - rate)), rate)


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> Model:
    """Bradley-Terry: P(i preferred to j) = logistic(w . (x_i - x_j)) over every pair of a label 1 and a label 0; none
    is drawn. The scale of the margin to a chance and the quantile are of the same rows. With one label only, or no rows,
    every text gets the share of label 1 (0.5 with none)."""
    if not len(y) or y.min() == y.max():
        return _constant(float(y.mean()) if len(y) else 0.5)
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.clip((x - mean) / scale, -6, 6)
    return _learned(lambda f, size: f(z, y), len(y), float(y.mean()), mean, scale, ridge)


def train(docs: DataFrame, labels: DataFrame, text: str = "text", ridge: float = 1.0) -> Model:
    """As fit, on every labelled document that is not held out, in passes over a table of their features: a task gives the
    sums of its rows, which Spark adds, and sums of the model's size come to the driver. Rows with a null id or label, or a
    label other than 0 and 1, are left out; a doc_id with several labels has its largest, and of several texts with one
    doc_id that of the smallest features counts."""
    rows = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "quality")
    rows = rows.where(~held_out()).groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality"))
    own = docs.where("doc_id is not null").withColumn("doc_id", F.col("doc_id").cast("long")).where(~held_out())
    # features are made before ids meet: they are shuffled, texts are not
    known = feature_table(own, text).groupBy("doc_id").agg(F.min("x").alias("x")).join(rows.hint("shuffle_hash"), "doc_id")
    known = written(known.select("x", "quality"), "quality-features")
    d = len(FEATURES)
    ends = known.agg(F.count("*").alias("n"), F.avg("quality").alias("rate"), *(f(F.col("x")[i]).alias(f"{name}{i}") for i in range(d) for name, f in (("m", F.avg), ("s", F.stddev_pop)))).first()
    if not ends["n"] or ends["rate"] in (0.0, 1.0):
        return _constant(ends["rate"] if ends["n"] else 0.5)
    mean, scale = np.array([ends[f"m{i}"] for i in range(d)]), np.array([ends[f"s{i}"] for i in range(d)]) + 1e-9

    def passed(f: Callable, size: int) -> np.ndarray:
        def run(batches):
            total = np.zeros(size)
            for batch in batches:
                x = batch.column(0).flatten().to_numpy().reshape(-1, d)
                total += f(np.clip((x - mean) / scale, -6, 6), batch.column(1).to_numpy().astype(int))
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at])], names=["at", "v"])

        out = np.zeros(size)
        for r in known.mapInArrow(run, "at long, v double").groupBy("at").agg(F.sum("v").alias("v")).collect():
            out[r["at"]] = r["v"]
        return out

    return _learned(passed, ends["n"], ends["rate"], mean, scale, ridge)


def scored(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """(doc_id, score, above_quantile): the score of each whole text, and whether it reaches the score quantile
    above which as many of the fitted rows lie as have label 1. Null and empty texts are scored as empty; null
    doc_ids and repeated rows are scored each; extra columns are ignored; an empty table gives no rows."""

    def run(batches):
        for batch in batches:
            rows = np.array([features(t) for t in batch.column(1).to_pylist()], float).reshape(-1, len(FEATURES))
            score = model.score(rows)
            above = pa.array(score >= model.quantile_score)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), above], names=["doc_id", "score", "above_quantile"])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes(text).alias("text"))
    return source.mapInArrow(run, "doc_id long, score double, above_quantile boolean")


def keep_good(docs: DataFrame, model: Model, at_least: float = 0.7, text: str = "text") -> DataFrame:
    """The rows of docs whose text scores at_least, in one pass over them. Null and empty texts are scored as empty;
    rows without an id and repeated rows are scored each; columns stay as they are, whatever their names; an empty
    table gives no rows."""

    def run(batches):
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            score = model.score(np.array([features(t) for t in texts], float).reshape(-1, len(FEATURES)))
            yield pa.RecordBatch.from_arrays(batch.columns[:-1], names=batch.schema.names[:-1]).filter(pa.array(score >= at_least))

    return docs.select("*", text_bytes(text).alias(free_name(docs, "__bytes"))).mapInArrow(run, docs.schema)
