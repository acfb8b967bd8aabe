"""Gradient boosting for quantiles: trees over binned features, grown from histograms of the pinball loss's gradient."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.work import settled
from .models import tree_scores

MOST_BINS = 255


def bin_edges(df: DataFrame, xs: Sequence[str], bins: int = 32) -> list[np.ndarray]:
    """For each feature the values, at most bins - 1 and ascending, that end its bins: a value is in the first bin whose
    end is not below it. They are approximate quantiles; a feature that is constant or unknown has none."""
    if not 2 <= bins <= MOST_BINS:
        raise ValueError(f"bins are from 2 to {MOST_BINS}")
    qs = [k / bins for k in range(1, bins)]
    got = df.agg(*(F.percentile_approx(F.nanvl(F.col(x).cast("double"), F.lit(None).cast("double")), qs, 10_000).alias(f"e{i}") for i, x in enumerate(xs)), *(F.max(F.nanvl(F.col(x).cast("double"), F.lit(None).cast("double"))).alias(f"m{i}") for i, x in enumerate(xs))).first()
    return [np.array(sorted({e for e in got[f"e{i}"] or () if e < got[f"m{i}"]}), float) for i in range(len(xs))]


def binned(x: np.ndarray, edges: Sequence[np.ndarray]) -> np.ndarray:
    """Bins of the columns of x, from 1; NaN is bin 0."""
    out = np.stack([np.searchsorted(e, x[:, i], "left") + 1 for i, e in enumerate(edges)], axis=1).astype(np.uint8)
    out[np.isnan(x)] = 0
    return out


def leaf_of(tree: dict, bins: Sequence[np.ndarray]) -> np.ndarray:
    """The node of each row in a tree of bins, by columns of bins; bin 0 goes the way the node says."""
    out = np.zeros(len(bins[0]), np.int32)
    walk: list = [(0, slice(None))]
    while walk:
        node, at = walk.pop()
        if tree["feature"][node] < 0:
            out[at] = node
            continue
        b = bins[tree["feature"][node]][at]
        left = b <= tree["bin"][node]  # bin 0 is below all
        if not tree["missing_left"][node]:
            left &= b > 0
        sides = ((tree[side][node], np.flatnonzero(way) if isinstance(at, slice) else at[way]) for side, way in (("left", left), ("right", ~left)))
        walk += [s for s in sides if len(s[1])]
    return out


def best_splits(histogram: np.ndarray, least: int) -> list[tuple[int, int, bool] | None]:
    """For each node of histogram[node, feature, bin, (gradient, n)] the split (feature, last bin to the left, whether
    missing goes left) that gains most, of equal ones the first; None where none gains or a side would have fewer rows
    than `least`."""
    out = []
    for node in histogram:
        best, found = 1e-12, None
        total = node[0].sum(axis=0)
        if total[1] > 0:
            for f, h in enumerate(node):
                up = np.cumsum(h[1:], axis=0)[:-1]
                for missing_left in (True, False):
                    left = up + (h[0] if missing_left else 0)
                    right = total - left
                    ok = (left[:, 1] >= least) & (right[:, 1] >= least)
                    gain = np.where(ok, left[:, 0] ** 2 / np.maximum(left[:, 1], 1) + right[:, 0] ** 2 / np.maximum(right[:, 1], 1) - total[0] ** 2 / total[1], 0.0)
                    k = int(np.argmax(gain)) if len(gain) else 0
                    if len(gain) and gain[k] > best * (1 + 1e-9):
                        best, found = float(gain[k]), (f, k + 1, missing_left)
                    if not h[0][1]:
                        break  # nothing is missing, so both ways are one
        out.append(found)
    return out


def grown(tree: dict, level: Sequence[int], splits: Sequence[tuple[int, int, bool] | None], edges: Sequence[np.ndarray]) -> list[int]:
    """Puts the splits of a level's nodes into the tree; the nodes of the next level."""
    below = []
    for node, split in zip(level, splits):
        if split is None:
            continue
        f, b, missing_left = split
        for side in ("left", "right"):
            tree[side][node] = len(tree["feature"])
            below.append(len(tree["feature"]))
            for k, v in (("feature", -1), ("bin", 0), ("threshold", 0.0), ("left", -1), ("right", -1), ("missing_left", False), ("value", 0.0)):
                tree[k].append(v)
        tree["feature"][node], tree["bin"][node], tree["missing_left"][node] = f, b, missing_left
        tree["threshold"][node] = float(edges[f][b - 1]) if b <= len(edges[f]) else float("inf")
    return below


def root() -> dict:
    return {"feature": [-1], "bin": [0], "threshold": [0.0], "left": [-1], "right": [-1], "missing_left": [False], "value": [0.0]}


def fit_boosted_quantile(df: DataFrame, xs: Sequence[str], y: str, q: float, **how) -> dict:
    """The artifact of fit_boosted_quantiles for one quantile."""
    return fit_boosted_quantiles(df, xs, y, [q], **how)[0]


def fit_boosted_quantiles(df: DataFrame, xs: Sequence[str], y: str, qs: Sequence[float], trees: int = 10, depth: int = 3, rate: float = 0.3, bins: int = 32, least: int = 20) -> list[dict]:
    """For each of the quantiles qs of y an artifact (base, trees, as tree_scores takes them).

    Features are binned once, and the models of all quantiles grow side by side, so the table is read as often for many as
    for one. A level of their trees costs one aggregate: each task counts its rows at or below the fit and above it by
    (model, node, feature, bin), of which the gradient of the pinball loss is made, and the tasks' counts are added in
    Spark, so that a histogram of the models' size comes to the driver. A leaf's value is the q quantile (percentile_approx)
    of the residuals of its rows, times the rate. The fits so far are columns of a table that is written anew for each
    tree; no tree reads those before. Rows without y are left out, missing features have a bin of their own; no
    rows give base 0 and no trees.
    """
    d, models = len(xs), range(len(qs))
    rows = df.where(F.col(y).isNotNull() & ~F.isnan(F.col(y).cast("double"))).select(*(F.col(x).cast("double").alias(f"x{i}") for i, x in enumerate(xs)), F.col(y).cast("double").alias("y"))
    edges = bin_edges(rows, [f"x{i}" for i in range(d)], bins)
    bases = rows.agg(F.percentile_approx("y", list(qs), 10_000)).first()[0]
    if bases is None:
        return [{"base": 0.0, "trees": []} for _ in qs]
    names = [*(f"b{i}" for i in range(d)), "y", *(f"f{m}" for m in models)]
    kinds = ", ".join(f"{n} {'byte' if n[0] == 'b' else 'double'}" for n in names)

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(float) for i in range(d)], axis=1)
            got = binned(x, edges).view(np.int8)
            yield pa.RecordBatch.from_arrays([*(pa.array(np.ascontiguousarray(got[:, i])) for i in range(d)), batch.column(d), *(pa.array(np.full(len(x), b)) for b in bases)], names=names)

    now = settled(rows.mapInArrow(put, kinds), "boost")
    out: list[list[dict]] = [[] for _ in qs]

    def read(batch: pa.RecordBatch) -> tuple[list[np.ndarray], np.ndarray, list[np.ndarray]]:
        got = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(len(names))]
        return [b.view(np.uint8) for b in got[:d]], got[d], got[d + 1 :]

    for _ in range(trees):
        grow, levels = [root() for _ in qs], [[0] for _ in qs]
        for _ in range(depth):
            shape = (len(qs), max(map(len, levels)), d, bins + 1, 2)

            def counts(batches: Iterator[pa.RecordBatch], grow=grow, levels=tuple(map(tuple, levels)), shape=shape) -> Iterator[pa.RecordBatch]:
                total = np.zeros(shape, np.int64)
                numbers = [np.full(len(tree["feature"]), -1) for tree in grow]
                for m in models:
                    numbers[m][list(levels[m])] = range(len(levels[m]))
                for batch in batches:
                    b, y, fits = read(batch)
                    for m in models:
                        if not levels[m]:
                            continue
                        node = numbers[m][leaf_of(grow[m], b)]
                        own = slice(None) if (node >= 0).all() else np.flatnonzero(node >= 0)
                        start, above = node[own] * (bins + 1) * 2, (y > fits[m])[own]
                        for f in range(d):
                            got = np.bincount(start + b[f][own] * np.int64(2) + above, minlength=shape[1] * shape[3] * 2)
                            total[m, :, f] += got.reshape(shape[1], *shape[3:])
                at = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total.ravel()[at])], names=["at", "n"])

            found = now.mapInArrow(counts, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toPandas()
            n = np.zeros(shape)
            n.reshape(-1)[found["at"]] = found["n"]
            for m, q in enumerate(qs):
                own = n[m, : len(levels[m])]
                histogram = np.stack([q * own[..., 1] + (q - 1) * own[..., 0], own.sum(axis=-1)], axis=-1)
                levels[m] = grown(grow[m], levels[m], best_splits(histogram, least), edges)
            if not any(levels):
                break

        def leaves(batches: Iterator[pa.RecordBatch], grow=grow) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                b, y, fits = read(batch)
                for m in models:
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(y), m, np.int32)), pa.array(leaf_of(grow[m], b)), pa.array(y - fits[m])], names=["model", "leaf", "rest"])

        for r in now.mapInArrow(leaves, "model int, leaf int, rest double").groupBy("model", "leaf").agg(F.percentile_approx("rest", list(qs), 10_000).alias("v")).collect():  # a row a leaf
            grow[r.model]["value"][r.leaf] = rate * r.v[r.model]
        for m in models:
            out[m].append({k: v for k, v in grow[m].items()})

        def moved(batches: Iterator[pa.RecordBatch], grow=grow) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                b, _, fits = read(batch)
                yield pa.RecordBatch.from_arrays([*batch.columns[: d + 1], *(pa.array(fits[m] + np.asarray(grow[m]["value"])[leaf_of(grow[m], b)]) for m in models)], names=names)

        if len(out[0]) < trees:
            now = settled(now.mapInArrow(moved, kinds), "boost")
    return [{"base": float(b), "trees": t} for b, t in zip(bases, out)]


def boosted_quantiles(train: DataFrame, rows: DataFrame, xs: Sequence[str], y: str, qs: dict[str, float], **how) -> DataFrame:
    """rows with a column for each quantile of qs, by the boosted trees of train; values are made ascending, so that
    quantiles don't cross."""
    order = sorted(qs, key=qs.get)
    models = fit_boosted_quantiles(train, xs, y, [qs[name] for name in order], **how)

    @F.arrow_udf(", ".join(f"q{i} double" for i in range(len(order))))
    def score(*columns: pa.Array) -> pa.Array:
        x = np.stack([c.to_numpy(zero_copy_only=False).astype(float) for c in columns]).T
        got = np.maximum.accumulate(np.stack([tree_scores(m["trees"], x, m["base"]) for m in models]), axis=0)
        return pa.StructArray.from_arrays([pa.array(g) for g in got], names=[f"q{i}" for i in range(len(order))])

    scored = rows.withColumn("__q", score(*(F.col(x).cast("double") for x in xs)))
    return scored.withColumns({name: F.col("__q")[f"q{i}"] for i, name in enumerate(order)}).drop("__q")
