"""Choosing between models on seasons that they haven't seen: combinatorial and forward-chained cross-validation from
season moments, and a permutation floor for partial correlations.

A season's moments are the sums that a least-squares fit and its squared loss need. They are summed map-side, once,
a row a season, and every fit and loss here comes from sums of those rows: no fit reads the panel again.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator, Mapping, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.work import settled
from .models import moments, solve_moments

#: Seasons that subsets are drawn of: one bit of a long each.
MOST_SEASONS = 62
#: Up to so many seasons, all subsets are listed before paths are drawn of them.
LISTED = 16
#: Rows of a season that are numbered in one window, on the average.
NUMBERED = 50_000
#: Values that replicates send to a block of places, together, and rows that are sent at once.
MET, SENT = 1 << 21, 1 << 17


def season_subsets(seasons: DataFrame, season: str, k: int, paths: int, purge: int = 0, seed: int = 0) -> DataFrame:
    """(path, season, side): the k test seasons of each path, and those it trains on: all others that are more than purge
    places from any test season. Paths are distinct subsets, numbered from 0: all there are, or `paths` of them, those
    whose seeded hash is smallest; with more than LISTED seasons they are drawn one by one and repeated ones left out,
    so that there may be fewer. Null seasons are left out; with fewer than k + 1 seasons there are no paths."""
    spark = seasons.sparkSession
    found = sorted(r[0] for r in seasons.where(F.col(season).isNotNull()).select(season).distinct().limit(MOST_SEASONS + 1).collect())
    n = len(found)
    if n > MOST_SEASONS:
        raise ValueError(f"there are more than {MOST_SEASONS} seasons")
    if n <= LISTED:
        masks = spark.range(1 << n).where(F.bit_count("id") == k).select(F.col("id").alias("mask"))
    else:
        drawn = spark.range(4 * paths).select("id", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("i"))
        place = F.row_number().over(Window.partitionBy("id").orderBy(F.xxhash64(F.lit(seed), "id", "i"), "i"))
        masks = drawn.withColumn("place", place).where(F.col("place") <= k).groupBy("id").agg(F.sum(F.expr("shiftleft(1L, i)")).alias("mask")).select("mask").distinct()
    chosen = masks.orderBy(F.xxhash64(F.lit(seed), "mask"), "mask").limit(paths if 0 < k < n else 0)
    numbered = chosen.withColumn("path", F.row_number().over(Window.orderBy("mask")) - 1)  # of at most `paths` rows
    near = reduce(lambda a, b: a.bitwiseOR(b), (F.shiftleft("mask", j).bitwiseOR(F.shiftright("mask", j)) for j in range(1, purge + 1)), F.col("mask"))
    listed = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(s).alias(season)) for i, s in enumerate(found)))) if found else F.lit(None)
    if not found:
        return spark.createDataFrame([], f"path int, {season} int, side string")
    each = numbered.select("path", "mask", near.alias("near"), listed.alias("s")).select("path", "mask", "near", "s.i", f"s.{season}")
    bit = lambda c: F.expr(f"shiftright({c}, i) & 1") == 1
    side = F.when(bit("mask"), "test").when(~bit("near"), "train")
    return each.select("path", season, side.alias("side")).where("side is not null")


def path_lifts(df: DataFrame, season: str, a: str, b: str, k: int, paths: int, purge: int = 0, seed: int = 0) -> DataFrame:
    """(path, train, test): how much the mean of column a is above that of b, in the mean of a path's training and test
    seasons. Each season counts alike, whatever its rows; rows in which either is null are left out."""
    per = settled(df.where(F.col(season).isNotNull() & F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(season).agg(F.avg(F.col(a) - F.col(b)).alias("lift")), "season-lifts")
    met = season_subsets(per, season, k, paths, purge, seed).join(F.broadcast(per), season)  # MOST_SEASONS rows
    side = lambda s: F.avg(F.when(F.col("side") == s, F.col("lift"))).alias(s)
    return met.groupBy("path").agg(side("train"), side("test"))


def _added(c: str, n: int) -> Column:
    """The sum of arrays of n numbers."""
    return F.array(*(F.sum(F.element_at(c, i + 1)) for i in range(n)))


def _sums(d: int) -> list[Column]:
    return [F.sum("n").alias("n"), _added("xx", d * (d + 1) // 2).alias("xx"), _added("xy", d).alias("xy"), F.sum("yy").alias("yy")]


def _part(xx: Sequence[float], xy: Sequence[float], d: int, own: Sequence[int]) -> tuple[np.ndarray, np.ndarray]:
    """The normal equations of some of the features, of those of all."""
    whole = np.zeros((d, d))
    whole[np.triu_indices(d)] = xx
    whole = whole + np.triu(whole, 1).T
    return whole[np.ix_(own, own)], np.asarray(xy, float)[list(own)]


def held_out_losses(fits: DataFrame, xs: Sequence[str], variants: Mapping[str, tuple[Sequence[str], float]]) -> DataFrame:
    """fits' other columns with (variant, inside, outside): the mean squared loss of each variant (its features and ridge),
    fitted on the sums xx, xy, yy, n, on those and on the sums test_xx, test_xy, test_yy, test_n. null where a side has
    no rows or the fit has fewer rows than coefficients."""
    d, names = len(xs) + 1, list(variants)
    own = {v: [0, *(1 + list(xs).index(c) for c in features)] for v, (features, _) in variants.items()}

    @F.pandas_udf("array<struct<variant: string, inside: double, outside: double>>")
    def losses(n: pd.Series, xx: pd.Series, xy: pd.Series, yy: pd.Series, m: pd.Series, tx: pd.Series, ty: pd.Series, tt: pd.Series) -> pd.Series:
        out = []
        for row in zip(n, xx, xy, yy, m, tx, ty, tt):
            one = []
            for v in names:
                inside = outside = None
                if row[0] is not None and row[0] >= len(own[v]):
                    a, c = _part(row[1], row[2], d, own[v])
                    b = np.asarray(solve_moments(a[np.triu_indices(len(c))], c, variants[v][1]))
                    loss = lambda a, c, yy, n, b=b: max(0.0, float((yy - 2 * b @ c + b @ a @ b) / n))
                    inside = loss(a, c, row[3], row[0])
                    if row[4] is not None and row[4] > 0:
                        outside = loss(*_part(row[5], row[6], d, own[v]), row[7], row[4])
                one.append({"variant": v, "inside": inside, "outside": outside})
            out.append(one)
        return pd.Series(out)

    sums = ("n", "xx", "xy", "yy", "test_n", "test_xx", "test_xy", "test_yy")
    kept = [c for c in fits.columns if c not in sums]
    return fits.select(*kept, F.explode(losses(*sums)).alias("l")).select(*kept, "l.variant", "l.inside", "l.outside")


def combinatorial_losses(df: DataFrame, season: str, xs: Sequence[str], y: str, variants: Mapping[str, tuple[Sequence[str], float]], k: int, paths: int, purge: int = 0, seed: int = 0) -> DataFrame:
    """(path, variant, inside, outside): combinatorial purged cross-validation. Each variant (features out of xs, ridge) is
    fitted on a path's training seasons and its squared loss taken there and on the path's test seasons; both from
    season moments alone."""
    d = len(xs) + 1
    per = settled(moments(df.where(F.col(season).isNotNull()), [season], xs, y), "season-moments")
    met = season_subsets(per, season, k, paths, purge, seed).join(F.broadcast(per), season)  # MOST_SEASONS rows
    sides = met.groupBy("path", "side").agg(*_sums(d))
    test = sides.where("side = 'test'").select("path", *(F.col(c).alias(f"test_{c}") for c in ("n", "xx", "xy", "yy")))
    return held_out_losses(sides.where("side = 'train'").drop("side").join(test, "path"), xs, variants)


def forward_losses(df: DataFrame, season: str, xs: Sequence[str], y: str, variants: Mapping[str, tuple[Sequence[str], float]], least: int = 2, span: int | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, season, n_train, variant, inside, outside): forward chaining. The fits for a season learn from the `span`
    seasons before it, or from all, if there are `least` or more; a window over the seasons sums their moments."""
    d = len(xs) + 1
    per = settled(moments(df.where(F.col(season).isNotNull()), [*keys, season], xs, y), "season-moments")
    before = Window.partitionBy(*keys).orderBy(season).rowsBetween(-span if span else Window.unboundedPreceding, -1)
    total = lambda c, n: F.array(*(F.sum(F.element_at(c, i + 1)).over(before) for i in range(n)))
    fits = per.select(
        *keys, season, F.count("n").over(before).alias("n_train"), F.sum("n").over(before).alias("n"), total("xx", d * (d + 1) // 2).alias("xx"), total("xy", d).alias("xy"), F.sum("yy").over(before).alias("yy"),
        *(F.col(c).alias(f"test_{c}") for c in ("n", "xx", "xy", "yy")),
    ).where(F.col("n_train") >= least)
    return held_out_losses(fits, xs, variants)


def grouped_losses(df: DataFrame, season: str, xs: Sequence[str], y: str, variants: Mapping[str, tuple[Sequence[str], float]], folds: int = 3, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, fold, n_train, variant, inside, outside): k-fold with whole seasons as groups. Seasons are dealt to folds in
    order of time, in turn; a fold's fits learn from all others: the sums of all less its own."""
    d, own = len(xs) + 1, Window.partitionBy(*keys)
    per = settled(moments(df.where(F.col(season).isNotNull()), [*keys, season], xs, y), "season-moments")
    dealt = per.withColumn("fold", (F.row_number().over(own.orderBy(season)) - 1) % folds)
    by_fold = dealt.groupBy(*keys, "fold").agg(*_sums(d), F.count("*").alias("seasons"))
    rest = lambda c, n: F.array(*(F.sum(F.element_at(c, i + 1)).over(own) - F.element_at(c, i + 1) for i in range(n)))
    fits = by_fold.select(
        *keys, "fold", (F.sum("seasons").over(own) - F.col("seasons")).alias("n_train"), (F.sum("n").over(own) - F.col("n")).alias("n"), rest("xx", d * (d + 1) // 2).alias("xx"), rest("xy", d).alias("xy"),
        (F.sum("yy").over(own) - F.col("yy")).alias("yy"), *(F.col(c).alias(f"test_{c}") for c in ("n", "xx", "xy", "yy")),
    )
    return held_out_losses(fits.where("n_train > 0"), xs, variants)


def best_variant(losses: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, variant, loss): the variant whose mean loss outside is least; of equal ones the first by name."""
    mean = losses.groupBy(*keys, "variant").agg(F.avg("outside").alias("loss")).where("loss is not null")
    return mean.groupBy(*keys).agg(F.min(F.struct("loss", "variant")).alias("b")).select(*keys, "b.variant", "b.loss")


# The permutation floor


def numbered_by(df: DataFrame, group: str, order: Sequence[str], out: str = "place") -> DataFrame:
    """df with each row's number in its group, from 0, and the group's size as `<out>_of`. Rows are dealt to buckets by a
    hash, numbered in their bucket and moved up by the buckets before, so no window holds a whole large group."""
    sizes = settled(df.groupBy(group, (F.pmod(F.xxhash64(*order), F.lit(1 << 20))).alias("__slot")).agg(F.count("*").alias("__n")), "slots")
    total = sizes.groupBy(group).agg(F.sum("__n").alias(f"{out}_of"))
    wide = F.greatest(F.lit(1), F.ceil(F.col(f"{out}_of") / NUMBERED)).cast("long")
    # a bucket is a range of slots, so that it can be told from the slot alone
    bucket = F.floor(F.col("__slot") * F.col("__buckets") / (1 << 20)).alias("__bucket")
    parts = sizes.join(total.withColumn("__buckets", wide), group).groupBy(group, bucket).agg(F.sum("__n").alias("__n"))
    before = F.sum("__n").over(Window.partitionBy(group).orderBy("__bucket")) - F.col("__n")
    starts = parts.select(group, "__bucket", before.alias("__before"))
    placed = df.withColumn("__slot", F.pmod(F.xxhash64(*order), F.lit(1 << 20))).join(total.withColumn("__buckets", wide), group).withColumn("__bucket", bucket)
    own = F.row_number().over(Window.partitionBy(group, "__bucket").orderBy("__slot", *order)) - 1
    placed = placed.withColumn(out, own).join(starts, [group, "__bucket"]).withColumn(out, (F.col(out) + F.col("__before")).cast("long"))
    return placed.select(*df.columns, out, f"{out}_of")


def permuted(place: np.ndarray, of: np.ndarray, rep: int, seed: int, back: bool = False) -> np.ndarray:
    """Another place for each place in range(of), by a permutation keyed by (seed, rep, of): four rounds of a balanced
    network over the next even number of bits, walked on until the place is one of the range. back undoes it."""
    half = np.maximum(1, (np.ceil(np.log2(np.maximum(of, 2))).astype(np.int64) + 1) // 2).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    at, left = place.astype(np.uint64).copy(), np.ones(len(place), bool)
    keys = [np.uint64((seed * 0x9E3779B97F4A7C15 + rep * 0xBF58476D1CE4E5B9 + r * 0x94D049BB133111EB + 1) % (1 << 64)) for r in range(4)]
    while left.any():
        a, b = at[left] >> half[left], at[left] & mask[left]
        a, b = (b, a) if back else (a, b)
        for key in reversed(keys) if back else keys:
            x = (b + key) * np.uint64(0xD6E8FEB86659FD93)
            x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
            a, b = b, (a ^ (x >> np.uint64(40))) & mask[left]
        a, b = (b, a) if back else (a, b)
        at[left] = a << half[left] | b
        left[left] = at[left] >= of[left].astype(np.uint64)
    return at.astype(np.int64)


def partial_of(moment: np.ndarray) -> float | None:
    """The correlation of the first two of (x, y, controls ...) with the controls held, from the sums of products of
    (1, x, y, controls ...); None where the controls or what is left of x or y can't be told apart from constants."""
    n = moment[0, 0]
    centred = moment[1:, 1:] - np.outer(moment[0, 1:], moment[0, 1:]) / n
    own, controls = centred[:2, :2], centred[2:, 2:]
    if len(controls):
        scale = np.sqrt(np.outer(np.diag(controls), np.diag(controls)))
        if (np.diag(controls) <= 0).any() or np.linalg.matrix_rank(controls / scale, tol=1e-9) < len(controls):
            return None
        own = own - centred[:2, 2:] @ np.linalg.solve(controls, centred[2:, :2])
    if (np.diag(own) <= 1e-12 * np.diag(centred)[:2]).any():
        return None
    return float(own[0, 1] / np.sqrt(own[0, 0] * own[1, 1]))


def shuffle_null(df: DataFrame, season: str, order: Sequence[str], x: str, y: str, controls: Sequence[str], reps: int = 25, seed: int = 0, least: int = 200) -> DataFrame:
    """One row (partial, reps, mean, p95, max): the correlation of x and y with the controls held, and the spread of its
    size when x is permuted within each season, `reps` times.

    Only rows in which all are known count; fewer than `least`, or controls that can't be told apart, give nulls and 0
    reps. A permutation is a function of a row's number in its season and can be undone, so replicates carry x to the
    number of the row that meets it, and only the products of x with its values are summed anew: all other sums are the
    same. Numbers are dealt out in blocks; what goes from some rows to a block is one row, so that no row is sorted or
    joined by itself, and a task holds a block, less of it the more replicates there are. order
    names columns that tell rows apart; rows that agree in them and all else are alike anyway.
    """
    spark, c = df.sparkSession, len(controls)
    known = df.select(F.col(season).alias("season"), *(F.col(o).alias(f"o{i}") for i, o in enumerate(order)), *(F.col(v).cast("double").alias(n) for v, n in ((x, "x"), (y, "y"), *((v, f"c{i}") for i, v in enumerate(controls)))))
    values = ["x", "y", *(f"c{i}" for i in range(c))]
    known = known.where(reduce(lambda a, b: a & b, (F.col(v).isNotNull() & ~F.isnan(v) for v in values), F.col("season").isNotNull()))
    rows = settled(numbered_by(known, "season", [*(f"o{i}" for i in range(len(order))), *values]).select("season", "place", "place_of", *values), "numbered")
    ones = [F.lit(1.0), *(F.col(v) for v in values)]
    fixed = np.array([v or 0.0 for v in rows.agg(*(F.sum(a * b).alias(f"m{i}_{j}") for i, a in enumerate(ones) for j, b in enumerate(ones))).first()]).reshape(c + 3, c + 3)
    real = partial_of(fixed) if fixed[0, 0] >= least else None
    if real is None:
        return spark.createDataFrame([(None, 0, None, None, None)], "partial double, reps int, mean double, p95 double, max double")
    block = max(1, MET // max(reps, 1))
    kind = dict(rows.dtypes)["season"]

    def parts(batch: pa.RecordBatch) -> Iterator[tuple]:
        """(season, block, replicate, places in the block, values); replicate -1 has what stays in its place."""
        names = batch.column(0).dictionary_encode()
        season, (place, of) = names.indices.to_numpy(), (batch.column(i).to_numpy() for i in (1, 2))
        kept = [batch.column(i).to_numpy() for i in range(3, batch.num_columns)]
        for rep in range(-1, reps):
            to = place if rep < 0 else permuted(place, of, rep, seed, back=True)
            order = np.lexsort((to, season))
            to, by, sent = to[order], season[order], np.stack([v[order] for v in (kept[1:] if rep < 0 else kept[:1])])
            cuts = np.flatnonzero((np.diff(by) != 0) | (np.diff(to // block) != 0)) + 1
            for i, j in zip([0, *cuts.tolist()], [*cuts.tolist(), len(to)]):
                yield names.dictionary[int(by[i])].as_py(), int(to[i] // block), rep, (to[i:j] % block).astype(np.int32).tobytes(), sent[:, i:j].tobytes()

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in itertools.chain(batches, [None]):
            held += [batch] if batch is not None and batch.num_rows else []
            if held and (batch is None or sum(x.num_rows for x in held) >= SENT):
                whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, got = [], list(zip(*parts(whole)))
                types = (whole.schema.field(0).type, pa.int64(), pa.int32(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(got, types)], names=["season", "block", "rep", "at", "v"])

    def meet(table: pa.Table) -> pa.Table:
        own, sums = np.zeros((c + 1, block)), np.zeros((reps, c + 1))
        chunks = [(r, np.frombuffer(at, np.int32), np.frombuffer(v)) for r, at, v in zip(*(table.column(x).to_pylist() for x in ("rep", "at", "v")))]
        for rep, at, v in chunks:
            if rep < 0:
                own[:, at] = v.reshape(c + 1, -1)
        for rep, at, v in chunks:
            if rep >= 0:
                sums[rep] += own[:, at] @ v
        return pa.table([pa.array(np.arange(reps, dtype=np.int32)), *(pa.array(sums[:, i]) for i in range(c + 1))], names=["rep", *(f"x{v}" for v in values[1:])])

    sent = rows.select("season", "place", "place_of", *values).mapInArrow(send, f"season {kind}, block long, rep int, at binary, v binary")
    met = sent.groupBy("season", "block").applyInArrow(meet, "rep int, " + ", ".join(f"x{v} double" for v in values[1:]))
    sums = met.groupBy("rep").agg(*(F.sum(f"x{v}").alias(f"x{v}") for v in values[1:])).orderBy("rep").collect()  # a row a replicate
    found = []
    for r in sums:
        moment = fixed.copy()
        moment[1, 2:] = moment[2:, 1] = [r[f"x{v}"] for v in values[1:]]
        part = partial_of(moment)
        found += [] if part is None else [abs(part)]
    found.sort()
    row = (real, len(found), float(np.mean(found)), found[min(len(found) - 1, int(len(found) * 0.95))], found[-1])
    return spark.createDataFrame([row], "partial double, reps int, mean double, p95 double, max double")
