"""Scoring by fitted artifacts, regressions by group, and forecast metrics."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import clamp, keyed_draw, logistic, shrunk_ratio
from ..sources.work import settled

#: Clusters of a bootstrap, as seasons, that one task numbers at most.
MOST_CLUSTERS = 100_000

# Scoring


def transformed(spec: dict) -> Column:
    """A feature's expression by its spec: column, kind (identity, indicator, center, ratio, shrunk), clip, missing."""
    x = F.col(spec["column"]).cast("double")
    kind = spec.get("kind", "identity")
    if kind == "indicator":
        x = F.when(x.isNotNull(), (x == spec.get("equals", 1)).cast("double"))
    elif kind == "center":
        x = x - spec["mean"]
    elif kind == "ratio":
        x = F.try_divide(x, F.col(spec["bucket_mean"]))
    elif kind == "shrunk":
        x = F.when(x.isNotNull(), shrunk_ratio(x, F.col(spec["bucket_mean"]), F.col(spec["n"]), spec["k"]))
    if "clip" in spec:
        x = F.when(x.isNotNull(), clamp(x, *map(float, spec["clip"])))
    return F.coalesce(x, F.lit(float(spec.get("missing", 0.0))))


def linear_head(specs: Sequence[dict], coefficients: dict[str, list[float]], group: Column, base: Column, form: str = "ratio", bounds: tuple[float, float] = (0.0, 2.0)) -> Column:
    """intercept + sum of coefficient x feature, by group, applied to a base: ratio gives base * clamp(lin), offset
    gives base + lin kept within base times the bounds. Groups without coefficients keep the base."""
    out = None
    for name, (intercept, *weights) in coefficients.items():
        lin = reduce(lambda acc, sw: acc + transformed(sw[0]) * F.lit(float(sw[1])), zip(specs, weights), F.lit(float(intercept)))
        value = base * clamp(lin, *bounds) if form == "ratio" else clamp_between(base + lin, base * bounds[0], base * bounds[1])
        out = F.when(group == name, value) if out is None else out.when(group == name, value)
    return base if out is None else out.otherwise(base)


def clamp_between(x: Column, low: Column, high: Column) -> Column:
    return F.least(high, F.greatest(low, x))


def check_artifact(artifact: dict, features: Sequence[str], holdout: Sequence[int] = ()) -> dict:
    """The artifact; ValueError if it has other features than those expected or in another order, if it learned from
    a season that is held out, if a tree lacks a part or points outside itself, or if its golden rows, of which
    there must be one, don't come out to 1e-6."""
    if list(artifact.get("features", [])) != list(features):
        raise ValueError("the artifact's features are not those expected")
    seen = sorted(set(artifact.get("seasons", ())) & set(holdout))
    if seen:
        raise ValueError(f"the artifact learned from held-out seasons {seen}")
    for tree in artifact.get("trees", ()):
        parts = [tree.get(k, ()) for k in ("feature", "threshold", "left", "right", "missing_left", "value")]
        inner = [k for k, f in enumerate(parts[0]) if f >= 0]
        if len({len(p) for p in parts}) != 1 or not parts[0] or any(not k < max(parts[2][k], parts[3][k]) < len(parts[0]) or parts[0][k] >= len(features) for k in inner):
            raise ValueError("a tree of the artifact is broken")
    if not artifact.get("golden"):
        raise ValueError("the artifact has no golden rows")
    for row in artifact["golden"]:
        got = tree_scores(artifact["trees"], np.array([row["x"]], float), artifact.get("base", 0.0))[0]
        if abs(got - row["y"]) > 1e-6:
            raise ValueError(f"a golden row gives {got}, not {row['y']}")
    return artifact


def heads(specs: Sequence[dict], coefficients: dict[str, dict[str, list[float]]], group: Column, base: Column, **how) -> list[Column]:
    """A linear_head for each name (mean, p10, p50, p90): coefficients by name and group."""
    return [linear_head(specs, by_group, group, base, **how).alias(name) for name, by_group in coefficients.items()]


def served(df: DataFrame, week: list[str], group: str, line: str, opponent: str, values: Sequence[str], zero: str) -> DataFrame:
    """df with `rank`, a row's place in its group by line (equals share one), and `no_game`: a row without an opponent in a week in which
    others have one is a certain zero: its values are 0 and the chance of zero is 1. Where no row of a week has an
    opponent, the schedule isn't known and nothing is changed. Places are worked out over the different lines of a
    group, so no window holds its rows."""
    by_line = df.groupBy(*week, group, line).agg(F.count("*").alias("__n"), F.max(F.col(opponent).isNotNull()).alias("__any"))
    above = Window.partitionBy(*week, group).orderBy(F.desc_nulls_last(line)).rowsBetween(Window.unboundedPreceding, -1)
    places = by_line.withColumn("rank", (F.coalesce(F.sum("__n").over(above), F.lit(0)) + 1).cast("int"))
    known = by_line.groupBy(*week).agg(F.max("__any").alias("__known"))
    out = df
    for found, keys in ((places.drop("__n", "__any"), [*week, group, line]), (known, week)):
        found = found.withColumnsRenamed({k: f"__of_{k}" for k in keys})
        out = out.join(found, reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"__of_{k}")) for k in keys))).drop(*(f"__of_{k}" for k in keys))
    out = out.withColumn("no_game", F.col("__known") & F.col(opponent).isNull()).drop("__known")
    return out.withColumns({**{v: F.when(F.col("no_game"), F.lit(0.0)).otherwise(F.col(v)) for v in values}, zero: F.when(F.col("no_game"), F.lit(1.0)).otherwise(F.col(zero))})


def age_factor(df: DataFrame, births: DataFrame, names: DataFrame, curve: DataFrame, key: str, group: str, name: str, season: str, out: str = "factor") -> DataFrame:
    """df with the curve(group, age, f) factor of each row's age: the birth year of births(key, born) goes before that
    of names(group, name, born); ages beyond the curve's ends take the ends, and 1 stands where the birth year or
    the age is unknown or the factor is not above 0."""
    one = births.select(key, F.col("born").alias("__one"))
    two = names.select(group, name, F.col("born").alias("__two"))
    ends = curve.agg(F.min("age").alias("__low"), F.max("age").alias("__high"))  # one row
    own = df.join(one, key, "left").join(two, [group, name], "left").join(F.broadcast(ends))
    own = own.withColumn("__age", F.greatest("__low", F.least("__high", F.col(season) - F.coalesce("__one", "__two"))))
    own = own.withColumn("__age", F.when(F.coalesce("__one", "__two").isNotNull(), F.col("__age")))
    held = curve.select(group, F.col("age").alias("__age"), F.col("f").alias("__f"))
    factor = F.when(F.col("__f") > 0, F.col("__f")).otherwise(1.0)
    return own.join(held, [group, "__age"], "left").withColumn(out, factor).select(*df.columns, out)


def opportunity_factor(
    df: DataFrame, usage: DataFrame, means: DataFrame, key: str, group: str, rank: str, season: str, fits: dict[str, dict], floors: dict[str, float],
    bucket: int = 12, most_rank: int = 60, low: float = 0.7, high: float = 1.3, out: str = "factor",
) -> DataFrame:
    """df with the factor of each row's use in the season before, against what its rank's bucket of the group has.

    usage has key, season and the features, means has group, bucket (from 0) and the features. fits give each
    group its features, coefficients b (intercept first), mean and amp: the fit of use over the bucket's mean, over
    the fit's mean, kept within low and high, moves the factor by amp. A feature that is missing, or whose bucket
    mean is not above its floor, counts as expected. Rows without a fit, a use, a rank up to most_rank or a
    bucket have 1.
    """
    names = list(floors)
    last = usage.select(key, (F.col(season) + 1).alias(season), F.lit(True).alias("__used"), *(F.col(c).cast("double").alias(f"__u_{c}") for c in names))
    held = means.select(group, F.col("bucket").alias("__bucket"), F.lit(True).alias("__held"), *(F.col(c).cast("double").alias(f"__m_{c}") for c in names))
    own = df.withColumn("__bucket", F.floor((F.col(rank) - 1) / bucket)).join(last, [key, season], "left").join(held, [group, "__bucket"], "left")
    relative = {c: F.when(F.col(f"__u_{c}").isNotNull() & (F.col(f"__m_{c}") > floors[c]), F.col(f"__u_{c}") / F.col(f"__m_{c}")).otherwise(1.0) for c in names}
    factor = None
    for name, fit in fits.items():
        value = reduce(lambda acc, cb: acc + relative[cb[0]] * F.lit(float(cb[1])), zip(fit["features"], fit["b"][1:]), F.lit(float(fit["b"][0])))
        moved = 1 + (clamp(value / float(fit["mean"]), low, high) - 1) * float(fit["amp"])
        factor = F.when(F.col(group) == name, moved) if factor is None else factor.when(F.col(group) == name, moved)
    known = F.col("__used").isNotNull() & F.col("__held").isNotNull() & F.col(rank).between(1, most_rank)
    return own.withColumn(out, F.when(known, F.coalesce(factor, F.lit(1.0))).otherwise(1.0)).select(*df.columns, out)


def carry_forward(df: DataFrame, key: list[str], season: str, value: str, at: int, qs: dict[str, float], least: float = 20.0) -> DataFrame:
    """(key, mean, and a column a quantile) of a season: last season's value, and it times the quantiles of value over
    the one before, over all other seasons whose one before is above `least`."""
    last = df.select(*key, (F.col(season) + 1).alias(season), F.col(value).alias("__last"))
    both = df.join(last, [*key, season])
    ratios = both.where((F.col("__last") > least) & (F.col(season) != at)).select((F.col(value) / F.col("__last")).alias("r"))
    ratio = ratios.agg(*(F.coalesce(F.percentile("r", q), F.lit(1.0)).alias(f"__{name}") for name, q in qs.items()))  # one row
    own = last.where(F.col(season) == at).join(F.broadcast(ratio))
    return own.select(*key, F.col("__last").alias("mean"), *((F.col("__last") * F.col(f"__{name}")).alias(name) for name in qs))


def boosted(train: DataFrame, rows: DataFrame, xs: Sequence[str], y: str, out: str, classes: bool = False, trees: int = 10, depth: int = 3, seed: int = 1) -> DataFrame:
    """rows with `out`, by gradient-boosted trees over binned features: the mean, or of two classes the chance of 1.
    Rows with a missing feature are left out of both."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.regression import GBTRegressor

    put = VectorAssembler(inputCols=list(xs), outputCol="__x", handleInvalid="skip")
    kind = GBTClassifier if classes else GBTRegressor
    learner = kind(featuresCol="__x", labelCol=y, predictionCol="__y", maxIter=trees, maxDepth=depth, maxBins=32, stepSize=0.3, seed=seed)
    model = learner.fit(put.transform(train.select(*xs, F.col(y).cast("double").alias(y))).select("__x", y))
    got = model.transform(put.transform(rows))
    value = vector_to_array(F.col("probability"))[1] if classes else F.col("__y")
    return got.withColumn(out, value).select(*rows.columns, out)


def tree_scores(trees: list[dict], x: np.ndarray, base: float = 0.0) -> np.ndarray:
    """The sum of boosted trees for rows of features; NaN goes the way the node says. A tree has arrays feature (-1
    at leaves), threshold, left, right, missing_left and value; rows go down it node by node, all of a node at once."""
    out, columns = np.full(len(x), base, float), [np.ascontiguousarray(x[:, f]) for f in range(x.shape[1])]
    for t in trees:
        walk: list = [(0, slice(None))]
        while walk:
            node, at = walk.pop()
            f = t["feature"][node]
            if f < 0:
                out[at] += t["value"][node]
                continue
            v = columns[f][at]
            left = v <= t["threshold"][node]
            if t["missing_left"][node]:
                left |= np.isnan(v)
            sides = ((t[side][node], np.flatnonzero(way) if isinstance(at, slice) else at[way]) for side, way in (("left", left), ("right", ~left)))
            walk += [s for s in sides if len(s[1])]
    return out


def score_trees(df: DataFrame, artifact: dict, features: Sequence[str], out: str) -> DataFrame:
    """df with the artifact's score of its feature columns; nulls are NaN in the trees only."""
    trees, base = artifact["trees"], float(artifact.get("base", 0.0))

    @F.pandas_udf("double")
    def score(frame: pd.DataFrame) -> pd.Series:
        return pd.Series(tree_scores(trees, frame.to_numpy(float), base))

    return df.withColumn(out, score(F.struct(*(F.col(c).cast("double").alias(c) for c in features))))


def mlp_scores(layers: list[dict], mean: list[float], scale: list[float], x: np.ndarray) -> np.ndarray:
    """Standardised features through layers of weights and biases with ReLU between."""
    h = (x - np.asarray(mean)) / np.asarray(scale)
    for i, layer in enumerate(layers):
        h = h @ np.asarray(layer["w"]) + np.asarray(layer["b"])
        h = np.maximum(h, 0) if i + 1 < len(layers) else h
    return h[:, 0]


def score_mlp(df: DataFrame, artifact: dict, features: Sequence[str], out: str) -> DataFrame:
    @F.pandas_udf("double")
    def score(frame: pd.DataFrame) -> pd.Series:
        return pd.Series(mlp_scores(artifact["layers"], artifact["mean"], artifact["scale"], frame.to_numpy(float)))

    return df.withColumn(out, score(F.struct(*(F.col(c).cast("double").alias(c) for c in features))))


def mixture_quantile(q: float, zero: Column, levels: Sequence[float], values: Column) -> Column:
    """The q quantile of a mixture of a mass at zero and a grid of conditional quantiles, whose values are made
    ascending and stay flat behind the last level."""
    at = (F.lit(q) - zero) / (1 - zero)
    knots = [0.0, *levels]
    ys = [F.lit(0.0)]
    for i in range(len(levels)):
        ys.append(F.greatest(ys[-1], F.element_at(values, i + 1)))
    out = F.when(at <= 0, 0.0)
    for i in range(len(levels)):
        out = out.when(at <= knots[i + 1], ys[i] + (ys[i + 1] - ys[i]) * (at - knots[i]) / (knots[i + 1] - knots[i]))
    return out.otherwise(ys[-1])


def hurdle_price(p: Column, level: Column, smear: float, money: float, low: float = 1.0, high: float | None = None) -> Column:
    """A share of the money: p * exp(level) / 1000 * smear + (1 - p) / money, times the money, clamped."""
    x = (p * F.exp(level) / 1000 * smear + (1 - p) / money) * money
    return clamp(x, low, float(money if high is None else high))


def win_chance(bid: Column, intercept: Column, slope: float, mean: float, sd: float) -> Column:
    """Logistic in the standardised log(1 + bid)."""
    return logistic(intercept + slope * (F.log1p(bid) - mean) / sd)


def bid_for(p: float, intercept: Column, slope: float, mean: float, sd: float) -> Column:
    """The least whole bid that wins with chance p; null if a higher bid does not help."""
    if slope <= 0:
        return F.lit(None).cast("long")
    return F.greatest(F.lit(0), F.ceil(F.expm1((F.lit(float(np.log(p / (1 - p)))) - intercept) / slope * sd + mean))).cast("long")


def season_blend(line: Column, games: Column, points: Column, k: float) -> Column:
    """(k * line + games * rate) / (k + games): the line without games, the rate without a line or a k."""
    n = F.when(games > 0, games).otherwise(0)
    rate = F.when(n > 0, points / n)
    mixed = rate if k <= 0 else (k * line + n * rate) / (k + n)
    return F.when(line.isNull(), rate).when(rate.isNull(), line).otherwise(mixed)


def consensus_blend(df: DataFrame, keys: list[str], own: str, other: str, weight: float, tie: str, out: str) -> DataFrame:
    """The group's own values dealt anew: the best to the row with the best mix of own and other percentile."""
    w = Window.partitionBy(*keys)
    pct = lambda c: F.coalesce(F.percent_rank().over(w.orderBy(F.desc_nulls_last(c))), F.lit(1.0))
    mixed = df.withColumn("__mix", (1 - weight) * pct(own) + weight * pct(other))
    mixed = mixed.withColumn("__place", F.row_number().over(w.orderBy("__mix", F.desc(own), tie)))
    dealt = df.withColumn("__place", F.row_number().over(w.orderBy(F.desc(own), tie))).select(*keys, "__place", F.col(own).alias(out))
    return mixed.join(dealt, [*keys, "__place"]).drop("__mix", "__place")


# Fitting


def embargoed(df: DataFrame, season: str, as_of: int, embargo: Sequence[int]) -> DataFrame:
    """Rows of seasons before as_of and not under embargo; ValueError if there are none."""
    out = df.where((F.col(season) < as_of) & ~F.col(season).isin(*embargo) if embargo else F.col(season) < as_of)
    if out.isEmpty():
        raise ValueError("no season is left to learn from")
    return out


def moments(df: DataFrame, keys: list[str], xs: Sequence[str], y: str) -> DataFrame:
    """(keys, n, xx, xy): the normal equations' sums with an intercept, of rows in which all are known. They are
    all that a least-squares fit needs, are summed map-side, and add up over groups."""
    cols = [F.lit(1.0), *(F.col(c).cast("double") for c in xs)]
    known = df.where(reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in (*xs, y))))
    xx = F.array(*(F.sum(a * b) for i, a in enumerate(cols) for b in cols[i:]))
    xy = F.array(*(F.sum(a * F.col(y)) for a in cols))
    return known.groupBy(*keys).agg(F.count("*").alias("n"), xx.alias("xx"), xy.alias("xy"), F.sum(F.col(y) * F.col(y)).alias("yy"))


def solve_moments(xx: Sequence[float], xy: Sequence[float], ridge: float = 0.0) -> list[float]:
    """Coefficients, intercept first and never penalised."""
    d = len(xy)
    a = np.zeros((d, d))
    a[np.triu_indices(d)] = xx
    a = a + np.triu(a, 1).T + ridge * np.diag([0.0] + [1.0] * (d - 1))
    return np.linalg.lstsq(a, np.asarray(xy, float), rcond=None)[0].tolist()


def fit_ols(df: DataFrame, keys: list[str], xs: Sequence[str], y: str, ridge: float = 0.0) -> DataFrame:
    """(keys, n, coefficients) by group; only the sums, a row a group, meet Python."""

    @F.pandas_udf("array<double>")
    def solve(xx: pd.Series, xy: pd.Series) -> pd.Series:
        return pd.Series([solve_moments(a, b, ridge) for a, b in zip(xx, xy)])

    return moments(df, keys, xs, y).select(*keys, "n", solve("xx", "xy").alias("coefficients"))


def leave_one_out(df: DataFrame, fold: str, xs: Sequence[str], y: str, ridge: float = 0.0) -> DataFrame:
    """df with `predicted`, by the fit on all folds but the row's: the sums of all less the fold's own."""
    per = moments(df, [fold], xs, y)
    d = len(xs) + 1
    whole = per.agg(
        *(F.array(*(F.sum(F.element_at(c, i + 1)) for i in range(n))).alias(f"__{c}") for c, n in (("xx", d * (d + 1) // 2), ("xy", d)))
    )
    minus = lambda a, b: F.zip_with(a, b, lambda p, q: p - q)

    @F.pandas_udf("array<double>")
    def solve(xx: pd.Series, xy: pd.Series) -> pd.Series:
        return pd.Series([solve_moments(a, b, ridge) for a, b in zip(xx, xy)])

    fits = per.join(F.broadcast(whole)).select(fold, solve(minus("__xx", "xx"), minus("__xy", "xy")).alias("__b"))
    predicted = reduce(lambda acc, ix: acc + F.element_at("__b", ix[0] + 2) * F.col(ix[1]), enumerate(xs), F.element_at("__b", 1))
    return df.join(fits, fold).withColumn("predicted", predicted).drop("__b")


def fit_logistic(df: DataFrame, xs: Sequence[str], y: str, l2: float = 1.0, rounds: int = 12) -> list[float]:
    """Coefficients of an L2-penalised logistic regression by Newton steps, intercept first. Each step is one
    aggregate over the rows; a vector and a matrix of the features' number come back."""
    d = len(xs) + 1
    cols = [F.lit(1.0), *(F.col(c).cast("double") for c in xs)]
    rows = df.where(reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in (*xs, y)))).select(*xs, y)
    w = np.zeros(d)
    for _ in range(rounds):
        p = logistic(reduce(lambda acc, ic: acc + float(w[ic[0]]) * ic[1], enumerate(cols), F.lit(0.0)))
        grad = [F.sum(c * (p - F.col(y))).alias(f"g{i}") for i, c in enumerate(cols)]
        hess = [F.sum(cols[i] * cols[j] * p * (1 - p)).alias(f"h{i}_{j}") for i in range(d) for j in range(i, d)]
        got = rows.agg(*grad, *hess).first()
        if got[0] is None:
            break
        penalty = np.diag([0.0] + [l2] * (d - 1))
        h = np.zeros((d, d))
        h[np.triu_indices(d)] = [got[f"h{i}_{j}"] for i in range(d) for j in range(i, d)]
        h = h + np.triu(h, 1).T + penalty + 1e-9 * np.eye(d)
        step = np.linalg.solve(h, np.array([got[f"g{i}"] for i in range(d)]) + penalty @ w)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return w.tolist()


def fit_quantile(df: DataFrame, keys: list[str], xs: Sequence[str], y: str, q: float, rounds: int = 25) -> DataFrame:
    """(keys, b): coefficients of a quantile regression by group, intercept first, by reweighted least squares on the
    pinball loss.

    As in fit_ols, sums by group are all that meets Python: each round weighs the rows by their residuals of the
    round before, q above and 1 - q below over their size, and sums the weighted normal equations map-side.
    """

    @F.pandas_udf("array<double>")
    def solve(xx: pd.Series, xy: pd.Series) -> pd.Series:
        return pd.Series([solve_moments(a, b) for a, b in zip(xx, xy)])

    cols = [F.lit(1.0), *(F.col(c).cast("double") for c in xs)]
    rows = df.where(reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in (*xs, y)))).select(*keys, *xs, y)
    b = fit_ols(rows, keys, xs, y).select(*keys, F.col("coefficients").alias("b"))
    for k in range(rounds):
        b = settled(b, "quantile-round")
        fitted = reduce(lambda acc, ic: acc + F.element_at("b", ic[0] + 1) * ic[1], enumerate(cols), F.lit(0.0))
        met = rows.join(b, keys).withColumn("__r", F.col(y) - fitted)
        weight = F.when(F.col("__r") >= 0, q).otherwise(1 - q) / F.greatest(F.abs("__r"), F.lit(1e-6))
        weighed = met.withColumn("__w", weight)
        xx = F.array(*(F.sum(F.col("__w") * a * c) for i, a in enumerate(cols) for c in cols[i:]))
        xy = F.array(*(F.sum(F.col("__w") * a * F.col(y)) for a in cols))
        b = weighed.groupBy(*keys).agg(xx.alias("xx"), xy.alias("xy")).select(*keys, solve("xx", "xy").alias("b"))
    return b


def forward_blocks(seasons: Sequence[int], least: int) -> list[tuple[list[int], int]]:
    """(training seasons, test season) in order of time, from the first with `least` seasons before it."""
    ordered = sorted(seasons)
    return [(ordered[:i], ordered[i]) for i in range(least, len(ordered))]


# Metrics


def pinball(y: Column, p: Column, q: float) -> Column:
    return F.when(y >= p, q * (y - p)).otherwise((q - 1) * (y - p))


def crps_season(y: Column, quantiles: dict[float, Column]) -> Column:
    """The mean of the pinball losses."""
    return reduce(lambda a, b: a + b, (pinball(y, p, q) for q, p in quantiles.items())) / len(quantiles)


def crps_week(y: Column, quantiles: dict[float, Column]) -> Column:
    """Twice the mean of the pinball losses."""
    return 2 * crps_season(y, quantiles)


def fit_quality(y: str, p: str) -> list[Column]:
    """RMSE, R2 and bias as aggregates."""
    e = F.col(p) - F.col(y)
    total = F.sum(F.col(y) * F.col(y)) - F.sum(y) * F.sum(y) / F.count(y)
    return [F.sqrt(F.avg(e * e)).alias("rmse"), (1 - F.sum(e * e) / F.nullif(total, F.lit(0.0))).alias("r2"), F.avg(e).alias("bias")]


def reliability(df: DataFrame, keys: list[str], p: str, y: str, bins: int = 5) -> DataFrame:
    """(keys, bin, n, mean chance, share that happened) of bins with rows."""
    b = F.least(F.lit(bins - 1), F.floor(F.col(p) * bins)).cast("int")
    return df.groupBy(*keys, b.alias("bin")).agg(F.count("*").alias("n"), F.avg(p).alias("chance"), F.avg(y).alias("share"))


def brier_and_logloss(p: str, y: str) -> list[Column]:
    c = clamp(F.col(p), 1e-6, 1 - 1e-6)
    return [F.avg(F.pow(F.col(p) - F.col(y), 2)).alias("brier"), F.avg(-(F.col(y) * F.log(c) + (1 - F.col(y)) * F.log(1 - c))).alias("logloss")]


def spearman(df: DataFrame, keys: list[str], x: str, y: str, out: str) -> DataFrame:
    """The correlation of average ranks."""
    w = Window.partitionBy(*keys)
    rank = lambda c: F.rank().over(w.orderBy(c)) + (F.count(F.lit(1)).over(Window.partitionBy(*keys, c)) - 1) / 2
    return df.withColumn("__x", rank(x)).withColumn("__y", rank(y)).groupBy(*keys).agg(F.corr("__x", "__y").alias(out))


def partial_correlation(df: DataFrame, keys: list[str], x: str, y: str, given: str, out: str) -> DataFrame:
    """The correlation of x and y with `given` held, from three correlations."""
    r = df.groupBy(*keys).agg(F.corr(x, y).alias("__a"), F.corr(x, given).alias("__b"), F.corr(y, given).alias("__c"))
    b, c = F.col("__b"), F.col("__c")
    return r.select(*keys, F.try_divide(F.col("__a") - b * c, F.sqrt((1 - b * b) * (1 - c * c))).alias(out))


def paired_effect(df: DataFrame, fold: str, a: str, b: str) -> DataFrame:
    """One row: the mean of the folds' paired differences, its standard error and t, and 2.9 errors as what could
    be told from nothing."""
    per = df.groupBy(fold).agg(F.avg(F.col(a) - F.col(b)).alias("d"))
    se = F.stddev_samp("d") / F.sqrt(F.count("*"))
    return per.agg(F.avg("d").alias("effect"), se.alias("se"), F.try_divide(F.avg("d"), se).alias("t"), (2.9 * se).alias("detectable"))


def clustered_bootstrap(df: DataFrame, cluster: str, value: str, draws: int = 2000, seed: int = 11) -> DataFrame:
    """One row: the mean of the clusters' means, and the 2.5 and 97.5 % points of its resamples.

    Clusters (seasons) are few and draws fixed: a draw's picks are keyed hashes, so the interval is the same
    whatever the partitions. The clusters' means are numbered and met by (draw, pick) rows.
    """
    means = settled(df.groupBy(cluster).agg(F.avg(value).alias("m")), "clusters")
    n = means.count()
    if n > MOST_CLUSTERS:
        raise ValueError(f"{n} clusters are more than the {MOST_CLUSTERS} that are numbered in one task")
    numbered = means.withColumn("i", F.row_number().over(Window.orderBy(cluster)))
    picks = df.sparkSession.range(draws * n).select((F.col("id") / n).cast("long").alias("draw"), (F.col("id") % n).alias("slot"))
    u = keyed_draw(F.lit("bootstrap"), F.lit(seed), F.col("draw"), F.col("slot"))
    picked = picks.withColumn("i", (F.floor(u * n) + 1).cast("int")).join(F.broadcast(numbered), "i").groupBy("draw").agg(F.avg("m").alias("m"))
    point = means.agg(F.avg("m").alias("mean"))
    return picked.agg(F.percentile("m", 0.025).alias("low"), F.percentile("m", 0.975).alias("high")).join(F.broadcast(point)).select("mean", "low", "high")


def gate(df: DataFrame, group: str, y: str, quantiles: dict[float, str], floor: str, zero: str, cover: tuple = (0.70, 0.90), pooled: tuple = (0.75, 0.85)) -> DataFrame:
    """(group or null for all, crps, floor, coverage, zero error, passes): clauses on each group and on all of them."""
    low, high = min(quantiles), max(quantiles)
    crps = crps_week(F.col(y), {q: F.col(c) for q, c in quantiles.items()})
    inside = F.when(F.col(y) > 0, F.col(y).between(F.col(quantiles[low]), F.col(quantiles[high])).cast("double"))
    got = df.rollup(group).agg(
        F.avg(crps).alias("crps"), F.avg(floor).alias("floor"), F.avg(inside).alias("coverage"),
        F.abs(F.avg(zero) - F.avg((F.col(y) == 0).cast("double"))).alias("zero_error"),
    )
    all_ = F.col(group).isNull()
    ok = (F.col("crps") < F.col("floor")) & (F.col("zero_error") <= 0.03) & F.when(all_, F.col("coverage").between(*pooled)).otherwise(F.col("coverage").between(*cover))
    return got.withColumn("passes", ok)


def overfit_chance(paths: DataFrame, train: str, test: str) -> DataFrame:
    """One row: the share of paths whose lift in training and in test disagree in sign; zero training lifts skipped."""
    return paths.where(F.col(train) != 0).agg(F.avg((F.signum(train) != F.signum(test)).cast("double")).alias("pbo"))
