"""Filters, joins, aggregates and set operations that SQL engines lack or define differently."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def in_scope(df: DataFrame, column: str, value) -> DataFrame:
    """df, of one scope if a value is given."""
    return df if value is None else df.where(F.col(column) == value)


def two_sided(df: DataFrame, sides: Sequence[dict[str, Column]]) -> DataFrame:
    """A row for each side of a two-sided row: sides give the output columns' expressions."""
    rows = F.array(*(F.struct(*(e.alias(c) for c, e in side.items())) for side in sides))
    return df.select(F.explode(rows).alias("__side")).select("__side.*")


def pairs_in_blocks(df: DataFrame, block: list[str], key: str, near: Column) -> DataFrame:
    """(a, b) pairs of keys, a < b, of rows of one block for which `near`, on columns of a and b, holds."""
    return df.alias("a").join(df.alias("b"), [F.col(f"a.{c}") == F.col(f"b.{c}") for c in block] + [F.col(f"a.{key}") < F.col(f"b.{key}"), near])


def pairs_in_bands(df: DataFrame, block: list[str], key: str, value: str, width: float) -> DataFrame:
    """(a, b) pairs as of pairs_in_blocks whose values are less than width apart. Rows meet by bands of the value, each
    with its own and the next ones, so a block is dealt out and what is compared grows as the pairs that there are."""
    band = F.floor(F.col(value) / (width * (1 + 1e-9)))
    spark = df.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)  # pairs outgrow rows, so bytes don't tell how many
    left = df.withColumn("__band", band).repartition(parts, *block, "__band")
    right = df.withColumn("__band", F.explode(F.array(band - 1, band, band + 1))).repartition(parts, *block, "__band").hint("merge")
    near = F.abs(F.col(f"a.{value}") - F.col(f"b.{value}")) < width
    return left.alias("a").join(right.alias("b"), [F.col(f"a.{c}") == F.col(f"b.{c}") for c in (*block, "__band")] + [F.col(f"a.{key}") < F.col(f"b.{key}"), near])


def unique_or_null(df: DataFrame, key: list[str], value: str, out: str) -> DataFrame:
    """The key's value, or null where more than one claims it."""
    return df.groupBy(*key).agg(F.when(F.min(value) == F.max(value), F.max(value)).alias(out))


def mode_first(df: DataFrame, keys: list[str], value: str, tie: Column, out: str) -> DataFrame:
    """The most frequent value; of equally frequent ones that with the least tie-break."""
    counts = df.groupBy(*keys, value).agg(F.count("*").alias("__n"), F.min(tie).alias("__tie"))
    return counts.groupBy(*keys).agg(F.min_by(value, F.struct(-F.col("__n"), F.col("__tie"))).alias(out))


def nearest_bucket(df: DataFrame, buckets: DataFrame, keys: list[str], at: str, bucket: str, out: str) -> DataFrame:
    """The bucket closest to each row's value, of those the keys have; the lower of two as close, and the
    lowest for a null value. The keys' buckets come along as one sorted list, in which each row looks its own up: rows are joined by key, not
    sorted into one partition a key. A row whose keys have no bucket gets null."""
    lists = buckets.where(F.col(bucket).isNotNull()).groupBy(*(F.col(k).alias(f"__k{i}") for i, k in enumerate(keys))).agg(F.sort_array(F.collect_set(bucket)).alias("__list"))
    met = df.join(lists, reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys))), "left")
    away = F.transform("__list", lambda b: F.struct(F.abs(b - F.col(at)).alias("away"), b.alias("bucket")))
    return met.withColumn("__out", F.array_min(away)["bucket"]).select(*(c for c in df.columns if c != out), F.col("__out").alias(out))


def null_coverage(df: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """(by, field, n, known): how many rows there are, and how many know each column."""
    wide = df.groupBy(*by).agg(F.count("*").alias("n"), *(F.count(c).alias(c) for c in columns))
    return wide.unpivot([*by, "n"], columns, "field", "known")


def signature(df: DataFrame, by: list[str]) -> DataFrame:
    """One row: the SHA-256 of the ordered counts by group, in JSON. A group is a row, not a document's worth."""
    counts = df.groupBy(*by).agg(F.count("*").alias("n"))
    text = F.to_json(F.array_sort(F.collect_list(F.struct(*by, "n"))))
    return counts.agg(F.sha2(text, 256).alias("signature"))


def quantile_nearest(df: DataFrame, keys: list[str], value: str, qs: dict[str, float]) -> DataFrame:
    """Values at index round(q * (n - 1)) of the sorted values, by a rank and no collected list."""
    w = Window.partitionBy(*keys)
    placed = df.where(F.col(value).isNotNull()).withColumn("__i", F.row_number().over(w.orderBy(value)) - 1).withColumn("__n", F.count(F.lit(1)).over(w))
    at = lambda q: F.floor(F.lit(q) * (F.col("__n") - 1) + 0.5)
    return placed.groupBy(*keys).agg(*(F.max(F.when(F.col("__i") == at(q), F.col(value))).alias(name) for name, q in qs.items()))


def quantile_floor(df: DataFrame, keys: list[str], value: str, us: dict[str, float]) -> DataFrame:
    """Values at index floor(u * n) of the sorted values, the last for u = 1."""
    w = Window.partitionBy(*keys)
    placed = df.where(F.col(value).isNotNull()).withColumn("__i", F.row_number().over(w.orderBy(value)) - 1).withColumn("__n", F.count(F.lit(1)).over(w))
    at = lambda u: F.least(F.col("__n") - 1, F.floor(F.lit(u) * F.col("__n")))
    return placed.groupBy(*keys).agg(*(F.max(F.when(F.col("__i") == at(u), F.col(value))).alias(name) for name, u in us.items()))


# Identity


def resolve_by_fallback(df: DataFrame, routes: Sequence[tuple[str, DataFrame, list[str]]], target: str) -> DataFrame:
    """df with target and `by`: the first route (name, dimension of keys and target, keys) that knows the row.
    Dimensions have a row a key; Spark broadcasts those it knows to be small."""
    found, names = [], []
    for i, (name, dimension, keys) in enumerate(routes):
        own = dimension.select(*(F.col(k).alias(f"__k{i}_{j}") for j, k in enumerate(keys)), F.col(target).alias(f"__t{i}"))
        df = df.join(own, [F.col(k) == F.col(f"__k{i}_{j}") for j, k in enumerate(keys)], "left").drop(*(f"__k{i}_{j}" for j in range(len(keys))))
        found.append(F.col(f"__t{i}"))
        names.append(F.when(F.col(f"__t{i}").isNotNull(), name))
    return df.withColumn(target, F.coalesce(*found)).withColumn("by", F.coalesce(*names)).drop(*(f"__t{i}" for i in range(len(routes))))


def disputed(df: DataFrame, key: list[str], owner: str) -> DataFrame:
    """Keys that more than one owner claims."""
    return df.groupBy(*key).agg(F.count_distinct(owner).alias("owners")).where("owners > 1")


def collapse_crosswalk(base: DataFrame, collapsed: DataFrame, variants: DataFrame, key: str) -> DataFrame:
    """base without the collapsed keys, and the variants."""
    return base.join(collapsed.select(key), key, "left_anti").unionByName(variants.select(*base.columns))


def expand_and_match(df: DataFrame, name: Column, variants: dict[str, list[str]], dimension: DataFrame, key: str, target: str) -> DataFrame:
    """Matches the first word of each name under its variants as well; null unless exactly one target is hit. The
    dimension comes as a row a key with its least and largest target, so names that many rows share multiply nothing."""
    table = F.create_map(*(x for k, v in variants.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    first, rest = F.split_part(name, F.lit(" "), F.lit(1)), F.substring_index(name, " ", -1)
    names = F.concat(F.array(first), F.coalesce(table[first], F.array().cast("array<string>")))
    tried = df.withColumn("__name", F.explode(F.transform(names, lambda n: F.concat_ws(" ", n, rest))))
    by_key = dimension.groupBy(F.col(key).alias("__name")).agg(F.min(target).alias("__least"), F.max(target).alias("__most"))
    hit = tried.join(by_key, "__name").groupBy(*df.columns)
    return hit.agg(F.when(F.min("__least") == F.max("__most"), F.max("__most")).alias(target))


def rekey_reasons(edges: DataFrame, old: DataFrame) -> DataFrame:
    """(old, new, reason) of edges(old, new) and all old keys: split, merged, unchanged, moved, or dropped."""
    e = edges.distinct()
    out = e.groupBy("old").agg(F.count("*").alias("__out"))
    into = e.groupBy("new").agg(F.count("*").alias("__in"))
    joined = old.select("old").distinct().join(e, "old", "left").join(out, "old", "left").join(into, "new", "left")
    reason = (
        F.when(F.col("new").isNull(), "dropped").when(F.col("__out") > 1, "split").when(F.col("__in") > 1, "merged").when(F.col("old") == F.col("new"), "unchanged").otherwise("moved")
    )
    return joined.select("old", "new", reason.alias("reason"))


def resolve_or_mint(df: DataFrame, known: DataFrame, keys: Sequence[str], target: str) -> DataFrame:
    """df with target: the known one of the first key that is known, else a key minted from the row's first
    non-null key by a 63-bit hash, negative, so that it depends on the row alone and not on its order; null for a row
    without a key."""
    for i, k in enumerate(keys):
        own = unique_or_null(known.where(F.col(k).isNotNull()), [k], target, f"__t{i}")
        df = df.join(own, k, "left")
    natural = F.coalesce(*(F.concat(F.lit(f"{k}="), F.col(k).cast("string")) for k in keys))
    minted = F.when(natural.isNotNull(), -F.shiftrightunsigned(F.xxhash64(natural), 1))
    found = F.coalesce(*(F.col(f"__t{i}") for i in range(len(keys))), minted)
    return df.withColumn(target, found).drop(*(f"__t{i}" for i in range(len(keys))))


def pick_among(df: DataFrame, candidates: DataFrame, keys: list[str], scores: list[Column], target: str) -> DataFrame:
    """Of the candidates that share the keys, the one that meets the first conditions; null if two meet as many. One
    aggregate keeps a row's best score with its least and largest target, so candidates are neither sorted nor kept."""
    met = df.join(candidates, keys, "left").withColumn("__score", F.struct(*(F.coalesce(s, F.lit(False)).alias(f"s{i}") for i, s in enumerate(scores))))
    each = met.groupBy(*df.columns, "__score").agg(F.min(target).alias("__least"), F.max(target).alias("__most"))
    best = each.groupBy(*df.columns).agg(F.max_by(F.struct("__least", "__most"), "__score").alias("__best"))
    return best.select(*df.columns, F.when(F.col("__best.__least") == F.col("__best.__most"), F.col("__best.__most")).alias(target))
