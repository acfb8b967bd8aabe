"""Write semantics over Parquet: upserts, write-once logs, slices, audits. Each gives the table as it is after
the write; where a path is given, the write is to it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def anti_by(df: DataFrame, other: DataFrame, key: list[str]) -> DataFrame:
    """The rows of df whose key other lacks; a null in a key equals a null."""
    there = other.select(*(F.col(k).alias(f"__k{i}") for i, k in enumerate(key)))
    return df.join(there, reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(key))), "left_anti")


def latest(df: DataFrame, key: list[str], order: str | None = None) -> DataFrame:
    """One row for each key, null a key as any: that with the largest order, then the largest other columns."""
    return _one(df, key, order, F.desc)


def first_of(df: DataFrame, key: list[str], order: str | None = None) -> DataFrame:
    """As latest, with the smallest."""
    return _one(df, key, order, F.asc)


def _one(df: DataFrame, key: list[str], order: str | None, way) -> DataFrame:
    by = [way(c) for c in ([order] if order else []) + [c for c in df.columns if c not in key and c != order]]
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(*(by or [way(key[0])])))
    return df.withColumn("__rank", rank).where("__rank = 1").drop("__rank")


def upsert(old: DataFrame, new: DataFrame, key: list[str], order: str | None = None) -> DataFrame:
    """old with new's rows in place of those with their key; of new rows with one key, the latest stays."""
    new = latest(new, key, order)
    return anti_by(old, new, key).unionByName(new.select(*old.columns))


def upsert_known(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """As upsert, but a null of the new row leaves the old value; of new rows with one key, the latest counts."""
    values = [c for c in old.columns if c not in key]
    own = old.withColumn("__old", F.lit(True))
    other = latest(new, key).select(*(F.col(k).alias(f"__k{i}") for i, k in enumerate(key)), *(F.col(c).alias(f"__v{i}") for i, c in enumerate(values)))
    met = own.join(other, reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(key))), "full")
    keys = (F.when(F.col("__old"), F.col(k)).otherwise(F.col(f"__k{i}")).alias(k) for i, k in enumerate(key))
    return met.select(*keys, *(F.coalesce(f"__v{i}", c).alias(c) for i, c in enumerate(values))).select(*old.columns)


def insert_new(old: DataFrame, new: DataFrame, key: list[str], order: str | None = None) -> DataFrame:
    """First writer wins: old, and of new's rows whose key it lacks the first of each key."""
    return old.unionByName(first_of(anti_by(new, old, key), key, order).select(*old.columns))


def replace_slice(old: DataFrame, new: DataFrame, slice_of: Column) -> DataFrame:
    """old without the rows in the slice, and new."""
    return old.where(~F.coalesce(slice_of, F.lit(False))).unionByName(new.select(*old.columns))


def overwrite_partitions(df: DataFrame, path: str, by: list[str]) -> None:
    """Replaces those partitions of the table at path that df has rows of, and no other."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def snapshot_replace(old: DataFrame, new: DataFrame, key: list[str], slice_of: Column) -> DataFrame:
    """old with the slice holding new's rows only, the latest of each key, and removed: 1 for those of the slice whose key
    new lacks. Null is a key as any."""
    inside = F.coalesce(slice_of, F.lit(False))
    new = latest(new, key)
    gone = anti_by(old.where(inside), new, key).withColumn("removed", F.lit(1))
    kept = old.where(~inside).unionByName(new.select(*old.columns)).withColumn("removed", F.lit(0))
    return kept.unionByName(gone)


def accumulate_seen(old: DataFrame, new: DataFrame, key: list[str], at: str, before: Column | None = None) -> DataFrame:
    """(key, first_seen, last_seen, times_seen) of old, which has them, and the rows of new seen at a time; keys
    last seen before a time are pruned."""
    fresh = new.groupBy(*key).agg(F.min(at).alias("first_seen"), F.max(at).alias("last_seen"), F.count("*").alias("times_seen"))
    both = old.select(*key, "first_seen", "last_seen", "times_seen").unionByName(fresh)
    out = both.groupBy(*key).agg(F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.sum("times_seen").alias("times_seen"))
    return out if before is None else out.where(F.col("last_seen") >= before)


class RefusedWrite(ValueError):
    """A write that would replace data by too little."""


def refuse_empty(new: DataFrame) -> DataFrame:
    if new.isEmpty():
        raise RefusedWrite("nothing was pulled; the table is left as it is")
    return new


def replace_table(new: DataFrame, path: str) -> DataFrame:
    """The table at path after new has taken its place, read back; RefusedWrite, and the table as it was, if new has
    no rows."""
    refuse_empty(new).write.mode("overwrite").parquet(path)
    return new.sparkSession.read.parquet(path)


def audit(df: DataFrame, by: list[str], last_good: DataFrame, floor: float = 0.5) -> DataFrame:
    """(by, n, last_good, verdict) of the slices of a table as read back after a write: ok, empty if it has no rows, or
    collapsed if n is under floor times the last_good(by, last_good) count. Slices of either side are audited."""
    found = df.groupBy(*by).agg(F.count("*").alias("n")).join(last_good.select(*by, "last_good"), by, "full")
    n = F.coalesce("n", F.lit(0))
    verdict = F.when(n == 0, "empty").when(n < F.coalesce("last_good", F.lit(0)) * floor, "collapsed").otherwise("ok")
    return found.select(*by, n.cast("long").alias("n"), F.col("last_good").cast("long").alias("last_good"), verdict.alias("verdict"))


def export_columns(df: DataFrame, allowed: list[str], private: list[str]) -> DataFrame:
    """The allowed columns that are there. A private column among the allowed ones, or one of the table that is in
    neither list, is refused."""
    unknown = [c for c in df.columns if c not in allowed and c not in private]
    clash = sorted(set(allowed) & set(private))
    if unknown or clash:
        raise RefusedWrite(f"columns that may not be exported: {', '.join(unknown + clash)}")
    return df.select(*(c for c in allowed if c in df.columns))


def save_csv(df: DataFrame, path: str) -> None:
    """CSV with a header; quotes are doubled and every text is quoted, so that commas and line ends are kept."""
    df.write.mode("overwrite").options(header=True, quote='"', escape='"', quoteAll=True, emptyValue="").csv(path)


def copy_to_catalog(df: DataFrame, database: str, name: str) -> DataFrame:
    """df as a table of another database, which is made if it isn't there."""
    spark: SparkSession = df.sparkSession
    spark.sql(f"CREATE DATABASE IF NOT EXISTS `{database}`")
    df.write.mode("overwrite").saveAsTable(f"`{database}`.`{name}`")
    return spark.table(f"`{database}`.`{name}`")
