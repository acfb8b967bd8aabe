"""Readers: Parquet tables, and CSV, JSON, XML and HTML landed as files. Nothing is fetched here."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


CSV = {"quote": '"', "escape": '"', "mode": "PERMISSIVE"}


def read_csv(spark: SparkSession, path: str, columns: list[str], header: bool = True) -> DataFrame:
    """Delimited text with quoted fields, doubled quotes and line ends within quotes. Every column is a string; one
    that is absent from a short row is the empty string. gzip files are read as they are, one task each."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    return spark.read.options(**CSV, header=header, multiLine=True, enforceSchema=True).schema(schema).csv(path).fillna("")


def csv_fields(line: Column, columns: list[str]) -> Column:
    """The fields of a line of delimited text, as a struct of strings; what is absent is the empty string."""
    row = F.from_csv(line, ", ".join(f"`{c}` string" for c in columns), CSV)
    return F.struct(*(F.coalesce(row[c], F.lit("")).alias(c) for c in columns))


def typed(df: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """String columns as kinds; empty, NA and what can't be read are null."""
    clean = {c: F.nullif(F.nullif(F.trim(F.col(c)), F.lit("")), F.lit("NA")).try_cast(kind) for c, kind in kinds.items()}
    return df.withColumns(clean)


def optional(df: DataFrame, column: str, kind: str) -> Column:
    """The column, or null of that type where the table has none."""
    return F.col(column).cast(kind) if column in df.columns else F.lit(None).cast(kind)


def first_present(df: DataFrame, names: list[str]) -> Column:
    """The first of the columns that is there and not empty."""
    return F.coalesce(*(F.nullif(F.col(c), F.lit("")) for c in names if c in df.columns), F.lit(""))


def read_periods(spark: SparkSession, root: str, periods: list[int], columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """The rows of a CSV feed that is partitioned as root/period=n, and (period, status, n): loaded, empty (a header
    and no row) or absent. A missing period is a row of the second table, not an error.

    One read of all partitions, pruned to the periods; the files that there are come from a listing whose
    contents aren't read.
    """
    schema = T.StructType([*(T.StructField(c, T.StringType()) for c in columns), T.StructField("period", T.IntegerType())])
    found = spark.read.options(**CSV, header=True, multiLine=True, enforceSchema=True).schema(schema).csv(root)
    found = found.fillna("", subset=columns).where(F.col("period").isin(*periods))
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    there = files.select(F.regexp_extract("path", r"/period=(-?\d+)/", 1).try_cast("int").alias("period")).where("period is not null").distinct()
    wanted = spark.createDataFrame([(p,) for p in periods], "period int")
    counted = found.groupBy("period").agg(F.count("*").alias("n"))
    states = wanted.join(there.withColumn("there", F.lit(True)), "period", "left").join(counted, "period", "left")
    n = F.coalesce("n", F.lit(0))
    status = F.when(n > 0, "loaded").when(F.col("there"), "empty").otherwise("absent")
    return found, states.select("period", status.alias("status"), n.cast("long").alias("n"))


def rss_items(df: DataFrame, xml: str, key: str) -> DataFrame:
    """(key, title, link, published) of each item of RSS text; CDATA marks and entities are resolved."""
    from ..functions.text import decode_entities

    item = F.explode(F.regexp_extract_all(F.col(xml), F.lit(r"(?is)<item\b[^>]*>(.*?)</item>"), F.lit(1)))
    inside = lambda tag: decode_entities(F.regexp_replace(F.regexp_extract("item", rf"(?is)<{tag}\b[^>]*>(?:<!\[CDATA\[)?(.*?)(?:\]\]>)?</{tag}>", 1), r"\s+", " "))
    found = df.select(key, item.alias("item"))
    return found.select(key, F.trim(inside("title")).alias("title"), F.trim(inside("link")).alias("link"), F.trim(inside("pubDate")).alias("published"))


def html_fields(df: DataFrame, html: str, key: str) -> DataFrame:
    """(key, title, heading, n_links): what a page's markup states, by expressions on the raw text."""
    return df.select(
        key,
        F.regexp_extract(html, r"<title>([^<]*)</title>", 1).alias("title"),
        F.regexp_extract(html, r"<h1>([^<]*)</h1>", 1).alias("heading"),
        F.size(F.regexp_extract_all(F.col(html), F.lit(r'<a href="([^"]*)"'), F.lit(1))).cast("long").alias("n_links"),
    )


def import_rows(target: DataFrame, incoming: DataFrame, bridge: DataFrame, key: str, fresh: bool = False, clash: str = "target") -> DataFrame:
    """incoming with its keys moved over bridge(old, new) and added to target, or instead of it if fresh;
    rows whose key the bridge lacks are left out. Of rows that come to one key target's win; with clash "both" all stay."""
    moved = incoming.join(bridge, incoming[key] == bridge["old"]).withColumn(key, F.col("new")).select(*target.columns)
    if clash == "both" and not fresh:
        return target.unionByName(moved)
    return moved if fresh else target.unionByName(moved.join(target.select(key), key, "left_anti"))
