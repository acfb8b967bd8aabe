"""What the operators of this package share: reading tables, a shared work folder, text as bytes."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Maps each byte of lower-cased UTF-8 that is no letter, digit or part of a longer character to a space.
WORD_BYTES = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A folder of the application's that driver and executors share: under spark.checkpoint.dir, else (in tests, on
    one machine) under the warehouse. A cluster without that setting is an error, as its warehouse may be a local
    folder. The folder may go once the application's results have been used."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_work"
        if not spark.sparkContext.getCheckpointDir():
            spark.sparkContext.setCheckpointDir(where)
    return f"{where.rstrip('/')}/{spark.sparkContext.applicationId}"


def written(df: DataFrame, tag: str) -> DataFrame:
    """df, written as Parquet to the shared folder and read back: its lineage ends there and it is computed once."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, name: str) -> str:
    """The name, or one that the table doesn't have yet: mix_ before it, as often as needed."""
    while name in df.columns:
        name = f"mix_{name}"
    return name


def text_bytes(column: str | Column = "text") -> Column:
    """The column as UTF-8 bytes; null counts as empty."""
    column = F.col(column) if isinstance(column, str) else column
    return F.coalesce(column.cast("string").cast("binary"), F.lit(b""))


def text_key(column: str | Column = "text") -> Column:
    """A long that tells rows which share a doc_id, or have none, apart by their text."""
    return F.xxhash64(text_bytes(column))


def words(text: bytes) -> list[bytes]:
    """Words of A-Z-lower-cased text: runs of ASCII letters, digits and non-ASCII characters."""
    return text.lower().translate(WORD_BYTES).split()
