"""Where intermediate tables go: a folder that the driver and all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: Rows that `dealt` gives a task, on the average.
TASK_ROWS = 1 << 18


def work_folder(spark: SparkSession, tag: str) -> str:
    """A new folder under spark.checkpoint.dir, in one of the application's; where that is unset, on one machine only,
    under the warehouse. The application's folder may go once its results have been used."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_work"
    return f"{where.rstrip('/')}/{spark.sparkContext.applicationId}/{tag}-{uuid.uuid4().hex}"


def settled(df: DataFrame, tag: str) -> DataFrame:
    """df, written and read back: its lineage ends there, and a lost executor costs no more than a read."""
    path = work_folder(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def parts_for(spark: SparkSession, rows: int) -> int:
    """How many partitions leave a task about TASK_ROWS of so many rows, or as many as the session shuffles to if these
    are more: memory of a task doesn't grow with the rows."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // TASK_ROWS))


def dealt(df: DataFrame, parts: int, *keys: str) -> DataFrame:
    """df, dealt out by keys to so many partitions; as it is if a shuffle would make as many by itself."""
    return df.repartition(parts, *keys) if parts > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df
