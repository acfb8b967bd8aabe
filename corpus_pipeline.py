"""The corpus pipeline: quality, near-duplicates, repeated passages, benchmark leaks, then the mixture.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as
the next one's docs. All but the last return the columns of documents; other columns that docs has, whatever
their names, go along. An empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from panelwright.llm import chunks, decontaminate, mixing, quality, simhash
from panelwright.llm.shared import table, written


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text scores 0.7 or more; the classifier learns from the labels of documents that aren't held out.
    Null and empty texts are scored as empty; rows without an id and repeated rows are scored each."""
    return quality.keep_good(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies, found by SimHash blocks and by MinHash bands and settled by their shingles: that with the smallest doc_id, then the smallest key of its text. Rows
    without an id come last; rows that share one and differ in text are told apart by it."""
    return simhash.keep_one_of_each(docs, **simhash.FIVE_WORDS)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without the passages that stand in an earlier document or before in their own text; a row that loses
    all its words goes. Null and empty texts and rows without an id stay."""
    return chunks.cut_repeats(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text holds no item of the benchmark, whatever their id. Null and empty texts stay."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture: rows with their domain, epoch and tokens, as often as the budget of their leaf takes them. Null
    languages and sources are a leaf of their own; columns of these names stay, and ours are called mix_ then."""
    return mixing.mix_by_source(docs)


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("substrings", substring_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
]

#: SQL has no fitted classifier, gear hash or SimHash; the stages are tested against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
