"""The corpus pipeline: its stages, one after the other, each written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from aeonframe.llm.decontamination import without_contaminated
from aeonframe.llm.jaccard_join import one_of_each
from aeonframe.llm.mixing import mixed
from aeonframe.llm.pii import redacted
from aeonframe.llm.quality import without_bad
from aeonframe.llm.storage import persisted


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects (score under 0.7) go."""
    return without_bad(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the one with the least doc_id."""
    return one_of_each(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold an item of benchmark, with edits within the budget, go."""
    return without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def without_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data gives way to the name of its kind; all documents stay."""
    return redacted(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes, with the number of copies and the words they make."""
    return mixed(docs).filter("copies > 0")


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontaminated),
    ("PII", without_pii),
    ("mixing sources", source_mix),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = persisted(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return docs


#: Hashes of shingles and trained models are not for SQL; the tests hold each stage against its operator, run() against the stages.
ORACLE_SQL = None
