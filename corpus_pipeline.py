"""The corpus pipeline: quality, near duplicates, benchmark leaks, source mixture and shards, in this order."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.llm import quality
from tidemark.llm._common import discard, written
from tidemark.llm.decontamination import decontaminate
from tidemark.llm.mixing import mix
from tidemark.llm.ngram_join import similar_documents
from tidemark.llm.sharding import shard

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _apart(docs: DataFrame, read: str) -> tuple[DataFrame, dict[str, str]]:
    """docs with all columns but those that a stage reads under reserved names, and the way back: an operator's own columns meet none of them."""
    others = {c: f"_kept_{i}_" for i, c in enumerate(docs.columns) if c not in read.split()}
    return docs.withColumnsRenamed(others), {held: c for c, held in others.items()}


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier trained on the folder's labels does not reject (score of 0.3 and up).

    Null and empty texts get a score as any other, repeated rows stand or fall together, an empty table stays empty; extra columns stay.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    model = quality.fit(docs, labels)
    held, back = _apart(docs, "doc_id text")
    return quality.score(held, model, threshold=0.3).where("predicted = 1").select(*held.columns).withColumnsRenamed(back)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least doc_id of each component of 5-word shingle similarity 0.75 and up; rows without a doc_id stay."""
    later = similar_documents(docs, k=5, percent=75).where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(later.hint("merge"), "doc_id", "left_anti").select(*docs.columns)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the folder's benchmark."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at temperature weights of nearly full entropy, each read four times at most; a row for each copy.

    A null source is a source of its own, texts without words are never read, repeated rows are rows of their own; an empty table stays empty. Extra columns stay.
    """
    held, back = _apart(docs, "doc_id text source")
    mixed = mix(held, budget_share=1.0, entropy_share=0.98, max_repeat=4.0)
    return mixed.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*held.columns).withColumnsRenamed(back)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row with its shard of eight and its slot there."""
    return shard(docs, shards=8)


STAGES: list[tuple[str, Stage]] = [
    ("quality", quality_filter),
    ("near_duplicates", near_duplicates),
    ("decontamination", benchmark_leaks),
    ("mixture", mixture),
    ("shards", shards),
]

#: A trained classifier is not SQL; the stages are tested against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the folder's documents, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
