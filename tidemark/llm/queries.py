"""The queries of this subpackage and, where SQL can express them, their oracles."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

import corpus_pipeline
from tidemark.llm import quality, toxicity
from tidemark.llm._common import fold, run_dir
from tidemark.llm.brown_lm import brown_scores
from tidemark.llm.decontamination import contaminated
from tidemark.llm.fill_middle import fill_middle, restored
from tidemark.llm.line_dedup import dedup_lines
from tidemark.llm.mixing import mix
from tidemark.llm.ngram_join import similar_documents
from tidemark.llm.resampling import resample
from tidemark.llm.sharding import shard
from tidemark.llm.topk import top_k
from tidemark.llm.warc import read_warc, write_warc
from tidemark.llm.window_dedup import dedup_windows

Query = Callable[[SparkSession, str], DataFrame]


def _load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _load(spark, sf_dir, "documents").select("doc_id", "text")
    found = contaminated(docs, _load(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", F.round("lcs_share", 6).alias("lcs_share"), F.round("answer_share", 6).alias("answer_share"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _load(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _load(spark, sf_dir, "documents").select("doc_id", "text")
    labels = _load(spark, sf_dir, "labels").where(fold("doc_id", 5) != 0).select("doc_id", "quality")
    scored = quality.score(docs, quality.fit(docs, labels), threshold=0.3)
    return scored.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", "predicted")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _load(spark, sf_dir, "documents").select("doc_id", "text")
    labels = _load(spark, sf_dir, "labels").where(fold("doc_id", 5) != 0).select("doc_id", "toxic")
    scored = toxicity.score(docs, toxicity.fit(docs.where(fold("doc_id", 5) != 0), labels), threshold=0.5)
    return scored.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", "predicted")


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_documents(_load(spark, sf_dir, "documents").select("doc_id", "text"), k=5, percent=75)


def op6_brown_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _load(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = fold("doc_id", 7) == 2
    return brown_scores(docs, learn=~held_out).select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op7_temperature_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _load(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix(docs, budget_share=1.0, entropy_share=0.98, max_repeat=4.0).select("doc_id", "source", "n_tokens", "weight", "copies", "block")


def op8_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _load(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return top_k(vectors, vectors.where("vec_id % 100 = 0"), k=10)


def op9_window_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _load(spark, sf_dir, "documents").select("doc_id", "text")
    cut = dedup_windows(docs, length=100, with_text=False)
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.col("kept").cast("string").alias("kept_sha256"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _load(spark, sf_dir, "documents").select("doc_id", "text")
    crc = F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32")
    return shard(docs.select("*", crc), shards=8).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op11_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_middle(_load(spark, sf_dir, "documents"), seed=1, rate=90, swapped=20)
    digest = lambda c: F.sha2(c, 256)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = resample(_load(spark, sf_dir, "documents"), _load(spark, sf_dir, "benchmark"), n=1, modulus=10000, share=(10, 100), least_words=20, seed=2024)
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{run_dir(spark)}/archives-{uuid.uuid4().hex}"
    write_warc(_load(spark, sf_dir, "pages"), path, min_bytes=0)
    found = read_warc(spark, path, with_payload=False).where("record_type IS NULL OR record_type <> 'warcinfo'")
    page = lambda c: F.regexp_extract(c, "^<urn:page:([^:]*):", 1).try_cast("long")
    kind = F.when(F.col("status").isin("whole", "revisit"), F.col("record_type")).otherwise(F.raise_error(F.concat_ws(" ", F.lit("archive record"), "record_id", "status")))
    return found.select(
        page("record_id").alias("page_id"), "payload_bytes", F.substring_index("payload_digest", ":", -1).alias("payload_digest"), kind.alias("record_type"), page("refers_to").alias("refers_to"),
    )


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Query] = {
    "op1_decontamination": op1_decontamination,
    "op2_line_dedup": op2_line_dedup,
    "op3_quality": op3_quality,
    "op5_toxicity": op5_toxicity,
    "op4_ngram_join": op4_ngram_join,
    "op6_brown_lm": op6_brown_lm,
    "op7_temperature_mixing": op7_temperature_mixing,
    "op8_exact_topk": op8_exact_topk,
    "op9_window_dedup": op9_window_dedup,
    "op10_sharding": op10_sharding,
    "op11_fill_middle": op11_fill_middle,
    "op12_resampling": op12_resampling,
    "op13_warc": op13_warc,
    "pipeline": pipeline,
}
