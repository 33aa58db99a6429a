"""The queries of this subpackage, one for each operator, over whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import html, jaccard, lines, mixing, pieces, quality, secrets, topk, toxicity, warc

PIECES = "piece_bpe_32k.model"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the decoded text of every document."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return pieces.encode(docs, public_tokenizers.path(PIECES), digest=True).drop("text")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines, dropped lines and a digest of the kept text of every document."""
    kept = lines.dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records of an archive of all pages, read back from it."""
    return warc.read_bundles(warc.write_bundles(_table(spark, sf_dir, "pages"))).drop("url", "payload")


def op4_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five highest inner products of every fiftieth vector among all others."""
    return topk.top_k(_table(spark, sf_dir, "embeddings"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents by a model of the labels that are not held out."""
    docs = _table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity.train(docs, _table(spark, sf_dir, "labels")))
    return scored.select("doc_id", toxicity.is_held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdicts of all documents."""
    return quality.quality(_table(spark, sf_dir, "documents")).select("doc_id", *quality.COUNTS, "base_failed", "kept")


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in all documents."""
    return secrets.scan(_table(spark, sf_dir, "documents"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words that a mix of all sources takes of every document."""
    return mixing.mix_sources(_table(spark, sf_dir, "documents"))


def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return html.extract(_table(spark, sf_dir, "pages"))


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The group of near copies of every document."""
    return jaccard.near_duplicates(_table(spark, sf_dir, "documents"))


def quality_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of op6_quality that SQL can say: counts and base rule."""
    return quality.quality(_table(spark, sf_dir, "documents")).select("doc_id", *quality.COUNTS, "base_failed")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)} | {"quality_counts": quality_counts}


def oracle_sql() -> dict[str, str]:
    return {"op2_line_dedup": lines.ORACLE, "op3_warc": warc.ORACLE, "op4_exact_topk": topk.ORACLE, "op7_secrets": secrets.ORACLE, "op8_mixing": mixing.ORACLE, "op10_ngram_jaccard": jaccard.ORACLE, "quality_counts": quality.COUNTS_ORACLE}
