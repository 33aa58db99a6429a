"""A corpus from raw documents to tokens, in five stages that each read what the one before wrote."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordlab.llm import jaccard, lines, mixing, pieces, toxicity
from recordlab.llm._space import Workspace, scratch

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labels that are not held out, does not reject.

    Null and empty texts stay; repeated rows stay or go alike; other columns than COLUMNS are dropped, as in every
    stage; an empty table stays empty, as in every stage.
    """
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.remove_toxic(docs.select(*COLUMNS), model)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents less the lines found in ten documents or more; n_chars follows the text.

    Emptied documents stay; a null text becomes an empty one; repeated rows count each, and so do rows without an id.
    """
    return lines.dedup_lines(docs.select(*COLUMNS)).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents, the one with the smallest doc_id; of rows equal in doc_id and text, one.

    Rows are told apart by doc_id and text, so an id that other rows share takes none of them along.  Rows without a
    doc_id come last in their group; rows without words stay, but for such repeats.
    """
    return jaccard.one_of_each_group(docs.select(*COLUMNS))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents, each not at all, once or twice, so that each source has about as many words as the mix takes.

    Documents without words go; rows that share a doc_id, or have none, are told apart by their source and text.
    """
    return mixing.mix_documents(docs.select(*COLUMNS))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each row; a null or empty text has no tokens."""
    return pieces.encode(docs.select("doc_id", "text"), public_tokenizers.path("piece_bpe_32k.model"), digest=True).drop("text")


STAGES = [
    ("toxicity", remove_toxic),
    ("line_dedup", dedup_lines),
    ("near_copies", drop_near_copies),
    ("mixing", mix),
    ("sentencepiece", tokenize),
]

#: The classifier's verdicts and the encoding can't be expressed in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again; what a stage no longer needs is dropped."""
    space = Workspace(spark, "pipeline")
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS), ""
    for name, stage in STAGES:
        with scratch():
            docs = space.put(stage(spark, docs, sf_dir), name)
        if last:
            space.drop(last)
        last = name
    return docs
