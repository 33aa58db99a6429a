"""Small samples of exact size: the head of the files, or a uniform reservoir."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def head(df: DataFrame, n: int, order: list | None = None) -> DataFrame:
    """The first ``n`` rows by ``order``; without one, in the order of the file names."""
    if n <= 0:
        raise ValueError("n must be positive")
    return df.orderBy(*order).limit(n) if order else df.limit(n)


def head_of_files(df: DataFrame, n: int) -> DataFrame:
    """The first ``n`` rows of the files a DataFrame reads, files in order of name, rows in order within a file."""
    if n <= 0:
        raise ValueError("n must be positive")
    placed = df.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    return placed.orderBy("_file", "_row").limit(n).drop("_file", "_row")


def reservoir(df: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """``n`` rows, all equally likely: each task keeps only its ``n`` smallest draws."""
    if n <= 0:
        raise ValueError("n must be positive")
    return df.withColumn("_draw", F.rand(seed)).orderBy("_draw").limit(n).drop("_draw")


def reservoir_by_bytes(df: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """A reservoir in which files count by size: each gets places in proportion to its bytes, rounded, ``n`` in all.

    Places are dealt by the sizes of the files, in one task; of a file's rows each task keeps only its ``n`` smallest draws.
    """
    if n <= 0:
        raise ValueError("n must be positive")
    from pyspark.sql.window import Window as W

    placed = df.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_size").alias("_bytes")).withColumn("_draw", F.rand(seed))
    files = placed.groupBy("_file").agg(F.max("_bytes").alias("b"))
    before = F.sum("b").over(W.orderBy("_file").rowsBetween(W.unboundedPreceding, W.currentRow))
    whole = F.sum("b").over(W.partitionBy(F.lit(0)))
    part = lambda x: F.floor(x * n / whole + 0.5)
    places = files.withColumn("_places", part(before) - part(before - F.col("b"))).select("_file", "_places")
    ranked = placed.join(places, "_file").withColumn("_rank", F.row_number().over(W.partitionBy("_file").orderBy("_draw")))
    return ranked.where((F.col("_rank") <= n) & (F.col("_rank") <= F.col("_places"))).drop("_file", "_bytes", "_draw", "_places", "_rank")
