"""Sampling of streams: a row's roll depends on its fields alone, so the same rows pass on a stream as in a batch."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..functions.hashing import Algorithm, ByteEncoding, roll


def sample_stream(stream: DataFrame, fraction: float, fields: list[str], algorithm: str | Algorithm = Algorithm.FARM, seed: int | None = None, encoding: str | ByteEncoding = ByteEncoding.RAW) -> DataFrame:
    """Keeps the rows of a streaming (or batch) DataFrame whose roll is below ``fraction``; holds no state."""
    if not 0 < fraction <= 1:
        raise ValueError("the fraction must be above 0 and at most 1")
    return stream.where(roll(stream, fields, algorithm, seed, encoding) < fraction)
