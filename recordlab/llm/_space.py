"""Shared scratch tables: the only place where operators of this subpackage cut lineage."""

from __future__ import annotations

import atexit
import contextlib
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recordlab.session import shared_dir, ship


_owners: list[list[Workspace]] = []


@contextlib.contextmanager
def scratch() -> Iterator[None]:
    """Drops, at its end, the tables that operators called within have written; what is wanted of them is written before."""
    _owners.append([])
    try:
        yield
    finally:
        for space in _owners.pop():
            space.drop()


class Workspace:
    """Tables of one operator call, in a folder of its own below :func:`shared_dir`.

    Results are lazy and may read them, so they last until the :func:`scratch` block around the call ends, else until
    the program does.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = ship(spark), f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        if _owners:
            _owners[-1].append(self)
        else:
            atexit.register(self.drop)

    def put(self, df: DataFrame, name: str, few: bool = False) -> DataFrame:
        """Writes ``df`` as Parquet and reads it back, so that a lost executor costs no more than one stage.

        With ``few`` an eighth of the files are written: for tables that are small beside the documents.
        """
        path = f"{self.root}/{name}"
        df = df.coalesce(max(1, partitions(self.spark) // 8)) if few else df
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str = "") -> None:
        try:
            jvm, hadoop = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)
            path.getFileSystem(hadoop).delete(path, True)
        except Exception:  # noqa: BLE001  the session may have ended before; what is left is scratch
            pass


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def row_key(*columns: str | Column) -> Column:
    """A name for the values of some columns, never null, so that it can be joined and partitioned by as it is."""
    return F.md5(F.to_json(F.struct(*[(F.col(c) if isinstance(c, str) else c).alias(f"c{i}") for i, c in enumerate(columns)])))
