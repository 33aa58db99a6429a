"""Reading and writing: Parquet, JSON lines, Avro, tables and delimited statistics."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.schema import compatible, strip_quotes

_SUFFIX = {".parquet": "parquet", ".avro": "avro", ".json": "json", ".jsonl": "json", ".ndjson": "json", ".csv": "csv", ".tsv": "csv"}


#: Formats that are part of Spark but known to it by a short name only with a package: the class works without.
_CLASS = {"avro": "org.apache.spark.sql.avro.AvroFileFormat"}


def kind_of(path: str) -> str:
    """Format of an input: by suffix (a glob's too), else a table name; anything else is an error."""
    name = path.rstrip("/").rsplit("/", 1)[-1].lower()
    for suffix, kind in _SUFFIX.items():
        if name.endswith(suffix):
            return kind
    if "/" not in path and re.sub(r"[_.`:$-]", "", name).isalnum():
        return "table"
    raise ValueError(f"cannot tell the format of {path!r}: use .parquet, .avro, .json, .csv or a table name")


def read(spark: SparkSession, path: str, schema: T.StructType | None = None, kind: str | None = None, where: str | None = None) -> DataFrame:
    """A DataFrame over files or a table.  ``where`` reaches the scan."""
    kind = kind or kind_of(path)
    if kind == "table":
        df = spark.table(table_name(path))
    else:
        reader = spark.read.format(_CLASS.get(kind, kind))
        if kind == "csv":
            reader = reader.option("header", True).option("sep", "\t" if path.rstrip("/").endswith(".tsv") else ",")
        df = (reader.schema(schema) if schema is not None else reader).load(path)
    return df.where(strip_quotes(where)) if where else df


def schema_of(spark: SparkSession, path: str) -> T.StructType:
    """Schema of files (a glob's too) or a table, without reading rows where the format stores it."""
    return read(spark, path).schema


def table_name(spec: str) -> str:
    """A table's name for the catalog from a specification: [catalog:]database.table, parts quoted where they need it.

    A trailing $decorator, which names a partition, is not part of the name.
    """
    found = re.fullmatch(r"(?:(?P<catalog>[^:`]+):)?(?P<rest>[^:$]+)(?:\$\w+)?", spec.strip())
    if found is None or "`" in spec and ":" in spec:
        raise ValueError(f"a table is written [catalog:]database.table, not {spec!r}")
    if found["catalog"] is None:
        return found["rest"]
    return ".".join(f"`{p}`" for p in (found["catalog"], *found["rest"].split(".")))


def read_pair(spark: SparkSession, left: str, right: str, where: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Two inputs; two Parquet or two Avro inputs are read with the one of their schemas that reads both."""
    kinds = kind_of(left), kind_of(right)
    if kinds[0] == kinds[1] and kinds[0] in ("parquet", "avro"):
        schema = compatible(schema_of(spark, left), schema_of(spark, right), one_way=kinds[0] == "avro")
        return read(spark, left, schema, where=where), read(spark, right, schema, where=where)
    return read(spark, left, where=where), read(spark, right, where=where)


def query(spark: SparkSession, text: str, into: str | None = None) -> DataFrame:
    """The rows of a SQL query; with ``into`` they are written to that table, which is new, and read from it."""
    if into is None:
        return spark.sql(text)
    spark.sql(text).write.mode("errorifexists").saveAsTable(table_name(into))
    return spark.table(table_name(into))


def write(df: DataFrame, path: str, kind: str | None = None, partition: str | None = None, by: str = "day") -> None:
    """Writes files or a table; what exists is never overwritten.

    ``partition`` names a time column by whose hour, day, month or year a table is partitioned.
    """
    kind = kind or kind_of(path)
    if partition:
        if by not in ("hour", "day", "month", "year"):
            raise ValueError("partition by hour, day, month or year")
        name = f"{partition}_{by}"
        df = df.withColumn(name, F.date_format(F.col(partition), {"hour": "yyyyMMddHH", "day": "yyyyMMdd", "month": "yyyyMM", "year": "yyyy"}[by]))
    writer = df.write.mode("errorifexists")
    if partition:
        writer = writer.partitionBy(name)
    if kind == "table":
        writer.saveAsTable(path)
    elif kind == "json":
        writer.option("ignoreNullFields", True).json(path)
    elif kind == "csv":
        writer.option("header", True).option("sep", "\t" if path.endswith(".tsv") else ",").csv(path)
    else:
        writer.format(_CLASS.get(kind, kind)).save(path)


def _fs(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    fs, where = _fs(spark, path)
    found = fs.globStatus(where)
    return found is not None and len(found) > 0


def list_files(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """(path, bytes) of the files that a path or glob names, folders one level deep, in order of name."""
    fs, where = _fs(spark, path)
    out = []
    for s in fs.globStatus(where) or []:
        for f in fs.listStatus(s.getPath()) if s.isDirectory() else [s]:
            if not f.isDirectory():
                out.append((f.getPath().toString(), f.getLen()))
    return sorted(out)


def is_done(spark: SparkSession, path: str) -> bool:
    """Whether a job that wrote to a folder finished."""
    return exists(spark, path.rstrip("/") + "/_SUCCESS")


def write_once(spark: SparkSession, df: DataFrame, path: str) -> DataFrame:
    """Writes unless a finished output is there, and reads it: a rerun costs nothing."""
    if not is_done(spark, path):
        kind = kind_of(path)
        df.write.mode("overwrite").format(_CLASS.get(kind, kind)).save(path)
    return read(spark, path)


def local_rows(df: DataFrame) -> Iterator[Row]:
    """The rows one by one on the driver, which holds a partition at a time and fetches the next meanwhile."""
    return df.toLocalIterator(prefetchPartitions=True)


def timestamp_text(column: Column) -> Column:
    """yyyy-MM-dd HH:mm:ss[.fraction] UTC, without trailing zeros of the fraction."""
    text = F.date_format(column, "yyyy-MM-dd HH:mm:ss.SSSSSS")
    return F.concat(F.regexp_replace(text, r"(\.0+|(?<=\.\d{1,6})0+)$", ""), F.lit(" UTC"))


def as_tsv(df: DataFrame) -> DataFrame:
    """One text column: the row's values joined by tabs, nested ones spread out, null as the text null."""
    from ..functions.deltas import render
    from ..plans.schema import flatten

    return df.select(F.concat_ws("\t", *[render(F.col(p), k) for p, k in flatten(df.schema)]).alias("value"))


def save_stats(result, output: str, mode: str = "text", header: bool = False) -> None:
    """Writes a comparison's key, field and global statistics.

    As text, to folders keys, fields and global below ``output``, tab-separated, with a header line in each file if
    asked; as tables, to names ending in _keys, _fields and _global.
    """
    parts = {"keys": result.key_stats, "fields": result.field_stats, "global": result.global_stats}
    for name, df in parts.items():
        if mode == "table":
            df.write.mode("errorifexists").saveAsTable(f"{output}_{name}")
            continue
        df = df.coalesce(1) if name == "global" else df
        place = f"{output.rstrip('/')}/{name}"
        if header:
            from ..functions.deltas import render
            from ..plans.schema import flatten

            flat = df.select(*[render(F.col(p), k).alias(p.split(".")[-1]) for p, k in flatten(df.schema)])
            flat.write.mode("errorifexists").option("sep", "\t").option("header", True).csv(place)
        else:
            as_tsv(df).write.mode("errorifexists").text(place)
