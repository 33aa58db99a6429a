"""Command line: diff, sample, take and generate."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession
from pyspark.sql import types as T

from .operators.diff import diff
from .operators.generate import generate
from .operators.sampling import Sample, sample
from .operators.take import head_of_files, reservoir
from .plans.schema import from_avro_json, from_table_json, keyed_fields
from .sources.io import as_tsv, kind_of, read, read_pair, save_stats, write, write_once


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="recordlab", description="Compare, sample, take from and generate datasets.")
    commands = top.add_subparsers(dest="command", required=True)
    d = commands.add_parser("diff", help="compare two datasets by key")
    d.add_argument("--lhs", required=True)
    d.add_argument("--rhs", required=True)
    d.add_argument("--output", required=True)
    d.add_argument("--key", action="append", required=True, help="path of a key part; repeatable")
    d.add_argument("--output-mode", choices=("text", "table"), default="text")
    d.add_argument("--where", "--row-restriction", dest="where", help="SQL predicate for both sides")
    d.add_argument("--ignore", action="append", default=[])
    d.add_argument("--unordered", action="append", default=[])
    d.add_argument("--unordered-field-key", dest="keyed", action="append", default=[], help="path:key of a keyed array")
    d.add_argument("--with-header", action="store_true")
    d.add_argument("--ignore-nan", action="store_true")
    s = commands.add_parser("sample", help="sample a dataset")
    s.add_argument("--input", required=True)
    s.add_argument("--output", required=True)
    s.add_argument("--fraction", "--sample", dest="fraction", type=float, required=True)
    s.add_argument("--fields", default="", help="comma-separated paths that decide a row's fate")
    s.add_argument("--seed", type=int)
    s.add_argument("--algorithm", choices=("farm", "murmur", "md5"), default="farm")
    s.add_argument("--distribution", choices=("stratified", "uniform"))
    s.add_argument("--distribution-fields", default="")
    s.add_argument("--exact", action="store_true")
    s.add_argument("--byte-encoding", choices=("raw", "hex", "base64"), default="raw")
    s.add_argument("--partition", help="time column to partition a table by")
    s.add_argument("--partition-by", choices=("hour", "day", "month", "year"), default="day")
    t = commands.add_parser("take", help="a few records")
    t.add_argument("--input", "--in", dest="input", required=True)
    t.add_argument("--output", "--out", dest="output", required=True)
    t.add_argument("-n", type=int, required=True)
    t.add_argument("--head", action="store_true")
    t.add_argument("--seed", type=int, default=0)
    g = commands.add_parser("generate", help="rows of a schema")
    g.add_argument("--schema", required=True, help="columns as in CREATE TABLE, or a table or record schema in JSON")
    g.add_argument("--output", required=True)
    g.add_argument("--rows", type=int, default=1_000_000)
    g.add_argument("--seed", type=int, default=0)
    return top


def schema_from(text: str) -> T.StructType:
    """A schema from columns as in CREATE TABLE, or from a table's or a record's schema in JSON."""
    text = text.strip()
    if text[:1] not in "[{":
        return T.StructType.fromDDL(text)
    return from_avro_json(text) if text[0] == "{" and json.loads(text).get("type") == "record" else from_table_json(text)


def save_report(got: Sample, output: str) -> None:
    """Target and actual size of every stratum, as a table beside a table, else as lines of text beside the files."""
    if kind_of(output) == "table":
        got.report.write.mode("overwrite").saveAsTable(f"{output}_report")
    else:
        as_tsv(got.report).write.mode("overwrite").text(f"{output.rstrip('/')}_report")


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    if args.command == "sample" and not 0 < args.fraction <= 1:
        parser().error("--fraction must be above 0 and at most 1")
    if args.command == "sample" and bool(args.distribution) != bool(args.distribution_fields):
        parser().error("--distribution and --distribution-fields go together")
    if args.command == "sample" and args.exact and not args.distribution:
        parser().error("--exact needs --distribution")
    if args.command == "take" and args.n <= 0:
        parser().error("-n must be positive")
    spark = spark or SparkSession.builder.appName(f"recordlab {args.command}").getOrCreate()
    if args.command == "diff":
        left, right = read_pair(spark, args.lhs, args.rhs, args.where)
        found = diff(left, right, args.key, ignore=tuple(args.ignore), unordered=tuple(args.unordered), keyed=keyed_fields(args.keyed), ignore_nan=args.ignore_nan)
        found.compared.persist()
        save_stats(found, args.output, args.output_mode, args.with_header)
        found.compared.unpersist()
    elif args.command == "sample":
        split = lambda x: [p for p in x.split(",") if p]
        got = sample(read(spark, args.input), args.fraction, split(args.fields), args.seed, args.algorithm, args.byte_encoding, args.distribution, split(args.distribution_fields), "exact" if args.exact else "approximate")
        rows = got.rows.drop("stratum") if got.population is not None else got.rows
        if args.partition or kind_of(args.output) == "table":
            write(rows, args.output, partition=args.partition, by=args.partition_by)
        else:
            write_once(spark, rows, args.output)
        if got.population is not None:
            save_report(got, args.output)
    elif args.command == "generate":
        write(generate(spark, schema_from(args.schema), args.rows, args.seed), args.output)
    else:
        df = read(spark, args.input)
        rows = (df.limit(args.n) if kind_of(args.input) == "table" else head_of_files(df, args.n)) if args.head else reservoir(df, args.n, args.seed)
        write(rows, args.output)
    return 0


if __name__ == "__main__":
    sys.exit(main())
