"""A million rows of a schema, the same on every run: python examples/make_rows.py OUTPUT.parquet"""

import sys

from pyspark.sql import SparkSession
from pyspark.sql import types as T

from recordlab.operators.generate import generate
from recordlab.sources.io import write

def main(output: str, rows: int = 1_000_000) -> None:
    spark = SparkSession.builder.appName("generate").getOrCreate()
    schema = T.StructType.fromDDL("user_id long not null, country string not null, tags array<string> not null, profile struct<age: int, joined: date>")
    countries = {"country": lambda s: s.frequency("country", [(5, "SE"), (3, "DE"), (1, "NO")])}
    write(generate(spark, schema, rows, seed=7, overrides=countries), output)


if __name__ == "__main__":
    main(sys.argv[1])
