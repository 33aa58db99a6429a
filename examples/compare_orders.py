"""Compares two versions of a table by key: python examples/compare_orders.py LEFT RIGHT KEY"""

import sys

from pyspark.sql import SparkSession

from recordlab.operators.diff import diff
from recordlab.sources.io import read_pair


def main(left: str, right: str, key: str) -> None:
    spark = SparkSession.builder.appName("compare").getOrCreate()
    found = diff(*read_pair(spark, left, right), [key])
    found.compared.persist()
    found.global_stats.show()
    found.field_stats.show(truncate=False)
    found.deltas.show(20, truncate=False)


if __name__ == "__main__":
    main(*sys.argv[1:4])
