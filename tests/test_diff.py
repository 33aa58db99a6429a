from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from recordlab.operators.diff import diff


def deltas(d):
    return sorted((r.key, r.field, r.delta_type, r.delta_value) for r in d.deltas.collect())


def pair(spark, schema, left, right):
    return spark.createDataFrame([(1, left)], f"id int, v {schema}"), spark.createDataFrame([(1, right)], f"id int, v {schema}")


@pytest.mark.parametrize(
    "schema, left, right, expected",
    [
        ("long", 20, 200, [("1", "v", "NUMERIC", 180.0)]),
        ("string", "hello", "Hello", [("1", "v", "STRING", 1.0)]),
        ("struct<a:int>", (1,), None, [("1", "v", "UNKNOWN", None)]),
        ("struct<a:int>", None, None, []),
        ("boolean", True, False, [("1", "v", "UNKNOWN", None)]),
        ("binary", bytearray(b"a"), bytearray(b"b"), [("1", "v", "UNKNOWN", None)]),
        ("array<string>", ["hello", "world"], ["Hello", "World"], [("1", "v", "UNKNOWN", None)]),
        ("array<long>", [1, 2], [1, 2, 3], [("1", "v", "UNKNOWN", None)]),
        ("array<long>", [], [], []),
        ("decimal(12,2)", Decimal("1.50"), Decimal("2.75"), [("1", "v", "NUMERIC", 1.25)]),
        ("decimal(12,2)", Decimal("1.50"), None, [("1", "v", "UNKNOWN", None)]),
        ("decimal(12,2)", Decimal("1.5"), Decimal("1.50"), []),
        ("map<string,int>", {"x": 1, "y": 2}, {"y": 5, "z": 1}, [("1", "v[x]", "UNKNOWN", None), ("1", "v[y]", "NUMERIC", 3.0), ("1", "v[z]", "UNKNOWN", None)]),
    ],
)
def test_golden_deltas(spark, schema, left, right, expected):
    assert deltas(diff(*pair(spark, schema, left, right), ["id"])) == expected


def test_opposite_vectors_are_two_apart(spark):
    (got,) = diff(*pair(spark, "array<long>", [20, 21], [-20, -21]), ["id"]).deltas.collect()
    assert got.delta_type == "VECTOR" and got.delta_value == pytest.approx(2.0)


def test_unordered_and_keyed_arrays(spark):
    rows = lambda *k: [(x, [1]) for x in k]
    kind = "array<struct<s:string,n:array<int>>>"
    swapped = pair(spark, kind, rows("a", "b", "c"), rows("a", "c", "b"))
    assert deltas(diff(*swapped, ["id"])) == [("1", "v", "UNKNOWN", None)]
    assert deltas(diff(*swapped, ["id"], unordered=("v",))) == []
    short = pair(spark, kind, rows("a", "b", "c"), rows("a", "c"))
    assert deltas(diff(*short, ["id"], keyed={"v": "s"})) == [("1", "v[b]", "UNKNOWN", None)]
    assert deltas(diff(*short, ["id"], keyed={"v": "s"}, indexed_paths=False)) == [("1", "v.n", "UNKNOWN", None), ("1", "v.s", "UNKNOWN", None)]


def test_last_of_repeated_element_keys_counts(spark):
    d = diff(*pair(spark, "array<struct<s:string,n:int>>", [("a", 1), ("a", 2)], [("a", 2)]), ["id"], keyed={"v": "s"})
    assert deltas(d) == []


@pytest.mark.parametrize("left, right, expected", [(1000, 1000, (1000, 1000, 0, 0, 0)), (500, 1000, (1000, 500, 0, 500, 0)), (1000, 500, (1000, 500, 0, 0, 500))])
def test_global_counts(spark, left, right, expected):
    assert tuple(diff(spark.range(left).withColumn("x", F.col("id") * 2.0), spark.range(right).withColumn("x", F.col("id") * 2.0), ["id"]).global_stats.first()) == expected


def test_ten_more_everywhere(spark):
    left = spark.range(1000).withColumn("x", F.col("id") * 2.0)
    d = diff(left, left.withColumn("x", F.col("x") + 10), ["id"])
    (f,) = d.field_stats.collect()
    assert (f.field, f["count"], f.fraction, f.delta_type) == ("x", 1000, 1.0, "NUMERIC")
    assert (f.min, f.max, f.mean) == pytest.approx((10.0, 10.0, 10.0)) and f.variance == pytest.approx(0, abs=1e-9)


def test_nan(spark):
    left = spark.range(100).withColumn("x", F.lit(1.0))
    right = left.withColumn("x", F.when(F.col("id") < 50, F.lit(float("nan"))).otherwise(11.0))
    (skip,) = diff(left, right, ["id"], ignore_nan=True).field_stats.collect()
    assert (skip["count"], skip.delta_count, skip.mean) == (100, 50, 10.0)
    (keep,) = diff(left, right, ["id"]).field_stats.collect()
    assert keep.delta_count == 100 and keep.mean != keep.mean


def test_keys(spark):
    df = spark.createDataFrame([(None, "bar", bytearray(b"testing"))], "a string, b string, c binary")
    assert diff(df, df, ["a", "b", "c"]).compared.first().key == "null_bar_74657374696E67"


def test_duplicate_key_is_an_error(spark):
    df = spark.createDataFrame([(1, 2), (1, 3)], "id int, x int")
    with pytest.raises(Exception, match="More than one record on a side has the key 1"):
        diff(df, df.limit(0), ["id"]).global_stats.collect()


def test_ignore_and_emit_equal(spark):
    left, right = pair(spark, "struct<a:int,b:int>", (1, 2), (5, 2))
    assert deltas(diff(left, right, ["id"], ignore=("v.a",))) == []
    assert deltas(diff(left, right, ["id"], ignore=("a",), ignore_mode="contains", emit_equal=True)) == [("1", "v.b", "NUMERIC", 0.0)]


def test_schemas_are_merged(spark):
    left = spark.createDataFrame([(1, (2,))], "id int, s struct<a:int>")
    right = spark.createDataFrame([(1, (2, "x"))], "id int, s struct<a:int,b:string>")
    assert deltas(diff(left, right, ["id"])) == [("1", "s.b", "UNKNOWN", None)]


def test_counters_and_plan(spark):
    left = spark.range(10)
    seen_df, seen = diff(left, spark.range(8), ["id"]).observed("counters")
    seen_df.collect()
    assert seen.get["num_missing_rhs"] == 2
    plan = diff(left, left, ["id"]).global_stats._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan


@pytest.mark.parametrize(
    "left, right, expected",
    [
        (["20", "21"], ["-20", "-21"], [("1", "v", "VECTOR", 2.0)]),
        (["1", "2.5"], ["1", "2.5"], []),
        (["1", "x"], ["1", "y"], [("1", "v", "UNKNOWN", None)]),
        (["1", None], ["1", "2"], [("1", "v", "UNKNOWN", None)]),
        (["1"], ["1", "2"], [("1", "v", "UNKNOWN", None)]),
        ([], [], []),
    ],
)
def test_lists_of_number_texts_are_vectors(spark, left, right, expected):
    got = deltas(diff(*pair(spark, "array<string>", left, right), ["id"], numeric_text=True))
    assert [(k, f, t, v and pytest.approx(v)) for k, f, t, v in expected] == got
    assert [d[2] for d in deltas(diff(*pair(spark, "array<string>", left, right), ["id"]))] == ["UNKNOWN"] * len(expected)


def test_decimal_arrays_are_vectors(spark):
    (got,) = diff(*pair(spark, "array<decimal(5,1)>", [Decimal("2.0"), Decimal("0.0")], [Decimal("0.0"), Decimal("3.5")]), ["id"]).deltas.collect()
    assert got.delta_type == "VECTOR" and got.delta_value == pytest.approx(1.0)


def test_defaults_of_types(spark):
    from pyspark.sql import types as T

    kind = T.StructType([
        T.StructField("id", T.IntegerType()), T.StructField("n", T.IntegerType()), T.StructField("s", T.StringType(), True, {"default": "none"}), T.StructField("b", T.BooleanType()),
        T.StructField("l", T.ArrayType(T.IntegerType())), T.StructField("r", T.StructType([T.StructField("x", T.DoubleType())])),
    ])
    left = spark.createDataFrame([(1, 0, "none", False, [], (0.0,)), (2, 1, "x", True, [1], (1.0,)), (3, None, None, None, None, (None,))], kind)
    right = spark.createDataFrame([(1, None, None, None, None, (None,)), (2, None, None, None, None, (None,)), (3, None, None, None, None, None)], kind)
    got = deltas(diff(left, right, ["id"], type_defaults=True))
    assert got == [("2", "b", "UNKNOWN", None), ("2", "l", "UNKNOWN", None), ("2", "n", "NUMERIC", -1.0), ("2", "r.x", "NUMERIC", -1.0), ("2", "s", "STRING", 4.0), ("3", "r", "UNKNOWN", None)]


def test_keys_are_joined_as_they_are(spark):
    import datetime as dt

    rows = [(None, True, dt.date(2020, 1, 2), Decimal("1.5"), 1), (0, None, None, None, 2), (0, False, dt.date(1970, 1, 1), Decimal("0"), 3), (7, True, dt.date(2020, 1, 2), None, 4)]
    left = spark.createDataFrame(rows, "a long, b boolean, c date, d decimal(4,1), x int")
    right = left.where("x <> 4").withColumn("x", F.col("x") + 1)
    d = diff(left, right, ["a", "b", "c", "d"])
    assert sorted((r.key, r.diff_type) for r in d.compared.collect()) == sorted([("null_true_2020-01-02_1.5", "DIFFERENT"), ("0_null_null_null", "DIFFERENT"), ("0_false_1970-01-01_0.0", "DIFFERENT"), ("7_true_2020-01-02_null", "MISSING_RHS")])
    assert [r.key for r in d.missing("rhs").collect()] == ["7_true_2020-01-02_null"] and d.missing("lhs").count() == 0
    plan = diff(left, right, ["a", "b", "c", "d"]).compared._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2


def test_field_stats_compare_once(spark):
    left = spark.range(50).withColumn("x", F.col("id") * 2.0)
    d = diff(left, left.withColumn("x", F.col("x") + 1), ["id"])
    plan = d.field_stats._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") == 1 and "NestedLoop" not in plan


def test_long_keyed_arrays(spark):
    import time

    rows = spark.range(1).select("id", F.expr("transform(sequence(1, 20000), i -> struct(cast(i as string) as s, i as n))").alias("v"))
    moved = rows.withColumn("v", F.expr("transform(v, x -> struct(x.s as s, if(x.n % 1000 = 0, x.n + 1, x.n) as n))"))
    began = time.time()
    assert diff(rows, moved, ["id"], keyed={"v": "s"}).deltas.count() == 20
    assert time.time() - began < 20
