"""Column expressions that measure how two values differ."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

DELTA = "struct<field:string,left:string,right:string,delta:struct<deltaType:string,deltaValue:double>>"


def numeric(left: Column, right: Column) -> Column:
    return right.cast("double") - left.cast("double")


def string(left: Column, right: Column) -> Column:
    return F.levenshtein(left, right).cast("double")


def vector(left: Column, right: Column) -> Column:
    """1 - cosine; null where a side is empty or all zero."""
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)
    return 1 - F.try_divide(dot(left, right), F.sqrt(dot(left, left)) * F.sqrt(dot(right, right)))


@dataclass(frozen=True)
class Measures:
    """The three distances, each a function of two Columns."""

    numeric: Callable[[Column, Column], Column] = numeric
    string: Callable[[Column, Column], Column] = string
    vector: Callable[[Column, Column], Column] = vector


def render(value: Column, kind: T.DataType) -> Column:
    """Text of a value, "null" for null; structs, arrays and maps as JSON."""
    if isinstance(kind, T.BinaryType):
        text = F.hex(value)
    elif isinstance(kind, T.StructType | T.ArrayType | T.MapType):
        text = F.to_json(value)
    else:
        text = value.cast("string")
    return F.coalesce(text, F.lit("null"))


def delta(name: Column, left: Column, right: Column, kind: T.DataType, label: Column | str, value: Column | None = None) -> Column:
    label = F.lit(label) if isinstance(label, str) else label
    value = F.lit(None) if value is None else value
    return F.struct(name.alias("field"), render(left, kind).alias("left"), render(right, kind).alias("right"), F.struct(label.alias("deltaType"), value.cast("double").alias("deltaValue")).alias("delta")).cast(DELTA)


def same(left: Column, right: Column, kind: T.DataType) -> Column:
    """Equality in which null equals null and NaN equals nothing."""
    if isinstance(kind, T.FloatType | T.DoubleType):
        return F.coalesce((left == right) & ~F.isnan(left), F.lit(False)) | (left.isNull() & right.isNull())
    return left.eqNullSafe(right)


def sort_by_text(values: Column, kind: T.DataType) -> Column:
    """An array's elements in the order of their texts; a null array stays null."""
    text = lambda x: render(x, kind)
    return F.array_sort(values, lambda a, b: F.when(text(a) < text(b), -1).when(text(a) > text(b), 1).otherwise(0))
