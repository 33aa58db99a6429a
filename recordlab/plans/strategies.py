"""Hypothesis strategies for property tests: values and rows of any schema."""

from __future__ import annotations

import datetime as dt
import decimal

from hypothesis import strategies as st
from pyspark.sql import types as T

_BITS = {T.ByteType: 7, T.ShortType: 15, T.IntegerType: 31, T.LongType: 63}


def values(kind: T.DataType, nullable: bool = False) -> st.SearchStrategy:
    """Values of a type; with ``nullable`` also None."""
    if type(kind) in _BITS:
        found = st.integers(-(2 ** _BITS[type(kind)]), 2 ** _BITS[type(kind)] - 1)
    elif isinstance(kind, T.StructType):
        found = st.tuples(*[values(f.dataType, f.nullable) for f in kind])
    elif isinstance(kind, T.ArrayType):
        found = st.lists(values(kind.elementType, kind.containsNull), max_size=4)
    elif isinstance(kind, T.MapType):
        found = st.dictionaries(values(kind.keyType), values(kind.valueType, kind.valueContainsNull), max_size=4)
    elif isinstance(kind, T.DecimalType):
        found = st.integers(-(10**kind.precision) + 1, 10**kind.precision - 1).map(lambda n: decimal.Decimal(n).scaleb(-kind.scale, decimal.Context(prec=40)))
    elif isinstance(kind, T.FloatType | T.DoubleType):
        found = st.floats(width=32 if isinstance(kind, T.FloatType) else 64)
    elif isinstance(kind, T.StringType):
        found = st.text(st.characters(exclude_categories=["Cs"]), max_size=20)
    elif isinstance(kind, T.BinaryType):
        found = st.binary(max_size=20).map(bytearray)
    elif isinstance(kind, T.BooleanType):
        found = st.booleans()
    elif isinstance(kind, T.DateType):
        found = st.dates(dt.date(1900, 1, 1), dt.date(2100, 1, 1))
    elif isinstance(kind, T.TimestampType | T.TimestampNTZType):
        found = st.datetimes(dt.datetime(1900, 1, 1), dt.datetime(2100, 1, 1))
    else:
        raise ValueError(f"values of type {kind.simpleString()} cannot be generated")
    return st.none() | found if nullable else found


def rows(schema: T.StructType, max_size: int = 20) -> st.SearchStrategy:
    """Lists of rows that createDataFrame takes with the schema."""
    return st.lists(values(schema), max_size=max_size)
