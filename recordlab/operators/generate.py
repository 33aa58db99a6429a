"""Schema-driven data: each value is a Column over the row number, a seed and the value's path."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.hashing import md5_roll


class Source:
    """Draws for one row: the same seed, row and path always give the same value, on any number of partitions."""

    def __init__(self, row: Column, seed: int = 0):
        self.row, self.seed = row, seed

    def at(self, part: Column) -> Source:
        """A source of further independent draws, such as for the elements of an array."""
        return Source(F.concat_ws("/", self.row.cast("string"), part.cast("string")), self.seed)

    def unit(self, path: str) -> Column:
        return md5_roll(self.row, F.lit(path), seed=self.seed)

    def choose(self, path: str, low: int, high: int) -> Column:
        """A whole number from low to high."""
        return (F.floor(self.unit(path) * (high - low + 1)) + low).cast("long")

    def between(self, path: str, low: float, high: float) -> Column:
        return F.lit(low) + self.unit(path) * (high - low)

    def one_of(self, path: str, values: list) -> Column:
        return F.element_at(F.array(*[F.lit(v) for v in values]), self.choose(path, 1, len(values)).cast("int"))

    def frequency(self, path: str, weighted: list[tuple[float, object]]) -> Column:
        """One of the values, as often as its weight says."""
        total, below, out = sum(w for w, _ in weighted), 0.0, None
        roll = self.unit(path)
        for w, v in weighted[:-1]:
            below += w
            v = v if isinstance(v, Column) else F.lit(v)
            out = F.when(roll < below / total, v) if out is None else out.when(roll < below / total, v)
        last = weighted[-1][1]
        last = last if isinstance(last, Column) else F.lit(last)
        return last if out is None else out.otherwise(last)

    def digest(self, path: str) -> Column:
        return F.md5(F.concat_ws("|", F.lit(str(self.seed)), self.row.cast("string"), F.lit(path)))

    def text(self, path: str, low: int = 0, high: int = 20) -> Column:
        """Lower-case letters and digits."""
        return F.substring(F.concat(self.digest(path), self.digest(path + "'")), F.lit(1), self.choose(path + "#", low, high).cast("int"))

    def upper_text(self, path: str, low: int = 1, high: int = 20) -> Column:
        return F.translate(self.text(path, low, high), "0123456789abcdef", "GHIJKLMNOPABCDEF")

    def uuid(self, path: str) -> Column:
        d = self.digest(path)
        return F.concat_ws("-", F.substring(d, 1, 8), F.substring(d, 9, 4), F.concat(F.lit("4"), F.substring(d, 14, 3)), F.concat(F.lit("8"), F.substring(d, 18, 3)), F.substring(d, 21, 12))

    def bytes(self, path: str, low: int = 0, high: int = 39) -> Column:
        wide = F.concat(*[self.digest(f"{path}{i}") for i in range(-(-high // 16))])
        return F.unhex(F.substring(wide, F.lit(1), (self.choose(path + "#", low, high) * 2).cast("int")))

    def list_of(self, path: str, make: Callable[[Source], Column], low: int, high: int) -> Column:
        """low to high values, each with draws of its own."""
        size = self.choose(path + "#", low, high)
        return F.transform(F.slice(F.sequence(F.lit(1), F.lit(max(high, 1))), F.lit(1), size.cast("int")), lambda i: make(self.at(i)))

    def map_of(self, path: str, make: Callable[[Source], Column], low: int, high: int) -> Column:
        """low to high entries; keys are distinct."""
        keys = F.array_distinct(self.list_of(path + ".key", lambda s: s.text(path + ".key", 4, 16), low, high))
        return F.map_from_arrays(keys, F.transform(keys, lambda k: make(self.at(k))))


def value(s: Source, kind: T.DataType, path: str, nullable: bool, overrides: dict[str, Callable[[Source], Column]]) -> Column:
    """A value of any type; a nullable one is null half of the time; an override makes the value at its path."""
    if path in overrides:
        return overrides[path](s).cast(kind)
    if isinstance(kind, T.StructType):
        out = F.struct(*[value(s, f.dataType, f"{path}.{f.name}" if path else f.name, f.nullable, overrides).alias(f.name) for f in kind])
    elif isinstance(kind, T.ArrayType):
        out = s.list_of(path, lambda e: value(e, kind.elementType, path + "[]", False, overrides), 1, 4)
    elif isinstance(kind, T.MapType):
        out = s.map_of(path, lambda e: value(e, kind.valueType, path + "{}", False, overrides), 0, 4)
    elif isinstance(kind, T.BooleanType):
        out = s.unit(path) < 0.5
    elif isinstance(kind, T.IntegerType | T.ShortType | T.ByteType):
        half = {T.IntegerType: 31, T.ShortType: 15, T.ByteType: 7}[type(kind)]
        out = s.choose(path, -(2**half), 2**half - 1)
    elif isinstance(kind, T.LongType):
        out = s.choose(path + "+", -(2**30), 2**30) * F.lit(2**32) + s.choose(path, 0, 2**32 - 1)
    elif isinstance(kind, T.FloatType | T.DoubleType):
        out = s.between(path, -1e9, 1e9)
    elif isinstance(kind, T.DecimalType):
        digits = min(kind.precision, 15)
        out = s.choose(path, -(10**digits) + 1, 10**digits - 1).cast("decimal(38,0)") / F.lit(10**kind.scale).cast("decimal(38,0)")
    elif isinstance(kind, T.BinaryType):
        out = s.bytes(path)
    elif isinstance(kind, T.DateType):
        out = F.date_add(F.lit("1970-01-01").cast("date"), s.choose(path, 0, 20000).cast("int"))
    elif isinstance(kind, T.TimestampType | T.TimestampNTZType):
        out = F.timestamp_millis(s.choose(path, 0, 1_700_000_000_000))
    elif isinstance(kind, T.StringType):
        out = s.frequency(path + "?", [(1, " "), (1, ""), (1, "foo"), (3, s.text(path))])
    elif isinstance(kind, T.NullType):
        return F.lit(None)
    else:
        raise ValueError(f"values of type {kind.simpleString()} cannot be generated")
    if not isinstance(kind, T.StructType | T.ArrayType | T.MapType):
        out = out.cast(kind)
    return F.when(s.unit(path + "=") < 0.5, out) if nullable else out


def generate(spark: SparkSession, schema: T.StructType, n: int, seed: int = 0, overrides: dict[str, Callable[[Source], Column]] | None = None) -> DataFrame:
    """``n`` rows of a schema.  The seed reproduces them on any cluster."""
    s = Source(F.col("_row"), seed)
    made = [value(s, f.dataType, f.name, f.nullable, overrides or {}).alias(f.name) for f in schema]
    return spark.range(n).withColumnRenamed("id", "_row").select(*made)


def _set(record: Column, parts: list[str], new: Column, safe: bool) -> Column:
    if len(parts) == 1:
        out = record.withField(parts[0], new)
    else:
        out = record.withField(parts[0], _set(record[parts[0]], parts[1:], new, safe))
    return F.when(record.isNotNull(), out) if safe else out


def amend(df: DataFrame, drawn: Column, *paths: str, safe: bool = False) -> DataFrame:
    """Sets every path to one drawn value.  With ``safe`` a null parent stays null, else it becomes a record."""
    for path in paths:
        top, *rest = path.split(".")
        df = df.withColumn(top, _set(F.col(top), rest, drawn, safe) if rest else drawn)
    return df


def try_amend(df: DataFrame, drawn: Column, *paths: str) -> DataFrame:
    return amend(df, drawn, *paths, safe=True)


def tupled(spark: SparkSession, first: T.StructType, second: T.StructType, n: int, seed: int = 0, overrides: tuple[dict, dict] = ({}, {})) -> DataFrame:
    """Pairs of records, as two structs named first and second."""
    s = Source(F.col("_row"), seed)
    pair = [F.struct(*[value(s, f.dataType, f"{name}.{f.name}", f.nullable, {f"{name}.{k}": v for k, v in own.items()}).alias(f.name) for f in kind]).alias(name) for name, kind, own in (("first", first, overrides[0]), ("second", second, overrides[1]))]
    return spark.range(n).withColumnRenamed("id", "_row").select(*pair)


def amend2(pairs: DataFrame, drawn: Column, first: str, second: str, safe: bool = False) -> DataFrame:
    """Sets one value in both records of each pair."""
    return amend(pairs, drawn, f"first.{first}", f"second.{second}", safe=safe)


def with_gen(spark: SparkSession, schema: T.StructType, check: Callable[[DataFrame], object], n: int = 100, seed: int | None = None, **options) -> object:
    """Runs a check on generated rows; when it fails, the error names the seed that reproduces them."""
    import random

    seed = random.randrange(1 << 31) if seed is None else seed
    try:
        return check(generate(spark, schema, n, seed, **options))
    except Exception as e:
        e.add_note(f"generated with seed {seed}")
        raise
