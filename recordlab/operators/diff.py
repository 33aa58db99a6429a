"""Keyed comparison of two DataFrames, field by field, as one declarative plan."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import cached_property

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from ..functions import deltas as D
from ..plans.schema import field_at, merge

SAME, DIFFERENT, MISSING_LHS, MISSING_RHS = "SAME", "DIFFERENT", "MISSING_LHS", "MISSING_RHS"
NUMBERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
#: Types of keys that are joined as they are; keys of other types are joined by their texts.
NATIVE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.DecimalType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)


@dataclass(frozen=True)
class Options:
    """What a comparison looks at.

    ``ignore`` names paths (or, with ``ignore_mode="contains"``, parts of paths).  ``unordered`` arrays are sorted by
    the text of their elements first; ``keyed`` arrays of structs are matched by the value of a field.  With
    ``indexed_paths`` the element's key is part of the reported path, and a missing element is one difference; without
    it every leaf of the missing element is one.  ``numeric_text`` measures texts that hold numbers as numbers, and
    lists of them as vectors; ``emit_equal`` reports equal leaves too.  ``overrides`` maps a path to its own function
    of two Columns; ``defaults`` maps a path to the value that an absent leaf stands for.  With ``type_defaults`` every
    other absent leaf stands for what its field's metadata gives as "default", else for 0, false or empty, and an
    absent list or map is an empty one; absent structs stay absent.
    """

    ignore: tuple[str, ...] = ()
    ignore_mode: str = "exact"
    unordered: tuple[str, ...] = ()
    keyed: dict[str, str] = field(default_factory=dict)
    indexed_paths: bool = True
    numeric_text: bool = False
    emit_equal: bool = False
    ignore_nan: bool = False
    guard: bool = True
    measures: D.Measures = D.Measures()
    overrides: dict[str, Callable[[Column, Column], Column]] = field(default_factory=dict)
    defaults: dict[str, object] = field(default_factory=dict)
    type_defaults: bool = False

    def drops(self, path: str) -> bool:
        return any(x in path for x in self.ignore) if self.ignore_mode == "contains" else path in self.ignore


def _empty() -> Column:
    return F.array().cast(f"array<{D.DELTA}>")


def _maybe(differs: Column, one: Column) -> Column:
    return F.when(differs, F.array(one)).otherwise(_empty())


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is computed once, however often ``f`` looks at it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def leaf_defaults(schema: T.StructType, prefix: str = "") -> dict[str, object]:
    """What an absent leaf stands for, by path: the "default" of its field's metadata, else 0, false or empty."""
    out: dict[str, object] = {}
    for f in schema:
        kind, path = f.dataType, prefix + f.name
        while isinstance(kind, T.ArrayType):
            kind = kind.elementType
        if isinstance(kind, T.StructType):
            out |= leaf_defaults(kind, path + ".")
        elif "default" in f.metadata:
            out[path] = f.metadata["default"]
        elif isinstance(kind, NUMBERS):
            out[path] = 0
        elif isinstance(kind, T.BooleanType):
            out[path] = False
        elif isinstance(kind, T.StringType | T.BinaryType):
            out[path] = ""
    return out


def _all(parts: list[Column]) -> Column:
    return _empty() if not parts else parts[0] if len(parts) == 1 else F.concat(*parts)


class _Compiler:
    """Turns a type into one Column: the array of deltas between two values of that type."""

    def __init__(self, options: Options):
        self.o = options

    def value(self, left: Column, right: Column, kind: T.DataType, path: str, name: Column) -> Column:
        if self.o.drops(path):
            return _empty()
        if isinstance(kind, T.StructType):
            return self.struct(left, right, kind, path, name)
        if self.o.type_defaults and isinstance(kind, T.MapType | T.ArrayType):
            none = (F.create_map() if isinstance(kind, T.MapType) else F.array()).cast(kind)
            left, right = F.coalesce(left, none), F.coalesce(right, none)
        if isinstance(kind, T.MapType):
            return self.map(left, right, kind, path, name)
        if isinstance(kind, T.ArrayType):
            return self.array(left, right, kind, path, name)
        return self.leaf(left, right, kind, path, name)

    def one_missing(self, left: Column, right: Column, kind: T.DataType, name: Column, then: Column) -> Column:
        both = left.isNotNull() & right.isNotNull()
        return F.when(both, then).when(left.isNull() & right.isNull(), _empty()).otherwise(F.array(D.delta(name, left, right, kind, "UNKNOWN")))

    def leaf(self, left: Column, right: Column, kind: T.DataType, path: str, name: Column) -> Column:
        m = self.o.measures
        if path in self.o.defaults:
            stand_in = F.lit(self.o.defaults[path]).cast(kind)
            left, right = F.coalesce(left, stand_in), F.coalesce(right, stand_in)
        if path in self.o.overrides:
            label, value = F.lit("NUMERIC"), self.o.overrides[path](left, right)
        elif isinstance(kind, NUMBERS):
            label, value = F.lit("NUMERIC"), m.numeric(left, right)
        elif isinstance(kind, T.StringType):
            label, value = F.lit("STRING"), m.string(left, right)
            if self.o.numeric_text:
                a, b = left.try_cast("double"), right.try_cast("double")
                both = a.isNotNull() & b.isNotNull()
                label, value = F.when(both, F.lit("NUMERIC")).otherwise(label), F.when(both, m.numeric(a, b)).otherwise(value)
        else:
            label, value = F.lit("UNKNOWN"), F.lit(None).cast("double")
        known = left.isNotNull() & right.isNotNull()
        one = D.delta(name, left, right, kind, F.when(known, label).otherwise("UNKNOWN"), F.when(known, value))
        return F.array(one) if self.o.emit_equal else _maybe(~D.same(left, right, kind), one)

    def struct(self, left: Column, right: Column, kind: T.StructType, path: str, name: Column) -> Column:
        below = [self.value(left[f.name], right[f.name], f.dataType, f"{path}.{f.name}", F.concat(name, F.lit(f".{f.name}"))) for f in kind]
        return self.one_missing(left, right, kind, name, _all(below))

    def map(self, left: Column, right: Column, kind: T.MapType, path: str, name: Column) -> Column:
        def entry(key: Column, a: Column, b: Column) -> Column:
            at = F.concat(name, F.lit("["), key.cast("string"), F.lit("]"))
            return self.value(a, b, kind.valueType, path, at)

        met = F.map_zip_with(left, right, entry)
        return self.one_missing(left, right, kind, name, F.flatten(F.map_values(met)))

    def array(self, left: Column, right: Column, kind: T.ArrayType, path: str, name: Column) -> Column:
        inner = kind.elementType
        if path in self.o.keyed and isinstance(inner, T.StructType):
            return self.one_missing(left, right, kind, name, self.keyed(left, right, inner, path, name))
        a, b = (D.sort_by_text(left, inner), D.sort_by_text(right, inner)) if path in self.o.unordered else (left, right)
        if isinstance(inner, NUMBERS):
            differs = F.exists(F.zip_with(a, b, lambda x, y: ~D.same(x, y, inner)), lambda x: x)
            one = D.delta(name, left, right, kind, "VECTOR", self.o.measures.vector(a, b))
        elif isinstance(inner, T.StringType) and self.o.numeric_text:
            numbers = lambda v: F.transform(v, lambda x: x.try_cast("double"))
            both = ~F.exists(F.concat(numbers(a), numbers(b)), lambda x: x.isNull())
            differs = F.exists(F.zip_with(a, b, lambda x, y: ~x.eqNullSafe(y)), lambda x: x)
            one = D.delta(name, left, right, kind, F.when(both, "VECTOR").otherwise("UNKNOWN"), F.when(both, self.o.measures.vector(numbers(a), numbers(b))))
        else:
            differs = F.exists(F.zip_with(a, b, lambda x, y: F.size(self.value(x, y, inner, path, F.lit(""))) > 0), lambda x: x)
            one = D.delta(name, left, right, kind, "UNKNOWN")
        sized = F.when(F.size(left) != F.size(right), F.array(D.delta(name, left, right, kind, "UNKNOWN"))).otherwise(_maybe(differs, one))
        return self.one_missing(left, right, kind, name, sized)

    def keyed(self, left: Column, right: Column, inner: T.StructType, path: str, name: Column) -> Column:
        """Elements meet by the text of their key; of several with one key the last counts."""
        by = self.o.keyed[path]
        key = lambda x: F.coalesce(x[by].cast("string"), F.lit("null"))

        def as_map(values: Column) -> Column:
            ordered = F.array_sort(F.transform(values, lambda x, i: F.struct(key(x).alias("k"), i.alias("i"))))
            last = _let(ordered, lambda s: F.filter(s, lambda t, i: F.coalesce(F.get(s, i + 1)["k"] != t["k"], F.lit(True))))
            return F.map_from_entries(F.transform(last, lambda t: F.struct(t["k"], F.get(values, t["i"]))))

        def entry(k: Column, a: Column, b: Column) -> Column:
            at = F.concat(name, F.lit("["), k, F.lit("]")) if self.o.indexed_paths else name
            both = _all([self.value(a[f.name], b[f.name], f.dataType, f"{path}.{f.name}", F.concat(at, F.lit(f".{f.name}"))) for f in inner])
            if self.o.indexed_paths:
                alone = F.array(D.delta(at, a, b, inner, "UNKNOWN"))
            else:
                alone = _all([_maybe(F.coalesce(a[f.name].isNotNull(), F.lit(False)) | F.coalesce(b[f.name].isNotNull(), F.lit(False)), D.delta(F.concat(at, F.lit(f".{f.name}")), a[f.name], b[f.name], f.dataType, "UNKNOWN")) for f in inner if not self.o.drops(f"{path}.{f.name}")])
            return F.when(a.isNotNull() & b.isNotNull(), both).otherwise(alone)

        found = F.flatten(F.map_values(F.map_zip_with(as_map(left), as_map(right), entry)))
        return found if self.o.indexed_paths else F.array_distinct(found)


def key_text(df: DataFrame, path: str) -> Column:
    """A key part as text: null is "null", bytes are upper-case hex."""
    kind = field_at(df.schema, path).dataType
    return F.coalesce(F.hex(F.col(path)) if isinstance(kind, T.BinaryType) else F.col(path).cast("string"), F.lit("null"))


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """``df`` with the columns of a merged schema, null where it has none."""

    def build(value: Column | None, kind: T.DataType, own: T.DataType | None) -> Column:
        if own is None:
            return F.lit(None).cast(kind)
        if isinstance(kind, T.StructType) and isinstance(own, T.StructType) and kind != own:
            inner = F.struct(*[build(value[f.name], f.dataType, own[f.name].dataType if f.name in own.names else None).alias(f.name) for f in kind])
            return F.when(value.isNotNull(), inner)
        return value

    return df.select(*[build(F.col(f"`{f.name}`") if f.name in df.columns else None, f.dataType, df.schema[f.name].dataType if f.name in df.columns else None).alias(f.name) for f in schema])


class Diff:
    """The comparison of two DataFrames, lazily: every property is a DataFrame over the same per-key relation."""

    def __init__(self, lhs: DataFrame, rhs: DataFrame, keys: list[str | Column], options: Options = Options()):
        if lhs.schema != rhs.schema:
            schema = merge(_loose(lhs.schema), _loose(rhs.schema))
            lhs, rhs = conform(lhs, schema), conform(rhs, schema)
        self.lhs, self.rhs, self.keys, self.options = lhs, rhs, keys, options

    def _parts(self, df: DataFrame) -> tuple[list[Column], list[Column]]:
        """Columns of the key to join by, none of them ever null, and the texts of its parts made of these."""
        parts, texts = [], []
        for i, k in enumerate(self.keys):
            found = None if isinstance(k, Column) else field_at(df.schema, k)
            if found is None or not isinstance(found.dataType, NATIVE):
                parts.append((k if isinstance(k, Column) else key_text(df, k)).alias(f"_k{i}"))
                texts.append(F.col(f"_k{i}"))
            elif "." not in k and not found.nullable:
                parts.append(F.col(k).alias(f"_k{i}"))
                texts.append(F.col(f"_k{i}").cast("string"))
            else:
                stand_in = F.lit("1970-01-01" if isinstance(found.dataType, T.DateType | T.TimestampType | T.TimestampNTZType) else "false" if isinstance(found.dataType, T.BooleanType) else "0")
                parts += [F.coalesce(F.col(k), stand_in.cast(found.dataType)).alias(f"_k{i}"), F.col(k).isNull().alias(f"_z{i}")]
                texts.append(F.when(F.col(f"_z{i}"), "null").otherwise(F.col(f"_k{i}").cast("string")))
        return parts, [t.alias(f"_k{i}") for i, t in enumerate(texts)]

    def _side(self, df: DataFrame, name: str, columns: list[str]) -> DataFrame:
        parts, texts = self._parts(df)
        side = df.select(*parts, F.struct(*[F.col(f"`{c}`") for c in columns]).alias(name)) if columns else df.select(*parts, F.lit(True).alias(name))
        if not self.options.guard:
            return side
        # The window shares the exchange and the sort of the join below.
        once = F.count("*").over(W.partitionBy(*side.columns[:-1]))
        checked = F.when(once > 1, F.raise_error(F.concat(F.lit("More than one record on a side has the key "), F.concat_ws("_", *texts)))).otherwise(F.col(name))
        return side.withColumn(name, checked.cast(side.schema[name].dataType))

    @cached_property
    def compared(self) -> DataFrame:
        """key parts _k0… as texts, key, diff_type, deltas."""
        plain = {k for k in self.keys if isinstance(k, str) and "." not in k}
        columns = [f.name for f in self.lhs.schema if not self.options.drops(f.name) and f.name not in plain]
        left, right = self._side(self.lhs, "_l", columns), self._side(self.rhs, "_r", columns)
        met = left.join(right, left.columns[:-1], "full_outer").select(*self._parts(self.lhs)[1], "_l", "_r")
        parts = [f"_k{i}" for i in range(len(self.keys))]
        left, right = F.col("_l"), F.col("_r")
        schema = self.lhs.schema
        options = replace(self.options, defaults=leaf_defaults(schema) | self.options.defaults) if self.options.type_defaults else self.options
        compiler = _Compiler(options)
        below = [compiler.value(left[c], right[c], schema[c].dataType, c, F.lit(c)) for c in columns] if columns else []
        deltas = F.when(left.isNotNull() & right.isNotNull(), _all(below)).otherwise(_empty())
        kind = F.when(left.isNull(), MISSING_LHS).when(right.isNull(), MISSING_RHS).when(F.size("deltas") == 0, SAME).otherwise(DIFFERENT)
        return met.withColumn("deltas", deltas).withColumn("diff_type", kind).select(*parts, F.concat_ws("_", *parts).alias("key"), "diff_type", "deltas")

    @cached_property
    def key_stats(self) -> DataFrame:
        """key, diff_type, delta: one row for each key, one for each differing field where fields differ."""
        return self.compared.select("key", "diff_type", F.explode_outer("deltas").alias("delta"))

    @cached_property
    def deltas(self) -> DataFrame:
        """key, field, left, right, delta_type, delta_value."""
        return self.compared.select("key", F.explode("deltas").alias("d")).select("key", "d.field", "d.left", "d.right", F.col("d.delta.deltaType").alias("delta_type"), F.col("d.delta.deltaValue").alias("delta_value"))

    @cached_property
    def global_stats(self) -> DataFrame:
        """num_total, num_same, num_diff, num_missing_lhs, num_missing_rhs: one row, zeros where nothing was compared."""
        return self.compared.agg(F.count("*").alias("num_total"), *self._classes())

    def _classes(self) -> list[Column]:
        return [F.count_if(F.col("diff_type") == kind).alias(name) for kind, name in ((SAME, "num_same"), (DIFFERENT, "num_diff"), (MISSING_LHS, "num_missing_lhs"), (MISSING_RHS, "num_missing_rhs"))]

    @cached_property
    def field_stats(self) -> DataFrame:
        """field, count, fraction of differing keys, and delta_type, min, max, delta_count and moments of the deltas.

        A field counts once for each key; the last of several deltas with its name counts.  With ``ignore_nan`` NaN
        deltas count for the field but not for the moments.  Moments are of the population, kurtosis is excess; both
        shape moments are null where the variance is zero.
        """
        rows = self.compared.where(F.col("diff_type") == DIFFERENT)
        last = F.col("deltas")
        if not self.options.indexed_paths:
            last = F.filter("deltas", lambda d, i: ~F.exists(F.slice("deltas", i + 2, F.size("deltas")), lambda e: e["field"] == d["field"]))
        # Each differing key also gives a row without a field, so that one aggregate counts the keys as well.
        every = F.concat(F.array(F.lit(None).cast(D.DELTA)), last)
        each = rows.select(F.explode(every).alias("d")).select("d.field", F.col("d.delta.deltaType").alias("t"), F.col("d.delta.deltaValue").alias("v"))
        v = F.when(~F.isnan("v"), F.col("v")) if self.options.ignore_nan else F.col("v")
        flat = F.var_pop(v) > 0
        stats = each.groupBy("field").agg(
            F.count("*").alias("count"), F.min("t").alias("delta_type"), F.min(v).alias("min"), F.max(v).alias("max"), F.count(v).alias("delta_count"),
            F.avg(v).alias("mean"), F.var_pop(v).alias("variance"), F.stddev_pop(v).alias("stddev"), F.when(flat, F.skewness(v)).alias("skewness"), F.when(flat, F.kurtosis(v)).alias("kurtosis"),
        )
        keys = F.max(F.when(F.col("field").isNull(), F.col("count"))).over(W.partitionBy(F.lit(0)))  # over the few rows of the result
        return stats.select("*", (F.col("count") / keys).alias("fraction")).where("field is not null").select("field", "count", "fraction", *stats.columns[2:])

    def missing(self, side: str) -> DataFrame:
        """Keys that only the other side has, by an anti join that reads nothing but keys."""
        here, there = (self.rhs, self.lhs) if side == "lhs" else (self.lhs, self.rhs)
        (own, texts), (other, _) = self._parts(here), self._parts(there)
        own, other = here.select(*own), there.select(*other)
        return own.join(other, own.columns, "left_anti").select(*texts).select(F.concat_ws("_", *[f"_k{i}" for i in range(len(self.keys))]).alias("key"))

    def duplicate_keys(self) -> DataFrame:
        """side, key and count of the keys that a side has more than once: what the guard raises on."""
        plain = lambda df, side: df.select(F.lit(side).alias("side"), F.concat_ws("_", *[k if isinstance(k, Column) else key_text(df, k) for k in self.keys]).alias("key"))
        return plain(self.lhs, "lhs").unionByName(plain(self.rhs, "rhs")).groupBy("side", "key").agg(F.count("*").alias("count")).where("count > 1")

    def observed(self, name: str = "diff") -> tuple[DataFrame, Observation]:
        """The per-key relation with counters that any action on it fills."""
        seen = Observation(name)
        return self.compared.observe(seen, *self._classes()), seen


def _loose(schema: T.StructType) -> T.StructType:
    """The schema with every top field nullable, so that only types have to agree."""
    return T.StructType([T.StructField(f.name, f.dataType, True) for f in schema])


def diff(lhs: DataFrame, rhs: DataFrame, keys: list[str | Column], where: str | None = None, pre: Callable[[DataFrame], DataFrame] | None = None, **options) -> Diff:
    """Compares two DataFrames by key.

    ``where`` is a predicate in SQL that restricts both sides (it reaches the scan); ``pre`` maps both sides first.
    The other arguments are those of :class:`Options`.
    """
    sides = [df.where(where) if where else df for df in (lhs, rhs)]
    return Diff(*[pre(df) if pre else df for df in sides], keys, Options(**options))
