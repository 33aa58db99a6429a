"""Protobuf messages to rows and back in Arrow batches, by a descriptor set and without generated classes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..plans.schema import from_descriptor
from ..session import ship


def _class(descriptors: bytes, message: str):
    from google.protobuf import descriptor_pb2, descriptor_pool, message_factory

    pool = descriptor_pool.DescriptorPool()
    for file in descriptor_pb2.FileDescriptorSet.FromString(descriptors).file:
        pool.Add(file)
    return message_factory.GetMessageClass(pool.FindMessageTypeByName(message))


def _reader(kind: T.StructType, about) -> Callable[[object], dict]:
    """Rows of messages: an unset field is null, unless ``kind`` says it never is."""
    parts = []
    for f in kind:
        field, inner = about.fields_by_name[f.name], f.dataType
        enum = {v.number: v.name for v in field.enum_type.values} if field.enum_type else None
        if isinstance(inner, T.MapType):
            value = field.message_type.fields_by_name["value"]
            own = _reader(inner.valueType, value.message_type) if isinstance(inner.valueType, T.StructType) else (lambda x: x)
            make = lambda x, own=own: [(k, own(v)) for k, v in x.items()]
        elif isinstance(inner, T.ArrayType):
            own = _reader(inner.elementType, field.message_type) if isinstance(inner.elementType, T.StructType) else (lambda x: x) if enum is None else enum.get
            make = lambda x, own=own: [own(v) for v in x]
        elif isinstance(inner, T.StructType):
            make = _reader(inner, field.message_type)
        else:
            make = (lambda x: x) if enum is None else enum.get
        parts.append((f.name, make, field.has_presence))

    def read(m) -> dict:
        return {n: make(getattr(m, n)) if not presence or m.HasField(n) else None for n, make, presence in parts}

    return read


def _fill(m, row: dict, about) -> None:
    for name, value in row.items():
        field = about.fields_by_name.get(name)
        if value is None or field is None:
            continue
        target = getattr(m, name)
        if field.message_type and field.message_type.GetOptions().map_entry:
            for k, v in value:
                if isinstance(v, dict):
                    _fill(target[k], v, field.message_type.fields_by_name["value"].message_type)
                elif v is not None:
                    target[k] = v
        elif hasattr(target, "add") and field.message_type:
            for v in value:
                _fill(target.add(), v, field.message_type)
        elif isinstance(value, list):
            target.extend(field.enum_type.values_by_name[v].number if field.enum_type else v for v in value)
        elif field.message_type:
            target.SetInParent()
            _fill(target, value, field.message_type)
        else:
            setattr(m, name, field.enum_type.values_by_name[value].number if field.enum_type else value)


def decode(df: DataFrame, column: str, descriptors: bytes, message: str) -> DataFrame:
    """A row for each message in a binary column; null messages are rows of nulls and empty lists."""
    ship(df.sparkSession)
    kind = from_descriptor(descriptors, message)
    arrow = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cls = _class(descriptors, message)
        read = _reader(kind, cls.DESCRIPTOR)
        for batch in batches:
            yield pa.RecordBatch.from_pylist([read(cls() if b is None else cls.FromString(b)) for b in batch.column(0).to_pylist()], arrow)

    return df.select(F.col(column).cast("binary")).mapInArrow(run, T.StructType([T.StructField(f.name, f.dataType, True) for f in kind]))


def encode(df: DataFrame, descriptors: bytes, message: str) -> DataFrame:
    """One binary column, value: a message of each row; columns that the message lacks are left out, nulls unset."""
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cls = _class(descriptors, message)
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                m = cls()
                _fill(m, row, cls.DESCRIPTOR)
                out.append(m.SerializeToString())
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])

    return df.mapInArrow(run, "value binary")
