"""Schema operators: paths, flattening, union, compatibility, and schemas from JSON."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import types as T


def field_at(schema: T.StructType, path: str) -> T.StructField:
    """The field at a dotted path, through structs and arrays of structs; an unknown name is an error at once."""
    kind: T.DataType = schema
    field = None
    for part in path.split("."):
        while isinstance(kind, T.ArrayType):
            kind = kind.elementType
        if not isinstance(kind, T.StructType) or part not in kind.names:
            known = ", ".join(kind.names) if isinstance(kind, T.StructType) else kind.simpleString()
            raise ValueError(f"no field {part!r} on path {path!r}; there is: {known}")
        field = kind[part]
        kind = field.dataType
    return field


def stratum_field(schema: T.StructType, path: str) -> T.StructField:
    """A field that can be a stratum key: not an array or a map anywhere on the path."""
    parts = path.split(".")
    for i in range(1, len(parts) + 1):
        found = field_at(schema, ".".join(parts[:i]))
        if isinstance(found.dataType, T.ArrayType | T.MapType):
            raise ValueError(f"{path!r} leads through an array or a map, which cannot be a stratum key")
    return found


def flatten(schema: T.StructType, prefix: str = "") -> Iterator[tuple[str, T.DataType]]:
    """(path, type) of every leaf; arrays and maps are leaves."""
    for f in schema:
        path = prefix + f.name
        if isinstance(f.dataType, T.StructType):
            yield from flatten(f.dataType, path + ".")
        else:
            yield path, f.dataType


def merge(a: T.StructType, b: T.StructType) -> T.StructType:
    """Union of fields, recursively; shared fields must agree in type and nullability."""
    fields = []
    theirs = {f.name: f for f in b}
    for f in a:
        g = theirs.pop(f.name, None)
        if g is not None and isinstance(f.dataType, T.StructType) and isinstance(g.dataType, T.StructType):
            f = T.StructField(f.name, merge(f.dataType, g.dataType), f.nullable)
        elif g is not None and (f.dataType, f.nullable) != (g.dataType, g.nullable):
            raise ValueError(f"field {f.name!r} is {f.dataType.simpleString()} on one side and {g.dataType.simpleString()} on the other, or differs in nullability")
        fields.append(f)
    return T.StructType([*fields, *theirs.values()])


_WIDER = {T.IntegerType: (T.LongType, T.FloatType, T.DoubleType), T.LongType: (T.FloatType, T.DoubleType), T.FloatType: (T.DoubleType,), T.StringType: (T.BinaryType,), T.BinaryType: (T.StringType,)}


def can_read(reader: T.DataType, writer: T.DataType) -> bool:
    """Whether data of type ``writer`` can be read as ``reader``: fields that only the reader has must be nullable."""
    if isinstance(reader, T.StructType) and isinstance(writer, T.StructType):
        theirs = {f.name: f for f in writer}
        return all(f.nullable if f.name not in theirs else (f.nullable or not theirs[f.name].nullable) and can_read(f.dataType, theirs[f.name].dataType) for f in reader)
    if isinstance(reader, T.ArrayType) and isinstance(writer, T.ArrayType):
        return can_read(reader.elementType, writer.elementType)
    if isinstance(reader, T.MapType) and isinstance(writer, T.MapType):
        return reader.keyType == writer.keyType and can_read(reader.valueType, writer.valueType)
    return reader == writer or type(reader) in _WIDER.get(type(writer), ())


def compatible(left: T.StructType, right: T.StructType, one_way: bool = False) -> T.StructType:
    """The schema to read both sides with: the left one if it reads the right, else the right one if it reads the left.

    With ``one_way`` only the right one is tried.
    """
    if not one_way and can_read(left, right):
        return left
    if can_read(right, left):
        return right
    raise ValueError("neither schema can read the other" if not one_way else "the right schema cannot read the left one")


_TABLE = {"INTEGER": T.LongType(), "INT64": T.LongType(), "FLOAT": T.DoubleType(), "FLOAT64": T.DoubleType(), "BOOLEAN": T.BooleanType(), "BOOL": T.BooleanType(), "STRING": T.StringType(), "BYTES": T.BinaryType(), "TIMESTAMP": T.TimestampType(), "DATE": T.DateType(), "TIME": T.StringType(), "DATETIME": T.TimestampNTZType()}


def from_table_json(text: str) -> T.StructType:
    """A warehouse table schema in JSON (fields with name, type, mode); a missing mode means NULLABLE."""

    def convert(fields: list[dict]) -> T.StructType:
        out = []
        for f in fields:
            name = f["type"].upper()
            kind = convert(f["fields"]) if name in ("RECORD", "STRUCT") else _TABLE.get(name)
            if kind is None:
                raise ValueError(f"type {f['type']} of {f['name']} is not supported")
            mode = (f.get("mode") or "NULLABLE").upper()
            out.append(T.StructField(f["name"], T.ArrayType(kind, False) if mode == "REPEATED" else kind, mode == "NULLABLE"))
        return T.StructType(out)

    given = json.loads(text)
    return convert(given["fields"] if isinstance(given, dict) else given)


def to_table_json(schema: T.StructType) -> str:
    """The JSON that :func:`from_table_json` reads; types that a warehouse table lacks are an error."""

    def convert(f: T.StructField) -> dict:
        kind, mode = f.dataType, "NULLABLE" if f.nullable else "REQUIRED"
        if isinstance(kind, T.ArrayType):
            kind, mode = kind.elementType, "REPEATED"
        if isinstance(kind, T.StructType):
            return {"name": f.name, "type": "RECORD", "mode": mode, "fields": [convert(x) for x in kind]}
        name = next((n for n, t in _TABLE.items() if t == kind), None)
        if name is None:
            raise ValueError(f"type {kind.simpleString()} of {f.name} is not supported")
        return {"name": f.name, "type": name, "mode": mode}

    return json.dumps({"fields": [convert(f) for f in schema]})


_MESSAGE = {1: T.DoubleType(), 2: T.FloatType(), 3: T.LongType(), 4: T.DecimalType(20, 0), 5: T.IntegerType(), 6: T.DecimalType(20, 0), 7: T.LongType(), 8: T.BooleanType(), 9: T.StringType(), 12: T.BinaryType(), 13: T.LongType(), 14: T.StringType(), 15: T.IntegerType(), 16: T.LongType(), 17: T.IntegerType(), 18: T.LongType()}


def from_descriptor(descriptors: bytes, message: str) -> T.StructType:
    """The schema of a message in a serialized Protobuf descriptor set; a field's default is in its metadata.

    Repeated fields are arrays, map fields maps, enumerations texts; a message inside itself is left out.
    """
    from google.protobuf import descriptor_pb2

    known: dict[str, tuple[str, object]] = {}

    def enter(prefix: str, messages, enums) -> None:
        for e in enums:
            known[f"{prefix}.{e.name}"] = ("enum", e)
        for m in messages:
            known[f"{prefix}.{m.name}"] = ("message", m)
            enter(f"{prefix}.{m.name}", m.nested_type, m.enum_type)

    for file in descriptor_pb2.FileDescriptorSet.FromString(descriptors).file:
        enter(f".{file.package}" if file.package else "", file.message_type, file.enum_type)
    top = next((k for k in known if k == f".{message}" or k.endswith(f".{message}")), None)
    if top is None or known[top][0] != "message":
        raise ValueError(f"no message {message!r} in the descriptors")

    def convert(name: str, above: tuple[str, ...]) -> T.StructType:
        fields = []
        for f in known[name][1].field:
            repeated, metadata = f.label == f.LABEL_REPEATED, {}
            if f.type in (f.TYPE_MESSAGE, f.TYPE_GROUP):
                if f.type_name in (*above, name):
                    continue
                kind: T.DataType = convert(f.type_name, (*above, name))
                if repeated and known[f.type_name][1].options.map_entry:
                    kind, repeated = T.MapType(kind["key"].dataType, kind["value"].dataType), False
            else:
                kind = _MESSAGE[f.type]
                if f.type == f.TYPE_ENUM:
                    metadata = {"default": f.default_value or known[f.type_name][1].value[0].name}
                elif f.HasField("default_value"):
                    plain = {"StringType": str, "BinaryType": str, "BooleanType": lambda x: x == "true"}
                    metadata = {"default": plain.get(type(kind).__name__, float if isinstance(kind, T.FloatType | T.DoubleType) else int)(f.default_value)}
            fields.append(T.StructField(f.name, T.ArrayType(kind, False) if repeated else kind, not repeated and f.label != f.LABEL_REQUIRED, metadata))
        return T.StructType(fields)

    return convert(top, ())


_AVRO = {"null": T.NullType(), "boolean": T.BooleanType(), "int": T.IntegerType(), "long": T.LongType(), "float": T.FloatType(), "double": T.DoubleType(), "bytes": T.BinaryType(), "string": T.StringType()}


def from_avro_json(text: str) -> T.StructType:
    """An Avro record schema in JSON; [null, T] is a nullable T, other unions become a struct of nullable members."""
    named: dict[str, T.DataType] = {}

    def convert(s) -> tuple[T.DataType, bool]:
        if isinstance(s, list):
            rest = [x for x in s if x != "null"]
            if len(rest) == 1:
                return convert(rest[0])[0], len(rest) < len(s)
            return T.StructType([T.StructField(f"member{i}", convert(x)[0], True) for i, x in enumerate(rest)]), len(rest) < len(s)
        if isinstance(s, str):
            return _AVRO.get(s) or named[s], s == "null"
        kind, logical = s["type"], s.get("logicalType")
        if isinstance(kind, dict | list):
            return convert(kind)
        if logical == "decimal":
            return T.DecimalType(s["precision"], s.get("scale", 0)), False
        if logical == "date":
            return T.DateType(), False
        if logical in ("timestamp-millis", "timestamp-micros"):
            return T.TimestampType(), False
        if kind == "record":
            out = T.StructType([])
            named[s["name"]] = out
            for f in s["fields"]:
                inner, nullable = convert(f["type"])
                out.add(f["name"], inner, nullable)
            return out, False
        if kind in ("enum", "fixed"):
            named[s["name"]] = T.StringType() if kind == "enum" else T.BinaryType()
            return named[s["name"]], False
        if kind == "array":
            inner, nullable = convert(s["items"])
            return T.ArrayType(inner, nullable), False
        if kind == "map":
            inner, nullable = convert(s["values"])
            return T.MapType(T.StringType(), inner, nullable), False
        return _AVRO[kind], kind == "null"

    return convert(json.loads(text))[0]


def keyed_fields(pairs: list[str]) -> dict[str, str]:
    """["path:key", …] as a dict; each must have exactly two parts."""
    out = {}
    for pair in pairs:
        parts = pair.split(":")
        if len(parts) != 2 or not all(parts):
            raise ValueError(f"a keyed field is written path:key, not {pair!r}")
        out[parts[0]] = parts[1]
    return out


def strip_quotes(text: str) -> str:
    """Takes off one pair of matching quotes around the whole text."""
    return text[1:-1] if len(text) > 1 and text[0] == text[-1] and text[0] in "\"'`" else text
