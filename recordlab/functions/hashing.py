"""Hash rolls: farm and murmur fingerprints in Arrow batches, and a portable roll from md5 in built-in functions."""

from __future__ import annotations

import base64
import struct
from enum import Enum

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.schema import field_at
from ..session import ship


class Algorithm(str, Enum):
    FARM = "farm"
    MURMUR = "murmur"
    MD5 = "md5"


class ByteEncoding(str, Enum):
    RAW = "raw"
    HEX = "hex"
    BASE64 = "base64"


# Fixed values of the two published algorithms.
_K0, _K1, _K2 = (np.uint64(x) for x in (0xC3A5C85C97CB3127, 0xB492B66FBE98F273, 0x9AE16A3B2F90404F))
_C1, _C2 = np.uint64(0x87C37B91114253D5), np.uint64(0x4CF5AD432745937F)


def _u(x: int) -> np.uint64:
    return np.uint64(x & 0xFFFFFFFFFFFFFFFF)


def _turn(x: np.ndarray, n: int) -> np.ndarray:
    """Rotation to the right."""
    return (x >> np.uint64(n)) | (x << np.uint64(64 - n)) if n else x


def _fold(x: np.ndarray) -> np.ndarray:
    return x ^ (x >> np.uint64(47))


class _Rows:
    """Messages of one length as a byte matrix, read as little-endian words at any offset."""

    def __init__(self, m: np.ndarray):
        self.m = m

    def u64(self, at: int) -> np.ndarray:
        return np.ascontiguousarray(self.m[:, at : at + 8]).view("<u8")[:, 0]

    def u32(self, at: int) -> np.ndarray:
        return np.ascontiguousarray(self.m[:, at : at + 4]).view("<u4")[:, 0].astype(np.uint64)

    def u8(self, at: int) -> np.ndarray:
        return self.m[:, at].astype(np.uint64)


def _join16(u: np.ndarray, v: np.ndarray, by: np.uint64) -> np.ndarray:
    a = _fold((u ^ v) * by)
    return _fold((v ^ a) * by) * by


def _farm_short(r: _Rows, n: int) -> np.ndarray:
    by = _u(int(_K2) + 2 * n)
    if n >= 8:
        a, b = r.u64(0) + _K2, r.u64(n - 8)
        return _join16(_turn(b, 37) * by + a, (_turn(a, 25) + b) * by, by)
    if n >= 4:
        return _join16(_u(n) + (r.u32(0) << np.uint64(3)), r.u32(n - 4), by)
    if n:
        y, z = r.u8(0) + (r.u8(n >> 1) << np.uint64(8)), _u(n) + (r.u8(n - 1) << np.uint64(2))
        return _fold((y * _K2) ^ (z * _K0)) * _K2
    return np.full(len(r.m), _K2)


def _farm_ends(r: _Rows, n: int, first: np.uint64) -> tuple[np.ndarray, np.ndarray, np.uint64, np.ndarray]:
    by = _u(int(_K2) + 2 * n)
    a, b, c, d = r.u64(0) * first, r.u64(8), r.u64(n - 8) * by, r.u64(n - 16) * _K2
    return _turn(a + b, 43) + _turn(c, 30) + d, a + _turn(b + _K2, 18) + c, by, a


def _farm_middle(r: _Rows, n: int) -> np.ndarray:
    if n <= 32:
        y, z, by, _ = _farm_ends(r, n, _K1)
        return _join16(y, z, by)
    y, z, by, a = _farm_ends(r, n, _K2)
    z = _join16(y, z, by)
    e, f = r.u64(16) * by, r.u64(24)
    g, h = (y + r.u64(n - 32)) * by, (z + r.u64(n - 24)) * by
    return _join16(_turn(e + f, 43) + _turn(g, 30) + h, e + _turn(f + a, 18) + g, by)


def _weak(r: _Rows, at: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    w, x, y, z = (r.u64(at + 8 * i) for i in range(4))
    a = a + w
    b, c = _turn(b + a + z, 21), a
    a = a + x + y
    return a + z, b + _turn(a, 44) + c


def _farm_long(r: _Rows, n: int) -> np.ndarray:
    rows = len(r.m)
    full = lambda v: np.full(rows, _u(v))
    x, y = full(81), full(81 * int(_K1) + 113)
    z = _fold(y * _K2 + np.uint64(113)) * _K2
    v, w = (full(0), full(0)), (full(0), full(0))
    x = x * _K2 + r.u64(0)
    last = (n - 1) // 64 * 64
    for at in (*range(0, last, 64), None):
        closing = at is None
        by, nine = (_K1, np.uint64(1)) if not closing else (_K1 + ((z & np.uint64(255)) << np.uint64(1)), np.uint64(9))
        if closing:
            at = last + ((n - 1) & 63) - 63
            w = (w[0] + np.uint64((n - 1) & 63), w[1])
            v = (v[0] + w[0], v[1])
            w = (w[0] + v[0], w[1])
        x = _turn(x + y + v[0] + r.u64(at + 8), 37) * by
        y = _turn(y + v[1] + r.u64(at + 48), 42) * by
        x = x ^ (w[1] * nine)
        y = y + v[0] * nine + r.u64(at + 40)
        z = _turn(z + w[0], 33) * by
        v = _weak(r, at, v[1] * by, x + w[0])
        w = _weak(r, at + 32, z + w[1], y + r.u64(at + 16))
        z, x = x, z
    return _join16(_join16(v[0], w[0], by) + _fold(y) * _K0 + z, _join16(v[1], w[1], by) + x, by)


def _farm(r: _Rows, n: int) -> np.ndarray:
    return _farm_short(r, n) if n <= 16 else _farm_middle(r, n) if n <= 64 else _farm_long(r, n)


def _murmur(r: _Rows, n: int, seed: int) -> np.ndarray:
    h1 = h2 = np.full(len(r.m), np.uint64(seed & 0xFFFFFFFF))
    left = lambda x, k: _turn(x, 64 - k)
    m1, m2 = (lambda k: left(k * _C1, 31) * _C2), (lambda k: left(k * _C2, 33) * _C1)
    for at in range(0, n - 15, 16):
        h1 = (left(h1 ^ m1(r.u64(at)), 27) + h2) * np.uint64(5) + np.uint64(0x52DCE729)
        h2 = (left(h2 ^ m2(r.u64(at + 8)), 31) + h1) * np.uint64(5) + np.uint64(0x38495AB5)
    if tail := n & 15:
        rest = np.zeros((len(r.m), 16), np.uint8)
        rest[:, :tail] = r.m[:, n - tail :]
        ends = _Rows(rest)
        h2, h1 = h2 ^ m2(ends.u64(8)) if tail > 8 else h2, h1 ^ m1(ends.u64(0))
    h1, h2 = h1 ^ np.uint64(n), h2 ^ np.uint64(n)
    h1 = h1 + h2
    h2 = h2 + h1

    def finish(k: np.ndarray) -> np.ndarray:
        k = (k ^ (k >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        k = (k ^ (k >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
        return k ^ (k >> np.uint64(33))

    return finish(h1) + finish(h2)


def hash_messages(messages: list[bytes], algorithm: Algorithm, seed: int | None = None) -> np.ndarray:
    """64-bit hashes as signed numbers; messages of one length are hashed together.

    farm takes a seed as four little-endian bytes before the message; murmur without a seed uses 0.
    """
    if algorithm is Algorithm.FARM and seed is not None:
        head = struct.pack("<i", seed)
        messages = [head + m for m in messages]
    out = np.zeros(len(messages), np.uint64)
    sizes = np.fromiter(map(len, messages), np.int64, len(messages))
    with np.errstate(over="ignore"):
        for n in np.unique(sizes):
            at = np.flatnonzero(sizes == n)
            rows = _Rows(np.frombuffer(b"".join(messages[i] for i in at), np.uint8).reshape(len(at), int(n)))
            out[at] = _farm(rows, int(n)) if algorithm is Algorithm.FARM else _murmur(rows, int(n), seed or 0)
    return out.view(np.int64)


def _layout(kind: T.DataType, encoding: ByteEncoding):
    """How a value of a type becomes bytes: numbers little-endian, whole ones as 64 bits, texts as UTF-8, no separators."""
    if isinstance(kind, T.ArrayType):
        inner = _layout(kind.elementType, encoding)
        return lambda v: b"".join(inner(x) for x in v if x is not None)
    if isinstance(kind, T.BooleanType):
        return lambda v: b"\x01" if v else b"\x00"
    if isinstance(kind, T.ByteType | T.ShortType | T.IntegerType | T.LongType):
        return lambda v: struct.pack("<q", v)
    if isinstance(kind, T.FloatType):
        return lambda v: struct.pack("<f", v)
    if isinstance(kind, T.DoubleType):
        return lambda v: struct.pack("<d", v)
    if isinstance(kind, T.BinaryType):
        return {ByteEncoding.RAW: bytes, ByteEncoding.HEX: lambda v: v.hex().encode(), ByteEncoding.BASE64: base64.b64encode}[encoding]
    if isinstance(kind, T.StringType):
        return str.encode
    raise ValueError(f"values of type {kind.simpleString()} cannot be hashed")


def fingerprint(df: DataFrame, fields: list[str], algorithm: str | Algorithm = Algorithm.FARM, seed: int | None = None, encoding: str | ByteEncoding = ByteEncoding.RAW) -> Column:
    """Hash of the fields of each row, in their order, as a long.  Nulls add nothing; arrays add their elements."""
    algorithm, encoding = Algorithm(algorithm), ByteEncoding(encoding)
    ship(df.sparkSession)
    columns, packers = [], []
    for path in fields:
        kind, column = field_at(df.schema, path).dataType, F.col(path)
        kind = df.select(column).schema[0].dataType
        while isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.ArrayType):
            column, kind = F.flatten(column), kind.elementType
        if isinstance(kind, T.DateType | T.TimestampType | T.TimestampNTZType):
            column, kind = column.cast("string"), T.StringType()
        columns.append(column)
        packers.append(_layout(kind, encoding))

    @F.arrow_udf("long")
    def run(*arrays: pa.Array) -> pa.Array:
        parts = [[b"" if v is None else pack(v) for v in a.to_pylist()] for a, pack in zip(arrays, packers, strict=True)]
        return pa.array(hash_messages([b"".join(x) for x in zip(*parts, strict=True)], algorithm, seed))

    return run(*columns)


def bound(hashed: Column) -> Column:
    """A signed 64-bit hash as a double from 0 to 1."""
    return (hashed.cast("double") + F.lit(2.0**63)) / F.lit(2.0**64 - 1)


def md5_roll(*parts: Column, seed: int = 0) -> Column:
    """A double in [0, 1) from 52 bits of md5; other engines compute the same.  Parts are separated; null is the text null."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(2.0**52)


def roll(df: DataFrame, fields: list[str], algorithm: str | Algorithm = Algorithm.FARM, seed: int | None = None, encoding: str | ByteEncoding = ByteEncoding.RAW) -> Column:
    """The number from 0 to 1 that a row's fields always get."""
    for path in fields:
        field_at(df.schema, path)
    if Algorithm(algorithm) is Algorithm.MD5:
        return md5_roll(*[F.col(p) for p in fields], seed=seed or 0)
    return bound(fingerprint(df, fields, algorithm, seed, encoding))


