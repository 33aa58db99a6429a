"""Line deduplication: documents probe sharded minimal perfect hashes of the distinct lines."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._space import Workspace, partitions
from ._text import LOWER, SPACE, chunks, mix, span_hashes, spans
from ._worker import lean

#: Keys in a shard; least count, and greatest number, of keys whose arrays every task holds itself; bits of the filter of the others.
SHARD, COMMON, MOST, FILTER = 1_000_000, 64, 100_000, 1 << 25
LEVELS = 48


def _keys(data: np.ndarray, offsets: np.ndarray, min_chars: int):
    """Text, line within the chunk, first line of the text, and two hashes, of every line that has a key long enough."""
    lower = LOWER[data]
    first, last, text = spans(lower, offsets, SPACE)
    breaks = np.concatenate(([0], np.cumsum(data == 10)))
    line = breaks[first]
    new = np.flatnonzero(np.concatenate(([True], (line[1:] != line[:-1]) | (text[1:] != text[:-1])))) if len(first) else np.zeros(0, np.int64)
    begin, end = first[new], last[np.concatenate((new[1:] - 1, [len(first) - 1]))] if len(new) else new
    if min_chars > 1 and len(new):
        points = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
        long = points[end] - points[begin] >= min_chars
        new, begin, end = new[long], begin[long], end[long]
    text = text[new]
    return text, line[new] - breaks[offsets[:-1]][text], span_hashes(lower, begin, end), span_hashes(lower, begin, end, 1)


def _once(*columns: np.ndarray) -> np.ndarray:
    """Order and then first places of the distinct tuples."""
    order = np.lexsort(columns)
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = np.any([c[order][1:] != c[order][:-1] for c in columns], axis=0)
    return order[new]


class PerfectHash:
    """Minimal perfect hash of distinct 128-bit keys, level by level: keys alone on their bit stay, others go on."""

    def __init__(self, levels: list[np.ndarray], rest: np.ndarray):
        self.levels, self.rest = levels, rest
        self.ranks = [np.concatenate((np.zeros(1, np.int32), np.cumsum(bits, dtype=np.int32))) for bits in levels]
        self.base = np.concatenate(([0], np.cumsum([int(r[-1]) for r in self.ranks]))).astype(np.int64)

    @staticmethod
    def _place(x: np.ndarray, y: np.ndarray, level: int, width: int) -> np.ndarray:
        return (mix(x + y * np.uint64(2 * level + 1)) % np.uint64(width)).astype(np.int64)

    @classmethod
    def build(cls, x: np.ndarray, y: np.ndarray) -> PerfectHash:
        levels: list[np.ndarray] = []
        while len(x) and len(levels) < LEVELS:
            width = len(x) + 7 & ~7
            at = cls._place(x, y, len(levels), width)
            alone = np.bincount(at, minlength=width) == 1
            levels.append(alone)
            x, y = x[~alone[at]], y[~alone[at]]
        return cls(levels, np.sort(x))

    def index(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Place of each key; any place, or -1, for a key that was not there when it was built."""
        out = np.full(len(x), -1, np.int64)
        todo = np.arange(len(x))
        for i, bits in enumerate(self.levels):
            if not len(todo):
                return out
            at = self._place(x[todo], y[todo], i, len(bits))
            hit = bits[at]
            out[todo[hit]] = self.base[i] + self.ranks[i][at[hit]]
            todo = todo[~hit]
        if len(self.rest) and len(todo):
            at = np.minimum(np.searchsorted(self.rest, x[todo]), len(self.rest) - 1)
            found = self.rest[at] == x[todo]
            out[todo[found]] = self.base[-1] + at[found]
        return out

    def pack(self) -> tuple[bytes, bytes]:
        return np.array([len(b) for b in self.levels], np.int64).tobytes() + b"".join(np.packbits(b).tobytes() for b in self.levels), self.rest.tobytes() + np.int64(len(self.levels)).tobytes()

    @classmethod
    def unpack(cls, packed: bytes, rest: bytes) -> PerfectHash:
        n = int(np.frombuffer(rest, np.int64)[-1])
        widths, at, levels = np.frombuffer(packed, np.int64, n), 8 * n, []
        for w in widths:
            levels.append(np.unpackbits(np.frombuffer(packed, np.uint8, int(w) // 8, at)).astype(bool))
            at += int(w) // 8
        return cls(levels, np.frombuffer(rest, np.uint64)[:-1])


def _count(min_chars: int):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            xs, ys = [], []
            for _, data, offsets in chunks(batch.column(0)):
                text, _, x, y = _keys(data, offsets, min_chars)
                one = _once(y, x, text)
                xs.append(x[one])
                ys.append(y[one])
            x, y = np.concatenate([*xs, np.zeros(0, np.uint64)]), np.concatenate([*ys, np.zeros(0, np.uint64)])
            order = np.lexsort((y, x))
            x, y = x[order], y[order]
            at = np.flatnonzero(np.concatenate(([True], (x[1:] != x[:-1]) | (y[1:] != y[:-1])))) if len(x) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(x[at].view(np.int64)), pa.array(y[at].view(np.int64)), pa.array(np.diff(np.append(at, len(x))))], ["x", "y", "c"])

    return run


def _build(min_docs: int):
    """Arrays of each shard, whose keys arrive together: fingerprints and counts in the order of the perfect hash.

    Counts beyond ``min_docs`` say no more than that number, so they stop there; their type follows from it.
    """
    kind = np.min_scalar_type(min_docs)

    def arrays(shard: int, held: list) -> pa.RecordBatch:
        x, y, c = (np.concatenate(v) for v in zip(*held, strict=True))
        x, y = x.view(np.uint64), y.view(np.uint64)
        table = PerfectHash.build(x, y)
        at = table.index(x, y)
        prints, counts = np.zeros(len(x), np.uint32), np.zeros(len(x), kind)
        prints[at], counts[at] = (y >> np.uint64(32)).astype(np.uint32), np.minimum(c, min_docs)
        levels, rest = table.pack()
        return pa.RecordBatch.from_pylist([{"shard": shard, "levels": levels, "rest": rest, "prints": prints.tobytes(), "counts": counts.tobytes()}])

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            shard, *rest = (c.to_numpy() for c in batch.columns)
            cut = np.flatnonzero(np.concatenate(([True], shard[1:] != shard[:-1]))) if len(shard) else []
            for lo, hi in zip(cut, [*cut[1:], len(shard)], strict=True) if len(shard) else ():
                if shard[lo] != now and held:
                    yield arrays(now, held)
                    held = []
                now = int(shard[lo])
                held.append(tuple(v[lo:hi] for v in rest))
        if held:
            yield arrays(now, held)

    return run


def _ask(common, shards: int, min_chars: int):
    """A row for each document and key that is not common but that the filter admits, for the shard that knows its count."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        *known, admitted = common.value
        for batch in batches:
            for row, data, offsets in chunks(batch.column(1)):
                text, _, x, y = _keys(data, offsets, min_chars)
                at = (y & np.uint64(FILTER - 1)).astype(np.int64)
                text, x, y = (v[(admitted[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool)] for v in (text, x, y))
                one = _once(y, x, text)
                one = one[~_in(known, x[one], y[one])]
                yield pa.RecordBatch.from_arrays([pa.array(x[one].view(np.int64) % shards), pa.array(x[one].view(np.int64)), pa.array(y[one].view(np.int64)), batch.column(0).take(pa.array(text[one] + row))], ["shard", "x", "y", "row"])

    return run


def _in(known, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    table, xs, ys = known
    if not len(xs):
        return np.zeros(len(x), bool)
    at = table.index(x, y)
    return (at >= 0) & (xs[at] == x) & (ys[at] == y)


def _answer(min_docs: int):
    """Arrays come first in each shard; each key that follows is looked up in them."""
    kind = np.min_scalar_type(min_docs)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, table, prints, counts = None, None, None, None
        for batch in batches:
            shards = batch.column(0).to_numpy()
            cut = np.flatnonzero(np.concatenate(([True], shards[1:] != shards[:-1]))) if len(shards) else []
            for lo, hi in zip(cut, [*cut[1:], len(shards)], strict=True) if len(shards) else ():
                if shards[lo] != now:
                    now = shards[lo]
                    levels, rest, prints, counts = (batch.column(i)[int(lo)].as_py() for i in (4, 5, 6, 7))
                    table, prints, counts = PerfectHash.unpack(levels, rest), np.frombuffer(prints, np.uint32), np.frombuffer(counts, kind)
                    lo += 1
                part = batch.slice(int(lo), int(hi - lo))
                if not part.num_rows:
                    continue
                x, y = (part.column(i).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) for i in (1, 2))
                at = table.index(x, y)
                drop = (at >= 0) & (prints[at] == (y >> np.uint64(32)).astype(np.uint32)) & (counts[at] >= min_docs)
                yield pa.RecordBatch.from_arrays([part.column(3).filter(pa.array(drop)), part.column(1).filter(pa.array(drop))], ["row", "x"])

    return run


def _keep(common, min_chars: int, text_at: int, names: list[str]):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = common.value[:3]
        for batch in batches:
            drops = batch.column(batch.num_columns - 1).to_pylist()
            n_lines, n_dropped, kept = [], [], []
            for row, data, offsets in chunks(batch.column(text_at)):
                text, line, x, y = _keys(data, offsets, min_chars)
                gone = _in(known, x, y)
                bounds = np.searchsorted(text, np.arange(len(offsets)))
                signed = x.view(np.int64)
                for i in range(len(offsets) - 1):
                    lo, hi = bounds[i], bounds[i + 1]
                    own = gone[lo:hi]
                    if drops[row + i]:
                        own = own | np.isin(signed[lo:hi], drops[row + i])
                    body = data[offsets[i] : offsets[i + 1]].tobytes()
                    if own.any():
                        lines = body.split(b"\n")
                        out = set(line[lo:hi][own].tolist())
                        body = b"\n".join(x for j, x in enumerate(lines) if j not in out)
                        n_lines.append(len(lines))
                        n_dropped.append(len(out))
                    else:
                        n_lines.append(body.count(b"\n") + 1)
                        n_dropped.append(0)
                    kept.append(body)
            columns = list(batch.columns[:-1])
            columns[text_at] = pa.array(kept, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())], names)

    return run


def _filter(counts: DataFrame, min_docs: int, below: int) -> np.ndarray:
    """Flags, by a part of the hash, of the keys that are found often enough but not held by every task."""
    at = F.col("y").bitwiseAND(F.lit(FILTER - 1))
    bits = F.bit_or(F.expr(f"shiftleft(1L, cast((y & {FILTER - 1}) & 63 as int))"))
    words = counts.where((F.col("c") >= min_docs) & (F.col("c") < below)).groupBy(F.shiftright(at, 6).cast("int").alias("w")).agg(bits.alias("m")).toArrow()
    flags = np.zeros(FILTER // 64, np.uint64)
    flags[words["w"].to_numpy()] = words["m"].to_numpy().view(np.uint64)
    return flags


def dedup_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """``docs`` with ``text`` less the lines that many documents share, and n_lines and n_dropped (long).

    The text is split at \\n; a null or empty one is one empty line, and its kept text is empty.  A line's key is the
    line stripped of ASCII white space at both ends, with A-Z lower-cased.  Keys of ``min_chars`` code points or more
    found in ``min_docs`` rows or more lose all their lines in every row; lines with shorter keys stay.  Each row
    counts as a document, also when rows repeat or doc_id is null.  Other columns pass through; columns of the
    input called n_lines or n_dropped are replaced.  Lines of any length are hashed whole.  An empty table gives an
    empty result.

    Keys are known by 128 hash bits.  Counts of all distinct keys are dealt to shards; each shard has a minimal
    perfect hash that indexes 32-bit fingerprints and counts.  Documents probe it only for keys that a filter of fixed
    size admits as found often enough.  The keys found most often, 100,000 at most, have their perfect hash in each
    task, so no shard gets a hot key's rows.
    """
    spark = docs.sparkSession
    space = Workspace(spark, "lines")
    docs = docs.drop("n_lines", "n_dropped")
    docs = docs.withColumn("text", F.col("text").cast("string"))
    counts = space.put(docs.select("text").mapInArrow(_count(min_chars), "x long, y long, c long").groupBy("x", "y").agg(F.sum("c").alias("c")), "counts")
    size = counts.agg(F.count("*").alias("keys"), F.sum("c").alias("lines")).first()
    shards = int(max(partitions(spark), size.keys // SHARD))
    often = max(COMMON, min_docs, (size.lines or 0) // MOST + 1)  # so MOST keys at most are found as often
    hot = counts.where(F.col("c") >= often).select("x", "y").toArrow()
    xs, ys = (hot[k].to_numpy().view(np.uint64) for k in ("x", "y"))
    table = PerfectHash.build(xs, ys)
    place = np.argsort(table.index(xs, ys))
    common = spark.sparkContext.broadcast((table, xs[place], ys[place], _filter(counts, min_docs, often)))
    dealt = counts.select(F.pmod("x", F.lit(shards)).cast("long").alias("shard"), "x", "y", "c")
    arrays = space.put(dealt.repartition(shards, "shard").sortWithinPartitions("shard").mapInArrow(_build(min_docs), "shard long, levels binary, rest binary, prints binary, counts binary"), "arrays")
    # A key that is dropped is dropped in every row, so rows that this hash does not tell apart may share what they drop.
    row = F.xxhash64("doc_id", "text")
    asked = docs.select(row.alias("row"), "text").mapInArrow(_ask(common, shards, min_chars), "shard long, x long, y long, row long")
    both = arrays.selectExpr("shard", "cast(null as long) x", "cast(null as long) y", "cast(null as long) row", "levels", "rest", "prints", "counts").unionByName(asked, allowMissingColumns=True)
    met = both.repartition(shards, "shard").sortWithinPartitions("shard", F.col("x").isNotNull())
    drops = space.put(met.mapInArrow(_answer(min_docs), "row long, x long").groupBy("row").agg(F.collect_set("x").alias("_gone")), "drops")
    names = docs.columns
    joined = docs.alias("d").hint("merge").join(drops.alias("g"), F.xxhash64("d.doc_id", "d.text") == F.col("g.row"), "left").select(*[F.col(f"d.`{c}`") for c in names], F.col("g._gone"))
    schema = docs.schema.add("n_lines", "long").add("n_dropped", "long")
    return joined.mapInArrow(_keep(common, min_chars, names.index("text"), schema.names), schema)


#: The same for DuckDB, with the query's parameters.
ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
s AS (SELECT k, i, l[i] AS line, translate(trim(l[i], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM d, unnest(range(1, len(l) + 1)) u(i)),
f AS (SELECT key FROM (SELECT DISTINCT k, key FROM s WHERE key <> '') GROUP BY key HAVING count(*) >= 10),
m AS (SELECT s.*, f.key IS NOT NULL AS gone FROM s LEFT JOIN f ON s.key = f.key)
SELECT any_value(d.doc_id) AS doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM m JOIN d ON m.k = d.k GROUP BY m.k
"""
