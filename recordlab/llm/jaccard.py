"""N-gram Jaccard join: size-banded tiles, hashed bitmap signatures, exact sorted-array intersection."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from ._space import Workspace, partitions, row_key
from ._text import mix, shingle_sets
from ._worker import lean
from .components import components

#: Least number of sets that makes a shingle frequent, most such shingles (the least number rises to hold it).
FREQUENT, MOST = 16, 1_000_000
#: Postings in a bucket, least number of buckets, sets in a piece of a tile, members checked against one copy of a set, bits of the filter of fixed size.
BUCKET, BUCKETS, PIECE, CHUNK, BLOOM = 500_000, 256, 50_000, 64, 1 << 26
#: Rounds, before the pairs across components meet, in which a member meets a few of its tile's largest component; they
#: are run while a member of a tile would meet so many others on average.
ROUNDS, SOME, CROWDED = 4, 4, 1000
#: Members on a side of a cell, fewest and most (a 64th of a group in between); shingles of all members on a side.
SIDE, SIDES, WEIGHT = 128, 2048, 1_000_000
#: Bits of the short name of a set beside its last eight, which tell its size: each class of sizes is wider by STEP.
NAME, STEP = 56, 1.06


@dataclass(frozen=True)
class _Names:
    """Sets are known by 128 bits, and called by ``bits`` of these and their class of sizes, or by what stands for that
    where several sets share it."""

    bits: int
    twins: dict[tuple[int, int], int]

    def whole(self, tokens: np.ndarray) -> tuple[int, int]:
        h = xxhash.xxh3_128_intdigest(tokens.tobytes())
        size = min(255, int(math.log(len(tokens)) / math.log(STEP)))
        return ((h >> (128 - self.bits)) - (1 << self.bits - 1)) * 256 + size, (h & ((1 << 64) - 1)) - (1 << 63)

    def ref(self, tokens: np.ndarray) -> int:
        name = self.whole(tokens)
        return self.twins.get(name, name[0])


def _apart(percent: int) -> int:
    """How far the classes of two sets that link are apart at most."""
    return int(math.log(100 / percent) / math.log(STEP)) + 1


def _bits(tokens: np.ndarray) -> bytes:
    """Parity signature: each bit tells whether an odd number of shingles fell on it."""
    width = min(8192, max(64, 2 << (len(tokens) - 1).bit_length()))
    odd = np.bincount((tokens & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


class _Signatures:
    """Parity signatures of many sets, folded to a common width on demand."""

    def __init__(self, n: np.ndarray, bits: list[bytes]):
        self.n, self.width = n.astype(np.int64), np.array([len(b) for b in bits], np.int64)
        self.own = {w: np.flatnonzero(self.width == w) for w in np.unique(self.width).tolist()}
        self.folded = {w: np.frombuffer(b"".join(bits[i] for i in at.tolist()), np.uint64).reshape(len(at), -1) for w, at in self.own.items()}
        self.at: dict[int, np.ndarray] = {}

    def _level(self, width: int) -> np.ndarray:
        if width not in self.at:
            out = np.zeros((len(self.n), width // 8), np.uint64)
            for w, rows in self.own.items():
                if w >= width:
                    x = self.folded[w]
                    while x.shape[1] * 8 > width:
                        x = x[:, : x.shape[1] // 2] ^ x[:, x.shape[1] // 2 :]
                    out[rows] = x
            self.at[width] = out
        return self.at[width]

    def most(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Upper bound of each pair's overlap: as many shingles at least are in one set only as bits differ."""
        width, out = np.minimum(self.width[i], self.width[j]), np.zeros(len(i), np.int64)
        for w in np.unique(width).tolist():
            at, level = np.flatnonzero(width == w), self._level(w)
            step = max(1, (1 << 19) // level.shape[1])
            for lo in range(0, len(at), step):
                part = at[lo : lo + step]
                differ = np.bitwise_count(level[i[part]] ^ level[j[part]]).sum(1, dtype=np.int64)
                out[part] = (self.n[i[part]] + self.n[j[part]] - differ) // 2
        return out

    def may_link(self, i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
        most = self.most(i, j)
        return 100 * most >= percent * (self.n[i] + self.n[j] - most)


def _overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted arrays."""
    if len(a) > len(b):
        a, b = b, a
    return int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())


def _links(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    common = _overlap(a, b)
    return 100 * common >= percent * (len(a) + len(b) - common)


def _keys(names: _Names, columns: list[str]):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: set[tuple[int, int]] = set()
        for batch in batches:
            rows = batch.num_rows
            n, ref, alt, bits = np.zeros(rows, np.int32), np.zeros(rows, np.int64), np.zeros(rows, np.int64), [None] * rows
            seen: dict[tuple[int, int], np.ndarray] = {}
            for i, tokens in shingle_sets(batch.column(1)):
                name = names.whole(tokens)
                n[i], (ref[i], alt[i]) = len(tokens), name
                if name not in held:
                    held.add(name)
                    bits[i] = _bits(tokens)
                seen.setdefault(name, tokens)
            often: list[bytes | None] = [None] * rows
            if seen:
                tokens = np.concatenate(list(seen.values()))
                seen.clear()
                tokens.sort()
                again = np.flatnonzero(tokens[1:] == tokens[:-1])  # shingles of one set in the batch are not counted
                tokens, counts = np.unique(tokens[again], return_counts=True)
                often[0] = np.stack([tokens.view(np.int64), counts + 1]).tobytes()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(ref, mask=n == 0), pa.array(alt, mask=n == 0), pa.array(bits, pa.binary()), pa.array(often, pa.binary()), *batch.columns[2:]], columns)

    return run


@lean
def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for packed in batch.column(0).to_pylist():
            tokens, counts = np.frombuffer(packed, np.int64).reshape(2, -1)
            yield pa.RecordBatch.from_arrays([pa.array(tokens), pa.array(counts)], ["token", "c"])


def _bands(n: int, percent: int) -> list[int]:
    """The band of sizes that a set of ``n`` shingles is in, powers of four, and the next where a partner can be there."""
    band = (n.bit_length() - 1) // 2
    return [band, band + 1] if n * 100 // percent >= 4 ** (band + 1) else [band]


def _slices(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The same rows, fewer at once."""
    for batch in batches:
        for lo in range(0, batch.num_rows, rows):
            yield batch.slice(lo, rows)


def _postings(buckets: int, frequent, names: _Names, percent: int, piece: int):
    """Prefixes, in each of their bands: the first tokens of a set, rare ones first, of which two linked sets share one at least.

    Postings of a token that more than ``piece`` sets have are dealt to pieces by the set, each in a row of its own
    that names the tile.
    """

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        late, often_by = frequent.value
        seen: set[int] = set()
        for batch in _slices(batches, 2500):
            prefixes: list[np.ndarray] = []
            refs: list[int] = []
            times_of: list[np.ndarray] = []
            for _, tokens in shingle_sets(batch.column(0)):
                ref = names.ref(tokens)
                if ref in seen:
                    continue
                seen.add(ref)
                n = len(tokens)
                wanted = n - -(-percent * n // 100) + 1
                times = np.zeros(n, np.int64)
                if len(late):
                    at = np.minimum(np.searchsorted(late, tokens), len(late) - 1)
                    often = late[at] == tokens
                    times[often] = often_by[at[often]]
                    order = np.lexsort((tokens, times))[:wanted]
                    tokens, times = tokens[order], times[order]
                for band in _bands(n, percent):
                    prefixes.append(tokens[:wanted] ^ mix(np.array([band + 1], np.uint64)))
                    refs.append(ref)
                    times_of.append(times[:wanted])
            if not refs:
                continue
            key = np.concatenate(prefixes)
            ref = np.repeat(np.array(refs, np.int64), [len(x) for x in prefixes])
            bucket = (key % np.uint64(buckets)).astype(np.int64)
            rest = (key >> np.uint64(32)).astype(np.uint32)
            own = np.full(len(key), -1, np.int64)
            hot = np.flatnonzero(np.concatenate(times_of) >= piece)
            if len(hot):
                own[hot] = (bucket[hot] << 32) | rest[hot].astype(np.int64)
                split = np.concatenate(times_of)[hot] // piece + 1
                bucket[hot] = (bucket[hot] + (mix(ref[hot].view(np.uint64)) % split.astype(np.uint64)).astype(np.int64) * 7919) % buckets
            del key, prefixes, times_of
            order = np.lexsort((own, bucket))
            bucket, rest, ref, own = bucket[order], rest[order], ref[order], own[order]
            start = np.flatnonzero(np.concatenate(([True], (bucket[1:] != bucket[:-1]) | (own[1:] != own[:-1]))))
            ends = [*start[1:].tolist(), len(bucket)]
            for lo in range(0, len(start), 256):
                some = range(lo, min(lo + 256, len(start)))
                yield pa.RecordBatch.from_arrays([
                    pa.array(bucket[start[lo : lo + 256]]), pa.array(own[start[lo : lo + 256]]),
                    pa.array([b"" if own[start[i]] >= 0 else rest[start[i] : ends[i]].tobytes() for i in some], pa.binary()),
                    pa.array([ref[start[i] : ends[i]].tobytes() for i in some], pa.binary()),
                ], ["bucket", "own", "rest", "refs"])

    return run


TILES = "tile long, ref long, center long, hub long, before long, members int, piece boolean"


def _tile(tile: np.ndarray, refs: np.ndarray, piece: bool, apart: int) -> pa.RecordBatch | None:
    """Rows of the tiles with two members or more (or of one piece of a tile), each with its tile's smallest member and,
    where their sizes allow a link, that again as its hub and the member before it; else itself."""
    order = np.lexsort((refs, tile))
    tile, refs = tile[order], refs[order]
    new = np.concatenate(([True], (tile[1:] != tile[:-1]) | (refs[1:] != refs[:-1])))
    tile, refs = tile[new], refs[new]
    start = np.flatnonzero(np.concatenate(([True], tile[1:] != tile[:-1])))
    size = np.diff(np.concatenate((start, [len(tile)])))
    least = 1 if piece else 2
    if not (size >= least).any():
        return None
    sign = np.add.reduceat((refs.view(np.uint64) ^ (refs.view(np.uint64) >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9), start) + size.astype(np.uint64)
    one = np.zeros(len(start), bool)  # groups of the same members are kept once
    one[np.unique(np.where(size >= least, sign, 0), return_index=True)[1]] = True
    keep = np.repeat(one & (size >= least), size)
    center, before = np.repeat(refs[start], size), np.concatenate((refs[:1], refs[:-1]))
    before[start] = refs[start]
    members = np.repeat(size, size).astype(np.int32)
    hub, before = (np.where(np.abs((x & 255) - (refs & 255)) <= apart, x, refs) for x in (center, before))
    return pa.RecordBatch.from_arrays([*(pa.array(x[keep]) for x in (tile, refs, center, hub, before, members)), pa.array(np.full(int(keep.sum()), piece))], ["tile", "ref", "center", "hub", "before", "members", "piece"])


def _tiles(apart: int):
    """Groups the postings of each bucket, which arrive together, by token."""

    def grouped(held: list, hot: dict) -> Iterator[pa.RecordBatch]:
        if held and (out := _tile(np.concatenate([x for x, _ in held]), np.concatenate([y for _, y in held]), False, apart)) is not None:
            yield out
        for tile, refs in hot.items():
            refs = np.concatenate(refs)
            yield _tile(np.full(len(refs), tile), refs, True, apart)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, hot = None, [], {}
        for batch in batches:
            for bucket, own, rest, refs in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if bucket != now:
                    yield from grouped(held, hot)
                    now, held, hot = bucket, [], {}
                refs = np.frombuffer(refs, np.int64)
                if own >= 0:
                    hot.setdefault(own, []).append(refs)
                else:
                    held.append(((np.int64(bucket) << 32) | np.frombuffer(rest, np.uint32).astype(np.int64), refs))
        yield from grouped(held, hot)

    return run


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each cell, which arrive together and are bounded."""
    held: list[pa.RecordBatch] = []
    now = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cell = batch.column(0).to_numpy()
        cut = np.flatnonzero(cell[1:] != cell[:-1]) + 1
        for lo, hi in zip([0, *cut.tolist()], [*cut.tolist(), len(cell)], strict=True):
            if cell[lo] != now and held:
                yield pa.Table.from_batches(held).combine_chunks()
                held = []
            now = cell[lo]
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


class _Cell:
    """Members of a cell by size, the tiles that they share, and what is known of their pairs."""

    def __init__(self, rows: pa.Table, percent: int):
        self.percent = percent
        rows = rows.take(pa.array(np.lexsort((rows.column("ref").to_numpy(), rows.column("n").to_numpy()))))
        self.rows, (self.n, self.ref, self.comp, self.part) = rows, (rows.column(c).to_numpy() for c in ("n", "ref", "comp", "part"))
        self.signs = _Signatures(self.n, rows.column("bits").to_pylist())
        self.label = np.unique(self.comp, return_inverse=True)[1]
        self.done = np.zeros((len(self.n),) * 2, bool)
        self.top = np.searchsorted(self.n, self.n.astype(np.int64) * 100 // percent, "right")

    def pairs(self, settled=None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Blocks of pairs in different components that share a tile, have sizes and signatures that can link, and did
        not come before; pairs of members that are both ``settled`` are left out."""
        lists = self.rows.column("tiles").combine_chunks()
        tile = lists.flatten().to_numpy()
        who = np.repeat(np.arange(len(self.n)), np.diff(lists.offsets.to_numpy()))
        order = np.lexsort((who, tile))
        tile, who = tile[order], who[order]
        cut = np.flatnonzero(tile[1:] != tile[:-1]) + 1
        known: set[bytes] = set()
        for lo, hi in zip([0, *cut.tolist()], [*cut.tolist(), len(tile)], strict=True):
            group = who[lo:hi]
            if hi - lo < 2 or group.tobytes() in known:
                continue
            known.add(group.tobytes())
            step = max(1, (1 << 18) // (hi - lo))
            for at in range(0, hi - lo, step):
                i, j = group[at : at + step, None], group[None, at:]
                ok = (j > i) & (j < self.top[i]) & (self.label[i] != self.label[j]) & ~self.done[i, j] & ((self.part[i] != self.part[j]) | (self.part[i] < 0))
                if settled is not None:
                    ok &= ~(settled[i] & settled[j])
                if not ok.any():
                    continue
                a, b = np.nonzero(ok)
                a, b = i[a, 0], j[0, b]
                self.done[a, b] = True
                ok = self.signs.may_link(a, b, self.percent)
                if ok.any():
                    yield a[ok], b[ok]


def _stirred(percent: int):
    """Members of each cell that have a partner in another component whose signature leaves room for a link."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _runs(batches):
            cell = _Cell(rows, percent)
            hit = np.zeros(len(cell.n), bool)
            for a, b in cell.pairs(hit):
                hit[a] = hit[b] = True
            if hit.any():
                yield pa.RecordBatch.from_arrays([pa.array(cell.rows.column("center").to_numpy()[hit]), pa.array(cell.ref[hit])], ["center", "ref"])

    return run


def _joined(percent: int):
    """Components that an exact link joins; what a cell has joined is not compared again, so it gives fewer rows than members."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _runs(batches):
            cell = _Cell(rows, percent)
            sets = [np.frombuffer(x, np.uint64) for x in cell.rows.column("tokens").to_pylist()]
            out: list[tuple[int, int]] = []
            for a, b in cell.pairs():
                for i, j in zip(a.tolist(), b.tolist(), strict=True):
                    if cell.label[i] != cell.label[j] and _links(sets[i], sets[j], percent):
                        out.append((int(cell.comp[i]), int(cell.comp[j])))
                        cell.label[cell.label == cell.label[j]] = cell.label[i]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], ["a", "b"])

    return run


def _cells(space: Workspace, rows: DataFrame, name: str, more: DataFrame | None = None) -> DataFrame:
    """``rows`` (center, ref, comp, n, ...), and ``more`` by ref, dealt to cells, with ``cell`` first and ``part`` last.

    The members of tiles with one centre make a cell.  Where they are many, or their sets are large, those of the
    largest component and the others are cut into sides of bounded size; each side of the others meets each other
    side in a cell of its own, and the sides of the largest component never meet one another.
    """
    by_comp = rows.groupBy("center", "comp").agg(F.count("*").alias("c"), F.sum("n").alias("w"))
    of = by_comp.groupBy("center").agg(F.max(F.struct("c", "comp", "w")).alias("main"), F.sum("c").alias("c"), F.sum("w").alias("w"))
    side = F.greatest(F.lit(SIDE), F.least(F.lit(SIDES), F.col("c") / 64))
    sides = lambda c, w: F.greatest(F.lit(1), F.ceil(c / side), F.ceil(w / WEIGHT))
    large = of.where((F.col("c") > 2 * SIDE) | (F.col("w") > 2 * WEIGHT)).select(
        F.col("center").alias("_center"), F.col("main.comp").alias("_main"),
        sides(F.col("main.c"), F.col("main.w")).alias("_mains"), sides(F.col("c") - F.col("main.c"), F.col("w") - F.col("main.w")).alias("_others"),
    )
    large = space.put(large, f"{name}-large", True)
    if more is not None:
        rows = rows.hint("merge").join(more, "ref")
    met = rows.join(large, F.col("center") == F.col("_center"), "left")
    draw = F.xxhash64("ref", F.lit(1))
    i, k = F.pmod(draw, F.col("_others")), F.pmod(draw, F.col("_mains"))
    cell = lambda kind, x, y: F.xxhash64("center", F.lit(kind), x, y)
    one = lambda x, part: F.struct(x.alias("cell"), part.cast("int").alias("part"))
    every = lambda n, f: F.transform(F.sequence(F.lit(0).cast("long"), F.col(n) - 1), f)
    of_main = every("_others", lambda x: one(cell(0, x, k), F.lit(0)))
    of_rest = F.concat(
        every("_mains", lambda x: one(cell(0, i, x), F.lit(1))),
        every("_others", lambda x: one(cell(1, F.least(i, x), F.greatest(i, x)), F.when(i == x, -1).when(i < x, 0).otherwise(1))),
    )
    alone = F.array(one(F.col("center"), F.lit(-1)))
    where = F.when(F.col("_center").isNull(), alone).when(F.col("comp") == F.col("_main"), of_main).otherwise(of_rest)
    dealt = met.select(F.explode(where).alias("_at"), *rows.columns).select("_at.cell", *rows.columns, "_at.part")
    return dealt.repartition(partitions(space.spark), "cell").sortWithinPartitions("cell")


def _bounded(percent: int):
    """Pairs whose signatures leave room for enough common shingles."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, n, m, x, y = batch.columns
            signs = _Signatures(np.concatenate([n.to_numpy(), m.to_numpy()]), x.to_pylist() + y.to_pylist())
            at = np.arange(batch.num_rows)
            ok = pa.array(signs.may_link(at, at + batch.num_rows, percent))
            yield pa.RecordBatch.from_arrays([a.filter(ok), b.filter(ok)], ["a", "b"])

    return run


def _arrays(bloom, names: _Names):
    """Sorted arrays of the sets that the filter admits, each once a task."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = bloom.value
        seen: set[int] = set()
        for batch in batches:
            refs, sets, size = [], [], 0
            for _, tokens in shingle_sets(batch.column(0)):
                ref = names.ref(tokens)
                at = ref >> 8 & (BLOOM - 1)
                if ref not in seen and int(flags[at >> 6]) >> (at & 63) & 1:
                    seen.add(ref)
                    refs.append(ref)
                    sets.append(tokens.tobytes())
                    size += len(sets[-1])
                    if size > 8 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(refs, pa.int64()), pa.array(sets, pa.binary())], ["ref", "tokens"])
                        refs, sets, size = [], [], 0
            if refs:
                yield pa.RecordBatch.from_arrays([pa.array(refs, pa.int64()), pa.array(sets, pa.binary())], ["ref", "tokens"])

    return run


def _flags(refs: DataFrame):
    """A filter of fixed size that admits the sets that ``refs`` names, and few others."""
    at = F.shiftright("ref", 8).bitwiseAND(F.lit(BLOOM - 1))
    words = refs.groupBy(F.shiftright(at, 6).cast("int").alias("w")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(shiftright(ref, 8) & 63 as int))")).alias("m")).toArrow()
    flags = np.zeros(BLOOM // 64, np.uint64)
    flags[words["w"].to_numpy()] = words["m"].to_numpy().view(np.uint64)
    return refs.sparkSession.sparkContext.broadcast(flags)


def _admitted(bloom):
    """The arrays that the filter admits; the others are not shuffled."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = bloom.value
        for batch in batches:
            at = batch.column(0).to_numpy() >> 8 & (BLOOM - 1)
            yield batch.filter(pa.array((flags[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool)))

    return run


def _checked(percent: int):
    """Exact check of each member against its centre, which comes first in its chunk."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, center, last = None, np.zeros(0, np.uint64), None
        for batch in batches:
            got: list[tuple[int, int]] = []
            for a, part, b, tokens in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = np.frombuffer(tokens, np.uint64)
                if b is None:
                    now, center, last = (a, part), own, None
                    continue
                assert now == (a, part)
                if b != last and _links(own, center, percent):  # an array comes once for each task that met its set
                    got.append((a, b))
                last = b
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in got], pa.int64()), pa.array([x[1] for x in got], pa.int64())], ["a", "b"])

    return run


def _candidates(space: Workspace, reps: DataFrame, pairs: DataFrame, percent: int, name: str) -> DataFrame:
    """Pairs whose sizes and signatures leave room for a link."""
    own = lambda k: reps.select(F.col("ref").alias(k), F.col("n").alias(f"n{k}"), F.col("bits").alias(f"bits{k}"))
    sized = pairs.join(own("a"), "a").join(own("b"), "b").where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
    return space.put(sized.select("a", "b", "na", "nb", "bitsa", "bitsb").mapInArrow(_bounded(percent), "a long, b long"), f"{name}-bounded")


def _verify(space: Workspace, left: DataFrame, arrays: DataFrame, percent: int, name: str) -> DataFrame:
    many = left.groupBy("a").count().where(F.col("count") > CHUNK)
    parted = left.join(many, "a", "left").select("a", "b", F.pmod(F.xxhash64("b"), F.coalesce(F.ceil(F.col("count") / CHUNK), F.lit(1))).alias("part"))
    centers = parted.select(F.col("a").alias("ref"), "a", "part", F.lit(None).cast("long").alias("b")).distinct()
    roles = space.put(centers.unionByName(parted.select(F.col("b").alias("ref"), "a", "part", "b")), f"{name}-roles", True)
    arrays = arrays.mapInArrow(_admitted(_flags(roles.select("ref"))), arrays.schema)
    met = roles.hint("merge").join(arrays, "ref").select("a", "part", "b", "tokens").repartition(partitions(space.spark), "a", "part").sortWithinPartitions("a", "part", "b")
    return space.put(met.mapInArrow(_checked(percent), "a long, b long"), f"{name}-links")


def _renamed(keys: DataFrame, reps: DataFrame) -> tuple[DataFrame, dict[tuple[int, int], int]]:
    """Keys in which different sets that share their short names have different ones, and these names.

    Of N sets that all are of one size about N * N / 2 ** 57 share them: some hundreds of ten billion.
    """
    shared = reps.where("least <> most").select("ref", "least")
    rows = keys.select("ref", "alt").join(shared, "ref").where("alt <> least").distinct().withColumn("name", F.expr("(xxhash64(ref, alt) & -256) | (ref & 255)")).collect()
    twins = {(r.ref, r.alt): r.name for r in rows}
    if twins:
        names = keys.sparkSession.createDataFrame([(*k, v) for k, v in twins.items()], "ref long, alt long, _name long")
        keys = keys.join(names, ["ref", "alt"], "left").withColumn("ref", F.coalesce("_name", "ref")).drop("_name")
    return keys, twins


def _sum(column: Column) -> Column:
    return F.coalesce(F.sum(column), F.lit(0))


def near_duplicates(docs: DataFrame, percent: int = 75, keep: tuple[str, ...] = (), group: bool = False) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of ``docs`` (doc_id, text; of other columns those in ``keep``).

    A document's set holds the distinct five-word shingles of its text, A-Z lower-cased; with fewer words the whole
    sequence is one shingle; a text without words, or a null one, has an empty set, links with nothing and is its own
    component.  Shingles are known by 64 hash bits, sets by 128.  Two sets link when their Jaccard similarity is
    ``percent`` hundredths or more; links are exact and none is lost:

    1. equal sets are one node, so copies are never paired;
    2. two linked sets share a token of their prefixes (frequent shingles last) within a band of sizes, which makes the
       tiles; each member of a tile is checked against its smallest member and the one before it, and what links
       becomes components;
    3. where tiles could still make many pairs, members meet a few of the tile's largest component, for some rounds;
    4. members of a tile that are in different components meet in cells of bounded size.  A first pass over signatures
       leaves the members that have a partner whose overlap, bounded by the bits, suffices; a second intersects their
       sorted arrays, joins components as it finds links, and gives one row for each component joined.

    Repeated rows each get a row; a null doc_id takes part and never is a component's id unless all are null.  With
    ``group`` a column of that name tells components apart, also those; it is null for empty sets.  An empty table
    gives an empty result.
    """
    spark = docs.sparkSession
    space = Workspace(spark, "jaccard")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *[F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(keep)])
    schema = T.StructType().add("doc_id", "long").add("n", "integer").add("ref", "long").add("alt", "long").add("bits", "binary").add("often", "binary")
    schema = T.StructType([*schema.fields, *docs.schema.fields[2:]])
    keys = space.put(docs.mapInArrow(_keys(_Names(NAME, {}), schema.names), schema), "keys")

    def sets(keys: DataFrame, name: str) -> DataFrame:
        best = [F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("bits", True).alias("bits"), F.min("alt").alias("least"), F.max("alt").alias("most")]
        return space.put(keys.where("n > 0").groupBy("ref").agg(*best), name)

    reps = sets(keys, "reps")
    total = reps.agg(_sum(F.col("n") - F.ceil(F.col("n") * percent / 100) + 1).alias("postings"), F.count_if(F.col("least") != F.col("most")).alias("shared")).first()
    twins: dict[tuple[int, int], int] = {}
    if total.shared:
        keys, twins = _renamed(keys, reps)
        reps = sets(keys, "reps-renamed")
    names = _Names(NAME, twins)
    counted = keys.where("often is not null").select("often").mapInArrow(_counts, "token long, c long").groupBy("token").agg(F.sum("c").alias("c"))
    often = space.put(counted.where(F.col("c") >= FREQUENT), "often", True)
    least = FREQUENT  # rises until the shingles that count as frequent are MOST at most, which bounds what is broadcast
    while often.where(F.col("c") >= least).count() > MOST:
        least *= 2
    late = often.where(F.col("c") >= least).toArrow()
    tokens, times = late["token"].to_numpy().view(np.uint64), late["c"].to_numpy()
    order = np.argsort(tokens)
    frequent = spark.sparkContext.broadcast((tokens[order], times[order].astype(np.int64)))
    parts = int(max(partitions(spark), total.postings // BUCKET))
    buckets = max(BUCKETS, 2 * parts)  # several a partition, so that these come out even
    dealt = docs.select("text").mapInArrow(_postings(buckets, frequent, names, percent, PIECE), "bucket long, own long, rest binary, refs binary")
    tiles = space.put(dealt.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(_tiles(_apart(percent)), TILES), "tiles")
    # The smallest members of a tile's pieces meet the smallest of all.
    tops = tiles.where("piece").groupBy("tile").agg(F.min("center").alias("top"), F.count("*").alias("whole"))
    tops = space.put(tops, "tops", True)
    near = tiles.select(F.explode(F.array("hub", "before")).alias("a"), F.col("ref").alias("b"))
    near = near.unionByName(tiles.where("piece and ref = center").join(tops, "tile").select(F.col("top").alias("a"), F.col("ref").alias("b")))
    left = _candidates(space, reps, near.where("a <> b").distinct(), percent, "near")
    # Tiles of three members have met all pairs by now.
    large = tiles.where("piece or members > 3").join(tops, "tile", "left").select("tile", "ref", F.coalesce("top", "center").alias("center"))
    large = space.put(large, "large")
    need = left.select(F.explode(F.array("a", "b")).alias("ref")).unionByName(large.select("ref"))
    # Written once; whatever intersects arrays later reads them here.
    arrays = space.put(docs.select("text").mapInArrow(_arrays(_flags(need), names), "ref long, tokens binary"), "arrays")
    links = _verify(space, left, arrays, percent, "near")
    for turn in range(ROUNDS + 1):
        comps = components(space, links, f"cc{turn}").withColumnRenamed("node", "ref")
        known = space.put(large.join(comps, "ref", "left").select("tile", "ref", "center", F.coalesce("comp", "ref").alias("comp")), f"known{turn}")
        counts = known.groupBy("tile", "comp").agg(F.count("*").alias("c"))
        size, within = F.sum("c").cast("double"), F.sum(F.col("c").cast("double") * F.col("c"))
        found = counts.groupBy("tile").agg(F.count("*").alias("comps"), size.alias("size"), ((size * size - within) / 2).alias("pairs"), F.max(F.struct("c", "comp"))["comp"].alias("main"))
        unsettled = space.put(found.where("comps > 1"), f"unsettled{turn}", True)
        open_ = unsettled.agg(_sum(F.col("size")).alias("rows"), _sum(F.col("pairs")).alias("pairs")).first()
        if turn == ROUNDS or open_.pairs <= CROWDED * open_.rows:
            break
        met = known.join(unsettled.select("tile", "main"), "tile")
        picks = met.where("comp = main").groupBy("tile").agg(F.array(*[F.min_by("ref", F.xxhash64("ref", F.lit(turn * SOME + t))) for t in range(SOME)]).alias("picks"))
        asked = met.where("comp <> main").join(space.put(picks, f"picks{turn}", True), "tile").select(F.explode("picks").alias("a"), F.col("ref").alias("b")).distinct()
        links = links.unionByName(_verify(space, _candidates(space, reps, asked, percent, f"some{turn}"), arrays, percent, f"some{turn}"))
    signs = reps.select("ref", "n", "bits")
    members = known.join(unsettled.select("tile"), "tile").groupBy("center", "ref", "comp").agg(F.collect_list("tile").alias("tiles")).join(signs, "ref")
    members = space.put(members.select("center", "ref", "comp", "n", "bits", "tiles"), "members", True)
    stirred = space.put(_cells(space, members, "stir").mapInArrow(_stirred(percent), "center long, ref long").distinct(), "stirred", True)
    last = None
    if not stirred.isEmpty():
        active = space.put(members.join(stirred, ["center", "ref"]), "active")
        once = arrays.mapInArrow(_admitted(_flags(stirred.select("ref"))), arrays.schema).groupBy("ref").agg(F.first("tokens").alias("tokens"))
        dealt = _cells(space, active, "join", once)
        last = components(space, space.put(dealt.mapInArrow(_joined(percent), "a long, b long").distinct(), "joined", True), "last")
    labelled = reps.select("ref", "rep", "copies").join(comps, "ref", "left").withColumn("comp", F.coalesce("comp", "ref"))
    if last is not None:
        labelled = labelled.join(last.select(F.col("node").alias("comp"), F.col("comp").alias("_last")), "comp", "left").withColumn("comp", F.coalesce("_last", "comp")).drop("_last")
    labelled = space.put(labelled, "labelled")
    groups = labelled.groupBy("comp").agg(F.min("rep").alias("component_id"), F.sum("copies").alias("rows")).where("rows > 1")
    final = space.put(labelled.join(space.put(groups, "groups", True), "comp").select("ref", "component_id", "comp"), "final")
    out = keys.join(final, "ref", "left")
    more = [F.col(f"_{i}").alias(c) for i, c in enumerate(keep)] + [F.coalesce("comp", "ref").alias("group")] * group
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), *more)


def one_of_each_group(docs: DataFrame, percent: int = 75) -> DataFrame:
    """``docs`` less near copies: of each group of linked rows that with the smallest doc_id stays, of several with this
    the one whose text has the smallest digest, and of rows equal in doc_id and text one.

    Rows without a doc_id come last in their group.  Rows without words are linked with nothing and stay, but for such
    repeats.  All columns pass through; an empty table gives an empty result.
    """
    space = Workspace(docs.sparkSession, "groups")
    digest = F.md5("text")
    found = near_duplicates(docs.select("doc_id", "text", digest.alias("digest")), percent, ("digest",), True)
    found = space.put(found.where("group is not null").select("group", F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest").alias("row")), "found")
    first = space.put(found.groupBy("group").agg(F.min("row").alias("first"), F.count("*").alias("rows")).where("rows > 1"), "first")
    gone = found.join(first, "group").where("row <> first").select(row_key("row.doc_id", "row.digest").alias("_gone")).distinct()
    left = docs.withColumn("_row", row_key("doc_id", digest)).hint("merge").join(space.put(gone, "gone"), F.col("_row") == F.col("_gone"), "left_anti")
    nth = F.row_number().over(W.partitionBy("_row").orderBy(F.lit(0)))  # shares the join's exchange
    return left.withColumn("_nth", nth).where("_nth = 1").select(*[F.col(f"`{c}`") for c in docs.columns])


#: The same for DuckDB, by counting the common shingles of all pairs that have one.
ORACLE = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
t AS (SELECT k, doc_id, list_sort(CASE WHEN len(w) >= 5 THEN list_distinct([array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)]) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM d),
r AS (SELECT min(k) AS k, s, len(s) AS n FROM t WHERE len(s) > 0 GROUP BY s),
x AS (SELECT k, n, unnest(s) AS h FROM r),
l AS (SELECT a.k AS a, b.k AS b FROM x a JOIN x b ON a.h = b.h AND a.k < b.k GROUP BY a.k, b.k, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
c(k, m) AS (SELECT k, k FROM r UNION SELECT e.b, c.m FROM c JOIN e ON c.k = e.a),
m AS (SELECT k, min(m) AS m FROM c GROUP BY k),
o AS (SELECT t.k, t.doc_id, len(t.s) AS n, m.m FROM t LEFT JOIN r ON t.s = r.s AND len(t.s) > 0 LEFT JOIN m ON r.k = m.k)
SELECT doc_id, n::BIGINT AS n_shingles, coalesce(CASE WHEN m IS NOT NULL THEN min(doc_id) OVER (PARTITION BY m) END, doc_id)::BIGINT AS component_id FROM o
"""
