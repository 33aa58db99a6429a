"""Exact top-k inner products by a three-phase uniform threshold over lists of partial scores."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from recordlab.session import ship

from ._space import Workspace

#: Lists that a score is the sum of, entries of each list's head, bytes of the queries of a wave on average.
LISTS, HEAD, WAVE = 4, 64, 16 << 20
#: Queries that are scored together, components of the candidates that they are scored against at once.
TOGETHER, BLOCK = 256, 1 << 19
LONG = np.iinfo(np.int64)
#: Components are kept as the narrowest of these that holds a vector's; the last holds any whole number exactly as a double does.
KINDS = {2: np.dtype("<i2"), 4: np.dtype("<i4"), 8: np.dtype("<f8")}


def _vectors(scale: int):
    """Whole-number vectors; null ones, and those with a null or a component that is not finite, are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, lists = batch.column(0), batch.column(1)
            offsets = lists.offsets.to_numpy().astype(np.int64)
            x = lists.values.to_numpy(zero_copy_only=False).astype(np.float64)  # a null becomes NaN
            bad = np.concatenate(([0], np.cumsum(~np.isfinite(x))))
            good = (bad[offsets[1:]] == bad[offsets[:-1]]) & ~np.asarray(lists.is_null()) & ~np.asarray(ids.is_null())
            with np.errstate(invalid="ignore", over="ignore"):
                x = np.floor(scale * x)
            sizes, out = [], []
            for i in np.flatnonzero(good).tolist():
                own = x[offsets[i] : offsets[i + 1]]
                most = float(np.abs(own).max(initial=0))
                if most == np.inf:
                    raise OverflowError("a component leaves the range of a double when it is scaled")
                size = 2 if most < 1 << 15 else 4 if most < 1 << 31 else 8
                sizes.append(size)
                out.append(own.astype(KINDS[size]).tobytes())
            yield pa.RecordBatch.from_arrays([ids.filter(pa.array(good)), pa.array(sizes, pa.int32()), pa.array(out, pa.binary())], ["vec_id", "size", "v"])

    return run


def _matrix(sizes: list[int], rows: list[bytes], wide: int = 0) -> np.ndarray:
    """The vectors as doubles, shorter ones padded with zeros."""
    lengths = {len(r) // s for s, r in zip(sizes, rows, strict=True)}
    wide = max([wide, *lengths])
    if len(set(sizes)) == 1 and lengths == {wide}:
        return np.frombuffer(b"".join(rows), KINDS[sizes[0]]).reshape(len(rows), wide).astype(np.float64)
    out = np.zeros((len(rows), wide))
    for i, (s, r) in enumerate(zip(sizes, rows, strict=True)):
        x = np.frombuffer(r, KINDS[s])
        out[i, : len(x)] = x
    return out


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact a @ b.T: in floating point where every sum is below its precision, else in Python's integers.

    Products beyond the range of a long become its ends, which :func:`_whole` does not let pass.
    """
    most = _most(a, b)
    if most < 1 << 24:
        return (a.astype(np.float32) @ b.T.astype(np.float32)).astype(np.int64)
    if most < 1 << 53:
        return (a @ b.T).astype(np.int64)
    whole = np.frompyfunc(int, 1, 1)
    out = whole(a).astype(object) @ whole(b.T).astype(object)
    return np.clip(out, LONG.min, LONG.max).astype(np.int64)


def _most(a: np.ndarray, b: np.ndarray) -> float:
    return float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1])


def _whole(score: np.ndarray) -> np.ndarray:
    if len(score) and (score.min() == LONG.min or score.max() == LONG.max):
        raise OverflowError("a score leaves 64 bits")
    return score


def _trim(row: np.ndarray, vec_id: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``k`` best of each row, by score, then smaller id."""
    order = np.lexsort((vec_id, ~score, row))
    row, vec_id, score = row[order], vec_id[order], score[order]
    keep = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[keep], vec_id[keep], score[keep]


class _Best:
    """The best entries of each query so far, and the score below which no other counts."""

    def __init__(self, rows: int, k: int, bound: np.ndarray):
        self.k, self.bound, none = k, bound.copy(), np.zeros(0, np.int64)
        self.row, self.vec_id, self.score = none, none, none

    def add(self, row: np.ndarray, vec_id: np.ndarray, score: np.ndarray) -> None:
        if not len(row):
            return
        self.row, self.vec_id, self.score = _trim(np.concatenate([self.row, row]), np.concatenate([self.vec_id, vec_id]), np.concatenate([self.score, score]), self.k)
        last = np.flatnonzero(np.arange(len(self.row)) - np.searchsorted(self.row, self.row) == self.k - 1)
        self.bound[self.row[last]] = np.maximum(self.bound[self.row[last]], self.score[last])

    def offer(self, scores: np.ndarray, ids: np.ndarray, own: np.ndarray, lo: int) -> None:
        """A block of scores of the queries from ``lo``."""
        rows, n = scores.shape
        bound = self.bound[lo : lo + rows]
        if n > 4 * self.k:
            bound = np.maximum(bound, np.partition(np.where(own, LONG.min, scores), n - self.k, axis=1)[:, n - self.k])
        row, col = np.nonzero((scores >= bound[:, None]) & ~own)
        self.add(*_trim(row + lo, ids[col], scores[row, col], self.k))


def _blocks(batches: Iterator[pa.RecordBatch], wide: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and vectors of the candidates, a bounded number of components at once, as wide as the queries at least."""
    for batch in batches:
        step = max(1, BLOCK // max(1, wide))
        for lo in range(0, batch.num_rows, step):
            part = batch.slice(lo, step)
            yield part.column(0).to_numpy(), _matrix(part.column(1).to_pylist(), part.column(2).to_pylist(), wide)


def _sorted_lists(x: np.ndarray, cut: list[int]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Each list by the norm of the vectors' part in it, which bounds a partial score: order and norms, high ones first."""
    out = []
    for a, b in zip(cut, cut[1:], strict=False):
        norm = np.sqrt((x[:, a:b] ** 2).sum(1)) * (1 + 1e-9)
        order = np.argsort(-norm, kind="stable")
        out.append((order, norm[order]))
    return out


def _cut(wide: int) -> list[int]:
    return [wide * j // LISTS for j in range(LISTS + 1)]


def _heads(wave, k: int):
    """Phase 1: each query's best scores among the heads of a task's lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qid, q = wave.value
        best = _Best(len(qid), k, np.full(len(qid), LONG.min))
        for ids, x in _blocks(batches, q.shape[1]):
            head = np.unique(np.concatenate([order[:HEAD] for order, _ in _sorted_lists(x, _cut(x.shape[1]))]))
            ids, x = ids[head], x[head, : q.shape[1]]
            for lo in range(0, len(qid), TOGETHER):
                best.offer(_product(q[lo : lo + TOGETHER], x), ids, ids[None, :] == qid[lo : lo + TOGETHER, None], lo)
        yield pa.RecordBatch.from_arrays([pa.array(qid[best.row]), pa.array(best.score)], ["query_id", "score"])

    return run


def _rest(wave, cutoffs, k: int):
    """Phases 2 and 3: entries that reach the uniform share of the cutoff in a list, resolved exactly.

    A score that reaches the cutoff reaches its share in some list; in a list only the entries count whose norms let
    them reach it, which come first.  Where these are few the partial scores are taken of them alone, and only pairs
    that reach a share are resolved; else the lists are summed as they are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (qid, q), cutoff = wave.value, cutoffs.value
        best = _Best(len(qid), k, cutoff)
        wide, cut = q.shape[1], _cut(q.shape[1])
        norms = [np.sqrt((q[:, a:b] ** 2).sum(1)) * (1 + 1e-9) for a, b in zip(cut, cut[1:], strict=False)]
        for ids, x in _blocks(batches, wide):
            x = x[:, :wide]
            lists = _sorted_lists(x, cut)
            for lo in range(0, len(qid), TOGETHER):
                part, bound = q[lo : lo + TOGETHER], best.bound[lo : lo + TOGETHER]
                share, first = (bound.astype(np.float64) - np.abs(bound.astype(np.float64)) * 1e-15) / LISTS, []
                for (_, norm), own in zip(lists, norms, strict=True):
                    with np.errstate(divide="ignore", invalid="ignore"):
                        least = np.where(share <= 0, -1.0, share / own[lo : lo + TOGETHER])
                    first.append(int(np.searchsorted(-norm, -np.nanmin(least, initial=np.inf), "right")))
                if sum(first) * 2 > LISTS * len(ids):
                    scores = sum(_product(part[:, a:b], x[:, a:b]) for a, b in zip(cut, cut[1:], strict=False)) if _most(part, x) < 1 << 53 else _product(part, x)
                    best.offer(scores, ids, ids[None, :] == qid[lo : lo + TOGETHER, None], lo)
                    continue
                pairs = []
                for (order, _), n, a, b in zip(lists, first, cut, cut[1:], strict=False):
                    row, col = np.nonzero(_product(part[:, a:b], x[order[:n], a:b]) >= share[:, None])
                    pairs.append(row * len(ids) + order[col])
                row, col = np.divmod(np.unique(np.concatenate(pairs)), len(ids))
                other = ids[col] != qid[row + lo]
                row, col = row[other], col[other]
                for at in range(0, len(row), 1 << 16):
                    r, c = row[at : at + (1 << 16)], col[at : at + (1 << 16)]
                    score = _dots(part[r], x[c])
                    high = score >= best.bound[r + lo]
                    best.add(*_trim(r[high] + lo, ids[c[high]], score[high], k))
        yield pa.RecordBatch.from_arrays([pa.array(qid[best.row]), pa.array(best.vec_id), pa.array(_whole(best.score))], ["query_id", "vec_id", "score"])

    return run


def _dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of two matrices, exact."""
    if _most(a, b) < 1 << 53:
        return np.einsum("ij,ij->i", a, b).astype(np.int64)
    return np.array([int(_product(x[None], y[None])[0, 0]) for x, y in zip(a, b, strict=True)], np.int64)


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, scale: int = 256) -> DataFrame:
    """query_id, rank, vec_id and score: each query's ``k`` highest inner products among all other rows.

    ``vectors`` has vec_id and embedding.  Components become floor(scale * x); a shorter vector counts as padded with
    zeros.  Queries are the ids of rows whose vec_id is divisible by ``every``; of several rows with such an id one
    asks.  Ties go to the smaller vec_id; a query with fewer partners has them all.  Null vectors and ids, and vectors
    with a null or a component that is not finite, take no part.  Rows with one id never are partners of that id;
    otherwise each of them is a candidate of its own.  Scores are exact; a score that leaves 64 bits is an error.  An
    empty table gives an empty result.

    Candidates are read where they lie.  The queries go to them in waves of about 16 MB, and each wave runs in three
    phases: each task's best scores among the heads of its lists are gathered; the k-th best of all is a cutoff that is
    safe, and goes back; tasks collect the entries that reach its uniform share in a list, resolve them exactly and
    give their ``k`` best.  So a wave moves at most k rows for each query and task.
    """
    spark = ship(vectors.sparkSession)
    space = Workspace(spark, "topk")
    table = space.put(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).mapInArrow(_vectors(scale), "vec_id long, size int, v binary"), "vectors")
    asking = table.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min(F.struct("size", "v")).alias("own")).select("vec_id", "own.*")
    asking = space.put(asking, "asking")
    waves = int((asking.agg(F.sum(F.length("v") * 8 / F.col("size"))).first()[0] or 0) // WAVE) + 1
    found = []
    for i in range(waves):
        rows = asking.where(F.pmod(F.xxhash64("vec_id"), F.lit(waves)) == i).toArrow().sort_by("vec_id")
        if not rows.num_rows:
            continue
        qid = rows["vec_id"].to_numpy()
        wave = spark.sparkContext.broadcast((qid, _matrix(rows["size"].to_pylist(), rows["v"].to_pylist())))
        heads = table.mapInArrow(_heads(wave, k), "query_id long, score long")
        high = heads.withColumn("r", F.row_number().over(W.partitionBy("query_id").orderBy(F.col("score").desc()))).where(F.col("r") <= k)
        known = high.groupBy("query_id").agg(F.min("score").alias("cutoff"), F.count("*").alias("n")).where(F.col("n") == k).select("query_id", "cutoff").toArrow()
        cutoff = np.full(len(qid), LONG.min)
        cutoff[np.searchsorted(qid, known["query_id"].to_numpy())] = known["cutoff"].to_numpy()
        found.append(space.put(table.mapInArrow(_rest(wave, spark.sparkContext.broadcast(cutoff), k), "query_id long, vec_id long, score long"), f"best/wave={i}"))
    best = spark.read.schema("query_id long, vec_id long, score long").parquet(f"{space.root}/best") if found else spark.createDataFrame([], "query_id long, vec_id long, score long")
    ranked = best.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


#: The same for DuckDB.
ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
q AS (SELECT vec_id, min(v) AS v FROM v WHERE vec_id % 50 = 0 GROUP BY vec_id),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score FROM q JOIN v c ON q.vec_id <> c.vec_id),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
