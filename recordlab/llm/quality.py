"""Quality rules: base counts, then robust multivariate outliers by language and source."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ._space import Workspace
from ._text import SPACE, chunks, span_hashes, spans, windows

SYMBOLS = np.zeros(256, bool)
SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Share of a group that a determinant is taken over, concentration steps, least rows of a group of its own, share of
#: normally distributed rows that the cutoff lets go.
CORE, STEPS, LEAST, TAIL = 0.75, 4, 40, 1e-5
#: The statistics are held in thousandths; standard deviation of each that is added to every estimate, so that groups
#: in which a statistic hardly varies do not reject small differences.
UNIT, FLOOR = 1000, (0.35, 0.35, 0.3, 0.5, 0.8)
K = len(FLOOR)


def chi_square(x: float, k: int) -> float:
    """Share of squared distances in ``k`` normal dimensions that are ``x`` or less."""
    a, x, n = k / 2, x / 2, 0
    term = total = 1 / a
    while term > total * 1e-16:
        n += 1
        term *= x / (a + n)
        total += term
    return total * math.exp(a * math.log(x) - x - math.lgamma(a)) if x > 0 else 0.0


def chi_square_inverse(p: float, k: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if chi_square(middle, k) < p else (low, middle)
    return low


#: What makes the covariance of the nearest CORE of normally distributed rows that of all; squared distance beyond which a row goes.
WIDEN = CORE / chi_square(chi_square_inverse(CORE, K), K + 2)
CUTOFF = chi_square_inverse(1 - TAIL, K)


def _repeats(data: np.ndarray, offsets: np.ndarray, first: np.ndarray, last: np.ndarray, text: np.ndarray, k: int = 5) -> np.ndarray:
    """Flags the words that lie in a window of ``k`` words found twice or more in their text."""
    flags = np.zeros(len(first) + 1, np.int32)
    hashes, at = windows(span_hashes(data, first, last), text, k)
    own = text[at]
    order = np.lexsort((hashes, own))
    same = (hashes[order][1:] == hashes[order][:-1]) & (own[order][1:] == own[order][:-1])
    twice = np.zeros(len(at), bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    np.add.at(flags, at[twice], 1)
    np.add.at(flags, at[twice] + k, -1)
    return np.cumsum(flags[:-1]) > 0


def count_batch(column: pa.Array) -> dict[str, np.ndarray]:
    """The five counts of each text."""
    out = {c: np.zeros(len(column), np.int64) for c in COUNTS}
    for row, data, offsets in chunks(column):
        rows = len(offsets) - 1
        at = slice(row, row + rows)
        first, last, text = spans(data, offsets, SPACE)
        per = lambda flags: np.diff(np.concatenate(([0], np.cumsum(flags)))[offsets])  # noqa: B023, E731
        out["n_words"][at] = np.bincount(text, minlength=rows)
        out["word_chars"][at] = per(~SPACE[data] & ((data & 0xC0) != 0x80))
        out["n_symbols"][at] = per(SYMBOLS[data])
        out["n_repeat_words"][at] = np.bincount(text, weights=_repeats(data, offsets, first, last, text), minlength=rows).astype(np.int64)
        if not len(first):
            continue
        line = np.zeros(256, bool)
        line[10] = True
        begin, end, own = spans(data, offsets, line)
        words = np.concatenate(([0], np.cumsum(~SPACE[data])))
        full = words[end] > words[begin]
        begin, end, own = begin[full], end[full], own[full]
        hashes = span_hashes(data, begin, end)
        order = np.lexsort((hashes, own))
        same = (hashes[order][1:] == hashes[order][:-1]) & (own[order][1:] == own[order][:-1])
        out["n_dup_lines"][at] = np.bincount(own[order[1:][same]], minlength=rows)
    return out


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts = count_batch(batch.column(batch.num_columns - 1))
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *map(pa.array, counts.values())], [*batch.schema.names[:-1], *counts])


def _moments(x: list[Column], by: str = "") -> list[Column]:
    return [F.count("*").alias(f"{by}n"), *[F.sum(v).alias(f"{by}s{i}") for i, v in enumerate(x)], *[F.sum(x[i] * x[j]).alias(f"{by}p{i}{j}") for i in range(K) for j in range(i, K)]]


def _matrices(rows: pd.DataFrame, by: str = "") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts, means and mean products of each row's moments, in units."""
    n = rows[f"{by}n"].to_numpy(float)
    mean = np.stack([rows[f"{by}s{i}"].to_numpy(float) for i in range(K)], 1) / n[:, None] / UNIT
    product = np.zeros((len(rows), K, K))
    for i in range(K):
        for j in range(i, K):
            product[:, i, j] = product[:, j, i] = rows[f"{by}p{i}{j}"].to_numpy(float) / n / UNIT**2
    return n, mean, product


def _result(g: pd.Series, start: np.ndarray | pd.Series, centre: np.ndarray, cov: np.ndarray) -> pd.DataFrame:
    """Centre, inverse of the covariance with the least variances added, and logarithm of its determinant."""
    cov = cov.copy()
    cov[:, range(K), range(K)] = np.maximum(cov[:, range(K), range(K)], 0) + np.array(FLOOR) ** 2
    values, vectors = np.linalg.eigh(cov)
    values = np.maximum(values, min(FLOOR) ** 2)
    inverse = np.einsum("gik,gk,gjk->gij", vectors, 1 / values, vectors)
    return pd.DataFrame({"g": np.asarray(g), "start": np.asarray(start), "size": np.log(values).sum(1), "centre": list(centre), "inverse": list(inverse.reshape(len(cov), -1))})


def _starts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Three covariances of each group around its medians: of the spreads alone, of signs, and of squashed values."""
    for rows in batches:
        if not len(rows):
            continue
        centre, spread = (np.stack([rows[f"{c}{i}"].to_numpy(float) for i in range(K)], 1) for c in ("centre", "spread"))
        scale = spread[:, :, None] * spread[:, None, :]
        _, mean, product = _matrices(rows, "t")
        cov = product - mean[:, :, None] * mean[:, None, :]
        root = np.sqrt(np.maximum(cov[:, range(K), range(K)], 1e-12))
        _, _, signs = _matrices(rows, "u")
        for start, shape in enumerate((np.broadcast_to(np.eye(K), cov.shape), signs * K, cov / (root[:, :, None] * root[:, None, :]))):
            yield _result(rows["g"], np.full(len(rows), start), centre, scale * shape)


def _estimates(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Mean and widened covariance of each core."""
    for rows in batches:
        if len(rows):
            _, mean, product = _matrices(rows)
            yield _result(rows["g"], rows["start"], mean, WIDEN * (product - mean[:, :, None] * mean[:, None, :]))


ESTIMATE = "g string, start int, size double, centre array<double>, inverse array<double>"


def _distance(x: list[Column]) -> Column:
    d = [v / UNIT - F.col("centre")[i] for i, v in enumerate(x)]
    return sum((d[i] * d[j] * F.col("inverse")[i * K + j] * (1 if i == j else 2) for i in range(K) for j in range(i, K)), F.lit(0.0))


def _whole(v: Column) -> Column:
    return F.round(v * UNIT).cast("long")


def quality(docs: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """doc_id, the five counts, base_failed, distance (squared, double) and kept of every row of ``docs``.

    Words are runs of other than ASCII white space; a null text has none.  Rows with fewer than 10 words, or more than
    a fifth of their words in repeated five-word windows, fail at once and take no part in the estimates.  The others
    become vectors (log words, word length, and logs of the rates of symbols, repeated lines and repeated words).

    Each language and source has its own minimum-covariance-determinant estimate.  Three starts around the medians
    (spreads alone, spatial signs, squashed values) each take concentration steps to the mean and covariance of the
    three quarters of rows that are nearest to the last estimate; that with the least determinant counts, widened to
    the covariance that normally distributed rows would have, with least variances added.  Groups of fewer than 40
    rows are looked up in the estimate of all rows of their language, and where these are fewer too in that of all.
    Rows with a squared Mahalanobis distance over ``cutoff``, beyond which one normally distributed row in 100,000
    lies, are not kept.

    All rows count in every step: a step sums exact integers by group and rounded distance, so that reruns agree, no
    group meets in one task, and no row is sampled.  Rows at equal distances are in a core together or not at all.
    Repeated rows count each; null languages and sources are values; an empty table gives an empty result.
    """
    space = Workspace(docs.sparkSession, "quality")
    keys = [F.col("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source")]
    kind = docs.schema["doc_id"].dataType.simpleString()
    counted = docs.select(*keys, F.col("text").cast("string").alias("text")).mapInArrow(_count, f"doc_id {kind}, lang string, source string, " + ", ".join(f"{c} long" for c in COUNTS))
    n = F.greatest(F.col("n_words"), F.lit(1))
    vector = [F.log(n + 1), F.col("word_chars") / n, F.log1p(100 * F.col("n_symbols") / n) / 2, F.log1p(100 * F.col("n_dup_lines") / n), F.log1p(100 * F.col("n_repeat_words") / n)]
    counted = counted.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))
    stats = space.put(counted.select("*", *[_whole(v).alias(f"x{i}") for i, v in enumerate(vector)]), "stats")
    sizes = stats.groupBy("lang", "source").agg(F.count_if(~F.col("base_failed")).alias("own"))
    lang = W.partitionBy("lang")
    sizes = space.put(sizes.withColumn("of_lang", F.sum("own").over(lang)).withColumn("some_small", F.min("own").over(lang) < LEAST), "sizes")
    some_smaller = not sizes.where((F.col("own") < LEAST) & (F.col("of_lang") < LEAST)).isEmpty()
    own, of_lang = F.to_json(F.struct("lang", "source")), F.to_json(F.struct("lang"))
    large, middle = F.col("own") >= LEAST, F.col("of_lang") >= LEAST
    # Where a group is looked up, and the estimates that its rows take part in.
    parts = [F.when(large, own), F.when(F.col("some_small") & middle, of_lang), F.when(F.lit(some_smaller), F.lit("all"))]
    groups = sizes.select(F.col("lang").alias("_lang"), F.col("source").alias("_source"), F.when(large, own).when(middle, of_lang).otherwise("all").alias("g"), F.array_compact(F.array(*parts)).alias("parts"))
    groups = space.put(groups, "groups")
    named = space.put(stats.join(groups, F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source"))).drop("_lang", "_source"), "named")
    x = [F.col(f"x{i}") for i in range(K)]
    good = named.where("not base_failed").select(F.explode("parts").alias("g"), *x)
    # percentile is exact on integers and holds one entry for each distinct value.
    first = good.groupBy("g").agg(*[F.percentile(v, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias(f"q{i}") for i, v in enumerate(x)])
    spread = [F.greatest((F.col(f"q{i}")[2] - F.col(f"q{i}")[0]) / UNIT / 1.349, F.lit(FLOOR[i])).alias(f"spread{i}") for i in range(K)]
    first = space.put(first.select("g", *[(F.col(f"q{i}")[1] / UNIT).alias(f"centre{i}") for i in range(K)], *spread), "first")
    z = [(v / UNIT - F.col(f"centre{i}")) / F.col(f"spread{i}") for i, v in enumerate(x)]
    length = F.sqrt(sum((v * v for v in z), F.lit(0.0)))
    shaped = good.join(first, "g").select("g", *[_whole(F.tanh(v)).alias(f"t{i}") for i, v in enumerate(z)], *[F.coalesce(_whole(F.try_divide(v, length)), F.lit(0)).alias(f"u{i}") for i, v in enumerate(z)])
    shaped = shaped.groupBy("g").agg(*_moments([F.col(f"t{i}") for i in range(K)], "t"), *_moments([F.col(f"u{i}") for i in range(K)], "u"))
    estimate = shaped.join(first, "g").mapInPandas(_starts, ESTIMATE)
    for step in range(STEPS):
        estimate = space.put(estimate, f"estimate{step}")
        near = good.join(estimate, "g").withColumn("bin", F.floor(F.log1p(_distance(x)) * 64).cast("int"))
        bins = near.groupBy("g", "start", "bin").agg(*_moments(x))
        of = W.partitionBy("g", "start")
        core = bins.withColumn("below", F.sum("n").over(of.orderBy("bin")) - F.col("n")).withColumn("all", F.sum("n").over(of)).where(F.col("below") < CORE * F.col("all"))
        sums = [c for c in bins.columns if c not in ("g", "start", "bin")]
        estimate = core.groupBy("g", "start").agg(*[F.sum(c).alias(c) for c in sums]).mapInPandas(_estimates, ESTIMATE)
    least = space.put(estimate.groupBy("g").agg(F.min(F.struct("size", "start", "centre", "inverse")).alias("e")).select("g", "e.centre", "e.inverse"), "estimate")
    far = named.join(least, "g", "left").withColumn("distance", _distance(x))
    kept = ~F.col("base_failed") & (F.coalesce("distance", F.lit(0.0)) <= cutoff)
    return far.select("doc_id", *COUNTS, "base_failed", kept.alias("kept"), "distance", "lang", "source")


#: The counts and base rule for DuckDB.
COUNTS_ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT k, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM d),
u AS (SELECT k, i, array_to_string(w[i:i + 4], ' ') AS h FROM w, unnest(range(1, len(w) - 3)) r(i)),
p AS (SELECT k, count(DISTINCT i + j) AS n FROM (SELECT k, i, count(*) OVER (PARTITION BY k, h) AS c FROM u), unnest(range(5)) o(j) WHERE c > 1 GROUP BY k),
l AS (SELECT k, count(*) - count(DISTINCT line) AS n FROM (SELECT k, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY k),
c AS (SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum([len(x) FOR x IN w]), 0)::BIGINT AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
  coalesce(l.n, 0)::BIGINT AS n_dup_lines, coalesce(p.n, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN l USING (k) LEFT JOIN p USING (k))
SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM c
"""
