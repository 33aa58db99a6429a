"""Toxicity: a sparse logistic model whose scores do not move when identity terms are swapped."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recordlab.session import ship

from ._space import Workspace
from ._text import LOWER, chunks, span_hashes, spans
from ._worker import lean

#: Neutral names of groups, by language; the swaps stay within a language.
IDENTITY = {
    "en": "women men girls boys muslims christians jews hindus buddhists atheists immigrants refugees africans asians europeans americans mexicans black white gay lesbian straight transgender disabled deaf blind elderly young".split(),
    "fr": "femmes hommes musulmans chrétiens juifs immigrés réfugiés africains asiatiques noirs blancs gays lesbiennes handicapés vieux jeunes".split(),
    "de": "frauen männer muslime christen juden einwanderer flüchtlinge afrikaner asiaten schwarze weiße schwule lesben behinderte alte junge".split(),
    "es": "mujeres hombres musulmanes cristianos judíos inmigrantes refugiados africanos asiáticos negros blancos gays lesbianas discapacitados viejos jóvenes".split(),
}
#: Labelled rows of each class that the model may see, swapped sentences of each, features that it keeps, lengths of
#: word beginnings in bytes.
SAMPLE, SENTENCES, FEATURES, HEADS = 4000, 50, 4096, (4, 5, 6)
GAP = np.ones(256, bool)
GAP[97:123] = GAP[128:] = False


@dataclass
class Model:
    """Weights of features known by 64-bit hashes (sorted), the intercept, and the logit of a text without words."""

    keys: np.ndarray
    weights: np.ndarray
    bias: float
    empty: float


def _features(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """First row, rows, row and hash of the words, and of the first bytes of longer ones, of each chunk."""
    for row, data, offsets in chunks(column):
        data = LOWER[data]
        first, last, text = spans(data, offsets, GAP)
        rows, hashes = [text], [span_hashes(data, first, last)]
        for k in HEADS:
            long = last - first > k
            rows.append(text[long])
            hashes.append(span_hashes(data, first[long], first[long] + k) ^ np.uint64(k))
        yield row, len(offsets) - 1, np.concatenate(rows), np.concatenate(hashes)


def _distinct(column: pa.Array) -> list[np.ndarray]:
    out = []
    for _, rows, text, hashes in _features(column):
        order = np.lexsort((hashes, text))
        text, hashes = text[order], hashes[order]
        new = np.ones(len(text), bool)
        new[1:] = (text[1:] != text[:-1]) | (hashes[1:] != hashes[:-1])
        out += np.split(hashes[new], np.searchsorted(text[new], np.arange(1, rows)))
    return out


def _named() -> np.ndarray:
    """Hashes of the identity terms."""
    return np.unique(np.concatenate(_distinct(pa.array([w for words in IDENTITY.values() for w in words]))))


def _swaps(text: str, most: int = SENTENCES) -> tuple[list[str], list[str]]:
    """Sentences with identity terms, and each with its terms swapped for the language's next one or left out."""
    given, swapped = [], []
    if _TERMS.search(text):
        for sentence in re.split(r"[.!?\n]", text):
            if len(given) >= most:
                break
            if _TERMS.search(sentence):
                for k in (0, 1):
                    given.append(sentence)
                    swapped.append(_TERMS.sub(lambda m, k=k: _FOLLOWING[m[0].lower()][k] if m[0].lower() in _FOLLOWING else m[0], sentence))
    return given, swapped


_FOLLOWING = {w: (words[(i + 1) % len(words)], "") for words in IDENTITY.values() for i, w in enumerate(words)}
_TERMS = re.compile(r"\b(" + "|".join(sorted(_FOLLOWING, key=len, reverse=True)) + r")\b", re.IGNORECASE)


def _cells(texts: list[str], keys: np.ndarray) -> list[np.ndarray]:
    """Which of the keys each text has."""
    out = []
    for own in _distinct(pa.array(texts, pa.string())) if texts else []:
        at = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
        out.append(at[keys[at] == own].astype(np.int32))
    return out


def _strength(df, bad, share: float, lib=np):
    """How far a feature's toxic rows are from what its rows would have by chance, in standard deviations."""
    return lib.abs(bad - df * share) / lib.sqrt(df * share * (1 - share) + 1)


def fit(texts: list[str | None], toxic: list[int], fairness: float = 20.0, lasso: float = 5e-4, steps: int = 300) -> Model:
    """The model of texts at hand; :func:`train` takes the same steps with the texts where they lie."""
    y, texts = np.array(toxic, float), [t or "" for t in texts]
    if not len(y) or y.min() == y.max():
        return _unfitted(y)
    own = _distinct(pa.array(texts, pa.string()))
    keys, at = np.unique(np.concatenate(own), return_inverse=True)
    row = np.repeat(np.arange(len(own)), [len(x) for x in own])
    df = np.bincount(at, minlength=len(keys))
    z = np.where(df >= 3, _strength(df, np.bincount(at, weights=y[row], minlength=len(keys)), y.mean()), 0)
    best = np.lexsort((keys.view(np.int64), -z))[:FEATURES]
    chosen = np.union1d(keys[best[z[best] > 0]], keys[np.isin(keys, _named())])
    if not len(chosen):
        return _unfitted(y)
    pairs = [_swaps(t) for t in texts]
    given, swapped = ([x for p in pairs for x in p[k]] for k in (0, 1))
    return _solve(chosen, _cells(texts, chosen), y, _cells(given, chosen), _cells(swapped, chosen), fairness, lasso, steps)


def _unfitted(y: np.ndarray) -> Model:
    share = (y.sum() + 0.5) / (len(y) + 1)
    rate = float(np.log(share / (1 - share)))
    return Model(np.zeros(0, np.uint64), np.zeros(0), rate, min(rate, -0.1))


def _solve(keys: np.ndarray, cells: list[np.ndarray], y: np.ndarray, given: list[np.ndarray], swapped: list[np.ndarray], fairness: float, lasso: float, steps: int) -> Model:
    """Weights that minimise logistic loss + lasso + fairness * mean squared score change over the swapped sentences."""
    flat = lambda parts: (np.repeat(np.arange(len(parts)), [len(x) for x in parts]), np.concatenate([np.zeros(0, np.int32), *parts]).astype(np.int64))
    (row, col), (r0, c0), (r1, c1) = flat(cells), flat(given), flat(swapped)
    rs, cs, sign = np.concatenate([r0, r1]), np.concatenate([c0, c1]), np.concatenate([np.ones(len(r0)), -np.ones(len(r1))])
    share, size, pairs = y.mean(), len(keys), max(1, len(given))
    weight = np.where(y > 0, 0.5 / y.mean(), 0.5 / (1 - y.mean())) / len(y)

    def gradient(w: np.ndarray, b: float) -> tuple[np.ndarray, float]:
        p = 1 / (1 + np.exp(-np.clip(np.bincount(row, weights=w[col], minlength=len(y)) + b, -40, 40)))
        d = weight * (p - y)
        g = np.bincount(col, weights=d[row], minlength=size)
        if len(given):
            moved = np.bincount(rs, weights=w[cs] * sign, minlength=pairs)
            g += 2 * fairness / pairs * np.bincount(cs, weights=moved[rs] * sign, minlength=size)
        return g, float(d.sum())

    # Accelerated proximal gradient; the step follows from the largest curvature, by power iteration.
    v = np.ones(size)
    for _ in range(15):
        v /= np.linalg.norm(v) + 1e-12
        u = np.bincount(col, weights=(weight * np.bincount(row, weights=v[col], minlength=len(y)))[row], minlength=size) / 4
        if len(given):
            u += 2 * fairness / pairs * np.bincount(cs, weights=np.bincount(rs, weights=v[cs] * sign, minlength=pairs)[rs] * sign, minlength=size)
        v = u
    step = 1 / (np.linalg.norm(v) * 1.1 + 0.5)
    w, b, last_w, last_b = np.zeros(size), 0.0, np.zeros(size), 0.0
    for i in range(steps):
        k = i / (i + 3)
        aw, ab = w + k * (w - last_w), b + k * (b - last_b)
        g, gb = gradient(aw, ab)
        last_w, last_b = w, b
        w = aw - step * g
        w = np.sign(w) * np.maximum(np.abs(w) - step * lasso, 0)
        b = ab - step * gb
    used = w != 0
    return Model(keys[used], w[used], float(b), min(float(b), float(np.log(share / (1 - share))), -0.1))


def _score(model):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, weights, bias, empty = model.value.keys, model.value.weights, model.value.bias, model.value.empty
        for batch in batches:
            scores = np.zeros(batch.num_rows)
            for row, rows, text, hashes in _features(batch.column(batch.num_columns - 1)):
                logit = np.where(np.bincount(text, minlength=rows) > 0, bias, empty)
                if len(keys) and len(hashes):
                    at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
                    hit = keys[at] == hashes
                    pair = np.unique(text[hit] * len(keys) + at[hit])
                    logit += np.bincount(pair // len(keys), weights=weights[pair % len(keys)], minlength=rows)
                scores[row : row + rows] = 1 / (1 + np.exp(-np.clip(logit, -40, 40)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(scores)], [*batch.schema.names[:-1], "score"])

    return run


def is_held_out(column: str = "doc_id"):
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % 5 == 0


@lean
def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        toxic = batch.column(1).to_numpy()
        own = _distinct(batch.column(0))
        keys, at = np.unique(np.concatenate([np.zeros(0, np.uint64), *own]), return_inverse=True)
        bad = np.bincount(at, weights=np.repeat(toxic, [len(x) for x in own]), minlength=len(keys)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(np.bincount(at, minlength=len(keys))), pa.array(bad)], ["key", "df", "bad"])


def _placed(keys):
    """Features of each row, and of its swapped sentences before and after, by their places among the chosen ones."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chosen = keys.value
        lists = pa.list_(pa.list_(pa.int32()))
        for batch in batches:
            texts = batch.column(0).to_pylist()
            swaps = [_swaps(t) for t in texts]
            given, swapped = (pa.array([_cells(s[k], chosen) for s in swaps], lists) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([batch.column(2), batch.column(1), pa.array(_cells(texts, chosen), pa.list_(pa.int32())), given, swapped], ["doc_id", "toxic", "cells", "given", "swapped"])

    return run


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, fairness: float = 20.0, lasso: float = 5e-4, steps: int = 300) -> Model:
    """Fits the model on at most ``sample`` labelled rows of each class, none held out, drawn by a hash of doc_id.

    Of rows that share a drawn doc_id and its label one counts.  Texts stay with the tasks, which count their features
    and give the places of the 4096 most telling ones, and of at most 50 swapped sentences a row; the driver solves for
    the weights.  Null ids and labels are left out.
    """
    spark = ship(docs.sparkSession)
    space = Workspace(spark, "toxicity")
    known = labels.where("doc_id is not null and toxic is not null").where(~is_held_out()).select(F.col("doc_id").alias("_id"), "toxic", F.xxhash64("doc_id").alias("_h")).distinct()
    drawn = known.where("toxic = 1").orderBy("_h").limit(sample).unionByName(known.where("toxic = 0").orderBy("_h").limit(sample))
    rows = docs.select("doc_id", "text").join(F.broadcast(drawn), F.col("doc_id") == F.col("_id"))
    rows = space.put(rows.groupBy("doc_id", F.col("toxic").cast("int").alias("toxic")).agg(F.min(F.coalesce("text", F.lit(""))).alias("text")).select("text", "toxic", "doc_id"), "sample")
    size = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("bad")).first()
    if size.bad in (0, size.n):
        return _unfitted(np.repeat([1.0, 0.0], [size.bad, size.n - size.bad]))
    counts = space.put(rows.mapInArrow(_counted, "key long, df long, bad long").groupBy("key").agg(F.sum("df").alias("df"), F.sum("bad").alias("bad")), "features")
    named = spark.createDataFrame([(int(k),) for k in _named().view(np.int64)], "key long")
    z = _strength(F.col("df"), F.col("bad"), size.bad / size.n, F).alias("z")
    best = counts.where("df >= 3").select("key", z).where("z > 0").orderBy(F.desc("z"), "key").limit(FEATURES).select("key")
    chosen = best.union(counts.join(F.broadcast(named), "key", "left_semi").select("key")).distinct().toArrow()["key"].to_numpy().view(np.uint64)
    if not len(chosen):
        return _unfitted(np.repeat([1.0, 0.0], [size.bad, size.n - size.bad]))
    chosen = np.sort(chosen)
    kind = docs.schema["doc_id"].dataType.simpleString()
    lists = "cells array<int>, given array<array<int>>, swapped array<array<int>>"
    found = rows.mapInArrow(_placed(spark.sparkContext.broadcast(chosen)), f"doc_id {kind}, toxic int, {lists}").toArrow().sort_by([("doc_id", "ascending"), ("toxic", "ascending")])
    arrays = lambda column: [np.array(x, np.int32) for x in column]
    given, swapped = ([x for row in found[k].to_pylist() for x in row] for k in ("given", "swapped"))
    return _solve(chosen, arrays(found["cells"].to_pylist()), found["toxic"].to_numpy().astype(float), arrays(given), arrays(swapped), fairness, lasso, steps)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score (0 to 1) of every row; only the text is read.  Null and empty texts, and others without
    words, score at most the rate of toxic rows among the labelled.  Rows that repeat score alike; texts of any length
    are read whole; an empty table gives an empty result."""
    sent = ship(docs.sparkSession).sparkContext.broadcast(model)
    keep = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return keep.mapInArrow(_score(sent), f"doc_id {keep.schema['doc_id'].dataType.simpleString()}, score double")


def remove_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` less the rows that score 0.5 or more; all columns stay, whatever their names.

    Null and empty texts stay, as they score below; repeated rows stay or go alike; an empty table stays empty.
    """
    sent = ship(docs.sparkSession).sparkContext.broadcast(model)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("text").cast("string").alias("text"))
    scored = rows.mapInArrow(_score(sent), T.StructType([rows.schema["row"], T.StructField("score", T.DoubleType())]))
    return scored.where("score < 0.5").select("row.*")
