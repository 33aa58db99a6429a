"""Sampling of distributed data: random or by hash, plain, stratified or uniform, approximate or exact."""

from __future__ import annotations

import math
from dataclasses import dataclass
from enum import Enum

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.hashing import Algorithm, ByteEncoding, roll
from ..plans.schema import stratum_field
from ..session import written_once


#: Bins of rolls by which an exact sample finds its thresholds.
BINS = 4096


class Distribution(str, Enum):
    STRATIFIED = "stratified"
    UNIFORM = "uniform"


class Precision(str, Enum):
    APPROXIMATE = "approximate"
    EXACT = "exact"


@dataclass(frozen=True)
class Sample:
    """The sampled rows, and, where strata were asked for, target and actual size of each."""

    rows: DataFrame
    population: DataFrame | None = None
    fraction: float = 1.0
    distribution: Distribution | None = None

    @property
    def report(self) -> DataFrame | None:
        """stratum, target, actual, diff: (target - actual) / target; strata without sampled rows count as 0."""
        if self.population is None:
            return None
        actual = self.rows.groupBy("stratum").agg(F.count("*").alias("actual"))
        aimed = self.population.withColumn("target", targets(self.distribution, self.fraction))
        return aimed.join(actual, "stratum", "left").select("stratum", "target", F.coalesce("actual", F.lit(0)).alias("actual")).withColumn("diff", F.try_divide(F.col("target") - F.col("actual"), F.col("target")))

    def check(self, tolerance: float = 0.01) -> DataFrame:
        """The report, in which a stratum or the total more than ``tolerance`` short is an error; excess never is."""
        rows = self.report
        total = W.partitionBy(F.lit(0))
        short = F.try_divide(F.sum("target").over(total) - F.sum("actual").over(total), F.sum("target").over(total))
        bad = (F.col("diff") > tolerance) | (short > tolerance)
        return rows.withColumn("diff", F.when(bad, F.raise_error(F.concat(F.lit("stratum under-sampled: "), F.col("stratum"))).cast("double")).otherwise(F.col("diff")))


def stratum(df: DataFrame, fields: list[str], as_set: bool = False) -> Column:
    """Text of the stratum of a row: its fields' texts in order, or with ``as_set`` their sorted distinct texts."""
    for path in fields:
        stratum_field(df.schema, path)
    texts = [F.coalesce(F.col(p).cast("string"), F.lit("null")) for p in fields]
    return F.array_join(F.array_sort(F.array_distinct(F.array(*texts))), ",") if as_set else F.concat_ws(",", *texts)


def targets(distribution: Distribution, fraction: float) -> Column:
    """Rows aimed at in a stratum of a table (stratum, c): its share, or an equal share of all, at most c."""
    if distribution is Distribution.STRATIFIED:
        return F.floor(F.col("c") * fraction).cast("double")
    every = W.partitionBy(F.lit(0))
    return F.least(F.col("c").cast("double"), F.floor(F.sum("c").over(every) * fraction / F.count("*").over(every)).cast("double"))


def strata(df: DataFrame) -> DataFrame:
    return df.groupBy("stratum").agg(F.count("*").alias("c"))


def uniform_parameters(population: DataFrame, fraction: float) -> DataFrame:
    """stratum, c, pop (equal share of all rows) and p = min(pop / c, 1)."""
    every = W.partitionBy(F.lit(0))
    shared = population.withColumn("pop", F.sum("c").over(every) * F.lit(float(fraction)) / F.count("*").over(every))
    return shared.withColumn("p", F.least(F.col("pop") / F.col("c"), F.lit(1.0)))


def chernoff_bounds(n: Column, fraction: Column, delta: float) -> tuple[Column, Column]:
    """Rolls below the first are surely in a sample of a fraction of n rows, rolls above the second surely not."""
    ln = -math.log(delta)
    high, low = F.lit(ln) / n, F.lit(1.5 * ln) / n
    upper = fraction + high + F.sqrt(high * high + 2 * high * fraction)
    lower = F.least(F.lit(1.0), fraction + low - F.sqrt(low * low + 2 * low * fraction))
    return lower, upper


def top_k_by_key(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """The first ``k`` rows of each key; a limit below each exchange keeps what moves small."""
    ranked = df.withColumn("_rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
    return ranked.where(F.col("_rank") <= k).drop("_rank")


def _smallest(rolled: DataFrame, aimed: DataFrame, ties: list[Column]) -> DataFrame:
    """The rows with the ``_target`` smallest rolls of each stratum, without sorting a stratum.

    Counts by stratum and roll bin, partially aggregated, tell in which bin each stratum's last row lies.  Rows in
    lower bins stay as they are; only that bin's rows, about one in ``BINS``, are ranked.
    """
    binned = rolled.withColumn("_bin", F.floor(F.col("_roll") * BINS))
    counts = binned.groupBy("stratum", "_bin").agg(F.count("*").alias("_n"))
    upto = counts.withColumn("_upto", F.sum("_n").over(W.partitionBy("stratum").orderBy("_bin"))).join(aimed, "stratum")
    below = F.col("_upto") - F.col("_n")
    edge = upto.where((below < F.col("_target")) & (F.col("_target") <= F.col("_upto"))).select("stratum", F.col("_bin").alias("_edge"), (F.col("_target") - below).alias("_need"))
    met = binned.join(edge, "stratum")
    sure = met.where(F.col("_bin") < F.col("_edge")).withColumn("_rank", F.lit(0))
    last = met.where(F.col("_bin") == F.col("_edge")).withColumn("_rank", F.row_number().over(W.partitionBy("stratum").orderBy("_roll", *ties)))
    return sure.unionByName(last.where(F.col("_rank") <= F.col("_need"))).drop("_roll", "_bin", "_edge", "_need", "_rank")


def sample(
    df: DataFrame,
    fraction: float,
    fields: list[str] | None = None,
    seed: int | None = None,
    algorithm: str | Algorithm = Algorithm.FARM,
    encoding: str | ByteEncoding = ByteEncoding.RAW,
    distribution: str | Distribution | None = None,
    distribution_fields: list[str] | None = None,
    precision: str | Precision = Precision.APPROXIMATE,
    as_set: bool = False,
    prune: bool = False,
    by: Column | None = None,
) -> Sample:
    """A sample of ``df``.

    With ``fields`` (or a roll ``by``) a row's fate depends on them alone and repeats anywhere; otherwise it is random.
    A ``distribution`` over ``distribution_fields`` keeps each stratum's share or gives all strata equal shares.
    Exact samples hold exactly the targets; equal rolls go by the other columns.  Only the rows around each stratum's
    threshold are ranked.  Random rolls cannot be drawn twice alike, so an exact random sample is drawn when this is
    called, and its rolls are written to the shared folder; there ``prune`` first drops rows whose roll is above a
    Chernoff bound, and may leave a stratum short with a probability of about 1e-6.

    Strata are counted by partial aggregation.  Approximate samples need no exchange of the rows themselves.
    """
    if not 0 < fraction <= 1:
        raise ValueError("the fraction must be above 0 and at most 1")
    distribution = Distribution(distribution) if distribution else None
    precision = Precision(precision)
    if distribution and not distribution_fields:
        raise ValueError("a distribution needs distribution fields")
    if distribution is None:
        if precision is Precision.EXACT:
            raise ValueError("an exact sample needs a distribution")
        if not fields and by is None:
            return Sample(df.sample(False, fraction, seed))
        return Sample(df.where((roll(df, fields, algorithm, seed, encoding) if by is None else by) < fraction))
    deterministic = bool(fields) or by is not None
    drawn = by if by is not None else roll(df, fields, algorithm, seed, encoding) if fields else F.rand(seed)
    rows = df.withColumn("stratum", stratum(df, distribution_fields, as_set))
    population = strata(rows)
    done = lambda kept: Sample(kept, population, fraction, distribution)
    if precision is Precision.EXACT:
        ties = [F.col(f"`{c}`") for c, t in df.dtypes if not t.startswith(("map", "array", "struct", "variant"))]
        aimed = population.withColumn("_target", targets(distribution, fraction)).select("stratum", "c", "_target")
        rolled = rows.withColumn("_roll", drawn)
        if not deterministic:
            if prune:
                bounds = aimed.select("stratum", chernoff_bounds(F.col("c"), F.col("_target") / F.col("c"), 1e-6)[1].alias("_most"))
                rolled = rolled.join(bounds, "stratum").where(F.col("_roll") <= F.col("_most")).drop("_most")
            rolled = written_once(rolled)
        return done(_smallest(rolled, aimed.drop("c"), ties))
    if distribution is Distribution.STRATIFIED:
        return done(rows.where(drawn < fraction if deterministic else drawn <= fraction))
    chances = uniform_parameters(population, fraction).select("stratum", "p")
    met = rows.withColumn("_roll", drawn).join(chances, "stratum")
    return done(met.where((F.col("_roll") < F.col("p")) if deterministic else (F.col("_roll") <= F.col("p"))).drop("_roll", "p"))
