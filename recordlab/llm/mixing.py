"""Mixing sources to target weights by Sainte-Laguë apportionment, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ._space import Workspace, row_key

WORDS = r"[^\x20\x09-\x0D]+"
#: Rows of a shard, and blocks for each row on average.
SHARD, BLOCKS = 512, 16


def _draw(*parts: Column | str) -> Column:
    """A number below 2^32 that depends on the parts alone."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *[F.coalesce((p if isinstance(p, Column) else F.col(p)).cast("string"), F.lit("null")) for p in parts])), 1, 8), 16, 10).cast("long")


def _apportion(parties: DataFrame, votes: str, seats: Column, by: list[str], tie: list[str]) -> DataFrame:
    """``parties`` with ``quota``: the seats whose quotients votes / (2 s - 1) are the highest of all; ``votes`` are long.

    A divisor that grants too few seats and one that grants too many bound each party's quota; only the seats between
    them, about three for each party, are ranked.  They are ranked by the whole part of the quotient and then by its
    fraction, which tells different quotients apart while a party has fewer than 2**25 seats.
    """
    group = W.partitionBy(*by) if by else W.partitionBy(F.lit(0))
    bounded = (
        parties.withColumn("_t", seats.cast("double")).withColumn("_v", F.col(votes).cast("double"))
        .withColumn("_n", F.count("*").over(group)).withColumn("_all", F.sum("_v").over(group))
        .withColumn("_low", F.when(F.col("_v") > 0, F.greatest(F.lit(0), F.floor(F.col("_v") * (F.col("_t") - F.col("_n") / 2) / F.col("_all") + 0.5) - 1)).otherwise(F.lit(0)).cast("long"))
        .withColumn("_high", F.when(F.col("_v") > 0, F.floor(F.col("_v") * (F.col("_t") + F.col("_n") / 2) / F.col("_all") + 0.5) + 1).otherwise(F.lit(0)).cast("long"))
        .withColumn("_left", F.col("_t") - F.sum("_low").over(group))
    )
    whole, rest = F.expr(f"`{votes}` div (2 * _seat - 1)"), F.expr(f"(`{votes}` % (2 * _seat - 1)) / (2 * _seat - 1)")
    ranked = (
        bounded.withColumn("_seat", F.explode_outer(F.when(F.col("_high") > F.col("_low"), F.sequence(F.col("_low") + 1, F.col("_high")))))
        .withColumn("_rank", F.row_number().over(group.orderBy(whole.desc_nulls_last(), rest.desc_nulls_last(), *tie, "_seat")))
    )
    keep = [c for c in parties.columns]
    return ranked.groupBy(*keep).agg((F.first("_low") + F.sum(F.when(F.col("_seat").isNotNull() & (F.col("_rank") <= F.col("_left")), 1).otherwise(0))).cast("long").alias("quota"))


def _mixed(docs: DataFrame, weights: tuple[int, ...], share: float, most: int, seed: int) -> DataFrame:
    space = Workspace(docs.sparkSession, "mixing")
    sized = docs.select("doc_id", F.col("source").alias("source"), F.coalesce(F.regexp_count("text", F.lit(WORDS)), F.lit(0)).cast("long").alias("size"), F.md5(F.coalesce("text", F.lit(""))).alias("digest"))
    sized = space.put(sized, "sized")
    per = sized.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("size").alias("source_size"))
    one, order = W.partitionBy(F.lit(0)), W.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    cycle = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    rise = W.partitionBy(F.lit(0)).orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
    sources = (
        per.withColumn("weight", cycle.cast("double")).withColumn("cap", (most * F.col("source_size")).cast("double")).withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("goal", share * F.sum("source_size").over(one).cast("double")).withColumn("rows", F.sum("n_docs").over(one))
        .withColumn("rest", F.col("goal") - F.coalesce(F.sum("cap").over(rise), F.lit(0.0))).withColumn("heavy", F.sum("weight").over(one) - F.coalesce(F.sum("weight").over(rise), F.lit(0.0)))
        .withColumn("level", F.min(F.when(F.col("rest") * F.col("weight") <= F.col("cap") * F.col("heavy"), F.struct("ratio", F.col("source").isNull(), "source", (F.col("rest") / F.col("heavy")).alias("level")))).over(one)["level"])
        .withColumn("target", F.least("cap", F.col("level") * F.col("weight"))).withColumn("votes", F.round("target").cast("long"))
        .withColumn("block", F.greatest(F.lit(1), F.expr(f"cast(goal / {share!r} as long) div (rows * {BLOCKS})")))
        .withColumn("seats", F.round(F.sum("votes").over(one) / F.col("block")).cast("long"))
        .withColumn("n_shards", F.ceil(F.col("n_docs") / SHARD)).withColumn("n_sections", F.ceil(F.sqrt("n_shards")))
        .select("source", "n_shards", "n_sections", "source_size", "target", "votes", "block", "seats")
    )
    sources = space.put(_apportion(sources, "votes", F.col("seats"), [], [F.col("source").asc_nulls_last()]).withColumnRenamed("quota", "source_quota"), "sources")
    table = sources.withColumnRenamed("source", "_source")
    of_source = F.col("source").eqNullSafe(F.col("_source"))
    dealt = sized.join(table, of_source).drop("_source").withColumn("draw", _draw(F.lit(seed), "doc_id", "digest"))
    dealt = dealt.withColumn("shard", F.col("draw") % F.col("n_shards"))
    cell = W.partitionBy("source", "shard").orderBy("draw", "doc_id", "digest").rowsBetween(W.unboundedPreceding, W.currentRow)
    placed = space.put(dealt.withColumn("end", F.sum("size").over(cell)).select("doc_id", "source", "size", "digest", "draw", "source_size", "target", "shard", "end"), "placed")
    shards = placed.groupBy("source", "shard").agg(F.sum("size").alias("shard_size")).join(table, of_source)
    shards = space.put(shards.select("source", "shard", (F.col("shard") % F.col("n_sections")).alias("section"), "shard_size", "block", "source_quota"), "shards")
    sections = shards.groupBy("source", "section", "source_quota").agg(F.sum("shard_size").alias("section_size"))
    sections = _apportion(sections, "section_size", F.col("source_quota"), ["source"], [F.col("section")])
    sections = space.put(sections.select(F.col("source").alias("_source"), F.col("section").alias("_section"), F.col("quota").alias("section_quota")), "sections")
    shards = shards.join(sections, of_source & (F.col("section") == F.col("_section"))).drop("_source", "_section")
    shards = _apportion(shards, "shard_size", F.col("section_quota"), ["source", "section"], [F.col("shard")])
    n = F.ceil(F.col("shard_size") / F.col("block"))
    cells = (
        shards.where("shard_size > 0").withColumn("n", n).withColumn("q", F.least("quota", most * F.col("n")))
        .withColumn("whole", F.expr("q div n")).withColumn("more", F.expr("q % n"))
        .withColumn("from", _draw(F.lit(seed), "source", "shard", F.lit("start")) % F.col("n"))
        .select(F.col("source").alias("_source"), F.col("shard").alias("_shard"), "shard_size", "whole", (F.col("from") * F.col("block")).alias("lo"), ((F.col("from") + F.col("more")) * F.col("block")).alias("hi"), (F.col("n") * F.col("block")).alias("turn"))
    )
    cells = space.put(cells, "cells")
    begin, end = F.col("end") - F.col("size"), F.col("end")
    met = lambda lo, hi: F.greatest(F.lit(0), F.least(end, hi) - F.greatest(begin, lo))
    taken = F.col("whole") * F.col("size") + met(F.col("lo"), F.col("hi")) + met(F.col("lo") - F.col("turn"), F.col("hi") - F.col("turn"))
    out = placed.join(cells, of_source & (F.col("shard") == F.col("_shard")), "left")
    return out.select("doc_id", "source", "size", "digest", "draw", "shard", "source_size", "target", F.coalesce(taken, F.lit(0)).cast("long").alias("taken"))


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: int = 2, seed: int = 17) -> DataFrame:
    """doc_id, size, source_size, target and taken of every row of ``docs`` (doc_id, text, source).

    A row's size is its number of words (null text: 0).  The sources, by code point with null last, weigh ``weights``
    in turn and share ``share`` times all words; a target stops at ``most`` times its source's words and the excess is
    shared by weight among the others.  Blocks of equal numbers of words are allocated by highest quotients to sources,
    within a source to sections, and within a section to shards of about 512 rows; a source has as many sections as a
    section has shards, so no ranking grows with the rows of a source but with their square root.  A shard whose quota
    is q of n blocks is taken q div n times whole, and once more over q mod n blocks that follow a seeded one in the
    shard's seeded order.  ``taken`` is the number of words of the row that the mix takes, repeats counted; it never
    exceeds ``most`` times the size.

    Reruns agree.  Rows without words take nothing; an empty table gives an empty result.  Rows are dealt by doc_id
    and text, so rows without a doc_id spread as others do; only rows that repeat both are dealt to one shard, where
    they share what falls on them in some order.  Sources are ranked in one task, a row a source.
    """
    return _mixed(docs, weights, share, most, seed).select("doc_id", "size", "source_size", "target", "taken")


def mix_documents(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: int = 2, seed: int = 17) -> DataFrame:
    """The rows of ``docs`` as a mix of whole documents: each row not at all, or up to ``most`` times.

    What :func:`mix_sources` takes of each row is rounded to whole copies, large documents of a shard first; what
    rounding leaves over or short is carried to the shard's next document, and no more than the documents that follow
    can make up for, so that the words of a shard, and so those of a source, come within about the size of its smallest
    documents of what is taken.  Rows without words go; rows
    equal in doc_id, source and text share what is taken of them; all columns pass through.
    """
    space = Workspace(docs.sparkSession, "mix")
    rows = F.sort_array(F.collect_list(F.struct("size", "draw", "doc_id", "digest", "taken")), asc=False)
    shards = _mixed(docs, weights, share, most, seed).where("size > 0").groupBy("source", "shard").agg(rows.alias("rows"), F.sum("taken").alias("taken"), F.sum("size").alias("size"))

    def step(acc: Column, x: Column) -> Column:
        want, taken, size = acc["carry"] + x["taken"], acc["taken"] - x["taken"], acc["size"] - x["size"]
        # No more than the documents that follow can give back, and no less than they can make up for.
        high, low = F.floor((want + taken) / x["size"]), F.ceil((want + taken - most * size) / x["size"])
        times = F.least(F.lit(most), F.greatest(F.lit(0), F.least(high, F.greatest(low, F.floor(want / x["size"] + 0.5))))).cast("int")
        return F.struct((want - times * x["size"]).alias("carry"), taken.alias("taken"), size.alias("size"), F.concat(acc["times"], F.array(times)).alias("times"))

    start = F.struct(F.lit(0).cast("long").alias("carry"), F.col("taken"), F.col("size"), F.array().cast("array<int>").alias("times"))
    each = shards.withColumn("times", F.aggregate("rows", start, step, lambda acc: acc["times"])).select("source", F.explode(F.arrays_zip("rows", "times")).alias("x"))
    each = each.select("source", "x.rows.doc_id", "x.rows.digest", "x.times").where("times > 0")
    # Of rows that are equal, so many are taken so many times.
    same = row_key("doc_id", "source", "digest")
    counts = space.put(each.groupBy(same.alias("_same")).agg(*[F.count_if(F.col("times") >= t).alias(f"_{t}") for t in range(1, most + 1)]), "times")
    keyed = docs.withColumn("_row", row_key("doc_id", "source", F.md5(F.coalesce("text", F.lit("")))))
    met = keyed.hint("merge").join(counts, F.col("_row") == F.col("_same"))
    nth = F.row_number().over(W.partitionBy("_row").orderBy(F.lit(0)))  # shares the join's exchange
    times = sum((F.when(F.col("_nth") <= F.col(f"_{t}"), 1).otherwise(0) for t in range(1, most + 1)), F.lit(0))
    taken = met.withColumn("_nth", nth).withColumn("_times", times).where("_times > 0")
    return taken.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_times")))).select(*[F.col(f"`{c}`") for c in docs.columns])


#: The same for DuckDB, with the weights, share and seed of the query.
ORACLE = rf"""
WITH sized AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORDS}'))::BIGINT AS size, md5(coalesce(text, '')) AS digest FROM documents),
per AS (SELECT source, count(*) AS n_docs, sum(size)::DOUBLE AS source_size FROM sized GROUP BY source),
weighed AS (SELECT *, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight, 2 * source_size AS cap,
  1.5::DOUBLE * sum(source_size) OVER () AS goal, sum(n_docs) OVER () AS nrows FROM per),
risen AS (SELECT *, cap / weight AS ratio, goal - coalesce(sum(cap) OVER r, 0) AS rest, sum(weight) OVER () - coalesce(sum(weight) OVER r, 0) AS heavy FROM weighed
  WINDOW r AS (ORDER BY cap / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
lev AS (SELECT rest / heavy AS level FROM risen WHERE rest * weight <= cap * heavy ORDER BY ratio, source ASC NULLS LAST LIMIT 1),
aimed AS (SELECT source, n_docs, source_size, least(cap, level * weight) AS target, greatest(1, (goal / 1.5)::BIGINT // (nrows * {BLOCKS}))::BIGINT AS block,
  ceil(n_docs / {SHARD}.0)::BIGINT AS n_shards, ceil(sqrt(ceil(n_docs / {SHARD}.0)))::BIGINT AS n_sections FROM risen, lev),
voted AS (SELECT *, round(target)::BIGINT AS votes FROM aimed),
seated AS (SELECT *, round(sum(votes) OVER () / block)::BIGINT AS seats FROM voted),
quotients AS (SELECT source, row_number() OVER (ORDER BY votes // (2 * s - 1) DESC, (votes % (2 * s - 1)) / (2 * s - 1) DESC, source ASC NULLS LAST, s) AS rk, seats
  FROM (SELECT source, votes, seats, unnest(range(1, (2 * target / block)::BIGINT + 4)) AS s FROM seated) WHERE votes > 0),
quota AS (SELECT source, count(*) AS source_quota FROM quotients WHERE rk <= seats GROUP BY source),
sources AS (SELECT s.*, coalesce(q.source_quota, 0) AS source_quota FROM seated s LEFT JOIN quota q ON s.source IS NOT DISTINCT FROM q.source),
drawn AS (SELECT d.*, s.n_docs, s.n_shards, s.n_sections, s.source_size, s.target, s.block, s.source_quota,
  ('0x' || substr(md5('17:' || coalesce(d.doc_id::VARCHAR, 'null') || ':' || d.digest), 1, 8))::BIGINT AS draw FROM sized d JOIN sources s ON d.source IS NOT DISTINCT FROM s.source),
dealt AS (SELECT *, draw % n_shards AS shard, draw % n_shards % n_sections AS section FROM drawn),
placed AS (SELECT *, sum(size) OVER (PARTITION BY source, shard ORDER BY draw, doc_id NULLS FIRST, digest ROWS UNBOUNDED PRECEDING)::BIGINT AS stop FROM dealt),
shards AS (SELECT source, section, shard, sum(size)::BIGINT AS shard_size, any_value(block) AS block, any_value(source_quota) AS source_quota, any_value(source_size) AS source_size FROM placed GROUP BY source, section, shard),
parts AS (SELECT source, section, sum(shard_size)::BIGINT AS section_size, any_value(source_quota) AS source_quota, any_value(source_size) AS source_size FROM shards GROUP BY source, section),
pq AS (SELECT source, section, row_number() OVER (PARTITION BY source ORDER BY section_size // (2 * s - 1) DESC, (section_size % (2 * s - 1)) / (2 * s - 1) DESC, section, s) AS rk, source_quota
  FROM (SELECT source, section, section_size, source_quota, unnest(range(1, (2 * section_size::DOUBLE * source_quota / source_size)::BIGINT + 4)) AS s FROM parts WHERE section_size > 0)),
pc AS (SELECT source, section, count(*) AS section_quota FROM pq WHERE rk <= source_quota GROUP BY source, section),
filled AS (SELECT h.*, p.section_size, coalesce(c.section_quota, 0) AS section_quota FROM shards h JOIN parts p ON h.source IS NOT DISTINCT FROM p.source AND h.section = p.section
  LEFT JOIN pc c ON h.source IS NOT DISTINCT FROM c.source AND h.section = c.section),
sq AS (SELECT source, shard, row_number() OVER (PARTITION BY source, section ORDER BY shard_size // (2 * s - 1) DESC, (shard_size % (2 * s - 1)) / (2 * s - 1) DESC, shard, s) AS rk, section_quota
  FROM (SELECT source, section, shard, shard_size, section_quota, unnest(range(1, (2 * shard_size::DOUBLE * section_quota / section_size)::BIGINT + 4)) AS s FROM filled WHERE shard_size > 0)),
sc AS (SELECT source, shard, count(*) AS quota FROM sq WHERE rk <= section_quota GROUP BY source, shard),
cells AS (SELECT h.source, h.shard, h.block, h.n, least(coalesce(c.quota, 0), 2 * h.n) AS q,
  ('0x' || substr(md5('17:' || coalesce(h.source, 'null') || ':' || h.shard::VARCHAR || ':start'), 1, 8))::BIGINT % h.n AS frm
  FROM (SELECT *, ceil(shard_size::DOUBLE / block)::BIGINT AS n FROM shards WHERE shard_size > 0) h LEFT JOIN sc c ON h.source IS NOT DISTINCT FROM c.source AND h.shard = c.shard),
runs AS (SELECT *, frm * block AS lo, (frm + q % n) * block AS hi, n * block AS turn, q // n AS whole FROM cells)
SELECT p.doc_id, p.size, p.source_size::BIGINT AS source_size, p.target,
  coalesce(whole * size + greatest(0, least(stop, hi) - greatest(stop - size, lo)) + greatest(0, least(stop, hi - turn) - greatest(stop - size, lo - turn)), 0)::BIGINT AS taken
FROM placed p LEFT JOIN runs r ON p.source IS NOT DISTINCT FROM r.source AND p.shard = r.shard
"""
