"""Registered queries of the comparison, sampling and generation operators, each with its SQL where SQL can say it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions.hashing import bound, fingerprint, md5_roll
from .operators import generate as G
from .operators.diff import Diff, diff
from .operators.sampling import chernoff_bounds, sample, strata, stratum, top_k_by_key, uniform_parameters
from .operators.take import head, head_of_files, reservoir
from .plans.schema import flatten, from_table_json
from .session import shared_dir
from .sources import messages
from .sources.io import as_tsv, read, read_pair, save_stats, schema_of, timestamp_text, write, write_once
from .streaming.sampling import sample_stream

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with the SQL that gives the same rows."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Comparison -----------------------------------------------------------------------------------------------------


def _orders(spark: SparkSession, d: str, **options) -> Diff:
    """Orders against a copy with rows missing on both sides, prices raised and priorities lowered."""
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority")
    k = F.col("o_orderkey")
    price = F.when(k % 7 == 0, F.col("o_totalprice") + (k % 10 + 1)).otherwise(F.col("o_totalprice"))
    priority = F.when(k % 5 == 0, F.lower("o_orderpriority")).otherwise(F.col("o_orderpriority"))
    return diff(o.where(k % 11 != 0), o.where(k % 13 != 0).select("o_orderkey", price.alias("o_totalprice"), priority.alias("o_orderpriority")), ["o_orderkey"], **options)


_ORDERS = """
WITH l AS (SELECT o_orderkey, o_totalprice, o_orderpriority FROM orders WHERE o_orderkey % 11 <> 0),
r AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN o_totalprice + (o_orderkey % 10 + 1) ELSE o_totalprice END AS o_totalprice,
  CASE WHEN o_orderkey % 5 = 0 THEN lower(o_orderpriority) ELSE o_orderpriority END AS o_orderpriority FROM orders WHERE o_orderkey % 13 <> 0),
j AS (SELECT coalesce(l.o_orderkey, r.o_orderkey)::VARCHAR AS key, l.o_orderkey AS lk, r.o_orderkey AS rk, l.o_totalprice AS lp, r.o_totalprice AS rp, l.o_orderpriority AS lo, r.o_orderpriority AS ro
  FROM l FULL JOIN r ON l.o_orderkey = r.o_orderkey),
c AS (SELECT *, CASE WHEN lk IS NULL THEN 'MISSING_LHS' WHEN rk IS NULL THEN 'MISSING_RHS' WHEN lp = rp AND lo = ro THEN 'SAME' ELSE 'DIFFERENT' END AS diff_type FROM j),
d AS (SELECT key, 'o_totalprice' AS field, 'NUMERIC' AS delta_type, rp - lp AS delta_value FROM c WHERE diff_type = 'DIFFERENT' AND lp <> rp
  UNION ALL SELECT key, 'o_orderpriority', 'STRING', levenshtein(lo, ro)::DOUBLE FROM c WHERE diff_type = 'DIFFERENT' AND lo <> ro)
"""
_COUNTS = """SELECT count(*)::BIGINT AS num_total, count_if(diff_type = 'SAME')::BIGINT AS num_same, count_if(diff_type = 'DIFFERENT')::BIGINT AS num_diff,
  count_if(diff_type = 'MISSING_LHS')::BIGINT AS num_missing_lhs, count_if(diff_type = 'MISSING_RHS')::BIGINT AS num_missing_rhs FROM c"""
_MOMENTS = """SELECT field, count(*)::BIGINT AS count, round(count(*) / any_value(n)::DOUBLE, 6) AS fraction, min(delta_type) AS delta_type, round(min(v), 4) AS min, round(max(v), 4) AS max, count(v)::BIGINT AS delta_count,
  round(avg(v), 4) AS mean, round(var_pop(v), 4) AS variance, round(stddev_pop(v), 4) AS stddev, round(avg((v - mu) ** 3) / nullif(var_pop(v), 0) ** 1.5, 3) AS skewness, round(avg((v - mu) ** 4) / nullif(var_pop(v), 0) ** 2 - 3, 3) AS kurtosis"""


def _flat(df: DataFrame) -> DataFrame:
    return df.select("key", "field", "delta_type", F.round("delta_value", 6).alias("delta_value"))


def _rounded(df: DataFrame) -> DataFrame:
    r = lambda c, n: F.round(c, n).alias(c)
    return df.select("field", "count", r("fraction", 6), "delta_type", *[r(c, 4) for c in ("min", "max")], "delta_count", *[r(c, 4) for c in ("mean", "variance", "stddev")], *[r(c, 3) for c in ("skewness", "kurtosis")])


@query(_ORDERS + _COUNTS)
def diff_global_stats(spark, d):
    return _orders(spark, d).global_stats


@query(_ORDERS + "SELECT c.key, c.diff_type, d.field, d.delta_type, round(d.delta_value, 6) AS delta_value FROM c LEFT JOIN d ON c.key = d.key")
def diff_key_stats(spark, d):
    return _orders(spark, d).key_stats.select("key", "diff_type", "delta.field", F.col("delta.delta.deltaType").alias("delta_type"), F.round("delta.delta.deltaValue", 6).alias("delta_value"))


@query(_ORDERS + "SELECT key, field, delta_type, round(delta_value, 6) AS delta_value FROM d")
def diff_deltas(spark, d):
    return _flat(_orders(spark, d).deltas)


@query(_ORDERS + ", m AS (SELECT field, delta_type, delta_value AS v, avg(delta_value) OVER (PARTITION BY field) AS mu, (SELECT count(*) FROM c WHERE diff_type = 'DIFFERENT') AS n FROM d) " + _MOMENTS + " FROM m GROUP BY field")
def diff_field_stats(spark, d):
    return _rounded(_orders(spark, d).field_stats)


@query(_ORDERS + "SELECT key FROM c WHERE diff_type = 'MISSING_LHS'")
def diff_missing_lhs(spark, d):
    return _orders(spark, d).missing("lhs")


@query(_ORDERS + "SELECT key FROM c WHERE diff_type = 'MISSING_RHS'")
def diff_missing_rhs(spark, d):
    return _orders(spark, d).missing("rhs")


@query(_ORDERS.replace("lp = rp AND lo = ro", "lo = ro") + _COUNTS)
def diff_ignore_fields(spark, d):
    return _orders(spark, d, ignore=("o_totalprice",)).global_stats


@query(_ORDERS.replace("% 11 <> 0", "% 11 <> 0 AND o_orderpriority < '3'").replace("% 13 <> 0", "% 13 <> 0 AND o_orderpriority < '3'") + _COUNTS)
def diff_row_restriction(spark, d):
    return _orders(spark, d, where="o_orderpriority < '3'").global_stats


@query("""WITH l AS (SELECT conv_id::VARCHAR || '_' || turn::VARCHAR AS key, role FROM conversations WHERE turn % 5 <> 4), r AS (SELECT conv_id::VARCHAR || '_' || turn::VARCHAR AS key, CASE WHEN conv_id % 3 = 0 THEN upper(role) ELSE role END AS role FROM conversations)
SELECT coalesce(l.key, r.key) AS key, CASE WHEN l.key IS NULL THEN 'MISSING_LHS' WHEN r.key IS NULL THEN 'MISSING_RHS' WHEN l.role IS NOT DISTINCT FROM r.role THEN 'SAME' ELSE 'DIFFERENT' END AS diff_type FROM l FULL JOIN r ON l.key = r.key""")
def diff_composite_key(spark, d):
    c = table(spark, d, "conversations").select("conv_id", "turn", "role")
    other = c.withColumn("role", F.when(F.col("conv_id") % 3 == 0, F.upper("role")).otherwise(F.col("role")))
    return diff(c.where("turn % 5 <> 4"), other, ["conv_id", "turn"]).compared.select("key", "diff_type")


@query("""WITH l AS (SELECT coalesce(nullif(c_custkey, 7)::VARCHAR, 'null') AS key, c_mktsegment AS s FROM customer), r AS (SELECT coalesce(nullif(c_custkey, 7)::VARCHAR, 'null') AS key, CASE WHEN c_custkey % 4 = 3 THEN 'NONE' ELSE c_mktsegment END AS s FROM customer WHERE c_custkey % 9 <> 1)
SELECT coalesce(l.key, r.key) AS key, CASE WHEN l.key IS NULL THEN 'MISSING_LHS' WHEN r.key IS NULL THEN 'MISSING_RHS' WHEN l.s = r.s THEN 'SAME' ELSE 'DIFFERENT' END AS diff_type FROM l FULL JOIN r ON l.key = r.key""")
def diff_null_key(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    key = F.when(F.col("c_custkey") != 7, F.col("c_custkey")).alias("c_custkey")
    other = c.where("c_custkey % 9 <> 1").select(key, F.when(F.col("c_custkey") % 4 == 3, "NONE").otherwise(F.col("c_mktsegment")).alias("c_mktsegment"))
    return diff(c.select(key, "c_mktsegment"), other, ["c_custkey"]).compared.select("key", "diff_type")


@query("""SELECT side, key, count(*)::BIGINT AS count FROM (SELECT 'lhs' AS side, l_orderkey::VARCHAR || '_' || l_linenumber::VARCHAR AS key FROM lineitem UNION ALL SELECT 'rhs', l_orderkey::VARCHAR || '_' || l_linenumber::VARCHAR FROM lineitem WHERE l_quantity > 25) GROUP BY side, key HAVING count(*) > 1""")
def diff_duplicate_keys(spark, d):
    x = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return diff(x, x.where("l_quantity > 25"), ["l_orderkey", "l_linenumber"]).duplicate_keys()


@query("""SELECT c_custkey::VARCHAR AS key, 'c_mktsegment' AS field, 'STRING' AS delta_type, levenshtein(c_mktsegment, reverse(c_mktsegment))::DOUBLE AS delta_value FROM customer WHERE c_custkey % 2 = 0 AND c_mktsegment <> reverse(c_mktsegment)""")
def diff_string_delta(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    other = c.withColumn("c_mktsegment", F.when(F.col("c_custkey") % 2 == 0, F.reverse("c_mktsegment")).otherwise(F.col("c_mktsegment")))
    return _flat(diff(c, other, ["c_custkey"]).deltas)


@query("""SELECT vec_id::VARCHAR AS key, 'embedding' AS field, 'VECTOR' AS delta_type, round(list_cosine_distance(embedding::DOUBLE[], list_reverse(embedding)::DOUBLE[]), 5) AS delta_value FROM embeddings WHERE vec_id % 3 = 0 AND embedding <> list_reverse(embedding)""")
def diff_vector_delta(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    other = e.withColumn("embedding", F.when(F.col("vec_id") % 3 == 0, F.reverse("embedding")).otherwise(F.col("embedding")))
    return diff(e, other, ["vec_id"]).deltas.select("key", "field", "delta_type", F.round("delta_value", 5).alias("delta_value"))


def _lists(spark, d) -> tuple[DataFrame, DataFrame]:
    o = table(spark, d, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list("o_orderpriority")).alias("p"))
    k = F.col("o_custkey")
    return o, o.select("o_custkey", F.when(k % 5 == 0, F.concat("p", F.array(F.lit("X")))).when(k % 2 == 0, F.reverse("p")).otherwise(F.col("p")).alias("p"))


_LISTS = "WITH o AS (SELECT o_custkey AS k, list_sort(list(o_orderpriority)) AS p FROM orders GROUP BY o_custkey) SELECT k::VARCHAR AS key, 'p' AS field, 'UNKNOWN' AS delta_type, NULL::DOUBLE AS delta_value FROM o WHERE k % 5 = 0"


@query(_LISTS + " OR k % 2 = 0 AND p <> list_reverse(p)")
def diff_array_ordered(spark, d):
    return _flat(diff(*_lists(spark, d), ["o_custkey"]).deltas)


@query(_LISTS)
def diff_array_unordered(spark, d):
    return _flat(diff(*_lists(spark, d), ["o_custkey"], unordered=("p",)).deltas)


def _keyed(spark, d, **options) -> Diff:
    lines = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").alias("qty"))
    nest = lambda x: x.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "qty"))).alias("lines"))
    moved = lines.where("not (l_linenumber = 4 and l_orderkey % 5 = 0)").withColumn("qty", F.when((F.col("l_linenumber") % 3 == 0) & (F.col("l_orderkey") % 2 == 0), F.col("qty") + 1).otherwise(F.col("qty")))
    return diff(nest(lines), nest(moved), ["l_orderkey"], keyed={"lines": "l_linenumber"}, **options)


_KEYED = """WITH l AS (SELECT l_orderkey AS k, l_linenumber AS n, max(l_quantity) AS q FROM lineitem GROUP BY ALL),
r AS (SELECT k, n, CASE WHEN n % 3 = 0 AND k % 2 = 0 THEN q + 1 ELSE q END AS q FROM l WHERE NOT (n = 4 AND k % 5 = 0))
"""


@query(_KEYED + """SELECT l.k::VARCHAR AS key, 'lines[' || l.n || ']' || CASE WHEN r.k IS NULL THEN '' ELSE '.qty' END AS field, CASE WHEN r.k IS NULL THEN 'UNKNOWN' ELSE 'NUMERIC' END AS delta_type, r.q - l.q AS delta_value
FROM l LEFT JOIN r ON l.k = r.k AND l.n = r.n WHERE l.k IN (SELECT k FROM r) AND (r.k IS NULL OR r.q <> l.q)""")
def diff_keyed_array(spark, d):
    return _flat(_keyed(spark, d).deltas)


@query(_KEYED + """SELECT key, field, delta_type, delta_value FROM (
SELECT DISTINCT l.k::VARCHAR AS key, f.field, CASE WHEN r.k IS NULL THEN 'UNKNOWN' ELSE 'NUMERIC' END AS delta_type, r.q - l.q AS delta_value, CASE WHEN f.field = 'lines.qty' THEN l.q ELSE l.n END AS was
FROM l LEFT JOIN r ON l.k = r.k AND l.n = r.n, (VALUES ('lines.qty'), ('lines.l_linenumber')) f(field) WHERE l.k IN (SELECT k FROM r) AND (r.k IS NULL OR r.q <> l.q AND f.field = 'lines.qty'))""")
def diff_keyed_array_unindexed(spark, d):
    # Equal differences of two elements collapse in this form.
    return _flat(_keyed(spark, d, indexed_paths=False).deltas)


@query("""WITH l AS (SELECT o_custkey AS k, o_orderpriority AS p, count(*) AS n FROM orders GROUP BY ALL), r AS (SELECT o_custkey AS k, o_orderpriority AS p, count(*) AS n FROM orders WHERE o_orderkey % 4 <> 0 GROUP BY ALL)
SELECT l.k::VARCHAR AS key, 'm[' || l.p || ']' AS field, CASE WHEN r.n IS NULL THEN 'UNKNOWN' ELSE 'NUMERIC' END AS delta_type, (r.n - l.n)::DOUBLE AS delta_value FROM l LEFT JOIN r ON l.k = r.k AND l.p = r.p WHERE l.k IN (SELECT k FROM r) AND r.n IS DISTINCT FROM l.n""")
def diff_map(spark, d):
    o = table(spark, d, "orders")
    counts = lambda x: x.groupBy("o_custkey", "o_orderpriority").agg(F.count("*").alias("n")).groupBy("o_custkey").agg(F.map_from_entries(F.collect_list(F.struct("o_orderpriority", "n"))).alias("m"))
    return _flat(diff(counts(o), counts(o.where("o_orderkey % 4 <> 0")), ["o_custkey"]).deltas)


@query("""WITH e AS (SELECT event_id, (props->>'k')::BIGINT AS k FROM events)
SELECT event_id::VARCHAR AS key, CASE WHEN event_id % 17 = 0 THEN 'info.props' ELSE 'info.props.k' END AS field, CASE WHEN event_id % 17 = 0 THEN 'UNKNOWN' ELSE 'NUMERIC' END AS delta_type, CASE WHEN event_id % 17 <> 0 THEN 5::DOUBLE END AS delta_value FROM e WHERE event_id % 17 = 0 OR event_id % 3 = 0 AND k IS NOT NULL""")
def diff_nested_struct(spark, d):
    e = table(spark, d, "events").select("event_id", "event_type", F.from_json("props", "k long").alias("props"))
    i = F.col("event_id")
    moved = F.when(i % 17 == 0, F.lit(None)).when(i % 3 == 0, F.struct((F.col("props.k") + 5).alias("k"))).otherwise(F.col("props"))
    return _flat(diff(e.select("event_id", F.struct("event_type", "props").alias("info")), e.select("event_id", F.struct("event_type", moved.alias("props")).alias("info")), ["event_id"]).deltas)


@query("""SELECT p_partkey::VARCHAR AS key, 'size' AS field, 'NUMERIC' AS delta_type, 3::DOUBLE AS delta_value FROM part WHERE p_partkey % 2 = 0
UNION ALL SELECT p_partkey::VARCHAR, 'brand', 'STRING', 1::DOUBLE FROM part WHERE p_partkey % 3 = 0""")
def diff_generic_text(spark, d):
    p = table(spark, d, "part")
    k = F.col("p_partkey")
    other = p.select(k, (F.col("p_size") + F.when(k % 2 == 0, 3).otherwise(0)).cast("string").alias("size"), F.concat("p_brand", F.when(k % 3 == 0, "!").otherwise("")).alias("brand"))
    return _flat(diff(p.select(k, F.col("p_size").cast("string").alias("size"), F.col("p_brand").alias("brand")), other, ["p_partkey"], numeric_text=True).deltas)


@query("""SELECT n_nationkey::VARCHAR AS key, 'note' AS field, 'UNKNOWN' AS delta_type, NULL::DOUBLE AS delta_value FROM nation WHERE n_nationkey % 2 = 0""")
def diff_schema_union(spark, d):
    n = table(spark, d, "nation")
    return _flat(diff(n, n.withColumn("note", F.when(F.col("n_nationkey") % 2 == 0, "even")), ["n_nationkey"]).deltas)


@query("""WITH m AS (SELECT 'o_totalprice' AS field, CASE WHEN o_orderkey % 6 <> 0 THEN (o_totalprice + (o_orderkey % 10 + 1)) - o_totalprice END AS v FROM orders WHERE o_orderkey % 2 = 0 OR o_orderkey % 6 = 0)
SELECT field, count(*)::BIGINT AS count, count(v)::BIGINT AS delta_count, round(avg(v), 4) AS mean FROM m GROUP BY field""")
def diff_nan_policy(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    k = F.col("o_orderkey")
    other = o.withColumn("o_totalprice", F.when(k % 6 == 0, F.lit(float("nan"))).when(k % 2 == 0, F.col("o_totalprice") + (k % 10 + 1)).otherwise(F.col("o_totalprice")))
    return diff(o, other, ["o_orderkey"], ignore_nan=True).field_stats.select("field", "count", "delta_count", F.round("mean", 4).alias("mean"))


@query("""SELECT n_nationkey::VARCHAR AS key, 'n_regionkey' AS field, 'NUMERIC' AS delta_type, CASE WHEN n_nationkey = 3 THEN 2 ELSE 0 END::DOUBLE AS delta_value FROM nation UNION ALL SELECT n_nationkey::VARCHAR, 'n_name', 'STRING', 0 FROM nation""")
def diff_emit_equal(spark, d):
    n = table(spark, d, "nation")
    return _flat(diff(n, n.withColumn("n_regionkey", F.when(F.col("n_nationkey") == 3, F.col("n_regionkey") + 2).otherwise(F.col("n_regionkey"))), ["n_nationkey"], emit_equal=True).deltas)


@query("SELECT s_suppkey::VARCHAR AS key, 's_acctbal' AS field, 'NUMERIC' AS delta_type, abs(round(s_acctbal) - s_acctbal) AS delta_value FROM (SELECT s_suppkey, round(s_acctbal, 2) AS s_acctbal FROM supplier) WHERE round(s_acctbal) <> s_acctbal".replace("abs(round(s_acctbal) - s_acctbal)", "round(abs(round(s_acctbal) - s_acctbal), 6)"))
def diff_overridden_measure(spark, d):
    s = table(spark, d, "supplier").select("s_suppkey", F.round("s_acctbal", 2).alias("s_acctbal"))
    return _flat(diff(s, s.withColumn("s_acctbal", F.round("s_acctbal")), ["s_suppkey"], overrides={"s_acctbal": lambda a, b: F.abs(b - a)}).deltas)


@query("""SELECT c_custkey::VARCHAR AS key, 'n' AS field, 'NUMERIC' AS delta_type, -1::DOUBLE AS delta_value FROM customer WHERE c_custkey % 6 = 0""")
def diff_defaults(spark, d):
    """An absent leaf stands for its default: 1 against nothing differs, 0 against nothing does not."""
    c = table(spark, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, F.when(F.col("c_custkey") % 3 == 0, 1).otherwise(0)).alias("n"))
    return _flat(diff(c, c.withColumn("n", F.lit(None).cast("int")), ["c_custkey"], defaults={"n": 0}).deltas)


@query("""SELECT c_custkey::VARCHAR AS key, CASE WHEN c_custkey % 3 = 0 THEN 'DIFFERENT' ELSE 'SAME' END AS diff_type FROM customer""")
def diff_preprocessed(spark, d):
    """Nulls become 0 on both sides before they are compared."""
    c = table(spark, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, F.col("c_nationkey")).alias("n"))
    other = c.withColumn("n", F.when(F.col("c_custkey") % 3 == 0, F.coalesce("n", F.lit(0)) + 1).otherwise(F.coalesce("n", F.lit(0))))
    return diff(c, other, ["c_custkey"], pre=lambda df: df.fillna({"n": 0})).compared.select("key", "diff_type")


# Sampling -------------------------------------------------------------------------------------------------------


def _roll(text: str, seed: int = 0) -> str:
    return f"(('0x' || substr(md5('{seed}|' || {text}), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0)"


@query(f"SELECT o_orderkey, o_custkey FROM orders WHERE {_roll('o_custkey::VARCHAR', 5)} < 0.1::DOUBLE")
def sample_hash_md5(spark, d):
    return sample(table(spark, d, "orders").select("o_orderkey", "o_custkey"), 0.1, ["o_custkey"], seed=5, algorithm="md5").rows


@query()
def sample_hash_farm(spark, d):
    return sample(table(spark, d, "orders").select("o_orderkey", "o_custkey"), 0.1, ["o_custkey"], seed=42).rows


@query()
def sample_hash_murmur(spark, d):
    return sample(table(spark, d, "orders").select("o_orderkey", "o_custkey"), 0.1, ["o_custkey"], seed=42, algorithm="murmur").rows


_BY_LANG = f"""WITH p AS (SELECT lang AS stratum, count(*) AS c FROM documents GROUP BY lang), s AS (SELECT doc_id, lang AS stratum, {_roll('doc_id::VARCHAR')} AS roll FROM documents),
u AS (SELECT *, sum(c) OVER () * 0.2::DOUBLE / count(*) OVER () AS pop FROM p)
"""


@query(_BY_LANG + """SELECT stratum, floor(c * 0.2::DOUBLE)::DOUBLE AS target, coalesce(n, 0)::BIGINT AS actual, round((floor(c * 0.2::DOUBLE) - coalesce(n, 0)) / nullif(floor(c * 0.2::DOUBLE), 0), 6) AS diff
FROM p LEFT JOIN (SELECT stratum, count(*) AS n FROM s WHERE roll < 0.2::DOUBLE GROUP BY stratum) USING (stratum)""")
def sample_stratified_hash(spark, d):
    got = sample(table(spark, d, "documents").select("doc_id", "lang"), 0.2, ["doc_id"], algorithm="md5", distribution="stratified", distribution_fields=["lang"])
    return got.report.withColumn("diff", F.round("diff", 6))


@query(_BY_LANG + """SELECT stratum, least(c, floor(pop))::DOUBLE AS target, coalesce(n, 0)::BIGINT AS actual, round((least(c, floor(pop)) - coalesce(n, 0)) / nullif(least(c, floor(pop)), 0), 6) AS diff
FROM u LEFT JOIN (SELECT s.stratum, count(*) AS n FROM s JOIN u USING (stratum) WHERE roll < least(pop / c, 1::DOUBLE) GROUP BY s.stratum) USING (stratum)""")
def sample_uniform_hash(spark, d):
    got = sample(table(spark, d, "documents").select("doc_id", "lang"), 0.2, ["doc_id"], algorithm="md5", distribution="uniform", distribution_fields=["lang"])
    return got.report.withColumn("diff", F.round("diff", 6))


@query(_BY_LANG + "SELECT doc_id, stratum FROM (SELECT s.*, row_number() OVER (PARTITION BY s.stratum ORDER BY roll, doc_id) AS rk, floor(c * 0.2::DOUBLE) AS t FROM s JOIN p USING (stratum)) WHERE rk <= t")
def sample_exact_stratified(spark, d):
    return sample(table(spark, d, "documents").select("doc_id", "lang"), 0.2, ["doc_id"], algorithm="md5", distribution="stratified", distribution_fields=["lang"], precision="exact").rows.select("doc_id", "stratum")


@query(f"""WITH p AS (SELECT c_mktsegment AS stratum, count(*) AS c FROM customer GROUP BY ALL), u AS (SELECT *, least(c, floor(sum(c) OVER () * 0.25::DOUBLE / count(*) OVER ())) AS t FROM p),
s AS (SELECT c_custkey, c_mktsegment AS stratum, row_number() OVER (PARTITION BY c_mktsegment ORDER BY {_roll('c_custkey::VARCHAR')}, c_custkey) AS rk FROM customer)
SELECT c_custkey, stratum FROM s JOIN u USING (stratum) WHERE rk <= t""")
def sample_exact_uniform(spark, d):
    return sample(table(spark, d, "customer").select("c_custkey", "c_mktsegment"), 0.25, ["c_custkey"], algorithm="md5", distribution="uniform", distribution_fields=["c_mktsegment"], precision="exact").rows.select("c_custkey", "stratum")


@query(_BY_LANG + "SELECT stratum, c::BIGINT AS c, round(pop, 6) AS pop, round(least(pop / c, 1::DOUBLE), 6) AS p FROM u")
def sample_uniform_params(spark, d):
    docs = table(spark, d, "documents")
    got = uniform_parameters(strata(docs.withColumn("stratum", stratum(docs, ["lang"]))), 0.2)
    return got.select("stratum", "c", F.round("pop", 6).alias("pop"), F.round("p", 6).alias("p"))


@query(_BY_LANG + """, g AS (SELECT stratum, c, 0.2::DOUBLE AS f, -ln(1e-6::DOUBLE) / c AS h, -1.5::DOUBLE * ln(1e-6::DOUBLE) / c AS l FROM p)
SELECT stratum, round(least(1::DOUBLE, f + l - sqrt(l * l + 2 * l * f)), 6) AS lower, round(f + h + sqrt(h * h + 2 * h * f), 6) AS upper FROM g""")
def sample_chernoff_bounds(spark, d):
    docs = table(spark, d, "documents")
    low, high = chernoff_bounds(F.col("c"), F.lit(0.2), 1e-6)
    return strata(docs.withColumn("stratum", stratum(docs, ["lang"]))).select("stratum", F.round(low, 6).alias("lower"), F.round(high, 6).alias("upper"))


@query("SELECT array_to_string(list_sort(list_distinct([o_orderstatus, left(o_orderpriority, 1)])), ',') AS stratum, count(*)::BIGINT AS c FROM orders GROUP BY ALL")
def sample_strata_key_set(spark, d):
    o = table(spark, d, "orders").select("o_orderstatus", F.substring("o_orderpriority", 1, 1).alias("p"))
    return strata(o.withColumn("stratum", stratum(o, ["o_orderstatus", "p"], as_set=True)))


@query()
def sample_bernoulli(spark, d):
    return sample(table(spark, d, "documents").select("doc_id", "lang"), 0.5, seed=11).rows


@query()
def sample_stratified_random(spark, d):
    return sample(table(spark, d, "documents").select("doc_id", "lang"), 0.5, seed=11, distribution="stratified", distribution_fields=["lang"]).report


@query()
def sample_uniform_random(spark, d):
    return sample(table(spark, d, "documents").select("doc_id", "lang"), 0.2, seed=11, distribution="uniform", distribution_fields=["lang"]).report


@query("SELECT c_nationkey, c_custkey, c_acctbal FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS rk FROM customer) WHERE rk <= 3")
def top_k_by_key_query(spark, d):
    return top_k_by_key(table(spark, d, "customer"), ["c_nationkey"], [F.desc("c_acctbal"), F.asc("c_custkey")], 3).select("c_nationkey", "c_custkey", "c_acctbal")


QUERIES["top_k_by_key"], ORACLE["top_k_by_key"] = QUERIES.pop("top_k_by_key_query"), ORACLE.pop("top_k_by_key_query")


@query("SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey LIMIT 25")
def take_head(spark, d):
    return head(table(spark, d, "orders").select("o_orderkey", "o_custkey"), 25, ["o_orderkey"])


@query("SELECT 100::BIGINT AS n, 100::BIGINT AS distinct_keys, 100::BIGINT AS members")
def take_reservoir(spark, d):
    o = table(spark, d, "orders").select("o_orderkey")
    got = reservoir(o, 100, seed=3)
    return got.join(o.withColumn("known", F.lit(1)), "o_orderkey", "left").agg(F.count("*").alias("n"), F.countDistinct("o_orderkey").alias("distinct_keys"), F.count("known").alias("members"))


# Generation -----------------------------------------------------------------------------------------------------


def _unit(path: str, row: str = "i::VARCHAR") -> str:
    return f"(('0x' || substr(md5('7|' || {row} || '|{path}'), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0)"


def _choose(path: str, low: int, high: int, row: str = "i::VARCHAR") -> str:
    return f"(floor({_unit(path, row)} * {high - low + 1}) + {low})::BIGINT"


@query(f"SELECT i AS id, CASE WHEN {_unit('w')} < 2/6::DOUBLE THEN 'Foo' WHEN {_unit('w')} < 4/6::DOUBLE THEN 'Bar' WHEN {_unit('w')} < 5/6::DOUBLE THEN 'Fizz' ELSE 'Buzz' END AS word FROM range(5000) t(i)")
def gen_weighted(spark, d):
    s = G.Source(F.col("id"), 7)
    return spark.range(5000).select("id", s.frequency("w", [(2, "Foo"), (2, "Bar"), (1, "Fizz"), (1, "Buzz")]).alias("word"))


@query(f"SELECT i AS id, j::BIGINT AS pos, {_choose('n', 0, 99, row=chr(39) + chr(39) + ' || i::VARCHAR || ' + chr(39) + '/' + chr(39) + ' || j::VARCHAR')} AS n FROM range(2000) t(i), range(1, 4) u(j)")
def gen_nested(spark, d):
    s = G.Source(F.col("id"), 7)
    made = spark.range(2000).select("id", F.struct(s.list_of("n", lambda e: e.choose("n", 0, 99), 3, 3).alias("numbers")).alias("r"))
    return made.select("id", F.posexplode("r.numbers")).select("id", (F.col("pos") + 1).cast("long").alias("pos"), F.col("col").alias("n"))


@query(f"""WITH g AS (SELECT i AS id, {_choose('a', 0, 9)} AS a, {_choose('e', 0, 3)} AS e FROM range(3000) t(i))
SELECT id, a, CASE WHEN a = 0 THEN 2147483647 ELSE a // 2 END::BIGINT AS half, CASE WHEN e = 0 THEN 'Exception' ELSE 'fine' END AS said, CASE WHEN e = 0 THEN 'Failure' ELSE 'Success' END AS status FROM g""")
def gen_dependent(spark, d):
    s = G.Source(F.col("id"), 7)
    made = spark.range(3000).select("id", s.choose("a", 0, 9).alias("a"), F.when(s.choose("e", 0, 3) == 0, "Exception").otherwise("fine").alias("said"))
    return made.select("id", "a", F.when(F.col("a") == 0, F.lit(2147483647)).otherwise(F.expr("a div 2")).cast("long").alias("half"), "said", F.when(F.col("said").startswith("Exception"), "Failure").otherwise("Success").alias("status"))


@query("SELECT 500::BIGINT AS n, 500::BIGINT AS same, 500::BIGINT AS distinct_keys")
def gen_pair_same_key(spark, d):
    first = from_table_json('[{"name": "record_id", "type": "STRING", "mode": "REQUIRED"}, {"name": "n", "type": "INTEGER"}]')
    second = T.StructType([T.StructField("parent", T.StructType([T.StructField("record_id", T.StringType(), False)]), False)])
    pairs = G.tupled(spark, first, second, 500, seed=7)
    keyed = pairs.withColumn("id", F.monotonically_increasing_id())
    both = G.amend2(keyed, G.Source(F.col("id"), 7).uuid("k"), "record_id", "parent.record_id")
    return both.agg(F.count("*").alias("n"), F.count_if(F.col("first.record_id") == F.col("second.parent.record_id")).alias("same"), F.countDistinct("first.record_id").alias("distinct_keys"))


@query("SELECT 1000::BIGINT AS n, 1000::BIGINT AS shaped")
def gen_from_schema(spark, d):
    schema = T.StructType.fromDDL("id long not null, tags array<string> not null, attrs map<string,int> not null, inner struct<flag: boolean, amount: decimal(12,2), at: timestamp> not null, note string")
    made = G.generate(spark, schema, 1000, seed=7)
    return made.agg(F.count("*").alias("n"), F.count_if(F.col("id").isNotNull() & (F.size("tags") > 0) & (F.size("attrs") < 5)).alias("shaped"))


# Schemas and formats --------------------------------------------------------------------------------------------


@query("SELECT * FROM (VALUES ('event_id', 'bigint'), ('info.event_type', 'string'), ('info.props.k', 'bigint')) t(path, kind)")
def schema_flatten(spark, d):
    e = table(spark, d, "events").select("event_id", F.struct("event_type", F.from_json("props", "k long").alias("props")).alias("info"))
    return spark.createDataFrame([(p, k.simpleString()) for p, k in flatten(e.schema)], "path string, kind string")


@query("SELECT n_nationkey::VARCHAR || chr(9) || n_name || chr(9) || n_regionkey::VARCHAR AS value FROM nation")
def render_tsv(spark, d):
    return as_tsv(table(spark, d, "nation"))


@query("SELECT n_nationkey, CASE WHEN n_nationkey % 3 <> 0 THEN n_name END AS n_name, n_regionkey FROM nation")
def json_lines_roundtrip(spark, d):
    n = table(spark, d, "nation").withColumn("n_name", F.when(F.col("n_nationkey") % 3 != 0, F.col("n_name")))
    return n.select(F.to_json(F.struct("*")).alias("line")).select(F.from_json("line", n.schema).alias("r")).select("r.*")


@query(f"SELECT o_orderkey, {_roll('o_custkey::VARCHAR')} AS roll FROM orders")
def roll_md5(spark, d):
    return table(spark, d, "orders").select("o_orderkey", md5_roll(F.col("o_custkey")).alias("roll"))


# More of the comparison ------------------------------------------------------------------------------------------


@query("SELECT o_orderkey::VARCHAR AS key, 'price' AS field, 'NUMERIC' AS delta_type, 1.25::DOUBLE AS delta_value FROM orders WHERE o_orderkey % 4 = 0")
def diff_decimal(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_totalprice").cast("decimal(14,2)").alias("price"))
    raised = F.when(F.col("o_orderkey") % 4 == 0, F.col("price") + F.lit("1.25").cast("decimal(3,2)")).otherwise(F.col("price")).cast("decimal(14,2)")
    return _flat(diff(o, o.withColumn("price", raised), ["o_orderkey"]).deltas)


@query("SELECT vec_id::VARCHAR AS key, 'v' AS field, 'VECTOR' AS delta_type, round(list_cosine_distance(v, list_reverse(v)), 5) AS delta_value FROM (SELECT vec_id, list_transform(embedding, lambda x: round(x::DOUBLE, 3)) AS v FROM embeddings) WHERE vec_id % 3 = 0 AND v <> list_reverse(v)")
def diff_text_vector(spark, d):
    """Lists of number texts are vectors where texts are measured as numbers."""
    e = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.round(x.cast("double"), 3).cast("string")).alias("v"))
    other = e.withColumn("v", F.when(F.col("vec_id") % 3 == 0, F.reverse("v")).otherwise(F.col("v")))
    return diff(e, other, ["vec_id"], numeric_text=True).deltas.select("key", "field", "delta_type", F.round("delta_value", 5).alias("delta_value"))


@query("""SELECT c_custkey::VARCHAR AS key, 'r.n' AS field, 'NUMERIC' AS delta_type, -(c_custkey % 3)::DOUBLE AS delta_value FROM customer WHERE c_custkey % 2 = 0 AND c_custkey % 3 <> 0
UNION ALL SELECT c_custkey::VARCHAR, 'l', 'UNKNOWN', NULL FROM customer WHERE c_custkey % 5 = 1""")
def diff_type_defaults(spark, d):
    """Absent leaves stand for zero or empty, absent lists for empty ones."""
    k = F.col("c_custkey")
    c = table(spark, d, "customer").select("c_custkey", F.struct(F.when(k % 2 == 0, k % 3).alias("n"), F.when(k % 7 == 0, "").alias("s")).alias("r"), F.when(k % 5 == 1, F.array(k)).when(k % 5 == 2, F.array().cast("array<bigint>")).alias("l"))
    other = c.select("c_custkey", F.struct(F.lit(None).cast("bigint").alias("n"), F.lit(None).cast("string").alias("s")).alias("r"), F.lit(None).cast("array<bigint>").alias("l"))
    return _flat(diff(c, other, ["c_custkey"], type_defaults=True).deltas)


@query(_ORDERS + "SELECT key, field, round(CASE WHEN field = 'o_totalprice' THEN delta_value / lp ELSE 0 END, 8) AS delta_value FROM d JOIN c USING (key)")
def diff_measures(spark, d):
    """Prices by their relative change, texts by the change of their length."""
    from .functions.deltas import Measures

    own = Measures(numeric=lambda a, b: (b - a) / a, string=lambda a, b: F.length(b) - F.length(a))
    return _orders(spark, d, measures=own).deltas.select("key", "field", F.round("delta_value", 8).alias("delta_value"))


@query("SELECT 'K' || o_orderkey AS key, CASE WHEN o_orderkey % 2 <> 0 THEN 'MISSING_LHS' WHEN o_orderkey % 3 <> 0 THEN 'MISSING_RHS' ELSE 'SAME' END AS diff_type FROM orders WHERE o_orderkey % 2 = 0 OR o_orderkey % 3 = 0")
def diff_key_function(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    return diff(o.where("o_orderkey % 2 = 0"), o.where("o_orderkey % 3 = 0"), [F.concat(F.lit("K"), F.col("o_orderkey").cast("string"))]).compared.select("key", "diff_type")


@query("SELECT event_id::VARCHAR AS key, 'info.event_type' AS field, 'STRING' AS delta_type, levenshtein(event_type, upper(event_type))::DOUBLE AS delta_value FROM events WHERE event_id % 2 = 0 AND event_type <> upper(event_type)")
def diff_nested_key(spark, d):
    e = table(spark, d, "events")
    kind = F.when(F.col("event_id") % 2 == 0, F.upper("event_type")).otherwise(F.col("event_type"))
    nest = lambda t: e.select(F.struct(F.col("event_id").alias("id"), t.alias("event_type")).alias("info"))
    return _flat(diff(nest(F.col("event_type")), nest(kind), ["info.id"]).deltas)


@query("SELECT c_custkey::VARCHAR AS key, 'r.name' AS field, 'STRING' AS delta_type, levenshtein(c_mktsegment, reverse(c_mktsegment))::DOUBLE AS delta_value FROM customer WHERE c_mktsegment <> reverse(c_mktsegment)")
def diff_ignore_contains(spark, d):
    c = table(spark, d, "customer")
    left = c.select("c_custkey", F.struct(F.col("c_acctbal").alias("price_a"), F.col("c_nationkey").alias("price_b"), F.col("c_mktsegment").alias("name")).alias("r"))
    right = left.withColumn("r", F.struct((F.col("r.price_a") + 1).alias("price_a"), (F.col("r.price_b") + 1).alias("price_b"), F.reverse("r.name").alias("name")))
    return _flat(diff(left, right, ["c_custkey"], ignore=("price",), ignore_mode="contains").deltas)


@query(_ORDERS + _COUNTS)
def diff_counters(spark, d):
    """Counters that an action on the comparison fills."""
    rows, seen = _orders(spark, d).observed("orders")
    rows.write.format("noop").mode("overwrite").save()
    kind = "num_same long, num_diff long, num_missing_lhs long, num_missing_rhs long"
    return spark.createDataFrame([tuple(seen.get[c.split()[0]] for c in kind.split(", "))], kind).withColumn("num_total", F.expr("num_same + num_diff + num_missing_lhs + num_missing_rhs"))


# Sources and sinks -----------------------------------------------------------------------------------------------


def _scratch(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/queries-{uuid.uuid4().hex[:12]}"


@query(_ORDERS + "SELECT field, count(*)::VARCHAR AS count, any_value(delta_type) AS delta_type FROM d GROUP BY field")
def save_stats_text(spark, d):
    """Field statistics as tab-separated text with a header in each file, read back."""
    place = _scratch(spark)
    save_stats(_orders(spark, d), place, header=True)
    return spark.read.option("sep", "\t").option("header", True).csv(f"{place}/fields").select("field", "count", "delta_type")


@query(_ORDERS + "SELECT count(*)::VARCHAR || chr(9) || count_if(diff_type = 'SAME') || chr(9) || count_if(diff_type = 'DIFFERENT') || chr(9) || count_if(diff_type = 'MISSING_LHS') || chr(9) || count_if(diff_type = 'MISSING_RHS') AS value FROM c")
def save_stats_lines(spark, d):
    place = _scratch(spark)
    save_stats(_orders(spark, d), place)
    return spark.read.text(f"{place}/global")


@query("SELECT o_orderkey, isnan(x) AS is_nan, isinf(x) AS is_infinite, CASE WHEN isfinite(x) THEN round(x, 2) END AS x, s FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'nan'::DOUBLE WHEN o_orderkey % 5 = 0 THEN '-inf'::DOUBLE ELSE o_totalprice END AS x, CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority END AS s FROM orders)")
def json_lines_file(spark, d):
    """JSON lines written to files and read back; NaN and infinity are texts there."""
    k, path = F.col("o_orderkey"), f"{_scratch(spark)}/orders.json"
    x = F.when(k % 3 == 0, float("nan")).when(k % 5 == 0, float("-inf")).otherwise(F.col("o_totalprice"))
    rows = table(spark, d, "orders").select(k, x.alias("x"), F.when(k % 2 == 0, F.col("o_orderpriority")).alias("s"))
    write(rows, path)
    x = F.col("x")
    whole = ~F.isnan(x) & (F.abs(x) != float("inf"))
    return read(spark, path, rows.schema).select("o_orderkey", F.isnan(x).alias("is_nan"), (F.abs(x) == float("inf")).alias("is_infinite"), F.when(whole, F.round(x, 2)).alias("x"), "s")


@query("SELECT o_orderkey, o_totalprice, CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority END AS s, len(l)::INT AS n, l[1] AS first FROM (SELECT *, [o_orderkey, o_custkey] AS l FROM orders)")
def avro_file(spark, d):
    """Avro written to files, probed and read back, with a null, a list and a record."""
    path, k = f"{_scratch(spark)}/orders.avro", F.col("o_orderkey")
    rows = table(spark, d, "orders").select(k, F.struct("o_totalprice").alias("r"), F.when(k % 2 == 0, F.col("o_orderpriority")).alias("s"), F.array("o_orderkey", "o_custkey").alias("l"))
    write(rows, path)
    return read(spark, path, schema_of(spark, path)).select("o_orderkey", "r.o_totalprice", "s", F.size("l").alias("n"), F.col("l")[0].alias("first"))


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN c_name END AS name, c_acctbal AS balance, [c_nationkey, c_custkey]::BIGINT[] AS numbers, c_mktsegment AS segment FROM customer")
def message_file(spark, d):
    """Protobuf messages written to Parquet as bytes and decoded by their descriptor, nested ones too."""
    from google.protobuf import descriptor_pb2

    f = descriptor_pb2.FieldDescriptorProto
    file = descriptor_pb2.FileDescriptorProto(name="customer.proto", package="example", syntax="proto2")
    inner, outer = file.message_type.add(name="Place"), file.message_type.add(name="Customer")
    inner.field.add(name="segment", number=1, type=f.TYPE_STRING, label=f.LABEL_OPTIONAL)
    for i, (name, kind, label) in enumerate((("id", f.TYPE_INT64, f.LABEL_REQUIRED), ("name", f.TYPE_STRING, f.LABEL_OPTIONAL), ("balance", f.TYPE_DOUBLE, f.LABEL_OPTIONAL), ("numbers", f.TYPE_INT64, f.LABEL_REPEATED))):
        outer.field.add(name=name, number=i + 1, type=kind, label=label)
    outer.field.add(name="place", number=9, type=f.TYPE_MESSAGE, type_name=".example.Place", label=f.LABEL_OPTIONAL)
    descriptors, path, k = descriptor_pb2.FileDescriptorSet(file=[file]).SerializeToString(), f"{_scratch(spark)}/m.parquet", F.col("c_custkey")
    c = table(spark, d, "customer")
    rows = c.select(k.alias("id"), F.when(k % 2 == 0, F.col("c_name")).alias("name"), F.col("c_acctbal").alias("balance"), F.array(F.col("c_nationkey").cast("long"), k).alias("numbers"), F.struct(F.col("c_mktsegment").alias("segment")).alias("place"))
    write(messages.encode(rows, descriptors, "example.Customer"), path)
    return messages.decode(read(spark, path), "value", descriptors, "example.Customer").select("id", "name", "balance", "numbers", "place.segment")


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey % 2 = 0 AND o_orderstatus = 'F'")
def parquet_file(spark, d):
    """Parquet written once, asked for again, probed and read by a glob with a quoted restriction."""
    path = f"{_scratch(spark)}/orders.parquet"
    rows = table(spark, d, "orders").select("o_orderkey", "o_orderstatus").where("o_orderkey % 2 = 0")
    write_once(spark, rows, path)
    write_once(spark, rows.limit(0), path)
    schema = schema_of(spark, path.replace("orders.", "ord*."))
    return read(spark, path.replace("orders.", "ord*."), schema, where="\"o_orderstatus = 'F'\"")


@query("SELECT strftime(ts, '%Y%m%d')::INT AS ts_day, count(*)::BIGINT AS n FROM events GROUP BY ALL")
def partitioned_file(spark, d):
    path = f"{_scratch(spark)}/events.parquet"
    write(table(spark, d, "events").select("event_id", "ts"), path, partition="ts", by="day")
    return read(spark, path).groupBy("ts_day").agg(F.count("*").alias("n"))


@query("SELECT c_custkey::VARCHAR AS key, CASE WHEN c_custkey % 3 = 0 THEN 'DIFFERENT' ELSE 'SAME' END AS diff_type FROM customer")
def diff_compatible_files(spark, d):
    """Two Parquet inputs of different schemas are read with the one that reads both."""
    place, k = _scratch(spark), F.col("c_custkey")
    c = table(spark, d, "customer")
    write(c.select(k, F.col("c_nationkey").cast("long").alias("n"), F.lit(None).cast("string").alias("note")), f"{place}/l.parquet")
    write(c.select(k, (F.col("c_nationkey") + F.when(k % 3 == 0, 1).otherwise(0)).cast("int").alias("n")), f"{place}/r.parquet")
    return diff(*read_pair(spark, f"{place}/l.parquet", f"{place}/r.parquet"), ["c_custkey"]).compared.select("key", "diff_type")


@query("SELECT event_id, rtrim(rtrim(strftime(ts, '%Y-%m-%d %H:%M:%S.%f'), '0'), '.') || ' UTC' AS text FROM events")
def timestamp_as_text(spark, d):
    return table(spark, d, "events").select("event_id", timestamp_text(F.col("ts")).alias("text"))


# Hashes ----------------------------------------------------------------------------------------------------------


def _mul(a: str, b: str) -> str:
    return f"(({a})::UHUGEINT * ({b})::UHUGEINT % 18446744073709551616::UHUGEINT)::UBIGINT"


def _add(a: str, b: str) -> str:
    return f"((({a})::UHUGEINT + ({b})::UHUGEINT) % 18446744073709551616::UHUGEINT)::UBIGINT"


def _turned(x: str, n: int) -> str:
    return f"(({x} >> {n}) + {_mul(x, str(2 ** (64 - n)))})"


def _little(text: str) -> str:
    """The number that 16 hexadecimal digits, lowest byte first, stand for."""
    return "('0x' || " + " || ".join(f"substr({text}, {i}, 2)" for i in range(15, 0, -2)) + ")::UBIGINT"


def _bytes_of(x: str) -> str:
    """16 hexadecimal digits, lowest byte first, of a number that is not negative."""
    return "(" + " || ".join(f"substr(lpad(hex({x}), 16, '0'), {i}, 2)" for i in range(15, 0, -2)) + ")"


def _farm_sql(messages: str) -> str:
    """``messages`` (id, h: 8 to 16 bytes in hexadecimal) and the published 64-bit farm fingerprint of each."""
    k2 = "11160318154034397263"  # fixed value of the algorithm
    return f"""m AS ({messages}),
f1 AS (SELECT id, {_add(_little("substr(h, 1, 16)"), k2)} AS a, {_little("substr(h, length(h) - 15, 16)")} AS b, {_add(k2, "length(h)")} AS mul FROM m),
f2 AS (SELECT id, mul, {_add(_mul(_turned("b", 37), "mul"), "a")} AS u, {_mul(_add(_turned("a", 25), "b"), "mul")} AS v FROM f1),
f3 AS (SELECT id, mul, v, {_mul("xor(u, v)", "mul")} AS x FROM f2),
f4 AS (SELECT id, mul, {_mul("xor(v, xor(x, x >> 47))", "mul")} AS y FROM f3),
farm AS (SELECT id, {_mul("xor(y, y >> 47)", "mul")} AS h FROM f4)
"""


def _bound_sql(h: str) -> str:
    return f"((CASE WHEN {h} >= 9223372036854775808::UBIGINT THEN ({h}::HUGEINT - 18446744073709551616::HUGEINT)::BIGINT ELSE {h}::BIGINT END)::DOUBLE + 9223372036854775808::DOUBLE) / 18446744073709551615::DOUBLE"


def _signed_sql(h: str) -> str:
    return f"(CASE WHEN {h} >= 9223372036854775808::UBIGINT THEN ({h}::HUGEINT - 18446744073709551616::HUGEINT)::BIGINT ELSE {h}::BIGINT END)"


ORACLE["sample_hash_farm"] = f"WITH {_farm_sql('SELECT o_orderkey AS id, ' + chr(39) + '2a000000' + chr(39) + ' || ' + _bytes_of('o_custkey') + ' AS h FROM orders')} SELECT o_orderkey, o_custkey FROM orders JOIN farm ON o_orderkey = id WHERE {_bound_sql('h')} < 0.1::DOUBLE"
ORACLE["sample_hash_murmur"] = f"""WITH g0 AS (SELECT o_orderkey, o_custkey, {_mul("o_custkey", "9782798678568883157")} AS k FROM orders),
g1 AS (SELECT o_orderkey, o_custkey, xor(xor(42::UBIGINT, {_mul(_turned("k", 33), "5545529020109919103")}), 8::UBIGINT) AS h1, xor(42::UBIGINT, 8::UBIGINT) AS h2 FROM g0),
g2 AS (SELECT o_orderkey, o_custkey, {_add("h1", "h2")} AS h1, h2 FROM g1), g3 AS (SELECT o_orderkey, o_custkey, h1, {_add("h2", "h1")} AS h2 FROM g2),
g4 AS (SELECT o_orderkey, o_custkey, {_mul("xor(h1, h1 >> 33)", "18397679294719823053")} AS h1, {_mul("xor(h2, h2 >> 33)", "18397679294719823053")} AS h2 FROM g3),
g5 AS (SELECT o_orderkey, o_custkey, {_mul("xor(h1, h1 >> 33)", "14181476777654086739")} AS h1, {_mul("xor(h2, h2 >> 33)", "14181476777654086739")} AS h2 FROM g4),
g6 AS (SELECT o_orderkey, o_custkey, {_add("xor(h1, h1 >> 33)", "xor(h2, h2 >> 33)")} AS h FROM g5)
SELECT o_orderkey, o_custkey FROM g6 WHERE {_bound_sql('h')} < 0.1::DOUBLE"""


@query(
    "WITH " + _farm_sql("""SELECT (c_custkey, 0) AS id, hex(encode(c_mktsegment)) AS h FROM customer
  UNION ALL SELECT (c_custkey, 1), hex(encode(lower(hex(encode(left(c_mktsegment, 4)))))) FROM customer UNION ALL SELECT (c_custkey, 2), hex(encode(base64(encode(left(c_mktsegment, 6))))) FROM customer""")
    + f"SELECT id[1] AS c_custkey, max(CASE WHEN id[2] = 0 THEN {_signed_sql('h')} END) AS raw, max(CASE WHEN id[2] = 1 THEN {_signed_sql('h')} END) AS hex, max(CASE WHEN id[2] = 2 THEN {_signed_sql('h')} END) AS base64 FROM farm GROUP BY 1"
)
def hash_encodings(spark, d):
    """Farm fingerprints of a text, and of bytes as hexadecimal and base-64 text."""
    c = table(spark, d, "customer").select("c_custkey", "c_mktsegment", *[F.encode(F.substring("c_mktsegment", 1, n), "UTF-8").alias(f"b{n}") for n in (4, 6)])
    return c.select("c_custkey", fingerprint(c, ["c_mktsegment"]).alias("raw"), fingerprint(c, ["b4"], encoding="hex").alias("hex"), fingerprint(c, ["b6"], encoding="base64").alias("base64"))


@query("WITH " + _farm_sql(f"SELECT o_orderkey AS id, {_bytes_of('o_orderkey')} || {_bytes_of('o_custkey')} AS h FROM orders") + f"SELECT id AS o_orderkey, {_signed_sql('h')} AS h, round({_bound_sql('h')}, 12) AS unit FROM farm")
def hash_fields(spark, d):
    """Two fields are one message, in their order; a null adds nothing; the hash as a number from 0 to 1."""
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", F.lit(None).cast("string").alias("nothing"))
    return o.withColumn("h", fingerprint(o, ["o_orderkey", "nothing", "o_custkey"])).select("o_orderkey", "h", F.round(bound(F.col("h")), 12).alias("unit"))


# More of sampling, generation and the command line ---------------------------------------------------------------


@query(_BY_LANG + "SELECT stratum, floor(c * 0.2::DOUBLE)::DOUBLE AS target, floor(c * 0.2::DOUBLE)::BIGINT AS actual, 0::DOUBLE AS diff FROM p")
def sample_exact_random(spark, d):
    """An exact sample by random rolls; the check lets it pass, and each row comes from its stratum."""
    docs = table(spark, d, "documents").select("doc_id", "lang")
    got = sample(docs, 0.2, seed=11, distribution="stratified", distribution_fields=["lang"], precision="exact")
    return got.check().select("stratum", "target", "actual", F.abs("diff").alias("diff"))


@query("SELECT o_orderkey, o_custkey FROM orders LIMIT 25")
def take_head_of_files(spark, d):
    return head_of_files(table(spark, d, "orders"), 25).select("o_orderkey", "o_custkey")


@query(ORACLE["sample_hash_md5"])
def stream_hash_sample(spark, d):
    """The hash sample of a stream of the table's files, written by a streaming query."""
    rows, place = table(spark, d, "orders").select("o_orderkey", "o_custkey"), _scratch(spark)
    write(rows, f"{place}/in.parquet")
    stream = spark.readStream.schema(rows.schema).parquet(f"{place}/in.parquet")
    kept = sample_stream(stream, 0.1, ["o_custkey"], "md5", 5)
    kept.writeStream.format("parquet").option("checkpointLocation", f"{place}/state").trigger(availableNow=True).start(f"{place}/out").awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{place}/out")


@query(f"SELECT CASE WHEN {_unit('c')} < 5/6::DOUBLE THEN 'SE' ELSE 'NO' END AS country, count(*)::BIGINT AS n FROM range(3000) t(i) GROUP BY 1")
def gen_overrides(spark, d):
    schema = T.StructType.fromDDL("id long not null, country string not null, r struct<x: int> not null")
    made = G.generate(spark, schema, 3000, seed=7, overrides={"country": lambda s: s.frequency("c", [(5, "SE"), (1, "NO")])})
    return made.groupBy("country").agg(F.count("*").alias("n"))


@query(f"SELECT n_nationkey, {_choose('k', 0, 999, 'n_nationkey::VARCHAR')} AS id, CASE WHEN n_nationkey % 2 = 0 THEN {_choose('k', 0, 999, 'n_nationkey::VARCHAR')} END AS inner_id FROM nation")
def gen_try_amend(spark, d):
    """One drawn value in a column and in a record; a record that is null stays null."""
    n = table(spark, d, "nation").select("n_nationkey", F.lit(0).cast("long").alias("id"), F.when(F.col("n_nationkey") % 2 == 0, F.struct(F.lit(1).cast("long").alias("id"), "n_name")).alias("r"))
    return G.try_amend(n, G.Source(F.col("n_nationkey"), 7).choose("k", 0, 999), "id", "r.id").select("n_nationkey", "id", F.col("r.id").alias("inner_id"))


@query(f"SELECT n, count(*)::BIGINT AS rows, count(DISTINCT m)::BIGINT AS kinds FROM (SELECT {_choose('n', 0, 99)} AS n, {_choose('m', 0, 9)} AS m FROM range(1000000) t(i)) GROUP BY n")
def gen_million(spark, d):
    schema = T.StructType.fromDDL("n long not null, m long not null")
    made = G.generate(spark, schema, 1_000_000, seed=7, overrides={"n": lambda s: s.choose("n", 0, 99), "m": lambda s: s.choose("m", 0, 9)})
    return made.groupBy("n").agg(F.count("*").alias("rows"), F.countDistinct("m").alias("kinds"))


@query(_ORDERS + "SELECT key, diff_type FROM c WHERE diff_type <> 'SAME'")
def cli_diff(spark, d):
    from .cli import main

    place, given = _scratch(spark), _orders(spark, d)
    for name, side in (("l", given.lhs), ("r", given.rhs)):
        write(side, f"{place}/{name}.parquet")
    main(["diff", "--lhs", f"{place}/l.parquet", "--rhs", f"{place}/r.parquet", "--key", "o_orderkey", "--output", f"{place}/out", "--with-header"], spark)
    return spark.read.option("sep", "\t").option("header", True).csv(f"{place}/out/keys").where("diff_type <> 'SAME'").select("key", "diff_type").distinct()


@query(ORACLE["sample_hash_md5"])
def cli_sample(spark, d):
    from .cli import main

    out = f"{_scratch(spark)}/s.parquet"
    main(["sample", "--input", f"{d}/orders.parquet", "--output", out, "--fraction", "0.1", "--fields", "o_custkey", "--seed", "5", "--algorithm", "md5"], spark)
    return read(spark, out).select("o_orderkey", "o_custkey")


@query("SELECT n_nationkey, n_name FROM nation LIMIT 7")
def cli_take(spark, d):
    from .cli import main

    out = f"{_scratch(spark)}/t.json"
    main(["take", "--in", f"{d}/nation.parquet", "--out", out, "-n", "7", "--head"], spark)
    return read(spark, out, table(spark, d, "nation").schema).select("n_nationkey", "n_name")
