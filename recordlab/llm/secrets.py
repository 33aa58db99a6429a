"""Secret scan with multipart credential linking, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ._space import Workspace

#: Kind, pattern, group whose length counts, least length.  Kinds keep this order where spans start together.
BASE = (
    ("assign", r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 8),
    ("access", r"AKIA[A-Z0-9]+", 0, 16),
    ("hex", r"[0-9a-f]{32,}", 0, 32),
)
#: Weak parts: they say little alone.  A secret must also mix digits and letters of both cases.
WEAK = (
    ("id", r"([Aa]ccess_?[Kk]ey_?[Ii][Dd]|[Cc]lient_?[Ii][Dd]|[Aa]ccount_?[Ii][Dd]|[Uu]ser_?[Nn]ame|[Uu]ser|[Ll]ogin)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9._@-]+)", 2, 3),
    ("secret", r"[A-Za-z0-9+/_-]{20,}", 0, 20),
    ("endpoint", r"https?://[^\x20\x09-\x0D\"'<>]+", 0, 12),
)
#: What each kind can stand for, and the code points that may lie between parts of one credential.
ROLE = {"assign": "s", "access": "i", "hex": "s", "id": "i", "secret": "s", "endpoint": "e"}
SCOPE = 256
PIECE = "array<struct<`order`:int,gap:int,hit:int,ok:boolean>>"


def _pieces(order: int, kind: str, pattern: str, group: int, least: int) -> Column:
    """Leftmost matches that do not overlap: the code points before each since the last, its own, and whether it counts."""
    p = F.lit(pattern)
    between, whole = F.split("text", pattern, -1), F.regexp_extract_all("text", p, F.lit(0))
    part = F.regexp_extract_all("text", p, F.lit(group)) if group else whole
    zipped = F.arrays_zip(F.slice(between, F.lit(1), F.size(whole)).alias("gap"), whole.alias("hit"), part.alias("part"))

    def piece(x: Column) -> Column:
        ok = F.length(x["part"]) >= least
        if kind == "secret":
            ok = ok & x["part"].rlike("[0-9]") & x["part"].rlike("[A-Z]") & x["part"].rlike("[a-z]")
        return F.struct(F.lit(order).alias("order"), F.length(x["gap"]).alias("gap"), F.length(x["hit"]).alias("hit"), ok.alias("ok"))

    return F.when(F.col("text").rlike(pattern), F.transform(zipped, piece).cast(PIECE)).otherwise(F.array().cast(PIECE))


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k[0]) for k in (*BASE, *WEAK)])
    text = F.transform(spans, lambda x: F.concat(F.element_at(names, x["order"] + 1), F.lit(":"), x["start"].cast("string"), F.lit(":"), x["stop"].cast("string")))
    return F.coalesce(F.array_join(text, ","), F.lit(""))


def scan(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans of every row of ``docs`` (doc_id, text; null text: empty).

    Base spans are the matches of each kind.  Weak parts (account identifiers, mixed tokens, endpoints) outside base
    spans are added where a complementary part lies within ``scope`` code points: a secret beside an identifier, an
    identifier beside a secret, an endpoint beside both.  Parts meet in an interval join within scopes of that length,
    where only a few can lie, so that a text full of parts does not pair all with all.  Where matches lie, and which
    weak ones base spans cover, follows from running sums and maxima over the matches of a row, so that the work on a
    text grows with its matches, however many they are.

    Rows without any part have empty spans; rows that repeat, or have no doc_id, are scanned one by one; an empty
    table gives an empty result.
    """
    space = Workspace(docs.sparkSession, "secrets")
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    base = rows.select("doc_id", "text", F.concat(*[_pieces(i, *k) for i, k in enumerate(BASE)]).alias("base"))
    identified = F.exists("base", lambda x: (x["order"] == 1) & x["ok"]) | F.col("text").rlike(WEAK[0][1])
    weak = F.when(identified, F.concat(*[_pieces(len(BASE) + i, *k) for i, k in enumerate(WEAK)])).otherwise(F.array().cast(PIECE))
    found = base.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.concat("base", weak).alias("pieces"))
    found = space.put(found, "found")
    each = found.where("size(pieces) > 0").select("row", F.posexplode("pieces").alias("pos", "p")).select("row", "pos", "p.*").repartition("row")
    stop = F.sum(F.col("gap") + F.col("hit")).over(W.partitionBy("row", "order").orderBy("pos")).cast("long")
    spans = each.withColumn("stop", stop).where("ok").select("row", "order", (F.col("stop") - F.col("hit")).alias("start"), "stop")
    # Of the base spans that begin before a weak part ends, one that ends after its beginning covers some of it.
    is_base = F.col("order") < len(BASE)
    reach = F.max(F.when(is_base, F.col("stop"))).over(W.partitionBy("row").orderBy(F.when(is_base, F.col("start")).otherwise(F.col("stop")), is_base).rowsBetween(W.unboundedPreceding, 0))
    spans = space.put(spans.withColumn("reach", reach).where(is_base | F.col("reach").isNull() | (F.col("reach") <= F.col("start"))).drop("reach"), "spans")
    roles = F.array(*[F.lit(ROLE[k[0]]) for k in (*BASE, *WEAK)])
    parts = spans.withColumn("role", F.element_at(roles, F.col("order") + 1))
    bins = lambda low, high: F.explode(F.sequence(low, high))
    begin, end = F.expr(f"start div {scope}"), F.expr(f"stop div {scope}")
    asking = parts.where(~is_base).select("row", "order", "start", "stop", "role", bins(begin, end).alias("bin"))
    others = parts.select(F.col("row").alias("_row"), F.col("start").alias("_start"), F.col("stop").alias("_stop"), F.col("role").alias("other"), bins(begin - 1, end + 1).alias("_bin"))
    near = (F.col("_start") <= F.col("stop") + scope) & (F.col("start") <= F.col("_stop") + scope)
    met = asking.join(others, (F.col("row") == F.col("_row")) & (F.col("bin") == F.col("_bin")) & near & (F.col("role") != F.col("other")))
    linked = met.groupBy("row", "order", "start", "stop", "role").agg(F.max(F.col("other") == "i").alias("i"), F.max(F.col("other") == "s").alias("s"))
    linked = linked.where("(role = 's' and i) or (role = 'i' and s) or (role = 'e' and i and s)").select("row", "order", "start", "stop")
    whole = spans.where(is_base).unionByName(linked).groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "order", "stop"))).alias("all"))
    out = found.select("row", "doc_id").join(space.put(whole, "whole"), "row", "left")
    count = lambda i: F.greatest(F.size(F.filter("all", lambda x: x["order"] == i)), F.lit(0)).cast("long").alias(f"n_{BASE[i][0]}")
    only = F.filter("all", lambda x: x["order"] < len(BASE))
    return out.select("doc_id", *[count(i) for i in range(len(BASE))], F.sha2(_joined(only), 256).alias("base_sha256"), _joined(F.col("all")).alias("spans"))


def _quote(pattern: str) -> str:
    return pattern.replace("'", "''")


def _sql_spans(order: int, kind: str, pattern: str, group: int, least: int) -> str:
    p = _quote(pattern)
    more = " AND regexp_matches(part[i], '[0-9]') AND regexp_matches(part[i], '[A-Z]') AND regexp_matches(part[i], '[a-z]')" if kind == "secret" else ""
    return f"""SELECT k, doc_id, {order} AS o, '{kind}' AS kind, '{ROLE[kind]}' AS role, i, gaps + hits - len(hit[i]) AS start, gaps + hits AS stop FROM (
  SELECT k, doc_id, i, hit, part, list_sum([len(x) for x in between[1:i]])::BIGINT AS gaps, list_sum([len(x) for x in hit[1:i]])::BIGINT AS hits
  FROM (SELECT k, doc_id, regexp_extract_all(t, '{p}') AS hit, regexp_extract_all(t, '{p}', {group}) AS part, string_split_regex(t, '{p}') AS between FROM d WHERE regexp_matches(t, '{p}')), unnest(range(1, len(hit) + 1)) u(i))
  WHERE len(part[i]) >= {least}{more}"""


#: The same for DuckDB.
ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS t FROM documents),
base AS ({" UNION ALL ".join(_sql_spans(i, *k) for i, k in enumerate(BASE))}),
loose AS ({" UNION ALL ".join(_sql_spans(len(BASE) + i, *k) for i, k in enumerate(WEAK))}),
weak AS (SELECT * FROM loose w WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.k = w.k AND b.start < w.stop AND w.start < b.stop)),
parts AS (SELECT * FROM base UNION ALL SELECT * FROM weak),
linked AS (SELECT w.* FROM weak w WHERE CASE w.role
  WHEN 's' THEN EXISTS (SELECT 1 FROM parts q WHERE q.k = w.k AND q.role = 'i' AND q.start <= w.stop + {SCOPE} AND w.start <= q.stop + {SCOPE})
  WHEN 'i' THEN EXISTS (SELECT 1 FROM parts q WHERE q.k = w.k AND q.role = 's' AND q.start <= w.stop + {SCOPE} AND w.start <= q.stop + {SCOPE})
  ELSE EXISTS (SELECT 1 FROM parts q WHERE q.k = w.k AND q.role = 'i' AND q.start <= w.stop + {SCOPE} AND w.start <= q.stop + {SCOPE})
   AND EXISTS (SELECT 1 FROM parts q WHERE q.k = w.k AND q.role = 's' AND q.start <= w.stop + {SCOPE} AND w.start <= q.stop + {SCOPE}) END),
b AS (SELECT k, count(*) FILTER (kind = 'assign') AS a, count(*) FILTER (kind = 'access') AS c, count(*) FILTER (kind = 'hex') AS h,
  string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, o) AS s FROM base GROUP BY k),
f AS (SELECT k, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, o) AS s FROM (SELECT * FROM base UNION ALL SELECT * FROM linked) GROUP BY k)
SELECT d.doc_id, coalesce(b.a, 0)::BIGINT AS n_assign, coalesce(b.c, 0)::BIGINT AS n_access, coalesce(b.h, 0)::BIGINT AS n_hex,
  sha256(coalesce(b.s, '')) AS base_sha256, coalesce(f.s, '') AS spans
FROM d LEFT JOIN b ON d.k = b.k LEFT JOIN f ON d.k = f.k
"""
