"""Queries that merge what is said of one thing, and that number things."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairn.operators import candidates, numbering
from cairn.operators import selection as sel
from cairn.plans.registry import query
from cairn.sources.readers import table


@query("""WITH f AS (SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS rn, l_quantity > 46 AS unk, CAST(CAST(round(l_tax * 100) AS INT) AS VARCHAR) AS v, l_returnflag AS c, CASE l_linenumber % 2 WHEN 0 THEN 'dynamic' ELSE 'missing' END AS why, l_linestatus AS t, 'o' || l_suppkey % 2 AS o FROM lineitem),
b AS (SELECT l_orderkey, bool_or(unk) AS unk, count(DISTINCT CASE WHEN unk THEN why END) AS whys, min(CASE WHEN unk THEN why END) AS why, count(DISTINCT t || '/' || o) AS origins, min(t) AS t, min(o) AS o FROM f GROUP BY ALL),
cs AS (SELECT l_orderkey, v, c, min(rn) AS co FROM f WHERE NOT unk OR l_linenumber % 3 = 0 GROUP BY ALL), vs AS (SELECT l_orderkey, v, min(co) AS vo, string_agg(c, '|' ORDER BY co) AS cs FROM cs GROUP BY ALL),
a AS (SELECT l_orderkey, count(*) AS n, string_agg(v || '(' || cs || ')', ',' ORDER BY vo) AS vs FROM vs GROUP BY ALL)
SELECT l_orderkey, CASE WHEN n > 4 OR unk OR n IS NULL THEN 'unknown' WHEN n = 1 THEN 'known' ELSE 'ambiguous' END AS state, CASE WHEN n > 4 OR n IS NULL THEN '' ELSE vs END AS alternatives,
CASE WHEN n > 4 THEN 'value_limit' WHEN unk AND whys = 1 THEN why WHEN unk THEN 'unknown_branch' END AS reason, CASE WHEN origins = 1 AND coalesce(n, 0) <= 4 THEN t END AS key_type, CASE WHEN origins = 1 AND coalesce(n, 0) <= 4 THEN o END AS key_origin FROM b LEFT JOIN a USING (l_orderkey)""")
def lattice_provenance(spark, sf_dir):
    """One value for all facts of an order, with alternatives, conditions, reasons and the origin that all share."""
    unknown, n = F.col("l_quantity") > 46, F.col("l_linenumber")
    said = F.array(F.struct(F.round(F.col("l_tax") * 100).cast("int").cast("string").alias("value"), F.array("l_returnflag").alias("conditions")))
    facts = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("at"), F.when(unknown, "unknown").otherwise("known").alias("state"), F.when(~unknown | (n % 3 == 0), said).otherwise(F.array().cast("array<struct<value:string,conditions:array<string>>>")).alias("alternatives"),
        F.when(n % 2 == 0, "dynamic").otherwise("missing").alias("reason"), F.col("l_linestatus").alias("key_type"), F.concat(F.lit("o"), (F.col("l_suppkey") % 2).cast("string")).alias("key_origin"),
    )
    out = sel.merged_facts(facts, ["l_orderkey"], "at")
    texts = F.transform("alternatives", lambda x: F.concat(x["value"], F.lit("("), F.array_join(x["conditions"], "|"), F.lit(")")))
    return out.withColumn("alternatives", F.array_join(texts, ","))


@query("""SELECT 'o' || o_orderkey AS candidate_id, 'c' || row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS alias FROM orders""")
def wire_aliases(spark, sf_dir):
    """Short names c1 to cN of all candidates, in order: a bijection over one group of all rows."""
    rows = table(spark, sf_dir, "orders").select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("candidate_id"), "o_totalprice", "o_orderkey")
    return numbering.aliases(rows, "candidate_id", ["o_totalprice", "o_orderkey"], "c")


@query("""WITH s AS (SELECT l_partkey, min(l_orderkey * 10 + l_linenumber) AS o FROM lineitem GROUP BY l_partkey) SELECT l_partkey AS evidence_id, 'e' || row_number() OVER (ORDER BY o, l_partkey) AS alias FROM s""")
def evidence_aliases(spark, sf_dir):
    """Short names e1 to eN of different pieces of evidence, as they first occur among the candidates."""
    return numbering.aliases(table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("evidence_id"), "l_orderkey", "l_linenumber"), "evidence_id", ["l_orderkey", "l_linenumber"], "e")


@query("""WITH i AS (SELECT event_id AS item_id, 's' || user_id % 40 AS source_id, CAST(event_id % 7 AS INT) AS line, CASE WHEN event_id % 3 <> 0 THEN 'x' || (event_id // 7) % 4 END AS context, event_type AS lane, CASE WHEN event_id % 2 = 0 THEN event_id END AS ref, CASE WHEN event_id % 5 = 0 THEN 'f' END AS fact FROM events),
c AS (SELECT source_id, line, context, min(item_id) AS since, min(min(item_id)) OVER (PARTITION BY source_id, line) AS first FROM i WHERE context IS NOT NULL GROUP BY source_id, line, context),
e AS (SELECT item_id, source_id, line, context, lane, ref, fact FROM i WHERE context IS NOT NULL
  UNION ALL SELECT i.item_id, i.source_id, i.line, c.context, lane, ref, fact FROM i JOIN c ON c.source_id = i.source_id AND c.line = i.line AND (c.since < i.item_id OR (c.since = c.first AND i.item_id < c.first)) WHERE i.context IS NULL
  UNION ALL SELECT item_id, source_id, line, NULL, lane, ref, fact FROM i WHERE context IS NULL AND NOT EXISTS (SELECT 1 FROM c WHERE c.source_id = i.source_id AND c.line = i.line)),
l AS (SELECT source_id, line, context, lane, min(item_id) AS a, count(ref) AS refs, count(fact) AS facts FROM e GROUP BY ALL)
SELECT source_id, line, context, string_agg(lane, ',' ORDER BY a) AS lanes, CAST(sum(refs) AS BIGINT) AS refs, CAST(sum(facts) AS BIGINT) AS facts FROM l GROUP BY source_id, line, context""")
def inherited_candidates(spark, sf_dir):
    """Candidates of a line with what they inherit from items without a context."""
    e = F.col("event_id")
    items = table(spark, sf_dir, "events").select(
        e.alias("item_id"), F.concat(F.lit("s"), (F.col("user_id") % 40).cast("string")).alias("source_id"), (e % 7).cast("int").alias("line"), F.when(e % 3 != 0, F.concat(F.lit("x"), (F.floor(e / 7) % 4).cast("string"))).alias("context"),
        F.col("event_type").alias("lane"), F.when(e % 2 == 0, e).alias("ref"), F.when(e % 5 == 0, "f").alias("fact"),
    )
    return candidates.inherited_candidates(items).withColumn("lanes", F.array_join("lanes", ","))
