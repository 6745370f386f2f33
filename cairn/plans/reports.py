"""Queries of reports, claim grades and digests of them."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairn.operators import findings as fin
from cairn.plans.registry import query
from cairn.sources import sinks
from cairn.sources.readers import config_corpus, table

MADE = """made AS (SELECT 'doc' || doc_id AS source_id, source || '.py' AS file_name, CAST(n_chars % 97 AS INT) AS line, CASE WHEN doc_id % 3 = 0 THEN '=SUM(A1)|' WHEN doc_id % 3 = 1 THEN chr(9) || 'x' || chr(10) || '<b>&' ELSE '  @y' END AS evidence FROM documents)"""


def made(spark, sf_dir):
    k = F.col("doc_id")
    evidence = F.when(k % 3 == 0, "=SUM(A1)|").when(k % 3 == 1, "\tx\n<b>&").otherwise("  @y")
    return table(spark, sf_dir, "documents").select(F.concat(F.lit("doc"), k.cast("string")).alias("source_id"), F.concat("source", F.lit(".py")).alias("file_name"), (F.col("n_chars") % 97).cast("int").alias("line"), evidence.alias("evidence"))


@query(f"""WITH {MADE} SELECT source_id, coalesce(file_name, '') AS file_name, coalesce(CAST(line AS VARCHAR), '') AS line, '' AS algorithm, '' AS risk_level, '未记录' AS detection_method, '' AS library, '' AS resolved_api, '''' || evidence AS evidence, '' AS reason, '' AS recommendation FROM made""")
def csv_report(spark, sf_dir):
    return sinks.csv_rows(made(spark, sf_dir))


@query(f"""WITH {MADE} SELECT file_name, line, '| ' || source_id || ' | ' || file_name || ' | ' || line || ' |  |  | 未记录 |  |  | ' || replace(replace(replace(replace(replace(evidence, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '|', '\\|'), chr(10), ' ↵ ') || ' |  |  |' AS row FROM made""")
def markdown_report(spark, sf_dir):
    return sinks.markdown_rows(made(spark, sf_dir))


@query(f"""WITH {MADE} SELECT file_name, line, '<tr><td>' || source_id || '</td><td>' || file_name || '</td><td>' || line || '</td><td></td><td></td><td>未记录</td><td></td><td></td><td>' || replace(replace(replace(evidence, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</td><td></td><td></td></tr>' AS row FROM made""")
def html_report(spark, sf_dir):
    return sinks.html_rows(made(spark, sf_dir))


GRADE_SQL = "CASE WHEN valid AND {0} = 'known' THEN 'E3' WHEN edges > 0 THEN 'E2' WHEN nodes > 0 THEN 'E1' ELSE 'E0' END"


@query(f"""WITH c AS (SELECT l_orderkey, l_linenumber, l_partkey, l_returnflag <> 'R' AS valid, CASE l_linenumber % 3 WHEN 0 THEN 'known' WHEN 1 THEN 'ambiguous' ELSE 'unknown' END AS algorithm, CASE WHEN l_suppkey % 2 = 0 THEN 'known' ELSE 'unknown' END AS quantum, CAST(l_quantity > 20 AS INT) AS edges, CAST(l_discount > 0.02 AS INT) AS nodes FROM lineitem),
g AS (SELECT *, {GRADE_SQL.format("algorithm")} AS a, {GRADE_SQL.format("quantum")} AS q FROM c)
SELECT l_orderkey, l_linenumber, l_partkey, a AS algorithm_level, CASE WHEN a <> 'E3' AND q = 'E3' THEN 'E2' ELSE q END AS quantum_level FROM g""")
def graded_claims(spark, sf_dir):
    """Levels of claims; the quantum class is never better founded than the algorithm."""
    valid, edges, nodes = F.col("l_returnflag") != "R", (F.col("l_quantity") > 20).cast("int"), (F.col("l_discount") > 0.02).cast("int")
    third = F.col("l_linenumber") % 3
    algorithm = F.when(third == 0, "known").when(third == 1, "ambiguous").otherwise("unknown")
    quantum = F.when(F.col("l_suppkey") % 2 == 0, "known").otherwise("unknown")
    a = fin.grade(valid, algorithm, edges, nodes)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", a.alias("algorithm_level"), fin.bounded_grade(fin.grade(valid, quantum, edges, nodes), a).alias("quantum_level"))


@query("""SELECT p_brand AS origin, CAST(sum(n) AS BIGINT) AS findings, CAST(sum(CASE WHEN p_partkey % 3 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS ssh, CAST(count_if(n = 0) AS BIGINT) AS clean FROM
(SELECT p_brand, p_partkey, CAST(p_size % 5 <> 3 AS INT) + CASE WHEN p_partkey % 3 = 0 THEN 1 ELSE 0 END + CASE WHEN p_partkey % 7 = 0 THEN 1 ELSE 0 END AS n FROM part) GROUP BY 1""")
def file_distribution(spark, sf_dir):
    """Findings of each origin with its files without any: findings are counted a file before they meet the files."""
    corpus = config_corpus(spark, sf_dir)
    n = fin.scan_config(corpus).groupBy("origin", "file_name").agg(F.count("*").alias("n"), F.max((F.col("algorithm") == "Ed25519").cast("int")).alias("s"))
    g = corpus.select("origin", "file_name").join(n, ["origin", "file_name"], "left").groupBy("origin")
    return g.agg(F.sum(F.coalesce("n", F.lit(0))).alias("findings"), F.sum(F.coalesce("s", F.lit(0))).alias("ssh"), F.count_if(F.col("n").isNull()).alias("clean"))


@query("""SELECT user_id % 100 AS scope, event_type, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS total, count(*) AS updates, max(event_id) AS version FROM events GROUP BY ALL""")
def progress_counters(spark, sf_dir):
    """Counters of each scope, from their changes; whole hundredths, so that the order of rows doesn't matter."""
    return table(spark, sf_dir, "events").groupBy((F.col("user_id") % 100).alias("scope"), "event_type").agg(F.sum(F.round(F.col("value") * 100).cast("long")).alias("total"), F.count("*").alias("updates"), F.max("event_id").alias("version"))
