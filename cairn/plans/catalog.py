"""Registered queries, each beside the SQL that states its result independently."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairn.functions import rules, text
from cairn.operators import checks
from cairn.operators import findings as fin
from cairn.operators import sequences as seq
from cairn.operators.spans import holding_spans
from cairn.plans import choices, deep, files, integrated, merges, reports, scans, symbols, views  # noqa: F401 - they register their queries
from cairn.plans.registry import QUERIES, SQL, query  # noqa: F401 - the catalogue's names
from cairn.sources.readers import config_corpus, table
from cairn.streaming import scan as streams


#: The corpus and its expected findings, stated from the columns of part.
CORPUS = """corpus AS (SELECT p_brand AS origin, p_partkey, p_size, 'f' || p_partkey || '.yaml' AS file_name,
  '# jwt_algorithm: RS256' || chr(10) || 'jwt_algorithm: ' || CASE p_size % 5 WHEN 0 THEN 'RS256' WHEN 1 THEN 'ES384' WHEN 2 THEN 'EdDSA' WHEN 3 THEN 'HS256' ELSE 'x25519' END
  || chr(10) || 'title: ES256' || chr(10) || CASE WHEN p_partkey % 3 = 0 THEN 'sshHostKey: ''ssh-ed25519'';  # ssh-rsa' ELSE '' END
  || chr(10) || CASE WHEN p_partkey % 7 = 0 THEN 'signature-algorithm = "RS256"' WHEN p_partkey % 5 = 0 THEN 'signature-algorithm: RS256 RS512' ELSE '' END AS content FROM part),
src AS (SELECT *, 'src_' || substr(sha256(file_name || chr(0) || content), 1, 12) AS source_id FROM corpus),
hits AS (SELECT source_id, origin, file_name, 2 AS line, CASE p_size % 5 WHEN 0 THEN 'RSA' WHEN 1 THEN 'ECDSA' WHEN 2 THEN 'EdDSA' ELSE 'X25519' END AS algorithm FROM src WHERE p_size % 5 <> 3
  UNION ALL SELECT source_id, origin, file_name, 4, 'Ed25519' FROM src WHERE p_partkey % 3 = 0
  UNION ALL SELECT source_id, origin, file_name, 5, 'RSA' FROM src WHERE p_partkey % 7 = 0),
found AS (SELECT h.*, string_split(s.content, chr(10))[h.line] AS evidence FROM hits h JOIN src s USING (source_id))"""
PURPOSE_SQL = "CASE WHEN algorithm IN ('DSA','ECDSA','EdDSA','Ed25519','Ed448') THEN '数字签名' WHEN algorithm IN ('DH','ECDH','X25519','X448') THEN '密钥建立' ELSE '用途待确认' END"
TARGETS_SQL = "CASE WHEN purpose = '数字签名' THEN 'ML-DSA,SLH-DSA' WHEN purpose = '密钥建立' THEN 'ML-KEM' ELSE 'ML-KEM,ML-DSA,SLH-DSA' END"


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fin.scan_config(config_corpus(spark, sf_dir))


# ---- scanning -----------------------------------------------------------------------------------


@query(f"""WITH {CORPUS}, g AS (SELECT origin, count(*) AS high_count, count(DISTINCT source_id) AS source_count, count(DISTINCT algorithm) AS algorithm_count FROM found GROUP BY origin),
r AS (SELECT *, 25 * high_count + 10 * source_count + 10 * algorithm_count AS raw_score FROM g)
SELECT origin, high_count, source_count, algorithm_count, raw_score, CAST(least(100, raw_score) AS BIGINT) AS score, CASE WHEN least(100, raw_score) >= 40 THEN '高' ELSE '中' END AS level FROM r""")
def migration_score(spark, sf_dir):
    f = found(spark, sf_dir).join(rules.profiles(spark).select("algorithm", "risk_level"), "algorithm")
    out = fin.score(f, ["origin"], F.col("risk_level").contains("高"))
    return out.withColumn("score", F.col("score").cast("long"))


@query(f"WITH {CORPUS} SELECT source_id, file_name, line, algorithm, evidence, 'text_config' AS detection_method FROM found")
def identifier_scan(spark, sf_dir):
    return found(spark, sf_dir).select("source_id", "file_name", "line", "algorithm", "evidence", "detection_method")


@query("""SELECT doc_id, CAST(i AS INT) AS line, kind FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
(VALUES ('token', 'token = "[0-9a-f]{40}"'), ('email', '[a-z0-9.]+@[a-z0-9.]+[.][a-z]+'), ('licence', 'Released under')) AS k(kind, pat) WHERE regexp_matches(t, pat)""")
def catalogue_scan(spark, sf_dir):
    own = [("token", 'token = "[0-9a-f]{40}"'), ("email", r"[a-z0-9.]+@[a-z0-9.]+[.][a-z]+"), ("licence", "Released under")]
    lines = fin.numbered_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), "text")
    return lines.select("doc_id", "line", F.explode(rules.identified(F.col("line_text"), own)).alias("kind"))


@query("SELECT doc_id, 'src_' || substr(sha256('d' || doc_id || chr(0) || text), 1, 12) AS source_id FROM documents")
def source_identity(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.source_id(F.concat(F.lit("d"), F.col("doc_id").cast("string")), F.col("text")).alias("source_id"))


@query("SELECT doc_id, CAST(generate_subscripts(string_split(text, chr(10)), 1) AS INT) AS line, CAST(length(unnest(string_split(text, chr(10)))) AS BIGINT) AS chars FROM documents")
def line_explode(spark, sf_dir):
    return fin.numbered_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), "text").select("doc_id", "line", F.length("line_text").cast("long").alias("chars"))


@query("""SELECT p_partkey, name, name IN ('jwtAlg', 'tls-config', 'SSHKeys', 'server.cert') AS is_sensitive FROM
(SELECT p_partkey, CASE p_partkey % 7 WHEN 0 THEN 'jwtAlg' WHEN 1 THEN 'title' WHEN 2 THEN 'tls-config' WHEN 3 THEN 'SSHKeys' WHEN 4 THEN 'keyboard' WHEN 5 THEN 'server.cert' ELSE 'certify' END AS name FROM part)""")
def sensitive_context(spark, sf_dir):
    names = F.element_at(F.array(*map(F.lit, ["jwtAlg", "title", "tls-config", "SSHKeys", "keyboard", "server.cert", "certify"])), (F.col("p_partkey") % 7 + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", names.alias("name")).withColumn("is_sensitive", rules.sensitive(F.col("name")))


PEM_KINDS = ["RSA PRIVATE", "EC PRIVATE", "DSA PUBLIC", "PRIVATE"]


@query("""SELECT c_custkey, 2 AS line, CASE c_custkey % 4 WHEN 0 THEN 'RSA' WHEN 1 THEN 'ECC' WHEN 2 THEN 'DSA' END AS algorithm, CASE WHEN c_custkey % 4 = 3 THEN 'unknown_pem_algorithm' END AS diagnostic FROM customer""")
def pem_scan(spark, sf_dir):
    kind = F.element_at(F.array(*map(F.lit, PEM_KINDS)), (F.col("c_custkey") % 4 + 1).cast("int"))
    content = F.concat(F.lit("note -----BEGIN RSA PRIVATE KEY-----\n-----BEGIN "), kind, F.lit(" KEY-----\nAAAA\n-----END "), kind, F.lit(" KEY-----"))
    lines = fin.numbered_lines(table(spark, sf_dir, "customer").select("c_custkey", content.alias("content")))
    named = rules.identified(F.col("line_text"), rules.PEM_HEADERS)
    generic = F.col("line_text").rlike("^-----BEGIN (?:ENCRYPTED )?(?:PRIVATE|PUBLIC) KEY-----")
    return lines.select("c_custkey", "line", F.get(named, 0).alias("algorithm"), F.when(generic, "unknown_pem_algorithm").alias("diagnostic")).where("algorithm is not null or diagnostic is not null")


# ---- findings to inventories --------------------------------------------------------------------


@query("""SELECT user_id, event_type, min_by(event_id, event_id) AS event_id, arg_min(value, event_id) AS value FROM events GROUP BY user_id, event_type""")
def finding_dedupe_first(spark, sf_dir):
    return fin.dedupe(table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value"), ["user_id", "event_type"], "event_id")


@query("""SELECT user_id, event_type, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events GROUP BY user_id, event_type""")
def finding_dedupe_last(spark, sf_dir):
    return fin.dedupe(table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value"), ["user_id", "event_type"], "event_id", last=True)


@query(f"WITH {CORPUS} SELECT algorithm, '高风险' AS risk_level, count(*) AS n FROM found GROUP BY algorithm")
def profile_join(spark, sf_dir):
    return found(spark, sf_dir).join(rules.profiles(spark), "algorithm").groupBy("algorithm", "risk_level").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {CORPUS} SELECT algorithm, count(*) AS finding_count, count(DISTINCT source_id) AS source_count FROM found GROUP BY algorithm")
def summary_counts(spark, sf_dir):
    return found(spark, sf_dir).groupBy("algorithm").agg(F.count(F.lit(1)).alias("finding_count"), F.countDistinct("source_id").alias("source_count"))


@query(f"""WITH {CORPUS}, a AS (SELECT source_id, file_name, algorithm, count(*) AS finding_count, string_agg(line || ':' || evidence, ';' ORDER BY line, evidence) AS locations FROM found GROUP BY ALL),
p AS (SELECT *, {PURPOSE_SQL} AS purpose FROM a) SELECT *, {TARGETS_SQL} AS targets FROM p""")
def asset_inventory(spark, sf_dir):
    return fin.assets(found(spark, sf_dir))


@query(f"""WITH {CORPUS}, a AS (SELECT algorithm, count(*) AS finding_count, count(DISTINCT source_id) AS affected_files FROM found GROUP BY ALL),
p AS (SELECT *, {PURPOSE_SQL} AS purpose FROM a) SELECT *, {TARGETS_SQL} AS targets FROM p""")
def migration_items(spark, sf_dir):
    return fin.migrations(found(spark, sf_dir))


@query(f"""WITH {CORPUS}, c AS (SELECT origin, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, origin) AS r FROM found GROUP BY origin)
SELECT origin AS label, n, CAST(0 AS BIGINT) AS other_keys FROM c WHERE r <= 8 UNION ALL SELECT 'other', CAST(coalesce(sum(n), 0) AS BIGINT), count(*) FROM c WHERE r > 8""")
def insights_topk_rest(spark, sf_dir):
    return fin.top_with_rest(found(spark, sf_dir), "origin", 8)


@query(f"""WITH {CORPUS}, p AS (SELECT {PURPOSE_SQL} AS purpose FROM found WHERE algorithm <> 'X25519')
SELECT d.purpose, count(p.purpose) AS n FROM (VALUES ('数字签名'), ('密钥建立'), ('用途待确认')) AS d(purpose) LEFT JOIN p ON p.purpose = d.purpose GROUP BY d.purpose""")
def purpose_zero_fill(spark, sf_dir):
    f = found(spark, sf_dir).where("algorithm != 'X25519'").groupBy(rules.purpose(F.col("algorithm")).alias("purpose")).agg(F.count(F.lit(1)).alias("n"))
    every = spark.createDataFrame([(p,) for p in (rules.SIGN, rules.EXCHANGE, rules.OPEN)], "purpose string")
    return every.join(f, "purpose", "left").select("purpose", F.coalesce("n", F.lit(0)).alias("n"))


@query("""SELECT user_id % 50 AS asset, CAST(count_if(event_type = 'click') AS BIGINT) AS confirmed, CAST(count_if(event_type = 'view') AS BIGINT) AS assessed, CAST(count_if(event_type NOT IN ('click', 'view')) AS BIGINT) AS pending FROM events GROUP BY 1""")
def status_pivot(spark, sf_dir):
    e = F.col("event_type")
    return table(spark, sf_dir, "events").groupBy((F.col("user_id") % 50).alias("asset")).agg(F.count_if(e == "click").alias("confirmed"), F.count_if(e == "view").alias("assessed"), F.count_if(~e.isin("click", "view")).alias("pending"))


@query(f"""WITH {CORPUS} SELECT origin AS source, algorithm AS target, 'uses' AS label, count(*) AS weight FROM found GROUP BY ALL
UNION ALL SELECT algorithm, {PURPOSE_SQL}, 'serves', count(*) FROM found GROUP BY ALL""")
def flow_edges(spark, sf_dir):
    # one scan and one combined aggregation: the second kind of edge is summed from the first
    uses = found(spark, sf_dir).groupBy("origin", "algorithm").agg(F.count(F.lit(1)).alias("weight"))
    serves = uses.groupBy("algorithm").agg(F.sum("weight").alias("weight"))
    return uses.select(F.col("origin").alias("source"), F.col("algorithm").alias("target"), F.lit("uses").alias("label"), "weight").unionByName(serves.select(F.col("algorithm").alias("source"), rules.purpose(F.col("algorithm")).alias("target"), F.lit("serves").alias("label"), "weight"))


# ---- filters and joins --------------------------------------------------------------------------


@query("SELECT doc_id, source, lang FROM documents WHERE lang = 'en' AND source = 'src1' AND (contains(lower(text), 'tion') OR contains(lower(source), 'tion'))")
def facet_filter(spark, sf_dir):
    any_ = F.instr(F.lower("text"), F.lit("tion")) > 0
    return table(spark, sf_dir, "documents").where((F.col("lang") == "en") & (F.col("source") == "src1") & (any_ | (F.instr(F.lower("source"), F.lit("tion")) > 0))).select("doc_id", "source", "lang")


@query("SELECT 'lang' AS facet, lang AS value, count(*) AS n FROM documents GROUP BY lang UNION ALL SELECT 'source', source, count(*) FROM documents GROUP BY source")
def facet_values(spark, sf_dir):
    d = table(spark, sf_dir, "documents").groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"))
    one = lambda c: d.groupBy(F.col(c).alias("value")).agg(F.sum("n").alias("n")).select(F.lit(c).alias("facet"), "value", "n")
    return one("lang").unionByName(one("source"))


@query("SELECT o_orderkey, o_orderstatus FROM orders o WHERE EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_quantity >= 49)")
def target_semi_join(spark, sf_dir):
    big = table(spark, sf_dir, "lineitem").where("l_quantity >= 49").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, sf_dir, "orders").join(big, "o_orderkey", "left_semi").select("o_orderkey", "o_orderstatus")


@query("SELECT c_custkey, c_mktsegment FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderpriority = '1-URGENT')")
def unmatched_anti(spark, sf_dir):
    urgent = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").join(urgent, "c_custkey", "left_anti").select("c_custkey", "c_mktsegment")


@query("""WITH n AS (SELECT p_partkey, 'app.' || replace(p_brand, '#', '_') || '.' || (p_size % 7) || '.' || p_partkey % 3 AS target FROM part),
m AS (SELECT DISTINCT 'app.' || replace(p_brand, '#', '_') AS module FROM part UNION SELECT DISTINCT 'app.' || replace(p_brand, '#', '_') || '.' || (p_size % 7) FROM part WHERE p_size % 2 = 0)
SELECT p_partkey, target, module AS prefix FROM n JOIN m ON target = module OR starts_with(target, module || '.') QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY length(module) DESC) = 1""")
def longest_prefix_join(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    base = F.concat(F.lit("app."), F.replace(F.col("p_brand"), F.lit("#"), F.lit("_")))
    size = (F.col("p_size") % 7).cast("string")
    names = p.select("p_partkey", F.concat_ws(".", base, size, (F.col("p_partkey") % 3).cast("string")).alias("target"))
    modules = p.select(base.alias("module")).union(p.where("p_size % 2 = 0").select(F.concat_ws(".", base, size)))
    return seq.longest_prefix(names, "target", modules, "module", ".").select("p_partkey", "target", "prefix")


@query("""WITH RECURSIVE e AS (SELECT DISTINCT s_nationkey AS caller, s_suppkey % 25 AS callee FROM supplier),
w(sink, place, depth) AS (SELECT callee, callee, 0 FROM (SELECT DISTINCT callee FROM e) UNION SELECT w.sink, e.caller, w.depth + 1 FROM w JOIN e ON e.callee = w.place WHERE w.depth < 5)
SELECT CAST(sink AS BIGINT) AS sink, CAST(place AS BIGINT) AS caller, CAST(min(depth) AS INT) AS depth FROM w WHERE depth > 0 GROUP BY ALL""")
def caller_recursion(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    e = s.select(F.col("s_nationkey").cast("long").alias("caller"), (F.col("s_suppkey") % 25).alias("callee")).distinct()
    level = e.select(F.col("callee").alias("sink"), "caller", F.lit(1).alias("depth"))
    every = level
    for depth in range(2, 6):  # at most five calls deep: five unrolled joins, distinct at each level
        level = level.select("sink", F.col("caller").alias("callee")).join(e, "callee").select("sink", "caller").distinct().withColumn("depth", F.lit(depth))
        every = every.unionByName(level)
    return every.groupBy("sink", "caller").agg(F.min("depth").alias("depth"))


@query("""SELECT a.event_id, arg_max(b.value, b.event_id) AS bound_value, max(b.event_id) AS bound_at FROM events a JOIN events b ON a.user_id = b.user_id AND b.event_id < a.event_id AND b.event_type = 'click'
WHERE a.event_type = 'purchase' GROUP BY a.event_id""")
def lexical_latest_before(spark, sf_dir):
    """The latest binding before a use, as an as-of join: one sorted pass over the union of both, no range join."""
    e = table(spark, sf_dir, "events").where("event_type in ('click', 'purchase')").select("event_id", "user_id", "event_type", "value")
    by = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, -1)
    bind = F.last(F.when(F.col("event_type") == "click", F.struct("value", "event_id")), ignorenulls=True).over(by)
    return e.withColumn("b", bind).where("event_type = 'purchase' and b is not null").select("event_id", F.col("b.value").alias("bound_value"), F.col("b.event_id").alias("bound_at"))


@query("""SELECT l_orderkey, l_linenumber, o_orderkey AS span FROM lineitem JOIN (SELECT o_orderkey, o_orderkey + CASE WHEN o_orderkey % 30011 = 0 THEN 1000000 WHEN o_orderkey % 101 = 0 THEN 300 ELSE o_custkey % 4 END AS past FROM orders WHERE o_orderstatus = 'F') ON l_orderkey >= o_orderkey AND l_orderkey < past""")
def span_containment(spark, sf_dir):
    """Places in spans of any length, some empty, some of a million places: an equi-join on blocks of powers of two."""
    k = F.col("o_orderkey")
    length = F.when(k % 30011 == 0, 1_000_000).when(k % 101 == 0, 300).otherwise(F.col("o_custkey") % 4)
    spans = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(k.alias("span"), (k + length).alias("past"))
    places = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber")
    return holding_spans(places, spans, "l_orderkey", "span", "past").select("l_orderkey", "l_linenumber", "span")


@query("""SELECT c_custkey, coalesce(n, 0) AS orders, n IS NULL AS failed FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'P' GROUP BY 1) ON o_custkey = c_custkey""")
def batch_left_ordinal(spark, sf_dir):
    n = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"))
    return table(spark, sf_dir, "customer").select("c_custkey").join(n, "c_custkey", "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("orders"), F.col("n").isNull().alias("failed"))


@query("""SELECT c_mktsegment, CASE WHEN count(n) = count(*) THEN CAST(sum(n) AS DOUBLE) END AS total, count(*) AS customers FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1) ON o_custkey = c_custkey GROUP BY 1""")
def null_poison_sum(spark, sf_dir):
    n = table(spark, sf_dir, "orders").where("o_orderstatus != 'F'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"))
    j = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment").join(n, "c_custkey", "left")
    return j.groupBy("c_mktsegment").agg(F.when(F.count("n") == F.count(F.lit(1)), F.sum("n").cast("double")).alias("total"), F.count(F.lit(1)).alias("customers"))


# ---- sequences ----------------------------------------------------------------------------------


@query("SELECT l_suppkey, l_orderkey, l_linenumber FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey) <= 20")
def repo_cap20(spark, sf_dir):
    r = F.row_number().over(Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey"))
    return table(spark, sf_dir, "lineitem").withColumn("r", r).where("r <= 20").select("l_suppkey", "l_orderkey", "l_linenumber")


@query("SELECT source, doc_id, running FROM (SELECT source, doc_id, CAST(sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id) AS BIGINT) AS running FROM documents) WHERE running <= 60000")
def prefix_budget(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("source", "doc_id", "n_chars")
    return seq.within_budget(d, "source", ["doc_id"], "n_chars", 60_000).select("source", "doc_id", "running")


@query("""WITH RECURSIVE d AS (SELECT source, doc_id, n_chars, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents),
g(source, r, doc_id, used, kept) AS (SELECT source, r, doc_id, CASE WHEN n_chars <= 60000 THEN n_chars ELSE 0 END, n_chars <= 60000 FROM d WHERE r = 1
UNION ALL SELECT d.source, d.r, d.doc_id, CASE WHEN g.used + d.n_chars <= 60000 THEN g.used + d.n_chars ELSE g.used END, g.used + d.n_chars <= 60000 FROM g JOIN d ON d.source = g.source AND d.r = g.r + 1)
SELECT source, doc_id FROM g WHERE kept""")
def greedy_budget(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("source", "doc_id", "n_chars")
    return seq.greedy_budget(d, "source", ["doc_id"], "n_chars", 60_000).select("source", "doc_id")


@query("SELECT user_id, event_id, turn FROM (SELECT user_id, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS INT) AS turn FROM events) ORDER BY turn, user_id LIMIT 500")
def round_robin(spark, sf_dir):
    return seq.interleave(table(spark, sf_dir, "events").select("user_id", "event_id"), "user_id", ["event_id"], 500).select("user_id", "event_id", "turn")


@query("SELECT user_id, event_id, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS b FROM events) WHERE b IS NULL OR b <> event_type")
def adjacent_dedupe(spark, sf_dir):
    return seq.without_repeats(table(spark, sf_dir, "events").select("user_id", "event_id", "event_type"), "user_id", ["event_id"], "event_type")


@query("""SELECT l_suppkey, min(k) AS first, max(k) AS last, count(*) AS n FROM (SELECT l_suppkey, k, k - row_number() OVER (PARTITION BY l_suppkey ORDER BY k) AS i FROM (SELECT DISTINCT l_suppkey, l_orderkey AS k FROM lineitem)) GROUP BY l_suppkey, i""")
def line_runs(spark, sf_dir):
    return seq.islands(table(spark, sf_dir, "lineitem").select("l_suppkey", F.col("l_orderkey").alias("k")), ["l_suppkey"], "k")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50 OFFSET 100")
def paginate(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").offset(100).limit(50)


# ---- sets and measures --------------------------------------------------------------------------


@query("""WITH c AS (SELECT source, CAST(count_if(quality = 1 AND n_chars > 1500) AS BIGINT) AS tp, CAST(count_if(quality = 0 AND n_chars > 1500) AS BIGINT) AS fp, CAST(count_if(quality = 1 AND n_chars <= 1500) AS BIGINT) AS fn FROM labels JOIN documents USING (doc_id) GROUP BY source),
p AS (SELECT *, tp + fp AS n, 1.959963984540054 AS z FROM c WHERE tp + fp > 0)
SELECT source, tp, fp, fn, round(tp / n, 9) AS precision,
round(greatest(0.0, (tp / n + z * z / (2 * n)) / (1 + z * z / n) - z * sqrt((tp / n) * (1 - tp / n) / n + z * z / (4.0 * n * n)) / (1 + z * z / n)), 9) AS low,
round(least(1.0, (tp / n + z * z / (2 * n)) / (1 + z * z / n) + z * sqrt((tp / n) * (1 - tp / n) / n + z * z / (4.0 * n * n)) / (1 + z * z / n)), 9) AS high FROM p""")
def multiset_eval(spark, sf_dir):
    j = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars"), "doc_id")
    gold, said = F.col("quality") == 1, F.col("n_chars") > 1500
    c = j.groupBy("source").agg(F.count_if(gold & said).alias("tp"), F.count_if(~gold & said).alias("fp"), F.count_if(gold & ~said).alias("fn")).where("tp + fp > 0")
    n = (F.col("tp") + F.col("fp")).cast("double")
    low, high = seq.wilson(F.col("tp"), n)
    return c.withColumns({"precision": F.round(F.col("tp") / n, 9), "low": F.round(low, 9), "high": F.round(high, 9)})


@query("""SELECT 'missing' AS side, l_orderkey AS k FROM (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45 EXCEPT SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O')
UNION ALL SELECT 'unproven', o_orderkey FROM (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' EXCEPT SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)""")
def set_diff_edges(spark, sf_dir):
    need = table(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("k")).distinct()
    have = table(spark, sf_dir, "orders").where("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("k"))
    return checks.set_differences(need, have, ["k"])


@query("""SELECT l_returnflag, l_linestatus, count(*) AS n, count(DISTINCT l_suppkey) AS files FROM lineitem GROUP BY ALL""")
def migration_tasks(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("l_suppkey").alias("files"))


@query("""WITH a AS (SELECT DISTINCT l_returnflag AS migration, CAST(l_linenumber AS VARCHAR) AS action FROM lineitem WHERE l_returnflag <> 'R' OR l_linenumber < 4)
SELECT action, count(*) = (SELECT count(DISTINCT migration) FROM a) AS shared, CASE WHEN count(*) < (SELECT count(DISTINCT migration) FROM a) THEN string_agg(migration, ',' ORDER BY migration) END AS items FROM a GROUP BY action""")
def shared_actions(spark, sf_dir):
    a = table(spark, sf_dir, "lineitem").where("l_returnflag != 'R' or l_linenumber < 4").select(F.col("l_returnflag").alias("migration"), F.col("l_linenumber").cast("string").alias("action")).distinct()
    return checks.shared_and_own(a, "migration", "action").select("action", "shared", F.array_join("items", ",").alias("items"))


@query("""SELECT c_custkey, CASE WHEN n = 1 THEN name WHEN m = 1 THEN name || ' · ' || suffix ELSE name || ' · ' || id END AS label FROM (SELECT c_custkey, name, id, suffix, count(*) OVER (PARTITION BY name) AS n, count(*) OVER (PARTITION BY name, suffix) AS m
FROM (SELECT c_custkey, c_mktsegment || c_nationkey AS name, md5(CAST(c_custkey AS VARCHAR)) AS id, right(md5(CAST(c_custkey AS VARCHAR)), 2) AS suffix FROM customer))""")
def label_disambiguation(spark, sf_dir):
    key = F.md5(F.col("c_custkey").cast("string"))
    c = table(spark, sf_dir, "customer").select("c_custkey", F.concat("c_mktsegment", F.col("c_nationkey").cast("string")).alias("name"), key.alias("id"), F.right(key, F.lit(2)).alias("suffix"))
    n, m = F.count(F.lit(1)).over(Window.partitionBy("name")), F.count(F.lit(1)).over(Window.partitionBy("name", "suffix"))
    return c.withColumns({"n": n, "m": m}).select("c_custkey", F.when(F.col("n") == 1, F.col("name")).when(F.col("m") == 1, F.concat_ws(" · ", "name", "suffix")).otherwise(F.concat_ws(" · ", "name", "id")).alias("label"))


# ---- text, opinions, streams --------------------------------------------------------------------


@query("""SELECT page_id, CASE WHEN v LIKE '=%' THEN '''' || v ELSE v END AS csv_cell, replace(replace(replace(replace(replace(v, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '|', '\\|'), chr(10), ' ↵ ') AS md_cell FROM (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN '=' || url || '|x' ELSE url || chr(10) || '|' END AS v FROM pages)""")
def csv_guard_md_escape(spark, sf_dir):
    v = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("="), "url", F.lit("|x"))).otherwise(F.concat("url", F.lit("\n|")))
    return table(spark, sf_dir, "pages").select("page_id", v.alias("v")).select("page_id", text.csv_guard(F.col("v")).alias("csv_cell"), text.markdown_cell(F.col("v")).alias("md_cell"))


@query("""SELECT doc_id, md5(regexp_replace(regexp_replace(text, '([a-zA-Z][a-zA-Z0-9+.-]*://)[^/\\s:@]+:[^/\\s@]+@', '\\1[REDACTED]@', 'g'), '((?:password|secret|token|api_key)\\s*[=:]\\s*)"[^"\\n]*"', '\\1"[REDACTED]"', 'gi')) AS digest FROM documents""")
def redact_sql(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.redact(F.col("text"))).alias("digest"))


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity < 5 THEN 'no_location' WHEN l_discount = 0 THEN 'no_citation' WHEN l_tax > 0.06 THEN 'blocking_gap' WHEN l_returnflag = 'N' THEN 'abstained' ELSE 'adopted' END AS reason FROM lineitem""")
def adoption_reason(spark, sf_dir):
    """The first test that an opinion fails, in order."""
    why = F.when(F.col("l_quantity") < 5, "no_location").when(F.col("l_discount") == 0, "no_citation").when(F.col("l_tax") > 0.06, "blocking_gap").when(F.col("l_returnflag") == "N", "abstained").otherwise("adopted")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", why.alias("reason"))


@query("""WITH f AS (SELECT o_orderkey, count(*) AS n, min(l_linenumber) AS op FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_quantity > 48 GROUP BY 1)
SELECT o.o_orderkey, CASE WHEN n = 1 THEN 'confirmed' WHEN n > 1 THEN 'ambiguous' ELSE 'pending' END AS status, CAST(CASE WHEN n = 1 THEN op END AS DOUBLE) AS operation FROM orders o LEFT JOIN f USING (o_orderkey)""")
def integrate_status(spark, sf_dir):
    """A finding takes an operation if exactly one matches; counts are combined before the shuffle."""
    ops = table(spark, sf_dir, "lineitem").where("l_quantity > 48").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("n"), F.min("l_linenumber").alias("op"))
    j = table(spark, sf_dir, "orders").select("o_orderkey").join(ops, "o_orderkey", "left")
    return j.select("o_orderkey", F.when(F.col("n") == 1, "confirmed").when(F.col("n") > 1, "ambiguous").otherwise("pending").alias("status"), F.when(F.col("n") == 1, F.col("op")).cast("double").alias("operation"))


@query("""SELECT doc_id, CAST(i AS INT) AS line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents) WHERE contains(t, 'Released under')""")
def stream_scan(spark, sf_dir):
    """The licence scan over a stream of Parquet files; a stateless query whose file sink writes each batch once."""
    d = table(spark, sf_dir, "documents")
    stream = spark.readStream.schema(d.schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/documents.parquet" if len(d.inputFiles()) > 1 else f"{sf_dir}/documents.parquet*")
    lines = fin.numbered_lines(stream.select("doc_id", "text"), "text")
    return streams.run_available(lines.where(F.col("line_text").contains("Released under")).select("doc_id", "line"))
