"""Queries of names, filters, pages, roll-ups, neighbourhoods and updates."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairn.functions import catalogue, names
from cairn.functions.rules import profiles
from cairn.operators import dispatch, numbering, views
from cairn.operators import integration as itg
from cairn.plans.deep import imports
from cairn.plans.files import pick
from cairn.plans.registry import query
from cairn.sources.readers import config_corpus, table

# ---- names --------------------------------------------------------------------------------------

PATHS = ["src/a/b.py", "pkg/__init__.py", "C:\\x\\y.py", "a/../b.py", "con.txt/x.py", "ok/LPT1 .py", "a//b.py", "deep/a. /x.py", "m.pyw", "x|y.py"]


@query(f"""SELECT p_partkey, path, regexp_extract(path, '([^/\\\\]*)$', 1) AS base, ['src.a.b', 'pkg', 'C:\\x\\y', 'a....b', 'con.txt.x', 'ok.LPT1 ', 'a..b', 'deep.a. .x', 'm', 'x|y'][p_partkey % 10 + 1] AS module,
[NULL, NULL, 'format', 'part', 'part', 'part', 'part', 'part', NULL, 'part'][p_partkey % 10 + 1] AS fault FROM (SELECT p_partkey, [{", ".join("'" + p + "'" for p in PATHS)}][p_partkey % 10 + 1] AS path FROM part)""")
def path_names(spark, sf_dir):
    """Base names, modules and faults of paths."""
    p = table(spark, sf_dir, "part").select("p_partkey", pick(F.col("p_partkey"), *PATHS).alias("path"))
    return p.select("p_partkey", "path", names.base_name(F.col("path")).alias("base"), names.module_of(F.col("path")).alias("module"), names.path_fault(F.col("path")).alias("fault"))


@query("""WITH m AS (SELECT l_orderkey, l_linenumber, ['a', 'a.b', 'a.b.c', ''][l_suppkey % 4 + 1] AS module, l_linenumber % 2 = 0 AS package, l_quantity % 3 + 1 AS lvl FROM lineitem),
k AS (SELECT *, CASE WHEN module = '' THEN [] ELSE string_split(module, '.') END AS parts FROM m)
SELECT l_orderkey, l_linenumber, CASE WHEN len(parts) - lvl + package::INT >= 0 THEN array_to_string(parts[1:CAST(len(parts) - lvl + package::INT AS INT)], '.') END AS base FROM k""")
def relative_imports(spark, sf_dir):
    """Where relative imports of modules and packages start."""
    module = pick(F.col("l_suppkey"), "a", "a.b", "a.b.c", "")
    base = names.relative_base(module, F.col("l_linenumber") % 2 == 0, (F.col("l_quantity") % 3 + 1).cast("int"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", base.alias("base"))


NAMED = ["makeKeyPair", "rsaKey", "signer.run", "resign", "X25519PrivateKey", "load_jwt", "asymmetric.x", "plain", "designKem", "EllipticCurvePublicKey.y"]


@query(f"""SELECT c_custkey, [{", ".join("'" + n + "'" for n in NAMED)}][c_custkey % 10 + 1] AS name, [false, true, true, false, true, true, true, false, true, true][c_custkey % 10 + 1] AS crypto, CASE WHEN c_custkey * 7 < 1000 THEN CAST(c_custkey * 7 AS VARCHAR) ELSE printf('%.1f', round(c_custkey * 7 / 1000.0, 1)) || 'k' END AS stars FROM customer""")
def crypto_names(spark, sf_dir):
    """Names of cryptography by words, by camel case and by parts of known targets; large numbers in short."""
    from cairn.plans.scans import TARGETS

    k = F.col("c_custkey")
    name = pick(k, *NAMED)
    return table(spark, sf_dir, "customer").select("c_custkey", name.alias("name"), names.crypto_named(name, names.catalogue_parts([t for t, _ in TARGETS])).alias("crypto"), names.short_count(k * 7).alias("stars"))


@query("""SELECT doc_id, decode(encode(text)[3:12]) AS part FROM (SELECT doc_id, 'ab' || chr(228) || chr(8364) || 'cdefghijk' || doc_id AS text FROM documents)""")
def byte_parts(spark, sf_dir):
    """Parts of lines between byte columns."""
    text = F.concat(F.lit("abä€cdefghijk"), F.col("doc_id").cast("string"))
    return table(spark, sf_dir, "documents").select("doc_id", names.byte_slice(text, F.lit(2), F.lit(12)).alias("part"))


@query("""SELECT event_id, sha256('{"a":' || event_id || ',"b":"' || event_type || '","c":' || CASE WHEN user_id % 3 = 0 THEN 'null' ELSE CAST(user_id AS VARCHAR) END || '}') AS digest,
CASE WHEN event_id >= 3600 THEN printf('%d:%02d:%02d', event_id // 3600, event_id // 60 % 60, event_id % 60) ELSE printf('%d:%02d', event_id // 60 % 60, event_id % 60) END AS took FROM events""")
def row_digests(spark, sf_dir):
    """Digests of rows as canonical JSON, and seconds as times."""
    e, u = F.col("event_id"), F.col("user_id")
    return table(spark, sf_dir, "events").select("event_id", names.canonical_digest(c=F.when(u % 3 != 0, u), a=e, b=F.col("event_type")).alias("digest"), names.elapsed(e).alias("took"))


@query("""WITH c AS (SELECT user_id, event_type, event_id % 2 AS half, count(*) AS n FROM events GROUP BY ALL), s AS (SELECT user_id, event_type, CAST(sum(n) AS BIGINT) AS n FROM c GROUP BY ALL)
SELECT user_id, string_agg(event_type || '=' || n, ',' ORDER BY event_type) AS counts FROM s GROUP BY user_id""")
def merged_counts(spark, sf_dir):
    """Counts of two halves added key by key."""
    e = table(spark, sf_dir, "events").groupBy("user_id", (F.col("event_id") % 2).alias("half"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    maps = e.groupBy("user_id").agg(*[F.map_from_entries(F.collect_list(F.when(F.col("half") == h, F.struct("event_type", "n")))).alias(f"m{h}") for h in (0, 1)])
    entries = F.array_sort(F.map_entries(names.add_counts(F.col("m0"), F.col("m1"))))
    return maps.select("user_id", F.array_join(F.transform(entries, lambda x: F.concat(x["key"], F.lit("="), x["value"].cast("string"))), ",").alias("counts"))


# ---- filters ------------------------------------------------------------------------------------

SHOWN = """shown AS (SELECT event_id, CASE WHEN user_id % 5 = 0 THEN NULL ELSE 'F' || user_id || '.py' END AS file_name, 's' || user_id % 40 AS source_id, ['RSA', 'ECDSA', 'DH'][event_id % 3 + 1] AS algorithm, event_type AS evidence,
  CASE WHEN event_id % 4 = 0 THEN NULL ELSE 'ast_call' END AS detection_method, CASE WHEN event_id % 7 = 0 THEN NULL ELSE ['pending', 'confirmed'][event_id % 2 + 1] END AS verification_status, CASE WHEN event_id % 5 < 2 THEN NULL ELSE 'sign' END AS purpose_code,
  CASE WHEN event_id % 6 = 0 THEN 'verify' END AS effective_purpose_code FROM events)"""


def shown(spark, sf_dir):
    e, u = F.col("event_id"), F.col("user_id")
    return table(spark, sf_dir, "events").select(
        "event_id", F.when(u % 5 != 0, F.concat(F.lit("F"), u.cast("string"), F.lit(".py"))).alias("file_name"), F.concat(F.lit("s"), (u % 40).cast("string")).alias("source_id"), pick(e, "RSA", "ECDSA", "DH").alias("algorithm"), F.col("event_type").alias("evidence"),
        F.when(e % 4 != 0, "ast_call").alias("detection_method"), F.when(e % 7 != 0, pick(e, "pending", "confirmed")).alias("verification_status"), F.when(e % 5 >= 2, "sign").alias("purpose_code"), F.when(e % 6 == 0, "verify").alias("effective_purpose_code"),
    )


FOUND = """SELECT {i} AS test, event_id FROM shown WHERE {where}"""
TESTS = [
    ({"algorithm": "RSA", "query": " CLICK "}, "algorithm = 'RSA' AND (contains(lower(coalesce(file_name, '')), 'click') OR contains(evidence, 'click'))"),
    ({"query": "f1", "source_id": "s7"}, "source_id = 's7' AND contains(lower(coalesce(file_name, '')), 'f1')"),
    ({"method": "unknown", "status": "confirmed"}, "detection_method IS NULL AND coalesce(verification_status, 'confirmed') = 'confirmed'"),
    ({"purpose": "verify"}, "effective_purpose_code = 'verify'"),
    ({"purpose": "unknown", "algorithm": "DH"}, "algorithm = 'DH' AND effective_purpose_code IS NULL AND purpose_code IS NULL"),
]


@query(f"WITH {SHOWN} " + " UNION ALL ".join(FOUND.format(i=i, where=w) for i, (_, w) in enumerate(TESTS)))
def finding_filters(spark, sf_dir):
    """Findings by algorithm, source, method, status, purpose and text."""
    out = None
    for i, (how, _) in enumerate(TESTS):
        part = views.filter_findings(shown(spark, sf_dir), **how).select(F.lit(i).alias("test"), "event_id")
        out = part if out is None else out.unionByName(part)
    return out


@query(f"WITH {SHOWN} SELECT event_id FROM shown WHERE algorithm <> 'DH' AND list_contains(CASE WHEN event_id % 3 = 0 THEN ['rule'] WHEN verification_status = 'ai_assessed' THEN ['ai'] ELSE ['cross_file'] END, 'cross_file') AND contains(lower(concat_ws(' ', coalesce(file_name, ''), algorithm)), '.py ec')")
def record_filter(spark, sf_dir):
    """Records of a graph by origin and by their joined names."""
    rows = shown(spark, sf_dir).where("algorithm <> 'DH'").withColumn("origins", F.when(F.col("event_id") % 3 == 0, F.array(F.lit("rule")))).withColumn("purpose_codes", F.array("purpose_code"))
    return views.filter_records(rows, origin="cross_file", query=".py EC").select("event_id")


@query(f"""WITH {SHOWN}, m AS (SELECT algorithm, ['ML-KEM', 'ML-DSA'][1 + CAST(algorithm = 'ECDSA' AS INT)] AS target, CASE WHEN algorithm = 'DH' THEN list(event_id) FILTER (WHERE event_id % 10 = 0) END AS ids FROM shown GROUP BY algorithm)
SELECT event_id FROM shown WHERE algorithm = 'RSA' OR algorithm = 'DH' AND event_id % 10 = 0""")
def targeted_findings(spark, sf_dir):
    """Findings that migrations to ML-KEM name, by id or by algorithm."""
    rows = shown(spark, sf_dir).withColumnRenamed("event_id", "finding_id")
    ids = F.array_compact(F.collect_list(F.when((F.col("algorithm") == "DH") & (F.col("finding_id") % 10 == 0), F.col("finding_id"))))
    plans = rows.groupBy("algorithm").agg(ids.alias("finding_ids")).withColumn("targets", F.when(F.col("algorithm") == "ECDSA", F.array(F.lit("ML-DSA"))).otherwise(F.array(F.lit("ML-KEM"))))
    return views.with_targets(rows, plans, "ML-KEM").select(F.col("finding_id").alias("event_id"))


@query("SELECT event_id FROM events ORDER BY event_id DESC LIMIT 30 OFFSET (SELECT (count(*) - 1) // 30 * 30 FROM events)")
def last_page(spark, sf_dir):
    """The last page, asked for by a number beyond it."""
    return views.page(table(spark, sf_dir, "events").select("event_id"), [F.desc("event_id")], 10**9, 30)[0]


@query("""WITH s AS (SELECT count(*) AS c, count_if(o_orderkey % 3 <> 0) AS d FROM orders) SELECT c AS candidate_files, d AS scanned_files, c - d AS skipped_files, c > d AS partial, 'not_utf8=' || (SELECT count(*) FROM orders WHERE o_orderkey % 6 = 0) || ',too_large=' || (SELECT count(*) FROM orders WHERE o_orderkey % 6 = 3) AS reasons FROM s""")
def coverage_rollup(spark, sf_dir):
    """How much of a table of files was scanned, and why the rest wasn't."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("source_id"))
    skipped = o.where("source_id % 3 = 0").groupBy(F.when(F.col("source_id") % 6 == 0, "not_utf8").otherwise("too_large").alias("reason")).agg(F.count(F.lit(1)).alias("files"))
    out = views.coverage(o, o.where("source_id % 3 <> 0"), skipped)
    return out.select("candidate_files", "scanned_files", "skipped_files", "partial", F.array_join(F.transform(F.map_entries("skip_reasons"), lambda x: F.concat(x["key"], F.lit("="), x["value"].cast("string"))), ",").alias("reasons"))


@query(f"""WITH {SHOWN}, a AS (SELECT algorithm, count(*) AS n FROM shown GROUP BY 1 ORDER BY n DESC, algorithm LIMIT 1), f AS (SELECT source_id, coalesce(file_name, '-') AS file_name, count(*) AS n FROM shown GROUP BY ALL ORDER BY n DESC, file_name, source_id LIMIT 1)
SELECT a.algorithm AS top_algorithm, a.n AS algorithm_count, f.file_name AS top_file, f.source_id AS top_source, f.n AS file_count, (SELECT count_if(coalesce(verification_status, 'confirmed') <> 'pending' AND coalesce(purpose_code, 'unknown') = 'unknown') FROM shown) AS unknown_purposes FROM a, f""")
def concise_insights(spark, sf_dir):
    """The most frequent algorithm and file, and open purposes."""
    return views.concise(shown(spark, sf_dir).fillna({"file_name": "-", "verification_status": "confirmed", "purpose_code": "unknown"}))


@query("""WITH g AS (SELECT source AS repo, count_if(doc_id % 3 = 0) + count_if(doc_id % 3 = 1 AND n_chars > 1000) AS n FROM documents WHERE source IS NOT NULL GROUP BY 1) SELECT repo, CAST(n AS BIGINT) AS finding_count, CAST(sum(n) OVER () AS BIGINT) AS all_findings, CAST(max(n) OVER () AS BIGINT) AS most_findings FROM g""")
def repo_comparison(spark, sf_dir):
    """Findings of both kinds of each source, beside the sum and the largest."""
    g = table(spark, sf_dir, "documents").where("source is not null").groupBy(F.col("source").alias("repo")).agg(F.count_if(F.col("doc_id") % 3 == 0).alias("c"), F.count_if((F.col("doc_id") % 3 == 1) & (F.col("n_chars") > 1000)).alias("a"))
    return views.compared(g, "repo", "c", "a")


@query("""WITH t AS (SELECT CAST(user_id AS VARCHAR) AS label, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, user_id) AS r FROM events GROUP BY user_id)
SELECT label, n FROM t WHERE r < 8 UNION ALL SELECT 'other', CAST(sum(n) AS BIGINT) FROM t WHERE r >= 8""")
def merged_tail(spark, sf_dir):
    """The seven largest groups and the sum of the others in the eighth place."""
    return views.merged_tail(table(spark, sf_dir, "events").withColumn("one", F.lit(1).cast("long")), "user_id", "one", 8)


EDGES = "e AS (SELECT DISTINCT l_partkey AS source, -1 - l_suppkey AS target FROM lineitem)"


@query(f"""WITH {EDGES}, b AS (SELECT * FROM e UNION SELECT target, source FROM e), d0 AS (SELECT 1 AS node UNION SELECT -3), d1 AS (SELECT DISTINCT b.target AS node FROM d0 JOIN b ON node = source WHERE b.target NOT IN (SELECT node FROM d0)),
d2 AS (SELECT DISTINCT b.target AS node FROM d1 JOIN b ON node = source WHERE b.target NOT IN (SELECT node FROM d0) AND b.target NOT IN (SELECT node FROM d1))
SELECT node, 0 AS distance FROM d0 UNION ALL SELECT node, 1 FROM d1 UNION ALL SELECT node, 2 FROM d2""")
def neighbourhood(spark, sf_dir):
    """Nodes within two steps of a part and a supplier, among all that is supplied."""
    edges = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").cast("long").alias("source"), (-1 - F.col("l_suppkey")).cast("long").alias("target"))
    return views.neighbourhood(edges, spark.createDataFrame([(1,), (-3,)], "node long"), 2)


@query("""WITH RECURSIVE e AS (SELECT c_custkey AS source, c_custkey // 3 AS target FROM customer WHERE c_custkey >= 3 UNION SELECT c_custkey, c_custkey - 1 FROM customer WHERE c_custkey % 10 = 1 UNION SELECT c_custkey, c_custkey + 1 FROM customer WHERE c_custkey % 10 = 0 AND c_custkey < (SELECT max(c_custkey) FROM customer)),
r AS (SELECT source, target FROM e UNION SELECT r.source, e.target FROM r JOIN e ON r.target = e.source) SELECT source, target FROM r WHERE source <> target""")
def dependency_closure(spark, sf_dir):
    """All modules that a module depends on, over any number of imports and over cycles."""
    return views.closure(imports(spark, sf_dir)[1].select(F.col("source").cast("long").alias("source"), F.col("target").cast("long").alias("target")))


@query("""WITH b AS (SELECT p_partkey AS id, p_partkey % 97 * 10.0 AS x, p_partkey % 89 * 10.0 AS y, p_size * 1.0 AS width, 8.0 AS height FROM part), v AS (SELECT id FROM b WHERE x <= 300 AND x + width >= 100 AND y <= 400 AND y + height >= 200)
SELECT DISTINCT source, target FROM (SELECT p_partkey AS source, p_partkey + 5 AS target FROM part) WHERE source IN (SELECT id FROM v) OR target IN (SELECT id FROM v)""")
def viewport_links(spark, sf_dir):
    """Links that touch a box in a viewport."""
    k = F.col("p_partkey")
    p = table(spark, sf_dir, "part")
    boxes = p.select(k.alias("id"), (k % 97 * 10.0).alias("x"), (k % 89 * 10.0).alias("y"), (F.col("p_size") * 1.0).alias("width"), F.lit(8.0).alias("height"))
    return views.visible(boxes, p.select(k.alias("source"), (k + 5).alias("target")), 100, 200, 300, 400)[1]


@query("""SELECT user_id, event_id, value FROM (SELECT *, min(CASE WHEN event_type = 'purchase' AND event_id % 3 = 0 THEN event_id END) OVER (PARTITION BY user_id) AS stop FROM events) WHERE stop IS NULL OR event_id <= stop""")
def terminal_freeze(spark, sf_dir):
    """Updates of a task up to the one that ends it."""
    return views.before_terminal(table(spark, sf_dir, "events"), "user_id", "event_id", (F.col("event_type") == "purchase") & (F.col("event_id") % 3 == 0)).select("user_id", "event_id", "value")


@query("SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def latest_versions(spark, sf_dir):
    """The last version of each task."""
    return views.latest(table(spark, sf_dir, "events").select("user_id", "event_id", "event_type"), ["user_id"], "event_id")


@query("""SELECT c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_name) AS ordinal FROM customer""")
def source_ordinals(spark, sf_dir):
    """Numbers of sources in the order of their names."""
    return numbering.numbered(table(spark, sf_dir, "customer"), ["c_nationkey"], ["c_name"]).select("c_custkey", "ordinal")


@query("""WITH s AS (SELECT user_id, event_type, min(event_id) AS o FROM events GROUP BY ALL) SELECT user_id, string_agg(event_type, ',' ORDER BY o) AS methods FROM s GROUP BY user_id""")
def first_seen_methods(spark, sf_dir):
    """Distinct values of a group in the order in which they first occur."""
    return itg.first_seen(table(spark, sf_dir, "events"), ["user_id"], "event_id", methods="event_type").withColumn("methods", F.array_join("methods", ","))


ALIAS_NAMES = ["EC", "RS384", "ES256K", "DH", "PS512", "Ed25519"]


@query(f"""SELECT event_id, ['ECC', 'RSA', 'ECDSA', 'DH', 'RSA', 'Ed25519'][event_id % 6 + 1] AS algorithm, ['签名场景：ML-DSA / SLH-DSA,密钥建立场景：ML-KEM', '签名场景：ML-DSA / SLH-DSA,密钥建立场景：ML-KEM', '签名场景：ML-DSA / SLH-DSA', '密钥建立场景：ML-KEM', '签名场景：ML-DSA / SLH-DSA,密钥建立场景：ML-KEM', '签名场景：ML-DSA / SLH-DSA'][event_id % 6 + 1] AS looked_at,
['AST 调用', '跨文件核验', '未记录'][event_id % 3 + 1] AS method, ['验签', '密钥导入', '用途待确认'][event_id % 3 + 1] AS purpose FROM events""")
def algorithm_names(spark, sf_dir):
    """What a name stands for, what to look at for it, and labels of methods and purposes."""
    e = F.col("event_id")
    name = catalogue.canonical(pick(e, *ALIAS_NAMES))
    label = F.array_join(F.transform(catalogue.direction_references(name, F.lit("unknown")), lambda r: r["label"]), ",")
    return table(spark, sf_dir, "events").select("event_id", name.alias("algorithm"), label.alias("looked_at"), catalogue.method_label(pick(e, "ast_call", "cross_file", "other")).alias("method"), catalogue.purpose_label(pick(e, "verify", "key_import", "nothing")).alias("purpose"))


# ---- whole scans --------------------------------------------------------------------------------


@query("""SELECT 'f' || p_partkey || '.yaml' AS file_name, CASE WHEN bad THEN NULL WHEN p_size % 5 = 0 THEN 'RSA' WHEN p_size % 5 = 1 THEN 'ECDSA' WHEN p_size % 5 = 2 THEN 'EdDSA' ELSE 'X25519' END AS algorithm, CASE WHEN bad THEN 0 ELSE 2 END AS line,
CASE WHEN bad THEN NULL ELSE 'text_config' END AS rule_id, 'crypto-rules-3' AS rule_version, CASE WHEN bad THEN NULL ELSE '高风险' END AS risk_level, CASE WHEN bad THEN 'config_parse_error' END AS diagnostic
FROM (SELECT *, p_partkey % 3 = 0 OR p_partkey % 7 = 0 AS bad FROM part) WHERE bad OR p_size % 5 <> 3""")
def findings_with_rules(spark, sf_dir):
    """Findings of configuration files with the rule that made them, and files that can't be read."""
    found = dispatch.with_rules(dispatch.scan(config_corpus(spark, sf_dir)))
    return found.withColumn("rule_id", F.when(F.col("diagnostic").isNull(), F.col("rule_id"))).select("file_name", "algorithm", "line", "rule_id", "rule_version", "risk_level", "diagnostic")
