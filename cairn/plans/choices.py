"""Queries that share, match, merge, check and rank rows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from cairn.functions import names, redaction, rules
from cairn.operators import checks
from cairn.operators import selection as sel
from cairn.operators import sequences as seq
from cairn.operators.steps import spread
from cairn.plans.files import pick
from cairn.plans.registry import query
from cairn.sources.readers import table

# ---- shares and lanes ---------------------------------------------------------------------------


@query("""WITH g AS (SELECT source || '/' || lang AS repo, count(*) AS c FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL GROUP BY 1),
l AS (SELECT max(v) AS v FROM (SELECT t.v, sum(least(c, t.v)) AS s FROM g, range(0, 2000) t(v) GROUP BY t.v) WHERE s <= 150),
r AS (SELECT g.*, v, row_number() OVER (PARTITION BY c > v ORDER BY repo) AS n, (SELECT 150 - sum(least(c, l.v)) FROM g, l) AS rest FROM g, l)
SELECT repo, c, CAST(least(c, v) + CASE WHEN c > v AND n <= rest THEN 1 ELSE 0 END AS BIGINT) AS allocated FROM r""")
def fair_share(spark, sf_dir):
    g = table(spark, sf_dir, "documents").where("source is not null and lang is not null").groupBy(F.concat_ws("/", "source", "lang").alias("repo")).agg(F.count("*").alias("c"))
    return sel.fair_shares(g, "repo", "c", 150)


@query("""WITH e AS (SELECT event_id, CASE event_type WHEN 'purchase' THEN 'unresolved' WHEN 'click' THEN 'independent' ELSE 'review' END AS lane FROM events),
n AS (SELECT *, row_number() OVER (PARTITION BY lane ORDER BY event_id) - 1 AS i FROM e),
p AS (SELECT *, CASE WHEN lane = 'unresolved' THEN i // 2 ELSE i END AS turn, CASE lane WHEN 'unresolved' THEN i % 2 WHEN 'independent' THEN 2 ELSE 3 END AS slot FROM n)
SELECT event_id, lane, CAST(row_number() OVER (ORDER BY turn, slot) AS INT) AS place FROM p ORDER BY turn, slot LIMIT 300""")
def weighted_lanes(spark, sf_dir):
    lane = F.when(F.col("event_type") == "purchase", "unresolved").when(F.col("event_type") == "click", "independent").otherwise("review")
    e = table(spark, sf_dir, "events").select("event_id", lane.alias("lane"))
    return sel.lanes(e, "lane", {"unresolved": 2, "independent": 1, "review": 1}, ["event_id"], 300)


# ---- matches ------------------------------------------------------------------------------------


@query("""WITH o AS (SELECT l_orderkey * 10 + l_linenumber AS op, l_suppkey, l_linenumber FROM lineitem WHERE l_quantity > 40),
f AS (SELECT l_suppkey, l_linenumber, min(l_orderkey) AS matched FROM lineitem WHERE l_quantity < 3 GROUP BY ALL HAVING count(*) = 1)
SELECT op, l_suppkey, l_linenumber, CASE WHEN op = min(op) OVER (PARTITION BY l_suppkey, l_linenumber) THEN matched END AS matched FROM o LEFT JOIN f USING (l_suppkey, l_linenumber)""")
def unique_match(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    o = l.where("l_quantity > 40").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("op"), "l_suppkey", "l_linenumber")
    f = l.where("l_quantity < 3").select("l_suppkey", "l_linenumber", F.col("l_orderkey").alias("finding"))
    return sel.unique_match(o, "op", f, "finding", ["l_suppkey", "l_linenumber"])


@query("""SELECT l_orderkey, l_linenumber, l_linenumber % 4 BETWEEN 1 AND 2 OR l_quantity BETWEEN 10 AND 20 AS covered FROM lineitem""")
def citation_cover(spark, sf_dir):
    """Whether some cited range of lines holds the line; the ranges stay in an array, so nothing is joined."""
    at = lambda line, low, high: F.struct(line.cast("double").alias("line"), F.lit(float(low)).alias("low"), F.lit(float(high)).alias("high"))
    cited = F.array(at(F.col("l_linenumber") % 4, 1, 2), at(F.col("l_quantity"), 10, 20))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.exists(cited, lambda c: c["line"].between(c["low"], c["high"])).alias("covered"))


@query("""SELECT c.event_id, CASE WHEN max(s.event_id) + 400 >= c.event_id THEN max(s.event_id) END AS span FROM events c LEFT JOIN events s ON s.user_id = c.user_id AND s.event_type = 'view' AND s.event_id <= c.event_id
WHERE c.event_type = 'purchase' GROUP BY c.event_id""")
def enclosing_span(spark, sf_dir):
    """The function that a call is in: the last start before it, if that function hasn't ended; one sorted pass."""
    e = table(spark, sf_dir, "events").where("event_type in ('view', 'purchase')").select("event_id", "user_id", "event_type")
    by = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0)
    start = F.last(F.when(F.col("event_type") == "view", F.col("event_id")), ignorenulls=True).over(by)
    return e.withColumn("s", start).where("event_type = 'purchase'").select("event_id", F.when(F.col("s") + 400 >= F.col("event_id"), F.col("s")).alias("span"))


@query("""WITH d AS (SELECT DISTINCT p_size AS source, p_size % 7 + 1 AS dep FROM part), sees AS (SELECT source, dep FROM d UNION SELECT source, source FROM d),
s AS (SELECT p_partkey AS symbol, p_partkey % 97 AS name, p_size AS source FROM part),
c AS (SELECT o_orderkey AS call, o_custkey % 97 AS name, CAST(o_orderkey % 50 + 1 AS INT) AS source FROM orders)
SELECT call, min(symbol) AS symbol FROM c JOIN sees USING (source) JOIN s ON s.source = sees.dep AND s.name = c.name GROUP BY call HAVING count(DISTINCT symbol) = 1""")
def resolved_calls(spark, sf_dir):
    """Calls whose name has exactly one definition in their source or what it depends on; all joins are on equal keys."""
    p = table(spark, sf_dir, "part")
    d = p.select(F.col("p_size").alias("source"), (F.col("p_size") % 7 + 1).alias("dep")).distinct()
    sees = d.union(d.select("source", F.col("source"))).distinct()
    # a name with several definitions in a source makes one row there, not one for each call and definition
    s = p.groupBy((F.col("p_partkey") % 97).alias("name"), F.col("p_size").alias("dep")).agg(F.min("p_partkey").alias("symbol"), F.max("p_partkey").alias("most"))
    c = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("call"), (F.col("o_custkey") % 97).alias("name"), (F.col("o_orderkey") % 50 + 1).cast("int").alias("source"))
    hit = c.join(sees, "source").join(s, ["dep", "name"])
    return hit.groupBy("call").agg(F.min("symbol").alias("symbol"), F.max("most").alias("_most")).where("symbol = _most").drop("_most")


@query("""WITH m AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'x' ELSE md5(text) END AS want FROM documents WHERE doc_id % 3 <> 0), f AS (SELECT doc_id, md5(text) AS have FROM documents WHERE doc_id % 5 <> 0)
SELECT doc_id, CASE WHEN f.doc_id IS NULL THEN 'missing_file' WHEN m.doc_id IS NULL THEN 'not_listed' WHEN want IS DISTINCT FROM have THEN 'digest_differs' ELSE 'ok' END AS status FROM m FULL JOIN f USING (doc_id)""")
def manifest_check(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("have"))
    f = d.where("doc_id % 5 != 0")
    m = d.where("doc_id % 3 != 0").select("doc_id", F.when(F.col("doc_id") % 7 == 0, "x").otherwise(F.col("have")).alias("want"))
    return checks.check_manifest(m, f, "doc_id", "want", "have")


@query("""WITH g AS (SELECT l_suppkey, l_linenumber, count(*) AS a FROM lineitem WHERE l_linestatus = 'F' GROUP BY ALL), p AS (SELECT l_suppkey, l_linenumber, count(*) AS b FROM lineitem WHERE l_linestatus = 'O' GROUP BY ALL)
SELECT l_suppkey, CAST(sum(least(a, b)) AS BIGINT) AS shared FROM g JOIN p USING (l_suppkey, l_linenumber) GROUP BY l_suppkey""")
def multiset_shared(spark, sf_dir):
    """The size of a multiset intersection: both counts in one aggregation, so nothing is joined."""
    c = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_linenumber").agg(F.count_if(F.col("l_linestatus") == "F").alias("a"), F.count_if(F.col("l_linestatus") == "O").alias("b"))
    return c.where("a > 0 and b > 0").groupBy("l_suppkey").agg(F.sum(F.least("a", "b")).alias("shared"))


@query("SELECT l_suppkey, l_linenumber FROM lineitem WHERE l_quantity < 20 INTERSECT ALL SELECT l_suppkey, l_linenumber FROM lineitem WHERE l_discount > 0.05")
def multiset_intersection(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    return l.where("l_quantity < 20").select("l_suppkey", "l_linenumber").intersectAll(l.where("l_discount > 0.05").select("l_suppkey", "l_linenumber"))


@query("""SELECT 'order_customer' AS reference, count(*) AS orphans FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 10 <> 0)
UNION ALL SELECT 'line_order', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P')""")
def broken_references(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").where("c_custkey % 10 != 0")
    orders = table(spark, sf_dir, "orders")
    one = checks.orphans(orders, "o_custkey", customers, "c_custkey", "order_customer")
    return one.unionByName(checks.orphans(table(spark, sf_dir, "lineitem"), "l_orderkey", orders.where("o_orderstatus != 'P'"), "o_orderkey", "line_order"))


@query("""WITH p AS (SELECT CASE WHEN p_partkey % 31 = 0 THEN 'pkg' || p_size ELSE (CASE WHEN p_partkey % 2 = 0 THEN 'Pkg' ELSE 'pkg' END) || p_size || '/m' || p_partkey % 400 END AS path FROM part), f AS (SELECT lower(path) AS folded, count(*) AS n FROM p GROUP BY 1)
SELECT folded, 'repeated' AS reason FROM f WHERE n > 1 UNION ALL SELECT DISTINCT a.folded, 'file_and_directory' FROM f a JOIN f b ON starts_with(b.folded, a.folded || '/')""")
def path_conflicts(spark, sf_dir):
    k, n = F.col("p_partkey"), F.col("p_size").cast("string")
    path = F.when(k % 31 == 0, F.concat(F.lit("pkg"), n)).otherwise(F.concat(F.when(k % 2 == 0, "Pkg").otherwise("pkg"), n, F.lit("/m"), (k % 400).cast("string")))
    return sel.path_conflicts(table(spark, sf_dir, "part").select(path.alias("path")), "path")


# ---- merges and groups --------------------------------------------------------------------------


@query("""WITH v AS (SELECT DISTINCT l_orderkey, CASE WHEN l_quantity <= 48 THEN CAST(round(l_tax * 100) AS INT) END AS v FROM lineitem), g AS (SELECT l_orderkey, count(*) AS n, bool_or(v IS NULL) AS unk, string_agg(v, ',' ORDER BY v) AS vs FROM v GROUP BY ALL)
SELECT l_orderkey, CASE WHEN unk OR n > 4 THEN 'unknown' WHEN n = 1 THEN 'known' ELSE 'ambiguous' END AS state, CASE WHEN NOT unk AND n <= 4 THEN vs END AS alternatives FROM g""")
def lattice_merge(spark, sf_dir):
    v = F.when(F.col("l_quantity") <= 48, F.round(F.col("l_tax") * 100).cast("int"))
    return sel.merged_values(table(spark, sf_dir, "lineitem").select("l_orderkey", v.alias("v")), ["l_orderkey"], "v")


@query("""SELECT user_id, event_id FROM (SELECT user_id, event_id, ts, row_number() OVER w AS r, sum(value) OVER w AS s, max(ts) OVER (PARTITION BY user_id) AS newest FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts DESC, event_id DESC ROWS UNBOUNDED PRECEDING))
WHERE r <= 8 AND s <= 400 AND ts > newest - INTERVAL 10 DAYS""")
def retention(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "value")
    return sel.retained(e, "user_id", ["ts", "event_id"], "value", 8, 400, "10 DAYS").select("user_id", "event_id")


@query("""SELECT event_id, CASE WHEN event_id = f THEN 'accepted' WHEN event_type = t THEN 'same_job' ELSE 'conflict' END AS answer FROM (SELECT event_id, event_type, min(event_id) OVER w AS f, arg_min(event_type, event_id) OVER w AS t FROM events WINDOW w AS (PARTITION BY user_id, CAST(floor(value) AS BIGINT)))""")
def idempotent_submission(spark, sf_dir):
    """The first request of an id is accepted; later ones give the same job if they ask the same, else conflict."""
    e = table(spark, sf_dir, "events").select("event_id", "event_type", "user_id", F.floor("value").cast("long").alias("request"))
    return checks.answered(e, ["user_id", "request"], "event_id", "event_type").select("event_id", "answer")


@query("""SELECT l_suppkey, count(*) AS findings, count(*) > 20 AS truncated, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS algorithms FROM lineitem GROUP BY l_suppkey""")
def repo_rows(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("findings"), (F.count("*") > 20).alias("truncated"), F.array_join(F.array_sort(F.collect_set("l_returnflag")), ",").alias("algorithms"))


@query("""SELECT o_orderkey, sha256(string_agg(l_partkey || ':' || l_suppkey, ';' ORDER BY l_partkey, l_suppkey, l_linenumber)) AS digest FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey""")
def candidate_digest(spark, sf_dir):
    """A digest of each group's rows in order, so that it doesn't depend on how they arrive."""
    rows = F.array_sort(F.collect_list(F.struct("l_partkey", "l_suppkey", "l_linenumber")))
    text = F.array_join(F.transform(rows, lambda r: F.concat_ws(":", r["l_partkey"].cast("string"), r["l_suppkey"].cast("string"))), ";")
    l = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sha2(text, 256).alias("digest"))  # noqa: E741
    return l.join(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", "left_semi")


@query("""SELECT l_returnflag AS template, count(*) AS operations, (SELECT count(DISTINCT k) FROM (SELECT l_suppkey AS k FROM lineitem b WHERE b.l_returnflag = a.l_returnflag UNION SELECT l_partkey % 500 FROM lineitem b WHERE b.l_returnflag = a.l_returnflag)) AS files FROM lineitem a GROUP BY l_returnflag""")
def chain_file_counts(spark, sf_dir):
    """Operations of each template and the files on their sinks and chains: pairs are made distinct before they are counted."""
    l = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("template"), F.array("l_suppkey", F.col("l_partkey") % 500).alias("chain"))  # noqa: E741
    files = l.select("template", F.explode(F.array_distinct("chain")).alias("k")).distinct().groupBy("template").agg(F.count("*").alias("files"))
    return l.groupBy("template").agg(F.count("*").alias("operations")).join(files, "template").select("template", "operations", "files")


@query("""SELECT count(*) AS baseline, CAST(count_if(l_returnflag = 'N') AS BIGINT) AS new_confirmed, CAST(count_if(l_quantity < 10) AS BIGINT) AS pending, CAST(count_if(l_tax = 0 AND l_returnflag = 'R') AS BIGINT) AS review_required FROM lineitem""")
def change_counters(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").agg(F.count("*").alias("baseline"), F.count_if(F.col("l_returnflag") == "N").alias("new_confirmed"), F.count_if(F.col("l_quantity") < 10).alias("pending"), F.count_if((F.col("l_tax") == 0) & (F.col("l_returnflag") == "R")).alias("review_required"))


@query("""SELECT event_type AS reason, count(*) AS n FROM events WHERE value > 5 GROUP BY 1 ORDER BY n DESC, min(event_id) LIMIT 3""")
def top_reasons(spark, sf_dir):
    e = table(spark, sf_dir, "events").where("value > 5").groupBy(F.col("event_type").alias("reason")).agg(F.count("*").alias("n"), F.min("event_id").alias("_first"))
    return e.orderBy(F.desc("n"), "_first").limit(3).drop("_first")


# ---- sequences ----------------------------------------------------------------------------------


@query("""WITH r AS (SELECT DISTINCT l_suppkey AS source, unnest(range(greatest(1, s - 3), least(210, s + l_linenumber + 4, greatest(1, s - 3) + 25) + 1)) AS line FROM (SELECT *, l_partkey % 200 + 1 AS s FROM lineitem)),
i AS (SELECT *, line - row_number() OVER (PARTITION BY source ORDER BY line) AS g FROM r) SELECT source, min(line) AS first, max(line) AS last, count(*) AS n FROM i GROUP BY source, g""")
def evidence_ranges(spark, sf_dir):
    """Lines around citations, joined into runs; a citation covers at most 26 lines."""
    s = F.col("l_partkey") % 200 + 1
    low = F.greatest(F.lit(1), s - 3)
    high = F.least(F.lit(210), s + F.col("l_linenumber") + 4, low + 25)
    return seq.joined_ranges(table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("source"), low.alias("low"), high.alias("high")), ["source"], "low", "high")


@query("""WITH c AS (SELECT user_id, event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS b FROM events)
SELECT user_id, event_id, event_type FROM c WHERE b IS NULL OR b <> event_type QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) <= 6""")
def activity_log(spark, sf_dir):
    e = seq.without_repeats(table(spark, sf_dir, "events").select("user_id", "event_id", "event_type"), "user_id", ["event_id"], "event_type")
    return e.withColumn("r", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("event_id")))).where("r <= 6").drop("r")


@query("SELECT p_brand, count(*) AS n, round(100.0 * count(*) / max(count(*)) OVER (), 6) AS width FROM part GROUP BY p_brand")
def bar_widths(spark, sf_dir):
    n = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.count("*").alias("n"))
    return n.select("p_brand", "n", F.round(F.lit(100.0) * F.col("n") / n.agg(F.max("n").cast("double")).scalar(), 6).alias("width"))


@query("SELECT l_orderkey, l_linenumber FROM lineitem ORDER BY l_returnflag = 'R' DESC, l_tax = 0 DESC, l_orderkey, l_linenumber LIMIT 3")
def priorities(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").orderBy((F.col("l_returnflag") == "R").desc(), (F.col("l_tax") == 0).desc(), "l_orderkey", "l_linenumber").limit(3).select("l_orderkey", "l_linenumber")


@query("""WITH f AS (SELECT p_size AS project, p_partkey, 'p-' || p_partkey || CASE p_partkey % 4 WHEN 0 THEN '.tar.gz' WHEN 1 THEN '-py3-none-any.whl' WHEN 2 THEN '-cp39.whl' ELSE '.exe' END AS name FROM part WHERE p_partkey % 11 <> 0 AND p_retailprice <= 1500)
SELECT project, p_partkey, r AS rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY project ORDER BY NOT ends_with(name, '.tar.gz'), NOT contains(name, 'py3-none-any'), name) AS INT) AS r FROM f) WHERE r <= 3""")
def release_rank(spark, sf_dir):
    k = F.col("p_partkey")
    name = F.concat(F.lit("p-"), k.cast("string"), F.element_at(F.array(*map(F.lit, (".tar.gz", "-py3-none-any.whl", "-cp39.whl", ".exe"))), (k % 4 + 1).cast("int")))
    files = table(spark, sf_dir, "part").select(F.col("p_size").alias("project"), "p_partkey", name.alias("name"), "p_retailprice")
    return checks.ranked_releases(files, "project", "name", k % 11 == 0, F.col("p_retailprice"), 1500).select("project", "p_partkey", "rank")


@query("""WITH s AS (SELECT l_orderkey, l_linenumber, l_suppkey AS place, lead(l_suppkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS next FROM lineitem)
SELECT place AS source, next AS target, count(*) AS weight FROM s WHERE next <> place GROUP BY ALL""")
def chain_edges(spark, sf_dir):
    """Edges of call chains: each place with the next of its chain, then counted."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    s = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("source"), F.lead("l_suppkey").over(w).alias("target"))
    return s.where("target != source").groupBy("source", "target").agg(F.count("*").alias("weight"))


@query("""WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS t FROM documents), h AS (SELECT doc_id, t, list_position(list_transform(t, lambda x: contains(x, 'Released under')), true) AS target FROM l)
SELECT doc_id, CAST(i AS INT) AS line, i = target AS is_target, CAST(length(t[i]) AS BIGINT) AS chars FROM (SELECT *, unnest(range(greatest(1, target - 3), least(len(t), target + 3) + 1)) AS i FROM h WHERE target > 0)""")
def code_window(spark, sf_dir):
    """Three lines before and after the first hit of a text, sliced from its array of lines."""
    t = table(spark, sf_dir, "documents").where(F.contains("text", F.lit("Released under"))).select("doc_id", F.split("text", "\n").alias("t"))
    h = t.withColumn("target", F.array_position(F.transform("t", lambda x: F.contains(x, F.lit("Released under"))), True).cast("int"))
    low = F.greatest(F.lit(1), F.col("target") - 3)
    h = h.select("doc_id", "target", low.alias("low"), F.posexplode(F.slice("t", low, F.col("target") + 4 - low)).alias("i", "s"))
    return h.select("doc_id", (F.col("low") + F.col("i")).alias("line"), (F.col("low") + F.col("i") == F.col("target")).alias("is_target"), F.length("s").cast("long").alias("chars"))


# ---- graphs -------------------------------------------------------------------------------------


@query("""WITH a(algorithm, problem, targets) AS (VALUES ('RSA', 'integer-factorization', ['ML-KEM', 'ML-DSA']), ('DH', 'discrete-log', ['ML-KEM']), ('ECDSA', 'elliptic-curve-dlog', ['ML-DSA']), ('EdDSA', 'elliptic-curve-dlog', ['ML-DSA', 'SLH-DSA'])),
f AS (SELECT l_orderkey, ['RSA', 'DH', 'ECDSA', 'EdDSA'][l_linenumber % 4 + 1] AS algorithm FROM lineitem), g AS (SELECT algorithm, count(*) AS findings FROM f GROUP BY 1)
SELECT 'algorithm:' || algorithm AS source, 'math:' || problem AS target, CAST(findings AS BIGINT) AS findings FROM a JOIN g USING (algorithm) UNION ALL SELECT 'algorithm:' || algorithm, 'pqc:' || unnest(targets), CAST(findings AS BIGINT) FROM a JOIN g USING (algorithm)
UNION ALL SELECT 'math:' || problem, 'risk:shor', CAST(sum(findings) AS BIGINT) FROM a JOIN g USING (algorithm) GROUP BY problem UNION ALL SELECT 'source:' || l_orderkey, 'algorithm:' || algorithm, CAST(count(*) AS BIGINT) FROM f GROUP BY ALL""")
def knowledge_edges(spark, sf_dir):
    """What findings, algorithms, problems and directions have to do with each other, with how many findings stand behind each edge."""
    found = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("source:"), F.col("l_orderkey").cast("string")).alias("file"), pick(F.col("l_linenumber"), "RSA", "DH", "ECDSA", "EdDSA").alias("algorithm"))
    count = F.count(F.lit(1)).alias("findings")
    p = rules.profiles(spark).select("algorithm", "recommendation").join(found.groupBy("algorithm").agg(count), "algorithm")
    problem = F.when(F.col("algorithm") == "RSA", "math:integer-factorization").when(F.col("algorithm").isin("DH", "DSA"), "math:discrete-log").otherwise("math:elliptic-curve-dlog")
    name = F.concat(F.lit("algorithm:"), "algorithm")
    named = F.array_compact(F.array(*[F.when(F.col("recommendation").contains(t), F.lit(f"pqc:{t}")) for t in ("ML-KEM", "ML-DSA", "SLH-DSA")]))
    rests = p.select(name.alias("source"), problem.alias("target"), "findings")
    out = rests.union(p.select(name, F.explode(named), "findings")).union(rests.groupBy("target").agg(F.sum("findings").alias("findings")).select("target", F.lit("risk:shor"), "findings"))
    return out.union(found.groupBy("file", name.alias("a")).agg(count))


@query("""SELECT o_orderpriority AS level, CAST(count_if(o_orderstatus = 'F') AS BIGINT) AS f, CAST(count_if(o_orderstatus = 'O') AS BIGINT) AS o, CAST(count_if(o_orderstatus = 'X') AS BIGINT) AS x FROM orders GROUP BY 1""")
def zero_filled_matrix(spark, sf_dir):
    m = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("level")).pivot("o_orderstatus", ["F", "O", "X"]).agg(F.count("o_orderkey"))
    return m.na.fill(0).select("level", F.col("F").alias("f"), F.col("O").alias("o"), F.col("X").alias("x"))


@query("""WITH f AS (SELECT ['crypto/', 'src/', 'docs/'][p_partkey % 3 + 1] || 'm' || p_partkey || CASE WHEN p_partkey % 2 = 0 THEN '.py' ELSE '.go' END AS path FROM part) SELECT path FROM f ORDER BY NOT starts_with(path, 'crypto'), NOT ends_with(path, '.py'), path LIMIT 100""")
def source_priority(spark, sf_dir):
    """Paths that speak of cryptography first, then Python, then by path; a top-k, so nothing is sorted whole."""
    k = F.col("p_partkey")
    path = F.concat(F.element_at(F.array(*map(F.lit, ("crypto/", "src/", "docs/"))), (k % 3 + 1).cast("int")), F.lit("m"), k.cast("string"), F.when(k % 2 == 0, ".py").otherwise(".go"))
    return checks.prioritised(table(spark, sf_dir, "part").select(path.alias("path")), "path", names.crypto_named(F.col("path"), [])).orderBy("priority").limit(100).select("path")


@query("""SELECT c_custkey, c_acctbal AS stars FROM customer WHERE c_custkey % 4 = 0 AND c_mktsegment = 'BUILDING' ORDER BY c_acctbal DESC, c_name LIMIT 30""")
def popular_repositories(spark, sf_dir):
    """The repositories of a topic and language with the most stars, thirty at most."""
    c = table(spark, sf_dir, "customer").withColumn("topics", F.when(F.col("c_custkey") % 4 == 0, F.array(F.lit("cryptography"), F.lit("x"))).otherwise(F.array(F.lit("x"))))
    return checks.popular(c, "cryptography", "Building", 50, languages="c_mktsegment", stars="c_acctbal", name="c_name").select("c_custkey", F.col("c_acctbal").alias("stars"))


@query("""SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'blank' WHEN doc_id % 7 = 0 THEN 'name_too_long' WHEN octet_length(encode(text)) > 4000 THEN 'too_large' END AS reason FROM documents""")
def snippet_checks(spark, sf_dir):
    """Why snippets aren't taken: blank ones, long names, long texts."""
    k = F.col("doc_id")
    d = table(spark, sf_dir, "documents").select("doc_id", F.when(k % 5 == 0, "  ").otherwise(F.col("text")).alias("content"), F.repeat(F.lit("n"), F.when(k % 7 == 0, 241).otherwise(240)).alias("name"))
    return d.select("doc_id", checks.snippet_faults(F.col("name"), F.col("content"), most_bytes=4000).alias("reason"))


@query("""SELECT c_custkey, i AS line, CASE i WHEN 1 THEN 'db_password = "[REDACTED]" # x' WHEN 2 THEN '-----BEGIN RSA PRIVATE KEY----- [REDACTED]' WHEN 3 THEN '[REDACTED PEM BODY]' WHEN 4 THEN '-----END RSA PRIVATE KEY-----' WHEN 5 THEN 'secret: "[REDACTED]"'
WHEN 6 THEN '[REDACTED SECRET]' WHEN 7 THEN 'name: c' || c_custkey WHEN 8 THEN 'api_key = load("[REDACTED]", algorithm="RS256")' WHEN 9 THEN 'see https://[REDACTED]@host/c and [REDACTED TOKEN]' WHEN 10 THEN 'key = "[REDACTED]"' WHEN 11 THEN '[REDACTED SECRET]' ELSE 'end' END AS text FROM customer, range(1, 13) t(i)""")
def redacted_lines(spark, sf_dir):
    """Lines without secrets: key blocks, YAML blocks, quotes over lines, assignments, calls, tokens, credentials."""
    lines = ['db_password = "x{k}" # x', "-----BEGIN RSA PRIVATE KEY-----", "AA{k}", "-----END RSA PRIVATE KEY-----", "secret: |", "    s{k}", "name: c{k}", 'api_key = load("{k}", algorithm="RS256")', "see https://me:{k}@host/c and ghp_0123456789abc", 'key = """a{k}', 'b"""', "end"]
    text = F.replace(F.lit("\n".join(lines)), F.lit("{k}"), F.col("c_custkey").cast("string"))
    masked = spread(table(spark, sf_dir, "customer").select("c_custkey")).select("c_custkey", redaction.redacted(text).alias("lines"))
    return masked.select("c_custkey", F.posexplode("lines").alias("line", "text")).withColumn("line", (F.col("line") + 1).cast("long"))
