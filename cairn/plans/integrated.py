"""Queries of the integrated view, on findings of lineitem, operations of orders and opinions of events."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairn.functions.catalogue import ALIASES, PURPOSES
from cairn.operators import integration as itg
from cairn.plans.files import pick
from cairn.plans.registry import query
from cairn.sources.readers import table

CANON = "CASE {0} " + " ".join(f"WHEN '{a}' THEN '{name}'" for name, names in ALIASES.items() for a in names) + " ELSE {0} END"
KNOWN = "('rsa','dsa','dh','ecdh','ecdsa','ecc','x25519','x448','eddsa','ed25519','ed448')"
TABLES = f"""f AS (SELECT 'f' || l_orderkey || '-' || l_linenumber AS finding_id, 's' || l_orderkey % 500 AS source_id, CAST(l_orderkey AS INT) AS line,
  ['RSA', 'EC', 'ECDSA', 'RS256'][l_linenumber % 4 + 1] AS algorithm, 'api' || l_linenumber % 3 AS resolved_api FROM lineitem),
o0 AS (SELECT *, unnest(CASE WHEN o_orderkey % 3 = 0 THEN ['a', 'b'] ELSE ['a'] END) AS part FROM orders),
o AS (SELECT 'o' || o_orderkey || part AS operation_id, 's' || o_orderkey % 500 AS source_id, CAST(o_orderkey AS INT) AS line, ['ES256', 'RSA', 'ECC', 'AES', 'unknown'][o_orderkey % 5 + 1] AS algorithm, 'api' || o_custkey % 3 AS api,
  ['sign', 'key_exchange', 'unknown'][o_custkey % 3 + 1] AS operation_type, o_custkey % 4 <> 0 AS alg3, o_custkey % 5 <> 0 AS type3, o_custkey % 7 <> 0 AS class3,
  CASE WHEN o_orderkey % 11 = 0 THEN 'symmetric' ELSE 'quantum_vulnerable' END AS risk_category, o_custkey % 2 = 0 AS template, 'c' || o_custkey % 2 AS context_id, o_custkey % 9 = 0 AS policy FROM o0),
op AS (SELECT * REPLACE ({CANON.format('algorithm')} AS algorithm), alg3 AND type3 AND class3 AS proven FROM o),
live AS (SELECT * FROM op WHERE NOT (proven AND (risk_category <> 'quantum_vulnerable' OR lower(algorithm) NOT IN {KNOWN}))),
fc AS (SELECT *, {CANON.format('algorithm')} AS canon FROM f),
k AS (SELECT source_id, line, canon AS algorithm, min(finding_id) AS finding_id, count(*) AS n FROM fc GROUP BY ALL),
may AS (SELECT * FROM live WHERE proven OR template),
d AS (SELECT min(operation_id) AS operation_id, k.finding_id FROM may JOIN k USING (source_id, line, algorithm) WHERE n = 1 GROUP BY k.finding_id),
l2 AS (SELECT * FROM may WHERE template AND operation_id NOT IN (SELECT operation_id FROM d) AND NOT EXISTS (SELECT 1 FROM k WHERE k.n > 1 AND k.source_id = may.source_id AND k.line = may.line AND k.algorithm = may.algorithm)),
k2 AS (SELECT source_id, line, resolved_api AS api, min(finding_id) AS finding_id, count(*) AS n FROM fc WHERE finding_id NOT IN (SELECT finding_id FROM d) GROUP BY ALL),
d2 AS (SELECT min(operation_id) AS operation_id, k2.finding_id FROM l2 JOIN k2 USING (source_id, line, api) WHERE k2.n = 1 GROUP BY k2.finding_id),
took AS (SELECT * FROM d UNION ALL SELECT * FROM d2),
r AS (SELECT f.finding_id, f.source_id, f.line, f.algorithm, coalesce(CASE WHEN policy THEN 'configuration' WHEN type3 THEN operation_type ELSE 'unknown' END, 'unknown') AS purpose_code, 'confirmed' AS verification_status,
  CASE WHEN took.operation_id IS NULL THEN 'rule' ELSE 'rule,cross_file' END AS origin, took.operation_id, context_id FROM f LEFT JOIN took USING (finding_id) LEFT JOIN live USING (operation_id)
  UNION ALL SELECT 'operation-' || substr(sha256(operation_id), 1, 24), source_id, line, CASE WHEN algorithm = 'unknown' THEN '算法待确认' ELSE algorithm END, CASE WHEN policy THEN 'configuration' WHEN type3 THEN operation_type ELSE 'unknown' END,
  CASE WHEN proven THEN 'confirmed' ELSE 'pending' END, 'cross_file', operation_id, context_id FROM live WHERE operation_id NOT IN (SELECT operation_id FROM took))"""


def findings(spark, sf_dir):
    n, k = F.col("l_linenumber"), F.col("l_orderkey")
    t = table(spark, sf_dir, "lineitem")
    return t.select(F.concat(F.lit("f"), k.cast("string"), F.lit("-"), n.cast("string")).alias("finding_id"), F.concat(F.lit("s"), (k % 500).cast("string")).alias("source_id"), k.cast("int").alias("line"), pick(n, "RSA", "EC", "ECDSA", "RS256").alias("algorithm"), F.concat(F.lit("api"), (n % 3).cast("string")).alias("resolved_api"))


def operations(spark, sf_dir):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    level = lambda modulus: F.when(c % modulus != 0, "E3").otherwise("E2")
    t = table(spark, sf_dir, "orders").withColumn("part", F.explode(F.when(k % 3 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("a")))))
    return t.select(
        F.concat(F.lit("o"), k.cast("string"), "part").alias("operation_id"), F.concat(F.lit("s"), (k % 500).cast("string")).alias("source_id"), k.cast("int").alias("line"), pick(k, "ES256", "RSA", "ECC", "AES", "unknown").alias("algorithm"),
        F.concat(F.lit("api"), (c % 3).cast("string")).alias("api"), pick(c, "sign", "key_exchange", "unknown").alias("operation_type"),
        F.create_map(F.lit("ALGORITHM"), level(4), F.lit("OPERATION_TYPE"), level(5), F.lit("QUANTUM_CLASS"), level(7)).alias("levels"),
        F.when(k % 11 == 0, "symmetric").otherwise("quantum_vulnerable").alias("risk_category"), F.when(c % 2 == 0, itg.TEMPLATE).otherwise("call").alias("context_kind"), F.concat(F.lit("c"), (c % 2).cast("string")).alias("context_id"), F.when(c % 9 == 0, "algorithm_policy").alias("evidence_scope"),
    )


@query(f"WITH {TABLES} SELECT * FROM r")
def integrated_operations(spark, sf_dir):
    """Findings and operations in one view: matched, confirmed anew, or pending."""
    return itg.integrate_operations(findings(spark, sf_dir), operations(spark, sf_dir))


OPINIONS = f"""p AS (SELECT event_id AS opinion_id, ['new_candidate', 'supports_static', 'questions_static', 'abstain', 'new_candidate', 'supports_static', 'new_candidate'][event_id % 7 + 1] AS kind,
  ['RSA', 'ES256', 'unknown', 'AES', 'X25519'][event_id % 5 + 1] AS algorithm, ['sign', 'key_exchange', 'unknown'][event_id % 3 + 1] AS purpose,
  CASE WHEN user_id % 3 = 0 THEN ['o' || event_id % 20000 || 'a'] WHEN user_id % 3 = 1 THEN [] ELSE ['o' || event_id % 9000 || 'a', 'f' || event_id % 7000 || '-1'] END AS refs,
  's' || (event_id % 1500) % 500 AS source_id, CAST(event_id % 1500 AS INT) AS line, CASE event_id // 1500 % 4 WHEN 1 THEN 'c0' WHEN 2 THEN 'c1' WHEN 3 THEN 'c2' END AS context_id, user_id % 11 = 0 AS conflict, CAST(user_id % 13 = 0 AS INT) AS gaps, user_id % 17 <> 0 AS valid, event_id % 19 <> 0 AS anchored,
  ['known_api', 'parameter_flow', 'implementation', 'name'][event_id % 4 + 1] AS basis, CASE WHEN event_id % 23 = 0 THEN 'algorithm_binding_missing' ELSE '' END AS scope_reason FROM events),
neutral AS (SELECT operation_id FROM op WHERE proven AND risk_category <> 'quantum_vulnerable'),
heard AS (SELECT * FROM p WHERE kind <> 'abstain' AND NOT (scope_reason <> '' AND len(refs) = 0) AND NOT (kind = 'new_candidate' AND algorithm <> 'unknown' AND lower({CANON.format('algorithm')}) NOT IN {KNOWN})
  AND opinion_id NOT IN (SELECT opinion_id FROM (SELECT event_id AS opinion_id FROM events WHERE false) UNION ALL SELECT opinion_id FROM (SELECT opinion_id, unnest(refs) AS ref FROM p WHERE kind = 'supports_static') u LEFT JOIN neutral ON ref = operation_id GROUP BY opinion_id HAVING count(*) = count(operation_id))),
named AS (SELECT finding_id AS row_id, finding_id AS ref FROM r UNION ALL SELECT finding_id, operation_id FROM r WHERE operation_id IS NOT NULL),
by_ref AS (SELECT DISTINCT opinion_id, row_id FROM (SELECT opinion_id, unnest(refs) AS ref FROM heard) JOIN named USING (ref)),
free AS (SELECT * FROM heard WHERE opinion_id NOT IN (SELECT opinion_id FROM by_ref)),
queue AS (SELECT *, row_number() OVER (PARTITION BY source_id, line ORDER BY opinion_id) AS i FROM free),
pend AS (SELECT source_id, line, list({{'ctx': context_id, 'id': finding_id}}) AS there FROM r WHERE verification_status = 'pending' GROUP BY ALL),
place(source_id, line, i, there, opinion_id, row_id, made) AS (SELECT DISTINCT q.source_id, q.line, CAST(0 AS BIGINT), coalesce(there, []), CAST(NULL AS BIGINT), CAST(NULL AS VARCHAR), false FROM queue q LEFT JOIN pend USING (source_id, line)
  UNION ALL SELECT source_id, line, i, CASE WHEN len(met) = 1 THEN there ELSE list_append(there, {{'ctx': context_id, 'id': 'candidate-' || opinion_id}}) END, opinion_id, CASE WHEN len(met) = 1 THEN met[1].id ELSE 'candidate-' || opinion_id END, len(met) <> 1
  FROM (SELECT q.source_id, q.line, q.i, q.context_id, q.opinion_id, p.there, [x FOR x IN p.there IF q.context_id IS NULL OR x.ctx = q.context_id] AS met FROM place p JOIN queue q ON q.source_id = p.source_id AND q.line = p.line AND q.i = p.i + 1)),
links AS (SELECT * FROM by_ref UNION ALL SELECT opinion_id, row_id FROM place WHERE i > 0),
every AS (SELECT * FROM r UNION ALL SELECT row_id, source_id, line, CASE WHEN algorithm = 'unknown' THEN '算法待确认' ELSE {CANON.format('algorithm')} END, 'unknown', 'pending', 'ai', NULL, free.context_id FROM place JOIN free USING (opinion_id, source_id, line) WHERE made),
turn AS (SELECT links.row_id, heard.*, {CANON.format('heard.algorithm')} AS mine, row_number() OVER (PARTITION BY row_id ORDER BY opinion_id) AS n FROM links JOIN heard USING (opinion_id)),
heed(row_id, n, algorithm, status, opinion_id, reason) AS (SELECT finding_id, CAST(0 AS BIGINT), algorithm, verification_status, CAST(NULL AS BIGINT), CAST(NULL AS VARCHAR) FROM every WHERE finding_id IN (SELECT row_id FROM turn)
  UNION ALL SELECT row_id, n, CASE WHEN reason = 'evidence_based_ai_judgment' AND status <> 'confirmed' THEN mine ELSE algorithm END, CASE WHEN reason = 'evidence_based_ai_judgment' AND status <> 'confirmed' THEN 'ai_assessed' ELSE status END, opinion_id, reason
  FROM (SELECT t.row_id, t.n, h.algorithm, h.status, t.opinion_id, t.mine, CASE WHEN scope_reason <> '' THEN scope_reason WHEN kind = 'questions_static' OR conflict OR ({CANON.format('h.algorithm')} NOT IN ('unknown', '算法待确认') AND mine <> 'unknown' AND {CANON.format('h.algorithm')} <> mine) THEN 'conflicting_evidence'
    WHEN gaps > 0 THEN 'missing_implementation' WHEN mine = 'unknown' THEN 'algorithm_unknown' WHEN NOT (valid AND anchored) THEN 'evidence_not_anchored' WHEN basis = 'name' THEN 'insufficient_basis' ELSE 'evidence_based_ai_judgment' END AS reason FROM heed h JOIN turn t ON t.row_id = h.row_id AND t.n = h.n + 1)),
why AS (SELECT turn.*, heed.reason FROM heed JOIN turn USING (row_id, n)),
sums AS (SELECT row_id, count(*) AS opinion_count, bool_or(reason = 'evidence_based_ai_judgment') AS adopted, list_sort(list_distinct(list(reason))) AS reasons, arg_max(reason, opinion_id) AS last_reason, bool_or(kind = 'questions_static' OR reason = 'conflicting_evidence') AS review_required,
  arg_max(purpose, opinion_id) FILTER (WHERE reason = 'evidence_based_ai_judgment') AS said_purpose, arg_max(mine, opinion_id) FILTER (WHERE reason = 'evidence_based_ai_judgment') AS said_algorithm FROM why GROUP BY row_id),
z AS (SELECT *, coalesce(adopted, false) AND verification_status = 'pending' AS turned, CASE WHEN coalesce(adopted, false) THEN said_purpose ELSE 'unknown' END AS inferred FROM every LEFT JOIN sums ON finding_id = row_id),
v AS (SELECT finding_id, source_id, line, CASE WHEN turned THEN said_algorithm ELSE algorithm END AS algorithm, CASE WHEN turned OR purpose_code = 'unknown' THEN inferred ELSE purpose_code END AS purpose_code,
  CASE WHEN inferred <> 'unknown' AND (purpose_code = 'unknown' OR turned) THEN 'ai' WHEN purpose_code <> 'unknown' THEN 'static' ELSE 'unknown' END AS purpose_origin, CASE WHEN turned THEN 'ai_assessed' ELSE verification_status END AS verification_status,
  CASE WHEN opinion_count IS NOT NULL AND origin <> 'ai' THEN origin || ',ai' ELSE origin END AS origin, operation_id, context_id, coalesce(opinion_count, 0) AS opinion_count, coalesce(adopted, false) AS adopted, coalesce(reasons, []) AS reasons, last_reason, coalesce(review_required, false) AS review_required FROM z)"""


def opinions(spark, sf_dir):
    e, u = F.col("event_id"), F.col("user_id")
    name = lambda sign, number, tail: F.concat(F.lit(sign), number.cast("string"), F.lit(tail))
    refs = F.when(u % 3 == 0, F.array(name("o", e % 20000, "a"))).when(u % 3 == 1, F.array().cast("array<string>")).otherwise(F.array(name("o", e % 9000, "a"), name("f", e % 7000, "-1")))
    return table(spark, sf_dir, "events").select(
        e.alias("opinion_id"), pick(e, "new_candidate", "supports_static", "questions_static", "abstain", "new_candidate", "supports_static", "new_candidate").alias("kind"), pick(e, "RSA", "ES256", "unknown", "AES", "X25519").alias("algorithm"),
        pick(e, "sign", "key_exchange", "unknown").alias("purpose"), refs.alias("refs"), name("s", (e % 1500) % 500, "").alias("source_id"), (e % 1500).cast("int").alias("line"), pick(F.floor(e / 1500), None, "c0", "c1", "c2").alias("context_id"), (u % 11 == 0).alias("conflict"), (u % 13 == 0).cast("int").alias("gaps"),
        (u % 17 != 0).alias("valid"), (e % 19 != 0).alias("anchored"), pick(e, "known_api", "parameter_flow", "implementation", "name").alias("basis"), F.when(e % 23 == 0, "algorithm_binding_missing").otherwise("").alias("scope_reason"),
    )


def view(spark, sf_dir):
    ops = operations(spark, sf_dir)
    return itg.attach_opinions(itg.integrate_operations(findings(spark, sf_dir), ops), opinions(spark, sf_dir), itg.neutral_operations(ops))


@query(f"WITH RECURSIVE {TABLES}, {OPINIONS} SELECT * REPLACE (array_to_string(reasons, ',') AS reasons) FROM v")
def integrated_view(spark, sf_dir):
    """All rows of the view with their opinions, purposes and reasons."""
    return view(spark, sf_dir).withColumn("reasons", F.array_join("reasons", ","))


PURPOSE_SQL = "CASE {0} " + " ".join(f"WHEN '{c}' THEN '{n}'" for c, n in PURPOSES.items()) + " END"


@query(f"""WITH RECURSIVE {TABLES}, {OPINIONS}, w AS (SELECT *, CASE WHEN purpose_code IN ('sign', 'verify') THEN ['ML-DSA', 'SLH-DSA'] WHEN purpose_code = 'key_exchange' THEN ['ML-KEM'] ELSE [] END AS t, {PURPOSE_SQL.format('purpose_code')} AS label FROM v)
SELECT verification_status, source_id, algorithm, count(*) AS finding_count, array_to_string(list_sort(list_distinct(list(purpose_code))), ',') AS purpose_codes, CASE WHEN bool_or(purpose_origin = 'ai') THEN 'ai' ELSE 'static' END AS purpose_origin,
CASE WHEN count(DISTINCT purpose_code) FILTER (WHERE purpose_code <> 'unknown') > 1 THEN array_to_string(list_sort(list_distinct(list(label))), ' / ') ELSE coalesce(max(label) FILTER (WHERE purpose_code <> 'unknown'), '用途待确认') END AS purpose,
CASE WHEN verification_status = 'pending' THEN '' ELSE array_to_string(list_sort(list_distinct(flatten(list(t)))), ',') END AS targets FROM w GROUP BY verification_status, source_id, algorithm""")
def integrated_assets(spark, sf_dir):
    out = itg.integrated_assets(view(spark, sf_dir))
    return out.withColumns({"purpose_codes": F.array_join("purpose_codes", ","), "targets": F.array_join("targets", ",")})


@query(f"""WITH RECURSIVE {TABLES}, {OPINIONS} SELECT verification_status, algorithm, purpose_code, count(*) AS finding_count, count(DISTINCT source_id) AS affected_files,
CASE WHEN purpose_code = 'sign' THEN 'ML-DSA,SLH-DSA' WHEN purpose_code = 'key_exchange' THEN 'ML-KEM' ELSE '' END AS targets,
CASE WHEN purpose_code = 'sign' THEN 'ML-DSA / SLH-DSA' WHEN purpose_code = 'key_exchange' THEN 'ML-KEM' ELSE concat_ws(',', CASE WHEN algorithm IN ('RSA', 'ECC', 'ECDSA', 'DSA', 'EdDSA', 'Ed25519', 'Ed448') THEN '签名场景：ML-DSA / SLH-DSA' END, CASE WHEN algorithm IN ('RSA', 'ECC', 'ECDH', 'DH', 'X25519', 'X448') THEN '密钥建立场景：ML-KEM' END) END AS "references"
FROM v WHERE verification_status IN ('confirmed', 'ai_assessed') GROUP BY ALL""")
def integrated_migrations(spark, sf_dir):
    out = itg.integrated_migrations(view(spark, sf_dir))
    return out.withColumns({"targets": F.array_join("targets", ","), "references": F.array_join("references", ",")})


@query(f"""WITH RECURSIVE {TABLES}, {OPINIONS} SELECT (SELECT count(*) FROM f) AS baseline, count_if(verification_status = 'confirmed' AND starts_with(origin, 'cross_file')) AS new_confirmed, count_if(verification_status = 'confirmed' AND purpose_code <> 'unknown') AS purpose_completed,
count_if(verification_status = 'pending') AS pending, count_if(verification_status = 'ai_assessed') AS ai_assessed, count_if(review_required) AS review_required, count_if(verification_status = 'confirmed') AS confirmed,
(SELECT count_if(kind = 'abstain') FROM p) AS abstained, (SELECT count_if(kind <> 'abstain' AND scope_reason <> '' AND len(refs) = 0) FROM p) AS scope_excluded,
(SELECT count_if(kind = 'new_candidate' AND NOT (scope_reason <> '' AND len(refs) = 0) AND algorithm = 'AES') FROM p) AS non_risks FROM v""")
def integrated_changes(spark, sf_dir):
    """The ten counters of how the view differs from its findings."""
    counted = itg.change_counters(view(spark, sf_dir), 0).drop("baseline")
    return counted.crossJoin(itg.left_out(opinions(spark, sf_dir))).crossJoin(findings(spark, sf_dir).agg(F.count(F.lit(1)).alias("baseline")))  # three tables of one row


@query(f"WITH RECURSIVE {TABLES}, {OPINIONS} SELECT reason, count(*) AS n FROM why GROUP BY reason")
def adoption_reasons(spark, sf_dir):
    """How often each reason decides about an opinion on a row."""
    from cairn.operators.integration import attached

    ops = operations(spark, sf_dir)
    return attached(itg.integrate_operations(findings(spark, sf_dir), ops), opinions(spark, sf_dir), itg.neutral_operations(ops))[1].groupBy("reason").agg(F.count(F.lit(1)).alias("n"))
