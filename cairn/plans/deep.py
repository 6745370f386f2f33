"""Queries of calls and values followed through programs, made from driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairn.operators import arguments, contexts, digests, keyflow
from cairn.plans.files import pick
from cairn.plans.registry import query
from cairn.sources.readers import table

#: Signature and call of each kind of program, with what its parameters get and why not.
FORMS = [
    ("a, /, b, *, c=9", "1, b=2", [("a", 0, "1", "positional"), ("b", 1, "2", "keyword"), ("c", 2, "9", "default")], None, ("0", "", "", "", "")),
    ("a, b=5", "1, 2", [("a", 0, "1", "positional"), ("b", 1, "2", "positional")], None, ("0", "", "", "", "")),
    ("a, /", "a=1", [("a", 0, None, None)], "invalid_argument_binding", ("0", "", "a", "", "")),
    ("a, b", "1, a=2", [("a", 0, None, None), ("b", 1, None, None)], "invalid_argument_binding", ("0", "a", "", "", "b")),
    ("a", "1, 2", [("a", 0, None, None)], "invalid_argument_binding", ("1", "", "", "", "")),
    ("a, *, k", "1", [("a", 0, None, None), ("k", 1, None, None)], "missing_argument", ("0", "", "", "", "k")),
    ("a, b", "*[1, 2]", [("a", 0, "1", "positional"), ("b", 1, "2", "positional")], None, ("0", "", "", "", "")),
    ("a, b", "*z", [("a", 0, None, None), ("b", 1, None, None)], "dynamic_unpack", ("0", "", "", "", "")),
    ("a, **kw", "1, q=2", [("a", 0, None, None)], "invalid_argument_binding", ("0", "", "", "q", "")),
    ("*args, k=7", "k=1", [("k", 0, "1", "keyword")], None, ("0", "", "", "", "")),
    ("a", "1, **{'a': 2}", [("a", 0, None, None)], "invalid_argument_binding", ("0", "a", "", "", "")),
]
quoted = lambda x: "NULL" if x is None else f"'{x}'"
BOUND = ", ".join(f"({i}, '{p}', {n}, {quoted(v)}, {quoted(o)}, {quoted(why)})" for i, (_, _, rows, why, _) in enumerate(FORMS) for p, n, v, o in rows)
SETS = ", ".join(f"({i}, {quoted(why)}, {s[0]}, {', '.join(map(quoted, s[1:]))})" for i, (*_, why, s) in enumerate(FORMS))


def bound_program(spark, sf_dir):
    """A module for each part: a function and a call of it, in one of the forms."""
    k = F.col("p_partkey")
    text = F.concat(F.lit("def f("), pick(k, *[f[0] for f in FORMS]), F.lit("): pass\nf("), pick(k, *[f[1] for f in FORMS]), F.lit(")"))
    return keyflow.program(table(spark, sf_dir, "part").select(F.concat(F.lit("p"), k.cast("string"), F.lit(".py")).alias("path"), text.alias("content")))


def part():
    return F.regexp_extract("function", r"^p(\d+)\.", 1).cast("long").alias("p_partkey")


@query(f"SELECT p_partkey, parameter, place, value, origin, reason FROM part JOIN (VALUES {BOUND}) AS e(form, parameter, place, value, origin, reason) ON p_partkey % {len(FORMS)} = form")
def bound_arguments(spark, sf_dir):
    """What each parameter of a called function gets, by place, name or default."""
    p = bound_program(spark, sf_dir)
    calls = p.calls.where("target is not null").select("call", F.col("target").alias("function"))
    bound = arguments.bound_arguments(calls, p.arguments, p.parameters)
    texts = p.flow.where("kind = 'constant'").select("node", F.regexp_extract("value", "#(.*)$", 1).alias("text"))
    return bound.join(texts, F.col("value") == F.col("node"), "left").select(part(), "parameter", "place", F.col("text").alias("value"), "origin", "reason")


@query(f"SELECT p_partkey, reason, surplus, twice, positional_only, unknown, missing FROM part JOIN (VALUES {SETS}) AS e(form, reason, surplus, twice, positional_only, unknown, missing) ON p_partkey % {len(FORMS)} = form")
def binding_conflicts(spark, sf_dir):
    """Why calls can't be bound, with the names in conflict."""
    p = bound_program(spark, sf_dir)
    faults = arguments.binding_faults(p.calls.where("target is not null").select("call", F.col("target").alias("function")), p.arguments, p.parameters)
    return faults.select(part(), "reason", "surplus", *[F.array_join(c, ",").alias(c) for c in ("twice", "positional_only", "unknown", "missing")])


def key_program(spark, sf_dir):
    """A module for each part: its function hands a key on to the module of a twelfth of its number, some the public key, some to itself as well."""
    k = F.col("p_partkey")
    up = F.floor(k / 12).cast("string")
    lines = [
        F.lit("from cryptography.hazmat.primitives.asymmetric import rsa, ec"), F.when(k < 12, "pass").otherwise(F.concat(F.lit("from pkg.m"), up, F.lit(" import run as up"))), F.lit("def run(key):"),
        F.when(k % 3 == 0, "    use = key.public_key()").otherwise("    use = key"), F.when(k % 5 == 0, "    run(use)").otherwise("    pass"), F.when(k < 12, "    pass").otherwise("    up(use)"), F.lit("    return use"),
        F.when(k % 2 == 0, "made = rsa.generate_private_key(65537, 2048)").otherwise("made = ec.generate_private_key(None)"), F.lit("out = run(made)"), F.lit("out.encrypt(b'', None)"),
    ]
    return keyflow.program(table(spark, sf_dir, "part").select(F.concat(F.lit("pkg/m"), k.cast("string"), F.lit(".py")).alias("path"), F.concat_ws("\n", *lines).alias("content")))


MODULE = r"^pkg\.m(\d+)#"
AFTER = "CASE WHEN k % 3 = 0 THEN string_split(key_type, ':')[1] || ':public' ELSE key_type END"
KEYED = f"""t(k, key_type, origin) AS (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'RSA:private' ELSE 'EC:private' END, p_partkey FROM part
  UNION SELECT unnest(CASE WHEN k % 5 = 0 AND k >= 12 THEN [k, k // 12] WHEN k % 5 = 0 THEN [k] WHEN k >= 12 THEN [k // 12] ELSE [] END), {AFTER}, origin FROM t)"""


@query(f"WITH RECURSIVE {KEYED} SELECT k AS p_partkey, key_type, origin FROM t")
def key_types(spark, sf_dir):
    """The types and makers of all keys that a parameter can hold, over chains and cycles of calls between modules."""
    number = lambda c: F.regexp_extract(c, MODULE, 1).cast("long")
    types = keyflow.key_types(key_program(spark, sf_dir)).where(F.endswith("node", F.lit("#run#key")))
    return types.select(number("node").alias("p_partkey"), "key_type", number("origin").alias("origin"))


@query(f"""WITH RECURSIVE {KEYED} SELECT DISTINCT k AS p_partkey, 10 AS line, 'encrypt' AS operation_type, 'RSA' AS algorithm, origin FROM t WHERE {AFTER} = 'RSA:public'
UNION ALL SELECT p_partkey, 8, 'key_generation', CASE WHEN p_partkey % 2 = 0 THEN 'RSA' ELSE 'ECC' END, p_partkey FROM part""")
def key_operations(spark, sf_dir):
    """What calls do with keys: those that make them, and methods of what is known to be a key."""
    found = keyflow.operations(key_program(spark, sf_dir)).where("reason is null")
    return found.select(F.regexp_extract("module", r"(\d+)$", 1).cast("long").alias("p_partkey"), "line", "operation_type", "algorithm", F.regexp_extract("origin", MODULE, 1).cast("long").alias("origin")).distinct()


@query("""WITH RECURSIVE c AS (SELECT 'a' || c_custkey AS call, 'f' || c_custkey AS caller, 'f' || c_custkey // 2 AS callee FROM customer
  UNION ALL SELECT 'b' || c_custkey, 'f' || c_custkey, 'f' || (2 * c_custkey + 1) FROM customer WHERE c_custkey % 5 = 0
  UNION ALL SELECT 'c' || c_custkey, 'f' || c_custkey, 'f' || c_custkey FROM customer WHERE c_custkey % 7 = 0
  UNION ALL SELECT 'd' || c_custkey, 'm:<module>', 'f' || c_custkey FROM customer WHERE c_custkey % 3 = 0),
w(sink, place, steps, seen) AS (SELECT 'f' || c_custkey, 'f' || c_custkey, CAST([] AS VARCHAR[]), CAST([] AS VARCHAR[]) FROM customer
  UNION ALL SELECT w.sink, c.caller, list_append(w.steps, c.call), list_append(w.seen, w.place) FROM w JOIN c ON c.callee = w.place WHERE len(w.steps) < 5 AND NOT list_contains(w.seen, w.place) AND w.place <> 'm:<module>'),
e AS (SELECT sink, steps, CASE WHEN place = 'm:<module>' THEN '' WHEN list_contains(seen, place) THEN 'recursive_call' WHEN place NOT IN (SELECT callee FROM c) THEN 'uninstantiated_template' WHEN len(steps) = 5 THEN 'call_depth_limit' END AS reason FROM w),
n AS (SELECT *, row_number() OVER (PARTITION BY sink ORDER BY steps) AS n FROM e WHERE reason IS NOT NULL)
SELECT sink, CASE WHEN n > 64 OR reason = 'uninstantiated_template' THEN '' ELSE array_to_string(list_reverse(steps), ' ') END AS path, CASE WHEN n > 64 THEN 'context_limit' WHEN reason <> '' THEN reason END AS reason FROM n WHERE n <= 65""")
def caller_paths(spark, sf_dir):
    """All ways to call a function, along a call graph with cycles, at most five calls and 64 ways."""
    k = F.col("c_custkey")
    t = table(spark, sf_dir, "customer")
    f = lambda n: F.concat(F.lit("f"), n.cast("long").cast("string"))
    each = lambda kind, caller, callee: t.select(F.concat(F.lit(kind), k.cast("string")).alias("call"), caller.alias("caller"), callee.alias("callee"), k)
    calls = each("a", f(k), f(F.floor(k / 2))).unionByName(each("b", f(k), f(2 * k + 1)).where("c_custkey % 5 = 0")).unionByName(each("c", f(k), f(k)).where("c_custkey % 7 = 0")).unionByName(each("d", F.lit("m:<module>"), f(k)).where("c_custkey % 3 = 0"))
    out = contexts.caller_paths(calls, t.select(f(k).alias("sink"), f(k).alias("function")))
    return out.withColumn("path", F.array_join("path", " "))


IMPORTS = """e AS (SELECT c_custkey AS s, c_custkey // 3 AS t FROM customer WHERE c_custkey >= 3 UNION SELECT c_custkey, c_custkey + 1 FROM customer WHERE c_custkey % 10 = 0 AND c_custkey < (SELECT max(c_custkey) FROM customer)
  UNION SELECT c_custkey, c_custkey - 1 FROM customer WHERE c_custkey % 10 = 1),
f AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 10 = 0 AND c_custkey < (SELECT max(c_custkey) FROM customer) THEN c_custkey + 1 ELSE c_custkey END AS part, sha256(c_name) AS digest FROM customer),
own AS MATERIALIZED (SELECT part, string_agg(k || '=' || digest, ',' ORDER BY k || '=' || digest) AS own FROM f GROUP BY part),
kid AS MATERIALIZED (SELECT DISTINCT a.part, b.part AS under FROM e JOIN f a ON s = a.k JOIN f b ON t = b.k WHERE a.part <> b.part),
d0 AS MATERIALIZED (SELECT part, sha256(own || '|') AS digest FROM own WHERE part NOT IN (SELECT part FROM kid))"""
ROUNDS = ", ".join(
    f"d{i} AS MATERIALIZED (SELECT * FROM d{i - 1} UNION ALL SELECT own.part, sha256(any_value(own) || '|' || string_agg(DISTINCT digest, ',' ORDER BY digest)) FROM own JOIN kid ON own.part = kid.part LEFT JOIN d{i - 1} d ON under = d.part WHERE own.part NOT IN (SELECT part FROM d{i - 1}) GROUP BY own.part HAVING count(*) = count(digest))"
    for i in range(1, 14)
)


def imports(spark, sf_dir):
    """Imports between modules of customers: a third of the number, and pairs that import each other."""
    k = F.col("c_custkey")
    t = table(spark, sf_dir, "customer")
    last = t.agg(F.max("c_custkey").alias("last"))
    e = t.crossJoin(F.broadcast(last)).select(k, F.explode(F.filter(F.array(F.when(k >= 3, F.floor(k / 3)), F.when((k % 10 == 0) & (k < F.col("last")), k + 1), F.when(k % 10 == 1, k - 1)), lambda x: x.isNotNull())).alias("target"))  # a table of one row
    return t.select(k.cast("string").alias("module"), F.sha2("c_name", 256).alias("digest")), e.select(k.cast("string").alias("source"), F.col("target").cast("string").alias("target"))


@query(f"WITH {IMPORTS}, {ROUNDS} SELECT CAST(k AS VARCHAR) AS module, digest FROM (SELECT k, part FROM f) JOIN d13 USING (part)")
def dependency_digests(spark, sf_dir):
    """A digest of each module and of all that it imports, over cycles and shared imports."""
    return digests.dependency_digests(*imports(spark, sf_dir)).select("module", "digest")


@query(f"WITH {IMPORTS} SELECT CAST(f.k AS VARCHAR) AS module, sha256(coalesce(string_agg(g.k || '=' || g.digest, ',' ORDER BY g.k || '=' || g.digest), '')) AS linked FROM f LEFT JOIN e ON f.k = e.s LEFT JOIN f g ON e.t = g.k GROUP BY f.k")
def linked_digests(spark, sf_dir):
    """A digest of what each module imports itself."""
    return digests.linked_digests(*imports(spark, sf_dir))
