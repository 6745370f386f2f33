"""Queries of symbols, made from driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairn.functions.catalogue import api_catalogue
from cairn.operators import symbols, views
from cairn.plans.registry import query
from cairn.sources.readers import table


def modules(spark, sf_dir):
    """A package of modules for suppliers: m<k> imports the module of the next supplier by one of three forms, and calls it from a method."""
    k = F.col("s_suppkey")
    text = lambda c: c.cast("string")
    before = text(k + 1)
    form = F.when(k % 3 == 0, F.concat(F.lit("from . import m"), before, F.lit(" as x"))).when(k % 3 == 1, F.concat(F.lit("import pkg.m"), before, F.lit(" as x"))).otherwise(F.concat(F.lit("from pkg.m"), before, F.lit(" import run as x")))
    shadow = F.when(k % 5 == 0, "x = None").otherwise("y = 1")
    call = F.when(k % 3 == 2, "x()").otherwise("x.run(1)")
    lines = [form, F.lit("from cryptography.hazmat.primitives.asymmetric import rsa"), shadow, F.lit("def run(a):"), F.lit("    rsa.generate_private_key()"), F.lit("    a()"), F.concat(F.lit("    return "), call), F.lit("run(z())"), F.lit("w = [hidden() for i in y]")]
    return table(spark, sf_dir, "supplier").select(F.concat(F.lit("pkg/m"), text(k), F.lit(".py")).alias("path"), F.concat_ws("\n", *lines).alias("content"))


@query("""WITH s AS (SELECT s_suppkey AS k, 'pkg.m' || s_suppkey AS module, 'pkg.m' || (s_suppkey + 1) AS before FROM supplier)
SELECT module, 'run' AS scope, 5 AS line, 'rsa.generate_private_key' AS name, 'cryptography.hazmat.primitives.asymmetric.rsa.generate_private_key' AS target, NULL AS reason FROM s
UNION ALL SELECT module, 'run', 6, 'a', NULL, 'dynamic' FROM s
UNION ALL SELECT module, 'run', 7, CASE WHEN k % 3 = 2 THEN 'x' ELSE 'x.run' END, CASE WHEN k % 5 <> 0 THEN before || '.run' END, CASE WHEN k % 5 = 0 THEN 'ambiguous' END FROM s
UNION ALL SELECT module, '', 8, 'run', module || '.run', NULL FROM s
UNION ALL SELECT module, '', 8, 'z', NULL, 'unknown' FROM s""")
def symbol_calls(spark, sf_dir):
    """Targets of all calls, through scopes, imports and relative places; or why there is none."""
    return symbols.resolve_calls(symbols.symbol_facts(modules(spark, sf_dir)))


@query("""WITH s AS (SELECT s_suppkey AS k FROM supplier), n(kind, c) AS (VALUES ('function', 1), ('parameter', 1), ('import', 2), ('call', 5))
SELECT kind, CAST(c * (SELECT count(*) FROM s) AS BIGINT) AS facts FROM n UNION ALL SELECT 'write', CAST(3 * (SELECT count(*) FROM s) AS BIGINT)""")
def symbol_kinds(spark, sf_dir):
    """How many facts of each kind there are."""
    return symbols.symbol_facts(modules(spark, sf_dir)).groupBy("kind").agg(F.count(F.lit(1)).alias("facts"))


@query("SELECT 'pkg.m' || s_suppkey AS module, 'run' AS scope, 5 AS line, 'rsa' AS code FROM supplier")
def symbol_sinks(spark, sf_dir):
    """Calls of known targets among all calls."""
    found = symbols.sinks(symbols.resolve_calls(symbols.symbol_facts(modules(spark, sf_dir))), api_catalogue(spark))
    return found.select("module", "scope", "line", "code")


@query("""WITH e AS (SELECT s_suppkey AS a, s_suppkey + 1 AS b FROM supplier WHERE s_suppkey % 3 <> 0 AND s_suppkey < (SELECT max(s_suppkey) FROM supplier)), two AS (SELECT e.a, f.b FROM e JOIN e f ON e.b = f.a UNION SELECT * FROM e)
SELECT 'pkg.m' || a AS source, 'pkg.m' || b AS target FROM two""")
def module_dependencies(spark, sf_dir):
    """Modules within two absolute imports of a module."""
    return views.closure(symbols.module_edges(symbols.symbol_facts(modules(spark, sf_dir))), 2)
