"""Queries that parse files: configuration nodes, Node programs and archives, made from driver tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cairn.operators import scanners
from cairn.plans.registry import query
from cairn.sources import archives
from cairn.sources.readers import table


def pick(number: Column, *values: str) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (number % len(values) + 1).cast("int"))


@query("""SELECT 'c' || p_partkey || '.json' AS file_name, 3 AS line, unnest(CASE p_partkey % 4 WHEN 0 THEN ['RSA'] WHEN 1 THEN ['ECDSA', 'Ed448'] WHEN 2 THEN ['Ed25519'] ELSE [] END) AS algorithm, CAST(NULL AS VARCHAR) AS diagnostic FROM part WHERE p_size % 5 <> 0
UNION ALL SELECT 'c' || p_partkey || '.json', NULL, NULL, 'ValueError' FROM part WHERE p_size % 5 = 0""")
def config_node_scan(spark, sf_dir):
    k = F.col("p_partkey")
    value = pick(k, '"RS256"', '["ES384", "Ed448"]', '"ssh-ed25519 AAAA"', '{"note": "RS256", "alg": "use RS256"}')
    tail = F.when(F.col("p_size") % 5 == 0, "NaN").otherwise("1")  # NaN is no JSON
    content = F.concat(F.lit('{"title": "RS256",\n "tls": {"x": "RS256"},\n "jwtAlgorithm": '), value, F.lit(',\n "n": '), tail, F.lit("}"))
    return scanners.scan_config_nodes(table(spark, sf_dir, "part").select(F.concat(F.lit("c"), k.cast("string"), F.lit(".json")).alias("file_name"), content.alias("content")))


@query("""SELECT o_orderkey, 3 AS line, CASE o_orderkey % 3 WHEN 1 THEN 'generateKeyPairSync' ELSE 'generateKeyPair' END AS method, CASE o_orderkey % 4 WHEN 0 THEN 'RSA' WHEN 1 THEN 'ECC' ELSE 'Ed25519' END AS algorithm
FROM orders WHERE o_orderkey % 4 <> 3 AND o_orderkey % 5 <> 0 AND o_orderkey % 7 <> 0""")
def node_scan(spark, sf_dir):
    k = F.col("o_orderkey")
    first = pick(k, "import * as c from 'node:crypto'", 'const {generateKeyPairSync: g} = require("crypto")', "import {generateKeyPair as g} from 'crypto'")
    # assigned again in a fifth of the files, in a comment in a seventh
    second = F.when(k % 5 == 0, pick(k, "c = fake", "g = fake", "function f(g) {} (g) => {}")).otherwise("// c = fake; g = fake")
    second = F.when((k % 5 == 0) & (k % 3 == 2), "g = fake").otherwise(second)
    call = F.concat(pick(k, "c.generateKeyPair", "g", "g"), F.lit("("), pick(k, "'rsa'", '"ec"', "'ed25519'", "kind"), F.lit(", {})"))
    third = F.when(k % 7 == 0, F.concat(F.lit("/* "), call, F.lit(" */"))).otherwise(call)
    files = table(spark, sf_dir, "orders").select("o_orderkey", F.concat_ws("\n", first, second, third).alias("content"))
    return scanners.scan_node(files, "o_orderkey")


@query("""SELECT p_brand AS path, 'src/m' || p_partkey || '.py' AS member, CAST(CASE WHEN p_partkey % 6 <> 0 THEN length('x = ' || p_partkey) END AS BIGINT) AS chars, CAST(NULL AS VARCHAR) AS reason FROM part WHERE p_partkey % 6 <> 0
UNION ALL SELECT p_brand, 'src/m' || p_partkey || '.bin', NULL, 'unsupported_type' FROM part WHERE p_partkey % 6 = 0""")
def archive_members(spark, sf_dir):
    def zipped(batches):
        import pyarrow as pa

        for b in batches:
            for brand, keys in zip(b.column(0), b.column(1), strict=True):
                files = [(f"root/src/m{k}.{'bin' if k % 6 == 0 else 'py'}", f"x = {k}") for k in keys.as_py()]
                yield pa.RecordBatch.from_pydict({"path": pa.array([brand.as_py()], pa.string()), "content": [archives.zip_bytes(files)]})

    # a brand's parts lie in as many archives as they need, each far below the bound of members
    parts = table(spark, sf_dir, "part").select("p_brand", "p_partkey", F.floor(F.col("p_partkey") / 1000).alias("number"))
    packed = parts.groupBy("p_brand", "number").agg(F.collect_list("p_partkey").alias("keys")).select("p_brand", "keys").mapInArrow(zipped, "path string, content binary")
    return archives.members(packed).select("path", "member", F.length("text").cast("long").alias("chars"), "reason")
