"""Queries that scan files of all kinds, made from driver tables with decoys."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairn.functions.catalogue import ASYMMETRIC, CALLS, CURVED, JWT
from cairn.functions.rules import NAMES
from cairn.operators import dispatch
from cairn.plans.files import pick
from cairn.plans.registry import query
from cairn.sources.readers import table

TARGETS = [(f"{module}.{name}", code) for module, names, code in CALLS for name in names]
TARGET_SQL = "t(i, api, algorithm) AS (VALUES " + ", ".join(f"({i}, '{t}', '{NAMES[code]}')" for i, (t, code) in enumerate(TARGETS)) + ")"


def python_files(orders):
    """A module for each order: a target of the catalogue, imported in one of four ways, called, shadowed in a fifth and dead in a seventh."""
    k = F.col("o_orderkey")
    target = F.element_at(F.array(*[F.lit(t) for t, _ in TARGETS]), (k % len(TARGETS) + 1).cast("int"))
    head, last = F.regexp_extract(target, r"^(.*)\.([^.]+)$", 1), F.regexp_extract(target, r"^(.*)\.([^.]+)$", 2)
    owner, cls = F.regexp_extract(head, r"^(.*)\.([^.]+)$", 1), F.regexp_extract(head, r"^(.*)\.([^.]+)$", 2)
    in_class = cls.rlike("^(?:[XE]d?\\d|Elliptic|SigningKey)")
    module = F.when(in_class, F.when(owner == "", head).otherwise(owner)).otherwise(head)
    member = F.when(in_class, F.concat_ws(".", cls, last)).otherwise(last)
    parent, name = F.regexp_extract(module, r"^(?:(.*)\.)?([^.]+)$", 1), F.regexp_extract(module, r"^(?:(.*)\.)?([^.]+)$", 2)
    first = F.split_part(member, F.lit("."), F.lit(1))
    way = F.when((k % 4 == 1) & (parent == ""), 0).otherwise(k % 4)
    bring = F.when(way == 0, F.concat(F.lit("import "), module)).when(way == 1, F.concat(F.lit("from "), parent, F.lit(" import "), name, F.lit(" as m"))).when(way == 2, F.concat(F.lit("from "), module, F.lit(" import "), first, F.lit(" as m"))).otherwise(F.concat(F.lit("import "), module, F.lit(" as m")))
    called = F.when(way == 0, target).when(way == 2, F.concat(F.lit("m"), F.substr(member, F.length(first) + 1, F.length(member)))).otherwise(F.concat(F.lit("m."), member))
    root = F.when(way == 0, F.split_part(module, F.lit("."), F.lit(1))).otherwise(F.lit("m"))
    second = F.when(k % 5 == 0, F.concat(root, F.lit(" = object()"))).otherwise(F.concat(F.lit("'''"), called, F.lit("()'''")))
    third = F.when(k % 7 == 0, F.lit("if not True:")).otherwise(F.lit("if True:"))
    argument = F.when(k % 3 == 0, "(2048)").otherwise("()")
    return orders.select(F.concat(F.lit("o"), k.cast("string"), F.lit(".py")).alias("file_name"), F.concat_ws("\n", bring, second, third, F.concat(F.lit("    x = "), called, argument)).alias("content"))


@query(f"""WITH {TARGET_SQL} SELECT 'o' || o_orderkey || '.py' AS file_name, 4 AS line, api AS resolved_api, algorithm, CASE WHEN api LIKE 'Crypto.%' THEN 'PyCryptodome' ELSE split_part(api, '.', 1) END AS library
FROM orders JOIN t ON o_orderkey % {len(TARGETS)} = i WHERE o_orderkey % 5 <> 0 AND o_orderkey % 7 <> 0 AND NOT (api = '{CURVED}' AND o_orderkey % 3 = 0)""")
def python_ast_scan(spark, sf_dir):
    """Calls of every target of the catalogue, through every form of import."""
    return dispatch.scan(python_files(table(spark, sf_dir, "orders"))).where("diagnostic is null").select("file_name", "line", "resolved_api", "algorithm", "library")


@query("""SELECT 'P' || c_custkey || '.cs' AS file_name, 2 AS line, CASE c_custkey % 5 WHEN 0 THEN 'RSA' WHEN 1 THEN 'ECDSA' WHEN 2 THEN 'ECDH' ELSE 'DSA' END AS algorithm,
'.NET ' || CASE c_custkey % 5 WHEN 0 THEN 'RSA' WHEN 1 THEN 'ECDsa' WHEN 2 THEN 'ECDiffieHellman' ELSE 'DSA' END || ' API' AS evidence FROM customer WHERE c_custkey % 5 <> 4""")
def dotnet_scan(spark, sf_dir):
    k = F.col("c_custkey")
    call = pick(k, "RSA.Create()", "new ECDsaCng (x)", "ECDiffieHellman.Create()", "new DSACryptoServiceProvider(1)", "Aes.Create()")
    content = F.concat(F.lit('// RSA.Create()\nvar k = '), call, F.lit(';\nvar s = "DSA.Create()" + @"ECDsa.Create()""";\n/* RSACng(\n) */'))
    return dispatch.scan(table(spark, sf_dir, "customer").select(F.concat(F.lit("P"), k.cast("string"), F.lit(".cs")).alias("file_name"), content.alias("content"))).select("file_name", "line", "algorithm", "evidence")


KINDS = [
    ("py", f"import os\nfrom {ASYMMETRIC}rsa import generate_private_key as g\njwt_alg = ['ES256', 'none']\ng(65537)", [(3, "ECDSA", "ast_config"), (4, "RSA", "ast_call")], None),
    ("pyw", f"from {ASYMMETRIC[:-1]} import ec\nx = ec.ECDSA(\nalg = 'RS256'", [(2, "ECDSA", "text_call"), (3, "RSA", "text_config")], "syntax_fallback"),
    ("yaml", "tls:\n  cipher:\n    - ssh-rsa AAAA\n    - RS256 RS384\nnote: RS256", [(3, "RSA", "text_config")], None),
    ("json", "{'alg': 'RS256'}", [], "config_parse_error"),
    ("js", "import {generateKeyPair as g} from 'node:crypto'\nconst jwtKey = 'x' // ES256\ng('ec', {})\nsignature = 'EdDSA';", [(3, "ECC", "text_call"), (4, "EdDSA", "text_config")], None),
    ("go", "var pem = `-----BEGIN EC PRIVATE KEY-----\nAA\n-----END EC PRIVATE KEY-----`\n// -----BEGIN RSA PRIVATE KEY-----", [(1, "ECC", "pem_header")], None),
    ("pem", "-----BEGIN PUBLIC KEY-----\nAA\n-----END PUBLIC KEY-----\n-----BEGIN DSA PRIVATE KEY-----", [(4, "DSA", "pem_header")], "unknown_pem_algorithm"),
    ("ini", "ssh_key = 'ssh-ed25519' # x\ntitle = RS256\nkeys: ES256;", [(1, "Ed25519", "text_config"), (3, "ECDSA", "text_config")], None),
    ("md", "RSA, ECDSA and RS256 are named here\nalg is RS256", [], None),
]


def _sql_rows() -> str:
    rows = [f"({i}, {line}, '{a}', '{m}', NULL)" for i, (_, _, found, _) in enumerate(KINDS) for line, a, m in found]
    rows += [f"({i}, {1 if note == 'unknown_pem_algorithm' else 0}, NULL, NULL, '{note}')" for i, (*_, note) in enumerate(KINDS) if note]
    return ", ".join(rows)


SUFFIX_SQL = "CASE p_partkey % {} {} END".format(len(KINDS), " ".join(f"WHEN {i} THEN '{s}'" for i, (s, *_) in enumerate(KINDS)))


@query(f"""WITH e(kind, line, algorithm, detection_method, diagnostic) AS (VALUES {_sql_rows()})
SELECT 'f' || p_partkey || '.' || {SUFFIX_SQL} AS file_name, line, algorithm, detection_method, diagnostic FROM part JOIN e ON p_partkey % {len(KINDS)} = kind""")
def scan_corpus(spark, sf_dir):
    """Findings and diagnostics of a corpus of files of nine kinds, most with decoys."""
    k = F.col("p_partkey")
    name = F.concat(F.lit("f"), k.cast("string"), F.lit("."), pick(k, *[s for s, *_ in KINDS]))
    files = table(spark, sf_dir, "part").select(name.alias("file_name"), pick(k, *[c for _, c, *_ in KINDS]).alias("content"))
    return dispatch.scan(files).select("file_name", "line", "algorithm", "detection_method", "diagnostic")


JWT_SQL = "j(jwt, family, risk_class) AS (VALUES " + ", ".join(f"('{n}', '{f}', '{r}')" for names, f, r in JWT for n in names) + ")"
NAMED = ["RS256", "ES256K", "HS384", "EdDSA", "none", "PS512", "HS512"]


@query(f"""WITH {JWT_SQL}, o AS (SELECT event_id, ['{"', '".join(NAMED)}'][event_id % {len(NAMED)} + 1] AS jwt FROM events) SELECT event_id, o.jwt, family, coalesce(risk_class, 'unknown') AS risk_class FROM o LEFT JOIN j ON o.jwt = j.jwt""")
def jwt_classes(spark, sf_dir):
    """Family and risk class of JWT names; names that the catalogue doesn't have are unknown."""
    from cairn.functions.catalogue import jwt_catalogue

    named = table(spark, sf_dir, "events").select("event_id", pick(F.col("event_id"), *NAMED).alias("jwt"))
    return named.join(F.broadcast(jwt_catalogue(spark)), "jwt", "left").select("event_id", "jwt", "family", F.coalesce("risk_class", F.lit("unknown")).alias("risk_class"))  # a fixed table of fourteen rows
