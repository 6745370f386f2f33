"""One scan of files of any kind: each is read by the parser of its suffix, and Spark matches its facts with rules and catalogues."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions import catalogue, rules, syntax
from cairn.functions.programs import config_scalars, node_calls
from cairn.functions.text import source_id
from cairn.operators.scanners import KEY_BEGINNINGS, NODE_TYPES
from cairn.operators.steps import spread

CONFIG, PYTHON, NODE = (".json", ".yaml", ".yml"), (".py", ".pyw", ""), (".js", ".jsx", ".ts", ".tsx")
C_LIKE = (".cs", ".java", *NODE, ".go", ".rs")
MOST_BYTES = 2 * 1024 * 1024
# Evidence of an identifier, and of one whose curve is open.
IDENTIFIER, OPEN_CURVE = "算法标识", "算法标识（曲线未确认）"
FACTS = "file_name string, source_id string, source_type string, kind string, line int, seq int, name string, value string"
LINE_BREAKS = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"


def suffix_of(name: str) -> str:
    base = re.split(r"[\\/]", name)[-1]
    return "." + base.rsplit(".", 1)[1].lower() if "." in base.lstrip(".") else ""


def file_facts(name: str, content: str, most_bytes: int = MOST_BYTES) -> Iterator[syntax.Fact]:
    """The facts of one file by its suffix. A file beyond a bound, or one that can't be read, has a note alone: no part of it passes for the whole."""
    suffix = suffix_of(name)
    try:
        if len(content.encode()) > most_bytes:
            raise syntax.Limit("too large")
        if suffix in CONFIG:
            found = [("scalar", line, key, value) for line, key, value in config_scalars(content, suffix == ".json")]
            found += [("pem", line + 1, None, v) for _, line, _, v in found if v.startswith("-----BEGIN ") and "-----END " in v]
        elif suffix in PYTHON:
            found = syntax.python_facts(content)
        else:
            found = [("text_" + k if k in ("call", "string") else k, *rest) for k, *rest in syntax.text_facts(content, suffix in C_LIKE, suffix == ".cs")]
            if suffix in NODE:
                found += [("node", *hit) for hit in node_calls(content)]
            found += syntax.text_blocks(content, suffix)
    except syntax.Limit:
        found = [("note", 0, None, "analysis_limit")]
    except (ValueError, RecursionError):
        found = [("note", 0, None, "config_parse_error" if suffix in CONFIG else "analysis_limit")]
    yield from found


def facts(files: DataFrame, most_bytes: int = MOST_BYTES) -> DataFrame:
    """The facts of all files; files has file_name and content, and may have source_id and source_type."""
    identity = F.col("source_id") if "source_id" in files.columns else source_id(F.col("file_name"), F.coalesce("content", F.lit("")))
    kind = F.col("source_type") if "source_type" in files.columns else F.lit("snippet")
    heads = [c.split()[0] for c in FACTS.split(", ")]

    def run(batches):
        for b in batches:
            out = []
            for name, text, identity, kind in zip(b["file_name"], b["content"], b["source_id"], b["source_type"], strict=True):
                out += [(name, identity, kind, k, line, seq, n, v) for seq, (k, line, n, v) in enumerate(file_facts(name or "", text or "", most_bytes))]
            yield pd.DataFrame(out, columns=heads)

    return spread(files.select("file_name", "content", identity.alias("source_id"), kind.alias("source_type"))).mapInPandas(run, FACTS)


HIT = "struct<line:int,code:string,evidence:string,method:string,api:string,diagnostic:string>"


def _hit(line: Column, code: Column, evidence: Column, method: str, api: Column | None = None) -> Column:
    return F.struct(line.alias("line"), code.alias("code"), evidence.alias("evidence"), F.lit(method).alias("method"), (F.lit(None).cast("string") if api is None else api).alias("api"), F.lit(None).cast("string").alias("diagnostic"))


def _identifiers(value: Column, begins: bool, method: str) -> Column:
    """A hit for each rule that the value matches whole, or from its beginning if that is one of a key."""
    hits = []
    for code, pattern in rules.IDENTIFIERS:
        match = value.rlike(f"^(?:{pattern})$")
        if begins:
            match = F.trim(value).rlike(f"^(?:{pattern})$") | value.rlike(KEY_BEGINNINGS) & value.rlike(f"^(?:{pattern})")
        text = F.concat(F.lit(f"{OPEN_CURVE if code == 'eddsa' else IDENTIFIER}: "), F.regexp_extract(value, pattern, 0))
        hits.append(F.when(match, _hit(F.col("line"), F.lit(code), text, method)))
    return F.array_compact(F.array(*hits))


def _key_headers() -> Column:
    """A hit for each header of a key block, and a diagnostic for each that doesn't name its algorithm."""
    lines = F.transform(F.split(F.col("value"), LINE_BREAKS), lambda x, i: F.struct((F.col("line") + i).cast("int").alias("line"), x.alias("text")))
    heads = F.filter(lines, lambda x: x["text"].startswith("-----BEGIN "))

    def hit(x: Column) -> Column:
        named = F.coalesce(*[F.when(x["text"].rlike(p), F.lit(code)) for code, p in rules.PEM_HEADERS])
        evidence = F.concat(F.lit("PEM "), F.when(named == "ecc", "EC").otherwise(F.upper(named)), F.lit(" key header"))
        generic = F.when(x["text"].rlike("^-----BEGIN (?:PRIVATE|PUBLIC) KEY-----"), "unknown_pem_algorithm")
        return F.struct(x["line"].alias("line"), named.alias("code"), evidence.alias("evidence"), F.when(named.isNotNull(), "pem_header").alias("method"), F.lit(None).cast("string").alias("api"), generic.alias("diagnostic"))

    return F.filter(F.transform(heads, hit), lambda h: h["code"].isNotNull() | h["diagnostic"].isNotNull())


def scan(files: DataFrame, most_bytes: int = MOST_BYTES) -> DataFrame:
    """Findings and diagnostics of files of any kind, one row each; diagnostic is null for a finding.

    A file is parsed once. Calls are joined with the catalogue of targets,
    named strings with the identifier rules where their name is sensitive, key
    blocks with the header rules. Of several findings of an algorithm on a
    line the first stays (of a text's the last), by an aggregate that combines
    before the shuffle. Null names and contents count as empty.
    """
    spark = files.sparkSession
    known = facts(files, most_bytes).join(F.broadcast(catalogue.api_catalogue(spark)), F.col("value") == F.col("target"), "left")  # a fixed table of some 50 rows
    none = F.array().cast(f"array<{HIT}>")
    ignored = (F.col("kind") == "curved") & (F.col("value") == catalogue.CURVED)
    named = rules.sensitive(F.coalesce("name", F.lit("")))
    node = catalogue.lookup(F.col("value"), {k: {v: c for c, v in rules.NAMES.items()}[a] for k, a in NODE_TYPES.items()}, F.lit(None).cast("string"))
    hits = (
        F.when(F.col("kind").isin("call", "curved") & F.col("code").isNotNull() & ~ignored, F.array(_hit(F.col("line"), F.col("code"), F.col("name"), "ast_call", F.col("value"))))
        .when((F.col("kind") == "text_call") & F.col("code").isNotNull(), F.array(_hit(F.col("line"), F.col("code"), F.col("name"), "text_call")))
        .when((F.col("kind") == "string") & named, _identifiers(F.col("value"), True, "ast_config"))
        .when((F.col("kind") == "scalar") & named & ~F.col("value").startswith("-----BEGIN "), _identifiers(F.col("value"), True, "text_config"))
        .when((F.col("kind") == "text_string") & named, _identifiers(F.col("value"), False, "text_config"))
        .when(F.col("kind") == "code", F.array_compact(F.array(*[F.when(F.col("value").rlike(p), _hit(F.col("line"), F.lit(code), F.lit(e), "text_call")) for code, p, e in catalogue.DOTNET])))
        .when((F.col("kind") == "node") & node.isNotNull(), F.array(_hit(F.col("line"), node, F.concat(F.lit("node:crypto."), F.col("name"), F.lit("("), F.col("value"), F.lit(")")), "text_call")))
        .when(F.col("kind") == "pem", _key_headers())
        .when(F.col("kind") == "note", F.array(F.struct(F.col("line"), *[F.lit(None).cast("string").alias(c) for c in ("code", "evidence", "method", "api")], F.col("value").alias("diagnostic"))))
        .otherwise(none)
    )
    each = known.select("source_id", "file_name", "source_type", "kind", "seq", F.posexplode(hits.cast(f"array<{HIT}>")).alias("n", "hit")).select("source_id", "file_name", "source_type", "kind", "seq", "n", "hit.*")
    text = F.col("kind").isin("text_call", "text_string", "code")
    place = F.col("seq") * 64 + F.col("n")
    order = F.struct(F.when(text, 0).when(F.col("kind") == "pem", 2).otherwise(1), F.when(text, -place).otherwise(place))
    profile = rules.profiles(spark)
    keys = ["source_id", "file_name", "source_type", "line", "code", "diagnostic"]
    first = each.groupBy(*keys).agg(F.min_by(F.struct("evidence", "method", "api"), order).alias("x")).select(*keys, "x.*")
    full = first.join(F.broadcast(profile), "code", "left")  # eleven rows
    return full.select("source_id", "file_name", "source_type", "line", "algorithm", "risk_level", "reason", "recommendation", "evidence", F.col("method").alias("detection_method"), F.when(F.col("api").isNotNull(), catalogue.library_of(F.col("api"))).alias("library"), F.col("api").alias("resolved_api"), "diagnostic")


def with_rules(findings: DataFrame) -> DataFrame:
    """Findings with the rule that made them and its version."""
    return findings.withColumns({"rule_id": F.coalesce("resolved_api", "detection_method", F.lit("legacy")), "rule_version": F.lit(catalogue.RULES_VERSION)})


def plain(findings: DataFrame) -> DataFrame:
    """Findings without what only a caller who asks for metadata gets."""
    return findings.drop("detection_method", "library", "resolved_api", "rule_id", "rule_version")
