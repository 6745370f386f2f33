"""From lines of text to findings, and from findings to inventories, scores and insights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions.rules import IDENTIFIERS, identified, purpose, sensitive, targets
from cairn.functions.text import source_id

ASSIGNMENT = r"^\s*['\"]?([\w.-]+)['\"]?\s*[:=]\s*(.*)"
#: A line up to a # outside quotes.
BEFORE_HASH = r"""^((?:[^"'#]++|"(?:[^"\\]++|\\.)*+(?:"|$)|'(?:[^'\\]++|\\.)*+(?:'|$))*+)"""
#: What ends a line of a source.
LINE_BREAKS = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"


def numbered_lines(sources: DataFrame, content: str = "content", split: str = "\n") -> DataFrame:
    """One row for each line, numbered from 1; a narrow operation."""
    keep = [c for c in sources.columns if c != content]
    return sources.select(*keep, F.posexplode(F.split(content, split)).alias("line", "line_text")).withColumn("line", F.col("line") + 1)


def bare_value(value: Column) -> Column:
    """A value without white space, closing semicolons and quotes around it."""
    out = F.trim(value)
    for signs in (";", " \t", "\"'"):
        out = F.btrim(out, F.lit(signs))
    return out


def scan_config(sources: DataFrame, rules: list[tuple[str, str]] = IDENTIFIERS) -> DataFrame:
    """Findings of values that are an algorithm identifier as a whole, beside names of cryptographic material; comments don't count."""
    named = sources.withColumn("source_id", source_id(F.col("file_name"), F.col("content")))
    lines = numbered_lines(named, split=LINE_BREAKS).withColumn("code", F.regexp_extract("line_text", BEFORE_HASH, 1))
    pairs = lines.withColumns({"name": F.regexp_extract("code", ASSIGNMENT, 1), "value": bare_value(F.regexp_extract("code", ASSIGNMENT, 2))}).where(F.col("name") != "").where(sensitive(F.col("name")))
    keep = [c for c in pairs.columns if c not in ("name", "value", "line_text", "code")]
    whole = [(code, f"^(?:{p})$") for code, p in rules]
    return pairs.select(*keep, F.trim("line_text").alias("evidence"), F.explode(identified(F.col("value"), whole)).alias("algorithm"), F.lit("text_config").alias("detection_method"))


def dedupe(findings: DataFrame, keys: list[str], order: str, last: bool = False) -> DataFrame:
    """First or last row of each key, by two-stage min_by or max_by: combined before the shuffle, unlike a window."""
    rest = [c for c in findings.columns if c not in keys]
    pick = F.max_by if last else F.min_by
    return findings.groupBy(*keys).agg(pick(F.struct(*rest), F.col(order)).alias("_r")).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def score(findings: DataFrame, by: list[str], high: Column) -> DataFrame:
    """Migration score: 25 a high-risk finding, 10 a source, 10 an algorithm, at most 100."""
    g = findings.groupBy(*by).agg(F.count_if(high).alias("high_count"), F.countDistinct("source_id").alias("source_count"), F.countDistinct("algorithm").alias("algorithm_count"))
    raw = 25 * F.col("high_count") + 10 * F.col("source_count") + 10 * F.col("algorithm_count")
    s = F.least(F.lit(100), raw)
    return g.withColumns({"raw_score": raw, "score": s}).withColumn("level", F.when(s >= 40, "高").when(s > 0, "中").otherwise("低"))


def assets(findings: DataFrame) -> DataFrame:
    """One row for each source and algorithm, with its locations in order."""
    at = F.array_sort(F.collect_list(F.struct("line", "evidence")))
    out = findings.groupBy("source_id", "file_name", "algorithm").agg(F.count(F.lit(1)).alias("finding_count"), F.array_join(F.transform(at, lambda x: F.concat_ws(":", x["line"].cast("string"), x["evidence"])), ";").alias("locations"))
    return out.withColumn("purpose", purpose(F.col("algorithm"))).withColumn("targets", targets(F.col("purpose")))


def migrations(findings: DataFrame) -> DataFrame:
    out = findings.groupBy("algorithm").agg(F.count(F.lit(1)).alias("finding_count"), F.countDistinct("source_id").alias("affected_files"))
    return out.withColumn("purpose", purpose(F.col("algorithm"))).withColumn("targets", targets(F.col("purpose")))


def top_with_rest(rows: DataFrame, key: str, k: int) -> DataFrame:
    """The k most frequent keys and one row for all others; ranks a table of counts, not the rows."""
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    top = counts.orderBy(F.desc("n"), key).limit(k)
    rest = counts.join(top.select(key), key, "left_anti").agg(F.count(F.lit(1)).alias("other_keys"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    return top.select(F.col(key).cast("string").alias("label"), "n", F.lit(0).cast("long").alias("other_keys")).unionByName(rest.select(F.lit("other").alias("label"), "n", "other_keys"))


def grade(valid: Column, kind: Column, edges: Column, nodes: Column) -> Column:
    """How well a claim is founded: E3 for a checked known value, E2 for edges, E1 for places alone, else E0."""
    return F.when(valid & (kind == "known"), "E3").when(edges > 0, "E2").when(nodes > 0, "E1").otherwise("E0")


def bounded_grade(own: Column, algorithm: Column) -> Column:
    """A quantum class is E3 only where its algorithm is."""
    return F.when((own == "E3") & (algorithm != "E3"), "E2").otherwise(own)
