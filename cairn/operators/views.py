"""Filters, pages, roll-ups and neighbourhoods that a reader of findings asks for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.operators.steps import settled

SEARCHED = ["file_name", "source_id", "algorithm", "evidence", "library", "resolved_api", "recommendation"]


def holds(query: str, columns: list[Column]) -> Column:
    """Whether any of some columns holds the query, in any case; an empty query holds for all rows."""
    text = query.strip().lower()
    if not text:
        return F.lit(True)
    found = F.lit(False)
    for c in columns:
        found = found | F.contains(F.lower(F.coalesce(c.cast("string"), F.lit(""))), F.lit(text))
    return found


def _column(rows: DataFrame, name: str, otherwise: str | None = None) -> Column:
    c = F.col(name) if name in rows.columns else F.lit(None).cast("string")
    return c if otherwise is None else F.coalesce(c, F.lit(otherwise))


def filter_findings(rows: DataFrame, algorithm: str = "", source_id: str = "", query: str = "", method: str = "", status: str = "", purpose: str = "") -> DataFrame:
    """Findings of an algorithm, source, method, status and purpose that hold a text in one of seven fields; each filter is off where it is empty.

    A finding without a method counts as unknown, one without a status as
    confirmed; its purpose is the effective one, else the static one, else
    unknown. Columns that rows don't have count as null.
    """
    keep = holds(query, [_column(rows, c) for c in SEARCHED])
    of = F.coalesce(_column(rows, "effective_purpose_code"), _column(rows, "purpose_code"), F.lit("unknown"))
    wanted = [(algorithm, _column(rows, "algorithm")), (source_id, _column(rows, "source_id")), (method, _column(rows, "detection_method", "unknown")), (status, _column(rows, "verification_status", "confirmed")), (purpose, of)]
    for value, column in wanted:
        if value:
            keep = keep & (column == value)
    return rows.where(keep)


def filter_records(rows: DataFrame, algorithm: str = "", status: str = "", purpose: str = "", origin: str = "", query: str = "") -> DataFrame:
    """Records of a graph: purpose may be one of several, origins may be missing, and the text is sought in the joined names."""
    keep = F.lit(True)
    if algorithm:
        keep = keep & (F.col("algorithm") == algorithm)
    if status:
        keep = keep & (_column(rows, "verification_status", "confirmed") == status)
    if purpose:
        keep = keep & (F.coalesce(F.array_contains("purpose_codes", purpose), F.lit(False)) | (_column(rows, "purpose_code", "") == purpose))
    if origin:
        otherwise = F.when(_column(rows, "verification_status", "") == "ai_assessed", F.array(F.lit("ai"))).otherwise(F.array(F.lit("cross_file")))
        keep = keep & F.array_contains(F.coalesce("origins", otherwise), origin)
    joined = F.concat_ws(" ", *[_column(rows, c, "") for c in ("file_name", "algorithm", "api")], _column(rows, "resolved_apis") if "resolved_apis" in rows.columns else F.lit(""))
    return rows.where(keep & holds(query, [joined]))


def with_targets(findings: DataFrame, migrations: DataFrame, target: str) -> DataFrame:
    """Findings that a migration to the target names, by finding id where it lists them, else by algorithm: two semi joins on disjoint rows."""
    hits = migrations.where(F.array_contains("targets", target))
    listed = hits.where(F.size("finding_ids") > 0).select(F.explode("finding_ids").alias("finding_id")).distinct()
    named = hits.where(F.coalesce(F.size("finding_ids"), F.lit(-1)) <= 0).select("algorithm").distinct()
    by_id = findings.join(listed, "finding_id", "left_semi")
    return by_id.unionByName(findings.join(listed, "finding_id", "left_anti").join(named, "algorithm", "left_semi"))


def page(rows: DataFrame, order: list[str], number: int, size: int = 50) -> tuple[DataFrame, int, int]:
    """(rows, pages, current): a page of rows in an order, with its number kept between 1 and the last one."""
    pages = max(1, -(-rows.count() // size))
    current = max(1, min(number, pages))
    return rows.orderBy(*order).offset((current - 1) * size).limit(size), pages, current


def coverage(candidates: DataFrame, scanned: DataFrame, skipped: DataFrame, key: str = "source_id") -> DataFrame:
    """One row: how many candidates were scanned and skipped, whether any was, and why (skipped: reason, files)."""
    reasons = skipped.groupBy("reason").agg(F.sum("files").alias("n")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("reason", "n")))).alias("skip_reasons"))
    n = candidates.select(key).distinct().agg(F.count(F.lit(1)).alias("candidate_files"))
    done = scanned.select(key).distinct().agg(F.count(F.lit(1)).alias("scanned_files"))
    one = n.crossJoin(done).crossJoin(reasons)  # three tables of one row
    return one.withColumn("skipped_files", F.greatest(F.lit(0), F.col("candidate_files") - F.col("scanned_files"))).withColumn("partial", F.col("skipped_files") > 0)


def compared(repos: DataFrame, name: str, confirmed: str, assessed: str) -> DataFrame:
    """Repositories by their findings of both kinds, with the sum and the largest of all."""
    total = repos.withColumn("finding_count", F.col(confirmed) + F.col(assessed))
    whole = total.agg(F.sum("finding_count").alias("all_findings"), F.max("finding_count").alias("most_findings"))
    return total.select(name, "finding_count").crossJoin(whole)  # a table of one row


def concise(findings: DataFrame) -> DataFrame:
    """One row: the most frequent algorithm and file, and how many findings that aren't pending have no known purpose."""
    algorithm = findings.groupBy("algorithm").agg(F.count(F.lit(1)).alias("n")).agg(F.min(F.struct((-F.col("n")).alias("less"), F.col("algorithm"))).alias("x")).select(F.col("x.algorithm").alias("top_algorithm"), (-F.col("x.less")).alias("algorithm_count"))
    files = findings.groupBy("source_id", "file_name").agg(F.count(F.lit(1)).alias("n")).agg(F.min(F.struct((-F.col("n")).alias("less"), F.col("file_name"), F.col("source_id"))).alias("x")).select(F.col("x.file_name").alias("top_file"), F.col("x.source_id").alias("top_source"), (-F.col("x.less")).alias("file_count"))
    unknown = findings.agg(F.count_if((F.col("verification_status") != "pending") & (F.col("purpose_code") == "unknown")).alias("unknown_purposes"))
    return algorithm.crossJoin(files).crossJoin(unknown)  # three tables of one row


def merged_tail(rows: DataFrame, key: str, count: str, capacity: int) -> DataFrame:
    """The largest rows up to a capacity; where there are more, the last place is the sum of all the others."""
    total = rows.groupBy(key).agg(F.sum(count).alias("n"))
    many = total.limit(capacity + 1).count() > capacity
    top = total.orderBy(F.desc("n"), key).limit(capacity - 1 if many else capacity)
    if not many:
        return top.select(F.col(key).cast("string").alias("label"), "n")
    rest = total.join(top.select(key), key, "left_anti").agg(F.sum("n").alias("n"))
    return top.select(F.col(key).cast("string").alias("label"), "n").unionByName(rest.select(F.lit("other").alias("label"), "n"))


def neighbourhood(edges: DataFrame, start: DataFrame, steps: int = 1, source: str = "source", target: str = "target", node: str = "node") -> DataFrame:
    """Nodes within so many steps of some nodes, either way along edges, with their distance; each step is kept as a checkpoint."""
    # edges are kept as they come: what a step reaches is made distinct, which is less than all edges both ways
    kept = settled(edges.select(F.col(source).alias("_a"), F.col(target).alias("_b")))
    seen = front = settled(start.select(node).distinct().withColumn("distance", F.lit(0)))
    for d in range(1, steps + 1):
        near = front.join(kept, F.col(node) == F.col("_a")).select(F.col("_b").alias(node)).unionByName(front.join(kept, F.col(node) == F.col("_b")).select(F.col("_a").alias(node))).distinct()
        front = settled(near.join(seen.select(node), node, "left_anti").withColumn("distance", F.lit(d)))
        seen = seen.unionByName(front)
    return seen


def visible(boxes: DataFrame, links: DataFrame, left: float, top: float, right: float, bottom: float) -> tuple[DataFrame, DataFrame]:
    """Boxes (id, x, y, width, height) that a viewport meets, and links (source, target) that touch one of them."""
    seen = boxes.where((F.col("x") <= right) & (F.col("x") + F.col("width") >= left) & (F.col("y") <= bottom) & (F.col("y") + F.col("height") >= top))
    ids = seen.select(F.col("id").alias("_id"))
    ends = links.select("source", "target", F.explode(F.array_distinct(F.array("source", "target"))).alias("_end"))
    return seen, ends.join(ids, F.col("_end") == F.col("_id"), "left_semi").select("source", "target").distinct()


def closure(edges: DataFrame, steps: int | None = None, source: str = "source", target: str = "target") -> DataFrame:
    """(source, target) of all targets within so many steps along edges, or of all that edges reach.

    A round joins only what the last one found, and keeps it as a checkpoint,
    so that plans stay as long as one round; it ends when nothing is new.
    """
    step = settled(edges.select(F.col(source).alias("_s"), F.col(target).alias("_t")).where(F.col("_s") != F.col("_t")).distinct())
    known = front = step.select(F.col("_s").alias(source), F.col("_t").alias(target))
    rounds = 1
    while (steps is None or rounds < steps) and front.limit(1).count():
        new = front.join(step, F.col(target) == F.col("_s")).select(source, F.col("_t").alias(target)).where(F.col(source) != F.col(target)).distinct()
        front = settled(new.join(known, [source, target], "left_anti"))
        known, rounds = known.unionByName(front), rounds + 1
    return known


def latest(rows: DataFrame, key: list[str], version: str) -> DataFrame:
    """The row of the highest version of each key; a version never goes back."""
    rest = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*rest), version).alias("_r")).select(*key, "_r.*")


def before_terminal(updates: DataFrame, key: str, order: str, state: Column) -> DataFrame:
    """Updates up to the first one that ends their task; later ones are late and left out."""
    end = updates.where(state).groupBy(key).agg(F.min(order).alias("_end"))
    return updates.join(end, key, "left").where(F.col("_end").isNull() | (F.col(order) <= F.col("_end"))).drop("_end")
