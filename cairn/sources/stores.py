"""Stores of sources and results: written whole or not at all, read by id."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions.names import base_name


def _files(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def write_snapshot(rows: DataFrame, path: str, complete: bool = True) -> bool:
    """Replaces the table at path by rows, which are written beside it first; an incomplete batch replaces nothing.

    A reader sees the old table or the new one, but for the moment between two
    renames; a failure before them leaves the old one.
    """
    if not complete:
        return False
    spark, tag = rows.sparkSession, uuid.uuid4().hex
    staged, old = f"{path.rstrip('/')}.new-{tag}", f"{path.rstrip('/')}.old-{tag}"
    rows.write.parquet(staged)
    fs, target = _files(spark, path)
    _, new = _files(spark, staged)
    _, before = _files(spark, old)
    if fs.exists(target):
        fs.rename(target, before)
    if not fs.rename(new, target):
        raise OSError(f"{staged} could not become {path}")
    fs.delete(before, True)
    return True


def write_sources(sources: DataFrame, path: str, buckets: int = 64) -> None:
    """A table of sources by id: a bucket of the id names the folder, so that a lookup reads few files."""
    bucket = F.pmod(F.xxhash64("source_id"), F.lit(buckets)).cast("int")
    sources.dropDuplicates(["source_id"]).withColumn("bucket", bucket).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)


def read_sources(spark: SparkSession, path: str, ids: list[str], buckets: int = 64) -> DataFrame:
    """Sources of some ids, without the buckets that hold none of them."""
    wanted = spark.createDataFrame([(i,) for i in ids], "source_id string").select("source_id", F.pmod(F.xxhash64("source_id"), F.lit(buckets)).cast("int").alias("bucket"))
    folders = [r.bucket for r in wanted.select("bucket").distinct().collect()]  # one number for each id asked for
    return spark.read.parquet(path).where(F.col("bucket").isin(folders)).join(F.broadcast(wanted.select("source_id")), "source_id", "left_semi").drop("bucket")


def with_origin(found: DataFrame, ids: DataFrame, origin: DataFrame) -> DataFrame:
    """Sources of ids as the task has them, else as the task that it came from has them."""
    missing = ids.join(found.select("source_id"), "source_id", "left_anti")
    return found.join(ids, "source_id", "left_semi").unionByName(origin.join(missing, "source_id", "left_semi"))


def samples(files: DataFrame, path: str = "file_name", content: str = "content") -> DataFrame:
    """name, lines and chars of each sample, in the order of their names."""
    lines = F.size(F.split(F.col(content), r"\r\n|[\n\r]")) - F.when(F.col(content).rlike(r"[\n\r]\z") | (F.col(content) == ""), 1).otherwise(0)
    return files.select(base_name(F.col(path)).alias("name"), lines.alias("lines"), F.length(content).alias("chars")).orderBy("name")


def json_report(sources: DataFrame, findings: DataFrame, source_type: str, scanned_at: str) -> DataFrame:
    """kind and body: the sources without their text and the findings as JSON, and a summary that is computed from the findings, whatever the caller says of them."""
    body = lambda df, kind: df.select(F.lit(kind).alias("kind"), F.to_json(F.struct("*")).alias("body"))
    counts = findings.groupBy("algorithm").agg(F.count(F.lit(1)).alias("n")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("algorithm", "n")))).alias("algorithm_counts"))
    summary = counts.crossJoin(findings.agg(F.count(F.lit(1)).alias("finding_count"))).crossJoin(sources.agg(F.count(F.lit(1)).alias("source_count")))  # tables of one row
    summary = summary.withColumns({"source_type": F.lit(source_type), "scanned_at": F.lit(scanned_at)})
    return body(summary, "summary").unionByName(body(sources.drop("content"), "source")).unionByName(body(findings, "finding"))


def open_candidates(candidates: DataFrame, operations: DataFrame, levels: Column, key: str = "operation_id") -> DataFrame:
    """Candidates that no operation settles: those of operations whose claims all have the highest grade need no more evidence."""
    settled = operations.where(F.forall(F.map_values(levels), lambda x: x == "E3")).select(key)
    return candidates.join(settled, key, "left_anti")


def reusable(opinions: DataFrame, candidates: DataFrame, key: str = "candidate_id", digest: str = "digest", valid: str = "citation_status") -> DataFrame:
    """Earlier opinions that still hold: their candidate is there with the same digest, and their citations were valid."""
    return opinions.where(F.col(valid) == "valid").join(candidates.select(key, digest), [key, digest], "left_semi")
