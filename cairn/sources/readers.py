"""Sources of text: folders, archives' listings, driver tables and a corpus derived from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions.text import source_id

# File name endings that are read.
SUFFIXES = [".py", ".pyw", ".cs", ".csproj", ".xaml", ".xml", ".md", ".java", ".js", ".jsx", ".ts", ".tsx", ".go", ".rs", ".txt", ".pem", ".yml", ".yaml", ".json", ".cfg", ".ini", ".toml"]
MOST_BYTES = 2 * 1024 * 1024


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def folder(spark: SparkSession, path: str, most_bytes: int = MOST_BYTES) -> tuple[DataFrame, DataFrame]:
    """(sources, skipped) of all files below a folder: listed, allowed, within size and decodable as UTF-8.

    Files that their size rejects are listed without their content being read.
    """
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    large = listed.where(F.col("length") > most_bytes).select("path", "length", F.lit(None).cast("binary").alias("content"))
    files = listed.where(F.col("length") <= most_bytes).select("path", "length", "content").unionByName(large)
    suffix = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    decoded = F.regexp_replace(F.try_validate_utf8("content"), "^﻿", "")
    why = F.when(~suffix.isin(SUFFIXES), "unsupported_type").when(F.col("length") > most_bytes, "too_large").when(F.try_validate_utf8("content").isNull(), "not_utf8")
    named = files.select(F.col("path").alias("file_name"), F.when(F.col("length") <= most_bytes, decoded).alias("content"), why.alias("reason"))
    return named.where("reason is null").select(source_id(F.col("file_name"), F.col("content")).alias("source_id"), "file_name", "content"), named.where("reason is not null").groupBy("reason").agg(F.count(F.lit(1)).alias("files"))


def config_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """origin, file_name and content: a configuration file for each part, with decoys, comments and repeats."""
    p, k = F.col("p_partkey"), F.col("p_size")
    alg = F.when(k % 5 == 0, "RS256").when(k % 5 == 1, "ES384").when(k % 5 == 2, "EdDSA").when(k % 5 == 3, "HS256").otherwise("x25519")
    lines = [
        F.lit("# jwt_algorithm: RS256"),
        F.concat(F.lit("jwt_algorithm: "), alg),
        F.lit("title: ES256"),
        F.when(p % 3 == 0, "sshHostKey: 'ssh-ed25519';  # ssh-rsa").otherwise(""),
        F.when(p % 7 == 0, 'signature-algorithm = "RS256"').otherwise(F.when(p % 5 == 0, "signature-algorithm: RS256 RS512").otherwise("")),
    ]
    return table(spark, sf_dir, "part").select(F.col("p_brand").alias("origin"), F.concat(F.lit("f"), p.cast("string"), F.lit(".yaml")).alias("file_name"), F.concat_ws("\n", *lines).alias("content"))
