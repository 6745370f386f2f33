"""Checks between tables: manifests, references, sets, repeated requests, releases and priorities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions.names import path_fault


def check_manifest(entries: DataFrame, files: DataFrame, key: str, listed: str, found: str, path: str | None = None) -> DataFrame:
    """key and status of every entry of a manifest and every file: each has to be the other's only one, with the same digest and a portable path.

    A null digest differs from any but a null one. Status is the first of
    missing_file, not_listed, listed_twice, unsafe_path, digest_differs and ok.
    """
    fault = F.max(path_fault(F.col(path)).isNotNull()) if path else F.lit(False)
    m = entries.groupBy(key).agg(F.first(listed).alias("_want"), F.count(F.lit(1)).alias("_times"), fault.alias("_fault"))
    f = files.select(key, F.col(found).alias("_have"), F.lit(True).alias("_is"))
    status = (
        F.when(F.col("_is").isNull(), "missing_file").when(F.col("_times").isNull(), "not_listed").when(F.col("_times") > 1, "listed_twice")
        .when(F.col("_fault"), "unsafe_path").when(~F.col("_want").eqNullSafe(F.col("_have")), "digest_differs").otherwise("ok")
    )
    return m.join(f, key, "full").select(key, status.alias("status"))


def orphans(rows: DataFrame, key: str, held: DataFrame, held_key: str, name: str) -> DataFrame:
    """One row: how many rows refer to something that isn't there; null references don't."""
    known = held.select(F.col(held_key).alias("_k"))
    return rows.where(F.col(key).isNotNull()).join(known, F.col(key) == F.col("_k"), "left_anti").agg(F.lit(name).alias("reference"), F.count(F.lit(1)).alias("orphans"))


def set_differences(need: DataFrame, have: DataFrame, columns: list[str]) -> DataFrame:
    """side and columns of what is needed but missing, and of what is there but not proven to be needed."""
    n, h = need.select(*columns).distinct(), have.select(*columns).distinct()
    return n.join(h, columns, "left_anti").select(F.lit("missing").alias("side"), *columns).unionByName(h.join(n, columns, "left_anti").select(F.lit("unproven").alias("side"), *columns))


def answered(requests: DataFrame, key: list[str], order: str, content: str) -> DataFrame:
    """Requests with an answer: the first of a key is accepted; later ones give the same job if they ask the same, else conflict."""
    first = requests.groupBy(*key).agg(F.min(F.struct(order, content)).alias("_f"))
    answer = F.when(F.col(order) == F.col("_f")[order], "accepted").when(F.col(content).eqNullSafe(F.col("_f")[content]), "same_job").otherwise("conflict")
    return requests.join(first, key).withColumn("answer", answer).drop("_f")


def ranked_releases(files: DataFrame, project: str, name: str, yanked: Column, size: Column, most_bytes: int, k: int = 3) -> DataFrame:
    """The k best files of each project: source archives first, then wheels for any Python 3, then by name; yanked and oversized ones are out."""
    is_source = F.col(name).rlike(r"\.(?:tar\.gz|zip|tar\.bz2)$")
    any_python = F.contains(F.col(name), F.lit("py3-none-any"))
    place = F.row_number().over(Window.partitionBy(project).orderBy(is_source.desc(), any_python.desc(), name))
    return files.where(~F.coalesce(yanked, F.lit(False)) & (size <= most_bytes)).withColumn("rank", place).where(F.col("rank") <= k)


def popular(repositories: DataFrame, topic: str, language: str, n: int, topics: str = "topics", languages: str = "language", stars: str = "stars", name: str = "full_name") -> DataFrame:
    """The n repositories of a topic and language with the most stars, between 1 and 30; a top-k."""
    return repositories.where(F.array_contains(topics, topic) & (F.lower(languages) == language.lower())).orderBy(F.desc(stars), name).limit(max(1, min(30, n)))


def prioritised(files: DataFrame, path: str, hint: Column) -> DataFrame:
    """Files with their place in the order of reading: paths that hint at cryptography, then Python, then by path."""
    order = [F.when(hint, 0).otherwise(1), F.when(F.lower(F.col(path)).endswith(".py"), 0).otherwise(1), F.col(path)]
    return files.withColumn("priority", F.struct(order[0].alias("hint"), order[1].alias("python"), order[2].alias("path")))


def shared_and_own(actions: DataFrame, item: str, action: str) -> DataFrame:
    """action, shared and items: whether all items have an action, and which have it where not all do."""
    each = actions.select(item, action).distinct()
    total = each.agg(F.countDistinct(item).alias("_total"))
    by = each.groupBy(action).agg(F.count(F.lit(1)).alias("_n"), F.array_sort(F.collect_set(item)).alias("items"))
    shared = F.col("_n") == F.col("_total")
    return by.crossJoin(total).select(action, shared.alias("shared"), F.when(~shared, F.col("items")).alias("items"))  # a table of one row


def snippet_faults(name: Column, content: Column, most_name: int = 240, most_bytes: int = 2 * 1024 * 1024) -> Column:
    """Why a snippet isn't taken; null for one that is."""
    return F.when(F.coalesce(F.trim(content), F.lit("")) == "", "blank").when(F.length(name) > most_name, "name_too_long").when(F.octet_length(content) > most_bytes, "too_large")
