"""What is known of candidates, by source, line and context."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def inherited_candidates(items: DataFrame) -> DataFrame:
    """source_id, line, context, lanes (in the order of their first items), refs and facts (their numbers).

    items has item_id (their order), source_id, line, context, lane, ref and
    fact. An item with a context belongs to that candidate of its line. One
    without belongs to those that the line has before it; where a line has
    none before, to the first that comes later, which inherits it; where a
    line has no contexts at all, to a candidate without one. Which, is decided
    by a join with one row for each line and context.
    """
    place = ["source_id", "line"]
    contexts = items.where("context is not null").groupBy(*place, "context").agg(F.min("item_id").alias("since"))
    first = contexts.groupBy(*place).agg(F.min("since").alias("first"))
    bare = items.where("context is null").drop("context").join(first, place, "left")
    early = bare.where("first is null or item_id < first")
    heirs = contexts.select(*place, F.col("since").alias("first"), "context")
    inherited = early.join(heirs, [*place, "first"], "left")
    shared = bare.where("item_id > first").join(contexts, place).where("since < item_id")
    cols = ["item_id", *place, "context", "lane", "ref", "fact"]
    every = items.where("context is not null").select(cols).unionByName(inherited.select(cols)).unionByName(shared.select(cols))
    lanes = every.groupBy(*place, "context", "lane").agg(F.min("item_id").alias("at"), F.count("ref").alias("refs"), F.count("fact").alias("facts"))
    named = F.transform(F.array_sort(F.collect_list(F.when(F.col("lane").isNotNull(), F.struct("at", "lane")))), lambda x: x["lane"])
    return lanes.groupBy(*place, "context").agg(named.alias("lanes"), F.sum("refs").alias("refs"), F.sum("facts").alias("facts"))
