"""Connected components of a link table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import drop_table, materialize


def _tops(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("u").agg(F.min("v").alias("m"))


def _large_star(e: DataFrame) -> DataFrame:
    """Links each node's larger neighbours with the least node that it knows."""
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    m = _tops(both).select("u", F.least("u", "m").alias("m"))
    return both.join(m, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(e: DataFrame) -> DataFrame:
    """Links each node and its smaller neighbours with the least of these."""
    m = _tops(e)
    return e.join(m, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").unionByName(m.select("u", F.col("m").alias("v"))).distinct()


def star_roots(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) of every node that links(u, v) names; root is the least node of its component.

    Each round is two aggregations with map-side combination and two joins
    that adaptive execution splits where one node has many links; nothing but
    a count and a checksum comes to the driver. The number of rounds grows
    with the logarithm of the component size.
    """
    e = materialize(links.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    seen = None
    for _ in range(most_rounds):
        after = materialize(_small_star(_large_star(e)), "stars")
        now = tuple(after.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        drop_table(e)
        e = after
        if now == seen or not now[0]:
            break
        seen = now
    else:
        raise RuntimeError(f"components didn't settle in {most_rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())

