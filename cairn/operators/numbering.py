"""Numbers of rows in an order, without a window over all of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.operators.steps import settled


def dense_numbers(rows: DataFrame, order: list[str | Column], name: str = "number") -> DataFrame:
    """rows with their numbers from 1 in an order; equal rows of the order get numbers as they come.

    Rows are dealt into ranges of the order, one task each, and numbered
    within their range; what the ranges before hold is added, which a table
    with one row for each range says. The ranges are kept as a checkpoint, as
    they may be cut elsewhere when they are made again.
    """
    order = [F.col(c) if isinstance(c, str) else c for c in order]
    ranged = settled(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    counts = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("_range", before.alias("_before"))  # a row for each range
    within = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return ranged.withColumn("_within", within).join(F.broadcast(offsets), "_range").withColumn(name, (F.col("_within") + F.col("_before")).cast("long")).drop("_range", "_within", "_before")


def numbered(rows: DataFrame, group: list[str], order: list[str], name: str = "ordinal") -> DataFrame:
    """Rows with their number, from 1, in an order within a group of any size: numbers of all rows less those before the group."""
    every = dense_numbers(rows, [*group, *order], "_number")
    first = every.groupBy(*group).agg(F.min("_number").alias("_first"))
    on = [F.col(c).eqNullSafe(F.col(f"_g_{c}")) for c in group]
    keyed = first.withColumnsRenamed({c: f"_g_{c}" for c in group})
    joined = every.join(keyed, on) if group else every.crossJoin(F.broadcast(first))  # one row without groups
    return joined.withColumn(name, (F.col("_number") - F.col("_first") + 1).cast("int")).drop("_number", "_first", *[f"_g_{c}" for c in group])


def aliases(rows: DataFrame, key: str, order: list[str], sign: str) -> DataFrame:
    """key and alias (sign and number) of each different key, numbered as they first occur; a bijection, however many keys there are."""
    first = rows.groupBy(key).agg(F.min(F.struct(*order)).alias("_first"))
    return dense_numbers(first, ["_first", key], "_n").select(key, F.concat(F.lit(sign), F.col("_n").cast("string")).alias("alias"))
