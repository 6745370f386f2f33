"""Budgets, islands, interleaving, prefix joins, recursion and evaluation measures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.operators.steps import settled, spread


def _ranges(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """rows with the number of their range of (group, order), fixed by a checkpoint; a large group spans several ranges."""
    return settled(rows.repartitionByRange(group, *order).withColumn("_range", F.spark_partition_id()))


def _running(ranged: DataFrame, group: str, order: list[str], size: str) -> DataFrame:
    """Adds running, the sum of sizes up to each row of its group: the ranges before, which are few rows, and the rows before in its own."""
    n = F.coalesce(F.col(size), F.lit(0))
    per = ranged.groupBy(F.col(group).alias("_g"), F.col("_range").alias("_r")).agg(F.sum(n).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("_g").orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.sum(n).over(Window.partitionBy(group, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    joined = ranged.withColumn("_in", inside).join(per.withColumn("_before", before), F.col(group).eqNullSafe(F.col("_g")) & (F.col("_range") == F.col("_r")))
    return joined.withColumn("running", F.col("_before") + F.col("_in")).drop("_g", "_r", "_n", "_before", "_in")


def within_budget(rows: DataFrame, group: str, order: list[str], size: str, budget: int) -> DataFrame:
    """Rows of each group before the running size first passes the budget; null sizes count as 0."""
    return _running(_ranges(rows, group, order), group, order, size).where(F.col("running") <= budget).drop("_range")


def greedy_budget(rows: DataFrame, group: str, order: list[str], size: str, budget: int) -> DataFrame:
    """Rows that fit when those that don't are skipped; null sizes count as 0.

    Each round takes the rows before the budget is first passed, and leaves
    out those after them that are larger than what is left of it, until no row
    is left. A round takes a row of each group that has one, and mostly many;
    all of them are sums over ranges, so no group is read by one task.
    """
    n = F.coalesce(F.col(size), F.lit(0))
    left = _ranges(rows, group, order).withColumn("_left", F.lit(budget).cast("long")).where(n <= F.col("_left"))
    kept = rows.where("false")
    while True:
        summed = settled(_running(left, group, order, size))
        taken = summed.where(F.col("running") <= F.col("_left"))
        kept = kept.unionByName(taken.select(*rows.columns))
        used = taken.groupBy(F.col(group).alias("_g")).agg(F.sum(n).alias("_used"))
        rest = summed.where(F.col("running") > F.col("_left")).join(used, F.col(group).eqNullSafe(F.col("_g"))).withColumn("_left", F.col("_left") - F.col("_used"))
        left = settled(rest.where(n <= F.col("_left")).drop("_g", "_used", "running"))
        if not left.limit(1).count():
            return kept


def interleave(rows: DataFrame, group: str, order: list[str], most: int) -> DataFrame:
    """First rows of all groups, then second ones, and so on."""
    turn = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    return rows.withColumn("turn", turn).where(F.col("turn") <= most).orderBy("turn", group).limit(most)


def islands(rows: DataFrame, group: list[str], number: str) -> DataFrame:
    """Runs of consecutive numbers in each group, each number counted once; a null is a run of its own."""
    # one sort by group and number tells where runs begin and end; no table of different rows or of runs is held
    by, n = Window.partitionBy(*group).orderBy(number), F.col(number)
    d = rows.select(*group, number).withColumns({"_b": F.lag(number).over(by), "_r": F.row_number().over(by), "_most": F.max(number).over(Window.partitionBy(*group))})
    begins = d.where(F.when(n.isNull(), F.col("_r") == 1).otherwise(F.col("_b").isNull() | (n > F.col("_b") + 1)))
    after = F.lead(F.struct("_b")).over(by)
    last = F.when(n.isNotNull(), F.when(after.isNull(), F.col("_most")).otherwise(after["_b"]))
    runs = begins.withColumn("last", last).select(*group, n.alias("first"), "last")
    return runs.withColumn("n", F.coalesce((F.col("last") - F.col("first")).cast("long") + 1, F.lit(1).cast("long")))


def joined_ranges(rows: DataFrame, group: list[str], low: str, high: str) -> DataFrame:
    """Runs of consecutive numbers that ranges from low to high cover in each group; no range is spread over its numbers.

    Ranges that begin at the same number come down to the longest, before they
    are sent. One begins a run if it begins more than one past all that those
    before it reach. Ranges that end before they begin cover nothing.
    """
    longest = rows.where(F.col(low) <= F.col(high)).groupBy(*group, low).agg(F.max(high).alias(high))
    by = Window.partitionBy(*group).orderBy(low)
    reach = F.max(high).over(by.rowsBetween(Window.unboundedPreceding, -1))
    begins = F.when(reach.isNull() | (F.col(low) > reach + 1), 1).otherwise(0)
    runs = longest.withColumn("_b", begins).withColumn("_i", F.sum("_b").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    out = runs.groupBy(*group, "_i").agg(F.min(low).alias("first"), F.max(high).alias("last")).drop("_i")
    return out.withColumn("n", (F.col("last") - F.col("first")).cast("long") + 1)


def without_repeats(rows: DataFrame, group: str, order: list[str], value: str) -> DataFrame:
    """Rows whose value differs from the one before in their group."""
    before = F.lag(value).over(Window.partitionBy(group).orderBy(*order))
    return rows.withColumn("_b", before).where(~F.col("_b").eqNullSafe(F.col(value))).drop("_b")


def longest_prefix(names: DataFrame, name: str, prefixes: DataFrame, prefix: str, separator: str) -> DataFrame:
    """The longest of a name's dotted prefixes that is in the other table: an equi-join on all its prefixes, no range join."""
    parts = F.split(name, rf"\Q{separator}\E")
    every = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), separator))
    tried = spread(names).withColumn("_p", F.explode(every))
    hit = tried.join(prefixes.select(F.col(prefix).alias("_p")).distinct(), "_p")
    return hit.groupBy(*names.columns).agg(F.max_by("_p", F.length("_p")).alias("prefix"))


def wilson(hits: Column, total: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    """The bounds of the Wilson score interval."""
    p = hits / total
    mid = (p + z * z / (2 * total)) / (1 + z * z / total)
    half = z * F.sqrt(p * (1 - p) / total + z * z / (4 * total * total)) / (1 + z * z / total)
    return F.greatest(F.lit(0.0), mid - half), F.least(F.lit(1.0), mid + half)
