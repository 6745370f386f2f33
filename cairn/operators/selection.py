"""Fair shares, lanes, unique matches, retention and other choices among rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Water levels that one pass over the groups tries.
LEVELS = 32


def fair_shares(groups: DataFrame, key: str, demand: str, limit: int) -> DataFrame:
    """Deals `limit` units to groups, evenly among those still unsatisfied; units left over go to the first keys.

    The common level is searched with a few combined aggregations, each of
    which tries 32 levels, so no task sees all groups. Demands that are null or
    negative count as 0.
    """
    want = F.greatest(F.coalesce(F.col(demand), F.lit(0)), F.lit(0)).cast("long")
    g = groups.withColumn("_want", want)
    low, high = 0, g.agg(F.max("_want")).first()[0] or 0
    used = 0
    total = g.agg(F.sum("_want")).first()[0] or 0
    if total <= limit:
        low, used = high, total
    while low < high:
        step = max(1, (high - low) // LEVELS)
        tried = [*range(low + step, high, step), high]
        sums = g.agg(*[F.sum(F.least("_want", F.lit(t))).alias(f"s{i}") for i, t in enumerate(tried)]).first()
        fits = [(t, s) for t, s in zip(tried, sums, strict=True) if s <= limit]
        if fits:
            low, used = fits[-1]
        high = next((t - 1 for t, s in zip(tried, sums, strict=True) if s > limit), low)
    first = g.where(F.col("_want") > low).orderBy(key).limit(max(0, limit - used)).select(key, F.lit(1).alias("_one"))
    out = g.join(first, key, "left").withColumn("allocated", F.least("_want", F.lit(low)) + F.coalesce("_one", F.lit(0)))
    return out.select(*groups.columns, "allocated")


def lanes(rows: DataFrame, lane: str, weights: dict[str, int], order: list[str], most: int) -> DataFrame:
    """The first `most` rows in turns, each lane giving as many rows a turn as it weighs; empty lanes are passed over.

    Only the first `most` rows of a lane can be chosen, so each lane is cut by a
    distributed top-k before it is numbered.
    """
    tops = reduce(DataFrame.unionByName, [rows.where(F.col(lane) == name).orderBy(*order).limit(most) for name in weights])
    i = F.row_number().over(Window.partitionBy(lane).orderBy(*order)) - 1
    before = {name: sum(list(weights.values())[:n]) for n, name in enumerate(weights)}
    weigh = reduce(lambda c, n: c.when(F.col(lane) == n, weights[n]), weights, F)
    start = reduce(lambda c, n: c.when(F.col(lane) == n, before[n]), weights, F)
    placed = tops.withColumn("_i", i).withColumn("_turn", F.floor(F.col("_i") / weigh)).withColumn("_slot", start + F.col("_i") % weigh)
    chosen = placed.orderBy("_turn", "_slot").limit(most)
    # `most` rows at most, so one numbered partition is bounded
    return chosen.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("_turn", "_slot"))).drop("_i", "_turn", "_slot")


def unique_match(left: DataFrame, left_id: str, right: DataFrame, right_id: str, keys: list[str]) -> DataFrame:
    """Gives the first left row of each key the right row of that key, where there is exactly one; each is used once.

    Both sides are combined to one row a key before they meet. Rows with a null
    key match nothing; left rows with one id and key are one operation.
    """
    first = left.groupBy(*keys).agg(F.min(left_id).alias(left_id))
    single = right.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.min(right_id).alias("matched")).where("_n = 1").drop("_n")
    return left.join(first.join(single, keys), [left_id, *keys], "left").select(*left.columns, "matched")


def proper_prefixes(path: Column) -> Column:
    """The directories above a path."""
    parts = F.split(path, "/")
    every = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts), F.lit(1))), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    return F.slice(every, 1, F.size(parts) - 1)


def path_conflicts(paths: DataFrame, path: str) -> DataFrame:
    """(folded, reason) of paths that differ in case alone or are a file here and a directory there."""
    f = paths.select(F.lower(path).alias("folded"))
    seen = f.groupBy("folded").agg(F.count(F.lit(1)).alias("n"))
    twice = seen.where("n > 1").select("folded", F.lit("repeated").alias("reason"))
    above = seen.select(F.explode(proper_prefixes(F.col("folded"))).alias("folded")).distinct()
    return twice.unionByName(seen.join(above, "folded", "left_semi").select("folded", F.lit("file_and_directory").alias("reason")))


def merged_values(rows: DataFrame, group: list[str], value: str, most: int = 4) -> DataFrame:
    """Known, Ambiguous (up to `most` alternatives, in order) or Unknown for the values that branches give a name.

    A null value makes its group Unknown. No more than most + 1 distinct values
    of a group are gathered.
    """
    seen = rows.select(*group, value).distinct()
    r = F.row_number().over(Window.partitionBy(*group).orderBy(F.asc_nulls_first(value)))
    few = seen.withColumn("_r", r).where(F.col("_r") <= most + 1)
    g = few.groupBy(*group).agg(F.max(F.col(value).isNull()).alias("_null"), F.count(F.lit(1)).alias("_n"), F.array_sort(F.collect_list(value)).alias("_v"))
    state = F.when(F.col("_null") | (F.col("_n") > most), "unknown").when(F.col("_n") == 1, "known").otherwise("ambiguous")
    return g.select(*group, state.alias("state"), F.when(state != "unknown", F.array_join(F.transform("_v", lambda x: x.cast("string")), ",")).alias("alternatives"))


def merged_facts(facts: DataFrame, group: list[str], order: str, most: int = 4, most_conditions: int = 16) -> DataFrame:
    """group, state, alternatives, reason, key_type and key_origin: one value for all that branches say of a name.

    facts has state (known, ambiguous or unknown), alternatives (value and
    conditions), reason, key_type, key_origin and an order. Equal values are
    one alternative, with the conditions of all, as they first occur. If any
    fact is unknown the result is, with its alternatives and the reason that
    all share, else unknown_branch; more than `most` values are unknown with
    value_limit and none. Type and origin of a key stay where all facts agree.

    Values and conditions are merged before rows move, and no more than
    most + 1 values and most_conditions conditions of a group are gathered, so
    the result doesn't depend on how rows are dealt.
    """
    by = Window.partitionBy(*group)
    same = F.struct("key_type", "key_origin")
    base = facts.groupBy(*group).agg(
        F.max(F.col("state") == "unknown").alias("_unknown"), F.min(F.when(F.col("state") == "unknown", F.col("reason"))).alias("_least"), F.max(F.when(F.col("state") == "unknown", F.col("reason"))).alias("_most"),
        F.min(same).alias("_from"), F.max(same).alias("_to"),
    )
    each = facts.select(*group, order, F.posexplode("alternatives").alias("_at", "_a")).select(*group, F.struct(F.col(order), F.col("_at")).alias("_o"), F.col("_a.value").alias("_value"), F.col("_a.conditions").alias("_conditions"))
    values = each.groupBy(*group, "_value").agg(F.min("_o").alias("_o")).withColumn("_r", F.row_number().over(by.orderBy("_o"))).where(F.col("_r") <= most + 1)
    said = each.select(*group, "_value", "_o", F.posexplode("_conditions").alias("_c_at", "_c")).groupBy(*group, "_value", "_c").agg(F.min(F.struct("_o", "_c_at")).alias("_c_o"))
    said = said.withColumn("_r", F.row_number().over(Window.partitionBy(*group, "_value").orderBy("_c_o"))).where(F.col("_r") <= most_conditions)
    said = said.groupBy(*group, "_value").agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", "_c"))), lambda x: x["_c"]).alias("_conditions"))
    keyed = values.join(said.withColumnsRenamed({c: f"_g_{c}" for c in [*group, "_value"]}), [F.col(c).eqNullSafe(F.col(f"_g_{c}")) for c in [*group, "_value"]], "left").drop(*[f"_g_{c}" for c in [*group, "_value"]])
    listed = keyed.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"), F.array_sort(F.collect_list(F.struct("_r", F.col("_value").alias("value"), F.coalesce("_conditions", F.array().cast("array<string>")).alias("conditions")))).alias("_v"))
    out = base.join(listed.withColumnsRenamed({c: f"_g_{c}" for c in group}), [F.col(c).eqNullSafe(F.col(f"_g_{c}")) for c in group], "left").fillna(0, ["_n"])
    over = F.col("_n") > most
    state = F.when(over | F.col("_unknown") | (F.col("_n") == 0), "unknown").when(F.col("_n") == 1, "known").otherwise("ambiguous")
    reason = F.when(over, "value_limit").when(F.col("_unknown"), F.when(F.col("_least").eqNullSafe(F.col("_most")), F.col("_least")).otherwise("unknown_branch")).when(F.col("_n") == 0, "missing_value")
    alternatives = F.when(over | F.col("_v").isNull(), F.array().cast("array<struct<value:string,conditions:array<string>>>")).otherwise(F.transform("_v", lambda x: F.struct(x["value"].cast("string").alias("value"), x["conditions"].alias("conditions"))))
    agree = F.col("_from").eqNullSafe(F.col("_to")) & ~over
    return out.select(*group, state.alias("state"), alternatives.alias("alternatives"), reason.alias("reason"), F.when(agree, F.col("_from.key_type")).alias("key_type"), F.when(agree, F.col("_from.key_origin")).alias("key_origin"))


def retained(rows: DataFrame, group: str, ended: list[str], size: str, most: int, budget: int, age: str) -> DataFrame:
    """Newest results of each group that keep within a number, a total size and an age; older ones go first.

    The first column of `ended` is a time; the others break ties. The running sum is needed for the first
    `most` rows alone, so the rank cuts each group before it.
    """
    w = Window.partitionBy(group).orderBy(*map(F.desc, ended))
    top = rows.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= most)
    run = F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return top.withColumns({"_s": run, "_new": F.first(ended[0]).over(w)}).where((F.col("_s") <= budget) & (F.col(ended[0]) > F.col("_new") - F.expr(f"INTERVAL {age}"))).drop("_r", "_s", "_new")
