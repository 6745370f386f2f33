"""Arguments of calls bound to parameters by joins: two ordered lists aligned by place and by name."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The most arguments of a call and names of a signature that are bound.
MOST = 64
NAMED = ["positional_only", "positional", "keyword_only"]


def _spread(arguments: DataFrame) -> DataFrame:
    """For each call what can be said about its arguments alone: given, keywords and reason."""
    repeated = arguments.where("keyword is not null and not dynamic").groupBy("call", "keyword").agg(F.array_sort(F.collect_list("place")).alias("p")).where("size(p) > 1").groupBy("call").agg(F.min(F.element_at("p", 2)).alias("again"))
    each = arguments.groupBy("call").agg(F.min(F.when(F.col("dynamic"), F.col("place"))).alias("unpack"), F.count_if(F.col("keyword").isNull() & ~F.col("dynamic")).alias("given"), F.count(F.lit(1)).alias("n"))
    none = F.lit(None).cast("int")
    first = F.when(F.col("unpack").isNotNull() & (F.col("again").isNull() | (F.col("unpack") < F.col("again"))), "dynamic_unpack").when(F.col("again").isNotNull(), "invalid_argument_binding").when(F.col("n") > MOST, "argument_limit")
    return each.join(repeated, "call", "left").select("call", F.when(first.isNull(), F.col("given")).otherwise(none).alias("given"), first.alias("unbound"))


def aligned(calls: DataFrame, arguments: DataFrame, parameters: DataFrame) -> DataFrame:
    """call, function and all that is known of each parameter: place, parameter, kind, default, and the values given by place and by name."""
    named = parameters.where(F.col("kind").isin(NAMED))
    by_place = arguments.where("keyword is null and not dynamic").select("call", "place", F.col("value").alias("by_place"))
    by_name = arguments.where("keyword is not null and not dynamic").groupBy("call", F.col("keyword").alias("parameter")).agg(F.min_by("value", "place").alias("by_name"))
    out = calls.join(named, "function").withColumn("at", F.when(F.col("kind") != "keyword_only", F.col("place")))
    out = out.join(by_place.withColumnRenamed("place", "at"), ["call", "at"], "left")
    return out.join(by_name, ["call", "parameter"], "left").drop("at")


def binding_faults(calls: DataFrame, arguments: DataFrame, parameters: DataFrame) -> DataFrame:
    """call, function, reason, and the sets behind it: surplus (how many arguments have no place), and names given twice, positional_only ones given by name, unknown and missing ones.

    Reasons are tested in a fixed order: more than 64 names in the signature,
    arguments that can't be spread or names that are given twice, more than 64
    arguments, then places and names that don't fit, then missing ones. The
    reason is null where all arguments are bound. A call with an argument that
    can't be spread has no sets.
    """
    a = aligned(calls, arguments, parameters)
    placed, keyed = F.col("by_place").isNotNull(), F.col("by_name").isNotNull()
    names = lambda c: F.array_sort(F.collect_set(F.when(c, F.col("parameter"))))
    sets = a.groupBy("call", "function").agg(
        F.count(F.lit(1)).alias("names"), F.count_if(F.col("kind") != "keyword_only").alias("places"), names(placed & keyed).alias("twice"),
        names((F.col("kind") == "positional_only") & keyed).alias("positional_only"), names(~placed & ~keyed & F.col("default").isNull()).alias("missing"),
    )
    known = parameters.where(F.col("kind").isin(NAMED)).select("function", F.col("parameter").alias("keyword"))
    given = arguments.where("keyword is not null and not dynamic").select("call", "keyword").distinct()
    unknown = calls.join(given, "call").join(known, ["function", "keyword"], "left_anti").groupBy("call", "function").agg(F.array_sort(F.collect_set("keyword")).alias("unknown"))
    empty = F.array().cast("array<string>")
    out = calls.join(sets, ["call", "function"], "left").join(unknown, ["call", "function"], "left").join(_spread(arguments), "call", "left")
    spread = F.col("unbound").isNull()
    surplus = F.greatest(F.coalesce("given", F.lit(0)) - F.coalesce("places", F.lit(0)), F.lit(0)).cast("int")
    out = out.withColumn("surplus", F.when(spread, surplus).otherwise(0))
    out = out.withColumns({c: F.when(spread, F.coalesce(c, empty)).otherwise(empty) for c in ("twice", "positional_only", "unknown", "missing")})
    bad = (F.col("surplus") > 0) | (F.size("twice") > 0) | (F.size("positional_only") > 0) | (F.size("unknown") > 0)
    reason = F.when(F.col("names") > MOST, "argument_limit").when(~spread, F.col("unbound")).when(bad, "invalid_argument_binding").when(F.size("missing") > 0, "missing_argument")
    return out.select("call", "function", reason.alias("reason"), "surplus", "twice", "positional_only", "unknown", "missing")


def bound_arguments(calls: DataFrame, arguments: DataFrame, parameters: DataFrame) -> DataFrame:
    """call, function, place, parameter, value, origin and reason: what each named parameter of a called function gets.

    calls has call and function, arguments call, place (its order among all),
    keyword, value and dynamic, parameters function, place, parameter, kind
    and default; places number the parameters with a name of their own first,
    as they stand. Values are ids of expressions; origin is positional, keyword
    or default. A call that can't be bound gives all its parameters the same
    reason and no value, of long signatures the first 64. `*` and `**`
    parameters take nothing: a call that needs them isn't bound.
    """
    faults = binding_faults(calls, arguments, parameters).select("call", "function", "reason")
    a = aligned(calls, arguments, parameters).join(faults, ["call", "function"])
    fine = F.col("reason").isNull()
    origin = F.when(F.col("by_place").isNotNull(), "positional").when(F.col("by_name").isNotNull(), "keyword").otherwise("default")
    rows = a.where((F.coalesce("reason", F.lit("")) != "argument_limit") | (F.col("place") < MOST))
    return rows.select("call", "function", "place", "parameter", F.when(fine, F.coalesce("by_place", "by_name", "default")).alias("value"), F.when(fine, origin).alias("origin"), "reason")
