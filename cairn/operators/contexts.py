"""Call paths from the top of a module down to a function, along a call graph with cycles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.operators.steps import settled

#: Scope of code outside functions, most calls of a path and most paths of a sink.
TOP = "<module>"
MOST_CALLS, MOST_PATHS = 5, 64


def _first(rows: DataFrame, group: str, order: list, n: int) -> DataFrame:
    return rows.withColumn("_o", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("_o") <= n).drop("_o")


def caller_paths(calls: DataFrame, sinks: DataFrame, most_calls: int = MOST_CALLS, most_paths: int = MOST_PATHS) -> DataFrame:
    """sink, path (calls from the outermost to the one of the sink's function) and reason.

    calls has call, caller and callee (functions; those at the top of a module
    end with `:<module>`), sinks has sink and function. A path that begins at
    the top of a module has no reason. Others end with recursive_call where a
    function calls itself over some way, call_depth_limit after `most_calls`
    calls, or, without a path, uninstantiated_template where no one calls the
    function. Paths are in the order of their calls, the sink's own first; a
    sink has the first `most_paths`, and a row context_limit if there are more.

    Every path that is followed ends somehow, so the first most_paths + 1
    beginnings of each sink hold its first most_paths + 1 paths: each round
    keeps no more, and of a function's callers no more are asked. Each path
    carries the functions that it has passed, so cycles end.
    """
    asked = _first(calls.select("call", "caller", "callee").distinct(), "callee", ["call"], most_paths + 1)
    asked = settled(asked.select(F.col("callee").alias("at"), "call", "caller"))
    texts = F.array().cast("array<string>")
    live = settled(sinks.select("sink", F.col("function").alias("at"), texts.alias("steps"), texts.alias("seen")).distinct())
    done = None
    for depth in range(most_calls + 1):
        top, again = F.endswith("at", F.lit(":" + TOP)), F.array_contains("seen", F.col("at"))
        # of what a path passes, its ends come first: only the rest is asked for callers
        state = F.when(top, "").when(again, "recursive_call").otherwise(F.lit(None))
        now = live.withColumn("reason", state)
        called = now.where("reason is null").join(asked.select("at").distinct(), "at", "left_semi")
        template = now.where("reason is null").join(asked.select("at").distinct(), "at", "left_anti").withColumn("reason", F.lit("uninstantiated_template"))
        ends = now.where("reason is not null").unionByName(template)
        if depth == most_calls:
            ends = ends.unionByName(called.withColumn("reason", F.lit("call_depth_limit")))
        ends = ends.select("sink", "steps", "reason", F.lit(None).cast("string").alias("at"), texts.alias("seen"))
        if depth < most_calls:
            further = called.select("sink", "steps", "seen", "at").join(asked, "at").select("sink", F.array_append("steps", F.col("call")).alias("steps"), F.lit(None).cast("string").alias("reason"), F.col("caller").alias("at"), F.array_append("seen", F.col("at")).alias("seen"))
            ends = ends.unionByName(further)
        beam = ends if done is None else ends.unionByName(done)
        beam = settled(_first(beam, "sink", ["steps"], most_paths + 1))
        done, live = beam.where("reason is not null"), beam.where("reason is null").drop("reason")
    ranked = done.withColumn("n", F.row_number().over(Window.partitionBy("sink").orderBy("steps")))
    path = F.when(F.col("reason") == "uninstantiated_template", texts).otherwise(F.reverse("steps"))
    rows = ranked.select("sink", F.when(F.col("n") <= most_paths, path).otherwise(texts).alias("path"), F.when(F.col("n") > most_paths, "context_limit").when(F.col("reason") != "", F.col("reason")).alias("reason"))
    return rows
