"""Digests of modules with all that they depend on: cycles of imports are condensed, then digested from below."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.operators.steps import settled


def _spread(start: DataFrame, edges: DataFrame, value: str) -> DataFrame:
    """node and the greatest `value` of all nodes that reach it over edges (source, target); start has node and value."""
    known = settled(start)
    while True:
        offered = known.join(edges, F.col("node") == F.col("source")).groupBy(F.col("target").alias("node")).agg(F.max(value).alias("_offer"))
        after = settled(known.join(offered, "node", "left").select("node", F.greatest(value, "_offer").alias(value), F.coalesce(F.col("_offer") > F.col(value), F.lit(False)).alias("_moved")))
        known = after.drop("_moved")
        if not after.where("_moved").limit(1).count():
            return known


def cycles(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node and component: the greatest node of its strongly connected component.

    Nodes without an edge to or from what is left are components of their own.
    The others take the colour of the greatest node that reaches them; what of
    a colour reaches its first node back is that node's component. Nothing but
    whether something moved comes to the driver; a round costs as many steps
    as the longest way to a colour.
    """
    left = settled(nodes.select("node").distinct())
    edges = settled(edges.where("source != target").select("source", "target").distinct())
    out = None
    while left.limit(1).count():
        inner = left.join(edges.select(F.col("source").alias("node")).distinct(), "node", "left_semi").join(edges.select(F.col("target").alias("node")).distinct(), "node", "left_semi")
        inner = settled(inner)
        alone = left.join(inner, "node", "left_anti").withColumn("component", F.col("node"))
        if inner.limit(1).count():
            coloured = _spread(inner.withColumn("colour", F.col("node")), edges.join(inner.select(F.col("node").alias("source")), "source").join(inner.select(F.col("node").alias("target")), "target"), "colour")
            of = lambda end: coloured.select(F.col("node").alias(end), F.col("colour").alias(f"{end}_colour"))
            back = edges.join(of("source"), "source").join(of("target"), "target").where("source_colour = target_colour").select(F.col("target").alias("source"), F.col("source").alias("target"))
            reached = _spread(coloured.select("node", "colour", (F.col("node") == F.col("colour")).cast("int").alias("reached")).select("node", "reached"), settled(back), "reached")
            alone = alone.unionByName(coloured.join(reached.where("reached = 1"), "node").select("node", F.col("colour").alias("component")))
        found = settled(alone)
        out = found if out is None else out.unionByName(found)
        left = settled(left.join(found, "node", "left_anti"))
        edges = settled(edges.join(left.select(F.col("node").alias("source")), "source", "left_semi").join(left.select(F.col("node").alias("target")), "target", "left_semi"))
    return out if out is not None else nodes.select("node", F.col("node").alias("component")).limit(0)


def dependency_digests(files: DataFrame, edges: DataFrame) -> DataFrame:
    """module, component and digest of every file: it changes with the file and with all that the file depends on, and with nothing else.

    files has module and digest (of its content), edges source and target
    (a module and one that it imports; others than in files are left out).
    Modules that import each other in a cycle share a component and a digest:
    that of their sorted names and digests and of the sorted digests of what
    they import. Each round digests the components all of whose imports have
    digests, so there are as many as the longest chain of components.
    """
    files = settled(files.select("module", "digest").distinct())
    known = files.select(F.col("module").alias("node")).distinct()
    inside = edges.join(known.withColumnRenamed("node", "source"), "source", "left_semi").join(known.withColumnRenamed("node", "target"), "target", "left_semi")
    parts = settled(cycles(known, inside))
    of = lambda end: parts.select(F.col("node").alias(end), F.col("component").alias(f"{end}_part"))
    below = settled(inside.join(of("source"), "source").join(of("target"), "target").where("source_part != target_part").select(F.col("source_part").alias("part"), F.col("target_part").alias("under")).distinct())
    own = files.join(parts.withColumnRenamed("node", "module"), "module").groupBy(F.col("component").alias("part")).agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "module", "digest"))), ",").alias("own"))
    waiting = settled(own)
    done = None
    while waiting.limit(1).count():
        if done is None:
            ready = waiting.join(below.select("part").distinct(), "part", "left_anti").withColumn("under", F.lit(""))
        else:
            state = below.join(waiting.select("part"), "part", "left_semi").join(done.select(F.col("part").alias("under"), "digest"), "under", "left")
            full = state.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.count("digest").alias("have"), F.array_join(F.array_sort(F.collect_set("digest")), ",").alias("under")).where("n = have")
            ready = waiting.join(full.select("part", "under"), "part")
        now = settled(ready.select("part", F.sha2(F.concat_ws("|", "own", "under"), 256).alias("digest")))
        done = now if done is None else done.unionByName(now)
        waiting = settled(waiting.join(now, "part", "left_anti"))
    if done is None:
        done = own.select("part", F.col("own").alias("digest"))
    return parts.join(done, F.col("component") == F.col("part")).select(F.col("node").alias("module"), "component", "digest")


def linked_digests(files: DataFrame, edges: DataFrame) -> DataFrame:
    """module and linked: one digest of the sorted names and digests of the modules that it imports itself; without any, of nothing."""
    under = edges.where("source != target").select("source", "target").distinct().join(files.select(F.col("module").alias("target"), "digest").distinct(), "target")
    lists = under.groupBy(F.col("source").alias("module")).agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "target", "digest"))), ",").alias("list"))
    return files.select("module").distinct().join(lists, "module", "left").select("module", F.sha2(F.coalesce("list", F.lit("")), 256).alias("linked"))
