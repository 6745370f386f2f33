"""Operator 4: near-duplicate embeddings by sorted projection passes, with exact links inside what the passes unite."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairn.llm.common import drop_table, materialize, small_batches, table
from cairn.llm.components import star_roots

# ---- shared with nearest neighbours -------------------------------------------------------------


def usable(embedding):
    """Vectors that can be compared: not null, without null or non-finite components, not zero."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.coalesce(~F.exists(embedding, bad) & F.exists(embedding, lambda x: x != 0), F.lit(False))


def as_double(embedding):
    """Components as doubles; adding 0 makes -0.0 and 0.0 one value."""
    return F.transform(embedding, lambda x: x.cast("double") + F.lit(0.0))


def vector_classes(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members: vec_id, class_id; classes: class_id, v, copies, least_id) of the comparable vectors; equal vectors are one class."""
    own = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("v")).where(usable(F.col("v"))).withColumn("v", as_double(F.col("v")))
    text = F.concat_ws(",", F.transform("v", lambda x: x.cast("string")))
    members = materialize(own.withColumn("class_id", F.md5(text)), "vectors")
    classes = materialize(members.groupBy("class_id").agg(F.first("v").alias("v"), F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("least_id")), "vclasses")
    return members.select("vec_id", "class_id"), classes


def matrix(column: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, np.float64) for v in column])


# ---- operator 4 ---------------------------------------------------------------------------------

#: Bits of a key, and steps of angle in a threshold's angle by which large components are ordered.
BITS, STEPS = 63, 16


def planes(dim: int, passes: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed + dim).standard_normal((passes, dim, BITS)).astype(np.float32)


def unit(column: pd.Series) -> np.ndarray:
    x = matrix(column)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n places the least one that links (a, b) reach."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _edges(ids: np.ndarray, a: np.ndarray, b: np.ndarray) -> list[tuple[str, str]]:
    """One edge for each vector that links unite with one before it: enough for components, linear in the vectors."""
    root = local_roots(len(ids), a, b)
    return [(ids[i], ids[root[i]]) for i in np.flatnonzero(root != np.arange(len(ids)))]


def _frame(edges: list[tuple[str, str]]) -> pd.DataFrame:
    return pd.DataFrame(edges, columns=["u", "v"], dtype=object)


def prefix_bits(n: int, bucket: int) -> int:
    """Bits of a key that all vectors of a bucket share: about `bucket` of n scattered vectors have the same."""
    return min(BITS, max(10, math.ceil(math.log2(max(1, n) / bucket))))


def passes_for(threshold: float, bits: int, miss: float) -> int:
    """Passes after which two vectors at the threshold have shared `bits` bits at least once, but for a chance of `miss`."""
    same = (1 - math.acos(threshold) / math.pi) ** bits
    return max(16, math.ceil(math.log(miss) / math.log1p(-same)))


def _window_edges(keyed: DataFrame, classes: DataFrame, threshold: float, window: int, block: int) -> DataFrame:
    """Edges between vectors at most `window` places apart in the order of a pass.

    Only keys and class ids are sorted; each vector is then sent to the
    blocks that hold its places.
    """
    # a global place for each row: the number of its range, its place there, and the sizes of the ranges before
    order = ["pass", "dim", "key", "class_id"]
    ranged = materialize(keyed.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()), "ranges")
    ranged = ranged.withColumn("range", F.shiftright("at", 33)).withColumn("at", F.col("at").bitwiseAND(F.lit((1 << 33) - 1)))
    sizes = ranged.groupBy("range").agg(F.count(F.lit(1)).alias("rows"))
    starts = sizes.select("range", F.coalesce(F.sum("rows").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    placed = ranged.join(starts, "range").withColumn("place", F.col("start") + F.col("at"))
    own = F.floor(F.col("place") / block)
    # the first places of a block are also compared with the end of the block before
    blocks = F.when((F.col("place") % block < window) & (own > 0), F.array(own, own - 1)).otherwise(F.array(own))
    dealt = placed.select(F.explode(blocks).alias("block"), "place", "pass", "dim", "class_id").join(classes.select("class_id", "v"), "class_id")

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("place", kind="stable")
        edges: list[tuple[str, str]] = []
        for _, part in rows.groupby(["pass", "dim"], sort=False):
            x, us, vs = unit(part["v"]), [], []
            for i in range(0, len(x), 256):  # a band of the matrix of cosines
                a, b = np.nonzero(x[i : i + 256] @ x[i : i + 256 + window].T >= threshold)
                near = (b > a) & (b <= a + window)
                us.append(a[near] + i)
                vs.append(b[near] + i)
            edges += _edges(part["class_id"].to_numpy(), np.concatenate(us), np.concatenate(vs))
        return _frame(edges)

    return materialize(dealt.groupBy("block").applyInPandas(compare, "u string, v string").distinct(), "vedges")


def _paired(rows: DataFrame, pairs: DataFrame, block: int) -> DataFrame:
    """Rows of both tiles of each pair (a, b), with the tile pairs dealt into bundles of about two blocks."""
    sides = pairs.select(F.col("a").alias("tile"), "a", "b", F.lit(0).alias("side")).unionByName(pairs.where("a != b").select(F.col("b").alias("tile"), "a", "b", F.lit(1).alias("side")))
    dealt = materialize(rows.join(sides, "tile"), "tiles")
    return dealt.withColumn("bundle", F.pmod(F.xxhash64("a", "b"), F.lit(max(1, -(-dealt.count() // (2 * block))))))


def _tile_pairs(rows: pd.DataFrame):
    """(left rows, right rows or None) of each tile pair of a bundle."""
    for _, part in rows.groupby(["a", "b"], sort=False):
        right = part[part["side"] == 1]
        yield part[part["side"] == 0], right if len(right) else None


def _deep_edges(keyed: DataFrame, roots: DataFrame, classes: DataFrame, threshold: float, window: int, block: int, prefix: int) -> DataFrame:
    """Edges between components of vectors that share a prefix of their keys further apart than the window.

    Buckets of a prefix are cut into tiles of about `block` rows. A component
    that fills tiles of its own isn't compared with itself, so a large group
    of near copies costs tiles in proportion to its size.
    """
    run = F.concat_ws(":", "pass", "dim", F.shiftright("key", BITS - prefix))
    at = keyed.select("class_id", run.alias("run")).join(roots.select(F.col("node").alias("class_id"), "root"), "class_id", "left").withColumn("root", F.coalesce("root", "class_id"))
    open_ = at.groupBy("run").agg(F.count(F.lit(1)).alias("n"), F.min("root").alias("lo"), F.max("root").alias("hi")).where((F.col("n") > window + 1) & (F.col("lo") != F.col("hi"))).select("run")
    at = materialize(at.join(open_, "run", "left_semi"), "runs")
    large = at.groupBy("run", "root").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > block).select("run", "root", F.col("root").alias("part"))
    at = at.join(large, ["run", "root"], "left").withColumn("part", F.coalesce("part", F.lit("")))
    parts = materialize(at.groupBy("run", "part").agg(F.ceil(F.count(F.lit(1)) / block).alias("tiles")), "parts")
    rows = at.join(parts, ["run", "part"]).select("class_id", "root", F.concat_ws("/", "run", "part", F.pmod(F.xxhash64("class_id"), F.col("tiles"))).alias("tile"))
    tiles = parts.select("run", "part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)).alias("k")).select("run", "part", F.concat_ws("/", "run", "part", "k").alias("tile"))
    left, right = tiles.select("run", F.col("part").alias("pa"), F.col("tile").alias("a")), tiles.select("run", F.col("part").alias("pb"), F.col("tile").alias("b"))
    pairs = left.join(right, "run").where((F.col("a") <= F.col("b")) & ((F.col("pa") != F.col("pb")) | (F.col("pa") == ""))).select("a", "b")

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        edges: list[tuple[str, str]] = []
        for left, right in _tile_pairs(rows):
            both = left if right is None else pd.concat([left, right])
            x, root, start = unit(both["v"]), pd.factorize(both["root"])[0], 0 if right is None else len(left)
            us, vs = [], []
            for i in range(0, len(left), 512):
                a, b = np.nonzero((x[i : min(len(left), i + 512)] @ x[start:].T >= threshold) & (root[i : min(len(left), i + 512), None] != root[None, start:]))
                us.append(a + i)
                vs.append(b + start)
            edges += _edges(both["class_id"].to_numpy(), np.concatenate(us), np.concatenate(vs))
        return _frame(edges)

    paired = _paired(rows.join(classes.select("class_id", "v"), "class_id"), pairs, block)
    return materialize(paired.groupBy("bundle").applyInPandas(compare, "u string, v string").distinct(), "vedges")


def _counted(x: np.ndarray, y: np.ndarray, copies: np.ndarray, threshold: float, same: bool) -> np.ndarray:
    """For each row of x the copies of the rows of y that it links with; without itself where x is y."""
    out = np.empty(len(x), np.int64)
    for i in range(0, len(x), 512):
        near = x[i : i + 512] @ y.T >= threshold
        if same:
            near[np.arange(len(near)), np.arange(i, i + len(near))] = False
        out[i : i + 512] = near @ copies
    return out


def _links_inside(of: DataFrame, threshold: float, block: int) -> DataFrame:
    """class_id and others: the vectors of other classes of its component that each class links with; of has class_id, root, copies and v.

    Small components are compared whole. The members of a large one are
    ordered by their angle to its root: two that together stay within the
    threshold's angle do link, two whose angles differ by more don't, and
    steps of angle that leave it open are compared tile by tile. Counts come
    out, never pairs.
    """
    sizes = of.groupBy("root").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    known = materialize(of.join(sizes, "root"), "vcomponents")
    small = known.where(F.col("n") <= block)
    bundles = max(1, -(-small.count() // (2 * block)))

    def whole(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("root", kind="stable")
        ends = np.flatnonzero((rows["root"] != rows["root"].shift()).to_numpy()).tolist() + [len(rows)]
        copies, others = rows["copies"].to_numpy(), np.zeros(len(rows), np.int64)
        for a, b in zip(ends[:-1], ends[1:], strict=True):
            x = unit(rows["v"].iloc[a:b])
            others[a:b] = _counted(x, x, copies[a:b], threshold, True)
        return pd.DataFrame({"class_id": rows["class_id"].to_numpy(), "others": others})

    counted = small.withColumn("bundle", F.pmod(F.xxhash64("root"), F.lit(bundles))).groupBy("bundle").applyInPandas(whole, "class_id string, others long")

    limit, edge = math.acos(threshold), 1e-6
    lead = known.where("class_id = root").where(F.col("n") > block).select("root", F.col("v").alias("lv"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    cosine = dot("v", "lv") / F.sqrt(dot("v", "v") * dot("lv", "lv"))
    large = known.where(F.col("n") > block).join(lead, "root").withColumn("angle", F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine))))
    large = materialize(large.withColumn("step", F.floor(F.col("angle") / (limit / STEPS))).select("root", "class_id", "copies", "v", "angle", "step"), "vlarge")
    steps = materialize(large.groupBy("root", "step").agg(F.min("angle").alias("lo"), F.max("angle").alias("hi"), F.sum("copies").alias("copies"), F.ceil(F.count(F.lit(1)) / block).alias("tiles")), "vsteps")
    one, two = (steps.select("root", *[F.col(c).alias(f"{c}_{k}") for c in ("step", "lo", "hi", "copies", "tiles")]) for k in "ab")
    met = one.join(two, "root").where((F.col("lo_a") - F.col("hi_b") <= limit + edge) & (F.col("lo_b") - F.col("hi_a") <= limit + edge))  # at most STEPS / limit * pi steps of a root
    sure = F.col("hi_a") + F.col("hi_b") <= limit - edge
    certain = met.where(sure).groupBy("root", F.col("step_a").alias("step")).agg(F.sum("copies_b").alias("all"), F.max(F.col("step_a") == F.col("step_b")).alias("own"))
    linked = large.join(certain, ["root", "step"]).select("class_id", (F.col("all") - F.when(F.col("own"), F.col("copies")).otherwise(F.lit(0))).alias("others"))
    number = lambda k: F.explode(F.sequence(F.lit(0).cast("long"), F.col(f"tiles_{k}") - 1))
    name = lambda k: F.concat_ws("/", "root", f"step_{k}", f"k_{k}").alias(k)
    pairs = met.where(~sure & (F.col("step_a") <= F.col("step_b"))).withColumn("k_a", number("a")).withColumn("k_b", number("b")).where((F.col("step_a") < F.col("step_b")) | (F.col("k_a") <= F.col("k_b"))).select(name("a"), name("b"))
    rows = large.join(steps.select("root", "step", "tiles"), ["root", "step"]).select("class_id", "copies", "v", F.concat_ws("/", "root", "step", F.pmod(F.xxhash64("class_id"), F.col("tiles"))).alias("tile"))

    def tiles(rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for left, right in _tile_pairs(rows):
            x, other = unit(left["v"]), left if right is None else right
            y = unit(other["v"])
            out.append(pd.DataFrame({"class_id": left["class_id"].to_numpy(), "others": _counted(x, y, other["copies"].to_numpy(), threshold, right is None)}))
            if right is not None:
                out.append(pd.DataFrame({"class_id": right["class_id"].to_numpy(), "others": _counted(y, x, left["copies"].to_numpy(), threshold, False)}))
        return pd.concat(out)

    open_ = _paired(rows, pairs, block).groupBy("bundle").applyInPandas(tiles, "class_id string, others long")
    return materialize(counted.unionByName(linked).unionByName(open_).groupBy("class_id").agg(F.sum("others").alias("others")), "vcounts")


def near_vectors(vectors: DataFrame, threshold: float = 0.95, window: int = 64, bucket: int = 512, miss: float = 0.001, block: int = 4096, seed: int = 11) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of vectors.

    In each pass a class of equal vectors has a key of 63 concatenated
    random hyperplane hashes. All passes are sorted at once by (pass, key) and
    each vector is compared with the `window` places after it. Vectors that
    share a prefix of a key but are further apart than that are compared tile
    by tile, unless they are in one component by then; the prefix grows with
    the logarithm of the number of vectors, so that about `bucket` scattered
    ones share it, and there are as many passes as leave a pair at the
    threshold apart in all of them with a chance of `miss`. Verified pairs are
    united across passes. Inside each component all links are then counted
    exactly, whatever its size: no number of partners is capped.

    A copy of a vector is a link of cosine 1; copies are counted by class,
    never expanded. Null, zero and non-finite vectors, and vectors with null
    components, link with nothing. Vectors of unequal dimensions never link.
    Rows that share a vec_id are rows of their own with equal values; null ids
    link, and name a component only if nothing else does (then kept is
    false). Other columns, labels too, are ignored; an empty table gives no
    rows.
    """
    small_batches(vectors.sparkSession)
    members, classes = vector_classes(vectors)
    n, dims = classes.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    block = max(128, min(block, (1 << 18) // (dims or 1)))
    prefix = prefix_bits(n, bucket)
    passes = passes_for(threshold, prefix, miss)

    def keys(batches):
        for rows in batches:
            if not len(rows):
                continue
            for dim, part in rows.groupby(rows["v"].map(len)):
                x = matrix(part["v"])
                for p, plane in enumerate(planes(int(dim), passes, seed)):
                    key = (((x @ plane) > 0).astype(np.uint64) << np.arange(BITS, dtype=np.uint64)[::-1]).sum(axis=1, dtype=np.uint64).astype(np.int64)
                    yield pd.DataFrame({"pass": np.int32(p), "dim": np.int32(dim), "key": key, "class_id": part["class_id"].to_numpy()})

    keyed = materialize(classes.select("class_id", "v").mapInPandas(keys, "pass int, dim int, key long, class_id string"), "vkeys")
    near = _window_edges(keyed, classes, threshold, window, block)
    roots = star_roots(near)
    deep = _deep_edges(keyed, roots, classes, threshold, window, block, prefix)
    if deep.limit(1).count():
        drop_table(roots)
        roots = star_roots(near.unionByName(deep))
    of = classes.join(roots.select(F.col("node").alias("class_id"), "root"), "class_id", "left").withColumn("root", F.coalesce("root", "class_id"))
    others = _links_inside(of.select("class_id", "root", "copies", "v"), threshold, block)
    least = of.groupBy("root").agg(F.min("least_id").alias("component_id"))
    named = of.drop("v").join(least, "root").join(others, "class_id", "left").select("class_id", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), "component_id")
    linked = members.join(named, "class_id").select("vec_id", "n_links", "component_id")
    alone = vectors.where(~usable(F.col("embedding"))).select(F.col("vec_id").cast("long").alias("vec_id"), F.lit(0).cast("long").alias("n_links"), F.col("vec_id").cast("long").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op4_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """near_vectors() of all embeddings at cosine 0.95; nulls, ties, repeated rows and empty tables as stated there."""
    return near_vectors(table(spark, sf_dir, "embeddings"))
