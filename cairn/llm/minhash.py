"""Operator 6: near-duplicate documents by circulant MinHash, banding and exact Jaccard verification."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm.common import WORD, materialize, mix64, shingle_hashes, small_batches, table, utf8_rows, word_hashes
from cairn.llm.components import star_roots

#: Positions of the circle; the second permutation is a shuffle of as many values.
CIRCLE = 1 << 20
#: Rows of a band and bands: two sets of Jaccard 0.85 meet in a band with probability 0.99996, of 0.8 with 0.9984.
ROWS, BANDS = 6, 21
COORDINATES = ROWS * BANDS
#: Classes of a bucket that are compared with each other, or with as many others, in one task.
TILE = 256


class Circulant:
    """Two permutations give every signature coordinate.

    The first (a mixing bijection, then the top bits) deals shingles to places
    of a circle; the second gives each place a value. Coordinate k is the least
    value at the set's places moved on by k, so the coordinates of a shingle
    are one contiguous run of the value table.
    """

    def __init__(self, seed: int = 17):
        values = np.random.default_rng(seed).permutation(CIRCLE).astype(np.uint32)
        self.runs = np.lib.stride_tricks.sliding_window_view(np.concatenate([values, values[:COORDINATES]]), COORDINATES)

    def signature(self, shingles: np.ndarray) -> np.ndarray:
        at = mix64(shingles ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(44)
        best = None
        for k in range(0, len(at), 4096):  # bounded memory for texts of any length
            part = self.runs[at[k : k + 4096]].min(axis=0)
            best = part if best is None else np.minimum(best, part)
        return best

    @staticmethod
    def bands(signature: np.ndarray) -> np.ndarray:
        rows = signature.reshape(BANDS, ROWS).astype(np.uint64)
        out = np.arange(BANDS, dtype=np.uint64)
        for j in range(ROWS):
            out = mix64(out ^ rows[:, j])
        return out.view(np.int64)


_circulant: list[Circulant] = []


def circulant() -> Circulant:
    if not _circulant:
        _circulant.append(Circulant())
    return _circulant[0]


def _texts_of(batches, size):
    """(record batch, row, distinct shingles of the row's text) of all rows."""
    for batch in batches:
        words, first, _, _ = word_hashes(*utf8_rows(batch.column(batch.schema.get_field_index("text"))))
        yield batch, (shingle_hashes(words[first[i] : first[i + 1]], size) for i in range(batch.num_rows))


def sketches(docs: DataFrame, shingle_size: int = 5) -> DataFrame:
    """doc_id, t (a hash of the text), n_shingles, class_id (a 128-bit digest of the shingle set; null if it is empty) and band keys."""
    small_batches(docs.sparkSession)

    def sketch(batches):
        import pyarrow as pa

        circle = circulant()
        for batch, sets in _texts_of(batches, shingle_size):
            sizes, ids, keys = [], [], []
            for s in sets:
                sizes.append(len(s))
                ids.append(hashlib.md5(s.tobytes()).digest() if len(s) else None)
                keys.append(circle.bands(circle.signature(s)) if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(ids, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "t", "n_shingles", "class_id", "bands"])

    return docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("t"), "text").mapInArrow(sketch, "doc_id long, t long, n_shingles long, class_id binary, bands array<long>")


def shingle_sets(docs: DataFrame, shingle_size: int = 5) -> DataFrame:
    """class_id and the whole shingle set of every row."""
    small_batches(docs.sparkSession)

    def sets_of(batches):
        import pyarrow as pa

        for _, sets in _texts_of(batches, shingle_size):
            rows = [s for s in sets if len(s)]
            ids = [hashlib.md5(s.tobytes()).digest() for s in rows]
            flat = np.concatenate(rows).view(np.int64) if rows else np.zeros(0, np.int64)
            ends = np.cumsum([0] + [len(s) for s in rows])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.binary()), pa.LargeListArray.from_arrays(pa.array(ends, pa.int64()), pa.array(flat)).cast(pa.list_(pa.int64()))], ["class_id", "shingles"])

    return docs.select("text").mapInArrow(sets_of, "class_id binary, shingles array<long>")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) whose full sets have 100 * intersection >= percent * union."""
    a = sets.select(F.col("class_id").alias("u"), F.col("shingles").alias("su"))
    b = sets.select(F.col("class_id").alias("v"), F.col("shingles").alias("sv"))
    common = F.size(F.array_intersect("su", "sv"))
    return pairs.join(a, "u").join(b, "v").withColumn("common", common).where(100 * F.col("common") >= percent * (F.size("su") + F.size("sv") - F.col("common"))).select("u", "v")


def near_duplicates(docs: DataFrame, percent: int = 80, shingle_size: int = 5) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, class_id, root (component of classes) and t of every row of docs.

    Texts with equal shingle sets are one class, whose copies are never
    expanded. Classes meet in bands. The members of a band bucket are first
    held against one leader, the class with the least share of shingles of its
    own, which is the middle of a group of copies: most of a large group joins
    by a number of comparisons linear in its size. Members that are in
    different components still are compared tile by tile, so no link that the
    bands bring up is lost. Shingles that one class alone holds bound its
    overlap with any other; pairs that this rules out are never made.

    Null and empty texts and texts without words have no shingles and link
    with nothing. Rows that share a doc_id are told apart by their shingle
    sets. Null ids take part; they are never a component_id unless the whole
    component has no id, whose component_id is null and kept false. Other
    columns are ignored; an empty table gives no rows.
    """
    sk = materialize(sketches(docs, shingle_size), "sketches")
    classes = materialize(sk.where("class_id is not null").groupBy("class_id").agg(F.min("doc_id").alias("least_id"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands")), "classes")
    # Buckets with one class say nothing; the count is combined before the shuffle.
    keyed = classes.select("class_id", "n", F.posexplode("bands").alias("band", "bucket"))
    shared = keyed.groupBy("bucket").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    buckets = materialize(keyed.join(shared, "bucket"), "buckets")
    members = buckets.select("class_id").distinct()
    wanted = classes.join(members, "class_id", "left_semi").select("least_id").distinct()
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    cand = d.join(wanted, d.doc_id.eqNullSafe(wanted.least_id), "left_semi")
    sets = materialize(shingle_sets(cand, shingle_size).groupBy("class_id").agg(F.first("shingles").alias("shingles")), "sets")

    twos = buckets.where("members = 2").groupBy("bucket").agg(F.min("class_id").alias("u"), F.max("class_id").alias("v")).select("u", "v")
    big = buckets.where("members > 2")
    own = materialize(_own_shingles(sets.join(big.select("class_id").distinct(), "class_id", "left_semi")), "own")
    # what a class alone holds is in no intersection: too much of it, and no link can be
    live = materialize(big.join(own, "class_id", "left").withColumn("own", F.coalesce("own", F.lit(0))).where(100 * (F.col("n") - F.col("own")) >= percent * F.col("n")), "live")
    stars = _held_against(live, _leaders(live), percent)
    good = materialize(_verified(twos.unionByName(stars).distinct(), sets, percent), "verified")
    roots = materialize(star_roots(good), "roots")

    # what the leaders leave in different components is compared tile by tile
    more = materialize(_tile_links(_unsettled(live, roots), classes, sets, percent), "verified")
    if more.limit(1).count():
        roots = materialize(star_roots(good.unionByName(more)), "roots")

    of = classes.select("class_id", "least_id").join(roots.select(F.col("node").alias("class_id"), "root"), "class_id", "left").withColumn("root", F.coalesce("root", "class_id"))
    least = of.groupBy("root").agg(F.min("least_id").alias("component_id"))
    named = of.join(least, "root").select("class_id", "root", "component_id")
    # a hot class is split by adaptive execution; class_id null (no shingles) is joined by nothing
    out = sk.select("doc_id", "t", "n_shingles", "class_id").join(named, "class_id", "left")
    out = out.withColumn("component_id", F.when(F.col("class_id").isNull(), F.col("doc_id")).otherwise(F.col("component_id")))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"), "class_id", "root", "t")


def _own_shingles(sets: DataFrame) -> DataFrame:
    """class_id and own: how many of its shingles no other of these classes holds."""
    each = sets.select("class_id", F.explode("shingles").alias("x"))
    single = each.groupBy("x").agg(F.count(F.lit(1)).alias("holders"), F.min(F.xxhash64("class_id")).alias("c")).where("holders = 1")
    counts = single.groupBy("c").agg(F.count(F.lit(1)).alias("own"))
    return sets.select("class_id", F.xxhash64("class_id").alias("c")).join(counts, "c").select("class_id", "own")


def _can_link(n_u: str, own_u: str, n_v: str, own_v: str, percent: int):
    """Whether the shingles that two classes hold alone leave enough for a link."""
    most = F.least(F.col(n_u) - F.col(own_u), F.col(n_v) - F.col(own_v))
    return 100 * most >= percent * (F.col(n_u) + F.col(n_v) - most)


def _leaders(live: DataFrame) -> DataFrame:
    """bucket, lc, ln and lo of the leader of each bucket: the class with the least share of shingles of its own."""
    by = F.struct((F.col("own") / F.col("n")).alias("share"), "class_id", "n", "own")
    return live.groupBy("bucket").agg(F.min(by).alias("l")).select("bucket", F.col("l.class_id").alias("lc"), F.col("l.n").alias("ln"), F.col("l.own").alias("lo"))


def _held_against(members: DataFrame, leaders: DataFrame, percent: int) -> DataFrame:
    """(u, v) of each member with the leader of its bucket, if the shingles that they hold alone leave room for a link."""
    near = members.join(leaders, "bucket").where("class_id != lc").where(_can_link("n", "own", "ln", "lo", percent))
    return near.select(F.least("class_id", "lc").alias("u"), F.greatest("class_id", "lc").alias("v"))


def _unsettled(live: DataFrame, roots: DataFrame) -> DataFrame:
    """Members, with root, that aren't the leader of their bucket, where these are in more than one component."""
    done = _leaders(live).select("bucket", F.col("lc").alias("class_id"))
    at = live.join(done, ["bucket", "class_id"], "left_anti").join(roots.select(F.col("node").alias("class_id"), "root"), "class_id", "left").withColumn("root", F.coalesce("root", "class_id"))
    open_ = at.groupBy("bucket").agg(F.min("root").alias("least"), F.max("root").alias("most")).where("least != most").select("bucket")
    return at.join(open_, "bucket", "left_semi")


def _overlaps(rows: list[np.ndarray], others: list[np.ndarray]) -> np.ndarray:
    """The sizes of the intersections of each of some sets with each of others."""
    flat = np.concatenate(others)
    owner = np.repeat(np.arange(len(others)), [len(x) for x in others])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    out = np.zeros((len(rows), len(others)), np.int64)
    for i, s in enumerate(rows):
        low, high = np.searchsorted(flat, s, "left"), np.searchsorted(flat, s, "right")
        n = high - low
        at = np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())
        out[i] = np.bincount(owner[at], minlength=len(others))
    return out


def _tile_links(rest: DataFrame, classes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between different components within buckets.

    A bucket is cut into tiles of about TILE classes, and every two of them
    meet in a task, which counts the overlaps of the whole sets and gives the
    links alone: sets travel once for each tile of their bucket, pairs don't
    travel. A pair is counted in the first band that it shares.
    """
    rest = materialize(rest, "open")
    tiles = rest.groupBy("bucket").agg(F.ceil(F.count(F.lit(1)) / TILE).alias("tiles"))
    own = F.pmod(F.xxhash64("class_id"), F.col("tiles"))
    met = rest.join(tiles, "bucket").withColumn("tile", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)))
    met = materialize(met.select("bucket", "band", "class_id", "root", "n", "own", F.least("tile", "other").alias("a"), F.greatest("tile", "other").alias("b"), "tile"), "tiles")
    bundles = max(1, -(-met.count() // (2 * TILE)))
    full = met.join(classes.select("class_id", "bands"), "class_id").join(sets, "class_id").withColumn("bundle", F.pmod(F.xxhash64("bucket", "a", "b"), F.lit(bundles)))

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        found = []
        for (_, a, b), part in rows.groupby(["bucket", "a", "b"], sort=False):
            left, right = (part[part["tile"] == k] for k in (a, b))
            if not len(left) or not len(right):
                continue
            common = _overlaps(list(left["shingles"]), list(right["shingles"]))
            sizes = left["n"].to_numpy()[:, None] + right["n"].to_numpy()[None, :] - common
            near = 100 * common >= percent * sizes
            roots = pd.factorize(pd.concat([left["root"], right["root"]]))[0]
            near &= roots[: len(left), None] != roots[None, len(left) :]
            u, v = np.nonzero(near)
            ids, others, bands, more = left["class_id"].to_numpy(), right["class_id"].to_numpy(), left["bands"].to_numpy(), right["bands"].to_numpy()
            at = int(part["band"].iloc[0])
            for i, j in zip(u.tolist(), v.tolist(), strict=True):
                if ids[i] != others[j] and int(np.argmax(np.asarray(bands[i]) == np.asarray(more[j]))) == at:
                    found.append((min(ids[i], others[j]), max(ids[i], others[j])))
        return pd.DataFrame(found, columns=["u", "v"], dtype=object)

    return full.groupBy("bundle").applyInPandas(compare, "u binary, v binary").distinct()


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """near_duplicates() of all documents at 85%; nulls, ties, repeated rows and empty tables as stated there."""
    return near_duplicates(table(spark, sf_dir, "documents"), percent=85).drop("class_id", "root", "t")


def keep_one(docs: DataFrame, percent: int = 80, shingle_size: int = 5) -> DataFrame:
    """docs with one row of each near-duplicate component; rows whose text has no word all stay.

    The row that stays is the one with the least doc_id (a null id only if all
    are null), and of texts that share that id the one with the least hash.
    """
    found = near_duplicates(docs.select("doc_id", "text"), percent, shingle_size).where("class_id is not null")
    by = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "t")
    stay = found.groupBy("root").agg(F.min(by).alias("s")).select(F.col("s.doc_id").alias("_id"), F.col("s.t").alias("_st"))
    has_word = F.coalesce(F.col("text").rlike(WORD), F.lit(False))
    left = docs.where(has_word).select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("k_id"), F.xxhash64("text").alias("k_t"))
    one = left.join(stay, F.col("k_id").eqNullSafe(F.col("_id")) & (F.col("k_t") == F.col("_st"))).dropDuplicates(["k_id", "k_t"])
    return one.select("row.*").unionByName(docs.where(~has_word))
