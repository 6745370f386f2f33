"""Operator 8: nearest neighbours by hierarchical navigable small-world graphs, one for each shard."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairn.llm.common import materialize, mix64, small_batches, table
from cairn.llm.vectors import vector_classes

#: Numbers in the vectors of a shard: 32 MB, and 65,536 vectors of 64 dimensions.
SHARD_NUMBERS = 1 << 22
#: Numbers in a block of distances (16 MB), bytes of a row that holds a piece of a graph, and copies of graphs for each core.
BLOCK_NUMBERS, PIECE_BYTES, COPIES = 1 << 22, 1 << 14, 8


class Hnsw:
    """A hierarchical navigable small-world graph in flat arrays.

    links[level] is an int32 array of rows of neighbour numbers, -1 where a
    row is shorter. Distances are squared Euclidean ones. Largest inner
    products are nearest neighbours once each vector has one more component
    that brings all to the same length.

    Nodes go in by number: each chooses neighbours among the nearest of the
    nodes before it, which are found by blocks of matrix products instead of
    a search, and each node then chooses among those that chose it.
    """

    def __init__(self, x: np.ndarray, m: int = 16, seed: int = 5):
        self.x = np.ascontiguousarray(x, np.float32)
        n = len(x)
        u = (mix64(np.arange(n, dtype=np.uint64) + np.uint64(seed)) >> np.uint64(11)).astype(np.float64) / (1 << 53)
        level = np.minimum(12, (-np.log(1 - u) / np.log(m)).astype(np.int64))
        self.top = int(level.max(initial=0))
        self.entry = int(np.argmax(level)) if n else 0
        self.links = []
        for lv in range(self.top + 1):
            ids = np.flatnonzero(level >= lv)
            rows = np.full((n, 2 * m if lv == 0 else m), -1, np.int32)
            own = self._layer(self.x[ids], m, rows.shape[1])
            rows[ids] = np.where(own >= 0, ids[own], -1)
            self.links.append(rows)

    @classmethod
    def stored(cls, x: np.ndarray, links: list[np.ndarray], entry: int, top: int) -> Hnsw:
        g = cls.__new__(cls)
        g.x, g.links, g.entry, g.top = np.ascontiguousarray(x, np.float32), links, entry, top
        return g

    @staticmethod
    def _diverse(x: np.ndarray, near: np.ndarray, far: np.ndarray, most: int) -> np.ndarray:
        """Up to `most` of each row of candidates `near`, sorted by distance `far` (infinite: none).

        Those nearer to the node than to one chosen before come first, then
        the nearest of the rest.
        """
        b, k = near.shape
        v = x[near]
        sq = np.einsum("bkd,bkd->bk", v, v)
        apart = sq[:, :, None] + sq[:, None, :] - 2 * (v @ v.transpose(0, 2, 1))
        least = np.full((b, k), np.inf, np.float32)
        chosen, count = np.zeros((b, k), bool), np.zeros(b, np.int64)
        for t in range(k):
            ok = np.isfinite(far[:, t]) & (far[:, t] < least[:, t]) & (count < most)
            chosen[:, t] = ok
            count += ok
            np.minimum(least, np.where(ok[:, None], apart[:, t], np.inf), out=least)
        rank = np.where(np.isfinite(far), np.where(chosen, 0, k) + np.arange(k), 3 * k)
        first = np.argsort(rank, axis=1, kind="stable")[:, :most]
        out = np.full((b, most), -1, np.int64)
        out[:, : first.shape[1]] = np.where(np.take_along_axis(rank, first, 1) < 3 * k, np.take_along_axis(near, first, 1), -1)
        return out

    @classmethod
    def _layer(cls, x: np.ndarray, m: int, width: int, candidates: int = 64, rows: int = 256) -> np.ndarray:
        n, sq = len(x), np.einsum("ij,ij->i", x, x)
        forward = np.full((n, m), -1, np.int64)
        block = max(16, min(rows, BLOCK_NUMBERS // max(1, n)))
        for s in range(1, n, block):
            e = min(n, s + block)
            far = sq[s:e, None] + sq[None, :e]
            dot = x[s:e] @ x[:e].T
            dot *= 2
            far -= dot
            far[:, s:e][np.triu(np.ones((e - s, e - s), bool))] = np.inf
            k = min(candidates, e)
            near = np.argpartition(far, k - 1, axis=1)[:, :k]
            far = np.take_along_axis(far, near, 1)
            order = np.argsort(far, axis=1, kind="stable")
            forward[s:e] = cls._diverse(x, np.take_along_axis(near, order, 1), np.take_along_axis(far, order, 1), m)
        a, c = np.nonzero(forward >= 0)
        b = forward[a, c]
        u, v = np.concatenate([a, b]), np.concatenate([b, a])
        far = np.empty(len(u), np.float32)
        for s in range(0, len(u), 1 << 15):
            d = x[u[s : s + (1 << 15)]] - x[v[s : s + (1 << 15)]]
            far[s : s + (1 << 15)] = np.einsum("ij,ij->i", d, d)
        order = np.lexsort((v, far, u))
        u, v, far = u[order], v[order], far[order]
        start = np.searchsorted(u, np.arange(n + 1))
        place = np.arange(len(u)) - start[u]
        out = np.full((n, width), -1, np.int64)
        for s in range(0, n, rows):
            e = min(n, s + rows)
            part = slice(start[s], start[e])
            fits = place[part] < candidates + width
            k = int(place[part][fits].max(initial=-1)) + 1
            near, d = np.zeros((e - s, k), np.int64), np.full((e - s, k), np.inf, np.float32)
            near[u[part][fits] - s, place[part][fits]] = v[part][fits]
            d[u[part][fits] - s, place[part][fits]] = far[part][fits]
            if k:
                out[s:e] = cls._diverse(x, near, d, width)
        return out

    def _distances(self, q: np.ndarray, ids: np.ndarray) -> np.ndarray:
        d = self.x[ids] - q
        return np.einsum("ij,ij->i", d, d)

    def _search(self, q: np.ndarray, starts: list[tuple[float, int]], ef: int, level: int) -> list[tuple[float, int]]:
        links, seen = self.links[level], {i for _, i in starts}
        near = list(starts)
        heapq.heapify(near)
        best = [(-d, i) for d, i in starts]
        heapq.heapify(best)
        while near:
            d, i = heapq.heappop(near)
            if d > -best[0][0] and len(best) >= ef:
                break
            new = [j for j in links[i].tolist() if j >= 0 and j not in seen]
            if not new:
                continue
            seen.update(new)
            for e, j in zip(self._distances(q, np.array(new)).tolist(), new, strict=True):
                if len(best) < ef or e < -best[0][0]:
                    heapq.heappush(near, (e, j))
                    heapq.heappush(best, (-e, j))
                    if len(best) > ef:
                        heapq.heappop(best)
        return sorted((-d, i) for d, i in best)

    def nearest(self, q: np.ndarray, k: int, ef: int) -> list[int]:
        if not len(self.x):
            return []
        at = [(float(self._distances(q, np.array([self.entry]))[0]), self.entry)]
        for level in range(self.top, 0, -1):
            at = self._search(q, at, 1, level)
        return [i for _, i in self._search(q, at, max(ef, k), 0)[:k]]


def _lifted(x: np.ndarray, most: float) -> np.ndarray:
    """x with one more component that brings all rows to the squared length `most`."""
    out = np.empty((len(x), x.shape[1] + 1), np.float32)
    out[:, :-1] = x
    for s in range(0, len(x), 4096):
        y = x[s : s + 4096]
        out[s : s + 4096, -1] = np.sqrt(np.maximum(0, most - (y * y).sum(axis=1)))
    return out


GRAPH = "dim int, shard long, total long, at long, body binary"


def graph_pieces(g: Hnsw, x: np.ndarray, most: float, ids: bytes) -> Iterator[tuple[int, int, bytes]]:
    """(total, at, body): the bytes of a graph and its vectors, where they stand in all, a piece at a time."""
    head = np.array([len(x), x.shape[1], g.entry, g.top, *[a.shape[1] for a in g.links]], np.int64)
    parts = [memoryview(a).cast("B") for a in (np.array([len(head)], np.int64), head, np.array([most]), x.ravel(), np.frombuffer(ids, np.uint8), *[a.ravel() for a in g.links])]
    total, at = sum(map(len, parts)), 0
    for part in parts:
        for s in range(0, len(part), PIECE_BYTES):
            body = bytes(part[s : s + PIECE_BYTES])
            yield total, at, body
            at += len(body)


def graph_of(buffer: bytearray) -> tuple[Hnsw, np.ndarray, memoryview]:
    """The graph, its vectors and their ids, of all the bytes of graph_pieces(); only the vectors at one length are a copy."""
    heads = int(np.frombuffer(buffer, np.int64, 1)[0])
    n, dim, entry, top, *widths = np.frombuffer(buffer, np.int64, heads, 8).tolist()
    at = 8 + 8 * heads
    most = float(np.frombuffer(buffer, np.float64, 1, at)[0])
    x = np.frombuffer(buffer, np.float64, n * dim, at + 8).reshape(n, dim)
    at += 8 + 8 * n * dim
    ids, links = memoryview(buffer)[at : at + 32 * n], []
    at += 32 * n
    for width in widths:
        links.append(np.frombuffer(buffer, np.int32, n * width, at).reshape(n, width))
        at += 4 * n * width
    return Hnsw.stored(_lifted(x, most), links, entry, top), x, ids


def dealt_classes(classes: DataFrame, shard_rows: int | None) -> tuple[DataFrame, DataFrame]:
    """(dim, shard, class_id and v of all classes; dim and shards, the number of a dimension's shards).

    A shard has vectors whose squared lengths differ by a factor of two at
    most, as the component that makes lengths equal would else drown the
    others; vectors of such a range that are too many for a shard are dealt by
    hash. There is a row for each dimension and range, so at most some two
    thousand ranges of a dimension.
    """
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    sized = classes.select(F.size("v").alias("dim"), F.floor(F.log2(F.least(F.greatest(square, F.lit(1e-300)), F.lit(1e300))) + 0.5).alias("range"), "class_id", "v")
    room = F.lit(shard_rows) if shard_rows else F.greatest(F.lit(1024), F.floor(F.lit(SHARD_NUMBERS) / F.col("dim")))
    pieces = materialize(sized.groupBy("dim", "range").agg(F.count(F.lit(1)).alias("n")).select("dim", "range", F.ceil(F.col("n") / room).alias("pieces")), "ranges")
    before = F.sum("pieces").over(Window.partitionBy("dim").orderBy("range")) - F.col("pieces")
    dealt = sized.join(F.broadcast(pieces.withColumn("first", before)), ["dim", "range"])
    return dealt.select("dim", (F.col("first") + F.pmod(F.xxhash64("class_id"), F.col("pieces"))).cast("long").alias("shard"), "class_id", "v"), pieces.groupBy("dim").agg(F.sum("pieces").alias("shards"))


def rows_of(column: pa.Array, dim: int) -> np.ndarray:
    """Lists of `dim` doubles as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def shard_graphs(dealt: DataFrame) -> DataFrame:
    """A graph for each dimension and shard, in pieces (GRAPH); every class is in a graph."""
    fields = pa.schema([("dim", pa.int32()), ("shard", pa.int64()), ("total", pa.int64()), ("at", pa.int64()), ("body", pa.binary())])

    def build(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dim, shard = (k.as_py() for k in key)
        ids, parts = [], []
        for b in batches:
            ids += b["class_id"].to_pylist()
            parts.append(rows_of(b["v"], dim).copy())
        order = np.argsort(np.array(ids))
        ids, x = "".join([ids[i] for i in order.tolist()]).encode(), np.concatenate(parts)
        parts.clear()
        x = x[order]
        most = max(float((x[s : s + 4096] ** 2).sum(axis=1).max()) for s in range(0, len(x), 4096))
        g = Hnsw(_lifted(x, most))
        for total, at, body in graph_pieces(g, x, most, ids):
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((dim, shard, total, at, body), fields, strict=True)], schema=fields)

    return materialize(dealt.select("dim", "shard", "class_id", "v").groupBy("dim", "shard").applyInArrow(build, GRAPH), "graphs")


def graph_hits(graphs: DataFrame, asked: DataFrame, shards: DataFrame, k: int, ef: int, query_rows: int, blocks_per_task: int) -> DataFrame:
    """q, class_id and score of the k + 1 nearest found in each shard for each row (q, v, dim) of asked.

    Queries travel in blocks. A task of `blocks_per_task` blocks or more reads
    its graph once, whose pieces are the first rows of its sorted partition,
    and the blocks stream past it. A graph is copied for no more tasks than
    give each core `COPIES` of them, so that copies don't grow with queries.
    """
    blocks = max(1, -(-asked.count() // query_rows))
    packed = asked.groupBy("dim", F.pmod(F.xxhash64("q", F.lit(3)), F.lit(blocks)).alias("block")).agg(F.collect_list(F.struct("q", "v")).alias("qs"))
    number, cores = max(1, graphs.where("at = 0").count()), graphs.sparkSession.sparkContext.defaultParallelism
    splits = max(1, min(-(-blocks // blocks_per_task), -(-COPIES * cores // number)))
    empty = lambda kind, *names: [F.lit(None).cast(kind).alias(c) for c in names]
    first = graphs.select("dim", "shard", F.explode(F.sequence(F.lit(0), F.lit(splits - 1))).alias("split"), "total", "at", "body", *empty("array<struct<q:string,v:array<double>>>", "qs"))
    then = packed.join(F.broadcast(shards), "dim").select("dim", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shards").cast("long") - 1)).alias("shard"), F.pmod("block", F.lit(splits)).cast("int").alias("split"), *empty("long", "total", "at"), *empty("binary", "body"), "qs")
    at = ["dim", "shard", "split"]
    # hashed to more partitions than there are tasks, so that few get two
    dealt = first.unionByName(then).repartition(max(cores, 4 * number * splits), *at).sortWithinPartitions(*at, F.col("at").asc_nulls_last())
    fields = pa.schema([("q", pa.string()), ("class_id", pa.string()), ("score", pa.float64())])

    def search(batches):
        place, buffer, g, x, ids = None, None, None, None, None
        for rows in batches:
            keys = zip(*(rows[c].to_pylist() for c in (*at, "total", "at")), strict=True)
            for i, (*here, total, offset) in enumerate(keys):
                if offset is not None:
                    if offset == 0:
                        place, g, x, ids = here, None, None, None
                        buffer = bytearray(total)
                    body = memoryview(rows["body"][i].as_buffer())
                    buffer[offset : offset + len(body)] = body
                    continue
                if here != place:
                    continue  # no vector of this dimension is in the shard
                if g is None:
                    g, x, ids = graph_of(buffer)
                qs = rows["qs"][i].values
                q_out, c_out, s_out = [], [], []
                for q, v in zip(qs.field("q").to_pylist(), rows_of(qs.field("v"), here[0]), strict=True):
                    found = g.nearest(np.append(v, 0).astype(np.float32), k + 1, ef)
                    q_out += [q] * len(found)
                    c_out += [str(ids[32 * i : 32 * i + 32], "ascii") for i in found]
                    s_out += (x[found] * v).sum(axis=1).tolist()
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip((q_out, c_out, s_out), fields, strict=True)], schema=fields)

    return materialize(dealt.mapInArrow(search, "q string, class_id string, score double"), "hits")


def search_inner(vectors: DataFrame, queries, k: int = 20, shard_rows: int | None = None, query_rows: int = 128, blocks_per_task: int = 4, ef: int = 160) -> DataFrame:
    """query_id, rank, vec_id and score: the k largest inner products of each query found among all other rows.

    `queries` is a condition on vec_id. Equal vectors are one class; every
    class is in the graph of one of the shards, which are dealt by length and
    hash and hold about `shard_rows` classes (32 MB of vectors unless it is
    given).
    Graphs are built by one task each, stored as pieces of flat arrays in the
    shared folder, and searched by blocks of queries; the shards' results are merged
    by a top-k aggregate. Scores are computed in double precision from the
    original vectors. A class brings in its k + 1 smallest ids, as no more can
    rank.

    Equal scores rank by the smaller vec_id. Null, zero and non-finite
    vectors, those with null components and those without an id take no part.
    Vectors of other dimensions than a query's are no candidates of it. Of
    rows with equal id and vector one takes part. With fewer candidates than k
    there are fewer rows. Other columns are ignored; an empty table gives no
    rows.
    """
    small_batches(vectors.sparkSession)
    members, classes = vector_classes(vectors.where(F.col("vec_id").isNotNull()))
    members = members.distinct()
    dealt, shards = dealt_classes(classes, shard_rows)
    graphs = shard_graphs(dealt)
    asked = members.where(queries).join(classes.select("class_id", "v"), "class_id").select(F.col("class_id").alias("q"), "v").distinct().withColumn("dim", F.size("v"))
    hits = graph_hits(graphs, asked, shards, k, ef, query_rows, blocks_per_task)
    # rank() keeps all that tie with the last place: a class may have smaller ids than another of the same score
    ranked = hits.withColumn("r", F.rank().over(Window.partitionBy("q").orderBy(F.desc("score")))).where(F.col("r") <= k + 1)
    first = Window.partitionBy("class_id").orderBy("vec_id")
    few = members.join(hits.select("class_id").distinct(), "class_id", "left_semi").withColumn("o", F.row_number().over(first)).where(F.col("o") <= k + 1).drop("o")
    found = ranked.select("q", "class_id", "score").join(few, "class_id")
    # for each class of queries its k + 1 first rows serve all its queries, each without itself
    best = found.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "vec_id"))).where(F.col("r") <= k + 1).drop("r", "class_id")
    q_ids = members.where(queries).select(F.col("vec_id").alias("query_id"), F.col("class_id").alias("q"))
    out = q_ids.join(best, "q").where("query_id != vec_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return out.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op8_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """search_inner() of the embeddings whose vec_id is divisible by 20; nulls, ties, repeated rows and empty tables as stated there."""
    return search_inner(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
