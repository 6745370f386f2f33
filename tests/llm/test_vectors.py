"""Embedding operators on large groups, dense topics, ties and repeated rows, against brute force."""

import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairn.llm import neighbours, vectors


def unit(x):
    return x / np.linalg.norm(x, axis=-1, keepdims=True)


def around(centres, degrees, rng):
    """One vector at `degrees` from each centre."""
    e = rng.standard_normal(centres.shape)
    e = unit(e - (e * centres).sum(1, keepdims=True) * centres)
    a = np.radians(degrees)[:, None]
    return np.cos(a) * centres + np.sin(a) * e


def scene(rng, copies, topic, pairs, dims=64):
    """Near copies of one vector, a topic of mutual cosine about 0.85, and pairs at cosine 0.95 to 0.96 in and outside of it."""
    one = unit(rng.standard_normal((1, dims)))
    about = around(np.repeat(unit(rng.standard_normal((1, dims))), topic, 0), np.full(topic, 22.8), rng)
    lone = unit(rng.standard_normal((pairs, dims)))
    border = lambda x: around(x, np.degrees(np.arccos(rng.uniform(0.9501, 0.96, len(x)))), rng)
    x = np.vstack([around(np.repeat(one, copies, 0), rng.uniform(0, 12.5, copies), rng), about, border(about[:pairs]), lone, border(lone)])
    return x[rng.permutation(len(x))].astype(np.float32)


def frame(spark, x):
    return spark.createDataFrame([(i, v.tolist(), "c", "p") for i, v in enumerate(x)], "vec_id long, embedding array<float>, class_id string, pass string").repartition(4)


def truth(x):
    u = unit(x.astype(np.float64))
    near = u @ u.T >= 0.95
    np.fill_diagonal(near, False)
    return near, vectors.local_roots(len(x), *np.nonzero(near))


def test_all_links_of_a_large_group(spark):
    x = scene(np.random.default_rng(4), 4000, 1000, 150)
    near, root = truth(x)
    got = {r.vec_id: r for r in vectors.near_vectors(frame(spark, x)).collect()}
    assert [got[i].n_links for i in range(len(x))] == near.sum(1).tolist()
    assert np.mean([got[i].component_id == root[i] for i in range(len(x))]) >= 0.999


def test_tiles_of_components_and_of_prefixes(spark):
    """Blocks so small that components, steps of angle and prefixes all span several tiles; repeated and null ids and equal vectors."""
    x = scene(np.random.default_rng(5), 500, 900, 60)
    x = np.vstack([x, x[:40], x[:1].repeat(30, 0)])
    near, root = truth(x)
    df = frame(spark, x).unionByName(spark.createDataFrame([(3, x[3].tolist(), "c", "p"), (None, x[3].tolist(), "c", "p")], "vec_id long, embedding array<float>, class_id string, pass string"))
    rows = vectors.near_vectors(df, window=8, block=128).collect()
    got = {r.vec_id: r for r in rows}
    twice = near[:, 3] | (np.arange(len(x)) == 3)  # links with the two rows added
    assert len(rows) == len(x) + 2 and got[None].component_id == root[3] and not got[None].kept
    assert [got[i].n_links for i in range(len(x))] == (near.sum(1) + 2 * twice).tolist()
    assert [got[i].component_id for i in range(len(x))] == root.tolist()


def unequal(kind):
    rng = np.random.default_rng(9)
    x = rng.standard_normal((6000, 64))
    if kind == "mixed":  # unit vectors, and a sixth of random ones that are eight times as long
        x[:5000] /= np.linalg.norm(x[:5000], axis=1, keepdims=True)
        return x[rng.permutation(6000)].astype(np.float32)
    return (x / np.linalg.norm(x, axis=1, keepdims=True) * rng.lognormal(0, 1, (6000, 1))).astype(np.float32)


@pytest.mark.parametrize("kind", ["scene", "mixed", "lognormal"])
def test_nearest_over_shards(spark, kind):
    x = scene(np.random.default_rng(6), 600, 1500, 300) if kind == "scene" else unequal(kind)
    got: dict = {}
    for r in neighbours.search_inner(frame(spark, x), F.col("vec_id") % 20 == 0, shard_rows=700 if kind == "scene" else 3000).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    u, hits = x.astype(np.float64), 0
    for q in range(0, len(x), 20):
        s = u @ u[q]
        s[q] = -np.inf
        assert len(got[q]) == 20 and all(abs(s[i] - v) < 1e-12 for i, v in got[q])
        hits += len(set(np.argsort(-s)[:20].tolist()) & {i for i, _ in got[q]})
    assert hits >= 0.95 * 20 * len(got) and len(got) == len(range(0, len(x), 20))


def test_nearest_ties_and_repeated_rows(spark):
    """Equal scores rank by the smaller vec_id; rows of one id and vector are one; a row without an id takes no part."""
    x = np.random.default_rng(7).standard_normal((40, 8)).astype(np.float32)
    rows = [(i, x[0 if i < 60 else i - 60].tolist()) for i in range(100)]
    df = spark.createDataFrame([*rows, *rows[:30], (None, x[0].tolist()), (20, None)], "vec_id long, embedding array<float>").repartition(3)
    got: dict = {}
    for r in neighbours.search_inner(df, F.col("vec_id") % 20 == 0, k=20, shard_rows=16).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    best = [i for i in np.lexsort((np.arange(100), -np.array([np.dot(np.float64(v), np.float64(rows[0][1])) for _, v in rows]))).tolist()]
    for q in (0, 20, 40):
        assert got[q] == [i for i in best if i != q][:20]


def test_graphs_travel_in_pieces(spark):
    """A stored graph has no large row and is the same when put together; building one keeps blocks of distances small."""
    x = np.random.default_rng(8).standard_normal((700, 16)).astype(np.float32)
    _, classes = vectors.vector_classes(frame(spark, x))
    dealt, _ = neighbours.dealt_classes(classes, 5000)
    v = {r.class_id: r.v for r in classes.collect()}
    shards: dict = {}
    for r in neighbours.shard_graphs(dealt).collect():
        assert len(r.body) <= 1 << 16
        shards.setdefault(r.shard, bytearray(r.total))[r.at : r.at + len(r.body)] = r.body
    seen = []
    for buffer in shards.values():
        g, y, ids = neighbours.graph_of(buffer)
        names = [str(ids[32 * i : 32 * i + 32], "ascii") for i in range(len(y))]
        assert (y == np.array([v[c] for c in names])).all()
        own = neighbours.Hnsw(neighbours._lifted(y, float((y * y).sum(axis=1).max())))
        assert (g.entry, g.top) == (own.entry, own.top) and all((a == b).all() for a, b in zip(g.links, own.links, strict=True))
        seen += names
    assert sorted(seen) == sorted(v) and max(map(len, shards.values())) > 2 * neighbours.PIECE_BYTES

    big = np.random.default_rng(9).standard_normal((20_000, 65)).astype(np.float32)
    tracemalloc.start()
    neighbours.Hnsw(big)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 150e6
