"""Components and digests of graphs with cycles against plain reachability."""

import random

import pytest

from cairn.operators import digests


def reach(edges, nodes):
    out = {n: {n} for n in nodes}
    for _ in nodes:
        for s, t in edges:
            out[s] |= out[t]
    return out


@pytest.mark.parametrize(("seed", "n", "m"), [(1, 14, 16), (2, 20, 45), (3, 12, 6)])
def test_components(spark, seed, n, m):
    rng = random.Random(seed)
    nodes = [f"n{i:02d}" for i in range(n)]
    edges = [(rng.choice(nodes), rng.choice(nodes)) for _ in range(m)]
    r = reach(edges, nodes)
    want = {a: max(b for b in nodes if b in r[a] and a in r[b]) for a in nodes}
    got = digests.cycles(spark.createDataFrame([(x,) for x in nodes], "node string"), spark.createDataFrame(edges, "source string, target string")).collect()
    assert {x.node: x.component for x in got} == want and len(got) == n


def test_a_change_reaches_what_is_above_and_nothing_else(spark):
    edges = [("a", "b"), ("b", "c"), ("c", "b"), ("c", "d"), ("e", "d"), ("f", "a"), ("g", "h"), ("a", "outside"), ("d", "d")]
    nodes = sorted({x for e in edges for x in e} - {"outside"})
    r = reach([e for e in edges if e[1] != "outside"], nodes)
    links = spark.createDataFrame(edges, "source string, target string")

    def made(changed):
        files = spark.createDataFrame([(n, "new" if n == changed else n * 3) for n in nodes], "module string, digest string")
        return {x.module: x.digest for x in digests.dependency_digests(files, links).collect()}, {x.module: x.linked for x in digests.linked_digests(files, links).collect()}

    whole, linked = made(None)
    assert len(whole) == len(nodes) and whole["b"] == whole["c"] and len(set(whole.values())) == len(nodes) - 1
    for n in ("d", "b", "f"):
        after, after_linked = made(n)
        assert {x for x in nodes if after[x] != whole[x]} == {x for x in nodes if n in r[x]}
        assert {x for x in nodes if after_linked[x] != linked[x]} == {s for s, t in edges if t == n and s != t}


def test_nothing(spark):
    files, links = spark.createDataFrame([], "module string, digest string"), spark.createDataFrame([], "source string, target string")
    assert digests.dependency_digests(files, links).count() == 0
