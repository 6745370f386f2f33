"""Ranked search against a plain scorer of all documents, and the threshold algorithm's stop."""

import re
from collections import Counter
from math import floor, log

import numpy as np
import pytest

from cairn.llm import ranking

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
RNG = np.random.default_rng(13)
WORDS = ["".join(RNG.choice(list("abcdefghijk"), RNG.integers(1, 5))) for _ in range(150)]


def prose(n):
    return " ".join(RNG.choice(WORDS, n, p=(p := 1 / np.arange(1, 151)) / p.sum()))


def terms(t):
    return TERM.findall((t or "").translate(LOWER))


def brute(docs, items, k=10):
    own = [(d, Counter(terms(t))) for d, t in docs]
    n_docs, total = sum(1 for _, c in own if c), sum(sum(c.values()) for _, c in own)
    df = Counter(t for _, c in own for t in c)
    asked: dict = {}
    for i, t in items:
        asked.setdefault(i, set()).update(terms(t))
    out = set()
    for i, ts in asked.items():
        found = []
        for at, (d, c) in enumerate(own):
            n = sum(c.values())
            score = sum(floor(1000 * log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * (10 + 90 * n * n_docs // total))) for t in ts if t in c)
            if score > 0:
                found.append((-score, d is None, d or 0, at, d))
        out |= {(i, r, x[4], -x[0]) for r, x in enumerate(sorted(found)[:k], 1)}
    return out


DOCS = [(i if i % 17 else None, prose(int(RNG.integers(1, 300)))) for i in range(300)]
DOCS += [(1000 + i, DOCS[1][1]) for i in range(25)] + [(5, None), (5, ""), (5, "..."), (6, "Straße ÉTÉ été x_y-z 漢字。漢字"), (7, "zzz " * 4000)] + [DOCS[2]] * 3
ITEMS = [(1, prose(30)), (2, DOCS[1][1]), (3, None), (4, "!!"), (5, "nowhereatall"), (6, "straße Été 漢字。漢字 X y"), (7, "a a A zzz"), (8, prose(3)), (8, "zzz"), (None, prose(5))]


@pytest.mark.parametrize("block", [1_000_000, 20])
def test_ranks(spark, block):
    docs = spark.createDataFrame([(d, t, 1) for d, t in DOCS], "doc_id long, text string, score int").repartition(3)
    items = spark.createDataFrame([(i, t, 1) for i, t in ITEMS], "item_id long, text string, rank int")
    got = [tuple(r) for r in ranking.search_ranked(docs, items, block_terms=block).collect()]
    assert set(got) == brute(DOCS, ITEMS) and len(got) == len(set(got))


def test_stops_before_the_lists_end():
    rng = np.random.default_rng(1)
    n = 20_000
    counts = np.full(n, 3)
    terms_ = np.sort(np.array([rng.choice(5, 3, replace=False) for _ in range(n)]), axis=1).ravel()
    impacts = rng.integers(0, 1000, 3 * n)
    impacts[np.repeat(np.arange(n), 3) < 40] += 5000
    shard, asked, looked = ranking.Shard(np.arange(n), np.zeros(n, bool), counts, terms_, impacts, 5), np.array([True, True, False, True, False]), []
    whole = shard.scores(np.arange(n), asked)
    shard.scores = lambda docs, asked, f=shard.scores: looked.append(len(docs)) or f(docs, asked)
    docs, scores = shard.best(np.flatnonzero(asked), asked, 10)
    assert list(docs) == sorted(range(n), key=lambda i: (-whole[i], i))[:10] and list(scores) == [whole[i] for i in docs]
    assert sum(looked) < 1000


def test_nothing(spark):
    docs, items = spark.createDataFrame(DOCS, "doc_id long, text string"), spark.createDataFrame(ITEMS, "item_id long, text string")
    assert ranking.search_ranked(docs.limit(0), items).count() == 0
    assert ranking.search_ranked(docs, items.limit(0)).count() == 0
