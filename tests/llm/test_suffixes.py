"""Removal of repeated strings against brute force over all windows, and the merge of sorted runs."""

import hashlib
from collections import Counter

import numpy as np
import pytest

from cairn.llm import suffixes

RNG = np.random.default_rng(11)
WORDS = ["".join(RNG.choice(list("abcdefghij"), RNG.integers(2, 8))) for _ in range(300)]


def prose(n):
    return " ".join(RNG.choice(WORDS, n))


def brute(texts, size):
    texts = [(t or "").encode() for t in texts]
    seen = Counter(t[i : i + size] for t in texts for i in range(len(t) - size + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - size + 1):
            if seen[t[i : i + size]] > 1:
                gone[i : i + size] = True
        kept = bytes(np.frombuffer(t, np.uint8)[~gone])
        out.append((len(t), int(gone.sum()), int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


PASSAGE, LONG, SHORT = prose(90), prose(400), prose(70)[:399]
COPY = prose(200)
EDITED = COPY[:700] + "EDIT" + COPY[700:]
TEXTS = [
    None, "", " ", "short", COPY, COPY, EDITED, COPY[3:], PASSAGE, f"{prose(50)} {PASSAGE} {prose(70)}", f"{prose(9)}|{PASSAGE}|{prose(30)}", f"{SHORT}|{prose(40)}", f"{prose(20)}!{SHORT}",
    "a" * 1500, "ab" * 300, f"{prose(30)} {prose(100)[:0]}{LONG}", LONG[500:1400] + prose(60), LONG[:450] + LONG[1200:1700], prose(20) + "é漢字" * 120, "é漢字" * 50 + prose(10), f"{PASSAGE} {prose(20)} {PASSAGE} {prose(20)}",
    "x\x00y" * 200, "\x00" * 450, prose(3000),
] + [f"{prose(25)} {PASSAGE[:460]} {prose(25)}" for _ in range(30)]


@pytest.fixture(scope="module")
def rows():
    return [(i if i % 9 else None, t, i) for i, t in enumerate(TEXTS)] + [(4, COPY, -1), (4, "another text of a repeated id", -2)]


@pytest.mark.parametrize(("size", "most"), [(400, 1000), (400, 3), (40, 2), (16, 1000)])
def test_all_windows(spark, rows, size, most):
    df = spark.createDataFrame(rows, "doc_id long, text string, span int").repartition(3)
    want = Counter(zip([r[0] for r in rows], *zip(*brute([r[1] for r in rows], size), strict=True), strict=True))
    got = Counter(tuple(r) for r in suffixes.without_repeats(df, size, most).drop("kept").collect())
    assert got == want


def test_kept_bytes(spark, rows):
    kept = suffixes.without_repeats(spark.createDataFrame(rows, "doc_id long, text string, span int")).collect()
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 and len(r.kept) == r.n_bytes - r.n_removed for r in kept)


def test_nothing(spark):
    assert suffixes.without_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert [tuple(r)[1:4] for r in suffixes.without_repeats(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")).collect()] == [(0, 0, 0)] * 2


def test_long_texts_are_hashed_in_pieces(spark, monkeypatch):
    text = (prose(40_000) + COPY).encode()
    data, ends = np.frombuffer(text, np.uint8), np.array([len(text)])
    runs = [(lo, hi, a) for _, los, his, places, *_ in suffixes.anchors(data, ends, ends * 0, 400) for lo, hi, a in zip(los, his, places, strict=True)]
    monkeypatch.setattr(suffixes, "CHUNK", 1000)
    pieces = [(lo, hi, a) for _, los, his, places, *_ in suffixes.anchors(data, ends, ends * 0, 400) for lo, hi, a in zip(los, his, places, strict=True)]
    owners = [{i: a for lo, hi, a in some for i in range(lo, hi + 1)} for some in (runs, pieces)]
    assert owners[0] == owners[1] and len(owners[0]) == len(text) - 399


@pytest.mark.parametrize("k", [1, 2, 3, 5, 8])
def test_merge(k):
    rng = np.random.default_rng(k)
    texts = [bytes(rng.choice([0, 97, 98], rng.integers(0, 12)).astype(np.uint8)) for _ in range(300)]
    runs = [sorted(texts[i::k]) for i in range(k)]

    def coded(run):
        shared, tails = suffixes.front_coded(run)
        at = 0
        for n, x in zip(shared.tolist(), run, strict=True):
            yield n, tails[at : at + len(x) - n], x
            at += len(x) - n

    got = list(suffixes.LoserTree([suffixes.Run(coded(r)) for r in runs]))
    assert [t for t, _, _ in got] == sorted(texts) and all(t == key for t, _, key in got)
    assert [n for _, n, _ in got] == suffixes.front_coded(sorted(texts))[0].tolist()
