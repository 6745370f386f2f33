"""Operator 11: bytes of long repeated strings, by a merge sort of suffix runs that knows common prefixes.

A window is a string of `size` bytes that starts somewhere in a document. Its
anchor is the place with the least hash of 16 bytes among the window's first
SPREAD places, so equal windows have their anchors at equal distances, and
windows that start next to each other mostly share one. What a task sorts are
the suffixes at anchors, each with the bytes before it that its windows reach.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm.common import BYTE, drop_table, materialize, mix64, small_batches, table, utf8_rows

#: Places among which an anchor is the least, and bytes that are hashed at a place.
SPREAD, GRAM = 256, 16
#: Classes with more different strings than this (13 MB of the longest) are cut into single windows, of which a run holds each once.
MOST_TEXTS = 20_000
#: Suffixes that a merging task gets on average, bytes of a sorted run, and starts hashed at a time.
TASK_SUFFIXES, RUN_BYTES, CHUNK = 6000, 32 << 20, 1 << 19
#: An odd multiplier and its inverse mod 2^64 turn prefix sums into hashes of substrings.
P = 0x9E3779B97F4A7C15 | 1
_powers: list[np.ndarray] = []

KEY = "id long, no_id boolean, t long"
KEYS = ["id", "no_id", "t"]


def row_key() -> list:
    """Tells rows apart that share a doc_id; equal rows share what is found for them."""
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("id"), F.col("doc_id").isNull().alias("no_id"), F.xxhash64("text").alias("t")]


class Substrings:
    """Hashes of any substrings of some bytes, by differences of prefix sums."""

    def __init__(self, data: np.ndarray):
        n = len(data) + 1
        if not _powers or len(_powers[0]) < n:
            _powers[:] = [np.multiply.accumulate(np.r_[np.uint64(1), np.full(n - 1, p, np.uint64)]) for p in (P, pow(P, -1, 1 << 64))]
        self.back = _powers[1]
        self.sums = np.zeros(n, np.uint64)
        np.cumsum(RAW[data] * _powers[0][: n - 1], out=self.sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix64((self.sums[end] - self.sums[start]) * self.back[start])


#: Unlike the values for words, upper and lower case differ here.
RAW = mix64(BYTE + np.arange(256, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))


def anchors(data: np.ndarray, ends: np.ndarray, starts: np.ndarray, size: int) -> Iterator[tuple[np.ndarray, ...]]:
    """lo, hi, anchor and two hashes of each run of windows that share an anchor.

    Windows start at lo to hi. The first hash is of the bytes that all windows
    of the anchor hold, the second of all bytes that this run covers. ends and
    starts bound the documents. Long inputs are hashed piece by piece, which
    may cut a run in two.
    """
    spread = min(SPREAD, size - GRAM + 1)
    core = size - spread + 1
    for at in range(0, max(0, len(data) - size + 1), CHUNK):
        part = data[at : at + CHUNK + size - 1]
        first = np.arange(len(part) - size + 1)
        owner = np.searchsorted(starts, first + at, "right") - 1
        fits = first + at + size <= ends[owner]
        if not fits.any():
            continue
        h = Substrings(part)
        places = np.arange(len(part) - GRAM + 1)
        least = (h(places, places + GRAM) >> np.uint64(32) << np.uint64(32)) | places.astype(np.uint64)
        step, have = 1, 1
        while have < spread:
            step = min(have, spread - have)
            least = np.minimum(least[:-step], least[step:])
            have += step
        anchor = (least[: len(first)] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        new = np.r_[True, (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1]) | (fits[1:] != fits[:-1])]
        lo = np.flatnonzero(new)
        hi = np.r_[lo[1:], len(first)] - 1
        lo, hi = lo[fits[lo]], hi[fits[lo]]
        a = anchor[lo]
        yield owner[lo], lo + at, hi + at, a + at, h(a, a + core), mix64(h(lo, hi + size) ^ ((a - hi) * 4096 + a - lo).astype(np.uint64))


def _batches(batches, columns: int):
    """The key columns, bytes and offsets of record batches whose last column is the text."""
    for b in batches:
        data, offsets = utf8_rows(b.column(columns))
        yield [b.column(i) for i in range(columns)], data, offsets


def anchor_table(docs: DataFrame, size: int) -> DataFrame:
    """KEY, lo, hi, a, core and whole: the runs of windows of all documents."""

    def runs(batches):
        import pyarrow as pa

        for keys, data, offsets in _batches(batches, 3):
            for owner, lo, hi, a, core, whole in anchors(data, offsets[1:], offsets[:-1], size):
                base = offsets[owner]
                numbers = [(lo - base).astype(np.int32), (hi - lo).astype(np.int32), (a - base).astype(np.int32), core.view(np.int64), whole.view(np.int64)]
                yield pa.RecordBatch.from_arrays([*[k.take(pa.array(owner)) for k in keys], *map(pa.array, numbers)], names=[*KEYS, "lo", "more", "a", "core", "whole"])

    return docs.select(*row_key(), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(runs, f"{KEY}, lo int, more int, a int, core long, whole long")


def listed(runs: DataFrame) -> DataFrame:
    """KEY and runs: one row for each document, equal rows once."""
    return runs.select(*KEYS, "lo", "hi", "a", "core").distinct().groupBy(*KEYS).agg(F.collect_list(F.struct("lo", "hi", "a", "core")).alias("runs"))


def with_runs(docs: DataFrame, runs: DataFrame) -> DataFrame:
    """KEY, runs and text of the documents that have any."""
    return docs.select(*row_key(), "text").join(listed(runs), KEYS).select(*KEYS, "runs", "text")


def window_hashes(docs: DataFrame, size: int) -> DataFrame:
    """KEY, a (a window's start) and core (its hash) for all windows of the listed runs."""

    def each(batches):
        import pyarrow as pa

        for b in batches:
            data, offsets = utf8_rows(b.column(4))
            lists = b.column(3)
            at, span = np.asarray(lists.offsets), lists.flatten()
            lo, hi = (np.asarray(span.field(i)).tolist() for i in (0, 1))
            for r in range(b.num_rows):
                mine = range(at[r] - at[0], at[r + 1] - at[0])
                starts = np.unique(np.concatenate([np.arange(lo[j], hi[j] + 1) for j in mine]))
                h = Substrings(data[offsets[r] : offsets[r + 1]])
                rows = pa.array(np.full(len(starts), r))
                yield pa.RecordBatch.from_arrays([*[b.column(i).take(rows) for i in range(3)], pa.array(starts.astype(np.int32)), pa.array(h(starts, starts + size).view(np.int64))], names=[*KEYS, "a", "core"])

    return docs.mapInArrow(each, f"{KEY}, a int, core long")


# ---- sorted runs -------------------------------------------------------------------------------


def common_prefix(x: bytes, y: bytes, at: int) -> int:
    """The length of the common prefix of x and y, which is known to be `at` or more."""
    most, step = min(len(x), len(y)), 8
    while at < most:
        if x[at : at + step] == y[at : at + step]:
            at += step
            step *= 2
        elif step == 1:
            return at
        else:
            step = max(1, step // 4)
    return most


def front_coded(texts: list[bytes]) -> tuple[np.ndarray, bytes]:
    """For sorted strings the length of each one's common prefix with the one before, and what follows the prefixes."""
    shared, tails, before = np.zeros(len(texts), np.int32), [], b""
    for i, x in enumerate(texts):
        k = common_prefix(before, x, 0)
        shared[i] = k
        tails.append(x[k:])
        before = x
    return shared, b"".join(tails)


class Run:
    """A sorted run that gives its strings one after another; `shared` is the known common prefix with the string that the merge gave last."""

    __slots__ = ("blocks", "i", "key", "number", "shared", "text")

    def __init__(self, blocks):
        self.blocks, self.text, self.shared, self.key = blocks, b"", 0, -1
        self.number = 0
        self.advance()

    def advance(self) -> None:
        x = next(self.blocks, None)
        if x is None:
            self.text = None
        else:
            self.shared, tail, self.key = x
            self.text = self.text[: self.shared] + tail


class LoserTree:
    """Merges sorted runs; matches begin where the common prefix of both players ends, so known bytes are never compared again."""

    def __init__(self, runs: list[Run]):
        self.k = 1 << max(0, (len(runs) - 1).bit_length())
        self.runs = runs + [None] * (self.k - len(runs))
        self.losers = [None] * self.k
        self.top = self._build(1)

    def _build(self, node: int):
        if node >= self.k:
            return self.runs[node - self.k]
        winner, self.losers[node] = self._match(self._build(2 * node), self._build(2 * node + 1))
        return winner

    @staticmethod
    def _match(x, y):
        """The winner and the loser. Both know what they share with the string given last; the one that shares more of it is smaller."""
        if x is None or x.text is None:
            return y, x
        if y is None or y.text is None:
            return x, y
        if x.shared != y.shared:
            return (x, y) if x.shared > y.shared else (y, x)
        k = common_prefix(x.text, y.text, x.shared)
        if x.text[k : k + 1] <= y.text[k : k + 1]:
            y.shared = k
            return x, y
        x.shared = k
        return y, x

    def __iter__(self):
        """(text, length of the prefix shared with the text before, key), in order."""
        for i, r in enumerate(self.runs):
            if r is not None:
                r.number = i
        while self.top is not None and self.top.text is not None:
            winner = self.top
            yield winner.text, winner.shared, winner.key
            node = (winner.number + self.k) >> 1
            winner.advance()
            while node:
                winner, self.losers[node] = self._match(winner, self.losers[node])
                node >>= 1
            self.top = winner


PIECES = "bucket int, run long, first int, shared binary, length binary, l0 binary, l1 binary, many binary, tails binary"
#: Rows of a piece have no number, those of a string's places no bucket.
RUN_ROWS = f"{PIECES}, number int, {KEY}, a int"


def sorted_runs(docs: DataFrame, size: int, buckets: int) -> DataFrame:
    """Front-coded pieces of sorted runs, and the places where each of their strings stands.

    A string holds the bytes from an anchor to the end of its last window and
    then, backwards, those before the anchor. Strings are dealt by the class of
    the anchor. Each task sorts what it reads, in runs of at most RUN_BYTES,
    and holds equal strings once.
    """

    def cut(batches):
        from pyspark import TaskContext

        seq, held, n = 0, {}, 0
        base = TaskContext.get().partitionId() << 24
        for b in batches:
            data, offsets = utf8_rows(b.column(4))
            lists = b.column(3)
            at, span = np.asarray(lists.offsets), lists.flatten()
            lo, hi, a, core = (np.asarray(span.field(i)).tolist() for i in range(4))
            ids = b.select(KEYS).to_pylist()
            for r in range(b.num_rows):
                text, key = data[offsets[r] : offsets[r + 1]].tobytes(), tuple(ids[r].values())
                for j in range(at[r] - at[0], at[r + 1] - at[0]):
                    x, y, z = lo[j], hi[j], a[j]
                    s = text[z : y + size] + text[x:z][::-1]
                    held.setdefault((core[j] % buckets, s, z - y, z - x), []).append((*key, z))
                    n += len(s) + 100
                if n > RUN_BYTES:
                    yield from written(held, base + seq)
                    seq, held, n = seq + 1, {}, 0
        yield from written(held, base + seq)

    def written(held: dict, run: int):
        order = sorted(held)
        out = []
        for first in range(0, len(order), 500):
            part = order[first : first + 500]
            edges = [0, *[i for i in range(1, len(part)) if part[i][0] != part[i - 1][0]], len(part)]
            for i, j in zip(edges, edges[1:], strict=False):
                own = part[i:j]
                shared, tails = front_coded([x[1] for x in own])
                numbers = [np.array(v, np.int32).tobytes() for v in ([len(x[1]) for x in own], [x[2] for x in own], [x[3] for x in own])]
                many = np.array([len(held[x]) > 1 for x in own], np.int8).tobytes()
                out.append((own[0][0], run, first + i, shared.tobytes(), *numbers, many, tails) + (None,) * 5)
        names = [c.split()[0] for c in RUN_ROWS.split(", ")]
        if out:
            yield pd.DataFrame(out, columns=names)
        members = [(None, run, *(None,) * 7, k, *m) for k, x in enumerate(order) for m in set(held[x])]
        for i in range(0, len(members), 10_000):
            yield pd.DataFrame(members[i : i + 10_000], columns=names).astype({"id": "int64", "t": "int64", "no_id": bool, "a": "int32", "number": "int32"})

    def frames(batches):
        import pyarrow as pa

        kind = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_()}
        schema = pa.schema([(c.split()[0], kind[c.split()[1]]) for c in RUN_ROWS.split(", ")])
        for f in cut(batches):
            yield pa.RecordBatch.from_pandas(f, schema=schema, preserve_index=False)

    return docs.mapInArrow(frames, RUN_ROWS)


def repeated_windows(texts: list[bytes], shared: np.ndarray, l0: np.ndarray, l1: np.ndarray, many: np.ndarray, size: int) -> np.ndarray:
    """For each string and distance l of a window from its anchor, whether the window stands elsewhere too.

    The strings are sorted, so windows of distance l with equal bytes after
    their anchors are neighbours; a second order of the bytes before the
    anchors does the same for those. Two windows are equal if both agree.
    """
    n = len(texts)
    most = int(l1.max()) + 1 if n else 0
    out = np.zeros((n, most), bool)
    backs = [x[size - k :] for x, k in zip(texts, l0.tolist(), strict=True)]
    order = np.array(sorted(range(n), key=backs.__getitem__), np.int64)
    before = np.array([0, *[common_prefix(backs[i], backs[j], 0) for i, j in zip(order[:-1].tolist(), order[1:].tolist(), strict=True)]], np.int64)
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    for d in range(most):
        own = np.flatnonzero((l0 <= d) & (d <= l1))
        if len(own):
            forward, backward = np.cumsum(shared < size - d)[own], np.cumsum(before < d)[rank[own]]
            _, of, count = np.unique(forward * (n + 1) + backward, return_inverse=True, return_counts=True)
            out[own, d] = (count[of] > 1) | many[own]
    return out


def merged(pieces: DataFrame, size: int) -> DataFrame:
    """run, number, from and to: for each string of a run the distances from its anchor at which windows repeat."""

    def pulled(rows):
        for r in rows:
            shared, length = (np.frombuffer(r[c], np.int32) for c in ("shared", "length"))
            ends = np.cumsum(length - shared)
            numbers = zip(shared.tolist(), [0, *ends[:-1].tolist()], ends.tolist(), np.frombuffer(r["l0"], np.int32).tolist(), np.frombuffer(r["l1"], np.int32).tolist(), np.frombuffer(r["many"], np.int8).tolist(), strict=True)
            first = True
            for i, (k, x, y, l0, l1, many) in enumerate(numbers):
                # a piece begins anew: its first string is whole
                yield (0 if first else k), r["tails"][x:y], (r["run"], r["first"] + i, l0, l1, many)
                first = False

    def rejoined(rows):
        """The strings of a run's pieces, each with what it shares with the one before."""
        text = b""
        for k, tail, key in pulled(rows):
            now = text[:k] + tail
            if k == 0:
                k = common_prefix(text, now, 0)
                tail = now[k:]
            yield k, tail, key
            text = now

    def merge(frame: pd.DataFrame) -> pd.DataFrame:
        runs = [Run(iter(rejoined(g.sort_values("first").to_dict("records")))) for _, g in frame.groupby("run")]
        texts, shared, l0, l1, many, of = [], [], [], [], [], []
        for text, k, (run, number, a, b, more) in LoserTree(runs):
            if texts and k == len(text) == len(texts[-1]) and a == l0[-1]:
                many[-1] = True
                of[-1].append((run, number))
            else:
                texts.append(text)
                shared.append(k)
                l0.append(a)
                l1.append(b)
                many.append(bool(more))
                of.append([(run, number)])
        hits = repeated_windows(texts, np.array(shared, np.int64), np.array(l0, np.int64), np.array(l1, np.int64), np.array(many, bool), size)
        edge = np.diff(np.pad(hits.astype(np.int8), ((0, 0), (1, 1))), axis=1)
        begins, ends = np.argwhere(edge == 1), np.argwhere(edge == -1)  # as many of each, in the same order
        rows = [(*place, x, y - 1) for (i, x), (_, y) in zip(begins.tolist(), ends.tolist(), strict=True) for place in of[i]]
        return pd.DataFrame(rows, columns=["run", "number", "from", "to"]).astype({"run": "int64", "number": "int32", "from": "int32", "to": "int32"})

    return pieces.groupBy("bucket").applyInPandas(merge, "run long, number int, from int, to int")


def repeated_spans(docs: DataFrame, size: int = 400, most_texts: int = MOST_TEXTS) -> DataFrame:
    """KEY and spans (start, past) of bytes that windows standing elsewhere too cover; spans may overlap.

    Windows are told apart by the class of their anchor (a hash of the bytes
    that all its windows hold); a class of one string holds no repeat. Classes
    of many different strings are cut into single windows, so that each run
    has every string of them once however many documents hold it.
    """
    small_batches(docs.sparkSession)
    shuffles = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    runs = materialize(anchor_table(docs, size), "anchors")
    classes = runs.groupBy("core", "whole").agg(F.count(F.lit(1)).alias("n")).groupBy("core").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("texts")).where("n > 1")
    classes = materialize(classes, "classes")
    found = runs.join(classes, "core").select(*KEYS, "lo", (F.col("lo") + F.col("more")).alias("hi"), "a", "core", (F.col("texts") > most_texts).alias("hot"))
    found = materialize(found, "found")
    drop_table(runs)
    drop_table(classes)
    chosen = found.where("not hot").drop("hot")
    n = found.count()
    if found.where("hot").limit(1).count():
        single = materialize(window_hashes(with_runs(docs, found.where("hot")), size), "windows")
        twice = single.groupBy("core").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("core")
        single = single.join(twice, "core").select(*KEYS, F.col("a").alias("lo"), F.col("a").alias("hi"), "a", "core")
        chosen = chosen.unionByName(single)
    buckets = max(shuffles, -(-n // TASK_SUFFIXES))
    sorted_ = materialize(sorted_runs(with_runs(docs, chosen), size, buckets), "runs")
    drop_table(found)
    hits = merged(sorted_.where("bucket is not null").select(*[c.split()[0] for c in PIECES.split(", ")]), size)
    members = sorted_.where("bucket is null").select("run", "number", *KEYS, "a")
    spans = members.join(hits, ["run", "number"]).select(*KEYS, F.struct((F.col("a") - F.col("to")).alias("start"), (F.col("a") - F.col("from") + size).alias("past")).alias("span"))
    return materialize(spans.distinct().groupBy(*KEYS).agg(F.collect_list("span").alias("spans")), "spans")


def without_repeats(docs: DataFrame, size: int = 400, most_texts: int = MOST_TEXTS) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept (the remaining bytes) of every row of docs.

    A byte goes if a string of `size` bytes that covers it also starts
    anywhere else in the table. Null and empty texts have no bytes. Texts of
    repeated rows repeat each other, so both go; rows that share a doc_id, and
    rows without one, are documents of their own. Other columns are ignored;
    an empty table gives no rows.
    """
    spans = repeated_spans(docs, size, most_texts)
    joined = docs.select("doc_id", *row_key(), F.coalesce("text", F.lit("")).alias("text")).join(spans, KEYS, "left").select("doc_id", "spans", "text")

    def cut(batches):
        import pyarrow as pa

        for b in batches:
            data, offsets = utf8_rows(b.column(2))
            removed, counts, kept = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows, np.int64), []
            for r, spans in enumerate(b.column(1).to_pylist()):
                text = data[offsets[r] : offsets[r + 1]].tobytes()
                if spans:
                    parts, at = [], 0
                    past = None
                    for x, y in sorted((s["start"], s["past"]) for s in spans):
                        if past is None or x > past:
                            if past is not None:
                                at = past
                            parts.append(text[at:x])
                            counts[r] += 1
                            past = y
                        else:
                            past = max(past, y)
                    parts.append(text[past:])
                    text = b"".join(parts)
                removed[r] = offsets[r + 1] - offsets[r] - len(text)
                kept.append(text)
            sha = pa.array([hashlib.sha256(k).hexdigest() for k in kept])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.diff(offsets)), pa.array(removed), pa.array(counts), sha, pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return joined.mapInArrow(cut, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def op11_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """without_repeats() of all documents, texts as hashes; nulls, ties, repeated rows and empty tables as stated there."""
    return without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("kept")
