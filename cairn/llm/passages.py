"""Operator 5: repeated passages, by MinHash banding of paragraphs with exact verification."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairn.llm.common import P_WORD, WORD, drop_table, materialize, mix64, small_batches, table, utf8_rows, word_hashes
from cairn.llm.components import star_roots

#: Words of a passage; words in a row that may differ inside it, the share of all its words, and the equal words on each side of them.
PASSAGE, GAP, GAP_SHARE, ANCHOR = 51, 2, 0.1, 8
#: A paragraph is PARAGRAPH shingles of KEY words, ten words, and its band is their MinHash. Of a passage with at most a
#: tenth of differing words, in runs of ANCHOR equal ones or more, one run has ten words: it holds a whole paragraph.
KEY, PARAGRAPH = 6, 5
#: Shingles of a short paragraph: ANCHOR words, so that each run of a passage holds a whole one.
SHORT = ANCHOR - KEY + 1
#: In each text of a passage the places of short paragraphs, the same in both, follow each other after at most STEP words and
#: spread over SPAN: the first is within SHORT words of the first run's start, the last within ANCHOR of the last run's end.
STEP = GAP + ANCHOR + SHORT - 1
SPAN = PASSAGE - int(PASSAGE * GAP_SHARE) - ANCHOR - SHORT + 1
#: Words of a stretch in which a few words repeat that one place stands for.
STRETCH = 8
#: Bytes of text that are hashed at a time.
HASH_BYTES = 4 << 20
#: Leaders that the members of a bucket are held against in turn, and members left over that are compared pairwise.
LEADERS, FEW = 2, 16
#: Words around a shingle of which four bits each travel with it: a paragraph has so many words besides its shingle.
AROUND = PARAGRAPH - 1
#: Words between two shingles that make a bucket together: a paragraph at least, and within the side of a passage.
NEAR, FAR = 10, 30


def _rolling(words: np.ndarray, size: int) -> np.ndarray:
    out = np.zeros(max(0, len(words) - size + 1), np.uint64)
    for j in range(size):
        out += words[j : j + len(out)] * np.uint64(pow(P_WORD, j, 1 << 64))
    return mix64(out)


def paragraph_minima(shingles: np.ndarray, size: int = PARAGRAPH, starts: np.ndarray | None = None) -> np.ndarray:
    """The places of the least shingle of each paragraph, the last of equal ones; a paragraph starts at every word, or where starts is true."""
    n = len(shingles) - size + 1
    if n < 1:
        return np.zeros(0, np.int64)
    least, at = shingles[size - 1 :].copy(), np.arange(size - 1, len(shingles))
    for k in range(size - 2, -1, -1):
        less = np.flatnonzero(shingles[k : k + n] < least)
        least[less] = shingles[less + k]
        at[less] = less + k
    kept = np.zeros(len(shingles), bool)
    kept[at if starts is None else at[starts[:n]]] = True
    return np.flatnonzero(kept)


def in_stretches(shingles: np.ndarray, at: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which places are in a stretch, and which of all places stand for it.

    A stretch is places with one shingle that overlap: its words are a few
    that repeat. Its first and last place stand for it, and one for each
    STRETCH words, so that they still follow each other after STEP words.
    number has the places' numbers in their own texts.
    """
    if not len(at):
        return np.zeros(0, bool), np.zeros(0, bool)
    same = (shingles[at[1:]] == shingles[at[:-1]]) & (np.diff(at) < PARAGRAPH)
    before, after = np.r_[False, same], np.r_[same, False]
    return before | after, ~(before & after) | np.r_[True, number[1:] // STRETCH != number[:-1] // STRETCH]


def hashed(column):
    """first row, word hashes and the rows' first words in them, of at most HASH_BYTES of texts at a time (or one text)."""
    data, offsets = utf8_rows(column)
    lo = 0
    while lo < len(offsets) - 1:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + HASH_BYTES, "right")) - 1)
        words, first, _, _ = word_hashes(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        yield lo, words, first
        lo = hi


def words_around(words: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Four bits of each of the AROUND words before (the nearest lowest) and after a shingle, in 32 bits."""
    bits = np.zeros(len(words) + 2 * AROUND, np.uint32)
    bits[AROUND : AROUND + len(words)] = words & np.uint64(15)
    out = np.zeros(len(at), np.uint32)
    for i in range(AROUND):
        out |= bits[at + AROUND - 1 - i] << np.uint32(4 * i) | bits[at + AROUND + KEY + i] << np.uint32(16 + 4 * i)
    return out.view(np.int32)


def _meets(a, b):
    """Whether the words around two equal shingles allow a common paragraph: some before, the others after."""
    differ = a.cast("long").bitwiseXOR(b.cast("long"))
    masks = [(1 << 4 * k) - 1 | ((1 << 4 * (AROUND - k)) - 1) << 16 for k in range(AROUND + 1)]
    # places in a stretch have no words around them: one place stands for several
    return F.coalesce(reduce(lambda x, y: x | y, [differ.bitwiseAND(F.lit(m).cast("long")) == 0 for m in masks]), F.lit(True))


def runs_on(a: np.ndarray, b: np.ndarray, diagonals: list[int]) -> list[tuple[int, int, int]]:
    """(start in a, end in a, start in b) of the runs of ANCHOR equal words or more on each diagonal, compared word by word."""
    out = []
    for d in sorted(set(diagonals)):
        lo, hi = max(0, d), min(len(a), len(b) + d)
        same = a[lo:hi] == b[lo - d : hi - d]
        for s, e in np.flatnonzero(np.diff(np.concatenate([[0], same.view(np.int8), [0]]))).reshape(-1, 2).tolist():
            if e - s >= ANCHOR:
                out.append((lo + s, lo + e, lo + s - d))
    return out


def chained(runs: list[tuple[int, int, int]]) -> list[list[tuple[int, int, int]]]:
    """Chains of runs that are passages: their edit distance is verified inside a band of GAP words.

    The next run of a chain follows after at most GAP words of either text,
    which are substituted, inserted or deleted; the edits of a chain stay
    under GAP_SHARE of its words. A run that begins inside the one before, as
    a repeated word at an insertion makes it, counts from there on.
    """
    last: dict[int, list] = {}  # diagonal -> [runs, edits] of the chain that ends on it
    chains = []
    for s, e, ls in sorted(runs, key=lambda r: (r[0], -r[1], r[2])):
        best = None
        for d in range(s - ls - GAP, s - ls + GAP + 1):
            if d in last:
                chain, edits = last[d]
                fs, fe, fl = chain[-1]
                gap, lgap = s - fe, ls - (fl + fe - fs)
                over = max(0, -gap, -lgap)
                new = edits + max(gap + over, lgap + over)
                if max(gap, lgap) <= GAP and e - s - over >= ANCHOR and s > fs and new <= GAP_SHARE * (e - chain[0][0]) and (best is None or (new, -chain[0][0]) < best[:2]):
                    best = (new, -chain[0][0], d, over)
        if best is None:
            chain = [[(s, e, ls)], 0]
        else:
            new, _, d, over = best
            chain = [[*last[d][0], (s + over, e, ls + over)], new]
        last[s - ls] = chain
        chains.append(chain)
    return [c for c, _ in chains if c[-1][1] - c[0][0] >= PASSAGE]


def common_runs(a: np.ndarray, b: np.ndarray, pairs: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """(start in a, end in a, start in b) of the passages that a and b share on the diagonals of colliding paragraphs."""
    return [(c[0][0], c[-1][1], c[0][2]) for c in chained(runs_on(a, b, [x - y for x, y in pairs]))]


def _key() -> list:
    """doc_id (a null one has a number of its own) and a hash of the text."""
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("d"), F.xxhash64("text").alias("t")]


def text_places(words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, ...]:
    """row, place, key and the words around it of each MinHash of a short paragraph, in texts long enough for a passage.

    place is four times the number of the first word, two more in a stretch,
    and one more where the shingle is the MinHash of a whole paragraph, too.
    """
    h = _rolling(words, KEY)
    n = np.diff(first)
    # words from a place to its text's end; none count in short texts
    rest = np.where(np.repeat(n, n) > SPAN + ANCHOR, np.repeat(first[1:], n) - np.arange(len(words)), 0)
    short, whole = (paragraph_minima(h, size, rest >= KEY + size - 1) for size in (SHORT, PARAGRAPH))
    kind, stays = np.zeros(len(h), np.int64), np.zeros(len(h), bool)
    kind[whole] = 1
    for of in (short, whole):
        stretch, stand = in_stretches(h, of, of - first[np.searchsorted(first, of, "right") - 1])
        kind[of[stretch]] |= 2
        stays[of[stand]] = True
    at = np.flatnonzero(stays)
    row = np.searchsorted(first, at, "right") - 1
    return row, (4 * (at - first[row]) + kind[at]).astype(np.int32), h[at], words_around(words, at)


def _held_twice(bucket: np.ndarray, *owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order of buckets, where each begins in it, and which of them have different owners."""
    order = np.argsort(bucket, kind="stable")
    k = bucket[order]
    begin = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
    return order, begin, np.any([np.minimum.reduceat(o[order], begin) != np.maximum.reduceat(o[order], begin) for o in owner], axis=0)


#: What travels of places, as arrays in bytes, and the bytes of text whose places meet in one part.
PLACE, PART_BYTES = {"d": np.int64, "t": np.int64, "place": np.int32, "bucket": np.uint64, "around": np.int32}, 12 << 20


def common_places(docs: DataFrame) -> DataFrame:
    """d, t, place, bucket and around of the places whose shingle another document has, in texts long enough for a passage.

    Places meet in parts by their bucket. What two texts of a batch share is
    known there: these places go on by themselves, and one row of each of
    their buckets tells the others, so that no part gets a frequent bucket whole.
    """
    small_batches(docs.sparkSession)
    parts = max(1, (docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // PART_BYTES)

    def sealed(cols):
        """The columns as bytes; only places of whole paragraphs outside of stretches need the words around them."""
        return [c.tobytes() for c in (*cols[:4], cols[4][cols[2] & 3 == 1])]

    def dealt(batches):
        import pyarrow as pa

        for batch in batches:
            ids = [batch.column(k).to_numpy() for k in (0, 1)]
            for row0, words, first in hashed(batch.column(2)):
                row, place, bucket, around = text_places(words, first)
                if not len(row):
                    continue
                row += row0
                order, begin, twice = _held_twice(bucket, row)
                sure = np.zeros(len(row), bool)
                sure[order] = np.repeat(twice, np.diff(np.r_[begin, len(row)]))
                tells = order[begin[twice]]
                send = np.r_[np.flatnonzero(~sure), tells]
                part = ((bucket[send] >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int32)
                by = np.argsort(part, kind="stable")
                cols = [*(x[row] for x in ids), place, bucket, around]
                sent = [c[send] for c in cols]
                sent[2][len(send) - len(tells) :] = -1
                sent = [c[by] for c in sent]
                number, at = np.unique(part[by], return_index=True)
                pieces = [slice(a, b) for a, b in zip(at, np.r_[at[1:], len(by)], strict=True)]
                alone = [c[sure] for c in cols]
                own = -1 - int(ids[0][row[0]]) % parts
                yield pa.RecordBatch.from_arrays([pa.array([*number.tolist(), own], pa.int32()), *[pa.array(list(c), pa.binary()) for c in zip(*[sealed([c[p] for c in sent]) for p in pieces], sealed(alone), strict=True)]], ["part", *PLACE])

    def meet(table):
        import pyarrow as pa

        cols = {c: np.frombuffer(b"".join(table.column(c).to_pylist()), kind) for c, kind in PLACE.items()}
        around = np.zeros(len(cols["place"]), np.int32)
        around[cols["place"] & 3 == 1] = cols["around"]
        cols["around"] = around
        stays = cols["place"] >= 0
        if table.column("part")[0].as_py() >= 0:
            order, begin, twice = _held_twice(cols["bucket"], cols["d"], cols["t"])
            stays[order] &= np.repeat(twice, np.diff(np.r_[begin, len(order)]))
        return pa.table({c: (v.view(np.int64) if c == "bucket" else v)[stays] for c, v in cols.items()})

    packed = docs.select("d", "t", "text").mapInArrow(dealt, f"part int, {', '.join(f'{c} binary' for c in PLACE)}")
    return packed.groupBy("part").applyInArrow(meet, "d long, t long, place int, bucket long, around int")


def possible_places(docs: DataFrame) -> DataFrame:
    """d, t, start, bucket and around of the MinHashes of paragraphs that can be in a passage.

    All short paragraphs of a passage's runs are in another document, too. So
    a place stays if its text has such places around it that follow each other
    after at most STEP words and spread over SPAN: phrases that many documents
    share, with nothing else around them, and what no other document has make
    no bucket.
    """
    common = materialize(common_places(docs).withColumn("start", F.shiftright("place", 2)), "common")
    by = Window.partitionBy("d", "t").orderBy("start")
    chained = common.withColumn("new", F.coalesce((F.col("start") - F.lag("start").over(by) > STEP).cast("int"), F.lit(0))).withColumn("chain", F.sum("new").over(by))
    chain = Window.partitionBy("d", "t", "chain")
    spread = chained.withColumn("spread", F.max("start").over(chain) - F.min("start").over(chain))
    around = F.when(F.col("place").bitwiseAND(2) == 0, F.col("around")).alias("around")
    out = materialize(spread.where((F.col("spread") >= SPAN) & (F.col("place").bitwiseAND(1) == 1)).select("d", "t", "start", "bucket", around), "possible")
    drop_table(common)
    return out


class Sorted:
    """A text's words and shingles of ANCHOR words, sorted once for all texts that are held against it."""

    def __init__(self, words: np.ndarray):
        self.words, self.hashes = words, _rolling(words, ANCHOR)
        self.order = np.argsort(self.hashes, kind="stable")
        self.sorted = self.hashes[self.order]


def equal_runs(a: np.ndarray, ha: np.ndarray, b: Sorted) -> list[tuple[int, int, int]]:
    """All runs of ANCHOR equal words or more, from the places at which both texts have equal shingles."""
    low, high = (np.searchsorted(b.sorted, ha, side) for side in ("left", "right"))
    at = np.flatnonzero(high > low)
    n = (high - low)[at]
    if n.sum() > 1 << 20:  # repetitive texts: diagonals, one place at a time
        met = np.zeros(len(ha) + len(b.hashes), bool)
        for x in at:
            met[x - b.order[low[x] : high[x]] + len(b.hashes)] = True
        return runs_on(a, b.words, (np.flatnonzero(met) - len(b.hashes)).tolist())
    x = np.repeat(at, n)
    y = b.order[np.repeat(low[at] - np.cumsum(n) + n, n) + np.arange(n.sum())]
    by = np.lexsort((x, x - y))
    x, y = x[by], y[by]
    first = np.ones(len(x), bool)
    first[1:] = (np.diff(x) != 1) | (np.diff(y) != 1)
    start = np.flatnonzero(first)
    size = np.diff(np.append(start, len(x))) + ANCHOR - 1
    return list(zip(x[start].tolist(), (x[start] + size).tolist(), y[start].tolist(), strict=True))


def _cumulative(words: np.ndarray) -> list[int]:
    """Hashes of the first word, the first two, and so on."""
    out, h = [], 0
    for w in words.tolist():
        h = (h * P_WORD + w) & (1 << 64) - 1
        out.append(h)
    return mix64(np.array(out, np.uint64)).view(np.int64).tolist()


def shared_passages(a: np.ndarray, b: Sorted) -> list[tuple[int, int, int, int, int, int, list[int], list[int]]]:
    """All passages that a and b share, those inside others of a left out: s, e, ls, le, p, lp, before and after.

    ls and le are the ends in b; p and lp are the places in a and b of the
    words of least hash. before and after are hashes of the words of a over
    the ends, fewer than a paragraph.
    """
    ha = _rolling(a, ANCHOR)
    runs = equal_runs(a, ha, b)
    out, reach = [], -1
    for chain in sorted(chained(runs), key=lambda c: (c[0][0], -c[-1][1], c[0][2])):
        (s, _, ls), (fs, e, fl) = chain[0], chain[-1]
        if e <= reach:
            continue
        reach = e
        _, p, lp = min((int(ha[k]), k, k - x + y) for x, z, y in chain for k in [x + int(np.argmin(ha[x : z - ANCHOR + 1]))])
        over = KEY + PARAGRAPH - 1
        out.append((s, e, ls, fl + e - fs, p, lp, _cumulative(a[max(0, s - over) : s][::-1]), _cumulative(a[e : e + over])))
    return out


PAIR = ["d", "t", "ld", "lt"]
RUN = ["s", "e", "ls", "le", "p", "lp"]
#: Bytes of the texts that one task holds against a leader at a time.
TASK_BYTES = 8 << 20


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The passages of each pair of documents, which are compared whole.

    A leader's text travels once for each TASK_BYTES of members: it is the
    first row of its group in a sorted partition, and the members stream past
    it.
    """
    measured = materialize(pairs.join(texts.select("d", "t", "n_bytes"), ["d", "t"]), "measured")
    sizes = measured.groupBy("ld", "lt").agg(F.ceil(F.sum("n_bytes") / TASK_BYTES).alias("pieces"))
    sizes = materialize(sizes.withColumn("pieces", F.greatest("pieces", F.lit(1))), "leaders")
    group = ["ld", "lt", "piece"]
    dealt = materialize(measured.join(sizes, ["ld", "lt"]).select(*group[:2], F.pmod(F.xxhash64("d", "t"), F.col("pieces")).alias("piece"), "d", "t"), "dealt")
    then = dealt.join(texts.select("d", "t", "text"), ["d", "t"]).select(*group, F.lit(1).alias("kind"), "d", "t", "text")
    lead = dealt.select(*group).distinct()
    first = lead.join(texts.select(F.col("d").alias("ld"), F.col("t").alias("lt"), "text"), ["ld", "lt"]).select(*group, F.lit(0).alias("kind"), F.lit(None).cast("long").alias("d"), F.lit(None).cast("long").alias("t"), "text")
    streamed = first.unionByName(then).repartition(*group).sortWithinPartitions(*group, "kind", "d", "t")

    def verify(batches):
        import pyarrow as pa

        leader = Sorted(np.zeros(0, np.uint64))
        for batch in batches:
            kinds = batch.column(3).to_pylist()
            for row0, words, begin in hashed(batch.column(6)):
                rows = []
                for i in range(len(begin) - 1):
                    own = words[begin[i] : begin[i + 1]]
                    if kinds[row0 + i]:
                        rows += [(row0 + i, *run) for run in shared_passages(own, leader)]
                    else:
                        leader = Sorted(own)
                cols = list(zip(*rows, strict=True)) or [()] * 9
                take = pa.array(cols[0], pa.int64())
                found = [*[pa.array(c, pa.int32()) for c in cols[1:7]], *[pa.array(c, pa.list_(pa.int64())) for c in cols[7:]]]
                yield pa.RecordBatch.from_arrays([*[batch.column(k).take(take) for k in (4, 5, 0, 1)], *found], [*PAIR, *RUN, "before", "after"])

    return streamed.mapInArrow(verify, "d long, t long, ld long, lt long, s int, e int, ls int, le int, p int, lp int, before array<long>, after array<long>")


def _after_least(bands: DataFrame) -> DataFrame:
    """The rows of each bucket that aren't of its least document, with that as ld and lt, and whether they can have a paragraph in common."""
    before = Window.partitionBy("bucket").orderBy("d", "t", "start").rowsBetween(Window.unboundedPreceding, 0)
    least, second = F.first(F.struct("d", "t", "around")).over(before), F.nth_value(F.struct("d", "t"), 2).over(before)
    # a least document with several places in the bucket may meet at any of them
    several = (F.col("second.d") == F.col("l.d")) & (F.col("second.t") == F.col("l.t"))
    meets = _meets(F.col("around"), F.col("l.around")) | several
    return bands.withColumn("l", least).withColumn("second", second).where((F.col("d") != F.col("l.d")) | (F.col("t") != F.col("l.t"))).select("bucket", "d", "t", "start", "around", F.col("l.d").alias("ld"), F.col("l.t").alias("lt"), meets.alias("meets"))


def window_keys(words: np.ndarray, at: list[int], shared: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, key) of all windows of PASSAGE words that hold a shingle at one of the places."""
    h = _rolling(words, PASSAGE)
    holds = np.zeros(len(h), bool)
    for q in at:
        holds[max(0, q - PASSAGE + KEY) : q + 1] = True
    start = np.flatnonzero(holds)
    return start, h[start]


def pair_keys(words: np.ndarray, at: list[int], shared: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, key) of each place with every shared MinHash of a paragraph NEAR to FAR words before or after it; a key is both shingles in order."""
    h = _rolling(words, KEY)
    least = paragraph_minima(h)
    least = least[np.isin(h[least], shared)]
    places, keys, by = [], [], np.uint64(P_WORD)
    for q in at:
        before, after = (least[np.searchsorted(least, lo) : np.searchsorted(least, hi, "right")] for lo, hi in ((q - FAR, q - NEAR), (q + NEAR, q + FAR)))
        key = np.unique(np.concatenate([h[before] * by + h[q], h[q : q + 1] * by + h[after]]))
        places.append(np.full(len(key), q))
        keys.append(key)
    return np.concatenate(places), mix64(np.concatenate(keys))


def _rebucketed(places: DataFrame, texts: DataFrame, possible: DataFrame, keys) -> DataFrame:
    """d, t, start, bucket and around: the keys that each text has for its places; without around, so that all of them meet."""

    def rebucket(batches):
        import pyarrow as pa

        for batch in batches:
            at, shared = batch.column(3).to_pylist(), batch.column(4)
            for row0, words, first in hashed(batch.column(2)):
                for i in range(len(first) - 1):
                    start, key = keys(words[first[i] : first[i + 1]], at[row0 + i], np.array(shared[row0 + i].as_py(), np.int64).view(np.uint64))
                    take = pa.array(np.full(len(start), row0 + i))
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(start.astype(np.int32)), pa.array(key.view(np.int64)), pa.nulls(len(start), pa.int32())], ["d", "t", "start", "bucket", "around"])

    held = places.groupBy("d", "t").agg(F.sort_array(F.collect_set("start")).alias("at"))
    shared = possible.join(held.select("d", "t"), ["d", "t"], "left_semi").groupBy("d", "t").agg(F.collect_set("bucket").alias("shared"))
    return held.join(shared, ["d", "t"]).join(texts, ["d", "t"]).select("d", "t", "text", "at", "shared").mapInArrow(rebucket, "d long, t long, start int, bucket long, around int")


def _unsettled(rows: DataFrame, runs: DataFrame) -> DataFrame:
    """bucket, d, t, start and around of the members whose place is in no passage that they share with their leader."""
    inside = F.coalesce(F.max((F.col("start") >= F.col("s")) & (F.col("start") < F.col("e"))), F.lit(False))
    return materialize(rows.join(runs.select(*PAIR, "s", "e"), PAIR, "left").groupBy("bucket", "d", "t", "start", "around").agg(inside.alias("in")).where("not in").drop("in"), "unsettled")


def passage_runs(docs: DataFrame, places: DataFrame) -> DataFrame:
    """Passages of pairs of documents.

    Members of a bucket are held against its least document; those whose place
    is in a passage of it are settled; a few bits of the words around a place
    tell before whether a whole paragraph can be equal. The others take their least document as
    the next leader, LEADERS times in all. Then all pairs of what is left are
    compared in buckets of up to FEW. The rest have a common phrase: each of
    their places makes buckets with the paragraphs around it, in which two
    phrases of a passage meet whatever else shares one of them, and these are
    settled in the same way. What shares two phrases with many others and a
    passage with none of their leaders goes into buckets by windows of 51
    words, whose members do share a passage with the least one.
    """
    rows = materialize(_after_least(places), "shared")
    ids = rows.select("d", "t").unionByName(rows.select(F.col("ld").alias("d"), F.col("lt").alias("t"))).distinct()
    texts = materialize(docs.join(ids, ["d", "t"], "left_semi").dropDuplicates(["d", "t"]).withColumn("n_bytes", F.octet_length("text").cast("long")), "passagetexts")
    compared = materialize(rows.where("meets").select(*PAIR).distinct(), "passagepairs")
    runs = materialize(verified(compared, texts), "runs")

    def compare(pairs: DataFrame) -> None:
        nonlocal compared, runs
        more = materialize(pairs.distinct().join(compared, PAIR, "left_anti"), "passagepairs")
        compared, runs = compared.unionByName(more), runs.unionByName(materialize(verified(more, texts), "runs"))

    def settle(members: DataFrame) -> DataFrame:
        rows = materialize(_after_least(members), "shared")
        compare(rows.where("meets").select(*PAIR))
        left = _unsettled(rows, runs)
        drop_table(rows)
        return left

    left = _unsettled(rows, runs)
    drop_table(rows)
    for _ in range(LEADERS - 1):
        left = settle(left)
    for keys in (pair_keys, window_keys):
        sizes = materialize(left.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "bucketsizes")
        few = left.join(sizes.where(F.col("n") <= FEW), "bucket").select("bucket", "d", "t", "around").distinct()
        both = few.join(few.select("bucket", F.col("d").alias("ld"), F.col("t").alias("lt"), F.col("around").alias("other")), "bucket")
        compare(both.where((F.struct("d", "t") > F.struct("ld", "lt")) & _meets(F.col("around"), F.col("other"))).select(*PAIR))
        hot = left.join(sizes.where(F.col("n") > FEW), "bucket").select("d", "t", "start")
        left = settle(_rebucketed(hot, texts, places, keys))
    return runs


def extended(runs: DataFrame) -> DataFrame:
    """Runs with the words over their ends that an earlier document with a run at the same end of the leader's has, too."""
    own = materialize(runs.withColumn("run", F.monotonically_increasing_id()), "numbered")
    places = {"before": F.col("ls"), "after": F.col("le")}
    over = [own.select("run", "d", "t", "ld", "lt", F.lit(side).alias("side"), at.alias("at"), F.posexplode(side).alias("more", "hash")) for side, at in places.items()]
    least = F.first(F.struct("d", "t")).over(Window.partitionBy("ld", "lt", "side", "at", "more", "hash").orderBy("d", "t").rowsBetween(Window.unboundedPreceding, 0))
    more = over[0].unionByName(over[1]).withColumn("l", least).where(F.struct("d", "t") != F.col("l"))
    most = more.groupBy("run").agg(*[F.max(F.when(F.col("side") == side, F.col("more") + 1)).alias(f"n_{side}") for side in places])
    return own.join(most, "run", "left").withColumn("s", F.col("s") - F.coalesce("n_before", F.lit(0))).withColumn("e", F.col("e") + F.coalesce("n_after", F.lit(0))).select(*PAIR, "s", "e", "p", "lp")


def repeated_passages(docs: DataFrame) -> DataFrame:
    """doc_id, start, end, n_words and kept_doc_id: passages of over 50 words that an earlier document has, too.

    Words are numbered from 0 in the whole text, end is past the last one.
    Paragraphs of ten words start at every word; the MinHash of their shingles
    is their band, so that no passage is without a bucket. Each place in a
    bucket is held against the bucket's least document, so a
    group of copies costs comparisons linear in its size, and what that
    doesn't settle goes through further rounds. Documents are compared whole,
    and the edit distance of each passage is verified. Of documents with equal
    texts the least stands for all, and the others are removed whole. Verified
    pairs are clustered by components; the least (document, place) of a
    component stays and all others are removals, whose overlapping spans are
    merged.

    Null, empty and short texts have no passages. Equal rows of one doc_id
    count once, rows with one doc_id and different texts are documents of
    their own, null ids take part and come back as null. Repeats inside one
    document are left alone. Other columns are ignored; an empty table gives
    no rows.
    """
    keyed = docs.select(*_key(), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    least = keyed.groupBy("t").agg(F.min("d").alias("kept"), F.max("d").alias("last")).where("kept < last").select("t", "kept")
    # written, so that the planner knows its size before it chooses a join with the texts
    least = materialize(least, "copies")
    several = materialize(keyed.groupBy("d").agg(F.min("t").alias("lo"), F.max("t").alias("hi")).where("lo != hi").select("d", F.lit(True).alias("several")), "several")
    known = keyed.join(least, "t", "left").join(several, "d", "left")
    copied = F.coalesce(F.col("d") != F.col("kept"), F.lit(False))
    copies = known.where(copied).select("d", "t", F.lit(0).alias("s"), F.regexp_count("text", F.lit(WORD)).alias("e"), "kept").where(F.col("e") >= PASSAGE).distinct()
    # only texts that share their doc_id need the hash to be told apart; others go without it through the shuffles
    firsts = known.where(~copied).select("d", F.when(F.col("several"), F.col("t")).otherwise(F.lit(0)).alias("t"), "text")
    runs = extended(passage_runs(firsts, possible_places(firsts)))
    # places are numbered by a hash: numbers are aggregated without sorting
    named = materialize(runs.select("d", "t", "s", "e", "ld", F.xxhash64("d", "t", "p").alias("node"), F.xxhash64("ld", "lt", "lp").alias("other")), "places")
    roots = star_roots(named.select(F.col("node").alias("u"), F.col("other").alias("v")))
    placed = materialize(named.join(roots, "node"), "placed")
    first = placed.groupBy("root").agg(F.min(F.least("d", "ld")).alias("kept"))
    kept = placed.select("d", "t", "s", "e", "root").join(first, "root").select("d", "t", "s", "e", "kept").unionByName(copies)
    # overlapping spans of a document become one: a span starts where none before reaches
    by = Window.partitionBy("d", "t").orderBy("s", "e")
    reach = F.max("e").over(by.rowsBetween(Window.unboundedPreceding, -1))
    islands = kept.withColumn("new", F.coalesce((F.col("s") > reach).cast("int"), F.lit(1))).withColumn("island", F.sum("new").over(by))
    merged = islands.groupBy("d", "t", "island").agg(F.min("s").alias("start"), F.max("e").alias("end"), F.min("kept").alias("kept"))
    null = lambda c: F.when(F.col(c) != -(1 << 63), F.col(c))
    return merged.select(null("d").alias("doc_id"), "start", "end", (F.col("end") - F.col("start")).alias("n_words"), null("kept").alias("kept_doc_id"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """repeated_passages() of all documents; nulls, ties, repeated rows and empty tables as stated there."""
    return repeated_passages(table(spark, sf_dir, "documents"))
