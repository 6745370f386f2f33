"""Operator 7: best-fit packing by bin completion with branch and bound."""

from __future__ import annotations

import math
import re
import zlib
from array import array
from bisect import bisect_left
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm.common import materialize, small_batches, table
from cairn.llm.tokens import byte_alphabet

PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: White space that two libraries see differently, and all beyond Latin letters (composed ones, so NFC changes nothing).
ODD = re.compile("[\x1c-\x1f\x85\u0250-\U0010ffff]")
#: The vocabulary's pattern of words, for Latin text: letters, one digit, or other signs, and English endings.
PATTERN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_²³¹¼½¾]+|[\d²³¹¼½¾]|(?:[^\w\s]|_)+")
LONGEST_KEPT, MOST_KEPT = 64, 1_000_000


class WordIds(dict):
    """Lower-case word -> its token ids as little-endian 32-bit bytes, remembered up to a bound.

    The vocabulary drops white space and its pattern never spans it, so a
    text's ids are those of its words, one after another; a new word goes to
    the library's merges alone. Texts beyond Latin letters go to the library
    whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.library = Tokenizer.from_file(path)
        self.merges = self.library.model
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        letters = {b: c for c, b in byte_alphabet().items()}
        self.bytes = {b: letters[b] for b in range(256)}

    def __missing__(self, word: str) -> bytes:
        tokens = self.merges.tokenize(word.encode().decode("latin-1").translate(self.bytes))
        ids = array("I", [t.id for t in tokens]).tobytes()
        if len(word) <= LONGEST_KEPT:
            if len(self) >= MOST_KEPT:
                self.clear()
            self[word] = ids
        return ids

    def text(self, text: str | None) -> bytes:
        if not text:
            return b""
        if ODD.search(text) or any(s in text for s in self.special):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return b"".join(map(self.__getitem__, PATTERN.findall(text.lower())))


_words: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    if path not in _words:
        _words[path] = WordIds(path)
    return _words[path]


def token_pieces(docs: DataFrame, path: str, size: int = 2048) -> DataFrame:
    """Every document's ids and an end id 0, cut into pieces of at most `size` ids."""
    small_batches(docs.sparkSession)

    def cut(batches):
        import pyarrow as pa

        own = word_ids(path)
        for batch in batches:
            rows: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = own.text(text) + b"\0\0\0\0"
                rows += [(doc, k, a // 4, len(p := ids[a : a + 4 * size]) // 4, zlib.crc32(p)) for k, a in enumerate(range(0, len(ids), 4 * size))]
            cols = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", "text").mapInArrow(cut, PIECE)


# ---- packing of one bounded group ---------------------------------------------------------------


def best_fit(sizes: list[int], cap: int) -> list[list[int]]:
    """Best-fit decreasing; a bit for each room that an open bin has finds the tightest one in constant time."""
    bins: list[list[int]] = []
    rooms: dict[int, list[int]] = {}
    open_rooms = 0
    for s in sorted(sizes, reverse=True):
        fit = open_rooms >> s
        if s and fit:
            room = s + (fit & -fit).bit_length() - 1
            b = rooms[room].pop()
            if not rooms[room]:
                open_rooms &= ~(1 << room)
            bins[b].append(s)
        elif s:
            room, b = cap, len(bins)
            bins.append([s])
        else:
            continue
        left = room - s
        rooms.setdefault(left, []).append(b)
        open_rooms |= 1 << left
    return bins


def lower_bound(counts: Counter, cap: int) -> int:
    """The larger of the sum bound and the bounds of Martello and Toth on items over a threshold."""
    number = np.zeros(cap + 1, np.int64)
    for s, n in counts.items():
        number[s] += n
    up_to = np.concatenate([[0], np.cumsum(number)])  # items shorter than s
    tokens = np.concatenate([[0], np.cumsum(number * np.arange(cap + 1))])
    best = -(-int(tokens[-1]) // cap)
    half = cap // 2 + 1
    t = np.arange(1, half)
    big = up_to[-1] - up_to[cap - t + 1]
    mid = up_to[cap - t + 1] - up_to[half]
    free = mid * cap - (tokens[cap - t + 1] - tokens[half])
    small = tokens[half] - tokens[t]
    over = np.maximum(0, -(-(small - free) // cap))
    return max(best, int((big + mid + over).max(initial=0)))


def fillings(counts: Counter, largest: int, cap: int, most_waste: int, width: int | None = 12, steps: int | None = 400) -> list[tuple[int, ...]]:
    """Undominated fillings around the largest document, least waste first; all of them without `width` and `steps`.

    A filling is kept if no other document fits beside it and no other found
    filling of as many documents is at least as large place by place.
    """
    sizes = sorted((s for s, n in counts.items() if n), reverse=True)
    negative = [-s for s in sizes]
    found: list[tuple[int, tuple[int, ...]]] = []
    budget = [math.inf if steps is None else steps]
    most = math.inf if width is None else 4 * width

    def left(s: int, taken: tuple[int, ...]) -> bool:
        return counts[s] > taken.count(s) + (s == largest)

    def grow(i: int, room: int, taken: tuple[int, ...]) -> None:
        if budget[0] <= 0 or len(found) >= most:
            return
        budget[0] -= 1
        fits = False
        for j in range(max(i, bisect_left(negative, -room)), len(sizes)):
            if left(sizes[j], taken):
                fits = True
                grow(j, room - sizes[j], (*taken, sizes[j]))
                if budget[0] <= 0:
                    break
        if not fits and room <= most_waste and not any(left(sizes[j], taken) for j in range(bisect_left(negative, -room), i)):
            found.append((room, taken))

    grow(0, cap - largest, ())
    found.sort(key=lambda x: (x[0], len(x[1])))
    kept: list[tuple[int, tuple[int, ...]]] = []
    for room, taken in found:
        if not any(len(o) == len(taken) and all(a >= b for a, b in zip(o, taken, strict=True)) for _, o in kept):
            kept.append((room, taken))
    return [t for _, t in kept[:width]]


def complete_bins(sizes: list[int], cap: int, nodes: int | None = 3000, width: int | None = 12, steps: int | None = 400) -> list[list[int]]:
    """Bin completion: depth-first over the fillings of the largest document left.

    `nodes`, `width` and `steps` bound the search, which then returns the best
    solution so far; with None for all three it is exact. The best-fit solution is the incumbent. A branch whose waste exceeds what
    one bin fewer would leave is pruned; a solution at the lower bound ends
    the search.
    """
    best = best_fit(sizes, cap)
    counts = Counter(s for s in sizes if s)
    floor, total = lower_bound(counts, cap), sum(sizes)
    if len(best) <= floor:
        return best
    path: list[list[int]] = []
    wasted = 0
    stack: list[list[tuple[int, ...]]] = []

    def open_node() -> None:
        largest = max((s for s, n in counts.items() if n), default=0)
        spare = (len(best) - 1) * cap - total - wasted
        stack.append([] if spare < 0 or not largest else [(largest, *f) for f in reversed(fillings(counts, largest, cap, spare, width, steps))])

    open_node()
    left = math.inf if nodes is None else nodes
    while stack and left > 0:
        if not stack[-1]:
            stack.pop()
            if path:
                undone = path.pop()
                wasted -= cap - sum(undone)
                counts.update(undone)
            continue
        chosen = list(stack[-1].pop())
        left -= 1
        path.append(chosen)
        wasted += cap - sum(chosen)
        counts.subtract(chosen)
        if not any(counts.values()):
            if len(path) < len(best):
                best = [list(b) for b in path]
                if len(best) <= floor:
                    break
        open_node()
    return best


def place(lengths: np.ndarray, cap: int, **search: int | None) -> tuple[np.ndarray, np.ndarray]:
    """The bin of each item and its offset there."""
    bins = complete_bins(lengths.tolist(), cap, **search)
    of_size: dict[int, list[int]] = {}
    for i in np.argsort(-lengths, kind="stable")[::-1]:
        of_size.setdefault(int(lengths[i]), []).append(int(i))
    which, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for b, items in enumerate(bins):
        at = 0
        for s in items:
            i = of_size[s].pop()
            which[i], offset[i] = b, at
            at += s
    return which, offset


PLACED = f"{PIECE}, sequence_id long, offset long"


def pack(pieces: DataFrame, size: int = 2048, group_rows: int = 8192, **search: int | None) -> DataFrame:
    """Adds sequence_id and offset to pieces (doc_id, piece, start, length, ids_crc32).

    Pieces are dealt by hash into groups of about `group_rows`, each packed by
    one task. What a group leaves unfilled, about a sequence of it, is packed
    again with what others leave, whole sequences together, until one group
    holds all of that or nothing is saved. Groups depend on ids and lengths
    only, never on sources or sizes of copies, so no group is hot. `search`
    goes to complete_bins().
    """
    groups = max(1, -(-pieces.count() // group_rows))

    def one(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "doc_id", "piece", "ids_crc32"], kind="stable")
        which, offset = place(rows["length"].to_numpy(), size, **search)
        if rows["sequence_id"].isna().all() or which.max() + 1 < rows["sequence_id"].nunique():
            rows["sequence_id"], rows["offset"] = (int(key[0]) << 32) + which, offset
        return rows.drop(columns="bundle")

    dealt = pieces.withColumn("bundle", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(groups))).withColumns({"sequence_id": F.lit(None).cast("long"), "offset": F.lit(None).cast("long")})
    out = dealt.groupBy("bundle").applyInPandas(one, PLACED)
    first = 0
    while groups > 1:
        packed = materialize(out, "packed")
        fills = packed.groupBy("sequence_id").agg(F.sum("length").alias("fill"), F.count(F.lit(1)).alias("n")).where(F.col("fill") < size)
        fills = materialize(fills.select(F.col("sequence_id").alias("open"), "n"), "unfilled")
        n, was = fills.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0], groups
        first, groups = first + was, max(1, -(-n // group_rows))
        if not n or groups >= was:
            return packed
        marked = packed.join(fills, F.col("sequence_id") == F.col("open"), "left")
        # numbers of new groups go on from those before, so that sequence numbers stay apart
        again = marked.where("open is not null").withColumn("bundle", F.pmod(F.xxhash64("sequence_id"), F.lit(groups)) + first).drop("open", "n")
        out = marked.where("open is null").drop("open", "n").unionByName(again.groupBy("bundle").applyInPandas(one, PLACED))
    return out


def pack_documents(docs: DataFrame, path: str, size: int = 2048) -> DataFrame:
    """Packs all documents into as few sequences of at most `size` tokens as the search finds.

    Null and empty texts are one piece of the end id alone. Repeated rows are
    packed each; null ids stay null; other columns are ignored; an empty table
    gives no rows. Only documents longer than a sequence are cut.
    """
    return pack(materialize(token_pieces(docs, path, size), "pieces"), size)


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pack_documents() of all documents; nulls, ties, repeated rows and empty tables as stated there."""
    import public_tokenizers

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
