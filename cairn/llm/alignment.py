"""Operator 12: alignment of two tokenizers' tokens where their bytes end together."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm.common import materialize, small_batches, table, utf8_rows
from cairn.llm.tokens import BEYOND_LATIN, ODD_SPACE, byte_alphabet

#: Long texts are cut where a plain space follows something else than white space: no token of either kind spans such a place.
CHUNK = re.compile(r"\s*\S+(?:(?! )\s+\S*)*|\s+")
#: Characters of the pieces of long texts, and bytes of texts that are aligned at once.
PIECE, BLOCK = 1 << 18, 1 << 20
#: What follows an id in the digest: inside and at the end of a group's first and second half.
ENDS = (b",", b"|", b",", b";")


def byte_level_tokens(vocabulary: dict[str, int]) -> list[bytes]:
    """The bytes of each id of a byte-level vocabulary."""
    letters, out = byte_alphabet(), [b""] * (max(vocabulary.values()) + 1)
    for token, i in vocabulary.items():
        out[i] = bytes(letters[c] for c in token)
    return out


def piece_bytes(model) -> list[bytes]:
    """The bytes of each piece; <0xHH> is byte HH."""
    return [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(map(model.id_to_piece, range(model.get_piece_size())))]


class Tokens:
    """Both tokenizers' ids of texts."""

    def __init__(self, path_a: str, path_b: str):
        import public_tokenizers
        import tiktoken
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(path_a), SentencePieceProcessor(model_file=path_b)
        self.a.encode_special_tokens = True
        self.bytes_a, self.bytes_b = byte_level_tokens(self.a.get_vocab(with_added_tokens=False)), piece_bytes(self.b)
        # ids of a byte-level vocabulary are its merges in order, so the faster library gives the same ids
        self.fast = tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks={t: i for i, t in enumerate(self.bytes_a)}, special_tokens={})
        self.len_a, self.len_b = (np.array([len(t) for t in x], np.int64) for x in (self.bytes_a, self.bytes_b))
        # a piece that goes on after another character with a space could span two pieces of a text: then texts are encoded whole
        self.cuttable = not any(re.search("[^▁]▁", self.b.id_to_piece(i)) for i in range(len(self.bytes_b)))
        self.before = len(self.b.encode("a"))
        self.strings = [str(i).encode() + end for n, end in zip((len(self.bytes_a),) * 2 + (len(self.bytes_b),) * 2, ENDS, strict=True) for i in range(n)]

    def encode_a(self, text: str) -> list[int]:
        # the libraries' tables of letters may differ beyond Latin
        return self.a.encode(text, add_special_tokens=False).ids if BEYOND_LATIN.search(text) else self.fast.encode_ordinary(text)

    def encode(self, text: str) -> tuple[list[int], list[int]]:
        """The ids of a space and a text by the first, and of the text by the second tokenizer; none if one of them changes its bytes."""
        if not text:
            return [], []
        if len(text) <= PIECE or not self.cuttable or ODD_SPACE.search(text):
            a, b = self.encode_a(" " + text), self.b.encode(text)
        else:
            a, b = [], []
            for piece in pieces(" " + text):
                a += self.encode_a(piece)
                b += self.b.encode("a" + piece)[self.before :]
        want = (" " + text).encode()
        same = b"".join(map(self.bytes_a.__getitem__, a)) == want == b"".join(map(self.bytes_b.__getitem__, b))
        return (a, b) if same else ([], [])


def pieces(text: str) -> Iterator[str]:
    """A text in pieces of about PIECE characters, or of one word."""
    held, n = [], 0
    for m in CHUNK.finditer(text):
        held.append(m[0])
        n += len(m[0])
        if n >= PIECE:
            yield "".join(held)
            held, n = [], 0
    if held:
        yield "".join(held)


def flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """All ids one after another, and how many each list has."""
    n = np.array([len(x) for x in lists], np.int64)
    return np.fromiter(chain.from_iterable(lists), np.int32, int(n.sum())), n


def sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The sum of each segment of values, by differences of prefix sums."""
    total = np.r_[0, np.cumsum(values)]
    ends = np.cumsum(counts)
    return total[ends] - total[ends - counts]


def aligned(own: Tokens, texts: list[str]) -> tuple[list, ...]:
    """n_a, n_b, n_groups, groups_sha256, and the ids of the linked tokens with how many each text has.

    The texts' tokens lie in one row of bytes. Ends of both kinds are counted
    once for all bytes; a byte at which two tokens end is the end of a group.
    """
    ids = [own.encode(t) for t in texts]
    (a, n_a), (b, n_b) = flat([x for x, _ in ids]), flat([y for _, y in ids])
    del ids
    ends_a, ends_b = np.cumsum(own.len_a[a]), np.cumsum(own.len_b[b])
    both = np.bincount(np.concatenate([ends_a, ends_b])) == 2
    last_a, last_b = both[ends_a], both[ends_b]
    groups = sums(last_a, n_a)
    # the digest's order: a group's tokens of the first kind, then those of the second
    through_a, through_b = np.r_[0, np.flatnonzero(last_a) + 1], np.r_[0, np.flatnonzero(last_b) + 1]
    order = np.empty(len(a) + len(b), np.int32)
    order[np.arange(len(a)) + through_b[np.cumsum(last_a) - last_a]] = a + last_a * len(own.bytes_a)
    order[np.arange(len(b)) + through_a[np.cumsum(last_b) - last_b + 1 if len(b) else np.zeros(0, int)]] = b + (2 * len(own.bytes_a) + last_b * len(own.bytes_b))
    shas, at = [], 0
    for n in (n_a + n_b).tolist():
        shas.append(hashlib.sha256(b"".join(map(own.strings.__getitem__, order[at : at + n].tolist()))[:-1]).hexdigest() if n else "")
        at += n
    return n_a, n_b, groups, shas, a[last_a], b[last_b]


_own: dict[tuple[str, str], Tokens] = {}


def link_table(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, groups_sha256, and linked_a and linked_b: the ids of linked tokens in order."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def align(batches):
        import pyarrow as pa

        own = _own.get((path_a, path_b)) or _own.setdefault((path_a, path_b), Tokens(path_a, path_b))
        for b in batches:
            sizes = np.diff(utf8_rows(b.column(1))[1])
            cuts = np.flatnonzero(np.diff(np.cumsum(sizes) // BLOCK)) + 1
            for x, y in zip([0, *cuts.tolist()], [*cuts.tolist(), b.num_rows], strict=True):
                n_a, n_b, groups, shas, a, c = aligned(own, b.column(1)[x:y].to_pylist())
                ends = pa.array(np.r_[0, np.cumsum(groups)].astype(np.int32))
                lists = [pa.ListArray.from_arrays(ends, pa.array(v.astype(np.int32))) for v in (a, c)]
                yield pa.RecordBatch.from_arrays([b.column(0)[x:y], *map(pa.array, (n_a, n_b, groups, shas)), *lists], names=["doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "linked_a", "linked_b"])

    read = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return read.mapInArrow(align, f"doc_id {kind}, n_a long, n_b long, n_groups long, groups_sha256 string, linked_a array<int>, linked_b array<int>")


def pair_counts(links: DataFrame) -> DataFrame:
    """a, b, n and best: how many links hold a pair of ids, and whether no pair with its b has more."""

    def counted(batches):
        import pyarrow as pa

        for batch in batches:
            a, b = (np.asarray(batch.column(i).flatten()).astype(np.int64) for i in (0, 1))
            pairs, n = np.unique(a << 32 | b, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(pairs >> 32), pa.array(pairs & 0xFFFFFFFF), pa.array(n)], names=["a", "b", "n"])

    pairs = links.select("linked_a", "linked_b").mapInArrow(counted, "a long, b long, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))
    top = pairs.groupBy("b").agg(F.max("n").alias("top"))
    return pairs.join(top, "b").select("a", "b", "n", (F.col("n") == F.col("top")).alias("best"))


def align_tokens(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every row of docs.

    Null and empty texts, and texts whose bytes one of the tokenizers changes,
    have no tokens: zeros and an empty digest. Repeated rows and null ids give
    a row each and all count. Other columns are ignored; an empty table gives
    no Very long texts are encoded in pieces, as they take much memory
    whole.

    The counts of pairs are broadcast: linked tokens end at the same byte, so
    one is the end of the other, and there are at most as many pairs as bytes
    in both vocabularies, whatever the corpus.
    """
    spark = docs.sparkSession
    small_batches(spark)
    links = materialize(link_table(docs, path_a, path_b), "links")
    known = pair_counts(links).toPandas()
    keys = (known["a"].to_numpy(np.int64) << 32) | known["b"].to_numpy(np.int64)
    order = np.argsort(keys)
    pairs = spark.sparkContext.broadcast((keys[order], known["n"].to_numpy(np.int64)[order], known["best"].to_numpy(bool)[order]))

    def scored(batches):
        import pyarrow as pa

        keys, counts, best = pairs.value
        for batch in batches:
            a, b = (np.asarray(batch.column(i).flatten()).astype(np.int64) for i in (5, 6))
            n, at = np.asarray(batch.column(3)), np.searchsorted(keys, a << 32 | b)
            own = [pa.array(sums(x[at].astype(np.int64), n)) for x in (best, counts)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], batch.column(3), *own, batch.column(4)], names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return links.mapInArrow(scored, f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")


def op12_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """align_tokens() of all documents; nulls, ties, repeated rows and empty tables as stated there."""
    import public_tokenizers

    return align_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
