"""Operator 2: token counts by the whole-token shortcut."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm.common import small_batches, table

#: Splits a text where no token can span: a word never continues after white space.
CHUNK = re.compile(r"\s*\S+|\s+")
#: Python counts these as white space and the tokenizer's pattern doesn't (or the reverse): such texts go to the library whole.
ODD_SPACE = re.compile(r"[\x1c-\x1f\x85]")
#: Beyond Latin letters the two libraries' Unicode tables may differ, so those chunks go to the library.
BEYOND_LATIN = re.compile(r"[^\x00-ɏ]")
#: Chunks longer than this aren't remembered, and the memory is emptied at so many chunks.
LONGEST_KEPT, MOST_KEPT = 64, 400_000


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies, by its published rule."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class WholeTokenCounter(dict):
    """Chunk -> number of tokens.

    A pre-token that is in `whole` counts 1 without merging. `whole` is proved
    when the counter is made, before any text is read: each vocabulary string
    is one pre-token and the library encodes it alone as exactly one token.
    """

    def __init__(self, path: str):
        import public_tokenizers
        import regex
        from tokenizers import Tokenizer

        super().__init__()
        self.library = Tokenizer.from_file(path)
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.whole = self.prove()

    def prove(self) -> frozenset[str]:
        letters, strings = byte_alphabet(), []
        for token in self.library.get_vocab(with_added_tokens=False):
            try:
                text = bytes(letters[c] for c in token).decode()
            except (KeyError, UnicodeDecodeError):
                continue  # not text of its own
            if text not in self.special and self.pattern.fullmatch(text) and not BEYOND_LATIN.search(text):
                strings.append(text)
        return frozenset(s for s, e in zip(strings, self.library.encode_batch(strings, add_special_tokens=False), strict=True) if len(e.ids) == 1)

    def merged(self, text: str) -> int:
        return len(self.library.encode(text, add_special_tokens=False).ids)

    def __missing__(self, chunk: str) -> int:
        if BEYOND_LATIN.search(chunk):
            n = self.merged(chunk)
        else:
            n = sum(1 if p in self.whole else self.merged(p) for p in self.pattern.findall(chunk))
        if len(chunk) <= LONGEST_KEPT:
            if len(self) >= MOST_KEPT:
                self.clear()
            self[chunk] = n
        return n

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if ODD_SPACE.search(text) or any(s in text for s in self.special):
            return self.merged(text)
        return sum(map(self.__getitem__, CHUNK.findall(text)))


_counters: dict[str, WholeTokenCounter] = {}


def counter(path: str) -> WholeTokenCounter:
    """One counter for each worker process and vocabulary."""
    if path not in _counters:
        _counters[path] = WholeTokenCounter(path)
    return _counters[path]


def token_counts(column: Column, path: str) -> Column:
    """The number of tokens of each text of a column. Null and empty texts have 0; no text is cut."""

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = counter(path)
        for texts in batches:
            yield pd.Series([own.count(t) for t in texts], dtype="int64")

    return count(column)


def count_tokens(docs: DataFrame, path: str, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every row of docs.

    Null texts count as empty (0 bytes, 0 tokens). Repeated rows and null ids
    give a row each; other columns are ignored. An empty table gives no rows.
    The special strings of the vocabulary count as one token each inside
    texts, which is the library's default.
    """
    small_batches(docs.sparkSession)
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), token_counts(text, path).alias("n_tokens")).withColumn("over_limit", F.col("n_tokens") > limit)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """count_tokens() of all documents; nulls, ties, repeated rows and empty tables as stated there."""
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
