"""Operator 9: language identification, first the family, then one-versus-one linear SVMs within it."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairn.llm.common import small_batches, table, utf8_rows

#: Families of common languages; a label that isn't here is a family of its own.
FAMILY = {
    "en": "germanic", "de": "germanic", "nl": "germanic", "sv": "germanic", "da": "germanic", "no": "germanic", "is": "germanic", "af": "germanic",
    "fr": "romance", "es": "romance", "it": "romance", "pt": "romance", "ro": "romance", "ca": "romance", "gl": "romance",
    "ru": "slavic", "pl": "slavic", "cs": "slavic", "uk": "slavic", "bg": "slavic", "sk": "slavic", "sr": "slavic", "hr": "slavic", "sl": "slavic",
    "fi": "uralic", "et": "uralic", "hu": "uralic", "tr": "turkic", "az": "turkic", "kk": "turkic",
}
#: Hash places of byte trigrams, besides one place for each byte.
PLACES = 4096
SIZE = PLACES + 256
#: The training sample: at most so many documents of a language, by hash of doc_id.
SAMPLE_PER_LANGUAGE = 400
UNKNOWN = "und"
#: A text of so many bytes, which say enough, is in none of the learned languages if its score is below this share of the least score of such a training text.
FLOOR_BYTES, FLOOR_SHARE = 200, 0.7

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LOWER[[9, 10, 11, 12, 13]] = 32


def features(data: np.ndarray, offsets: np.ndarray):
    """For each row a unit vector of the square roots of its trigram and byte counts over the whole text."""
    low = _LOWER[data]
    code = low.astype(np.uint32)
    tri = np.zeros(len(low), np.uint32)
    if len(low) > 2:
        tri[:-2] = (code[:-2] * np.uint32(0x9E3779B1) + code[1:-1] * np.uint32(0x85EBCA77) + code[2:] * np.uint32(0xC2B2AE3D)) >> np.uint32(20)
    for a, b in zip(offsets[:-1], offsets[1:], strict=True):
        v = np.zeros(SIZE, np.float32)
        if b > a:
            v[PLACES:] = np.bincount(low[a:b], minlength=256)
            if b - a > 2:
                v[:PLACES] = np.bincount(tri[a : b - 2], minlength=PLACES)
            np.sqrt(v, out=v)
            v /= np.linalg.norm(v)
        yield v


@dataclass
class Split:
    """One linear SVM: positive margins are for `a`, negative ones for `b`."""

    a: str
    b: str
    weights: np.ndarray
    bias: float


def fit_svm(x: np.ndarray, positive: np.ndarray, c: float = 30.0, rounds: int = 120) -> tuple[np.ndarray, float]:
    """A linear SVM with squared hinge loss, by accelerated gradient steps over the whole sample."""
    n, y = len(x), np.where(positive, 1.0, -1.0).astype(np.float32)
    share = np.where(positive, 0.5 / max(1, positive.sum()), 0.5 / max(1, (~positive).sum())).astype(np.float32)
    x1 = np.hstack([x, np.ones((n, 1), np.float32)])
    w = np.zeros(x1.shape[1], np.float32)
    look, step, t = w.copy(), 1.0 / (1.0 + 4.0 * c), 1.0
    for _ in range(rounds):
        gap = np.maximum(0, 1 - y * (x1 @ look))
        new = look - step * (look - 2 * c * (x1.T @ (share * gap * y)))
        t_new = (1 + (1 + 4 * t * t) ** 0.5) / 2
        look, w, t = new + (t - 1) / t_new * (new - w), new, t_new
    return w[:-1], float(w[-1])


@dataclass
class LanguageModel:
    """families: one-versus-one splits between families; within: those between the languages of each family; floor: the least score of a text in one of them."""

    languages: dict[str, list[str]]
    families: list[Split]
    within: dict[str, list[Split]]
    floor: float = 0.0

    @classmethod
    def fit(cls, x: np.ndarray, labels: list[str], sizes: list[int]) -> LanguageModel:
        y = np.array(labels, dtype=object)
        fam = np.array([FAMILY.get(v, v) for v in labels], dtype=object)

        def splits(classes: np.ndarray, names: list[str]) -> list[Split]:
            out = []
            for a, b in combinations(names, 2):
                of = (classes == a) | (classes == b)
                out.append(Split(a, b, *fit_svm(x[of], classes[of] == a)))
            return out

        names = sorted(set(fam))
        languages = {f: sorted(set(y[fam == f])) for f in names}
        model = cls(languages, splits(fam, names), {f: splits(y, languages[f]) for f in names})
        model.floor = FLOOR_SHARE * min((model.predict(v)[1] for v, n in zip(x, sizes, strict=True) if n >= FLOOR_BYTES), default=0.0)
        return model

    @staticmethod
    def _vote(v: np.ndarray, names: list[str], splits: list[Split]) -> tuple[str, float]:
        if len(names) == 1:
            return names[0], 1.0
        points = dict.fromkeys(names, 0.0)
        for s in splits:
            p = 1 / (1 + np.exp(-4.0 * float(v @ s.weights + s.bias)))
            points[s.a] += p
            points[s.b] += 1 - p
        best = max(names, key=lambda k: points[k])
        return best, points[best] / (len(names) - 1)

    def predict(self, v: np.ndarray) -> tuple[str, float]:
        family, p = self._vote(v, sorted(self.languages), self.families)
        language, q = self._vote(v, self.languages[family], self.within[family])
        return language, min(1.0, max(0.0, p * q))


def held_out():
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 4 == 2


def training_sample(docs: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE) -> DataFrame:
    """text and lang of at most `per_language` documents of each language outside the held-out fold.

    Documents are chosen by the hash of their id and text; equal rows count
    once. Counts of the languages come
    first, so that only about twice the wanted number of rows meets in the
    ranking of a language, however many documents it has; what comes to the
    driver is a number for each label.
    """
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out())
    key = F.xxhash64(F.lit("sample"), "doc_id", "text")
    u = F.pmod(key, F.lit(1 << 30)) / F.lit(float(1 << 30))
    rate = {r.lang: 2.0 * per_language / r.n for r in rows.groupBy("lang").agg(F.approx_count_distinct(key).alias("n")).collect()}
    if not rate:
        return rows.select("text", "lang")
    near = rows.select(key.alias("key"), "lang", u.alias("u")).where(F.col("u") <= _by_language(rate)).distinct()
    first = near.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("u", "key"))).where(F.col("r") <= per_language)
    cut = {r.lang: r.u for r in first.groupBy("lang").agg(F.max("u").alias("u")).collect()}
    if not cut:
        return rows.where("false").select("text", "lang")
    # few rows are left; those that tie with the last one are cut here
    chosen = rows.where(u <= _by_language(cut)).select(key.alias("key"), u.alias("u"), "text", "lang").dropDuplicates(["key", "lang"])
    return chosen.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("u", "key"))).where(F.col("r") <= per_language).select("text", "lang")


def _by_language(values: dict[str, float]):
    """A number for each language; there is one entry for each label, never for each document."""
    return F.create_map(*[F.lit(x) for pair in sorted(values.items()) for x in pair])[F.col("lang")]


def fit_languages(docs: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE) -> LanguageModel | None:
    """A model from the bounded sample, whose feature vectors (17 KB each) come to the driver; None without labelled rows."""
    small_batches(docs.sparkSession)

    def vectors(batches):
        import pyarrow as pa

        for batch in batches:
            data, offsets = utf8_rows(batch.column(0))
            rows = [v.tobytes() for v in features(data, offsets)]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary()), batch.column(1), pa.array(np.diff(offsets), pa.int64())], ["v", "lang", "n"])

    rows = training_sample(docs, per_language).mapInArrow(vectors, "v binary, lang string, n long").collect()
    if not rows:
        return None
    rows.sort(key=lambda r: (r.lang, bytes(r.v)))
    return LanguageModel.fit(np.stack([np.frombuffer(r.v, np.float32) for r in rows]), [r.lang for r in rows], [r.n for r in rows])


def predicted(model: LanguageModel | None):
    """lang_pred and score of each whole text, as a struct column of the table that has `text`.

    Null texts and texts without a letter are `und` with score 0, and so are
    all texts if nothing could be learned. Only texts go to Python.
    """

    @F.pandas_udf("lang_pred string, score double")
    def predict(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        import pyarrow as pa

        for texts, letters in batches:
            vectors = features(*utf8_rows(pa.array(texts, pa.large_string())))
            said = [model.predict(v) if ok and model else (UNKNOWN, 0.0) for v, ok in zip(vectors, letters, strict=True)]
            yield pd.DataFrame(said, columns=["lang_pred", "score"])

    letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    return predict(F.coalesce(F.col("text"), F.lit("")), letters)


def identify(docs: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row of docs.

    Learns from text and lang of rows whose crc32(doc_id) mod 4 isn't 2; a
    prediction sees the text alone. Null ids hash as the empty string;
    repeated rows get a row each; other columns are ignored; an empty table
    gives no rows.
    """
    small_batches(docs.sparkSession)
    model = fit_languages(docs.select("doc_id", "text", "lang"), per_language)
    said = docs.select("doc_id", held_out().alias("held_out"), predicted(model).alias("said"))
    return said.select("doc_id", "held_out", "said.lang_pred", "said.score")


def keep_identified(docs: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE) -> DataFrame:
    """The rows of docs whose language the model identifies, with their columns as they are.

    Rows with null texts and without a letter go, and so do texts of 200 bytes
    or more whose score is below the model's floor: they are in none of the
    learned languages. Shorter texts say too little to go. Where no row
    outside the held-out fold has a label, all rows with a letter stay.
    Repeated rows stay or go together; an empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    model = fit_languages(docs.select("doc_id", "text", "lang"), per_language)
    if model is None:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    said = predicted(model)
    return docs.where((said["lang_pred"] != UNKNOWN) & ((said["score"] >= model.floor) | (F.octet_length("text") < FLOOR_BYTES)))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """identify() of all documents; nulls, ties, repeated rows and empty tables as stated there."""
    return identify(table(spark, sf_dir, "documents"))
