"""Helpers that the corpus operators share: scratch tables, batch sizes and word hashing."""

from __future__ import annotations

import tempfile
import uuid
from weakref import WeakKeyDictionary

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that end a word: space and \t \n \v \f \r.
SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE}]+"
#: Rows and bytes of one Arrow batch. Texts, vectors and graphs may be long, so batches stay far below Spark's 10,000 rows.
BATCH_ROWS, BATCH_BYTES = 1000, "32mb"

#: Spark's setting that deletes the shuffle files of a query when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_own_scratch: dict[str, str] = {}
_written: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bounds the memory of Python workers; all operators set the same values, which hold for the session."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def scratch(spark: SparkSession) -> str:
    """The shared folder of the cluster, a part of it for each application.

    A temporary folder serves only where the session names none and the master
    is local (as in tests); on a cluster its files would be spread over machines.
    """
    app, base = spark.sparkContext.applicationId, spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        if app not in _own_scratch:
            _own_scratch[app] = tempfile.mkdtemp(prefix="cairn-")
        base = _own_scratch[app]
    return f"{base.rstrip('/')}/cairn/{app}"


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Writes df as Parquet in the shared scratch folder and reads it again.

    The written table cuts the lineage: a lost executor costs the running
    tasks, never the steps before, and rows that depend on task order
    (range-partition numbers) are fixed once. The shuffle files of the write
    are deleted with it. A result reads such tables until it is written
    itself; clear_scratch() then deletes them.
    """
    spark = df.sparkSession
    path = f"{scratch(spark)}/{tag}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    _written[out] = path
    return out


def _delete(spark: SparkSession, where: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(where)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def drop_table(df: DataFrame) -> None:
    """Deletes a table of materialize() that no later step reads; the file system of its path may be remote, so Hadoop's client does it."""
    if df in _written:
        _delete(df.sparkSession, _written.pop(df))


def clear_scratch(spark: SparkSession) -> None:
    """Deletes all tables that this application's operators wrote; results that still read them must be written before."""
    _delete(spark, scratch(spark))


# ---- vectorised word hashing over Arrow buffers -------------------------------------------------

_rng = np.random.default_rng(20240229)
#: A random 64-bit value for each byte; A-Z share those of a-z, and white space has 0.
BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BYTE[65:91] = BYTE[97:123]
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[32, 9, 10, 11, 12, 13]] = True
#: Multipliers of the word hash and the shingle hash, odd so that they have inverses mod 2^64.
P_BYTE = int(0x9E3779B97F4A7C15) | 1
P_WORD = int(0xC2B2AE3D27D4EB4F) | 1
_MASK = (1 << 64) - 1


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose output bits all depend on all input bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers(p: int, n: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    out[:1] = 1
    done = 1
    while done < n:  # doubling: p^(k+j) = p^k * p^j
        m = min(done, n - done)
        out[done : done + m] = out[:m] * np.uint64(pow(p, done, 1 << 64))
        done += m
    return out


def utf8_rows(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column of a record batch, and its row offsets (null: empty), without a copy."""
    import pyarrow as pa

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if offsets else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_hashes(data: np.ndarray, offsets: np.ndarray, gap: np.ndarray = IS_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes of all words of a batch; A-Z hash like a-z.

    Returns the hashes, the row's first word in them (n + 1 values), and the
    words' first and past-the-end byte. A word is a maximal run of bytes that
    `gap` doesn't mark, as it does white space; rows end words.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    word = ~gap[data]
    first = word.copy()
    first[1:] &= ~word[:-1]
    cut = offsets[1:-1]
    cut = cut[cut < n]
    first[cut] = word[cut]
    start = np.flatnonzero(first)
    last = word.copy()
    last[:-1] &= ~word[1:]
    last[cut[cut > 0] - 1] = word[cut[cut > 0] - 1]
    end = np.flatnonzero(last) + 1
    # the polynomial of each word, by Horner on positions inside the word: sum of byte * p^(place in word)
    at = np.arange(n, dtype=np.int64)
    begin = np.zeros(n, np.int64)
    begin[start] = start
    np.maximum.accumulate(begin, out=begin)
    place = at - begin
    value = BYTE[data]
    value[~word] = 0
    value *= _powers(P_BYTE, int(place.max()) + 1 if n else 1)[place]
    total = np.add.reduceat(value, start) if len(start) else np.zeros(0, np.uint64)
    hashes = mix64(total + (end - start).astype(np.uint64))
    return hashes, np.searchsorted(start, offsets), start, end


def shingle_hashes(words: np.ndarray, size: int = 5) -> np.ndarray:
    """Distinct hashes of one text's shingles; with fewer words the whole sequence is one, without words there are none."""
    n = len(words)
    if not n:
        return words
    k = min(n, size)
    out = np.zeros(n - k + 1, np.uint64)
    for j in range(k):
        out += words[j : n - k + 1 + j] * np.uint64(pow(P_WORD, j, 1 << 64))
    return np.unique(mix64(out + np.uint64(k)))


def md5_key(*columns):
    """A reproducible hash-random key, the same in every SQL engine: 32 hex digits."""
    return F.md5(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]))
