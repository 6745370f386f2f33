"""Operator 10: line dedup with DataFrame functions only; decisions are bitmaps, not texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairn.llm.common import materialize, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
STRIPPED = " \t\n\x0b\x0c\r"


def lines_of(text: Column) -> Column:
    """The lines of a text; null and empty texts have one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z alone; plain lower() where no other letter can be met."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def keys_of(text: Column) -> Column:
    """A 128-bit key for each line, null for a line that has no characters to compare."""

    def key(line: Column) -> Column:
        k = F.btrim(line, F.lit(STRIPPED))
        return F.when(k != "", F.struct(F.xxhash64(k).alias("h1"), F.xxhash64(F.lit(1), k, F.lit(2)).alias("h2")))

    return F.transform(lines_of(ascii_lower(F.coalesce(text, F.lit("")))), key)


def row_key() -> list[Column]:
    """Tells rows apart that share a doc_id; equal rows share their decisions."""
    return [F.coalesce(F.col("doc_id"), F.lit(-1)).alias("id"), F.col("doc_id").isNull().alias("no_id"), F.xxhash64("text").alias("t")]


ROW = ["id", "no_id", "t"]


def heavy_keys(lines: DataFrame, partitions: int) -> DataFrame:
    """h1 and pieces: keys whose lines would fill much of a task, and in how many pieces to deal them.

    A sketch of bounded size finds them; what it says decides only how lines
    are dealt, never which lines go. At most 4 keys for each partition are heavy.
    """
    most = 4 * partitions
    top = lines.agg(F.expr(f"approx_top_k(h1, {most}, {max(10_000, 4 * most)})").alias("top"), F.count(F.lit(1)).alias("n"))
    each = F.ceil(F.col("n") / most)
    return top.select(F.explode("top").alias("x"), each.alias("each")).where("x.count > each").select(F.col("x.item").alias("h1"), F.ceil(F.col("x.count") / F.col("each")).alias("pieces"))


def streamed_lines(lines: DataFrame, heavy: DataFrame) -> DataFrame:
    """Adds heavy, new (the first line of a document with an id in its group), n_docs and is_first of each line's group, a key or a piece of one."""
    # the broadcast table has at most 4 rows for each partition
    dealt = lines.join(F.broadcast(heavy), "h1", "left").withColumn("heavy", F.col("pieces").isNotNull())
    dealt = dealt.withColumn("piece", F.when(F.col("heavy"), F.pmod(F.xxhash64("id", "no_id"), F.col("pieces"))).otherwise(F.lit(0))).drop("pieces")
    group = ["h1", "h2", "piece"]
    ranged = dealt.repartitionByRange(*group)
    by = Window.partitionBy(*group).orderBy("no_id", "id", "t", "p")
    whole = by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    new = (~F.col("no_id") & ~F.lag("id").over(by).eqNullSafe(F.col("id"))).cast("long")
    streamed = ranged.withColumn("new", new).withColumns({"n_docs": F.sum("new").over(whole), "is_first": F.row_number().over(by) == 1})
    return streamed


def drop_bitmaps(docs: DataFrame, min_docs: int = 10, keep_first: bool = False) -> DataFrame:
    """id, no_id, t and drop_words: for each document that loses lines, the set words of its bitmap.

    Bit p % 64 of word p / 64 says that line p goes; words without a set bit
    are left out, which compresses bitmaps of long documents with few drops.

    Line hashes are partitioned by range, and each range is sorted by hash,
    document and position, so that a window streams over the occurrences of a
    key in order: it counts the key's documents and finds its first
    occurrence. A heavy key is cut into pieces by document, which the ranges
    spread over tasks; the counts and first occurrences of its pieces then
    meet in a table with one row for each heavy key. Keys in at least
    `min_docs` documents lose all their lines, or all but the first by
    (document, position) with keep_first.
    """
    spark = docs.sparkSession
    keyed = materialize(docs.select(*row_key(), keys_of(F.col("text")).alias("keys")), "linekeys")
    lines = keyed.select(*ROW, F.posexplode("keys").alias("p", "k")).where("k is not null").select(*ROW, "p", "k.h1", "k.h2")
    heavy = materialize(heavy_keys(lines.select("h1"), int(spark.conf.get("spark.sql.shuffle.partitions"))), "heavykeys")
    streamed = streamed_lines(lines, heavy)
    marks = materialize(streamed.where(F.col("heavy") | (F.col("n_docs") >= min_docs)), "linemarks")
    place = F.struct("no_id", "id", "t", "p")
    totals = marks.where("heavy").groupBy("h1", "h2").agg(F.sum("new").alias("all_docs"), F.min(place).alias("first"))
    hits = marks.join(F.broadcast(totals), ["h1", "h2"], "left").where(F.coalesce("all_docs", "n_docs") >= min_docs)
    if keep_first:
        hits = hits.where(~F.when(F.col("heavy"), place == F.col("first")).otherwise(F.col("is_first")))
    words = hits.groupBy(*ROW, F.floor(F.col("p") / 64).cast("int").alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("p") % 64).cast("int"))).alias("bits"))
    return words.groupBy(*ROW).agg(F.map_from_entries(F.collect_list(F.struct("w", "bits"))).alias("drop_words"))


def _dense(n_lines: Column, sparse: Column) -> Column:
    """The bitmap as an array, for access by number."""
    return F.transform(F.sequence(F.lit(0), F.floor((n_lines - 1) / 64).cast("int")), lambda w: F.coalesce(F.element_at(sparse, w), F.lit(0).cast("long")))


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """row (all columns of docs), kept_text, n_lines and n_dropped."""
    id_, no_id, t = row_key()
    b = bitmaps.select(*[F.col(c).alias(f"b_{c}") for c in ROW], "drop_words")
    left = docs.select(F.struct("*").alias("row"), id_, no_id, t)
    on = (F.col("id") == F.col("b_id")) & (F.col("no_id") == F.col("b_no_id")) & (F.col("t") == F.col("b_t"))
    lines = lines_of(F.col("row.text"))
    n = F.size(lines)
    word = lambda i: F.element_at(F.col("bits"), (F.floor(i / 64) + 1).cast("int"))
    bit = lambda i: F.call_function("shiftrightunsigned", word(i), (i % 64).cast("int")).bitwiseAND(F.lit(1).cast("long"))
    joined = left.join(b, on, "left").withColumn("bits", F.when(F.col("drop_words").isNotNull(), _dense(n, F.col("drop_words"))))
    kept = F.array_join(F.filter(lines, lambda _, i: bit(i) == 0), "\n")
    dropped = F.coalesce(F.aggregate(F.map_values("drop_words"), F.lit(0), lambda a, x: a + F.bit_count(x)), F.lit(0))
    text = F.when(F.col("drop_words").isNull(), F.coalesce(F.col("row.text"), F.lit(""))).otherwise(kept)
    return joined.select("row", text.alias("kept_text"), n.cast("long").alias("n_lines"), dropped.cast("long").alias("n_dropped"))


def dedup_lines(docs: DataFrame, min_docs: int = 10, keep_first: bool = False) -> DataFrame:
    """row (all columns of docs), kept_text, n_lines and n_dropped.

    Null and empty texts are one empty line, which is always kept. A key's
    documents are the different ids of its rows, so rows that share a doc_id
    count once and rows without one don't count; all of them lose their lines
    with frequent keys. Equal rows get equal decisions. Other columns stay
    inside row, whatever their names; an empty table gives no rows.
    """
    return apply_bitmaps(docs, drop_bitmaps(docs.select("doc_id", "text"), min_docs, keep_first))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """dedup_lines() of all documents, texts as hashes; nulls, ties, repeated rows and empty tables as stated there."""
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(F.col("row.doc_id").alias("doc_id"), "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


OP10_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
raw AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS p FROM d),
l AS (SELECT doc_id, p, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM raw),
hot AS (SELECT k FROM l WHERE k <> '' GROUP BY k HAVING count(DISTINCT doc_id) >= 10),
f AS (SELECT l.*, (hot.k IS NOT NULL) AS gone FROM l LEFT JOIN hot ON l.k = hot.k)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CAST(gone AS INT)) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY p) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM f GROUP BY doc_id
"""
