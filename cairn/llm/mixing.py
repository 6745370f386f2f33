"""Operator 1: mixing sources to target weights, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairn.llm.common import WORD, materialize, md5_key, table

#: Hex digits of the key that name a range: 4096 ranges of equal width for each source.
RANGE_DIGITS = 3


def word_count():
    return F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")


def source_key():
    """'0' and the name, or '1' for null: sorts by code point with null last."""
    return F.when(F.col("source").isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col("source")))


def source_targets(totals: DataFrame, weights: tuple[int, ...], share: float, most_epochs: float) -> DataFrame:
    """Adds target to totals(skey, source_size), which has one row for each source.

    Water filling in closed form: with the sources ordered by limit over
    weight, the level of the first source that stays below its limit is the
    level of all sources after it; the ones before have their limits. The
    windows run over one row for each source, never over documents.
    """
    ranked = totals.withColumn("rank", F.row_number().over(Window.orderBy("skey")) - 1)
    ws = F.array(*[F.lit(w) for w in weights])
    ranked = ranked.withColumn("weight", F.element_at(ws, (F.col("rank") % len(weights) + 1).cast("int"))).withColumn("limit", F.lit(float(most_epochs)) * F.col("source_size"))
    order = Window.orderBy(F.col("limit") / F.col("weight"), "skey")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    all_ = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.lit(share) * F.sum("source_size").over(all_) - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    leveled = ranked.withColumn("level", level)
    first = F.min(F.when(F.col("level") * F.col("weight") <= F.col("limit"), F.struct((F.col("limit") / F.col("weight")).alias("at"), "skey", "level"))).over(all_)
    return leveled.withColumn("target", F.least(F.col("limit"), F.col("weight") * F.coalesce(first["level"], F.lit(0.0)))).select("skey", "source_size", "target")


def mixture(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most_epochs: float = 2.0) -> DataFrame:
    """doc_id, size, source_size, target, taken, epochs, part, skey and t (a hash of the text) of every row of docs.

    Within its source a document has a hash-random key. Keys are cut into
    4096 ranges of equal width, which are spread over the cluster and sorted;
    a document's place in the order of its source is the sum of the ranges
    before (one row for each range) and of the rows before in its own range.
    A source gives its whole epochs and then, in that order, documents up to
    its exact budget; the document at the cut gives a part.

    Null texts have size 0, a null source is a source of its own and comes
    last, rows with equal ids and sizes tie and are interchangeable. A source
    of size 0 has target 0; an empty table gives no rows.
    """
    sized = materialize(docs.select("doc_id", source_key().alias("skey"), word_count().alias("size"), F.xxhash64("text").alias("t")).withColumn("key", md5_key("doc_id", "size")).withColumn("span", F.substring("key", 1, RANGE_DIGITS)), "sized")
    spans = materialize(sized.groupBy("skey", "span").agg(F.sum("size").alias("span_size")), "spans")
    targets = source_targets(spans.groupBy("skey").agg(F.sum("span_size").alias("source_size")), weights, share, most_epochs)
    by_span = Window.partitionBy("skey").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    offsets = spans.withColumn("span_before", F.coalesce(F.sum("span_size").over(by_span), F.lit(0))).drop("span_size").join(targets, "skey")
    in_span = Window.partitionBy("skey", "span").orderBy("key", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    placed = sized.withColumn("rows_before", F.coalesce(F.sum("size").over(in_span), F.lit(0))).join(offsets, ["skey", "span"])
    budget = F.round("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    placed = placed.withColumn("epochs", epochs).withColumn("rest", budget - F.col("epochs") * F.col("source_size")).withColumn("before", F.col("span_before") + F.col("rows_before"))
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("before"))).cast("long")
    return placed.select("doc_id", "size", "source_size", "target", (F.col("epochs") * F.col("size") + part).alias("taken"), "epochs", part.alias("part"), "skey", "t")


def mix(docs: DataFrame, **how) -> DataFrame:
    """The rows of docs that the mixture takes, each as often as it takes them.

    Documents stay whole: the one at a source's cut is taken if at least half
    of it is within the budget. Rows that share a doc_id, source and text get
    the same number of copies as their first one.
    """
    m = mixture(docs, **how)
    copies = m.groupBy("doc_id", "skey", "t").agg(F.max(F.col("epochs") + F.when(F.col("size") > 0, (2 * F.col("part") >= F.col("size")).cast("long")).otherwise(F.lit(0))).alias("_copies"))
    c = copies.where("_copies > 0").select(F.col("doc_id").alias("c_id"), F.col("skey").alias("c_skey"), F.col("t").alias("c_t"), F.col("_copies").alias("copies"))
    left = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("m_id"), source_key().alias("m_skey"), F.xxhash64("text").alias("m_t"))
    on = F.col("m_id").eqNullSafe(F.col("c_id")) & (F.col("m_skey") == F.col("c_skey")) & (F.col("m_t") == F.col("c_t"))
    return left.join(c, on).select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """mixture() of all documents; nulls, ties, repeated rows and empty tables as stated there."""
    return mixture(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP1_SQL = r"""
WITH sized AS (SELECT doc_id, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS skey,
    CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
keyed AS (SELECT *, md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|' || CAST(size AS VARCHAR)) AS key FROM sized),
totals AS (SELECT skey, CAST(sum(size) AS BIGINT) AS source_size FROM keyed GROUP BY skey),
ranked AS (SELECT *, [5, 2, 1][CAST((row_number() OVER (ORDER BY skey) - 1) % 3 + 1 AS INT)] AS weight, 2.0::DOUBLE * source_size AS lim FROM totals),
leveled AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(lim) OVER (ORDER BY lim / weight, skey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
    / sum(weight) OVER (ORDER BY lim / weight, skey ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lvl FROM ranked),
base AS (SELECT coalesce((SELECT lvl FROM leveled WHERE lvl * weight <= lim ORDER BY lim / weight, skey LIMIT 1), 0.0) AS lvl),
targets AS (SELECT skey, source_size, least(lim, weight * base.lvl) AS target FROM leveled, base),
placed AS (SELECT k.doc_id, k.size, t.source_size, t.target, CAST(round(t.target) AS BIGINT) AS budget,
    CAST(coalesce(sum(size) OVER (PARTITION BY k.skey ORDER BY key, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before
  FROM keyed k JOIN targets t ON k.skey = t.skey)
SELECT doc_id, size, source_size, target, CAST(CASE WHEN source_size = 0 THEN 0 ELSE budget // source_size * size
    + greatest(0, least(size, budget % source_size - before)) END AS BIGINT) AS taken FROM placed
"""
