"""Operator 13: ranked lexical search by the threshold algorithm over shards of documents."""

from __future__ import annotations

from math import floor, log

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairn.llm.common import materialize, small_batches, table, utf8_rows, word_hashes

#: Bytes that end a term: all of ASCII but digits and letters.
GAP = np.arange(256) < 128
GAP[[*range(48, 58), *range(65, 91), *range(97, 123)]] = False
#: Postings of a shard, entries that a list gives in a first round, and items' terms that are searched at once.
SHARD_POSTINGS, ROUND, BLOCK_TERMS = 2_000_000, 32, 1_000_000


def item_terms(items: DataFrame) -> DataFrame:
    """item_id and term (a hash), each pair once."""
    kind = items.schema["item_id"].dataType.simpleString()

    def terms(batches):
        import pyarrow as pa

        for b in batches:
            hashes, first, *_ = word_hashes(*utf8_rows(b.column(1)), GAP)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(np.repeat(np.arange(b.num_rows), np.diff(first)))), pa.array(hashes.view(np.int64))], names=["item_id", "term"])

    return items.select("item_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(terms, f"item_id {kind}, term long").distinct()


def forward_index(docs: DataFrame, terms) -> DataFrame:
    """doc_id, n (the terms of a document, with repeats), and which of the broadcast terms it holds how often."""

    def count(batches):
        import pyarrow as pa

        known = terms.value
        for b in batches:
            hashes, first, *_ = word_hashes(*utf8_rows(b.column(1)), GAP)
            hashes, row = hashes.view(np.int64), np.repeat(np.arange(b.num_rows), np.diff(first))
            at = np.minimum(np.searchsorted(known, hashes), max(0, len(known) - 1))
            hit = known[at] == hashes if len(known) else np.zeros(len(hashes), bool)
            pairs, tf = np.unique(row[hit] * max(1, len(known)) + at[hit], return_counts=True)
            ends = pa.array(np.searchsorted(pairs, np.arange(b.num_rows + 1) * max(1, len(known))).astype(np.int32))
            lists = [pa.ListArray.from_arrays(ends, pa.array(x.astype(np.int32))) for x in (pairs % max(1, len(known)), tf)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.diff(first)), *lists], names=["doc_id", "n", "terms", "tf"])

    return docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(count, "doc_id long, n long, terms array<int>, tf array<int>")


class Shard:
    """Documents as a forward index and as lists of each term's documents by falling impact."""

    def __init__(self, ids: np.ndarray, no_id: np.ndarray, counts: np.ndarray, terms: np.ndarray, impacts: np.ndarray, n_terms: int):
        self.ids, self.no_id, self.terms, self.impacts = ids, no_id, terms, impacts
        self.ends = np.r_[0, np.cumsum(counts)]
        docs = np.repeat(np.arange(len(ids)), counts)
        order = np.lexsort((-impacts, terms))
        self.list_docs, self.list_impacts = docs[order], impacts[order]
        self.list_ends = np.searchsorted(terms[order], np.arange(n_terms + 1))

    def scores(self, docs: np.ndarray, asked: np.ndarray) -> np.ndarray:
        """Whole scores of documents, by looking them up in the forward index."""
        n = self.ends[docs + 1] - self.ends[docs]
        past = np.cumsum(n)
        at = np.arange(int(n.sum())) + np.repeat(self.ends[docs] - (past - n), n)
        total = np.r_[0, np.cumsum(np.where(asked[self.terms[at]], self.impacts[at], 0))]
        return total[past] - total[past - n]

    def best(self, of: np.ndarray, asked: np.ndarray, k: int, floor_: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """The k best documents for the terms `of` and their scores, none below floor_, equal scores by id.

        The threshold algorithm: the lists give their next entries in turn, all
        new documents are scored whole, and it ends when what documents not
        seen can score at most, the sum of the lists' last impacts, is strictly
        below the kth score. So all documents that tie with the kth were seen.
        """
        lists = [(self.list_ends[t], self.list_ends[t + 1]) for t in of.tolist()]
        lists = [x for x in lists if x[0] < x[1]]
        seen, docs, scores = np.zeros(len(self.ids), bool), np.zeros(0, np.int64), np.zeros(0, np.int64)
        depth, step = 0, ROUND
        while lists:
            new = np.unique(np.concatenate([self.list_docs[x + depth : min(x + depth + step, y)] for x, y in lists]))
            depth, step = depth + step, 2 * step
            new = new[~seen[new]]
            seen[new] = True
            got = self.scores(new, asked)
            good = got >= max(1, floor_)
            docs, scores = np.concatenate([docs, new[good]]), np.concatenate([scores, got[good]])
            order = np.lexsort((self.ids[docs], self.no_id[docs], -scores))[:k]
            docs, scores = docs[order], scores[order]
            lists = [(x, y) for x, y in lists if x + depth < y]
            threshold = sum(int(self.list_impacts[x + depth - 1]) for x, y in lists)
            kth = int(scores[-1]) if len(scores) == k else 0
            if threshold < max(kth, floor_, 1):
                break
        return docs, scores


def shard_hits(forward: DataFrame, lists, weights, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """item, doc_id and score: for each task of forward's rows the k best documents of each item.

    A task holds one shard at a time. What an item's kth document scores in a
    task's shards so far is a floor for the next ones.
    """

    def shards(batches):
        held, size = [], 0
        for b in batches:
            counts = np.diff(np.asarray(b.column(2).offsets))
            no_id = np.asarray(b.column(0).is_null())
            held.append((np.asarray(b.column(0).fill_null(0)), no_id, np.asarray(b.column(1)), counts, np.asarray(b.column(2).flatten()), np.asarray(b.column(3).flatten()).astype(np.int64)))
            size += len(held[-1][4])
            if size >= SHARD_POSTINGS:
                yield [np.concatenate(x) for x in zip(*held, strict=True)]
                held, size = [], 0
        if held:
            yield [np.concatenate(x) for x in zip(*held, strict=True)]

    def search(batches):
        import pyarrow as pa

        (terms, ends), w = lists.value, weights.value
        top: list = [(np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64))] * (len(ends) - 1)
        for ids, no_id, n, counts, held, tf in shards(batches):
            m = np.repeat(10 + 90 * n * n_docs // max(1, n_terms), counts)
            shard = Shard(ids, no_id, counts, held, w[held] * (1_000_000_000 * tf // (1000 * tf + 8 * m)), len(w))
            asked = np.zeros(len(w), bool)
            for i, (x, y) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)):
                of = terms[x:y]
                asked[of] = True
                old = top[i]
                docs, scores = shard.best(of, asked, k, int(old[2][-1]) if len(old[2]) == k else 0)
                asked[of] = False
                if len(docs):
                    both = [np.concatenate(p) for p in zip(old, (ids[docs], no_id[docs], scores), strict=True)]
                    order = np.lexsort((both[0], both[1], -both[2]))[:k]
                    top[i] = tuple(v[order] for v in both)
        for i, (ids, no_id, scores) in enumerate(top):
            if len(ids):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), i)), pa.array(ids, mask=no_id), pa.array(scores)], names=["item", "doc_id", "score"])

    return forward.mapInArrow(search, "item long, doc_id long, score long")


def search_block(docs: DataFrame, pairs: DataFrame, k: int) -> DataFrame:
    """item_id, rank, doc_id and score for the items of pairs (item_id, term), which fit in memory."""
    spark = docs.sparkSession
    known = pairs.collect()
    items = list(dict.fromkeys(r.item_id for r in known))
    number = {x: i for i, x in enumerate(items)}
    codes = np.array([number[r.item_id] for r in known], np.int64)
    vocabulary, term = np.unique(np.array([r.term for r in known], np.int64), return_inverse=True)
    order = np.lexsort((term, codes))
    lists = term[order], np.searchsorted(codes[order], np.arange(len(items) + 1))
    forward = materialize(forward_index(docs, spark.sparkContext.broadcast(vocabulary)), "forward")
    n_docs, n_terms = forward.agg(F.sum((F.col("n") > 0).cast("long")), F.sum("n")).first()
    df = {t: n for t, n in forward.select(F.explode("terms").alias("t")).groupBy("t").count().collect()}  # a row for each term of the items at most
    w = np.array([floor(1000 * log((2 * (n_docs or 0) + 2) / (2 * df.get(i, 0) + 1))) for i in range(len(vocabulary))], np.int64)
    hits = shard_hits(forward, spark.sparkContext.broadcast(lists), spark.sparkContext.broadcast(w), n_docs or 0, n_terms or 0, k)
    by = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = hits.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)
    names = spark.createDataFrame(list(enumerate(items)), f"item long, item_id {pairs.schema['item_id'].dataType.simpleString()}")
    return ranked.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")


def search_ranked(docs: DataFrame, items: DataFrame, k: int = 10, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """item_id, rank, doc_id and score: each item's k best documents with a score above 0, equal scores by ascending doc_id.

    Documents are dealt into shards; each shard's lists and forward index are
    searched by the threshold algorithm for all items, and the shards' best
    are ranked. The items' terms are broadcast, at most `block_terms` or those
    of one item at a time; more items go in blocks, each with a pass of its
    own. Of the corpus only N, L and the counts of the items' terms are
    gathered.

    Rows that share an item_id are one item with the terms of all of them; an
    item without terms, or whose terms no document holds, has no rows. Null
    texts have no terms. Each row of docs is a document: repeated rows rank
    one after another, rows without an id after those with one. Other columns
    are ignored; empty tables give no rows. Terms are compared by 64-bit
    hashes.
    """
    small_batches(docs.sparkSession)
    pairs = materialize(item_terms(items), "terms")
    blocks = max(1, -(-pairs.count() // block_terms))
    out = None
    for i in range(blocks):
        part = search_block(docs, pairs.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == i), k)
        out = part if out is None else out.unionByName(part)
    return out


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """search_ranked() of all documents for each benchmark item; nulls, ties, repeated rows and empty tables as stated there."""
    return search_ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark").select("item_id", "text"))


OP13_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
s AS (SELECT CAST(count(*) AS BIGINT) AS n_docs, CAST(sum(len(ts)) AS BIGINT) AS n_terms FROM d WHERE len(ts) > 0),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark),
p AS (SELECT r, t, CAST(count(*) AS BIGINT) AS tf FROM (SELECT r, unnest(ts) AS t FROM d) WHERE t IN (SELECT t FROM q) GROUP BY r, t),
w AS (SELECT t, CAST(floor(1000 * ln((2 * n_docs + 2) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM p, s GROUP BY t, n_docs),
x AS (SELECT p.r, d.doc_id, p.t, w.w * ((1000000000 * p.tf) // (1000 * p.tf + 8 * (10 + (90 * len(d.ts) * s.n_docs) // s.n_terms))) AS v FROM p JOIN w ON p.t = w.t JOIN d ON p.r = d.r, s),
y AS (SELECT q.item_id, x.doc_id, x.r, CAST(sum(x.v) AS BIGINT) AS score FROM q JOIN x ON q.t = x.t GROUP BY q.item_id, x.doc_id, x.r),
z AS (SELECT item_id, doc_id, score, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS INT) AS rank FROM y WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM z WHERE rank <= 10
"""
