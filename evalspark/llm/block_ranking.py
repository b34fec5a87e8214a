"""Ranked lexical search over posting lists that are blocked by document similarity.

Documents are tokenised once into a forward table: the terms of the query block that a document holds, how often, and
its number of terms. Document frequencies and lengths come from that table over all documents. A task cuts its part of
the table into shards of bounded size and answers all queries in each. In a shard, the posting list of a term is
clustered: representatives are taken from it, every document joins the most similar one by a random projection of its
weighted vector, and each block stores the largest value of every coordinate among its documents. For a query the sum
of weight times that maximum bounds the score of any document of the block. Lists are taken by falling bound, blocks
too, and a list or block is skipped only when its bound is below the k-th best score so far, or equal to it with no
smaller doc_id in the block; documents of the others are scored exactly. Results therefore are those of a full scan. The
best k per query go on from shard to shard, and a task returns at most k rows per query.

All weights and scores are whole numbers. Null texts and texts without terms are in no list and count nowhere. Null ids
rank last among equal scores and stay null; repeated ids are documents of their own, and so are rows of one item_id
queries of their own. Other columns are ignored. Without queries or documents there are no rows. Queries are read in
blocks of QUERIES rows, so what every task gets is bounded by the queries and not by the documents.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evalspark.llm.common import Words, kept_table, pieces, table

# [^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]: the bytes between terms.
GAPS = np.zeros(256, bool)
GAPS[:0x30] = GAPS[0x3A:0x41] = GAPS[0x5B:0x61] = GAPS[0x7B:0x80] = True
TOP = 10
QUERIES = 1000
# Forward entries of a shard, documents a block should hold, and dimensions of the projection.
SHARD, BLOCK, AXES = 500_000, 64, 16
# Stands for a null doc_id in comparisons.
LAST = 2**63 - 1


class Vocabulary:
    """Terms of a query block, numbered by their hash; plain arrays, so that tasks need not have the package."""

    def __init__(self, words: Words):
        self.hash, first = np.unique(words.hash, return_index=True)
        self.at = np.stack([words.first[first], words.last[first]], axis=1)
        self.data = words.data

    def find(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """(word, term) of the words that are terms here; hashes find them and bytes decide."""
        if not len(self.hash):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        term = np.minimum(np.searchsorted(self.hash, words.hash), len(self.hash) - 1)
        size = self.at[term, 1] - self.at[term, 0]
        word = np.flatnonzero((self.hash[term] == words.hash) & (size == words.last - words.first))
        term, size = term[word], size[word]
        ends = np.cumsum(size)
        place = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - size, size)
        same = words.data[np.repeat(words.first[word], size) + place] == self.data[np.repeat(self.at[term, 0], size) + place]
        wrong = np.repeat(np.arange(len(word)), size)[~same]
        keep = np.ones(len(word), bool)
        keep[wrong] = False
        return word[keep], term[keep]


def counts(words: Words, known: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, term, occurrences) of the known terms, by row and term."""
    word, term = known.find(words)
    key, times = np.unique(words.rows()[word] * len(known.hash) + term, return_counts=True)
    return key // max(len(known.hash), 1), key % max(len(known.hash), 1), times


def forward_table(docs: DataFrame, known: Vocabulary, doc_id: str, text: str) -> DataFrame:
    """doc_id, n and the known terms `u` with their counts `tf` of every document that has a term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                words = Words(part.column("text"), lower=True, gaps=GAPS)
                row, term, times = counts(words, known)
                offsets = pa.array(np.searchsorted(row, np.arange(part.num_rows + 1)), pa.int32())
                lists = [pa.ListArray.from_arrays(offsets, pa.array(v, pa.int32())) for v in (term, times)]
                out = pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(words.count, pa.int64()), *lists], ["doc_id", "n", "u", "tf"])
                yield out.filter(pa.array(words.count > 0))

    picked = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return picked.mapInArrow(run, "doc_id bigint, n bigint, u array<int>, tf array<int>")


class Shard:
    """Part of the index: forward rows and posting lists, each blocked when a query first needs it."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, u: np.ndarray, value: np.ndarray, weight: np.ndarray, axes: np.ndarray):
        self.ids, self.rows, self.u, self.value, self.width = ids, rows, u, value, len(weight)
        order = np.argsort(u, kind="stable")
        self.posting = np.repeat(np.arange(len(ids)), np.diff(rows))[order]
        self.lists = np.searchsorted(u[order], np.arange(self.width + 1))
        self.most = np.zeros(self.width, np.int64)
        held = np.flatnonzero(np.diff(self.lists))
        if len(held):
            self.most[held] = np.maximum.reduceat(value[order], self.lists[held])
        parts = axes[u] * (weight[u] * value).astype(np.float32)[:, None]
        self.place = np.add.reduceat(parts, rows[:-1], axis=0) if len(u) else np.zeros((len(ids), axes.shape[1]), np.float32)
        self.place /= np.maximum(np.linalg.norm(self.place, axis=1, keepdims=True), np.float32(1e-12))
        self.blocked: dict[int, tuple] = {}

    def entries(self, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Forward entries of some documents and the number of each document's."""
        size = self.rows[docs + 1] - self.rows[docs]
        ends = np.cumsum(size)
        return np.arange(ends[-1]) + np.repeat(self.rows[docs] - (ends - size), size), size

    def blocks(self, term: int) -> tuple:
        """(documents by block, start of each block, its least id, summary terms, their maxima, start of each summary)."""
        if term in self.blocked:
            return self.blocked[term]
        docs = self.posting[self.lists[term] : self.lists[term + 1]]
        wanted = -(-len(docs) // BLOCK)
        if wanted > 1:
            chosen = docs[np.arange(wanted) * len(docs) // wanted]
            near = np.argmax(self.place[docs] @ self.place[chosen].T, axis=1)
            order = np.argsort(near, kind="stable")
            docs, near = docs[order], near[order]
            starts = np.flatnonzero(np.diff(near, prepend=-1))
        else:
            starts = np.zeros(1, np.int64)
        at, size = self.entries(docs)
        block = np.repeat(np.searchsorted(starts, np.arange(len(docs)), side="right") - 1, size)
        largest = np.zeros(len(starts) * self.width, np.int64)
        np.maximum.at(largest, block * self.width + self.u[at], self.value[at])
        kept = np.flatnonzero(largest)
        found = (
            docs, np.append(starts, len(docs)), np.minimum.reduceat(self.ids[docs], starts),
            kept % self.width, largest[kept], np.searchsorted(kept, np.arange(len(starts)) * self.width),
        )
        self.blocked[term] = found
        return found

    def scores(self, docs: np.ndarray, wq: np.ndarray) -> np.ndarray:
        at, size = self.entries(docs)
        return np.add.reduceat(wq[self.u[at]] * self.value[at], np.cumsum(size) - size)

    def search(self, terms: np.ndarray, wq: np.ndarray, best: tuple[np.ndarray, np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray]:
        """The best k of the documents here and those found before; `wq` holds the query's weights and zeros."""
        score, ids = best
        bound = wq[terms] * self.most[terms]
        order = np.argsort(bound, kind="stable")
        terms, total = terms[order], np.cumsum(bound[order])
        seen = np.zeros(len(self.ids), bool)
        for term, rest in zip(terms[::-1].tolist(), total[::-1].tolist()):
            # Documents whose terms all stand in the lists from here on score `rest` at most.
            if rest == 0 or (len(score) == k and rest < score[-1]):
                break
            docs, starts, least, u, value, at = self.blocks(term)
            bounds = np.add.reduceat(wq[u] * value, at)
            todo = np.argsort(-bounds, kind="stable")
            step = 2
            while len(todo):
                if len(score) == k:
                    todo = todo[(bounds[todo] > score[-1]) | ((bounds[todo] == score[-1]) & (least[todo] < ids[-1]))]
                now, todo, step = todo[:step], todo[step:], 2 * step
                if not len(now):
                    break
                near = np.concatenate([docs[starts[b] : starts[b + 1]] for b in now.tolist()])
                near = near[~seen[near]]
                seen[near] = True
                if not len(near):
                    continue
                found = self.scores(near, wq)
                take = found >= (score[-1] if len(score) == k else 1)
                score, ids = np.concatenate([score, found[take]]), np.concatenate([ids, self.ids[near[take]]])
                first = np.lexsort([ids, -score])[:k]
                score, ids = score[first], ids[first]
        return score, ids


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    """(doc_id, n, row starts, u, tf) of bounded runs of forward rows."""
    for batch in batches:
        ids = batch.column("doc_id").fill_null(LAST).to_numpy()
        n, u, tf = batch.column("n").to_numpy(), batch.column("u").flatten().to_numpy(), batch.column("tf").flatten().to_numpy()
        ends = np.cumsum(batch.column("u").value_lengths().to_numpy())
        row = 0
        while row < len(ids):
            before = int(ends[row - 1]) if row else 0
            stop = max(row + 1, int(np.searchsorted(ends, before + SHARD, side="right")))
            rows = np.concatenate([[before], ends[row:stop]]).astype(np.int64)
            yield ids[row:stop], n[row:stop], rows - before, u[before : rows[-1]], tf[before : rows[-1]]
            row = stop


def _search_block(docs: DataFrame, block: list, top: int, doc_id: str, text: str) -> DataFrame:
    """(query, doc_id, score): the best of every partition for each query of the block."""
    words = Words(pa.array([t for _, t in block], pa.string()), lower=True, gaps=GAPS)
    known = Vocabulary(words)
    row, term, _ = counts(words, known)
    asked = [term[row == q] for q in range(len(block))]
    forward = kept_table(forward_table(docs, known, doc_id, text), "forward")
    size = forward.agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("terms")).first()
    n_docs, n_terms = size["docs"], size["terms"] or 1
    weight = np.zeros(len(known.hash), np.int64)
    # One row per term of the query block at most.
    for u, df in forward.select(F.explode("u").alias("u")).groupBy("u").count().collect():
        weight[u] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))
    axes = np.random.Generator(np.random.PCG64(11)).normal(size=(len(weight), AXES)).astype(np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in asked]
        for ids, n, rows, u, tf in _shards(batches):
            m = 10 + (90 * n * n_docs) // n_terms
            tf = tf.astype(np.int64)
            value = (1_000_000_000 * tf) // (1000 * tf + 8 * np.repeat(m, np.diff(rows)))
            shard, wq = Shard(ids, rows, u.astype(np.int64), value, weight, axes), np.zeros(len(weight), np.int64)
            for q, terms in enumerate(asked):
                wq[terms] = weight[terms]
                best[q] = shard.search(terms, wq, best[q], top)
                wq[terms] = 0
        query = np.repeat(np.arange(len(best)), [len(s) for s, _ in best])
        if len(query):
            ids = np.concatenate([i for _, i in best])
            yield pa.RecordBatch.from_arrays(
                [pa.array(query, pa.int32()), pa.array(ids, pa.int64(), mask=ids == LAST), pa.array(np.concatenate([s for s, _ in best]))],
                ["query", "doc_id", "score"],
            )

    return forward.where(F.size("u") > 0).mapInArrow(run, "query int, doc_id bigint, score bigint")


def _best(rows: DataFrame, by: list, top: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def rank(
    docs: DataFrame, queries: DataFrame, top: int = TOP, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id"
) -> DataFrame:
    """item_id, rank, doc_id and score of the `top` best documents of every query with a score above 0."""
    spark = docs.sparkSession
    asked = queries.select(F.col(item_id).alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    kind = asked.schema["item_id"].dataType.simpleString()
    out, block = None, []

    def answer(block: list) -> DataFrame:
        # First the best per hash slice, so that no task meets the rows of every partition for one query.
        found = _search_block(docs, block, top, doc_id, text)
        found = _best(found.withColumn("slice", F.pmod(F.hash("doc_id"), F.lit(16))), ["query", "slice"], top)
        found = _best(found.select("query", "doc_id", "score"), ["query"], top)
        names = spark.createDataFrame([(q, i) for q, (i, _) in enumerate(block)], f"query int, item_id {kind}")
        return found.join(F.broadcast(names), "query").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")

    for row in asked.toLocalIterator():
        block.append((row["item_id"], row["text"]))
        if len(block) == QUERIES:
            out, block = answer(block) if out is None else out.union(answer(block)), []
    if block:
        out = answer(block) if out is None else out.union(answer(block))
    return out if out is not None else spark.createDataFrame([], f"item_id {kind}, rank int, doc_id bigint, score bigint")


def op11_block_ranking(spark: SparkSession, folder: str) -> DataFrame:
    return rank(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


_TERMS = "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
SQL = f"""WITH d AS (SELECT doc_id, {_TERMS} AS t FROM documents WHERE text IS NOT NULL),
n AS (SELECT doc_id, len(t) AS n FROM d WHERE len(t) > 0),
s AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM n),
tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(t) AS term FROM d) GROUP BY 1, 2),
q AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark WHERE text IS NOT NULL),
w AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, s GROUP BY term, docs),
m AS (SELECT doc_id, 10 + (90 * n * docs) // terms AS m FROM n, s),
sc AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
  FROM q JOIN tf USING (term) JOIN w USING (term) JOIN m USING (doc_id) GROUP BY 1, 2)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM sc WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 10"""
