"""Substring dedup by fixed-block anchors.

A window of 20 words is removed from every place but its earliest: smallest doc_id, then earliest start in the document.

1. Index: every document is cut into non-overlapping reference blocks of 10 words. Whatever its start, a window of
   20 words holds a whole block of the other place it occurs at.
2. Probe: every rolling run of 10 words of every document is looked up. Hashes travel as packed arrays, dealt by
   hash to shards; the index is repeated over a few salts, so that the probes of one hot block spread over tasks.
3. Extend: around every hit the windows of 20 words are the candidates of an exact repeat. A batch of documents
   settles repeats among its own documents and sends one candidate for each window, so a window that stands in very
   many documents reaches its shard once for each batch. The smallest doc_id wins there, the others are told.
4. Overlapping windows add up to maximal repeats, and their words go.

Null text has no words. Rows with equal doc_id are each compared with smaller ids and with themselves, not with each
other; a null doc_id counts as smaller than any other. Repeated rows get equal results. Windows are judged on the
input. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalspark.llm.common import Bitmap, Words, kept_table, mix, pieces, table, window_hashes

WINDOW, BLOCK = 20, 10
SALTS = 4
# Marks rows of windows that a batch has settled by itself.
SETTLED = 1
LOWEST = -(2**63)


def _shards(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)


def _runs(words: Words, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first word, row) of every run of `size` words inside a row."""
    hashes = window_hashes(words.hash, size)
    rows = words.rows()
    inside = np.flatnonzero(rows[: len(hashes)] == rows[size - 1 :]) if len(hashes) else np.zeros(0, int)
    return hashes[inside], inside, rows[inside]


def _ids(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("__id").to_numpy(zero_copy_only=False).astype(np.int64)


def _keyed(docs: DataFrame, *columns: str) -> DataFrame:
    return docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(LOWEST)).alias("__id"), *columns)


REQUEST = "shard int, salt int, ids binary, sizes binary, hashes binary"


def _requests(shard: np.ndarray, salt: int, row: np.ndarray, ids: np.ndarray, hashes: np.ndarray) -> list[tuple]:
    """One packed row for each shard: hashes in order of their documents, and how many each document has."""
    order = np.lexsort((row, shard))
    shard, row, hashes = shard[order], row[order], hashes[order]
    cuts = np.flatnonzero(np.diff(shard)) + 1
    out = []
    for s, r, h in zip(np.split(shard, cuts), np.split(row, cuts), np.split(hashes, cuts), strict=True):
        if len(s):
            own, sizes = np.unique(r, return_counts=True)
            out.append((int(s[0]), salt, ids[own].tobytes(), sizes.astype(np.uint32).tobytes(), h.tobytes()))
    return out


def _request_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["shard", "salt", "ids", "sizes", "hashes"]
    )


def _answers(owner: np.ndarray, hashes: np.ndarray, shards: int) -> list[tuple]:
    """Hashes for documents, packed like requests and dealt by document."""
    ids, row = np.unique(owner, return_inverse=True)
    return _requests((mix(ids.view(np.uint64)) % np.uint64(shards)).astype(np.int32)[row], 0, row, ids, hashes)


def _by_document(answers: DataFrame, kind: type, shards: int) -> DataFrame:
    """(_id, found): one row for each document with its hashes; the answers stay packed until they meet here."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owners, hashes = [], []
        for batch in batches:
            for ids, sizes, found in zip(*(batch.column(c).to_pylist() for c in ("ids", "sizes", "hashes")), strict=True):
                owners.append(np.repeat(np.frombuffer(ids, np.int64), np.frombuffer(sizes, np.uint32)))
                hashes.append(np.frombuffer(found, kind))
        if owners:
            owner, found = np.concatenate(owners), np.concatenate(hashes)
            order = np.argsort(owner, kind="stable")
            owner, found = owner[order], found[order]
            cuts = np.flatnonzero(np.diff(owner)) + 1
            values = pa.array([np.unique(v).tobytes() for v in np.split(found, cuts)], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(owner[np.concatenate([[0], cuts])]), values], ["__id", "found"])

    return answers.repartition(shards, "shard").mapInArrow(gather, "__id bigint, found binary")


def block_hits(docs: DataFrame) -> DataFrame:
    """(_id, found): 32-bit hashes of those runs of 10 words of a document that are a reference block elsewhere.

    A hash that meets another by chance only adds a candidate, which the extension drops.
    """
    shards = _shards(docs.sparkSession)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, "text"):
                words, ids = Words(batch.column("text")), _ids(batch)
                hashes, first, row = _runs(words, BLOCK)
                if not len(hashes):
                    continue
                fixed = (first - words.row_at[row]) % BLOCK == 0
                shard = ((hashes >> np.uint64(32)) % np.uint64(shards)).astype(np.int32)
                short = hashes.astype(np.uint32)
                rows = []
                # Blocks are index entries for all salts, and probes like the others for one of them.
                for salt in range(SALTS):
                    rows += _requests(shard[fixed], -1 - salt, row[fixed], ids, short[fixed])
                salt = int(ids[0] % SALTS)
                rows += _requests(shard[fixed], salt, row[fixed], ids, short[fixed])
                rows += _requests(shard[~fixed], SALTS + salt, row[~fixed], ids, short[~fixed])
                yield _request_batch(rows)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, probes = defaultdict(list), defaultdict(list)
        for batch in batches:
            for shard, salt, ids, sizes, hashes in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if salt < 0:
                    index[shard, -1 - salt].append(np.frombuffer(hashes, np.uint32))
                else:
                    probes[shard, salt % SALTS].append((salt < SALTS, ids, sizes, hashes))
        for key, asked in probes.items():
            known, times = np.unique(np.concatenate(index[key]), return_counts=True) if key in index else (np.zeros(0, np.uint32), None)
            if not len(known):
                continue
            owners, found = [], []
            for is_block, ids, sizes, hashes in asked:
                h = np.frombuffer(hashes, np.uint32)
                place = np.minimum(np.searchsorted(known, h), len(known) - 1)
                hit = known[place] == h
                if is_block:
                    hit &= times[place] > 1
                owners.append(np.repeat(np.frombuffer(ids, np.int64), np.frombuffer(sizes, np.uint32))[hit])
                found.append(h[hit])
            rows = _answers(np.concatenate(owners), np.concatenate(found), shards)
            if rows:
                yield _request_batch(rows)

    asked = _keyed(docs, "text").mapInArrow(ask, REQUEST)
    # The salt that an entry is for; index entries carry it as a negative number.
    lane = F.when(F.col("salt") < 0, -1 - F.col("salt")).otherwise(F.col("salt") % SALTS)
    return _by_document(asked.repartition(shards, "shard", lane).mapInArrow(meet, REQUEST), np.uint32, shards)


def repeated_windows(docs: DataFrame) -> DataFrame:
    """(_id, found): 64-bit hashes of the windows of a document that stand in a document with a smaller id.

    A document that repeats only its own windows has a row, too.
    """
    spark = docs.sparkSession
    shards = _shards(spark)
    hits = kept_table(block_hits(docs), "hits")
    texts = Bitmap(hits, "__id").split(_keyed(docs, "text"), "__id", True)
    joined = texts.join(hits, "__id")

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, "text"):
                words, ids = Words(batch.column("text")), _ids(batch)
                hashes, first, row = _runs(words, BLOCK)
                found = [np.frombuffer(v, np.uint32) for v in batch.column("found").to_pylist()]
                near = np.zeros(len(words.hash) + 1, np.int64)
                cuts = np.searchsorted(row, np.arange(len(ids) + 1))
                for k, wanted in enumerate(found):
                    part = slice(cuts[k], cuts[k + 1])
                    at = first[part][np.isin(hashes[part].astype(np.uint32), wanted)]
                    np.add.at(near, np.maximum(at - (WINDOW - BLOCK), words.row_at[k]), 1)
                    np.add.at(near, at + 1, -1)
                near = np.cumsum(near)[:-1] > 0
                hashes, first, row = _runs(words, WINDOW)
                taken = near[first]
                hashes, row = hashes[taken], row[taken]
                if not len(hashes):
                    continue
                # The smallest id of the batch speaks for a window; its other documents have lost it already.
                order = np.lexsort((ids[row], hashes))
                h, i, r = hashes[order], ids[row][order], row[order]
                lead = np.concatenate([[True], h[1:] != h[:-1]])
                best = i[np.flatnonzero(lead)][np.cumsum(lead) - 1]
                # A document that repeats its own window gets an answer too, which is no loss by itself.
                lost = ~lead & (i > best)
                owner, gone = i[lost], h[lost]
                own = np.unique(i[~lead & (i == best)])
                owner, gone = np.concatenate([owner, own]), np.concatenate([gone, np.zeros(len(own), np.uint64)])
                rows = _requests((h[lead] % np.uint64(shards)).astype(np.int32), 0, r[lead], ids, h[lead])
                rows += [(shard, SETTLED, *rest) for shard, _, *rest in _answers(owner, gone, shards)]
                yield _request_batch(rows)

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = defaultdict(list)
        for batch in batches:
            rows = []
            for shard, kind, ids, sizes, hashes in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if kind == SETTLED:
                    rows.append((shard, kind, ids, sizes, hashes))
                    continue
                owner = np.repeat(np.frombuffer(ids, np.int64), np.frombuffer(sizes, np.uint32))
                asked[shard].append((owner, np.frombuffer(hashes, np.uint64)))
            if rows:
                yield _request_batch(rows)
        for parts in asked.values():
            owner, hashes = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.lexsort((owner, hashes))
            owner, hashes = owner[order], hashes[order]
            lead = np.concatenate([[True], hashes[1:] != hashes[:-1]])
            lost = owner > owner[np.flatnonzero(lead)][np.cumsum(lead) - 1]
            rows = _answers(owner[lost], hashes[lost], shards)
            if rows:
                yield _request_batch(rows)

    asked = joined.select("__id", "text", "found").mapInArrow(extend, REQUEST)
    return _by_document(asked.repartition(shards, "shard").mapInArrow(decide, REQUEST), np.uint64, shards)


def _kept(batch: pa.RecordBatch, losses: list | None) -> Iterator[tuple[int, int, bytes, bool]]:
    """(words, removed words, kept words joined by a space) of each row."""
    texts = batch.column("text").to_pylist()
    if losses is None:
        for text in texts:
            words = (text or "").encode().split()
            yield len(words), 0, b" ".join(words)
        return
    words = Words(batch.column("text"))
    hashes, first, row = _runs(words, WINDOW)
    cuts = np.searchsorted(row, np.arange(len(texts) + 1))
    for k, text in enumerate(texts):
        h, at = hashes[cuts[k] : cuts[k + 1]], first[cuts[k] : cuts[k + 1]] - words.row_at[k]
        gone = np.ones(len(h), bool)
        gone[np.unique(h, return_index=True)[1]] = False  # a window's later places in the document itself
        if losses[k]:
            gone |= np.isin(h, np.frombuffer(losses[k], np.uint64))
        step = np.zeros(words.count[k] + 1, np.int64)
        np.add.at(step, at[gone], 1)
        np.add.at(step, at[gone] + WINDOW, -1)
        covered = np.cumsum(step)[:-1] > 0
        parts = (text or "").encode().split()
        yield len(parts), int(covered.sum()), b" ".join([w for w, c in zip(parts, covered, strict=True) if not c])


def without(docs: DataFrame, make: Callable, schema: str) -> DataFrame:
    """Apply `make(batch, rows of _kept)` to every document; documents with no repeat are not shuffled."""
    told = kept_table(repeated_windows(docs), "repeats")
    marks = Bitmap(told, "__id")
    keyed = _keyed(docs, "*")

    def plain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, "text"):
                yield make(batch, list(_kept(batch, None)))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, "text"):
                yield make(batch, list(_kept(batch, batch.column("__found").to_pylist())))

    losses = told.withColumnRenamed("found", "__found")
    repeated = marks.split(keyed, "__id", True).join(losses, "__id", "left")
    return marks.split(keyed, "__id", False, plain, schema).union(repeated.mapInArrow(cut, schema))


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and the digest of the kept words."""

    def make(batch, rows):
        return pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id").cast(pa.int64()),
                pa.array([r[0] for r in rows], pa.int64()),
                pa.array([r[1] for r in rows], pa.int64()),
                pa.array([hashlib.sha256(r[2]).hexdigest() for r in rows]),
            ],
            ["doc_id", "n_words", "n_removed", "kept_sha256"],
        )

    schema = "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string"
    return without(docs.select("doc_id", "text"), make, schema)


def without_repeats(docs: DataFrame) -> DataFrame:
    """The rows with repeated passages cut out; rows that lose all their words go. n_chars follows the new text."""
    names, schema = docs.columns, docs.schema

    def make(batch, rows):
        texts = batch.column("text").to_pylist()
        new = [r[2].decode() if r[1] else t for r, t in zip(rows, texts, strict=True)]
        columns = {c: batch.column(c) for c in names} | {"text": pa.array(new, pa.string())}
        if "n_chars" in columns:
            kind = columns["n_chars"].type
            old = columns["n_chars"].to_pylist()
            columns["n_chars"] = pa.array([len(t) if r[1] else n for r, t, n in zip(rows, new, old, strict=True)], kind)
        left = [not r[1] or r[0] > r[1] for r in rows]
        return pa.RecordBatch.from_arrays(list(columns.values()), list(columns)).filter(pa.array(left, pa.bool_()))

    return without(docs, make, schema)


def op10_fixed_anchors(spark: SparkSession, folder: str) -> DataFrame:
    """Words of every document that a repeated window of 20 words covers."""
    return digests(table(spark, folder, "documents"))
