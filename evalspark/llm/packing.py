"""Packing along a space-filling curve.

Each document is tokenised once; its token ids are hashed with random signs into a few dimensions, the place in that
space gives a Hilbert key, and documents are range-sorted by the key. The token streams of neighbours follow each
other, cut into sequences of `length` tokens, so only the very last sequence is padded (or not, at a power of two).

Only (key, size) rows are sorted; the ids are written once and joined to their places by row. Ties of the key, such as
copies, are ordered by doc_id, content hash and row, so a hot key is spread over many tasks. A null text is a document of
one closing token; null ids sort first; repeated rows are documents of their own; other columns are ignored. An empty
table gives no rows.
"""

from __future__ import annotations

import base64
import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evalspark.llm.common import ODD, kept_table, mix, pieces, table

LENGTH = 2048
CLOSE = 1
DIMENSIONS, BITS = 4, 15
# Words with their tokens that a worker remembers.
MEMORY = 400_000
# Latin letters, and marks before them, come before this character.
LATIN_END = "\u0250"
# A space that white space or the end follows; the tokenizer may then join white space.
LOOSE_SPACE = re.compile(r" (?=\s|\Z)")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def rank_path() -> str:
    """The vocabulary of `tokenizer_path` as ranks."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


class Encoder:
    """Token ids as the tokenizer gives them; words seen before are looked up.

    A word with the space before it is encoded alone, which the tokenizer itself does, as long as no white space
    follows that space; texts with other spacing or with a special token are encoded whole. With `ranks`, the same
    vocabulary for a faster library, that library encodes words of Latin letters, where both give equal ids.
    """

    def __init__(self, path: str, ranks: str | None = None):
        from tokenizers import Tokenizer

        self.fast = None
        if ranks:
            import public_tokenizers
            import tiktoken

            with open(ranks, "rb") as lines:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            self.fast = tiktoken.Encoding("words", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.inner = Tokenizer.from_file(path)
        self.specials = [t.content for t in self.inner.get_added_tokens_decoder().values()]
        self.known: dict[str, bytes] = {}

    def _words(self, words: list[str]) -> None:
        """Remember the ids of words, each with a space before it."""
        if self.fast:
            encode = self.fast.encode_ordinary
            for w in words:
                if w.isascii() or max(w) < LATIN_END:
                    self.known[w] = array("I", encode(" " + w)).tobytes()
            words = [w for w in words if w not in self.known]
        self.known.update(zip(words, self._bytes([" " + w for w in words]), strict=True))

    def _bytes(self, texts: list[str]) -> list[bytes]:
        found = self.inner.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, np.uint32).tobytes() for e in found]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        split: list[list[str] | None] = []
        fresh: set[str] = set()
        known = self.known
        for text in texts:
            whole = LOOSE_SPACE.search(text) or any(s in text for s in self.specials)
            words = None if whole else text.split(" ")
            split.append(words)
            if words is not None:
                fresh.update(set(words[1:]).difference(known))
        if len(known) + len(fresh) > MEMORY:
            known.clear()
            fresh = {w for words in split if words is not None for w in words[1:]}
        self._words(list(fresh))
        # First words have no space before them.
        heads = self._bytes([text if words is None else words[0] for words, text in zip(split, texts, strict=True)])
        return [
            head if words is None else head + b"".join(map(known.__getitem__, words[1:]))
            for head, words in zip(heads, split, strict=True)
        ]


def signs(ids: np.ndarray) -> np.ndarray:
    """Random signs of token ids, one column for each dimension."""
    bits = mix(ids.astype(np.uint64) * ODD + np.uint64(7))
    return np.stack([((bits >> np.uint64(k)) & np.uint64(1)).astype(np.float64) * 2 - 1 for k in range(DIMENSIONS)], axis=1)


def places(vectors: np.ndarray) -> np.ndarray:
    """Whole-number coordinates below 2**BITS; a vector's entries are roughly normal with variance one."""
    return ((np.arctan(vectors) / np.pi + 0.5) * (2**BITS - 1)).astype(np.int64)


def hilbert_keys(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place of each row of coordinates on a Hilbert curve, by Gray-code steps from the highest bit on."""
    x = [points[:, k].copy() for k in range(points.shape[1])]
    n = len(x)
    for b in range(bits - 1, 0, -1):
        q = 1 << b
        low = q - 1
        for i in range(n):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(high, x[0] ^ low, x[0] ^ swap)
            if i:
                x[i] = x[i] ^ swap
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        q = 1 << b
        flip = np.where((x[-1] & q) != 0, flip ^ (q - 1), flip)
    key = np.zeros(len(points), np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | (((x[i] ^ flip) >> b) & 1)
    return key


def id_type(path: str) -> type:
    """Ids of a vocabulary below 2**16 travel in two bytes."""
    return np.uint16 if Encoder(path).inner.get_vocab_size(with_added_tokens=True) < 1 << 16 else np.uint32


def tokens(docs: DataFrame, path: str, kind: type, close: int = CLOSE, ranks: str | None = None) -> DataFrame:
    """doc_id, curve key, number of tokens, ids, and a hash of them, per document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path, ranks)
        end = np.array([close], np.uint32).tobytes()
        table_of_signs = signs(np.arange(encoder.inner.get_vocab_size(with_added_tokens=True) + 1))
        for whole in batches:
            for batch in pieces(whole, "text"):
                ids = [i + end for i in encoder.encode([t or "" for t in batch.column("text").to_pylist()])]
                sizes = np.array([len(i) // 4 for i in ids])
                at = np.concatenate([[0], np.cumsum(sizes)[:-1]])
                sums = np.add.reduceat(table_of_signs[np.frombuffer(b"".join(ids), np.uint32)], at, axis=0)
                keys = hilbert_keys(places(sums / np.sqrt(sizes)[:, None]))
                crc = [zlib.crc32(i) for i in ids]
                small = [np.frombuffer(i, np.uint32).astype(kind).tobytes() for i in ids]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array(keys), pa.array(sizes), pa.array(crc, pa.int64()), pa.array(small, pa.binary())],
                    ["doc_id", "key", "n", "crc", "ids"],
                )

    schema = "doc_id bigint, key bigint, n bigint, crc bigint, ids binary"
    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, schema)


PIECES = (
    "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, "
    "curve_key bigint"
)


def pack(docs: DataFrame, path: str | None = None, length: int = LENGTH, ranks: str | None = None) -> DataFrame:
    """Pieces of all documents in sequences of `length` tokens, neighbours on the curve after each other."""
    if path is None:
        path, ranks = tokenizer_path(), rank_path()
    # The row number is fixed by writing it.
    kind = id_type(path)
    encoded = kept_table(tokens(docs, path, kind, ranks=ranks).withColumn("row", F.monotonically_increasing_id()), "tokens")
    small = encoded.select("row", "doc_id", "key", "n", "crc")
    order = ["key", "doc_id", "crc", "row"]
    ranged = small.repartitionByRange(*order).sortWithinPartitions(*order)
    # monotonically_increasing_id: partition in the upper bits, place within it in the lower 33.
    placed = kept_table(ranged.withColumn("_at", F.monotonically_increasing_id()), "order")
    placed = placed.withColumn("_part", F.shiftright("_at", 33))
    # One row for each range partition: few, and bounded by the number of partitions.
    parts = placed.groupBy("_part").agg(F.sum("n").alias("total"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("_part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.withColumn("_in", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(F.broadcast(parts), "_part")
    starts = starts.select("row", (F.col("_in") + F.col("_base")).alias("at"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            columns = [batch.column(c).to_pylist() for c in ("doc_id", "key", "n", "at", "ids")]
            for doc_id, key, n, at, ids in zip(*columns, strict=True):
                wide = np.frombuffer(ids, kind).astype(np.uint32)
                start = 0
                while start < n:
                    sequence, offset = divmod(at + start, length)
                    size = min(n - start, length - offset)
                    out.append((doc_id, start, size, zlib.crc32(wide[start : start + size].tobytes()), n, sequence, offset, key))
                    start += size
            if out:
                names = [part.split()[0] for part in PIECES.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names)

    return encoded.select("row", "doc_id", "key", "n", "ids").join(starts, "row").drop("row").mapInArrow(run, PIECES)


def op3_curve_packing(spark: SparkSession, folder: str) -> DataFrame:
    """All documents in sequences of 2048 tokens."""
    return pack(table(spark, folder, "documents"))
