"""Merge-type subword encoding with seeded merge dropout, and decoding.

The agenda of a word holds its candidate merges, best score first and leftmost on ties. A candidate that comes up is
skipped for good with probability `dropout`, by a hash of (seed, doc_id, text, index of the word, place, sizes of both
parts), so every occurrence of a word is drawn for itself. A worker remembers each word's merges without dropout: they
hold for an occurrence that skips none of them, and the agenda is run for every other. Without dropout the ids are those
of the model.

Pieces hold spaces at their beginning only, so words are segmented apart. Characters outside the vocabulary become
bytes; so does a literal U+2581, which keeps decoding lossless. Null and empty texts have no ids and decode to an
empty text. Null ids count as one id, repeated rows get equal ids and other columns have no effect. An empty table gives
no rows.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalspark.llm.common import mix, pieces, table

DROPOUT, SEED = 0.1, 17
SPACE = "▁"
# Stands for a character outside the vocabulary, whose ids are below.
UNKNOWN = 0xFFFF
# Stands for a null doc_id.
LOWEST = -(2**63)
# Bytes that a worker's memory of segmented words may take, what Python adds to each of them included.
MEMORY = 192 << 20
ENTRY = 300
# Characters whose agendas run side by side.
BLOCK = 1 << 16


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Memory:
    """Ids and merges of words within a bound of bytes.

    Words live in two generations: when the young one has taken half of the bound it becomes the old one, whose words are
    forgotten unless they came up meanwhile.
    """

    def __init__(self, bound: int):
        self.bound, self.size = bound // 2, 0
        self.young: dict[str, tuple[bytes, bytes]] = {}
        self.old: dict[str, tuple[bytes, bytes]] = {}

    def get(self, words: Iterable[str]) -> list[tuple[bytes, bytes] | None]:
        found = list(map(self.young.get, words))
        again = []
        for k, word in enumerate(words):
            if found[k] is None and word in self.old:
                found[k] = self.old.pop(word)
                again.append((word, found[k]))
        if again:
            self.put(*zip(*again, strict=True))
        return found

    def put(self, words: Sequence[str], made: Sequence[tuple[bytes, bytes]]) -> None:
        self.young.update(zip(words, made, strict=True))
        self.size += ENTRY * len(words) + 4 * sum(map(len, words)) + sum(len(ids) + len(merges) for ids, merges in made)
        if self.size > self.bound:
            self.old, self.young, self.size = self.young, {}, 0


class Codec:
    """Vocabulary of a merge-type model, and both directions."""

    def __init__(self, path: str, dropout: float, seed: int, memory: int = MEMORY, merges: bool = True):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.rank: dict[str, float] = {}
        self.id: dict[str, int] = {}
        self.bytes_of: list[bytes] = []
        self.byte_id = [0] * 256
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                value = int(piece[3:5], 16)
                self.byte_id[value] = i
                self.bytes_of.append(bytes([value]))
            elif model.is_control(i) or model.is_unknown(i):
                self.bytes_of.append(b"")
            else:
                text = piece.replace(SPACE, " ")
                self.id[text], self.rank[text] = i, -model.get_score(i)
                self.bytes_of.append(text.encode())
        self.limit, self.seed = int(dropout * 2**32), seed
        self.known = Memory(memory)
        if merges:
            self._pairs()

    def _pairs(self) -> None:
        """Sorted (left id, right id) of all merges, with the score and the id of what they give."""
        keys, ranks, made = [], [], []
        for text, i in self.id.items():
            for k in range(1, len(text)):
                left, right = self.id.get(text[:k]), self.id.get(text[k:])
                if left is not None and right is not None:
                    keys.append(left << 16 | right)
                    ranks.append(self.rank[text])
                    made.append(i)
        order = np.argsort(np.array(keys, np.uint32))
        self.keys = np.array(keys, np.uint32)[order]
        self.ranks, self.made = np.array(ranks, np.float64)[order], np.array(made, np.int64)[order]

    def skipped(self, base: np.ndarray, merges: np.ndarray) -> np.ndarray:
        """Whether occurrences named by base skip the candidates."""
        return (mix(base ^ merges) >> np.uint64(32)).astype(np.int64) < self.limit

    def agenda(self, words: list[str], base: np.ndarray | None = None) -> tuple[list[bytes], list[bytes]]:
        """Ids and merges of many words at once: in every round each word takes the first candidate of its agenda.

        A candidate that is skipped when it comes up never merges, so it is left out as soon as it arises. base names
        the occurrence of each word; without it nothing is skipped.
        """
        out: list[bytes] = [b""] * len(words)
        text = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        lengths = np.array([len(w) for w in words])
        seen, at = np.unique(text, return_inverse=True)
        symbol = np.array([self.id.get(chr(c), UNKNOWN) for c in seen], np.int64)[at]
        word = np.repeat(np.arange(len(words)), lengths)
        start = np.arange(len(text)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        origin, size = np.arange(len(text)), np.ones(len(text), np.int64)
        taken: list[tuple[np.ndarray, np.ndarray]] = []

        def merge(k: np.ndarray, right: np.ndarray) -> np.ndarray:
            """Place and sizes of the candidates of symbols k and right."""
            return (start[k] << 40 | size[k] << 20 | size[right]).astype(np.uint64)

        def score(k: np.ndarray) -> np.ndarray:
            """Score of the candidates of symbols k and k + 1; endless if there is none."""
            right = np.minimum(k + 1, len(symbol) - 1)
            key = (symbol[k] << 16 | symbol[right]).astype(np.uint32)
            place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            good = (self.keys[place] == key) & (k + 1 < len(symbol)) & (word[k] == word[right])
            if base is not None:
                good &= ~self.skipped(base[word[k]], merge(k, right))
            return np.where(good, self.ranks[place], np.inf)

        scores = score(np.arange(len(symbol)))
        while len(symbol):
            begin = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            best = np.minimum.reduceat(scores, begin)
            counts = np.diff(np.append(begin, len(word)))
            over = np.isinf(best)
            if over.any():
                ended = np.repeat(over, counts)
                ids, of, code = symbol[ended], word[ended], text[origin[ended]]
                cuts = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
                odd = np.zeros(len(words), bool)
                odd[of[ids == UNKNOWN]] = True
                data, ends = ids.astype(np.uint32).tobytes(), np.append(cuts[1:], len(of))
                for w, a, b in zip(of[cuts].tolist(), cuts.tolist(), ends.tolist(), strict=True):
                    out[w] = data[4 * a : 4 * b] if not odd[w] else self._with_bytes(ids[a:b], code[a:b])
                alive = ~ended
                symbol, word, start, origin, size, scores = (x[alive] for x in (symbol, word, start, origin, size, scores))
                best, counts = best[~over], counts[~over]
                if not len(symbol):
                    break
            first = np.flatnonzero(scores == np.repeat(best, counts))
            first = first[np.concatenate([[True], word[first][1:] != word[first][:-1]])]
            if base is None:
                taken.append((word[first], merge(first, first + 1)))
            key = (symbol[first] << 16 | symbol[first + 1]).astype(np.uint32)
            symbol[first] = self.made[np.searchsorted(self.keys, key)]
            size[first] += size[first + 1]
            alive = np.ones(len(symbol), bool)
            alive[first + 1] = False
            symbol, word, start, origin, size, scores = (x[alive] for x in (symbol, word, start, origin, size, scores))
            first = first - np.arange(len(first))  # one symbol fewer for each word before
            scores[first] = score(first)
            before = first[first > 0] - 1
            scores[before] = score(before)
        made = [b""] * len(words)
        if taken:
            of, merges = (np.concatenate(x) for x in zip(*taken, strict=True))
            order = np.argsort(of, kind="stable")
            ends = (8 * np.searchsorted(of[order], np.arange(len(words) + 1))).tolist()
            data = merges[order].tobytes()
            made = [data[a:b] for a, b in zip(ends, ends[1:], strict=False)]
        return out, made

    def blocks(self, words: list[str], base: np.ndarray | None = None) -> Iterator[tuple[bytes, bytes]]:
        """Ids and merges of each word; about BLOCK characters are worked on at once."""
        ends = np.cumsum([len(word) for word in words])
        start = 0
        while start < len(words):
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + BLOCK, side="right")))
            yield from zip(*self.agenda(words[start:stop], None if base is None else base[start:stop]), strict=True)
            start = stop

    def _with_bytes(self, ids: np.ndarray, codes: np.ndarray) -> bytes:
        """Ids with characters outside the vocabulary as the ids of their bytes."""
        found = []
        for i, code in zip(ids.tolist(), codes.tolist(), strict=True):
            found += [i] if i != UNKNOWN else [self.byte_id[x] for x in chr(code).encode()]
        return np.array(found, np.uint32).tobytes()

    def encode(self, texts: list[str], doc_ids: list[int | None] | None = None) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        known, flat, ends, bases = self.known, [], [0], []
        for text, doc_id in zip(texts, doc_ids or [None] * len(texts), strict=True):
            words = re.findall(" *[^ ]+| +", " " + text) if text else []
            flat += words
            ends.append(len(flat))
            named = (LOWEST if doc_id is None else doc_id).to_bytes(8, "little", signed=True) + text.encode()
            key = np.uint64(xxhash.xxh3_64_intdigest(named, seed=self.seed))
            bases.append(mix(key + np.arange(len(words), dtype=np.uint64)))
        kinds = {word: k for k, word in enumerate(dict.fromkeys(flat))}
        found = known.get(kinds)
        fresh = [word for word, old in zip(kinds, found, strict=True) if old is None]
        if fresh:
            made = list(self.blocks(fresh))
            known.put(fresh, made)
            new = iter(made)
            found = [next(new) if old is None else old for old in found]
        kind = np.fromiter(map(kinds.__getitem__, flat), np.int64, len(flat))
        ids = [found[k][0] for k in kind.tolist()]
        if self.limit and flat:
            merges = [made for _, made in found]
            counts = np.array([len(x) // 8 for x in merges])
            begin = np.cumsum(counts) - counts
            base, n = np.concatenate(bases), counts[kind]
            of = np.repeat(np.arange(len(flat)), n)
            place = np.arange(len(of)) - np.repeat(np.cumsum(n) - n - begin[kind], n)
            hit = np.zeros(len(flat), bool)
            hit[of[self.skipped(base[of], np.frombuffer(b"".join(merges), np.uint64)[place])]] = True
            again = np.flatnonzero(hit)
            if len(again):
                for k, (made, _) in zip(again.tolist(), self.blocks([flat[k] for k in again.tolist()], base[again]), strict=True):
                    ids[k] = made
        return [b"".join(ids[a:b]) for a, b in zip(ends, ends[1:], strict=False)]

    def decode(self, ids: bytes) -> str:
        data = b"".join([self.bytes_of[i] for i in np.frombuffer(ids, np.uint32).tolist()])
        return data.decode(errors="replace")[1:]


def encode_batches(batches: Iterator[pa.RecordBatch], codec: Codec) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of batches of doc_id and text, and the ids of each row."""
    for whole in batches:
        for batch in pieces(whole, "text"):
            yield batch, codec.encode([t or "" for t in batch.column("text").to_pylist()], batch.column("doc_id").to_pylist())


def encode(docs: DataFrame, path: str | None = None, dropout: float = DROPOUT, seed: int = SEED) -> DataFrame:
    """doc_id, text and ids (little-endian unsigned 32-bit) of every row; without a path each task finds the model itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, ids in encode_batches(batches, Codec(path or model_path(), dropout, seed)):
            columns = [batch.column("doc_id"), batch.column("text"), pa.array(ids, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text", "ids"])

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, "doc_id bigint, text string, ids binary")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """The rows of `encode` with `decoded`, read from ids alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(path or model_path(), 0.0, 0, merges=False)
        for batch in batches:
            texts = pa.array([codec.decode(i) for i in batch.column("ids").to_pylist()], pa.string())
            columns = [*batch.columns, texts]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "decoded"])

    return encoded.mapInArrow(run, "doc_id bigint, text string, ids binary, decoded string")


def op6_merge_dropout(spark: SparkSession, folder: str) -> DataFrame:
    """Every document encoded with merge dropout and decoded again from its ids, in one step over each slice of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(model_path(), DROPOUT, SEED)
        for batch, ids in encode_batches(batches, codec):
            digest, same = [], []
            for text, row in zip(batch.column("text"), ids, strict=True):
                decoded = codec.decode(row)
                digest.append(hashlib.sha256(decoded.encode()).hexdigest())
                same.append(decoded == (text.as_py() or ""))
            counts = pa.array([len(row) // 4 for row in ids], pa.int64())
            columns = [batch.column("doc_id"), counts, pa.array([zlib.crc32(row) for row in ids], pa.int64()), pa.array(digest, pa.string())]
            names = ["doc_id", "n_pieces", "ids_crc32", "decoded_sha256", "lossless"]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(same, pa.bool_())], names)

    schema = "doc_id bigint, n_pieces bigint, ids_crc32 bigint, decoded_sha256 string, lossless boolean"
    return table(spark, folder, "documents").select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, schema)
