"""Byte-pair encoding with word ends by tree concatenation, and decoding.

Texts are cut at the tokenizer's special tokens, normalised and split into pieces as its file says. A piece of at most
LEAF symbols is encoded by agenda: the mergeable pair of lowest rank first, the leftmost on ties. A longer one is halved
until every part is that short; all parts of a batch are encoded together, as rows of one matrix. Then neighbours are
joined level by level: the last tokens of the left side and the first of the right one are taken back to symbols and
encoded again, in a window that doubles on each side that disagrees, until its first token is the left side's and its
last token the right side's. All neighbouring tokens then stand as some encoding has put them next to each other, and
a sequence of which that holds is the encoding of the whole: no merge crosses a border before another border is crossed.

Ids equal those of the tokenizer, decoding is its tokens joined by a space. Null and empty texts have no ids and decode
to an empty text. Null or repeated ids, repeated rows and other columns have no effect: rows are independent. An
empty table gives no rows. A piece is bounded by its text; beside that a task holds about 60 bytes per symbol of a step.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalspark.llm.common import pieces, table

# Longest run of symbols that is encoded without halving.
LEAF = 16
# Runs of symbols from this length on use a heap, since a matrix row costs the square of its length.
LONG = 128
# Symbols in one matrix.
CELLS = 1 << 21
# Bytes of text in one step.
STEP = 1 << 21
NONE = np.int32(2**31 - 1)
# Fixed value: pieces of a text, as the tokenizer's file has it.
PIECE = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable bytes for themselves, the others from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class TreeCodec:
    """Vocabulary and merges of a tokenizer file, and both directions."""

    def __init__(self, path: str):
        import regex

        self.path = path
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        model = file["model"]
        kinds = [n["type"] for n in file["normalizer"]["normalizers"]]
        split = file["pre_tokenizer"]["pretokenizers"][0]
        if (model["type"], kinds, split["pattern"]) != ("BPE", ["NFC", "Replace", "Lowercase"], {"Regex": PIECE}) or file["decoder"]:
            raise ValueError(f"{path} is not a tokenizer of this kind")
        vocabulary, end = model["vocab"], model["end_of_word_suffix"]
        self.special = {t["content"]: t["id"] for t in file["added_tokens"]}
        if any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in file["added_tokens"]):
            raise ValueError("special tokens must stand for themselves")
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.piece = regex.compile(PIECE)
        names = {**vocabulary, **self.special}
        tokens = [""] * (max(names.values()) + 1)
        for name, i in names.items():
            tokens[i] = name
        self.tokens = pa.array(tokens)
        letters = byte_letters()
        self.inner = np.array([vocabulary[c] for c in letters], np.int32)
        self.last = np.array([vocabulary[c + end] for c in letters], np.int32)
        self._merges(model["merges"], vocabulary)
        self.pairs: dict[int, int] = {}
        self._library = None

    def _merges(self, merges: list, vocabulary: dict[str, int]) -> None:
        symbols = {int(i): (int(i),) for i in (*self.inner, *self.last)}
        keys, made = [], []
        for merge in merges:
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            a, b, c = vocabulary[left], vocabulary[right], vocabulary[left + right]
            keys.append(a << 32 | b)
            made.append(c)
            symbols.setdefault(c, symbols[a] + symbols[b])
        keys, self.made = np.array(keys, np.int64), np.array(made, np.int32)
        self.rank_of = np.argsort(keys, kind="stable").astype(np.int32)
        self.keys = np.append(keys[self.rank_of], np.int64(2**62))
        self.rank_of = np.append(self.rank_of, NONE)
        self.symbols = [symbols.get(i, ()) for i in range(len(self.tokens))]

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Place in the list of merges of each pair of ids, NONE for those that do not merge."""
        key = left.astype(np.int64) << 32 | right
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.rank_of[at], NONE)

    # ---- runs of symbols

    def _rows(self, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of symbol runs of one length, as rows that are filled from the left, and the number of ids of each."""
        out, count = m.copy(), np.full(len(m), m.shape[1])
        live, width = np.arange(len(m)), m.shape[1]
        rank = self.ranks(m[:, :-1], m[:, 1:])
        while width > 1:
            at = rank.argmin(axis=1)
            best = rank[np.arange(len(m)), at]
            on = best != NONE
            if not on.all():
                out[live[~on], :width], count[live[~on]] = m[~on], width
                live, m, rank, at, best = live[on], m[on], rank[on], at[on], best[on]
            if not len(live):
                return out, count
            row, width = np.arange(len(m)), width - 1
            column = np.arange(width)
            m = np.take_along_axis(m, column + (column > at[:, None]), 1)
            m[row, at] = self.made[best]
            column = column[:-1]
            rank = np.take_along_axis(rank, column + (column > at[:, None]), 1)
            for side in (at - 1, at):
                has = (side >= 0) & (side < width - 1)
                r, c = row[has], side[has]
                rank[r, c] = self.ranks(m[r, c], m[r, c + 1])
        out[live, :1], count[live] = m, 1
        return out, count

    def _heap(self, symbols: np.ndarray) -> np.ndarray:
        """Ids of one long symbol run."""
        if not self.pairs:
            self.pairs = dict(zip(self.keys.tolist(), self.rank_of.tolist()))
        ids, ranks = symbols.tolist(), self.ranks(symbols[:-1], symbols[1:]).tolist()
        n, none = len(ids), int(NONE)
        made, after, before = self.made, list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i) for i, r in enumerate(ranks) if r != none]
        heapq.heapify(heap)
        ranks.append(none)
        while heap:
            rank, i = heapq.heappop(heap)
            if ranks[i] != rank:
                continue
            gone = after[i]
            ids[i], ranks[gone], after[i] = int(made[rank]), -1, after[gone]
            ids[gone] = -1
            if after[i] < n:
                before[after[i]] = i
            for left in (before[i], i):
                right = after[left] if left >= 0 else n
                if left >= 0:
                    ranks[left] = self.pairs.get(ids[left] << 32 | ids[right], none) if right < n else none
                    if ranks[left] != none:
                        heapq.heappush(heap, (ranks[left], left))
        found = np.array(ids, np.int32)
        return found[found >= 0]

    def runs(self, runs: list[np.ndarray]) -> list[np.ndarray]:
        """Ids of every symbol run; runs of equal length are encoded together."""
        out: list[np.ndarray] = [np.zeros(0, np.int32)] * len(runs)
        sizes = np.array([len(r) for r in runs], np.int64)
        for size in np.unique(sizes):
            at = np.flatnonzero(sizes == size)
            if size >= LONG:
                for i in at:
                    out[i] = self._heap(runs[i])
            elif size:
                step = max(1, CELLS // int(size))
                for k in range(0, len(at), step):
                    rows, count = self._rows(np.stack([runs[i] for i in at[k : k + step]]))
                    for i, row, n in zip(at[k : k + step].tolist(), rows, count.tolist()):
                        out[i] = row[:n]
        return out

    def halves(self, symbols: np.ndarray) -> list[np.ndarray]:
        """The run halved until no part is longer than LEAF, a power of two parts."""
        parts = 1
        while len(symbols) > LEAF * parts:
            parts *= 2
        cuts = np.arange(parts + 1) * len(symbols) // parts
        return [symbols[a:b] for a, b in zip(cuts[:-1], cuts[1:])]

    def window(self, left: np.ndarray, right: np.ndarray, i: int, j: int) -> np.ndarray:
        """Symbols of the last i tokens of one side and the first j of the other."""
        ids = [*left[len(left) - i :].tolist(), *right[:j].tolist()]
        return np.array([s for t in ids for s in self.symbols[t]], np.int32)

    def join(self, sides: list[tuple[np.ndarray, np.ndarray]]) -> list[np.ndarray]:
        """Encoding of each left side followed by its right side."""
        out: list[np.ndarray] = [np.zeros(0, np.int32)] * len(sides)
        open_ = [(k, min(2, len(a)), min(2, len(b))) for k, (a, b) in enumerate(sides)]
        while open_:
            again = []
            for (k, i, j), w in zip(open_, self.runs([self.window(*sides[k], i, j) for k, i, j in open_])):
                a, b = sides[k]
                fits_left = i == len(a) or w[0] == a[len(a) - i]
                fits_right = j == len(b) or w[-1] == b[j - 1]
                if fits_left and fits_right:
                    out[k] = np.concatenate([a[: len(a) - i], w, b[j:]])
                else:
                    again.append((k, i if fits_left else min(2 * i, len(a)), j if fits_right else min(2 * j, len(b))))
            open_ = again
        return out

    def tree(self, long: list[np.ndarray]) -> list[np.ndarray]:
        """Encodings of long symbol runs: parts together, then pairs of neighbours level by level."""
        parts = [self.halves(symbols) for symbols in long]
        flat = self.runs([p for each in parts for p in each])
        done = np.cumsum([0] + [len(each) for each in parts])
        parts = [flat[a:b] for a, b in zip(done[:-1], done[1:])]
        while any(len(each) > 1 for each in parts):
            pairs = [(each[k], each[k + 1]) for each in parts for k in range(0, len(each) - 1, 2)]
            joined = iter(self.join(pairs))
            parts = [[next(joined) for _ in range(len(each) // 2)] or each for each in parts]
        return [each[0] for each in parts]

    # ---- texts

    def words(self, text: str) -> list[str]:
        """Pieces of a text in order; special tokens are marked by a space before them."""
        if "<|" not in text:
            return self._words(text)
        out: list[str] = []
        for part in self.cut.split(text):
            out += [" " + part] if part in self.special else self._words(part)
        return out

    def _words(self, text: str) -> list[str]:
        # Characters that this Python does not know yet are left to the tokenizer's own tables.
        if not text.isascii() and any(unicodedata.category(c) == "Cn" for c in set(text)):
            if self._library is None:
                from tokenizers import Tokenizer

                self._library = Tokenizer.from_file(self.path)
            clean = self._library.normalizer.normalize_str(text)
            letters = {c: b for b, c in enumerate(byte_letters())}
            found = self._library.pre_tokenizer.pre_tokenize_str(clean)
            return [bytes(letters[c] for c in w).decode() for w, _ in found]
        # Lower-casing is by character, so a sigma at a word's end is like any other; white space is never in a piece.
        return self.piece.findall(unicodedata.normalize("NFC", text).replace("Σ", "σ").lower())

    def encode_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words one after another, and the place where each word's begin."""
        data, at = np.frombuffer(words.buffers()[2] or b"", np.uint8), np.frombuffer(words.buffers()[1], np.int32)
        at = at[words.offset : words.offset + len(words) + 1].astype(np.int64)
        sizes = np.diff(at)
        special = data[at[:-1]] == 32
        out: list[np.ndarray] = [np.zeros(0, np.int32)] * len(words)
        count = np.zeros(len(words), np.int64)
        groups = []
        for size in np.unique(sizes[~special & (sizes <= LEAF)]).tolist():
            rows = np.flatnonzero((sizes == size) & ~special)
            m = data[at[rows][:, None] + np.arange(size)]
            m = np.concatenate([self.inner[m[:, :-1]], self.last[m[:, -1:]]], axis=1)
            for k in range(0, len(rows), CELLS // size):
                ids, n = self._rows(m[k : k + CELLS // size])
                groups.append((rows[k : k + CELLS // size], ids, n))
                count[rows[k : k + CELLS // size]] = n
        rest = np.flatnonzero(special | (sizes > LEAF))
        long = [k for k in rest.tolist() if not special[k]]
        runs = []
        for k in long:
            run = data[at[k] : at[k + 1]]
            runs.append(np.append(self.inner[run[:-1]], self.last[run[-1]]))
        for k, ids in zip(long, self.tree(runs)):
            out[k], count[k] = ids, len(ids)
        for k in rest[special[rest]].tolist():
            out[k], count[k] = np.array([self.special[words[k].as_py()[1:]]], np.int32), 1
        starts = np.concatenate([[0], np.cumsum(count)])
        flat = np.zeros(starts[-1], np.int32)
        for rows, ids, n in groups:
            inside = np.arange(ids.shape[1]) < n[:, None]
            flat[(starts[rows][:, None] + np.arange(ids.shape[1]))[inside]] = ids[inside]
        for k in rest.tolist():
            flat[starts[k] : starts[k + 1]] = out[k]
        return flat, starts

    def encode(self, texts: pa.Array) -> pa.ListArray:
        """Ids of every text; a word that stands often in the texts is encoded once."""
        words, rows = [], [0]
        for text in texts.to_pylist():
            if text:
                words += self.words(text)
            rows.append(len(words))
        if not words:
            return pa.ListArray.from_arrays(pa.array(rows, pa.int32()), pa.array([], pa.int32()))
        coded = pa.array(words, pa.string()).dictionary_encode()
        flat, starts = self.encode_words(coded.dictionary)
        code = coded.indices.to_numpy()
        size = np.diff(starts)[code]
        ends = np.cumsum(size)
        at = np.arange(ends[-1]) + np.repeat(starts[code] - (ends - size), size)
        offsets = np.concatenate([[0], ends])[rows]
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat[at]))

    def decode(self, ids: pa.ListArray) -> pa.Array:
        """Tokens of each list of ids, joined by a space."""
        flat = ids.flatten()
        offsets = pa.array(np.concatenate([[0], np.cumsum(ids.value_lengths().fill_null(0).to_numpy())]), pa.int32())
        return pc.binary_join(pa.ListArray.from_arrays(offsets, self.tokens.take(flat)), " ")


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """The column `text` replaced by its `ids`; rows of other columns stay."""
    kept = docs.drop("text", "ids")
    schema = kept.withColumn("ids", F.array().cast("array<int>")).schema
    names = kept.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = TreeCodec(path or model_path())
        for batch in batches:
            for part in pieces(batch, "text", STEP):
                columns = [part.column(n) for n in names]
                yield pa.RecordBatch.from_arrays([*columns, codec.encode(part.column("text"))], names=[*names, "ids"])

    return docs.select(*names, F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """Adds `decoded`, the text of the column `ids`."""
    names = [c for c in encoded.columns if c != "decoded"]
    schema = encoded.select(*names, F.lit("").alias("decoded")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = TreeCodec(path or model_path())
        for batch in batches:
            step = 256
            for k in range(0, batch.num_rows, step):
                part = batch.slice(k, step)
                columns = [part.column(n) for n in names]
                yield pa.RecordBatch.from_arrays([*columns, codec.decode(part.column("ids"))], names=[*names, "decoded"])

    return encoded.select(*names).mapInArrow(run, schema)


def op13_tree_bpe(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return decode(encode(docs)).select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
