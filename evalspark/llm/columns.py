"""Substring dedup with a column-wise multi-document construction.

Every byte goes that a 400-byte string covers which also starts elsewhere, judged on the input.

1. Anchors: of the rolling hashes of 32 bytes the smallest in any window of 400 bytes. Equal windows have equal
   anchors, at the same offset. A row holds the anchor, a hash of all bytes that a window with the anchor can
   reach (its surroundings), and the place.
2. Surroundings that occur at two places are repeated as a whole. Kinds of surroundings of an anchor that share
   half of a window send one segment of bytes each.
3. Columns: segments of an anchor stand below each other, anchor under anchor, so equal windows start in the same
   column. From the last column to the first each round inserts one symbol of every segment: the order of the
   suffixes is carried on by a stable sort on the symbol, as in a multi-document Burrows-Wheeler transform, and the
   lengths of common prefixes by minima over the order before. A window is repeated where a common prefix with a
   neighbour in the order has 400 bytes or more.

The construction over whole documents needs as many sequential rounds as the longest document has bytes, each over
the transform of the whole collection; aligned segments bound it to 768 rounds over a few thousand segments, and shuffles
by anchor take the place of its external files. Anchors with more than `MOST_KINDS` kinds are settled by a grouping of
all their windows instead, which no single task has to hold.

Texts are UTF-8 bytes; null is empty. Equal texts are one text at several places, so they go if they have 400 bytes.
Matches never cross rows. Repeated and null ids are rows like others. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalspark.llm.common import BYTE_CODES, ODD, Bitmap, as_long, kept_table, mix, pieces, table, text_bytes

WINDOW, ANCHOR = 400, 32
LEAD = WINDOW - ANCHOR
HALF = LEAD // 2
# Steps of the runs that settle anchors with very many kinds.
STEP = 64
MOST_KINDS = 16_384
SEGMENTS = 4096
# Segments whose runs are named at once.
NAMED = 256


def rolling(data: np.ndarray, size: int = ANCHOR) -> np.ndarray:
    """Hash of every run of `size` bytes, a power of two, by doubling."""
    h, power, width = BYTE_CODES[data], ODD, 1
    with np.errstate(over="ignore"):
        while width < size:
            h = h[:-width] * power + h[width:]
            power, width = power * power, width * 2
    return mix(h)


def slide(values: np.ndarray, size: int, ufunc) -> np.ndarray:
    """Minimum or maximum of every run of `size` values, from running ones to both sides of block edges."""
    count = len(values) - size + 1
    padded = np.full(-(-len(values) // size) * size, values[-1])
    padded[: len(values)] = values
    blocks = padded.reshape(-1, size)
    ahead = ufunc.accumulate(blocks, axis=1).ravel()
    back = ufunc.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return ufunc(back[:count], ahead[size - 1 : size - 1 + count])


def anchors(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, byte place) of the anchors of all rows of a batch."""
    if len(data) < WINDOW:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h, span = rolling(data), WINDOW - ANCHOR + 1
    least = slide(h, span, np.minimum)
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))
    least[row[: len(least)] != row[WINDOW - 1 :]] = 0  # windows do not cross rows
    none = np.zeros(span - 1, np.uint64)
    most = slide(np.concatenate([none, least, none]), span, np.maximum)
    found = np.flatnonzero((h == most) & (most > 0))
    return h[found], found


PLACES = "a bigint, c bigint, l bigint, r bigint, t bigint, u int, pos int, lead int, tail int"


def places(docs: DataFrame) -> DataFrame:
    """One row for each anchor and kind of surroundings in a text: the hashes, the text's name, and the first place.

    l and r name the HALF bytes before and after the anchor; a window with the anchor holds one of them whole.
    Surroundings that occur twice in the text are repeated: rows without a hash are spans (pos, tail) of such.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [part.split()[0] for part in PLACES.split(", ")]
        for whole in batches:
            for batch in pieces(whole, "text"):
                data, at = text_bytes(batch.column("text"))
                hashes, found = anchors(data, at)
                if not len(found):
                    continue
                row = np.searchsorted(at, found, side="right") - 1
                lead, tail = np.minimum(found - at[row], LEAD), np.minimum(at[row + 1] - found, WINDOW)
                view, digest = memoryview(data), xxhash.xxh3_64_intdigest
                ends = list(zip((found - lead).tolist(), (found + tail).tolist(), lead.tolist(), strict=True))
                around = np.array([digest(view[s:e], seed=x) for s, e, x in ends], np.uint64)
                at_anchor = found.tolist()
                left = np.array([digest(view[p - HALF : p], seed=1) if x >= HALF else 0 for p, (_, _, x) in zip(at_anchor, ends, strict=True)], np.uint64)
                after = [(p + ANCHOR, e) for p, (_, e, _) in zip(at_anchor, ends, strict=True)]
                right = np.array([digest(view[p : p + HALF], seed=2) if e - p >= HALF else 0 for p, e in after], np.uint64)
                pos = found - at[row]
                order = np.lexsort((pos, around, hashes, row))
                same = (row[order][1:] == row[order][:-1]) & (hashes[order][1:] == hashes[order][:-1]) & (around[order][1:] == around[order][:-1])
                fresh = np.concatenate([[True], ~same])
                twice = np.concatenate([~fresh[1:], [False]]) | ~fresh
                t, u = (batch.column(c).to_numpy() for c in ("t", "u"))
                k = order[fresh]
                columns = [as_long(x[k]) for x in (hashes, around, left, right)]
                columns += [pa.array(x[row[k]]) for x in (t, u)] + [pa.array(x[k].astype(np.int32)) for x in (pos, lead, tail)]
                yield pa.RecordBatch.from_arrays(columns, names)
                k = np.sort(order[twice])
                if len(k):
                    # Spans of a row that touch or overlap become one.
                    first, stop = (pos - lead)[k], (pos + tail)[k]
                    cut = np.concatenate([[True], (row[k][1:] != row[k][:-1]) | (first[1:] > stop[:-1])])
                    begin = np.flatnonzero(cut)
                    first, stop, owner = first[begin], np.maximum.reduceat(stop, begin), row[k][begin]
                    none, zero = pa.nulls(len(begin), pa.int64()), pa.array(np.zeros(len(begin), np.int32))
                    columns = [none] * 4 + [pa.array(x[owner]) for x in (t, u)]
                    columns += [pa.array(first.astype(np.int32)), zero, pa.array(stop.astype(np.int32))]
                    yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select("t", "u", "text").mapInArrow(run, PLACES)


def repeats(bytes_of: np.ndarray, lead: np.ndarray, tail: np.ndarray, group: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(first, end) of the columns that repeated windows cover, per segment; end 0 where there are none.

    bytes_of: one segment a row with its anchor in column LEAD; group: number of the anchor, ascending.
    """
    n, width = bytes_of.shape
    order, common = np.arange(n), np.zeros(n, np.int64)
    first, end = np.zeros(n, np.int64), np.zeros(n, np.int64)
    begin, stop = LEAD - lead, LEAD + tail
    for column in range(width - 1, -1, -1):
        key = group * 256 + bytes_of[order, column]
        same = np.zeros(n, bool)
        if (key[1:] >= key[:-1]).all():
            same[1:] = key[1:] == key[:-1]
            common = np.where(same, common + 1, 0)
        else:
            turn = np.argsort(key, kind="stable")
            key = key[turn]
            same[1:] = key[1:] == key[:-1]
            pairs = np.flatnonzero(same)
            # The common prefix of two suffixes is the least one between them in the order before.
            bounds = np.stack([turn[pairs - 1] + 1, turn[pairs] + 1], axis=1).ravel()
            carried = np.zeros(n, np.int64)
            if len(pairs):
                carried[pairs] = np.minimum.reduceat(np.append(common, 0), bounds)[::2] + 1
            common, order = carried, order[turn]
        inside = (begin[order] <= column) & (column < stop[order])
        common[1:][~(inside[1:] & inside[:-1])] = 0
        if column <= LEAD:
            long = common >= window
            hit = long.copy()
            hit[:-1] |= long[1:]
            which = order[hit]
            first[which] = column
            end[which] = np.maximum(end[which], column + window)
    return first, end


SPANS = "a bigint, c bigint, first int, stop int"


def _span_batch(a, c, first, end) -> pa.RecordBatch:
    """Spans relative to the anchor, of the segments that have one."""
    some = end > 0
    columns = [pa.array(x[some]) for x in (a, c)] + [pa.array((x[some] - LEAD).astype(np.int32)) for x in (first, end)]
    return pa.RecordBatch.from_arrays(columns, ["a", "c", "first", "stop"])


def _matrix(rows: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    out = np.zeros((len(rows), LEAD + WINDOW), np.uint8)
    lead, tail = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
    for k, (_, _, x, data) in enumerate(rows):
        lead[k], tail[k] = x, len(data) - x
        out[k, LEAD - x : LEAD - x + len(data)] = np.frombuffer(data, np.uint8)
    return out, lead, tail


def column_spans(segments: DataFrame) -> DataFrame:
    """(a, c, first, stop) of segments (a, c, lead, data): the part around the anchor that repeated windows cover."""

    def settle(rows: list[tuple]) -> pa.RecordBatch:
        a, c = (np.array([r[k] for r in rows], np.int64) for k in (0, 1))
        group = np.concatenate([[0], np.cumsum(a[1:] != a[:-1])])
        return _span_batch(a, c, *repeats(*_matrix(rows), group))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in ("a", "c", "lead", "data")), strict=True):
                if len(held) >= SEGMENTS and row[0] != held[-1][0]:
                    yield settle(held)
                    held = []
                held.append(row)
        if held:
            yield settle(held)

    return segments.repartition("a").sortWithinPartitions("a", "c").select("a", "c", "lead", "data").mapInArrow(run, SPANS)


def _named_runs(segments: DataFrame, length: int, starts) -> DataFrame:
    """(a, c, at, name): 128-bit names of runs of `length` bytes of a segment, `at` relative to its anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, NAMED):
                out = []
                for row in whole.slice(start, NAMED).to_pylist():
                    data, lead = row["data"], row["lead"]
                    for at in starts(row):
                        if 0 <= at + lead <= len(data) - length:
                            out.append((row["a"], row["c"], at, xxhash.xxh3_128_digest(data[at + lead : at + lead + length])))
                if out:
                    types = [pa.int64(), pa.int64(), pa.int32(), pa.binary()]
                    columns = [pa.array(x, k) for x, k in zip(zip(*out, strict=True), types, strict=True)]
                    yield pa.RecordBatch.from_arrays(columns, ["a", "c", "at", "name"])

    named = kept_table(segments.mapInArrow(run, "a bigint, c bigint, at int, name binary"), "runs")
    # Segments of an anchor differ, so equal runs at one offset lie in different segments.
    often = named.groupBy("a", "at", "name").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    return named.join(often, ["a", "at", "name"]).select("a", "c", "at")


def grouped_spans(segments: DataFrame) -> DataFrame:
    """The same spans by groupings, for anchors with very many kinds of surroundings.

    Any window holds a whole run of WINDOW - STEP bytes that starts at a multiple of STEP; only windows around
    repeated ones of these are named and grouped themselves.
    """
    grid = range(-(LEAD // STEP) * STEP, STEP + 1, STEP)
    coarse = _named_runs(segments, WINDOW - STEP, lambda row: grid)
    lists = coarse.groupBy("a", "c").agg(F.collect_set("at").alias("runs"))
    near = segments.join(lists, ["a", "c"])
    windows = _named_runs(near, WINDOW, lambda row: sorted({k for g in row["runs"] for k in range(g - STEP + 1, g + 1) if -LEAD <= k <= 0}))
    return windows.groupBy("a", "c").agg(F.min("at").alias("first"), (F.max("at") + WINDOW).alias("stop"))


def marks(docs: DataFrame, most_kinds: int = MOST_KINDS) -> DataFrame:
    """(t, u, first, stop): byte spans of texts that repeated windows cover, each once for all copies of a text. docs: t, u, text."""
    found = kept_table(places(docs), "places")
    inner = found.where("a IS NULL").select("t", "u", F.col("pos").alias("first"), F.col("tail").alias("stop"))
    found = found.where("a IS NOT NULL").withColumn("place", F.xxhash64("t", "u", "pos"))
    kinds = found.groupBy("a", "c").agg(*[f(c).alias(n) for f, c, n in ((F.min, "place", "lo"), (F.max, "place", "hi"), (F.max, "l", "l"), (F.max, "r", "r"))])
    kinds = kept_table(kinds, "kinds")
    shared = kinds.groupBy("a").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("a")
    halves = kinds.join(shared, "a").select("a", "c", F.explode(F.array("l", "r")).alias("half")).where("half != 0")
    halves = kept_table(halves, "halves")
    often = halves.groupBy("a", "half").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    partial = kept_table(halves.join(often, ["a", "half"]).select("a", "c").distinct(), "partial")
    several = partial.groupBy("a").agg(F.count(F.lit(1)).alias("kinds"))
    partial = partial.join(several, "a").select("a", "c", "kinds")
    known = kinds.where("lo < hi").select("a", "c", "lo", "hi").join(partial, ["a", "c"], "full")
    known = known.join(kinds.select("a", "c", F.col("lo").alias("_lo"), F.col("hi").alias("_hi")), ["a", "c"])
    known = known.select("a", "c", F.col("_lo").alias("lo"), F.col("_hi").alias("hi"), F.coalesce("kinds", F.lit(1)).alias("kinds"))
    known = kept_table(known, "known")
    hits = Bitmap(known, "a").split(found, "a", True).drop("l", "r").join(known, ["a", "c"])
    hits = kept_table(hits, "hits")
    whole = hits.where("lo < hi").select("t", "u", (F.col("pos") - F.col("lead")).alias("first"), (F.col("pos") + F.col("tail")).alias("stop"))

    wanted = hits.where("kinds > 1 AND place = lo").dropDuplicates(["a", "c"])
    wanted = kept_table(wanted.select("t", "u", "a", "c", "kinds", "pos", "lead", "tail"), "wanted")
    texts = Bitmap(wanted, "t").split(docs, "t", True).groupBy("t", "u").agg(F.first("text").alias("text"))
    lists = wanted.groupBy("t", "u").agg(F.collect_list(F.struct("a", "c", "kinds", "pos", "lead", "tail")).alias("wanted"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in pieces(whole, "text")):
            for text, asked in zip(batch.column("text"), batch.column("wanted").to_pylist(), strict=True):
                data = text.as_py().encode()
                rows = [(w["a"], w["c"], w["kinds"], w["lead"], data[w["pos"] - w["lead"] : w["pos"] + w["tail"]]) for w in asked]
                types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
                columns = [pa.array(x, k) for x, k in zip(zip(*rows, strict=True), types, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, ["a", "c", "kinds", "lead", "data"])

    segments = texts.join(lists, ["t", "u"]).select("text", "wanted").mapInArrow(cut, "a bigint, c bigint, kinds bigint, lead int, data binary")
    segments = kept_table(segments, "segments")
    usual = column_spans(segments.where(F.col("kinds") <= most_kinds))
    spans = usual.union(grouped_spans(segments.where(F.col("kinds") > most_kinds)))
    partly = hits.where("kinds > 1 AND lo = hi").select("a", "c", "t", "u", "pos").join(spans, ["a", "c"])
    partly = partly.select("t", "u", (F.col("pos") + F.col("first")).alias("first"), (F.col("pos") + F.col("stop")).alias("stop"))
    copies = docs.groupBy("t", "u").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    copies = copies.select("t", "u", F.lit(0).alias("first"), F.lit(2**31 - 1).alias("stop"))
    return inner.union(whole).union(partly).union(copies).distinct()


def keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", F.xxhash64(text).alias("t"), F.hash(text).alias("u"), text.alias("text"))


DIGESTS = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"


def digests(docs: DataFrame, most_kinds: int = MOST_KINDS) -> DataFrame:
    """doc_id, bytes, removed bytes, removed runs, and the digest of the other bytes of every row."""
    rows = keyed(docs)
    found = kept_table(marks(rows.select("t", "u", "text"), most_kinds), "marks")
    bitmap = Bitmap(found, "t")

    def row(doc_id, data: bytes, spans) -> tuple:
        kept, at, removed, runs = hashlib.sha256(), 0, 0, 0
        if len(data) >= WINDOW:
            last = -1
            for first, stop in sorted((s["first"], min(s["stop"], len(data))) for s in spans or ()):
                if first > last:
                    runs += 1
                    kept.update(data[at:first])
                    removed += stop - first
                elif stop > last:
                    removed += stop - last
                last = max(last, stop)
                at = last
        kept.update(data[at:])
        return doc_id, len(data), removed, runs, kept.hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in pieces(whole, "text")):
            spans = batch.column("spans").to_pylist() if "spans" in batch.schema.names else [None] * batch.num_rows
            texts = (t.as_py().encode() for t in batch.column("text"))
            out = [row(*x) for x in zip(batch.column("doc_id").to_pylist(), texts, spans, strict=True)]
            if out:
                types = [pa.int64()] * 4 + [pa.string()]
                columns = [pa.array(x, k) for x, k in zip(zip(*out, strict=True), types, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, [part.split()[0] for part in DIGESTS.split(", ")])

    lists = found.groupBy("t", "u").agg(F.collect_list(F.struct("first", "stop")).alias("spans"))
    plain = bitmap.split(rows, "t", False).select("doc_id", "text")
    marked = bitmap.split(rows, "t", True).join(lists, ["t", "u"], "left").select("doc_id", "text", "spans")
    return plain.mapInArrow(run, DIGESTS).union(marked.mapInArrow(run, DIGESTS))


def op7_column_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Bytes of every document that repeated strings of 400 bytes cover."""
    return digests(table(spark, folder, "documents"))
