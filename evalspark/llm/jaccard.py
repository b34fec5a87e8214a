"""N-gram Jaccard join with set-relation skipping.

Sets are the distinct shingles of lower-cased texts (A-Z only), of `size` words; two documents link when the
intersection is `percent` % of the union or more. op9 takes three words and 90 %. Equal sets are one set.

1. Answers from similar sets: sets that share a min-hash are compared with the leader of their group only, the one
   that shares most min-hashes with most sets and so stands nearest to the text that others were made from. A set that
   links with a leader takes over the leader's group as its own answer, so groups of near copies need no pairs. Sets
   without an answer choose leaders among themselves in a second round, and try a member of each group they share a
   min-hash with.
2. Index lists: every set enters the lists of its prefix, the first n - ceil(percent n / 100) + 1 shingles in an order that
   puts frequent shingles last, except for shingles that no other set's prefix has. Lists are sorted by set size and skipped in blocks whose sizes or positions cannot
   reach the overlap; sets that share an answer are skipped as well. What is left is compared by a sketch that
   bounds the difference of two sets, then exactly.

The order of shingles only has to be the same everywhere: frequent ones are found per batch, added up by Spark, and
the `FREQUENT` most frequent are known to all tasks; this bounds a broadcast and has no effect on results.

A null text and a text without words have no shingles and link with nothing; fewer than `size` words are one
shingle. Links run between sets, named by 64-bit hashes; a component is named by the smallest doc_id of its sets.
Rows with a null doc_id count as smaller than all and get a null component if that is theirs. Repeated rows get
equal results. An empty table gives no rows.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalspark.llm.common import ODD, Bitmap, Words, as_long, components, give_back, kept_table, mix, pieces, table

SHINGLE, PERCENT = 3, 90
FREQUENT = 100_000
LOWEST = -(2**63)
TURN = np.uint64(0x13198A2E03707344)
MINS, ROUNDS = 8, 2
LIST_BLOCK = 512
# Bits of a set's sketch, and of its folded form in the index lists.
BITS, LIST_BITS = 1024, 512
# Bits for each shingle in the last sketch, for sets of which the other two say too little.
FINE = 4
# Index lists are dealt to so many tasks for each shuffle partition, so that a task holds little.
SHARDS = 4
# Tokens before its own that an entry carries, and bits that mark the tokens which several labels share, at most.
BEFORE, MARK_BITS = 2, 1 << 28
# Pairs whose sketches are compared at a time.
CHUNK = 65_536


def shingle_sets(texts: pa.Array, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of distinct shingles, sorted within each row, offsets of the rows in them)."""
    words = Words(texts, lower=True)
    rows, h = words.rows(), words.hash
    all_rows, all_keys = [], []
    if len(h) >= size:
        inside = np.flatnonzero(rows[: len(h) - size + 1] == rows[size - 1 :])
        key = np.zeros(len(inside), np.uint64)
        for k in range(size):
            key = key * ODD + h[inside + k]
        all_rows.append(rows[inside])
        all_keys.append(mix(key))
    for k in np.flatnonzero((words.count > 0) & (words.count < size)):
        key = words.count[k : k + 1].astype(np.uint64)
        for j in range(words.row_at[k], words.row_at[k + 1]):
            key = key * ODD + h[j : j + 1]
        all_rows.append(np.array([k]))
        all_keys.append(mix(key))
    if not all_rows:
        return np.zeros(0, np.uint64), np.zeros(len(words.count) + 1, np.int64)
    row, key = np.concatenate(all_rows), np.concatenate(all_keys)
    order = np.lexsort((key, row))
    row, key = row[order], key[order]
    fresh = np.ones(len(row), bool)
    fresh[1:] = (row[1:] != row[:-1]) | (key[1:] != key[:-1])
    row, key = row[fresh], key[fresh]
    return key, np.searchsorted(row, np.arange(len(words.count) + 1))


def _reduced(ufunc, values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """ufunc.reduceat over the parts between offsets; 0 for empty parts."""
    out = np.zeros(len(at) - 1, np.uint64)
    full = np.flatnonzero(at[1:] > at[:-1])
    if len(full):
        out[full] = ufunc.reduceat(values, at[full])
    return out


def set_names(keys: np.ndarray, at: np.ndarray) -> np.ndarray:
    """64-bit name of each row's set."""
    return mix(_reduced(np.add, mix(keys ^ TURN), at) * ODD + np.diff(at).astype(np.uint64))


def min_hashes(keys: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Least shingle of each row in each of MINS classes; the largest number where there is none."""
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))
    out = np.full((len(at) - 1) * MINS, ~np.uint64(0))
    np.minimum.at(out, row * MINS + (keys % np.uint64(MINS)).astype(np.int64), keys)
    return out


def sketches(keys: np.ndarray, at: np.ndarray, bits: int = BITS) -> np.ndarray:
    """For each row and class of shingles, whether the row has an odd number of them; packed to bytes."""
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))
    place = (keys >> np.uint64(40)).astype(np.int64) % bits
    out = np.zeros((len(at) - 1, bits // 8), np.uint8)
    for k in range(0, len(out), LIST_BLOCK):
        stop = min(k + LIST_BLOCK, len(out))
        part = slice(at[k], at[stop])
        odd = np.bincount((row[part] - k) * bits + place[part], minlength=(stop - k) * bits) & 1
        out[k:stop] = np.packbits(odd.astype(np.uint8).reshape(-1, bits), axis=1)
    return out


def fine_sketch(keys: np.ndarray) -> bytes:
    """The sketch of one set with FINE bits or more for each shingle, a power of two in all."""
    bits = max(64, 1 << (FINE * len(keys) - 1).bit_length())
    return np.packbits((np.bincount((keys >> np.uint64(20)).astype(np.int64) % bits, minlength=bits) & 1).astype(np.uint8)).tobytes()


def folded(sketch: np.ndarray, bits: int = LIST_BITS) -> np.ndarray:
    """The sketches with fewer bits, which divide those they have."""
    return np.bitwise_xor.reduce(sketch.reshape(len(sketch), -1, bits // 8), axis=1)


def apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Least number of shingles that two sets differ by: classes where one has an odd number and the other has not."""
    x, y = (np.ascontiguousarray(v).view(np.uint64) for v in (x, y))
    return np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)


SCAN = "doc_id bigint, n bigint, s bigint, mins array<bigint>, sketch binary, token bigint, times bigint"


def scan(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """For every row its set's size, name, min-hashes and sketch; and rows with the shingles that sets of a batch share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [part.split()[0] for part in SCAN.split(", ")]
        for whole in batches:
            for batch in pieces(whole, "text"):
                keys, at = shingle_sets(batch.column("text"), size)
                name = set_names(keys, at)
                m = batch.num_rows
                mins = pa.ListArray.from_arrays(pa.array(np.arange(m + 1, dtype=np.int32) * MINS), as_long(min_hashes(keys, at)))
                none = pa.nulls(m, pa.int64())
                sketch = pa.array([x.tobytes() for x in sketches(keys, at)], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), as_long(np.diff(at)), as_long(name), mins, sketch, none, none], names)
                # Copies count once.
                lead = np.zeros(m, bool)
                lead[np.unique(name, return_index=True)[1]] = True
                own = keys[np.repeat(lead, np.diff(at))]
                token, times = np.unique(own, return_counts=True)
                token, times = token[times > 1], times[times > 1]
                if len(token):
                    none = pa.nulls(len(token), pa.int64())
                    blank = [pa.nulls(len(token), kind) for kind in (pa.list_(pa.int64()), pa.binary())]
                    yield pa.RecordBatch.from_arrays([none, none, none, *blank, as_long(token), as_long(times)], names)

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, SCAN)


def _contents(docs: DataFrame, sets: DataFrame, size: int = SHINGLE) -> DataFrame:
    """(s, shingles, fine) of the sets (s, node), read from the document that names each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, "text"):
                keys, at = shingle_sets(batch.column("text"), size)
                data = [keys[at[k] : at[k + 1]].tobytes() for k in range(batch.num_rows)]
                fine = [fine_sketch(keys[at[k] : at[k + 1]]) for k in range(batch.num_rows)]
                yield pa.RecordBatch.from_arrays([as_long(set_names(keys, at)), pa.array(data, pa.binary()), pa.array(fine, pa.binary())], ["s", "shingles", "fine"])

    texts = docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(LOWEST)).alias("node"), "text")
    # Joined by set: rows that share an id, or have none, would all meet under one key.
    found = Bitmap(sets, "node").split(texts, "node", True, run, "s bigint, shingles binary, fine binary")
    return found.join(sets.select("s"), "s", "left_semi").dropDuplicates(["s"])


def verified(docs: DataFrame, pairs: DataFrame, sets: DataFrame, percent: int = PERCENT, size: int = SHINGLE) -> DataFrame:
    """The pairs (a, b) of set names whose sets link.

    Sketches differ by no more than the sets do, so most pairs fall before any set is sent: the sketches known from the
    scan first, then those whose size goes with the set's, an eighth of its shingles.
    """

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, BITS // 8) for c in ("x", "y"))
            total = batch.column("n").to_numpy() + batch.column("m").to_numpy()
            good = (100 + percent) * apart(x, y) <= (100 - percent) * total
            yield batch.select(["a", "b", "n", "m"]).filter(pa.array(good))

    known = sets.select("s", "n", "sketch")
    paired = pairs.distinct().join(known.select(F.col("s").alias("a"), "n", F.col("sketch").alias("x")), "a")
    paired = paired.join(known.select(F.col("s").alias("b"), F.col("n").alias("m"), F.col("sketch").alias("y")), "b")
    pairs = kept_table(paired.select("a", "b", "n", "m", "x", "y").mapInArrow(near, "a bigint, b bigint, n bigint, m bigint"), "pairs")
    wanted = pairs.select(F.col("a").alias("s")).union(pairs.select(F.col("b").alias("s"))).distinct()
    contents = kept_table(_contents(docs, kept_table(sets.join(wanted, "s").select("s", "node"), "wanted"), size), "contents")

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y, n, m in zip(*(batch.column(c).to_pylist() for c in ("x", "y", "n", "m")), strict=True):
                x, y = (np.frombuffer(v, np.uint8)[None] for v in (x, y))
                bits = 8 * min(x.size, y.size)
                good.append((100 + percent) * int(apart(folded(x, bits), folded(y, bits))[0]) <= (100 - percent) * (n + m))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    fine = pairs.join(contents.select(F.col("s").alias("a"), F.col("fine").alias("x")), "a")
    fine = fine.join(contents.select(F.col("s").alias("b"), F.col("fine").alias("y")), "b")
    pairs = kept_table(fine.select("a", "b", "n", "m", "x", "y").mapInArrow(close, "a bigint, b bigint"), "close")
    left = Bitmap(pairs.select(F.explode(F.array("a", "b")).alias("s")), "s")
    contents = left.split(contents.select("s", "shingles"), "s", True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = []
            for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                place = np.minimum(np.searchsorted(y, x), len(y) - 1)
                both = int((y[place] == x).sum())
                linked.append((100 + percent) * both >= percent * (len(x) + len(y)))
            yield batch.select(["a", "b"]).filter(pa.array(linked, pa.bool_()))

    joined = pairs.join(contents.select(F.col("s").alias("a"), F.col("shingles").alias("x")), "a")
    joined = joined.join(contents.select(F.col("s").alias("b"), F.col("shingles").alias("y")), "b")
    return joined.select("a", "b", "x", "y").mapInArrow(run, "a bigint, b bigint")


def shared_mins(sets: DataFrame) -> DataFrame:
    """(k, v, s, n, met): min-hashes that several sets share, with the number of these sets."""
    mins = sets.select("s", "n", F.posexplode("mins").alias("k", "v")).where("v != -1")
    groups = mins.groupBy("k", "v").agg(F.count(F.lit(1)).alias("met")).where("met > 1")
    return mins.join(groups, ["k", "v"])


def _fitting(met: DataFrame, partners: DataFrame, percent: int) -> DataFrame:
    """(a, b): each set with the partner (k, v, b, m) of its min-hash groups, sizes allowing."""
    fits = F.least("n", "m") * 100 >= F.greatest("n", "m") * percent
    pairs = met.join(partners, ["k", "v"]).where("s != b").where(fits)
    return pairs.select(F.least("s", "b").alias("a"), F.greatest("s", "b").alias("b"))


def leader_pairs(met: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(a, b): each set with the leaders of its min-hash groups."""
    central = met.groupBy("s").agg(F.sum("met").alias("score"))
    first = F.max_by(F.struct(F.col("s").alias("b"), F.col("n").alias("m")), F.struct("score", "s"))
    leaders = met.join(central, "s").groupBy("k", "v").agg(first.alias("leader")).select("k", "v", "leader.*")
    return _fitting(met, leaders, percent)


def member_pairs(met: DataFrame, answered: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(a, b): each set with one answered set of each of its min-hash groups, another in most of them."""
    some = F.min_by(F.struct(F.col("s").alias("b"), F.col("n").alias("m")), F.xxhash64("s", "k"))
    return _fitting(met, answered.groupBy("k", "v").agg(some.alias("member")).select("k", "v", "member.*"), percent)


def led(docs: DataFrame, sets: DataFrame, percent: int = PERCENT, size: int = SHINGLE) -> DataFrame:
    """(a, b): links of sets with their leaders, from ROUNDS rounds over the sets that have none yet.

    From the second round on, sets are compared with members of the groups found as well: those near the edge of a group
    link with many members, but not with the leader. Without this they would meet each of them in the index lists.
    """
    links, met = None, kept_table(shared_mins(sets), "met")
    for _ in range(ROUNDS):
        open_sets, members = met, None
        if links is not None:
            answered = links.select(F.explode(F.array("a", "b")).alias("s")).distinct()
            marked = kept_table(met.join(answered.withColumn("has", F.lit(True)), "s", "left"), "open")
            open_sets, members = marked.where("has IS NULL").drop("has"), marked.where("has").drop("has")
        pairs = leader_pairs(open_sets, percent)
        if members is not None:
            pairs = pairs.union(member_pairs(open_sets, members, percent))
        found = kept_table(verified(docs, pairs, sets, percent, size), "leaders")
        links = found if links is None else links.union(found)
    return links


PREFIXES = "s bigint, label bigint, n int, tokens binary, sketch binary"
HOLDER = np.dtype([("token", "<u8"), ("label", "<i8")])
ENTRY = np.dtype([("token", "<u8"), ("s", "<i8"), ("label", "<i8"), ("n", "<u4"), ("at", "<u4"), ("before", "<u8", (BEFORE,)), ("sketch", "u1", (LIST_BITS // 8,))])


def _dealt(entries: np.ndarray, shards: int) -> pa.RecordBatch:
    """(shard, data): the entries of each shard of tokens as bytes."""
    shard = (entries["token"] % np.uint64(shards)).astype(np.int32)
    order = np.argsort(shard, kind="stable")
    shard = shard[order]
    parts = [x for x in np.split(entries[order], np.flatnonzero(np.diff(shard)) + 1) if len(x)]
    return pa.RecordBatch.from_arrays([pa.array(np.unique(shard), pa.int32()), pa.array([x.tobytes() for x in parts], pa.binary())], ["shard", "data"])


def _prefixes(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of a batch of prefixes, the row and the place in its prefix of each."""
    held = [np.frombuffer(x.as_buffer(), np.uint64) for x in batch.column("tokens")]
    sizes = np.array([len(x) for x in held], np.int64)
    row = np.repeat(np.arange(len(held)), sizes)
    return np.concatenate(held), row, np.arange(len(row)) - (np.cumsum(sizes) - sizes)[row]


def shared_tokens(prefixes: DataFrame, shards: int) -> DataFrame:
    """(shard, marks): bits of the tokens that prefixes of different labels share; what else has them set is chance.

    A token takes bit `token // shards` modulo the number of bits of its shard, eight or more for each token up to a bound.
    """

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                tokens, row, _ = _prefixes(batch)
                holders = np.zeros(len(tokens), HOLDER)
                holders["token"], holders["label"] = tokens, batch.column("label").to_numpy()[row]
                yield _dealt(holders, shards)
        give_back()

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [np.frombuffer(x.as_buffer(), HOLDER) for batch in batches for x in batch.column("data")]
        if not parts:
            return
        e = np.concatenate(parts)
        del parts
        e = e[np.lexsort((e["label"], e["token"]))]
        other = (e["token"][1:] == e["token"][:-1]) & (e["label"][1:] != e["label"][:-1])
        token = np.unique(e["token"][1:][other])
        del e
        shard, at = token % np.uint64(shards), token // np.uint64(shards)
        for one in np.unique(shard).tolist():
            own = at[shard == one]
            bits = min(1 << (8 * len(own)).bit_length(), max(8, MARK_BITS // shards // 8 * 8))
            marks = np.zeros(bits, np.uint8)
            marks[own % np.uint64(bits)] = 1
            data = np.packbits(marks, bitorder="little").tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([one], pa.int32()), pa.array([data], pa.binary())], ["shard", "marks"])
        give_back()

    held = prefixes.select("label", "tokens").mapInArrow(deal, "shard int, data binary")
    return held.repartition(shards, "shard").mapInArrow(mark, "shard int, marks binary")


def list_pairs(docs: DataFrame, labels: DataFrame, frequent: DataFrame, percent: int = PERCENT, size: int = SHINGLE) -> DataFrame:
    """(a, b): sets with different labels that meet in an index list where sizes and positions let them link.

    labels: (doc_id, s, label) of the sets that have an answer already; other sets are their own label. Ids only tell
    which texts to look at; rows may share one. Only tokens that several labels share make entries. Two sets that met
    in the list of a token before are skipped in a later one: entries carry the last tokens before theirs.
    """
    spark = docs.sparkSession
    shards = SHARDS * max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    common = frequent.orderBy(F.desc("times"), "token").limit(FREQUENT).collect()
    tokens = np.array([r["token"] for r in common], np.int64).view(np.uint64)
    order = np.argsort(tokens)
    known = spark.sparkContext.broadcast((tokens[order], np.array([r["times"] for r in common], np.int64)[order]))

    texts = docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(LOWEST)).alias("_id"), "text")
    marks = Bitmap(labels, "doc_id")

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, "text"):
                keys, at = shingle_sets(batch.column("text"), size)
                full = pa.array(np.diff(at) > 0)
                yield pa.RecordBatch.from_arrays([as_long(set_names(keys, at)), batch.column("text")], ["s", "text"]).filter(full)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, times = known.value
        for whole in batches:
            # Texts with an answer come with a label and a bit below zero.
            bits = whole.column("bit").to_numpy()
            whole = whole.filter(pa.array((bits < 0) | ~marks.maybe(np.maximum(bits, 0))))
            for batch in pieces(whole, "text"):
                keys, at = shingle_sets(batch.column("text"), size)
                name = set_names(keys, at).view(np.int64)
                given = batch.column("label")
                label = np.where(given.is_null().to_numpy(zero_copy_only=False), name, given.fill_null(0).to_numpy())
                held, sketch = np.diff(at), folded(sketches(keys, at))
                lead = np.zeros(len(name), bool)
                lead[np.unique(name, return_index=True)[1]] = True  # copies in a batch enter once
                lead &= held > 0
                row = np.repeat(np.arange(len(held)), held)
                part = lead[row]
                keys, row = keys[part], row[part]
                often = np.zeros(len(keys), np.int64)
                if len(tokens):
                    place = np.minimum(np.searchsorted(tokens, keys), len(tokens) - 1)
                    often = np.where(tokens[place] == keys, times[place], 0)
                order = np.lexsort((keys, often, row))
                keys, row = keys[order], row[order]
                rank = np.arange(len(row)) - np.searchsorted(row, row)  # from the first entry of the same row
                n = held[row]
                keys = keys[rank < n - (percent * n + 99) // 100 + 1]
                rows = np.flatnonzero(lead)
                ends = np.cumsum(held[rows] - (percent * held[rows] + 99) // 100 + 1)
                data = [keys[a:z].tobytes() for a, z in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=False)]
                columns = [pa.array(name[rows]), pa.array(label[rows]), pa.array(held[rows], pa.int32())]
                columns += [pa.array(data, pa.binary()), pa.array([x.tobytes() for x in sketch[rows]], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, [part.split()[0] for part in PREFIXES.split(", ")])

    answered = marks.split(texts, "_id", True, named, "s bigint, text string")
    answered = answered.join(labels.select("s", "label").distinct(), "s", "left")
    alone = texts.select("text", F.lit(None).cast("bigint").alias("label"), marks.bit("_id").alias("bit"))
    prefixes = alone.union(answered.select("text", "label", F.lit(-1).cast("bigint"))).mapInArrow(cut, PREFIXES)
    prefixes = kept_table(prefixes, "prefixes")
    found = {r["shard"]: np.frombuffer(r["marks"], np.uint8) for r in shared_tokens(prefixes, shards).collect()}  # MARK_BITS bits at most
    widths = np.array([8 * len(found.get(k, b"0")) for k in range(shards)], np.uint64)
    all_marks = np.concatenate([found.get(k, np.zeros(1, np.uint8)) for k in range(shards)])
    shared = spark.sparkContext.broadcast((all_marks, np.cumsum(widths) - widths, widths))

    def enter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        all_marks, begins, widths = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            tokens, row, rank = _prefixes(batch)
            shard = (tokens % np.uint64(shards)).astype(np.int64)
            bit = begins[shard] + tokens // np.uint64(shards) % widths[shard]
            taken = np.flatnonzero(all_marks[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8) & 1)
            tokens, row, rank = tokens[taken], row[taken], rank[taken]
            entries = np.zeros(len(tokens), ENTRY)
            s, label, n = (batch.column(c).to_numpy()[row] for c in ("s", "label", "n"))
            for field, values in (("token", tokens), ("s", s), ("label", label), ("n", n), ("at", rank)):
                entries[field] = values
            # Places before the first are told apart by the set's own name, which no other set has.
            for k in range(BEFORE):
                inside = np.zeros(len(row), bool)
                inside[k + 1 :] = row[k + 1 :] == row[: -k - 1]
                entries["before"][:, k] = np.where(inside, np.roll(tokens, k + 1), s.view(np.uint64))
            sketch = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.uint8).reshape(batch.num_rows, -1)
            entries["sketch"] = sketch[row]
            if len(entries):
                yield _dealt(entries, shards)
        give_back()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [np.frombuffer(x.as_buffer(), ENTRY) for batch in batches for x in batch.column("data")]
        if not parts:
            return
        e = np.concatenate(parts)
        del parts
        e = e[np.lexsort((e["s"], e["n"], e["token"]))]
        fresh = np.ones(len(e), bool)
        fresh[1:] = (e["token"][1:] != e["token"][:-1]) | (e["s"][1:] != e["s"][:-1])
        e = e[fresh]
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(e["token"])) + 1, [len(e)]])
        for k in np.flatnonzero(np.diff(cuts) > 1):
            g = e[cuts[k] : cuts[k + 1]]
            if (g["label"] == g["label"][0]).all():
                continue
            n, at = g["n"].astype(np.int64), g["at"].astype(np.int64)
            for start in range(0, len(g), LIST_BLOCK):
                block = slice(start, min(start + LIST_BLOCK, len(g)))
                # Sizes ascend, so partners end where the largest of the block is too small for them.
                stop = int(np.searchsorted(n, n[block][-1] * 100 // percent, side="right"))
                if stop <= start + 1:
                    continue
                other = slice(start, stop)
                need = (percent * (n[block][:, None] + n[other][None, :]) + 99 + percent) // (100 + percent)
                reach = np.minimum((n - at)[block][:, None], (n - at)[other][None, :])
                good = (reach >= need) & (g["label"][block][:, None] != g["label"][other][None, :])
                good &= np.arange(start, block.stop)[:, None] < np.arange(start, stop)[None, :]
                # Both have a token before this one, in whose list they met: sizes, positions and sketches said the same there.
                for x in range(BEFORE):
                    for y in range(BEFORE):
                        good &= g["before"][block, x][:, None] != g["before"][other, y][None, :]
                i, j = np.nonzero(good)
                near = [
                    (100 + percent) * apart(g["sketch"][block][i[k : k + CHUNK]], g["sketch"][other][j[k : k + CHUNK]])
                    <= (100 - percent) * (n[block][i[k : k + CHUNK]] + n[other][j[k : k + CHUNK]])
                    for k in range(0, len(i), CHUNK)
                ]
                near = np.concatenate(near) if near else np.zeros(0, bool)
                i, j = i[near], j[near]
                if len(i):
                    a, b = g["s"][block][i], g["s"][other][j]
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])
        del e
        give_back()

    entered = prefixes.mapInArrow(enter, "shard int, data binary")
    return entered.repartition(shards, "shard").mapInArrow(meet, "a bigint, b bigint")


def join(docs: DataFrame, percent: int = PERCENT, size: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles, component_id of every row."""
    return _joined(docs, percent, size).drop("s", "root")


def _joined(docs: DataFrame, percent: int, size: int) -> DataFrame:
    scanned = kept_table(scan(docs, size), "shingles")
    rows = scanned.where("token IS NULL").select(F.coalesce("doc_id", F.lit(LOWEST)).alias("doc_id"), "n", "s", "mins", "sketch")
    sets = rows.where("n > 0").groupBy("s").agg(F.min("n").alias("n"), F.min("doc_id").alias("node"), *[F.first(c).alias(c) for c in ("mins", "sketch")])
    sets = kept_table(sets, "sets")
    frequent = scanned.where("token IS NOT NULL").groupBy("token").agg(F.sum("times").alias("times"))
    first = led(docs, sets, percent, size)
    answers = kept_table(components(first, "a", "b"), "answers")
    labels = rows.join(answers.select(F.col("node").alias("s"), F.col("component").alias("label")), "s").select("doc_id", "s", "label").distinct()
    labels = kept_table(labels, "labels")
    second = verified(docs, list_pairs(docs, labels, frequent, percent, size), sets, percent, size)
    linked = components(first.union(second), "a", "b").select(F.col("node").alias("s"), "component")
    named = sets.join(linked, "s", "left").select("s", "node", F.coalesce("component", "s").alias("component"))
    least = named.groupBy("component").agg(F.min("node").alias("component_id"))
    of_set = named.join(least, "component").select("s", "component_id", F.col("component").alias("root"))
    found = rows.join(of_set, "s", "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    shown = [F.when(c != LOWEST, c) for c in (F.col("doc_id"), component)]
    return found.select(shown[0].alias("doc_id"), F.col("n").alias("n_shingles"), shown[1].alias("component_id"), "s", "root")


def _free(columns: list[str], name: str) -> str:
    """The name, longer if a column has it already."""
    while name in columns:
        name += "_"
    return name


def _with_set(docs: DataFrame, marks: Bitmap, key: str, size: int, name: str) -> DataFrame:
    """The marked rows with the name of their set in a new column, null without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, "text"):
                keys, at = shingle_sets(batch.column("text"), size)
                names = pa.array(set_names(keys, at).view(np.int64), mask=np.diff(at) == 0)
                yield pa.RecordBatch.from_arrays([*batch.columns, names], [*batch.schema.names, name])

    return marks.split(docs, key, True, run, docs.withColumn(name, F.lit(0).cast("bigint")).schema)


def one_of_each(docs: DataFrame, percent: int = PERCENT, size: int = SHINGLE) -> DataFrame:
    """The row with the smallest doc_id of each component; rows without doc_id or without words stay.

    Rows are told apart by id and set: different texts under one id are judged each for itself. Of a component's rows
    that share its smallest id one set stays, and of rows with equal id and set one row.
    """
    found = kept_table(_joined(docs, percent, size).where("doc_id IS NOT NULL AND n_shingles > 0"), "linked")
    sets = found.groupBy("doc_id", "s").agg(F.first("component_id").alias("component_id"), F.first("root").alias("root"), F.count(F.lit(1)).alias("n"))
    first = sets.where("doc_id = component_id").groupBy("root").agg(F.first("doc_id").alias("doc_id"), F.min("s").alias("s"))
    sets = sets.join(first.select("doc_id", "s", F.lit(1).alias("own")), ["doc_id", "s"], "left")
    by_id = sets.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("kinds"), F.max(F.when(F.col("own").isNull() | (F.col("n") > 1), 1).otherwise(0)).alias("odd")
    )
    told = sets.join(by_id.where("odd = 1 OR kinds > 1"), "doc_id", "left_semi")
    key, s, own = (_free(docs.columns, name) for name in ("__key", "__s", "__own"))
    told = told.select(F.col("doc_id").alias(key), F.col("s").alias(s), F.coalesce("own", F.lit(0)).alias(own))
    told = kept_table(told, "dropped")
    marks = Bitmap(told, key)
    keyed = docs.withColumn(key, F.coalesce(F.col("doc_id").cast("bigint"), F.lit(LOWEST)))
    plain = marks.split(keyed, key, False).select(*docs.columns)
    judged = _with_set(keyed, marks, key, size, s).join(told, [key, s], "left")
    repeated = judged.where(F.col(own) == 1).dropDuplicates([key, s]).select(*docs.columns)
    return plain.union(judged.where(F.col(own).isNull()).select(*docs.columns)).union(repeated)


def op9_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    """Components of documents linked by 3-word shingles at a similarity of 0.9."""
    return join(table(spark, folder, "documents"))
