"""Bootstrap replicates by count arrays.

The counts of one example in all b replicates are an array that is made inside an Arrow step. Examples whose rows agree
for all models have one profile; a task adds their counts up, and only then multiplies: a statistic says what a row adds
to which key (a label, say), and the sums of the profiles become sums per (task, model, key), sent as one row per key,
never one per replicate. The arrays are added again across the shuffle, turned into the key's part of the statistic,
added over the keys of a model, and expanded into replicates at the very end, when b values per model are left.

``poisson`` hashes (seed, task, replicate, example) and so has no draw table. ``multinomial`` draws n of n positions:
a step draws a whole replicate and sends how often each position was drawn, a quarter of a byte for most, one row per
run of positions. Null predictions are handled by the statistic; a replicate that draws nothing has a null value.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import LongType, StructField, StructType

from evalspark.functions.draws import hash_grid, hash_range, poisson_limits
from evalspark.functions.vectors import list_column
from evalspark.scaling import explode_range, group_rank, materialize

TASK, MODEL, ID = "task_name", "model_ckpt", "img_id"
REPLICATE = "replicate"
# Counts held at once by one step, and bytes of sums held before they are sent on.
CELLS = 2_000_000
SUM_BYTES = 128 * 1024 * 1024
# Positions of a task whose counts travel together (a power of two, four at least), slots drawn and positions counted
# at once, bytes of packed counts sent at once, hashes made at once, and bytes of packed counts in one task.
RUN_BITS, SLOTS, PACK = 12, 1 << 25, 4_000_000
RUN = 1 << RUN_BITS
DRAWN, DRAW_BYTES = 1 << 18, 64 * 1024 * 1024
# Profiles multiplied at once.
PROFILES = 4096
# Distinct rows (model and values) and words of 62 bits by which the rows of an example are told in numbers.
KINDS, WORDS, WORD = 10_000, 4, 62


@dataclass(frozen=True)
class Statistic:
    """How a metric comes from summed weights.

    ``columns`` are the row's values. ``fold`` maps the distinct combinations of them to (key, slot, coefficient)
    triples: each adds coefficient times the weight to a slot of a key. ``part`` turns the sums of keys, an array (keys,
    slots, replicates), into what each key adds to the model, (keys, parts, replicates). ``value`` makes the
    metric (replicates) from the sum of the parts and the largest key. ``dense`` is for few keys of which a row adds to
    many: rows are then added up as one matrix product per model.
    """

    columns: list[str]
    slots: int
    fold: Callable[[dict[str, np.ndarray]], list[tuple[np.ndarray, int, np.ndarray]]]
    part: Callable[[np.ndarray, np.ndarray], np.ndarray]
    value: Callable[[np.ndarray, int], np.ndarray]
    dense: bool = False


# ---- counts of examples


def _poisson_counts(seed: int, b: int) -> Callable:
    limits = np.array(poisson_limits())

    def counts(part: pa.RecordBatch) -> np.ndarray:
        out = np.zeros((part.num_rows, b), np.uint8)
        tasks, ids = np.array(part.column(TASK).to_pylist(), object), part.column("_id").to_pylist()
        for task in dict.fromkeys(tasks.tolist()):
            rows = np.flatnonzero(tasks == task)
            drawn = hash_grid([f"{seed}-{task}-{r}" for r in range(b)], [ids[i] for i in rows.tolist()])
            found = np.zeros(drawn.shape, np.uint8)
            for limit in limits:
                # Few counts are above the first limits.
                more = drawn >= limit
                if not more.any():
                    break
                found += more
            out[rows] = found.T
        return out

    return counts


def _drawn_windows(prefix: str, n: int, first: int, stop: int) -> Iterator[tuple[int, np.ndarray]]:
    """(first position, counts) of the draws of some slots, a window of positions at a time.

    A count fits a byte: n draws of at most 255 do, and of more positions none is drawn 256 times but with a
    probability of less than 1e-500.
    """
    window = -(-SLOTS // RUN) * RUN
    pieces = (hash_range(prefix, k, min(k + DRAWN, stop)) % n for k in range(first, stop, DRAWN))
    if n <= window:
        counts = np.zeros(-(-n // RUN) * RUN, np.uint8)
        for place in pieces:
            np.add.at(counts, place, np.uint8(1))
        yield 0, counts
        return
    places = np.sort(np.concatenate(list(pieces)))
    for start in range(0, n, window):
        a, z = np.searchsorted(places, [start, start + window])
        counts = np.zeros(-(-min(window, n - start) // RUN) * RUN, np.uint8)
        np.add.at(counts, places[a:z] - start, np.uint8(1))
        yield start, counts


def _pack(counts: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """(run, bytes) of counts: two bits for each, and what is above 3 or equal as a byte each behind them."""
    few = np.minimum(counts, 3).view("<u4")
    bits = (few | few >> 6 | few >> 12 | few >> 18).astype(np.uint8).reshape(-1, RUN // 4)
    more = np.flatnonzero(counts >= 3)
    extra, ends = counts[more] - 3, np.searchsorted(more, np.arange(1, len(bits) + 1) * RUN)
    for run in np.flatnonzero(bits.any(axis=1)).tolist():
        yield run, bits[run].tobytes() + extra[ends[run - 1] if run else 0 : ends[run]].tobytes()


# The four counts of a byte, as the bytes of a word.
_FOUR = sum((np.arange(256, dtype="<u4") >> 2 * k & 3) << 8 * k for k in range(4)).astype("<u4")


def _unpack(packed: list[np.ndarray]) -> np.ndarray:
    """Counts (rows, RUN) of packed rows."""
    counts = _FOUR[np.concatenate([p[: RUN // 4] for p in packed])].view(np.uint8)
    counts[np.flatnonzero(counts == 3)] += np.concatenate([p[RUN // 4 :] for p in packed])
    return counts.reshape(len(packed), RUN)


def packed_draws(spark: SparkSession, sizes: dict[str, int], b: int, seed: int) -> DataFrame:
    """(task, run, replicate, draws): how often a replicate draws the positions of a run, packed.

    Slot s of a replicate picks position ``hash(seed, task, replicate, s) mod n``. A replicate of more than SLOTS slots is
    drawn in pieces, whose counts add up.
    """
    tasks = spark.createDataFrame(sorted(sizes.items()), f"{TASK} string, _n bigint")
    each = tasks.withColumn(REPLICATE, F.explode(F.sequence(F.lit(0), F.lit(b - 1))))
    work = explode_range(each, F.lit(0), F.floor((F.col("_n") - 1) / SLOTS), "_first")

    def batch_of(held: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.string(), pa.int64(), pa.int32(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], [TASK, "_run", REPLICATE, "_draws"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = [], 0
        for batch in batches:
            for row in batch.to_pylist():
                task, n, r, first = row[TASK], row["_n"], row[REPLICATE], row["_first"] * SLOTS
                for start, counts in _drawn_windows(f"{seed}-{task}-{r}", n, first, min(first + SLOTS, n)):
                    for place, draws in _pack(counts):
                        held.append((task, start // RUN + place, r, draws))
                        total += len(draws)
                        if total >= PACK:
                            yield batch_of(held)
                            held, total = [], 0
        if held:
            yield batch_of(held)

    return work.select(TASK, "_n", REPLICATE, "_first").mapInArrow(run, f"{TASK} string, _run bigint, {REPLICATE} int, _draws binary")


# ---- sums


def _parts(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


@dataclass(frozen=True)
class Layout:
    """How the rows of an example are told in a few whole numbers: a field of bits for each model in one of the words.

    ``fields`` holds (model, word, lowest bit, bits) and ``values`` the values that a field's numbers from 1 on stand for.
    """

    words: int
    fields: list[tuple]
    values: list[list[tuple]]
    kinds: list[pa.DataType]

    def rows(self, task: str | None, words: tuple[int, ...]) -> list[tuple]:
        out = []
        for (model, word, low, bits), values in zip(self.fields, self.values, strict=True):
            code = words[word] >> low & (1 << bits) - 1
            if code:
                out.append((task, model, *values[code - 1]))
        return out


def _layout(found: list[tuple], kinds: list[pa.DataType]) -> Layout | None:
    """Fields for distinct rows (model, values), if they fit WORDS words."""
    values: dict[object, list[tuple]] = {}
    for model, *rest in found:
        values.setdefault(model, []).append(tuple(rest))
    fields, word, low = [], 0, 0
    for model, own in values.items():
        bits = len(own).bit_length()
        if low + bits > WORD:
            word, low = word + 1, 0
        fields.append((model, word, low, bits))
        low += bits
    return Layout(word + 1, fields, list(values.values()), kinds) if word < WORDS and len(fields) <= WORD else None


class _Sums:
    """Sums of one task's examples per profile, and from them per (task, model, key)."""

    def __init__(self, statistic: Statistic, b: int, layout: Layout | None = None):
        self.statistic, self.b, self.layout = statistic, b, layout
        self.kinds = layout.kinds if layout else []
        self._clear()

    def _clear(self) -> None:
        # Distinct (task, model, values) of rows, and distinct sets of them that an example has.
        self.rows: dict[tuple, int] = {}
        self.at: dict[bytes, int] = {}
        # Profiles by their task and words.
        self.told: dict[tuple, int] = {}
        self.data = np.zeros((0, self.b), np.int32)

    def add(self, part: pa.RecordBatch, counts: np.ndarray) -> None:
        """Adds the counts (examples, replicates) of a batch's examples."""
        profile = self._profiles(part)
        if len(self.at) > len(self.data):
            grown = np.zeros((len(self.at) + len(self.at) // 4, self.b), np.int32)
            grown[: len(self.data)] = self.data
            self.data = grown
        order = np.argsort(profile, kind="stable")
        starts = np.flatnonzero(np.diff(profile[order], prepend=-1))
        self.data[profile[order[starts]]] += np.add.reduceat(counts[order], starts, axis=0, dtype=np.int32)

    def _told_profiles(self, part: pa.RecordBatch) -> np.ndarray:
        tasks = part.column(TASK).dictionary_encode()
        words = [part.column(f"_w{k}").to_numpy() for k in range(self.layout.words)]
        code = tasks.indices.fill_null(len(tasks.dictionary)).to_numpy().astype(np.int64)
        first = np.zeros(0, np.int64)
        for word in words:
            _, place = np.unique(word, return_inverse=True)
            _, first, code = np.unique(code * (place.max(initial=0) + 1) + place, return_index=True, return_inverse=True)
        profiles = []
        for k, task in zip(first.tolist(), part.column(TASK).take(pa.array(first)).to_pylist(), strict=True):
            name = (task, *(int(word[k]) for word in words))
            if name not in self.told:
                rows = [self.rows.setdefault(r, len(self.rows)) for r in self.layout.rows(task, name[1:])]
                self.told[name] = self.at.setdefault(np.sort(np.array(rows, np.int64)).tobytes(), len(self.at))
            profiles.append(self.told[name])
        return np.array(profiles, np.int64)[code]

    def _profiles(self, part: pa.RecordBatch) -> np.ndarray:
        if self.layout:
            return self._told_profiles(part)
        rows = part.column("_rows")
        parent, flat = rows.value_parent_indices().to_numpy(), rows.flatten()
        names = [MODEL, *self.statistic.columns]
        self.kinds = [flat.field(c).type for c in self.statistic.columns]
        coded = [part.column(TASK).take(pa.array(parent)).dictionary_encode(), *(flat.field(c).dictionary_encode() for c in names)]
        code = np.zeros(len(flat), np.int64)
        for c in coded:
            code = code * (len(c.dictionary) + 1) + c.indices.fill_null(len(c.dictionary)).to_numpy()
            _, first, code = np.unique(code, return_index=True, return_inverse=True)
        values = zip(*(c.take(pa.array(first)).to_pylist() for c in coded), strict=True)
        known = np.array([self.rows.setdefault(v, len(self.rows)) for v in values], np.int64)[code]
        sizes = np.bincount(parent, minlength=part.num_rows)
        begins = np.cumsum(sizes) - sizes
        out = np.zeros(part.num_rows, np.int64)
        for size in np.unique(sizes).tolist():
            some = np.flatnonzero(sizes == size)
            sets = np.sort(known[begins[some][:, None] + np.arange(size)], axis=1)
            keys, inverse = np.unique(np.ascontiguousarray(sets).view(f"V{8 * size}").ravel(), return_inverse=True)
            out[some] = np.array([self.at.setdefault(k.tobytes(), len(self.at)) for k in keys], np.int64)[inverse]
        return out

    def full(self) -> bool:
        return self.data.nbytes > SUM_BYTES

    def take(self) -> Iterator[pa.RecordBatch]:
        if self.at:
            rows = list(self.rows)
            columns = zip(self.statistic.columns, self.kinds, range(2, 2 + len(self.kinds)), strict=True)
            values = {c: pa.array([r[k] for r in rows], kind).to_numpy(zero_copy_only=False) for c, kind, k in columns}
            # Pairs of a profile and a row of its examples.
            row = np.frombuffer(b"".join(self.at), np.int64)
            profile = np.repeat(np.arange(len(self.at)), [len(k) // 8 for k in self.at])
            owners = list(dict.fromkeys(r[:2] for r in rows))
            place = {o: k for k, o in enumerate(owners)}
            owner = np.array([place[r[:2]] for r in rows])
            triples = self.statistic.fold(values)
            yield from (self._take_dense if self.statistic.dense else self._take_sparse)(owners, owner, profile, row, triples)
        self._clear()

    def _batch(self, owners: list[tuple], keys: np.ndarray, sums: np.ndarray) -> pa.RecordBatch:
        tasks, models = zip(*owners, strict=True)
        return pa.RecordBatch.from_arrays(
            [pa.array(tasks, pa.string()), pa.array(models, pa.string()), pa.array(keys, pa.int64()), list_column(sums.reshape(len(keys), -1))],
            [TASK, MODEL, "_key", "_sums"],
        )

    def _take_sparse(self, owners: list[tuple], owner: np.ndarray, profile: np.ndarray, row: np.ndarray, triples: list) -> Iterator[pa.RecordBatch]:
        slots, keys = self.statistic.slots, np.unique(np.concatenate([k for k, _, _ in triples]))
        cells, members, weights = [], [], []
        for key, slot, coefficient in triples:
            used = coefficient[row] != 0
            cells.append(((owner * len(keys) + np.searchsorted(keys, key)) * slots + slot)[row[used]])
            members.append(profile[used])
            weights.append(coefficient[row[used]])
        cell, member, weight = (np.concatenate(c) for c in (cells, members, weights))
        order = np.argsort(cell, kind="stable")
        cell, member, weight = cell[order], member[order], weight[order]
        edges = np.flatnonzero(np.diff(cell, prepend=-1))
        # Sums of a bounded number of keys are made and sent at a time.
        targets, local = np.unique(cell[edges] // slots, return_inverse=True)
        step = max(1, CELLS // (slots * self.b))
        for k in range(0, len(targets), step):
            out = np.zeros((min(step, len(targets) - k), slots, self.b))
            for e in range(*np.searchsorted(local, [k, k + step]).tolist()):
                stop = edges[e + 1] if e + 1 < len(edges) else len(cell)
                for a in range(edges[e], stop, PROFILES):
                    some = slice(a, min(a + PROFILES, stop))
                    out[local[e] - k, cell[edges[e]] % slots] += weight[some] @ self.data[member[some]].astype(float)
            now = targets[k : k + step]
            yield self._batch([owners[o] for o in (now // len(keys)).tolist()], keys[now % len(keys)], out)

    def _take_dense(self, owners: list[tuple], owner: np.ndarray, profile: np.ndarray, row: np.ndarray, triples: list) -> Iterator[pa.RecordBatch]:
        keys = np.unique(np.concatenate([k for k, _, _ in triples]))
        places = [(np.searchsorted(keys, key), slot, c) for key, slot, c in triples]
        for k, name in enumerate(owners):
            own = np.flatnonzero(owner[row] == k)
            total = np.zeros((len(keys) * self.statistic.slots, self.b))
            for a in range(0, len(own), PROFILES):
                some = own[a : a + PROFILES]
                matrix = np.zeros((len(keys), self.statistic.slots, len(some)))
                for place, slot, coefficient in places:
                    np.add.at(matrix, (place[row[some]], slot, np.arange(len(some))), coefficient[row[some]])
                total += matrix.reshape(-1, len(some)) @ self.data[profile[some]].astype(float)
            yield self._batch([name] * len(keys), keys, total)


SUMS = f"{TASK} string, {MODEL} string, _key bigint, _sums array<double>"


def _slices(batch: pa.RecordBatch, b: int) -> Iterator[pa.RecordBatch]:
    """About CELLS counts at a time."""
    step = max(1, CELLS // b)
    for k in range(0, batch.num_rows, step):
        yield batch.slice(k, step)


def _told(examples: DataFrame) -> list[str]:
    """The columns that tell the rows of an example."""
    return [c for c in examples.columns if c not in (TASK, ID)]


def _poisson_sums(examples: DataFrame, statistic: Statistic, b: int, seed: int, layout: Layout | None = None) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = _Sums(statistic, b, layout), _poisson_counts(seed, b)
        for batch in batches:
            for part in _slices(batch, b):
                sums.add(part, counts(part))
                if sums.full():
                    yield from sums.take()
        yield from sums.take()

    fed = examples.select(TASK, F.col(ID).cast("string").alias("_id"), *_told(examples))
    return fed.mapInArrow(run, SUMS)


def _multinomial_sums(examples: DataFrame, statistic: Statistic, b: int, seed: int, layout: Layout | None = None) -> DataFrame:
    """Draws and examples of one run of positions meet in one task; the draws come first and become counts."""
    sizes = {r[TASK]: r["n"] for r in examples.groupBy(TASK).agg(F.count(F.lit(1)).alias("n")).collect()}
    placed = group_rank(examples, [TASK], [ID], "_i", largest=max(sizes.values(), default=0)).withColumn("_p", F.col("_i") - 1)
    none = {REPLICATE: F.lit(None).cast("int"), "_draws": F.lit(None).cast("binary")}
    told = _told(examples)
    fed = placed.select(
        TASK, F.floor(F.col("_p") / RUN).alias("_run"), *[v.alias(k) for k, v in none.items()], F.pmod("_p", F.lit(RUN)).cast("int").alias("_at"), *told
    )
    drawn = packed_draws(examples.sparkSession, sizes, b, seed)
    no_rows = [F.lit(None).cast(fed.schema[c].dataType).alias(c) for c in told]
    drawn = drawn.select(TASK, "_run", REPLICATE, "_draws", F.lit(-1).alias("_at"), *no_rows)
    runs = sum(-(-n // RUN) for n in sizes.values())
    # About a third of a byte per count.
    parts = max(_parts(examples.sparkSession), -(-runs * RUN * b // (3 * DRAW_BYTES)))
    met = drawn.union(fed).repartition(parts, TASK, "_run").sortWithinPartitions(TASK, "_run", "_at")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Rows a power of two apart would share a few places of the cache, where turning them is slow.
        sums, now, turned, counts = _Sums(statistic, b, layout), None, None, np.zeros((b, RUN + 64), np.uint8)[:, :RUN]
        for batch in batches:
            tasks, runs, at = batch.column(TASK).dictionary_encode(), batch.column("_run").to_numpy(), batch.column("_at").to_numpy()
            code = tasks.indices.fill_null(-1).to_numpy()
            new = (np.diff(code) != 0) | (np.diff(runs) != 0) | (np.diff(at < 0))
            edges = [0, *(np.flatnonzero(new) + 1).tolist()] if batch.num_rows else []
            for a, z in zip(edges, [*edges[1:], batch.num_rows], strict=True):
                key = batch.column(TASK)[a].as_py(), int(runs[a])
                if key != now:
                    now, turned = key, None
                    counts[:] = 0
                part = batch.slice(a, z - a)
                if at[a] < 0:
                    found = _unpack([np.frombuffer(d.as_buffer(), np.uint8) for d in part.column("_draws")])
                    # A replicate may come in several pieces.
                    for replicate, some in zip(part.column(REPLICATE).to_pylist(), found, strict=True):
                        counts[replicate] += some
                    continue
                if turned is None:
                    turned = np.ascontiguousarray(counts.T)
                for piece in _slices(part, b):
                    sums.add(piece, turned[piece.column("_at").to_numpy()])
                    if sums.full():
                        yield from sums.take()
        yield from sums.take()

    return met.mapInArrow(run, SUMS)


def _matrix(column: pa.ListArray, *shape: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), *shape)


def _add_keys(sums: DataFrame, statistic: Statistic, b: int) -> DataFrame:
    """Adds the sums of each key over all tasks, and the parts of each partition's keys per model."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[tuple, list] = {}
        now, held = None, None

        def close() -> None:
            task, model, key = now
            found = statistic.part(np.array([key]), held[None])[0]
            entry = parts.setdefault((task, model), [np.zeros_like(found), -1])
            entry[0] += found
            entry[1] = max(entry[1], key)

        for batch in batches:
            keys = zip(*(batch.column(c).to_pylist() for c in (TASK, MODEL, "_key")), strict=True)
            for key, values in zip(keys, _matrix(batch.column("_sums"), statistic.slots, b), strict=True):
                if key != now:
                    if now:
                        close()
                    now, held = key, np.zeros_like(values)
                held += values
        if now:
            close()
        if parts:
            tasks, models = zip(*parts, strict=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(tasks), pa.array(models), pa.array([p[1] for p in parts.values()], pa.int64()), list_column(np.stack([p[0].ravel() for p in parts.values()]))],
                [TASK, MODEL, "_top", "_parts"],
            )

    dealt = sums.repartition(TASK, MODEL, "_key").sortWithinPartitions(TASK, MODEL, "_key")
    return dealt.mapInArrow(run, f"{TASK} string, {MODEL} string, _top bigint, _parts array<double>")


def _values(parts: DataFrame, statistic: Statistic, b: int) -> DataFrame:
    """The array of b values of each model."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple, list] = {}
        for batch in batches:
            owners = zip(batch.column(TASK).to_pylist(), batch.column(MODEL).to_pylist(), batch.column("_top").to_pylist(), strict=True)
            for (task, model, top), values in zip(owners, _matrix(batch.column("_parts"), -1, b), strict=True):
                entry = found.setdefault((task, model), [np.zeros_like(values), -1])
                entry[0] += values
                entry[1] = max(entry[1], top)
        if found:
            tasks, models = zip(*found, strict=True)
            values = np.concatenate([statistic.value(total, top) for total, top in found.values()])
            flat = pa.array(values, from_pandas=True)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1) * b, pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([pa.array(tasks), pa.array(models), lists], [TASK, MODEL, "_values"])

    # One row per model and partition of the step before.
    return parts.repartition(TASK, MODEL).mapInArrow(run, f"{TASK} string, {MODEL} string, _values array<double>")


def _told_examples(df: DataFrame, kept: list[str]) -> tuple[DataFrame, Layout] | None:
    """(task, example, words): the rows of an example as numbers, added up before the shuffle, and their layout.

    None if there are too many distinct rows, or if a model has several rows of an example.
    """
    spark, columns = df.sparkSession, [F.col(c).alias(f"_k{k}") for k, c in enumerate(kept)]
    rows = df.select(F.col(TASK), F.col(ID), *columns)
    names = [f"_k{k}" for k in range(len(kept))]
    found = [tuple(r) for r in rows.select(*names).distinct().limit(KINDS + 1).collect()]
    kinds = [to_arrow_type(rows.schema[n].dataType) for n in names]
    layout = _layout(found, kinds[1:]) if len(found) <= KINDS else None
    if layout is None:
        return None
    known = []
    for k, ((model, word, low, _), values) in enumerate(zip(layout.fields, layout.values, strict=True)):
        for code, rest in enumerate(values, start=1):
            known.append((model, *rest, *(code << low if w == word else 0 for w in range(layout.words)), 1 << k))
    words = [f"_w{k}" for k in range(layout.words)]
    schema = StructType([*rows.select(*names).schema.fields, *(StructField(n, LongType()) for n in (*words, "_bit"))])
    # At most KINDS rows, which is why they may go to every task.
    known = F.broadcast(spark.createDataFrame(known, schema).withColumnsRenamed({n: f"_of{n}" for n in names}))
    match = reduce(lambda x, y: x & y, [F.col(n).eqNullSafe(F.col(f"_of{n}")) for n in names])
    # One row a model: then fields do not touch, and their union is their sum.
    out = rows.join(known, match, "left").groupBy(TASK, ID).agg(
        *[F.bit_or(w).alias(w) for w in words], (F.bit_count(F.coalesce(F.bit_or("_bit"), F.lit(0))) != F.count(F.lit(1))).alias("_more")
    )
    out = materialize(out, "examples")
    if not out.where("_more").isEmpty():
        return None
    return out.drop("_more"), layout


def _listed_examples(df: DataFrame, kept: list[str]) -> DataFrame:
    """(task, example, _rows): the rows of an example as a list."""
    # A set number of parts: what follows is far more work than the size of these rows tells.
    spread = df.select(TASK, ID, *kept).repartition(_parts(df.sparkSession), TASK, ID)
    return spread.groupBy(TASK, ID).agg(F.collect_list(F.struct(*kept)).alias("_rows"))


def replicates(df: DataFrame, statistic: Statistic, b: int, seed: int, method: str = "multinomial") -> DataFrame:
    """(task, model, replicate, value) of a statistic, b rows per task and model."""
    if method not in ("poisson", "multinomial"):
        raise ValueError(f"unknown resampling method {method!r}")
    kept = [c for c in dict.fromkeys([MODEL, *statistic.columns])]
    examples, layout = _told_examples(df, kept) or (_listed_examples(df, kept), None)
    if method == "poisson":
        if layout:
            examples = examples.repartition(_parts(df.sparkSession), TASK, ID)
        sums = _poisson_sums(examples, statistic, b, seed, layout)
    else:
        sums = _multinomial_sums(examples if layout else materialize(examples, "examples"), statistic, b, seed, layout)
    values = _values(_add_keys(sums, statistic, b), statistic, b)
    return values.select(TASK, MODEL, F.posexplode("_values").alias(REPLICATE, "value"))


# ---- statistics


def _number(values: np.ndarray) -> np.ndarray:
    """Numbers with nan for nulls."""
    return np.array([np.nan if v is None else v for v in values], float) if values.dtype == object else values.astype(float)


def _ratio(top: np.ndarray, below: np.ndarray) -> np.ndarray:
    return np.divide(top, below, out=np.full(len(top), np.nan), where=below != 0)


def weighted_mean(column: str) -> Statistic:
    """Mean of a column; a null adds nothing, but its row counts."""

    def fold(c: dict[str, np.ndarray]) -> list:
        x = _number(c[column])
        zero = np.zeros(len(x), np.int64)
        return [(zero, 0, np.nan_to_num(x)), (zero, 1, np.ones(len(x)))]

    return Statistic([column], 2, fold, lambda keys, sums: sums, lambda total, top: _ratio(total[0], total[1]))


def _f1(sums: np.ndarray) -> np.ndarray:
    """F1 per key from slots true positives, truths, predictions; 0 where the class is absent."""
    total = sums[:, 1] + sums[:, 2]
    return np.divide(2 * sums[:, 0], total, out=np.zeros_like(total), where=total > 0)


NO_LABEL = -(2**62)


def macro_f1() -> Statistic:
    """Sum of F1 over the classes, divided by the largest label of the full data plus one."""

    def fold(c: dict[str, np.ndarray]) -> list:
        true, pred = _number(c["y_true"]), _number(c["y_pred"])
        out = [(true, 1, np.ones(len(true))), (pred, 2, np.ones(len(true))), (true, 0, (true == pred).astype(float))]
        # A null label belongs to no class.
        return [(np.nan_to_num(k, nan=NO_LABEL).astype(np.int64), slot, v) for k, slot, v in out]

    def part(keys: np.ndarray, sums: np.ndarray) -> np.ndarray:
        return np.stack([np.where((keys > NO_LABEL)[:, None], _f1(sums), 0), sums[:, 1]], axis=1)

    return Statistic(["y_true", "y_pred"], 3, fold, part, lambda total, top: np.where(total[1] > 0, total[0] / (top + 1), np.nan))


def multilabel_f1(column: str = "_traits") -> Statistic:
    """Macro F1 over {0, 1} per trait, averaged over the traits.

    The column holds both label arrays, ``y_true`` and ``y_pred``, as JSON; they are read side by side.
    """
    row = 2**32 - 1

    def fold(c: dict[str, np.ndarray]) -> list:
        pairs = [json.loads(v) for v in c[column]]
        # A row with a null side has no traits.
        sides = [[p.get(side) if "y_true" in p and "y_pred" in p else [] for p in pairs] for side in ("y_true", "y_pred")]
        size = np.array([max(len(t), len(p)) for t, p in zip(*sides, strict=True)])
        out = []
        for t in range(size.max(initial=0)):
            has = (size > t).astype(float)
            true, pred = (_number(np.array([v[t] if len(v) > t else None for v in side], object)) for side in sides)
            for label, slot, hit in ((true, 1, has), (pred, 2, has), (true, 0, has * (true == pred))):
                known = ~np.isnan(label)
                out.append((t * 2**32 + np.where(known, label, row - 1).astype(np.int64), slot, np.where(known, hit, 0)))
            # Says in which replicates the trait occurs.
            out.append((np.full(len(true), t * 2**32 + row), 1, has))
        return out or [(np.full(len(size), row), 1, np.zeros(len(size)))]

    def part(keys: np.ndarray, sums: np.ndarray) -> np.ndarray:
        marker = (keys % 2**32 == row)[:, None]
        return np.stack([np.where(marker, 0, _f1(sums) / 2), np.where(marker, sums[:, 1] > 0, 0)], axis=1)

    return Statistic([column], 3, fold, part, lambda total, top: _ratio(total[0], total[1]), dense=True)


def coded(bits: list[str], value: Callable[[np.ndarray], np.ndarray], column: str = "_code") -> Statistic:
    """A metric of how many rows have each of some flags, which stand as bits in one integer column."""

    def fold(c: dict[str, np.ndarray]) -> list:
        code = c[column].astype(np.int64)
        zero = np.zeros(len(code), np.int64)
        return [(zero, k, ((code >> k) & 1).astype(float)) for k in range(len(bits))] + [(zero, len(bits), np.ones(len(code)))]

    return Statistic([column], len(bits) + 1, fold, lambda keys, sums: sums, lambda total, top: value(total))
