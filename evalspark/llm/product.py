"""Embedding near-dedup by product quantisation with inverted lists.

Unit vectors are assigned to coarse lists; residuals are coded by one of 256 codewords in each of 8 subspaces. A query's
distances to the codes (asymmetric distances) are the sums of its table entries, taken for a whole list as one product with
the decoded codes; exact cosines in double precision are compared for what the codes leave.

Probes are sufficient, so nothing is missed: a vector within distance r of the query lies in a list whose bisector
with the query's own list is no further than r from the query, and its code's distance differs from its own by its
coding error at most, which is stored. Codebooks come from at most `SAMPLE` vectors, the ones with the smallest hash; all
vectors are indexed. Equal vectors are one entry with a count. Near lists make up groups, `GROUPS` of them until a group
fills a block, so a vector is sent to as many groups at most however many lists it probes. Two lists of different groups
meet in one of the two, in turn, so that all groups have the same work. Vectors travel packed, many in a row; blocks of a
group and parts of its queries meet in a task, which returns counts and a spanning forest of the links, never the pairs.

Vectors that are null, zero, or hold null or non-finite components link with nothing, as do vectors of different
length. Vectors are named by their content, so rows that share an id or have none are rows of their own, and their
component is that of their vector; a null vec_id counts as the smallest. Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import astuple, dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalspark.llm.common import components, kept_table, mix, table

COSINE = 0.95
SAMPLE = 32_768
LIST_ROWS = 256
MOST_LISTS = 4096
SUBSPACES, CODES = 8, 256
# Groups of lists at least, parts of a group's queries at least, bytes of a block's vectors, and of vectors in one row.
GROUPS, PARTS = 17, 2
BLOCK_BYTES, PACK_BYTES = 16 << 20, 512 << 10
# Vectors of a list compared at once with a row of queries, and links folded at once.
TILE, EDGES = 4096, 1 << 18
# More than the rounding of a product in single precision.
SLACK = 1e-4
LOWEST = -(2**63)


def _means(points: np.ndarray, count: int, rounds: int, seed: int) -> np.ndarray:
    """Centres of k-means."""
    count = min(count, len(points))
    centres = points[np.random.Generator(np.random.PCG64(seed)).permutation(len(points))[:count]].copy()
    for _ in range(rounds):
        near = np.argmin((centres**2).sum(axis=1) - 2 * points @ centres.T, axis=1)
        sizes = np.bincount(near, minlength=count)
        sums = np.stack([np.bincount(near, points[:, k], minlength=count) for k in range(points.shape[1])], axis=1)
        centres = np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1)[:, None], centres)
    return centres


def _in_line(points: np.ndarray, some: np.ndarray) -> np.ndarray:
    """Row numbers in an order in which near points follow each other: halves along the widest dimension."""
    if len(some) < 3:
        return some
    some = some[np.argsort(points[some, np.argmax(points[some].var(axis=0))], kind="stable")]
    half = len(some) // 2
    return np.concatenate([_in_line(points, some[:half]), _in_line(points, some[half:])])


@dataclass(frozen=True)
class Model:
    """Coarse centres, the group of each, and, for each subspace (a range of dimensions), its codewords."""

    centres: np.ndarray
    group: np.ndarray
    cuts: np.ndarray
    words: list[np.ndarray]
    reach: float

    @cached_property
    def apart(self) -> np.ndarray:
        """Distances of the centres."""
        c, square = self.centres, (self.centres**2).sum(axis=1)
        return np.sqrt(np.maximum(square[:, None] + square[None, :] - 2 * c @ c.T, 0))

    def distances(self, x: np.ndarray, lists: slice = slice(None)) -> np.ndarray:
        """Squared distances to the centres of some lists."""
        return 1 + (self.centres[lists] ** 2).sum(axis=1) - 2 * x @ self.centres[lists].T

    def lists(self, group: int) -> slice:
        """The lists of a group, which follow each other."""
        return slice(*np.searchsorted(self.group, [group, group + 1]).tolist())

    def probes(self, x: np.ndarray, own: np.ndarray, lists: slice = slice(None), d: np.ndarray | None = None) -> np.ndarray:
        """Which of some lists each vector asks: its own, and those that may hold a vector in reach and do not ask back."""
        near = ((x - self.centres[own]) ** 2).sum(axis=1)
        gap = (self.distances(x, lists) if d is None else d) - near[:, None]
        needed = gap <= 2 * self.apart[own, lists] * self.reach + 1e-9
        number, group = np.arange(len(self.centres))[lists], self.group[lists]
        groups = int(self.group[-1]) + 1
        # Of two groups the one behind asks the one ahead, round a circle; in a group lists ask those from their own on.
        ahead = (np.arange(groups)[None, :] - np.arange(groups)[:, None]) % groups
        asks = (2 * ahead < groups) | ((2 * ahead == groups) & (np.arange(groups)[None, :] > np.arange(groups)[:, None]))
        needed &= asks[self.group[own]][:, group]
        needed &= (number[None, :] >= own[:, None]) | (group[None, :] != self.group[own][:, None])
        needed |= number[None, :] == own[:, None]
        return needed

    def code(self, x: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(codes, vectors that the codes stand for)."""
        left = x - self.centres[own]
        codes, stand = np.zeros((len(x), len(self.words)), np.uint8), np.zeros_like(x)
        for m, words in enumerate(self.words):
            part = left[:, self.cuts[m] : self.cuts[m + 1]]
            codes[:, m] = np.argmin((words**2).sum(axis=1) - 2 * part @ words.T, axis=1)
            stand[:, self.cuts[m] : self.cuts[m + 1]] = words[codes[:, m]]
        return codes, stand + self.centres[own]


def fit(x: np.ndarray, lists: int, cosine: float, groups: int = GROUPS) -> Model:
    centres = _means(x, lists, 8, 1)
    centres = centres[_in_line(centres, np.arange(len(centres)))]
    group = np.arange(len(centres)) * min(groups, len(centres)) // len(centres)
    near = np.argmin((centres**2).sum(axis=1) - 2 * x @ centres.T, axis=1)
    left = x - centres[near]
    cuts = np.linspace(0, x.shape[1], min(SUBSPACES, x.shape[1]) + 1).astype(int)
    words = [_means(left[:, a:b], CODES, 6, 2 + m) for m, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
    return Model(centres, group, cuts, words, float(np.sqrt(2 - 2 * cosine)) + 1e-6)


def unit_vectors(df: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """(vec_id, dim, a, b, unit): unit vector as doubles and its 128-bit name; null for those that link with nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for values in batch.column("v").to_pylist():
                unit = None
                if values and None not in values:
                    x = np.array(values, np.float64)
                    if np.isfinite(x).all() and x.any():
                        x = x / np.abs(x).max()  # no overflow in the norm
                        unit = x / np.sqrt((x * x).sum())
                if unit is None:
                    rows.append((None, None, None, None))
                else:
                    name = np.frombuffer(xxhash.xxh3_128_digest(unit.tobytes()), np.int64)
                    rows.append((len(unit), int(name[0]), int(name[1]), unit.tobytes()))
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.binary()]
            columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], k) for k in kinds]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), *columns], ["vec_id", "dim", "a", "b", "unit"])

    picked = df.select(F.coalesce(F.col(vec_id).cast("bigint"), F.lit(LOWEST)).alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
    return picked.mapInArrow(run, "vec_id bigint, dim int, a bigint, b bigint, unit binary")


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(len(column), -1)


def _forest(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, smallest node of its component) of the graph with the given links."""
    nodes, ends = np.unique(np.concatenate([left, right]), return_inverse=True)
    i, j = ends[: len(left)], ends[len(left) :]
    label = np.arange(len(nodes))
    while True:
        least = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, least)
        np.minimum.at(new, j, least)
        new = new[new]
        if (new == label).all():
            break
        label = new
    some = label != np.arange(len(nodes))
    return nodes[some], nodes[label[some]]


class _Block:
    """Vectors of a group of lists, and the links that queries found there."""

    def __init__(self, model: Model, group: int, cosine: float, rep: np.ndarray, copies: np.ndarray, own: np.ndarray, y: np.ndarray):
        order = np.argsort(own, kind="stable")
        self.model, self.cosine, self.lists = model, cosine, model.lists(group)
        self.rep, self.copies, self.own, self.y = (v[order] for v in (rep, copies, own, y))
        stand = model.code(self.y, self.own)[1]
        most = model.reach + np.sqrt(((self.y - stand) ** 2).sum(axis=1))
        # |x - y'|^2 = 1 + |y'|^2 - 2 x.y' is no more than most^2 if the product is this or more.
        self.least = ((1 + (stand**2).sum(axis=1) - most**2) / 2 - SLACK).astype(np.float32)
        self.stand = stand.astype(np.float32)
        self.n = np.zeros(len(rep), np.int64)
        self.links: list[tuple[np.ndarray, np.ndarray]] = []
        self.held = 0

    def _hits(self, x: np.ndarray, own: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query, vector) of all pairs that the codes leave."""
        needed, single = self.model.probes(x, own, self.lists), x.astype(np.float32)
        begins = np.searchsorted(self.own, np.arange(self.lists.start, self.lists.stop + 1)).tolist()
        for k, (begin, end) in enumerate(zip(begins, begins[1:], strict=False)):
            rows = np.flatnonzero(needed[:, k]) if end > begin else ()
            for a in range(begin, end if len(rows) else begin, TILE):
                z = min(a + TILE, end)
                hit = single[rows] @ self.stand[a:z].T >= self.least[a:z]
                if hit.any():
                    i, j = np.nonzero(hit)
                    yield rows[i], a + j

    def ask(self, rep: np.ndarray, copies: np.ndarray, own: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rep, n) of the queries that have links."""
        n = np.zeros(len(rep), np.int64)
        for i, j in self._hits(x, own):
            # Two vectors of one list meet twice and count once.
            once = (own[i] != self.own[j]) | (rep[i] < self.rep[j])
            i, j = i[once], j[once]
            near = [np.einsum("ij,ij->i", x[i[k : k + 65536]], self.y[j[k : k + 65536]]) >= self.cosine for k in range(0, len(i), 65536)]
            linked = np.concatenate([np.zeros(0, bool), *near])
            i, j = i[linked], j[linked]
            if not len(i):
                continue
            np.add.at(n, i, self.copies[j])
            np.add.at(self.n, j, copies[i])
            self.links.append(_forest(rep[i], self.rep[j]))
            self.held += len(self.links[-1][0])
            if self.held > EDGES:
                self._fold()
        return rep[n > 0], n[n > 0]

    def _fold(self) -> None:
        self.links = [_forest(*(np.concatenate([v[k] for v in self.links]) for k in (0, 1)))] if self.links else []
        # Folded links are as many as the vectors at most.
        self.held = -len(self.links[0][0]) if self.links else 0

    def close(self) -> pa.RecordBatch:
        self._fold()
        a, b = self.links[0] if self.links else (np.zeros(0, np.int64),) * 2
        some = self.n > 0
        return _found(np.concatenate([self.rep[some], a]), np.concatenate([self.rep[some], b]), np.concatenate([self.n[some], np.zeros(len(a), np.int64)]))


def _found(a: np.ndarray, b: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(n)], ["a", "b", "n"])


PACKED = "key string, kind int, rep binary, copies binary, own binary, unit binary"


def links(entries: DataFrame, dim: int, cosine: float = COSINE, block: int | None = None) -> DataFrame:
    """(a, b, n) of distinct unit vectors (rep, copies, unit): n linked copies where a = b, else an edge of the forest."""
    spark = entries.sparkSession
    total = entries.count()
    block = block or max(1024, BLOCK_BYTES // (8 * dim))
    step = max(1, PACK_BYTES // (8 * dim))
    sample = entries.orderBy(F.xxhash64("unit"), "rep").limit(SAMPLE).select("unit").collect()
    x = np.stack([np.frombuffer(r["unit"], np.float64) for r in sample])
    lists = max(1, min(MOST_LISTS, total // LIST_ROWS))
    # Plain arrays: workers need not have the package to read them.
    shared = spark.sparkContext.broadcast(astuple(fit(x, lists, cosine, max(GROUPS, -(-total // block)))))

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        """(rows, vectors, own lists, which groups each asks, own groups, number of groups), a part of a batch at a time."""
        model = Model(*shared.value)
        groups = int(model.group[-1]) + 1
        begins = np.flatnonzero(np.diff(model.group, prepend=-1))
        for batch in batches:
            for part in (batch.slice(k, step) for k in range(0, batch.num_rows, step)):
                x = _matrix(part.column("unit"))
                d = model.distances(x)
                own = np.argmin(d, axis=1)
                asked = np.logical_or.reduceat(model.probes(x, own, d=d), begins, axis=1)
                yield part, x, own, asked, model.group[own], groups

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = None
        for _, _, _, asked, group, groups in assigned(batches):
            now = np.stack([np.bincount(group, minlength=groups), asked.sum(axis=0)])
            sums = now if sums is None else sums + now
        if sums is not None:
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in (np.arange(sums.shape[1]), *sums)], ["list", "held", "asked"])

    sizes = entries.select("unit").mapInArrow(count, "list bigint, held bigint, asked bigint")
    rows = sizes.groupBy("list").agg(F.sum("held").alias("held"), F.sum("asked").alias("asked")).collect()  # MOST_LISTS rows at most
    cut = {r["list"]: (max(1, -(-r["held"] // block)), max(PARTS, -(-r["asked"] // block))) for r in rows}

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x, own, asked, group, groups in assigned(batches):
            reps, copies = part.column("rep").to_numpy(), part.column("copies").to_numpy()
            hashed = mix(reps.view(np.uint64))

            def packed(key: str, kind: int, some: np.ndarray) -> tuple:
                arrays = reps[some], copies[some], own[some], x[some]  # noqa: B023
                return key, kind, *(v.astype(t).tobytes() for v, t in zip(arrays, (np.int64, np.int64, np.int64, np.float64), strict=True))

            for g in range(groups):
                blocks, parts = cut.get(g, (1, PARTS))
                held, query = np.flatnonzero(group == g), np.flatnonzero(asked[:, g])
                at, to = hashed[held] % np.uint64(blocks), hashed[query] % np.uint64(parts)
                out = [packed(f"{g}:{b}:{q}", 0, held[at == b]) for b in np.unique(at).tolist() for q in range(parts)]
                out += [packed(f"{g}:{b}:{q}", 1, query[to == q]) for q in np.unique(to).tolist() for b in range(blocks)]
                kinds = [pa.string(), pa.int32(), *[pa.binary()] * 4]
                # A few rows at a time: each holds up to PACK_BYTES of vectors.
                for some in (out[k : k + 8] for k in range(0, len(out), 8)):
                    columns = [pa.array(c, k) for c, k in zip(zip(*some, strict=True), kinds, strict=True)]
                    yield pa.RecordBatch.from_arrays(columns, ["key", "kind", "rep", "copies", "own", "unit"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, now, waiting, here = Model(*shared.value), None, [], None
        for batch in batches:
            for key, kind, *rest in zip(*(batch.column(c) for c in ("key", "kind", "rep", "copies", "own", "unit")), strict=True):
                rep, copies, own, unit = (np.frombuffer(v.as_buffer(), np.float64 if k == 3 else np.int64) for k, v in enumerate(rest))
                if (key := key.as_py()) != now:
                    if here is not None:
                        yield here.close()
                    now, waiting, here = key, [], None
                # The vectors of a block come before the queries.
                if kind.as_py() == 0:
                    waiting.append([v.copy() for v in (rep, copies, own, unit.reshape(len(rep), -1))])
                elif waiting or here is not None:
                    if here is None:
                        here = _Block(model, int(now.split(":")[0]), cosine, *(np.concatenate(v) for v in zip(*waiting, strict=True)))
                        waiting = []
                    found, n = here.ask(rep, copies, own, unit.reshape(len(rep), -1))
                    if len(found):
                        yield _found(found, found, n)
        if here is not None:
            yield here.close()

    dealt = entries.select("rep", "copies", "unit").mapInArrow(deal, PACKED)
    keys = sum(b * q for b, q in cut.values())
    dealt = dealt.repartition(min(max(keys, 1), MOST_LISTS), "key").sortWithinPartitions("key", "kind")
    return dealt.mapInArrow(meet, "a bigint, b bigint, n bigint")


def near_duplicates(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", cosine: float = COSINE) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row."""
    rows = kept_table(unit_vectors(df, vec_id, vector), "units")
    entries = rows.where("dim IS NOT NULL").groupBy("dim", "a", "b").agg(
        F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("copies"), F.first("unit").alias("unit")
    )
    # The number of an entry is written with it; ids of rows may be shared or null.
    entries = kept_table(entries.withColumn("rep", F.monotonically_increasing_id()), "entries")
    found = None
    for (dim,) in sorted(entries.select("dim").distinct().collect()):
        part = links(entries.where(F.col("dim") == dim), dim, cosine)
        found = part if found is None else found.union(part)
    if found is None:
        found = df.sparkSession.createDataFrame([], "a bigint, b bigint, n bigint")
    found = kept_table(found, "links")
    counts = found.where("a = b").groupBy("a").agg(F.sum("n").alias("n")).withColumnRenamed("a", "rep")
    groups = components(found.where("a != b"), "a", "b").select(F.col("node").alias("rep"), F.col("component").alias("group"))
    known = entries.join(counts, "rep", "left").join(groups, "rep", "left").select(
        "dim", "a", "b", "least", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("group", "rep").alias("group")
    )
    known = kept_table(known, "known")
    known = known.join(known.groupBy("group").agg(F.min("least").alias("component")), "group").drop("group", "least")
    out = rows.select("vec_id", "dim", "a", "b").join(known, ["dim", "a", "b"], "left")
    component = F.coalesce("component", "vec_id")
    shown = [F.when(c != LOWEST, c) for c in (F.col("vec_id"), component)]
    return out.select(
        shown[0].alias("vec_id"),
        F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        shown[1].alias("component_id"),
        (F.col("vec_id") == component).alias("kept"),
    )


def op1_product_quantisation(spark: SparkSession, folder: str) -> DataFrame:
    """Vectors linked by a cosine of 0.95 or more."""
    return near_duplicates(table(spark, folder, "embeddings"))
