"""Quality classifier: a linear-chain conditional random field over the lines of a document.

Every line gets a few measured shares, cut into bins; the features of a line are the bins of the line and of its
two neighbours. Training takes the label of a document for each of its lines, on a bounded number of labelled
documents (`max_docs`, the ones with the smallest hash of doc_id). The length-weighted mean of the forward-backward
marginals is the quality of a document, mapped to a probability by a logistic curve fitted on the same documents.

Null and empty texts are one empty line and get a score like any other; repeated rows get equal scores; null
doc_id is never trained on and not held out; null labels do not train; if a document has several labels, the
smallest counts. Without two classes to train on the score is the share of good labels (0.5 without labels).
An empty table gives no rows. Texts alone decide a score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evalspark.llm.common import ROW_BYTES, Words, mix, pieces, run_hashes, table, text_bytes

MAX_DOCS = 6000
LIMIT = 0.3
BINS = 8
SYMBOLS = b"#*$%&|<>"
MEASURES = 12
WIDTH = 3 * (MEASURES * BINS + 1)


def _class(chars) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


MARK = _class(SYMBOLS)
# Kinds of bytes, each of which has one; 0 is any other.
UPPER, LOWER, DIGIT, BAR, SIGN, LOUD, STOP, WHITE = range(1, 9)
KINDS = np.zeros(256, np.uint8)
for _kind, _chars in (
    (UPPER, range(65, 91)),
    (LOWER, range(97, 123)),
    (DIGIT, range(48, 58)),
    (SIGN, SYMBOLS),
    (BAR, b"|"),
    (LOUD, b"!"),
    (STOP, b".,;:?"),
    (WHITE, [32, 9, 11, 12, 13, 10]),
):
    KINDS[list(_chars)] = _kind


def line_bins(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bins per line and measure, bytes per line, lines per row) of the rows of a text column."""
    data, at = text_bytes(texts)
    rows = len(at) - 1
    breaks = np.flatnonzero(data == 10)
    # A row's lines start at its own start and after each line break.
    first = np.sort(np.concatenate([at[:-1], breaks + 1]), kind="stable")
    owner = np.concatenate([np.arange(rows), np.searchsorted(at, breaks, side="right") - 1])
    lines = np.bincount(owner, minlength=rows)
    ends_at = np.cumsum(lines) - 1
    last = np.concatenate([first[1:] - 1, [len(data)]]) if len(first) else first
    last[ends_at] = at[1:]
    size = last - first

    # Bytes of each kind in each line; a break counts as white space of the line that it ends.
    line_of = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(data))))
    kinds = np.bincount(line_of * (WHITE + 1) + KINDS[data], minlength=len(first) * (WHITE + 1)).reshape(-1, WHITE + 1)
    words = Words(texts)
    place = np.searchsorted(first, words.first, side="right") - 1
    # Several empty lines share a start; a word belongs to the last of them, which is the one with the text.
    n_words = np.bincount(place, minlength=len(first))
    chars = kinds[:, :WHITE].sum(axis=1)
    letters = kinds[:, UPPER] + kinds[:, LOWER]
    order = np.lexsort((words.hash, place))
    same = (words.hash[order][1:] == words.hash[order][:-1]) & (place[order][1:] == place[order][:-1])
    repeats = np.bincount(place[order][1:][same], minlength=len(first))
    next_same = (words.hash[1:] == words.hash[:-1]) & (place[1:] == place[:-1])
    stutter = np.bincount(place[1:][next_same], minlength=len(first))
    marked = MARK[data[words.last - 1]] if len(words.last) else np.zeros(0, bool)
    marks = np.bincount(place[marked], minlength=len(first)) if len(place) else np.zeros(len(first))
    full = size > 0
    key = np.zeros(len(first), np.uint64)
    key[full] = run_hashes(data, first[full], last[full])
    line_row = np.repeat(np.arange(rows), lines)
    order = np.lexsort((key, line_row))
    again = np.zeros(len(first), bool)
    again[order[1:]] = (key[order][1:] == key[order][:-1]) & (line_row[order][1:] == line_row[order][:-1]) & full[order[1:]]
    # Repeats over the whole row: distinct words of all, for lines that repeat each other's words.
    word_row = words.rows()
    order = np.argsort(mix(words.hash + word_row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), kind="stable")
    fresh = np.ones(len(order), bool)
    fresh[1:] = (words.hash[order][1:] != words.hash[order][:-1]) | (word_row[order][1:] != word_row[order][:-1])
    distinct = np.bincount(word_row[order][fresh], minlength=rows) / np.maximum(words.count, 1)
    w, c = np.maximum(n_words, 1), np.maximum(chars, 1)
    shares = [
        kinds[:, UPPER] / np.maximum(letters, 1),
        (kinds[:, SIGN] + kinds[:, BAR]) / c,
        kinds[:, LOUD] / c,
        kinds[:, BAR] / c,
        kinds[:, STOP] / c,
        kinds[:, DIGIT] / c,
        repeats / w,
        stutter / w,
        marks / w,
        distinct[line_row] if rows else np.zeros(0),
    ]
    cuts = np.array([0.0, 0.02, 0.06, 0.15, 0.3, 0.5, 0.8])
    bins = [np.searchsorted(cuts, s, side="left") for s in shares]
    bins.append(np.minimum(np.log2(chars / w + 1).astype(int), BINS - 1))
    bins.append(np.where(again, BINS - 1, np.minimum(np.log2(n_words + 1).astype(int) // 2, BINS - 2)))
    return np.stack(bins, axis=1), size, lines


def emissions(bins: np.ndarray, lines: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Score of the good label for every line, over the bad one."""
    if not len(bins):
        return np.zeros(0)
    at = np.cumsum(lines)
    w = weights.reshape(3, MEASURES * BINS + 1)
    slots = bins + np.arange(MEASURES) * BINS
    own, before, after = (w[k][slots].sum(axis=1) + w[k][-1] for k in range(3))
    out = own.copy()
    inner = np.ones(len(bins), bool)
    inner[np.concatenate([[0], at[:-1]])] = False
    out[inner] += before[np.flatnonzero(inner) - 1]
    inner = np.ones(len(bins), bool)
    inner[at - 1] = False
    out[inner] += after[np.flatnonzero(inner) + 1]
    return out


class Chains:
    """Rows as chains of lines, longest first, so that step t touches the first few chains only."""

    def __init__(self, lines: np.ndarray):
        self.start = np.concatenate([[0], np.cumsum(lines)[:-1]]).astype(int)
        self.order = np.argsort(-lines, kind="stable")
        self.lines = lines[self.order]
        self.begin = self.start[self.order]
        longest = int(lines.max()) if len(lines) else 0
        self.active = np.searchsorted(-self.lines, -np.arange(longest), side="left")

    def marginals(self, scores: np.ndarray, moves: np.ndarray):
        """(marginal of good per line, marginal of each move over all lines, log of the partition functions)."""
        n, top = len(scores), len(self.active)
        pot = np.stack([np.zeros(n), scores], axis=1)
        pot = np.exp(pot - pot.max(axis=1, keepdims=True))
        shift = np.maximum(scores, 0).sum()
        step = np.exp(moves)
        ahead, scale = np.zeros((n, 2)), np.ones(n)
        for t in range(top):
            i = self.begin[: self.active[t]] + t
            now = pot[i] * (ahead[i - 1] @ step if t else 1.0)
            scale[i] = now.sum(axis=1)
            ahead[i] = now / scale[i, None]
        back = np.ones((n, 2))
        for t in range(top - 2, -1, -1):
            i = self.begin[: self.active[t + 1]] + t
            back[i] = (pot[i + 1] * back[i + 1]) @ step.T / scale[i + 1, None]
        good = ahead * back
        later = np.ones(n, bool)
        later[self.start] = False
        j = np.flatnonzero(later)
        pairs = np.einsum("ia,ab,ib->ab", ahead[j - 1], step, pot[j] * back[j] / scale[j, None])
        return good[:, 1] / good.sum(axis=1), pairs, np.log(scale).sum() + shift


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    moves: np.ndarray
    slope: float
    base: float

    def quality(self, bins: np.ndarray, size: np.ndarray, lines: np.ndarray) -> np.ndarray:
        """Length-weighted share of good lines per row."""
        if not len(lines):
            return np.zeros(0)
        good, _, _ = Chains(lines).marginals(emissions(bins, lines, self.weights), self.moves)
        at = np.concatenate([[0], np.cumsum(lines)[:-1]])
        weight = size + 1.0
        return np.add.reduceat(good * weight, at) / np.add.reduceat(weight, at)

    def probability(self, quality: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.slope * quality + self.base)))


def train(bins: np.ndarray, size: np.ndarray, lines: np.ndarray, label: np.ndarray, rounds: int = 150, ridge: float = 1.0) -> Model:
    """Weights of most conditional likelihood with a ridge, by Adam steps; then the logistic curve of the documents."""
    if not len(label) or label.min() == label.max():
        share = float(label.mean()) if len(label) else 0.5
        return Model(np.zeros(WIDTH), np.zeros((2, 2)), 0.0, float(np.log((share + 1e-3) / (1 - share + 1e-3))))
    chains, truth = Chains(lines), np.repeat(label, lines).astype(float)
    at = np.concatenate([[0], np.cumsum(lines)[:-1]])
    later = np.ones(len(truth), bool)
    later[at] = False
    j = np.flatnonzero(later)
    seen = np.zeros((2, 2))
    np.add.at(seen, (truth[j - 1].astype(int), truth[j].astype(int)), 1)
    slots = bins + np.arange(MEASURES) * BINS
    ends = np.cumsum(lines) - 1
    inner = np.ones(len(truth), bool)
    inner[ends] = False
    k = np.flatnonzero(inner)
    theta, m, v = np.zeros(WIDTH + 4), np.zeros(WIDTH + 4), np.zeros(WIDTH + 4)
    for step in range(1, rounds + 1):
        moves = theta[WIDTH:].reshape(2, 2)
        good, pairs, _ = chains.marginals(emissions(bins, lines, theta[:WIDTH]), moves)
        off = good - truth
        grad = np.zeros((3, MEASURES * BINS + 1))
        for part, (place, error) in enumerate(((slots, off), (slots[j - 1], off[j]), (slots[k + 1], off[k]))):
            grad[part, :-1] = np.bincount(place.ravel(), np.repeat(error, MEASURES), minlength=MEASURES * BINS)
            grad[part, -1] = error.sum()
        whole = np.concatenate([grad.ravel(), (pairs - seen).ravel()]) + ridge * theta
        whole /= len(truth)
        m, v = 0.9 * m + 0.1 * whole, 0.99 * v + 0.01 * whole**2
        theta -= 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    model = Model(theta[:WIDTH].copy(), theta[WIDTH:].reshape(2, 2).copy(), 0.0, 0.0)
    x = model.quality(bins, size, lines)
    a, b = 1.0, 0.0
    for _ in range(50):  # Newton steps of a logistic regression with a small ridge
        p = 1 / (1 + np.exp(-(a * x + b)))
        w = p * (1 - p) + 1e-9
        g = np.array([((p - label) * x).sum() + 0.01 * a, (p - label).sum() + 0.01 * b])
        h = np.array([[(w * x * x).sum() + 0.01, (w * x).sum()], [(w * x).sum(), w.sum() + 0.01]])
        da, db = np.linalg.solve(h, g)
        a, b = a - da, b - db
    return Model(model.weights, model.moves, float(a), float(b))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_DOCS) -> Model:
    """Train on at most `max_docs` labelled documents that are not held out; only their bins reach the driver."""
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id")))
    usable = usable.groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    chosen = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, "text", ROW_BYTES):
                bins, size, lines = line_bins(batch.column("text"))
                at = np.concatenate([[0], np.cumsum(lines)])
                parts = [bins[a:b].astype(np.uint8).tobytes() for a, b in zip(at, at[1:], strict=False)]
                sizes = [size[a:b].astype(np.int64).tobytes() for a, b in zip(at, at[1:], strict=False)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), batch.column("quality"), pa.array(parts, pa.binary()), pa.array(sizes, pa.binary())],
                    ["doc_id", "quality", "bins", "sizes"],
                )

    # max_docs rows of two numbers: a broadcast of a known size, which spares the shuffle of all texts.
    found = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    rows = found.mapInArrow(run, "doc_id bigint, quality int, bins binary, sizes binary").collect()
    rows.sort(key=lambda r: (r["doc_id"], bytes(r["bins"]), bytes(r["sizes"])))
    if not rows:
        return train(np.zeros((0, MEASURES), int), np.zeros(0, int), np.zeros(0, int), np.zeros(0, int))
    bins = [np.frombuffer(r["bins"], np.uint8).reshape(-1, MEASURES).astype(int) for r in rows]
    size = np.concatenate([np.frombuffer(r["sizes"], np.int64) for r in rows])
    return train(np.concatenate(bins), size, np.array([len(b) for b in bins]), np.array([r["quality"] for r in rows]))


def score(docs: DataFrame, model: Model, limit: float = LIMIT, keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` (doc_id) of every row with `score` and `predicted`."""
    keep = ["doc_id"] if keep is None else keep
    inner = docs.select(*dict.fromkeys([*keep, "text"]))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in inner.select(*keep).schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, "text", ROW_BYTES):
                p = model.probability(model.quality(*line_bins(batch.column("text"))))
                columns = [*[batch.column(c) for c in keep], pa.array(p), pa.array((p >= limit).astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, [*keep, "score", "predicted"])

    return inner.mapInArrow(run, ", ".join([*fields, "score double", "predicted int"]))


def op8_line_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Quality score of every document, learnt from the labels that are not held out."""
    docs = table(spark, folder, "documents")
    model = fit(docs, table(spark, folder, "labels"))
    scored = score(docs, model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
