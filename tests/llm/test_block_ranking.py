"""Ranked search against a full scan in plain Python."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from evalspark.llm import block_ranking as br

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def full_scan(docs, queries, top=10):
    bags = [(i, Counter(terms(t))) for i, t in docs if terms(t)]
    n, total = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in queries:
        found = []
        for doc, bag in bags:
            m, score = 10 + (90 * sum(bag.values()) * n) // total, 0
            for t in set(terms(text)) & set(bag):
                score += math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * bag[t]) // (1000 * bag[t] + 8 * m))
            if score > 0:
                found.append((-score, doc is None, doc or 0, doc))
        out += [(item, r + 1, doc, -s) for r, (s, _, _, doc) in enumerate(sorted(found, key=lambda x: x[:3])[:top])]
    return sorted(out, key=repr)


def rows(df):
    return sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in df.collect()), key=repr)


@pytest.mark.parametrize("shard, block", [(500_000, 64), (700, 3), (50, 1)])
def test_equals_a_full_scan(spark, texts, docs, monkeypatch, shard, block):
    monkeypatch.setattr(br, "SHARD", shard)
    monkeypatch.setattr(br, "BLOCK", block)
    rng = random.Random(7)
    words = sorted({w for t in texts for w in terms(t)})
    extra = [(1000 + i, " ".join(rng.choices(words, k=rng.randint(1, 60)))) for i in range(300)]
    extra += [(2000 + i, "same Words here, Été") for i in range(40)] + [(2000, "same words"), (5000, "q" * 700_000 + " same")]
    df = docs.select("doc_id", "text", "n", "s", "score").unionByName(
        spark.createDataFrame(extra, "doc_id bigint, text string"), allowMissingColumns=True
    ).repartition(3)
    asked = [(i, " ".join(rng.choices(words, k=25))) for i in range(12)] + [(50, "SAME été"), (51, None), (52, ""), (53, texts[11]), (53, "same"), (None, "words"), (54, "nowhereatall")]
    queries = spark.createDataFrame(asked, "item_id bigint, text string").withColumn("query", F.lit(1))
    plain = [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
    assert rows(br.rank(df, queries)) == full_scan(plain, asked)
    assert rows(br.rank(df, queries, top=3)) == full_scan(plain, asked, 3)


def test_query_blocks(spark, docs, texts, monkeypatch):
    asked = [(i, texts[k]) for i, k in enumerate((9, 10, 11, 12, 13))]
    queries = spark.createDataFrame(asked, "item_id bigint, text string")
    whole = rows(br.rank(docs, queries))
    monkeypatch.setattr(br, "QUERIES", 2)
    assert rows(br.rank(docs, queries)) == whole


def test_nothing_to_rank(spark, docs, no_docs):
    queries = spark.createDataFrame([(1, "x")], "item_id bigint, text string")
    assert br.rank(no_docs, queries).count() == 0
    assert br.rank(docs, queries.where("false")).count() == 0
    assert br.rank(docs, queries.withColumn("text", F.lit("..."))).count() == 0


def test_bounds_hold_and_skip(spark):
    """No block's bound is below a score in it, and near copies of a query keep most blocks from being scored."""
    import numpy as np

    rng = np.random.default_rng(2)
    rows_, u, value = [0], [], []
    for d in range(400):
        own = np.sort(rng.choice(80, 20, replace=False)) if d % 4 else np.arange(d % 60, d % 60 + 20)
        u.append(own)
        value.append(rng.integers(1, 1000, 20))
        rows_.append(rows_[-1] + 20)
    weight = rng.integers(0, 9000, 80)
    axes = rng.normal(size=(80, 16)).astype(np.float32)
    shard = br.Shard(np.arange(400), np.array(rows_), np.concatenate(u), np.concatenate(value), weight, axes)
    terms_, wq = np.arange(30, 45), np.zeros(80, np.int64)
    wq[terms_] = weight[terms_]
    scored = []
    plain = shard.scores
    exact = plain(np.arange(400), wq)
    for t in terms_.tolist():
        docs, starts, least, su, sv, at = shard.blocks(t)
        bounds = np.add.reduceat(wq[su] * sv, at)
        for b in range(len(least)):
            inside = docs[starts[b] : starts[b + 1]]
            assert bounds[b] >= exact[inside].max() and least[b] == inside.min()
    shard.scores = lambda d, w: (scored.append(len(d)), plain(d, w))[1]
    score, ids = shard.search(terms_, wq, (np.zeros(0, np.int64), np.zeros(0, np.int64)), 10)
    want = np.lexsort([np.arange(400), -exact])[:10]
    assert ids.tolist() == want.tolist() and score.tolist() == exact[want].tolist()
    assert sum(scored) < 400
