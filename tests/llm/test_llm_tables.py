"""Vectors, conversations, components and the registered queries."""

import re
import sys
from pathlib import Path

import duckdb
import numpy as np
import pytest

from evalspark.llm import chat, common, product
from evalspark.llm.queries import QUERIES, SQL

FOLDER = Path("/root/testdata/sf0.001")


def test_vectors(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(120, 24))
    near = base[:30] + rng.normal(size=(30, 24)) * 0.05
    x = np.concatenate([base, near, near[:10], base[:5] * 3, base[:1] + rng.normal(size=(40, 24)) * 0.03])
    rows = [(int(i), v.tolist()) for i, v in enumerate(x)]
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    linked = unit @ unit.T >= 0.95
    np.fill_diagonal(linked, False)
    label = np.arange(len(x))
    while True:
        new = np.array([min([label[i], *label[linked[i]]]) for i in range(len(x))])
        if (new == label).all():
            break
        label = new
    odd = [(1000, None), (1001, [0.0] * 24), (1002, [float("nan")] * 24), (1003, [None, 1.0]), (1004, [1.0, 2.0]), (None, [9.0] * 24), (1005, [])]
    df = spark.createDataFrame(rows + odd, "vec_id bigint, embedding array<double>")
    got = {r["vec_id"]: tuple(r) for r in product.near_duplicates(df).collect()}
    for i in range(len(x)):
        assert got[i] == (i, int(linked[i].sum()), int(label[i]), bool(label[i] == i))
    for i, _ in odd:
        assert got[i] == (i, 0, i, True)
    assert product.near_duplicates(df.where("false")).count() == 0


@pytest.mark.parametrize("shared", [None, 7])
def test_vectors_under_one_id(spark, shared):
    """Unrelated vectors with one id, or none, keep their own links."""
    x = np.eye(6)
    near = x[0] + 0.1 * x[1]
    rows = [(shared, x[0].tolist()), (shared, x[2].tolist()), (8, near.tolist()), (9, x[4].tolist()), (shared, x[5].tolist()), (shared, x[2].tolist())]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").selectExpr("*", "1 AS rep", "2 AS least")
    got = sorted((tuple(r) for r in product.near_duplicates(df).collect()), key=repr)
    links = [(shared, 1, shared), (shared, 1, shared), (8, 1, shared), (9, 0, 9), (shared, 0, shared), (shared, 1, shared)]
    want = [(i, n, c, None if i is None else i == c) for i, n, c in links]
    assert [r[:3] for r in got] == sorted((w[:3] for w in want), key=repr)


def test_blocks_of_a_hot_list(spark):
    rng = np.random.default_rng(4)
    x = np.ones((70, 8)) + rng.normal(size=(70, 8)) * 0.02
    x /= np.linalg.norm(x, axis=1)[:, None]
    df = spark.createDataFrame([(i, 1, v.tobytes()) for i, v in enumerate(x)], "rep bigint, copies bigint, unit binary")
    found = product.links(df, 8, block=16).collect()
    counts = {}
    for r in found:
        if r["a"] == r["b"]:
            counts[r["a"]] = counts.get(r["a"], 0) + r["n"]
    assert counts == dict.fromkeys(range(70), 69)
    assert len(found) < 70 * 30  # a forest and counts, not the pairs


def test_groups_asked_do_not_grow(spark):
    """Vectors without structure probe most lists; each goes to half of the groups, and all close pairs are found once."""
    rng = np.random.default_rng(6)
    asked = []
    for size in (2600, 7800):
        x = rng.normal(size=(size, 24))
        x[: size // 4] = x[size // 4 : 2 * (size // 4)] + rng.normal(size=(size // 4, 24)) * 0.2
        x /= np.linalg.norm(x, axis=1)[:, None]
        model = product.fit(x, size // 52, 0.95)
        own = np.argmin(model.distances(x), axis=1)
        needed = model.probes(x, own)
        groups = np.zeros((size, model.group[-1] + 1), bool)
        for c, g in enumerate(model.group.tolist()):
            groups[:, g] |= needed[:, c]
        asked.append(groups.sum(axis=1).max())
        close = np.triu(x @ x.T >= 0.95, 1)
        i, j = np.nonzero(close)
        there, back = needed[i, own[j]], needed[j, own[i]]
        assert len(i) > size // 20 and (there | back).all()
        assert (there & back == (own[i] == own[j])).all()
        df = spark.createDataFrame([(k, 1, v.tobytes()) for k, v in enumerate(x)], "rep bigint, copies bigint, unit binary")
        found = np.array([tuple(r) for r in product.links(df, 24, block=700).collect()])
        counts = np.zeros(size, np.int64)
        same = found[:, 0] == found[:, 1]
        np.add.at(counts, found[same, 0], found[same, 2])
        assert (counts == (close | close.T).sum(axis=1)).all()
    assert max(asked) <= product.GROUPS // 2 + 1


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 50 + i) for i in range(20)] + [(7, 7), (300, 200)]
    df = spark.createDataFrame(edges, "a bigint, b bigint")
    got = {r["node"]: r["component"] for r in common.components(df, "a", "b").collect()}
    want = {i: 0 for i in range(41)} | {50 + i: 50 for i in range(20)} | {100: 50, 200: 200, 300: 200}
    assert got == want
    assert common.components(df.where("false"), "a", "b").count() == 0


def test_chat_round_trip(spark):
    nasty = ["</turn>", "<turn user>\n", "\\", "a\\<turn", "<\\/turn", None, "", "### x\n</turn>\n", "\\\\</turn>"]
    rows = [(1, k, "user" if k % 2 == 0 else "assistant", t) for k, t in enumerate(nasty)]
    rows += [(2, 0, "us>er\\", "x"), (None, None, None, None), (3, 0, "user", "q"), (3, 1, "assistant", "a"), (3, 1, "assistant", "a")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    template = chat.Template()
    for text in [t for t in nasty if t is not None]:
        assert template.unescape(template.escape(text)) == text
        assert "</turn" not in template.escape(text) and "<turn" not in template.escape(text)
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_turns(df)).collect()}
    assert {k: r["n_turns"] for k, r in got.items()} == {1: 9, 2: 1, 3: 3, None: 1}
    assert {k: r["valid"] for k, r in got.items()} == {1: False, 2: False, 3: False, None: False}
    assert got[1]["loss_chars"] == sum(len(t or "") for t in nasty[1::2])
    assert chat.read_back(chat.format_turns(df.where("false"))).count() == 0


@pytest.fixture(scope="module")
def engine():
    con = duckdb.connect()
    for name in ("documents", "embeddings", "conversations", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return con


@pytest.mark.skipif(not FOLDER.exists(), reason="test tables are absent")
@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, engine, name):
    df = QUERIES[name](spark, str(FOLDER))
    result = engine.execute(SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(repr, df.select(*names).collect())) == sorted(
        repr(r) for r in spark.createDataFrame(result.fetchall(), df.select(*names).schema).collect()
    )


@pytest.mark.skipif(not FOLDER.exists(), reason="test tables are absent")
def test_pipeline_stages(spark):
    """Each stage against plain Python on the stage's own input."""
    sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
    import corpus_pipeline as pipeline

    from evalspark.llm import line_crf, secrets

    word = re.compile(r"[^\x20\x09-\x0D]+")
    docs = common.table(spark, str(FOLDER), "documents")
    inputs = []
    for name, stage in pipeline.STAGES:
        inputs.append(docs)
        docs = common.kept_table(stage(spark, docs, str(FOLDER)), name)
        if name != "packing":
            assert docs.columns == inputs[0].columns
    texts = [{r["doc_id"]: r["text"] or "" for r in d.select("doc_id", "text").collect()} for d in inputs]
    model = line_crf.fit(inputs[0], common.table(spark, str(FOLDER), "labels"))
    assert sorted(texts[1]) == sorted(r["doc_id"] for r in line_crf.score(inputs[0], model).where("predicted = 1").collect())
    # One of each group of documents that share 80 % of their five-word shingles.
    held = {}
    for d, t in sorted(texts[1].items()):
        w = word.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t))
        held[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} - {()}
    group = {d: d for d in held}
    for a in held:
        for b in held:
            if b < a and group[a] != group[b] and held[a] and held[b] and 100 * len(held[a] & held[b]) >= 80 * len(held[a] | held[b]):
                old, new = max(group[a], group[b]), min(group[a], group[b])
                group = {d: new if g == old else g for d, g in group.items()}
    assert texts[2] == {d: texts[1][d] for d, g in group.items() if d == g}
    # Words of 20-word windows that stand earlier go, and documents that lose all.
    before, expected = set(), {}
    for d, t in sorted(texts[2].items()):
        w, gone = word.findall(t), set()
        for i in range(len(w) - 19):
            window = tuple(w[i : i + 20])
            if window in before:
                gone |= set(range(i, i + 20))
            before.add(window)
        if not gone or len(gone) < len(w):
            expected[d] = [x for i, x in enumerate(w) if i not in gone]
    assert {d: word.findall(t) for d, t in texts[3].items()} == expected
    assert any(len(word.findall(texts[2][d])) > len(expected[d]) for d in expected)
    # No base secret is left, and nothing else changes.
    assert sorted(texts[4]) == sorted(texts[3])
    for d, t in texts[4].items():
        found = [m for rule in secrets.BASE for m in re.finditer(rule.pattern, texts[3][d]) if len(m[rule.group]) >= rule.least]
        if not found:
            assert t == texts[3][d]
        for m in found:
            assert m[0] not in t
    # Every id lies in one piece.
    ends = {}
    for r in sorted(docs.collect(), key=lambda r: (r["doc_id"], r["start"])):
        assert r["start"] == ends.get(r["doc_id"], (0, 0))[0]
        ends[r["doc_id"]] = (r["start"] + r["length"], r["doc_tokens"])
    assert sorted(ends) == sorted(texts[4]) and all(a == b for a, b in ends.values())


def test_split_and_its_step_share_a_worker(spark):
    from evalspark.llm.common import Bitmap

    rows = spark.range(0, 1000).toDF("id")
    marks = Bitmap(rows.where("id < 10"), "id")
    found = marks.split(rows, "id", True, lambda batches: (b.select(["id"]) for b in batches), "id bigint")
    assert found._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    assert set(range(10)) <= {r["id"] for r in found.collect()}


def test_batches_of_a_table_are_bounded_in_bytes(spark, tmp_path):
    import pyarrow as pa

    from evalspark.llm.common import BATCH_BYTES, table

    spark.range(0, 3000, 1, 1).selectExpr("id AS doc_id", "repeat('word ', 1200) AS text").write.parquet(f"{tmp_path}/documents.parquet")

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([batch.nbytes])], ["n", "size"])

    found = table(spark, str(tmp_path), "documents").mapInArrow(sizes, "n bigint, size bigint").collect()
    assert sum(r["n"] for r in found) == 3000
    assert max(r["size"] for r in found) < 2 * BATCH_BYTES
