"""Tree concatenation against the tokenizer itself."""

import hashlib
import random

import pyarrow as pa
import pytest

from evalspark.llm import tree_bpe as tb

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def codec():
    return tb.TreeCodec(tb.model_path())


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(tb.model_path())


def hard_texts():
    rng = random.Random(1)
    out = ["", None, "<|endoftext|>x<|startoftext|><|endoftext|", "ab" * 900 + "!" * 700, "a" * 5000, "thethethe" * 90]
    out += ["ΑΣΣ Σ'S'Re'll !'s 'soo '''s", "\x1cа́бᲉꟋ x1234²³Ⅷ", "日本語テキスト" * 60, "é́ İ ß   x"]
    for letters in ("ab", "the", "aeinrst", "!.?-", "abcdefghijklmnopqrstuvwxyz'1 ", "é😀ß中文a"):
        out += ["".join(rng.choice(letters) for _ in range(n)) for n in (5, 16, 17, 33, 200, 1000)]
    return out


def test_ids_are_those_of_the_tokenizer(codec, library, texts):
    every = hard_texts() + texts
    ids = codec.encode(pa.array(every, pa.string()))
    for text, got, back in zip(every, ids.to_pylist(), codec.decode(ids).to_pylist()):
        want = library.encode(text or "", add_special_tokens=False).ids
        assert got == want, repr((text or "")[:60])
        assert back == library.decode(want, skip_special_tokens=False)


@pytest.mark.parametrize("leaf", [1, 2, 5])
def test_joins_hold_for_every_leaf_size(codec, library, monkeypatch, leaf):
    """Smaller leaves put a join at every place of a word."""
    monkeypatch.setattr(tb, "LEAF", leaf)
    monkeypatch.setattr(tb, "LONG", 24)
    rng = random.Random(leaf)
    names = [t.replace("</w>", "") for t in library.get_vocab() if not t.startswith("<|") and t.isascii()]
    words = ["".join(rng.choice(names) for _ in range(rng.choice([1, 2, 4, 9]))) for _ in range(400)]
    got = codec.encode(pa.array(words)).to_pylist()
    assert got == [library.encode(w, add_special_tokens=False).ids for w in words]


def test_rows_of_a_table(spark, library, docs, no_docs, texts):
    long = ["ø" * 300_000 + " x" * 200_000, None, ""]
    df = docs.unionByName(spark.createDataFrame([(None, t) for t in long], "doc_id bigint, text string"), allowMissingColumns=True)
    df = df.withColumn("ids", df.doc_id).withColumn("decoded", df.doc_id)
    got = tb.decode(tb.encode(df))
    assert got.columns == [c for c in df.columns if c not in ("text", "ids", "decoded")] + ["ids", "decoded"]
    want = []
    for row in df.collect():
        ids = library.encode(row["text"] or "", add_special_tokens=False).ids
        want.append((row["doc_id"], len(ids), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    rows = [(r["doc_id"], len(r["ids"]), hashlib.sha256(r["decoded"].encode()).hexdigest()) for r in got.collect()]
    assert sorted(rows, key=repr) == sorted(want, key=repr)
    assert tb.decode(tb.encode(no_docs)).count() == 0


def test_another_kind_of_file_is_refused(tmp_path):
    import json

    with open(tb.model_path(), encoding="utf-8") as f:
        file = json.load(f)
    file["normalizer"]["normalizers"].pop()
    other = tmp_path / "other.json"
    other.write_text(json.dumps(file), encoding="utf-8")
    with pytest.raises(ValueError):
        tb.TreeCodec(str(other))
