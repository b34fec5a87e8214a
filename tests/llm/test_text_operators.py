"""Operators on documents against plain Python."""

import hashlib
import random
import re
import struct
import sys
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from evalspark.llm import anchors, columns, jaccard, line_crf, packing, perplexity, secrets, subword

WORD = r"[^\x20\x09-\x0D]+"


def rows_of(df, *names):
    return sorted(map(tuple, df.select(*names).collect()), key=repr)


def pairs(docs):
    return [(r["doc_id"], r["text"] or "") for r in docs.select("doc_id", "text").collect()]


def test_anchors(docs, no_docs):
    listed = pairs(docs)
    expected = []
    for doc_id, text in listed:
        w = re.findall(WORD, text)
        gone, seen = set(), set()
        smaller = [re.findall(WORD, t) for d, t in listed if (d is None, d) != (doc_id is None, doc_id) and (d is None or (doc_id is not None and d < doc_id))]
        before = {tuple(x[i : i + 20]) for x in smaller for i in range(len(x) - 19)}
        for i in range(len(w) - 19):
            key = tuple(w[i : i + 20])
            if key in before or key in seen:
                gone |= set(range(i, i + 20))
            seen.add(key)
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        expected.append((doc_id, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    got = rows_of(anchors.digests(docs), "doc_id", "n_words", "n_removed", "kept_sha256")
    assert got == sorted(expected, key=repr)
    assert sum(x[2] for x in expected) > 100
    assert anchors.digests(no_docs).count() == 0
    cut = anchors.without_repeats(docs)
    assert cut.columns == docs.columns
    assert all(r["n_chars"] == len(r["text"]) for r in cut.collect() if r["text"] is not None and r["n_chars"] is not None)


@pytest.mark.parametrize("most_kinds", [16_384, 1])
def test_columns(docs, no_docs, most_kinds):
    listed = [(d, t.encode()) for d, t in pairs(docs)]
    often = Counter(b[i : i + 400] for _, b in listed for i in range(len(b) - 399))
    expected = []
    for doc_id, b in listed:
        gone = [False] * len(b)
        for i in range(len(b) - 399):
            if often[b[i : i + 400]] > 1:
                gone[i : i + 400] = [True] * 400
        runs = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        expected.append((doc_id, len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    got = rows_of(columns.digests(docs, most_kinds), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == sorted(expected, key=repr)
    assert columns.digests(no_docs, most_kinds).count() == 0


def shingles(text):
    w = re.findall(WORD, "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
    if not w:
        return frozenset()
    return frozenset(zip(w, w[1:], w[2:], strict=False)) if len(w) > 2 else frozenset([tuple(w)])


def test_jaccard(docs, no_docs):
    listed = [(d, shingles(t)) for d, t in pairs(docs)]
    group = {d: d for d, _ in listed}
    order = lambda d: (d is not None, d)
    for _ in range(len(listed)):
        for a, x in listed:
            for b, y in listed:
                if x and y and 100 * len(x & y) >= 90 * len(x | y):
                    group[a] = group[b] = min(group[a], group[b], key=order)
    expected = [(d, len(x), group[d]) for d, x in listed]
    assert rows_of(jaccard.join(docs), "doc_id", "n_shingles", "component_id") == sorted(expected, key=repr)
    assert jaccard.join(no_docs).count() == 0
    kept = jaccard.one_of_each(docs)
    assert kept.columns == docs.columns
    named = [d for d, _ in listed if d is not None and group[d] == d]
    got = sorted(r["doc_id"] for r in kept.where("doc_id IS NOT NULL").collect())
    assert got == sorted(set(named))


def test_jaccard_pairs_meet_once(spark):
    """Near copies share most of their prefixes, but a pair comes out of few of these lists."""
    import pyarrow as pa

    rng = random.Random(8)
    base = [f"w{rng.randrange(9000)}" for _ in range(300)]
    texts = []
    for k in range(40):
        w = list(base)
        w[rng.randrange(300)], w[rng.randrange(300)] = f"x{k}", f"y{k}"
        texts.append(" ".join(w))
    name = [int(x) for x in jaccard.set_names(*jaccard.shingle_sets(pa.array(texts))).view("int64")]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    labels, frequent = spark.createDataFrame([], "doc_id bigint, s bigint, label bigint"), spark.createDataFrame([], "token bigint, times bigint")
    met = [(r["a"], r["b"]) for r in jaccard.list_pairs(docs, labels, frequent).collect()]
    held = [shingles(t) for t in texts]
    linked = {tuple(sorted((name[a], name[b]))) for a in range(40) for b in range(a) if 100 * len(held[a] & held[b]) >= 90 * len(held[a] | held[b])}
    assert len(linked) == 780 and linked <= set(met)
    assert len(met) < 3 * len(linked)


def test_jaccard_fine_sketches():
    """They bound the difference of two sets from below, also folded, and tell large sets apart that short ones can't."""
    import numpy as np

    draw = np.random.default_rng(4)
    for size, other in ((1, 0), (40, 4), (3000, 1800), (5000, 5000)):
        both = draw.integers(0, 2**63, size, dtype=np.uint64)
        x, y = both, np.concatenate([both[other:], draw.integers(0, 2**63, other + size // 3, dtype=np.uint64)])
        apart = 2 * other + size // 3
        short = [jaccard.sketches(np.sort(v), np.array([0, len(v)])) for v in (x, y)]
        fine = [np.frombuffer(jaccard.fine_sketch(v), np.uint8)[None] for v in (x, y)]
        bits = 8 * min(v.size for v in fine)
        least = int(jaccard.apart(*(jaccard.folded(v, bits) for v in fine))[0])
        assert int(jaccard.apart(*short)[0]) <= apart and 0.6 * apart <= least <= apart
    # Sets of 5,000 and 6,666 shingles that share nothing: 90 % would need fewer than 614 apart, short sketches say 512 or so.
    assert int(jaccard.apart(*short)[0]) < 614 < least


def test_jaccard_shared_ids(spark):
    """Different texts under null and repeated ids keep the labels of their own sets."""
    import numpy as np
    import pyarrow as pa

    rng = random.Random(3)
    bases = [[f"w{rng.randrange(900)}" for _ in range(120)] for _ in range(12)]
    texts = [" ".join(b) for b in bases] + [" ".join([*b[:-1], "end"]) for b in bases] + [" ".join(["start", *b[1:-1], "end"]) for b in bases]
    name = [int(x) for x in jaccard.set_names(*jaccard.shingle_sets(pa.array(texts))).view(np.int64)]
    schema = "doc_id bigint, text string"
    frequent = spark.createDataFrame([], "token bigint, times bigint")
    for shared in (None, 7):
        docs = spark.createDataFrame([(shared, t) for t in texts[:24]], schema)
        key = jaccard.LOWEST if shared is None else shared
        labels = spark.createDataFrame([(key, s, k) for k, s in enumerate(name[:24])], "doc_id bigint, s bigint, label bigint")
        met = {(r["a"], r["b"]) for r in jaccard.list_pairs(docs, labels, frequent).collect()}
        assert {tuple(sorted((name[k], name[k + 12]))) for k in range(12)} <= met
    rows = [([None, 5, 6, 100 + k][k % 4], t) for k, t in enumerate(texts)]
    held, least = [shingles(t) for t in texts], lambda d: jaccard.LOWEST if d is None else d
    group = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if 100 * len(held[a] & held[b]) >= 90 * len(held[a] | held[b]):
                old, new = group[a], group[b]
                group = [new if g == old else g for g in group]
    lowest = {g: min(least(rows[k][0]) for k in range(len(rows)) if group[k] == g) for g in group}
    expected = [(d, len(held[k]), None if lowest[group[k]] == jaccard.LOWEST else lowest[group[k]]) for k, (d, _) in enumerate(rows)]
    got = rows_of(jaccard.join(spark.createDataFrame(rows, schema)), "doc_id", "n_shingles", "component_id")
    assert got == sorted(expected, key=repr)


@pytest.mark.parametrize("shared", [7, None])
def test_one_of_each_under_one_id(spark, shared):
    """Unrelated texts under one id are judged apart; repeated rows stay once."""
    rng = random.Random(4)
    a, b, c, d = (" ".join(f"{n}{rng.randrange(900)}" for _ in range(60)) for n in "abcd")
    rows = [(shared, a), (shared, b), (3, b + " end"), (shared, c), (shared, c), (9, c + " end"), (10, d), (10, d), (11, ""), (11, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "'k' AS __own", "1 AS n", "2 AS kinds")
    got = sorted(((r["doc_id"], r["text"]) for r in jaccard.one_of_each(docs).collect()), key=repr)
    if shared is None:
        # Rows without an id stay; a null id is the smallest of its group.
        want = [(None, a), (None, b), (None, c), (None, c), (10, d), (11, ""), (11, None)]
    else:
        want = [(7, a), (3, b + " end"), (7, c), (10, d), (11, ""), (11, None)]
    assert got == sorted(want, key=repr)


def test_pipeline_near_duplicates(spark):
    """Five words and 80 % against all pairs, on copies that three words and 90 % tell apart."""
    sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
    import corpus_pipeline as pipeline

    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(500)]
    texts = [None, "", "one two three four", "One two three four", "one two three"]
    for length in (20, 40, 48, 50, 52, 55, 90, 300):
        for _ in range(6):
            base = [rng.choice(vocabulary) for _ in range(length)]
            texts.append(" ".join(base))
            for changes in (1, 2, 3):
                other = list(base)
                for k in rng.sample(range(length), changes):
                    other[k] = "other"
                texts.append(" ".join(other))
    rng.shuffle(texts)

    def sets(text, size):
        w = re.findall(WORD, (text or "").lower())
        return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} - {()}

    def kept(size, percent):
        held = [sets(t, size) for t in texts]
        group = list(range(len(texts)))
        for a in range(len(texts)):
            for b in range(a):
                if held[a] and held[b] and 100 * len(held[a] & held[b]) >= percent * len(held[a] | held[b]):
                    old, new = max(group[a], group[b]), min(group[a], group[b])
                    group = [new if g == old else g for g in group]
        return [i for i, g in enumerate(group) if g == i]

    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = sorted(r["doc_id"] for r in pipeline.near_duplicates(spark, docs, "").collect())
    assert got == kept(5, 80)
    assert len(got) < len(kept(3, 90))


def test_packing(docs, no_docs):
    from tokenizers import Tokenizer

    inner = Tokenizer.from_file(packing.tokenizer_path())
    packed = packing.pack(docs, length=64).collect()
    streams = defaultdict(list)
    for r in packed:
        streams[r["sequence_id"]].append((r["offset"], r["length"]))
    for k, parts in streams.items():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at == 64 or k == max(streams)
    got = Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in packed)
    want = Counter()
    starts = defaultdict(set)
    for r in packed:
        starts[r["doc_id"]].add((r["start"], r["length"]))
    for doc_id, text in pairs(docs):
        ids = inner.encode(text, add_special_tokens=False).ids + [1]
        own = [(s, n) for s, n in starts[doc_id] if zlib.crc32(struct.pack(f"<{n}I", *ids[s : s + n])) and s + n <= len(ids)]
        assert {0} <= {s for s, _ in own}
        want[doc_id, len(ids)] += len(ids)
    held = Counter()
    for (doc_id, _, length, _, total), times in got.items():
        held[doc_id, total] += length * times
    assert held == want
    assert packing.pack(no_docs).count() == 0


def test_hilbert_steps():
    import itertools

    import numpy as np

    points = np.array(list(itertools.product(range(8), repeat=3)))
    keys = packing.hilbert_keys(points, 3)
    assert sorted(keys) == list(range(512))
    assert set(np.abs(np.diff(points[np.argsort(keys)], axis=0)).sum(axis=1)) == {1}


def spans(text, pattern, group, least, kind):
    return [(m.start(), kind, m.end()) for m in re.finditer(pattern, text) if len(m[group]) >= least]


def test_ledger(spark, docs, no_docs, tmp_path):
    path = f"file://{tmp_path}/ledger"
    secrets.update_ledger(docs, path, rules=secrets.BASE, known=False)
    first = spark.read.parquet(path).count()
    assert first == len({t for _, t in pairs(docs)})
    secrets.update_ledger(docs, path, rules=secrets.BASE)
    assert spark.read.parquet(path).count() == first  # nothing is unseen
    newer = (secrets.BASE[0], secrets.BASE[1], secrets.Rule("hex", "[0-9a-f]{25,}", version=2))
    secrets.update_ledger(docs, path, rules=newer)
    again = spark.read.parquet(path).where(F.array_contains("scanned", "hex:2"))
    assert again.count() == first
    assert {tuple(r["scanned"]) for r in again.select("scanned").collect()} == {("hex:2",)}
    expected = []
    for doc_id, text in pairs(docs):
        found = []
        for k, rule in enumerate(secrets.BASE):
            found += spans(text, rule.pattern, rule.group, rule.least, k)
        expected.append((doc_id, sorted(found)))
    got = secrets.findings(docs, path, secrets.BASE).select("doc_id", "__spans").collect()
    assert sorted(((r[0], [tuple(s) for s in r[1]]) for r in got), key=repr) == sorted(expected, key=repr)
    assert any(s for _, s in expected)
    clean = secrets.redact(docs, path, secrets.BASE)
    assert clean.columns == docs.columns
    for r in clean.where("text LIKE '%SECRET%'").collect():
        assert "Abc/123456" not in r["text"] and "AKIA" not in r["text"] and r["n_chars"] == len(r["text"])
    empty = f"file://{tmp_path}/empty"
    secrets.update_ledger(no_docs, empty, known=False)
    assert secrets.findings(no_docs, empty).count() == 0


def test_base_rules(docs, no_docs):
    expected = []
    for doc_id, text in pairs(docs):
        w = re.findall(WORD, text)
        often = Counter(zip(w, w[1:], w[2:], strict=False))
        covered = {i + k for i in range(len(w) - 2) if often[tuple(w[i : i + 3])] > 1 for k in range(3)}
        seen, again = set(), 0
        for line in text.split("\n"):
            if re.search(WORD, line):
                again += line in seen
                seen.add(line)
        symbols = len(re.findall(r"[#*$%&|<>]", text))
        failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
        expected.append((doc_id, len(w), sum(map(len, w)), symbols, again, len(covered), failed))
    judged = perplexity.judge(docs).cache()
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    assert rows_of(judged, *names) == sorted(expected, key=repr)
    assert judged.where("base_failed AND kept").count() == 0
    assert perplexity.judge(no_docs).count() == 0


def test_marks_once_for_all_copies(spark):
    """Spans of a text with many copies do not grow with the copies."""
    draw = random.Random(8)
    text = "".join(draw.choices("abcdefgh ", k=3000))
    counts = []
    for copies in (3, 30):
        docs = spark.createDataFrame([(k, text) for k in range(copies)], "doc_id bigint, text string")
        found = columns.marks(columns.keyed(docs).select("t", "u", "text")).collect()
        assert len(found) == len(set(found))
        counts.append(len(found))
    assert counts[0] == counts[1]


def plain_kneser_ney(clean, order):
    """Probability of the last byte of any n-gram after the rest, by plain recursion over counts."""
    counts = {order: Counter(clean)}
    for k in range(order - 1, 0, -1):
        counts[k] = Counter(gram[1:] for gram in counts[k + 1])
    cuts = {}
    for k, of in counts.items():
        n = [sum(v == j for v in of.values()) for j in (1, 2, 3, 4)]
        if min(n[:3]) == 0:
            cuts[k] = [0.5] * 3
        else:
            y = n[0] / (n[0] + 2 * n[1])
            cuts[k] = [max(0.05, min(j - 0.05, j - (j + 1) * y * n[j] / n[j - 1])) for j in (1, 2, 3)]
    contexts = {k: {} for k in counts}
    for k, of in counts.items():
        for gram, n in of.items():
            own = contexts[k].setdefault(gram[:-1], [0, 0.0])
            own[0] += n
            own[1] += cuts[k][min(n, 3) - 1]

    def probability(gram):
        if not gram:
            return 1 / 256
        k, lower = len(gram), probability(gram[1:])
        if gram[:-1] not in contexts[k]:
            return lower
        total, freed = contexts[k][gram[:-1]]
        n = counts[k][gram]
        return (n - cuts[k][min(n, 3) - 1] if n else 0) / total + freed / total * lower

    return probability


def test_perplexity_by_recursion(spark, no_docs):
    """Perplexities against plain recursion, sums of one, both paths of the model, and junk that goes."""
    import math
    import random

    draw = random.Random(3)
    parts = ["lo", "ra", "mi", "ten", "sul", "ka", "é", "nor"]

    def prose(n):
        return " ".join("".join(draw.choices(parts, k=draw.randint(1, 4))) for _ in range(n))

    rows = [(k, "xx" if k % 3 else None, prose(draw.randint(60, 90))) for k in range(60)]
    rows += [(100 + k, "xx", prose(70).replace(" ", "*** ")) for k in range(15)]
    rows += [(200, "xx", "la " * 40 + prose(41)), (201, "xx", None), (202, "other", prose(60).replace(" ", " | ")), (0, "xx", ""), (None, "xx", rows[1][2])]
    table = spark.createDataFrame(rows, "doc_id bigint, lang string, text string").withColumn("l", F.lit("clash"))
    found = {(r["doc_id"], r["lang"], r["n_words"]): r for r in perplexity.judge(table).collect()}
    joined = {(r["doc_id"], r["lang"], r["n_words"]): r for r in perplexity.judge(table, low=0.0, most=0).collect()}
    assert len(found) == len(rows)
    assert all(abs(r["perplexity"] - joined[k]["perplexity"]) < 1e-6 for k, r in found.items())
    # Without reach the lower band ends near the median and takes clean texts below it.
    below = [r for r in joined.values() if r["low"] is not None and not r["base_failed"] and r["perplexity"] < r["low"]]
    assert below and not any(r["kept"] for r in below)

    order = perplexity.ORDER
    for lang in ("xx", None, "other"):
        mine = [(i, (t or "").encode()) for i, of, t in rows if of == lang]
        ngrams = {}
        for i, data in mine:
            wide = b"\0" * (order - 1) + data + b"\0"
            ngrams[i, data] = [wide[k : k + order] for k in range(len(data) + 1)]
        clean = []
        for i, data in mine:
            w = re.findall(WORD, data.decode())
            often = Counter(zip(w, w[1:], w[2:], strict=False))
            covered = {k + j for k in range(len(w) - 2) if often[tuple(w[k : k + 3])] > 1 for j in range(3)}
            symbols = len(re.findall(r"[#*$%&|<>]", data.decode()))
            if len(w) >= 50 and 100 * len(covered) <= 50 * len(w) and 20 * symbols < len(w):
                clean += ngrams[i, data]
        probability = plain_kneser_ney(clean, order)
        for i, data in mine:
            expected = -sum(math.log(probability(g)) for g in ngrams[i, data]) / (len(data) + 1)
            row = found[i, lang, len(re.findall(WORD, data.decode()))]
            assert abs(row["perplexity"] - expected) < 1e-5
            if clean:
                assert abs(sum(probability(ngrams[i, data][-1][:-1] + bytes([x])) for x in range(256)) - 1) < 1e-9
    assert not any(r["kept"] for r in found.values() if r["doc_id"] is not None and r["doc_id"] >= 100 and r["lang"] == "xx")
    assert all(r["kept"] for r in found.values() if r["doc_id"] is not None and 0 < r["doc_id"] < 60)
    # No clean document, no band: the base rules decide.
    other = next(r for r in found.values() if r["lang"] == "other")
    assert other["low"] is None and other["kept"]


def test_subwords(docs, no_docs, texts):
    import sentencepiece

    inner = sentencepiece.SentencePieceProcessor(model_file=subword.model_path())
    plain = subword.Codec(subword.model_path(), 0.0, 1, 1)
    for text in texts:
        if text and "▁" not in text:
            assert list(struct.unpack(f"<{len(plain.encode([text])[0]) // 4}I", plain.encode([text])[0])) == inner.encode(text)
    found = subword.decode(subword.encode(docs, dropout=0.3)).collect()
    assert all(r["decoded"] == (r["text"] or "") for r in found)
    assert len(found) == docs.count()
    again = {(r["doc_id"], r["text"]): bytes(r["ids"]) for r in subword.encode(docs, dropout=0.3).collect()}
    assert all(again[r["doc_id"], r["text"]] == bytes(r["ids"]) for r in found)
    other = {(r["doc_id"], r["text"]): bytes(r["ids"]) for r in subword.encode(docs, dropout=0.3, seed=4).collect()}
    assert other != again
    assert subword.decode(subword.encode(no_docs)).count() == 0


def test_memory_of_words_is_bounded():
    """Few bytes of memory give the ids of much memory, and the bound holds."""
    texts = [" ".join(f"word{k * 7 % 100}x{k}" for k in range(j, j + 50)) for j in range(0, 400, 10)]
    small, large = (subword.Codec(subword.model_path(), 0.1, 17, memory) for memory in (1 << 15, 1 << 26))
    for text in texts:
        assert small.encode([text], [1]) == large.encode([text], [1])
        assert len(small.known.young) + len(small.known.old) < 2 * (1 << 15) // subword.ENTRY
    assert len(large.known.young) > 300


def test_occurrences_vary():
    """Each occurrence against the agenda alone; a frequent word has many segmentations, within a text and between ids."""
    import numpy as np

    codec = subword.Codec(subword.model_path(), 0.1, 17)
    text = " ".join(["international understanding"] * 1000)
    plain = subword.Codec(subword.model_path(), 0.0, 17)
    decoded, kinds = [], Counter()
    for doc_id in (1, 2, None):
        ids = codec.encode([text], [doc_id])[0]
        assert codec.decode(ids) == text
        assert ids == codec.encode(["other", text], [5, doc_id])[1]
        decoded.append(ids)
        rest = [codec.bytes_of[i].decode() for i in np.frombuffer(ids, np.uint32)]
        cut = "|".join(rest).replace("| ", "\n ").split("\n")  # pieces hold spaces at their beginning only
        kinds.update(x for x in cut if x.replace("|", "").strip() == "international")
    assert len(set(decoded)) == 3
    assert len(kinds) > 20
    # What is taken from memory equals the agenda of the occurrence.
    base = np.arange(1, 3001, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    words = [" international", " understanding", " a"] * 1000
    free, merges = codec.agenda(words)
    drawn, _ = codec.agenda(words, base)
    assert free[:3] == [plain.encode([w[1:]])[0] for w in words[:3]]
    for k in range(3000):
        if not codec.skipped(base[k], np.frombuffer(merges[k], np.uint64)).any():
            assert drawn[k] == free[k]
    assert 0.1 < np.mean([a != b for a, b in zip(drawn, free, strict=True)]) < 0.8


def test_line_classifier(spark, no_docs):
    good, bad = "The quiet river ran by the old mill.\nNobody came. ", "BUY!! NOW### *** $$$\n|x|x|x|x| "
    rows = [(i, (bad if i % 2 else good) * (1 + i % 5)) for i in range(60)] + [(None, good), (100, None), (101, "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("score", F.lit("clash"))
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(60)] + [(0, 1), (None, 1), (5, None)], "doc_id bigint, quality int")
    found = line_crf.score(docs, line_crf.fit(docs, labels)).collect()
    assert len(found) == len(rows)
    for r in found:
        assert 0 <= r["score"] <= 1
        if r["doc_id"] is not None and r["doc_id"] < 60:
            assert r["predicted"] == 1 - r["doc_id"] % 2
    assert line_crf.score(no_docs, line_crf.fit(no_docs, labels)).count() == 0


def test_forward_backward():
    import itertools

    import numpy as np

    scores, moves = np.array([0.3, -1.0, 0.7, 2.0]), np.array([[0.5, -0.2], [-0.4, 0.9]])
    lines = np.array([3, 1])
    got, pairs_seen, log_z = line_crf.Chains(lines).marginals(scores, moves)
    weight, good = 0.0, np.zeros(3)
    for path in itertools.product((0, 1), repeat=3):
        value = np.exp(sum(scores[k] * y for k, y in enumerate(path)) + sum(moves[a, b] for a, b in zip(path, path[1:], strict=False)))
        weight += value
        good += value * np.array(path)
    assert np.allclose(got[:3], good / weight)
    assert np.isclose(log_z, np.log(weight) + np.log(1 + np.exp(2.0)))
    assert np.isclose(pairs_seen.sum(), 2)


def test_perplexity_by_slices(spark, docs, no_docs):
    """A large model goes in slices: what is shuffled is a row for each text and pass, whatever the length of the text."""
    table = docs.select("doc_id", "lang", "text")
    names = ["doc_id", "lang", "n_words", "kept", "base_failed", "low", "high"]
    whole = perplexity.judge(table)
    counted = perplexity.count(table)
    total = counted.count()
    sliced = perplexity.judge(table, most=0, rows=total // 5 + 1)
    assert rows_of(sliced, *names) == rows_of(whole, *names)
    found = [sorted((repr(r["doc_id"]), r["n_words"], r["perplexity"]) for r in x.collect()) for x in (whole, sliced)]
    assert all(a[:2] == b[:2] and abs(a[2] - b[2]) < 1e-6 for a, b in zip(*found, strict=True))
    sums = perplexity.slice_sums(table, perplexity.log_probabilities(counted), total // 5 + 1)
    texts = table.count()
    assert total > 50 * texts and sums.count() == 2 * texts
    # Every n-gram of a text is in one of the five slices.
    assert sums.groupBy("l", "digest").agg(F.sum("known").alias("known"), F.sum("n").alias("n")).where("known != n").isEmpty()
    assert perplexity.judge(no_docs, most=-1, rows=1).count() == 0


def test_ledger_in_place(spark, docs):
    """Texts that are expected to differ are scanned without a shuffle; copies among them change no finding."""
    from evalspark.scaling import shared_folder

    table = docs.select("doc_id", "text")
    tracker, found, stages = spark.sparkContext.statusTracker(), [], []
    for copies in (True, False):
        path = shared_folder(spark, "ledger")
        group = f"ledger-{copies}"
        spark.sparkContext.setJobGroup(group, group)
        secrets.update_ledger(table, path, known=False, copies=copies)
        stages.append(sum(len(tracker.getJobInfo(job).stageIds) for job in tracker.getJobIdsForGroup(group)))
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        found.append((rows_of(secrets.findings(table, path), "doc_id", "text", "__spans"), rows_of(secrets.redact(table, path), "doc_id", "text")))
    assert found[0] == found[1]
    assert any(spans for _, _, spans in found[0][0])
    assert stages[0] > 1 and stages[1] == 1


def test_line_shares():
    """Shares of kinds of bytes in lines, in bins, against plain Python."""
    import numpy as np
    import pyarrow as pa

    cuts = [0.0, 0.02, 0.06, 0.15, 0.3, 0.5, 0.8]
    texts = ["Ab 1|#!\n\n.,;:? é\t$", "", None, "\n", "AB\ncd ", "###||| 12!! x.", "\x0b\x0c\r \nZ"]
    expected, owners = [], []
    for text in texts:
        lines = (text or "").encode().split(b"\n")
        owners.append(len(lines))
        for line in lines:
            chars = max(1, sum(c not in b" \t\x0b\x0c\r\n" for c in line))
            upper, lower = (sum(a <= c <= z for c in line) for a, z in ((65, 90), (97, 122)))
            counts = [sum(c in kind for c in line) / chars for kind in (b"#*$%&|<>", b"!", b"|", b".,;:?", b"0123456789")]
            expected.append([sum(x > cut for cut in cuts) for x in (upper / max(1, upper + lower), *counts)])
    bins, _, lines = line_crf.line_bins(pa.array(texts))
    assert lines.tolist() == owners
    assert np.array_equal(bins[:, :6], expected)
