import random

import pytest

# Columns whose names operators use for themselves.
CLASHES = {"n": 1, "s": "x", "key": "k", "_id": 5, "spans": "z", "at": 2, "row": 3, "label": 9, "found": "f", "score": 0.5}


def make_texts():
    """Texts with near copies, shared passages, long and empty ones."""
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 9))) for _ in range(300)]

    def prose(n):
        return " ".join(rng.choice(words) + rng.choice(["", ".", "\n", ","]) for _ in range(n))

    passage, short = prose(70), prose(25)
    base = [prose(n) for n in (3, 60, 150, 400, 900, 3000)]
    texts = [None, "", " ", "one", "two words", "\n\n\n", "aaaa" * 400, ("tick tock " * 200).strip()]
    texts += base + [base[3], base[3], base[3].upper(), base[2] + " extra", "extra " + base[2]]
    for _ in range(6):
        w = base[3].split(" ")
        w[rng.randrange(len(w))] = "changed"
        texts.append(" ".join(w))
    texts += [prose(80) + " " + passage + " " + prose(90) for _ in range(5)]
    texts += [short + " " + prose(40) for _ in range(4)] + [passage + " " + passage]
    texts += ["x \\### password = 'Abc/123456' token:zz AKIA" + "A1" * 9 + " " + "0af" * 9, "<|endoftext|> a  b \t c ▁ 🙂"]
    return texts


@pytest.fixture(scope="session")
def texts():
    return make_texts()


@pytest.fixture(scope="session")
def docs(spark, texts):
    """Documents with repeated rows, a null id and clashing columns."""
    rows = [(i, t, "en" if i % 3 else None, f"src{i}", len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[9], rows[9], (None, texts[11], "fr", None, None)]
    names = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    out = spark.createDataFrame(rows, names)
    from pyspark.sql import functions as F

    return out.withColumns({k: F.lit(v) for k, v in CLASHES.items()})


@pytest.fixture(scope="session")
def no_docs(docs):
    return docs.where("false")
