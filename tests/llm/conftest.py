import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, sequence_id string"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, columns whose names clash with results."""
    body = " ".join(f"w{i % 97}x{i}" for i in range(400))
    texts = {
        1: body, 2: body, 3: body + " tail", 4: None, 5: "", 6: " \n\t ", 7: "one two three", 8: "ONE two THREE", 9: "a " * 9000, 10: " ".join(f"u{i}" for i in range(60000)),
        11: "x ### *** | <a>\nx ### *** | <a>\nline", 12: "Ünïcode ß Σ 日本語 🎉 " * 30, 13: body[: len(body) // 2], 14: "don't <|endoftext|> it's 3.14", 15: " ".join(f"p{i}" for i in range(60)) + " " + body,
    }
    rows = [(d, t, None if d % 7 == 0 else "en" if d % 2 else "de", None if d % 5 == 0 else f"s{d % 3}", None if t is None else len(t), 5, "clash") for d, t in texts.items()]
    rows += [rows[0], (None, body, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def corpus():
    """Random texts with planted copies, near copies and passages; (doc_id, text)."""
    import random

    r = random.Random(5)
    vocabulary = ["".join(r.choice("abcdefghij") for _ in range(r.randint(1, 6))) for _ in range(3000)]
    words = lambda n: [r.choice(vocabulary) for _ in range(n)]
    docs = [words(r.randint(0, 260)) for _ in range(90)]
    base, passage = words(300), words(70)
    docs += [list(base) for _ in range(5)]
    for _ in range(25):
        copy = list(base)
        for _ in range(r.randint(1, 14)):
            copy[r.randrange(len(copy))] = r.choice(vocabulary)
        docs.append(copy)
    for _ in range(20):
        docs.append(words(r.randint(0, 80)) + passage + words(r.randint(0, 80)))
    docs += [["z"] * n for n in (3, 49, 50, 51, 200)] + [["z"] * 120]
    r.shuffle(docs)
    return [(i * 3 + 1, " ".join(d) if i % 4 else "\n ".join(d) + " ") for i, d in enumerate(docs)]


@pytest.fixture(scope="session")
def corpus_docs(spark, corpus):
    return spark.createDataFrame([(d, t, "en", f"s{d % 4}", len(t)) for d, t in corpus], "doc_id long, text string, lang string, source string, n_chars long").repartition(4).cache()
