import random
import re

import pytest

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def folded(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def corpus(seed=1, n=60):
    """Small documents with copies, near copies, shared passages and lines, odd texts, nulls, repeated rows."""
    rnd = random.Random(seed)
    vocabulary = ["".join(rnd.choice("abdeghilmnorstuéß") for _ in range(rnd.randint(1, 8))) for _ in range(400)]
    text = lambda k: " ".join(rnd.choice(vocabulary) for _ in range(k))
    passage, rows = text(70), []
    for i in range(n):
        kind = i % 6
        if kind == 0 and rows:
            t = rnd.choice(rows)[1]
        elif kind == 1 and rows:
            w = (rnd.choice(rows)[1] or "x").split(" ")
            w[rnd.randrange(len(w))] = "changed"
            t = " ".join(w)
        elif kind == 2:
            t = text(30) + "\n" + passage + "\n  The SAME Line \n" + text(20)
        else:
            t = text(rnd.randint(1, 200)) + "\nthe same line\n" + text(rnd.randint(0, 30))
        rows.append((i, t, rnd.choice(["en", "de", None]), rnd.choice(["a", "b", "B", None])))
    odd = [None, "", " \t\n\x0b\x0c\r ", "\n\n", "one", "İstanbul ÀB", "<|endoftext|> a", "日本語 テキスト", "a b c", "x " * 3, "!!! $$$", "A\r\nb\x85c", text(20_000), "q" * 50_000]
    rows += [(1000 + i, t, "en", "b") for i, t in enumerate(odd)]
    rows += [rows[3], rows[3]]
    return rows


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    from pyspark.sql import functions as F

    d = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    for c in ("_id", "key", "words", "n", "fp", "node", "label", "size", "_text"):  # columns whose names operators use inside
        d = d.withColumn(c, F.lit("clash"))
    return d.cache()


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)
