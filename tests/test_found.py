"""Texts of retrieved documents alone are read, and gold by numbered tokens."""

import random
import re
import sys

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import packed, retrieve
from lodestone.plans import catalog, corpus, ranking
from lodestone.plans.evidence import Evidence
from lodestone.plans.retrieval import Setting
from lodestone.sources import tables


def _inputs(df):
    return [x for x in df.inputFiles() if "documents.parquet" in x]


def test_texts_are_read_of_retrieved_documents_alone(spark):
    e = Evidence(spark, "/root/testdata/sf0.001")
    assert not _inputs(e.rows()) and not _inputs(e.spans())
    s = Setting(spark, "/root/testdata/sf0.001")
    plan = ranking.context_rows(s)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LeftSemi") >= 2


def test_gold_is_that_of_the_joined_form(spark, monkeypatch):
    docs = [("d2", "a b c d e f g h i"), ("d10", "x a b c d e f g h"), ("d3", "a b c d"), ("d4", None), ("d5", "a b c d e f g"), ("d6", "h i j k l m n o p q r s t u v w")]
    docs = spark.createDataFrame(docs, "doc_id string, text string").coalesce(1)
    asked = spark.createDataFrame([("q1", "A b c d e f g h and more"), ("q2", "too short"), ("q3", "b c d e f g h i"), ("q4", "g h i j k l m n")], "q_id string, text string")
    own = sorted(map(tuple, tables.gold(docs, asked).collect()))
    assert own == [("q1", "d10"), ("q3", "d2")]  # q4's tokens follow each other only across d5 and d6
    monkeypatch.setattr(tables, "MOST_RUNS", 0)
    assert sorted(map(tuple, tables.gold(docs, asked).collect())) == own


def test_tokens_of_whole_texts_are_numbered_in_the_tasks(spark):
    """The same tokens as the built-in pattern, which the search and gold no longer run over whole texts."""
    texts = ["", None, "A-b C# c++ .net v1.2.3-rc a..b a.+b +-x #", "Kİ İx SÄtze ΣΣ été número_1", "x\x00y z w", "a" * 5000 + "." + "b+" * 300]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    rows = df.select(T.tokens(F.col("text")).alias("toks"), F.lower("text").alias("low")).orderBy("i").collect()
    words = sorted({t for r in rows for t in r["toks"]})
    n, sizes = T.token_numbers(words[1:])(pa.array([r["low"] for r in rows], pa.string()))
    assert sizes.tolist() == [len(r["toks"]) for r in rows]
    assert n.tolist() == [words.index(t) - 1 for r in rows for t in r["toks"]]
    plan = lambda x: x._jdf.queryExecution().executedPlan().toString()
    s = Setting(spark, "/root/testdata/sf0.001")
    of_units = plan(packed.numbered(s.docs, retrieve.document_text(), ["doc_id"], ["a"]))
    before_tasks = plan(tables.gold(s.docs, s.asked.limit(0))).split("MapInArrow")[-1]
    assert "regexp_extract_all" not in of_units and "regexp_extract_all" not in before_tasks.split("documents.parquet")[0]


def test_variety_reads_texts_once_and_counts_as_the_built_in_pattern(spark):
    rows = corpus.variety(spark, "/root/testdata/sf0.001")
    assert not _inputs(rows)
    t = T.tokens(F.col("text"))
    docs = tables.table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", F.round(F.when(F.size(t) > 0, F.size(F.array_distinct(t)) / F.size(t)).otherwise(0.0), 6).alias("p"))
    other = tables.table(spark, "/root/testdata/sf0.001", "labels").filter("quality is not null").join(docs, "doc_id").select("doc_id", "quality", "p")
    assert sorted(map(tuple, rows.collect())) == sorted(map(tuple, other.collect()))


@pytest.mark.parametrize("name, lists, gold", [("paired_arms", 1, 1), ("pipeline_waterfall", 3, 1), ("selector_comparison", 1, 1)])
def test_arms_search_once(spark, monkeypatch, name, lists, gold):
    """Both arms, and the stages before them, read the same lists and the same gold."""
    made = []
    monkeypatch.setattr(retrieve, "packed_top", lambda *a, f=retrieve.packed_top, **k: made.append("list") or f(*a, **k))
    monkeypatch.setattr(tables, "gold", lambda *a, f=tables.gold: made.append("gold") or f(*a))
    catalog.queries()[name](spark, "/root/testdata/sf0.001")
    assert (made.count("list"), made.count("gold")) == (lists, gold)


@pytest.mark.parametrize("piece", [1, 40, 1 << 20])
def test_texts_are_cut_by_pieces_and_not_one_by_one(monkeypatch, piece):
    """Tokens are those of the pattern wherever a piece or a text ends, and no call is made a text."""
    monkeypatch.setattr(T, "PIECE", piece)
    rnd = random.Random(3)
    texts = [None if i % 9 == 0 else "".join(rnd.choices("ab1_+#.-  é\n\x00", k=rnd.choice([0, 1, 2, 3, 9, 40]))) for i in range(400)]
    found = [re.findall(T.TOKEN, t or "") for t in texts]
    words = sorted({w for f in found for w in f})[::2]
    calls = []
    numbers, own = T.token_numbers(words), pa.array(["x.a", *texts, "b"], pa.string())[1:-1]
    sys.setprofile(lambda frame, event, arg: calls.append(event))
    try:
        n, sizes = numbers(own)
    finally:
        sys.setprofile(None)
    assert sizes.tolist() == [len(f) for f in found]
    assert n.tolist() == [words.index(w) if w in words else -1 for f in found for w in f]
    assert piece < 1 << 20 or len(calls) < len(texts)
