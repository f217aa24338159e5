"""Top-k search by parts against the rows that `retrieve.Index` makes."""

import random

import pytest
from pyspark.sql import functions as F

from lodestone.operators import fuse, packed, retrieve
from lodestone.plans import catalog
from lodestone.plans import sql as S
from lodestone.plans.retrieval import Setting
from tests import oracle


def _tables(spark, n=300):
    rnd = random.Random(7)
    words = [f"w{i}" for i in range(40)]
    docs = [(f"d{i}", None if i % 50 == 0 else " ".join(rnd.choices(words, k=rnd.randint(0, 30)))) for i in range(n)]
    docs += [(f"x{i}", docs[i][1]) for i in range(60)]  # copies tie
    asked = [(f"q{i}", " ".join(rnd.choices(words + ["absent"], k=rnd.randint(1, 9)))) for i in range(30)] + [("none", "nowhere")]
    return spark.createDataFrame(docs, "doc_id string, text string").repartition(5), retrieve.query_terms(spark.createDataFrame(asked, "q_id string, text string"))


def _same(own, full):
    mine, theirs = ({(r["q_id"], r["rank"]): (r["doc_id"], r["score"]) for r in x.collect()} for x in (own, full))
    assert mine and mine.keys() == theirs.keys()
    assert all(mine[k][0] == theirs[k][0] and mine[k][1] == pytest.approx(theirs[k][1], abs=1e-9) for k in mine)


@pytest.mark.parametrize("k", [1, 7, 1000])
def test_top_k_is_that_of_all_scores(spark, monkeypatch, k):
    monkeypatch.setattr(packed, "BLOCK", 8)  # several blocks of queries, and of postings
    monkeypatch.setattr(packed, "POSTINGS", 50)
    docs, terms = _tables(spark)
    text = F.col("text")
    own = retrieve.packed_units(docs, text, terms)
    _same(retrieve.packed_top(own, k, None, b=0.95), retrieve.ranked(retrieve.bm25(docs, terms, b=0.95, text=text), k))


def test_best_sections_of_a_document_that_spans_batches(spark):
    docs, terms = _tables(spark)
    sections = docs.select((F.xxhash64("doc_id") % 9).cast("string").alias("doc_id"), F.col("doc_id").alias("section_id"), "text", F.lit("w1").alias("title"))
    own = retrieve.packed_units(sections, retrieve.section_text(), terms, ("doc_id", "section_id"))
    _same(retrieve.packed_top(own, 3, None), retrieve.ranked(retrieve.max_rollup(retrieve.section_scores(sections, terms)), 3))


def test_a_document_twice_or_too_many_terms_take_the_full_ranking(spark, monkeypatch):
    docs, terms = _tables(spark)
    twice = docs.unionByName(docs.filter("doc_id = 'd3'"))
    assert retrieve.packed_units(twice, F.col("text"), terms) is None
    full = lambda: retrieve.bm25(twice, terms, text=F.col("text"))
    _same(retrieve.packed_top(None, 5, full), retrieve.ranked(full(), 5))
    monkeypatch.setattr(retrieve.Index, "COPIED", 2)
    assert retrieve.packed_units(docs, F.col("text"), terms) is None


def test_no_documents(spark):
    docs, terms = _tables(spark)
    none = docs.filter("false")
    assert retrieve.packed_top(retrieve.packed_units(none, F.col("text"), terms), 5, None).count() == 0


def _inputs(df):
    return [x for x in df.inputFiles() if "documents.parquet" in x]


def test_lists_are_searched_once_and_read_no_document_again(spark):
    s = Setting(spark, "/root/testdata/sf0.001")
    lists = s.channels()
    assert not _inputs(lists)
    assert s.bm25(200).filter("rank > 200").isEmpty() and not _inputs(s.bm25(200))


def test_shown_scores_and_their_sql_round_alike(spark):
    """Scores of nine digits that end in 500: DuckDB's own rounding gives 133.308485 and 64.931648."""
    scores, con = [133.3084855, 64.9316485, 140.3286545, 0.0000005, 12.0], oracle.duck("/root/testdata/sf0.001")
    mine = [r["s"] for r in spark.createDataFrame([(x,) for x in scores], "x double").select(F.round("x", 6).alias("s")).collect()]
    assert mine == [con.execute(f"SELECT {S.half_up('?::DOUBLE')}", [x]).fetchone()[0] for x in scores]
    assert S.half_up("score") in catalog.oracles()["field_weighted_bm25"]


def test_weighted_fields_are_added_in_the_order_of_terms(spark):
    """Equal documents have equal sums, whatever is shuffled: a task adds up a document's terms in their order."""
    s = Setting(spark, "/root/testdata/sf0.001")
    _same(s.weighted(10), retrieve.ranked(retrieve.bm25(s.docs, s.terms, text=retrieve.weighted_text()), 10))
    found = catalog.queries()["field_weighted_bm25"](spark, "/root/testdata/sf0.001")
    assert not _inputs(found)
    oracle.compare(spark, oracle.duck("/root/testdata/sf0.01"), catalog.queries()["field_weighted_bm25"], catalog.oracles()["field_weighted_bm25"], "/root/testdata/sf0.01")


def test_section_gate_ranks_no_more_sections_than_can_lift(spark):
    """Beyond the first ten a section changes nothing, so no row is made of it."""
    sf = "/root/testdata/sf0.001"
    got, s = catalog.queries()["section_signal_gate"](spark, sf), Setting(spark, sf)
    assert not _inputs(got)
    whole = fuse.section_shadow(s.bm25(50), s.section())
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, whole.collect()))


def _lines(spark):
    """Documents of up to 30 lines, many of them alike, one that holds a line 60 times, and copies."""
    rnd = random.Random(11)
    words = [f"w{i}" for i in range(30)]
    lines = [" ".join(rnd.choices(words, k=rnd.randint(1, 8))) for _ in range(150)]
    docs = [(f"d{i}", rnd.choices(lines, k=rnd.choice([1, 2, 5, 30]))) for i in range(120)] + [("many", [lines[0]] * 60 + lines[:9])]
    docs += [(f"x{i}", docs[i][1]) for i in range(30)]
    rows = [(d, f"s{j}", "w1" if d == "d3" else "", t) for d, ls in docs for j, t in enumerate(ls)]
    asked = [(f"q{i}", " ".join(rnd.choices(words, k=rnd.randint(1, 6)))) for i in range(25)] + [("q", lines[0]), ("none", "nowhere"), ("rare", "w7")]
    return spark.createDataFrame(rows, "doc_id string, section_id string, title string, text string").repartition(5), retrieve.query_terms(spark.createDataFrame(asked, "q_id string, text string"))


@pytest.mark.parametrize("deep", [(20, 40), (60,), (5000,)])
def test_two_best_sections_without_ranking_all(spark, monkeypatch, deep):
    """Places behind the first sections are counted; questions they don't decide are ranked whole."""
    monkeypatch.setattr(packed, "BLOCK", 8)
    monkeypatch.setattr(packed, "POSTINGS", 50)
    monkeypatch.setattr(retrieve, "SLICE", 10)
    sections, terms = _lines(spark)
    asked = []

    def full(q):
        asked.extend(r["q_id"] for r in q.collect())
        return retrieve.top_section_rrf(retrieve.section_scores(sections, terms)).join(q, "q_id", "left_semi")

    own = retrieve.packed_units(sections.withColumn("doc_id", retrieve.unit_id()), retrieve.section_text(), terms)
    counted = []
    monkeypatch.setattr(packed.Packed, "places", lambda self, wanted, *a, f=packed.Packed.places: counted.extend(wanted) or f(self, wanted, *a))
    _same(retrieve.top_section_rrf_best(own, 10, full, deep=deep), retrieve.ranked(retrieve.top_section_rrf(retrieve.section_scores(sections, terms)), 10))
    assert counted or deep != (60,)
    assert deep != (5000,) or not asked


def test_section_rrf_makes_no_row_of_every_section(spark):
    assert not _inputs(catalog.queries()["section_topn_rrf"](spark, "/root/testdata/sf0.001"))
