"""Leakage and membership on small planted cases."""

from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import leakage


def test_passages_are_found_inside_texts(spark):
    passage = "one two three four five six seven eight nine ten"
    asked = spark.createDataFrame([("a", passage.upper()), ("b", "Rare, word"), ("c", "..."), ("d", "four five six seven x")], "q_id string, text string")
    docs = spark.createDataFrame([(1, "so: " + passage.replace(" ", ",  ") + " and more\nlines"), (2, passage[:-3]), (3, "a rare word"), (4, "rare words"), (5, None)], "doc_id bigint, text string")
    got = leakage.contained_passages(asked, "q_id", docs, "doc_id").collect()
    assert sorted((r.q_id, r.doc_id) for r in got) == [("a", 1), ("b", 3)]


def test_near_join_of_two_tables_changes_the_decision(spark):
    words = [f"w{i}" for i in range(20)]
    asked = spark.createDataFrame([("a", " ".join(words)), ("b", "")], "q_id string, text string")
    docs = spark.createDataFrame([(k, " ".join(words[k:] + [f"z{i}" for i in range(k)])) for k in range(5)], "doc_id bigint, text string")
    terms = T.tokens(F.col("text"))
    near = leakage.near_sets(asked, "q_id", terms, docs, "doc_id", terms, 0.8)
    assert sorted((r.left_id, r.right_id, r.similarity) for r in near.collect()) == [("a", 0, 1.0), ("a", 1, 0.9048), ("a", 2, 0.8182)]
    got = leakage.leakage_report(asked.limit(0), near, asked).first()
    assert (got.exact, got.near, got.decision) == (0, 3, "leakage_found")


def test_every_member_of_a_class_is_named(spark):
    words = "a b c d e f g h i j".split()
    docs = spark.createDataFrame([(7, "x y"), (3, "Y, x x"), (9, "y x"), (1, " ".join(words)), (2, " ".join(words[:9])), (4, " ".join(words[::-1])), (5, ""), (6, "alone")], "doc_id bigint, text string")
    terms = T.tokens(F.col("text"))
    got = leakage.set_members(docs, "doc_id", terms, leakage.similar_sets(docs, "doc_id", terms, 0.8)).collect()
    assert sorted(map(tuple, got)) == [(1, 1, 2, 1), (2, 2, 1, 1), (3, 3, 3, 0), (4, 1, 2, 1), (6, 6, 1, 0), (7, 3, 3, 0), (9, 3, 3, 0)]
