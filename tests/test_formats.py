"""File formats and small row operators, on planted rows."""

import json

import pytest
from pyspark.sql import functions as F

from lodestone.operators import compare, fuse, leakage
from lodestone.sources import files


def test_evaluation_samples(spark, tmp_path):
    p = tmp_path / "e.json"
    row = {"id": "1", "question": "q", "answer": "a", "is_impossible": False, "contexts": [{"filename": "f", "text": "t"}]}
    p.write_text(json.dumps([row, {k: v for k, v in row.items() if k != "contexts"} | {"id": "2"}]))
    got = {r.id: r.contexts for r in files.evaluation_samples(spark, str(p)).collect()}
    assert got["1"][0].filename == "f" and got["2"] == []
    p.write_text(json.dumps([{k: v for k, v in row.items() if k != "question"}]))
    with pytest.raises(Exception, match="missing: question"):
        files.evaluation_samples(spark, str(p)).collect()


@pytest.mark.parametrize(("lines", "exact", "why"), [("[1]", False, "not a JSON object"), ("{", False, "not a JSON object"), ('{"a": 1, "b": "x"}\n\n{"a": 2, "b": "y"}', True, "blank line"), ('{"a": 1}', True, "fields are not exact"), ('{"a": 1, "b": "x", "c": 2}', True, "fields are not exact")])
def test_bad_lines_stop_the_query(spark, tmp_path, lines, exact, why):
    p = tmp_path / "r.jsonl"
    p.write_text(lines)
    with pytest.raises(Exception, match=why):
        files.json_lines(spark, str(p), "a int, b string", exact).collect()


def test_json_lines_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([(1, "x"), (2, None), (3, "ü\n")], "a int, b string")
    files.write_json_lines(rows, str(tmp_path / "r"))
    got = files.json_lines(spark, str(tmp_path / "r"), "a int, b string", exact=True)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, rows.collect()))
    (tmp_path / "blank.jsonl").write_text('{"a": 1}\n\n  \n{"b": "y"}\n')
    assert {tuple(r) for r in files.json_lines(spark, str(tmp_path / "blank.jsonl"), "a int, b string").collect()} == {(1, None), (None, "y")}


def test_contract_rows(spark, tmp_path):
    p = tmp_path / "c.csv"
    p.write_text('Split,QuestionId,AnswerId,QuestionText,ProcessedAnswerText,Url,Tags\ntrain,1,1," How ""so""?\nNow",a,u,\ntrain,2,, ,a,u,t\ntrain,3,3,???,a,u,t\n')
    rows, rejects = files.contract_rows(spark, str(p))
    (r,) = rows.collect()
    assert (r.QuestionId, r.QuestionText, r.norm, r.Tags) == ("1", 'How "so"?\nNow', "how so now", "")
    assert {x.reason: x.n for x in rejects.collect()} == {"missing_AnswerId": 1, "missing_QuestionText": 1, "empty_normalized_question": 1}


def test_questions_round_trip(spark, tmp_path):
    rows = [("s", "v", "train", None, "o", "i1", "q1", "t", "x", True, "a", "d", ["d"], (3, 9)), ("s", "v", "dev", None, "o", "i2", "q2", None, "y", False, "a", None, None, None)]
    files.write_questions(spark.createDataFrame(rows, files.SPLIT), str(tmp_path / "w"))
    (a,) = files.questions(spark, str(tmp_path / "w" / "split=train"), array=False).collect()
    (b,) = files.questions(spark, str(tmp_path / "w" / "split=dev"), array=False).collect()
    assert (a.q_id, a.answer, a.answer_doc_id, a.doc_ids, a.start_offset, a.end_offset, a.answerable) == ("i1", "a", "d", ["d"], 3, 9, True)
    assert (b.q_id, b.title, b.answer, b.answer_doc_id, b.doc_ids, b.start_offset, b.answerable) == ("i2", "", "", None, [], None, False)


def test_exact_precheck(spark):
    out = spark.createDataFrame([(1, "Same!"), (2, "same"), (3, "other"), (4, ""), (5, None)], "id int, text string")
    dev = spark.createDataFrame([("train", "a", "SAME"), ("dev", "a", "same "), ("dev", "b", "?")], "split string, q string, text string")
    assert tuple(leakage.exact_precheck(out, dev, "id", "q", "split").first()) == (3, 4, 2, False)
    assert tuple(leakage.exact_precheck(out.limit(0), dev, "id", "q", "split").first()) == (3, 0, 0, True)


def test_first_and_last_row_of_a_key(spark):
    d = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), (None, 3, "z")], "doc_id string, at int, v string")
    assert {(r.doc_id, r.v) for r in fuse.one_per_key(d, ["doc_id"], [F.col("at")]).collect()} == {("a", "x"), (None, "z")}
    assert {(r.doc_id, r.v) for r in fuse.one_per_key(d, ["doc_id"], [F.col("at").desc()]).collect()} == {("a", "y"), (None, "z")}


def test_locality(spark):
    far = "word " * 100
    rows = [
        (None, 0, 1, 10, 0.5, "gold_document_missing"), (far, None, None, 10, 0.5, "section_not_identified"), (far, 0, 1, None, 0.5, "section_not_identified"), (far, 0, 1, 221, 0.1, "long_section_low_local_anchor"),
        (far, 0, 1, 220, 0.15, "boundary_early_low_local_anchor"), (far, 0, 1, 220, 0.85, "boundary_late_low_local_anchor"), (far, 0, 1, 220, 0.5, "low_local_anchor"), (far + "disk", 284, None, 220, 0.5, "local_anchor_present"), (far + "disk", 283, None, 220, 0.5, "low_local_anchor"),
    ]
    d = spark.createDataFrame(rows, "text string, s int, e int, n int, p double, want string")
    got = d.withColumn("got", compare.locality_bucket(F.array(F.lit("disk")), F.col("text"), F.col("s"), F.col("e"), F.col("n"), F.col("p")))
    assert [r.got for r in got.collect()] == [r[-1] for r in rows]
