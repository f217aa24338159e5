"""Operators on small inputs with known results."""

import json
import random

import pytest
from pyspark.sql import functions as F

from lodestone.functions import metrics as M
from lodestone.functions import text as T
from lodestone.operators import actions, answer, evaluate, evidence, fuse, leakage, retrieve, threads
from lodestone.sources import files


def one(spark, column, text="x"):
    return spark.range(1).select(column.alias(text)).first()[0]


def words(spark, text, f):
    return one(spark, f(F.lit(text)))


def test_tokens(spark):
    got = words(spark, "WebSphere MQ 7.0.1.5 supports C++ and app-scan_source.", T.tokens)
    assert {"websphere", "mq", "7.0.1.5", "c++", "app-scan_source"} <= set(got)
    assert one(spark, T.tokens(F.lit(None).cast("string"))) == []


def test_sentences_and_sections(spark):
    assert words(spark, "One. Two!\n\nThree four?  Five", T.sentences) == ["One.", "Two!", "Three four?", "Five"]
    got = words(spark, "Intro text. Cause: bad disk. Resolving the problem: swap it.", T.sections)
    assert [(s.heading, s.body) for s in got] == [("", "Intro text."), ("Cause", ": bad disk."), ("Resolving the problem", ": swap it.")]


def test_signals(spark):
    assert words(spark, "The solution: upgrade.", T.answer_bonus) == 25.0
    assert words(spark, "The solution: upgrade.", T.answer_multiplier) == pytest.approx(2.75)
    assert words(spark, "Symptom: null pointer exception", T.problem_penalty) == pytest.approx(0.12 * 0.25 * 0.6)
    assert words(spark, "x" * 600, T.noise_penalty) == pytest.approx(0.72 * 0.55)
    wanted = F.array(F.lit("cve-2020-1234"))
    assert one(spark, T.cve_bonus(F.lit("CVE-2020-1234 and CVE-2020-9999"), wanted)) == 46.0
    assert one(spark, T.cve_multiplier(F.lit("CVE-2020-1234 and CVE-2020-9999"), wanted)) == pytest.approx(1.35 * 0.85)
    assert one(spark, T.cve_bonus(F.lit("CVE-2021-1111"), wanted)) == -45.0


def test_routes(spark):
    r = lambda t, q: one(spark, T.route(F.lit(t), F.lit(q)))
    assert r("a", "which versions of cvss") == "security_bulletin_affected_product"
    assert r("how to x", "how to x") == "how_to_or_lookup"
    assert r("a", "a javacore appears") == "error_or_log"
    assert one(spark, T.subtype(F.lit("Why is it"), F.lit(""))) == "failure_or_behavior"


def test_metrics(spark):
    f1 = lambda a, b: one(spark, M.token_f1(T.tokens(F.lit(a)), T.tokens(F.lit(b))))
    assert f1("a a b", "a b b") == pytest.approx(2 / 3)
    assert f1("", "a") == 0 and f1("c", "a") == 0
    empty = F.array().cast("array<string>")
    assert one(spark, M.jaccard(empty, empty)) == 1.0
    assert one(spark, M.score_ratio(F.lit(1.0), F.lit(0.0))) == float("inf")
    assert one(spark, M.unit_vector(F.array(F.lit(0.0), F.lit(0.0)))) == [0.0, 0.0]


DOCS = [
    ("doc-a", "Restart service A", "Use the control panel to restart service A after an upgrade."),
    ("doc-b", "Service upgrade notes", "Check service logs after upgrade before calling support."),
    ("doc-c", "Password policy", "Rotate administrator passwords every 90 days."),
]


def test_bm25_order(spark):
    docs = spark.createDataFrame(DOCS, "doc_id string, title string, text string")
    asked = spark.createDataFrame([("q", "service A stopped after upgrade")], "q_id string, title string")
    got = retrieve.ranked(retrieve.bm25(docs, retrieve.query_terms(asked, "title")), 2).orderBy("rank").collect()
    assert [r.doc_id for r in got] == ["doc-a", "doc-b"] and got[0].score > got[1].score
    empty = retrieve.ranked(retrieve.bm25(docs.limit(0), retrieve.query_terms(asked, "title")))
    assert empty.count() == 0


def test_rrf(spark):
    lists = spark.createDataFrame([("s", "q", "a", 1), ("s", "q", "b", 2), ("d", "q", "b", 1), ("d", "q", "c", 2)], "channel string, q_id string, doc_id string, rank int")
    assert [r.doc_id for r in retrieve.ranked(fuse.rrf(lists)).orderBy("rank").collect()] == ["b", "a", "c"]
    assert [r.doc_id for r in fuse.interleave(lists, ["s", "d"]).orderBy("rank").collect()] == ["a", "b", "c"]


@pytest.mark.parametrize("k", [1, 10, 50, 150, 400])
def test_top_k_with_ties_is_a_full_sort(spark, k):
    rnd = random.Random(142)
    rows = [("q", f"d{i:03d}", float(rnd.randint(-5, 5))) for i in range(200)]
    got = retrieve.ranked(spark.createDataFrame(rows, "q_id string, doc_id string, score double"), k).orderBy("rank").collect()
    assert [r.doc_id for r in got] == [d for _, d, _ in sorted(rows, key=lambda r: (-r[2], r[1]))][:k]


def test_top_k_plan_has_a_group_limit(spark):
    df = retrieve.ranked(spark.createDataFrame([("q", "d", 1.0)], "q_id string, doc_id string, score double"), 3)
    assert "WindowGroupLimit" in df._jdf.queryExecution().toString()


def test_gate_and_pools(spark):
    base = spark.createDataFrame([("q", f"d{i:02d}", 20.0 - i, i) for i in range(1, 16)], "q_id string, doc_id string, score double, rank int")
    challenger = spark.createDataFrame([("q", "d12", 30.0, 1)], "q_id string, doc_id string, score double, rank int")
    lengths = spark.createDataFrame([("d12", 0.5)], "doc_id string, ratio double")
    got = fuse.gate_rank10(base, challenger, lengths, margin_max=5.0).orderBy("rank").collect()
    assert [r.doc_id for r in got][8:11] == ["d09", "d12", "d10"] and got[9].lifted
    pool = fuse.prefix_pool(base, base.select("q_id", F.concat(F.lit("x"), "doc_id").alias("doc_id"), "rank"), 3, 5).orderBy("rank").collect()
    assert [r.doc_id for r in pool] == ["d01", "d02", "d03", "xd01", "xd02"]


def test_evidence_and_answers(spark):
    docs = spark.createDataFrame([("d1", "t", "The adapter fails at boot time. The solution is to update the adapter firmware now."), ("d2", "t", "Nothing here is related to that.")], "doc_id string, title string, text string")
    asked = spark.createDataFrame([("q", "adapter firmware solution"), ("r", "zebra")], "q_id string, text string")
    results = spark.createDataFrame([("q", "d1", 1), ("q", "d2", 2), ("r", "d2", 1)], "q_id string, doc_id string, rank int")
    rows = evidence.with_terms(evidence.sentence_rows(results, docs), asked)
    best = evidence.answer_aware_ranked(rows).filter("place = 1").first()
    assert best.sentence.startswith("The solution")
    a = {r.q_id: r for r in answer.verified(answer.composed(evidence.bm25_ranked(rows), asked), results).collect()}
    assert a["q"].answer.endswith("[d1]") and not a["q"].refused
    assert a["r"].refused and a["r"].answer == answer.REFUSAL and a["r"].reasons == ["already_refused"]
    spans = evidence.window_rows(results, docs)
    assert spans.filter("q_id = 'q' and doc_id = 'd1'").count() >= 2
    w = evidence.local_windows(evidence.bm25_ranked(rows).filter("place = 1"), docs, asked).first()
    assert "adapter" in w.window


def test_retrieval_metrics(spark):
    asked = spark.createDataFrame([("1",), ("2",), ("3",)], "q_id string")
    gold = spark.createDataFrame([("1", "a"), ("2", "b")], "q_id string, gold string")
    results = spark.createDataFrame([("1", "a", 1), ("2", "b", 2), ("3", "c", 1)], "q_id string, doc_id string, rank int")
    m = evaluate.retrieval_metrics(evaluate.gold_ranks(asked, gold, results)).first()
    assert (m.questions, m.hit1, m.hit5, m.mrr, m.not_found) == (2, 0.5, 1.0, 0.75, 0)


def test_similar_sets_lose_no_pair(spark):
    rnd = random.Random(3)
    rows = [(i, " ".join(sorted({rnd.choice("abcdefghij") for _ in range(8)}))) for i in range(60)]
    got = {(r.left_id, r.right_id) for r in leakage.similar_sets(spark.createDataFrame(rows, "id int, text string"), "id", F.split("text", " "), 0.6).collect()}
    first = {}
    for i, t in rows:
        first.setdefault(t, i)
    reps = [(i, set(t.split())) for t, i in first.items()]
    want = {(min(i, j), max(i, j)) for i, a in reps for j, b in reps if i != j and len(a & b) / len(a | b) >= 0.6}
    assert got == want


def test_ledger_rejects_and_goes_on(spark):
    rows = spark.createDataFrame([(1, 1, 900), (1, 2, 1500), (1, 3, 1000), (1, 4, 100), (1, 5, 1)], "thread int, seq int, bytes bigint")
    r = threads.ledger(rows, 3, 2000).first()
    assert (r.offered, r.kept, r.bytes) == (5, 3, 2000)


def test_actions(spark):
    c = spark.createDataFrame([("q", i, d) for i, d in ((1, "a"), (2, "a"), (3, "b"), (4, "c"))], "q_id string, place int, doc_id string")
    got = {r.idx: r.family for r in actions.enumerate_actions(c).collect()}
    assert got["0,1,2"] == "baseline" and got["1,2"] == "delete_slot_1" and got["3,1,2"] == "replace_slot_1" and got["0,2,3"] == "document_coverage" and got["0"] == "keep_prefix_1"
    assert one(spark, actions.outcome(F.lit(0), F.lit(-0.5))) == "citation_preserved_f1_loss"


def test_json_sources(spark, tmp_path):
    q = tmp_path / "q.json"
    row = {"QUESTION_ID": "1", "QUESTION_TITLE": "t", "QUESTION_TEXT": "x", "DOCUMENT": "d", "ANSWER": "a", "START_OFFSET": "10", "END_OFFSET": "55", "ANSWERABLE": "Y", "DOC_IDS": ["d"]}
    q.write_text(json.dumps([row, row | {"QUESTION_ID": "2", "ANSWERABLE": "N", "START_OFFSET": "-", "END_OFFSET": "", "DOCUMENT": "", "DOC_IDS": ["missing-doc"]}]))
    got = {r.q_id: r for r in files.questions(spark, str(q)).collect()}
    assert got["1"].start_offset == 10 and got["2"].start_offset is None and got["2"].answer_doc_id is None and not got["2"].answerable
    q.write_text(json.dumps([row | {"ANSWERABLE": "maybe"}]))
    with pytest.raises(Exception, match="neither Y nor N"):
        files.questions(spark, str(q)).collect()
    c = tmp_path / "c.json"
    c.write_text(json.dumps({"k1": {"id": "", "title": "T", "text": "body", "sections": [{"id": "s", "text": "sec", "start": "0", "end": "-"}]}, "k2": {"id": "d2", "title": "U", "text": "b", "sections": []}}))
    docs = files.corpus(spark, str(c))
    assert {r.doc_id for r in docs.collect()} == {"k1", "d2"}
    s = files.sections(docs).collect()
    assert len(s) == 1 and s[0].start_offset == 0 and s[0].end_offset is None


def test_repeated_sample_ids_fail(spark, tmp_path):
    p = tmp_path / "s.jsonl"
    row = {"split_name": "s", "assigned_split": "train", "sample_id": "1", "question_id": "1", "question_text": "x", "answerable": True}
    p.write_text("\n".join([json.dumps(row), "", json.dumps(row)]))
    with pytest.raises(Exception, match="repeated sample_id"):
        files.split_samples(spark, str(p)).collect()
    p.write_text(json.dumps({k: v for k, v in row.items() if k != "question_text"}))
    with pytest.raises(Exception, match="missing: question_text"):
        files.split_samples(spark, str(p)).collect()


def test_csv_zip_and_fingerprint(spark, tmp_path):
    import hashlib
    import zipfile

    (tmp_path / "a.csv").write_text("id,x\n1,a\n1,\n2,b,c\n")
    r = files.csv_profile(spark, str(tmp_path / "a.csv"), ["id", "x"], "id").first()
    assert (r.n, r.malformed, r.missing_x, r.repeated) == (3, 1, 1, 1)
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("d/one.txt", "1")
        z.writestr("two.txt", "2")
    assert {x.name for x in files.zip_names(spark, str(tmp_path / "z.zip")).collect()} == {"one.txt", "two.txt"}
    f = files.fingerprints(spark, str(tmp_path / "a.csv")).first()
    assert f.sha256 == hashlib.sha256((tmp_path / "a.csv").read_bytes()).hexdigest()


def test_embedding_cache_is_read_through(spark, tmp_path):
    docs = spark.createDataFrame([("a",), ("b",)], "doc_id string")
    calls = []

    def encode(d):
        calls.append(1)
        return d.select("doc_id", F.array(F.lit(1.0)).alias("embedding"))

    path = str(tmp_path / "cache")
    for _ in range(2):
        assert files.cached_embeddings(spark, path, docs, encode).count() == 2
    assert len(calls) == 1


def test_gold_section_is_the_first_that_holds_the_offset(spark):
    s = spark.createDataFrame([("d", "s0", 0, 0, 10), ("d", "s1", 1, 10, 20)], "doc_id string, section_id string, pos int, start_offset int, end_offset int")
    g = spark.createDataFrame([("q", "d", 10), ("r", "d", 15), ("u", "d", 99)], "q_id string, doc_id string, at int")
    assert {r.q_id: r.section_id for r in files.gold_section(g, s).collect()} == {"q": "s0", "r": "s1"}


def test_stream_ledger(spark, tmp_path):
    from lodestone.streaming.ledger import ledger_stream

    schema = "thread bigint, seq bigint, input string, response string"
    src = tmp_path / "in"
    spark.createDataFrame([(1, 1, "a", "b"), (1, 2, "x" * 3000, ""), (1, 3, "c", "d"), (2, 2, "late", "start")], schema).coalesce(1).write.parquet(str(src))
    turns = spark.readStream.schema(schema).parquet(str(src))
    q = ledger_stream(turns).writeStream.outputMode("append").format("memory").queryName("ledger_out").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    got = {(r.thread, r.seq): (r.accepted, r.reason, r.kept) for r in spark.sql("select * from ledger_out").collect()}
    assert got == {(1, 1): (True, "", 1), (1, 2): (False, "byte_limit", 1), (1, 3): (True, "", 2), (2, 2): (False, "not_contiguous", 0)}


def test_matches_of_an_index_are_added_up_in_the_task_of_their_document(spark):
    from lodestone.operators import retrieve

    docs = spark.createDataFrame([(str(i), "t", "a a b" if i % 2 else "b c") for i in range(20)], "doc_id string, title string, text string")
    terms = spark.createDataFrame([("q", "a", 1), ("q", "b", 2), ("r", "c", 1)], "q_id string, term string, qtf long")

    def scored():
        index = retrieve.Index(docs, retrieve.document_text(), terms)
        plan = index.scores()._jdf.queryExecution().executedPlan().toString()
        return {(r.q_id, r.doc_id): r.score for r in index.scores().collect()}, plan

    got, plan = scored()
    assert "Exchange hashpartitioning(q_id" not in plan.split("BroadcastExchange")[0]  # no row of (query, document, term) is shuffled
    kept = retrieve.Index.COPIED
    try:
        retrieve.Index.COPIED = 2  # fewer than the query terms: the joined form
        assert scored()[0] == got and len(got) == 30
    finally:
        retrieve.Index.COPIED = kept


def test_best_cosines_by_cells_equal_all_pairs(spark):
    import random

    from lodestone.operators import retrieve

    rnd = random.Random(5)
    rows = [(str(i), [float(rnd.randint(-2, 2)) for _ in range(3)]) for i in range(60)] + [("n", None), ("m", [1.0, None, 2.0]), ("z", [0.0, 0.0, 0.0])]
    vectors = spark.createDataFrame(rows, "doc_id string, embedding array<double>")
    queries = vectors.filter("doc_id in ('7', '8', 'n', '30')").withColumnRenamed("doc_id", "q_id")
    wanted = retrieve.ranked(retrieve.cosine(vectors, queries).filter("q_id <> doc_id"), 9)
    got = retrieve.cosine_top(vectors, queries, 9, cell=7)
    listed = lambda df: sorted((r.q_id, r["rank"], r.doc_id, r.score) for r in df.collect() if r.score is not None)
    assert listed(got) == listed(wanted) and got.count() == wanted.count() == 36
    few = vectors.filter("doc_id in ('n', '7', '8')")
    assert [(r.doc_id, r.score is None) for r in retrieve.cosine_top(few, queries.filter("q_id = '7'"), 9).orderBy("rank").collect()] == [("8", False), ("n", True)]


def test_similar_sets_lose_no_pair_to_the_place_of_the_first_shared_term(spark):
    import random

    rnd = random.Random(9)
    sets = {i: {f"w{rnd.randint(0, 9)}" for _ in range(rnd.randint(6, 16))} for i in range(150)}
    rows = spark.createDataFrame([(i, " ".join(x)) for i, x in sets.items()], "id int, text string")
    classes = {}
    for i, x in sets.items():
        classes.setdefault(frozenset(x), i)
    ids = sorted(classes.items(), key=lambda c: c[1])
    wanted = {(i, j) for a, (x, i) in enumerate(ids) for y, j in ids[a + 1 :] if len(x & y) / len(x | y) >= 0.8}
    assert {(r.left_id, r.right_id) for r in leakage.similar_sets(rows, "id", F.split("text", " "), 0.8).collect()} == wanted and len(wanted) > 20
