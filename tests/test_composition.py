"""Routing, composition, guards, swaps, splits and comparisons of runs against known results."""

from pyspark.sql import functions as F

from lodestone.functions import metrics as M
from lodestone.functions import text as T
from lodestone.operators import answer, compare, compose, evidence

ROWS = "q_id string, doc_id string, pos int, place int, rank int, score double, sentence string"


def one(df):
    return df.collect()[0]


def test_routes_read_title_and_text(spark):
    d = spark.createDataFrame([("CVE-2020-1 in product", "what now"), ("How to start", "it fails with exception"), ("How to start", "please"), ("", "upgrade fails"), ("a", "b")], "title string, text string")
    got = [r.route for r in d.select(T.route(F.col("title"), F.col("text")).alias("route")).collect()]
    assert got == ["security_bulletin_vulnerability_detail", "error_or_log", "how_to_or_lookup", "install_upgrade_config", "other"]


def test_route_trace(spark):
    routes = [("a", "security_bulletin_vulnerability_detail"), ("b", "limitation_or_restriction"), ("c", "other"), ("d", "install_upgrade_config")]
    from lodestone.plans.evidence import SPAN_ROUTES

    got = evidence.route_trace(spark.createDataFrame(routes, "q_id string, route string"), SPAN_ROUTES).orderBy("q_id").collect()
    assert [(r.windowed, r.routed, r.reranked) for r in got] == [("section_span", "section_span", "routed")] * 2 + [("answer_window", "answer_aware", "local_window"), ("answer_aware", "answer_aware", "routed")]


def decisions(spark, route, rows, **settings):
    ranked = spark.createDataFrame([("q", d, i, i + 1, r, float(s), x) for i, (d, r, s, x) in enumerate(rows)], ROWS)
    got = one(answer.route_composed(ranked, spark.createDataFrame([("q", route)], "q_id string, route string"), **settings))
    return got.decision, got.kept


def test_route_aware_composition(spark):
    strong = [("a", 1, 150, "Install the fix now"), ("b", 2, 120, "other words here"), ("c", 3, 10, "more")]
    assert decisions(spark, "install_upgrade_config", strong) == ("keep_top3_default", "1,2,3")  # ratio alone doesn't do
    assert decisions(spark, "install_upgrade_config", [strong[0], ("b", 2, 80, "other words")]) == ("top1_direct_strong_signal", "1")
    assert decisions(spark, "how_to_or_lookup", strong) == ("keep_top3_default", "1,2,3")
    assert decisions(spark, "how_to_or_lookup", strong, how_to=True) == ("top1_direct_strong_signal", "1")
    assert decisions(spark, "security_bulletin_remediation", strong) == ("keep_top3_citation_sensitive", "1,2,3")
    assert decisions(spark, "other", strong)[0] == "keep_top3_default"
    assert decisions(spark, "install_upgrade_config", [("a", 9, 150, "install it")]) == ("keep_top3_default", "1")
    same = [("a", 1, 50, "the same words"), ("a", 1, 40, "Words the same!"), ("b", 2, 30, "the same words")]
    assert decisions(spark, "other", same) == ("dedup_same_document", "1,3")


def test_window_gate(spark):
    pairs = [
        ("restart the server", "restart the server", False), ("restart the server", "Please restart the server. Then apply the fix.", True), ("restart the server", "Symptom restart the server", False),
        ("restart the server", "Question restart the server", False), ("restart the server", "nothing of it", False), ("restart the server", "Restart the server. One. Two. Three.", False), ("restart the server", "restart the server " + "word " * 100, False),
    ]
    d = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, sentence string, window string, want boolean")
    got = compare.window_gate(d).orderBy("i").collect()
    assert [r.replace for r in got] == [r.want for r in got]
    loose = compare.window_gate(d, block_problem_headings=False, block_noise_growth=False, max_sentences=9).orderBy("i").collect()
    assert loose[2].replace and loose[5].replace and not loose[3].replace


def test_document_cap_and_rank_coverage(spark):
    rows = [("q", "a", 0, 1, 1, 90.0, "x"), ("q", "a", 1, 2, 1, 80.0, "y"), ("q", "c", 0, 3, 3, 70.0, "z"), ("q", "b", 0, 4, 2, 10.0, "w")]
    d = spark.createDataFrame(rows, ROWS)
    of = lambda df: [(r.doc_id, r.pos) for r in df.orderBy("slot").collect()]
    assert of(compose.take_with_cap(d, ["q_id"], [F.col("place")], 3, 1)) == [("a", 0), ("c", 0), ("b", 0)]
    assert of(compose.take_with_cap(d, ["q_id"], [F.col("place")], 3, 2)) == [("a", 0), ("a", 1), ("c", 0)]
    assert of(compose.rank_coverage(d)) == [("a", 0), ("b", 0), ("c", 0)]
    got = compose.score_rank_policies(d, [("flat", 0.0, 1), ("steep", 4.0, 3)], 2)
    assert of(got.filter("policy = 'flat'")) == [("a", 0), ("c", 0)] and of(got.filter("policy = 'steep'")) == [("a", 0), ("a", 1)]


def guarded(spark, models, ranks=(1, 2, 3, 4), scores=(90, 80, 70, 65), **settings):
    rows = [("q", f"d{i}", i, i + 1, r, float(s), "x", float(m)) for i, (m, r, s) in enumerate(zip(models, ranks, scores))]
    got = one(compose.score_guarded(spark.createDataFrame(rows, ROWS + ", model double"), spark.createDataFrame([("q", "other")], "q_id string, route string"), **settings))
    return got.action[:4], got.reason, got.kept


def test_score_guards(spark):
    assert guarded(spark, (0.9, 0.1, 0.2)) == ("keep", "model_selected_top_candidate", "1,2,3")
    assert guarded(spark, (0.1, 0.2, 0.9)) == ("repl", "candidate_score_gte_60_accepted", "3,1,2")
    assert guarded(spark, (0.1, 0.2, 0.9), blocked=("other",))[1] == "route_blocked"
    assert guarded(spark, (0.1, 0.2, 0.9), max_place=2)[1] == "selected_rank_exceeds_limit"
    assert guarded(spark, (0.1, 0.2, 0.9), min_margin=0.9)[1] == "score_margin_below_min"
    assert guarded(spark, (0.1, 0.2, 0.9), scores=(90, 80, 59))[1] == "candidate_score_gte_60_blocked"
    assert guarded(spark, (0.1, 0.2, 0.3, 0.9))[1] == "selected_citation_rank_exceeds_limit"
    assert guarded(spark, (0.1, 0.2, 0.3, 0.9), ranks=(1, 2, 9, 3))[1] == "baseline_out_of_rank_document_dropped"
    assert guarded(spark, (0.1, 0.2, 0.3, 0.9), ranks=(1, 2, 9, 3), preserve=False)[2] == "4,1,2"
    assert guarded(spark, (0.1, 0.2, 0.3, 0.9), max_rank=None)[2] == "4,1,2"


def test_policy_search(spark):
    rows = [("q1", 1, 50.0, 0.1, 0.2), ("q1", 3, 20.0, 0.9, 0.8), ("q2", 1, 90.0, 0.1, 0.5), ("q2", 2, 20.0, 0.15, 0.1)]
    d = spark.createDataFrame(rows, "q_id string, place int, score double, model double, f1 double")
    got = {r.policy: (r.changed, r.total_f1, r.improved, r.regressed) for r in compose.policy_search(d, compose.policy_grid([2, 3], [0.0, 0.1], [None, 60.0])).collect()}
    assert len(got) == 8 and got["rank3_margin0.1_protect60.0"] == (1, 1.3, 1, 0) and got["rank2_margin0.0_protectNone"] == (1, 0.3, 0, 1) and got["rank2_margin0.1_protectNone"][0] == 0


def test_swaps_and_pool_contract(spark):
    ranked = spark.createDataFrame([("q", f"d{i}", i) for i in range(1, 16)], "q_id string, doc_id string, rank int")
    swaps = spark.createDataFrame([("q", "d4", "d12", 0.9), ("q", "d5", "d13", 0.1)], "q_id string, out_doc string, in_doc string, gain double")
    got = [(r.doc_id, r["rank"]) for r in compose.swap_materialised(ranked, swaps, 0.5).orderBy("rank").collect()]
    assert [x for x, _ in got] == ["d1", "d2", "d3", "d5", "d6", "d7", "d8", "d9", "d10", "d12"] and [r for _, r in got] == list(range(1, 11))
    bad = ranked.union(spark.createDataFrame([("r", "x", 0), ("r", "x", 500), ("r", "y", 500)], "q_id string, doc_id string, rank int"))
    assert tuple(one(compose.pool_contract(bad))) == (2, 1, 1, 1, 1) and tuple(one(compose.pool_contract(ranked))) == (1, 0, 0, 0, 0)


def test_splits(spark):
    groups = spark.createDataFrame([(f"g{i}", 1 + i % 4) for i in range(200)], "g string, n int")
    split = compose.ratio_split(groups, "g", "n", {"train": 0.7, "dev": 0.15, "test": 0.15})
    load = {r.split: r.n for r in split.join(groups, "g").groupBy("split").agg(F.sum("n").alias("n")).collect()}
    assert split.count() == 200 and abs(load["train"] / 500 - 0.7) < 0.02 and abs(load["dev"] - load["test"]) <= 8
    rows = spark.createDataFrame([("a", 1, "train"), ("a", 2, "test"), ("b", 3, "dev")], "g string, doc_id int, split string")
    held = spark.createDataFrame([(1,), (2,)], "doc_id int")
    got = {r.check: (r.observed, r.passed) for r in compose.split_checks(rows, "g", held).collect()}
    assert got == {"groups_do_not_cross_splits": (1, False), "held_documents_only_in_test": (1, False)}


def test_listwise_metrics_and_changed_answers(spark):
    got = one(compose.listwise_metrics(spark.createDataFrame([("m", "a", 1), ("m", "b", 3), ("m", "c", None), ("m", "d", 12)], "method string, q_id string, rank int")))
    assert (got.found, got.mrr, got.median_rank, got.conditional_recall_5, got.recall_5) == (3, round((1 + 1 / 3 + 1 / 12) / 3, 6), 3.0, 0.666667, 0.5)
    none = one(compose.listwise_metrics(spark.createDataFrame([("m", "a", None)], "method string, q_id string, rank int")))
    assert (none.found, none.mrr, none.conditional_recall_1, none.recall_1, none.ndcg) == (0, None, None, 0.0, 0.0)
    schema = "q_id int, answerable boolean, refused boolean, answer string, f1 double"
    base = spark.createDataFrame([(1, False, True, "r", 0.0), (2, True, False, "x", 0.5), (3, True, False, "x", 0.5), (4, True, False, "x", 0.5), (5, True, False, "s", 0.1)], schema)
    other = spark.createDataFrame([(1, False, False, "a", 0.0), (2, True, False, "y", 0.7), (3, True, False, "y", 0.1), (4, True, False, "y", 0.5), (5, True, False, "s", 0.1)], schema)
    got = {r.outcome: r.n for r in compose.changed_answers(base, other).collect()}
    assert got == {"unanswerable_refusal_regression": 1, "answerable_f1_improved": 1, "answerable_f1_regressed": 1, "answerable_f1_tied_changed": 1}


def test_buckets(spark):
    d = spark.createDataFrame([(float("inf"), None, 5, 0.1), (1.6, 0.04, 6, 0.2), (1.45, 0.05, 9, 0.21), (1.1, 0.2, 10, 0.5), (1.0, 0.4, 20, 0.6)], "r double, g double, n int, o double")
    got = d.select(M.ratio_bucket(F.col("r")), M.gap_bucket(F.col("g")), M.query_length_bucket(F.col("n")), M.overlap_bucket(F.col("o"))).collect()
    assert [tuple(r) for r in got] == [
        ("ratio_document_score_zero", "not_applicable", "lt_6", "le_0_10"), ("ratio_gte_1_60", "gap_0_00_to_0_04", "6_7", "0_10_0_20"), ("ratio_1_45_to_1_59", "gap_0_05_to_0_19", "8_9", "0_20_0_30"),
        ("ratio_1_10_to_1_19", "gap_0_20_to_0_39", "10_19", "0_30_0_50"), ("ratio_lt_1_10", "gap_0_40_plus", "ge_20", "gt_0_50"),
    ]
