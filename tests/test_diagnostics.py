"""Workflow sequences, closing streams, Poisson bootstrap, causes of misses, paired arms, window signals."""

import datetime
import json
import math
import os
import random

import pytest
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import diagnose, evidence, workflow
from lodestone.streaming import ledger

PLAIN = ["validate", "retrieve", "prepare"]
COMPOSE = ["compose", "verify", "observe", "complete"]


@pytest.mark.parametrize(
    "actions, seqs, want",
    [
        (PLAIN + ["initial_compose", *COMPOSE], None, (8, "complete", "complete")),
        (PLAIN + ["initial_inspect", "inspect", "final_compose", *COMPOSE], None, (10, "complete", "complete")),
        (PLAIN + ["initial_inspect", "inspect", "inspect"], None, (5, "alternate_evidence_inspected", "invalid")),
        (PLAIN + ["initial_refuse", "refuse"], None, (5, "refuse", "refuse")),
        (PLAIN, None, (3, "initial_context_prepared", "incomplete")),
        (PLAIN + ["initial_clarify", "clarify", "validate"], None, (5, "clarify", "invalid")),
        (["retrieve"], None, (0, "received", "invalid")),
        (PLAIN, [1, 2, 4], (3, "initial_context_prepared", "gap")),
        (PLAIN, [1, 2, 2], (1, "validated", "gap")),
        (["validate"] * 60, None, (1, "validated", "invalid")),
    ],
)
def test_sequences(spark, actions, seqs, want):
    rows = [("r", s, a) for s, a in zip(seqs or range(1, 99), actions)]
    got = workflow.checked_sequences(spark.createDataFrame(rows, "run string, seq int, action string")).first()
    assert (got.valid_steps, got.state, got.status, got.steps) == (*want, len(actions))


def test_the_table_allows_one_inspection():
    """Every path from the start ends in a terminal state and inspects at most once."""
    table = {}
    for s, a, t in workflow.ITERATIVE:
        table.setdefault(s, []).append((a, t))

    def walk(state, inspected):
        if state in workflow.TERMINAL:
            assert state not in table and inspected <= 1
            return
        for a, t in table[state]:
            walk(t, inspected + (a == "inspect"))

    walk(workflow.START, 0)


def test_alternate_evidence_wants_ten_contiguous_ranks(spark):
    rows = [("a", f"d{i}", i) for i in range(1, 15)] + [("b", f"d{i}", i) for i in range(1, 9)] + [("c", f"d{i}", i + (i > 4)) for i in range(1, 15)]
    got = {r.q_id: (r.problem, r.documents) for r in workflow.alternate_evidence(spark.createDataFrame(rows, "q_id string, doc_id string, rank int")).collect()}
    assert got == {"a": ("", ",".join(f"d{i}" for i in range(1, 11))), "b": ("too_few", ""), "c": ("ranks_not_contiguous", "")}


# ---- closing and expiry on a stream -------------------------------------------------

SCHEMA = "thread bigint, kind string, seq bigint, input string, response string, ts timestamp"


def _event(thread, kind, seq, minute, text="in"):
    return {"thread": thread, "kind": kind, "seq": seq, "input": text, "response": "out", "ts": (datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=minute)).isoformat()}


def _run(spark, tmp_path, name):
    """One query over all files that are there now; it goes on from its checkpoint the next time."""
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in")).withWatermark("ts", "5 minutes")
    q = ledger.closing_stream(stream, "30 minutes").writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "checkpoint")).outputMode("append").trigger(availableNow=True)
    started = q.start() if name == "first" else None
    if started is None:  # a memory sink doesn't restart from a checkpoint; a file sink does
        started = ledger.closing_stream(stream, "30 minutes").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "checkpoint")).outputMode("append").trigger(availableNow=True).start()
    started.awaitTermination(120)
    assert started.exception() is None
    return sorted((r.thread, r.kind, r.seq, r.accepted, r.reason) for r in spark.read.parquet(str(tmp_path / "out")).collect())


def _write(tmp_path, name, events):
    (tmp_path / "in").mkdir(exist_ok=True)
    path = tmp_path / "in" / name
    path.write_text("\n".join(json.dumps(e) for e in events))
    os.utime(path, (1_700_000_000 + int(name[0]) * 60,) * 2)  # files are taken in the order of their times


def test_threads_close_expire_and_survive_a_restart(spark, tmp_path):
    _write(tmp_path, "1.json", [_event(1, "turn", 1, 0), _event(1, "turn", 3, 1), _event(2, "turn", 1, 0), _event(3, "turn", 1, 0)])
    first = _run(spark, tmp_path, "restarted")
    assert first == [(1, "turn", 1, True, ""), (1, "turn", 3, False, "not_contiguous"), (2, "turn", 1, True, ""), (3, "turn", 1, True, "")]
    # A new query from the same checkpoint still knows the threads: the close sums them up, the late turn is refused.
    _write(tmp_path, "2.json", [_event(1, "turn", 2, 2), _event(1, "close", 0, 3)])
    _write(tmp_path, "3.json", [_event(1, "turn", 3, 4), _event(1, "close", 0, 5), _event(2, "turn", 2, 20)])
    second = [r for r in _run(spark, tmp_path, "restarted") if r not in first]
    assert second == [(1, "close", 0, False, "thread_closed"), (1, "summary", 2, True, "closed"), (1, "turn", 2, True, ""), (1, "turn", 3, False, "thread_closed"), (2, "turn", 2, True, "")]
    # Event time moves on: open threads expire with a summary, the closed one is forgotten without another.
    _write(tmp_path, "4.json", [_event(9, "turn", 1, 100)])
    _write(tmp_path, "5.json", [_event(9, "turn", 2, 101)])
    _write(tmp_path, "6.json", [_event(9, "turn", 3, 102)])
    rows = _run(spark, tmp_path, "restarted")
    assert [r for r in rows if r[4] == "expired"] == [(2, "summary", 2, True, "expired"), (3, "summary", 1, True, "expired")]
    assert len([r for r in rows if r[0] == 1 and r[1] == "summary"]) == 1


# ---- Poisson bootstrap ------------------------------------------------------------------


def test_poisson_weights_have_their_law(spark):
    w = spark.range(1, 201).join(spark.range(200).select(F.col("id").alias("k"))).select(diagnose.poisson_weight(F.col("id"), F.col("k")).alias("w"))
    counts = {r.w: r.n for r in w.groupBy("w").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(counts.values())
    for k in range(4):
        assert abs(counts[k] / total - math.exp(-1) / math.factorial(k)) < 0.01


def test_bootstrap_interval_is_near_the_exact_one_and_reruns_agree(spark):
    rnd = random.Random(3)
    values = [rnd.gauss(0.2, 1) for _ in range(400)]
    t = spark.createDataFrame([(str(i), v) for i, v in enumerate(values)], "q_id string, v double")
    a, b = diagnose.poisson_bootstrap(t, "q_id", "v", 400).first(), diagnose.poisson_bootstrap(t.repartition(7), "q_id", "v", 400).first()
    assert a == b
    mean, dev = sum(values) / 400, math.sqrt(sum((v - sum(values) / 400) ** 2 for v in values)) / 400
    assert a.mean == pytest.approx(mean, abs=1e-6) and a.sum == pytest.approx(mean * 400, abs=1e-4)
    assert a.mean_low == pytest.approx(mean - 1.96 * dev, abs=0.02) and a.mean_high == pytest.approx(mean + 1.96 * dev, abs=0.02)
    plan = diagnose.poisson_bootstrap(t, "q_id", "v")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


# ---- causes, arms, candidate sets ----------------------------------------------------------


def test_rules_are_learned_from_miss_rates_and_applied_in_order(spark):
    names = [k for k, _ in diagnose.CAUSES]
    rows = [(f"m{i}", True, "x", "bad", *["x"] * 4) for i in range(3)] + [(f"h{i}", False, "x", "good", *["x"] * 4) for i in range(5)] + [("m9", True, "once", "good", *["x"] * 4)]
    t = spark.createDataFrame(rows, "q_id string, missed boolean, " + ", ".join(f"{n} string" for n in names))
    rules = diagnose.learned_rules(t)
    assert [(r.family, r.bucket, r.n, r.rate) for r in rules.collect()] == [(names[1], "bad", 3, 1.0)]
    got = {r.q_id: (r.cause, r.signals, r.confidence) for r in diagnose.root_causes(t, rules).collect()}
    assert got == {**{f"m{i}": (names[1], 1, "low_single_signal") for i in range(3)}, "m9": ("mixed_or_low_confidence", 0, "low_no_high_signal")}
    both = spark.createDataFrame([("q", True, "zero_gold_section_overlap", "zero_title_heading_overlap", "low_local_anchor", "x", "x", "x")], t.schema)
    assert tuple(diagnose.root_causes(both, diagnose.fixed_rules(spark)).first()) == ("q", names[0], 3, "high_multi_signal")


def _arm(q, arm, kind="k", f1=0.5):
    return (q, arm, kind, f1)


@pytest.mark.parametrize("bad", [[_arm("q", "a")], [_arm("q", "a"), _arm("q", "a"), _arm("q", "b")], [_arm("q", "a"), _arm("q", "b", "other")], [_arm("q", "a"), _arm("q", "b", None)]])
def test_a_violated_pairing_stops_the_query(spark, bad):
    fine = [_arm("p", "a", f1=0.1), _arm("p", "b", f1=0.3)]
    schema = "q_id string, arm string, kind string, f1 double"
    good = diagnose.paired_arms(spark.createDataFrame(fine, schema), ("a", "b"), ["kind"], ["f1"]).first()
    assert tuple(good) == ("p", "k", 0.1, 0.3)
    with pytest.raises(Exception, match="arms aren't paired for q"):
        diagnose.paired_arms(spark.createDataFrame(fine + bad, schema), ("a", "b"), ["kind"], ["f1"]).collect()


def test_planted_leaks_are_found(spark):
    rows = [(i, i % 2, i % 2 + 3, i % 7, float(i)) for i in range(60)]
    t = spark.createDataFrame(rows, "gold_rank int, y int, copy int, noise int, unique double")
    got = {r.feature: (r.by_name, r.by_value) for r in diagnose.feature_leakage(t, ["gold_rank", "copy", "noise", "unique"], "y").collect()}
    assert got == {"gold_rank": (True, False), "copy": (False, True), "noise": (False, False), "unique": (False, False)}


def test_consistency_counts_each_kind(spark):
    rows = spark.createDataFrame([("a",), ("a",), ("b",), ("c",)], "q_id string")
    told = spark.createDataFrame([("a", 2), ("b", 5), ("d", 1)], "q_id string, n bigint")
    assert tuple(diagnose.consistency(rows, told).first()) == (4, 1, 1, 1)


# ---- windows ----------------------------------------------------------------------------------


WORDS = "apply resolving the problem to resolve this root cause local fix null trace cve-2020-12345 cvss base score summary must steps security bulletin docview support/docview é ünïcode /opt/ibm/was problem(abstract) cveid workaround caused by a b c".split()


def _document(rnd):
    parts = []
    for _ in range(rnd.randint(1, 12)):
        parts.append(" ".join(rnd.choice(WORDS) for _ in range(rnd.randint(2, 14))) + rnd.choice([". ", "! ", "\n\n", "\n", "? ", " Resolution: ", "\nSymptom\n"]))
    return "".join(parts)


def test_window_signals_equal_those_of_the_joined_text(spark):
    rnd = random.Random(5)
    docs = spark.createDataFrame([(str(i), _document(rnd)) for i in range(60)], "doc_id string, text string")
    results = docs.select(F.lit("q").alias("q_id"), "doc_id", F.col("doc_id").cast("int").alias("rank"))
    rows = evidence.window_rows(results, docs).cache()
    assert rows.count() > 200 and rows.filter("scoring <> sentence").count() > 20
    kept, read, wanted = evidence.signals_of(rows), T.Signals(F.col("scoring"), F.col("sentence")), F.array(F.lit("cve-2020-12345"))
    s, span = F.col("scoring"), F.col("sentence")
    scores = lambda own: [T.noise_penalty(s, own), T.answer_bonus(s, own), T.answer_multiplier(s, own), T.problem_penalty(s, own), T.action_bonus(s, own), T.compact_multiplier(span, s, own), T.length_penalty(span, 20, 10, own), T.span_bonus(s, own), T.cve_bonus(s, wanted, own), T.cve_multiplier(s, wanted, own), T.background_penalty(s, own), T.reference_penalty(s, own)]
    plain = rows.select("scoring", *[F.round(a, 9).alias(f"a{i}") for i, a in enumerate(scores(kept))], *[F.round(b, 9).alias(f"b{i}") for i, b in enumerate(scores(read))], F.array_sort("terms").alias("t1"), F.array_sort(T.content_terms(span)).alias("t2"))
    for i in range(12):
        bad = plain.filter(F.col(f"a{i}") != F.col(f"b{i}")).select("scoring", f"a{i}", f"b{i}").head(1)
        assert not bad, (i, bad)
    assert plain.filter(F.col("t1") != F.col("t2")).count() == 0
    rows.unpersist()


def test_windows_are_the_runs_of_sentences_of_each_section(spark):
    text = "One sentence that is long enough. Another sentence that is long enough! Short. A third sentence that is long enough\n\nA fourth sentence that is long enough"
    docs = spark.createDataFrame([("d", text)], "doc_id string, text string")
    got = [r.sentence for r in evidence.window_rows(docs.select(F.lit("q").alias("q_id"), "doc_id", F.lit(1).alias("rank")), docs).orderBy("pos").collect()]
    kept = ["One sentence that is long enough.", "Another sentence that is long enough!", "A third sentence that is long enough", "A fourth sentence that is long enough"]
    assert got == kept + [" ".join(kept[i : i + 2]) for i in range(3)] + [" ".join(kept[i : i + 3]) for i in range(2)]
