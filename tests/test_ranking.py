"""Learned rankers and policies: gradients, fold isolation, thresholds, known small cases."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators import boosting, context, linear, objectives
from lodestone.operators import policies as P
from lodestone.plans import policies as plans

FOLDS = plans.FOLDS


def _groups(spark, seed=1, questions=40, signal=1.0):
    """Planted actions: x0 decides the tier, x1 and x2 are noise."""
    rnd = random.Random(seed)
    rows = []
    for q in range(questions):
        for i in range(rnd.randint(4, 9)):
            x = [rnd.gauss(0, 1) for _ in range(3)]
            t = signal * x[0] + rnd.gauss(0, 0.3)
            rows.append((str(q), q % FOLDS, f"a{i}", *x, 2 if t > 0.9 else 1 if t > 0 else 0))
    return spark.createDataFrame(rows, "q_id string, fold int, item string, x0 double, x1 double, x2 double, tier int")


X = ["x0", "x1", "x2"]


# ---- gradients -------------------------------------------------------------------


def _numeric(loss, s, eps=1e-5):
    return np.array([(loss(s + eps * np.eye(len(s))[i]) - loss(s - eps * np.eye(len(s))[i])) / (2 * eps) for i in range(len(s))])


def test_softmax_gradient_equals_finite_differences():
    rng = np.random.default_rng(1)
    starts, s = np.array([0, 4, 5]), rng.normal(size=9)
    y = np.concatenate([rng.dirichlet(np.ones(n)) for n in (4, 1, 4)])
    w = np.full(9, 0.25)
    group = np.add.reduceat(w, starts)

    def loss(z):
        parts = np.split(z, starts[1:])
        return sum(g * -(t * (p - p.max() - np.log(np.exp(p - p.max()).sum()))).sum() for g, p, t in zip(group, parts, np.split(y, starts[1:])))

    g, h = objectives.softmax(y, w, s, starts)
    assert np.allclose(g, _numeric(loss, s), atol=1e-8) and (h > 0).all()
    assert np.allclose(np.add.reduceat(g, starts), 0, atol=1e-12)


def test_logistic_and_pinball_gradients():
    rng = np.random.default_rng(2)
    y, s, w = (rng.random(8) < 0.5).astype(float), rng.normal(size=8), rng.random(8)
    g, _ = objectives.logistic(y, w, s, np.array([0]))
    assert np.allclose(g, _numeric(lambda z: (w * (np.log1p(np.exp(z)) - y * z)).sum(), s), atol=1e-7)
    y = rng.normal(size=8)
    g, _ = objectives.pinball(0.25)(y, w, s, np.array([0]))
    assert np.allclose(g, _numeric(lambda z: (w * np.where(y > z, 0.25 * (y - z), 0.75 * (z - y))).sum(), s), atol=1e-7)


def test_lambdas_by_all_pairs():
    rng = np.random.default_rng(3)
    gains, k = objectives.TIER_GAINS, objectives.TRUNCATION
    for n in (2, 3, 7, 12):
        tier, s = rng.integers(0, 3, n), np.round(rng.normal(size=n), 3)
        order = np.argsort(-s, kind="stable")
        rank = {int(i): r for r, i in enumerate(order)}
        ideal = sum(g / math.log2(i + 2) for i, g in enumerate(sorted((gains[t] for t in tier), reverse=True)[:k]))
        g, h, total = np.zeros(n), np.zeros(n), 0.0
        for i, j in itertools.permutations(range(n), 2):
            if tier[i] > tier[j] and min(rank[i], rank[j]) < k and ideal > 0:
                delta = (gains[tier[i]] - gains[tier[j]]) * abs(1 / math.log2(rank[i] + 2) - 1 / math.log2(rank[j] + 2)) / ideal / (0.01 + abs(s[i] - s[j]))
                p = 1 / (1 + math.exp(s[i] - s[j]))
                g[i] -= p * delta
                g[j] += p * delta
                h[i] += p * (1 - p) * delta
                h[j] += p * (1 - p) * delta
                total += 2 * p * delta
        norm = math.log2(1 + total) / total if total else 1.0
        got = objectives.lambdas(tier, s)
        assert np.allclose(got[0], g * norm) and np.allclose(got[1], h * norm)


def test_lambda_rows_equal_the_fitted_gradients(spark):
    rows = _groups(spark, 4).withColumn("score", F.round(F.col("x1"), 3))
    got = {(r.q_id, r["item"]): (r.gradient, r.curvature) for r in P.lambda_rows(rows.select("q_id", "item", "tier", "score"), objectives.TIER_GAINS, objectives.TRUNCATION).collect()}
    for q, group in itertools.groupby(sorted(rows.collect(), key=lambda r: (r.q_id, r["item"])), key=lambda r: r.q_id):
        group = list(group)
        g, h = objectives.lambdas(np.array([r.tier for r in group]), np.array([r.score for r in group]))
        for r, a, b in zip(group, g, h):
            assert got[q, r["item"]] == pytest.approx((a, b), abs=2e-6)


# ---- fitting ------------------------------------------------------------------------


def _cv(spark, rows, objective, label="tier", **options):
    return {(r.q_id, r["item"]): r.model_score for r in boosting.out_of_fold(rows, X, label, "item", FOLDS, objective, **options).collect()}


def test_no_model_sees_the_fold_it_scores(spark):
    """Other labels and features in a fold leave the scores of its own rows' models alone."""
    rows = _groups(spark, 5)
    changed = rows.withColumn("tier", F.when(F.col("fold") == 1, 2 - F.col("tier")).otherwise(F.col("tier")))
    for objective in (objectives.logistic, objectives.lambdarank):
        a, b = _cv(spark, rows, objective, trees=3), _cv(spark, changed, objective, trees=3)
        own = {(r.q_id, r["item"]) for r in rows.filter("fold = 1").collect()}
        assert all(a[k] == b[k] for k in own) and any(a[k] != b[k] for k in a.keys() - own)


def test_fit_does_not_depend_on_partitions(spark):
    rows = _groups(spark, 6)
    assert _cv(spark, rows.repartition(1), objectives.softmax, trees=3) == _cv(spark, rows.repartition(7), objectives.softmax, trees=3)


def test_held_out_loss_falls_and_lambdamart_ranks(spark):
    rows = _groups(spark, 7, questions=120)
    share = F.col("tier") / F.greatest(F.lit(1), F.sum("tier").over(__import__("pyspark.sql", fromlist=["Window"]).Window.partitionBy("q_id")))
    aimed = rows.withColumn("target", share).filter("tier >= 0")
    fitted = boosting.out_of_fold(aimed, X, "target", "item", FOLDS, objectives.softmax, trees=10)
    j = aimed.join(fitted.select("q_id", "item", F.col("model_score").alias("score")), ["q_id", "item"])
    loss = lambda t: P.softmax_loss(P.softmax_rows(t), []).first().loss
    assert loss(j) < loss(j.withColumn("score", F.lit(0.0))) - 0.1
    ndcg = lambda scores: P.ndcg(rows.join(scores.select("q_id", "item", F.col("model_score").alias("score")), ["q_id", "item"]), objectives.TIER_GAINS, objectives.TRUNCATION, []).first().ndcg
    noise = rows.withColumn("model_score", F.col("x1"))
    ranked = boosting.out_of_fold(rows, X, "tier", "item", FOLDS, objectives.lambdarank, trees=10)
    assert ndcg(ranked) > 0.9 > ndcg(noise) + 0.1


def test_lambdamart_beats_pointwise_where_only_the_order_within_questions_counts(spark):
    """Each question has a level of its own that is no use in ranking; it fills the pointwise loss."""
    rnd, rows = random.Random(8), []
    for q in range(160):
        level = rnd.choice([0, 0, 0, 1])
        for i in range(8):
            a, b = rnd.gauss(0, 1), float(level) + rnd.gauss(0, 0.05)
            rows.append((str(q), q % FOLDS, f"a{i}", a, b, rnd.gauss(0, 1), 2 if level and a > -1.5 else 1 if a > 0.7 else 0))
    t = spark.createDataFrame(rows, "q_id string, fold int, item string, x0 double, x1 double, x2 double, tier int")
    top = lambda objective: P.ndcg(t.join(boosting.out_of_fold(t, X, "tier", "item", FOLDS, objective, trees=4, depth=1).select("q_id", "item", F.col("model_score").alias("score")), ["q_id", "item"]), objectives.TIER_GAINS, 4, []).first().ndcg
    assert top(objectives.lambdarank) > top(objectives.squared)


def test_quantile_head_covers_its_share(spark):
    rnd = random.Random(9)
    rows = [(str(q), q % FOLDS, str(i), x := rnd.random(), rnd.random(), rnd.random(), x + rnd.gauss(0, 0.5) * (1 + x)) for q in range(200) for i in range(5)]
    t = spark.createDataFrame(rows, "q_id string, fold int, item string, x0 double, x1 double, x2 double, f1 double")
    scores = boosting.out_of_fold(t, X, "f1", "item", FOLDS, objectives.pinball(0.25), trees=10)
    below = scores.agg(F.avg((F.col("y") < F.col("model_score")).cast("int")).alias("s")).first().s
    assert abs(below - 0.25) < 0.05


def test_ordinal_chances_never_fall(spark):
    rows = _groups(spark, 10).withColumn("f1", F.round(F.col("x0") / 5, 4))
    for r in plans.ordinal_heads(rows, X).collect():
        assert list(r.chances) == sorted(r.chances) and len(r.chances) == len(plans.ORDINAL)


def test_logistic_weights_against_a_closed_case(spark):
    """One feature, four cells, almost no penalty: the weight is the log of the odds ratio, the intercept the log odds."""
    rows = [(0.0, 1)] * 3 + [(0.0, 0)] * 9 + [(1.0, 1)] * 8 + [(1.0, 0)] * 4
    t = spark.createDataFrame([(str(i), 0, x, y) for i, (x, y) in enumerate(rows)], "q_id string, fold int, x0 double, label int")
    w = linear.fit(linear.design(t, ["x0"], ["label"], ["q_id"]), 1, 1, [frozenset()], l2=1e-9)
    assert w[0, 0] == pytest.approx([math.log((8 / 4) / (3 / 9)), math.log(3 / 9)], abs=1e-6)


def test_pairwise_model_has_no_intercept_and_finds_the_sign(spark):
    """Signed differences d and -d: the closed Newton solution of one feature with equal differences."""
    t = spark.createDataFrame([("a", 0, 2.0, 1), ("a", 0, -2.0, 0), ("b", 0, 2.0, 1), ("b", 0, -2.0, 0), ("c", 0, -2.0, 1), ("c", 0, 2.0, 0)], "q_id string, fold int, x0 double, label int")
    w = linear.fit(linear.design(t, ["x0"], ["label"], ["q_id"]), 1, 1, [frozenset()], intercept=False, l2=1e-9)
    assert w.shape == (1, 1, 1) and w[0, 0, 0] == pytest.approx(math.log(2) / 2, abs=1e-6)


def test_linear_scores_come_from_models_without_the_fold(spark):
    rows = _groups(spark, 11).withColumn("good", (F.col("tier") == 2).cast("int"))
    changed = rows.withColumn("good", F.when(F.col("fold").isin(0, 2), 1 - F.col("good")).otherwise(F.col("good")))
    models = linear.left_out_pairs(FOLDS)

    def scores(t):
        table = linear.design(t, X, ["good"], ["q_id", "item"])
        return {(r.q_id, r["item"], r.fold, r.outer): r.model_scores[0] for r in linear.scored(table, linear.fit(table, 3, 1, models), 3, linear.by_outer(models, FOLDS)).collect()}

    a, b = scores(rows), scores(changed)
    assert len(a) == rows.count() * FOLDS
    same = {k for k in a if a[k] == pytest.approx(b[k], abs=1e-9)}
    assert same == {k for k in a if {k[2], k[3]} == {0, 2}}


# ---- selection ---------------------------------------------------------------------------


@pytest.fixture(scope="module")
def scored(spark):
    rnd = random.Random(12)
    rows = [(str(q), q % FOLDS, f"a{i}", round(rnd.random(), 3), round(rnd.random(), 3), round(rnd.random(), 3), i == 0) for q in range(30) for i in range(rnd.randint(2, 14))]
    return spark.createDataFrame(rows, "q_id string, fold int, item string, gain double, risk double, risk_b double, base boolean").cache()


@pytest.mark.parametrize("share", [0.01, 0.25, 0.5, 1.0])
def test_thresholds_are_the_value_at_the_place(scored, share):
    best = P.best_actions(scored, "citation_minus_risk")
    got = {r.fold: r.threshold for r in P.coverage_thresholds(best, share, "fold").collect()}
    values = {}
    for r in best.collect():
        values.setdefault(r.fold, []).append(r.utility)
    assert got == {k: pytest.approx(sorted(v, reverse=True)[max(1, math.ceil(len(v) * share)) - 1], abs=1e-9) for k, v in values.items()}


def test_places_with_ties_and_negative_values(spark):
    values = [-5.5, -5.5, 0.0, 1e-9, 2.0, 2.0, 2.0, 1e6, None]
    t = spark.createDataFrame([("g", v) for v in values], "g string, v double")
    known = sorted((v for v in values if v is not None), reverse=True)
    for place in range(1, 9):
        assert P.place_value(t, "g", "v", spark.createDataFrame([("g", place)], "g string, place bigint")).first().threshold == pytest.approx(known[place - 1], abs=1e-9)
    plan = P.place_value(t, "g", "v", spark.createDataFrame([("g", 1)], "g string, place bigint"))._jdf.queryExecution().executedPlan().toString()
    assert "collect_" not in plan and "SinglePartition" not in plan


def test_abstained_questions_have_no_row(scored):
    best = P.best_actions(scored, "safe_product")
    kept = P.abstaining(best, P.coverage_thresholds(best, 0.25, "fold"), "fold")
    assert 0 < kept.count() < best.count() and kept.filter(F.col("utility") < F.col("threshold")).count() == 0


def test_dominators_by_all_pairs(scored):
    got = {r.q_id: (r["item"], r.dominators) for r in P.joint_constraint(scored.withColumnRenamed("risk", "risk_a"), "dominance", 0.05, 0.02).collect()}
    floor = lambda v, w: math.floor((v + 1e-12) / w)
    for q, rows in itertools.groupby(sorted(scored.collect(), key=lambda r: r.q_id), key=lambda r: r.q_id):
        rows = list(rows)
        count = lambda r: sum(l.risk <= r.risk - 0.05 and l.risk_b <= r.risk_b - 0.05 and l.gain >= r.gain + 0.02 for l in rows if l is not r)  # noqa: B023, E731, E741
        best = min(rows, key=lambda r: (count(r), max(floor(r.risk, 0.05), floor(r.risk_b, 0.05)), floor(r.risk, 0.05) + floor(r.risk_b, 0.05), -floor(r.gain, 0.02), r["item"]))
        assert got[q] == (best["item"], count(best))
    plan = P.joint_constraint(scored.withColumnRenamed("risk", "risk_a"), "dominance", 0.05, 0.02)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan


def test_nested_thresholds_never_read_their_own_fold(spark):
    rnd = random.Random(13)
    rows = [(k % 3, round(rnd.uniform(0, 10), 3), rnd.choice([-1, 0, 1])) for k in range(300)]
    schema = "fold int, margin double, change int"
    a = {r.fold: r for r in P.nested_thresholds(spark.createDataFrame(rows, schema), plans.MARGINS).collect()}
    flipped = [(f, m, -c if f == 1 else c) for f, m, c in rows]
    b = {r.fold: r for r in P.nested_thresholds(spark.createDataFrame(flipped, schema), plans.MARGINS).collect()}
    assert a[1].threshold == b[1].threshold and a[1].train_net == b[1].train_net and a[1].held_net == -b[1].held_net
    plan = P.nested_thresholds(spark.createDataFrame(rows, schema), plans.MARGINS)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_two_stages_keep_the_outer_fold_apart(spark, monkeypatch):
    """Other outcomes in a fold change neither which of its questions pass the gate nor their utilities."""
    rnd, rows = random.Random(14), []
    for q in range(32):
        for i in range(7):
            n = rnd.randint(1, 4)
            rows.append((str(q), f"{i}", "baseline" if i == 0 else "keep_prefix_1", i == 0, q % FOLDS, n, *[round(rnd.random(), 4) for _ in range(13)], 0 if i == 0 else rnd.choice([-1, 0, 0, 1]), 0.0 if i == 0 else round(rnd.uniform(-0.3, 0.3), 4)))
    names = ", ".join(f"{c} double" for c in plans.ACTION_FEATURES[1:])
    t = spark.createDataFrame(rows, f"q_id string, item string, family string, base boolean, fold int, n_sentences int, {names}, cit int, f1 double").withColumn("tier", plans.actions.tier(F.col("cit"), F.col("f1")))
    worse = F.col("fold") == 2
    other = t.withColumn("cit", F.when(worse, -F.col("cit")).otherwise(F.col("cit"))).withColumn("f1", F.when(worse, -F.col("f1")).otherwise(F.col("f1"))).withColumn("tier", plans.actions.tier(F.col("cit"), F.col("f1")))
    get = lambda x: {(r.q_id, r["item"]): r.utility for r in plans.two_stage(x, trees=2).filter("fold = 2").collect()}
    a = get(t)
    assert a and a == get(other)
    per = plans.two_stage(t, trees=2).groupBy("q_id").count()
    assert per.filter("count > 1").count() == 0


# ---- context selection ------------------------------------------------------------------------


def test_hard_negatives_and_pairs(spark):
    rows = [("q", "g", 30, 1, 0, 5.0), ("q", "a", 6, 0, 0, 0.0), ("q", "b", 7, 0, 0, 9.0), ("q", "c", 8, 0, 0, 9.0), ("q", "d", 9, 0, 0, 1.0), ("r", "x", 6, 0, 1, 1.0)]
    t = spark.createDataFrame(rows, "q_id string, doc_id string, rank int, is_gold int, fold int, overlap_score double")
    got = {r.doc_id: r.windows for r in context.hard_negatives(t, 2).collect()}
    assert got == {"a": "rank", "b": "overlap+rank", "c": "overlap"}
    pairs = {(r.negative, r.label): r.overlap_score for r in context.preference_pairs(t, ["overlap_score"], 2).collect()}
    assert pairs == {("a", 1): 5.0, ("a", 0): -5.0, ("b", 1): -4.0, ("b", 0): 4.0, ("c", 1): -4.0, ("c", 0): 4.0}


def test_protected_prefix_stays(spark):
    pool = spark.createDataFrame([("q", f"d{i:02}", i) for i in range(1, 31)], "q_id string, doc_id string, rank int")
    scores = spark.createDataFrame([("q", f"d{i:02}", float(i)) for i in range(6, 30)], "q_id string, doc_id string, model_score double")
    got = [r.doc_id for r in context.protected(pool, scores, 5).orderBy("rank").collect()]
    assert got == [f"d{i:02}" for i in (1, 2, 3, 4, 5, 29, 28, 27, 26, 25)]
    report = context.selection_report(context.protected(pool, scores, 5), pool, spark.createDataFrame([("q", "d29")], "q_id string, gold string"), 5).first()
    assert (report.selected_hits, report.baseline_hits, report.gained, report.violations, report.promotions) == (1, 0, 1, 0, 5)


def test_a_word_cut_at_the_end_of_the_beginning_is_no_coverage(spark):
    text = "x " * (context.SHORT_CHARS // 2 - 2) + "alphabet beta"  # the first SHORT_CHARS characters end in "alph"
    docs = spark.createDataFrame([("1", "gamma", text)], "doc_id string, title string, text string")
    asked = spark.createDataFrame([("7", "alph", "alph beta gamma delta")], "q_id string, title string, text string")
    pool = spark.createDataFrame([("7", "1", 1, 0.1)], "q_id string, doc_id string, rank int, score double")
    channels = pool.selectExpr("'document' AS channel", "q_id", "doc_id", "rank")
    row = context.features(pool, channels, docs, asked, ["document", "title"]).first()
    assert (row.overlap_count, row.title_overlap, row.coverage, row.body_coverage) == (2, 1, 0.5, 0.25)
