"""Queries of policies over real composition actions: what each does to citation and F1 is known.

Queries with SQL decide from given scores (`given`, plain formulas of runtime
features); the others fit models, and no row is scored by one that saw its fold.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import metrics as M
from lodestone.functions import text as T
from lodestone.operators import actions, boosting, evidence, fuse, linear, objectives
from lodestone.operators import policies as P
from lodestone.plans import corpus
from lodestone.plans import sql as S
from lodestone.plans.evidence import BM25_ROWS, ROUTES, Evidence
from lodestone.plans.ranking import FOLDS, fold
from lodestone.plans.retrieval import FIT, Setting, with_fit
from lodestone.sources.scratch import stored

QUERIES, ORACLES = {}, {}
ACTION_FEATURES = ["n_sentences", "score_sum", "score_best", "score_least", "rank_best", "n_documents", "n_tokens", "n_overlap", "is_delete", "is_replace", "is_prefix", "is_coverage", "score_change", "token_change"]
RELATIVE = ["score_sum_z", "n_tokens_z", "n_overlap_z"]
GAINS, DEPTH = objectives.TIER_GAINS, objectives.TRUNCATION


def query(oracle: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def action_table(e):
    """(q_id, item, family, base, fold, features, cit, f1, tier) of every enumerated action.

    `item` lists the places of the action's sentences; cit and f1 are what it
    changes against the question's baseline action.
    """
    r = evidence.bm25_ranked(e.rows()).filter("place <= 12").select("q_id", "place", "doc_id", "rank", "score", F.size("overlap").alias("n_overlap"), T.tokens(F.col("sentence")).alias("toks"))
    listed = actions.enumerate_actions(r.select("q_id", "place", "doc_id"))
    each = listed.select("q_id", F.col("idx").alias("item"), "family", F.explode(F.split("idx", ",")).alias("i")).withColumn("place", F.col("i").cast("int") + 1)
    j = each.join(r, ["q_id", "place"])
    agg = j.groupBy("q_id", "item", "family").agg(
        F.count(F.lit(1)).cast("int").alias("n_sentences"), F.round(F.sum("score"), 4).alias("score_sum"), F.round(F.max("score"), 4).alias("score_best"), F.round(F.min("score"), 4).alias("score_least"), F.min("rank").alias("rank_best"),
        F.count_distinct("doc_id").cast("int").alias("n_documents"), F.sum(F.size("toks")).cast("int").alias("n_tokens"), F.sum("n_overlap").cast("int").alias("n_overlap"), F.flatten(F.collect_list("toks")).alias("toks"), F.collect_set("doc_id").alias("cited"),
    )
    asked = e.asked.select("q_id", T.tokens(F.col("text")).alias("gt")).join(e.gold, "q_id", "left")
    agg = agg.join(asked, "q_id").withColumn("own_f1", F.round(M.token_f1(F.col("toks"), F.col("gt")), 4)).withColumn("own_cit", F.coalesce(F.array_contains("cited", F.col("gold")), F.lit(False)).cast("int")).drop("toks", "cited", "gt", "gold")
    agg = stored(agg, "actions")
    base = agg.filter("family = 'baseline'").select("q_id", F.col("own_f1").alias("b_f1"), F.col("own_cit").alias("b_cit"), F.col("score_sum").alias("b_score"), F.col("n_tokens").alias("b_tokens"))  # one row a question
    out = agg.join(base, "q_id").withColumn("cit", F.col("own_cit") - F.col("b_cit")).withColumn("f1", F.round(F.col("own_f1") - F.col("b_f1"), 4))
    out = out.withColumn("score_change", F.round(F.col("score_sum") - F.col("b_score"), 4)).withColumn("token_change", F.col("n_tokens") - F.col("b_tokens"))
    for name in ("delete", "replace"):
        out = out.withColumn(f"is_{name}", F.col("family").startswith(f"{name}_slot").cast("int"))
    out = out.withColumn("is_prefix", F.col("family").startswith("keep_prefix").cast("int")).withColumn("is_coverage", (F.col("family") == "document_coverage").cast("int"))
    return out.select("q_id", "item", "family", (F.col("family") == "baseline").alias("base"), fold().alias("fold"), *ACTION_FEATURES, "cit", "f1", actions.tier(F.col("cit"), F.col("f1")).alias("tier"))


_ROWS = [
    *BM25_ROWS, S.GOLD, f"en AS MATERIALIZED ({corpus.ORACLES['action_enumeration']})", "ex AS (SELECT q_id, idx, family, unnest(string_split(idx, ','))::BIGINT AS i FROM en)",
    f"ag AS MATERIALIZED (SELECT ex.q_id, ex.idx AS item, ex.family, count(*)::INT AS n_sentences, round(sum(p.score), 4) AS score_sum, round(max(p.score), 4) AS score_best, round(min(p.score), 4) AS score_least, min(p.rank) AS rank_best, count(DISTINCT p.doc_id)::INT AS n_documents, flatten(list({S.toks('p.sentence')})) AS t, sum(len(p.overlap))::INT AS n_overlap, list(p.doc_id) AS cited FROM ex JOIN p ON p.q_id = ex.q_id AND p.place = ex.i + 1 GROUP BY ex.q_id, ex.idx, ex.family)",
    f"af AS MATERIALIZED (SELECT ag.*, len(t)::INT AS n_tokens, {S.f1('t', S.toks('ques.text'))} AS own_f1, coalesce(list_contains(cited, gold), false)::INT AS own_cit FROM ag JOIN ques USING (q_id) LEFT JOIN gold ON gold.q_id = ag.q_id)",
    f"ad AS MATERIALIZED (SELECT a.*, a.own_cit - b.own_cit AS cit, round(a.own_f1 - b.own_f1, 4)::DOUBLE AS f1, round(a.score_sum - b.score_sum, 4) AS score_change, a.n_tokens - b.n_tokens AS token_change, starts_with(a.family, 'delete_slot')::INT AS is_delete, starts_with(a.family, 'replace_slot')::INT AS is_replace, starts_with(a.family, 'keep_prefix')::INT AS is_prefix, (a.family = 'document_coverage')::INT AS is_coverage, a.family = 'baseline' AS base, (a.q_id::BIGINT % {FOLDS})::INT AS fold FROM af a JOIN af b ON a.q_id = b.q_id AND b.family = 'baseline')",
    f"ar AS MATERIALIZED (SELECT *, {corpus._TIER} AS tier FROM ad)",
    "gv AS MATERIALIZED (SELECT q_id, item, fold, base, tier, cit, f1, round(score_best / (score_best + 50.0::DOUBLE), 6) AS gain, round(n_tokens / (n_tokens + 60.0::DOUBLE), 6) AS risk, round(1 / (1.0::DOUBLE + n_overlap), 6) AS risk_b FROM ar)",
]


def given(rows):
    """Scores by plain formulas: gain from the best sentence, one risk from length, one from overlap."""
    c = F.col
    return rows.select(
        "q_id", "item", "fold", "base", "tier", "cit", "f1", F.round(c("score_best") / (c("score_best") + 50.0), 6).alias("gain"), F.round(c("n_tokens") / (c("n_tokens") + 60.0), 6).alias("risk"), F.round(1 / (1.0 + c("n_overlap")), 6).alias("risk_b")
    )


@query(S.query(_ROWS, f"SELECT q_id, item, family, base, fold, {', '.join(ACTION_FEATURES)}, cit, f1, tier FROM ar"))
def action_outcomes(spark, d):
    return action_table(Evidence(spark, d))


# ---- dual targets ------------------------------------------------------------

_BEST = "be AS MATERIALIZED (SELECT * FROM (SELECT *, round(gain * (1 - risk), 9) AS utility FROM gv WHERE NOT base) QUALIFY row_number() OVER (PARTITION BY q_id ORDER BY utility DESC, gain DESC, risk, item DESC) = 1)"
_THR = f"th AS MATERIALIZED (SELECT k AS fold, utility AS threshold FROM (SELECT k, utility, row_number() OVER (PARTITION BY k ORDER BY utility DESC) AS i, greatest(1, ceil(count(*) OVER (PARTITION BY k) * 0.25)) AS place FROM be, (SELECT unnest(range({FOLDS}))::INT AS k) WHERE be.fold <> k) WHERE i = place)"


def _thresholds(best, share=0.25):
    """A threshold for each fold, from the questions of the others."""
    others = best.withColumn("outer", F.explode(F.array(*[F.lit(k) for k in range(FOLDS)]))).filter(F.col("outer") != F.col("fold"))
    return P.coverage_thresholds(others, share, "outer").withColumnRenamed("outer", "fold")


@query(S.query([*_ROWS, _BEST, _THR], "SELECT q_id, item, fold, utility, cit, f1 FROM be JOIN th USING (fold) WHERE utility >= threshold"))
def dual_target_selection(spark, d):
    best = stored(P.best_actions(given(action_table(Evidence(spark, d))).filter(~F.col("base")), "safe_product"), "best")
    return P.abstaining(best, _thresholds(best), "fold").select("q_id", "item", "fold", "utility", "cit", "f1")


def dual_heads(rows, by=linear.by_outer):
    """Chances of a citation gain and of an F1 loss for every action, under every outer fold, by models that saw neither fold."""
    labelled = rows.withColumn("gains", (F.col("cit") > 0).cast("int")).withColumn("loses", (F.col("f1") < -actions.TOLERANCE).cast("int"))
    weighed = labelled.join(rows.groupBy("q_id").agg((1.0 / F.count(F.lit(1))).alias("w")), "q_id")
    table = stored(linear.design(weighed, ACTION_FEATURES, ["gains", "loses"], ["q_id", "item", "cit", "f1"], "w"), "heads")
    models = linear.left_out_pairs(FOLDS)
    weights = linear.fit(table, len(ACTION_FEATURES), 2, models, balanced=True)
    scored = linear.scored(table, weights, len(ACTION_FEATURES), by(models, FOLDS))
    p = lambda i: F.round(F.element_at("model_scores", i), 9)
    return scored.select("q_id", "item", "fold", "outer", "cit", "f1", p(1).alias("gain"), p(2).alias("risk"))


def dual_target(rows, mode="safe_product", share=0.25):
    """Selected actions: the threshold of an outer fold comes from inner predictions of the others."""
    best = stored(P.best_actions(dual_heads(rows), mode, ("q_id", "outer")), "best")
    thresholds = P.coverage_thresholds(best.filter("outer <> fold"), share, "outer")
    return P.abstaining(best.filter("outer = fold"), thresholds, "outer")


@query(None)
def dual_target_cv(spark, d):
    rows = action_table(Evidence(spark, d)).filter(~F.col("base"))
    chosen = dual_target(rows)
    return chosen.groupBy("fold").agg(F.count(F.lit(1)).alias("selected"), F.sum("cit").alias("citation_change"), F.round(F.avg("f1"), 6).alias("f1_change"), F.count_if(F.col("f1") < -actions.TOLERANCE).alias("f1_losses"))


# ---- nested thresholds -----------------------------------------------------------

MARGINS = [0.0, 0.5, 1.0, 2.0, 3.0, 5.0, 8.0]
_NEST = """cl AS MATERIALIZED (SELECT f.fold, t.threshold, count(o.margin) AS n, coalesce(sum(o.change), 0) AS net, count(o.margin) FILTER (o.change < 0) AS losses FROM (SELECT DISTINCT fold FROM op) f CROSS JOIN (SELECT unnest({grid})::DOUBLE AS threshold) t LEFT JOIN op o ON o.fold = f.fold AND o.margin >= t.threshold GROUP BY f.fold, t.threshold),
tr AS (SELECT a.fold, a.threshold, a.n AS held_n, a.net AS held_net, a.losses AS held_losses, coalesce(sum(b.n), 0) AS train_n, coalesce(sum(b.net), 0) AS train_net, coalesce(sum(b.losses), 0) AS train_losses FROM cl a LEFT JOIN cl b ON b.threshold = a.threshold AND b.fold <> a.fold GROUP BY ALL)"""
_PICK = "SELECT fold, threshold, CASE WHEN train_net >= {least} THEN 'best_on_other_folds' ELSE 'no_threshold_met_minimum' END AS reason, train_n::BIGINT AS train_n, train_net::BIGINT AS train_net, train_losses::BIGINT AS train_losses, held_n::BIGINT AS held_n, held_net::BIGINT AS held_net, held_losses::BIGINT AS held_losses FROM tr QUALIFY row_number() OVER (PARTITION BY fold ORDER BY (train_net >= {least})::INT DESC, CASE WHEN train_net >= {least} THEN train_net END DESC NULLS LAST, CASE WHEN train_net >= {least} THEN -train_n END DESC NULLS LAST, threshold DESC) = 1"
_SWAPS = [S.BM25, FIT, S.GOLD, "a AS (SELECT q_id, row_number() OVER (PARTITION BY q_id ORDER BY fit, rank DESC, doc_id) AS i, doc_id AS out_doc, fit AS o FROM fits WHERE rank <= 10 QUALIFY i <= 3)", "c AS (SELECT q_id, row_number() OVER (PARTITION BY q_id ORDER BY fit DESC, rank, doc_id) AS i, doc_id AS in_doc, fit AS n FROM fits WHERE rank > 10 QUALIFY i <= 3)",
    f"op AS MATERIALIZED (SELECT (q_id::BIGINT % {FOLDS})::INT AS fold, round(n - o, 6) AS margin, coalesce(in_doc = gold, false)::INT - coalesce(out_doc = gold, false)::INT AS change FROM a JOIN c USING (q_id, i) LEFT JOIN gold USING (q_id))"]


@query(S.query([*_SWAPS, _NEST.format(grid=MARGINS)], _PICK.format(least=0)))
def nested_margin_selection(spark, d):
    """Margins of conservative swaps, chosen inside each outer fold's complement by the gold they bring in."""
    s = Setting(spark, d)
    swaps = fuse.swaps(with_fit(s).withColumnRenamed("fit", "model")).join(s.gold, "q_id", "left")
    is_gold = lambda c: F.coalesce(F.col(c) == F.col("gold"), F.lit(False)).cast("int")
    return P.nested_thresholds(swaps.select(fold().alias("fold"), F.col("gain").alias("margin"), (is_gold("in_doc") - is_gold("out_doc")).alias("change")), MARGINS)


LEADS = [0.0, 20.0, 40.0, 60.0, 80.0, 100.0]
_LEAD = [*_ROWS, ROUTES, "s2 AS (SELECT q_id, max(score) FILTER (place = 1) AS s1, max(score) FILTER (place = 2) AS s2 FROM p GROUP BY q_id)",
    f"op AS MATERIALIZED (SELECT ar.q_id, ar.fold, route, round(s1 - coalesce(s2, 0), 6) AS margin, round(10000 * f1)::BIGINT AS change FROM ar JOIN s2 USING (q_id) JOIN qr USING (q_id) WHERE item = '0')"]


def _leads(e):
    """Answering with the first sentence alone: the lead of its score, and what it changes in F1 (in 1e-4)."""
    r = evidence.bm25_ranked(e.rows()).filter("place <= 2")
    lead = r.groupBy("q_id").agg(F.round(F.max(F.when(F.col("place") == 1, F.col("score"))) - F.coalesce(F.max(F.when(F.col("place") == 2, F.col("score"))), F.lit(0.0)), 6).alias("margin"))
    alone = action_table(e).filter("item = '0'").select("q_id", "fold", F.round(F.col("f1") * 10_000).cast("bigint").alias("change"))
    return alone.join(lead, "q_id").join(e.routes(), "q_id")


@query(S.query([*_LEAD, _NEST.format(grid=LEADS)], _PICK.format(least=100)))
def route_policy_cv(spark, d):
    """The lead at which one sentence answers, with a least training gain; where none reaches it, the highest."""
    return P.nested_thresholds(_leads(Evidence(spark, d)), LEADS, 100)


_POLICIES = "pp AS (SELECT 'lead_' || t::INT AS policy, fold, route, margin >= t AS changed, CASE WHEN margin >= t THEN change ELSE 0 END / 10000.0::DOUBLE AS delta FROM op, (SELECT unnest(" + str(LEADS) + ") AS t)), pl AS (SELECT policy, 'fold' AS part, fold::VARCHAR AS value, changed, delta FROM pp UNION ALL SELECT policy, 'route', route, changed, delta FROM pp)"


@query(S.query([*_LEAD, _POLICIES], "SELECT policy, part, value, count(*) AS questions, count(*) FILTER (changed) AS changes, round(sum(delta), 4) AS net, round(round(sum(delta), 4) / count(*), 4) AS mean, round(sum(delta), 4) >= 0 AS nonregression FROM pl GROUP BY policy, part, value"))
def policy_stability(spark, d):
    """Every lead as a policy, over folds and routes."""
    rows = _leads(Evidence(spark, d)).withColumn("t", F.explode(F.array(*[F.lit(t) for t in LEADS])))
    on = F.col("margin") >= F.col("t")
    rows = rows.select(F.concat(F.lit("lead_"), F.col("t").cast("int").cast("string")).alias("policy"), "fold", "route", on.alias("changed"), (F.when(on, F.col("change")).otherwise(0) / F.lit(10_000.0)).alias("delta"))
    return P.stability(rows, "policy", ["fold", "route"])


# ---- joint constraints ------------------------------------------------------------

SAFETY, GAIN = 0.05, 0.02
_LEVEL = "floor((round({x}, 6) + 1e-12::DOUBLE) / {w}::DOUBLE)"
_JOINT = [*_ROWS, f"jl AS MATERIALIZED (SELECT q_id, item, gain, risk AS risk_a, risk_b, {_LEVEL.format(x='risk', w=SAFETY)} AS la, {_LEVEL.format(x='risk_b', w=SAFETY)} AS lb, {_LEVEL.format(x='gain', w=GAIN)} AS lg FROM gv)",
    f"dm AS MATERIALIZED (SELECT r.q_id, r.item, count(l.item)::INT AS dominators FROM jl r LEFT JOIN jl l ON l.q_id = r.q_id AND l.risk_a <= r.risk_a - {SAFETY}::DOUBLE AND l.risk_b <= r.risk_b - {SAFETY}::DOUBLE AND l.gain >= r.gain + {GAIN}::DOUBLE GROUP BY r.q_id, r.item)"]


@query(S.query(_JOINT, "SELECT q_id, item, dominators, greatest(la, lb) AS worst, la + lb AS both, lg AS gain_level FROM jl JOIN dm USING (q_id, item) QUALIFY row_number() OVER (PARTITION BY q_id ORDER BY dominators, greatest(la, lb), la + lb, lg DESC, item) = 1"))
def joint_constraint_select(spark, d):
    rows = given(action_table(Evidence(spark, d))).withColumnRenamed("risk", "risk_a")
    return P.joint_constraint(rows, "dominance", SAFETY, GAIN)


@query(S.query(_JOINT, "SELECT q_id, item, 0 AS dominators, greatest(la, lb) AS worst, la + lb AS both, lg AS gain_level FROM jl QUALIFY row_number() OVER (PARTITION BY q_id ORDER BY la, lb, lg DESC, item) = 1"))
def lexicographic_select(spark, d):
    rows = given(action_table(Evidence(spark, d))).withColumnRenamed("risk", "risk_a")
    return P.joint_constraint(rows, "first_risk", SAFETY, GAIN)


# ---- the two-stage gate --------------------------------------------------------------

_GATE = [*_ROWS, "g1 AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY risk, item) AS s FROM gv)", "g2 AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY risk, item) AS safe, count(*) OVER (PARTITION BY q_id) AS pool, max(risk) FILTER (base) OVER (PARTITION BY q_id) AS base_risk FROM g1 WHERE s <= 8 OR base)",
    "g3 AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY gain DESC, risk, item) AS place, max(gain) OVER (PARTITION BY q_id) AS hi, min(gain) OVER (PARTITION BY q_id) AS lo, count(*) OVER (PARTITION BY q_id) AS m FROM g2 WHERE NOT base)", "g4 AS (SELECT a.*, coalesce(b.gain, a.gain) AS second FROM g3 a LEFT JOIN g3 b ON a.q_id = b.q_id AND b.place = 2 WHERE a.place = 1)"]


@query(S.query(_GATE, "SELECT q_id, item, gain AS score, risk, round(CASE WHEN hi > lo THEN (gain - second) / (hi - lo) ELSE 0 END, 9)::DOUBLE AS margin, pool, base_risk, round((safe - 1) / greatest(1, pool - 1), 9)::DOUBLE AS risk_place, round(risk - base_risk, 9) AS risk_change FROM g4"))
def gate_features(spark, d):
    return P.gate_rows(given(action_table(Evidence(spark, d))).select("q_id", "item", "base", "risk", F.col("gain").alias("score")))


GATE_FEATURES = ["score", "margin", "risk", "base_risk", "risk_place", "risk_change"]


def first_stage(rows, **options):
    """Ranker scores of every action under every outer fold, by models that saw neither fold."""
    groups = stored(boosting.grouped(rows.filter(~F.col("base")), ACTION_FEATURES, "tier", "item"), "ranker")
    models = boosting.fit(groups, len(ACTION_FEATURES), boosting.left_out_pairs(FOLDS), objectives.lambdarank, **options)
    return boosting.scored(groups, len(ACTION_FEATURES), models, linear.by_outer([m.without for m in models], FOLDS))


def two_stage(rows, share=0.5, **options):
    """Changes that a gate lets through: it is fitted, in each outer fold's complement, on winners of inner models alone."""
    scores = first_stage(rows, **options).select("q_id", "item", "outer", F.round("model_score", 9).alias("score"))
    heads = dual_heads(rows).select("q_id", "item", "outer", "risk")
    every = rows.select("q_id", "item", "fold", "base", "cit", "f1", "tier").join(heads, ["q_id", "item"]).join(scores, ["q_id", "item", "outer"], "left")
    gate = stored(P.gate_rows(every, keys=("q_id", "fold", "outer")).join(rows.select("q_id", "item", "cit", "f1", (F.col("tier") == 2).cast("int").alias("strict")), ["q_id", "item"]), "gate")
    # A gate row belongs to an outer fold; its gate model is left without that fold, and sees rows of that outer fold alone.
    groups = stored(boosting.grouped(gate, GATE_FEATURES, "strict", "item", outer="outer"), "gate_groups")
    models = boosting.fit(groups, len(GATE_FEATURES), [boosting.Model(frozenset([k]), outer=k) for k in range(FOLDS)], objectives.logistic, trees=8, least=3, balanced=True)
    by = {f: [(o, o) for o in range(FOLDS)] for f in range(FOLDS)}
    own = stored(boosting.scored(groups, len(GATE_FEATURES), models, by).withColumn("utility", F.round("model_score", 9)), "gated")
    thresholds = P.coverage_thresholds(own.filter("outer <> fold"), share, "outer")
    return P.abstaining(own.filter("outer = fold"), thresholds, "outer").join(rows.select("q_id", "item", "cit", "f1"), ["q_id", "item"])


@query(None)
def two_stage_gate_cv(spark, d):
    chosen = two_stage(action_table(Evidence(spark, d)), trees=6)
    return chosen.groupBy("fold").agg(F.count(F.lit(1)).alias("changed"), F.sum("cit").alias("citation_change"), F.round(F.avg("f1"), 6).alias("f1_change"), F.count_if(F.col("f1") < -actions.TOLERANCE).alias("f1_losses"))


# ---- group-wise rankers ---------------------------------------------------------------

_SHARE = "sf AS MATERIALIZED (SELECT q_id, item, fold, tier, gain, gain * 4 AS score, CASE WHEN tier = 2 THEN 2 WHEN base THEN 1 WHEN tier = 1 THEN 0 ELSE -1 END AS label FROM gv), sn AS (SELECT *, count(*) FILTER (label = 2) OVER w AS ns, count(*) FILTER (label >= 0) OVER w AS nf, count(*) FILTER (label IN (1, 2)) OVER w AS np FROM sf WINDOW w AS (PARTITION BY q_id)), sg AS MATERIALIZED (SELECT *, round(((CASE WHEN ns > 0 THEN (label = 2)::INT::DOUBLE / ns ELSE (label = 1)::INT::DOUBLE END) + 0.5::DOUBLE * (label >= 0)::INT::DOUBLE / nf + 0.25::DOUBLE * (label IN (1, 2))::INT::DOUBLE / np) / 1.75::DOUBLE, 9) AS target FROM sn), so AS MATERIALIZED (SELECT *, exp(score - max(score) OVER w) / sum(exp(score)) OVER w * exp(max(score) OVER w) AS probability FROM sg WINDOW w AS (PARTITION BY q_id))"


def targets(rows):
    """The mixture target of every action: strict gains, the baseline, harmless changes."""
    label = F.when(F.col("tier") == 2, 2).when(F.col("base"), 1).when(F.col("tier") == 1, 0).otherwise(-1)
    mix = actions.grouped_target(rows.select("q_id", F.col("item").alias("action_id"), label.alias("label")))
    return rows.join(mix.select("q_id", F.col("action_id").alias("item"), "target"), ["q_id", "item"])


@query(S.query([*_ROWS, _SHARE], "SELECT q_id, item, target, round(probability, 6) AS probability, round(probability - target, 6) AS gradient FROM so"))
def softmax_gradients(spark, d):
    rows = targets(given(action_table(Evidence(spark, d)))).withColumn("score", F.col("gain") * 4)
    return P.softmax_rows(rows).select("q_id", "item", "target", F.round("probability", 6).alias("probability"), F.round("gradient", 6).alias("gradient"))


@query(S.query([*_ROWS, _SHARE, "sl AS (SELECT q_id, fold, sum(-target * ln(probability)) AS loss, arg_max(target, (probability, item)) AS caught FROM so GROUP BY q_id, fold)"], "SELECT fold, count(*) AS questions, round(avg(loss), 6) AS loss, round(avg(caught), 6) AS caught FROM sl GROUP BY fold"))
def softmax_loss(spark, d):
    rows = targets(given(action_table(Evidence(spark, d)))).withColumn("score", F.col("gain") * 4)
    return P.softmax_loss(P.softmax_rows(rows), ["fold"])


def _with_scores(rows, features, label, objective, **options):
    scores = boosting.out_of_fold(rows, features, label, "item", FOLDS, objective, **options)
    return rows.join(scores.select("q_id", "item", F.round("model_score", 9).alias("score")), ["q_id", "item"])


@query(None)
def softmax_ranker_cv(spark, d):
    """Held-out loss of each fold under equal scores and under boosted trees of the grouped softmax objective."""
    rows = stored(targets(action_table(Evidence(spark, d))), "targets")
    fitted = _with_scores(rows, ACTION_FEATURES, "target", objectives.softmax)
    before = P.softmax_loss(P.softmax_rows(rows.withColumn("score", F.lit(0.0))), ["fold"]).select("fold", "questions", F.col("loss").alias("loss_before"))
    after = P.softmax_loss(P.softmax_rows(fitted), ["fold"]).select("fold", F.col("loss").alias("loss_after"), "caught")
    return before.join(after, "fold")


_LAMBDA = [*_ROWS, f"lr AS MATERIALIZED (SELECT q_id, item, tier, gain AS score, ([0.0, 1.0, 4.0])[tier + 1]::DOUBLE AS g, row_number() OVER (PARTITION BY q_id ORDER BY gain DESC, item) AS rank, max(gain) OVER (PARTITION BY q_id) = min(gain) OVER (PARTITION BY q_id) AS flat FROM gv)",
    f"li AS (SELECT q_id, sum(g / log2(i + 1)) AS ideal FROM (SELECT q_id, g, row_number() OVER (PARTITION BY q_id ORDER BY g DESC, item) AS i FROM lr) WHERE i <= {DEPTH} GROUP BY q_id)",
    f"lp AS MATERIALIZED (SELECT a.q_id, a.item AS i, b.item AS k, CASE WHEN a.tier > b.tier THEN 1 ELSE -1 END AS s, 1 / (1 + exp((CASE WHEN a.tier > b.tier THEN 1 ELSE -1 END) * (a.score - b.score))) AS p, abs(a.g - b.g) * abs(1 / log2(a.rank + 1) - 1 / log2(b.rank + 1)) / ideal / CASE WHEN a.flat THEN 1.0 ELSE 0.01 + abs(a.score - b.score) END AS delta FROM lr a JOIN lr b ON a.q_id = b.q_id AND a.rank < b.rank AND a.rank <= {DEPTH} AND a.tier <> b.tier JOIN li ON li.q_id = a.q_id WHERE ideal > 0)",
    "lt AS (SELECT q_id, 2 * sum(p * delta) AS total FROM lp GROUP BY q_id)", "ls AS (SELECT q_id, item, sum(g) AS g, sum(h) AS h FROM (SELECT q_id, i AS item, -s * p * delta AS g, p * (1 - p) * delta AS h FROM lp UNION ALL SELECT q_id, k, s * p * delta, p * (1 - p) * delta FROM lp) GROUP BY q_id, item)"]


@query(S.query(_LAMBDA, "SELECT q_id, item, tier, rank, round(coalesce(ls.g, 0) * coalesce(CASE WHEN total > 0 THEN log2(1 + total) / total END, 1), 6)::DOUBLE AS gradient, round(coalesce(h, 0) * coalesce(CASE WHEN total > 0 THEN log2(1 + total) / total END, 1), 6)::DOUBLE AS curvature FROM lr LEFT JOIN ls USING (q_id, item) LEFT JOIN lt USING (q_id)"))
def lambda_gradients(spark, d):
    return P.lambda_rows(given(action_table(Evidence(spark, d))).withColumn("score", F.col("gain")), GAINS, DEPTH)


@query(None)
def lambdamart_cv(spark, d):
    """Held-out nDCG of each fold: LambdaMART, the same trees fitted row by row, and the order of the sentences' scores."""
    rows = stored(action_table(Evidence(spark, d)), "tiers")
    ranked = _with_scores(rows, ACTION_FEATURES, "tier", objectives.lambdarank)
    pointwise = _with_scores(rows, ACTION_FEATURES, "tier", objectives.squared)
    plain = rows.withColumn("score", F.col("score_sum"))
    get = lambda t, name: P.ndcg(t, GAINS, DEPTH, ["fold"]).select("fold", "questions", F.col("ndcg").alias(name))
    return get(ranked, "lambdamart").join(get(pointwise, "pointwise").drop("questions"), "fold").join(get(plain, "score_order").drop("questions"), "fold")


# ---- heads of the F1 change -----------------------------------------------------------------

ORDINAL, QUANTILE = (-0.05, -actions.TOLERANCE, 0.05), 0.25


def relative(rows):
    """Features against their question: z-scores of three of them."""
    from pyspark.sql import Window as W

    w = W.partitionBy("q_id")
    for c in ("score_sum", "n_tokens", "n_overlap"):
        dev = F.stddev_pop(c).over(w)
        rows = rows.withColumn(f"{c}_z", F.round(F.when(dev > 0, (F.col(c) - F.avg(c).over(w)) / dev).otherwise(F.lit(0.0)), 6))
    return rows


def ordinal_heads(rows, features):
    """Out of fold: the chances that F1 changes by less than each threshold, never falling from one to the next."""
    names = [f"below_{i}" for i in range(len(ORDINAL))]
    for n, t in zip(names, ORDINAL):
        rows = rows.withColumn(n, (F.col("f1") < t).cast("int"))
    table = stored(linear.design(rows, features, names, ["q_id", "item", "f1"]), "ordinal")
    models = linear.left_out(FOLDS)
    weights = linear.fit(table, len(features), len(names), models)
    scored = linear.scored(table, weights, len(features), linear.by_fold(models, FOLDS))
    chances = F.array(*[F.array_max(F.slice("model_scores", 1, i + 1)) for i in range(len(names))])
    return scored.select("q_id", "item", "fold", "f1", chances.alias("chances"))


def quantile_head(rows, features, **options):
    """Out of fold: the lower quantile of the F1 change, by boosted trees under the pinball loss."""
    scores = boosting.out_of_fold(rows, features, "f1", "item", FOLDS, objectives.pinball(QUANTILE), **options)
    return scores.select("q_id", "item", "fold", F.col("y").alias("f1"), F.round("model_score", 9).alias("low"))


@query(None)
def f1_heads_cv(spark, d):
    """Calibration by fold: mean chance against share for each ordinal threshold, and how many changes lie below the quantile."""
    rows = stored(relative(action_table(Evidence(spark, d)).filter(~F.col("base"))), "relative")
    features = ACTION_FEATURES + RELATIVE
    o, q = ordinal_heads(rows, features), quantile_head(rows, features)
    long = o.select("fold", "f1", F.posexplode("chances").alias("i", "p"))
    edges = F.element_at(F.array(*[F.lit(float(t)) for t in ORDINAL]), F.col("i") + 1)
    ordinal = long.groupBy("fold", F.concat(F.lit("below_"), F.col("i").cast("string")).alias("head")).agg(F.round(F.avg("p"), 6).alias("predicted"), F.round(F.avg((F.col("f1") < edges).cast("int")), 6).alias("observed"), F.count(F.lit(1)).alias("n"))
    low = q.groupBy("fold", F.lit("quantile").alias("head")).agg(F.lit(QUANTILE).alias("predicted"), F.round(F.avg((F.col("f1") < F.col("low")).cast("int")), 6).alias("observed"), F.count(F.lit(1)).alias("n"))
    return ordinal.unionByName(low)


# ---- what the chosen actions turned out to be -----------------------------------------------

RULES = ("dominance", "first_risk", "worst_risk")
_ORDERS = {"dominance": "dominators, greatest(la, lb), la + lb, lg DESC, item", "first_risk": "la, lb, lg DESC, item", "worst_risk": "greatest(la, lb), la + lb, lg DESC, item"}
_FAMILY = "CASE WHEN family LIKE 'delete_slot%' THEN 'delete' WHEN family LIKE 'replace_slot%' THEN 'replace' ELSE family END"


@query(S.query([*_JOINT, *[f"w{i} AS (SELECT '{r}' AS rule, q_id, item FROM jl JOIN dm USING (q_id, item) QUALIFY row_number() OVER (PARTITION BY q_id ORDER BY {o}) = 1)" for i, (r, o) in enumerate(_ORDERS.items())], "wa AS (" + " UNION ALL ".join(f"SELECT * FROM w{i}" for i in range(len(_ORDERS))) + ")",
    f"wo AS (SELECT rule, {corpus._OUT} AS outcome, {_FAMILY} AS family, base, tier, f1, best FROM wa JOIN (SELECT *, max(tier) OVER (PARTITION BY q_id) AS best FROM ar) ar USING (q_id, item))"],
    "SELECT rule, outcome, family, count(*) AS n, count(*) FILTER (tier = 0) AS unsafe, count(*) FILTER (best = 2 AND tier < 2) AS missed_gain, sum(round(10000 * f1)::BIGINT) / 10000.0::DOUBLE AS f1_change FROM wo GROUP BY ALL"))
def winner_attribution(spark, d):
    """What each rule's winners did: outcome and family, unsafe winners, and strict gains that were there and not taken."""
    from pyspark.sql import Window as W

    rows = stored(action_table(Evidence(spark, d)), "rows")
    scores = given(rows).withColumnRenamed("risk", "risk_a")
    won = None
    for rule in RULES:
        part = P.joint_constraint(scores, rule, SAFETY, GAIN).select(F.lit(rule).alias("rule"), "q_id", "item")
        won = part if won is None else won.unionByName(part)
    family = F.when(F.col("family").startswith("delete_slot"), "delete").when(F.col("family").startswith("replace_slot"), "replace").otherwise(F.col("family"))
    known = rows.withColumn("best", F.max("tier").over(W.partitionBy("q_id"))).select("q_id", "item", actions.outcome(F.col("cit"), F.col("f1")).alias("outcome"), family.alias("family"), "tier", "best", "f1")
    return won.join(known, ["q_id", "item"]).groupBy("rule", "outcome", "family").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("tier") == 0).alias("unsafe"), F.count_if((F.col("best") == 2) & (F.col("tier") < 2)).alias("missed_gain"), (F.sum(F.round(F.col("f1") * 10_000).cast("bigint")) / F.lit(10_000.0)).alias("f1_change")
    )
