"""Queries of composition under citation limits, guarded rewrites, swaps, splits, grids and comparisons of runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import metrics as M
from lodestone.functions import text as T
from lodestone.operators import answer, compose, evaluate, evidence, fuse
from lodestone.plans import sql as S
from lodestone.plans.evidence import _LABELS, BM25_ROWS, CASES, EV, RANKED, ROUTES, Evidence, cases, placed, rows_sql
from lodestone.plans.retrieval import _POOL, _WEIGHTED, ALL, FIT, POOL, SEC, TITLE, Setting, fit_sql, prefix_pool, with_fit
from lodestone.plans.scalars import signal_sql
from lodestone.sources import tables as R

QUERIES, ORACLES = {}, {}


def query(oracle: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


#: Rules by name: power of the rank's logarithm, and sentences of one document.
SPECS = [("rule_score_rank_p000_cap1", 0.0, 1), ("rule_score_rank_p025_cap1", 0.25, 1), ("rule_score_rank_p050_cap1", 0.5, 1), ("rule_score_rank_p100_cap1", 1.0, 1), ("rule_score_rank_p025_cap3", 0.25, 3), ("rule_score_rank_p050_cap3", 0.5, 3), ("rule_score_rank_p100_cap3", 1.0, 3)]
_THREE = [S.BM25, EV, rows_sql("ev", "r", False), placed("r_s", "base", "p", 3)]
_VALUES = ", ".join(f"('{n}', {p}::DOUBLE, {c})" for n, p, c in SPECS)
_RULES = [*_THREE, f"e1 AS (SELECT policy, cap, q_id, doc_id, pos, rank, sentence, round(score / pow(log2(rank + 1), power), 9) AS key FROM p, (VALUES {_VALUES}) v(policy, power, cap))", "e2 AS (SELECT * FROM e1 QUALIFY row_number() OVER (PARTITION BY policy, q_id, doc_id ORDER BY key DESC, rank, doc_id, sentence) <= cap)"]


def _candidates(e, cap=3):
    return evidence.bm25_ranked(e.rows(), cap)


@query(S.query(_RULES, "SELECT policy, q_id, doc_id, pos, row_number() OVER (PARTITION BY policy, q_id ORDER BY key DESC, rank, doc_id, sentence) AS slot FROM e2 QUALIFY slot <= 3"))
def citation_aware_compose(spark, d):
    return compose.score_rank_policies(_candidates(Evidence(spark, d)), SPECS)


@query(S.query([*_THREE, "l1 AS (SELECT *, CASE WHEN rank <= 3 AND row_number() OVER (PARTITION BY q_id, rank ORDER BY place) = 1 THEN rank END AS lead FROM p)", "l2 AS (SELECT * FROM l1 QUALIFY row_number() OVER (PARTITION BY q_id, doc_id ORDER BY lead NULLS LAST, place) <= 1)"], "SELECT q_id, doc_id, pos, row_number() OVER (PARTITION BY q_id ORDER BY lead NULLS LAST, place) AS slot FROM l2 QUALIFY slot <= 3"))
def context_rank_coverage(spark, d):
    return compose.rank_coverage(_candidates(Evidence(spark, d)))


def _modelled(rows):
    """A score beside the selector's: the covered share of a sentence's terms and its answer signal."""
    return rows.withColumn("model", F.round(F.size("overlap") / F.size("terms") + T.answer_signal(F.col("sentence")) / 10, 6))


_MODEL = f"round(len(overlap) / len(terms)::DOUBLE + {signal_sql('sentence')} / 10, 6)"
_LEAD = [
    *BM25_ROWS, ROUTES, f"md AS MATERIALIZED (SELECT *, {_MODEL} AS model FROM p)", "bs1 AS (SELECT * FROM md QUALIFY row_number() OVER (PARTITION BY q_id ORDER BY model DESC, place) = 1)",
    "bl1 AS (SELECT q_id, max(model) FILTER (place = 1) AS m1, list({'p': place, 'd': doc_id, 'r': rank} ORDER BY place) FILTER (place <= 3) AS plain FROM md GROUP BY q_id)",
    "pr1 AS (SELECT b.q_id, b.place, b.score, route, round(b.model - m1, 6) AS margin, plain, list_concat([{'p': b.place, 'd': b.doc_id, 'r': b.rank}], list_filter(plain, lambda x: x.p <> b.place))[1:3] AS proposed FROM bs1 b JOIN bl1 USING (q_id) JOIN qr USING (q_id))",
    "rs1 AS (SELECT *, CASE WHEN place = 1 THEN 'model_selected_top_candidate' WHEN place > 5 THEN 'selected_rank_exceeds_limit' WHEN margin < 0 THEN 'score_margin_below_min' WHEN score < 20 THEN 'candidate_score_gte_20_blocked' WHEN len(list_filter(proposed, lambda x: x.r > 3)) > 0 THEN 'selected_citation_rank_exceeds_limit' WHEN len(list_filter(plain, lambda x: x.r > 3 AND NOT list_contains(list_transform(proposed, lambda y: y.d), x.d))) > 0 THEN 'baseline_out_of_rank_document_dropped' ELSE 'candidate_score_gte_20_accepted' END AS reason FROM pr1)",
]


@query(S.query(_LEAD, "SELECT q_id, CASE WHEN reason = 'candidate_score_gte_20_accepted' THEN 'replace_with_model_candidate' ELSE 'keep_top_candidate' END AS action, reason, place AS lead, margin, array_to_string(list_transform(CASE WHEN reason = 'candidate_score_gte_20_accepted' THEN proposed ELSE plain END, lambda x: x.p), ',') AS kept FROM rs1"))
def score_guarded_compose(spark, d):
    e = Evidence(spark, d)
    return compose.score_guarded(_modelled(evidence.bm25_ranked(e.rows())), e.routes(), min_score=20.0)


GRID = compose.policy_grid([2, 3, 5], [0.0, 0.05, 0.2], [None, 40.0])
_GRID_SQL = ", ".join(f"('{n}', {r}, {m}::DOUBLE, {'NULL' if p is None else p}::DOUBLE)" for n, r, m, p in GRID)
_SEARCH = [*_LABELS, f"ml AS MATERIALIZED (SELECT *, {_MODEL} AS model FROM bl)", "mb AS (SELECT * FROM ml QUALIFY row_number() OVER (PARTITION BY q_id ORDER BY model DESC, place) = 1)", "m1 AS (SELECT q_id, f1, score, model FROM ml WHERE place = 1)", f"mg AS (SELECT policy, m1.f1 AS old, CASE WHEN mb.place > 1 AND mb.place <= g.place AND round(mb.model - m1.model, 6) >= margin AND (protect IS NULL OR m1.score < protect) THEN mb.f1 ELSE m1.f1 END AS new, mb.place > 1 AND mb.place <= g.place AND round(mb.model - m1.model, 6) >= margin AND (protect IS NULL OR m1.score < protect) AS ok FROM mb JOIN m1 USING (q_id), (VALUES {_GRID_SQL}) g(policy, place, margin, protect))"]


@query(S.query(_SEARCH, "SELECT policy, count(*) AS questions, count(*) FILTER (ok) AS changed, round(sum(new), 4) AS total_f1, count(*) FILTER (new > old) AS improved, count(*) FILTER (new < old) AS regressed FROM mg GROUP BY policy"))
def policy_search(spark, d):
    e = Evidence(spark, d)
    rows = _modelled(evidence.bm25_ranked(e.rows())).join(e.asked.select("q_id", T.tokens(F.col("text")).alias("gt")), "q_id")
    return compose.policy_search(rows.withColumn("f1", F.round(M.token_f1(T.tokens(F.col("sentence")), F.col("gt")), 4)), GRID)


_SWAPPED = [
    S.BM25, FIT, "a AS (SELECT q_id, row_number() OVER (PARTITION BY q_id ORDER BY fit, rank DESC, doc_id) AS i, doc_id AS out_doc, fit AS o FROM fits WHERE rank <= 10 QUALIFY i <= 3)", "c AS (SELECT q_id, row_number() OVER (PARTITION BY q_id ORDER BY fit DESC, rank, doc_id) AS i, doc_id AS in_doc, fit AS n FROM fits WHERE rank > 10 QUALIFY i <= 3)",
    "sw1 AS (SELECT * FROM a JOIN c USING (q_id, i) WHERE round(n - o, 6) > 0.5)", "cx1 AS (SELECT q_id, doc_id, rank AS was FROM fits f WHERE rank <= 10 AND NOT EXISTS (SELECT 1 FROM sw1 s WHERE s.q_id = f.q_id AND s.out_doc = f.doc_id) OR EXISTS (SELECT 1 FROM sw1 s WHERE s.q_id = f.q_id AND s.in_doc = f.doc_id))",
]


@query(S.query(_SWAPPED, "SELECT q_id, doc_id, was, row_number() OVER (PARTITION BY q_id ORDER BY was, doc_id) AS rank FROM cx1 QUALIFY rank <= 10"))
def swap_materialise(spark, d):
    c = with_fit(Setting(spark, d))
    return compose.swap_materialised(c.select("q_id", "doc_id", "rank"), fuse.swaps(c.withColumnRenamed("fit", "model")), 0.5)


_CONTRACT = "pl AS (SELECT q_id, doc_id, row_number() OVER (PARTITION BY q_id ORDER BY part, was) AS rank FROM pool QUALIFY rank <= 400), pq AS (SELECT q_id, count(*) AS n, count(DISTINCT rank) AS r, count(DISTINCT doc_id) AS d, min(rank) AS low, max(rank) AS high FROM pl GROUP BY q_id)"


@query(S.query([*ALL, _WEIGHTED, *_POOL, _CONTRACT], "SELECT count(*) AS pools, count(*) FILTER (low < 1) AS not_positive, count(*) FILTER (high > 400) AS too_deep, count(*) FILTER (r < n) AS repeated_ranks, count(*) FILTER (d < n) AS repeated_documents FROM pq"))
def pool_contract(spark, d):
    return compose.pool_contract(prefix_pool(spark, d), POOL)


RATIOS = {"train": 0.7, "dev": 0.15, "test": 0.15}
_SHARE = {"dev": 1, "test": 2, "train": 3}  # places of the names in order
_FILLED = "list_min([" + ", ".join(f"{{'s': load[{i}] / greatest(total * {RATIOS[n]}::DOUBLE, 1.0), 'n': load[{i}], 'at': {i}}}" for n, i in _SHARE.items()) + "]).at"
_SPLIT = f"""g AS (SELECT source, count(*) AS n, row_number() OVER (ORDER BY sha256('split|' || coalesce(source, '')), source NULLS FIRST) AS i, (SELECT count(*) FROM documents) AS total FROM documents GROUP BY source),
st AS (SELECT 0::BIGINT AS i, [0, 0, 0]::BIGINT[] AS load, 0 AS spot UNION ALL SELECT g.i, list_transform(load, lambda v, j: CASE WHEN j = {_FILLED} THEN v + g.n ELSE v END), {_FILLED} FROM st JOIN g ON g.i = st.i + 1),
sp AS (SELECT source, (['dev', 'test', 'train'])[spot] AS split FROM st JOIN g USING (i))"""


def _split(spark, d):
    groups = R.table(spark, d, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    return compose.ratio_split(groups, "source", "n", RATIOS)


@query(f"WITH RECURSIVE {_SPLIT} SELECT source, split FROM sp")
def ratio_split(spark, d):
    return _split(spark, d)


def _assigned(spark, d):
    s = _split(spark, d).withColumnRenamed("source", "_s")
    docs = R.table(spark, d, "documents").select("doc_id", "source", "lang")
    return docs.join(s, docs["source"].eqNullSafe(s["_s"])).drop("_s")


@query(f"WITH RECURSIVE {_SPLIT}, asg AS (SELECT doc_id, source, split FROM documents d JOIN sp USING (source)) SELECT 'groups_do_not_cross_splits' AS check, count(*) AS observed, count(*) = 0 AS passed FROM (SELECT source FROM asg GROUP BY source HAVING count(DISTINCT split) > 1) UNION ALL SELECT 'held_documents_only_in_test', count(*), count(*) = 0 FROM asg WHERE split <> 'test' AND doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def split_leakage_checks(spark, d):
    held = R.table(spark, d, "labels").filter("toxic = 1").select("doc_id").distinct()
    return compose.split_checks(_assigned(spark, d), "source", held)


@query(f"WITH RECURSIVE {_SPLIT}, asg AS (SELECT doc_id, lang, source, split FROM documents d JOIN sp USING (source)) SELECT split, \"column\", value, count(*) AS n, count(DISTINCT doc_id) AS ids FROM (SELECT split, doc_id, 'lang' AS \"column\", lang AS value FROM asg UNION ALL SELECT split, doc_id, 'source', source FROM asg) GROUP BY ALL")
def split_summary(spark, d):
    return compose.split_summary(_assigned(spark, d), ["lang", "source"])


_LIST = [S.BM25, S.GOLD, TITLE, "lr AS (SELECT 'document' AS method, q_id, rank FROM gold LEFT JOIN (SELECT q_id, doc_id AS gold, rank FROM br WHERE rank <= 50) USING (q_id, gold) UNION ALL SELECT 'title', q_id, rank FROM gold LEFT JOIN (SELECT q_id, doc_id AS gold, rank FROM tr WHERE rank <= 50) USING (q_id, gold))"]
_RECALL = ", ".join([f"round(count(*) FILTER (rank <= {k}) / nullif(count(rank), 0), 6) AS conditional_recall_{k}" for k in (1, 5, 10, 20)] + [f"round(count(*) FILTER (rank <= {k}) / count(*), 6) AS recall_{k}" for k in (1, 5, 10, 20)])


@query(S.query(_LIST, f"SELECT method, count(rank) AS found, round(avg(1 / rank), 6) AS mrr, round(avg(rank), 6) AS mean_rank, round(median(rank), 6) AS median_rank, {_RECALL}, round(coalesce(sum(1 / log2(rank + 1)) FILTER (rank <= 20), 0) / count(*), 6) AS ndcg FROM lr GROUP BY method"))
def listwise_metrics(spark, d):
    s = Setting(spark, d)
    g = s.gold
    of = lambda ranked, name: evaluate.gold_ranks(g.select("q_id"), g, ranked).select(F.lit(name).alias("method"), "q_id", "rank")
    return compose.listwise_metrics(of(s.bm25(50), "document").unionByName(of(s.title(50), "title")))


_LOOSE = "(ans.n = 0 OR best < 20.0 OR first_rank > 3)"
_CHANGED = [*CASES, f"ch1 AS (SELECT cs.answerable, final_refused AS br, {_LOOSE} AS orf, CASE WHEN final_refused THEN 0 ELSE f1 END AS bf, CASE WHEN {_LOOSE} THEN 0 ELSE f1 END AS of_ FROM cs JOIN ans USING (q_id))"]


@query(S.query(_CHANGED, "SELECT CASE WHEN NOT answerable AND br AND NOT orf THEN 'unanswerable_refusal_regression' WHEN NOT answerable AND NOT br AND orf THEN 'unanswerable_refusal_improvement' WHEN NOT answerable THEN 'unanswerable_changed_answer' WHEN round(of_ - bf, 6) > 0 THEN 'answerable_f1_improved' WHEN round(of_ - bf, 6) < 0 THEN 'answerable_f1_regressed' ELSE 'answerable_f1_tied_changed' END AS outcome, count(*) AS n FROM ch1 WHERE br <> orf GROUP BY outcome"))
def changed_answer_risk(spark, d):
    """Strict verification (score 40, rank 1) against loose verification (score 20, rank 3)."""
    e = Evidence(spark, d)

    def run(score, rank):
        v = answer.verified(e.answers(), e.results(), score=score, rank=rank).select("q_id", F.col("final_refused").alias("refused"), F.when(F.col("final_refused"), answer.REFUSAL).otherwise(F.col("answer")).alias("answer"))
        c = cases(e).select("q_id", "answerable", "f1")
        return v.join(c, "q_id").withColumn("f1", F.when(F.col("refused"), 0.0).otherwise(F.col("f1")))

    return compose.changed_answers(run(40.0, 1), run(20.0, 3))


@query(S.query([S.BM25, TITLE, "dl AS (SELECT count(score) AS n_left, round(avg(round(score, 6)), 6) AS mean_left, min(round(score, 6)) AS min_left, max(round(score, 6)) AS max_left FROM br WHERE rank <= 50)", "dr AS (SELECT count(score) AS n_right, round(avg(round(score, 6)), 6) AS mean_right, min(round(score, 6)) AS min_right, max(round(score, 6)) AS max_right FROM tr WHERE rank <= 50)"], "SELECT *, round(mean_right - mean_left, 6) AS mean_difference FROM dl, dr"))
def pool_distribution_compare(spark, d):
    s = Setting(spark, d)
    value = lambda r: r.select(F.round("score", 6).alias("value"))
    return compose.distribution_compare(value(s.bm25(50)), value(s.title(50)))


def _case(x: str, pairs, otherwise: str) -> str:
    return "CASE " + " ".join(f"WHEN {x} {c} THEN '{v}'" for c, v in pairs) + f" ELSE '{otherwise}' END"


_RATIO_SQL = _case("ratio", [("= 'inf'::DOUBLE", "ratio_document_score_zero"), (">= 1.6", "ratio_gte_1_60"), (">= 1.45", "ratio_1_45_to_1_59"), (">= 1.2", "ratio_1_20_to_1_44"), (">= 1.1", "ratio_1_10_to_1_19")], "ratio_lt_1_10")
_GAP_SQL = _case("gap", [("IS NULL", "not_applicable"), ("< 0.05", "gap_0_00_to_0_04"), ("< 0.2", "gap_0_05_to_0_19"), ("< 0.4", "gap_0_20_to_0_39")], "gap_0_40_plus")
_LEN_SQL = _case("n_q", [("< 6", "lt_6"), ("< 8", "6_7"), ("< 10", "8_9"), ("< 20", "10_19")], "ge_20")
_OVER_SQL = _case("share", [("<= 0.1", "le_0_10"), ("<= 0.2", "0_10_0_20"), ("<= 0.3", "0_20_0_30"), ("<= 0.5", "0_30_0_50")], "gt_0_50")
_SIGNAL = [S.BM25, SEC, fit_sql(10), "sg1 AS (SELECT f.q_id, f.doc_id, CASE WHEN coalesce(s.score, 0) <= 0 THEN 0 ELSE round(s.score / f.score, 6) END::DOUBLE AS ratio, CASE WHEN s.rank IS NOT NULL THEN round(abs(1 / f.rank - 1 / s.rank), 6) END AS gap, n_q, round(shared / n_q::DOUBLE, 6) AS share FROM fits f LEFT JOIN (SELECT * FROM sr WHERE rank <= 50) s ON s.q_id = f.q_id AND s.doc_id = f.doc_id)"]


@query(S.query(_SIGNAL, f"SELECT q_id, doc_id, {_RATIO_SQL} AS ratio_bucket, {_GAP_SQL} AS gap_bucket, {_LEN_SQL} AS length_bucket, {_OVER_SQL} AS overlap_bucket FROM sg1"))
def signal_buckets(spark, d):
    """Buckets of the section signal, rank gap, question length and overlap of the first ten documents."""
    s = Setting(spark, d)
    sec = s.section(50).select("q_id", "doc_id", F.col("rank").alias("s_rank"), F.col("score").alias("s_score"))
    q = s.asked.select("q_id", F.array_distinct(T.tokens(F.col("text"))).alias("qt"))
    t = s.docs.select("doc_id", F.array_distinct(T.tokens(F.col("text"))).alias("dt"))
    j = s.bm25(10).join(sec, ["q_id", "doc_id"], "left").join(t, "doc_id").join(q, "q_id")
    ratio = F.round(M.score_ratio(F.coalesce("s_score", F.lit(0.0)), F.col("score")), 6)
    gap = F.round(F.abs(1 / F.col("rank") - 1 / F.col("s_rank")), 6)
    share = F.round(M.overlap_ratio(F.col("qt"), F.col("dt")), 6)
    return j.select("q_id", "doc_id", M.ratio_bucket(ratio).alias("ratio_bucket"), M.gap_bucket(gap).alias("gap_bucket"), M.query_length_bucket(F.size("qt")).alias("length_bucket"), M.overlap_bucket(share).alias("overlap_bucket"))
