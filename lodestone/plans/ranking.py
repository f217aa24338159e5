"""Queries of learned context selection and action ranking.

Models have no SQL; what goes into them and what is decided from given scores has.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import boosting, context, objectives
from lodestone.operators import fuse
from lodestone.operators.retrieve import ranked
from lodestone.plans import sql as S
from lodestone.plans.evidence import CASES, Evidence, _INSIDE, _bucketed
from lodestone.plans.retrieval import ALL, WEIGHTS, Setting, _WEIGHTED
from lodestone.sources.scratch import stored

QUERIES, ORACLES = {}, {}
FOLDS, PROTECT = 4, 5
CHANNELS = ["document", "section", "title"]


def query(oracle: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def fold(q_id="q_id"):
    return (F.col(q_id).cast("bigint") % FOLDS).cast("int")


def context_rows(s):
    """The fused pool of every question with features."""
    channels = s.channels()
    pool = stored(ranked(fuse.rrf(channels, WEIGHTS), context.POOL_DEPTH), "pool")
    return context.features(pool, channels, s.found(pool), s.asked, CHANNELS).withColumn("fold", fold())


_FEATURES = [
    *ALL, _WEIGHTED, S.ranks("ws", "wr", context.POOL_DEPTH),
    f"dq AS MATERIALIZED (SELECT q_id, list_distinct({S.toks('text')}) AS qt, list_distinct(regexp_extract_all(lower(text), {S.lit(S.T.SPECIAL)})) AS qs FROM ques)",
    f"dd AS MATERIALIZED (SELECT doc_id, list_distinct({S.toks('title')}) AS tt, list_distinct({S.toks('text')}) AS bt, list_distinct({S.toks('title || chr(10) || text[1:' + str(context.SHORT_CHARS) + ']')}) AS st, list_distinct(regexp_extract_all(lower(title), {S.lit(S.T.SPECIAL)})) AS ts, list_distinct(regexp_extract_all(lower(text), {S.lit(S.T.SPECIAL)})) AS bs FROM docs)",
    "cm AS MATERIALIZED (SELECT q_id, doc_id, " + ", ".join(f"min(rank) FILTER (channel = '{c}') AS {c}" for c in CHANNELS) + " FROM ch GROUP BY q_id, doc_id)",
    "pf AS MATERIALIZED (SELECT p.q_id, p.doc_id, p.rank, p.score AS rrf_score, cm.document, cm.section, cm.title, len(qt) AS n_q, len(list_intersect(qt, st)) AS o, len(list_intersect(qt, tt)) AS ot, len(list_intersect(qt, bt)) AS ob, len(list_intersect(qt, list_concat(tt, bt))) AS oa, len(bt) AS nb, len(list_intersect(qs, list_concat(ts, bs))) AS sa, len(list_intersect(qs, ts)) AS st FROM wr p JOIN dq USING (q_id) JOIN dd USING (doc_id) LEFT JOIN cm ON cm.q_id = p.q_id AND cm.doc_id = p.doc_id)",
    "cf AS MATERIALIZED (SELECT q_id, doc_id, rank, rrf_score, round(1 / rank, 6) AS baseline_inverse, o AS overlap_count, round(o / n_q, 6) AS overlap_ratio, round(o + o / n_q + 0.35::DOUBLE / log2(rank + 1), 6) AS overlap_score, (document IS NOT NULL)::INT + (section IS NOT NULL)::INT + (title IS NOT NULL)::INT AS route_hits, round(greatest(coalesce(1 / document, 0), coalesce(1 / section, 0), coalesce(1 / title, 0)), 6) AS best_inverse, ot AS title_overlap, round(oa / n_q, 6) AS coverage, round(ob / n_q, 6) AS body_coverage, round(least(nb / 1000.0::DOUBLE, 5.0), 6) AS length_bucket, sa AS special_matches, st AS title_special, coalesce((document <= 10)::INT, 0) AS in_top10, round(coalesce(1 / document, 0), 6) AS document_inverse, round(coalesce(1 / section, 0), 6) AS section_inverse, round(coalesce(1 / title, 0), 6) AS title_inverse, (q_id::BIGINT % 4)::INT AS fold FROM pf)",
]


@query(S.query(_FEATURES, "SELECT * FROM cf"))
def context_features(spark, d):
    return context_rows(Setting(spark, d))


_HARD = [
    *_FEATURES, S.GOLD, f"lb AS MATERIALIZED (SELECT cf.*, coalesce(doc_id = gold, false)::INT AS is_gold FROM cf LEFT JOIN gold USING (q_id) WHERE rank > {PROTECT})",
    "oth AS MATERIALIZED (SELECT * FROM lb WHERE is_gold = 0 AND q_id IN (SELECT q_id FROM lb WHERE is_gold = 1))",
    f"hn AS MATERIALIZED (SELECT q_id, doc_id, string_agg(src, '+' ORDER BY src) AS windows FROM (SELECT q_id, doc_id, 'rank' AS src FROM oth QUALIFY row_number() OVER (PARTITION BY q_id ORDER BY rank, doc_id) <= {context.HARD} UNION ALL SELECT q_id, doc_id, 'overlap' FROM oth QUALIFY row_number() OVER (PARTITION BY q_id ORDER BY overlap_score DESC, rank, doc_id) <= {context.HARD}) GROUP BY q_id, doc_id)",
]


def _labelled(s):
    return context.labelled(stored(context_rows(s), "context"), s.gold, PROTECT)


@query(S.query(_HARD, "SELECT q_id, doc_id, rank, overlap_score, windows FROM hn JOIN lb USING (q_id, doc_id)"))
def hard_negatives(spark, d):
    return context.hard_negatives(_labelled(Setting(spark, d))).select("q_id", "doc_id", "rank", "overlap_score", "windows")


_DIFFS = ["rrf_score", "overlap_score", "coverage", "title_overlap"]


@query(S.query([*_HARD, "ps AS (SELECT * FROM lb WHERE is_gold = 1 QUALIFY row_number() OVER (PARTITION BY q_id ORDER BY rank, doc_id) = 1)"], "SELECT n.q_id, n.fold, p.doc_id AS positive, n.doc_id AS negative, l.label, " + ", ".join(f"round((2 * l.label - 1) * (p.{c} - n.{c}), 6)::DOUBLE AS {c}" for c in _DIFFS) + " FROM hn h JOIN lb n USING (q_id, doc_id) JOIN ps p ON p.q_id = n.q_id, (SELECT unnest([1, 0]) AS label) l"))
def preference_pairs(spark, d):
    return context.preference_pairs(_labelled(Setting(spark, d)), _DIFFS)


def _selection(s, score):
    """Selected contexts from out-of-fold scores against the fused ranking's first ten."""
    rows, gold = stored(context_rows(s), "context"), s.gold
    scores = score(context.labelled(rows, gold, PROTECT))
    return context.selection_report(context.protected(rows, scores, PROTECT), rows, gold, PROTECT)


@query(None)
def pairwise_context_cv(spark, d):
    return _selection(Setting(spark, d), lambda rows: context.pairwise_scored(rows, context.FEATURES, FOLDS))


def boosted_scores(rows):
    """Boosted trees on gold and hard negatives, classes balanced; every row is scored."""
    positives = rows.filter("is_gold = 1")
    train = stored(boosting.grouped(positives.unionByName(context.hard_negatives(rows).select(*rows.columns)).withColumn("one", F.lit(1.0)), context.FEATURES, "is_gold", "doc_id", "one"), "train")
    models = boosting.fit(train, len(context.FEATURES), boosting.left_out(FOLDS), objectives.logistic, trees=20, rate=0.2, balanced=True)
    every = boosting.grouped(rows, context.FEATURES, "is_gold", "doc_id")
    return boosting.scored(every, len(context.FEATURES), models).select("q_id", F.col("item").alias("doc_id"), F.round("model_score", 9).alias("model_score"))


@query(None)
def boosted_context_cv(spark, d):
    return _selection(Setting(spark, d), boosted_scores)


@query(S.query([*_FEATURES, S.GOLD, f"sl AS MATERIALIZED (SELECT q_id, doc_id, rank AS was, row_number() OVER (PARTITION BY q_id ORDER BY (rank > {PROTECT})::INT, CASE WHEN rank <= {PROTECT} THEN rank END, overlap_score DESC, rank, doc_id) AS rank FROM cf QUALIFY row_number() OVER (PARTITION BY q_id ORDER BY (rank > {PROTECT})::INT, CASE WHEN rank <= {PROTECT} THEN rank END, overlap_score DESC, rank, doc_id) <= 10)",
    "pq AS (SELECT q_id, count(*) FILTER (was > 10) AS promoted, avg(was) AS mean_was FROM sl GROUP BY q_id)",
    "fl AS (SELECT pq.*, gold IS NOT NULL AS answerable, gold IS NOT NULL AND EXISTS (SELECT 1 FROM cf WHERE cf.q_id = pq.q_id AND cf.doc_id = gold) AS c, gold IS NOT NULL AND EXISTS (SELECT 1 FROM cf WHERE cf.q_id = pq.q_id AND cf.doc_id = gold AND rank <= 10) AS b, gold IS NOT NULL AND EXISTS (SELECT 1 FROM sl WHERE sl.q_id = pq.q_id AND sl.doc_id = gold) AS a FROM pq LEFT JOIN gold USING (q_id))"],
    "SELECT count(*) AS questions, count(*) FILTER (answerable) AS answerable, count(*) FILTER (c) AS in_pool, count(*) FILTER (b) AS baseline_hits, count(*) FILTER (a) AS selected_hits, count(*) FILTER (a AND NOT b) AS gained, count(*) FILTER (b AND NOT a) AS lost, sum(promoted)::BIGINT AS promotions, 0::BIGINT AS violations, round(avg(mean_was), 4) AS average_rank FROM fl"))
def overlap_protected_report(spark, d):
    """The same selection with the overlap score in the model's place."""
    return _selection(Setting(spark, d), lambda rows: rows.select("q_id", "doc_id", F.col("overlap_score").alias("model_score")))


@query(S.query([*CASES, _INSIDE], "SELECT count(*) AS case_count, count(*) FILTER (answerable) AS answerable_count, count(*) FILTER (NOT answerable) AS unanswerable_count, count(*) FILTER (answerable AND in_context) AS context_gold_hit_count, round(coalesce(count(*) FILTER (answerable AND in_context) / nullif(count(*) FILTER (answerable), 0), 0), 6) AS context_gold_hit_rate, round(coalesce(avg(CASE WHEN final_refused THEN 0 ELSE f1 END) FILTER (answerable), 0), 6) AS average_f1_all_answerable, round(coalesce(avg(f1) FILTER (answerable AND NOT final_refused), 0), 6) AS average_f1_completed_answerable, count(*) FILTER (answerable AND NOT final_refused AND cited_gold) AS gold_citation_count, round(coalesce(count(*) FILTER (answerable AND NOT final_refused AND cited_gold) / nullif(count(*) FILTER (answerable), 0), 0), 6) AS gold_citation_rate, count(*) FILTER (answerable AND final_refused) AS answerable_refusal_count, round(coalesce(count(*) FILTER (answerable AND final_refused) / nullif(count(*) FILTER (answerable), 0), 0), 6) AS answerable_refusal_rate, count(*) FILTER (NOT answerable AND NOT final_refused) AS false_answer_count, round(coalesce(count(*) FILTER (NOT answerable AND NOT final_refused) / nullif(count(*) FILTER (NOT answerable), 0), 0), 6) AS false_answer_rate FROM cx"))
def case_aggregate(spark, d):
    return context.case_aggregate(_bucketed(Evidence(spark, d)), F.col("inside"))
