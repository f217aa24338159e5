"""Queries of learned scorers and their policies; models have no SQL, their inputs and metrics do."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import metrics as M
from lodestone.functions import text as T
from lodestone.operators import evidence, learn
from lodestone.plans.corpus import VARIETY, variety
from lodestone.plans.evidence import Evidence
from lodestone.sources.scratch import stored

QUERIES, ORACLES = {}, {}
FEATURES = ["rank", "score", "n_tokens", "n_overlap", "coverage", "signal"]


def query(oracle: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def candidates(spark, d):
    """Evidence sentences with features, token F1, best flag and the question's fold."""
    from lodestone.operators.retrieve import top_k

    e = Evidence(spark, d)
    r = evidence.bm25_ranked(e.rows(), 2).join(e.asked.select("q_id", T.tokens(F.col("text")).alias("gt")), "q_id")
    x = F.col("sentence")
    r = r.select("q_id", "doc_id", "place", "rank", "score", F.size(T.tokens(x)).alias("n_tokens"), F.size("overlap").alias("n_overlap"), (F.size("overlap") / F.size("terms")).alias("coverage"), T.answer_signal(x).alias("signal"), F.round(M.token_f1(T.tokens(x), F.col("gt")), 4).alias("f1"))
    r = top_k(r, ["q_id"], [F.col("f1").desc(), F.col("place")], None, "b").withColumn("best", (F.col("b") == 1).cast("int")).drop("b")
    return r.withColumn("fold", F.pmod(F.crc32("q_id"), F.lit(3)).cast("int"))


@query(None)
def logistic_candidate_cv(spark, d):
    rows = stored(candidates(spark, d), "candidates")
    s = learn.out_of_fold(rows, "logistic", FEATURES, "best", 3)
    return learn.selection_metrics(learn.argmax(s), rows)


@query(None)
def ridge_candidate_cv(spark, d):
    rows = stored(candidates(spark, d), "candidates")
    s = learn.out_of_fold(rows, "ridge", FEATURES, "f1", 3)
    return learn.selection_metrics(learn.argmax(s), rows)


@query(None)
def guarded_policy(spark, d):
    s = learn.out_of_fold(candidates(spark, d), "logistic", FEATURES, "best", 3)
    return learn.guarded(s, 3, 0.05)


@query(f"WITH x AS (SELECT p, quality AS y FROM ({VARIETY})), v AS (SELECT p, count(*) FILTER (y = 1) AS pos, count(*) FILTER (y = 0) AS neg FROM x GROUP BY p), c AS (SELECT pos, neg, coalesce(sum(neg) OVER (ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM v) SELECT round(sum(pos * (below + neg / 2)) / (sum(pos) * sum(neg)), 6) AS auc FROM c")
def roc_auc(spark, d):
    return learn.auc(variety(spark, d), "p", "quality")
