"""Retrieval and answer metrics, paired comparison, buckets and attribution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import metrics as M


def gold_ranks(asked: DataFrame, gold: DataFrame, results: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, q_id, gold, rank or null) of the questions that have a gold document."""
    wanted = gold.select("q_id", F.col("gold").alias("doc_id"))
    base = asked.select("q_id").join(wanted, "q_id")
    for k in keys:
        base = base.crossJoin(results.select(k).distinct())  # a literal list of configurations
    return base.join(results.select(*keys, "q_id", "doc_id", "rank"), [*keys, "q_id", "doc_id"], "left").withColumnRenamed("doc_id", "gold")


def hit(rank: Column, k: int) -> Column:
    return F.round(F.coalesce(F.avg(F.when(rank <= k, 1.0).otherwise(0.0)), F.lit(0.0)), 4)


def retrieval_metrics(ranks: DataFrame, keys: tuple[str, ...] = (), ks=(1, 5, 10), depth: int = 10) -> DataFrame:
    r = F.col("rank")
    mrr = F.round(F.coalesce(F.avg(F.when(r <= depth, 1 / r).otherwise(0.0)), F.lit(0.0)), 4)
    missing = F.count_if(r.isNull())
    return ranks.groupBy(*keys).agg(F.count(F.lit(1)).alias("questions"), *[hit(r, k).alias(f"hit{k}") for k in ks], mrr.alias("mrr"), missing.alias("not_found"))


def paired(base: DataFrame, challenger: DataFrame, k: int = 10) -> DataFrame:
    """One row: improved, regressed, both hit, both missed, moved up or down."""
    j = base.select("q_id", F.col("rank").alias("b")).join(challenger.select("q_id", F.col("rank").alias("c")), "q_id")
    bh, ch = F.coalesce(F.col("b") <= k, F.lit(False)), F.coalesce(F.col("c") <= k, F.lit(False))
    far = F.lit(10**9)
    b, c = F.coalesce("b", far), F.coalesce("c", far)
    counts = [("improved", ~bh & ch), ("regressed", bh & ~ch), ("both_hit", bh & ch), ("both_missed", ~bh & ~ch), ("rank_up", c < b), ("rank_down", c > b)]
    return j.agg(F.count(F.lit(1)).alias("questions"), *[F.count_if(x).alias(n) for n, x in counts])


def answer_metrics(cases: DataFrame, refused: str = "refused") -> DataFrame:
    """cases: q_id, answerable, refused, cited_gold, f1."""
    a, r = F.col("answerable"), F.col(refused)
    rate = lambda part, whole: F.round(M.ratio(F.count_if(part), F.count_if(whole)), 4)
    answered = a & ~r
    return cases.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(a).alias("answerable"), F.count_if(answered).alias("answered_answerable"), F.count_if(~a & ~r).alias("answered_unanswerable"),
        rate(answered & F.col("cited_gold"), answered).alias("gold_citation_rate"), rate(~a & r, ~a).alias("refusal_rate"), rate(a & r, a).alias("false_refusal_rate"),
        F.round(F.coalesce(F.avg(F.when(answered, F.col("f1"))), F.lit(0.0)), 6).alias("average_f1"), F.round(F.coalesce(F.avg(F.when(a, F.when(r, 0.0).otherwise(F.col("f1")))), F.lit(0.0)), 6).alias("average_f1_all_answerable"),
    )


def pareto(rows: DataFrame, id_: str, better_high: list[str]) -> DataFrame:
    """Rows that no other row dominates; for tables of configurations."""
    a, b = rows.alias("a"), rows.alias("b")
    no_worse = better = None
    for c in better_high:
        ge, gt = F.col(f"b.{c}") >= F.col(f"a.{c}"), F.col(f"b.{c}") > F.col(f"a.{c}")
        no_worse, better = (ge, gt) if no_worse is None else (no_worse & ge, better | gt)
    return a.join(b, no_worse & better & (F.col(f"a.{id_}") != F.col(f"b.{id_}")), "left_anti")


def concentration(rows: DataFrame, key: str) -> DataFrame:
    """Share of rows by key."""
    from pyspark.sql import Window as W

    n = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("share", F.round(F.col("n") / F.sum("n").over(W.partitionBy(F.lit(1))), 4))


def distribution(rows: DataFrame, value: str, by: list[str]) -> DataFrame:
    """count, min, max, mean and interpolated percentiles of a column by group."""
    ps = {"p10": 0.1, "p25": 0.25, "median": 0.5, "p75": 0.75, "p90": 0.9, "p99": 0.99}
    v = F.col(value)
    return rows.groupBy(*by).agg(F.count(v).alias("n"), F.round(F.min(v), 4).alias("lowest"), F.round(F.max(v), 4).alias("highest"), F.round(F.avg(v), 4).alias("average"), *[F.round(F.percentile(v, F.lit(p)), 4).alias(k) for k, p in ps.items()])
