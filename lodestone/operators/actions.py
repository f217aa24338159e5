"""Composition actions and policies that choose among scored actions.

predictions: (q_id, action_id, gain, risk, cit, f1, base): scores are inputs;
`cit` and `f1` are outcome deltas, `base` marks the question's baseline.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.operators.retrieve import top_k

TOLERANCE = 1e-9


def enumerate_actions(candidates: DataFrame, most: int = 3, alternates: int = 12) -> DataFrame:
    """Delete, replace, append, prefix and coverage actions on ranked sentences.

    candidates: (q_id, place, doc_id).  Actions with equal index lists are one,
    with the first family's name and the number of names it had.
    """
    listed = candidates.filter(F.col("place") <= alternates).groupBy("q_id").agg(F.array_sort(F.collect_list(F.struct("place", "doc_id"))).alias("c"))  # at most `alternates` a question
    n = F.least(F.size("c"), F.lit(most))
    base = F.slice("all", 1, n)
    rows = listed.withColumn("all", F.transform("c", lambda x: x["place"] - 1)).withColumn("base", base)
    others = F.array_except("all", "base")
    as_action = lambda order, family, idx: F.struct(F.lit(order).alias("o"), family.alias("family"), idx.alias("idx"))
    slots = F.sequence(F.lit(1), F.size("base"))
    out_of = lambda i: F.concat(F.slice("base", 1, i - 1), F.slice("base", i + 1, F.lit(most)))
    delete = F.transform(slots, lambda i: as_action(1, F.concat(F.lit("delete_slot_"), i.cast("string")), out_of(i)))
    swap = lambda i, a: F.concat(F.slice("base", 1, i - 1), F.array(a), F.slice("base", i + 1, F.lit(most)))
    replace = F.flatten(F.transform(slots, lambda i: F.transform(others, lambda a: as_action(2, F.concat(F.lit("replace_slot_"), i.cast("string")), swap(i, a)))))
    append = F.when(F.size("base") < most, F.transform(others, lambda a: as_action(3, F.lit("append_candidate"), F.concat(F.col("base"), F.array(a))))).otherwise(F.array().cast("array<struct<o:int,family:string,idx:array<int>>>"))
    prefix = F.array(as_action(4, F.lit("keep_prefix_1"), F.slice("base", 1, 1)), as_action(5, F.lit("keep_prefix_2"), F.slice("base", 1, 2)))
    firsts = F.filter("c", lambda x: ~F.exists(F.filter("c", lambda y: y["place"] < x["place"]), lambda y: y["doc_id"] == x["doc_id"]))
    coverage = F.array(as_action(6, F.lit("document_coverage"), F.slice(F.transform(firsts, lambda x: x["place"] - 1), 1, most)))
    every = F.concat(F.array(as_action(0, F.lit("baseline"), F.col("base"))), delete, replace, append, prefix, coverage)
    flat = rows.select("q_id", F.posexplode(every).alias("at", "a")).select("q_id", "at", F.col("a.family").alias("family"), F.array_join(F.transform("a.idx", lambda x: x.cast("string")), ",").alias("idx"))
    return flat.filter("idx <> ''").groupBy("q_id", "idx").agg(F.min_by("family", "at").alias("family"), F.count_distinct("family").alias("names"))


def outcome(cit: Column, f1: Column) -> Column:
    up, same = f1 > TOLERANCE, F.abs(f1) <= TOLERANCE
    return (
        F.when((cit > 0) & up, "dual_gain").when((cit > 0) & same, "citation_gain_f1_tied").when((cit == 0) & up, "f1_gain_citation_preserved")
        .when(cit > 0, "citation_gain_f1_loss").when(cit < 0, "citation_loss").when(~same & ~up, "citation_preserved_f1_loss").otherwise("neutral")
    )


def tier(cit: Column, f1: Column) -> Column:
    return F.when((cit >= 0) & (f1 >= -TOLERANCE) & ((cit > 0) | (f1 > TOLERANCE)), 2).when((cit == 0) & (F.abs(f1) <= TOLERANCE), 1).otherwise(0)


def dominates(a: str, b: str) -> Column:
    ac, bc, af, bf = F.col(f"{a}.cit"), F.col(f"{b}.cit"), F.col(f"{a}.f1"), F.col(f"{b}.f1")
    return (ac >= bc) & (af >= bf - TOLERANCE) & ((ac > bc) | (af > bf + TOLERANCE))


def pairs(predictions: DataFrame) -> DataFrame:
    """Comparable pairs of a question's actions, with the preference and its weight."""
    p = predictions.withColumn("tier", tier(F.col("cit"), F.col("f1")))
    a, b = p.alias("a"), p.alias("b")
    j = a.join(b, (F.col("a.q_id") == F.col("b.q_id")) & (F.col("a.action_id") < F.col("b.action_id")))
    same = F.when(F.col("a.tier") == 0, 0).when(dominates("a", "b"), 1).when(dominates("b", "a"), -1).otherwise(0)
    preference = F.when(F.col("a.tier") > F.col("b.tier"), 1).when(F.col("a.tier") < F.col("b.tier"), -1).otherwise(same)
    out = j.select(F.col("a.q_id").alias("q_id"), F.col("a.action_id").alias("left_id"), F.col("b.action_id").alias("right_id"), preference.alias("preference")).filter("preference <> 0")
    return out.withColumn("weight", F.round(1 / (2 * F.count(F.lit(1)).over(W.partitionBy("q_id"))), 9))


def frontier(predictions: DataFrame) -> DataFrame:
    """Uniform target over the undominated actions of the best tier."""
    p = predictions.withColumn("tier", tier(F.col("cit"), F.col("f1"))).withColumn("best", F.max("tier").over(W.partitionBy("q_id"))).filter("tier = best")
    a, b = p.alias("a"), p.alias("b")
    kept = a.join(b, (F.col("a.q_id") == F.col("b.q_id")) & (F.col("a.action_id") != F.col("b.action_id")) & dominates("b", "a"), "left_anti")
    return kept.withColumn("probability", F.round(1 / F.count(F.lit(1)).over(W.partitionBy("q_id")), 9)).select("q_id", "action_id", "tier", "probability")


def safety_pool(predictions: DataFrame, cap: int) -> DataFrame:
    """The `cap` safest actions of each question, and its baseline."""
    p = top_k(predictions, ["q_id"], [F.col("risk"), F.col("action_id")], None, "safe")
    return p.filter((F.col("safe") <= cap) | F.col("base"))


def rank_capped(predictions: DataFrame, cap: int = 8) -> DataFrame:
    """The best gain within the safety pool."""
    w = top_k(safety_pool(predictions, cap), ["q_id"], [F.col("gain").desc(), F.col("risk"), F.col("action_id")], 1, "n")
    return w.select("q_id", "action_id", "gain", "risk")


def safety_first(predictions: DataFrame, cap: int = 16, prefix: int = 4) -> DataFrame:
    """Pool, then its safest prefix and the baseline, then the best gain."""
    pool = top_k(safety_pool(predictions, cap).drop("safe"), ["q_id"], [F.col("risk"), F.col("action_id")], None, "safe").filter((F.col("safe") <= prefix) | F.col("base"))
    w = top_k(pool, ["q_id"], [F.col("gain").desc(), F.col("risk"), F.col("action_id")], 1, "n")
    return w.select("q_id", "action_id", "gain", "risk")


def rank_utility(predictions: DataFrame, penalty: float = 0.5) -> DataFrame:
    """Winner by normalised gain rank plus penalty times normalised risk rank."""
    n = F.greatest(F.lit(1), F.count(F.lit(1)).over(W.partitionBy("q_id")) - 1)
    g = (F.row_number().over(W.partitionBy("q_id").orderBy(F.col("gain").desc(), "risk", "action_id")) - 1) / n
    r = (F.row_number().over(W.partitionBy("q_id").orderBy("risk", F.col("gain").desc(), "action_id")) - 1) / n
    u = predictions.withColumn("g", g).withColumn("r", r).withColumn("utility", F.round(F.col("g") + penalty * F.col("r"), 9))
    return top_k(u, ["q_id"], [F.col("utility"), F.col("r"), F.col("g"), F.col("action_id")], 1, "n").select("q_id", "action_id", F.round("utility", 6).alias("utility"))


def grouped_target(labels: DataFrame, safety: float = 0.5, precision: float = 0.25) -> DataFrame:
    """Mixture of capture, safety and precision shares; sums to 1 a question.

    labels: (q_id, action_id, label) with 2 strict, 1 baseline, 0 neutral safe, -1 unsafe.
    """
    w = W.partitionBy("q_id")
    of = lambda c: F.sum(c.cast("int")).over(w)
    strict, base, safe = F.col("label") == 2, F.col("label") == 1, F.col("label") >= 0
    capture = F.when(of(strict) > 0, strict.cast("double") / of(strict)).otherwise(base.cast("double"))
    mix = (capture + safety * safe.cast("double") / of(safe) + precision * (strict | base).cast("double") / of(strict | base)) / (1 + safety + precision)
    return labels.withColumn("target", F.round(mix, 9)).select("q_id", "action_id", "label", "target")


def relative(rows: DataFrame, value: str) -> DataFrame:
    """A feature against its question: delta to mean, z-score, share of values not above, extremes."""
    w = W.partitionBy("q_id")
    v, mean, dev = F.col(value), F.avg(value).over(w), F.stddev_pop(value).over(w)
    z = F.when(dev > 0, (v - mean) / dev).otherwise(F.lit(0.0))
    return rows.select("q_id", "action_id", F.round(v - mean, 6).alias("delta"), F.round(z, 6).alias("zscore"), F.round(F.cume_dist().over(w.orderBy(value)), 6).alias("share"), (v == F.min(value).over(w)).alias("is_min"), (v == F.max(value).over(w)).alias("is_max"))


def risk_calibration(rows: DataFrame, probability: str, label: str, bins: int = 5) -> DataFrame:
    """Per bin: count, mean probability and rate; with the Brier part of the bin."""
    p, y = F.col(probability), F.col(label).cast("double")
    b = F.least(F.floor(p * bins), F.lit(bins - 1)).cast("int")
    return rows.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(p), 6).alias("predicted"), F.round(F.avg(y), 6).alias("observed"), F.round(F.avg((p - y) * (p - y)), 6).alias("brier"))


def coverage_threshold(rows: DataFrame, score: str, coverage: float) -> DataFrame:
    """The score at place ceil(n coverage), best first, found by refined histograms."""
    from lodestone.operators.policies import coverage_thresholds

    return coverage_thresholds(rows.select(F.lit(1).alias("all"), F.col(score).alias("utility")), coverage, "all").select("threshold")
