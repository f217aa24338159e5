"""Fusion of ranked lists, candidate pools and gates.

A ranked list is (channel, q_id, doc_id, rank[, score]).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.functions import metrics as M
from lodestone.operators.retrieve import top_k

RRF_K = 60


def channel(results: DataFrame, name: str) -> DataFrame:
    return results.select(F.lit(name).alias("channel"), "q_id", "doc_id", "rank")


def rrf(lists: DataFrame, weights: dict[str, float] | None = None, k: int = RRF_K) -> DataFrame:
    """Sum of weight / (k + rank) over the channels."""
    weight: Column = F.lit(1.0)
    for name, w in (weights or {}).items():
        weight = F.when(F.col("channel") == name, F.lit(float(w))).otherwise(weight)
    return lists.groupBy("q_id", "doc_id").agg(F.round(F.sum(weight / (k + F.col("rank"))), 9).alias("score"))


def interleave(lists: DataFrame, order: list[str]) -> DataFrame:
    """Round robin by rank, then channel order; a document's first place counts."""
    place = F.array_position(F.array(*[F.lit(c) for c in order]), F.col("channel"))
    first = lists.groupBy("q_id", "doc_id").agg(F.min(F.struct("rank", place.alias("place"))).alias("at"))
    return top_k(first, ["q_id"], [F.col("at.rank"), F.col("at.place")]).select("q_id", "doc_id", "rank")


def prefix_pool(prefix: DataFrame, more: DataFrame, prefix_depth: int, depth: int) -> DataFrame:
    """The first ranking's prefix, then unseen documents of the second, re-ranked."""
    head = prefix.filter(F.col("rank") <= prefix_depth).select("q_id", "doc_id", F.lit(0).alias("part"), "rank")
    tail = more.join(head.select("q_id", "doc_id"), ["q_id", "doc_id"], "left_anti").select("q_id", "doc_id", F.lit(1).alias("part"), "rank")
    both = head.unionByName(tail).withColumnRenamed("rank", "was")
    return top_k(both, ["q_id"], [F.col("part"), F.col("was")], depth).select("q_id", "doc_id", "part", "rank")


def marginal_hits(lists: DataFrame, gold: DataFrame, order: list[str], depth: int) -> DataFrame:
    """For each channel, the questions whose gold it is first, in order, to find."""
    place = F.array_position(F.array(*[F.lit(c) for c in order]), F.col("channel"))
    wanted = gold.select("q_id", F.col("gold").alias("doc_id"))
    found = lists.filter(F.col("rank") <= depth).join(wanted, ["q_id", "doc_id"]).select("q_id", "channel", place.alias("place"))
    first = found.groupBy("q_id").agg(F.min_by("channel", "place").alias("channel"))
    return first.groupBy("channel").agg(F.count(F.lit(1)).alias("hits"))


def gate_rank10(base: DataFrame, challenger: DataFrame, lengths: DataFrame, low: int = 11, high: int = 20, challenger_max: int = 10, margin_max: float = 1.5, length: tuple[float, float] = (0.85, 1.2)) -> DataFrame:
    """At most one document of the baseline's band low .. high takes rank 10.

    base and challenger: (q_id, doc_id, score, rank); lengths: (doc_id, ratio).
    The first nine ranks stay; a margin of exactly 0 sorts last among margins.
    """
    tenth = base.filter("rank = 10").select("q_id", F.col("score").alias("tenth"))
    c = challenger.select("q_id", "doc_id", F.col("rank").alias("c_rank"), F.col("score").alias("c_score"))
    near = base.join(tenth, "q_id").join(c, ["q_id", "doc_id"]).join(lengths, "doc_id").withColumn("margin", F.round(F.col("tenth") - F.col("score"), 9))
    near = near.filter(F.col("rank").between(low, high) & (F.col("c_rank") <= challenger_max) & (F.col("margin") <= margin_max) & ((F.col("ratio") <= length[0]) | (F.col("ratio") >= length[1])))
    order = [F.col("c_rank"), F.when(F.col("margin") == 0, float("inf")).otherwise(F.col("margin")), F.col("c_score").desc(), F.col("score").desc(), F.col("doc_id")]
    lifted = top_k(near, ["q_id"], order, 1, "n").select("q_id", "doc_id", F.lit(True).alias("lifted"))
    both = base.join(lifted, ["q_id", "doc_id"], "left").withColumn("lifted", F.coalesce("lifted", F.lit(False)))
    placed = both.withColumnRenamed("rank", "base_rank").withColumn("place", F.when(F.col("lifted"), F.lit(9.5)).otherwise(F.col("base_rank").cast("double")))
    return top_k(placed, ["q_id"], [F.col("place")]).select("q_id", "doc_id", "base_rank", "lifted", "rank")


def reason_code(base_rank: Column, challenger_rank: Column, margin: Column, ratio: Column, lifted: Column) -> Column:
    head = F.when(lifted, "promoted").otherwise("not_promoted")
    return F.concat_ws("|", head, M.rank_bucket(base_rank), M.rank_bucket(challenger_rank), M.margin_bucket(margin), M.length_bucket(ratio))


def section_shadow(base: DataFrame, section: DataFrame, section_max: int = 10, depth: int = 50) -> DataFrame:
    """Documents that sections rank high come right after the baseline's first ten."""
    s = section.select("q_id", "doc_id", F.col("rank").alias("s_rank"), F.col("score").alias("s_score"))
    both = base.withColumnRenamed("rank", "base_rank").join(s, ["q_id", "doc_id"], "full_outer")
    part = F.when(F.col("base_rank") <= 10, 0).when(F.col("s_rank") <= section_max, 1).when(F.col("base_rank").isNotNull(), 2)
    kept = both.withColumn("part", part).filter("part is not null")
    order = [F.col("part"), F.when(F.col("part") == 1, F.col("s_rank")).otherwise(F.col("base_rank")), F.col("doc_id")]
    return top_k(kept, ["q_id"], order, depth).select("q_id", "doc_id", "part", "rank")


def dense_promotions(base: DataFrame, dense: DataFrame, dense_max: int = 5, keep: int = 3, depth: int = 10, k: int = RRF_K) -> DataFrame:
    """Dense documents outside the baseline's first ten go behind a kept prefix."""
    inside = base.filter(F.col("rank") <= 10).select("q_id", "doc_id")
    new = dense.filter(F.col("rank") <= dense_max).join(inside, ["q_id", "doc_id"], "left_anti")
    b = base.select("q_id", "doc_id", F.col("rank").alias("b_rank"))
    score = 1 / (k + F.col("rank")) + F.coalesce(1 / (k + F.col("b_rank")), F.lit(0.0))
    new = new.join(b, ["q_id", "doc_id"], "left").withColumn("s", F.round(score, 9))
    up = top_k(new, ["q_id"], [F.col("s").desc(), F.col("rank"), F.col("doc_id")], None, "n").select("q_id", "doc_id", F.lit(1).alias("part"), F.col("n").alias("pos"))
    old = base.select("q_id", "doc_id", F.when(F.col("rank") <= keep, 0).otherwise(2).alias("part"), F.col("rank").alias("pos"))
    first = old.unionByName(up).groupBy("q_id", "doc_id").agg(F.min(F.struct("part", "pos")).alias("at"))
    return top_k(first, ["q_id"], [F.col("at.part"), F.col("at.pos")], depth).select("q_id", "doc_id", F.col("at.part").alias("part"), "rank")


def diversity(results: DataFrame, cluster: str = "cluster", weight: float = 0.05) -> DataFrame:
    """score - weight * best score * number of better documents of the same cluster."""
    within = W.partitionBy("q_id", cluster).orderBy("rank")
    best = F.max("score").over(W.partitionBy("q_id"))
    dup = F.row_number().over(within) - 1
    size = F.count(F.lit(1)).over(W.partitionBy("q_id", cluster))
    adj = F.round(F.col("score") - F.lit(weight) * best * dup, 9)
    out = results.select("q_id", "doc_id", F.col("rank").alias("base_rank"), size.alias("cluster_size"), dup.alias("dup_index"), adj.alias("score"))
    return top_k(out, ["q_id"], [F.col("score").desc(), F.col("dup_index"), F.col("base_rank"), F.col("doc_id")])


def previous_margin(results: DataFrame) -> DataFrame:
    """Margins of each score to the best and to the one before."""
    w = W.partitionBy("q_id").orderBy("rank")
    return results.select("q_id", "doc_id", "rank", F.round(F.first("score").over(w) - F.col("score"), 6).alias("to_first"), F.round(F.lag("score").over(w) - F.col("score"), 6).alias("to_previous"))


def shortlist(candidates: DataFrame, prefix_depth: int, depth: int, k: int, protect: int, replace: int) -> DataFrame:
    """Protected prefix, then the best of prefix rest and append candidates.

    candidates: (q_id, doc_id, rank, fit), better fits higher.
    """
    by_fit = [F.col("fit").desc(), F.col("rank"), F.col("doc_id")]
    parts = candidates.filter(F.col("rank") <= depth).withColumn("tail", (F.col("rank") > prefix_depth).cast("int"))
    own = top_k(parts, ["q_id", "tail"], by_fit, None, "own")
    kept = own.filter((F.col("tail") == 0) & (F.col("own") <= k) | (F.col("tail") == 1) & (F.col("own") <= replace))
    kept = kept.withColumn("free", ((F.col("tail") == 1) | (F.col("own") > protect)).cast("int"))
    chosen = top_k(kept, ["q_id", "free"], by_fit, None, "n").filter((F.col("free") == 0) | (F.col("n") <= k - protect))
    return top_k(chosen.withColumnRenamed("rank", "was"), ["q_id"], [F.col("fit").desc(), F.col("was"), F.col("doc_id")], k).select("q_id", "doc_id", "was", "rank")


def swaps(candidates: DataFrame, keep: int = 10, budget: int = 3, margin: float = 0.0) -> DataFrame:
    """i-th weakest of the first `keep` against the i-th strongest of the rest.

    candidates: (q_id, doc_id, rank, model); accepted where the gain passes the margin.
    """
    inside = top_k(candidates.filter(F.col("rank") <= keep), ["q_id"], [F.col("model"), F.col("rank").desc(), F.col("doc_id")], budget, "i")
    outside = top_k(candidates.filter(F.col("rank") > keep), ["q_id"], [F.col("model").desc(), F.col("rank"), F.col("doc_id")], budget, "i")
    a = inside.select("q_id", "i", F.col("doc_id").alias("out_doc"), F.col("model").alias("out_model"))
    b = outside.select("q_id", "i", F.col("doc_id").alias("in_doc"), F.col("model").alias("in_model"))
    gain = F.round(F.col("in_model") - F.col("out_model"), 6)
    return a.join(b, ["q_id", "i"]).withColumn("gain", gain).withColumn("accepted", F.col("gain") > margin).select("q_id", "i", "out_doc", "in_doc", "gain", "accepted")



def one_per_key(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order: first wins, or with a descending order last wins."""
    return top_k(rows, keys, order, 1, "_n").drop("_n")
