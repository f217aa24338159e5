"""Composition under citation limits, guarded rewrites, swaps, splits and policy grids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.operators.retrieve import top_k


def take_with_cap(rows: DataFrame, keys: list[str], order: list[Column], limit: int, cap: int | Column, name: str = "slot") -> DataFrame:
    """The first `limit` rows of each key in order, of each document at most `cap`."""
    own = top_k(rows, [*keys, "doc_id"], order, None if isinstance(cap, Column) else cap, "_own")
    return top_k(own.filter(F.col("_own") <= cap).drop("_own"), keys, order, limit, name)


def score_rank_policies(rows: DataFrame, specs: list[tuple[str, float, int]], limit: int = 3) -> DataFrame:
    """(policy, q_id, doc_id, pos, slot): sentences by score / log2(rank + 1) ** power under a document cap, for every spec.

    specs: (policy, power, cap), a literal list that every row meets.
    """
    grid = F.explode(F.array(*[F.struct(F.lit(n).alias("policy"), F.lit(float(p)).alias("power"), F.lit(c).alias("cap")) for n, p, c in specs])).alias("g")
    each = rows.select("q_id", "doc_id", "pos", "rank", "sentence", "score", grid).select("*", "g.*").drop("g")
    each = each.withColumn("key", F.round(F.col("score") / F.pow(F.log2(F.col("rank") + 1), "power"), 9))
    order = [F.col("key").desc(), F.col("rank"), F.col("doc_id"), F.col("sentence")]
    return take_with_cap(each, ["policy", "q_id"], order, limit, F.col("cap")).select("policy", "q_id", "doc_id", "pos", "slot")


def rank_coverage(rows: DataFrame, limit: int = 3, cap: int = 1) -> DataFrame:
    """(q_id, doc_id, pos, slot): the first sentence of each of the best `limit` documents in rank order, then the rest."""
    first = F.row_number().over(W.partitionBy("q_id", "rank").orderBy("place")) == 1
    lead = rows.withColumn("lead", F.when(first & (F.col("rank") <= limit), F.col("rank")))
    return take_with_cap(lead, ["q_id"], [F.col("lead").asc_nulls_last(), F.col("place")], limit, cap).select("q_id", "doc_id", "pos", "slot")


def lead_rewrite(rows: DataFrame, lead: Column, limit: int = 3) -> DataFrame:
    """The leading candidate first, the others in their order, cut at `limit`."""
    return top_k(rows, ["q_id"], [(F.col("place") == lead).desc(), F.col("place")], limit, "slot")


def score_guarded(rows: DataFrame, routes: DataFrame, blocked: tuple[str, ...] = (), max_place: int = 5, min_margin: float = 0.0, min_score: float = 60.0, max_rank: int | None = 3, preserve: bool = True, limit: int = 3) -> DataFrame:
    """(q_id, action, reason, lead, margin, kept): a model's choice leads the answer if no guard objects.

    rows: (q_id, doc_id, place, rank, score, model).  The choice is the best
    model score, ties by place.  Guards, in order: it leads already, its route,
    place, margin over the first candidate and score; a proposed citation beyond
    `max_rank`; a document beyond it that the plain answer cites and the
    proposal drops.
    """
    blocked_score, accepted = (f"candidate_score_gte_{min_score:g}_{x}" for x in ("blocked", "accepted"))
    # All state is bounded: the best row, the first row, and `limit` + 1 rows of a question.
    best = F.max_by(F.struct("place", "doc_id", "score", "model", "rank"), F.struct("model", -F.col("place")))
    chosen = rows.groupBy("q_id").agg(best.alias("b"), F.max(F.when(F.col("place") == 1, F.col("model"))).alias("first")).join(routes, "q_id")
    row = F.struct("place", "doc_id", "rank")
    base = rows.filter(F.col("place") <= limit).groupBy("q_id").agg(F.array_sort(F.collect_list(row)).alias("base"))
    c = chosen.join(base, "q_id").withColumn("margin", F.round(F.col("b.model") - F.col("first"), 6))
    lead = F.struct(F.col("b.place").alias("place"), F.col("b.doc_id").alias("doc_id"), F.col("b.rank").alias("rank"))
    others = F.filter("base", lambda x: x["place"] != F.col("b.place"))
    c = c.withColumn("proposed", F.slice(F.concat(F.array(lead), others), 1, limit))
    reason = (
        F.when(F.col("b.place") == 1, "model_selected_top_candidate").when(F.col("route").isin(*blocked) if blocked else F.lit(False), "route_blocked").when(F.col("b.place") > max_place, "selected_rank_exceeds_limit")
        .when(F.col("margin") < min_margin, "score_margin_below_min").when(F.col("b.score") < min_score, blocked_score)
    )
    if max_rank is not None:
        reason = reason.when(F.exists("proposed", lambda x: x["rank"] > max_rank), "selected_citation_rank_exceeds_limit")
        if preserve:
            far = F.transform(F.filter("base", lambda x: x["rank"] > max_rank), lambda x: x["doc_id"])
            reason = reason.when(F.size(F.array_except(far, F.transform("proposed", lambda x: x["doc_id"]))) > 0, "baseline_out_of_rank_document_dropped")
    reason = reason.otherwise(accepted)
    c = c.withColumn("reason", reason)
    taken = F.col("reason") == accepted
    kept = F.when(taken, F.col("proposed")).otherwise(F.col("base"))
    action = F.when(taken, "replace_with_model_candidate").otherwise("keep_top_candidate")
    return c.select("q_id", action.alias("action"), "reason", F.col("b.place").alias("lead"), "margin", F.array_join(F.transform(kept, lambda x: x["place"].cast("string")), ",").alias("kept"))


def policy_grid(places: list[int], margins: list[float], protect: list[float | None]) -> list[tuple[str, int, float, float | None]]:
    """All combinations of limits, each with a name."""
    return [(f"rank{r}_margin{m}_protect{p}", r, m, p) for r in places for m in margins for p in protect]


def policy_search(rows: DataFrame, grid: list[tuple[str, int, float, float | None]]) -> DataFrame:
    """(policy, questions, changed, total_f1, improved, regressed) of every guard setting.

    rows: (q_id, place, score, model, f1).  A setting may replace the first
    candidate by the model's best if that is within the place limit, leads by
    the margin, and the first one's score doesn't reach the protecting score.
    """
    best = F.max_by(F.struct("place", "model", "f1"), F.struct("model", -F.col("place")))
    top = lambda c: F.max(F.when(F.col("place") == 1, F.col(c)))
    per = rows.groupBy("q_id").agg(best.alias("b"), top("model").alias("m1"), top("f1").alias("f1"), top("score").alias("s1"))
    settings = F.explode(F.array(*[F.struct(F.lit(n).alias("policy"), F.lit(r).alias("place"), F.lit(float(m)).alias("margin"), F.lit(p).cast("double").alias("protect")) for n, r, m, p in grid])).alias("g")
    each = per.select("*", settings)
    ok = (F.col("b.place") > 1) & (F.col("b.place") <= F.col("g.place")) & (F.round(F.col("b.model") - F.col("m1"), 6) >= F.col("g.margin")) & (F.col("g.protect").isNull() | (F.col("s1") < F.col("g.protect")))
    each = each.select(F.col("g.policy").alias("policy"), ok.alias("ok"), F.col("f1").alias("old"), F.when(ok, F.col("b.f1")).otherwise(F.col("f1")).alias("new"))
    return each.groupBy("policy").agg(F.count(F.lit(1)).alias("questions"), F.count_if("ok").alias("changed"), F.round(F.sum("new"), 4).alias("total_f1"), F.count_if(F.col("new") > F.col("old")).alias("improved"), F.count_if(F.col("new") < F.col("old")).alias("regressed"))


def swap_materialised(ranked: DataFrame, swaps: DataFrame, threshold: float = 0.0, depth: int = 10) -> DataFrame:
    """(q_id, doc_id, was, rank): the context after the swaps whose gain passes the threshold, in rank order.

    ranked: (q_id, doc_id, rank); swaps: (q_id, out_doc, in_doc, gain).
    """
    taken = swaps.filter(F.col("gain") > threshold)
    kept = ranked.filter(F.col("rank") <= depth).join(taken.select("q_id", F.col("out_doc").alias("doc_id")), ["q_id", "doc_id"], "left_anti")
    new = ranked.join(taken.select("q_id", F.col("in_doc").alias("doc_id")), ["q_id", "doc_id"], "left_semi")
    both = kept.select("q_id", "doc_id", F.col("rank").alias("was")).unionByName(new.select("q_id", "doc_id", F.col("rank").alias("was")))
    return top_k(both, ["q_id"], [F.col("was"), F.col("doc_id")], depth)


def pool_contract(pool: DataFrame, most: int = 400) -> DataFrame:
    """Counts of what a candidate pool must not have: ranks below one, beyond `most`, or repeated, and repeated documents."""
    per = pool.groupBy("q_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("rank").alias("ranks"), F.count_distinct("doc_id").alias("documents"), F.min("rank").alias("low"), F.max("rank").alias("high"))
    return per.agg(F.count(F.lit(1)).alias("pools"), F.count_if(F.col("low") < 1).alias("not_positive"), F.count_if(F.col("high") > most).alias("too_deep"), F.count_if(F.col("ranks") < F.col("n")).alias("repeated_ranks"), F.count_if(F.col("documents") < F.col("n")).alias("repeated_documents"))


def ratio_split(groups: DataFrame, key: str, size: str, ratios: dict[str, float], seed: str = "split") -> DataFrame:
    """(key, split): groups in hash order, each to the split that is filled least against its share.

    Every step depends on the last, so this is an ordered fold over the list of
    groups: one row a group, and groups are few beside their rows.
    """
    names = sorted(ratios)
    item = F.struct(F.sha2(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col(key).cast("string"), F.lit(""))).cast("binary"), 256).alias("h"), F.col(key).alias("k"), F.col(size).cast("bigint").alias("n"))
    listed = groups.agg(F.array_sort(F.collect_list(item)).alias("g"), F.sum(size).alias("total"))
    target = F.array(*[F.greatest(F.col("total") * F.lit(ratios[x]), F.lit(1.0)) for x in names])
    start = F.struct(F.array_repeat(F.lit(0).cast("bigint"), len(names)).alias("load"), F.array().cast(f"array<struct<k:{dict(groups.dtypes)[key]},at:int>>").alias("out"))

    def put(acc, x):
        filled = F.array(*[F.struct((acc["load"][i] / F.col("t")[i]).alias("share"), acc["load"][i].alias("n"), F.lit(i).alias("at")) for i in range(len(names))])
        at = F.array_min(filled)["at"]
        load = F.transform(acc["load"], lambda v, i: F.when(i == at, v + x["n"]).otherwise(v))
        return F.struct(load.alias("load"), F.concat(acc["out"], F.array(F.struct(x["k"].alias("k"), at.alias("at")))).alias("out"))

    done = listed.withColumn("t", target).select(F.explode(F.aggregate("g", start, put)["out"]).alias("r"))
    return done.select(F.col("r.k").alias(key), F.element_at(F.array(*[F.lit(x) for x in names]), F.col("r.at") + 1).alias("split"))


def split_checks(rows: DataFrame, group: str, held: DataFrame) -> DataFrame:
    """(check, observed, passed): groups that cross splits, and held-out documents outside the test split.

    rows: (group, doc_id, split); held: (doc_id) kept for the test split.
    """
    crossing = rows.groupBy(group).agg(F.count_distinct("split").alias("n")).agg(F.count_if(F.col("n") > 1).alias("n"))
    outside = rows.filter(F.col("split") != "test").join(held.select("doc_id"), "doc_id", "left_semi").agg(F.count(F.lit(1)).alias("n"))
    named = lambda d, name: d.select(F.lit(name).alias("check"), F.col("n").alias("observed"), (F.col("n") == 0).alias("passed"))
    return named(crossing, "groups_do_not_cross_splits").unionByName(named(outside, "held_documents_only_in_test"))


def split_summary(rows: DataFrame, columns: list[str], doc_id: str = "doc_id") -> DataFrame:
    """(split, column, value, n, ids): value counts of each column by split, with distinct ids."""
    each = rows.select("split", F.col(doc_id).alias("_d"), F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])))
    return each.groupBy("split", "column", "value").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("_d").alias("ids"))


def listwise_metrics(ranks: DataFrame, depths: tuple[int, ...] = (1, 5, 10, 20)) -> DataFrame:
    """Over (method, q_id, rank or null): MRR, mean and median rank of the found, recall among the found and among all.

    The median is a percentile over counts by rank, which bounded depths keep short.
    """
    found, k = F.col("rank").isNotNull(), F.col("rank")
    share = lambda d, whole: F.round(F.try_divide(F.count_if(found & (k <= d)), whole), 6)
    n, all_ = F.count("rank"), F.count(F.lit(1))
    return ranks.groupBy("method").agg(
        n.alias("found"), F.round(F.avg(1 / k), 6).alias("mrr"), F.round(F.avg("rank"), 6).alias("mean_rank"), F.round(F.percentile("rank", F.lit(0.5)), 6).alias("median_rank"),
        *[share(d, n).alias(f"conditional_recall_{d}") for d in depths], *[share(d, all_).alias(f"recall_{d}") for d in depths], F.round(F.sum(F.coalesce(F.when(k <= max(depths), 1 / F.log2(k + 1)), F.lit(0.0))) / all_, 6).alias("ndcg"),
    )


def changed_answers(base: DataFrame, other: DataFrame, margin: float = 0.0) -> DataFrame:
    """(outcome, n): what became of answers that two runs give differently.

    Both: (q_id, answerable, refused, answer, f1).
    """
    b = base.select("q_id", "answerable", F.col("refused").alias("br"), F.col("answer").alias("ba"), F.col("f1").alias("bf"))
    o = other.select("q_id", F.col("refused").alias("orf"), F.col("answer").alias("oa"), F.col("f1").alias("of"))
    j = b.join(o, "q_id").filter((F.col("ba") != F.col("oa")) | (F.col("br") != F.col("orf")))
    gain = F.round(F.col("of") - F.col("bf"), 6)
    outcome = (
        F.when(~F.col("answerable") & F.col("br") & ~F.col("orf"), "unanswerable_refusal_regression").when(~F.col("answerable") & ~F.col("br") & F.col("orf"), "unanswerable_refusal_improvement").when(~F.col("answerable"), "unanswerable_changed_answer")
        .when(gain > margin, "answerable_f1_improved").when(gain < -margin, "answerable_f1_regressed").otherwise("answerable_f1_tied_changed")
    )
    return j.groupBy(outcome.alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


def distribution_compare(left: DataFrame, right: DataFrame, value: str = "value") -> DataFrame:
    """One row: size, mean, least and largest value of two pools side by side, and the difference of means."""
    of = lambda d, x: d.agg(F.count(value).alias(f"n_{x}"), F.round(F.avg(value), 6).alias(f"mean_{x}"), F.min(value).alias(f"min_{x}"), F.max(value).alias(f"max_{x}"))
    return of(left, "left").join(of(right, "right")).withColumn("mean_difference", F.round(F.col("mean_right") - F.col("mean_left"), 6))
