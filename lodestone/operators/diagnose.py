"""Diagnosis: causes of misses, evidence proxies, paired arms, waterfalls, summaries of candidate sets, resampling."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import metrics as M
from lodestone.operators import ordered
from lodestone.operators.retrieve import top_k

# ---- resampling ----------------------------------------------------------------

#: Cumulative chances of a Poisson variable of mean 1: below the i-th, its value is at most i.
POISSON = [math.exp(-1) * sum(1 / math.factorial(j) for j in range(i + 1)) for i in range(12)]


def poisson_weight(replicate: Column, key: Column) -> Column:
    """A Poisson(1) weight from a hash of replicate and key: 52 bits of an md5 as a number in (0, 1)."""
    bits = F.conv(F.substring(F.md5(F.concat_ws("|", replicate.cast("string"), key.cast("string")).cast("binary")), 1, 13), 16, 10).cast("bigint")
    u = (bits.cast("double") + 0.5) / F.lit(float(2**52))
    return sum(((u >= F.lit(c)).cast("int") for c in POISSON), F.lit(0))


def poisson_bootstrap(rows: DataFrame, key: str, value: str, replicates: int = 200, low: float = 0.025, high: float = 0.975) -> DataFrame:
    """Mean and sum of a value with percentile intervals, one row.

    Each row weighs itself in each replicate by a hash, so a task adds up all
    replicates of its rows alone and sends one row a replicate.
    """
    each = rows.select(F.col(key).alias("k"), F.col(value).cast("double").alias("v")).withColumn("r", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
    w = poisson_weight(F.col("r"), F.col("k"))
    sums = each.withColumn("w", w).groupBy("r").agg(F.sum(F.col("w") * F.col("v")).alias("s"), F.sum("w").alias("n"), F.sum("v").alias("all"), F.count("v").alias("rows"))
    mean = F.when(F.col("n") > 0, F.col("s") / F.col("n")).otherwise(F.lit(0.0))
    sums = sums.withColumn("mean", mean).withColumn("total", mean * F.col("rows"))
    at = lambda c, q: F.round(F.percentile(c, F.lit(q)), 6)  # noqa: E731  over `replicates` rows
    return sums.agg(
        F.max("rows").alias("rows"), F.round(F.max("all") / F.max("rows"), 6).alias("mean"), at("mean", low).alias("mean_low"), at("mean", high).alias("mean_high"),
        F.round(F.max("all"), 6).alias("sum"), at("total", low).alias("sum_low"), at("total", high).alias("sum_high"),
    )


# ---- causes of context misses -----------------------------------------------------

# The families in order, and the buckets that count as a signal.
CAUSES = [
    ("query_expression_gap", ["zero_gold_section_overlap", "very_low_gold_section_overlap_lt_0_10", "low_gold_section_overlap_lt_0_25", "short_query_low_gold_overlap"]),
    ("title_heading_mismatch", ["zero_title_heading_overlap", "very_low_title_heading_overlap_lt_0_10", "low_title_heading_overlap_lt_0_25"]),
    ("section_boundary_or_span_locality", ["long_section_low_local_anchor", "boundary_early_low_local_anchor", "boundary_late_low_local_anchor", "low_local_anchor"]),
    ("long_document_score_dilution", ["very_long_gold_document", "long_gold_document", "gold_document_much_longer_than_top10"]),
    ("entity_version_error_code_mismatch", ["special_tokens_absent_in_gold_context", "partial_special_token_overlap"]),
    ("bm25_field_weighting_or_index_structure", ["section_rank_beats_doc_rollup", "title_rank_beats_doc_rollup", "section_or_title_diagnostic_top10"]),
]


def miss_buckets(cases: DataFrame) -> DataFrame:
    """(q_id, missed, a bucket a family) of questions that have a gold document.

    cases: n_query, section_ratio, title_ratio, section_tokens, position (0 to 1),
    gold_tokens, top10_median, n_special, special_found, doc_rank, title_rank,
    section_rank (null: not found within the depth).
    """
    c = F.col
    r = c("section_ratio")
    gap = (
        F.when((c("n_query") <= 3) & (r < 0.25), "short_query_low_gold_overlap").when(r == 0, "zero_gold_section_overlap").when(r < 0.10, "very_low_gold_section_overlap_lt_0_10")
        .when(r < 0.25, "low_gold_section_overlap_lt_0_25").when(r < 0.50, "moderate_gold_section_overlap_lt_0_50").otherwise("strong_gold_section_overlap")
    )
    t = c("title_ratio")
    title = F.when(t == 0, "zero_title_heading_overlap").when(t < 0.10, "very_low_title_heading_overlap_lt_0_10").when(t < 0.25, "low_title_heading_overlap_lt_0_25").otherwise("title_or_heading_overlap_present")
    far = r < 0.10
    place = (
        F.when(c("section_tokens").isNull(), "section_not_identified").when(far & (c("section_tokens") > 220), "long_section_low_local_anchor").when(far & (c("position") <= 0.15), "boundary_early_low_local_anchor")
        .when(far & (c("position") >= 0.85), "boundary_late_low_local_anchor").when(far, "low_local_anchor").otherwise("local_anchor_present")
    )
    n, m = c("gold_tokens"), c("top10_median")
    length = F.when((m > 0) & (n >= m * 2.5) & (n > 1000), "gold_document_much_longer_than_top10").when(n > 3000, "very_long_gold_document").when(n > 1000, "long_gold_document").when(n > 300, "medium_gold_document").otherwise("short_gold_document")
    s, f = c("n_special"), c("special_found")
    entity = F.when(s == 0, "no_special_query_tokens").when(f == 0, "special_tokens_absent_in_gold_context").when(f == s, "special_tokens_matched").otherwise("partial_special_token_overlap")
    near = lambda x: F.coalesce(c(x) <= 10, F.lit(False))
    d = c("doc_rank")
    index = (
        F.when(d.isNull() & (near("title_rank") | near("section_rank")), "section_or_title_diagnostic_top10").when((d > 10) & near("section_rank"), "section_rank_beats_doc_rollup").when((d > 10) & near("title_rank"), "title_rank_beats_doc_rollup")
        .when((d > 10) & (d <= 20), "near_miss_rank_11_to_20").when(d.isNull(), "gold_doc_not_found_top50").otherwise("weak_index_structure_signal")
    )
    found = dict(zip([k for k, _ in CAUSES], (gap, title, place, length, entity, index)))
    return cases.select("q_id", F.coalesce(d > 10, F.lit(True)).alias("missed"), *[v.alias(k) for k, v in found.items()])


def _long(buckets: DataFrame) -> DataFrame:
    families = F.array(*[F.struct(F.lit(i).alias("place"), F.lit(k).alias("family"), F.col(k).alias("bucket")) for i, (k, _) in enumerate(CAUSES)])
    return buckets.select("q_id", "missed", F.inline(families))


def learned_rules(buckets: DataFrame, least: int = 2) -> DataFrame:
    """(place, family, bucket, n, rate, lift): buckets of at least `least` cases that miss more often than all cases do."""
    whole = buckets.agg(F.avg(F.col("missed").cast("double")).alias("overall"))
    per = _long(buckets).groupBy("place", "family", "bucket").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("missed").cast("double")).alias("rate")).join(F.broadcast(whole))  # one row
    return per.filter((F.col("n") >= least) & (F.col("rate") > F.col("overall"))).select("place", "family", "bucket", "n", F.round("rate", 6).alias("rate"), F.round(F.col("rate") - F.col("overall"), 6).alias("lift"))


def fixed_rules(spark) -> DataFrame:
    return spark.createDataFrame([(i, k, b) for i, (k, bs) in enumerate(CAUSES) for b in bs], "place int, family string, bucket string")


def root_causes(buckets: DataFrame, rules: DataFrame) -> DataFrame:
    """(q_id, cause, signals, confidence) of the missed cases: the first family whose bucket is in the rule table."""
    hits = _long(buckets.filter("missed")).join(F.broadcast(rules.select("family", "bucket", F.lit(1).alias("hit"))), ["family", "bucket"], "left")  # families x buckets rows
    per = hits.groupBy("q_id").agg(F.min_by("family", F.when(F.col("hit") == 1, F.col("place"))).alias("cause"), F.sum(F.coalesce("hit", F.lit(0))).alias("signals"))
    band = F.when(F.col("signals") >= 3, "high_multi_signal").when(F.col("signals") == 2, "medium_two_signal").when(F.col("signals") == 1, "low_single_signal").otherwise("low_no_high_signal")
    return per.select("q_id", F.coalesce("cause", F.lit("mixed_or_low_confidence")).alias("cause"), "signals", band.alias("confidence"))


# ---- evidence proxies --------------------------------------------------------------


def proxy_metrics(views: DataFrame, threshold: float) -> DataFrame:
    """One row over views (q_id, phase initial or final, stratum, label, score).

    Confusion, balanced accuracy, AUC over all views, and rates of the paths:
    compose at once where gold is visible, inspect and then compose where only
    the final view has it, compose in the end where neither has.
    """
    v = views.withColumn("yes", F.col("score") >= threshold)
    y, p = F.col("label") == 1, F.col("yes")
    per = v.groupBy("score").agg(F.count_if(y).alias("pos"), F.count_if(~y).alias("neg"))
    below = ordered.running(per, [F.col("score")], F.col("neg"), "below")
    area = below.withColumn("wins", F.col("pos") * (F.col("below") + F.col("neg") / 2)).agg(F.round(M.ratio(F.sum("wins"), F.sum("pos") * F.sum("neg")), 6).alias("roc_auc"))
    q = v.groupBy("q_id").agg(F.max("stratum").alias("stratum"), F.bool_or((F.col("phase") == "initial") & p).alias("first"), F.bool_or((F.col("phase") == "final") & p).alias("last"))
    rate = lambda of, what: F.round(M.ratio(F.count_if(of & what), F.count_if(of)), 6)
    at_once, later = F.col("stratum") == "initial_gold_visible", F.col("stratum") == "alternate_only_gold_visible"
    neither = ~at_once & ~later
    paths = q.agg(
        rate(at_once, F.col("first")).alias("initial_visible_compose_rate"), rate(later, ~F.col("first")).alias("alternate_only_inspect_rate"), rate(later, F.col("last")).alias("alternate_only_final_compose_rate"),
        rate(later, ~F.col("first") & F.col("last")).alias("alternate_only_path_success_rate"), rate(neither, F.col("last")).alias("insufficient_final_compose_rate"),
    )
    counts = v.agg(F.count(F.lit(1)).alias("case_count"), F.count_if(y & p).alias("true_positive"), F.count_if(~y & p).alias("false_positive"), F.count_if(~y & ~p).alias("true_negative"), F.count_if(y & ~p).alias("false_negative"))
    half = lambda a, b: M.ratio(F.col(a), F.col(a) + F.col(b))
    counts = counts.withColumn("balanced_accuracy", F.round((half("true_positive", "false_negative") + half("true_negative", "false_positive")) / 2, 6))
    return counts.join(F.broadcast(area)).join(F.broadcast(paths))  # one row each


# ---- paired arms ----------------------------------------------------------------------


def paired_arms(rows: DataFrame, arms: tuple[str, str], fixed: list[str], measured: list[str], key: str = "q_id") -> DataFrame:
    """(key, fixed columns, measured columns of both arms): each key once under each arm.

    A key that lacks an arm, has one twice, or whose fixed columns differ between
    its arms stops the query.
    """
    mine = lambda c, a: F.max(F.when(F.col("arm") == a, F.col(c)))
    per = rows.groupBy(key).agg(*[F.count_if(F.col("arm") == a).alias(f"_n{i}") for i, a in enumerate(arms)], *[F.count_distinct(F.struct(*[F.col(c).alias(c) for c in fixed])).alias("_kinds")], *[F.max(c).alias(c) for c in fixed], *[mine(c, a).alias(f"{a}_{c}") for c in measured for a in arms])
    right = (F.col("_n0") == 1) & (F.col("_n1") == 1) & (F.col("_kinds") == 1)
    checked = F.when(right, F.col(key)).otherwise(F.raise_error(F.concat(F.lit("arms aren't paired for "), F.coalesce(F.col(key).cast("string"), F.lit("null")))).cast(rows.schema[key].dataType))
    return per.select(checked.alias(key), *fixed, *[f"{a}_{c}" for c in measured for a in arms])


def arm_policy(pairs: DataFrame, choose: Column, arms: tuple[str, str], by: list[str]) -> DataFrame:
    """Totals of a policy that takes the second arm where `choose` holds, against both arms alone."""
    pick = lambda c: F.when(choose, F.col(f"{arms[1]}_{c}")).otherwise(F.col(f"{arms[0]}_{c}"))
    grains = lambda c: F.sum(F.round(c * 10_000).cast("bigint")) / F.lit(10_000.0)  # noqa: E731  exact sums of 1e-4
    delta = pick("f1") - F.col(f"{arms[0]}_f1")
    return pairs.groupBy(*by).agg(
        F.count(F.lit(1)).alias("questions"), F.count_if(choose).alias("switched"), grains(F.col(f"{arms[0]}_f1")).alias("first_f1"), grains(F.col(f"{arms[1]}_f1")).alias("second_f1"), grains(pick("f1")).alias("policy_f1"),
        F.count_if(delta > 0).alias("improved"), F.count_if(delta < 0).alias("regressed"), F.count_if(pick("cited_gold")).alias("policy_citations"), F.count_if(F.col(f"{arms[0]}_cited_gold")).alias("first_citations"),
    )


# ---- waterfall ----------------------------------------------------------------------------


def waterfall(rows: DataFrame, stages: list[str], by: str) -> DataFrame:
    """Long form: for all rows and each group, how many reach each stage and how many are lost since the one before."""
    both = rows.select(F.explode(F.array(F.lit("all"), F.col(by).cast("string"))).alias("part"), *stages)
    counts = both.groupBy("part").agg(F.count(F.lit(1)).alias("n"), *[F.count_if(c).alias(c) for c in stages])
    steps = F.array(*[F.struct(F.lit(i).alias("at"), F.lit(c).alias("stage"), F.col(c).alias("reached"), ((F.col(stages[i - 1]) if i else F.col("n")) - F.col(c)).alias("dropped")) for i, c in enumerate(stages)])
    return counts.select("part", "n", F.inline(steps)).select("part", "n", "stage", "reached", "dropped")


def transitions(rows: DataFrame, pairs: list[tuple[str, str, str]], by: str) -> DataFrame:
    """Long form: for each named pair of flags, counts of (before, after) for all rows and each group."""
    kinds = F.array(*[F.struct(F.lit(name).alias("kind"), F.col(a).alias("before"), F.col(b).alias("after")) for name, a, b in pairs])
    both = rows.select(F.explode(F.array(F.lit("all"), F.col(by).cast("string"))).alias("part"), kinds.alias("k")).select("part", F.inline("k"))
    return both.groupBy("part", "kind", "before", "after").agg(F.count(F.lit(1)).alias("n"))


# ---- rows and candidate sets ------------------------------------------------------------------


def row_evaluation(results: DataFrame, gold: DataFrame, ks: tuple[int, ...] = (1, 3, 5, 10), low: float = 0.3) -> DataFrame:
    """Hits, MRR, F1 of the first row and best F1 within k, median rank, failure counts.

    results: (q_id, doc_id, rank, f1) within the greatest k; gold: (q_id, gold).
    """
    j = results.join(gold, "q_id")
    per = j.groupBy("q_id").agg(F.min(F.when(F.col("doc_id") == F.col("gold"), F.col("rank"))).alias("rank"), *[F.max(F.when(F.col("rank") <= k, F.col("f1"))).alias(f"o{k}") for k in ks])
    per = gold.select("q_id").join(per, "q_id", "left").fillna(0.0, [f"o{k}" for k in ks])
    r, mean = F.col("rank"), lambda c: F.round(F.avg(c), 4)
    return per.agg(
        F.count(F.lit(1)).alias("questions"), *[mean(F.coalesce((r <= k).cast("int"), F.lit(0))).alias(f"hit{k}") for k in ks], mean(F.coalesce(1 / r, F.lit(0.0))).alias("mrr"), F.percentile(r, F.lit(0.5)).alias("median_rank"),
        *[mean(f"o{k}").alias(f"oracle{k}" if k > 1 else "top1_f1") for k in ks], F.count_if(r.isNull()).alias("missing"), F.count_if(r.isNull() | (r > 1)).alias("wrong_first"), F.count_if(F.col("o1") < low).alias("low_first"),
    )


def candidate_summary(rows: DataFrame, by: list[str]) -> DataFrame:
    """Per group of questions: candidates, first and best F1, what an oracle gains, where the best stands.

    rows: (q_id, place, f1, by columns).
    """
    per = rows.groupBy("q_id", *by).agg(F.count(F.lit(1)).alias("n"), F.max(F.when(F.col("place") == 1, F.col("f1"))).alias("first"), F.max("f1").alias("best"), F.min_by("place", F.struct(-F.col("f1"), F.col("place"))).alias("at"))
    grains = lambda c: F.sum(F.round(F.col(c) * 10_000).cast("bigint")) / F.count(c) / F.lit(10_000.0)
    return per.groupBy(*by).agg(F.count(F.lit(1)).alias("questions"), F.sum("n").alias("candidates"), F.round(grains("first"), 6).alias("first_f1"), F.round(grains("best"), 6).alias("best_f1"), F.round(grains("best") - grains("first"), 6).alias("oracle_gain"), F.count_if(F.col("at") > 1).alias("better_than_first"), F.max("at").alias("deepest_best"))


#: Parts of a column's name that betray an outcome.
OUTCOME_NAMES = ("gold", "label", "best", "f1", "answer", "target", "is_")


def feature_leakage(rows: DataFrame, features: list[str], label: str, allowed: tuple[str, ...] = ()) -> DataFrame:
    """(feature, by_name, by_value): features whose name speaks of the outcome, or that alone tell the label.

    A feature tells the label if it takes two values or more, none of which goes
    with both labels, and takes no more values than a tenth of the rows.
    """
    named = {f: any(x in f.lower() for x in OUTCOME_NAMES) and f not in allowed for f in features}
    long = rows.select(F.col(label).cast("int").alias("y"), F.inline(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("string").alias("value")) for f in features])))
    per = long.groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("y").alias("kinds"), F.max("y").alias("y"))
    told = per.groupBy("feature").agg(F.count(F.lit(1)).alias("values"), F.max("kinds").alias("kinds"), F.sum("n").alias("n"), F.count_distinct("y").alias("labels"))
    by_value = (F.col("kinds") == 1) & (F.col("labels") > 1) & (F.col("values") * 10 <= F.col("n"))
    names = F.col("feature").isin([f for f, bad in named.items() if bad] or [""])
    return told.select("feature", names.alias("by_name"), by_value.alias("by_value"))


def consistency(rows: DataFrame, summaries: DataFrame, key: str = "q_id") -> DataFrame:
    """Keys on one side alone, and keys whose number of rows differs from the summary's `n`."""
    n = rows.groupBy(key).agg(F.count(F.lit(1)).alias("own"))
    j = n.join(summaries.select(key, F.col("n").alias("told")), key, "full_outer")
    return j.agg(F.count(F.lit(1)).alias("keys"), F.count_if(F.col("told").isNull()).alias("only_rows"), F.count_if(F.col("own").isNull()).alias("only_summary"), F.count_if(F.col("own") != F.col("told")).alias("different"))


def f1_distribution(rows: DataFrame, value: str, by: list[str]) -> DataFrame:
    return rows.groupBy(*by, M.f1_bucket(F.col(value)).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def first_rows(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return top_k(rows, keys, order, 1, "_n").drop("_n")


def change_contrasts(rows: DataFrame, by: list[str], features: dict[str, str]) -> DataFrame:
    """Outcomes of changed choices by group: number, F1 change, mean feature difference.

    rows: the structs `b` (before) and `c` (after), each with place, f1 and the features; `features` names contrasts.
    """
    b, c = F.col("b"), F.col("c")
    outcome = F.when(c["f1"] > b["f1"], "improved").when(c["f1"] < b["f1"], "regressed").when(c["place"] == b["place"], "unchanged").otherwise("tied")
    gain = F.round((c["f1"] - b["f1"]) * 10_000).cast("bigint")
    return rows.groupBy(*by, outcome.alias("outcome")).agg(F.count(F.lit(1)).alias("n"), (F.sum(gain) / F.lit(10_000.0)).alias("f1_change"), *[F.round(F.avg(F.round(c[f] - b[f], 4)), 6).alias(f"{n}_contrast") for n, f in features.items()])
