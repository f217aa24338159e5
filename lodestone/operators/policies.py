"""Policies over scored actions: dual-target selection, nested thresholds, dominance, gates, group-wise losses.

An action is (q_id, item); scores are inputs, whether given or out of fold.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.operators.retrieve import top_k

GRID_DIGITS = 9
LEVELS, LEVEL_BITS = 4, 16


def place_value(rows: DataFrame, group: str, value: str, wanted: DataFrame) -> DataFrame:
    """(group, threshold): the value at a place, counted from the largest; wanted: (group, place).

    Values lie on a grid of 1e-9.  Four histograms refine the answer by 16 bits
    each; all are partial aggregates, so no task gets the values of a group.
    """
    key = F.round(F.col(value) * 10.0**GRID_DIGITS).cast("bigint") + F.lit(2**62)
    keyed = rows.filter(F.col(value).isNotNull()).select(group, key.alias("key"))
    at = wanted.select(group, F.col("place").cast("bigint").alias("place"), F.lit(0).cast("bigint").alias("head"))
    for level in range(LEVELS):
        shift = LEVEL_BITS * (LEVELS - 1 - level)
        inside = keyed.join(F.broadcast(at), group) if level == 0 else keyed.join(F.broadcast(at), group).filter(F.shiftright("key", shift + LEVEL_BITS) == F.col("head"))  # one row a group
        cells = inside.groupBy(group, "place", F.shiftright("key", shift).alias("cell")).agg(F.count(F.lit(1)).alias("n"))
        down = W.partitionBy(group).orderBy(F.col("cell").desc()).rowsBetween(W.unboundedPreceding, 0)
        run = cells.withColumn("run", F.sum("n").over(down)).filter(F.col("run") >= F.col("place"))
        first = run.groupBy(group).agg(F.max(F.struct("cell", (F.col("place") - (F.col("run") - F.col("n"))).alias("place"))).alias("e"))
        at = first.select(group, F.col("e.place").alias("place"), F.col("e.cell").alias("head"))
    return at.select(group, ((F.col("head") - F.lit(2**62)) / F.lit(10.0**GRID_DIGITS)).alias("threshold"))


# ---- dual targets ------------------------------------------------------------

MODES = ("citation_only", "safe_product", "citation_minus_half_risk", "citation_minus_risk")


def utility(gain: Column, risk: Column, mode: str) -> Column:
    """One utility of the chance of a citation gain and that of an F1 loss."""
    forms = {MODES[0]: gain, MODES[1]: gain * (1 - risk), MODES[2]: gain - 0.5 * risk, MODES[3]: gain - risk}
    return F.round(forms[mode], GRID_DIGITS)


def best_actions(predictions: DataFrame, mode: str, keys: tuple[str, ...] = ("q_id",)) -> DataFrame:
    """The action of the highest utility a question; ties: higher gain, lower risk, larger item."""
    u = predictions.withColumn("utility", utility(F.col("gain"), F.col("risk"), mode))
    return top_k(u, list(keys), [F.col("utility").desc(), F.col("gain").desc(), F.col("risk"), F.col("item").desc()], 1, "_n").drop("_n")


def coverage_thresholds(best: DataFrame, share: float, group: str) -> DataFrame:
    """(group, threshold): the utility that ceil(share n) questions of a group reach."""
    n = best.groupBy(group).agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) * F.lit(share))).alias("place"))
    return place_value(best, group, "utility", n)


def abstaining(best: DataFrame, thresholds: DataFrame, group: str) -> DataFrame:
    """Actions that reach their group's threshold; a question below it has no row."""
    return best.join(F.broadcast(thresholds), group).filter(F.col("utility") >= F.col("threshold"))  # one row a group


# ---- nested thresholds ---------------------------------------------------------


def nested_thresholds(rows: DataFrame, grid: list[float], least: int = 0) -> DataFrame:
    """For each outer fold, the threshold that is best on the other folds, and its figures on both sides.

    rows: (fold, margin, change) of opportunities that are accepted where the
    margin reaches the threshold.  One pass adds up fold x grid cell; what a
    threshold accepts is the sum of the cells from its own on, and training
    figures are totals less the fold's own.  Order: most net change, fewest
    accepted, highest threshold; where no threshold nets `least`, the highest.
    """
    steps = sorted(grid)
    cell = reduce(lambda acc, t: acc + (F.col("margin") >= t).cast("int"), steps, F.lit(0))
    cells = rows.groupBy("fold", cell.alias("cell")).agg(F.count(F.lit(1)).alias("n"), F.sum("change").alias("net"), F.count_if(F.col("change") < 0).alias("losses"))
    folds = cells.select("fold").distinct()
    table = folds.select("fold", F.inline(F.array(*[F.struct(F.lit(i + 1).alias("cell"), F.lit(float(t)).alias("threshold")) for i, t in enumerate(steps)])))
    onward = W.partitionBy("fold").orderBy(F.col("cell").desc()).rowsBetween(W.unboundedPreceding, 0)
    names = ("n", "net", "losses")
    held = table.join(cells.filter("cell > 0"), ["fold", "cell"], "left").na.fill(0, list(names))
    held = held.select("fold", "threshold", *[F.sum(c).over(onward).alias(c) for c in names])
    total = W.partitionBy("threshold")
    both = held.select("fold", "threshold", *[c for c in names], *[(F.sum(c).over(total) - F.col(c)).alias(f"train_{c}") for c in names])
    fit = (F.col("train_net") >= least).cast("int")
    order = [fit.desc(), F.when(fit == 1, F.col("train_net")).desc(), F.when(fit == 1, -F.col("train_n")).desc(), F.col("threshold").desc()]
    best = top_k(both.withColumn("reason", F.when(fit == 1, "best_on_other_folds").otherwise("no_threshold_met_minimum")), ["fold"], order, 1, "_n")
    return best.select("fold", "threshold", "reason", "train_n", "train_net", "train_losses", F.col("n").alias("held_n"), F.col("net").alias("held_net"), F.col("losses").alias("held_losses"))


def stability(rows: DataFrame, policy: str, parts: list[str]) -> DataFrame:
    """For each policy and each part (fold, route, ...): changes, net change, mean, and whether it holds its own.

    rows: (policy, part columns, changed, delta).  Long form: part, value.
    """
    long = rows.select(policy, "changed", "delta", F.inline(F.array(*[F.struct(F.lit(p).alias("part"), F.col(p).cast("string").alias("value")) for p in parts])))
    per = long.groupBy(policy, "part", "value").agg(F.count(F.lit(1)).alias("questions"), F.count_if("changed").alias("changes"), F.round(F.sum("delta"), 4).alias("net"))
    return per.withColumn("mean", F.round(F.col("net") / F.col("questions"), 4)).withColumn("nonregression", F.col("net") >= 0)


# ---- joint constraints ---------------------------------------------------------


def level(value: Column, width: float) -> Column:
    """The bucket of a value; a width of 0 keeps the value itself."""
    return F.floor((value + 1e-12) / width).cast("double") if width > 0 else value.cast("double")


def joint_constraint(predictions: DataFrame, rule: str, safety: float, gain: float) -> DataFrame:
    """One action a question by bucketed risks and gain.

    predictions: (q_id, item, risk_a, risk_b, gain).  `worst_risk` orders by the
    larger bucket, the buckets' sum and the gain; `first_risk` by one risk after
    the other; `dominance` first by the number of actions that are better by the
    margins in both risks and in gain.  Dominators are counted inside a
    question's array of actions, which enumeration bounds; no pairs become rows.
    """
    a, b, g = level(F.col("risk_a"), safety), level(F.col("risk_b"), safety), level(F.col("gain"), gain)
    rows = predictions.withColumn("worst", F.greatest(a, b)).withColumn("both", a + b).withColumn("own", g).withColumn("la", a).withColumn("lb", b)
    if rule == "first_risk":
        order = [F.col("la"), F.col("lb"), F.col("own").desc(), F.col("item")]
    else:
        order = [F.col("worst"), F.col("both"), F.col("own").desc(), F.col("item")]
    if rule == "dominance":
        actions = rows.groupBy("q_id").agg(F.collect_list(F.struct("item", "risk_a", "risk_b", "gain", "worst", "both", "own", "la", "lb")).alias("x"))

        def better(l, r):
            by_margin = (l["risk_a"] <= r["risk_a"] - safety) & (l["risk_b"] <= r["risk_b"] - safety) & (l["gain"] >= r["gain"] + gain)
            return by_margin & ((l["risk_a"] < r["risk_a"]) | (l["risk_b"] < r["risk_b"]) | (l["gain"] > r["gain"]))

        counted = F.transform("x", lambda r: r.withField("dominators", F.size(F.filter("x", lambda l: better(l, r)))))
        rows = actions.select("q_id", F.inline(counted))
        order = [F.col("dominators"), *order]
    else:
        rows = rows.withColumn("dominators", F.lit(0))
    return top_k(rows, ["q_id"], order, 1, "_n").select("q_id", "item", "dominators", "worst", "both", F.col("own").alias("gain_level"))


# ---- the two-stage gate ----------------------------------------------------------


def gate_rows(predictions: DataFrame, cap: int = 8, keys: tuple[str, ...] = ("q_id",)) -> DataFrame:
    """The second stage's row of a question: its conditional winner against the baseline.

    predictions: (keys, item, score, risk, base).  Of the `cap` safest actions and
    the baseline, the winner is the best score that isn't the baseline; its lead
    is normalised by the spread of the scores in the pool.
    """
    keys_ = list(keys)
    pool = top_k(predictions, keys_, [F.col("risk"), F.col("item")], None, "_s").filter((F.col("_s") <= cap) | F.col("base"))
    pool = top_k(pool, keys_, [F.col("risk"), F.col("item")], None, "safe")
    others = top_k(pool.filter(~F.col("base")), keys_, [F.col("score").desc(), F.col("risk"), F.col("item")], None, "place")
    first = lambda c: F.max(F.when(F.col("place") == 1, F.col(c)))
    second = F.coalesce(F.max(F.when(F.col("place") == 2, F.col("score"))), first("score"))
    spread = F.max("score") - F.min("score")
    per = others.groupBy(*keys_).agg(first("item").alias("item"), first("score").alias("score"), first("risk").alias("risk"), first("safe").alias("_safe"), F.round(F.when(spread > 0, (first("score") - second) / spread).otherwise(F.lit(0.0)), 9).alias("margin"))
    whole = pool.groupBy(*keys_).agg(F.count(F.lit(1)).alias("pool"), F.max(F.when(F.col("base"), F.col("risk"))).alias("base_risk"))
    place = F.round((F.col("_safe") - 1) / F.greatest(F.lit(1), F.col("pool") - 1), 9)
    return per.join(whole, keys_).withColumn("risk_place", place).withColumn("risk_change", F.round(F.col("risk") - F.col("base_risk"), 9)).drop("_safe")


# ---- group-wise losses -------------------------------------------------------------


def softmax_rows(rows: DataFrame, score: str = "score") -> DataFrame:
    """Adds `probability`, each question's softmax of the score, and `gradient` = probability - target."""
    w = W.partitionBy("q_id")
    e = F.exp(F.col(score) - F.max(score).over(w))
    out = rows.withColumn("_e", e)
    return out.withColumn("probability", F.col("_e") / F.sum("_e").over(w)).withColumn("gradient", F.col("probability") - F.col("target")).drop("_e")


def softmax_loss(rows: DataFrame, by: list[str]) -> DataFrame:
    """Mean cross-entropy of the questions' softmax against their targets, by group; rows from softmax_rows."""
    own = rows.groupBy("q_id", *by).agg(F.sum(-F.col("target") * F.log(F.greatest(F.col("probability"), F.lit(1e-300)))).alias("loss"), F.max_by("target", F.struct("probability", "item")).alias("caught"))
    return own.groupBy(*by).agg(F.count(F.lit(1)).alias("questions"), F.round(F.avg("loss"), 6).alias("loss"), F.round(F.avg("caught"), 6).alias("caught"))


def lambda_rows(rows: DataFrame, gains: tuple[float, ...], truncation: int) -> DataFrame:
    """(q_id, item, tier, rank, gradient, curvature): lambda gradients of a question's scored actions.

    Each of the `truncation` first meets the actions behind it, so a question of n
    actions gives truncation x n pairs.  rows: (q_id, item, tier, score).
    """
    gain = F.element_at(F.array(*[F.lit(float(g)) for g in gains]), F.col("tier") + 1)
    r = top_k(rows.withColumn("gain", gain), ["q_id"], [F.col("score").desc(), F.col("item")], None, "rank")
    w = W.partitionBy("q_id")
    at = F.row_number().over(w.orderBy(F.col("gain").desc(), "item"))
    r = r.withColumn("_at", at).withColumn("ideal", F.sum(F.when(F.col("_at") <= truncation, F.col("gain") / F.log2(F.col("_at") + 1))).over(w)).withColumn("flat", F.max("score").over(w) == F.min("score").over(w)).drop("_at")
    a, b = r.filter(F.col("rank") <= truncation).alias("a"), r.alias("b")
    j = a.join(b, (F.col("a.q_id") == F.col("b.q_id")) & (F.col("b.rank") > F.col("a.rank")) & (F.col("a.tier") != F.col("b.tier"))).filter("a.ideal > 0")
    d = F.col("a.score") - F.col("b.score")
    sign = F.when(F.col("a.tier") > F.col("b.tier"), 1.0).otherwise(-1.0)
    delta = F.abs(F.col("a.gain") - F.col("b.gain")) * F.abs(1 / F.log2(F.col("a.rank") + 1) - 1 / F.log2(F.col("b.rank") + 1)) / F.col("a.ideal")
    delta = F.when(F.col("a.flat"), delta).otherwise(delta / (0.01 + F.abs(d)))
    p = 1 / (1 + F.exp(sign * d))
    pairs = j.select(F.col("a.q_id").alias("q_id"), F.col("a.item").alias("i"), F.col("b.item").alias("k"), (sign * p * delta).alias("push"), (p * (1 - p) * delta).alias("curve"))
    each = pairs.select("q_id", F.inline(F.array(F.struct(F.col("i").alias("item"), (-F.col("push")).alias("g"), F.col("curve").alias("h")), F.struct(F.col("k").alias("item"), F.col("push").alias("g"), F.col("curve").alias("h")))))
    sums = each.groupBy("q_id", "item").agg(F.sum("g").alias("g"), F.sum("h").alias("h"))
    total = pairs.groupBy("q_id").agg((2 * F.sum(F.abs("push"))).alias("total"))
    out = r.join(sums, ["q_id", "item"], "left").join(total, "q_id", "left")
    norm = F.when(F.col("total") > 0, F.log2(1 + F.col("total")) / F.col("total")).otherwise(F.lit(1.0))
    return out.select("q_id", "item", "tier", "rank", F.round(F.coalesce("g", F.lit(0.0)) * norm, 6).alias("gradient"), F.round(F.coalesce("h", F.lit(0.0)) * norm, 6).alias("curvature"))


def ndcg(rows: DataFrame, gains: tuple[float, ...], depth: int, by: list[str], score: str = "score") -> DataFrame:
    """Mean nDCG at a depth of the questions that have any gain, by group. rows: (q_id, item, tier, score)."""
    gain = F.element_at(F.array(*[F.lit(float(g)) for g in gains]), F.col("tier").cast("int") + 1)
    r = top_k(rows.withColumn("gain", gain), ["q_id"], [F.col(score).desc(), F.col("item")], None, "_r")
    r = top_k(r, ["q_id"], [F.col("gain").desc(), F.col("item")], None, "_i")
    at = lambda c: F.sum(F.when(F.col(c) <= depth, F.col("gain") / F.log2(F.col(c) + 1)).otherwise(0.0))
    own = r.groupBy("q_id", *by).agg(at("_r").alias("got"), at("_i").alias("best")).filter("best > 0")
    return own.groupBy(*by).agg(F.count(F.lit(1)).alias("questions"), F.round(F.avg(F.col("got") / F.col("best")), 6).alias("ndcg"))
