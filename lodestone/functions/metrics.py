"""Similarity and metric scalars as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(part: Column, whole: Column, digits: int | None = None) -> Column:
    """part / whole; 0 for an empty whole."""
    r = F.when(whole > 0, part / whole).otherwise(F.lit(0.0))
    return F.round(r, digits) if digits is not None else r


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets: both empty 1, one empty 0."""
    n, m = F.size(a), F.size(b)
    shared = F.size(F.array_intersect(a, b))
    return F.when((n == 0) & (m == 0), F.lit(1.0)).when((n == 0) | (m == 0), F.lit(0.0)).otherwise(shared / (n + m - shared))


def overlap_ratio(source: Column, target: Column) -> Column:
    """Share of the source's terms that the target has."""
    return ratio(F.size(F.array_intersect(source, target)), F.size(source))


def multiset_shared(a: Column, b: Column) -> Column:
    """Number of tokens that two token lists share, repeats counted."""
    count = lambda xs, t: F.size(F.filter(xs, lambda x: x == t))
    return F.aggregate(F.array_intersect(a, b), F.lit(0), lambda acc, t: acc + F.least(count(a, t), count(b, t)))


def token_f1(prediction: Column, gold: Column) -> Column:
    """Token F1 of two token lists; 0 where either is empty or nothing is shared."""
    shared = multiset_shared(prediction, gold)
    precision, recall = shared / F.size(prediction), shared / F.size(gold)
    return F.when((F.size(prediction) > 0) & (F.size(gold) > 0) & (shared > 0), 2 * precision * recall / (precision + recall)).otherwise(F.lit(0.0))


def inverse_rank(rank: Column) -> Column:
    return F.coalesce(F.when(rank > 0, 1 / rank), F.lit(0.0))


def rank_score(rank: Column) -> Column:
    return F.round(1 / F.log2(rank + 1), 8)


def score_ratio(numerator: Column, denominator: Column) -> Column:
    """0 for no numerator, infinite for no denominator."""
    return F.when(numerator <= 0, F.lit(0.0)).when(denominator <= 0, F.lit(float("inf"))).otherwise(numerator / denominator)


def idf(n: Column, df: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def bm25_norm(length: Column, average: Column, k1: float, b) -> Column:
    """k1 (1 - b + b length / average); an average of 0 leaves k1 (1 - b)."""
    b = b if isinstance(b, Column) else F.lit(float(b))
    return F.lit(float(k1)) * (1 - b + F.when(average > 0, b * length / average).otherwise(F.lit(0.0)))


def bm25_term(idf_: Column, tf: Column, norm: Column, k1: float) -> Column:
    return idf_ * tf * F.lit(float(k1) + 1) / (tf + norm)


def unit_vector(v: Column) -> Column:
    """The vector over its length; a zero vector stays."""
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return F.transform(v, lambda x: x.cast("double") / F.when(norm > 0, norm).otherwise(F.lit(1.0)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def bucket(value: Column, edges: list[tuple[float, str]], above: str, missing: str | None = None, closed: bool = True) -> Column:
    """Label of the first edge that the value doesn't pass."""
    out = F.when(value.isNull(), F.lit(missing))
    for edge, label in edges:
        out = out.when(value <= edge if closed else value < edge, label)
    return out.otherwise(above)


# The edges and labels of the report buckets.
RANK_EDGES = [(1, "rank_1"), (5, "rank_2_to_5"), (10, "rank_6_to_10"), (20, "rank_11_to_20"), (50, "rank_21_to_50")]
MARGIN_EDGES = [(0.02, "margin_lte_0_02"), (0.03, "margin_0_02_to_0_03"), (0.04, "margin_0_03_to_0_04"), (0.05, "margin_0_04_to_0_05")]


def rank_bucket(rank: Column) -> Column:
    return bucket(rank, RANK_EDGES, "not_found_top50", "not_found_top50")


def margin_bucket(margin: Column) -> Column:
    return bucket(margin, MARGIN_EDGES, "margin_gt_0_05", "margin_not_available")


def length_bucket(r: Column) -> Column:
    return (
        F.when(r.isNull(), "length_not_available").when(r <= 0.75, "length_lte_0_75").when(r <= 0.85, "length_0_75_to_0_85")
        .when(r < 1.2, "length_mid_band").when(r < 1.35, "length_1_20_to_1_35").when(r < 1.5, "length_1_35_to_1_50").otherwise("length_gte_1_50")
    )


def f1_bucket(value: Column) -> Column:
    return bucket(value, [(0.2, "f1_lt_0_2"), (0.4, "f1_0_2_to_0_4"), (0.6, "f1_0_4_to_0_6"), (0.8, "f1_0_6_to_0_8")], "f1_gte_0_8", "f1_none", closed=False)


def ratio_bucket(ratio_: Column) -> Column:
    return F.when(ratio_ == float("inf"), "ratio_document_score_zero").when(ratio_ >= 1.6, "ratio_gte_1_60").when(ratio_ >= 1.45, "ratio_1_45_to_1_59").when(ratio_ >= 1.2, "ratio_1_20_to_1_44").when(ratio_ >= 1.1, "ratio_1_10_to_1_19").otherwise("ratio_lt_1_10")


def gap_bucket(value: Column) -> Column:
    return F.when(value.isNull(), "not_applicable").when(value < 0.05, "gap_0_00_to_0_04").when(value < 0.2, "gap_0_05_to_0_19").when(value < 0.4, "gap_0_20_to_0_39").otherwise("gap_0_40_plus")


def query_length_bucket(n: Column) -> Column:
    return F.when(n < 6, "lt_6").when(n < 8, "6_7").when(n < 10, "8_9").when(n < 20, "10_19").otherwise("ge_20")


def overlap_bucket(value: Column) -> Column:
    return F.when(value <= 0.1, "le_0_10").when(value <= 0.2, "0_10_0_20").when(value <= 0.3, "0_20_0_30").when(value <= 0.5, "0_30_0_50").otherwise("gt_0_50")
