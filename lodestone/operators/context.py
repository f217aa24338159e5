"""Learned context selection: features of pool documents, hard negatives, preference pairs, protected selection.

A pool is (q_id, doc_id, rank, score): the fused ranking of a question, cut at a depth.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import metrics as M
from lodestone.functions import text as T
from lodestone.operators import linear
from lodestone.operators.retrieve import top_k

# Depths of the pool, the context and the two lists of hard negatives; characters of a document's beginning.
POOL_DEPTH, CONTEXT_DEPTH, HARD, SHORT_CHARS = 200, 10, 20, 5000
FEATURES = [
    "rrf_score", "baseline_inverse", "overlap_count", "overlap_ratio", "overlap_score", "route_hits", "best_inverse", "title_overlap", "coverage", "body_coverage",
    "length_bucket", "special_matches", "title_special", "in_top10", "document_inverse", "section_inverse", "title_inverse",
]


def _postings(docs: DataFrame, asked_terms: DataFrame) -> DataFrame:
    """(doc_id, kind, term, in_title, in_body, in_short) of terms and special tokens that any question holds."""
    title, text = F.coalesce("title", F.lit("")), F.coalesce("text", F.lit(""))
    short = F.concat_ws("\n", title, F.substring(text, 1, SHORT_CHARS))
    tagged = lambda kind, terms, field: F.transform(F.array_distinct(terms), lambda t: F.struct(F.lit(kind).alias("kind"), t.alias("term"), F.lit(field).alias("field")))
    parts = [tagged("term", T.tokens(title), 0), tagged("term", T.tokens(text), 1), tagged("term", T.tokens(short), 2), tagged("special", T.special_tokens(title), 0), tagged("special", T.special_tokens(text), 1)]
    each = docs.select("doc_id", F.inline(F.concat(*parts))).join(asked_terms, ["kind", "term"], "left_semi")
    has = lambda f: F.max((F.col("field") == f).cast("int"))
    return each.groupBy("doc_id", "kind", "term").agg(has(0).alias("in_title"), has(1).alias("in_body"), has(2).alias("in_short"))


def features(pool: DataFrame, channels: DataFrame, docs: DataFrame, asked: DataFrame, names: list[str], main: str = "document") -> DataFrame:
    """The pool with FEATURES (one inverse rank a channel of `names`).

    A pool document meets the terms of its question by (document, term), so the
    work is the pool's size times a question's terms, and no frequent term is one key.
    The beginning of a text may end inside a word; that piece counts in the overlap
    with the beginning, never in the coverage by title and body.
    """
    terms = asked.select("q_id", F.explode(T.tokens(F.col("text"))).alias("term")).distinct().withColumn("kind", F.lit("term"))
    special = asked.select("q_id", F.explode(T.special_tokens(F.col("text"))).alias("term")).withColumn("kind", F.lit("special"))
    wanted = terms.unionByName(special)
    met = pool.select("q_id", "doc_id").join(wanted, "q_id").join(_postings(docs, wanted.select("kind", "term").distinct()), ["doc_id", "kind", "term"])
    count = lambda kind, c: F.sum(F.when(F.col("kind") == kind, c).otherwise(0))
    shared = met.groupBy("q_id", "doc_id").agg(
        count("term", F.col("in_short")).alias("overlap_count"), count("term", F.col("in_title")).alias("title_overlap"), count("term", F.col("in_body")).alias("n_body"), count("term", F.greatest("in_title", "in_body")).alias("n_any"),
        count("special", F.lit(1)).alias("special_matches"), count("special", F.col("in_title")).alias("title_special"),
    )
    sizes = asked.select("q_id", F.size(F.array_distinct(T.tokens(F.col("text")))).alias("n_q"))
    lengths = docs.select("doc_id", F.round(F.least(F.size(F.array_distinct(T.tokens(F.col("text")))) / F.lit(1000.0), F.lit(5.0)), 6).alias("length_bucket"))
    best = channels.groupBy("q_id", "doc_id").pivot("channel", names).agg(F.min("rank"))
    j = pool.join(shared, ["q_id", "doc_id"], "left").join(best, ["q_id", "doc_id"], "left").join(sizes, "q_id").join(lengths, "doc_id")
    j = j.fillna(0, ["overlap_count", "title_overlap", "n_body", "n_any", "special_matches", "title_special"])
    share = lambda c: F.round(F.when(F.col("n_q") > 0, F.col(c) / F.col("n_q")).otherwise(F.lit(0.0)), 6)
    inverse = {n: M.inverse_rank(F.col(n)) for n in names}
    overlap = F.col("overlap_count") + F.when(F.col("n_q") > 0, F.col("overlap_count") / F.col("n_q")).otherwise(F.lit(0.0)) + F.lit(0.35) / F.log2(F.col("rank") + 1)
    return j.select(
        "q_id", "doc_id", "rank", F.col("score").alias("rrf_score"), F.round(1 / F.col("rank"), 6).alias("baseline_inverse"), "overlap_count", share("overlap_count").alias("overlap_ratio"), F.round(overlap, 6).alias("overlap_score"),
        sum((F.col(n).isNotNull().cast("int") for n in names), F.lit(0)).alias("route_hits"), F.round(F.greatest(*inverse.values()), 6).alias("best_inverse"), "title_overlap",
        share("n_any").alias("coverage"), share("n_body").alias("body_coverage"), "length_bucket", "special_matches", "title_special", F.coalesce((F.col(main) <= CONTEXT_DEPTH).cast("int"), F.lit(0)).alias("in_top10"),
        *[F.round(inverse[n], 6).alias(f"{n}_inverse") for n in names],
    )


def labelled(rows: DataFrame, gold: DataFrame, protect: int = 0) -> DataFrame:
    """Rows behind the protected prefix, with is_gold; questions without gold have none."""
    j = rows.join(gold.select("q_id", "gold"), "q_id", "left")
    return j.filter(F.col("rank") > protect).withColumn("is_gold", F.coalesce(F.col("doc_id") == F.col("gold"), F.lit(False)).cast("int")).drop("gold")


def hard_negatives(rows: DataFrame, most: int = HARD) -> DataFrame:
    """Of each question that has gold among its rows: the first `most` others by rank, and by overlap score.

    Two bounded windows; a document in both is one row.
    """
    found = rows.filter("is_gold = 1").select("q_id").distinct()
    others = rows.filter("is_gold = 0").join(found, "q_id", "left_semi")
    by_rank = top_k(others, ["q_id"], [F.col("rank"), F.col("doc_id")], most, "place").withColumn("by", F.lit("rank"))
    by_overlap = top_k(others, ["q_id"], [F.col("overlap_score").desc(), F.col("rank"), F.col("doc_id")], most, "place").withColumn("by", F.lit("overlap"))
    both = by_rank.unionByName(by_overlap)
    names = [c for c in rows.columns if c not in ("q_id", "doc_id")]
    return both.groupBy("q_id", "doc_id").agg(*[F.first(c).alias(c) for c in names], F.array_join(F.array_sort(F.collect_list("by")), "+").alias("windows"))


def preference_pairs(rows: DataFrame, names: list[str], most: int = HARD) -> DataFrame:
    """The first gold row of a question against each hard negative, both ways round.

    (q_id, fold, positive, negative, label, a signed difference a feature).
    """
    first = top_k(rows.filter("is_gold = 1"), ["q_id"], [F.col("rank"), F.col("doc_id")], 1, "_n")
    positive = first.select("q_id", F.col("doc_id").alias("positive"), F.struct(*names).alias("p"))  # one row a question
    negative = hard_negatives(rows, most).select("q_id", "fold", F.col("doc_id").alias("negative"), F.struct(*names).alias("n"))
    both = negative.join(positive, "q_id").withColumn("label", F.explode(F.array(F.lit(1), F.lit(0))))
    sign = F.when(F.col("label") == 1, 1.0).otherwise(-1.0)
    return both.select("q_id", "fold", "positive", "negative", "label", *[F.round(sign * (F.col(f"p.{c}") - F.col(f"n.{c}")), 6).alias(c) for c in names])


def pairwise_scored(rows: DataFrame, names: list[str], folds: int, most: int = HARD) -> DataFrame:
    """Rows with the out-of-fold score of a linear preference model without an intercept."""
    from lodestone.sources.scratch import stored

    pairs = stored(linear.design(preference_pairs(rows, names, most), names, ["label"], ["q_id"]), "pairs")
    models = linear.left_out(folds)
    weights = linear.fit(pairs, len(names), 1, models, intercept=False)
    each = linear.design(rows, names, ["is_gold"], ["q_id", "doc_id", "rank", "is_gold"])
    scores = linear.scored(each, weights, len(names), linear.by_fold(models, folds), probability=False)
    return scores.withColumn("model_score", F.round(F.element_at("model_scores", 1), 9)).drop("model_scores", "y", "outer")


def protected(pool: DataFrame, scores: DataFrame, protect: int, depth: int = CONTEXT_DEPTH) -> DataFrame:
    """(q_id, doc_id, was, rank): the pool's first `protect` documents, then the best scores of the rest.

    Equal scores keep the pool's order; a document without a score comes last.
    """
    j = pool.select("q_id", "doc_id", F.col("rank").alias("was")).join(scores.select("q_id", "doc_id", "model_score"), ["q_id", "doc_id"], "left")
    kept = F.col("was") <= protect
    order = [(~kept).cast("int"), F.when(kept, F.col("was")), F.col("model_score").desc_nulls_last(), F.col("was"), F.col("doc_id")]
    return top_k(j, ["q_id"], order, depth).select("q_id", "doc_id", "was", "rank")


def selection_report(selected: DataFrame, pool: DataFrame, gold: DataFrame, protect: int, depth: int = CONTEXT_DEPTH) -> DataFrame:
    """Gold in the selected and in the baseline context, transitions, promotions from the tail, prefix violations."""
    wanted = gold.select("q_id", F.col("gold").alias("doc_id"))
    seen = lambda rows, name: rows.join(wanted, ["q_id", "doc_id"], "left_semi").select("q_id", F.lit(True).alias(name))
    per = selected.groupBy("q_id").agg(F.count_if(F.col("was") > depth).alias("promoted"), (F.count_if((F.col("rank") <= protect) & (F.col("was") != F.col("rank")))).alias("violations"), F.avg("was").alias("mean_was"))
    j = per.join(gold.select("q_id", F.lit(True).alias("answerable")), "q_id", "left").join(seen(selected, "a"), "q_id", "left").join(seen(pool.filter(F.col("rank") <= depth), "b"), "q_id", "left").join(seen(pool, "c"), "q_id", "left")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    n = F.count_if(yes("answerable"))
    return j.agg(
        F.count(F.lit(1)).alias("questions"), n.alias("answerable"), F.count_if(yes("c")).alias("in_pool"), F.count_if(yes("b")).alias("baseline_hits"), F.count_if(yes("a")).alias("selected_hits"),
        F.count_if(yes("a") & ~yes("b")).alias("gained"), F.count_if(~yes("a") & yes("b")).alias("lost"), F.sum("promoted").alias("promotions"), F.sum("violations").alias("violations"), F.round(F.avg("mean_was"), 4).alias("average_rank"),
    )


def case_aggregate(cases: DataFrame, in_context: Column) -> DataFrame:
    """One row over cases (answerable, refused, cited_gold, f1): hit, F1, citation and refusal counts and rates."""
    a, r = F.col("answerable"), F.col("final_refused")
    f1 = F.when(r, 0.0).otherwise(F.col("f1"))
    rate = lambda part, whole: F.round(M.ratio(F.count_if(part), F.count_if(whole)), 6)
    mean = lambda v, of: F.round(F.coalesce(F.avg(F.when(of, v)), F.lit(0.0)), 6)
    return cases.agg(
        F.count(F.lit(1)).alias("case_count"), F.count_if(a).alias("answerable_count"), F.count_if(~a).alias("unanswerable_count"), F.count_if(a & in_context).alias("context_gold_hit_count"), rate(a & in_context, a).alias("context_gold_hit_rate"),
        mean(f1, a).alias("average_f1_all_answerable"), mean(f1, a & ~r).alias("average_f1_completed_answerable"), F.count_if(a & ~r & F.col("cited_gold")).alias("gold_citation_count"), rate(a & ~r & F.col("cited_gold"), a).alias("gold_citation_rate"),
        F.count_if(a & r).alias("answerable_refusal_count"), rate(a & r, a).alias("answerable_refusal_rate"), F.count_if(~a & ~r).alias("false_answer_count"), rate(~a & ~r, ~a).alias("false_answer_rate"),
    )


def union_context(rows: DataFrame, depth: int = CONTEXT_DEPTH) -> DataFrame:
    """(q_id, doc_id, was, model, rank): the union of the first `depth` by fit and by rank, by falling model score.

    rows: (q_id, doc_id, was, fit, model).
    """
    both = top_k(rows, ["q_id"], [F.col("fit").desc(), F.col("was"), F.col("doc_id")], None, "_f").filter((F.col("_f") <= depth) | (F.col("was") <= depth))
    return top_k(both, ["q_id"], [F.col("model").desc(), F.col("was"), F.col("doc_id")], depth).select("q_id", "doc_id", "was", "model", "rank")
