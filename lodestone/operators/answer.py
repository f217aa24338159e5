"""Composition, verification and refusal of cited answers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions import metrics as M
from lodestone.functions import text as T
from lodestone.operators.retrieve import top_k

REFUSAL = "I do not have enough retrieved evidence to answer this question."
MIN_SCORE, MAX_SENTENCES = 2.0, 3
#: Routes that keep all their sentences, and routes that may answer with one.
CITED_ROUTES = ("security_bulletin_affected_product", "security_bulletin_remediation", "security_bulletin_vulnerability_detail", "security_bulletin_post_fix_behavior", "limitation_or_restriction")
DIRECT_ROUTES = ("how_to_or_lookup", "install_upgrade_config")


def composed(ranked: DataFrame, asked: DataFrame, least: float = MIN_SCORE, most: int = MAX_SENTENCES) -> DataFrame:
    """answers(q_id, answer, citations, refused): the best sentences, each with its document."""
    top = top_k(ranked.filter(F.col("score") >= least), ["q_id"], [F.col("place")], most, "slot")
    cite = F.struct("slot", "doc_id", "rank", F.round("score", 4).alias("score"), "sentence")
    lists = top.groupBy("q_id").agg(F.array_sort(F.collect_list(cite)).alias("c"))  # at most `most` rows a question
    out = asked.select("q_id").join(lists, "q_id", "left")
    text = F.array_join(F.transform("c", lambda x: F.concat(x["sentence"], F.lit(" ["), x["doc_id"], F.lit("]"))), " ")
    cites = F.coalesce(F.transform("c", lambda x: F.struct(x["doc_id"].alias("doc_id"), x["rank"].alias("rank"), x["score"].alias("score"))), F.array().cast("array<struct<doc_id:string,rank:int,score:double>>"))
    return out.select("q_id", F.coalesce(text, F.lit(REFUSAL)).alias("answer"), cites.alias("citations"), F.col("c").isNull().alias("refused"))


def verified(answers: DataFrame, results: DataFrame, least: int = 1, score: float = 8.0, rank: int = 3) -> DataFrame:
    """Adds context_valid, reasons and final_refused; tests the best score and rank of all citations."""
    context = results.groupBy("q_id").agg(F.collect_set("doc_id").alias("context"))
    a = answers.join(context, "q_id", "left").withColumn("context", F.coalesce("context", F.array().cast("array<string>")))
    cited = F.transform("citations", lambda c: c["doc_id"])
    valid = F.size(F.array_except(cited, "context")) == 0
    some = F.size("citations") > 0
    best, first = F.array_max(F.transform("citations", lambda c: c["score"])), F.array_min(F.transform("citations", lambda c: c["rank"]))
    checks = [(F.size("citations") < least, "not_enough_citations"), (~valid, "citation_not_in_retrieved_context"), (some & (best < score), "weak_evidence_score"), (some & (first > rank), "citation_rank_too_low")]
    failed = F.array_compact(F.array(*[F.when(c, F.lit(name)) for c, name in checks]))
    reasons = F.when(F.col("refused"), F.array(F.lit("already_refused"))).when(F.size(failed) > 0, failed).otherwise(F.array(F.lit("verified")))
    out = a.withColumn("context_valid", F.col("refused") | valid).withColumn("reasons", reasons)
    return out.withColumn("final_refused", ~F.array_contains("reasons", "verified")).drop("context")


def route_composed(ranked: DataFrame, routes: DataFrame, score_min: float = 100.0, ratio_min: float = 1.15, margin_min: float = 20.0, install_margin_min: float = 60.0, how_to: bool = False, rank_max: int = 3, duplicate: float = 0.96) -> DataFrame:
    """(q_id, decision, kept): three sentences, one strong one, or near-duplicates of a document removed.

    A strong first sentence beats the second by ratio or by margin; questions
    about installing go by a margin of their own alone, and look-ups answer
    with one sentence only if `how_to` is set.
    """
    top = top_k(ranked, ["q_id"], [F.col("place")], MAX_SENTENCES, "slot")
    row = F.struct("slot", "doc_id", "rank", "score", "sentence", F.array_distinct(T.tokens(F.col("sentence"))).alias("terms"))
    lists = top.groupBy("q_id").agg(F.array_sort(F.collect_list(row)).alias("c")).join(routes, "q_id")  # three rows a question
    first, second = F.col("c")[0], F.get("c", F.lit(1))
    rest, install = F.greatest(second["score"], F.lit(0.0)), F.col("route") == "install_upgrade_config"
    margin = first["score"] - rest >= F.when(install, install_margin_min).otherwise(margin_min)
    lead = second.isNull() | (rest == 0) | (~install & (first["score"] / rest >= ratio_min)) | margin
    strong = (first["score"] >= score_min) & (first["rank"] <= rank_max) & T.has(F.lower(first["sentence"]), T.COMPOSE_SIGNAL) & lead
    direct = F.col("route").isin(*[r for r in DIRECT_ROUTES if how_to or r != "how_to_or_lookup"])
    same = lambda a, b: (a["doc_id"] == b["doc_id"]) & (M.jaccard(a["terms"], b["terms"]) >= duplicate)
    some = F.filter("c", lambda x: F.size(x["terms"]) > 0)
    unique = F.aggregate(some, F.filter("c", lambda x: F.lit(False)), lambda acc, x: F.when(F.exists(acc, lambda y: same(x, y)), acc).otherwise(F.concat(acc, F.array(x))))
    decision = (
        F.when(F.col("route").isin(*CITED_ROUTES), "keep_top3_citation_sensitive").when(direct & strong, "top1_direct_strong_signal")
        .when(F.size(unique) < F.size("c"), "dedup_same_document").otherwise("keep_top3_default")
    )
    kept = F.when(decision == "top1_direct_strong_signal", F.slice("c", 1, 1)).when(decision == "dedup_same_document", unique).otherwise(F.col("c"))
    return lists.select("q_id", "route", decision.alias("decision"), F.array_join(F.transform(kept, lambda x: x["slot"].cast("string")), ",").alias("kept"))
