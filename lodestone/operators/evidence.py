"""Evidence selection: sentences or sentence windows of retrieved documents, ranked.

All state is per question, so each selector is one pipeline keyed by q_id.
Rows: (q_id, doc_id, rank, pos, sentence, scoring, terms, overlap, ...).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.functions import metrics as M
from lodestone.functions import text as T
from lodestone.operators.retrieve import top_k

MIN_CHARS, SPAN_SENTENCES = 24, 3


def _retrieved(results: DataFrame, docs: DataFrame) -> DataFrame:
    return results.select("q_id", "doc_id", "rank").join(docs.select("doc_id", "text"), "doc_id")


def sentence_rows(results: DataFrame, docs: DataFrame, least: int = MIN_CHARS) -> DataFrame:
    """One row a sentence of at least `least` characters; the first of equal ones a question."""
    each = _retrieved(results, docs).select("q_id", "doc_id", "rank", F.posexplode(T.sentences(F.col("text"))).alias("pos", "sentence"))
    each = each.filter(F.length("sentence") >= least).withColumn("scoring", F.col("sentence"))
    return _first(each)


def window_rows(results: DataFrame, docs: DataFrame, least: int = MIN_CHARS, most: int = SPAN_SENTENCES) -> DataFrame:
    """Windows of 1 .. most sentences inside the sections of a document, with their signals.

    Patterns, tokens and terms are read once a sentence of each retrieved
    document, whoever retrieved it.  A window adds up, joins or unites what its
    sentences and its heading have; only phrases of several words, which may lie
    across two sentences, are looked for in the joined text.
    """
    wanted = results.select("doc_id").distinct()
    parts = docs.select("doc_id", "text").join(wanted, "doc_id", "left_semi").select("doc_id", F.posexplode(T.sections(F.col("text"))).alias("part", "s"))
    parts = parts.select("doc_id", "part", F.col("s.heading").alias("heading"), *T.unit_signals(F.col("s.heading"), "h_"), F.filter(T.sentences(F.col("s.body")), lambda x: F.length(x) >= least).alias("sents"))
    heads = [c for c in parts.columns if c != "sents"]
    x = F.col("x")
    units = parts.select(*heads, F.size("sents").alias("n"), F.posexplode("sents").alias("i", "x")).select(*heads, "n", "i", "x", *T.unit_signals(x), F.size(T.tokens(x)).alias("toks"), T.content_terms(x).alias("terms"), F.substring(x, -1, 1).isin(".", "!", "?").cast("int").alias("ends"))
    near = W.partitionBy("doc_id", "part").orderBy("i")
    own = F.struct("x", "bits", "chars", "symbols", "foreign", "cves", "toks", "terms", "ends")
    units = units.select(*heads, "n", "i", *[(F.lead(own, k) if k else own).over(near).alias(f"u{k}") if k else own.alias("u0") for k in range(most)])

    def window(size: int) -> Column:
        us = [F.col(f"u{k}") for k in range(size)]
        total = lambda c, more=0: reduce(lambda a, b: a + b, [u[c] for u in us]) + more
        union = lambda c: F.array_distinct(F.concat(*[u[c] for u in us])) if size > 1 else us[0][c]
        # Windows of smaller sizes come first; n - k + 1 of size k each.
        before = sum((F.col("n") - k + 1 for k in range(1, size)), F.lit(0))
        text = F.concat_ws(" ", *[u["x"] for u in us])
        bits = reduce(lambda a, b: a.bitwiseOR(b), [u["bits"] for u in us])
        ends = reduce(lambda a, b: a + b, [u["ends"] for u in us[:-1]], F.lit(1))
        return F.when(us[-1].isNotNull(), F.struct(text.alias("sentence"), bits.alias("bits"), total("chars", size - 1).alias("chars"), total("symbols").alias("symbols"), total("foreign").alias("foreign"), union("cves").alias("cves"), total("toks").alias("toks"), union("terms").alias("terms"), ends.alias("sents"), (before + F.col("i")).alias("at"), F.lit(size).alias("size")))

    rows = units.select(*heads, F.inline(F.array_compact(F.array(*[window(k) for k in range(1, most + 1)]))))
    headed = F.col("heading") != ""
    scoring = F.when(headed, F.concat_ws(" ", "heading", "sentence")).otherwise(F.col("sentence"))
    bits = F.col("bits").bitwiseOR(F.col("h_bits")).bitwiseOR(F.when(headed | (F.col("size") > 1), T.phrase_bits(scoring)).otherwise(F.lit(0).cast("bigint")))
    chars = F.col("chars") + F.when(headed, F.col("h_chars") + 1).otherwise(0)
    rows = rows.select(
        "doc_id", (F.col("part") * 100_000 + F.col("at")).alias("pos"), "sentence", scoring.alias("scoring"), "terms", bits.alias("w_bits"), chars.alias("w_chars"), (F.col("symbols") + F.col("h_symbols")).alias("w_symbols"),
        (F.col("foreign") + F.col("h_foreign")).alias("w_foreign"), F.array_distinct(F.concat("h_cves", "cves")).alias("w_cves"), F.col("toks").alias("w_tokens"), F.col("sents").alias("w_sentences"), F.md5(F.col("sentence").cast("binary")).alias("_key"),
    )
    each = results.select("q_id", "doc_id", "rank").join(rows, "doc_id")
    return top_k(each, ["q_id", "_key"], [F.col("rank"), F.col("pos")], 1, "_n").drop("_n", "_key")


WINDOW_SIGNALS = ("w_bits", "w_chars", "w_symbols", "w_foreign", "w_tokens", "w_sentences", "w_cves")


def signals_of(rows: DataFrame) -> T.Signals | None:
    """The kept signals of windows; None for rows whose texts are read."""
    return T.Kept(*[F.col(c) for c in WINDOW_SIGNALS]) if WINDOW_SIGNALS[0] in rows.columns else None


def _first(rows: DataFrame) -> DataFrame:
    return top_k(rows, ["q_id", "sentence"], [F.col("rank"), F.col("pos")], 1, "_n").drop("_n")


def overlap_ranked(rows: DataFrame, asked: DataFrame, text: str = "text") -> DataFrame:
    """Shared tokens over log2(rank + 1)."""
    q = asked.select("q_id", F.array_distinct(T.tokens(F.col(text))).alias("qt"))
    n = F.size(F.array_intersect("qt", T.tokens(F.col("sentence"))))
    scored = rows.join(q, "q_id").withColumn("overlap", n).filter("overlap > 0").withColumn("score", F.round(F.col("overlap") / F.log2(F.col("rank") + 1), 9))
    return evidence_order(scored)


def evidence_order(scored: DataFrame, cap: int | None = None) -> DataFrame:
    """Order by score, rank, id, place; with a cap, that many of each document."""
    order = [F.col("score").desc(), F.col("rank"), F.col("doc_id"), F.col("pos")]
    if cap:
        scored = top_k(scored, ["q_id", "doc_id"], order, cap, "_own").drop("_own")
    return top_k(scored, ["q_id"], order, None, "place")


def with_terms(rows: DataFrame, asked: DataFrame, text: str = "text") -> DataFrame:
    """Content terms of each row, those it shares with its question, and the question's CVE ids."""
    q = asked.select("q_id", T.content_terms(F.col(text)).alias("qt"))
    wanted = F.filter("qt", lambda t: T.has(t, f"^{T.CVE}$"))
    terms = rows if "terms" in rows.columns else rows.withColumn("terms", T.content_terms(F.col("sentence")))
    out = terms.join(q, "q_id").withColumn("wanted", wanted)
    return out.withColumn("overlap", F.array_intersect("qt", "terms")).drop("qt")


def bm25_scored(rows: DataFrame, k1: float = 1.2, b: float = 0.35, scale: float = 2.5) -> DataFrame:
    """Candidate-local BM25 over term sets, with overlap bonus, rank prior and noise penalty."""
    own = W.partitionBy("q_id")
    sized = rows.withColumn("n", F.count(F.lit(1)).over(own)).withColumn("mean", F.avg(F.size("terms")).over(own))
    norm = 1 - F.lit(b) + F.when(F.col("mean") > 0, F.lit(b) * F.size("terms") / F.col("mean")).otherwise(F.lit(0.0))
    each = sized.select("q_id", "doc_id", "pos", "n", norm.alias("norm"), F.explode("overlap").alias("term"))
    each = each.withColumn("df", F.count(F.lit(1)).over(W.partitionBy("q_id", "term")))
    part = M.idf(F.col("n"), F.col("df")) * (k1 + 1) / (1 + F.lit(k1) * F.col("norm"))
    sums = each.groupBy("q_id", "doc_id", "pos").agg(F.sum(part).alias("bm25"))
    base = F.coalesce("bm25", F.lit(0.0)) + 0.25 * F.size("overlap")
    score = base * (1 + 0.35 / F.log2(F.col("rank") + 1)) * T.noise_penalty(F.col("scoring"), signals_of(rows)) * scale
    return rows.join(sums, ["q_id", "doc_id", "pos"], "left").withColumn("score", score).drop("bm25")


def _rounded(df: DataFrame, score: Column) -> DataFrame:
    return df.withColumn("score", F.round(score, 9))


def bm25_ranked(rows: DataFrame, cap: int = 1) -> DataFrame:
    return evidence_order(_rounded(bm25_scored(rows.filter(F.size("overlap") > 0)), F.col("score")), cap)


def _answer_scored(rows: DataFrame) -> DataFrame:
    s, own = F.col("scoring"), signals_of(rows)
    admitted = rows.filter((F.size("overlap") > 0) | (T.answer_bonus(s, own) > 0))
    return bm25_scored(admitted).withColumn("score", (F.col("score") + T.answer_bonus(s, own)) * T.answer_multiplier(s, own) * T.problem_penalty(s, own))


def answer_aware_ranked(rows: DataFrame, cap: int = 1) -> DataFrame:
    return evidence_order(_rounded(_answer_scored(rows), F.col("score")), cap)


def answer_window_ranked(rows: DataFrame, cap: int = 1) -> DataFrame:
    s, span, own = F.col("scoring"), F.col("sentence"), signals_of(rows)
    score = (F.col("score") + T.action_bonus(s, own)) * T.compact_multiplier(span, s, own) * T.length_penalty(span, 140, 95, own)
    return evidence_order(_rounded(_answer_scored(rows), score), cap)


def section_span_ranked(rows: DataFrame, cap: int = 1) -> DataFrame:
    s, span, wanted, own = F.col("scoring"), F.col("sentence"), F.col("wanted"), signals_of(rows)
    score = (F.col("score") + T.span_bonus(s, own) + T.cve_bonus(s, wanted, own)) * T.cve_multiplier(s, wanted, own)
    score = score * T.background_penalty(s, own) * T.reference_penalty(s, own) * T.length_penalty(span, 180, 120, own)
    return evidence_order(_rounded(_answer_scored(rows), score), cap)


def routed(branches: list[tuple], routes: DataFrame) -> DataFrame:
    """Union of selectors, each made for the questions of its routes alone.

    branches: (function of a table of q_id to ranked rows, condition on `route`).
    """
    out = None
    for make, condition in branches:
        own = routes.filter(condition)
        part = make(own.select("q_id")).join(own.select("q_id", "route"), "q_id")
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def route_trace(routes: DataFrame, spanned: tuple[str, ...]) -> DataFrame:
    """Which selector each routed strategy takes for a question."""
    span, other = F.col("route").isin(*spanned), F.col("route") == "other"
    routed_ = F.when(span, "section_span").otherwise("answer_aware")
    return routes.select("q_id", "route", F.when(other, "answer_window").otherwise(routed_).alias("windowed"), routed_.alias("routed"), F.when(other, "local_window").otherwise("routed").alias("reranked"))


def local_windows(chosen: DataFrame, docs: DataFrame, asked: DataFrame, least: int = MIN_CHARS, most: int = 3, text: str = "text") -> DataFrame:
    """For each chosen sentence, the best window of its document around it.

    Anchors are the document's sentences that equal a sentence of the candidate,
    else contain it or lie in it, else the one that shares most of its terms.
    """
    terms = T.plain_terms
    own = chosen.select("q_id", "doc_id", "pos", "sentence").join(docs.select("doc_id", "text"), "doc_id").join(asked.select("q_id", terms(F.col(text)).alias("qt")), "q_id")
    sents = F.filter(T.sentences(F.col("text")), lambda x: F.length(x) >= least)
    own = own.select("q_id", "doc_id", "pos", "sentence", "qt", sents.alias("sents"), T.sentences(F.col("sentence")).alias("parts"), terms(F.col("sentence")).alias("at"))
    places = F.sequence(F.lit(1), F.size("sents"))
    exact = F.filter(places, lambda i: F.array_contains(F.col("parts"), F.element_at("sents", i)))
    near = F.filter(places, lambda i: F.col("sentence").contains(F.element_at("sents", i)) | F.element_at("sents", i).contains(F.col("sentence")))
    share = F.transform(places, lambda i: F.struct(M.overlap_ratio(F.col("at"), terms(F.element_at("sents", i))).alias("r"), i.alias("i")))
    best = F.filter(F.array(F.array_max(share)), lambda s: s["r"] >= 0.6)
    anchors = F.when(F.size(exact) > 0, exact).when(F.size(near) > 0, near).otherwise(F.transform(best, lambda s: s["i"]))
    each = own.filter(F.size("sents") > 0).withColumn("anchor", F.explode(anchors))
    start = F.explode(F.sequence(F.greatest(F.lit(1), F.col("anchor") - (most - 1)), F.col("anchor")))
    each = each.withColumn("start", start)
    end = F.explode(F.sequence(F.col("anchor"), F.least(F.size("sents"), F.col("start") + (most - 1))))
    each = each.withColumn("end", end).withColumn("window", F.array_join(F.slice("sents", F.col("start"), F.col("end") - F.col("start") + 1), " "))
    w = F.col("window")
    n, k, low = F.size(T.tokens(w)), F.size(T.sentences(w)), F.lower(w)
    compact = F.when(k == 1, 0.4).when((k == 2) & (n <= 80), 0.3).when((k == 3) & (n <= 100), 0.1).otherwise(-0.2)
    noise = T.bonus(n > 100, 0.8) + T.bonus(n > 140, 1.2) + T.bonus(T.has(low, T.TRACE), 0.4)
    score = F.size(F.array_intersect("qt", terms(w))) + 1.5 * M.overlap_ratio(F.col("at"), terms(w)) + T.answer_signal(w) + compact - noise
    scored = each.select("q_id", "doc_id", "pos", "window", F.round(score, 9).alias("local"), n.alias("n")).distinct()
    return top_k(scored, ["q_id", "doc_id", "pos"], [F.col("local").desc(), F.col("n"), F.col("window").desc()], 1, "_n").drop("_n", "n")
