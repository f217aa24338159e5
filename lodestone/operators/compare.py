"""Structured queries, screening rules, and comparisons of ranked lists and selections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.functions import metrics as M
from lodestone.functions import text as T
from lodestone.operators.retrieve import top_k

# The word lists of structured queries.
STOPWORDS = "a about after all also an and any are as at be been before being but by can cannot could customer did do does during for from get getting had has have help how i in is it its my need needs not of on or our please problem question saw see should that the their them there these they this those to urgent use used using was we were what when where which why will with would you your".split()
ACTION_TERMS = "apply change configure connect create delete disable enable fix install migrate recover remove repair reset resolve restart run set start stop troubleshoot update upgrade".split()
ERROR_TERMS = "abend exception failure fault stacktrace traceback warning".split()
PLATFORM_TERMS = "aix db2 ibm java linux mq oracle unix was websphere windows zos z/os".split()


def content(term: Column) -> Column:
    return (F.length(term) >= 3) & ~term.isin(STOPWORDS)


def error_or_log(term: Column) -> Column:
    return term.isin(ERROR_TERMS) | term.rlike("^(err|warn|0x)") | (term.rlike("[a-z]") & term.rlike("[0-9]") & (F.length(term) >= 3))


def version_or_platform(term: Column) -> Column:
    return term.isin(PLATFORM_TERMS) | term.rlike(r"^v?\d+(?:[._-]\d+)+$")


def noun_phrases(tokens: Column, size: int = 2) -> Column:
    """Terms of windows whose members are all content terms, first occurrence order."""
    n = F.size(tokens)
    runs = F.transform(F.sequence(F.lit(1), n - size + 1), lambda i: F.slice(tokens, i, size))
    kept = F.filter(runs, lambda w: F.forall(w, content))
    return F.when(n >= size, F.array_distinct(F.flatten(kept))).otherwise(F.array().cast("array<string>"))


def structured_terms(title: Column, text: Column, most: int = 16, least: int = 6) -> Column:
    """Distinct terms, bucket by bucket, cut at `most`; filled with content terms to `least`."""
    t = F.array_distinct(T.tokens(F.concat_ws("\n", title, text)))
    quoted = T.quoted_terms(F.concat_ws("\n", title, text))
    buckets = [
        F.filter(t, error_or_log),
        F.filter(t, version_or_platform),
        F.filter(t, lambda x: F.array_contains(quoted, x) | x.rlike(r"[_+#.\-]")),
        F.filter(t, lambda x: x.isin(ACTION_TERMS)),
        F.filter(F.array_distinct(T.tokens(title)), lambda x: content(x) | x.isin(ACTION_TERMS)),
    ]
    chosen = F.slice(F.array_distinct(F.concat(*buckets)), 1, most)
    filled = F.array_distinct(F.concat(chosen, F.filter(t, lambda x: content(x) | x.isin(ACTION_TERMS))))
    return F.when(F.size(chosen) >= least, chosen).otherwise(F.slice(filled, 1, most))


def query_variants(asked: DataFrame) -> DataFrame:
    """(q_id, variant, query): title, special tokens, and both."""
    special = F.array_join(T.special_tokens(F.col("text")), " ")
    forms = F.array(*[F.struct(F.lit(n).alias("variant"), q.alias("query")) for n, q in (("title", F.col("title")), ("special", special), ("title_special", F.trim(F.concat_ws(" ", "title", special))))])
    return asked.select("q_id", F.inline(forms)).filter(F.trim("query") != "")


def channel_features(lists: DataFrame, channels: list[str]) -> DataFrame:
    """(q_id, doc_id, a rank column a channel, votes, best inverse rank)."""
    wide = lists.groupBy("q_id", "doc_id").pivot("channel", channels).agg(F.min("rank"))
    votes = sum((F.col(c).isNotNull().cast("int") for c in channels), F.lit(0))
    best = F.greatest(*[M.inverse_rank(F.col(c)) for c in channels])
    return wide.withColumn("votes", votes).withColumn("best_inverse", F.round(best, 8))


def passes(rule: str) -> Column:
    """Named screening rules over channel and text features."""
    v, b = F.col("votes"), F.col("best_inverse")
    rules = {
        "route_vote_or_best_secondary_rank": (v >= 2) | (b >= 1 / 20),
        "strong_route_consensus_and_margin": (v >= 3) | ((v >= 2) & (b >= 1 / 20)),
        "low_confidence_tail_screen_only": F.col("rank") > 20,
        "special_token_exact_or_title_heading_match": (F.col("special") > 0) | (F.col("title_overlap") > 0),
        "route_vote_plus_evidence_density": (v >= 2) | (F.col("special") > 0) | (F.col("coverage") >= 0.3),
    }
    return rules[rule]


def view_coverage(asked: DataFrame, gold: DataFrame, first: DataFrame, second: DataFrame) -> DataFrame:
    """Gold found by only one view, by both, by neither."""
    wanted = gold.select("q_id", F.col("gold").alias("doc_id"))
    seen = lambda view, name: wanted.join(view.select("q_id", "doc_id").distinct(), ["q_id", "doc_id"], "left_semi").select("q_id", F.lit(True).alias(name))
    j = wanted.join(seen(first, "a"), "q_id", "left").join(seen(second, "b"), "q_id", "left")
    a, b = F.coalesce("a", F.lit(False)), F.coalesce("b", F.lit(False))
    return j.agg(F.count(F.lit(1)).alias("questions"), F.count_if(a & b).alias("both"), F.count_if(a & ~b).alias("only_first"), F.count_if(~a & b).alias("only_second"), F.count_if(~a & ~b).alias("neither"))


def alignment(left: DataFrame, right: DataFrame) -> DataFrame:
    """Per question: equal as lists, equal as sets, size of the symmetric difference."""
    listed = lambda d, name: d.groupBy("q_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "doc_id"))), lambda x: x["doc_id"]).alias(name))  # noqa: E731  ranked lists of bounded depth
    j = listed(left, "a").join(listed(right, "b"), "q_id")
    diff = F.size(F.array_except("a", "b")) + F.size(F.array_except("b", "a"))
    return j.select("q_id", (F.col("a") == F.col("b")).alias("same_order"), (diff == 0).alias("same_set"), diff.alias("difference"))


def winners(base: DataFrame, challenger: DataFrame, margin: float = 0.03) -> DataFrame:
    """Counts of wins by F1 margin, then by citing gold, else ties. Inputs: q_id, f1, cited_gold."""
    j = base.select("q_id", F.col("f1").alias("bf"), F.col("cited_gold").alias("bc")).join(challenger.select("q_id", F.col("f1").alias("cf"), F.col("cited_gold").alias("cc")), "q_id")
    d = F.col("cf") - F.col("bf")
    who = F.when(d >= margin, "challenger").when(d <= -margin, "baseline").when(F.col("cc") & ~F.col("bc"), "challenger").when(F.col("bc") & ~F.col("cc"), "baseline").otherwise("tie")
    return j.groupBy(who.alias("winner")).agg(F.count(F.lit(1)).alias("n"))


def feature_contrasts(rows: DataFrame, group: str, features: list[str]) -> DataFrame:
    """Mean of each feature by group, long form."""
    long = rows.select(group, F.inline(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in features])))
    return long.groupBy("feature", group).agg(F.round(F.avg("value"), 6).alias("mean"), F.count(F.lit(1)).alias("n"))


def fold_stability(rows: DataFrame, value: str, fold: str) -> DataFrame:
    """Spread of a metric's mean across folds."""
    per = rows.groupBy(fold).agg((F.sum(F.round(F.col(value) * 10_000).cast("bigint")) / F.count(value) / F.lit(10_000.0)).alias("m"))  # exact sums of 1e-4
    return per.agg(F.round(F.min("m"), 6).alias("lowest"), F.round(F.max("m"), 6).alias("highest"), F.round(F.max("m") - F.min("m"), 6).alias("spread"), F.round(F.avg("m"), 6).alias("average"))


def support_gate(candidates: DataFrame, score: float, rank: int, least: int) -> DataFrame:
    """Questions with at least `least` candidates over the score within the rank."""
    n = F.count_if((F.col("score") >= score) & (F.col("rank") <= rank))
    return candidates.groupBy("q_id").agg(n.alias("support")).withColumn("accepted", F.col("support") >= least)


def window_gate(rows: DataFrame, max_tokens: int = 90, max_sentences: int = 3, max_added: int = 60, max_ratio: float = 4.0, min_coverage: float = 0.5, min_signal: float = 0.0, block_problem_headings: bool = True, block_question_heading: bool = True, block_noise_growth: bool = True) -> DataFrame:
    """(…, replace): whether `window` may take the place of `sentence`."""
    sentence, window = F.col("sentence"), F.col("window")
    a, b = T.tokens(sentence), T.tokens(window)
    n, m = F.size(a), F.size(b)
    ok = (sentence != window) & (m <= max_tokens) & (F.size(T.sentences(window)) <= max_sentences) & (m - n <= max_added) & (m <= F.greatest(n, F.lit(1)) * max_ratio)
    ok = ok & (M.overlap_ratio(T.plain_terms(sentence), T.plain_terms(window)) >= min_coverage) & (T.answer_signal(window) - T.answer_signal(sentence) >= min_signal)
    if block_problem_headings:
        ok = ok & ~T.has(F.lower(window), T.NOISE_HEADING)
    if block_question_heading:
        ok = ok & ~T.has(F.lower(window), T.QUESTION_HEADING)
    if block_noise_growth:
        ok = ok & (T.problem_noise(window) <= T.problem_noise(sentence))
    return rows.withColumn("replace", ok)


def gate_outcomes(rows: DataFrame) -> DataFrame:
    """Per gate setting: F1 sums without windows, with all of them, and with those that pass. rows: (gate, replace, fs, fw)."""
    grains = lambda c: F.sum(F.round(c * 10_000).cast("bigint")) / F.lit(10_000.0)  # noqa: E731  exact sums of 1e-4
    g, s, w = F.col("replace"), F.col("fs"), F.col("fw")
    return rows.groupBy("gate").agg(F.count(F.lit(1)).alias("windows"), F.count_if(g).alias("replaced"), grains(s).alias("baseline_f1"), grains(w).alias("forced_f1"), grains(F.when(g, w).otherwise(s)).alias("gated_f1"), F.count_if(g & (w > s)).alias("improved"), F.count_if(g & (w < s)).alias("regressed"))


def anchored(rows: DataFrame, asked: DataFrame, docs: DataFrame, text: str = "text") -> DataFrame:
    """Order by twice the title overlap plus a quarter of the sentence overlap."""
    q = asked.select("q_id", F.array_distinct(T.tokens(F.col(text))).alias("_q"))
    d = docs.select("doc_id", F.array_distinct(T.tokens(F.col("title"))).alias("_t"))
    score = 2.0 * F.size(F.array_intersect("_q", "_t")) + 0.25 * F.size(F.array_intersect("_q", T.tokens(F.col("sentence"))))
    j = rows.join(q, "q_id").join(d, "doc_id").withColumn("anchor", score).drop("_q", "_t")
    return top_k(j, ["q_id"], [F.col("anchor").desc(), F.col("score").desc(), F.col("rank"), F.col("doc_id")], None, "anchored")


def evidence_summary(rows: DataFrame) -> DataFrame:
    """List-level features of a question's evidence."""
    s = F.col("score")
    return rows.groupBy("q_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id").alias("documents"), F.round(F.max(s), 4).alias("best"), F.round(F.avg(s), 4).alias("mean"), F.min("rank").alias("first_rank"), F.round(F.max(s) - F.avg(s), 4).alias("lead"), F.sum(F.size("overlap")).alias("overlap"))


def prefix_oracle(rows: DataFrame) -> DataFrame:
    """Best F1 over single sentences and over prefixes of one to three. Inputs: q_id, place, f1, prefix_f1."""
    w = W.partitionBy("q_id")
    return rows.withColumn("_m", F.max("f1").over(w)).groupBy("q_id").agg(F.max("f1").alias("best_single"), F.max("prefix_f1").alias("best_prefix"), F.max(F.when(F.col("place") == 1, F.col("f1"))).alias("first"))


def locality_bucket(query: Column, text: Column, start: Column, end: Column, section_tokens: Column, position: Column) -> Column:
    """Whether the text within 220 characters of the answer shares terms with the query.

    `query` is a set of tokens, `section_tokens` the token count of the gold
    section (null: none was found), `position` the answer's place in it, 0 to 1.
    """
    first = F.greatest(start - 220, F.lit(0))
    near = F.substring(text, first + 1, F.greatest(F.coalesce(F.nullif(end, F.lit(0)), start) + 220 - first, F.lit(0)))
    far = F.coalesce(M.overlap_ratio(query, F.array_distinct(T.tokens(near))), F.lit(0.0)) < 0.1
    return (
        F.when(text.isNull(), "gold_document_missing").when(section_tokens.isNull() | start.isNull(), "section_not_identified").when(far & (section_tokens > 220), "long_section_low_local_anchor")
        .when(far & (position <= 0.15), "boundary_early_low_local_anchor").when(far & (position >= 0.85), "boundary_late_low_local_anchor").when(far, "low_local_anchor").otherwise("local_anchor_present")
    )
