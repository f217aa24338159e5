"""Queries of diagnosis: workflow sequences, resampling, causes of misses, proxies, paired arms, waterfalls, candidate sets."""

from __future__ import annotations

from copy import copy

from pyspark.sql import functions as F

from lodestone.functions import metrics as M
from lodestone.functions import text as T
from lodestone.operators import answer, diagnose, evidence, fuse, retrieve, workflow
from lodestone.operators.retrieve import ranked, top_k
from lodestone.plans import sql as S
from lodestone.plans.evidence import _LABELS, _PAIR, BM25_ROWS, CASES, EV, ROUTES, Evidence, _pair, cases, placed
from lodestone.plans.ranking import FOLDS, fold
from lodestone.plans.retrieval import _WEIGHTED, ALL, FIT, POOL, PREFIX, WEIGHTS, Setting, with_fit
from lodestone.plans.scalars import signal_sql
from lodestone.sources import tables as R
from lodestone.sources.scratch import stored

QUERIES, ORACLES = {}, {}


def query(oracle: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


# ---- workflow -----------------------------------------------------------------

_TABLE = ", ".join(str(x) for x in workflow.ITERATIVE)
_STEPS = """ca AS (SELECT conv_id, turn, role, text, sum((role = 'user')::INT) OVER (PARTITION BY conv_id ORDER BY turn) + (role = 'system')::INT AS u FROM conversations),
cb AS (SELECT conv_id || '/' || u AS run, turn, unnest(a) AS action, generate_subscripts(a, 1) AS step FROM (SELECT *, CASE WHEN role = 'system' THEN ['validate'] WHEN role = 'user' THEN ['validate', 'retrieve', 'prepare'] WHEN strlen(text) >= 1000 THEN ['initial_compose', 'compose', 'verify', 'observe', 'complete'] WHEN strlen(text) >= 600 THEN ['initial_inspect', 'inspect', 'final_compose', 'compose', 'verify', 'observe', 'complete'] WHEN strlen(text) >= 300 THEN ['initial_clarify', 'clarify'] ELSE ['initial_refuse', 'refuse'] END AS a FROM ca)),
st AS MATERIALIZED (SELECT run, action, row_number() OVER (PARTITION BY run ORDER BY turn, step) AS seq FROM cb)"""


@query(f"WITH RECURSIVE t(state, action, next_state) AS (VALUES {_TABLE}), {_STEPS}, w AS (SELECT run, 0::BIGINT AS seq, 'received' AS state FROM (SELECT DISTINCT run FROM st) UNION ALL SELECT st.run, st.seq, t.next_state FROM w JOIN st ON st.run = w.run AND st.seq = w.seq + 1 JOIN t ON t.state = w.state AND t.action = st.action), e AS (SELECT run, max(seq) AS valid, arg_max(state, seq) AS state FROM w GROUP BY run), n AS (SELECT run, count(*) AS steps FROM st GROUP BY run) SELECT run, steps, valid::INT AS valid_steps, state, CASE WHEN valid < steps THEN 'invalid' WHEN state IN ('complete', 'refuse', 'clarify') THEN state ELSE 'incomplete' END AS status FROM e JOIN n USING (run)")
def workflow_sequences(spark, d):
    return workflow.checked_sequences(workflow.turn_actions(R.table(spark, d, "conversations")))


@query(S.query([S.BM25, "ae AS (SELECT q_id, doc_id, rank, row_number() OVER (PARTITION BY q_id ORDER BY rank, doc_id) AS n FROM br JOIN docs USING (doc_id) WHERE rank <= 20 AND lang = 'en' QUALIFY n <= 10)", "ag AS (SELECT q_id, count(*) AS listed, count(*) FILTER (rank = n) AS fine, string_agg(doc_id, ',' ORDER BY n) AS documents FROM ae GROUP BY q_id)", "ap AS (SELECT *, CASE WHEN listed < 10 THEN 'too_few' WHEN fine < 10 THEN 'ranks_not_contiguous' ELSE '' END AS problem FROM ag)"], "SELECT q_id, listed, CASE WHEN problem = '' THEN documents ELSE '' END AS documents, problem FROM ap"))
def alternate_evidence(spark, d):
    """English documents of the first twenty as a pool: where another language ranks among them, ranks have gaps."""
    s = Setting(spark, d)
    return workflow.alternate_evidence(s.bm25(20).join(s.docs.filter("lang = 'en'").select("doc_id"), "doc_id"))


# ---- resampling -----------------------------------------------------------------

REPLICATES = 200
_W = " + ".join(f"(u >= {c!r}::DOUBLE)::INT" for c in diagnose.POISSON)
_BOOT = [*_PAIR, "dl AS MATERIALIZED (SELECT q_id, CASE WHEN c < 1000000000 THEN 1 / c ELSE 0 END - CASE WHEN b < 1000000000 THEN 1 / b ELSE 0 END AS v FROM j)", f"bu AS (SELECT r, v, (('0x' || md5(r || '|' || q_id)[1:13])::BIGINT + 0.5::DOUBLE) / {2**52}.0::DOUBLE AS u FROM dl, (SELECT unnest(range(1, {REPLICATES} + 1)) AS r))", f"bw AS (SELECT r, v, {_W} AS w FROM bu)", "bs2 AS (SELECT r, CASE WHEN sum(w) > 0 THEN sum(w * v) / sum(w) ELSE 0 END AS mean, count(*) AS n, sum(v) AS total FROM bw GROUP BY r)"]


@query(S.query(_BOOT, "SELECT max(n) AS rows, round(max(total) / max(n), 6) AS mean, round(quantile_cont(mean, 0.025), 6) AS mean_low, round(quantile_cont(mean, 0.975), 6) AS mean_high, round(max(total), 6) AS sum, round(quantile_cont(mean * n, 0.025), 6) AS sum_low, round(quantile_cont(mean * n, 0.975), 6) AS sum_high FROM bs2"))
def poisson_bootstrap(spark, d):
    """Reciprocal-rank change of titles against whole documents, with Poisson bootstrap intervals."""
    b, c = _pair(spark, d)
    rr = lambda x: F.coalesce(1 / x["rank"], F.lit(0.0))
    deltas = b.select("q_id", rr(b).alias("x")).join(c.select("q_id", rr(c).alias("y")), "q_id").select("q_id", (F.col("y") - F.col("x")).alias("v"))
    return diagnose.poisson_bootstrap(stored(deltas, "deltas"), "q_id", "v", REPLICATES)


# ---- causes of context misses -------------------------------------------------------

FOUND = 50  # ranks beyond count as not found


def miss_cases(s):
    """What the bucket families read, for each question with a gold document; its section is the line that shares most with the question."""
    gold = s.gold.withColumnRenamed("gold", "doc_id")
    qt = s.asked.select("q_id", F.array_distinct(T.tokens(F.col("text"))).alias("qt"), T.special_tokens(F.col("text")).alias("qs"))
    g = stored(gold.join(qt, "q_id").join(s.found(gold).select("doc_id", "title", "text"), "doc_id"), "gold")
    lines = g.select("q_id", "qt", F.size(F.split("text", "\n")).alias("lines"), F.posexplode(F.split("text", "\n")).alias("pos", "line")).filter(F.trim("line") != "").withColumn("toks", T.tokens(F.col("line")))
    lines = lines.withColumn("shared", F.size(F.array_intersect("qt", "toks")))
    section = top_k(lines, ["q_id"], [F.col("shared").desc(), F.col("pos")], 1, "_n").select("q_id", "shared", F.size("toks").alias("section_tokens"), F.round((F.col("pos") + 0.5) / F.col("lines"), 4).alias("position"))
    bm = s.bm25(FOUND)
    top = bm.filter("rank <= 10").join(s.found(bm.filter("rank <= 10")).select("doc_id", F.size(T.tokens(F.col("text"))).alias("n")), "doc_id").groupBy("q_id").agg(F.percentile("n", F.lit(0.5)).alias("top10_median"))
    at = lambda rows, name: rows.join(gold, ["q_id", "doc_id"]).select("q_id", F.col("rank").alias(name))
    n_q = F.size("qt")
    share = lambda c: F.round(F.when(n_q > 0, c / n_q).otherwise(F.lit(0.0)), 6)
    special = F.concat_ws("\n", "title", "text")
    base = g.select("q_id", "qt", n_q.alias("n_query"), share(F.size(F.array_intersect("qt", T.tokens(F.col("title"))))).alias("title_ratio"), F.size(T.tokens(F.col("text"))).alias("gold_tokens"), F.size("qs").alias("n_special"), F.size(F.array_intersect("qs", T.special_tokens(special))).alias("special_found"))
    j = base.join(section, "q_id", "left").join(top, "q_id", "left").join(at(bm, "doc_rank"), "q_id", "left").join(at(s.title(FOUND), "title_rank"), "q_id", "left").join(at(s.section(FOUND), "section_rank"), "q_id", "left")
    return j.withColumn("section_ratio", share(F.coalesce("shared", F.lit(0)))).drop("qt", "shared")


def _miss_sql() -> list[str]:
    special = lambda x: f"list_distinct(regexp_extract_all(lower({x}), {S.lit(T.SPECIAL)}))"
    near = lambda c: f"coalesce({c} <= 10, false)"
    return [
        *ALL, S.GOLD,
        f"mg AS MATERIALIZED (SELECT gold.q_id, gold AS doc_id, list_distinct({S.toks('q.text')}) AS qt, {special('q.text')} AS qs, d.title, d.text FROM gold JOIN ques q USING (q_id) JOIN docs d ON d.doc_id = gold)",
        "ml AS (SELECT q_id, qt, len(string_split(text, chr(10))) AS lines, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM mg)",
        f"mo AS (SELECT q_id, lines, pos, len({S.toks('line')}) AS section_tokens, len(list_intersect(qt, {S.toks('line')})) AS shared FROM ml WHERE trim(line, ' ') <> '' QUALIFY row_number() OVER (PARTITION BY q_id ORDER BY shared DESC, pos) = 1)",
        f"mt AS (SELECT q_id, quantile_cont(len({S.toks('d.text')}), 0.5) AS top10_median FROM br JOIN docs d USING (doc_id) WHERE rank <= 10 GROUP BY q_id)",
        f"mc AS MATERIALIZED (SELECT mg.q_id, len(qt) AS n_query, round(len(list_intersect(qt, {S.toks('title')})) / len(qt), 6) AS title_ratio, len({S.toks('text')}) AS gold_tokens, len(qs) AS n_special, len(list_intersect(qs, {special('title || chr(10) || text')})) AS special_found, section_tokens, round((pos + 0.5::DOUBLE) / lines, 4) AS position, round(coalesce(shared, 0) / len(qt), 6) AS section_ratio, top10_median, b.rank AS doc_rank, t.rank AS title_rank, s.rank AS section_rank FROM mg LEFT JOIN mo USING (q_id) LEFT JOIN mt USING (q_id) "
        + " ".join(f"LEFT JOIN {r} {a} ON {a}.q_id = mg.q_id AND {a}.doc_id = mg.doc_id AND {a}.rank <= {FOUND}" for r, a in (("br", "b"), ("tr", "t"), ("sr", "s"))) + ")",
        f"""mb AS MATERIALIZED (SELECT q_id, coalesce(doc_rank > 10, true) AS missed,
CASE WHEN n_query <= 3 AND section_ratio < 0.25 THEN 'short_query_low_gold_overlap' WHEN section_ratio = 0 THEN 'zero_gold_section_overlap' WHEN section_ratio < 0.1 THEN 'very_low_gold_section_overlap_lt_0_10' WHEN section_ratio < 0.25 THEN 'low_gold_section_overlap_lt_0_25' WHEN section_ratio < 0.5 THEN 'moderate_gold_section_overlap_lt_0_50' ELSE 'strong_gold_section_overlap' END AS query_expression_gap,
CASE WHEN title_ratio = 0 THEN 'zero_title_heading_overlap' WHEN title_ratio < 0.1 THEN 'very_low_title_heading_overlap_lt_0_10' WHEN title_ratio < 0.25 THEN 'low_title_heading_overlap_lt_0_25' ELSE 'title_or_heading_overlap_present' END AS title_heading_mismatch,
CASE WHEN section_tokens IS NULL THEN 'section_not_identified' WHEN section_ratio < 0.1 AND section_tokens > 220 THEN 'long_section_low_local_anchor' WHEN section_ratio < 0.1 AND position <= 0.15 THEN 'boundary_early_low_local_anchor' WHEN section_ratio < 0.1 AND position >= 0.85 THEN 'boundary_late_low_local_anchor' WHEN section_ratio < 0.1 THEN 'low_local_anchor' ELSE 'local_anchor_present' END AS section_boundary_or_span_locality,
CASE WHEN top10_median > 0 AND gold_tokens >= top10_median * 2.5 AND gold_tokens > 1000 THEN 'gold_document_much_longer_than_top10' WHEN gold_tokens > 3000 THEN 'very_long_gold_document' WHEN gold_tokens > 1000 THEN 'long_gold_document' WHEN gold_tokens > 300 THEN 'medium_gold_document' ELSE 'short_gold_document' END AS long_document_score_dilution,
CASE WHEN n_special = 0 THEN 'no_special_query_tokens' WHEN special_found = 0 THEN 'special_tokens_absent_in_gold_context' WHEN special_found = n_special THEN 'special_tokens_matched' ELSE 'partial_special_token_overlap' END AS entity_version_error_code_mismatch,
CASE WHEN doc_rank IS NULL AND ({near('title_rank')} OR {near('section_rank')}) THEN 'section_or_title_diagnostic_top10' WHEN doc_rank > 10 AND {near('section_rank')} THEN 'section_rank_beats_doc_rollup' WHEN doc_rank > 10 AND {near('title_rank')} THEN 'title_rank_beats_doc_rollup' WHEN doc_rank BETWEEN 11 AND 20 THEN 'near_miss_rank_11_to_20' WHEN doc_rank IS NULL THEN 'gold_doc_not_found_top50' ELSE 'weak_index_structure_signal' END AS bm25_field_weighting_or_index_structure FROM mc)""",
        "mx AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT q_id, missed, {i} AS place, '{k}' AS family, {k} AS bucket FROM mb" for i, (k, _) in enumerate(diagnose.CAUSES)) + ")",
    ]


_MISS = _miss_sql()
_FIXED = "rl AS (SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{b}')" for k, bs in diagnose.CAUSES for b in bs) + ") v(family, bucket))"
_LEARNT = "rl AS MATERIALIZED (SELECT place, family, bucket, count(*) AS n, avg(missed::INT) AS rate, (SELECT avg(missed::INT) FROM mb) AS overall FROM mx GROUP BY place, family, bucket HAVING count(*) >= 2 AND avg(missed::INT) > (SELECT avg(missed::INT) FROM mb))"
_CAUSE = "SELECT q_id, coalesce(arg_min(mx.family, place) FILTER (rl.bucket IS NOT NULL), 'mixed_or_low_confidence') AS cause, count(rl.bucket) AS signals, CASE WHEN count(rl.bucket) >= 3 THEN 'high_multi_signal' WHEN count(rl.bucket) = 2 THEN 'medium_two_signal' WHEN count(rl.bucket) = 1 THEN 'low_single_signal' ELSE 'low_no_high_signal' END AS confidence FROM mx LEFT JOIN (SELECT family, bucket FROM rl) rl ON rl.family = mx.family AND rl.bucket = mx.bucket WHERE missed GROUP BY q_id"


def _buckets(spark, d):
    return diagnose.miss_buckets(miss_cases(Setting(spark, d)))


@query(S.query(_MISS, "SELECT * FROM mb"))
def context_miss_buckets(spark, d):
    return _buckets(spark, d)


@query(S.query([*_MISS, _FIXED], _CAUSE))
def context_miss_causes(spark, d):
    return diagnose.root_causes(_buckets(spark, d), diagnose.fixed_rules(spark))


@query(S.query([*_MISS, _LEARNT], "SELECT place, family, bucket, n, round(rate, 6) AS rate, round(rate - overall, 6) AS lift FROM rl"))
def context_miss_rules(spark, d):
    return diagnose.learned_rules(stored(_buckets(spark, d), "buckets"))


@query(S.query([*_MISS, _LEARNT], _CAUSE))
def context_miss_learned_causes(spark, d):
    b = stored(_buckets(spark, d), "buckets")
    return diagnose.root_causes(b, stored(diagnose.learned_rules(b), "rules"))


# ---- evidence proxies -----------------------------------------------------------------

_VIEWS = [S.BM25, FIT, S.GOLD,
    "gk AS (SELECT ques.q_id, gold, (SELECT rank FROM br WHERE br.q_id = ques.q_id AND br.doc_id = gold AND rank <= 50) AS rank FROM ques LEFT JOIN gold USING (q_id))",
    "vw AS MATERIALIZED (SELECT f.q_id, phase, CASE WHEN gold IS NULL THEN 'unanswerable' WHEN gk.rank <= 5 THEN 'initial_gold_visible' WHEN gk.rank <= 10 THEN 'alternate_only_gold_visible' WHEN gk.rank IS NOT NULL THEN 'union_gold_missing_candidate_hit' ELSE 'candidate_pool_gold_missing' END AS stratum, coalesce(gk.rank <= depth, false)::INT AS label, round(max(fit) / (max(fit) + 20), 6) AS score FROM fits f JOIN (VALUES ('initial', 5), ('final', 10)) v(phase, depth) ON f.rank <= depth JOIN gk USING (q_id) GROUP BY ALL)",
    "vy AS MATERIALIZED (SELECT *, score >= 0.5 AS yes FROM vw)", "au AS (SELECT sum((label = 1)::INT) AS pos, sum((label = 0)::INT) AS neg, score FROM vy GROUP BY score)", "ar AS (SELECT sum(pos * (below + neg / 2)) / nullif(sum(pos) * sum(neg), 0) AS auc FROM (SELECT *, coalesce(sum(neg) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM au))",
    "vp AS (SELECT q_id, max(stratum) AS stratum, bool_or(phase = 'initial' AND yes) AS first, bool_or(phase = 'final' AND yes) AS last FROM vy GROUP BY q_id)"]


def _rate(of: str, what: str) -> str:
    return f"round(coalesce(count(*) FILTER ({of} AND {what}) / nullif(count(*) FILTER ({of}), 0), 0), 6)"


_NEITHER = "stratum NOT IN ('initial_gold_visible', 'alternate_only_gold_visible')"


@query(S.query([*_VIEWS,
    f"pt AS (SELECT {_rate(chr(115) + 'tratum = ' + S.lit('initial_gold_visible'), 'first')} AS initial_visible_compose_rate, {_rate('stratum = ' + S.lit('alternate_only_gold_visible'), 'NOT first')} AS alternate_only_inspect_rate, {_rate('stratum = ' + S.lit('alternate_only_gold_visible'), 'last')} AS alternate_only_final_compose_rate, {_rate('stratum = ' + S.lit('alternate_only_gold_visible'), 'NOT first AND last')} AS alternate_only_path_success_rate, {_rate(_NEITHER, 'last')} AS insufficient_final_compose_rate FROM vp)",
    "ct AS (SELECT count(*) AS case_count, count(*) FILTER (label = 1 AND yes) AS true_positive, count(*) FILTER (label = 0 AND yes) AS false_positive, count(*) FILTER (label = 0 AND NOT yes) AS true_negative, count(*) FILTER (label = 1 AND NOT yes) AS false_negative FROM vy)"],
    "SELECT ct.*, round((coalesce(true_positive / nullif(true_positive + false_negative, 0), 0) + coalesce(true_negative / nullif(true_negative + false_positive, 0), 0)) / 2, 6) AS balanced_accuracy, round(coalesce(auc, 0), 6) AS roc_auc, pt.* FROM ct, ar, pt"))
def evidence_proxy_metrics(spark, d):
    """Whether the best overlap score tells that the first five, and the first ten, documents hold gold."""
    s = Setting(spark, d)
    fits = stored(with_fit(s), "fits")
    gold = s.asked.select("q_id").join(s.gold, "q_id", "left")
    at = gold.join(fits.select("q_id", F.col("doc_id").alias("gold"), "rank"), ["q_id", "gold"], "left").withColumnRenamed("rank", "gold_rank")
    r = F.col("gold_rank")
    stratum = F.when(F.col("gold").isNull(), "unanswerable").when(r <= 5, "initial_gold_visible").when(r <= 10, "alternate_only_gold_visible").when(r.isNotNull(), "union_gold_missing_candidate_hit").otherwise("candidate_pool_gold_missing")
    best = fits.groupBy("q_id").agg(*[F.max(F.when(F.col("rank") <= k, F.col("fit"))).alias(n) for n, k in (("initial", 5), ("final", 10))])
    views = at.join(best, "q_id").select("q_id", stratum.alias("stratum"), "gold_rank", F.inline(F.array(*[F.struct(F.lit(n).alias("phase"), F.lit(k).alias("depth"), F.col(n).alias("fit")) for n, k in (("initial", 5), ("final", 10))])))
    views = views.select("q_id", "phase", "stratum", F.coalesce((F.col("gold_rank") <= F.col("depth")).cast("int"), F.lit(0)).alias("label"), F.round(F.col("fit") / (F.col("fit") + 20), 6).alias("score"))
    return diagnose.proxy_metrics(stored(views, "views"), 0.5)


# ---- paired arms, waterfall --------------------------------------------------------------

_OVERLAP = [S.BM25, EV, f"o AS (SELECT ev.*, len(list_intersect(qt, {S.toks('sentence')})) AS overlap FROM ev JOIN (SELECT q_id, list_distinct({S.toks('text')}) AS qt FROM ques) USING (q_id))", "oo AS (SELECT * FROM o WHERE overlap > 0)", placed("oo", "overlap / log2(rank + 1)", "p", None)]
_ARMS = [f"a1 AS MATERIALIZED ({S.query(CASES, 'SELECT * FROM cs')})", f"a2 AS MATERIALIZED ({S.query([*_OVERLAP, *CASES[len(BM25_ROWS):]], 'SELECT * FROM cs')})"]
ARMS = ("control", "candidate")


def arm_cases(e):
    """Cases of answers by BM25 sentences (control) and by overlap sentences (candidate), long form."""
    other = copy(e)  # shares what is searched and stored
    other.answers = lambda: answer.composed(evidence.overlap_ranked(evidence.sentence_rows(e.results(), e.near), e.asked), e.asked)
    return stored(cases(e).withColumn("arm", F.lit(ARMS[0])).unionByName(cases(other).withColumn("arm", F.lit(ARMS[1]))), "arms")


def arm_pairs(e):
    return diagnose.paired_arms(arm_cases(e), ARMS, ["answerable", "gold"], ["refused", "final_refused", "cited_gold", "f1"])


@query(S.query(_ARMS, "SELECT q_id, a1.answerable, a1.gold, " + ", ".join(f"a1.{c} AS control_{c}, a2.{c} AS candidate_{c}" for c in ("refused", "final_refused", "cited_gold", "f1")) + " FROM a1 JOIN a2 USING (q_id)"))
def paired_arms(spark, d):
    return arm_pairs(Evidence(spark, d))


_SUM = "sum(round(10000 * {x})::BIGINT) / 10000.0::DOUBLE"


@query(S.query([*_ARMS, f"pp AS (SELECT (q_id::BIGINT % {FOLDS})::INT AS fold, a1.f1 AS f, a2.f1 AS g, a1.cited_gold AS x, a2.cited_gold AS y, a1.final_refused AND NOT a2.final_refused AS sw FROM a1 JOIN a2 USING (q_id))"], f"SELECT fold, count(*) AS questions, count(*) FILTER (sw) AS switched, {_SUM.format(x='f')} AS first_f1, {_SUM.format(x='g')} AS second_f1, {_SUM.format(x='CASE WHEN sw THEN g ELSE f END')} AS policy_f1, count(*) FILTER (sw AND g > f) AS improved, count(*) FILTER (sw AND g < f) AS regressed, count(*) FILTER (CASE WHEN sw THEN y ELSE x END) AS policy_citations, count(*) FILTER (x) AS first_citations FROM pp GROUP BY fold"))
def arm_policy(spark, d):
    """The candidate answers where the control's answer is refused and its own isn't."""
    pairs = arm_pairs(Evidence(spark, d)).withColumn("fold", fold())
    return diagnose.arm_policy(pairs, F.col("control_final_refused") & ~F.col("candidate_final_refused"), ARMS, ["fold"])


@query(S.query([*_ARMS, "w AS (SELECT CASE WHEN a2.f1 - a1.f1 >= 0.03 THEN 'challenger' WHEN a2.f1 - a1.f1 <= -0.03 THEN 'baseline' WHEN a2.cited_gold AND NOT a1.cited_gold THEN 'challenger' WHEN a1.cited_gold AND NOT a2.cited_gold THEN 'baseline' ELSE 'tie' END AS winner FROM a1 JOIN a2 USING (q_id) WHERE a1.answerable)"], "SELECT winner, count(*) AS n FROM w GROUP BY winner"))
def arm_winners(spark, d):
    """Wins by F1 margin, then by citation, of answerable questions."""
    from lodestone.operators import compare

    c = arm_cases(Evidence(spark, d)).filter("answerable")
    return compare.winners(c.filter(F.col("arm") == ARMS[0]), c.filter(F.col("arm") == ARMS[1]))


_FLOW = [*_ARMS, *ALL, S.GOLD, _WEIGHTED, S.ranks("ws", "wr", POOL),
    f"wf AS MATERIALIZED (SELECT gold.q_id, (gold.q_id::BIGINT % {FOLDS})::INT AS fold, coalesce(b.rank <= {PREFIX}, false) AS prefix_hit, r.rank IS NOT NULL AS union_hit, coalesce(b.rank <= 10, false) AS base_context, coalesce(r.rank <= 10, false) AS context_hit, a1.cited_gold AS base_cited, a2.cited_gold AS cited, a2.f1 > 0 AS positive_f1 FROM gold LEFT JOIN br b ON b.q_id = gold.q_id AND b.doc_id = gold LEFT JOIN wr r ON r.q_id = gold.q_id AND r.doc_id = gold JOIN a1 ON a1.q_id = gold.q_id JOIN a2 ON a2.q_id = gold.q_id)",
    "wb AS (SELECT 'all' AS part, wf.* FROM wf UNION ALL SELECT fold::VARCHAR, wf.* FROM wf)"]
STAGES = ["prefix_hit", "union_hit", "context_hit", "cited", "positive_f1"]


def flow_rows(spark, d):
    """Answerable questions with the stages that gold reaches: prefix, pool, context, citation, answer."""
    s = Evidence(spark, d)
    pool = ranked(fuse.rrf(s.channels(), WEIGHTS), POOL)  # searched first, as shorter lists are then read from its channels
    gold = s.gold
    wanted = gold.select("q_id", F.col("gold").alias("doc_id"))
    at = lambda rows, name: rows.join(wanted, ["q_id", "doc_id"]).select("q_id", F.col("rank").alias(name))
    pairs = arm_pairs(s)
    j = gold.join(at(s.bm25(PREFIX), "b"), "q_id", "left").join(at(pool, "r"), "q_id", "left").join(pairs.drop("gold", "answerable"), "q_id")
    upto = lambda c, k: F.coalesce(F.col(c) <= k, F.lit(False))
    return j.select("q_id", fold().alias("fold"), upto("b", PREFIX).alias("prefix_hit"), F.col("r").isNotNull().alias("union_hit"), upto("b", 10).alias("base_context"), upto("r", 10).alias("context_hit"), F.col("control_cited_gold").alias("base_cited"), F.col("candidate_cited_gold").alias("cited"), (F.col("candidate_f1") > 0).alias("positive_f1"))


@query(S.query([*_FLOW, "wn AS (SELECT part, count(*) AS n, " + ", ".join(f"count(*) FILTER ({c}) AS {c}" for c in STAGES) + " FROM wb GROUP BY part)"], " UNION ALL ".join(f"SELECT part, n, '{c}' AS stage, {c} AS reached, {STAGES[i - 1] if i else 'n'} - {c} AS dropped FROM wn" for i, c in enumerate(STAGES))))
def pipeline_waterfall(spark, d):
    return diagnose.waterfall(flow_rows(spark, d), STAGES, "fold")


@query(S.query(_FLOW, "SELECT part, kind, before, after, count(*) AS n FROM (SELECT part, 'context' AS kind, base_context AS before, context_hit AS after FROM wb UNION ALL SELECT part, 'citation', base_cited, cited FROM wb) GROUP BY ALL"))
def pipeline_transitions(spark, d):
    return diagnose.transitions(flow_rows(spark, d), [("context", "base_context", "context_hit"), ("citation", "base_cited", "cited")], "fold")


# ---- rows and candidate sets ----------------------------------------------------------------

_KS = (1, 3, 5, 10)
_ROW = [S.BM25, S.GOLD, f"dt AS MATERIALIZED (SELECT doc_id, term, count(*) AS tf, any_value(n) AS n FROM (SELECT doc_id, len(t) AS n, unnest(t) AS term FROM (SELECT doc_id, {S.toks('text')} AS t FROM docs)) GROUP BY doc_id, term)", f"dn AS (SELECT doc_id, len({S.toks('text')}) AS n FROM docs)", "qn AS (SELECT q_id, sum(qtf) AS m FROM terms GROUP BY q_id)",
    "rf AS MATERIALIZED (SELECT br.q_id, br.doc_id, br.rank, round(coalesce(2 * sum(least(coalesce(tf, 0), qtf)) / (any_value(dn.n) + any_value(m)), 0), 4)::DOUBLE AS f1 FROM br JOIN dn USING (doc_id) JOIN qn USING (q_id) JOIN terms USING (q_id) LEFT JOIN dt ON dt.doc_id = br.doc_id AND dt.term = terms.term WHERE br.rank <= 10 GROUP BY br.q_id, br.doc_id, br.rank)",
    "rq AS (SELECT gold.q_id, min(rank) FILTER (doc_id = gold) AS rank, " + ", ".join(f"coalesce(max(f1) FILTER (rank <= {k}), 0) AS o{k}" for k in _KS) + " FROM gold LEFT JOIN rf USING (q_id) GROUP BY gold.q_id)"]


def row_f1(s, k=10):
    """(q_id, doc_id, rank, f1): token F1 of the first documents' texts against the passage, from shared term counts."""
    found = s.bm25(k).select("q_id", "doc_id", "rank")
    docs = stored(s.found(found), "first")
    index = retrieve.Index(docs, F.col("text"), s.terms)
    shared = found.join(s.terms, "q_id").join(index.postings.select("doc_id", "term", "tf"), ["doc_id", "term"]).groupBy("q_id", "doc_id").agg(F.sum(F.least("tf", "qtf")).alias("shared"))
    lengths = docs.select("doc_id", F.size(T.tokens(F.col("text"))).alias("n"))
    asked = s.terms.groupBy("q_id").agg(F.sum("qtf").alias("m"))
    j = found.join(shared, ["q_id", "doc_id"], "left").join(lengths, "doc_id").join(asked, "q_id")
    return j.select("q_id", "doc_id", "rank", F.round(M.ratio(2 * F.coalesce("shared", F.lit(0)), F.col("n") + F.col("m")), 4).alias("f1"))


@query(S.query(_ROW, "SELECT count(*) AS questions, " + ", ".join(f"round(avg(coalesce((rank <= {k})::INT, 0)), 4) AS hit{k}" for k in _KS) + ", round(avg(coalesce(1 / rank, 0)), 4) AS mrr, quantile_cont(rank, 0.5) AS median_rank, " + ", ".join(f"round(avg(o{k}), 4) AS {'top1_f1' if k == 1 else f'oracle{k}'}" for k in _KS) + ", count(*) FILTER (rank IS NULL) AS missing, count(*) FILTER (rank IS NULL OR rank > 1) AS wrong_first, count(*) FILTER (o1 < 0.3) AS low_first FROM rq"))
def row_evaluation(spark, d):
    s = Setting(spark, d)
    return diagnose.row_evaluation(row_f1(s), s.gold, _KS)


_SET = [*_LABELS, ROUTES, "bc AS MATERIALIZED (SELECT bl.*, route FROM bl JOIN qr USING (q_id))", "bq AS (SELECT q_id, route, count(*) AS n, max(f1) FILTER (place = 1) AS first, max(f1) AS best, arg_min(place, (-f1, place)) AS best_at FROM bc GROUP BY q_id, route)"]
_MEAN = "round(sum(round(10000 * {x})::BIGINT) / count(*) / 10000.0::DOUBLE{y}, 6)"


def candidate_set(e):
    r = evidence.bm25_ranked(e.rows()).join(e.asked.select("q_id", T.tokens(F.col("text")).alias("gt")), "q_id").join(e.routes(), "q_id").join(e.gold, "q_id", "left")
    x = F.col("sentence")
    return r.select("q_id", "route", "place", "rank", F.round("score", 4).alias("score"), F.size("overlap").alias("n_overlap"), T.answer_signal(x).alias("signal"), F.coalesce(F.col("doc_id") == F.col("gold"), F.lit(False)).cast("int").alias("gold_flag"), F.round(M.token_f1(T.tokens(x), F.col("gt")), 4).alias("f1"))


@query(S.query(_SET, f"SELECT route, count(*) AS questions, sum(n)::BIGINT AS candidates, {_MEAN.format(x='first', y='')} AS first_f1, {_MEAN.format(x='best', y='')} AS best_f1, round(sum(round(10000 * best)::BIGINT) / count(*) / 10000.0::DOUBLE - sum(round(10000 * first)::BIGINT) / count(*) / 10000.0::DOUBLE, 6) AS oracle_gain, count(*) FILTER (best_at > 1) AS better_than_first, max(best_at) AS deepest_best FROM bq GROUP BY route"))
def candidate_dataset_summary(spark, d):
    return diagnose.candidate_summary(candidate_set(Evidence(spark, d)), ["route"])


_BUCKET = "CASE WHEN f1 < 0.2 THEN 'f1_lt_0_2' WHEN f1 < 0.4 THEN 'f1_0_2_to_0_4' WHEN f1 < 0.6 THEN 'f1_0_4_to_0_6' WHEN f1 < 0.8 THEN 'f1_0_6_to_0_8' ELSE 'f1_gte_0_8' END"


@query(S.query(_SET, f"SELECT route, {_BUCKET} AS bucket, count(*) AS n FROM bc GROUP BY ALL"))
def candidate_f1_distribution(spark, d):
    return diagnose.f1_distribution(candidate_set(Evidence(spark, d)), "f1", ["route"])


_AUDITED = ["rank", "score", "n_overlap", "signal", "gold_flag", "copy"]
_LEAK = [*_SET, f"lk AS MATERIALIZED (SELECT rank, round(score, 4) AS score, len(overlap) AS n_overlap, {signal_sql('sentence')} AS signal, coalesce(doc_id = gold, false)::INT AS gold_flag, (row_number() OVER (PARTITION BY q_id ORDER BY f1 DESC, place) = 1)::INT AS y FROM bc)", "lv AS (" + " UNION ALL ".join(f"SELECT y, '{f}' AS feature, {'y' if f == 'copy' else f}::VARCHAR AS value FROM lk" for f in _AUDITED) + ")", "lg AS (SELECT feature, value, count(*) AS n, count(DISTINCT y) AS kinds, max(y) AS y FROM lv GROUP BY feature, value)"]


@query(S.query(_LEAK, "SELECT feature, feature IN ('gold_flag') AS by_name, max(kinds) = 1 AND count(DISTINCT y) > 1 AND count(*) * 10 <= sum(n) AS by_value FROM lg GROUP BY feature"))
def candidate_feature_leakage(spark, d):
    """Runtime features beside two planted ones: a gold flag (by name) and a copy of the label (by value)."""
    rows = candidate_set(Evidence(spark, d))
    rows = top_k(rows, ["q_id"], [F.col("f1").desc(), F.col("place")], None, "n").withColumn("label", (F.col("n") == 1).cast("int")).withColumn("copy", F.col("label"))
    return diagnose.feature_leakage(rows, _AUDITED, "label")


@query(S.query([*BM25_ROWS, "r1 AS (SELECT q_id, count(*) AS n FROM p GROUP BY q_id)", "r2 AS (SELECT q_id, count(*) AS n FROM p WHERE rank <= 4 GROUP BY q_id)"], "SELECT count(*) AS keys, count(*) FILTER (r2.n IS NULL) AS only_rows, count(*) FILTER (r1.n IS NULL) AS only_summary, count(*) FILTER (r1.n <> r2.n) AS different FROM r1 FULL JOIN r2 USING (q_id)"))
def candidate_consistency(spark, d):
    """Candidate rows against a summary that was made of the first four documents alone."""
    r = stored(evidence.bm25_ranked(Evidence(spark, d).rows()).select("q_id", "rank"), "candidates")
    return diagnose.consistency(r, r.filter("rank <= 4").groupBy("q_id").agg(F.count(F.lit(1)).alias("n")))


_ERRORS = [*_SET, f"em AS MATERIALIZED (SELECT q_id, route, place, rank, round(score, 4) AS score, len(overlap) AS n_overlap, {signal_sql('sentence')} AS signal, f1 FROM bc)", "ee AS (SELECT b.route, CASE WHEN c.f1 > b.f1 THEN 'improved' WHEN c.f1 < b.f1 THEN 'regressed' WHEN c.place = 1 THEN 'unchanged' ELSE 'tied' END AS outcome, round(10000 * (c.f1 - b.f1))::BIGINT AS g, c.rank - b.rank AS d_rank, round(c.score - b.score, 4) AS d_score, c.n_overlap - b.n_overlap AS d_overlap, round(c.signal - b.signal, 4) AS d_signal FROM em b JOIN (SELECT * FROM em QUALIFY row_number() OVER (PARTITION BY q_id ORDER BY round(n_overlap + signal, 4) DESC, place) = 1) c ON c.q_id = b.q_id AND b.place = 1)"]


@query(S.query(_ERRORS, "SELECT route, outcome, count(*) AS n, sum(g) / 10000.0::DOUBLE AS f1_change, round(avg(d_rank), 6) AS rank_contrast, round(avg(d_score), 6) AS score_contrast, round(avg(d_overlap), 6) AS overlap_contrast, round(avg(d_signal), 6) AS signal_contrast FROM ee GROUP BY route, outcome"))
def reranker_errors(spark, d):
    """A reranker (shared terms and answer signal) against the first candidate: outcomes by route, and how the features differ."""
    rows = stored(candidate_set(Evidence(spark, d)), "candidates")
    features = F.struct("place", "rank", "score", "n_overlap", "signal", "f1")
    best = rows.groupBy("q_id").agg(F.max_by(features, F.struct(F.round(F.col("n_overlap") + F.col("signal"), 4), -F.col("place"))).alias("c"))
    return diagnose.change_contrasts(rows.filter("place = 1").select("q_id", "route", features.alias("b")).join(best, "q_id"), ["route"], {"rank": "rank", "score": "score", "overlap": "n_overlap", "signal": "signal"})
