"""Queries of evidence selection, answers and their evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import metrics as M
from lodestone.functions import text as T
from lodestone.operators import answer, evaluate, evidence, retrieve
from lodestone.operators.retrieve import top_k
from lodestone.plans import sql as S
from lodestone.plans.retrieval import Setting
from lodestone.plans.scalars import _noise, _route_sql, action_bonus_sql, answer_bonus_sql, answer_multiplier_sql, problem_penalty_sql, signal_sql
from lodestone.sources.scratch import stored

QUERIES, ORACLES = {}, {}
CONTEXT = 5


def query(oracle: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


class Evidence(Setting):
    def results(self, k=CONTEXT):
        return self.bm25(k)

    @property
    def near(self):
        """The documents of the results: a few a question, whatever the table."""
        if "near" not in self._packed:
            self._packed["near"] = stored(self.found(self.results()), "near")
        return self._packed["near"]

    def rows(self, keep=None):
        return evidence.with_terms(evidence.sentence_rows(self._of(keep), self.near), self.asked)

    def spans(self, keep=None):
        return evidence.with_terms(evidence.window_rows(self._of(keep), self.near), self.asked)

    def _of(self, keep):
        """The results of all questions, or of those in `keep` alone."""
        return self.results() if keep is None else self.results().join(keep, "q_id", "left_semi")

    def routes(self):
        return self.asked.select("q_id", T.route(F.col("title"), F.col("text")).alias("route"))

    def answers(self):
        return answer.composed(evidence.bm25_ranked(self.rows()), self.asked)


def shown(df):
    return df.select("q_id", "doc_id", "pos", "place", F.md5(F.col("sentence").cast("binary")).alias("sentence"), F.round("score", 6).alias("score"))


EV = f"""rt AS MATERIALIZED (SELECT q_id, doc_id, rank, text FROM br JOIN docs USING (doc_id) WHERE rank <= {CONTEXT}),
ev AS MATERIALIZED (SELECT q_id, doc_id, rank, sentence, sentence AS scoring, pos FROM (SELECT q_id, doc_id, rank, unnest(s) AS sentence, generate_subscripts(s, 1) - 1 AS pos FROM (SELECT q_id, doc_id, rank, {S.sents('text')} AS s FROM rt)) WHERE length(sentence) >= 24 QUALIFY row_number() OVER (PARTITION BY q_id, sentence ORDER BY rank, pos) = 1)"""
WIN = f"""ws AS MATERIALIZED (SELECT q_id, doc_id, rank, list_filter({S.sents('text')}, lambda s: length(s) >= 24) AS s FROM rt),
wn AS (SELECT q_id, doc_id, rank, s, size, unnest(range(1, len(s) - size + 2)) AS start FROM (SELECT *, unnest(range(1, least(3, len(s)) + 1)) AS size FROM ws)),
wp AS (SELECT q_id, doc_id, rank, array_to_string(s[start : start + size - 1], ' ') AS sentence, row_number() OVER (PARTITION BY q_id, doc_id ORDER BY size, start) - 1 AS pos FROM wn),
wv AS MATERIALIZED (SELECT *, sentence AS scoring FROM wp QUALIFY row_number() OVER (PARTITION BY q_id, sentence ORDER BY rank, pos) = 1)"""


def rows_sql(source: str, out: str, signal: bool) -> str:
    keep = f"len(overlap) > 0{' OR ' + answer_bonus_sql('scoring') + ' > 0' if signal else ''}"
    return f"""{out}_c AS (SELECT e.*, {S.content('sentence')} AS terms, list_intersect(qt, {S.content('sentence')}) AS overlap FROM {source} e JOIN (SELECT q_id, {S.content('text')} AS qt FROM ques) USING (q_id)),
{out} AS MATERIALIZED (SELECT * FROM {out}_c WHERE {keep}),
{out}_n AS (SELECT q_id, count(*) AS n, avg(len(terms)) AS mean FROM {out} GROUP BY q_id),
{out}_d AS (SELECT q_id, term, count(*) AS df FROM (SELECT q_id, unnest(overlap) AS term FROM {out}) GROUP BY q_id, term),
{out}_b AS (SELECT q_id, doc_id, pos, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * 2.2::DOUBLE / (1 + 1.2::DOUBLE * (1 - 0.35::DOUBLE + 0.35::DOUBLE * l / mean))) AS bm25 FROM (SELECT q_id, doc_id, pos, len(terms) AS l, unnest(overlap) AS term FROM {out}) JOIN {out}_d USING (q_id, term) JOIN {out}_n USING (q_id) GROUP BY q_id, doc_id, pos),
{out}_s AS MATERIALIZED (SELECT {out}.*, (coalesce(bm25, 0) + 0.25::DOUBLE * len(overlap)) * (1 + 0.35::DOUBLE / log2(rank + 1)) * {_noise('scoring')} * 2.5::DOUBLE AS base FROM {out} LEFT JOIN {out}_b USING (q_id, doc_id, pos))"""


def placed(source: str, score: str, out: str, cap: int | None = 1) -> str:
    order = "score DESC, rank, doc_id, pos"
    capped = f" QUALIFY row_number() OVER (PARTITION BY q_id, doc_id ORDER BY {order}) <= {cap}" if cap else ""
    return f"{out}_x AS MATERIALIZED (SELECT *, round({score}, 9) AS score FROM {source}{capped}), {out} AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY {order}) AS place FROM {out}_x)"


ANSWERED = f"(base + {answer_bonus_sql('scoring')}) * {answer_multiplier_sql('scoring')} * {problem_penalty_sql('scoring')}"
SHOW = "SELECT q_id, doc_id, pos, place, md5(sentence) AS sentence, round(score, 6) AS score FROM"
BM25_ROWS = [S.BM25, EV, rows_sql("ev", "r", False), placed("r_s", "base", "p")]


@query(S.query([S.BM25, EV, f"o AS (SELECT ev.*, len(list_intersect(qt, {S.toks('sentence')})) AS overlap FROM ev JOIN (SELECT q_id, list_distinct({S.toks('text')}) AS qt FROM ques) USING (q_id))", "oo AS (SELECT * FROM o WHERE overlap > 0)", placed("oo", "overlap / log2(rank + 1)", "p", None)], f"{SHOW} p"))
def overlap_sentences(spark, d):
    e = Evidence(spark, d)
    return shown(evidence.overlap_ranked(evidence.sentence_rows(e.results(), e.near), e.asked))


@query(S.query(BM25_ROWS, f"{SHOW} p"))
def bm25_sentences(spark, d):
    return shown(evidence.bm25_ranked(Evidence(spark, d).rows()))


@query(S.query([S.BM25, EV, rows_sql("ev", "r", True), placed("r_s", ANSWERED, "p", 2)], f"{SHOW} p"))
def answer_aware_sentences(spark, d):
    return shown(evidence.answer_aware_ranked(Evidence(spark, d).rows(), 2))


_NSENT = f"len({S.sents('sentence')})"
_COMPACT = S.mult((f"{_NSENT} BETWEEN 2 AND 3 AND len({S.toks('sentence')}) <= 90", 1.08), (f"{_NSENT} BETWEEN 2 AND 3 AND {answer_bonus_sql('scoring')} > 0", 1.08))


def _long(hard: int, soft: int) -> str:
    return f"(CASE WHEN len({S.toks('sentence')}) > {hard} THEN 0.65 WHEN len({S.toks('sentence')}) > {soft} THEN 0.8 ELSE 1.0 END)::DOUBLE"


@query(S.query([S.BM25, EV, WIN, rows_sql("wv", "r", True), placed("r_s", f"({ANSWERED} + {action_bonus_sql('scoring')}) * {_COMPACT} * {_long(140, 95)}", "p")], f"{SHOW} p"))
def answer_window_sentences(spark, d):
    return shown(evidence.answer_window_ranked(Evidence(spark, d).spans()))


_SPAN = f"({ANSWERED} + {S.plus((S.has('lower(scoring)', T.SPAN_ACTION), 6), (S.has('lower(scoring)', T.LIMITATION), 22), (S.has('lower(scoring)', T.ENHANCEMENT), 16))}) * {_long(180, 120)}"


@query(S.query([S.BM25, EV, WIN, rows_sql("wv", "r", True), placed("r_s", _SPAN, "p")], f"{SHOW} p"))
def section_span_sentences(spark, d):
    return shown(evidence.section_span_ranked(Evidence(spark, d).spans()))


#: Routes whose answers lie in a section of their own.
SPAN_ROUTES = ("security_bulletin_vulnerability_detail", "limitation_or_restriction")


def _routed(e, windows=False):
    """Section spans for SPAN_ROUTES, answer-aware sentences for the rest; with windows, these for `other`."""
    span = F.col("route").isin(*SPAN_ROUTES)
    branches = [(lambda q: evidence.section_span_ranked(e.spans(q)), span)]
    aware = ~span
    if windows:
        aware = aware & (F.col("route") != "other")
        branches.append((lambda q: evidence.answer_window_ranked(e.spans(q)), F.col("route") == "other"))
    return evidence.routed([*branches, (lambda q: evidence.answer_aware_ranked(e.rows(q)), aware)], stored(e.routes(), "routes"))


_SPANNED = "(" + ", ".join(S.lit(r) for r in SPAN_ROUTES) + ")"
ROUTES = f"qr AS MATERIALIZED (SELECT q_id, {_route_sql()} AS route FROM (SELECT q_id, lower(concat_ws(chr(10) || chr(10), nullif(trim(title), ''), nullif(trim(text), ''))) AS q, lower(title) AS t FROM ques))"
_HYBRID = [S.BM25, ROUTES, EV, WIN, rows_sql("ev", "ra", True), placed("ra_s", ANSWERED, "pa"), rows_sql("wv", "rw", True), placed("rw_s", _SPAN, "ps")]
_WINDOW = placed("rw_s", f"({ANSWERED} + {action_bonus_sql('scoring')}) * {_COMPACT} * {_long(140, 95)}", "pw")
_ONLY = "JOIN qr USING (q_id) WHERE route"


@query(S.query(_HYBRID, f"{SHOW} ps {_ONLY} IN {_SPANNED} UNION ALL {SHOW} pa {_ONLY} NOT IN {_SPANNED}"))
def hybrid_routed_sentences(spark, d):
    return shown(_routed(Evidence(spark, d)))


@query(S.query([*_HYBRID, _WINDOW], f"{SHOW} ps {_ONLY} IN {_SPANNED} UNION ALL {SHOW} pw {_ONLY} = 'other' UNION ALL {SHOW} pa {_ONLY} NOT IN {_SPANNED} AND route <> 'other'"))
def hybrid_window_sentences(spark, d):
    return shown(_routed(Evidence(spark, d), True))


@query(S.query([S.BASE, ROUTES], f"SELECT q_id, route, CASE WHEN route IN {_SPANNED} THEN 'section_span' WHEN route = 'other' THEN 'answer_window' ELSE 'answer_aware' END AS windowed, CASE WHEN route IN {_SPANNED} THEN 'section_span' ELSE 'answer_aware' END AS routed, CASE WHEN route = 'other' THEN 'local_window' ELSE 'routed' END AS reranked FROM qr"))
def route_trace(spark, d):
    return evidence.route_trace(Evidence(spark, d).routes(), SPAN_ROUTES)


def reranked(e):
    """Best windows around the first three routed sentences of questions on the route `other`; other routes keep theirs."""
    chosen = _routed(e).filter("place <= 3")
    return chosen, evidence.local_windows(chosen.filter("route = 'other'"), e.near, e.asked)


def plain_sql(x: str) -> str:
    return f"list_filter(list_distinct({S.toks(x)}), lambda y: y NOT IN ({', '.join(S.lit(w) for w in T.STOPWORDS)}) AND length(y) > 1)"


def _share(a: str, b: str) -> str:
    return f"(CASE WHEN len({a}) > 0 THEN len(list_intersect({a}, {b})) / len({a})::DOUBLE ELSE 0 END)"


LOCAL = [
    S.BM25, ROUTES, EV, rows_sql("ev", "ra", True), placed("ra_s", ANSWERED, "pa"),
    f"l0 AS MATERIALIZED (SELECT pa.q_id, doc_id, pos, sentence, list_filter({S.sents('d.text')}, lambda s: length(s) >= 24) AS s, {S.sents('sentence')} AS parts, {plain_sql('q.text')} AS qt, {plain_sql('sentence')} AS a FROM pa JOIN qr USING (q_id) JOIN docs d USING (doc_id) JOIN ques q ON q.q_id = pa.q_id WHERE route = 'other' AND place <= 3)",
    "l1 AS MATERIALIZED (SELECT *, list_filter(range(1, len(s) + 1), lambda i: list_contains(parts, s[i])) AS exact, list_filter(range(1, len(s) + 1), lambda i: contains(sentence, s[i]) OR contains(s[i], sentence)) AS near FROM l0)",
    f"l2 AS MATERIALIZED (SELECT q_id, doc_id, pos, arg_max(i, (r, i)) AS best, max(r) AS r FROM (SELECT q_id, doc_id, pos, i, {_share('a', 't')} AS r FROM (SELECT q_id, doc_id, pos, a, i, {plain_sql('s[i]')} AS t FROM (SELECT *, unnest(range(1, len(s) + 1)) AS i FROM l0))) GROUP BY q_id, doc_id, pos)",
    "l3 AS (SELECT l1.*, unnest(CASE WHEN len(exact) > 0 THEN exact WHEN len(near) > 0 THEN near WHEN r >= 0.6 THEN [best] ELSE [] END) AS anchor FROM l1 JOIN l2 USING (q_id, doc_id, pos))",
    "l4 AS (SELECT *, unnest(range(greatest(1, anchor - 2), anchor + 1)) AS first FROM l3)", "l5 AS (SELECT *, unnest(range(anchor, least(len(s), first + 2) + 1)) AS last FROM l4)",
    "l6 AS MATERIALIZED (SELECT DISTINCT q_id, doc_id, pos, sentence, qt, a, array_to_string(s[first : last], ' ') AS w FROM l5)",
    f"l7 AS MATERIALIZED (SELECT *, {plain_sql('w')} AS t, len({S.toks('w')}) AS n, len({S.sents('w')}) AS k FROM l6)",
    f"l8 AS MATERIALIZED (SELECT *, round(len(list_intersect(qt, t)) + 1.5::DOUBLE * {_share('a', 't')} + {signal_sql('w')} + CASE WHEN k = 1 THEN 0.4 WHEN k = 2 AND n <= 80 THEN 0.3 WHEN k = 3 AND n <= 100 THEN 0.1 ELSE -0.2 END::DOUBLE - (CASE WHEN n > 100 THEN 0.8 ELSE 0 END::DOUBLE + CASE WHEN n > 140 THEN 1.2 ELSE 0 END::DOUBLE + CASE WHEN {S.has('lower(w)', T.TRACE)} THEN 0.4 ELSE 0 END::DOUBLE), 9) AS local FROM l7)",
    "lw AS MATERIALIZED (SELECT q_id, doc_id, pos, sentence, w, local FROM l8 QUALIFY row_number() OVER (PARTITION BY q_id, doc_id, pos ORDER BY local DESC, n, w DESC) = 1)",
]


@query(S.query(LOCAL, "SELECT q_id, doc_id, pos, md5(w) AS window, round(local, 6) AS score FROM lw"))
def local_window_rerank(spark, d):
    best = reranked(Evidence(spark, d))[1]
    return best.select("q_id", "doc_id", "pos", F.md5(F.col("window").cast("binary")).alias("window"), F.round("local", 6).alias("score"))


ANSWER = ["top AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY place) AS slot FROM p WHERE score >= 2.0 QUALIFY slot <= 3)", f"ans AS MATERIALIZED (SELECT ques.q_id, coalesce(string_agg(sentence || ' [' || doc_id || ']', ' ' ORDER BY slot), {S.lit(answer.REFUSAL)}) AS answer, count(slot) AS n, max(round(score, 4)) AS best, min(rank) AS first_rank FROM ques LEFT JOIN top ON top.q_id = ques.q_id GROUP BY ques.q_id)"]


@query(S.query([*BM25_ROWS, *ANSWER], "SELECT q_id, md5(answer) AS answer, n AS n_citations, n = 0 AS refused FROM ans"))
def extractive_answers(spark, d):
    a = Evidence(spark, d).answers()
    return a.select("q_id", F.md5(F.col("answer").cast("binary")).alias("answer"), F.size("citations").cast("bigint").alias("n_citations"), "refused")


_REASONS = "CASE WHEN n = 0 THEN 'already_refused' WHEN best < 40.0 AND first_rank > 1 THEN 'weak_evidence_score,citation_rank_too_low' WHEN best < 40.0 THEN 'weak_evidence_score' WHEN first_rank > 1 THEN 'citation_rank_too_low' ELSE 'verified' END"


@query(S.query([*BM25_ROWS, *ANSWER], f"SELECT q_id, {_REASONS} AS reasons, {_REASONS} <> 'verified' AS final_refused, true AS context_valid FROM ans"))
def verify_answers(spark, d):
    e = Evidence(spark, d)
    v = answer.verified(e.answers(), e.results(), score=40.0, rank=1)
    return v.select("q_id", F.array_join("reasons", ",").alias("reasons"), "final_refused", "context_valid")


@query(S.query([*BM25_ROWS, *ANSWER], f"SELECT reason, count(*) AS n FROM (SELECT unnest(string_split({_REASONS}, ',')) AS reason FROM ans) GROUP BY reason"))
def reason_counts(spark, d):
    e = Evidence(spark, d)
    v = answer.verified(e.answers(), e.results(), score=40.0, rank=1)
    return v.select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def cases(e):
    """Answers with gold, whether they cite it, and their F1 against the passage."""
    v = answer.verified(e.answers(), e.results(), score=40.0, rank=1)
    g = e.gold
    j = v.join(g, "q_id", "left").join(e.asked.select("q_id", T.tokens(F.col("text")).alias("gt")), "q_id")
    return j.select("q_id", F.col("gold").isNotNull().alias("answerable"), "gold", "refused", "final_refused", F.coalesce(F.exists("citations", lambda c: c["doc_id"] == F.col("gold")), F.lit(False)).alias("cited_gold"), F.round(M.token_f1(T.tokens(F.col("answer")), F.col("gt")), 4).alias("f1"))


CASES = [
    *BM25_ROWS, *ANSWER, S.GOLD,
    f"atok AS (SELECT q_id, term, count(*) AS n FROM (SELECT q_id, unnest({S.toks('answer')}) AS term FROM ans) GROUP BY q_id, term)", f"gt AS (SELECT q_id, term, count(*) AS n FROM (SELECT q_id, unnest({S.toks('text')}) AS term FROM ques) GROUP BY q_id, term)",
    "sh AS (SELECT atok.q_id, sum(least(atok.n, gt.n)) AS s FROM atok JOIN gt USING (q_id, term) GROUP BY atok.q_id)", "la AS (SELECT q_id, sum(n) AS n FROM atok GROUP BY q_id)", "lg AS (SELECT q_id, sum(n) AS n FROM gt GROUP BY q_id)",
    f"cs AS MATERIALIZED (SELECT ans.q_id, gold IS NOT NULL AS answerable, gold, ans.n = 0 AS refused, {_REASONS.replace('n = 0', 'ans.n = 0')} <> 'verified' AS final_refused, gold IS NOT NULL AND EXISTS (SELECT 1 FROM top WHERE top.q_id = ans.q_id AND top.doc_id = gold) AS cited_gold, round(coalesce(2 * (s / la.n) * (s / lg.n) / (s / la.n + s / lg.n), 0), 4)::DOUBLE AS f1 FROM ans LEFT JOIN gold USING (q_id) LEFT JOIN sh USING (q_id) LEFT JOIN la USING (q_id) LEFT JOIN lg USING (q_id))",
]


def _metrics(refused: str) -> str:
    return f"""SELECT count(*) AS total, count(*) FILTER (answerable) AS answerable, count(*) FILTER (answerable AND NOT {refused}) AS answered_answerable, count(*) FILTER (NOT answerable AND NOT {refused}) AS answered_unanswerable,
round(coalesce(count(*) FILTER (answerable AND NOT {refused} AND cited_gold) / nullif(count(*) FILTER (answerable AND NOT {refused}), 0), 0), 4) AS gold_citation_rate, round(coalesce(count(*) FILTER (NOT answerable AND {refused}) / nullif(count(*) FILTER (NOT answerable), 0), 0), 4) AS refusal_rate,
round(coalesce(count(*) FILTER (answerable AND {refused}) / nullif(count(*) FILTER (answerable), 0), 0), 4) AS false_refusal_rate, round(coalesce(avg(f1) FILTER (answerable AND NOT {refused}), 0), 6) AS average_f1, round(coalesce(avg(CASE WHEN {refused} THEN 0 ELSE f1 END) FILTER (answerable), 0), 6) AS average_f1_all_answerable FROM cs"""


@query(S.query(CASES, _metrics("refused")))
def answer_metrics(spark, d):
    return evaluate.answer_metrics(cases(Evidence(spark, d)))


@query(S.query(CASES, _metrics("final_refused")))
def verified_metrics(spark, d):
    return evaluate.answer_metrics(cases(Evidence(spark, d)), "final_refused")


@query(S.query(CASES, "SELECT CASE WHEN answerable AND cited_gold THEN 'answerable_gold_cited' WHEN answerable THEN 'answerable_gold_not_cited' ELSE 'unanswerable' END AS bucket, count(*) AS n FROM cs WHERE NOT refused AND final_refused GROUP BY bucket"))
def refusal_buckets(spark, d):
    c = cases(Evidence(spark, d)).filter(~F.col("refused") & F.col("final_refused"))
    b = F.when(F.col("answerable") & F.col("cited_gold"), "answerable_gold_cited").when(F.col("answerable"), "answerable_gold_not_cited").otherwise("unanswerable")
    return c.groupBy(b.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


_BUCKET = """CASE WHEN NOT answerable AND NOT final_refused THEN 'answerability_false_answer' WHEN NOT answerable THEN 'answer_supported_and_cited' WHEN NOT in_context THEN 'retrieval_context_miss' WHEN NOT cited_gold THEN 'evidence_selection_miss' WHEN final_refused THEN 'verification_over_refusal' WHEN f1 < 0.2 THEN 'low_overlap_gold_cited_answer' ELSE 'answer_supported_and_cited' END"""


def _bucketed(e):
    ctx = e.results().select("q_id", F.col("doc_id").alias("gold"), F.lit(True).alias("inside"))
    c = cases(e).join(ctx, ["q_id", "gold"], "left").withColumn("inside", F.coalesce("inside", F.lit(False)))
    a, f = F.col("answerable"), F.col("final_refused")
    return c.withColumn(
        "bucket",
        F.when(~a & ~f, "answerability_false_answer").when(~a, "answer_supported_and_cited").when(~F.col("inside"), "retrieval_context_miss").when(~F.col("cited_gold"), "evidence_selection_miss")
        .when(f, "verification_over_refusal").when(F.col("f1") < 0.2, "low_overlap_gold_cited_answer").otherwise("answer_supported_and_cited"),
    )


_INSIDE = "cx AS MATERIALIZED (SELECT cs.*, coalesce(gold IN (SELECT doc_id FROM br WHERE br.q_id = cs.q_id AND rank <= 5), false) AS in_context FROM cs)"


@query(S.query([*CASES, _INSIDE], f"SELECT q_id, {_BUCKET} AS bucket FROM cx"))
def error_decomposition(spark, d):
    return _bucketed(Evidence(spark, d)).select("q_id", "bucket")


_KINDS = ["answerability_false_answer", "retrieval_context_miss", "evidence_selection_miss", "verification_over_refusal", "low_overlap_gold_cited_answer", "answer_supported_and_cited"]


@query(S.query([*CASES, _INSIDE, ROUTES, f"bu AS (SELECT q_id, {_BUCKET} AS bucket FROM cx)"], "SELECT route, " + ", ".join(f"count(*) FILTER (bucket = '{k}') AS {k}" for k in _KINDS) + " FROM bu JOIN qr USING (q_id) GROUP BY route"))
def route_bucket_crosstab(spark, d):
    e = Evidence(spark, d)
    j = _bucketed(e).join(e.routes(), "q_id")
    return j.groupBy("route").pivot("bucket", _KINDS).agg(F.count(F.lit(1))).na.fill(0)


GAP_MARGIN = 0.05
_GAP = f"""CASE WHEN gold IS NULL THEN 'gold_document_missing' WHEN NOT in_context THEN 'gold_not_in_context' WHEN NOT cited_gold THEN 'gold_in_context_not_selected' WHEN round(best_window, 4) >= round(f1 + {GAP_MARGIN}::DOUBLE, 4) THEN 'gold_window_beats_selected_answer'
WHEN round(best_sentence, 4) >= round(f1 + {GAP_MARGIN}::DOUBLE, 4) THEN 'gold_sentence_beats_selected_answer' WHEN f1 < 0.2 THEN 'selected_answer_low_overlap' ELSE 'selected_answer_reasonable_overlap' END"""
_BEST = [
    f"gs0 AS MATERIALIZED (SELECT cs.q_id, list_filter({S.sents('d.text')}, lambda s: length(s) >= 24) AS s, {S.toks('q.text')} AS gt FROM cs JOIN docs d ON d.doc_id = gold JOIN ques q ON q.q_id = cs.q_id)",
    "gs1 AS (SELECT q_id, gt, s, size, unnest(range(1, len(s) - size + 2)) AS start FROM (SELECT *, unnest(range(1, least(3, len(s)) + 1)) AS size FROM gs0))",
    f"gs2 AS (SELECT q_id, gt, size, {S.toks(chr(97) + 'rray_to_string(s[start : start + size - 1], chr(32))')} AS wt FROM gs1)",
    f"gs3 AS MATERIALIZED (SELECT q_id, max(f) AS best_window, max(f) FILTER (size = 1) AS best_sentence FROM (SELECT q_id, size, {S.f1('wt', 'gt')} AS f FROM gs2) GROUP BY q_id)",
    f"ga AS MATERIALIZED (SELECT *, {_GAP} AS gap FROM cx LEFT JOIN gs3 USING (q_id))",
]


def _gaps(e):
    """Cases with the best F1 of a sentence and of a window of the gold document, and the gap category."""
    c = _bucketed(e)
    texts = c.select("q_id", F.col("gold").alias("doc_id")).join(e.found(e.gold.select(F.col("gold").alias("doc_id"))).select("doc_id", "text"), "doc_id").join(e.asked.select("q_id", T.tokens(F.col("text")).alias("gt")), "q_id")
    sents = F.filter(T.sentences(F.col("text")), lambda x: F.length(x) >= evidence.MIN_CHARS)
    sized = lambda k: F.array_max(F.transform(T.windows(sents, k), lambda w: F.round(M.token_f1(T.tokens(w), F.col("gt")), 4)))
    c = c.join(texts.select("q_id", sized(evidence.SPAN_SENTENCES).alias("best_window"), sized(1).alias("best_sentence")), "q_id", "left")
    over = lambda x: F.round(F.col(x), 4) >= F.round(F.col("f1") + GAP_MARGIN, 4)
    return c.withColumn(
        "gap",
        F.when(F.col("gold").isNull(), "gold_document_missing").when(~F.col("inside"), "gold_not_in_context").when(~F.col("cited_gold"), "gold_in_context_not_selected").when(over("best_window"), "gold_window_beats_selected_answer")
        .when(over("best_sentence"), "gold_sentence_beats_selected_answer").when(F.col("f1") < 0.2, "selected_answer_low_overlap").otherwise("selected_answer_reasonable_overlap"),
    )


@query(S.query([*CASES, _INSIDE, *_BEST], "SELECT gap, count(*) AS n, round(avg(f1), 4) AS average_f1 FROM ga GROUP BY gap"))
def answer_gap_buckets(spark, d):
    return _gaps(Evidence(spark, d)).groupBy("gap").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("f1"), 4).alias("average_f1"))


_PRIORITY = "round((2 * count(*) FILTER (gap = 'gold_in_context_not_selected') + count(*) FILTER (gap = 'gold_window_beats_selected_answer') + count(*) FILTER (gap = 'selected_answer_low_overlap')) * (1 + coalesce(round(avg(CASE WHEN best_window IS NOT NULL THEN greatest(0, best_window - f1) END), 4), 0)), 4)"


@query(S.query([*CASES, _INSIDE, *_BEST], f"SELECT q_id::BIGINT % 4 AS part, {_PRIORITY} AS priority FROM ga GROUP BY part"))
def gap_priority(spark, d):
    """Weighted count of the cases that better selection would mend, times one plus the mean F1 that gold windows have over answers."""
    g = _gaps(Evidence(spark, d)).withColumn("part", F.col("q_id").cast("bigint") % 4)
    n = lambda k: F.count_if(F.col("gap") == k)
    mean = F.coalesce(F.round(F.avg(F.when(F.col("best_window").isNotNull(), F.greatest(F.lit(0.0), F.col("best_window") - F.col("f1")))), 4), F.lit(0.0))
    score = (2 * n("gold_in_context_not_selected") + n("gold_window_beats_selected_answer") + n("selected_answer_low_overlap")) * (1 + mean)
    return g.groupBy("part").agg(F.round(score, 4).alias("priority"))


_SWEEP = [*BM25_ROWS, *ANSWER, "grid AS (SELECT s, r FROM (VALUES (5.0), (20.0), (40.0), (60.0)) a(s), (VALUES (1), (3), (5)) b(r))", "sw AS MATERIALIZED (SELECT s::DOUBLE AS min_score, r AS max_rank, count(*) FILTER (ans.n > 0 AND best >= s AND first_rank <= r) AS kept, count(*) FILTER (ans.n > 0 AND (best < s OR first_rank > r)) AS newly_refused FROM ans, grid GROUP BY s, r)"]


def _sweep(spark, d):
    e = Evidence(spark, d)
    grid = spark.createDataFrame([(float(s), r) for s in (5, 20, 40, 60) for r in (1, 3, 5)], "min_score double, max_rank int")
    best, first = F.array_max(F.transform("citations", lambda c: c["score"])), F.array_min(F.transform("citations", lambda c: c["rank"]))
    j = e.answers().select("refused", best.alias("best"), first.alias("first")).join(F.broadcast(grid))
    ok = (F.col("best") >= F.col("min_score")) & (F.col("first") <= F.col("max_rank"))
    return j.groupBy("min_score", "max_rank").agg(F.count_if(~F.col("refused") & ok).alias("kept"), F.count_if(~F.col("refused") & ~ok).alias("newly_refused"))


@query(S.query(_SWEEP, "SELECT * FROM sw"))
def threshold_sweep(spark, d):
    return _sweep(spark, d)


@query(S.query(_SWEEP, "SELECT min_score, max_rank, kept FROM sw a WHERE NOT EXISTS (SELECT 1 FROM sw b WHERE b.kept >= a.kept AND b.min_score >= a.min_score AND -b.max_rank >= -a.max_rank AND (b.kept > a.kept OR b.min_score > a.min_score OR b.max_rank < a.max_rank))"))
def pareto_frontier(spark, d):
    s = _sweep(spark, d).withColumn("tight", -F.col("max_rank")).withColumn("id", F.concat_ws("/", "min_score", "max_rank"))
    return evaluate.pareto(s, "id", ["kept", "min_score", "tight"]).select("min_score", "max_rank", "kept")


_IN = lambda names: "(" + ", ".join(S.lit(r) for r in names) + ")"
_COMPOSE = [
    S.BM25, ROUTES, EV, rows_sql("ev", "r", False), placed("r_s", "base", "p", 3),
    f"t3 AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY place) AS slot, list_distinct({S.toks('sentence')}) AS tt FROM p QUALIFY slot <= 3)",
    f"w3 AS (SELECT q_id, count(*) AS n, max(score) FILTER (slot = 1) AS s1, max(greatest(score, 0)) FILTER (slot = 2) AS s2, max(rank) FILTER (slot = 1) AS r1, bool_or(slot = 1 AND {S.has('lower(sentence)', T.COMPOSE_SIGNAL)}) AS signal, max(len(tt)) FILTER (slot = 1) AS l1, max(len(tt)) FILTER (slot = 2) AS l2, max(len(tt)) FILTER (slot = 3) AS l3 FROM t3 GROUP BY q_id)",
    "du AS (SELECT a.q_id, bool_or(a.slot = 1 AND b.slot = 2) AS d12, bool_or(a.slot = 1 AND b.slot = 3) AS d13, bool_or(a.slot = 2 AND b.slot = 3) AS d23 FROM t3 a JOIN t3 b ON a.q_id = b.q_id AND a.slot < b.slot AND a.doc_id = b.doc_id AND len(a.tt) > 0 AND len(b.tt) > 0 AND len(list_intersect(a.tt, b.tt)) / (len(a.tt) + len(b.tt) - len(list_intersect(a.tt, b.tt))) >= 0.96 GROUP BY a.q_id)",
    "kp AS (SELECT w3.*, route, l1 > 0 AS k1, coalesce(l2 > 0 AND NOT coalesce(d12, false), false) AS k2, coalesce(l3 > 0 AND NOT coalesce(d13, false) AND NOT (coalesce(d23, false) AND NOT coalesce(d12, false)), false) AS k3 FROM w3 JOIN qr USING (q_id) LEFT JOIN du USING (q_id))",
    f"dc AS (SELECT *, CASE WHEN route IN {_IN(answer.CITED_ROUTES)} THEN 'keep_top3_citation_sensitive' WHEN route = 'install_upgrade_config' AND s1 >= 100 AND r1 <= 3 AND signal AND (n = 1 OR s2 = 0 OR s1 - s2 >= 60) THEN 'top1_direct_strong_signal' WHEN k1::INT + k2::INT + k3::INT < n THEN 'dedup_same_document' ELSE 'keep_top3_default' END AS decision FROM kp)",
]


@query(S.query(_COMPOSE, "SELECT q_id, route, decision, array_to_string(CASE decision WHEN 'top1_direct_strong_signal' THEN [1] WHEN 'dedup_same_document' THEN list_filter([1, 2, 3], lambda i: ([k1, k2, k3])[i]) ELSE range(1, n + 1) END, ',') AS kept FROM dc"))
def route_aware_compose(spark, d):
    e = Evidence(spark, d)
    return answer.route_composed(evidence.bm25_ranked(e.rows(), 3), e.routes())


METRICS = "count(*) AS questions, round(avg((coalesce(rank, 999) <= 1)::INT), 4) AS hit1, round(avg((coalesce(rank, 999) <= 5)::INT), 4) AS hit5, round(avg((coalesce(rank, 999) <= 10)::INT), 4) AS hit10, round(avg(CASE WHEN rank <= 10 THEN 1 / rank ELSE 0 END), 4) AS mrr, count(*) FILTER (rank IS NULL) AS not_found"
RANKED = "gr AS MATERIALIZED (SELECT gold.q_id, br.rank FROM gold LEFT JOIN br ON br.q_id = gold.q_id AND br.doc_id = gold)"


@query(S.query([S.BM25, S.GOLD, RANKED], f"SELECT {METRICS} FROM gr"))
def retrieval_metrics(spark, d):
    s = Setting(spark, d)
    wide = retrieve.bm25(s.docs, s.terms).select("q_id", "doc_id", F.array("score").alias("s"))
    return evaluate.retrieval_metrics(retrieve.ranks_of(wide, s.gold, ["bm25"]))


_GRID_VALUES = [(f"k{k}_b{b}".replace(".", "_"), k, b) for k in (0.9, 1.2, 1.5) for b in (0.55, 0.75, 0.95)]
_GRID = [
    S.BASE, S.index("b", "docs", S.DOC_TEXT), S.GOLD, "cfg AS (SELECT config_id, k1::DOUBLE AS k1, b::DOUBLE AS b FROM (VALUES " + ", ".join(f"('{i}', {k}, {b})" for i, k, b in _GRID_VALUES) + ") v(config_id, k1, b))",
    f"gs AS MATERIALIZED (SELECT config_id, q_id, doc_id, round(sum({S.term_score('k1', 'b')}), 9) AS score FROM b_m, cfg GROUP BY config_id, q_id, doc_id)", S.ranks("gs", "grk", keys="config_id, q_id"),
    "gg AS MATERIALIZED (SELECT config_id, gold.q_id, rank FROM gold CROSS JOIN cfg LEFT JOIN grk USING (config_id) WHERE false UNION ALL SELECT c.config_id, g.q_id, r.rank FROM gold g CROSS JOIN cfg c LEFT JOIN grk r ON r.config_id = c.config_id AND r.q_id = g.q_id AND r.doc_id = g.gold)",
]


def _grid(spark, d):
    s = Setting(spark, d)
    return retrieve.grid_ranks(s.docs, s.terms, s.gold, _GRID_VALUES)


@query(S.query(_GRID, f"SELECT config_id, {METRICS} FROM gg GROUP BY config_id"))
def bm25_grid_metrics(spark, d):
    return evaluate.retrieval_metrics(_grid(spark, d), ("config_id",))


@query(S.query([*_GRID, f"m AS (SELECT config_id, {METRICS} FROM gg GROUP BY config_id)"], "SELECT config_id, hit10, mrr FROM m ORDER BY hit10 DESC, hit5 DESC, hit1 DESC, mrr DESC, not_found, config_id LIMIT 1"))
def select_config(spark, d):
    m = evaluate.retrieval_metrics(_grid(spark, d), ("config_id",))
    return m.orderBy(F.desc("hit10"), F.desc("hit5"), F.desc("hit1"), F.desc("mrr"), "not_found", "config_id").limit(1).select("config_id", "hit10", "mrr")


_PAIR = [S.BM25, S.GOLD, RANKED, S.index("t", "docs", "title"), S.scores("t", "ts"), S.ranks("ts", "tr"), "gt2 AS (SELECT gold.q_id, tr.rank FROM gold LEFT JOIN tr ON tr.q_id = gold.q_id AND tr.doc_id = gold)", "j AS (SELECT gr.q_id, coalesce(gr.rank, 1000000000) AS b, coalesce(gt2.rank, 1000000000) AS c FROM gr JOIN gt2 USING (q_id))"]


def _pair(spark, d):
    """(q_id, rank or null) of gold in whole documents and in titles: counts of what comes before, so no full ranking is sorted."""
    s = Setting(spark, d)
    g = s.gold

    def ranks(text):
        index = retrieve.Index(s.docs, text, s.terms)
        wide = index.scores().select("q_id", "doc_id", F.array("score").alias("s"))
        return retrieve.ranks_of(wide, g, ["gold"], index.copied).select("q_id", "rank")

    return ranks(retrieve.document_text()), ranks(F.col("title"))


@query(S.query(_PAIR, "SELECT count(*) AS questions, count(*) FILTER (b > 10 AND c <= 10) AS improved, count(*) FILTER (b <= 10 AND c > 10) AS regressed, count(*) FILTER (b <= 10 AND c <= 10) AS both_hit, count(*) FILTER (b > 10 AND c > 10) AS both_missed, count(*) FILTER (c < b) AS rank_up, count(*) FILTER (c > b) AS rank_down FROM j"))
def paired_comparison(spark, d):
    return evaluate.paired(*_pair(spark, d))


@query(S.query(_PAIR, "SELECT b <= 10 AS before, c <= 10 AS after, count(*) AS n FROM j GROUP BY ALL"))
def transition_counts(spark, d):
    b, c = _pair(spark, d)
    j = b.select("q_id", F.coalesce(F.col("rank") <= 10, F.lit(False)).alias("before")).join(c.select("q_id", F.coalesce(F.col("rank") <= 10, F.lit(False)).alias("after")), "q_id")
    return j.groupBy("before", "after").agg(F.count(F.lit(1)).alias("n"))


@query(None)
def paired_bootstrap(spark, d):
    """95 % interval of the MRR difference; seeded numpy resampling of the question list in one task."""
    b, c = _pair(spark, d)
    rr = lambda x: F.coalesce(1 / x["rank"], F.lit(0.0))
    diffs = b.select("q_id", rr(b).alias("x")).join(c.select("q_id", rr(c).alias("y")), "q_id").select("q_id", (F.col("y") - F.col("x")).alias("delta"))

    def resample(pdf):
        import numpy as np
        import pandas as pd

        v = pdf.sort_values("q_id")["delta"].to_numpy()
        rng = np.random.default_rng(20240501)
        means = v[rng.integers(0, len(v), (2000, len(v)))].mean(axis=1) if len(v) else np.zeros(1)
        return pd.DataFrame({"mean": [round(float(v.mean()) if len(v) else 0.0, 6)], "low": [round(float(np.quantile(means, 0.025)), 6)], "high": [round(float(np.quantile(means, 0.975)), 6)]})

    return diffs.groupBy(F.lit(1).alias("all")).applyInPandas(resample, "mean double, low double, high double")


@query(S.query([S.BM25, S.GOLD, RANKED, f"qn AS (SELECT q_id, len(list_distinct({S.toks('text')})) AS n FROM ques)", "tg AS (SELECT q_id, list_sort(list_filter([CASE WHEN n <= 3 THEN 'short_query_lte_3_unique_terms' END, CASE WHEN rank IS NULL THEN 'gold_doc_not_found_within_top50' WHEN rank > 50 THEN 'gold_doc_not_found_within_top50' WHEN rank <= 20 THEN 'gold_doc_rank_11_to_20' ELSE 'gold_doc_rank_21_to_50' END], lambda x: x IS NOT NULL)) AS tags FROM gr JOIN qn USING (q_id) WHERE rank IS NULL OR rank > 10)"], "SELECT q_id, array_to_string(tags, ',') AS tags FROM tg"))
def bm25_miss_tags(spark, d):
    s = Setting(spark, d)
    g = evaluate.gold_ranks(s.asked, s.gold, s.bm25()).filter("rank is null or rank > 10")
    j = g.join(s.asked.select("q_id", F.size(F.array_distinct(T.tokens(F.col("text")))).alias("n")), "q_id")
    where = F.when(F.col("rank").isNull() | (F.col("rank") > 50), "gold_doc_not_found_within_top50").when(F.col("rank") <= 20, "gold_doc_rank_11_to_20").otherwise("gold_doc_rank_21_to_50")
    tags = F.array_sort(F.array_compact(F.array(F.when(F.col("n") <= 3, "short_query_lte_3_unique_terms"), where)))
    return j.select("q_id", F.array_join(tags, ",").alias("tags"))


_FEATURES = [*BM25_ROWS, f"ft AS (SELECT q_id, doc_id, pos, rank, round(score, 4) AS score, len({S.toks('sentence')}) AS n_tokens, len({S.sents('sentence')}) AS n_sentences, len(overlap) AS n_overlap, round(len(overlap) / len(terms)::DOUBLE, 4) AS coverage, {signal_sql('sentence')} AS signal FROM p)"]


@query(S.query(_FEATURES, "SELECT * FROM ft"))
def candidate_features(spark, d):
    r = evidence.bm25_ranked(Evidence(spark, d).rows())
    x = F.col("sentence")
    return r.select("q_id", "doc_id", "pos", "rank", F.round("score", 4).alias("score"), F.size(T.tokens(x)).alias("n_tokens"), F.size(T.sentences(x)).alias("n_sentences"), F.size("overlap").alias("n_overlap"), F.round(F.size("overlap") / F.size("terms"), 4).alias("coverage"), T.answer_signal(x).alias("signal"))


_LABELS = [*BM25_ROWS, S.GOLD, f"bl AS (SELECT p.*, {S.f1(S.toks('sentence'), S.toks('q.text'))} AS f1, gold FROM p JOIN (SELECT q_id, text FROM ques) q USING (q_id) LEFT JOIN gold USING (q_id))"]


@query(S.query(_LABELS, "SELECT q_id, doc_id, pos, f1, row_number() OVER (PARTITION BY q_id ORDER BY f1 DESC, place) = 1 AS is_best, coalesce(doc_id = gold, false) AS is_gold, round(max(f1) OVER (PARTITION BY q_id) - f1, 4) AS gap FROM bl"))
def best_candidate_label(spark, d):
    from pyspark.sql import Window as W

    e = Evidence(spark, d)
    r = evidence.bm25_ranked(e.rows()).join(e.asked.select("q_id", T.tokens(F.col("text")).alias("gt")), "q_id").join(e.gold, "q_id", "left")
    r = r.withColumn("f1", F.round(M.token_f1(T.tokens(F.col("sentence")), F.col("gt")), 4))
    best = F.max("f1").over(W.partitionBy("q_id"))
    first = top_k(r.withColumn("best", best), ["q_id"], [F.col("f1").desc(), F.col("place")], None, "n")
    return first.select("q_id", "doc_id", "pos", "f1", (F.col("n") == 1).alias("is_best"), F.coalesce(F.col("doc_id") == F.col("gold"), F.lit(False)).alias("is_gold"), F.round(F.col("best") - F.col("f1"), 4).alias("gap"))
