"""Queries of structured search, screening and comparison operators."""

from __future__ import annotations

from copy import copy

from pyspark.sql import functions as F

from lodestone.functions import metrics as M
from lodestone.functions import text as T
from lodestone.operators import answer, compare, context, evidence, retrieve
from lodestone.operators.retrieve import ranked
from lodestone.plans import diagnostics
from lodestone.plans import sql as S
from lodestone.plans.evidence import BM25_ROWS, CASES, LOCAL, Evidence, cases, plain_sql, reranked
from lodestone.plans.retrieval import ALL, FIT, SHOW, Setting, shown, with_fit
from lodestone.plans.scalars import signal_sql
from lodestone.sources.scratch import stored

QUERIES, ORACLES = {}, {}


def query(oracle: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def _in(words) -> str:
    return "(" + ", ".join(S.lit(w) for w in words) + ")"


_CONTENT = f"(length(x) >= 3 AND x NOT IN {_in(compare.STOPWORDS)})"
_ACTION = f"x IN {_in(compare.ACTION_TERMS)}"
_ERROR = f"(x IN {_in(compare.ERROR_TERMS)} OR regexp_matches(x, '^(err|warn|0x)') OR (regexp_matches(x, '[a-z]') AND regexp_matches(x, '[0-9]') AND length(x) >= 3))"
_VERSION = rf"(x IN {_in(compare.PLATFORM_TERMS)} OR regexp_full_match(x, 'v?\d+(?:[._-]\d+)+'))"
_ORDERED = "list_filter({t}, lambda y, j: list_position({t}, y) = j)"
_STRUCT = [
    S.DOCS, S.QUES,
    f"tk AS MATERIALIZED (SELECT q_id, t, {_ORDERED.format(t='t')} AS u, h, {_ORDERED.format(t='h')} AS hu, list_distinct(flatten(list_transform(list_concat(list_concat(regexp_extract_all(b, '`([^`]+)`', 1), regexp_extract_all(b, '\"([^\"]+)\"', 1)), regexp_extract_all(b, '''([^'']+)''', 1)), lambda g: {S.toks('g')}))) AS quoted FROM (SELECT q_id, {S.toks('title || chr(10) || text')} AS t, {S.toks('title')} AS h, title || chr(10) || text AS b FROM ques))",
    f"bk AS MATERIALIZED (SELECT q_id, u, list_concat(list_concat(list_concat(list_concat(list_filter(u, lambda x: {_ERROR}), list_filter(u, lambda x: {_VERSION})), list_filter(u, lambda x: list_contains(quoted, x) OR regexp_matches(x, '[_+#.\\-]'))), list_filter(u, lambda x: {_ACTION})), list_filter(hu, lambda x: {_CONTENT} OR {_ACTION})) AS b FROM tk)",
    f"ch1 AS MATERIALIZED (SELECT q_id, u, {_ORDERED.format(t='b')}[1:16] AS c FROM bk)", f"fl1 AS MATERIALIZED (SELECT q_id, c, list_concat(c, list_filter(u, lambda x: {_CONTENT} OR {_ACTION})) AS f FROM ch1)",
    f"fin AS MATERIALIZED (SELECT q_id, CASE WHEN len(c) >= 6 THEN c ELSE {_ORDERED.format(t='f')}[1:16] END AS terms FROM fl1)",
]


@query(S.query(_STRUCT, "SELECT q_id, array_to_string(terms, ' ') AS query, len(terms) AS n FROM fin"))
def structured_query_terms(spark, d):
    t = compare.structured_terms(F.col("title"), F.col("text"))
    return Setting(spark, d).asked.select("q_id", t.alias("t")).select("q_id", F.array_join("t", " ").alias("query"), F.size("t").alias("n"))


@query(S.query([*_STRUCT, "sterms AS (SELECT q_id, unnest(terms) AS term, 1 AS qtf FROM fin)", S.index("g", "docs", S.DOC_TEXT, terms="sterms"), S.scores("g", "gs"), S.ranks("gs", "gr", 10)], f"{SHOW} gr"))
def structured_query_bm25(spark, d):
    s = Setting(spark, d)
    terms = s.asked.select("q_id", F.explode(compare.structured_terms(F.col("title"), F.col("text"))).alias("term"), F.lit(1).alias("qtf"))
    return shown(ranked(retrieve.bm25(s.docs, terms), 10))


_SP = f"array_to_string(list_sort(list_distinct(regexp_extract_all(lower(text), {S.lit(T.SPECIAL)}))), ' ')"


@query(S.query([S.QUES, f"v AS (SELECT q_id, 'title' AS variant, title AS query FROM ques UNION ALL SELECT q_id, 'special', {_SP} FROM ques UNION ALL SELECT q_id, 'title_special', trim(title || ' ' || {_SP}) FROM ques)"], "SELECT * FROM v WHERE trim(query) <> ''"))
def query_variants(spark, d):
    return compare.query_variants(Setting(spark, d).asked)


_WIDE = "wd AS MATERIALIZED (SELECT q_id, doc_id, min(rank) FILTER (channel = 'document') AS document, min(rank) FILTER (channel = 'section') AS section, min(rank) FILTER (channel = 'title') AS title FROM ch GROUP BY q_id, doc_id), wv AS MATERIALIZED (SELECT *, (document IS NOT NULL)::INT + (section IS NOT NULL)::INT + (title IS NOT NULL)::INT AS votes, round(greatest(coalesce(1 / document, 0), coalesce(1 / section, 0), coalesce(1 / title, 0)), 8) AS best_inverse FROM wd)"


@query(S.query([*ALL, _WIDE], "SELECT * FROM wv"))
def channel_features(spark, d):
    return compare.channel_features(Setting(spark, d).channels(), ["document", "section", "title"])


@query(S.query([*ALL, _WIDE], "SELECT votes >= 2 OR best_inverse >= 0.05 AS loose, votes >= 3 OR (votes >= 2 AND best_inverse >= 0.05) AS strict, count(*) AS n FROM wv GROUP BY ALL"))
def filter_rules(spark, d):
    f = compare.channel_features(Setting(spark, d).channels(), ["document", "section", "title"])
    return f.groupBy(compare.passes("route_vote_or_best_secondary_rank").alias("loose"), compare.passes("strong_route_consensus_and_margin").alias("strict")).agg(F.count(F.lit(1)).alias("n"))


@query(S.query([*ALL, S.GOLD, "a AS (SELECT gold.q_id, gold IN (SELECT doc_id FROM br WHERE br.q_id = gold.q_id AND rank <= 10) AS a, gold IN (SELECT doc_id FROM tr WHERE tr.q_id = gold.q_id AND rank <= 10) AS b FROM gold)"], "SELECT count(*) AS questions, count(*) FILTER (a AND b) AS both, count(*) FILTER (a AND NOT b) AS only_first, count(*) FILTER (NOT a AND b) AS only_second, count(*) FILTER (NOT a AND NOT b) AS neither FROM a"))
def view_coverage(spark, d):
    s = Setting(spark, d)
    return compare.view_coverage(s.asked, s.gold, s.bm25(10), s.title(10))


@query(S.query(ALL, "SELECT q_id, list(doc_id ORDER BY x.rank) = any_value(b) AS same_order, len(list_intersect(list(doc_id), any_value(b))) = len(list(doc_id)) AND len(any_value(b)) = len(list(doc_id)) AS same_set, len(list(doc_id)) + len(any_value(b)) - 2 * len(list_intersect(list(doc_id), any_value(b))) AS difference FROM (SELECT * FROM br WHERE rank <= 10) x JOIN (SELECT q_id, list(doc_id ORDER BY rank) AS b FROM sr WHERE rank <= 10 GROUP BY q_id) USING (q_id) GROUP BY q_id"))
def candidate_alignment(spark, d):
    s = Setting(spark, d)
    return compare.alignment(s.bm25(10), s.section(10))


@query(diagnostics.ORACLES["arm_winners"])
def selector_comparison(spark, d):
    e = Evidence(spark, d)
    base = cases(e).filter("answerable")
    other = copy(e)  # shares what is searched and stored
    other.answers = lambda: answer.composed(evidence.overlap_ranked(evidence.sentence_rows(e.results(), e.near), e.asked), e.asked)
    return compare.winners(base, cases(other).filter("answerable"))


@query(S.query(CASES, "SELECT feature, cited_gold, round(avg(value), 6) AS mean, count(*) AS n FROM (SELECT cited_gold, 'f1' AS feature, f1 AS value FROM cs UNION ALL SELECT cited_gold, 'refused', final_refused::INT::DOUBLE FROM cs) GROUP BY feature, cited_gold"))
def feature_contrasts(spark, d):
    c = cases(Evidence(spark, d)).withColumn("refused", F.col("final_refused").cast("int"))
    return compare.feature_contrasts(c, "cited_gold", ["f1", "refused"])


@query(S.query(CASES, "SELECT round(min(m), 6) AS lowest, round(max(m), 6) AS highest, round(max(m) - min(m), 6) AS spread, round(avg(m), 6) AS average FROM (SELECT sum(round(f1 * 10000)::BIGINT) / count(f1) / 10000.0::DOUBLE AS m FROM cs GROUP BY q_id::BIGINT % 5)"))
def fold_stability(spark, d):
    c = cases(Evidence(spark, d)).withColumn("fold", F.col("q_id").cast("bigint") % 5)
    return compare.fold_stability(c, "f1", "fold")


@query(S.query(BM25_ROWS, "SELECT q_id, count(*) FILTER (score >= 20 AND rank <= 3) AS support, support >= 2 AS accepted FROM p GROUP BY q_id"))
def support_count_gate(spark, d):
    return compare.support_gate(evidence.bm25_ranked(Evidence(spark, d).rows()), 20.0, 3, 2)


@query(S.query([*BM25_ROWS, f"an AS (SELECT p.*, 2.0::DOUBLE * len(list_intersect(list_distinct({S.toks('q.text')}), {S.toks('d.title')})) + 0.25::DOUBLE * len(list_intersect(list_distinct({S.toks('q.text')}), {S.toks('p.sentence')})) AS anchor FROM p JOIN ques q USING (q_id) JOIN docs d USING (doc_id))"], "SELECT q_id, doc_id, pos, anchor, row_number() OVER (PARTITION BY q_id ORDER BY anchor DESC, score DESC, rank, doc_id) AS anchored FROM an"))
def anchor_reordering(spark, d):
    e = Evidence(spark, d)
    return compare.anchored(evidence.bm25_ranked(e.rows()), e.asked, e.near).select("q_id", "doc_id", "pos", "anchor", "anchored")


@query(S.query(BM25_ROWS, "SELECT q_id, count(*) AS n, count(DISTINCT doc_id) AS documents, round(max(score), 4) AS best, round(avg(score), 4) AS mean, min(rank) AS first_rank, round(max(score) - avg(score), 4) AS lead, sum(len(overlap))::BIGINT AS overlap FROM p GROUP BY q_id"))
def evidence_summary(spark, d):
    return compare.evidence_summary(evidence.bm25_ranked(Evidence(spark, d).rows()))


def _noise(x: str) -> str:
    return f"round({S.plus((S.has(f'lower({x})', T.NOISE_HEADING), 1.0), (S.has(f'lower({x})', T.QUESTION_HEADING), 0.7), (S.has(f'lower({x})', T.TRACE), 0.5), (f'len({S.toks(x)}) > 120', 0.8))}, 4)"


def gate_sql(max_tokens: int = 90, min_coverage: float = 0.5) -> str:
    n, m = f"len({S.toks('sentence')})", f"len({S.toks('w')})"
    covered = f"(CASE WHEN len({plain_sql('sentence')}) > 0 THEN len(list_intersect({plain_sql('sentence')}, {plain_sql('w')})) / len({plain_sql('sentence')})::DOUBLE ELSE 0 END)"
    return (
        f"(sentence <> w AND {m} <= {max_tokens} AND len({S.sents('w')}) <= 3 AND {m} - {n} <= 60 AND {m} <= greatest({n}, 1) * 4.0 AND {covered} >= {min_coverage} AND {signal_sql('w')} - {signal_sql('sentence')} >= 0"
        f" AND NOT {S.has('lower(w)', T.NOISE_HEADING)} AND NOT {S.has('lower(w)', T.QUESTION_HEADING)} AND {_noise('w')} <= {_noise('sentence')})"
    )


def gated_windows(spark, d):
    """Routed sentences of the route `other` with the best window around each."""
    chosen, best = reranked(Evidence(spark, d))
    return best.join(chosen.select("q_id", "doc_id", "pos", "sentence"), ["q_id", "doc_id", "pos"])


@query(S.query(LOCAL, f"SELECT q_id, doc_id, pos, {gate_sql()} AS replace FROM lw"))
def local_window_gate(spark, d):
    return compare.window_gate(gated_windows(spark, d)).select("q_id", "doc_id", "pos", "replace")


GATES = [(t, c) for t in (40, 90) for c in (0.5, 0.9)]
_GATED = "gr AS MATERIALIZED (SELECT *, " + ", ".join(f"{gate_sql(t, c)} AS g{i}" for i, (t, c) in enumerate(GATES)) + f", {S.f1(S.toks('sentence'), S.toks('q.text'))} AS fs, {S.f1(S.toks('w'), S.toks('q.text'))} AS fw FROM lw JOIN ques q USING (q_id))"
_GRAIN = "sum(round(10000 * {x})::BIGINT) / 10000.0::DOUBLE"


@query(S.query([*LOCAL, _GATED], " UNION ALL ".join(f"SELECT 'tokens{t}_coverage{round(c * 100)}' AS gate, count(*) AS windows, count(*) FILTER (g{i}) AS replaced, {_GRAIN.format(x='fs')} AS baseline_f1, {_GRAIN.format(x='fw')} AS forced_f1, {_GRAIN.format(x=f'CASE WHEN g{i} THEN fw ELSE fs END')} AS gated_f1, count(*) FILTER (g{i} AND fw > fs) AS improved, count(*) FILTER (g{i} AND fw < fs) AS regressed FROM gr" for i, (t, c) in enumerate(GATES))))
def window_gate_grid(spark, d):
    """Every gate setting over the same windows: F1 of sentences, of all windows, and of the windows that it lets through."""
    e = Evidence(spark, d)
    rows = stored(gated_windows(spark, d).join(e.asked.select("q_id", T.tokens(F.col("text")).alias("gt")), "q_id"), "windows")
    f1 = lambda c: F.round(M.token_f1(T.tokens(F.col(c)), F.col("gt")), 4)
    rows = stored(rows.withColumn("fs", f1("sentence")).withColumn("fw", f1("window")), "window_f1")
    out = None
    for tokens, coverage in GATES:
        gated = compare.window_gate(rows, max_tokens=tokens, min_coverage=coverage).withColumn("gate", F.lit(f"tokens{tokens}_coverage{round(coverage * 100)}"))
        part = gated.select("gate", "replace", "fs", "fw")
        out = part if out is None else out.unionByName(part)
    return compare.gate_outcomes(out)


_ORACLE = [*BM25_ROWS, f"c3 AS (SELECT p.q_id, place, sentence, string_agg(sentence, ' ') OVER (PARTITION BY p.q_id ORDER BY place) AS so_far, q.text FROM p JOIN (SELECT q_id, text FROM ques) q USING (q_id) WHERE place <= 3)", f"c4 AS (SELECT q_id, place, {S.f1(S.toks('sentence'), S.toks('text'))} AS f, {S.f1(S.toks('so_far'), S.toks('text'))} AS pf FROM c3)"]


@query(S.query(_ORACLE, "SELECT q_id, max(f) AS best_single, max(pf) AS best_prefix, max(f) FILTER (place = 1) AS first FROM c4 GROUP BY q_id"))
def composition_oracle(spark, d):
    from pyspark.sql import Window as W

    e = Evidence(spark, d)
    r = evidence.bm25_ranked(e.rows()).filter("place <= 3").join(e.asked.select("q_id", T.tokens(F.col("text")).alias("gt")), "q_id")
    so_far = F.array_join(F.collect_list("sentence").over(W.partitionBy("q_id").orderBy("place")), " ")  # three sentences a question
    f1 = lambda x: F.round(M.token_f1(T.tokens(x), F.col("gt")), 4)
    return compare.prefix_oracle(r.select("q_id", "place", f1(F.col("sentence")).alias("f1"), so_far.alias("prefix"), "gt").withColumn("prefix_f1", f1(F.col("prefix"))))


_PHRASES = [S.QUES, f"nt AS MATERIALIZED (SELECT q_id, {S.toks('text')} AS t FROM ques)", f"nr AS MATERIALIZED (SELECT q_id, flatten(list_transform(list_filter(range(1, len(t)), lambda i: len(list_filter(t[i : i + 1], lambda x: {_CONTENT})) = 2), lambda i: t[i : i + 1])) AS f FROM nt)"]


@query(S.query(_PHRASES, f"SELECT q_id, array_to_string({_ORDERED.format(t='f')}, ' ') AS terms, len(list_distinct(f)) AS n FROM nr"))
def noun_phrase_terms(spark, d):
    """Terms that stand beside another content term, as a view of a question."""
    t = compare.noun_phrases(T.tokens(F.col("text")))
    return Setting(spark, d).asked.select("q_id", t.alias("t")).select("q_id", F.array_join("t", " ").alias("terms"), F.size("t").alias("n"))


@query(S.query([S.BM25, FIT, "uc AS (SELECT *, round(fit + score / 10, 6) AS model FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY fit DESC, rank, doc_id) AS by_fit FROM fits) WHERE by_fit <= 10 OR rank <= 10)"], "SELECT q_id, doc_id, rank AS was, round(model, 6) AS model, row_number() OVER (PARTITION BY q_id ORDER BY model DESC, rank, doc_id) AS rank FROM uc QUALIFY row_number() OVER (PARTITION BY q_id ORDER BY model DESC, rank, doc_id) <= 10"))
def union_context(spark, d):
    """The first ten by overlap and the first ten by rank together, ordered by a score, cut at ten."""
    rows = with_fit(Setting(spark, d)).withColumn("model", F.round(F.col("fit") + F.col("score") / 10, 6)).withColumnRenamed("rank", "was")
    return context.union_context(rows)
