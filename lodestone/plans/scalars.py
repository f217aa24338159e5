"""Queries of text and metric scalars."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import metrics as M
from lodestone.functions import text as T
from lodestone.plans import sql as S
from lodestone.sources import tables as R

QUERIES, ORACLES = {}, {}


def query(oracle: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def _docs(spark, d):
    return R.table(spark, d, "documents").select("doc_id", "text")


def _sentences(spark, d):
    return _docs(spark, d).select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("pos", "sentence"))


SENT = f"sent AS MATERIALIZED (SELECT doc_id, unnest(s) AS sentence, generate_subscripts(s, 1) - 1 AS pos FROM (SELECT doc_id, {S.sents('text')} AS s FROM documents))"


@query(f"SELECT doc_id, len(t) AS n_tokens, len(list_distinct(t)) AS n_distinct, md5(array_to_string(t, ' ')) AS digest FROM (SELECT doc_id, {S.toks('text')} AS t FROM documents)")
def tokenize_counts(spark, d):
    t = T.tokens(F.col("text"))
    return _docs(spark, d).select("doc_id", t.alias("t")).select("doc_id", F.size("t").alias("n_tokens"), F.size(F.array_distinct("t")).alias("n_distinct"), F.md5(F.array_join("t", " ").cast("binary")).alias("digest"))


@query(f"WITH {SENT} SELECT doc_id, count(*) AS n_sentences, max(length(sentence)) AS longest, sum(length(sentence))::BIGINT AS characters FROM sent GROUP BY doc_id")
def sentence_split(spark, d):
    return _sentences(spark, d).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_sentences"), F.max(F.length("sentence")).alias("longest"), F.sum(F.length("sentence")).alias("characters"))


@query(f"SELECT doc_id, md5({S.norm('text')}) AS flat, md5(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'))) AS question_key, CASE WHEN length({S.norm('text')}) <= 220 THEN {S.norm('text')} ELSE {S.norm('text')}[1:220] || '...' END AS preview FROM documents")
def normalize_text(spark, d):
    t = F.col("text")
    return _docs(spark, d).select("doc_id", F.md5(T.normalized(t).cast("binary")).alias("flat"), F.md5(T.question_key(t).cast("binary")).alias("question_key"), T.preview(t).alias("preview"))


@query(f"SELECT doc_id, len(c) AS n_terms, md5(array_to_string(list_sort(c), ' ')) AS digest FROM (SELECT doc_id, {S.content('text')} AS c FROM documents)")
def content_terms(spark, d):
    return _docs(spark, d).select("doc_id", T.content_terms(F.col("text")).alias("c")).select("doc_id", F.size("c").alias("n_terms"), F.md5(F.array_join(F.array_sort("c"), " ").cast("binary")).alias("digest"))


_SPECIAL = f"list_sort(list_distinct(regexp_extract_all(lower(text), {S.lit(T.SPECIAL)})))"


@query(f"SELECT doc_id, len(s) AS n_special, array_to_string(s, ' ') AS special FROM (SELECT doc_id, {_SPECIAL} AS s FROM documents)")
def special_tokens(spark, d):
    s = T.special_tokens(F.col("text"))
    return _docs(spark, d).select("doc_id", s.alias("s")).select("doc_id", F.size("s").alias("n_special"), F.array_join("s", " ").alias("special"))


@query(f"SELECT page_id, len(list_distinct(regexp_extract_all(lower(html), {S.lit(T.CVE)}))) AS n_cves, regexp_matches(lower(html), {S.lit(T.PATH_LIKE)}) AS path_like FROM pages")
def cve_extract(spark, d):
    return R.table(spark, d, "pages").select("page_id", F.size(T.cves(F.col("html"))).alias("n_cves"), T.has(F.lower("html"), T.PATH_LIKE).alias("path_like"))


def _route_sql() -> str:
    q, t = "q", "t"
    security = S.any_of(q, T.SECURITY_WORDS)
    pairs = [("security_bulletin_post_fix_behavior", f"{security} AND {S.has(q, T.POST_FIX)}"), ("security_bulletin_affected_product", f"{security} AND {S.has(q, T.AFFECTED)}"), ("security_bulletin_remediation", f"{security} AND {S.has(q, T.REMEDIATION)}"), ("security_bulletin_vulnerability_detail", security)]
    pairs += [(label, S.any_of(q, words)) for label, words in T.ROUTE_WORDS] + [("how_to_or_lookup", S.starts(t, T.LOOKUP_STARTS))]
    return S.case(pairs, "other")


_TURNS = "(SELECT conv_id, turn, lower(concat_ws(chr(10) || chr(10), nullif(trim(left(text, 60)), ''), nullif(trim(text), ''))) AS q, lower(left(text, 60)) AS t, lower(left(text, 60) || chr(10) || text) AS b FROM conversations)"


def _turns(spark, d):
    return R.table(spark, d, "conversations").select("conv_id", "turn", "text", F.substring("text", 1, 60).alias("title"))


@query(f"SELECT conv_id, turn, {_route_sql()} AS route FROM {_TURNS}")
def route_classify(spark, d):
    return _turns(spark, d).select("conv_id", "turn", T.route(F.col("title"), F.col("text")).alias("route"))


@query("SELECT conv_id, turn, " + S.case([(label, f"{S.any_of('b', words)} OR {S.starts('trim(t)', starts)}") for label, words, starts in T.SUBTYPE_WORDS], "general_other") + f" AS subtype FROM {_TURNS}")
def subtype_classify(spark, d):
    return _turns(spark, d).select("conv_id", "turn", T.subtype(F.col("title"), F.col("text")).alias("subtype"))


_TYPES = [("security_bulletin", T.SECURITY_WORDS), T.ROUTE_WORDS[0], ("attachment_or_link", T.LINK_WORDS), *T.ROUTE_WORDS[1:]]


@query("SELECT conv_id, turn, " + S.case([(label, S.any_of("b", words)) for label, words in _TYPES] + [("how_to_or_lookup", S.starts("t", T.LOOKUP_STARTS))], "other") + f" AS kind FROM {_TURNS}")
def question_type(spark, d):
    return _turns(spark, d).select("conv_id", "turn", T.question_type(F.col("title"), F.col("text"), F.lit("")).alias("kind"))


def _noise(x: str) -> str:
    symbols = rf"(length(regexp_replace({x}, '[\pL\pN\s\x0b\pZ]', '', 'g')) / length({x})::DOUBLE)"
    low = f"lower({x})"
    return S.mult((f"length({x}) > 260", 0.72), (f"length({x}) > 500", 0.55), (f"regexp_matches({low}, {S.lit(T.PATH_LIKE)})", 0.7), (S.has(low, T.DUMP), 0.75), (f"{symbols} > 0.18", 0.8))


@query(f"WITH {SENT} SELECT doc_id, count(*) AS n, round(sum({_noise('sentence')}), 6) AS penalty FROM sent GROUP BY doc_id")
def noise_penalty(spark, d):
    return _sentences(spark, d).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(T.noise_penalty(F.col("sentence"))), 6).alias("penalty"))


def answer_bonus_sql(x: str) -> str:
    low = f"lower({x})"
    return f"(CASE WHEN {S.has(low, T.ANSWER)} THEN 25.0::DOUBLE WHEN {S.has(low, T.WORKAROUND)} THEN 12.0::DOUBLE WHEN {S.has(low, T.CAUSE)} THEN 10.0::DOUBLE ELSE 0.0::DOUBLE END)"


def answer_multiplier_sql(x: str) -> str:
    low = f"lower({x})"
    return S.mult((S.has(low, T.ANSWER), 2.5), (S.has(low, T.WORKAROUND), 1.6), (S.has(low, T.CAUSE), 1.3), (S.has(low, T.ACTION), 1.1))


def problem_penalty_sql(x: str) -> str:
    low = f"lower({x})"
    return S.mult((f"contains({low}, 'problem(abstract)') OR {S.has(low, T.STATED)}", 0.12), (S.has(low, T.DIAGNOSIS), 0.5), (S.has(low, T.PROBLEM_DUMP), 0.25), (f"contains(' ' || {low} || ' ', ' null ')", 0.6))


#: Sentences with the words that the signals look for, as the tables have none.
_SIGNALS = [
    "Resolving the problem: install the fix and restart.", "Symptom: a null pointer exception in thread main.", "The root cause is a stack dump at C:\\temp\\x\\y.", "CVEID: CVE-2019-12345 DESCRIPTION: a flaw. CVSS Base Score: 5",
    "You must enable the supported setting before you upgrade.", "Steps to reproduce: run the procedure twice.", "Summary. Remediation/Fixes: apply the patch.", "Known current limitation; an enhancement (RFE) is open.", "See support/docview, Security Bulletin: none.",
]
_SIGNAL_ROWS = "(SELECT pos, x AS sentence FROM (VALUES " + ", ".join(f"({i}, {S.lit(x)})" for i, x in enumerate(_SIGNALS)) + ") AS v(pos, x) UNION ALL SELECT 1000 + item_id, text FROM benchmark)"


def _signals(spark, d):
    rows = spark.createDataFrame(list(enumerate(_SIGNALS)), "pos bigint, sentence string")
    return rows.unionAll(R.table(spark, d, "benchmark").select((F.col("item_id") + 1000).alias("pos"), F.col("text").alias("sentence")))


@query(f"SELECT pos, {answer_bonus_sql('sentence')} AS bonus, round({answer_multiplier_sql('sentence')}, 6) AS multiplier, round({problem_penalty_sql('sentence')}, 6) AS penalty FROM {_SIGNAL_ROWS}")
def answer_section_score(spark, d):
    s = F.col("sentence")
    return _signals(spark, d).select("pos", T.answer_bonus(s).alias("bonus"), F.round(T.answer_multiplier(s), 6).alias("multiplier"), F.round(T.problem_penalty(s), 6).alias("penalty"))


def action_bonus_sql(x: str) -> str:
    low = f"lower({x})"
    return S.plus((S.has(low, T.RESOLVE), 12), (S.has(low, T.STEPS), 8), (S.has(low, T.WINDOW_ACTION), 5), (S.has(low, T.MUST), 3))


def signal_sql(x: str) -> str:
    low = f"lower({x})"
    return "round(" + S.plus((S.has(low, T.ANSWER), 2.0), (S.has(low, T.WORKAROUND), 1.2), (S.has(low, T.WINDOW_ACTION), 0.8), (S.has(low, T.MUST), 0.4)) + ", 4)"


def problem_noise_sql(x: str) -> str:
    low = f"lower({x})"
    return "round(" + S.plus((f"regexp_matches({low}, {S.lit(T.NOISE_HEADING)})", 1.0), (f"regexp_matches({low}, {S.lit(T.QUESTION_HEADING)})", 0.7), (S.has(low, T.TRACE), 0.5), (f"len({S.toks(x)}) > 120", 0.8)) + ", 4)"


def span_bonus_sql(x: str) -> str:
    low = f"lower({x})"
    return S.plus((f"regexp_matches({low}, {S.lit(T.CVSS)})", 45), (f"{low} ~ '.*description.*' AND contains({low}, 'cve') AND {S.has(low, 'description')}", 20), (S.has(low, T.LIMITATION), 22), (S.has(low, T.ENHANCEMENT), 16), (S.has(low, T.SPAN_ACTION), 6))


@query(f"SELECT pos, {action_bonus_sql('sentence')} AS action_bonus, {signal_sql('sentence')} AS signal, {problem_noise_sql('sentence')} AS noise, {span_bonus_sql('sentence')} AS span_bonus FROM {_SIGNAL_ROWS}")
def answer_signals(spark, d):
    s = F.col("sentence")
    return _signals(spark, d).select("pos", T.action_bonus(s).alias("action_bonus"), T.answer_signal(s).alias("signal"), T.problem_noise(s).alias("noise"), T.span_bonus(s).alias("span_bonus"))


_WIN = f"""WITH s AS (SELECT item_id, {S.sents('text')} AS s FROM benchmark),
w AS (SELECT item_id, size, start, array_to_string(s[start : start + size - 1], ' ') AS span FROM (SELECT item_id, s, unnest(range(1, least(3, len(s)) + 1)) AS size FROM s), LATERAL (SELECT unnest(range(1, len(s) - size + 2)) AS start))
SELECT item_id, count(*) AS n_windows, max(length(span)) AS longest, md5(string_agg(span, '|' ORDER BY size, start)) AS digest FROM w GROUP BY item_id"""


@query(_WIN)
def sentence_windows(spark, d):
    w = R.table(spark, d, "benchmark").select("item_id", T.windows(T.sentences(F.col("text")), 3).alias("w")).filter(F.size("w") > 0)
    return w.select("item_id", F.size("w").cast("bigint").alias("n_windows"), F.array_max(F.transform("w", lambda x: F.length(x))).alias("longest"), F.md5(F.array_join("w", "|").cast("binary")).alias("digest"))


_F1 = """shared AS (SELECT a, b, sum(least(x.n, y.n)) AS s FROM counts x JOIN counts y ON x.term = y.term JOIN pairs ON x.id = a AND y.id = b GROUP BY a, b)"""


@query(
    f"""WITH t AS (SELECT item_id AS id, {S.toks('text')} AS t FROM benchmark), pairs AS (SELECT id AS a, id + 1 AS b FROM t WHERE id + 1 IN (SELECT id FROM t)),
counts AS (SELECT id, term, count(*) AS n FROM (SELECT id, unnest(t) AS term FROM t) GROUP BY id, term), {_F1}
SELECT pairs.a AS left_id, pairs.b AS right_id, round(CASE WHEN coalesce(s, 0) = 0 THEN 0 ELSE 2 * (s / len(x.t)::DOUBLE) * (s / len(y.t)::DOUBLE) / (s / len(x.t)::DOUBLE + s / len(y.t)::DOUBLE) END, 6)::DOUBLE AS f1
FROM pairs JOIN t x ON x.id = a JOIN t y ON y.id = b LEFT JOIN shared ON shared.a = pairs.a AND shared.b = pairs.b"""
)
def token_f1_pairs(spark, d):
    t = R.table(spark, d, "benchmark").select(F.col("item_id").alias("left_id"), T.tokens(F.col("text")).alias("x"))
    other = t.select((F.col("left_id") - 1).alias("left_id"), F.col("left_id").alias("right_id"), F.col("x").alias("y"))
    return t.join(other, "left_id").select("left_id", "right_id", F.round(M.token_f1(F.col("x"), F.col("y")), 6).alias("f1"))


@query(
    f"""WITH t AS (SELECT item_id AS id, list_distinct({S.toks('text')}) AS t FROM benchmark)
SELECT x.id AS left_id, y.id AS right_id, round(len(list_intersect(x.t, y.t)) / len(list_distinct(list_concat(x.t, y.t)))::DOUBLE, 6) AS jaccard, round(len(list_intersect(x.t, y.t)) / len(x.t)::DOUBLE, 6) AS coverage FROM t x JOIN t y ON y.id = x.id + 1"""
)
def jaccard_pairs(spark, d):
    t = R.table(spark, d, "benchmark").select(F.col("item_id").alias("left_id"), F.array_distinct(T.tokens(F.col("text"))).alias("x"))
    other = t.select((F.col("left_id") - 1).alias("left_id"), F.col("left_id").alias("right_id"), F.col("x").alias("y"))
    return t.join(other, "left_id").select("left_id", "right_id", F.round(M.jaccard(F.col("x"), F.col("y")), 6).alias("jaccard"), F.round(M.overlap_ratio(F.col("x"), F.col("y")), 6).alias("coverage"))


def _edges(x: str, edges, above: str, missing: str, op: str = "<=") -> str:
    return f"CASE WHEN {x} IS NULL THEN {S.lit(missing)} " + " ".join(f"WHEN {x} {op} {e} THEN {S.lit(label)}" for e, label in edges) + f" ELSE {S.lit(above)} END"


_LENGTH = "CASE WHEN r <= 0.75 THEN 'length_lte_0_75' WHEN r <= 0.85 THEN 'length_0_75_to_0_85' WHEN r < 1.2 THEN 'length_mid_band' WHEN r < 1.35 THEN 'length_1_20_to_1_35' WHEN r < 1.5 THEN 'length_1_35_to_1_50' ELSE 'length_gte_1_50' END"


@query(
    f"""WITH x AS (SELECT doc_id, n_chars / avg(n_chars) OVER () AS r, 1 + doc_id % 70 AS k, (doc_id % 7) / 100.0 AS m FROM documents)
SELECT doc_id, {_LENGTH} AS length_bucket, {_edges('k', M.RANK_EDGES, 'not_found_top50', 'not_found_top50')} AS rank_bucket, {_edges('m', M.MARGIN_EDGES, 'margin_gt_0_05', 'margin_not_available')} AS margin_bucket, round(1 / log2(k + 1), 8) AS rank_score FROM x"""
)
def report_buckets(spark, d):
    docs = R.table(spark, d, "documents")
    mean = docs.agg(F.avg("n_chars").alias("mean"))
    x = docs.join(F.broadcast(mean)).select("doc_id", (F.col("n_chars") / F.col("mean")).alias("r"), (1 + F.col("doc_id") % 70).alias("k"), ((F.col("doc_id") % 7) / F.lit(100.0)).alias("m"))
    return x.select("doc_id", M.length_bucket(F.col("r")).alias("length_bucket"), M.rank_bucket(F.col("k")).alias("rank_bucket"), M.margin_bucket(F.col("m")).alias("margin_bucket"), M.rank_score(F.col("k")).alias("rank_score"))
