"""Queries of leakage, splits, action policies, threads and sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import metrics as M
from lodestone.functions import text as T
from lodestone.operators import actions, evaluate, evidence, leakage, threads
from lodestone.plans import sql as S
from lodestone.plans.evidence import BM25_ROWS, Evidence
from lodestone.plans.retrieval import FIT, POOL, PREFIX, Setting, fit_sql, with_fit
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


def _norm(x: str) -> str:
    return f"trim(regexp_replace(lower({x}), '[^a-z0-9]+', ' ', 'g'))"


@query(S.query([S.DOCS, S.SECTIONS], f"SELECT b.item_id::VARCHAR AS q_id, s.doc_id, s.pos FROM benchmark b JOIN sections s ON {_norm('b.text')} = {_norm('s.text')} WHERE {_norm('b.text')} <> ''"))
def exact_leakage(spark, d):
    docs = R.documents(spark, d)
    asked = R.table(spark, d, "benchmark").select(F.col("item_id").cast("string").alias("q_id"), "text")
    return leakage.exact_overlaps(asked, R.sections(docs).select("doc_id", "pos", "text"))


@query(f"""WITH t AS (SELECT doc_id, list_sort(list_distinct({S.toks('text')})) AS terms FROM documents), c AS MATERIALIZED (SELECT terms, min(doc_id) AS id, count(*) AS members FROM t WHERE len(terms) > 0 GROUP BY terms),
e AS (SELECT id, unnest(terms) AS term FROM c), s AS (SELECT a.id AS left_id, b.id AS right_id, count(*) AS shared FROM e a JOIN e b ON a.term = b.term AND a.id < b.id GROUP BY a.id, b.id)
SELECT left_id, right_id, round(shared / (len(x.terms) + len(y.terms) - shared), 4) AS similarity, x.members AS n_left, y.members AS n_right FROM s JOIN c x ON x.id = left_id JOIN c y ON y.id = right_id WHERE shared / (len(x.terms) + len(y.terms) - shared) >= 0.8""")  # fmt: skip
def near_duplicate_join(spark, d):
    return leakage.similar_sets(R.table(spark, d, "documents"), "doc_id", T.tokens(F.col("text")), 0.8)


@query(f"""WITH p AS ({ORACLES["near_duplicate_join"]}), l AS (SELECT id, count(*) AS n_links FROM (SELECT left_id AS id FROM p UNION ALL SELECT right_id FROM p) GROUP BY id),
t AS (SELECT doc_id, list_sort(list_distinct({S.toks("text")})) AS terms FROM documents), m AS (SELECT doc_id AS id, min(doc_id) OVER w AS representative, count(*) OVER w AS members FROM t WHERE len(terms) > 0 WINDOW w AS (PARTITION BY terms))
SELECT m.id, representative, members, coalesce(n_links, 0) AS n_links FROM m LEFT JOIN l ON l.id = representative""")
def near_duplicate_members(spark, d):
    """Who is in the classes of near_duplicate_join."""
    docs = R.table(spark, d, "documents")
    return leakage.set_members(docs, "doc_id", T.tokens(F.col("text")), near_duplicate_join(spark, d))


@query(f"WITH k AS (SELECT doc_id AS id, {_norm('text')} AS norm FROM documents) SELECT id, min(id) OVER (PARTITION BY norm) AS class_id, count(*) OVER (PARTITION BY norm) AS n FROM k QUALIFY n > 1")
def internal_duplicates(spark, d):
    return leakage.internal_duplicates(R.table(spark, d, "documents"), "doc_id")


@query(f"WITH k AS (SELECT doc_id, source, lang, {_norm('text')} AS norm FROM documents), r AS (SELECT doc_id, CASE WHEN lang <> 'en' THEN 'language' WHEN count(*) OVER (PARTITION BY norm) > 1 THEN 'internal_duplicate' WHEN length(norm) < 40 THEN 'too_short' ELSE 'selected' END AS reason FROM k) SELECT reason, count(*) AS n FROM r GROUP BY reason")
def split_exclusions(spark, d):
    docs = R.table(spark, d, "documents").select("doc_id", "lang", T.question_key(F.col("text")).alias("norm"))
    dup = leakage.internal_duplicates(R.table(spark, d, "documents"), "doc_id").select(F.col("id").alias("doc_id"), F.lit(True).alias("dup"))
    reason = F.when(F.col("lang") != "en", "language").when(F.col("dup"), "internal_duplicate").when(F.length("norm") < 40, "too_short").otherwise("selected")
    return docs.join(dup, "doc_id", "left").groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


_SEL = "sel AS MATERIALIZED (SELECT id FROM (SELECT DISTINCT source AS id FROM documents) ORDER BY sha256('split|' || id) LIMIT (SELECT ceil(count(DISTINCT source) * 0.2)::BIGINT FROM documents))"


@query(S.query([_SEL], "SELECT CASE WHEN source IN (SELECT id FROM sel) THEN 'test' ELSE 'train' END AS split, count(*) AS n, count(DISTINCT source) AS groups FROM documents GROUP BY split"))
def disjoint_split(spark, d):
    docs = R.table(spark, d, "documents").select("doc_id", "source")
    sel = leakage.disjoint_selection(docs, "source", 0.2, "split").withColumnRenamed("id", "source").withColumn("split", F.lit("test"))
    j = docs.join(sel, "source", "left").withColumn("split", F.coalesce("split", F.lit("train")))
    return j.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("source").alias("groups"))


@query("SELECT item_id::VARCHAR AS q_id, (row_number() OVER (ORDER BY item_id::VARCHAR) - 1) % 5 AS fold FROM benchmark")
def fold_round_robin(spark, d):
    return leakage.fold_round_robin(R.questions(spark, d), "q_id", 5)


_FOLDS = """WITH RECURSIVE g AS (SELECT source, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, sha256(source) NULLS FIRST) AS i FROM documents GROUP BY source),
st AS (SELECT 0::BIGINT AS i, [0, 0, 0, 0, 0]::BIGINT[] AS load, 0 AS fold UNION ALL SELECT g.i, list_transform(load, lambda v, j: CASE WHEN j = list_position(load, list_min(load)) THEN v + g.n ELSE v END), list_position(load, list_min(load)) FROM st JOIN g ON g.i = st.i + 1)
SELECT source, fold FROM st JOIN g USING (i)"""


@query(_FOLDS)
def greedy_folds(spark, d):
    g = R.table(spark, d, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    return leakage.greedy_folds(g, "source", "n", 5)


_PASSAGE = f"SELECT b.item_id::VARCHAR AS q_id, d.doc_id FROM benchmark b JOIN documents d ON contains(' ' || {_norm('d.text')} || ' ', ' ' || {_norm('b.text')} || ' ') WHERE {_norm('b.text')} <> ''"
_NEAR = f"""WITH x AS (SELECT item_id::VARCHAR AS q_id, list_distinct({S.toks('text')}) AS a FROM benchmark), y AS (SELECT doc_id, list_distinct({S.toks('text')}) AS b FROM documents),
j AS (SELECT q_id, doc_id, len(list_intersect(a, b)) AS shared, len(a) AS n, len(b) AS m FROM x JOIN y ON len(a) > 0 AND len(b) > 0 AND len(b) >= 0.79 * len(a) AND len(b) <= len(a) / 0.79)
SELECT q_id, doc_id, round(shared / (n + m - shared), 4) AS similarity FROM j WHERE shared / (n + m - shared) >= 0.8"""


@query(_PASSAGE)
def passage_leakage(spark, d):
    asked = R.table(spark, d, "benchmark").select(F.col("item_id").cast("string").alias("q_id"), "text")
    return leakage.contained_passages(asked, "q_id", R.table(spark, d, "documents"), "doc_id")


@query(_NEAR)
def near_leakage(spark, d):
    terms = T.tokens(F.col("text"))
    asked = R.table(spark, d, "benchmark").select(F.col("item_id").cast("string").alias("q_id"), "text")
    found = leakage.near_sets(asked, "q_id", terms, R.table(spark, d, "documents"), "doc_id", terms, 0.8)
    return found.select(F.col("left_id").alias("q_id"), F.col("right_id").alias("doc_id"), "similarity")


_LINES = f"SELECT b.item_id FROM benchmark b JOIN (SELECT unnest(string_split(text, chr(10))) AS line FROM documents) s ON {_norm('b.text')} = {_norm('s.line')} WHERE {_norm('b.text')} <> ''"


@query(f"WITH c AS (SELECT (SELECT count(*) FROM benchmark) AS rows, (SELECT count(*) FROM ({_LINES})) AS equal_lines, (SELECT count(*) FROM ({_NEAR})) AS near) SELECT *, CASE WHEN equal_lines > 0 OR near > 0 THEN 'leakage_found' ELSE 'no_equal_line_or_near_copy' END AS decision FROM c")
def leakage_report(spark, d):
    """Lines equal to a passage, and near copies of whole texts; passages inside a text are leakage_audit's."""
    report = leakage.leakage_report(exact_leakage(spark, d), near_leakage(spark, d), R.table(spark, d, "benchmark"), "no_equal_line_or_near_copy")
    return report.withColumnRenamed("exact", "equal_lines")


@query(f"WITH c AS (SELECT (SELECT count(*) FROM benchmark) AS rows, (SELECT count(*) FROM ({_PASSAGE})) AS exact, (SELECT count(*) FROM ({_NEAR})) AS near) SELECT *, CASE WHEN exact > 0 OR near > 0 THEN 'leakage_found' ELSE 'clean' END AS decision FROM c")
def leakage_audit(spark, d):
    """Passages anywhere in a text, and near copies of whole texts."""
    return leakage.leakage_report(passage_leakage(spark, d), near_leakage(spark, d), R.table(spark, d, "benchmark"))


@query(S.query([*BM25_ROWS, "k AS MATERIALIZED (SELECT q_id, list(place - 1 ORDER BY place) AS a, list(doc_id ORDER BY place) AS d FROM p WHERE place <= 12 GROUP BY q_id)",
    "k3 AS MATERIALIZED (SELECT q_id, a, a[1:3] AS b, a[4:] AS o, d FROM k)", "sl AS (SELECT *, unnest(range(1, len(b) + 1)) AS i FROM k3)",
    "ev_ AS (SELECT q_id, 0 AS o, 'baseline' AS family, b AS idx FROM k3 UNION ALL SELECT q_id, 1, 'delete_slot_' || i, list_concat(b[1 : i - 1], b[i + 1 :]) FROM sl UNION ALL SELECT q_id, 2, 'replace_slot_' || i, list_concat(list_concat(b[1 : i - 1], [x]), b[i + 1 :]) FROM (SELECT *, unnest(o) AS x FROM sl) UNION ALL SELECT q_id, 3, 'append_candidate', list_concat(b, [x]) FROM (SELECT *, unnest(o) AS x FROM k3) WHERE len(b) < 3 UNION ALL SELECT q_id, 4, 'keep_prefix_1', b[1:1] FROM k3 UNION ALL SELECT q_id, 5, 'keep_prefix_2', b[1:2] FROM k3 UNION ALL SELECT q_id, 6, 'document_coverage', list_filter(a, lambda x: list_position(d, d[x + 1]) = x + 1)[1:3] FROM k3)",
    "fl AS (SELECT q_id, o, family, array_to_string(idx, ',') AS idx FROM ev_)"],
    "SELECT q_id, idx, min_by(family, o * 100 + coalesce(TRY_CAST(family[-1:] AS INT), 0)) AS family, count(DISTINCT family) AS names FROM fl WHERE idx <> '' GROUP BY q_id, idx"))
def action_enumeration(spark, d):
    r = evidence.bm25_ranked(Evidence(spark, d).rows()).select("q_id", "place", "doc_id")
    return actions.enumerate_actions(r)


PRED = "pr AS MATERIALIZED (SELECT q_id, doc_id AS action_id, fit AS gain, round(1 / (1 + score) + rank / 500.0::DOUBLE, 6) AS risk, (shared - first_value(shared) OVER w)::INT AS cit, round(score - first_value(score) OVER w, 2) AS f1, rank = 1 AS base FROM fits WHERE rank <= 30 WINDOW w AS (PARTITION BY q_id ORDER BY rank))"


def predictions(spark, d):
    """Scored actions from retrieval: documents as actions, rank 1 as the baseline."""
    from pyspark.sql import Window as W

    s = Setting(spark, d)
    docs = s.docs.select("doc_id", F.array_distinct(T.tokens(F.col("text"))).alias("dt"))
    asked = s.asked.select("q_id", F.array_distinct(T.tokens(F.col("text"))).alias("qt"))
    c = with_fit(s).filter("rank <= 30").join(docs, "doc_id").join(asked, "q_id").withColumn("shared", F.size(F.array_intersect("qt", "dt")))
    w = W.partitionBy("q_id").orderBy("rank")
    first = lambda x: F.first(x).over(w)
    risk = F.round(1 / (1 + F.col("score")) + F.col("rank") / F.lit(500.0), 6)
    return c.select("q_id", F.col("doc_id").alias("action_id"), F.col("fit").alias("gain"), risk.alias("risk"), (F.col("shared") - first("shared")).alias("cit"), F.round(F.col("score") - first("score"), 2).alias("f1"), (F.col("rank") == 1).alias("base"))


_P = [S.BM25, FIT, PRED]
_TIER = "CASE WHEN cit >= 0 AND f1 >= -1e-9 AND (cit > 0 OR f1 > 1e-9) THEN 2 WHEN cit = 0 AND abs(f1) <= 1e-9 THEN 1 ELSE 0 END"
_OUT = "CASE WHEN cit > 0 AND f1 > 1e-9 THEN 'dual_gain' WHEN cit > 0 AND abs(f1) <= 1e-9 THEN 'citation_gain_f1_tied' WHEN cit = 0 AND f1 > 1e-9 THEN 'f1_gain_citation_preserved' WHEN cit > 0 THEN 'citation_gain_f1_loss' WHEN cit < 0 THEN 'citation_loss' WHEN f1 < -1e-9 THEN 'citation_preserved_f1_loss' ELSE 'neutral' END"


@query(S.query(_P, f"SELECT q_id, action_id, {_OUT} AS outcome, {_TIER} AS tier FROM pr"))
def action_outcome(spark, d):
    return predictions(spark, d).select("q_id", "action_id", actions.outcome(F.col("cit"), F.col("f1")).alias("outcome"), actions.tier(F.col("cit"), F.col("f1")).alias("tier"))


def _dom(a: str, b: str) -> str:
    return f"({a}.cit >= {b}.cit AND {a}.f1 >= {b}.f1 - 1e-9 AND ({a}.cit > {b}.cit OR {a}.f1 > {b}.f1 + 1e-9))"


_TIERED = f"pt AS MATERIALIZED (SELECT *, {_TIER} AS tier FROM pr)"


@query(S.query([*_P, _TIERED, f"j AS (SELECT a.q_id, a.action_id AS left_id, b.action_id AS right_id, CASE WHEN a.tier > b.tier THEN 1 WHEN a.tier < b.tier THEN -1 WHEN a.tier = 0 THEN 0 WHEN {_dom('a', 'b')} THEN 1 WHEN {_dom('b', 'a')} THEN -1 ELSE 0 END AS preference FROM pt a JOIN pt b ON a.q_id = b.q_id AND a.action_id < b.action_id)"], "SELECT *, round(1 / (2 * count(*) OVER (PARTITION BY q_id)), 9) AS weight FROM j WHERE preference <> 0"))
def pairwise_pairs(spark, d):
    return actions.pairs(predictions(spark, d))


@query(S.query([*_P, _TIERED, "bt AS MATERIALIZED (SELECT *, max(tier) OVER (PARTITION BY q_id) AS best FROM pt QUALIFY tier = best)", f"k AS (SELECT * FROM bt a WHERE NOT EXISTS (SELECT 1 FROM bt b WHERE a.q_id = b.q_id AND a.action_id <> b.action_id AND {_dom('b', 'a')}))"], "SELECT q_id, action_id, tier, round(1 / count(*) OVER (PARTITION BY q_id), 9) AS probability FROM k"))
def listnet_target(spark, d):
    return actions.frontier(predictions(spark, d))


_POOL = "pl AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY risk, action_id) AS safe FROM pr) WHERE safe <= {cap} OR base)"
_WIN = "SELECT q_id, action_id, gain, risk FROM {t} QUALIFY row_number() OVER (PARTITION BY q_id ORDER BY gain DESC, risk, action_id) = 1"


@query(S.query([*_P, _POOL.format(cap=8)], _WIN.format(t="pl")))
def rank_capped_pool(spark, d):
    return actions.rank_capped(predictions(spark, d))


@query(S.query([*_P, _POOL.format(cap=16), "px AS (SELECT * FROM (SELECT * EXCLUDE (safe), row_number() OVER (PARTITION BY q_id ORDER BY risk, action_id) AS safe FROM pl) WHERE safe <= 4 OR base)"], _WIN.format(t="px")))
def safety_frontier(spark, d):
    return actions.safety_first(predictions(spark, d))


_RANKS = "ru AS (SELECT *, (row_number() OVER (PARTITION BY q_id ORDER BY gain DESC, risk, action_id) - 1) / greatest(1, count(*) OVER (PARTITION BY q_id) - 1) AS g, (row_number() OVER (PARTITION BY q_id ORDER BY risk, gain DESC, action_id) - 1) / greatest(1, count(*) OVER (PARTITION BY q_id) - 1) AS r FROM pr), uu AS (SELECT *, round(g + 0.5::DOUBLE * r, 9) AS utility FROM ru)"


@query(S.query([*_P, _RANKS], "SELECT q_id, action_id, round(utility, 6) AS utility FROM uu QUALIFY row_number() OVER (PARTITION BY q_id ORDER BY utility, r, g, action_id) = 1"))
def joint_risk_winner(spark, d):
    return actions.rank_utility(predictions(spark, d))


_LABEL = "CASE WHEN base THEN 1 WHEN cit >= 0 AND f1 >= -3 THEN 2 WHEN cit >= -2 THEN 0 ELSE -1 END"


@query(S.query([*_P, f"lb AS (SELECT q_id, action_id, {_LABEL} AS label FROM pr)", "n AS (SELECT *, count(*) FILTER (label = 2) OVER w AS ns, count(*) FILTER (label >= 0) OVER w AS nf, count(*) FILTER (label IN (1, 2)) OVER w AS np FROM lb WINDOW w AS (PARTITION BY q_id))"], "SELECT q_id, action_id, label, round(((CASE WHEN ns > 0 THEN (label = 2)::INT::DOUBLE / ns ELSE (label = 1)::INT::DOUBLE END) + 0.5::DOUBLE * (label >= 0)::INT::DOUBLE / nf + 0.25::DOUBLE * (label IN (1, 2))::INT::DOUBLE / np) / 1.75::DOUBLE, 9) AS target FROM n"))
def top1_target(spark, d):
    label = F.when(F.col("base"), 1).when((F.col("cit") >= 0) & (F.col("f1") >= -3), 2).when(F.col("cit") >= -2, 0).otherwise(-1)
    return actions.grouped_target(predictions(spark, d).select("q_id", "action_id", label.alias("label")))


@query(S.query(_P, "SELECT q_id, action_id, round(gain - avg(gain) OVER w, 6) AS delta, round(CASE WHEN stddev_pop(gain) OVER w > 0 THEN (gain - avg(gain) OVER w) / stddev_pop(gain) OVER w ELSE 0 END, 6) AS zscore, round(cume_dist() OVER (PARTITION BY q_id ORDER BY gain), 6) AS share, gain = min(gain) OVER w AS is_min, gain = max(gain) OVER w AS is_max FROM pr WINDOW w AS (PARTITION BY q_id)"))
def relative_features(spark, d):
    return actions.relative(predictions(spark, d), "gain")


VARIETY = f"SELECT l.doc_id, round(CASE WHEN len(t) > 0 THEN len(list_distinct(t)) / len(t)::DOUBLE ELSE 0 END, 6) AS p, quality FROM labels l JOIN (SELECT doc_id, {S.toks('text')} AS t FROM documents) USING (doc_id) WHERE quality IS NOT NULL"


def variety(spark, d):
    """Labelled documents with the share of their tokens that are distinct, as a score of quality; stored, as refined histograms read it many times."""
    import pyarrow as pa

    texts = R.table(spark, d, "documents").select("doc_id", F.lower("text").alias("text"))
    sizes = T.token_sizes()

    def count(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, sizes(batch.column("text")))], names=["doc_id", "n", "kinds"])

    counted = texts.mapInArrow(count, f"doc_id {texts.schema['doc_id'].dataType.simpleString()}, n bigint, kinds bigint")
    docs = counted.select("doc_id", F.round(M.ratio(F.col("kinds"), F.col("n")), 6).alias("p"))
    return stored(R.table(spark, d, "labels").filter("quality is not null").select("doc_id", "quality").join(docs, "doc_id"), "variety")


@query(f"WITH c AS ({VARIETY}) SELECT least(floor(p * 5), 4)::INT AS bin, count(*) AS n, round(avg(p), 6) AS predicted, round(avg(quality), 6) AS observed, round(avg((p - quality) * (p - quality)), 6) AS brier FROM c GROUP BY bin")
def risk_calibration(spark, d):
    return actions.risk_calibration(variety(spark, d), "p", "quality")


@query(f"SELECT min(v) AS threshold FROM (SELECT p AS v FROM ({VARIETY}) ORDER BY v DESC LIMIT (SELECT ceil(count(*) * 0.3)::BIGINT FROM labels))")
def coverage_threshold(spark, d):
    return actions.coverage_threshold(variety(spark, d), "p", 0.3)


_SIDE = [S.BM25, fit_sql(POOL), f"wt AS (SELECT fits.*, list_intersect(list_distinct({S.toks('q.text')}), {S.toks('d.text')}) AS t FROM fits JOIN docs d USING (doc_id) JOIN ques q USING (q_id))", "pri AS (SELECT q_id, list_distinct(flatten(list(t))) AS seen FROM (SELECT * FROM wt WHERE rank <= 200 QUALIFY row_number() OVER (PARTITION BY q_id ORDER BY fit DESC, rank, doc_id) <= 10) GROUP BY q_id)"]


@query(S.query(_SIDE, "SELECT q_id, doc_id, row_number() OVER (PARTITION BY q_id ORDER BY fit DESC, rank, doc_id) AS place, len(list_filter(t, lambda x: NOT list_contains(seen, x))) AS novel FROM wt JOIN pri USING (q_id) WHERE rank > 200 QUALIFY place <= 5"))
def sidecar_observation(spark, d):
    """The best tail documents beside the primary context, and their novel query terms."""
    from lodestone.operators.retrieve import top_k

    s = Setting(spark, d)
    docs = s.docs.select("doc_id", F.array_distinct(T.tokens(F.col("text"))).alias("dt"))
    asked = s.asked.select("q_id", F.array_distinct(T.tokens(F.col("text"))).alias("qt"))
    c = with_fit(s, POOL).join(docs, "doc_id").join(asked, "q_id").withColumn("t", F.array_intersect("qt", "dt")).drop("dt", "qt").withColumnRenamed("rank", "was")
    order = [F.col("fit").desc(), F.col("was"), F.col("doc_id")]
    primary = top_k(c.filter(F.col("was") <= PREFIX), ["q_id"], order, 10, "n").groupBy("q_id").agg(F.array_distinct(F.flatten(F.collect_list("t"))).alias("seen"))  # ten rows a question
    side = top_k(c.filter(F.col("was") > PREFIX), ["q_id"], order, 5, "place")
    return side.join(primary, "q_id").select("q_id", "doc_id", "place", F.size(F.array_except("t", "seen")).alias("novel"))


_TURNS = "sp AS (SELECT *, lead(role) OVER w AS next_role, lead(text) OVER w AS response FROM conversations WHERE role <> 'system' WINDOW w AS (PARTITION BY conv_id ORDER BY turn)), tu AS MATERIALIZED (SELECT conv_id AS thread, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS seq, strlen(text) + strlen(response) AS bytes FROM sp WHERE role = 'user' AND next_role = 'assistant')"
_LEDGER = "ls AS (SELECT thread, list(bytes ORDER BY seq) AS b FROM tu GROUP BY thread), fo AS (SELECT thread, len(b) AS offered, list_reduce(list_transform(b, lambda x: {'kept': 0, 'bytes': x::BIGINT}), lambda acc, x: CASE WHEN acc.kept < 3 AND acc.bytes + x.bytes <= 2000 THEN {'kept': acc.kept + 1, 'bytes': acc.bytes + x.bytes} ELSE acc END, {'kept': 0, 'bytes': 0::BIGINT}) AS st FROM ls)"


@query(S.query([_TURNS, _LEDGER], "SELECT thread, offered, st.kept AS kept, st.bytes AS bytes FROM fo"))
def thread_ledger(spark, d):
    return threads.ledger(threads.turns(R.table(spark, d, "conversations")))


@query("WITH t(state, action, next_state) AS (VALUES " + ", ".join(str(x) for x in threads.TRANSITIONS) + "), a AS (SELECT (['received', 'validated', 'context_prepared', 'observed'])[1 + event_id % 4] AS state, (['validate_request', 'retrieve_candidate_pool', 'select_refuse', 'complete', 'refuse'])[1 + event_id % 5] AS action FROM events), n AS (SELECT state, action, count(*) AS n FROM a GROUP BY ALL) SELECT state, action, next_state, n FROM n LEFT JOIN t USING (state, action)")
def transition_check(spark, d):
    pick = lambda names, k: F.element_at(F.array(*[F.lit(x) for x in names]), (F.col("event_id") % k + 1).cast("int"))
    a = R.table(spark, d, "events").select(pick(["received", "validated", "context_prepared", "observed"], 4).alias("state"), pick(["validate_request", "retrieve_candidate_pool", "select_refuse", "complete", "refuse"], 5).alias("action"))
    return threads.transition_check(a, spark.createDataFrame(threads.TRANSITIONS, "state string, action string, next_state string"))


@query("SELECT event_type AS node, count(value) AS n, round(avg(value), 4) AS average, round(quantile_cont(value, 0.5), 4) AS p50, round(quantile_cont(value, 0.95), 4) AS p95, round(quantile_cont(value, 0.99), 4) AS p99, round(max(value), 4) AS highest FROM events GROUP BY event_type")
def node_latency(spark, d):
    return threads.node_latency(R.table(spark, d, "events"), "event_type", "value")


@query("WITH p AS (SELECT event_type, epoch(ts) AS t, 1 AS d FROM events UNION ALL SELECT event_type, epoch(ts) + value, -1 FROM events), r AS (SELECT event_type, d, sum(d) OVER (PARTITION BY event_type ORDER BY t, d ROWS UNBOUNDED PRECEDING) AS running FROM p) SELECT event_type, count(*) AS n, max(running)::BIGINT AS peak, count(*) FILTER (running > 4) AS over_limit FROM r WHERE d = 1 GROUP BY event_type")
def admission_peaks(spark, d):
    return threads.concurrency(R.table(spark, d, "events"), "ts", "value", 4, "event_type")


@query("WITH n AS (SELECT conv_id, floor((row_number() OVER (ORDER BY conv_id) - 1) / 16)::BIGINT AS shard FROM (SELECT DISTINCT conv_id FROM conversations)) SELECT shard, count(*) AS n, min(conv_id) AS first_key, max(conv_id) AS last_key, sha256(string_agg(conv_id::VARCHAR, chr(10) ORDER BY conv_id::VARCHAR)) AS digest FROM n GROUP BY shard")
def shard_plan(spark, d):
    return threads.shards(R.table(spark, d, "conversations"), "conv_id", 16)


@query("SELECT lang, count(*) AS n, count(DISTINCT source) AS sources, count(*) FILTER (NOT contains(text, chr(10))) AS one_line, min(n_chars) AS shortest, max(n_chars) AS longest, round(avg(n_chars), 4) AS average FROM documents GROUP BY lang")
def dataset_stats(spark, d):
    t = R.table(spark, d, "documents")
    return t.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("source").alias("sources"), F.count_if(~F.col("text").contains("\n")).alias("one_line"), F.min("n_chars").alias("shortest"), F.max("n_chars").alias("longest"), F.round(F.avg("n_chars"), 4).alias("average"))


@query("WITH x AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN '' WHEN 1 THEN '-' ELSE event_id::VARCHAR END AS raw, CASE event_id % 2 WHEN 0 THEN ' y ' ELSE 'N' END AS flag FROM events) SELECT event_id, CASE WHEN raw IN ('', '-') THEN NULL ELSE raw::BIGINT END AS parsed, upper(trim(flag)) = 'Y' AS answerable FROM x")
def nullable_parse(spark, d):
    from lodestone.sources import files

    e, m = F.col("event_id"), F.col("event_id") % 4
    raw = F.when(m == 0, "").when(m == 1, "-").otherwise(e.cast("string"))
    flag = F.when(e % 2 == 0, " y ").otherwise("N")
    return R.table(spark, d, "events").select("event_id", files.optional_long(raw).alias("parsed"), files.yes_no(flag).alias("answerable"))


@query("SELECT event_type, count(*) AS n, round(min(value), 4) AS lowest, round(max(value), 4) AS highest, round(avg(value), 4) AS average, round(quantile_cont(value, 0.1), 4) AS p10, round(quantile_cont(value, 0.25), 4) AS p25, round(quantile_cont(value, 0.5), 4) AS median, round(quantile_cont(value, 0.75), 4) AS p75, round(quantile_cont(value, 0.9), 4) AS p90, round(quantile_cont(value, 0.99), 4) AS p99 FROM events GROUP BY event_type")
def value_distribution(spark, d):
    return evaluate.distribution(R.table(spark, d, "events"), "value", ["event_type"])


@query("SELECT source, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 4) AS share FROM documents GROUP BY source")
def share_concentration(spark, d):
    return evaluate.concentration(R.table(spark, d, "documents"), "source")


@query("SELECT lang, quality, count(*) AS n, avg(n_chars)::DOUBLE AS average FROM documents JOIN labels USING (doc_id) GROUP BY GROUPING SETS ((lang, quality), (lang), ())")
def segment_metrics(spark, d):
    j = R.table(spark, d, "documents").join(R.table(spark, d, "labels"), "doc_id")
    return j.rollup("lang", "quality").agg(F.count(F.lit(1)).alias("n"), F.avg("n_chars").alias("average"))


@query("SELECT doc_id, mode(quality) AS quality, count(*) AS n FROM labels GROUP BY doc_id")
def mode_per_key(spark, d):
    from lodestone.operators.retrieve import top_k

    n = R.table(spark, d, "labels").groupBy("doc_id", "quality").agg(F.count(F.lit(1)).alias("k"))
    total = n.groupBy("doc_id").agg(F.sum("k").alias("n"))
    return top_k(n, ["doc_id"], [F.col("k").desc(), F.col("quality")], 1, "r").join(total, "doc_id").select("doc_id", "quality", "n")
