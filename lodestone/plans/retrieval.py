"""Queries of retrieval, fusion, pools and gates: `benchmark` asks, `documents` answer."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import fuse, retrieve
from lodestone.operators.retrieve import ranked
from lodestone.plans import sql as S
from lodestone.sources import tables as R
from lodestone.sources.scratch import stored

QUERIES, ORACLES = {}, {}
DEPTH = 50  # of the lists that gates and contexts read
SHADOW = 10  # of the section list that lifts documents
CHANNEL_DEPTH, PREFIX, POOL = 400, 200, 400  # of the channels, the kept prefix and the candidate pool


def query(oracle: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


class Setting:
    """The tables of one query, lazily."""

    def __init__(self, spark, d):
        self.docs, self.asked = R.documents(spark, d), R.questions(spark, d)
        self.terms = retrieve.query_terms(self.asked)
        self._packed, self._lists = {}, {}

    @property
    def sections(self):
        return R.sections(self.docs)

    @property
    def gold(self):
        if "gold" not in self._packed:
            self._packed["gold"] = stored(R.gold(self.docs, self.asked), "gold")
        return self._packed["gold"]

    def found(self, results):
        """The documents that `results` name: texts are read and cut into tokens of these alone."""
        return self.docs.join(results.select("doc_id").distinct(), "doc_id", "left_semi")

    def bm25(self, k=None, **settings):
        full = lambda: retrieve.bm25(self.docs, self.terms, **settings)
        return self._best("document", k, full, lambda: (self.docs, retrieve.document_text()), **settings)

    def title(self, k=None):
        return self._best("title", k, lambda: retrieve.bm25(self.docs, self.terms, text=F.col("title")), lambda: (self.docs, F.col("title")))

    def weighted(self, k=None):
        text = retrieve.weighted_text()
        return self._best("weighted", k, lambda: retrieve.bm25(self.docs, self.terms, text=text), lambda: (self.docs, text))

    def section(self, k=None):
        full = lambda: retrieve.max_rollup(retrieve.section_scores(self.sections, self.terms))
        return self._best("section", k, full, lambda: (self.sections, retrieve.section_text()), ("doc_id", "section_id"))

    def _best(self, name, k, full, units, keys=("doc_id",), **settings):
        """The full ranking, or its first k, which are searched and stored once a Setting."""
        if k is None:
            return ranked(full())
        at = (name, *sorted(settings.items()))
        own = self._lists.setdefault(at, {})
        if not any(have >= k for have in own):
            if name not in self._packed:
                self._packed[name] = retrieve.packed_units(*units(), self.terms, keys)
            own[k] = stored(retrieve.packed_top(self._packed[name], k, full, **settings), f"{name}-top")
        deep = min(have for have in own if have >= k)
        return own[deep] if deep == k else own[deep].filter(F.col("rank") <= k)

    def channels(self, k=CHANNEL_DEPTH):
        """Three lexical channels as one list: whole documents, best sections, titles."""
        parts = [("document", self.bm25(k)), ("section", self.section(k)), ("title", self.title(k))]
        out = None
        for name, x in parts:
            c = fuse.channel(x, name)
            out = c if out is None else out.unionByName(c)
        return out

    def lengths(self):
        n = self.docs.select("doc_id", F.size(T.tokens(retrieve.document_text())).alias("n"))
        return n.join(F.broadcast(n.agg(F.avg("n").alias("avg_len")))).select("doc_id", (F.col("n") / F.col("avg_len")).alias("ratio"))


def shown(df, *more):
    return df.select("q_id", "doc_id", "rank", F.round("score", 6).alias("score"), *more)


SHOW = "SELECT q_id, doc_id, rank, round(score, 6) AS score FROM"
SEC = ",\n".join([S.SECTIONS, S.index("s", "sections", "title || chr(10) || chr(10) || section_id || chr(10) || chr(10) || text", "doc_id, section_id"), S.scores("s", "ss", "doc_id, section_id"), "sm AS MATERIALIZED (SELECT q_id, doc_id, max(score) AS score FROM ss GROUP BY q_id, doc_id)", S.ranks("sm", "sr")])
TITLE = ",\n".join([S.index("t", "docs", "title"), S.scores("t", "ts"), S.ranks("ts", "tr")])
CHANNELS = f"ch AS MATERIALIZED (SELECT 'document' AS channel, q_id, doc_id, rank FROM br WHERE rank <= {CHANNEL_DEPTH} UNION ALL SELECT 'section', q_id, doc_id, rank FROM sr WHERE rank <= {CHANNEL_DEPTH} UNION ALL SELECT 'title', q_id, doc_id, rank FROM tr WHERE rank <= {CHANNEL_DEPTH})"
ALL = [S.BM25, SEC, TITLE, CHANNELS]


@query(S.query([S.BASE, S.index("b", "docs", S.DOC_TEXT)], "SELECT term, df, sum(tf)::BIGINT AS tf, round(ln(1 + (n - df + 0.5) / (df + 0.5)), 6) AS idf FROM (SELECT DISTINCT term, df, doc_id, tf, n FROM b_m) GROUP BY term, df, n"))
def bm25_postings(spark, d):
    s = Setting(spark, d)
    i = retrieve.Index(s.docs, retrieve.document_text(), s.terms)
    from lodestone.functions import metrics as M

    per = i.df.filter("term <> ''").join(F.broadcast(i.stats))
    return per.select("term", "df", F.col("total").alias("tf"), F.round(M.idf(F.col("n"), F.col("df")), 6).alias("idf"))


@query(S.query([S.BM25], f"{SHOW} br WHERE rank <= 10"))
def bm25_top10(spark, d):
    return shown(Setting(spark, d).bm25(10))


@query(S.query([S.BASE, S.index("b", "docs", S.DOC_TEXT), S.scores("b", "bs", b="(CASE WHEN len / avg_len <= 0.75 THEN 0.55 WHEN len / avg_len >= 1.35 THEN 0.95 ELSE 0.75 END)"), S.ranks("bs", "br", 10)], f"{SHOW} br"))
def bm25_length_band(spark, d):
    s = Setting(spark, d)
    return shown(ranked(retrieve.length_band(s.docs, s.terms), 10))


@query(S.query([S.BASE, SEC], f"{SHOW} sr WHERE rank <= 10"))
def section_max_rollup(spark, d):
    return shown(Setting(spark, d).section(10))


_SRRF = [
    S.BASE, SEC, S.ranks("ss", "sg", order="score DESC, doc_id, section_id"),
    "own AS (SELECT *, row_number() OVER (PARTITION BY q_id, doc_id ORDER BY rank) AS own FROM sg QUALIFY own <= 2)",
    "rr AS (SELECT q_id, doc_id, round(sum(1 / (60 + rank)), 9) AS score FROM own GROUP BY q_id, doc_id)", S.ranks("rr", "r2", 10),
]


@query(S.query(_SRRF, f"{SHOW} r2"))
def section_topn_rrf(spark, d):
    s = Setting(spark, d)
    units = s.sections.withColumn("doc_id", retrieve.unit_id())
    own = retrieve.packed_units(units, retrieve.section_text(), s.terms)

    def full(asked):
        terms = s.terms if asked is None else s.terms.join(asked, "q_id", "left_semi")
        return retrieve.top_section_rrf(retrieve.section_scores(s.sections, terms))

    return shown(retrieve.top_section_rrf_best(own, 10, full))


@query(S.query([S.BASE, S.index("w", "docs", "CASE WHEN trim(title) = '' THEN '' ELSE title || chr(10) || title END || chr(10) || text"), S.ordered_scores("w", "ws"), S.ranks("ws", "wr", 10)], f"SELECT q_id, doc_id, rank, {S.half_up('score')} AS score FROM wr"))
def field_weighted_bm25(spark, d):
    return shown(Setting(spark, d).weighted(10))


_FIELDED = [
    S.BASE, TITLE, S.index("x", "docs", "text"), S.scores("x", "xs"),
    "tn AS (SELECT q_id, doc_id, score / max(score) OVER (PARTITION BY q_id) AS t FROM ts)", "xn AS (SELECT q_id, doc_id, score / max(score) OVER (PARTITION BY q_id) AS x FROM xs)",
    "fs AS (SELECT q_id, doc_id, round(0.25::DOUBLE * coalesce(t, 0) + 0.75::DOUBLE * coalesce(x, 0), 9) AS score FROM tn FULL JOIN xn USING (q_id, doc_id))", S.ranks("fs", "fr", 10),
]


@query(S.query(_FIELDED, f"{SHOW} fr"))
def fielded_fusion(spark, d):
    s = Setting(spark, d)
    return shown(ranked(retrieve.fielded(s.docs, s.terms), 10))


_ORDERED = f"list_filter({S.toks('text')}, lambda t, i: list_position({S.toks('text')}, t) = i)"
_VIEWS = [
    S.DOCS, S.QUES,
    f"views AS (SELECT q_id || '/dedup' AS q_id, term, 1 AS qtf FROM (SELECT q_id, unnest({_ORDERED}) AS term FROM ques) UNION ALL SELECT q_id || '/content', term, 1 FROM (SELECT q_id, unnest({S.content('text')}) AS term FROM ques) UNION ALL SELECT q_id || '/title', term, 1 FROM (SELECT q_id, unnest(list_distinct({S.toks('title')})) AS term FROM ques))",
    S.index("v", "docs", S.DOC_TEXT, terms="views"), S.scores("v", "vs"), S.ranks("vs", "vr", 5),
]


@query(S.query(_VIEWS, f"{SHOW} vr"))
def query_view_dedup(spark, d):
    """Distinct terms, content terms, and the first tokens only (the title) as views of a question."""
    s = Setting(spark, d)
    views = [("dedup", F.array_distinct(T.tokens(F.col("text")))), ("content", T.content_terms(F.col("text"))), ("title", F.array_distinct(T.tokens(F.col("title"))))]
    terms = None
    for name, t in views:
        x = s.asked.select(F.concat("q_id", F.lit(f"/{name}")).alias("q_id"), F.explode(t).alias("term"), F.lit(1).alias("qtf"))
        terms = x if terms is None else terms.unionByName(x)
    return shown(ranked(retrieve.bm25(s.docs, terms), 5))


_BOOST = [
    S.BM25,
    f"have AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(title || chr(10) || text), {S.lit(T.SPECIAL)})) AS token FROM docs)", f"wanted AS (SELECT DISTINCT q_id, unnest(regexp_extract_all(lower(text), {S.lit(T.SPECIAL)})) AS token FROM ques)",
    "extra AS (SELECT q_id, doc_id, count(*) * 2.0::DOUBLE AS extra FROM have JOIN wanted USING (token) GROUP BY q_id, doc_id)", "xs AS (SELECT q_id, doc_id, round(coalesce(score, 0) + coalesce(extra, 0), 9) AS score FROM bs FULL JOIN extra USING (q_id, doc_id))", S.ranks("xs", "xr", 10),
]


@query(S.query(_BOOST, f"{SHOW} xr"))
def special_token_boost(spark, d):
    s = Setting(spark, d)
    return shown(ranked(retrieve.special_boost(retrieve.bm25(s.docs, s.terms), s.docs, s.asked), 10))


_COS = """WITH u AS (SELECT vec_id::VARCHAR AS id, vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
n AS (SELECT id, vec_id, label, CASE WHEN list_inner_product(v, v) > 0 THEN list_transform(v, lambda x: x / sqrt(list_inner_product(v, v))) ELSE v END AS v FROM u),
c AS (SELECT q.id AS q_id, d.id AS doc_id, round(list_inner_product(q.v, d.v), 9) AS score, q.label = d.label AS relevant FROM n q JOIN n d ON q.vec_id % 25 = 0 AND q.id <> d.id)
"""


@query(_COS + "SELECT q_id, doc_id, row_number() OVER (PARTITION BY q_id ORDER BY score DESC, doc_id) AS rank, round(score, 6) AS score FROM c QUALIFY rank <= 10")
def dense_cosine_topk(spark, d):
    e = R.table(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("doc_id"), "vec_id", "embedding")
    q = e.filter("vec_id % 25 = 0").select(F.col("doc_id").alias("q_id"), "embedding")
    return shown(retrieve.cosine_top(e, q, 10))


@query(S.query([S.BM25, SEC, "l AS (SELECT q_id, doc_id, rank FROM br WHERE rank <= 400 UNION ALL SELECT q_id, doc_id, rank FROM sr WHERE rank <= 400)", "f AS (SELECT q_id, doc_id, round(sum(1 / (60 + rank)), 9) AS score FROM l GROUP BY q_id, doc_id)", S.ranks("f", "fr", 10)], f"{SHOW} fr"))
def rrf_two(spark, d):
    s = Setting(spark, d)
    lists = fuse.channel(s.bm25(CHANNEL_DEPTH), "document").unionByName(fuse.channel(s.section(CHANNEL_DEPTH), "section"))
    return shown(ranked(fuse.rrf(lists), 10))


_WEIGHTED = "ws AS (SELECT q_id, doc_id, round(sum((CASE channel WHEN 'document' THEN 1.2 WHEN 'section' THEN 1.0 ELSE 0.8 END)::DOUBLE / (60 + rank)), 9) AS score FROM ch GROUP BY q_id, doc_id)"
WEIGHTS = {"document": 1.2, "section": 1.0, "title": 0.8}


@query(S.query([*ALL, _WEIGHTED, S.ranks("ws", "wr", 10)], f"{SHOW} wr"))
def rrf_weighted(spark, d):
    return shown(ranked(fuse.rrf(Setting(spark, d).channels(), WEIGHTS), 10))


@query(S.query([*ALL, "f AS (SELECT q_id, doc_id, min((rank, CASE channel WHEN 'document' THEN 1 WHEN 'section' THEN 2 ELSE 3 END)) AS place FROM ch GROUP BY q_id, doc_id)"], "SELECT q_id, doc_id, row_number() OVER (PARTITION BY q_id ORDER BY place) AS rank FROM f"))
def route_interleave(spark, d):
    return fuse.interleave(Setting(spark, d).channels(), ["document", "section", "title"])


_POOL = [f"pre AS (SELECT q_id, doc_id, rank FROM br WHERE rank <= {PREFIX})", "more AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY score DESC, doc_id) AS rank FROM ws)", "pool AS (SELECT q_id, doc_id, 0 AS part, rank AS was FROM pre UNION ALL SELECT q_id, doc_id, 1, rank FROM more WHERE (q_id, doc_id) NOT IN (SELECT (q_id, doc_id) FROM pre))"]


@query(S.query([*ALL, _WEIGHTED, *_POOL], f"SELECT q_id, doc_id, part, row_number() OVER (PARTITION BY q_id ORDER BY part, was) AS rank FROM pool QUALIFY rank <= {POOL}"))
def prefix_pool(spark, d):
    s = Setting(spark, d)
    more = ranked(fuse.rrf(s.channels(), WEIGHTS), POOL + PREFIX)
    return fuse.prefix_pool(s.bm25(PREFIX), more, PREFIX, POOL)


@query(S.query([*ALL, S.GOLD, _WEIGHTED, S.ranks("ws", "wr"), "sized AS (SELECT q_id, count(*) AS n FROM ws GROUP BY q_id)", "g AS (SELECT gold.q_id, rank FROM gold LEFT JOIN wr ON wr.q_id = gold.q_id AND wr.doc_id = gold)"], "SELECT count(*) AS questions, round(avg((coalesce(rank, 1000000) <= 10)::INT), 4) AS hit10, round(avg((coalesce(rank, 1000000) <= 50)::INT), 4) AS hit50, round(avg((coalesce(rank, 1000000) <= 100)::INT), 4) AS hit100, round(avg((coalesce(rank, 1000000) <= 200)::INT), 4) AS hit200, round(avg((coalesce(rank, 1000000) <= 400)::INT), 4) AS hit400, (SELECT round(avg(n), 4) FROM sized) AS pool_avg, (SELECT max(n) FROM sized) AS pool_max, (SELECT median(n) FROM sized) AS pool_median FROM g"))
def union_pool_metrics(spark, d):
    s = Setting(spark, d)
    pool = ranked(fuse.rrf(s.channels(), WEIGHTS))
    sized = pool.groupBy("q_id").agg(F.count(F.lit(1)).alias("n")).agg(F.round(F.avg("n"), 4).alias("pool_avg"), F.max("n").alias("pool_max"), F.percentile("n", F.lit(0.5)).alias("pool_median"))
    g = s.gold
    found = g.join(pool, (pool["q_id"] == g["q_id"]) & (pool["doc_id"] == g["gold"]), "left").select("rank")
    hit = lambda k: F.round(F.avg(F.when(F.col("rank") <= k, 1).otherwise(0)), 4).alias(f"hit{k}")
    return found.agg(F.count(F.lit(1)).alias("questions"), *[hit(k) for k in (10, 50, 100, 200, 400)]).join(F.broadcast(sized))


@query(S.query([*ALL, S.GOLD, "f AS (SELECT gold.q_id, min(CASE channel WHEN 'document' THEN 1 WHEN 'section' THEN 2 ELSE 3 END) AS p FROM gold JOIN ch ON ch.q_id = gold.q_id AND ch.doc_id = gold WHERE rank <= 10 GROUP BY gold.q_id)"], "SELECT (['document', 'section', 'title'])[p] AS channel, count(*) AS hits FROM f GROUP BY p"))
def marginal_channel_hits(spark, d):
    s = Setting(spark, d)
    return fuse.marginal_hits(s.channels(), s.gold, ["document", "section", "title"], 10)


_RATIO = "lens AS (SELECT doc_id, len(t) / avg(len(t)) OVER () AS ratio FROM b_tok)"
_GATE = [
    S.BM25, _RATIO, S.scores("b", "cs", b="0.95"), S.ranks("cs", "cr"), "tenth AS (SELECT q_id, score AS tenth FROM br WHERE rank = 10)",
    "near AS (SELECT br.*, cr.rank AS c_rank, cr.score AS c_score, ratio, round(tenth - br.score, 9) AS margin FROM br JOIN tenth USING (q_id) JOIN cr USING (q_id, doc_id) JOIN lens USING (doc_id) WHERE br.rank BETWEEN 11 AND 20 AND c_rank <= 10 AND margin <= 1.5 AND (ratio <= 0.85 OR ratio >= 1.2))",
    "up AS (SELECT q_id, doc_id FROM near QUALIFY row_number() OVER (PARTITION BY q_id ORDER BY c_rank, CASE WHEN margin = 0 THEN 'inf'::DOUBLE ELSE margin END, c_score DESC, score DESC, doc_id) = 1)",
    "placed AS (SELECT q_id, doc_id, rank AS base_rank, (q_id, doc_id) IN (SELECT (q_id, doc_id) FROM up) AS lifted FROM br WHERE rank <= 50)",
]


@query(S.query(_GATE, "SELECT q_id, doc_id, base_rank, lifted, row_number() OVER (PARTITION BY q_id ORDER BY CASE WHEN lifted THEN 9.5 ELSE base_rank END) AS rank FROM placed"))
def score_margin_gate(spark, d):
    s = Setting(spark, d)
    return fuse.gate_rank10(s.bm25(DEPTH), s.bm25(b=0.95), s.lengths())


@query(S.query([S.BM25, SEC, "u AS (SELECT q_id, doc_id, CASE WHEN b.rank <= 10 THEN 0 WHEN s.rank <= 10 THEN 1 WHEN b.rank IS NOT NULL THEN 2 END AS part, b.rank AS b_rank, s.rank AS s_rank FROM (SELECT * FROM br WHERE rank <= 50) b FULL JOIN sr s USING (q_id, doc_id))"], "SELECT q_id, doc_id, part, row_number() OVER (PARTITION BY q_id ORDER BY part, CASE WHEN part = 1 THEN s_rank ELSE b_rank END, doc_id) AS rank FROM u WHERE part IS NOT NULL QUALIFY rank <= 50"))
def section_signal_gate(spark, d):
    s = Setting(spark, d)
    return fuse.section_shadow(s.bm25(DEPTH), s.section(SHADOW), SHADOW)


@query(
    S.query(
        [S.BM25, TITLE, "inside AS (SELECT q_id, doc_id FROM br WHERE rank <= 10)", "cand AS (SELECT tr.q_id, tr.doc_id, tr.rank, round(1 / (60 + tr.rank) + coalesce(1 / (60 + br.rank), 0), 9) AS s FROM tr LEFT JOIN br ON br.q_id = tr.q_id AND br.doc_id = tr.doc_id AND br.rank <= 50 WHERE tr.rank <= 5 AND (tr.q_id, tr.doc_id) NOT IN (SELECT (q_id, doc_id) FROM inside))",
         "up AS (SELECT q_id, doc_id, 1 AS part, row_number() OVER (PARTITION BY q_id ORDER BY s DESC, rank, doc_id) AS pos FROM cand)", "every AS (SELECT * FROM up UNION ALL SELECT q_id, doc_id, CASE WHEN rank <= 3 THEN 0 ELSE 2 END, rank FROM br WHERE rank <= 50)", "f AS (SELECT q_id, doc_id, min((part, pos)) AS place FROM every GROUP BY q_id, doc_id)"],
        "SELECT q_id, doc_id, place[1] AS part, row_number() OVER (PARTITION BY q_id ORDER BY place) AS rank FROM f QUALIFY rank <= 10",
    )
)
def selective_dense_promote(spark, d):
    s = Setting(spark, d)
    return fuse.dense_promotions(s.bm25(DEPTH), s.title(DEPTH))


_CLUSTER = "CASE WHEN len(list_intersect({a}, {b})) < 1 THEN 'EMPTY' ELSE sha256(array_to_string(list_sort(list_distinct(list_intersect({a}, {b}))), chr(10)))[1:16] END".format(a=S.toks("d.title"), b=S.toks("q.title"))


@query(S.query([S.BM25, f"c AS (SELECT br.*, {_CLUSTER} AS cluster FROM br JOIN docs d USING (doc_id) JOIN ques q USING (q_id) WHERE rank <= 30)", "x AS (SELECT q_id, doc_id, rank AS base_rank, count(*) OVER (PARTITION BY q_id, cluster) AS cluster_size, row_number() OVER (PARTITION BY q_id, cluster ORDER BY rank) - 1 AS dup_index, score, max(score) OVER (PARTITION BY q_id) AS best FROM c)", "y AS (SELECT q_id, doc_id, base_rank, cluster_size, dup_index, round(score - 0.05::DOUBLE * best * dup_index, 9) AS score FROM x)"], "SELECT q_id, doc_id, base_rank, cluster_size, dup_index, round(score, 6) AS score, row_number() OVER (PARTITION BY q_id ORDER BY score DESC, dup_index, base_rank, doc_id) AS rank FROM y"))
def cluster_diversity(spark, d):
    s = Setting(spark, d)
    first = s.bm25(30)
    titles = s.found(first).select("doc_id", F.array_distinct(T.tokens(F.col("title"))).alias("dt"))
    asked = s.asked.select("q_id", F.array_distinct(T.tokens(F.col("title"))).alias("qt"))
    shared = F.array_sort(F.array_intersect("dt", "qt"))
    cluster = F.when(F.size(shared) < 1, "EMPTY").otherwise(F.substring(F.sha2(F.array_join(shared, "\n").cast("binary"), 256), 1, 16))
    rows = first.join(titles, "doc_id").join(asked, "q_id").withColumn("cluster", cluster)
    return fuse.diversity(rows).withColumn("score", F.round("score", 6))


@query(S.query([S.BM25], "SELECT q_id, doc_id, rank, round(first_value(score) OVER w - score, 6) AS to_first, round(lag(score) OVER w - score, 6) AS to_previous FROM br WHERE rank <= 20 WINDOW w AS (PARTITION BY q_id ORDER BY rank)"))
def score_margins(spark, d):
    return fuse.previous_margin(Setting(spark, d).bm25(20))


def fit_sql(k: int = DEPTH) -> str:
    return f"fit AS MATERIALIZED (SELECT br.q_id, br.doc_id, br.rank, br.score, len(list_intersect(list_distinct({S.toks('q.text')}), {S.toks('d.text')})) AS shared, len(list_distinct({S.toks('q.text')})) AS n_q FROM br JOIN docs d USING (doc_id) JOIN ques q USING (q_id) WHERE rank <= {k}), fits AS MATERIALIZED (SELECT *, round(shared + shared / n_q::DOUBLE + 0.35::DOUBLE / log2(rank + 1), 8) AS fit FROM fit)"


FIT = fit_sql()


def with_fit(s, k=DEPTH):
    """BM25 candidates with their query-overlap score and a rank prior."""
    first = s.bm25(k)
    d = s.found(first).select("doc_id", F.array_distinct(T.tokens(F.col("text"))).alias("dt"))
    q = s.asked.select("q_id", F.array_distinct(T.tokens(F.col("text"))).alias("qt"))
    n = F.size(F.array_intersect("qt", "dt"))
    fit = F.round(n + n / F.size("qt") + F.lit(0.35) / F.log2(F.col("rank") + 1), 8)
    return first.join(d, "doc_id").join(q, "q_id").select("q_id", "doc_id", "rank", "score", fit.alias("fit"))


_SHORT = [
    S.BM25, FIT, "own AS (SELECT *, (rank > 25)::INT AS tail, row_number() OVER (PARTITION BY q_id, rank > 25 ORDER BY fit DESC, rank, doc_id) AS own FROM fits)", "kept AS (SELECT *, (tail = 1 OR own > 6)::INT AS free FROM own WHERE tail = 0 AND own <= 10 OR tail = 1 AND own <= 2)",
    "chosen AS (SELECT *, row_number() OVER (PARTITION BY q_id, free ORDER BY fit DESC, rank, doc_id) AS n FROM kept QUALIFY free = 0 OR n <= 4)",
]


@query(S.query(_SHORT, "SELECT q_id, doc_id, rank AS was, row_number() OVER (PARTITION BY q_id ORDER BY fit DESC, was, doc_id) AS rank FROM chosen QUALIFY row_number() OVER (PARTITION BY q_id ORDER BY fit DESC, was, doc_id) <= 10"))
def shortlist_protected(spark, d):
    return fuse.shortlist(with_fit(Setting(spark, d)), 25, DEPTH, 10, 6, 2)


@query(S.query([S.BM25, FIT], "SELECT q_id, doc_id, rank AS was, round(fit, 6) AS fit, row_number() OVER (PARTITION BY q_id ORDER BY fit DESC, was, doc_id) AS rank FROM fits QUALIFY row_number() OVER (PARTITION BY q_id ORDER BY fit DESC, was, doc_id) <= 10"))
def overlap_context_top10(spark, d):
    c = with_fit(Setting(spark, d)).withColumnRenamed("rank", "was")
    return retrieve.top_k(c, ["q_id"], [F.col("fit").desc(), F.col("was"), F.col("doc_id")], 10).select("q_id", "doc_id", "was", F.round("fit", 6).alias("fit"), "rank")


@query(S.query([S.BM25, FIT, "p AS (SELECT q_id, doc_id, (rank > 5)::INT AS part, row_number() OVER (PARTITION BY q_id, rank > 5 ORDER BY CASE WHEN rank <= 5 THEN rank::DOUBLE ELSE -fit END, rank) AS pos FROM fits)"], "SELECT q_id, doc_id, part, row_number() OVER (PARTITION BY q_id ORDER BY part, pos) AS rank FROM p QUALIFY rank <= 10"))
def protected_prefix_context(spark, d):
    c = with_fit(Setting(spark, d)).withColumn("part", (F.col("rank") > 5).cast("int"))
    at = retrieve.top_k(c.withColumnRenamed("rank", "was"), ["q_id", "part"], [F.when(F.col("part") == 0, F.col("was").cast("double")).otherwise(-F.col("fit")), F.col("was")], 10, "pos")
    return retrieve.top_k(at, ["q_id"], [F.col("part"), F.col("pos")], 10).select("q_id", "doc_id", "part", "rank")


_SWAP = [
    S.BM25, FIT, "a AS (SELECT q_id, row_number() OVER (PARTITION BY q_id ORDER BY fit, rank DESC, doc_id) AS i, doc_id AS out_doc, fit AS o FROM fits WHERE rank <= 10 QUALIFY i <= 3)",
    "c AS (SELECT q_id, row_number() OVER (PARTITION BY q_id ORDER BY fit DESC, rank, doc_id) AS i, doc_id AS in_doc, fit AS n FROM fits WHERE rank > 10 QUALIFY i <= 3)",
]


@query(S.query(_SWAP, "SELECT q_id, i, out_doc, in_doc, round(n - o, 6) AS gain, round(n - o, 6) > 0 AS accepted FROM a JOIN c USING (q_id, i)"))
def conservative_swap(spark, d):
    return fuse.swaps(with_fit(Setting(spark, d)).withColumnRenamed("fit", "model"))


@query(S.query(_SWAP, "SELECT count(*) AS n, round(coalesce(quantile_cont(g, 0.25), 0), 6) AS q25, round(coalesce(quantile_cont(g, 0.5), 0), 6) AS q50, round(coalesce(quantile_cont(g, 0.75), 0), 6) AS q75 FROM (SELECT round(n - o, 6) AS g FROM a JOIN c USING (q_id, i)) WHERE g > 0"))
def margin_threshold_grid(spark, d):
    s = fuse.swaps(with_fit(Setting(spark, d)).withColumnRenamed("fit", "model")).filter("gain > 0")
    return s.agg(F.count(F.lit(1)).alias("n"), *[F.round(F.coalesce(F.percentile("gain", F.lit(p)), F.lit(0.0)), 6).alias(f"q{int(p * 100)}") for p in (0.25, 0.5, 0.75)])


@query(S.query([S.BM25, S.DOCS.replace("docs AS", "docs2 AS"), "q1 AS (SELECT q_id, list_distinct(" + S.toks("text") + ") AS qt FROM ques)", "o AS (SELECT q_id, rank, len(list_intersect(qt, " + S.toks("d.text") + ")) / len(qt)::DOUBLE AS r FROM br JOIN docs2 d USING (doc_id) JOIN q1 USING (q_id) WHERE rank <= 10)", "f AS (SELECT q_id, max(r) FILTER (rank = 1) AS top1, avg(r) AS mean10 FROM o GROUP BY q_id)"], "SELECT q_id, round(top1, 6) AS top1, round(mean10, 6) AS mean10, CASE WHEN len(qt) > 30 THEN 'query_too_long' WHEN top1 > 0.9 THEN 'overlap_high' ELSE 'activated' END AS gate FROM f JOIN q1 USING (q_id)"))
def selective_dense_gate(spark, d):
    from lodestone.functions import metrics as M

    s = Setting(spark, d)
    q = s.asked.select("q_id", F.array_distinct(T.tokens(F.col("text"))).alias("qt"))
    first = s.bm25(10)
    docs = s.found(first).select("doc_id", F.array_distinct(T.tokens(F.col("text"))).alias("dt"))
    r = first.join(docs, "doc_id").join(q, "q_id").withColumn("r", M.overlap_ratio(F.col("qt"), F.col("dt")))
    f = r.groupBy("q_id").agg(F.max(F.when(F.col("rank") == 1, F.col("r"))).alias("top1"), F.avg("r").alias("mean10"), F.first(F.size("qt")).alias("n"))
    gate = F.when(F.col("n") > 30, "query_too_long").when(F.col("top1") > 0.9, "overlap_high").otherwise("activated")
    return f.select("q_id", F.round("top1", 6).alias("top1"), F.round("mean10", 6).alias("mean10"), gate.alias("gate"))
