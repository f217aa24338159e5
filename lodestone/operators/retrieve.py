"""Inverted-index and dense retrieval as joins.

Scores are rounded to nine digits before they are ranked, so the order of a
floating-point sum cannot decide a tie; ties go to the smaller string id.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.functions import metrics as M
from lodestone.functions import text as T
from lodestone.operators.packed import Packed
from lodestone.sources.scratch import stored

K1, B = 1.5, 0.75


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int | None = None, name: str = "rank") -> DataFrame:
    """Dense 1-based ranks within the keys, cut at k by a window group limit."""
    out = df.withColumn(name, F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
    return out if k is None else out.filter(F.col(name) <= k)


def ranked(scores: DataFrame, k: int | None = None, keys: list[str] | None = None, item: str = "doc_id") -> DataFrame:
    return top_k(scores, keys or ["q_id"], [F.col("score").desc(), F.col(item)], k)


def query_terms(asked: DataFrame, text: str = "text") -> DataFrame:
    """(q_id, term, qtf): a repeated query term adds its score again."""
    return asked.select("q_id", F.explode(T.tokens(F.col(text))).alias("term")).groupBy("q_id", "term").agg(F.count(F.lit(1)).alias("qtf"))


def _small(df: DataFrame, rows: int) -> bool:
    return df.limit(rows + 1).count() <= rows


class Index:
    """Lazy postings of (unit, text) rows, limited to the terms that are asked for.

    Every unit also posts the empty term, so that document frequencies, the
    number of units and their mean length all come from postings.  A unit counts
    its own terms before anything is shuffled, and the postings are dealt by the
    first key, the document, alone: document frequencies, mean length and matches
    read the same shuffle.  Query terms with their frequencies are copied to the
    tasks while there are at most COPIED of them, so that the rows of (query,
    unit, shared term), of which there are many times more than postings, are
    made and added up inside a document's task.  Beyond that they are joined.
    """

    COPIED = 1_000_000  # rows of query terms, some tens of bytes each

    def __init__(self, units: DataFrame, text: Column, terms: DataFrame, keys: tuple[str, ...] = ("doc_id",)):
        self.keys, self.terms = list(keys), terms
        self.copied = copied = F.broadcast if _small(terms, self.COPIED) else lambda df: df
        tok = units.select(*self.keys, T.tokens(text).alias("toks")).select(*self.keys, F.size("toks").alias("len"), F.sort_array(F.concat("toks", F.array(F.lit("")))).alias("toks"))
        wanted = terms.select("term").union(terms.sparkSession.range(1).select(F.lit("").alias("term"))).distinct()
        runs = tok.withColumn("starts", T.run_starts(F.col("toks"))).select(*self.keys, "len", F.inline(T.runs(F.col("toks"), F.col("starts"))))
        each = runs.join(copied(wanted), "term", "left_semi")
        self.postings = each.repartition(self.keys[0]).groupBy(*self.keys, "len", "term").agg(F.sum("tf").alias("tf"))
        # Counts are of tf, which is never null, so that all three uses read the same columns and so the same shuffle.
        empty = F.col("term") == ""
        whole = F.sum(F.when(empty, F.col("len")))
        self.stats = self.postings.agg(F.count(F.when(empty, F.col("tf"))).alias("n"), (whole / F.sum(F.when(empty, F.col("tf")))).alias("avg_len"))
        self.df = self.postings.groupBy("term").agg(F.count("tf").alias("df"), F.sum("tf").alias("total"))
        sized = self.df.join(terms, "term").join(F.broadcast(self.stats))  # one row
        self.asked = copied(sized.select("term", "q_id", "qtf", M.idf(F.col("n"), F.col("df")).alias("idf")))

    def matches(self, *parts: Column) -> DataFrame:
        """One row a (query, unit, shared term): qtf, idf and `parts`, columns that are made once a posting of tf, len and avg_len."""
        own = self.postings.join(F.broadcast(self.stats.select("avg_len"))).select(*self.keys, "term", *parts)  # one row
        return own.join(self.asked, "term")

    def scores(self, k1: float = K1, b=B) -> DataFrame:
        """(q_id, unit keys, score)."""
        m = self.matches(saturation(k1, b).alias("part"))
        return m.groupBy("q_id", *self.keys).agg(F.round(F.sum(F.col("qtf") * F.col("idf") * F.col("part")), 9).alias("score"))


def saturation(k1: float, b) -> Column:
    """What a posting brings a query, but for idf and qtf."""
    return M.bm25_term(F.lit(1.0), F.col("tf"), M.bm25_norm(F.col("len"), F.col("avg_len"), k1, b), k1)


def packed_units(units: DataFrame, text: Column, terms: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> Packed | None:
    """Units stored for `packed_top`; None where there are too many query terms to copy, or a key isn't unique."""
    own = Packed(units, text, terms, keys) if _small(terms, Index.COPIED) else None
    return own if own and own.usable else None


def packed_top(own: Packed | None, k: int, full: Callable[[], DataFrame], k1: float = K1, b: float = B) -> DataFrame:
    """(q_id, doc_id, score, rank): the first k a query, by the best unit of each document; of all scores, `full`, where `own` is None."""
    return ranked(own.top(k, k1, b) if own else full(), k)


def document_text() -> Column:
    return F.concat_ws("\n\n", "title", "text")


def bm25(docs: DataFrame, terms: DataFrame, k1: float = K1, b: float = B, text: Column | None = None) -> DataFrame:
    return Index(docs, document_text() if text is None else text, terms).scores(k1, b)


def grid_ranks(docs: DataFrame, terms: DataFrame, gold: DataFrame, configs: list[tuple[str, float, float]]) -> DataFrame:
    """(config_id, q_id, rank or null) of each question's gold document for many (k1, b).

    One pass: every configuration is a column of one aggregate, and a rank is
    one plus the number of documents that come before, so nothing is sorted.
    """
    index = Index(docs, document_text(), terms)
    m = index.matches(*[saturation(k1, b).alias(f"part{i}") for i, (_, k1, b) in enumerate(configs)])
    score = lambda i: F.round(F.sum(F.col("qtf") * F.col("idf") * F.col(f"part{i}")), 9)
    wide = m.groupBy("q_id", "doc_id").agg(F.array(*[score(i) for i in range(len(configs))]).alias("s"))
    return ranks_of(wide, gold, [name for name, _, _ in configs], index.copied)


def ranks_of(wide: DataFrame, gold: DataFrame, names: list[str], copied=lambda df: df) -> DataFrame:
    """wide: (q_id, doc_id, s array of scores by name) -> (config_id, q_id, rank or null).

    Gold rows, one a question, are passed through `copied`: where it broadcasts them, no score is shuffled.
    """
    own = wide.join(copied(gold.select("q_id", F.col("gold").alias("doc_id"))), ["q_id", "doc_id"]).select("q_id", F.col("doc_id").alias("gold"), F.col("s").alias("g"))
    before = lambda i: F.count_if((F.col("s")[i] > F.col("g")[i]) | ((F.col("s")[i] == F.col("g")[i]) & (F.col("doc_id") < F.col("gold"))))
    counts = wide.join(copied(own), "q_id").groupBy("q_id").agg(*[(before(i) + 1).alias(f"r{i}") for i in range(len(names))])
    every = gold.select("q_id").join(counts, "q_id", "left")
    return every.select("q_id", F.inline(F.array(*[F.struct(F.lit(n).alias("config_id"), F.col(f"r{i}").alias("rank")) for i, n in enumerate(names)])))


def length_band(docs: DataFrame, terms: DataFrame, short_b: float = 0.55, long_b: float = 0.95, base_b: float = B, short: float = 0.75, long: float = 1.35, k1: float = K1) -> DataFrame:
    """BM25 whose b depends on the document's length ratio."""
    r = F.col("len") / F.col("avg_len")
    b = F.when(r <= short, F.lit(short_b)).when(r >= long, F.lit(long_b)).otherwise(F.lit(base_b))
    return Index(docs, document_text(), terms).scores(k1, b)


def section_text() -> Column:
    return F.concat_ws("\n\n", "title", "section_id", "text")


def section_scores(sections: DataFrame, terms: DataFrame, k1: float = K1, b: float = B) -> DataFrame:
    return Index(sections, section_text(), terms, ("doc_id", "section_id")).scores(k1, b)


def max_rollup(scores: DataFrame) -> DataFrame:
    return scores.groupBy("q_id", "doc_id").agg(F.max("score").alias("score"))


def top_section_rrf(scores: DataFrame, n: int = 2, k: int = 60) -> DataFrame:
    """The n best sections of a document add 1 / (k + their global rank)."""
    every = top_k(scores, ["q_id"], [F.col("score").desc(), F.col("doc_id"), F.col("section_id")], None, "g")
    own = top_k(every, ["q_id", "doc_id"], [F.col("g")], n, "own")
    return own.groupBy("q_id", "doc_id").agg(F.round(F.sum(1 / (k + F.col("g"))), 9).alias("score"))


def unit_id() -> Column:
    """Document and section in one id, whose order is that of the two where no document's id has a NUL."""
    return F.concat("doc_id", F.lit("\0"), "section_id")


SLICE, DEEP = 4096, (400, 3200)  # questions that are searched at once; first sections of a question that are looked at, and then


def top_section_rrf_best(own: Packed | None, k: int, full: Callable[[DataFrame | None], DataFrame], n: int = 2, rrf: int = 60, deep: tuple[int, ...] = DEEP) -> DataFrame:
    """(q_id, doc_id, score, rank): the first k a question by `top_section_rrf` with n = 2, without ranking all sections.

    The first `deep` sections of a question are ranked.  What a document has there, and
    what it could have behind, says which documents may be among the first k;
    of those with one section there, the second is looked up and its place in all
    sections counted.  Questions for which the first sections don't decide are
    searched deeper, and in the end by `full`, which gets them as (q_id).
    """
    if own is None or n != 2 or not own.rows.filter(F.col("doc_id").rlike("\\x00[^\\x00]*\\x00")).isEmpty():
        return ranked(full(None), k)
    spark, out = own.rows.sparkSession, []
    left = sorted({q for q, _, _ in own.asked})
    for most in deep:
        open_ = []
        for at in range(0, len(left), SLICE):
            some, undecided = _decided(own, k, left[at : at + SLICE], rrf, most)
            out.append(some)
            open_ += undecided
        left = open_
    if left:
        out.append(full(spark.createDataFrame([(q,) for q in left], "q_id string")))
    every = out[0] if out else spark.createDataFrame([], "q_id string, doc_id string, score double")
    for x in out[1:]:
        every = every.unionByName(x)
    return ranked(every, k)


def _decided(own: Packed, k: int, names: list[str], rrf: int, most: int) -> tuple[DataFrame, list[str]]:
    """Scores of the documents that may be among the first k, for the questions in `names` whose first sections decide, and the other questions."""
    first = stored(ranked(own.top(most, K1, B, names), most), "sections-top")
    spark, doc = first.sparkSession, F.substring_index("doc_id", "\0", 1)
    one = first.select("q_id", doc.alias("parent"), "doc_id", "rank")
    in_two = top_k(one, ["q_id", "parent"], [F.col("rank")], 2, "own")
    share = lambda r: 1 / (rrf + r)
    had = in_two.groupBy("q_id", "parent").agg(F.sum(share(F.col("rank"))).alias("have"), F.count(F.lit(1)).alias("n"), F.min_by("doc_id", "rank").alias("best"), F.min("rank").alias("at"))
    ends = first.groupBy("q_id").agg((F.count(F.lit(1)) < most).alias("whole"))
    kth = top_k(had, ["q_id"], [F.col("have").desc(), F.col("parent")], k, "place").filter(F.col("place") == k).select("q_id", F.col("have").alias("kth"))
    edge, behind = 2e-9, share(F.lit(most + 1))  # scores are compared at nine digits
    bounds = ends.join(kth, "q_id", "left")
    undecided = [r["q_id"] for r in bounds.filter(~F.col("whole") & ~F.coalesce(F.col("kth") > behind + share(F.lit(most + 2)) + edge, F.lit(False))).select("q_id").collect()]
    may = had.join(bounds, "q_id").filter(~F.col("q_id").isin(undecided)) if undecided else had.join(bounds, "q_id")
    reach = F.col("have") + F.when((F.col("n") < 2) & ~F.col("whole"), behind).otherwise(F.lit(0.0))
    may = stored(may.filter(F.col("kth").isNull() | (reach >= F.col("kth") - edge)).withColumn("lacks", (F.col("n") < 2) & ~F.col("whole")), "sections-may")
    lacking = [(r["q_id"], r["parent"], r["best"]) for r in may.filter("lacks").select("q_id", "parent", "best").collect()]
    second = []
    if lacking:
        wanted: dict[str, list[str]] = {}
        for q, parent, _ in lacking:
            wanted.setdefault(parent, []).append(q)
        known = may.filter("lacks").select("q_id", F.col("best").alias("doc_id"))
        others = own.of_parents(wanted, names, K1, B).join(known, ["q_id", "doc_id"], "left_anti")
        second = [tuple(r) for r in ranked(others.withColumn("parent", doc), 1, ["q_id", "parent"]).select("q_id", "doc_id", "score").collect()]
    places = own.places(second, names, K1, B) if second else []
    more = spark.createDataFrame([(q, u.split("\0", 1)[0], p) for (q, u, _), p in zip(second, places)], "q_id string, parent string, second bigint")
    score = F.when(F.col("second").isNotNull(), share(F.col("at")) + share(F.col("second"))).otherwise(F.col("have"))
    return may.join(more, ["q_id", "parent"], "left").select("q_id", F.col("parent").alias("doc_id"), F.round(score, 9).alias("score")), undecided


def weighted_text(title_weight: int = 2, body_weight: int = 1) -> Column:
    return F.concat_ws("\n", T.repeated(F.col("title"), title_weight), T.repeated(F.col("text"), body_weight))


def fielded(docs: DataFrame, terms: DataFrame, title_weight: float = 0.25, k1: float = K1, b: float = B) -> DataFrame:
    """Title and body scores, each over its query's best, weighted and added."""

    def share(text: str, name: str) -> DataFrame:
        index = Index(docs, F.col(text), terms)
        s = index.scores(k1, b)
        best = s.groupBy("q_id").agg(F.max("score").alias("best"))  # one row a question
        return s.join(index.copied(best), "q_id").select("q_id", "doc_id", (F.col("score") / F.col("best")).alias(name))

    both = share("title", "t").join(share("text", "x"), ["q_id", "doc_id"], "full_outer")
    mixed = title_weight * F.coalesce("t", F.lit(0.0)) + (1 - title_weight) * F.coalesce("x", F.lit(0.0))
    return both.select("q_id", "doc_id", F.round(mixed, 9).alias("score"))


def special_boost(base: DataFrame, docs: DataFrame, asked: DataFrame, boost: float = 2.0, text: str = "text") -> DataFrame:
    """Base score and a boost for every special token that query and document share."""
    have = docs.select("doc_id", F.explode(T.special_tokens(F.concat_ws("\n", "title", "text"))).alias("token"))
    want = asked.select("q_id", F.explode(T.special_tokens(F.col(text))).alias("token"))
    extra = have.join(want, "token").groupBy("q_id", "doc_id").agg((F.count(F.lit(1)) * F.lit(boost)).alias("extra"))
    both = base.join(extra, ["q_id", "doc_id"], "full_outer")
    return both.select("q_id", "doc_id", F.round(F.coalesce("score", F.lit(0.0)) + F.coalesce("extra", F.lit(0.0)), 9).alias("score"))


def cosine(vectors: DataFrame, queries: DataFrame) -> DataFrame:
    """(q_id, doc_id, score): every query vector against every vector.

    Vectors are dealt into 16 blocks, each of which meets a copy of the queries
    through an equi-join on the block number.
    """
    q = queries.select("q_id", M.unit_vector(F.col("embedding")).alias("qv"))
    v = vectors.select("doc_id", M.unit_vector(F.col("embedding")).alias("dv"))
    blocks = 16
    left = q.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = v.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).cast("int"))
    return right.join(left, "block").select("q_id", "doc_id", F.round(M.dot(F.col("qv"), F.col("dv")), 9).alias("score"))


CELL = 4096  # vectors, and queries, of one cell of the grid below


def cosine_top(vectors: DataFrame, queries: DataFrame, k: int, cell: int = CELL) -> DataFrame:
    """(q_id, doc_id, score, rank): the k best of `cosine` but for a query's own id, by score and then id.

    Every query meets every vector: vectors and queries are dealt into parts of
    about `cell` rows, a task multiplies two parts as matrices and keeps k rows a
    query, and a window takes the best of those.  A task holds two parts and
    their scores, whatever the size of the tables.  A vector that is null, empty
    or holds a null has null scores, which come last.
    """
    import numpy as np
    import pandas as pd

    parts = lambda df: max(1, -(-df.count() // cell))
    nv, nq = parts(vectors), parts(queries)
    part = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    x = F.col("embedding")
    whole = F.coalesce((F.size(x) > 0) & ~F.exists(x, lambda c: c.isNull()), F.lit(False))
    own = F.when(whole, M.unit_vector(x)).otherwise(F.array().cast("array<double>")).alias("v")
    v = vectors.select("doc_id", own, part("doc_id", nv).alias("vp")).withColumn("qp", every(nq))
    q = queries.select("q_id", own, part("q_id", nq).alias("qp")).withColumn("vp", every(nv))

    def stacked(rows):
        dim = rows.map(len).max()
        return np.stack([r if len(r) else np.zeros(dim) for r in rows])

    def best(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        names, found, scores, voids = [], [], [], []
        if len(left) and len(right):
            left = left.sort_values("doc_id", kind="stable")  # so that the first of equal scores has the smaller id
            ids, lacks = left["doc_id"].to_numpy(), left["v"].map(len).to_numpy() == 0
            mine = stacked(left["v"])
            for at in range(0, len(right), 256):
                some = right.iloc[at : at + 256]
                theirs = stacked(some["v"])
                if theirs.shape[1] != mine.shape[1] and theirs.shape[1] and mine.shape[1]:
                    raise ValueError("vectors of different lengths")
                near = np.round(theirs @ mine.T, 9) if theirs.shape[1] == mine.shape[1] else np.zeros((len(some), len(ids)))
                for name, vector, row in zip(some["q_id"], some["v"], near):
                    void = lacks | (len(vector) == 0)
                    key = np.where(void, -np.inf, np.where(np.isnan(row), np.inf, row))  # as Spark orders: NaN, numbers, null
                    others = np.flatnonzero(ids != name)
                    if len(others) > k:
                        others = others[key[others] >= np.partition(key[others], -k)[-k]]
                    first = others[np.argsort(-key[others], kind="stable")[:k]]
                    names += [name] * len(first)
                    found += list(ids[first])
                    scores += list(row[first])
                    voids += list(void[first])
        return pd.DataFrame({"q_id": pd.Series(names, dtype=object), "doc_id": pd.Series(found, dtype=object), "score": pd.Series(scores, dtype=float), "void": pd.Series(voids, dtype=bool)})

    met = v.groupBy("vp", "qp").cogroup(q.groupBy("vp", "qp")).applyInPandas(best, "q_id string, doc_id string, score double, void boolean")
    met = met.select("q_id", "doc_id", F.when(~F.col("void"), F.coalesce("score", F.lit(float("nan")))).alias("score"))  # Arrow reads NaN as null
    return ranked(met, k)
