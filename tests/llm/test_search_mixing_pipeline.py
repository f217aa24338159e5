"""Exact search, mixing and the pipeline."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lodestone.llm import exact_search, mixing

from .conftest import WORDS


def clip(s):
    return max(min(s, 2**63 - 1), -(2**63))


def best(rows, is_query, k=20):
    usable = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for q, a in {i: a for i, a in reversed(usable) if is_query(i)}.items():
        scores = sorted((-clip(sum(x * y for x, y in zip(a, b))), i) for i, b in usable if i != q)[:k]
        out |= {(q, n, i, -s) for n, (s, i) in enumerate(scores, 1)}
    return out


def vectors(scale=1.0, n=300, seed=4):
    rng = np.random.default_rng(seed)
    rows = [(i, [float(x) for x in rng.normal(size=12).astype(np.float32) * scale]) for i in range(n)]
    for i in range(40, 80):
        rows[i] = (i, rows[40][1])  # ties
    return rows + [(1000, None), (1001, [1.0, None]), (1002, [float("nan")] * 12), (1003, [float("inf")] * 12), (1020, []), (1040, [1.0, 2.0]), (None, [1.0] * 12)]


@pytest.mark.parametrize("scale", [0.2, 3e4, 1e9])
def test_exact_search(spark, scale):
    rows = vectors(scale)
    d = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").withColumn("score", F.lit("clash")).withColumn("id", F.lit("clash"))
    for blocks in ({}, {"query_block": 5, "candidate_block": 37}):
        got = exact_search.top_k(d, F.col("vec_id") % 20 == 0, **blocks).collect()
        assert {(r.query_id, r["rank"], r.vec_id, r.score) for r in got} == best(rows, lambda i: i % 20 == 0)


def test_exact_search_of_few_and_none(spark):
    d = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id bigint, embedding array<double>")
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in exact_search.top_k(d, F.col("vec_id") == 0).collect()] == [(0, 1, 1, 64 * 128)]
    assert exact_search.top_k(d.limit(0), F.col("vec_id") == 0).count() == 0
    assert exact_search.top_k(d, F.lit(False)).count() == 0


def test_pruning_keeps_all_that_can_win():
    rng = np.random.default_rng(0)
    c = np.floor(64 * rng.normal(size=(64, 3000)) * np.linspace(2, 0.1, 64)[:, None])
    q = c[:, :70]
    for j, (i, ids, scores) in enumerate(exact_search.best_of_block(np.arange(70), q, np.arange(3000), c, 20)):
        s = c.T @ q[:, j]
        want = sorted((-x, k) for k, x in enumerate(s) if k != j)[:20]
        assert list(zip(-scores, ids)) == want


def test_bounds_prune_vectors_of_uneven_energy():
    rng = np.random.default_rng(2)
    shape = np.linspace(1, 0, 64)[:, None] ** 4
    c = np.floor(64 * rng.normal(size=(64, 8192)) * shape * rng.lognormal(size=8192))
    seen = []
    found = list(exact_search.best_of_block(np.arange(100), c[:, :100], np.arange(8192), c, 20, seen))
    for j in (0, 50, 99):
        want = sorted((-x, k) for k, x in enumerate(c.T @ c[:, j]) if k != j)[:20]
        assert list(zip(-found[j][2], found[j][1])) == want
    assert sum(seen) < 0.3 * 100 * 8192 * 64


def test_bounds_prune_the_given_vectors(spark):
    """Vectors of even energy: under 0.7 of the products are made, and the results are exact."""
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").orderBy("vec_id").select("vec_id", "embedding").toArrow()
    ids, v = rows["vec_id"].to_numpy(), np.floor(64 * np.array(rows["embedding"].to_pylist(), float)).T
    asked, seen = ids % 20 == 0, []
    for i, found, scores in exact_search.best_of_block(ids[asked], v[:, asked], ids, v, 20, seen):
        s = v.T @ v[:, ids == i][:, 0]
        assert list(zip(scores, found)) == [(-x, k) for x, k in sorted((-x, k) for k, x in zip(ids, s) if k != i)[:20]]
    assert sum(seen) < 0.7 * asked.sum() * len(ids) * 64


def test_equal_ids_are_separate_candidates(spark):
    d = spark.createDataFrame([(0, [1.0]), (1, [2.0]), (1, [2.0]), (1, [3.0])], "vec_id bigint, embedding array<double>")
    got = exact_search.top_k(d, F.col("vec_id") == 0).collect()
    assert [(r["rank"], r.vec_id, r.score) for r in sorted(got, key=lambda r: r["rank"])] == [(1, 1, 64 * 192), (2, 1, 64 * 128), (3, 1, 64 * 128)]


def waterfill(sizes, total):
    weights = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    out, open_ = {}, set(sizes)
    while open_:
        left, w = total - sum(out.values()), sum(weights[s] for s in open_)
        over = {s for s in open_ if left * weights[s] / w > 2 * sizes[s]}
        if not over:
            return out | {s: left * weights[s] / w for s in open_}
        out |= {s: 2.0 * sizes[s] for s in over}
        open_ -= over
    return out


def test_mixing(docs, rows, empty):
    got = mixing.with_copies(docs).select("doc_id", "source", "_m.*", F.col("size").alias("clash")).collect()
    sizes, taken, biggest = {}, {}, {}
    assert len(got) == len(rows)
    for r in got:
        assert r.copies in (0, 1, 2) and r.clash == "clash"
        sizes[r.source] = sizes.get(r.source, 0) + r["size"]
        taken[r.source] = taken.get(r.source, 0) + r.copies * r["size"]
        biggest[r.source] = max(biggest.get(r.source, 0), r["size"])
    want = waterfill(sizes, 1.5 * sum(sizes.values()))
    assert sorted(len(WORDS.findall(t or "")) for _, t, _, _ in rows) == sorted(r["size"] for r in got)
    for r in got:
        assert r.target == pytest.approx(want[r.source]) and r.source_size == sizes[r.source]
    for s, t in want.items():
        assert abs(taken[s] - t) <= biggest[s]
    again = mixing.with_copies(docs).select("doc_id", "_m.copies").collect()
    assert sorted((r.doc_id, r.copies) for r in again) == sorted((r.doc_id, r.copies) for r in got)
    assert mixing.with_copies(empty).count() == 0
    mixed = mixing.mixed(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r.copies for r in got)


def test_large_sources_come_near_their_targets(spark):
    d = spark.range(6000).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), (F.col("id") % 3).cast("string")).alias("source"), F.repeat(F.lit("w "), (F.col("id") % 97 + 1).cast("int")).alias("text"))
    per = mixing.with_copies(d).groupBy("source").agg(F.sum(F.col("_m.copies") * F.col("_m.size")).alias("taken"), F.first("_m.target").alias("target")).collect()
    assert all(abs(r.taken - r.target) <= 0.001 * r.target for r in per)


def test_inclusion_frequencies_match_the_probabilities(spark):
    """Equal sources draw independently, so each is a repetition for the others of its weight."""
    sizes, n = [1, 3, 6, 12, 25, 50, 100, 200, 400, 800] * 3, 240
    rows = [(1000 * s + i, f"s{s:03d}", "w " * size) for s in range(n) for i, size in enumerate(sizes)]
    d = spark.createDataFrame(rows, "doc_id bigint, source string, text string")
    # Weights of 9 and 1: the first half of the sources stops at twice its size, the others draw.
    got = mixing.shares(d, weights=(9, 1), share=1.3).filter("copies < 2 and target < 2 * source_size").collect()
    drawn = {r.doc_id // 1000 for r in got}
    assert len(drawn) == n // 2
    target = got[0].target - math.floor(got[0].target / sum(sizes)) * sum(sizes)
    count = {}
    for r in mixing.shares(d, weights=(9, 1), share=1.3).collect():
        if r.doc_id // 1000 in drawn:
            count.setdefault(r["size"], []).append(r.copies - math.floor(r.target / r.source_size))
    c, full = 0.0, []
    for size in sorted(count, reverse=True):
        open_ = sum(3 * x * x.bit_length() for x in count if x not in full)
        c = (target - sum(3 * x for x in full)) / open_
        if c * size.bit_length() <= 1:
            break
        full.append(size)
    want = {x: min(1.0, c * x.bit_length()) for x in count}
    assert len({round(p, 6) for p in want.values()}) > 5
    for size, taken in count.items():
        assert abs(np.mean(taken) - want[size]) < 0.1, (size, np.mean(taken), want[size])


def test_rows_without_an_id_are_drawn_one_by_one(spark):
    d = spark.createDataFrame([(None, f"t{i} " * 20, "a") for i in range(200)] + [(1, "x " * 50, "b")], "doc_id bigint, text string, source string")
    got = mixing.with_copies(d, weights=(1, 100)).filter("doc_id is null").select("_m.*").collect()
    assert len({r.copies for r in got}) == 2 and abs(sum(r.copies * r["size"] for r in got) - got[0].target) <= 20


def test_columns_named_like_inner_ones_stay(spark):
    d = spark.range(20).selectExpr("id as doc_id", "'a b' as text", "'s' as source", "id as _copy", "1 as m", "2 as p", "3 as k", "4 as row", "5 as col")
    got = mixing.mixed(d)
    assert got.columns == d.columns and all(r["_copy"] == r.doc_id and r.row == 4 for r in got.collect())
    assert mixing.with_copies(d).columns == [*d.columns, "_m"]


def test_mixing_plan_is_native(docs):
    text = mixing.with_copies(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in text and "Arrow" not in text and "Pandas" not in text


def test_pipeline_stages(spark, tmp_path, rows):
    long = " ".join(f"the word{i} of thing{i * 3}" for i in range(60))
    data = rows + [(5000 + i, f"{long} end{i} of the text", "en", "a") for i in range(3)] + [(6000, long.replace("word", "noun"), "en", "b")]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    spark.createDataFrame([(*r, len(r[1] or "")) for r in data], schema).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    seen = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        seen.append(out.count())
        docs = out
    assert len(corpus_pipeline.STAGES) == 5 and seen[0] < len(data) and seen[2] < seen[1] == seen[0]
    kept = {r.doc_id for r in docs.collect()}
    assert 6000 in kept or seen[3] >= 1
    pieces = corpus_pipeline.run(spark, str(tmp_path))
    assert pieces.agg(F.sum("length")).first()[0] > 0
    gone = corpus_pipeline.drop_near_copies(spark, spark.createDataFrame([(1, "a b c d", "x"), (2, "A b  c d", "x"), (3, "z", "x")], "doc_id bigint, text string, source string"), "")
    assert {r.doc_id for r in gone.collect()} == {1, 3}


def test_pipeline_of_empty_and_null_tables(spark, tmp_path):
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    for k, data in enumerate(([], [(None, None, None, None, None), (1, None, None, None, None), (1, "", "en", "a", 0)])):
        docs = spark.createDataFrame(data, schema)
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs_out = stage(spark, docs, "")
            assert docs_out.columns == docs.columns and docs_out.count() <= 2 * len(data), name
        assert corpus_pipeline.STAGES[-1][1](spark, docs, "").count() == len(data)
