"""Pairs of similar sets: all of them, and whole sets shuffled for none that can't be similar."""

import random

import pytest
from pyspark.sql import functions as F

from lodestone.operators import leakage, similar
from lodestone.plans import catalog


def _rows(n=160):
    rnd = random.Random(5)
    words, rows = [f"w{i}" for i in range(60)], []
    for i in range(n):
        base = rnd.choice(rows)[1].split(" ") if rows and rnd.random() < 0.6 else rnd.sample(words, rnd.randint(1, 40))
        rows.append((i, " ".join(w for w in base if rnd.random() < 0.95) or "w0"))
    own = [f"c{i}" for i in range(200)]  # near copies of a long set, whose parities have 128 or 256 bits
    rows += [(n + i, " ".join(rnd.sample(own, rnd.randint(110, 150)))) for i in range(40)]
    return rows + [(n + 40, ""), (n + 41, None)]


def _brute(rows, t):
    classes = {}
    for i, x in rows:
        if x:
            classes.setdefault(frozenset(x.split(" ")), []).append(i)
    known = sorted((min(v), k, len(v)) for k, v in classes.items())
    near = [(i, j, len(a & b) / len(a | b), m, n) for i, a, m in known for j, b, n in known if i < j]
    return {(i, j, m, n): s for i, j, s, m, n in near if s >= t}


@pytest.mark.parametrize("small", [False, True])
@pytest.mark.parametrize("t", [0.5, 0.8])
def test_every_similar_pair_is_found(spark, monkeypatch, small, t):
    if small:  # several blocks, grids, parts and pieces
        for name, n in (("HELD", 20), ("CHUNK", 7), ("POSTINGS", 50), ("CELL", 5), ("CROWD", 3), ("PLACES", 16)):
            monkeypatch.setattr(similar, name, n)
    rows = _rows()
    df = spark.createDataFrame(rows, "id int, text string").repartition(3)
    got = leakage.similar_sets(df, "id", F.split(F.when(F.col("text") != "", F.col("text")), " "), t).collect()
    wanted = _brute(rows, t)
    found = {(r.left_id, r.right_id, r.n_left, r.n_right): r.similarity for r in got}
    assert len(wanted) > 100 and len(got) == len(wanted) and found.keys() == wanted.keys()
    assert all(found[k] == pytest.approx(wanted[k], abs=6e-5) for k in wanted)


def test_sets_of_pairs_that_only_share_a_rare_term_stay_where_they_are(spark, monkeypatch):
    """A hundred long sets that meet on a term of their prefixes: 4950 pairs, and no set is sent to be compared."""
    rows = [(i, f"rare{i // 2} " + " ".join(f"x{i}y{j}" for j in range(80)) + " rare") for i in range(100)]
    sent = []
    monkeypatch.setattr(similar, "compared", lambda own, pairs, *a, f=similar.compared: sent.append(pairs.count()) or f(own, pairs, *a))
    got = leakage.similar_sets(spark.createDataFrame(rows, "id int, text string"), "id", F.split("text", " "), 0.8)
    assert got.isEmpty() and sent == [0]
    assert "array_intersect" not in got._jdf.queryExecution().executedPlan().toString()


def test_members_are_named_without_cutting_texts_again(spark):
    got = catalog.queries()["near_duplicate_members"](spark, "/root/testdata/sf0.001")
    assert not [x for x in got.inputFiles() if "documents.parquet" in x]
    assert got.count() == 200
