"""Line dedup, SimHash, substring dedup against brute force."""

import collections
import hashlib
import random

import numpy as np
import pytest
import xxhash

from lodestone.llm import line_dedup, simhash, substring_dedup

from .conftest import WORDS, folded

BLANK = " \t\n\x0b\x0c\r"


@pytest.mark.parametrize("least,keep,bytes_", [(3, "none", 1 << 24), (3, "none", 0), (2, "first", 1 << 24), (2, "first", 0)])
def test_line_dedup(docs, rows, least, keep, bytes_):
    key = lambda x: folded(x.strip(BLANK))
    n, first = collections.Counter(), {}
    for i, t, _, _ in sorted(rows, key=lambda r: r[0]):
        keys = [key(x) for x in (t or "").split("\n")]
        n.update(set(keys))
        for k, x in enumerate(keys):
            first.setdefault(x, (i, k))
    want = collections.Counter()
    for i, t, _, _ in rows:
        lines = (t or "").split("\n")
        kept = [x for k, x in enumerate(lines) if not (key(x) and n[key(x)] >= least and (keep == "none" or first[key(x)] != (i, k)))]
        want[i, "\n".join(kept), len(lines), len(lines) - len(kept)] += 1
    got = line_dedup.deduplicated(docs, least=least, keep=keep, broadcast_bytes=bytes_)
    assert got.columns == [*docs.columns, "_lines"]
    assert collections.Counter((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in got.select("doc_id", "text", "_lines.*").collect()) == want


def test_line_dedup_of_nothing_and_of_null_ids(spark, empty):
    assert line_dedup.deduplicated(empty).count() == 0
    d = spark.createDataFrame([(None, "x\ny"), (None, "x"), (2, "X ")], "doc_id bigint, text string")
    for bytes_ in (0, 1 << 20):
        got = line_dedup.deduplicated(d, least=2, broadcast_bytes=bytes_)
        assert sorted(r.text for r in got.collect()) == ["", "X ", "y"]


def test_line_dedup_with_full_filters(docs, monkeypatch):
    """A filter too small suspects every line; the result is the same."""
    digest = lambda d: collections.Counter((r.doc_id, r.text) for r in d.select("doc_id", "text").collect())
    want = digest(line_dedup.deduplicated(docs, least=3, keep="first"))
    monkeypatch.setattr("lodestone.llm.bloom.MAX_BITS", 9)
    for bytes_ in (0, 1 << 20):
        assert digest(line_dedup.deduplicated(docs, least=3, keep="first", broadcast_bytes=bytes_)) == want


def print_of(text, k=3):
    w = WORDS.findall(folded(text or ""))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] or [" ".join(w)]]
    return sum(1 << j for j in range(64) if 2 * sum(x >> j & 1 for x in h) > len(h))


def classes(prints, most):
    """Smallest id that each fingerprint reaches."""
    ids = {}
    for i, p in prints:
        ids[p] = min(ids.get(p, i), i)
    keys = list(ids)
    parent = {p: p for p in keys}

    def find(p):
        while parent[p] != p:
            p = parent[p]
        return p

    for a, p in enumerate(keys):
        for q in keys[:a]:
            if bin(p ^ q).count("1") <= most:
                x, y = find(p), find(q)
                if x != y:
                    parent[x if ids[x] > ids[y] else y] = y if ids[x] > ids[y] else x
    return {p: ids[find(p)] for p in keys}


def test_simhash(docs, rows, empty):
    prints = {(i, t): print_of(t) for i, t, _, _ in rows}
    want = classes([(i, p) for (i, _), p in prints.items()], 3)
    got = simhash.near_duplicates(docs).collect()
    assert sorted((r.doc_id, r.fingerprint, r.component_id) for r in got) == sorted((i, f"{prints[i, t]:016x}", want[prints[i, t]]) for i, t, _, _ in rows)
    assert simhash.near_duplicates(empty).count() == 0
    kept = simhash.deduplicated(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == set(want.values())


def test_links_at_every_distance_and_in_hot_keys(spark):
    rnd = random.Random(8)
    base = [rnd.getrandbits(64) for _ in range(40)]
    fps = set(base)
    for p in base:
        for d in (1, 2, 3, 4):
            q = p
            for b in rnd.sample(range(64), d):
                q ^= 1 << b
            fps.add(q)
    chain = [0]
    for k in range(20):
        chain.append(chain[-1] ^ (0b111 << (3 * k)))
    fps |= set(chain)
    rows = [(p - (1 << 64) if p >> 63 else p, i) for i, p in enumerate(sorted(fps))]
    nodes = spark.createDataFrame(rows, "fp bigint, node bigint")
    want = classes([(i, p % (1 << 64)) for p, i in rows], 3)
    for hot in (2000, 1):
        got = {r.node: r.component for r in simhash.components(simhash.links(nodes, hot=hot)).collect()}
        assert all(got.get(i, i) == want[p % (1 << 64)] for p, i in rows)


def test_components_of_long_paths(spark):
    path = list(range(60))
    random.Random(2).shuffle(path)
    edges = spark.createDataFrame(list(zip(path, path[1:])) + [(100, 101), (101, 100)], "a bigint, b bigint")
    got = {r.node: r.component for r in simhash.components(edges).collect()}
    assert all(got.get(i, i) == 0 for i in range(60)) and got[101] == 100


def without_passages(rows, length=50):
    words = [(i, WORDS.findall(t or "")) for i, t, _, _ in rows]
    first = {}
    for i, w in words:
        for k in range(len(w) - length + 1):
            key = tuple(w[k : k + length])
            first[key] = min(first.get(key, i), i)
    out = collections.Counter()
    for i, w in words:
        gone = np.zeros(len(w), bool)
        for k in range(len(w) - length + 1):
            if first[tuple(w[k : k + length])] < i:
                gone[k : k + length] = True
        out[i, " ".join(x for x, g in zip(w, gone) if not g), len(w), int(gone.sum())] += 1
    return out


@pytest.mark.parametrize("settings", [{}, {"hot": 0}, {"hot": 1}, {"shard_words": 100}])
def test_substring_dedup(docs, rows, settings):
    got = substring_dedup.deduplicated(docs, **settings).collect()
    assert collections.Counter((r.doc_id, r.kept, r.n_words, r.n_removed) for r in got) == without_passages(rows)
    assert sum(r.n_removed for r in got) > 0


def test_substring_dedup_of_nothing_and_of_null_ids(spark, empty):
    assert substring_dedup.deduplicated(empty).count() == 0
    t = " ".join(str(i) for i in range(60))
    d = spark.createDataFrame([(None, t), (3, t), (5, t)], "doc_id bigint, text string")
    assert sorted((str(r.doc_id), r.n_removed) for r in substring_dedup.deduplicated(d).collect()) == [("3", 0), ("5", 60), ("None", 0)]


def test_rows_that_share_an_id_but_not_a_text(spark):
    t, u = (" ".join(f"{c}{i}" for i in range(80)) for c in "tu")
    d = spark.createDataFrame([(1, t), (5, t), (5, u), (5, t), (7, u)], "doc_id bigint, text string")
    for hot in (1000, 0):
        got = substring_dedup.deduplicated(d, hot=hot).collect()
        assert sorted((r.doc_id, r.kept[:2], r.n_removed) for r in got) == [(1, "t0", 0), (5, "", 80), (5, "", 80), (5, "u0", 0), (7, "", 80)]


def test_a_large_group_of_near_copies(spark):
    """Many different contexts of the same anchors: they are split until they fit, and no window is lost."""
    rnd = random.Random(12)
    base = [f"w{rnd.randrange(60)}" for _ in range(160)]
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(rnd.randint(0, 5)):
            w[rnd.randrange(len(w))] = f"x{rnd.randrange(40)}"
        rows.append((i, " ".join(w[rnd.randrange(20) :]), None, None))
    d = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    want = without_passages(rows)
    for hot in (1000, 20, 3):
        got = substring_dedup.deduplicated(d, hot=hot).collect()
        assert collections.Counter((r.doc_id, r.kept, r.n_words, r.n_removed) for r in got) == want


def test_halves_share_the_core_of_equal_windows():
    rnd = random.Random(3)
    words = [b"%d" % rnd.randrange(9) for _ in range(92)]
    todo, seen = [(words, -42, -42, 0)], set()
    while todo:
        part, at, lo, hi = todo.pop()
        for a, z, s, e in substring_dedup.halves(part, at, lo, hi, 50):
            own = part[s - at : e - at + 50]
            assert a <= s <= e <= z and own == words[s + 42 : e + 92] and len(part[z - at : a - at + 50]) == 50 - (z - a)
            todo += [(own, s, a, z)] if a < z else []
            seen |= {s} if a == z else set()
    assert seen == set(range(-42, 1))


def test_fm_index_counts_like_a_scan():
    rnd = np.random.default_rng(1)
    text = np.append(rnd.integers(1, 4, 300), 0)
    index = substring_dedup.FMIndex(text, 4, 50)
    for size in (1, 2, 5):
        for s in range(0, 290, 37):
            low, high = np.array([0]), np.array([len(text)])
            for c in text[s : s + size][::-1]:
                low, high = index.extend(np.array([c]), low, high)
            assert high[0] - low[0] == sum((text[i : i + size] == text[s : s + size]).all() for i in range(301 - size))


def test_query_digests(spark, tmp_path, rows):
    from lodestone.llm import queries

    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op5_substring_dedup(spark, str(tmp_path)).collect()
    want = collections.Counter((i, n, r, hashlib.sha256(k.encode()).hexdigest()) for (i, k, n, r), c in without_passages(rows).items() for _ in range(c))
    assert collections.Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == want
    assert queries.op1_line_dedup(spark, str(tmp_path)).columns == ["doc_id", "n_lines", "n_dropped", "kept_sha256"]


def test_similar_texts_meet_and_unlike_ones_do_not(spark):
    rnd = random.Random(11)
    words = [f"w{i}" for i in range(3000)]
    rows = []
    for i in range(40):
        w = [rnd.choice(words) for _ in range(300)]
        rows.append((3 * i, " ".join(w)))
        rows.append((3 * i + 1, " ".join(w).upper()))
        w[rnd.randrange(300)] = "other"
        rows.append((3 * i + 2, " ".join(w)))
    rows += [(500, None), (501, ""), (502, "one two"), (503, "one  TWO"), (504, "one two three")]
    d = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: r.component_id for r in simhash.similar(d).collect()}
    assert all(got[3 * i] == got[3 * i + 1] == 3 * i for i in range(40))
    assert sum(got[3 * i + 2] == 3 * i for i in range(40)) >= 38
    assert {got[3 * i + 2] for i in range(40)} <= {3 * i for i in range(40)} | {3 * i + 2 for i in range(40)}
    assert (got[500], got[501], got[502], got[503], got[504]) == (500, 500, 502, 502, 504)
    assert {r.doc_id: r.component_id for r in simhash.similar(d, hot=1).collect()} == got
    assert simhash.similar(d.limit(0)).count() == 0
    assert {r.doc_id for r in simhash.without_similar(d).collect()} == set(got.values())


def test_a_pair_at_the_threshold_shares_a_key():
    """Sign-angle model: bits of sets with Jaccard 0.8 differ with probability acos(2 J / (1 + J)) / pi."""
    rnd = np.random.default_rng(6)
    masks = np.array(simhash._random_masks(), np.uint64).reshape(simhash.TABLES, -1)
    differ = rnd.random((2000, masks.shape[1], 64)) < np.arccos(1.6 / 1.8) / np.pi
    words = (differ * (np.uint64(1) << np.arange(64, dtype=np.uint64))).sum(axis=2, dtype=np.uint64)
    met = ((words[:, None, :] & masks[None]) == 0).all(axis=2).any(axis=1)
    assert met.mean() >= 0.98


def near_the_threshold(seed=5, n=150):
    """Pairs of texts whose five-word shingle sets are alike in about 0.65 to 0.95, and their sets."""
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(5000)]
    rows = []
    for i in range(n):
        w = [rnd.choice(words) for _ in range(rnd.choice([60, 150, 400]))]
        v = list(w)
        cut = rnd.uniform(0.02, 0.22) * len(w)
        v[len(w) - int(cut) :] = [rnd.choice(words) for _ in range(int(cut))]
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(v))]
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for i, t in rows}
    return rows, sets


def test_similarity_around_the_threshold(spark):
    rows, sets = near_the_threshold()
    jaccard = {i: len(sets[i] & sets[i + 1]) / len(sets[i] | sets[i + 1]) for i in range(0, len(rows), 2)}
    alike = {i for i, x in jaccard.items() if x >= 0.8}
    assert sum(0.7 <= x < 0.8 for x in jaccard.values()) > 20 and sum(0.8 <= x < 0.9 for x in jaccard.values()) > 20
    got = {r.doc_id: r.component_id for r in simhash.similar(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    linked = {i for i in jaccard if got[i] == got[i + 1]}
    assert all(got[i] == i for i in jaccard) and all(got[i + 1] in (i, i + 1) for i in jaccard)
    assert linked <= alike, sorted((round(jaccard[i], 3), i) for i in linked - alike)
    assert len(linked) >= 0.98 * len(alike), sorted((round(jaccard[i], 3), i) for i in alike - linked)


def test_repeated_shingles_do_not_make_texts_alike(spark):
    spam = "buy it now " * 500
    rows = [(i, spam + " ".join(f"{i}x{k}" for k in range(100))) for i in range(4)]
    got = simhash.similar(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(i, i) for i in range(4)]


def test_hot_candidate_groups_are_cut_without_loss(spark):
    base = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join(base[: 200 - i] + [f"{i}y{k}" for k in range(i)])) for i in range(40)]
    rows += [(100 + i, " ".join(f"v{i}x{k}" for k in range(50))) for i in range(5)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string")
    whole = {r.doc_id: r.component_id for r in simhash.similar(d).collect()}
    assert {r.doc_id: r.component_id for r in simhash.similar(d, sets=3).collect()} == whole and set(whole.values()) != set(whole)


def test_large_groups_by_pivots_equal_all_pairs(spark):
    """Several classes, chains between them and single nodes in one group of many chunks."""
    rnd = random.Random(4)
    flip = lambda x, k: [x[0] ^ sum(1 << b for b in rnd.sample(range(63), k)), *x[1:]]
    nodes = []
    for _ in range(4):
        x = [rnd.getrandbits(63) for _ in simhash.WORDS]
        nodes += [x] + [flip(x, rnd.randint(1, 9)) for _ in range(40)]
        for _ in range(15):
            x = flip(x, 10)
            nodes.append(x)
    nodes += [[rnd.getrandbits(63) for _ in simhash.WORDS] for _ in range(20)]
    rnd.shuffle(nodes)
    distance = lambda x, y: sum(bin(a ^ b).count("1") for a, b in zip(x, y))
    want = list(range(len(nodes)))
    for i in range(len(nodes)):
        for j in range(i):
            if distance(nodes[i], nodes[j]) <= 10:
                a, b = sorted((want[i], want[j]))
                want = [a if x == b else x for x in want]
    rows = spark.createDataFrame([(7, i, *x) for i, x in enumerate(nodes)], "g bigint, node bigint, " + ", ".join(f"{w} bigint" for w in simhash.WORDS))
    sizes = spark.createDataFrame([(7, len(nodes), 6)], "g bigint, n bigint, chunks int")
    near = lambda t: simhash._bits_near(np.stack([t[c].to_numpy().astype(np.uint64) for c in simhash.WORDS], axis=1), 10)
    got = {r.node: r.component for r in simhash.components(simhash._pivoted(rows, sizes, near)).collect()}
    assert [got.get(i, i) for i in range(len(nodes))] == want


def test_keys_grow_with_the_nodes():
    assert simhash.tables_for(1 << 20) == (simhash.TABLES, simhash.KEY_BITS)
    tables, bits = simhash.tables_for(1 << 30)
    assert bits == 22 and tables > 2 * simhash.TABLES
    agree = 1 - np.arccos(1.6 / 1.8) / np.pi
    assert 1 - (1 - agree**bits) ** tables >= 1 - (1 - agree**simhash.KEY_BITS) ** simhash.TABLES - 1e-3


def test_columns_named_like_inner_ones_stay(spark):
    d = spark.createDataFrame([(1, "a b", "x"), (2, "a b", "y"), (None, "a b", "z")], "doc_id bigint, text string, leader string").toDF("doc_id", "text", "_leader")
    d = d.selectExpr("*", "1 as leader", "2 as id", "3 as row", "4 as component_id")
    for f in (simhash.deduplicated, simhash.without_similar):
        got = f(d)
        assert got.columns == d.columns and sorted(str(r["_leader"]) for r in got.collect()) == ["x", "z"]
