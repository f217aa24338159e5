"""The quality network and the whole pipeline against brute force."""

import collections
import math
import random

import numpy as np
import pytest

import corpus_pipeline
from lodestone.llm import oracles, packing, quality_model, quality_rules
from tests.llm.conftest import WORDS, folded
from tests.llm.test_text_operators import measured

BLANK = " \t\n\x0b\x0c\r"


# ---- word vectors, pooling, network ------------------------------------------------


def plain_vectors(texts):
    """Contexts word by word: the neighbours within the window, in words and in shapes."""
    places, signs = quality_model.index_vectors()
    n, d = 1 << quality_model.BITS, quality_model.DIMENSIONS
    index = lambda b: [sum(s for p, s in zip(places[b], signs[b]) if p == k) for k in range(d)]
    sums = collections.defaultdict(lambda: np.zeros(d))
    for t in texts:
        for ids in quality_model._ids(t):
            for i, a in enumerate(ids):
                for j in range(max(0, i - quality_model.WINDOW), min(len(ids), i + quality_model.WINDOW + 1)):
                    if i != j:
                        sums[a] += index(ids[j])
    unit = lambda v: v / max(math.sqrt((v * v).sum()), 1e-9)
    return lambda b: unit(unit(sums[b].astype(np.float32)) + unit(np.array(index(b)))), n


def test_word_vectors_and_pooling_equal_brute_force(spark):
    rnd = random.Random(3)
    texts = [" ".join(rnd.choice(["the", "The", "of", "x1", "x22", "Über!", "a-b", "end."]) for _ in range(rnd.randint(0, 30))) for _ in range(40)] + [None, "", "one"]
    vectors = quality_model.word_vectors(spark.createDataFrame([(t,) for t in texts], "text string").repartition(5), "text")
    want, n = plain_vectors(texts)
    assert vectors.shape == (n, quality_model.DIMENSIONS)
    used = {b for t in texts for ids in quality_model._ids(t) for b in ids}
    for b in [*used, 0, 17, n - 1]:
        assert np.allclose(vectors[b], want(b), atol=1e-5)
    for t, got in zip(texts, quality_model.pooled(texts, vectors)):
        words, shapes = quality_model._ids(t)
        assert len(words) == len(shapes) == len((t or "").split())
        mean = lambda ids: np.mean([vectors[b] for b in ids], axis=0) if ids else np.zeros(quality_model.DIMENSIONS)
        share = len(set(words)) / max(len(words), 1)
        assert np.allclose(got, [*mean(words), *mean(shapes), math.log1p(len(words)), share], atol=1e-5)


def test_the_network_and_its_temperature_equal_brute_force():
    rng = np.random.default_rng(4)
    n = 2000  # enough rows to learn one direction of 130
    x = rng.normal(size=(n, 2 * quality_model.DIMENSIONS + 2))
    y = (x[:, 0] + 0.5 * rng.normal(size=n) > 0).astype(float)
    model = quality_model.fitted(x, y)
    w1, b1, w2, b2 = model["w"]

    def logit(row):
        z = [(v - m) / s for v, m, s in zip(row, model["mean"], model["scale"])]
        hidden = [math.tanh(sum(a * w for a, w in zip(z, w1[:, h])) + b1[h]) for h in range(quality_model.HIDDEN)]
        return sum(a * w for a, w in zip(hidden, w2)) + b2[0]

    got = quality_model.probability(x[:40], model)
    assert np.allclose(got, [1 / (1 + math.exp(-logit(r) / model["temperature"])) for r in x[:40]], atol=1e-9)
    aside = [i for i in range(n) if i % 5 == 4]
    logits = [logit(x[i]) for i in aside]

    def loss(t):
        return sum(math.log1p(math.exp(-abs(z / t))) + max(z / t, 0) - y[i] * z / t for i, z in zip(aside, logits))

    assert model["temperature"] == pytest.approx(min(np.geomspace(0.5, 10, 60), key=loss))
    right = np.mean((quality_model.probability(x[aside], model) > 0.5) == (y[aside] > 0.5))
    assert right > 0.75


# ---- the pipeline, stage by stage and in one ------------------------------------------


def table(seed=7):
    """Documents that each stage has something to do with."""
    rnd = random.Random(seed)
    vocabulary = ["".join(rnd.choice("abdeghilmnorst") for _ in range(rnd.randint(2, 8))) for _ in range(600)]
    text = lambda k: "\n".join(" ".join([*(rnd.choice(vocabulary) for _ in range(9)), rnd.choice(["the", "of", "and", "is"]), "that"]) for _ in range(k))
    rows = []
    for i in range(60):
        t = text(rnd.randint(8, 20))
        if i % 5 == 0 and rows:  # an exact or near copy of an earlier document
            t = rows[rnd.randrange(len(rows))][1]
            if i % 10 == 0:
                words = t.split(" ")
                words[len(words) // 2] = "changed"
                t = " ".join(words)
        if i % 3 == 0:
            t += "\n  The SAME line again\n" + text(2)
        rows.append((i, t, "en", rnd.choice(["a", "a", "b", None]), None))
    rows += [(100, None, "en", "a", None), (101, "", None, "b", None), (102, "too short", "de", "a", None), (103, "$$$ ### " * 60, "en", "a", None), rows[4], rows[4]]
    return [(i, t, lang, source, len(t or "")) for i, t, lang, source, _ in rows]


def test_pipeline_equals_brute_force(spark, tmp_path):
    import duckdb
    from tokenizers import Tokenizer

    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    data = table()
    spark.createDataFrame(data, schema).write.parquet(str(tmp_path / "documents.parquet"))
    # Quality: the rules' own verdict of each row, whose measures are counted here again.
    judged = quality_rules.judged(spark.createDataFrame(data, schema)).select("doc_id", "text", "_quality.*").collect()
    for r in judged:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == measured(r.text)
    verdict = {(r.doc_id, r.text): r.kept for r in judged}
    docs = [r for r in data if verdict[r[0], r[1]]]
    assert 0 < len(docs) < len(data) and all(r[1] for r in docs)
    # Lines of ten documents or more stay in the first of them.
    key = lambda x: folded(x.strip(BLANK))
    n, first = collections.Counter(), {}
    for i, t, *_ in sorted(docs, key=lambda r: r[0]):
        keys = [key(x) for x in t.split("\n")]
        n.update(set(keys))
        for k, x in enumerate(keys):
            first.setdefault(x, (i, k))
    assert any(v >= 10 for k, v in n.items() if k)
    lines = lambda i, t: "\n".join(x for k, x in enumerate(t.split("\n")) if not (key(x) and n[key(x)] >= 10 and first[key(x)] != (i, k)))
    docs = [(i, t2 := lines(i, t), lang, source, len(t2)) for i, t, lang, source, _ in docs]
    # Near copies: components of exact five-word Jaccard 0.8, of which the smallest id stays.
    shingles = []
    for _, t, *_ in docs:
        w = WORDS.findall(folded(t))
        shingles.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} or {tuple(w)})
    group = list(range(len(docs)))
    for a in range(len(docs)):
        for b in range(a):
            if len(shingles[a] & shingles[b]) >= 0.8 * len(shingles[a] | shingles[b]):
                old, new = group[a], group[b]
                group = [new if g == old else g for g in group]
    leader = {g: min(docs[k][0] for k in range(len(docs)) if group[k] == g) for g in set(group)}
    unique = [r for k, r in enumerate(docs) if r[0] == leader[group[k]]]  # rows of one id stay or go together
    assert len(unique) < len(docs)
    # Mixing: the copies that the SQL of the operator takes of this table.
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, n_chars BIGINT)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?, ?)", unique)
    copies = {i: taken // size if size else 0 for i, size, taken in con.execute(f"SELECT doc_id, size, taken FROM ({oracles.OP9})").fetchall()}
    mixed = [r for r in unique for _ in range(copies[r[0]])]
    assert mixed and len({copies[r[0]] for r in unique}) > 1
    # Packing: every copy's ids once, in gapless sequences of 1024.
    library = Tokenizer.from_file(packing.default_vocabulary())
    want = collections.Counter((i, len(library.encode(t, add_special_tokens=False).ids) + 1) for i, t, *_ in mixed)
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    got, at = collections.Counter(), 0
    for p in sorted(pieces, key=lambda p: (p.sequence_id, p.offset)):
        assert p.sequence_id * 1024 + p.offset == at
        at += p.length
        if p.start + p.length == p.doc_tokens:
            got[p.doc_id, p.doc_tokens] += 1
    assert got == want
