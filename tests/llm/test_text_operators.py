"""Quality rules, token counts, packing, language and quality models."""

import collections
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import language_id, packing, quality_model, quality_rules, tokens
from lodestone.llm.common import crc_mod

from .conftest import WORDS


def measured(text):
    text = text or ""
    w = WORDS.findall(text)
    counts, covered = collections.Counter(zip(w, w[1:], w[2:])), set()
    for i in range(len(w) - 2):
        if counts[tuple(w[i : i + 3])] > 1:
            covered |= {i, i + 1, i + 2}
    lines = [x for x in text.split("\n") if WORDS.search(x)]
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_quality_rules(docs, rows, empty):
    got = quality_rules.judged(docs).select("text", "_quality.*", "words").collect()
    assert len(got) == len(rows) and all(r.words == "clash" for r in got)
    for r in got:
        n, chars, symbols, dup, repeat = measured(r.text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, dup, repeat)
        assert r.base_failed == (n < 50 or 100 * repeat > 50 * n) and not (r.kept and r.base_failed)
    assert quality_rules.judged(empty).count() == 0
    kept = quality_rules.filtered(docs)
    assert kept.columns == docs.columns and kept.count() == sum(r.kept for r in got)


def test_quality_rules_plan_is_one_projection(docs):
    plan = quality_rules.judged(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan


def test_symbols_fail_a_document(spark):
    good = " ".join(f"the word{i} of" for i in range(40))
    bad = " ".join(f"the$$$ word{i}### of%%%" for i in range(40))
    got = quality_rules.judged(spark.createDataFrame([(good,), (bad,)], "text string")).select("_quality.kept").collect()
    assert [r.kept for r in got] == [True, False]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.default_vocabulary())


def test_token_counts(docs, rows, empty, library):
    got = tokens.token_counts(docs).collect()
    want = sorted((i, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t, _, _ in rows)
    assert sorted((r.doc_id, r.n_bytes, r.n_tokens) for r in got) == want
    assert all(r.over_limit == (r.n_tokens > 1024) for r in got)
    assert tokens.token_counts(empty).count() == 0


def test_encoder_equals_the_library_on_safe_characters(library):
    import random

    import regex

    whole = tokens.whole_tokens(tokens.default_vocabulary())
    assert len(whole) > 40_000 and all(len(library.encode(s, add_special_tokens=False).ids) == 1 for s in list(whole)[:500])
    e, rnd = tokens.Encoder(tokens.default_vocabulary(), whole), random.Random(5)
    safe = [chr(i) for i in range(0x10000) if regex.fullmatch(tokens.SAFE, chr(i))]
    latin = [c for c in safe if ord(c) < 0x3000]
    odd = [chr(i) for i in (0x85, 0xA0, 0x300, 0x64B, 0x2003, 0x200D, 0x3000, 0xAD, 0xFEFF, 0x1F600, 0x10400, 0x1D7CE, 0x32000, 0x0E01, 0x0905)]
    for k in range(6000):
        pool = (safe, latin, safe + odd * 2000)[k % 3]
        s = "".join(rnd.choice(pool) if rnd.random() < 0.5 else rnd.choice(" ab's\n1. ") for _ in range(rnd.randint(0, 30)))
        ids = library.encode(s, add_special_tokens=False).ids
        assert e.ids(s) == ids and e.count(s) == len(ids)


def test_words_of_odd_characters_leave_the_shortcut_to_the_others():
    e = tokens.Encoder(tokens.default_vocabulary(), {})
    runs = list(e._runs("plain words \U0001f600 then Ελληνικά и русский 日本語 a\u0300 x end"))
    assert "".join(x for _, x in runs) == "plain words \U0001f600 then Ελληνικά и русский 日本語 a\u0300 x end"
    assert [safe for safe, _ in runs] == [True, False, True, False, True] and "русский" in runs[2][1]
    assert list(e._runs("a <|endoftext|> b")) == [(False, "a <|endoftext|> b")] and list(e._runs("")) == [(True, "")]


def test_packing_round_trip(docs, rows, empty, library):
    got = packing.packed(docs, with_ids=True).collect()
    stream = collections.defaultdict(dict)
    for r in got:
        stream[r.sequence_id][r.offset] = bytes(r.ids)
        assert len(r.ids) == 4 * r.length and zlib.crc32(r.ids) == r.ids_crc32 and r.offset + r.length <= 1024
    sizes = []
    for s in sorted(stream):
        at = 0
        for o in sorted(stream[s]):
            assert o == at
            at += len(stream[s][o]) // 4
        sizes.append(at)
    assert sorted(stream) == list(range(len(stream))) and set(sizes[:-1]) <= {1024}
    # In stream order a document begins at start 0 and ends with its last id; its pieces follow each other without a gap.
    found, ids = collections.Counter(), []
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.start == len(ids)
        ids += np.frombuffer(r.ids, "<u4").tolist()
        if len(ids) == r.doc_tokens:
            found[r.doc_id, tuple(ids)] += 1
            ids = []
    assert not ids
    assert found == collections.Counter((i, (*library.encode(t or "", add_special_tokens=False).ids, 0)) for i, t, _, _ in rows)
    nameless = packing.packed(docs.sparkSession.createDataFrame([(None, "a b"), (None, None), (None, "a b")], "doc_id bigint, text string"))
    assert sorted((r.doc_id, r.start, r.doc_tokens) for r in nameless.collect()) == [(None, 0, 1), (None, 0, 3), (None, 0, 3)]
    assert packing.packed(empty).count() == 0


def test_language_id(spark, docs, empty):
    rows = [(i, ("der und die nicht " if i % 2 else "the and of that ") * (1 + i % 3) + str(i), "de" if i % 2 else "en") for i in range(80)]
    rows += [(100, None, "en"), (101, "", "de"), (102, "123 !!", "en"), (103, "the that", None)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").withColumn("score", F.lit("clash"))
    got = {r.doc_id: r for r in language_id.identified(d, crc_mod(F.col("doc_id"), 4) == 2).collect()}
    assert len(got) == len(rows)
    assert all(got[i].lang_pred == lang for i, _, lang in rows[:80]) and got[103].lang_pred == "en"
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (100, 101, 102))
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= got[i].score <= 1 for i in got)
    assert language_id.identified(docs, F.lit(True)).filter("lang_pred <> 'und'").count() == 0
    assert language_id.identified(empty, F.lit(False)).count() == 0
    assert language_id.identified(docs, F.lit(False)).count() == docs.count()


def test_language_scores_equal_brute_force(monkeypatch):
    model = np.random.default_rng(0).normal(size=(3, 1 << 10)).astype(np.float32)
    texts = ["abc déf", "", None, "x", "hello world " * 40, "12"]
    for chunk in (language_id.CHUNK, 7):
        monkeypatch.setattr(language_id, "CHUNK", chunk)
        sums, has, grams = language_id._scored(texts, model, 10)
        for t, s, h, n in zip(texts, sums, has, grams):
            want = plain_counts(t, 10)
            assert h == any(c.isalpha() for c in t or "")
            assert np.allclose(s, model.astype(float) @ want if h else 0) and n == (want.sum() if h else 0)


def plain_counts(text, bits):
    """Buckets of all 1- to 4-grams of a text, one by one."""
    codes = [32] + [ord(c) if c.isalpha() else 32 for c in (text or "").lower()] + [32]
    out = np.zeros(1 << bits, int)
    for i in range(len(codes)):
        h = 0
        for n, c in enumerate(codes[i : i + 4], 1):
            h = (h * 0x9E3779B97F4A7C15 + c + n) % 2**64
            mixed = (h ^ (h >> 29)) * 0xBF58476D1CE4E5B9 % 2**64
            out[mixed >> (64 - bits)] += 1
    return out


def test_the_trained_model_and_its_answers_equal_brute_force(spark):
    rows = [(i, t, x) for i, (t, x) in enumerate([("the cat and the dog", "en"), ("der hund und die katze", "de"), ("le chat et le chien", "fr"), ("a dog", "en"), ("ein hund \U00032000 \U000323af", "de")] * 3)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    languages, model = language_id.trained(d, "text", "lang", bits=12)
    assert languages == ["de", "en", "fr"]
    sums = np.array([sum(plain_counts(t, 12) for _, t, x in rows if x == lang) for lang in languages]) + 0.5
    want = np.log(sums / sums.sum(axis=1, keepdims=True))
    assert np.allclose(model, want, atol=1e-4)
    asked = ["the hund", "le dog et", "katze cat chat", "d", "\U00032000", "chien " * 400]
    got = language_id.predicted(spark.createDataFrame(list(enumerate(asked)), "doc_id bigint, text string"), languages, model).collect()
    for r in got:
        n = plain_counts(asked[r.doc_id], 12)
        logs = want @ n
        tempered = np.exp((logs - logs.max()) * min(24, n.sum()) / n.sum())
        assert r.lang_pred == languages[int(logs.argmax())]
        assert r.score == pytest.approx(1 / tempered.sum(), abs=1e-3)
    assert {round(r.score, 3) for r in got} != {1.0}


def test_every_language_is_learned(spark):
    rows = [(i, f"x{chr(0x4E00 + i)}{chr(0x4E00 + i)}y {chr(0x4E00 + i)}" * 5, f"l{i:03d}") for i in range(300)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    got = {r.doc_id: r.lang_pred for r in language_id.identified(d, F.lit(False)).collect()}
    assert sum(got[i] == x for i, _, x in rows) >= 297
    assert language_id.bits_for(256) == 16 and language_id.bits_for(257) == 15 and language_id.bits_for(1 << 20) == 8


def test_long_texts_count_every_gram_once(monkeypatch):
    codes = language_id._padded("the quick brown fox " * 20)
    whole = language_id._counts(codes, 12)
    monkeypatch.setattr(language_id, "CHUNK", 50)
    assert (language_id._counts(codes, 12) == whole).all()


def test_quality_model(spark, docs, empty):
    rows = [(i, " ".join(f"w{(i * 7 + k) % 50}{'$$$' if i % 3 == 0 else ''}" for k in range(60)), int(i % 3 != 0)) for i in range(120)]
    d = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(500, None), (501, "")], "doc_id bigint, text string").withColumn("score", F.lit("clash"))
    labels = spark.createDataFrame([(i, q) for i, _, q in rows] + [(1, 1), (7, None), (None, 0)], "doc_id bigint, quality int")
    held = lambda c: crc_mod(c, 5) == 0
    got = {r.doc_id: r for r in quality_model.classified(d, labels, held).collect()}
    assert len(got) == 122 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got.values())
    out = [(got[i].score > 0.5) == bool(q) for i, _, q in rows if got[i].held_out]
    assert sum(out) >= 0.9 * len(out) > 0
    again = {r.doc_id: r.score for r in quality_model.classified(d, labels, held).collect()}
    assert all(abs(again[i] - got[i].score) < 1e-6 for i in got)
    none = quality_model.classified(docs, labels.limit(0), held).collect()
    assert len(none) == docs.count() and {r.score for r in none} == {0.5}
    assert quality_model.classified(empty, labels, held).count() == 0


def test_quality_model_of_one_class_null_ids_and_long_texts(spark):
    long = "word " * 300_000
    d = spark.createDataFrame([(i, f"some text {i}") for i in range(40)] + [(None, "no id"), (None, None), (90, long), (91, "z" * 200_000)], "doc_id bigint, text string")
    for quality in (0, 1):
        labels = spark.createDataFrame([(i, quality) for i in range(30)], "doc_id bigint, quality int")
        got = quality_model.classified(d, labels, lambda c: crc_mod(c, 5) == 0).collect()
        assert len(got) == 44 and all(0 <= r.score <= 1 for r in got)
        assert all((r.score >= 0.5) == bool(quality) for r in got if r.doc_id is not None and r.doc_id < 40)


def test_words_that_differ_late_have_shapes_of_their_own():
    a, b = ("aA0!" * 30 + x for x in ("a", "0"))
    assert quality_model._ids(a)[1] != quality_model._ids(b)[1]
