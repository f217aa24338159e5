"""Filter audit, WARC archives and vector codes against brute force."""

import base64
import hashlib
import itertools
import math
import os
import random
from collections import Counter
from fractions import Fraction

import pyarrow.fs as pafs
import pytest
from pyspark.sql import functions as F

from lodestone.llm import filter_audit, vector_codes, warc
from lodestone.llm.common import looked_up
from tests.llm.conftest import WORDS

# ---- filter audit ------------------------------------------------------------


def failing(rows, labels):
    """(part, letters failed, good, toxic) of every row, by the plain conditions."""
    least = {}
    for i, t, *_ in rows:
        if i is not None:
            least[t or ""] = min(least.get(t or "", i), i)
    good, toxic = ({i for i, *m in labels if m[k] == 1 and i is not None} for k in (0, 1))
    for i, text, _, source in rows:
        t = text or ""
        w = WORDS.findall(t)
        own = ("A" if len(w) < 50 else "") + ("B" if 100 * len(set(w)) < 65 * len(w) else "")
        own += "C" if 100 * sum("A" <= c <= "Z" for c in t) > 5 * len(t) else ""
        own += ("D" if set(t) & set("#$%&*|") else "") + ("E" if i is not None and i > least[t] else "")
        yield source or "", own, i in good, i in toxic


def simulated(rows, labels):
    """Runs every order over every document."""
    docs, out = list(failing(rows, labels)), set()
    for part in {d[0] for d in docs}:
        own, steps = [d for d in docs if d[0] == part], []
        for order in itertools.permutations("ABCDE"):
            left = own
            for k, f in enumerate(order, 1):
                gone = [d for d in left if f in d[1]]
                left = [d for d in left if f not in d[1]]
                fails = [d for d in own if f in d[1]]
                steps.append((part, "".join(order), k, len(left), len(gone), len(fails) - len(gone), sum(d[1] == f for d in own), sum(d[2] for d in gone), sum(d[3] for d in gone), f))
        removed = Counter()
        for s in steps:
            removed[s[-1]] += s[4]
        out |= {(*s[:-1], removed[s[-1]]) for s in steps}
    return out


def test_audit_equals_running_every_order(spark, docs, rows):
    rnd = random.Random(3)
    labels = [(r[0], rnd.randint(0, 1), rnd.randint(0, 1)) for r in rows if rnd.random() < 0.5] + [(3, 1, None), (3, None, 1), (None, 1, 1)]
    more = [(None, rows[0][1], "en", "a"), (None, None, None, None), (2000, "A# B " * 30, "en", "C"), (2001, "A# B " * 30, "en", "a"), (-1, "A# B " * 30, "en", None)]
    table = docs.select("doc_id", "text", "lang", "source").unionByName(spark.createDataFrame(more, "doc_id bigint, text string, lang string, source string")).withColumn("mask", F.lit("clash"))
    marks = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    got = filter_audit.audited(table, marks).collect()
    assert len(got) == len(set(got)) and {tuple(r) for r in got} == simulated(rows + more, labels)
    assert {r.part for r in got} >= {"", "C"}


def test_audit_of_nothing(spark, empty):
    marks = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert filter_audit.audited(empty, marks).collect() == []


def test_shapley_integral_is_the_mean_over_orders():
    rnd = random.Random(4)
    counts = [rnd.randint(0, 9) for _ in range(32)]
    poly = filter_audit.polynomial(counts)
    for on in range(32):
        assert filter_audit.corner(poly, on) == sum(c for m, c in enumerate(counts) if m & on)
    values = [filter_audit.shapley(poly, i) for i in range(5)]
    assert all(isinstance(v, Fraction) for v in values) and sum(values) == sum(counts[1:])
    for i in range(5):
        orders = [o[: o.index(i)] for o in itertools.permutations(range(5))]
        mean = Fraction(sum(c for o in orders for m, c in enumerate(counts) if m >> i & 1 and not any(m >> j & 1 for j in o)), math.factorial(5))
        assert values[i] == mean


def test_copies_do_not_meet_in_one_task(spark):
    """The copies of one text are told apart by (digest, id), not gathered by digest."""
    d = spark.range(50).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"), F.lit("s").alias("source"))
    plan = filter_audit.mask_counts(d, spark.createDataFrame([], "doc_id bigint, quality int, toxic int"))._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "collect_" not in plan


# ---- WARC ----------------------------------------------------------------------

PAGES = [
    (1, "http://a.example/x y\r\nz", "<p>ä</p>"), (2, "http://a.example/2", "<p>ä</p>"), (9, None, "<p>ä</p>"), (3, "", None), (4, "u", ""), (5, "http://b.example/", "WARC/1.1\r\n\r\nnot a record\r\n\r\n"),
    (None, "n", "<p>ä</p>"), (None, "m", "alone"), (7, "d", "twice"), (7, "d", "twice"), (8, "long", "é" * 3_000_000), (10, "l2", "abc\x00def"),
]


def b32(data):
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def expected(pages, least=0):
    first = {}
    for i, _, h in pages:
        if i is not None:
            first[h or ""] = max(first.get(h or "", i), i)
    for i, _, h in pages:
        p = (h or "").encode()
        f = first.get(h or "") if len(p) >= least else None
        revisit = f is not None and i != f
        yield i, len(p), b32(p), "revisit" if revisit else "response", f if revisit else None


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame(PAGES, "page_id bigint, url string, html string").withColumn("payload", F.lit("clash")).withColumn("digest", F.lit(1))


@pytest.fixture(scope="module")
def archive(pages, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("warc") / "a")
    warc.archived(pages, path)
    return path


def key(rows):
    return sorted(map(tuple, rows), key=repr)


@pytest.mark.parametrize("least", [0, 1, 6, 100])
def test_pages_round_trip(spark, pages, tmp_path, least):
    path = f"file://{tmp_path}/a"
    warc.archived(pages, path, least_bytes=least)
    assert key(warc.summary(spark, path).collect()) == key(expected(PAGES, least))
    assert not [f for f in os.listdir(tmp_path / "a") if f.startswith("_")]


def test_payloads_come_back_whole(spark, archive):
    got = {(r.record_id, bytes(r.payload)) for r in warc.records(spark, archive).filter("record_type = 'response'").collect()}
    assert got == {(f"<urn:page:{'' if i is None else i}>", (h or "").encode()) for (i, _, h), (*_, kind, _) in zip(PAGES, expected(PAGES)) if kind == "response"}
    heads = {r.record_id: r for r in warc.records(spark, archive, payload=False).filter("record_type = 'revisit'").collect()}
    assert heads["<urn:page:1>"].target_uri == "http://a.example/x%20y%0D%0Az" and heads["<urn:page:1>"].refers_to == "<urn:page:9>"
    assert all(r.payload is None and r.headers["warc-profile"] == warc.REVISIT for r in heads.values())


def test_standard_gzip_reads_the_archive(archive):
    import gzip

    for f in os.listdir(archive):
        data = gzip.open(f"{archive}/{f}").read()
        assert data.startswith(b"WARC/1.1\r\nWARC-Type: warcinfo\r\n") and data.endswith(b"\r\n\r\n")


def test_empty_table_and_overwrite(spark, pages, archive, tmp_path):
    path = str(tmp_path / "none")
    warc.archived(pages.limit(0), path)
    assert warc.summary(spark, path).collect() == [] and warc.records(spark, path).filter("record_type <> 'warcinfo'").count() == 0
    warc.decided(pages).write.format("warc").mode("overwrite").save(path)
    warc.decided(pages.limit(1)).write.format("warc").mode("overwrite").save(path)
    assert warc.records(spark, path).filter("record_type <> 'warcinfo'").count() == 1


def _filters(df):
    return "Filter (" in df._jdf.queryExecution().executedPlan().toString()


def test_predicates_reach_the_reader(spark, archive):
    asked = warc.records(spark, archive).filter("record_type = 'response' AND target_uri LIKE 'http://b%' AND content_length > 10 AND NOT record_id IN ('x', 'y')")
    assert [r.record_id for r in asked.collect()] == ["<urn:page:5>"]
    assert not _filters(asked)  # Spark has nothing left to test
    asked = warc.records(spark, archive).filter("payload_bytes > 100")
    assert _filters(asked) and asked.count() == 1
    assert warc.records(spark, archive).filter("refers_to IS NULL").count() + warc.records(spark, archive).filter("refers_to IS NOT NULL").count() == warc.records(spark, archive).count()
    assert warc.records(spark, archive).filter("file = 'elsewhere'").count() == 0


def test_every_predicate_answers_as_sql(spark, archive):
    plain = warc.records(spark, archive).cache()  # what Spark itself filters
    values = ["response", "revisit", "<urn:page:2>", "http://", None]
    lit = lambda v: "NULL" if v is None else f"'{v}'"
    for column in ("record_type", "target_uri", "refers_to"):
        for v in values:
            for test in ("{c} = {v}", "{c} <=> {v}", "{c} > {v}", "{c} <= {v}", "{c} IN ('revisit', {v})", "NOT {c} = {v}", "NOT {c} IN ('revisit', {v})", "startswith({c}, {v})", "NOT contains({c}, {v})", "endswith({c}, {v})"):
                condition = test.format(c=column, v=lit(v))
                assert warc.records(spark, archive, payload=False).filter(condition).count() == plain.filter(condition).count(), condition
    plain.unpersist()


def _walked(path, wanted, payload):
    with pafs.LocalFileSystem().open_input_file(path) as file:
        stream = warc.Gzip(file) if path.endswith(".gz") else warc.Plain(file)
        return list(warc.walk(stream, wanted, payload, True)), stream


@pytest.mark.parametrize("layout", ["members", "one member", "plain members", "plain"])
def test_unwanted_payloads_are_passed_over(tmp_path, layout):
    import gzip

    rnd = random.Random(5)
    payloads = [rnd.randbytes(n) for n in (0, 10, 300_000, 70_000, 5, 65_536, 1)]
    records = [warc.page_record("response" if i % 2 else "request", f"<urn:page:{i}>", None, None, p) for i, p in enumerate(payloads)]
    path = str(tmp_path / ("a.warc" if layout == "plain" else "a.warc.gz"))
    data = {"members": lambda: b"".join(map(warc.member, records)), "one member": lambda: gzip.compress(b"".join(records)), "plain members": lambda: b"".join(map(gzip.compress, records)), "plain": lambda: b"".join(records)}[layout]()
    open(path, "wb").write(data)
    for payload in (True, False):
        for keep in (lambda r: r["record_type"] == "response", lambda r: r["record_type"] == "request", lambda r: True, lambda r: False):
            got, stream = _walked(path, keep, payload)
            want = [(f"<urn:page:{i}>", len(p), p if payload else None) for i, p in enumerate(payloads) if keep({"record_type": "response" if i % 2 else "request"})]
            assert [(r["record_id"], r["payload_bytes"], r["payload"]) for r in got] == want
            assert stream.tell() == len(data)
    if layout == "members":
        assert _walked(path, lambda r: False, False)[1].passed > 200_000
        starts = [r["offset"] for r in _walked(path, lambda r: True, True)[0]]
        assert starts == [0, *itertools.accumulate(len(warc.member(r)) for r in records)][:-1]


def test_broken_archives_raise(tmp_path):
    good = warc.page_record("response", "<urn:page:1>", "u", None, b"payload")
    for name, data in (("cut.warc", good[:-8]), ("odd.warc", b"hello\r\n\r\n"), ("open.warc", good[:20]), ("wrong.warc", good.replace(b"payload", b"pAyload")), ("cut.warc.gz", warc.member(good)[:-20]), ("odd.warc.gz", b"hello, not a member of anything")):
        (tmp_path / name).write_bytes(data)
        with pytest.raises(ValueError):
            _walked(str(tmp_path / name), lambda r: True, True)


def test_files_are_planned_by_size(spark, pages, tmp_path):
    path = str(tmp_path / "many")
    pages_ = pages.unionAll(pages).unionAll(pages)
    warc.archived(pages_, path, file_bytes=1, least_bytes=1 << 40)
    files = {f for f in os.listdir(path)}
    assert len(files) == pages_.count() and warc.records(spark, path, split_bytes=1).rdd.getNumPartitions() == len(files)
    assert warc.records(spark, path).rdd.getNumPartitions() == 1
    assert warc.records(spark, path).filter("record_type = 'response'").count() == pages_.count()


def test_hot_keys_are_looked_up_by_broadcast(spark, monkeypatch):
    from lodestone.llm import common

    monkeypatch.setattr(common, "HOT_KEYS", 1)
    rows = spark.range(1000).select("id", F.when(F.col("id") < 600, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 7).cast("string"))).alias("key"))
    table = rows.groupBy("key").agg(F.max("id").alias("top"), F.count(F.lit(1)).alias("n")).filter("key <> 'k3'")
    got = looked_up(rows, table, "key", "n", F.xxhash64("id"))
    assert got.columns == ["id", "key", "top"]
    want = rows.join(table.drop("n"), "key", "left").select("id", "key", "top")
    assert sorted(got.collect()) == sorted(want.collect(), key=lambda r: r.id)


# ---- vector codes ----------------------------------------------------------------


def quantised(rows, parts=8, entries=16, rounds=6, scale=4096):
    """The contract in plain Python integers; rows: (vec_id, vector, label)."""
    rows = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    width = -(-max((len(v) for _, v, _ in rows), default=0) // parts) * parts
    ints = [[math.floor(Fraction(x) * scale) for x in v] + [0] * (width - len(v)) for _, v, _ in rows]
    step = width // parts
    cut = lambda v, p: tuple(v[p * step : (p + 1) * step])
    first = {}
    for (i, v, _), n in zip(rows, ints):
        if i not in first or list(v) < first[i][0]:
            first[i] = (list(v), n)
    seeds = [first[i][1] for i in sorted(first, key=lambda i: (i is None, i))[:entries]]
    books = [[list(cut(s, p)) for s in seeds] for p in range(parts)]
    near = lambda v, book: min((sum((a - b) ** 2 for a, b in zip(v, e)), k) for k, e in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            groups = {}
            for v in ints:
                groups.setdefault(near(cut(v, p), books[p])[1], []).append(cut(v, p))
            for k, g in groups.items():
                books[p][k] = [sum(c) // len(g) for c in zip(*g)]
    found = [[near(cut(v, p), books[p]) for p in range(parts)] for v in ints]
    error, by_label = [sum(d for d, _ in f) for f in found], Counter()
    for (_, _, label), e in zip(rows, error):
        by_label[label] += e
    text = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    top = 2**63 - 1
    return [(i, "".join(f"{k:02x}" for _, k in f), min(e, top), min(sum(min(x, top) for x, r in zip(error, rows) if r[2] == label), top), text) for (i, _, label), f, e in zip(rows, found, error)]


def vectors(seed, n=150, d=16, size=1.0):
    rnd = random.Random(seed)
    rows = [(rnd.randrange(10**6), [rnd.gauss(0, size) for _ in range(d)], rnd.choice([0, 0, 0, 1, None])) for _ in range(n)]
    rows += [rows[0], rows[0], (None, [1.0] * d, 1), (5, None, 0), (6, [None] + [0.0] * (d - 1), 0), (7, [float("nan")] * d, 0), (8, [float("inf")] * d, 0), (3, [0.5] * (d - 3), 1), (3, [0.25] * d, 1)]
    return rows


def coded(spark, rows, kind="double", **more):
    table = spark.createDataFrame(rows, f"vec_id bigint, embedding array<{kind}>, label int").withColumn("v", F.lit(1)).withColumn("code", F.lit(1)).withColumn("n", F.lit(1))
    return key(vector_codes.compressed(table, **more).collect())


@pytest.mark.parametrize("d, size", [(16, 1.0), (13, 0.01), (64, 1.0), (16, 40_000.0), (8, 1e15)])
def test_codes_equal_plain_integers(spark, d, size):
    rows = vectors(d, d=d, size=size)
    assert coded(spark, rows) == key(quantised(rows))


def test_codes_of_few_and_equal_rows(spark):
    assert coded(spark, []) == []
    for rows in ([(1, [0.5] * 8, None)], [(i, [0.25] * 8, 1) for i in range(40)], [(None, [float(i)] * 9, None) for i in range(3)], [(1, [], 1), (2, [], 1)], [(i, [1e30 * i] * 8, i) for i in range(5)]):
        assert coded(spark, rows) == key(quantised(rows)), rows


def test_codes_keep_other_shapes(spark):
    rows = vectors(9, n=60, d=12)
    assert coded(spark, rows, parts=3, entries=4, rounds=2, scale=100) == key(quantised(rows, 3, 4, 2, 100))


def test_rounds_send_one_row_a_component(spark):
    """What a task sends doesn't grow with its rows."""
    rows = spark.range(3000).select(F.col("id").alias("vec_id"), F.array(*[F.rand(i) for i in range(16)]).alias("v"))
    books, width = vector_codes.trained(rows.limit(100), rounds=1)
    assert vector_codes.sums(rows, books, 4096, width).count() == 8 * 16 * 2
