"""Quality classifier: random-indexing word vectors and a two-layer network.

Every word, and every word's shape (runs of capitals, small letters, digits and
each other character), falls into one of 2 ** BITS buckets.  A bucket has a
sparse random index vector; its word vector adds up the index vectors of its
neighbours in the sample texts (random indexing), so words in like company have
like vectors.  A document is the mean of its words' vectors beside the mean of
its shapes' vectors.  A network with one hidden layer, trained in numpy, gives a
logit, and a temperature fitted on rows set aside turns it into a probability.

The model is fitted on a bounded sample of the labelled learning rows (at most
`max_rows`, drawn by a hash of the id); what is broadcast (vectors and weights)
has a fixed size.  Every row of the input is scored, without a shuffle.

Defined results: null or empty texts have the zero vector and get the score the
network gives it; a document labelled more than once counts with its highest
label, null labels are left out; without labels every score is 0.5, with labels
of one class only it is their mean.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import worker_cache, written

BITS, DIMENSIONS, NONZERO, WINDOW = 14, 64, 4, 2
MAX_ROWS, SAMPLE_PARTS, MAX_SHAPES_CACHED = 16_000, 16, 100_000
HIDDEN, EPOCHS, BATCH, RATE, DECAY = 32, 40, 128, 3e-3, 1e-4
THRESHOLD = 0.3
CHUNK = 8_192


#: Letters to a or A (bytes of other scripts count as a), digits to 0.
_CLASSES = bytes(65 if 65 <= i <= 90 else 97 if 97 <= i <= 122 or i >= 128 else 48 if 48 <= i <= 57 else i for i in range(256))


def _ids(text: str | None) -> tuple[list[int], list[int]]:
    """Buckets of the words of a text, and of their shapes.

    A word that repeats the one before it has a shape of its own.
    """
    from xxhash import xxh3_64_intdigest as h

    shift, known = 64 - BITS, worker_cache("quality shapes")
    data = (text or "").encode("utf-8", "surrogatepass")
    words = data.split()
    shapes = re.sub(rb"([aA0!-/:-@])\1+", rb"\1", data.translate(_CLASSES)).split()
    if len(known) > MAX_SHAPES_CACHED:
        known.clear()
    for x in set(shapes) - known.keys():
        known[x] = h(x, 1) >> shift
    again = h(b"again", 2) >> shift
    first = [again if a == b else known[s] for a, b, s in zip(words[1:], words, shapes[1:])]
    return [h(w) >> shift for w in words], [known[s] for s in shapes[:1]] + first


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """For each bucket: NONZERO places and their signs; a fixed function of the bucket.

    One more bucket, which adds nothing, stands between documents.
    """
    rng = np.random.default_rng(10)
    n = 1 << BITS
    places, signs = rng.integers(0, DIMENSIONS, (n, NONZERO)), rng.choice([-1.0, 1.0], (n, NONZERO))
    return np.vstack([places, places[:1]]), np.vstack([signs, np.zeros((1, NONZERO))])


def _add_contexts(sums: np.ndarray, ids: list[int], places: np.ndarray, signs: np.ndarray) -> None:
    x = np.asarray(ids, np.int64)
    for d in range(1, WINDOW + 1):
        for a, b in ((x[:-d], x[d:]), (x[d:], x[:-d])):
            for k in range(NONZERO):
                sums += np.bincount(a * DIMENSIONS + places[b, k], signs[b, k], len(sums))


def word_vectors(sample: DataFrame, text: str) -> np.ndarray:
    """Vectors of all buckets from the texts of a bounded sample."""
    places, signs = index_vectors()
    n, step = 1 << BITS, 1 << (BITS - 4)

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, held = np.zeros((n + 1) * DIMENSIONS), ([], [])
        for b in batches:
            for t in b.column(0).to_pylist():
                for ids, new in zip(held, _ids(t)):
                    ids += new + [n] * WINDOW
                if len(held[0]) > 200_000:
                    for ids in held:
                        _add_contexts(sums, ids, places, signs)
                    held = ([], [])
        for ids in held:
            if ids:
                _add_contexts(sums, ids, places, signs)
        for s in range(0, n, step):
            part = sums[s * DIMENSIONS : (s + step) * DIMENSIONS]
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([part.astype(np.float32).tobytes()], pa.binary())], ["start", "sums"])

    def add(key, rows):
        total = sum(np.frombuffer(x.as_buffer(), np.float32).astype(np.float64) for x in rows["sums"])
        return pa.table([pa.array([key[0].as_py()], pa.int32()), pa.array([total.astype(np.float32).tobytes()], pa.binary())], ["start", "sums"])

    schema = "start int, sums binary"
    contexts = np.zeros((n, DIMENSIONS), np.float32)
    for r in sample.select(text).mapInArrow(collect, schema).groupBy("start").applyInArrow(add, schema).collect():  # 16 rows
        part = np.frombuffer(r.sums, np.float32).reshape(-1, DIMENSIONS)
        contexts[r.start : r.start + len(part)] = part
    own = np.zeros((n, DIMENSIONS), np.float32)
    for k in range(NONZERO):
        own[np.arange(n), places[:n, k]] += signs[:n, k]
    unit = lambda v: v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
    return unit(unit(contexts) + unit(own)).astype(np.float32)


def pooled(texts: list[str | None], vectors: np.ndarray) -> np.ndarray:
    """One row a text: mean word vector, mean shape vector, log of the word count, share of distinct words."""
    out = np.zeros((len(texts), 2 * DIMENSIONS + 2), np.float32)
    for i, t in enumerate(texts):
        words, shapes = (np.array(x, np.int64) for x in _ids(t))
        n = max(len(words), 1)
        for s in range(0, len(words), CHUNK):
            out[i, :DIMENSIONS] += vectors[words[s : s + CHUNK]].sum(axis=0) / n
        kinds, counts = np.unique(shapes, return_counts=True)
        out[i, DIMENSIONS:-2] = (counts / n) @ vectors[kinds]
        out[i, -2:] = np.log1p(len(words)), len(np.unique(words)) / n
    return out


def fitted(x: np.ndarray, y: np.ndarray, seed: int = 10) -> dict:
    """Weights, input scale and temperature of the network."""
    if not len(y) or y.min() == y.max():
        return {"constant": float(y.mean()) if len(y) else 0.5}
    rng = np.random.default_rng(seed)
    aside = np.arange(len(y)) % 5 == 4
    if aside.sum() < 10 or len(set(y[~aside])) < 2:
        aside[:] = False
    mean, scale = x[~aside].mean(axis=0), x[~aside].std(axis=0) + 1e-3
    z, t = (x - mean) / scale, y.astype(np.float64)
    d = z.shape[1]
    w = [rng.normal(0, 1 / np.sqrt(d), (d, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
    m, v, step = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w], 0
    rows = np.flatnonzero(~aside)
    for _ in range(EPOCHS):
        order = rng.permutation(rows)
        for s in range(0, len(order), BATCH):
            b = order[s : s + BATCH]
            h = np.tanh(z[b] @ w[0] + w[1])
            p = 1 / (1 + np.exp(-np.clip(h @ w[2] + w[3], -30, 30)))
            g = (p - t[b]) / len(b)
            gh = np.outer(g, w[2]) * (1 - h * h)
            grads = [z[b].T @ gh + DECAY * w[0], gh.sum(axis=0), h.T @ g + DECAY * w[2], np.array([g.sum()])]
            step += 1
            for k, a in enumerate(grads):
                m[k] += 0.1 * (a - m[k])
                v[k] += 0.001 * (a * a - v[k])
                w[k] -= RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    model = {"mean": mean, "scale": scale, "w": w, "temperature": 1.0}
    held = aside if aside.any() else ~aside
    logit, truth = _logits(x[held], model), t[held]
    loss = lambda c: np.mean(np.logaddexp(0, logit / c) - truth * logit / c)
    model["temperature"] = float(min(np.geomspace(0.5, 10, 60), key=loss))
    return model


def _logits(x: np.ndarray, model: dict) -> np.ndarray:
    w = model["w"]
    return np.tanh((x - model["mean"]) / model["scale"] @ w[0] + w[1]) @ w[2] + w[3]


def probability(x: np.ndarray, model: dict) -> np.ndarray:
    if "constant" in model:
        return np.full(len(x), model["constant"])
    return 1 / (1 + np.exp(-np.clip(_logits(x, model) / model["temperature"], -30, 30)))


def trained(docs: DataFrame, labels: DataFrame, usable: Column, text: str, doc_id: str, label: str, max_rows: int = MAX_ROWS) -> tuple[np.ndarray, dict]:
    """Word vectors and network; `usable` tells learning rows by the column doc_id."""
    known = labels.select(F.col(doc_id).alias("doc_id"), F.col(label).cast("double").alias("label")).filter(usable & F.col("label").isNotNull())
    known = known.groupBy("doc_id").agg(F.max("label").alias("label"))
    n = known.count()
    unit = F.shiftrightunsigned(F.xxhash64(F.lit(10), "doc_id"), 11).cast("double") / F.lit(float(2**53))
    chosen = known.filter(unit < min(1.0, max_rows / max(n, 1)))  # about max_rows rows of two numbers
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).join(F.broadcast(chosen), "doc_id")
    sample = written(rows.repartition(SAMPLE_PARTS, "doc_id"), "quality")
    vectors = word_vectors(sample, "text")
    shared = docs.sparkSession.sparkContext.broadcast(vectors)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = pooled(b.column(2).to_pylist(), shared.value)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([r.tobytes() for r in x], pa.binary())], ["doc_id", "label", "x"])

    id_type = sample.schema["doc_id"].dataType.simpleString()
    got = sample.select("doc_id", "label", "text").mapInArrow(features, f"doc_id {id_type}, label double, x binary").collect()  # the bounded sample: half a KB a row
    got.sort(key=lambda r: (r.doc_id, r.x))
    x = np.array([np.frombuffer(r.x, np.float32) for r in got], np.float64).reshape(len(got), 2 * DIMENSIONS + 2)
    return vectors, fitted(x, np.array([float(r.label > 0) for r in got]))


def scored(docs: DataFrame, vectors: np.ndarray, model: dict, text: str = "text", keep: tuple[str, ...] = ("doc_id",), threshold: float = THRESHOLD) -> DataFrame:
    """The kept columns, score and predicted of every row."""
    shared = docs.sparkSession.sparkContext.broadcast((vectors, model))
    narrow = docs.select(*keep, F.col(text).alias("_text"))
    kept = narrow.drop("_text").schema
    names = [*kept.names, "score"]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors, model = shared.value
        for b in batches:
            p = probability(pooled(b.column(b.num_columns - 1).to_pylist(), vectors).astype(np.float64), model)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(p, pa.float64())], names)

    ddl = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + ["score double"])
    return narrow.mapInArrow(score, ddl).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def classified(docs: DataFrame, labels: DataFrame, held_out, text: str = "text", doc_id: str = "doc_id", label: str = "quality", max_rows: int = MAX_ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted); `held_out` maps an id column to a Boolean column."""
    vectors, model = trained(docs, labels, ~held_out(F.col("doc_id")), text, doc_id, label, max_rows)
    tagged = docs.select(F.col(doc_id).alias("doc_id"), held_out(F.col(doc_id)).alias("held_out"), F.col(text).alias("_t"))
    return scored(tagged, vectors, model, "_t", ("doc_id", "held_out"))
