"""Language identification: multinomial naive Bayes over hashed character n-grams.

Texts are lower-cased and every character that isn't a letter becomes a space.
All 1- to 4-grams of code points fall into 2 ** BITS buckets by a multiplicative
hash, computed for a whole batch of texts in numpy.  Training adds up bucket
counts per language over a bounded sample of the learning rows (at most
`max_rows` a language, drawn by a hash of the id; a rarer language keeps all its
rows).  Every language is learned.  The matrix of log probabilities is broadcast;
it has 2 ** b floats a language, where b is BITS for up to 256 languages and one
less each time their number doubles, so it holds 64 MB whatever the corpus (past
2 ** 16 languages b stays at 8 and the matrix grows by 1 KB a language).

The score is the winner's share of the posterior of the mean n-gram, sharpened to
SHARPNESS n-grams: that of a whole document would be 1 up to rounding for nearly
every text, however close its two best languages are.  The winner is the same.

Defined results: a text that is null or has no letter gives `und` with score 0;
if nothing can be learned, every text does.  Ties go to the language that comes
first by code point.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import worker_cache, written

BITS, ORDERS, SMOOTHING = 16, (1, 2, 3, 4), 0.5
MAX_ROWS = 15_000  # of each language that the model learns from
SHARPNESS = 24  # n-grams whose evidence makes the score
UNKNOWN = "und"
CHUNK = 1_000_000  # characters handled at once


def _letters() -> np.ndarray:
    """For every code point: itself if it is a letter, else a space."""
    held = worker_cache("letters")
    if "table" not in held:
        table = np.full(0x110000, 32, np.uint32)
        for i in range(0x110000):
            if not 0xD800 <= i < 0xE000 and chr(i).isalpha():
                table[i] = i
        held["table"] = table
    return held["table"]


def _codes(text: str | None) -> np.ndarray:
    lower = (text or "").lower().encode("utf-32-le", "surrogatepass")
    return _letters()[np.frombuffer(lower, np.uint32)]


def _buckets(codes: np.ndarray, bits: int) -> list[np.ndarray]:
    """For each order, the bucket of the n-gram that starts at each place.

    Places are those of a text with a space put before and after it.
    """
    out, h = [], np.zeros(len(codes), np.uint64)
    x = codes.astype(np.uint64)
    for n in range(1, max(ORDERS) + 1):
        h = h[: len(codes) - n + 1] * np.uint64(0x9E3779B97F4A7C15) + x[n - 1 :] + np.uint64(n)
        if n in ORDERS:
            mixed = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            out.append((mixed >> np.uint64(64 - bits)).astype(np.int64))
    return out


def _pieces(codes: np.ndarray) -> Iterator[np.ndarray]:
    """Chunks of a text that overlap so that no n-gram is lost or counted twice."""
    yield codes[:CHUNK]
    for i in range(CHUNK, len(codes), CHUNK):
        yield codes[i - max(ORDERS) + 1 : i + CHUNK]


def bits_for(languages: int) -> int:
    """Buckets, as a power of two, that keep the model bounded."""
    return max(BITS - max(int(np.ceil(np.log2(max(languages, 1)))) - 8, 0), 8)


def _counts(codes: np.ndarray, bits: int) -> np.ndarray:
    total = np.zeros(1 << bits, np.int64)
    for k, part in enumerate(_pieces(codes)):
        for n, b in zip(ORDERS, _buckets(part, bits)):
            total += np.bincount(b[max(ORDERS) - n if k else 0 :], minlength=1 << bits)
    return total


def trained(rows: DataFrame, text: str, label: str, bits: int | None = None, max_rows: int = MAX_ROWS, order: str = "doc_id") -> tuple[list[str], np.ndarray]:
    """Languages by code point, and their log probabilities (languages x buckets)."""
    usable = rows.select(F.col(label).cast("string").alias("label"), F.col(text).alias("text"), F.xxhash64(F.lit(3), F.col(order)).alias("h")).filter("label is not null and text is not null")
    share = written(usable.groupBy("label").count().select("label", F.least(F.lit(1.0), F.lit(float(max_rows)) / F.col("count")).alias("share")), "languages")
    unit = F.shiftrightunsigned("h", 11).cast("double") / F.lit(float(2**53))
    languages = sorted(r.label for r in share.select("label").collect())  # the classes of the model, one row a language
    bits = bits or bits_for(len(languages))
    if not languages:
        return [], np.zeros((0, 1 << bits), np.float32)
    number = {x: i for i, x in enumerate(languages)}
    sample = usable.join(share, "label").filter(unit < F.col("share")).select("label", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for name, t in zip(b.column(0).to_pylist(), b.column(1)):
                i = number[name]
                sums[i] = sums.get(i, 0) + _counts(_padded(t.as_py()), bits)
        step = 1 << 12  # a slice of a language's counts: bounded rows, summed in parallel
        for i, row in sums.items():
            for s in range(0, 1 << bits, step):
                part = row[s : s + step]
                if part.any():
                    yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([s], pa.int32()), pa.array([part.tobytes()], pa.binary())], ["label", "start", "counts"])

    def add(key, rows):
        total = sum(np.frombuffer(x.as_buffer(), np.int64) for x in rows["counts"])
        return pa.table([pa.array([key[0].as_py()], pa.int32()), pa.array([key[1].as_py()], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["label", "start", "counts"])

    schema = "label int, start int, counts binary"
    summed = sample.mapInArrow(count, schema).groupBy("label", "start").applyInArrow(add, schema)
    matrix = np.zeros((len(languages), 1 << bits), np.float64)
    for r in summed.collect():  # at most languages x 16 rows of 32 KB
        part = np.frombuffer(r.counts, np.int64)
        matrix[r.label, r.start : r.start + len(part)] = part
    matrix += SMOOTHING
    return languages, np.log(matrix / matrix.sum(axis=1, keepdims=True)).astype(np.float32)


def _padded(text: str | None) -> np.ndarray:
    return np.concatenate([[np.uint32(32)], _codes(text), [np.uint32(32)]]).astype(np.uint32)


def _scored(texts, model: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log likelihoods (texts x languages), whether a text has a letter, and its number of n-grams."""
    columns, most, unused = model.shape[0], max(ORDERS), model.shape[1]
    padded = np.hstack([model, np.zeros((columns, 1), model.dtype)])  # one more bucket, which adds nothing
    sums, has, grams = np.zeros((len(texts), columns)), np.zeros(len(texts), bool), np.zeros(len(texts), np.int64)
    group, places, skips, size = [], [], [], 0

    def flush():
        nonlocal group, places, skips, size
        if not group:
            return
        codes, skip = np.concatenate(group), np.array(skips)
        ends = np.cumsum([len(x) for x in group])
        cuts = ends - [len(x) for x in group]
        for n, b in zip(ORDERS, _buckets(codes, bits)):
            # n-grams that reach into the next text, or that the piece before had, don't count
            use = np.zeros(len(codes) + 1, np.int64)
            first, last = np.minimum(cuts + np.where(skip, most - n, 0), ends), ends - n + 1
            some = last > first
            use[first[some]] += 1
            use[last[some]] -= 1
            b = np.where(np.cumsum(use)[: len(b)] > 0, b, unused)
            np.add.at(grams, places, np.where(some, last - first, 0))
            for c in range(columns):
                value = np.zeros(len(codes))
                value[: len(b)] = padded[c][b]
                np.add.at(sums[:, c], places, np.add.reduceat(value, cuts))
        group, places, skips, size = [], [], [], 0

    for i, t in enumerate(texts):
        codes = _padded(t)
        if (codes != 32).any():
            has[i] = True
            for k, part in enumerate(_pieces(codes)):
                group.append(part)
                places.append(i)
                skips.append(k > 0)
                size += len(part)
                if size >= CHUNK:
                    flush()
    flush()
    return sums, has, grams


def predicted(docs: DataFrame, languages: list[str], model: np.ndarray, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns, lang_pred and score of every row; no shuffle."""
    bits = int(model.shape[1]).bit_length() - 1
    shared = docs.sparkSession.sparkContext.broadcast((languages, model))
    narrow = docs.select(*[F.col(c) for c in keep], F.col(text).alias("_text"))
    from pyspark.sql.pandas.types import to_arrow_schema

    kept = narrow.drop("_text")
    names = list(to_arrow_schema(kept.schema).names) + ["lang_pred", "score"]
    ddl = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema] + ["lang_pred string", "score double"])

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages, model = shared.value
        for b in batches:
            sums, has, grams = _scored(b.column(b.num_columns - 1).to_pylist(), model, bits)
            if languages:
                mean = sums * (np.minimum(grams, SHARPNESS) / np.maximum(grams, 1))[:, None]
                odds = np.exp(mean - mean.max(axis=1, keepdims=True))
                best, score = sums.argmax(axis=1), odds.max(axis=1) / odds.sum(axis=1)
                names_ = [languages[k] if h else UNKNOWN for k, h in zip(best, has)]
                score = np.where(has, score, 0.0)
            else:
                names_, score = [UNKNOWN] * b.num_rows, np.zeros(b.num_rows)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(names_, pa.string()), pa.array(score, pa.float64())], names)

    return narrow.mapInArrow(predict, ddl)


def identified(docs: DataFrame, held_out: Column, text: str = "text", label: str = "lang", doc_id: str = "doc_id", max_rows: int = MAX_ROWS) -> DataFrame:
    """(doc_id, held_out, lang_pred, score): learns from the rows that aren't held out."""
    languages, model = trained(docs.filter(~held_out), text, label, max_rows=max_rows, order=doc_id)
    tagged = docs.select(F.col(doc_id).alias("doc_id"), held_out.alias("held_out"), F.col(text).alias("_t"))
    return predicted(tagged, languages, model, "_t", ("doc_id", "held_out"))
