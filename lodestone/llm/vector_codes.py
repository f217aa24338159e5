"""Vector code compression: product quantisation with integer codebooks.

A vector becomes integers, floor(scale * x), and is cut into equal consecutive
parts; each part is coded by its nearest codebook entry.  The codebook of a part
starts as that part of the vectors with the smallest ids and is refined in a
fixed number of rounds.

In a round every task holds the codebooks (entries x dimensions integers, whatever
the size of the table).  All squared distances of an Arrow batch come from
|x - c|^2 = |x|^2 - 2 x.c + |c|^2 with exact int64 matrix products; |x|^2 is the
same for all entries, so the first argmin of |c|^2 - 2 x.c is the nearest entry
with the lowest index.  A task sends one sum and count an entry, however many
rows it has; a grouped shuffle merges them, and the driver gets one row a codebook
component.  Entries are floors of exact quotients; unused ones stay.

Integers stay exact: int64 while no component reaches 2 ** 27 in size and a part's
squared distance can't pass 2 ** 62, else Python integers; sums travel in limbs of
30 bits that are added as decimals.

Defined results: vectors that are null or hold a null or non-finite component are
dropped; shorter ones count as padded by zeros, as does a length that isn't a
multiple of the number of parts; a vector whose id is null is coded, and is a
seed only after all that have one; repeated ids seed with the smallest of their
vectors and are all coded; with fewer ids than entries the codebooks are smaller;
equal entries keep their places, of which the first is used.  An `error` beyond a
long is held to its largest value, as are sums of them.  Columns of other names take
no part.  An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import looked_up, written

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
SMALL, LIMB, MOST = 2**27, 30, 2**63 - 1
BATCH = 4096

Codebooks = list[list[list[int]]]  # part, entry, position


def integers(vectors: pa.Array, scale: int, width: int) -> np.ndarray:
    """Rows of `width` integers: int64 if small, else Python integers."""
    lengths = np.diff(vectors.offsets.to_numpy())
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    out = np.zeros((len(vectors), width))
    row = np.repeat(np.arange(len(vectors)), lengths)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    with np.errstate(over="ignore"):
        scaled = np.floor(out * scale)
    if np.abs(scaled).max(initial=0) < SMALL:
        return scaled.astype(np.int64)
    exact = np.zeros(out.shape, object)
    for at, x in np.ndenumerate(out):
        numerator, denominator = x.as_integer_ratio()
        exact[at] = numerator * scale // denominator
    return exact


def nearest(part: np.ndarray, book: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Index and squared distance of the nearest entry of each row."""
    small = part.dtype != object and max((abs(x) for e in book for x in e), default=0) < SMALL and part.shape[1] * (2 * SMALL) ** 2 < 2**62
    kind = np.int64 if small else object
    entries, x = np.array(book, dtype=kind).reshape(len(book), part.shape[1]), part.astype(kind)
    partial = (entries * entries).sum(axis=1)[None, :] - 2 * (x @ entries.T)
    index = partial.argmin(axis=1) if partial.shape[1] else np.zeros(len(x), np.int64)
    return index, np.take_along_axis(partial, index[:, None], axis=1)[:, 0] + (x * x).sum(axis=1)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for s in range(0, b.num_rows, BATCH):
            yield b.slice(s, BATCH)


def _limbs(x: int) -> Iterator[tuple[int, int]]:
    k = 0
    while -(2**62) > x or x >= 2**62:
        yield k, x & (1 << LIMB) - 1
        x, k = x >> LIMB, k + 1
    yield k, x


def sums(rows: DataFrame, books: Codebooks, scale: int, width: int) -> DataFrame:
    """(part, entry, place, limb, n, total): members and component sums of every used entry."""
    step = width // len(books)

    def partial(batches):
        total, count = np.zeros((len(books), len(books[0]), step), object), np.zeros((len(books), len(books[0])), np.int64)
        for b in _pieces(batches):
            m = integers(b.column(0), scale, width)
            for p, book in enumerate(books):
                own = m[:, p * step : (p + 1) * step]
                index, _ = nearest(own, book)
                order = np.argsort(index, kind="stable")
                used, at = np.unique(index[order], return_index=True)
                if step:
                    total[p, used] += np.add.reduceat(own[order], at, axis=0).astype(object)
                count[p] += np.bincount(index, minlength=len(book))
        out = [(p, e, i, k, int(count[p, e]), v) for p, e in zip(*np.nonzero(count)) for i in range(step) for k, v in _limbs(int(total[p, e, i]))]
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in out], t) for j, t in enumerate(kinds)], ["part", "entry", "place", "limb", "n", "total"])

    found = rows.select("v").mapInArrow(partial, "part int, entry int, place int, limb int, n bigint, total bigint")
    return found.groupBy("part", "entry", "place", "limb").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))


def refined(books: Codebooks, merged: list) -> Codebooks:
    """Every used entry replaced by the floor of its mean."""
    count: dict[tuple, int] = {}
    total: dict[tuple, int] = {}
    for r in merged:
        at = (r.part, r.entry, r.place)
        total[at] = total.get(at, 0) + (int(r.total) << LIMB * r.limb)
        count[at] = max(count.get(at, 0), r.n)  # limb 0 has all members; a higher limb those of large sums
    return [[[total[p, e, i] // count[p, e, i] if (p, e, i) in total else x for i, x in enumerate(entry)] for e, entry in enumerate(book)] for p, book in enumerate(books)]


def usable(vectors: DataFrame, vec_id: str, embedding: str, label: str) -> DataFrame:
    v = F.col(f"`{embedding}`")
    fine = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    # A key of labels that is never null: null gives "n", a value "v" and its text.
    key = F.coalesce(F.concat(F.lit("v"), F.col(f"`{label}`").cast("string")), F.lit("n"))
    return vectors.filter(fine).select(F.col(f"`{vec_id}`").alias("vec_id"), v.cast("array<double>").alias("v"), key.alias("label"))


def first_vectors(rows: DataFrame, n: int) -> pa.Array:
    """The vectors of the n smallest ids, nulls last; a task sends n ids at most, then those rows alone meet."""

    def least(batches):
        held = None
        for b in batches:
            both = pa.concat_arrays([b.column(0)] if held is None else [held, b.column(0)]).unique()
            held = both.take(pc.sort_indices(both, null_placement="at_end")[:n])
        if held is not None:
            yield pa.RecordBatch.from_arrays([held], ["vec_id"])

    ids = rows.select("vec_id").mapInArrow(least, rows.select("vec_id").schema).distinct().orderBy(F.col("vec_id").asc_nulls_last()).limit(n).collect()
    known = [r.vec_id for r in ids if r.vec_id is not None]
    own = F.col("vec_id").isin(known) | (F.col("vec_id").isNull() if len(known) < len(ids) else F.lit(False))
    return rows.filter(own).groupBy("vec_id").agg(F.min("v").alias("v")).orderBy(F.col("vec_id").asc_nulls_last()).select("v").toArrow()["v"].combine_chunks()


def trained(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[Codebooks, int]:
    """Codebooks of rows (vec_id, v), and the padded number of dimensions."""
    longest = rows.agg(F.max(F.size("v"))).first()[0] or 0
    width = -(-longest // parts) * parts
    seeds = first_vectors(rows, entries)
    m = integers(seeds, scale, width) if len(seeds) else np.zeros((0, width), np.int64)
    step = width // parts
    books = [[[int(x) for x in row[p * step : (p + 1) * step]] for row in m] for p in range(parts)]
    for _ in range(rounds if len(m) else 0):
        books = refined(books, sums(rows, books, scale, width).collect())
    return books, width


def coded(rows: DataFrame, books: Codebooks, width: int, scale: int = SCALE) -> DataFrame:
    """Rows (vec_id, v, label) -> (vec_id, label, code, error)."""
    step = width // len(books)
    kind = rows.schema["vec_id"].dataType.simpleString()

    def assign(batches):
        for b in _pieces(batches):
            m = integers(b.column(1), scale, width)
            found = [nearest(m[:, p * step : (p + 1) * step], book) for p, book in enumerate(books)] if len(m) else []
            errors = [min(int(x), MOST) for x in sum((d for _, d in found), np.zeros(len(m), object))]
            codes = ["".join(f"{i:02x}" for i in row) for row in zip(*[i for i, _ in found])]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(codes, pa.string()), pa.array(errors, pa.int64())], ["vec_id", "label", "code", "error"])

    return rows.select("vec_id", "v", "label").mapInArrow(assign, f"vec_id {kind}, label string, code string, error bigint")


def digest(books: Codebooks) -> str:
    return hashlib.sha256(",".join(str(x) for book in books for entry in book for x in entry).encode()).hexdigest()


def compressed(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of every usable row."""
    rows = written(usable(vectors, vec_id, embedding, label), "vectors")
    books, width = trained(rows, parts, entries, rounds, scale)
    done = written(coded(rows, books, width, scale), "codes")
    held = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(MOST).cast("decimal(38,0)")).cast("bigint")
    by_label = done.groupBy("label").agg(held.alias("label_error"), F.count(F.lit(1)).alias("n"))
    both = looked_up(done, by_label, "label", "n", F.xxhash64("vec_id", "code"))
    return both.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
