"""Exact top-k by inner product: columnar branch-and-bound.

Vectors become integers, floor(scale * x).  Queries and candidates are packed
into blocks of bounded size, candidates in vertical layout (one row a
dimension).  Every pair of blocks is one group; blocks are dealt out as whole
rows, so no row is built for a pair of vectors, and a block of queries is large,
so that candidates are shuffled few times.  Within a group each query meets the
candidates on its own.  Scores grow dimension block by dimension block, in order of
the query's own mass.  After a few blocks the leaders are scored whole, and their
k-th best score is the bound: a candidate survives while its partial score plus
the product of both remaining lengths (Cauchy-Schwarz on the remaining mass)
reaches it; the others are compacted away.  Each group gives at most k candidates a
query; the k best over all groups are chosen by a window of bounded size a query.

Sums stay exact: single precision while no sum can pass 2 ** 24, double while
none can pass 2 ** 53, else Python integers, held to the range of a long before
they are ranked.

Defined results: vectors that are null, or that hold a null or non-finite
component, take no part; a shorter vector counts as padded by zeros; an empty
vector scores 0; a query excludes the rows with its own id; ties go to the
smaller id.  Rows without an id take no part.  Repeated ids are separate
candidates; a query id that occurs more than once is searched with the smallest
of its vectors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SCALE, K = 64, 20
QUERY_BLOCK, CANDIDATE_BLOCK = 16_384, 8192
DIMENSION_BLOCK, SEED_BLOCKS, SEED_MASS, SEEDS, COMPACT = 4, 6, 0.6, 4, 0.9


def _matrix(vectors: pa.Array, scale: int) -> np.ndarray:
    """Rows of integers as float64 where exact, else as objects."""
    lengths = np.diff(vectors.offsets.to_numpy())
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    out = np.zeros((len(vectors), max(lengths.max(initial=0), 1)))
    out[np.repeat(np.arange(len(vectors)), lengths), np.concatenate([np.arange(n) for n in lengths]) if len(lengths) else []] = flat
    with np.errstate(over="ignore"):
        scaled = np.floor(out * scale)
    if not np.isfinite(scaled).all():
        return np.array([[int(x) * scale for x in row] for row in out], object)
    return scaled


def _packed(rows: DataFrame, blocks: int, block: int, scale: int, name: str) -> DataFrame:
    """Rows (block, ids, matrix, dimensions, kind) of at most 2 * `block` vectors, the matrix vertical."""
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("id", "v"), F.lit(blocks)).cast("int"))

    def pack(key, table):
        m, ids = _matrix(table["v"].combine_chunks(), scale), table["id"].to_numpy()
        out = []
        for s in range(0, len(ids), 2 * block):  # repeated rows share a block, which is cut here
            part = np.ascontiguousarray(m[s : s + 2 * block].T)
            kind = "O" if part.dtype == object else "<f4" if np.abs(part).max(initial=0) < 2**24 else "<f8"
            data = repr(part.tolist()).encode() if kind == "O" else part.astype(kind).tobytes()
            out.append((key[0].as_py(), ids[s : s + 2 * block].astype("<i8").tobytes(), data, part.shape[0], kind))
        types_ = (pa.int32(), pa.binary(), pa.binary(), pa.int32(), pa.string())
        return pa.table([pa.array(x, t) for x, t in zip(zip(*out), types_)], ["block", "ids", "matrix", "dimensions", "kind"])

    packed = dealt.groupBy("block").applyInArrow(pack, "block int, ids binary, matrix binary, dimensions int, kind string")
    return packed.select(*[F.col(c).alias(f"{name}_{c}") for c in packed.columns])


def _unpacked(ids: bytes, matrix: bytes, dimensions: int, kind: str) -> tuple[np.ndarray, np.ndarray]:
    if kind == "O":
        import ast

        return np.frombuffer(ids, "<i8"), np.array(ast.literal_eval(matrix.decode()), object).reshape(dimensions, -1)
    return np.frombuffer(ids, "<i8"), np.frombuffer(matrix, kind).astype(np.float64).reshape(dimensions, -1)


def best_of_block(q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int, seen: list[int] | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query: its id, and ids and scores of its k best in the block.

    q and c are vertical: dimensions x rows.  `seen`, if given, gets the number
    of products of one dimension that were made.
    """
    d = max(len(q), len(c))
    q, c = (np.vstack([m, np.zeros((d - len(m), m.shape[1]), m.dtype)]) for m in (q, c))
    if q.dtype == object or c.dtype == object:
        yield from _plain(q_ids, q.astype(object), c_ids, c.astype(object), k)
        return
    bound = np.sqrt((q * q).sum(axis=0).max(initial=0) * (c * c).sum(axis=0).max(initial=0))
    if bound >= 2.0**52:
        yield from _plain(q_ids, _integers(q), c_ids, _integers(c), k)
        return
    kind = np.float32 if bound < 2.0**23 and max(np.abs(q).max(initial=0), np.abs(c).max(initial=0)) < 2.0**23 else np.float64
    q, c = q.astype(kind), np.ascontiguousarray(c, kind)
    cuts = range(0, d, DIMENSION_BLOCK)
    blocks = [c[s : s + DIMENSION_BLOCK] for s in cuts]
    # Squared lengths are sums of integers, exact in single precision too where kind allows it.
    mass = np.stack([(x * x).sum(axis=0) for x in blocks])
    energy, whole = mass.mean(axis=1) if len(c_ids) else np.zeros(len(blocks)), mass.sum(axis=0)
    for j in range(len(q_ids)):
        own = [q[s : s + DIMENSION_BLOCK, j] for s in cuts]
        lengths = np.array([(x.astype(np.float64) ** 2).sum() for x in own])
        order = np.argsort(-lengths * energy, kind="stable")  # the query's heaviest blocks first
        # Remaining lengths are rounded up a little so that no bound is too low.
        rest_q = (np.sqrt(np.cumsum(lengths[order][::-1])[::-1]) * (1 + 1e-5)).astype(kind)
        itself = c_ids == q_ids[j]
        # The leaders are chosen once most of the mass is in, after SEED_BLOCKS blocks at the latest.
        got = np.cumsum((lengths * energy)[order])
        seed = min(SEED_BLOCKS, int((got < SEED_MASS * got[-1]).sum()) + 1, len(order) - 1)
        alive, part, rest, low = None, np.zeros(len(c_ids), kind), whole.copy(), -np.inf
        for i, at in enumerate(order):
            if i == seed:
                part[itself] = -np.inf
                if len(part) - itself.sum() > SEEDS * k:
                    # The leaders so far are scored whole: their k-th best score is the bound to begin with.
                    lead = np.argpartition(-part, SEEDS * k)[: SEEDS * k]
                    low = np.partition(q[:, j] @ c[:, lead], -k)[-k]
                    if seen is not None:
                        seen.append(len(lead) * d)
            if low > -np.inf:
                keep = np.flatnonzero(part + rest_q[i] * np.sqrt(rest) >= low)
                if len(keep) < COMPACT * len(part):
                    alive, part, rest = keep if alive is None else alive[keep], part[keep], rest[keep]
            part += own[at] @ (blocks[at] if alive is None else blocks[at].take(alive, axis=1))
            rest -= mass[at] if alive is None else mass[at].take(alive)
            if seen is not None:
                seen.append(len(part) * len(own[at]))
        ids = c_ids if alive is None else c_ids[alive]
        fit = np.flatnonzero(part > -np.inf)
        if len(fit) > k:
            fit = fit[part[fit] >= np.partition(part[fit], -k)[-k]]
        ids, score = ids[fit], part[fit].astype(np.float64)
        first = np.lexsort((ids, -score))[:k]
        yield int(q_ids[j]), ids[first], score[first].astype(np.int64)


def _integers(m: np.ndarray) -> np.ndarray:
    return np.array([[int(x) for x in row] for row in m], object).reshape(m.shape)


def _plain(q_ids, q, c_ids, c, k):
    low, high = -(2**63), 2**63 - 1
    for j in range(len(q_ids)):
        scores = [min(max(int(x), low), high) for x in (q[:, j] @ c if len(q) else [0] * len(c_ids))]
        rows = sorted((-s, int(i)) for s, i in zip(scores, c_ids) if i != q_ids[j])[:k]
        yield int(q_ids[j]), np.array([i for _, i in rows], np.int64), np.array([-s for s, _ in rows], np.int64)


def top_k(vectors: DataFrame, is_query: Column, vec_id: str = "vec_id", embedding: str = "embedding", k: int = K, scale: int = SCALE, query_block: int = QUERY_BLOCK, candidate_block: int = CANDIDATE_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows for each row for which `is_query` holds."""
    v = F.col(embedding)
    usable = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.col(vec_id).isNotNull()
    rows = vectors.filter(usable).select(F.col(vec_id).cast("bigint").alias("id"), v.cast("array<double>").alias("v"), is_query.alias("q"))
    sizes = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if("q").alias("q")).first()
    n_q, n_c = max(1, -(-sizes.q // query_block)), max(1, -(-sizes.n // candidate_block))
    queries = _packed(rows.filter("q").groupBy("id").agg(F.min("v").alias("v")), n_q, query_block, scale, "q")
    candidates = _packed(rows.select("id", "v"), n_c, candidate_block, scale, "c")
    # Every block of queries meets every block of candidates: both are dealt out by the pair of block numbers.
    left = queries.withColumn("c_block", F.explode(F.sequence(F.lit(0), F.lit(n_c - 1))))
    right = candidates.withColumn("q_block", F.explode(F.sequence(F.lit(0), F.lit(n_q - 1))))
    names = [f"{x}_{y}" for x in "qc" for y in ("ids", "matrix", "dimensions", "kind")]
    pairs = left.join(right, ["q_block", "c_block"]).select(*names)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                row = [c[i].as_py() for c in b.columns]
                found = list(best_of_block(*_unpacked(*row[:4]), *_unpacked(*row[4:]), k))
                owner = np.repeat([q for q, _, _ in found], [len(x) for _, x, _ in found]).astype(np.int64)
                ids, scores = (np.concatenate([x[n] for x in found] or [[]]).astype(np.int64) for n in (1, 2))
                yield pa.RecordBatch.from_arrays([pa.array(owner), pa.array(ids), pa.array(scores)], ["query_id", "vec_id", "score"])

    found = pairs.mapInArrow(search, "query_id bigint, vec_id bigint, score bigint")
    best = W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
