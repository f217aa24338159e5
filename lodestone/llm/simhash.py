"""SimHash near-duplicates: fingerprints, pivot distance tables, components.

A text becomes 64 bits: bit j is 1 if it is set in more than half of the hashes
of its word shingles, repeats included.  Texts are linked if their fingerprints
differ in at most `most` bits, and the operator gives each row the smallest id
that it reaches over links.

Scale.  Equal fingerprints are one node, so copies cost nothing further.  Nodes
that differ in at most 3 bits agree in one of 4 bands of 16 bits, and the other
48 bits agree in one of 4 bands of 12: 16 keys of 28 bits a node find every
link, and a key's nodes are met in one sorted partition.  There the distances
to a fixed table of pivot fingerprints discard pairs: by the triangle inequality
two nodes within 3 bits differ by at most 3 in every coordinate, so a node looks
only at the run of like distances to the first pivot, then at the largest
coordinate difference, and only survivors have their bits compared.  What leaves
is a star for each class of a group, never its pairs.  A key with more than
`hot` nodes is split by the same pigeonhole: of the bits it leaves open, one
quarter in four is equal in nodes within 3 bits, so each node goes on under four
longer keys, until fewer than SPLIT bits are open.  Components come from
alternating large-star and small-star rounds, whose minima are partial
aggregates.

Wider links.  `similar` finds documents whose shingle sets are alike in
`SIMILARITY` or more: such pairs differ in about 39 of 256 bits, too many for
banded keys.  Its keys are fixed random choices of bits of the 256: TABLES of
KEY_BITS up to 2 ** 24 nodes, then a bit more each time the nodes double and as
many more tables as keep the chance to meet (`tables_for`).  Under the sign-angle
model a pair at the threshold shares one in about 99 % of cases, and differs in at
most WIDE_MOST bits more surely; sets of a few shingles do so less often.  This is
the only step that can miss a pair.  The texts of each candidate component then
meet, and exact Jaccard of their shingle sets decides every link, so no pair below
the threshold is one.

Large groups (`_pivoted`).  A key or component with too many members is dealt
into chunks, and a few of its members, the pivots, are met by every chunk.  What
is linked to the largest class of pivots is one class; only the rest, usually
little, is met by every chunk again.  So a large group of near copies costs one
row a member and no link is lost.

Defined results: null or empty texts have no shingle and fingerprint zero, and
are linked like any other; fewer words than a shingle has make one shingle; a
row without an id keeps a null id and takes part as a member only; repeated
rows share a fingerprint and hence a component.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.llm.common import written

SHINGLE, SEED, MOST = 3, 42, 3
PIVOTS, HOT = 24, 2_000
SPLIT = 12  # open bits below which a hot key is not split: it has fewer than 2 ** SPLIT nodes
ROWS_A_TASK = 1_000_000  # of nodes times tables
FIRST = 8  # tables of the first pass of the wide search
GUIDES = 8  # members of a large group that all its chunks meet
#: For candidates of similar shingle sets: words of 64 bits, and bits of all of them that may differ.
SIMILAR_SHINGLE, WORDS, WIDE_MOST = 5, ("fp", "w1", "w2", "w3"), 64
TABLES, KEY_BITS = 96, 16
#: Links are confirmed by exact Jaccard; a group of more documents or shingles than these is cut.
SIMILARITY, HOT_SETS, VOLUME = 0.8, 200, 1_000_000
SMALL = 64  # nodes of a key whose pairs are all compared at once
CHUNK = 50_000  # hashes whose bits are counted at once


def _hashes(data: bytes, shingle: int) -> Iterator[np.ndarray]:
    """Shingle hashes of one text in chunks; `data` is UTF-8, equal shingles repeat."""
    from xxhash import xxh64_intdigest as h

    words = data.lower().split()  # bytes: A-Z only, and ASCII white space only
    if not words:
        return
    n = max(len(words) - shingle + 1, 1)
    line = memoryview(b" ".join(words))
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    last = ends[min(shingle, len(words)) - 1 :]
    for s in range(0, n, CHUNK):
        yield np.array([h(line[a:b], SEED) for a, b in zip(starts[s : min(s + CHUNK, n)].tolist(), last[s : min(s + CHUNK, n)].tolist())], np.uint64)


def _bit_sums(hashes: np.ndarray) -> np.ndarray:
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return bits.sum(axis=0, dtype=np.int64)


def _majority(sums: np.ndarray, n: int) -> int:
    return int(sum(1 << j for j in np.flatnonzero(2 * sums > n).tolist()))


def fingerprint(data: bytes, shingle: int = SHINGLE) -> int:
    """The fingerprint of one text as an unsigned number."""
    sums, n = np.zeros(64, np.int64), 0
    for hashes in _hashes(data, shingle):
        sums, n = sums + _bit_sums(hashes), n + len(hashes)
    return _majority(sums, n)


def hash_set(data: bytes, shingle: int) -> np.ndarray:
    """The distinct shingle hashes of one text, in order."""
    parts = list(_hashes(data, shingle))
    return np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)


def sketches(hashes: np.ndarray) -> list[int]:
    """A word of 64 majority bits from each of len(WORDS) mixes of distinct hashes."""
    out = []
    for _ in WORDS:
        sums = sum((_bit_sums(hashes[s : s + CHUNK]) for s in range(0, len(hashes), CHUNK)), np.zeros(64, np.int64))
        out.append(_majority(sums, len(hashes)))
        hashes = (hashes ^ (hashes >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0xD1B54A32D192ED03)
        hashes ^= hashes >> np.uint64(29)
    return out


def fingerprints(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long."""
    narrow = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("data"))

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(x.as_py(), shingle) for x in b.column(1)], np.uint64).astype(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps)], ["doc_id", "fp"])

    return narrow.mapInArrow(mapped, f"doc_id {narrow.schema['doc_id'].dataType.simpleString()}, fp bigint")


def _masks() -> list[int]:
    """16 masks of 28 bits: a band of 16, and a quarter of the other 48 bits."""
    out = []
    for band in range(4):
        first = [i for i in range(16 * band, 16 * band + 16)]
        others = [i for i in range(64) if i not in first]
        out += [sum(1 << i for i in first + others[12 * q : 12 * q + 12]) for q in range(4)]
    return out


def _longer(mask: int) -> list[int]:
    """The mask with each quarter of its open bits: nodes within 3 bits that agree on it agree on one of these."""
    open_ = [i for i in range(64) if not mask >> i & 1]
    return [mask | sum(1 << i for i in open_[len(open_) * q // 4 : len(open_) * (q + 1) // 4]) for q in range(4)]


def tables_for(nodes: int) -> tuple[int, int]:
    """Tables and key bits: unlike nodes of a key stay a few hundred, and the chance of a pair at the threshold to meet stays."""
    bits = max(KEY_BITS, int(np.ceil(np.log2(max(nodes, 1)))) - 8)
    agree = 1 - np.arccos(2 * SIMILARITY / (1 + SIMILARITY)) / np.pi
    return int(np.ceil(TABLES * agree ** (KEY_BITS - bits))), bits


def _random_masks(tables: int = TABLES, key_bits: int = KEY_BITS) -> list[list[int]]:
    """For each table a mask of every word, key_bits bits in all."""
    rng = np.random.default_rng(5)
    chosen = [rng.choice(64 * len(WORDS), key_bits, replace=False).tolist() for _ in range(tables)]
    return [[sum(1 << i % 64 for i in bits if i // 64 == w) for w in range(len(WORDS))] for bits in chosen]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def pivots(n: int = PIVOTS) -> np.ndarray:
    """Reference fingerprints: the same fixed random numbers everywhere."""
    return np.random.default_rng(4).integers(0, 2**64, n, np.uint64)


def forest(fps: np.ndarray, table: np.ndarray, most: int) -> tuple[list[int], list[int]]:
    """Stars (first place, place) over what links connect among these nodes.

    Places are visited breadth first.  A visited node is compared with those
    that no one has reached yet: by the run of near distances to the first
    pivot, by the largest coordinate difference, then by the bits themselves.
    """
    d = np.bitwise_count(fps[:, None] ^ table[None, :]).astype(np.int8)
    order = np.argsort(d[:, 0], kind="stable")
    fps, d = fps[order], d[order]
    first, open_ = d[:, 0].copy(), np.ones(len(fps), bool)
    left, right = [], []
    for root in range(len(fps)):
        if not open_[root]:
            continue
        open_[root] = False
        stack, tree = [root], [int(order[root])]
        while stack:
            i = stack.pop()
            a, b = np.searchsorted(first, first[i] - most, "left"), np.searchsorted(first, first[i] + most, "right")
            near = a + np.flatnonzero(open_[a:b])
            if not len(near):
                continue
            near = near[np.abs(d[near] - d[i]).max(axis=1) <= most]
            near = near[np.bitwise_count(fps[near] ^ fps[i]) <= most]
            open_[near] = False
            tree += order[near].tolist()
            stack += near.tolist()
        low = min(tree)
        left += [low] * (len(tree) - 1)
        right += [x for x in tree if x != low]
    return left, right


def _reached(n: int, near, joined: int = 0) -> tuple[list[int], list[int]]:
    """Stars (first place, place) over places 0..n-1; near(i, places) says which of these are linked to i.

    The first `joined` places are known to be one class, and aren't compared.
    """
    open_, left, right = np.ones(n, bool), [], []
    open_[:joined] = False
    roots = ([0] if joined else []) + list(range(joined, n))
    for root in roots:
        if root >= joined and not open_[root]:
            continue
        open_[root] = False
        stack = list(range(joined)) if root < joined else [root]
        while stack and len(others := np.flatnonzero(open_)):
            i = stack.pop()
            found = others[near(i, others)]
            open_[found] = False
            left += [root] * len(found)
            right += found.tolist()
            stack += found.tolist()
    return left, right


def _bits_near(words: np.ndarray, most: int):
    return lambda i, others: np.bitwise_count(words[others] ^ words[i]).sum(axis=1) <= most


def wide_forest(words: np.ndarray, starts: np.ndarray, ends: np.ndarray, most: int) -> tuple[list[int], list[int]]:
    """The same for sketches of several words, in each of many groups of rows."""
    left, right = [], []
    for s, e in zip(starts[ends - starts > SMALL].tolist(), ends[ends - starts > SMALL].tolist()):
        x, y = _reached(e - s, _bits_near(words[s:e], most))
        left += [s + i for i in x]
        right += [s + i for i in y]
    small = (ends - starts > 1) & (ends - starts <= SMALL)
    end = np.repeat(np.where(small, ends, 0), ends - starts)
    i, parent = np.flatnonzero(end), {}

    def find(x: int) -> int:
        while (y := parent.get(x, x)) != x:
            parent[x] = x = parent.get(y, y)
        return x

    for step in range(1, SMALL):  # all pairs of all small groups that are `step` rows apart
        i = i[end[i] > i + step]
        if not len(i):
            break
        for a in i[np.bitwise_count(words[i] ^ words[i + step]).sum(axis=1) <= most].tolist():
            if (x := find(a)) != (y := find(a + step)):
                parent[max(x, y)] = min(x, y)
    for x in list(parent):
        if (root := find(x)) != x:
            left.append(root)
            right.append(x)
    return left, right


def _whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray]]:
    """Rows sorted by `g` as tables of whole groups, with where each group starts and ends."""

    def cut(rows: pa.Table):
        g = rows["g"].to_numpy()
        at = np.flatnonzero(g[1:] != g[:-1]) + 1
        return rows, np.concatenate([[0], at]), np.concatenate([at, [len(g)]])

    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch])
        rows = pa.concat_tables([held, rows]) if held is not None else rows
        g = rows["g"].to_numpy()
        last = int(np.searchsorted(g, g[-1], "left")) if len(g) else 0
        if last:
            yield cut(rows.slice(0, last))
        held = rows.slice(last).combine_chunks()
    if held is not None:
        yield cut(held)


def _edges(rows: pa.Table, left: list[int], right: list[int]) -> pa.RecordBatch:
    """Edges between the labels of rows, if they have some that name what is joined already, else between nodes."""
    name = rows["label" if "label" in rows.column_names else "node"].combine_chunks()
    ends = [name.take(pa.array(x, pa.int64())) for x in (left, right)]
    unlike = pc.not_equal(*ends)
    return pa.RecordBatch.from_arrays([x.filter(unlike) for x in ends], ["a", "b"])


def _chunk_pairs(own: Column, chunks: Column, key: Column) -> Column:
    """Groups of a row of chunk `own`: a chunk meets every chunk, itself included."""
    return F.transform(F.sequence(F.lit(0), chunks - 1), lambda x: F.xxhash64(key, F.least(own, x), F.greatest(own, x)))


def _stars(grouped: DataFrame, near_of, role: bool = False) -> DataFrame:
    """Edges (a, b) over the groups `g` of (g, node, ...); rows of role 0 are one class already."""
    id_type = grouped.schema["node"].dataType.simpleString()

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, starts, ends in _whole_groups(batches):
            a, b = [], []
            for s, e in zip(starts.tolist(), ends.tolist()):
                if e - s > 1:
                    own = rows.slice(s, e - s)
                    joined = int((own["role"].to_numpy() == 0).sum()) if role else 0
                    if joined < e - s:
                        x, y = _reached(e - s, near_of(own), joined)
                        a += [s + i for i in x]
                        b += [s + i for i in y]
            if a:
                yield _edges(rows, a, b)

    return grouped.repartition("g").sortWithinPartitions("g", *["role"][: int(role)], "node").mapInArrow(within, f"a {id_type}, b {id_type}")


def _pivoted(rows: DataFrame, sizes: DataFrame, near_of) -> DataFrame | None:
    """Edges (a, b) that connect all links inside groups too large for one task.

    rows: (g, node, ...) of any groups; sizes: (g, n, chunks) of the large ones.
    Every chunk meets GUIDES members of its group.  Members linked to the
    largest class of these are one class; the others meet every chunk.
    """
    if not sizes.head(1):
        return None
    id_type = rows.schema["node"].dataType.simpleString()
    payload = [c for c in rows.columns if c != "g"]
    hot = rows.join(sizes, "g").select(F.col("g").alias("of"), "n", "chunks", *payload)
    hot = written(hot.withColumn("sub", F.pmod(F.xxhash64("of", "node"), F.col("chunks")).cast("int")), "hot")
    place = F.row_number().over(W.partitionBy("of").orderBy(F.xxhash64("node"), "node"))
    guides = hot.withColumn("_place", place).filter(F.col("_place") <= GUIDES).drop("sub", "_place")
    every = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("sub")
    met = guides.select("of", every, F.lit(0).alias("role"), *payload).unionByName(hot.select("of", "sub", F.lit(1).alias("role"), *payload))
    met = met.withColumn("g", F.xxhash64("of", "sub"))

    def absorb(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, starts, ends in _whole_groups(batches):
            node, of, a, b = rows["node"].combine_chunks(), rows["of"].combine_chunks(), [], []
            name = rows["label"].combine_chunks() if "label" in rows.column_names else node
            for s, e in zip(starts.tolist(), ends.tolist()):
                own = rows.slice(s, e - s)
                n, near = int((own["role"].to_numpy() == 0).sum()), near_of(own)
                root = np.arange(n)
                x, y = _reached(n, near)
                root[y] = x
                main = int(np.bincount(root).argmax())
                open_ = np.ones(e - s, bool)
                open_[:n] = root != main
                for i in np.flatnonzero(root == main).tolist():
                    others = n + np.flatnonzero(open_[n:])
                    open_[others[near(i, others)]] = False
                reached = s + np.flatnonzero(~open_)
                a += [s + main] * len(reached) + (rest := (s + n + np.flatnonzero(open_[n:])).tolist())
                b += reached.tolist() + [None] * len(rest)
            # A row without b names a node that isn't reached; edges are between labels, if there are some.
            x, y = pa.array(a, pa.int64()), pa.array(b, pa.int64())
            yield pa.RecordBatch.from_arrays([of.take(x), pc.if_else(pc.is_null(y), node.take(x), name.take(x)), name.take(y)], ["of", "a", "b"])

    dealt = met.repartition("g").sortWithinPartitions("g", "role", "node")
    first = written(dealt.mapInArrow(absorb, f"of bigint, a {id_type}, b {id_type}"), "absorbed")
    edges = first.filter("b is not null").select("a", "b")
    rest = first.filter("b is null").select("of", F.col("a").alias("node"))
    r = rest.groupBy("of").agg(F.count(F.lit(1)).alias("r")).join(sizes.withColumnRenamed("g", "of"), "of")
    pieces = r.select("of", F.ceil(F.col("r") * F.col("chunks") / F.col("n")).cast("int").alias("pieces"))
    piece = F.pmod(F.xxhash64("node"), F.col("pieces")).cast("int")
    left = written(hot.join(rest, ["of", "node"]).join(pieces, "of").withColumn("piece", piece), "rest")
    joined = hot.join(rest, ["of", "node"], "left_anti").join(pieces, "of").select("of", "sub", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece"), F.lit(0).alias("role"), *payload)
    again = joined.unionByName(left.select("of", every, "piece", F.lit(1).alias("role"), *payload)).withColumn("g", F.xxhash64("of", "sub", "piece"))
    among = left.select(F.explode(_chunk_pairs(F.col("piece"), F.col("pieces"), F.col("of"))).alias("g"), *payload)
    return edges.unionByName(_stars(again, near_of, role=True)).unionByName(_stars(among, near_of))


def links(nodes: DataFrame, hot: int = HOT) -> DataFrame:
    """Edges (a, b) between node ids that connect all nodes within MOST bits.

    nodes: (fp long, node), fingerprints distinct.
    """
    key = F.xxhash64("mask", F.col("fp").bitwiseAND(F.col("mask")))
    masks, cold = _masks(), None
    now = nodes.select("fp", "node", F.explode(F.array(*[F.lit(_signed(m)) for m in masks])).alias("mask")).withColumn("key", key)
    while True:
        open_ = 64 - masks[0].bit_count()
        over = written(now.groupBy("key").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > hot).select("key"), "keys") if open_ >= SPLIT else None
        # Keys with more than `hot` nodes are few; the planner broadcasts them if their table is small.
        done = now.select("key", "fp", "node") if over is None else now.join(over, "key", "left_anti").select("key", "fp", "node")
        cold = done if cold is None else cold.unionByName(done)
        if over is None or not over.head(1):
            break
        pairs = [(_signed(m), _signed(x)) for m in set(masks) for x in _longer(m)]
        longer = nodes.sparkSession.createDataFrame(pairs, "mask bigint, longer bigint")
        now = now.join(over, "key").join(F.broadcast(longer), "mask").select("fp", "node", F.col("longer").alias("mask")).distinct().withColumn("key", key)
        now, masks = written(now, "longer"), [x % (1 << 64) for _, x in pairs]
    id_type = nodes.schema["node"].dataType.simpleString()

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pivots()
        for rows, starts, ends in _whole_groups(batches):
            fps, a, b = rows["fp"].to_numpy().astype(np.uint64), [], []
            for s, e in zip(starts.tolist(), ends.tolist()):
                if e - s > 1:
                    x, y = forest(fps[s:e], table, MOST)
                    a += [s + i for i in x]
                    b += [s + i for i in y]
            if a:
                yield _edges(rows, a, b)

    dealt = cold.withColumnRenamed("key", "g").repartition("g").sortWithinPartitions("g", "node")
    return dealt.mapInArrow(within, f"a {id_type}, b {id_type}")


def wide_links(nodes: DataFrame, masks: list[list[int]], most: int = WIDE_MOST, hot: int = HOT) -> DataFrame:
    """Edges (a, b) that connect the labels of nodes within `most` of all bits of WORDS that share a key.

    nodes: (*WORDS long, node, label), sketches of distinct sets; nodes with
    one label are connected already.
    """
    part = lambda c, m: F.col(c).bitwiseAND(F.lit(_signed(m)))
    keys = F.array(*[F.xxhash64(F.lit(t), *[part(c, x) for c, x in zip(WORDS, m) if x]) for t, m in enumerate(masks)])
    counts = nodes.select(F.explode(keys).alias("g")).groupBy("g").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > hot)
    counts = written(counts.withColumn("chunks", F.ceil(F.col("n") / hot).cast("int")), "keys")
    met = nodes.select(F.explode(keys).alias("g"), "node", "label", *WORDS)
    id_type = nodes.schema["node"].dataType.simpleString()
    words_of = lambda rows: np.stack([rows[c].to_numpy().astype(np.uint64) for c in WORDS], axis=1)

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, starts, ends in _whole_groups(batches):
            a, b = wide_forest(words_of(rows), starts, ends, most)
            if a:
                yield _edges(rows, a, b)

    cold = met.join(counts.select("g"), "g", "left_anti").repartition("g").sortWithinPartitions("g", "node")
    edges = cold.mapInArrow(within, f"a {id_type}, b {id_type}")
    more = _pivoted(met, counts, lambda rows: _bits_near(words_of(rows), most))
    return edges if more is None else edges.unionByName(more)


def candidates(nodes: DataFrame, most: int = WIDE_MOST, hot: int = HOT) -> DataFrame:
    """(node, component) over pairs within `most` bits that share a key of any table.

    The first tables join most of a large group of near copies; the others add
    edges between what these left apart, so edges don't pile up table by table.
    """
    n = nodes.count()
    masks = _random_masks(*tables_for(n))
    nodes = nodes.repartition(-(-n * len(masks) // ROWS_A_TASK) or 1, "node")  # each row becomes one a table
    first = components(wide_links(nodes.withColumn("label", F.col("node")), masks[:FIRST], most, hot))
    labelled = written(nodes.join(first, "node", "left").select("node", *WORDS, F.coalesce("component", "node").alias("label")), "labelled").repartition(-(-n * len(masks) // ROWS_A_TASK) or 1, "node")
    return components(wide_links(labelled, masks[FIRST:], most, hot).unionByName(first.select(F.col("node").alias("a"), F.col("component").alias("b"))))


def _jaccard_near(sets: list[np.ndarray], least: float):
    """near(i, places): which of these sets of distinct values have Jaccard >= least with set i."""
    sizes = np.array([len(x) for x in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, term, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner_of = owner[np.argsort(term, kind="stable")]
    start, own = np.cumsum(n) - n, np.split(term, np.cumsum(sizes)[:-1])

    def near(i: int, others: np.ndarray) -> np.ndarray:
        k = n[own[i]]
        at = np.arange(k.sum()) + np.repeat(start[own[i]] - (np.cumsum(k) - k), k)
        shared = np.bincount(owner_of[at], minlength=len(sets))[others]
        return (shared > 0) & (shared / np.maximum(sizes[i] + sizes[others] - shared, 1) >= least)

    return near


def confirmed(found: DataFrame, nodes: DataFrame, docs: DataFrame, shingle: int, least: float, sets: int = HOT_SETS, volume: int = VOLUME) -> DataFrame:
    """Edges (a, b) that connect all pairs with Jaccard >= least inside a component of candidates.

    found: (node, component); nodes: (node, n) with n shingles; docs:
    (doc_id, data).  A component's texts meet in one group and are compared as
    exact sets.  One of more than `sets` documents or `volume` shingles is
    compared in chunks (`_pivoted`).
    """
    # A component's first node isn't listed with the others.
    found = found.union(found.select("component", "component")).distinct()
    of = written(found.join(nodes.groupBy("node").agg(F.sum("n").alias("n")), "node").select("node", F.xxhash64("component").alias("g"), "n"), "candidates")
    chunks = F.greatest(F.ceil(F.count(F.lit(1)) / sets), F.ceil(F.sum("n") / volume)).cast("int")
    large = written(of.groupBy("g").agg(F.count(F.lit(1)).alias("n"), chunks.alias("chunks")).filter("chunks > 1"), "large")
    texts = docs.join(of.select("g", "node"), F.col("doc_id") == F.col("node")).select("g", "node", "data")
    near_of = lambda rows: _jaccard_near([hash_set(t.as_py(), shingle) for t in rows["data"]], least)
    edges = _stars(texts.join(large.select("g"), "g", "left_anti"), near_of)
    more = _pivoted(texts, large, near_of)
    return edges if more is None else edges.unionByName(more)


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node id that each linked node reaches.

    Alternates large-star and small-star until the edges are stars: each node
    has one edge down, and none leads to a node that has one itself.  Every
    round is written to the shared folder, so lineage stays short.
    """
    both = lambda e: e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select("b", "a"))
    now = written(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while True:
        deep = now.join(now.select(F.col("b").alias("a")).distinct(), "a", "left_semi").select("a")
        if not deep.union(now.groupBy("a").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("a")).head(1):
            return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
        near = both(now)
        low = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = near.filter("v > u").join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        large = large.distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
        now = written(small.filter("a <> b").distinct(), "edges")


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = SHINGLE, hot: int = HOT) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row."""
    prints = written(fingerprints(docs, text, doc_id, shingle), "prints")
    nodes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("node")), "nodes")
    named = nodes.filter(F.col("node").isNotNull())
    found = components(links(named, hot))
    label = written(nodes.join(found, "node", "left").select("fp", F.coalesce("component", "node").alias("component")), "labels")
    text_of = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return prints.join(label, "fp").select("doc_id", text_of.alias("fingerprint"), F.col("component").alias("component_id"))


def similar(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = SIMILAR_SHINGLE, least: float = SIMILARITY, hot: int = HOT, sets: int = HOT_SETS) -> DataFrame:
    """(doc_id, component_id): components over pairs whose shingle sets have Jaccard >= least."""
    narrow = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("data"))

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [hash_set(x.as_py(), shingle) for x in b.column(1)]
            words = np.array([sketches(x) for x in found], np.uint64).reshape(-1, len(WORDS)).astype(np.int64)
            digests = [hashlib.blake2b(x.tobytes(), digest_size=16).digest() for x in found]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(digests, pa.binary()), pa.array([len(x) for x in found], pa.int64()), *[pa.array(w) for w in words.T]], ["doc_id", "digest", "n", *WORDS])

    sketch = f"doc_id {narrow.schema['doc_id'].dataType.simpleString()}, digest binary, n bigint, " + ", ".join(f"{w} bigint" for w in WORDS)
    prints = written(narrow.mapInArrow(mapped, sketch), "sketches")
    # Equal sets are one node.
    nodes = written(prints.groupBy("digest", "n", *WORDS).agg(F.min("doc_id").alias("node")), "nodes")
    named = nodes.filter(F.col("node").isNotNull())
    found = components(confirmed(candidates(named, WIDE_MOST, hot), named.select("node", "n"), narrow, shingle, least, sets))
    label = written(nodes.join(found, "node", "left").select("digest", F.coalesce("component", "node").alias("component")), "labels")
    return prints.join(label, "digest").select("doc_id", F.col("component").alias("component_id"))


def _leaders(docs: DataFrame, found: DataFrame, doc_id: str) -> DataFrame:
    leaders = found.filter(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias("leader")).distinct()
    rows = docs.select(F.col(f"`{doc_id}`").alias("id"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    kept = rows.join(leaders, F.col("id") == F.col("leader"), "left").filter("leader is not null or id is null")
    return kept.select(*[F.col("row")[c].alias(c) for c in docs.columns])


def deduplicated(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", **settings) -> DataFrame:
    """The rows whose id names their component; rows without an id stay.

    Rows that share an id are one document and stay or go together.
    """
    return _leaders(docs, near_duplicates(docs, text, doc_id, **settings), doc_id)


def without_similar(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", **settings) -> DataFrame:
    """The same over links of similar shingle sets: one document of each group stays."""
    return _leaders(docs, similar(docs, text, doc_id, **settings), doc_id)
