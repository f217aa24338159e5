"""Pairs of similar term sets, with no set shuffled for a pair that can't be similar.

A set travels as its class, a number from the digest of its terms, until it is
known to be near another.  What is written beside the sets is small:

1. Sets are stored once as sorted 64-bit hashes.  That no two terms have one hash, and
   no two classes one number, is tested; hashes of another salt are taken otherwise.
2. Terms are ordered from rare to frequent by a table of counts, fixed in size, that
   each task gets (terms of one place in it count as equally frequent).  Two sets
   with Jaccard >= t share a term among the first n - ceil(t n) + 1 of each; these
   prefixes meet by term, in blocks of numbers.
3. Pairs that met are tested by parities: bit i of a set tells whether an odd number of its
   terms falls on i, so two sets differ in no more bits than in terms.  Classes are dealt
   into blocks, and a cell of the grid gets the parities of two blocks and their pairs.
4. Of the pairs left, nearly all similar, whole sets decide.  A pair is counted where the
   smallest neighbour of its first class is at home, so that the sets of a
   group of near copies are sent to one place, or to a grid of places where there are many.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.sources.scratch import stored

PLACES = 1 << 21  # of the table of counts, and of the one of classes that are near another
HELD, CHUNK = 1 << 22, 1 << 20  # pairs that a task holds before it passes them on, and looks at at once
POSTINGS, CELL = 1 << 20, 1 << 11  # postings of a task; classes in a block of the grid grow as the root of this times all
CROWD = 1 << 18  # pairs at a home from which on it becomes a grid


def sets(rows: DataFrame, id_: str, terms: Column, salt: int) -> DataFrame:
    """(id, c, digest, terms) of every row with terms; and where id and c are void, a task's hashes (terms) with a second hash (other) and counts of rows."""

    def number(batches):
        from hashlib import blake2b

        import numpy as np
        import pyarrow as pa

        key, held = salt.to_bytes(8, "little"), []
        longs = lambda x, ends: pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x, pa.int64()))
        names = ["id", "c", "digest", "terms", "other", "counts"]

        def merged(parts):
            h, o, n = (np.concatenate(x) for x in zip(*parts))
            at = np.lexsort((o, h))
            h, o, n = h[at], o[at], n[at]
            first = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (o[1:] != o[:-1])])
            return h[first], o[first], np.add.reduceat(n, first)

        kind = None
        for batch in batches:
            lists, ids = batch.column("terms"), batch.column("id")
            kind = ids.type
            words = lists.flatten().dictionary_encode()
            if not len(words):
                continue
            both = np.frombuffer(b"".join(blake2b(w.encode(), digest_size=16, salt=key).digest() for w in words.dictionary.to_pylist()), np.int64).reshape(-1, 2)
            size = lists.value_lengths().fill_null(0).to_numpy()
            pair = np.unique(np.repeat(np.arange(len(size)), size) * len(both) + words.indices.to_numpy())
            owner, word = pair // len(both), pair % len(both)
            counts = np.bincount(word, minlength=len(both))
            held.append((both[:, 0], both[:, 1], counts))
            if sum(len(x[0]) for x in held) > HELD:
                held = [merged(held)]
            h = both[word, 0]
            h = h[np.lexsort((h, owner))]
            ends = np.r_[0, np.cumsum(np.bincount(owner, minlength=len(size)))]
            some = np.flatnonzero(np.diff(ends))
            digests = [blake2b(h[ends[i] : ends[i + 1]].tobytes(), digest_size=16).digest() for i in some]
            c = np.frombuffer(b"".join(digests), np.int64)[::2]
            void = pa.nulls(len(some), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(some)), pa.array(c), pa.array(digests, pa.binary()), longs(h, np.r_[0, ends[some + 1]]), void, void], names=names)
        if held:
            h, o, n = merged(held)
            ends = np.r_[np.arange(0, len(h), 1 << 16), len(h)]
            void = lambda t: pa.nulls(len(ends) - 1, t)
            yield pa.RecordBatch.from_arrays([void(kind), void(pa.int64()), void(pa.binary()), longs(h, ends), longs(o, ends), longs(n, ends)], names=names)

    own = rows.select(F.col(id_).alias("id"), terms.alias("terms"))
    kind = own.schema["id"].dataType.simpleString()
    return own.mapInArrow(number, f"id {kind}, c bigint, digest binary, terms array<bigint>, other array<bigint>, counts array<bigint>")


def table(df: DataFrame, place: str, value: str):
    """The sums of `value` by `place`, one of PLACES, as an array."""
    import numpy as np

    out = np.zeros(PLACES, np.int32)
    found = df.groupBy(place).agg(F.least(F.sum(value), F.lit(2**31 - 1)).cast("int").alias("v")).toArrow()
    out[found.column(0).to_numpy()] = found.column(1).to_numpy()
    return out


def numbered_sets(rows: DataFrame, id_: str, terms: Column) -> tuple[DataFrame, DataFrame, object]:
    """Stored sets (id, c, terms), classes (c, id, members), and counts of terms by place."""
    for salt in range(8):
        every = stored(sets(rows, id_, terms, salt), "sets")
        own = every.filter("c is not null")
        classes = stored(own.groupBy("digest").agg(F.first("c").alias("c"), F.min("id").alias("id"), F.count(F.lit(1)).alias("members")), "classes")
        words = every.filter("c is null").select(F.inline(F.arrays_zip(F.col("terms").alias("h"), F.col("other").alias("o"), F.col("counts").alias("n"))))
        words = stored(words.toDF("h", "o", "n").groupBy("h").agg(F.sum("n").alias("n"), (F.min("o") != F.max("o")).alias("twice")), "words")
        if words.filter("twice").isEmpty() and classes.groupBy("c").count().filter("count > 1").isEmpty():
            return own.select("id", "c", "terms"), classes.select("c", "id", "members"), table(words.select((F.col("h").bitwiseAND(PLACES - 1)).cast("int").alias("place"), "n"), "place", "n")
    raise ValueError("equal hashes of different terms under every salt")


def flat(batch):
    """(classes, values, sizes, owners) of a batch of sets."""
    import numpy as np

    lists = batch.column("terms")
    size = lists.value_lengths().to_numpy()
    return batch.column("c").to_numpy(), lists.flatten().to_numpy(), size, np.repeat(np.arange(len(size)), size)


def postings(own: DataFrame, counts, threshold: float, parts: int) -> DataFrame:
    """(part, data): blocks of rows term, class, size and place of the prefixes, dealt by term; terms that one row alone has are left out."""
    shared = own.sparkSession.sparkContext.broadcast(counts)

    def deal(batches):
        import numpy as np
        import pyarrow as pa

        rarity = shared.value
        for batch in batches:
            c, h, size, owner = flat(batch)
            if not len(h):
                continue
            often = rarity[h & (PLACES - 1)]
            at = np.lexsort((h, often, owner))
            place = np.arange(len(h)) - np.repeat(np.cumsum(size) - size, size) + 1
            most = size - np.ceil(threshold * size).astype(np.int64) + 1
            keep = (place <= most[owner]) & (often[at] > 1)
            h, place, owner = h[at][keep], place[keep], owner[keep]
            part = (h >> 24) % parts
            to = np.argsort(part, kind="stable")
            found, starts = np.unique(part[to], return_index=True)
            columns = [h[to], c[owner[to]], size[owner[to]].astype(np.int32), place[to].astype(np.int32)]
            data = [b"".join(x[i:j].tobytes() for x in columns) for i, j in zip(starts, np.r_[starts[1:], len(to)])]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array(data, pa.binary())], names=["part", "data"])

    return own.select("c", "terms").mapInArrow(deal, "part int, data binary").repartition(parts, "part")


def cell_of(a, b, blocks: int):
    """Pairs with the class of the lower block first, and their cells."""
    import numpy as np

    u, v = a % blocks, b % blocks
    swap = (u > v) | ((u == v) & (a > b))
    return np.where(swap, b, a), np.where(swap, a, b), np.minimum(u, v) * blocks + np.maximum(u, v)


def met(dealt: DataFrame, threshold: float, blocks: int) -> DataFrame:
    """(cell, kind, a, b, c): blocks of pairs of classes that share a term of their prefixes, within length and place bounds."""

    def pairs(batches):
        import numpy as np
        import pyarrow as pa

        columns: list[list] = [[], [], [], []]
        for batch in batches:
            for x in batch.column("data"):
                data = x.as_py()
                n, begin = len(data) // 24, 0
                for column, kind in zip(columns, (np.int64, np.int64, np.int32, np.int32)):
                    column.append(np.frombuffer(data, kind, n, begin))
                    begin += n * np.dtype(kind).itemsize
        if not columns[0]:
            return
        h, c, n, at = (np.concatenate(x) for x in columns)
        del columns
        order = np.lexsort((c, n, h))
        h, c, n, at = h[order], c[order], n[order], at[order]
        new = np.r_[True, (h[1:] != h[:-1]) | (c[1:] != c[:-1])]  # a class once a term, whatever rows it has
        h, c, n, at = h[new], c[new], n[new].astype(np.int64), at[new].astype(np.int64)
        least = np.ceil(threshold * n)

        def packed(held):
            a, b, cell = cell_of(*(np.concatenate(x) for x in zip(*held)), blocks)
            order = np.lexsort((b, a, cell))
            a, b, cell = a[order], b[order], cell[order]
            new = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
            a, b, cell = a[new], b[new], cell[new]
            return a, b, cell

        def out(a, b, cell):
            found, starts = np.unique(cell, return_index=True)
            ends = np.r_[starts[1:], len(cell)]
            blobs = [pa.array([x[i:j].tobytes() for i, j in zip(starts, ends)], pa.binary()) for x in (a, b)]
            return pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.nulls(len(found), pa.bool_()).fill_null(True), *blobs, pa.nulls(len(found), pa.binary())], names=["cell", "pairs", "a", "b", "x"])

        held, many = [], 0
        for first in range(0, len(h), CHUNK):
            live, step = np.arange(first, min(first + CHUNK, len(h))), 0
            while True:
                step += 1
                live = live[live + step < len(h)]
                other = live + step
                near = (h[live] == h[other]) & (least[other] <= n[live])  # sizes grow within a term, so that none behind is near either
                live, other = live[near], other[near]
                if not len(live):
                    break
                most = 1 + np.minimum(n[live] - at[live], n[other] - at[other])
                good = (most >= threshold * (n[live] + n[other] - most) - 1e-9) & (c[live] != c[other])
                if good.any():
                    held.append((c[live[good]], c[other[good]]))
                    many += len(held[-1][0])
                if many > HELD:
                    a, b, cell = packed(held)
                    held, many = [(a, b)], len(a)
                    if many > HELD // 2:
                        yield out(a, b, cell)
                        held, many = [], 0
        if held:
            yield out(*packed(held))

    return dealt.mapInArrow(pairs, "cell int, pairs boolean, a binary, b binary, x binary")


def parities(own: DataFrame, blocks: int) -> DataFrame:
    """(cell, pairs, a, b, x): blocks of classes (a), sizes (b) and parities (x), a copy for each cell of the block's row and column."""

    def bits(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            c, h, size, owner = flat(batch)
            if not len(h):
                continue
            width = width_of(size)
            ends = np.r_[0, np.cumsum(width)]
            odd = np.bincount(ends[owner] + ((h >> 21) & (width[owner] - 1)), minlength=ends[-1]) & 1
            data, ends = np.packbits(odd.astype(np.uint8)), ends // 8
            first = np.unique(c, return_index=True)[1]
            block = c[first] % blocks
            rows = [(int(k), first[block == k]) for k in np.unique(block)]
            cs, ns = ([x[own].tobytes() for _, own in rows] for x in (c, size.astype(np.int64)))
            xs = [b"".join(data[ends[i] : ends[i + 1]].tobytes() for i in own) for _, own in rows]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.int32()), *[pa.array(x, pa.binary()) for x in (cs, ns, xs)]], names=["block", "a", "b", "x"])

    every = own.select("c", "terms").mapInArrow(bits, "block int, a binary, b binary, x binary")
    other = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    cell = F.least("block", "other") * blocks + F.greatest("block", "other")
    return every.withColumn("other", other).select(cell.cast("int").alias("cell"), F.lit(False).alias("pairs"), "a", "b", "x")


def width_of(size):
    """Bits of a parity: the power of two from a set's size on, 64 at least."""
    import numpy as np

    return np.maximum(64, 1 << np.ceil(np.log2(np.maximum(size, 1))).astype(np.int64))


def near(cells: DataFrame, threshold: float) -> DataFrame:
    """(a, b): the pairs, each once, whose parities differ in no more bits than similar sets differ in terms."""

    def test(batches):
        import numpy as np
        import pyarrow as pa

        asked, have = {}, {}
        for batch in batches:
            for cell, pairs, *data in zip(*(batch.column(i).to_pylist() for i in range(5))):
                (asked if pairs else have).setdefault(cell, []).append(data)
        for cell in asked:
            a, b = (np.concatenate([np.frombuffer(x[i], np.int64) for x in asked[cell]]) for i in (0, 1))
            c, n = (np.concatenate([np.frombuffer(x[i], np.int64) for x in have[cell]]) for i in (0, 1))
            data = np.frombuffer(b"".join(x[2] for x in have[cell]), np.uint64)
            width = width_of(n) // 64
            begin = np.cumsum(width) - width
            c, one = np.unique(c, return_index=True)
            n, width, begin = n[one], width[one], begin[one]
            order = np.lexsort((b, a))
            a, b = a[order], b[order]
            new = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]
            a, b = a[new], b[new]
            i, j = np.searchsorted(c, a), np.searchsorted(c, b)
            swap = width[i] > width[j]
            i, j = np.where(swap, j, i), np.where(swap, i, j)  # i has as many bits as j, or half
            keep = np.zeros(len(a), bool)
            kinds = width[i] * 2 + (width[i] < width[j])
            for kind in np.unique(kinds):
                w, half, some = kind // 2, kind % 2, np.flatnonzero(kinds == kind)
                for at in range(0, len(some), max(1, CHUNK // int(w))):
                    own = some[at : at + max(1, CHUNK // int(w))]
                    x, y = data[begin[i[own], None] + np.arange(w)], data[begin[j[own], None] + np.arange(w)]
                    if half:  # places beyond the first half fall on those within it
                        y = y ^ data[begin[j[own], None] + w + np.arange(w)]
                    differ = np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)
                    keep[own] = differ <= (1 - threshold) / (1 + threshold) * (n[i[own]] + n[j[own]]) + 1e-6
            yield pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(b[keep])], names=["a", "b"])

    return cells.mapInArrow(test, "a bigint, b bigint")


def compared(own: DataFrame, pairs: DataFrame, threshold: float, parts: int) -> DataFrame:
    """(a, b, similarity) of the pairs, by whole sets, from the threshold on."""
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    lowest = pairs.groupBy("b").agg(F.min("a").alias("home"))
    at = pairs.join(lowest.select(F.col("b").alias("a"), "home"), "a", "left").select("a", "b", F.coalesce("home", "a").alias("home"))
    at = stored(at, "pairs")
    crowded = at.groupBy("home").agg(F.ceil(F.sqrt(F.count(F.lit(1)) / CROWD)).cast("int").alias("grid"))
    side = lambda c: F.pmod(F.xxhash64(c), "grid")
    at = stored(at.join(crowded, "home").select("a", "b", F.xxhash64("home", side("a"), side("b")).alias("cell")), "pairs")
    wanted = at.select("cell", F.explode(F.array("a", "b")).alias("c")).distinct()
    places = table(wanted.select("c").distinct().select((F.col("c").bitwiseAND(PLACES - 1)).cast("int").alias("place"), F.lit(1).alias("one")), "place", "one") > 0
    shared = own.sparkSession.sparkContext.broadcast(places)

    def asked(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            c = batch.column("c").to_numpy()
            first = np.sort(np.unique(c, return_index=True)[1])
            yield batch.take(pa.array(first[shared.value[c[first] & (PLACES - 1)]]))

    def count(batches):
        import numpy as np
        import pyarrow as pa

        cells, pairs = [], []
        for batch in batches:
            is_set = batch.column("b").is_null().to_numpy(zero_copy_only=False)
            cells.append(batch.filter(pa.array(is_set)))
            pairs.append(batch.filter(pa.array(~is_set)))
        if not pairs or not sum(len(x) for x in pairs):
            return
        cell, a, b = (np.concatenate([x.column(k).to_numpy() for x in pairs]) for k in ("cell", "a", "b"))
        have_cell, have = (np.concatenate([x.column(k).to_numpy() for x in cells]) for k in ("cell", "a"))
        lists = pa.chunked_array([x.column("terms") for x in cells]).combine_chunks()
        values, local = np.unique(lists.flatten().to_numpy(), return_inverse=True)
        size = lists.value_lengths().to_numpy()
        ends = np.r_[0, np.cumsum(size)]
        order = np.lexsort((have, have_cell))
        by = dict(zip(zip(have_cell[order].tolist(), have[order].tolist()), order.tolist()))
        order = np.lexsort((b, a, cell))
        cell, a, b = cell[order], a[order], b[order]
        starts = np.flatnonzero(np.r_[True, (cell[1:] != cell[:-1]) | (a[1:] != a[:-1])])
        mark, found = np.zeros(len(values), bool), np.zeros(len(a))
        for first, last in zip(starts, np.r_[starts[1:], len(a)]):
            i = by[int(cell[first]), int(a[first])]
            own = local[ends[i] : ends[i + 1]]
            mark[own] = True
            for k in range(first, last):
                j = by[int(cell[k]), int(b[k])]
                same = np.count_nonzero(mark[local[ends[j] : ends[j + 1]]])
                found[k] = same / (size[i] + size[j] - same)
            mark[own] = False
        keep = found >= threshold
        yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (a, b, found)], names=["a", "b", "similarity"])

    near_sets = own.select("c", "terms").mapInArrow(asked, "c bigint, terms array<bigint>").join(wanted, "c").select("cell", F.col("c").alias("a"), F.lit(None).cast("bigint").alias("b"), "terms")
    every = near_sets.unionByName(at.select("cell", "a", "b", F.lit(None).cast("array<bigint>").alias("terms")))
    return every.repartition(parts, "cell").mapInArrow(count, "a bigint, b bigint, similarity double")


def similar_classes(rows: DataFrame, id_: str, terms: Column, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Classes (c, id, members) of rows with equal sets, and (a, b, similarity): all pairs of them with Jaccard >= threshold."""
    own, classes, counts = numbered_sets(rows, id_, terms)
    n, many = (x or 0 for x in own.agg(F.count(F.lit(1)), F.sum(F.size("terms"))).first())
    least = rows.sparkSession.sparkContext.defaultParallelism
    parts = max(4 * least, -int(-((1 - threshold) * many + 2 * n) // POSTINGS) * 4)
    blocks = max(1, round((n / CELL) ** 0.5))
    pairs = met(postings(own, counts, threshold, parts), threshold, blocks)
    cells = pairs.unionByName(parities(own, blocks)).repartition(max(1, blocks * (blocks + 1) // 2), "cell")
    left = stored(near(cells, threshold), "near")
    return classes, stored(compared(own, left, threshold, max(2 * least, -(-int(many) // (8 * POSTINGS)))), "similar")
