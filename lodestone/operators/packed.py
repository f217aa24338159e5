"""Top-k search in which a task keeps k rows a query, whatever it reads.

`retrieve.Index` makes a row a (query, unit, shared term), and sorts a row a (query,
unit) to rank them.  Here a unit is stored once as the numbers of the query
terms it holds, and a task adds up whole blocks of queries as matrices and keeps
the k best of each query, so that only these are shuffled and sorted.  Scores
and ties are those of `retrieve.Index` and `retrieve.ranked`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import token_numbers
from lodestone.sources.scratch import stored

POSTINGS, BLOCK = 1_024, 256  # postings and queries whose products a task holds at once: 2 MB, which a core's cache holds


def numbered(units: DataFrame, text: Column, keys: list[str], words: list[str]) -> DataFrame:
    """(doc_id, key, len, terms, tfs) of every unit: which of `words` it holds, by number, and how often."""
    import numpy as np
    import pyarrow as pa

    many, numbers = max(len(words), 1), token_numbers(words)

    def number(batches):
        for batch in batches:
            found, size = numbers(batch.column("text"))
            pair = (np.repeat(np.arange(len(size), dtype=np.int64), size) * many + found)[found >= 0]
            pair, tf = np.unique(pair, return_counts=True)
            ends = pa.array(np.searchsorted(pair, np.arange(len(size) + 1, dtype=np.int64) * many).astype(np.int32))
            lists = [pa.ListArray.from_arrays(ends, pa.array(x.astype(np.int32))) for x in (pair % many, tf)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), pa.array(size), *lists], names=["doc_id", "key", "len", "terms", "tfs"])

    own = units.select(F.col(keys[0]).alias("doc_id"), F.xxhash64(*keys).alias("key"), F.lower(text).alias("text"))
    return own.mapInArrow(number, "doc_id string, key bigint, len bigint, terms array<int>, tfs array<int>")


def kept(held: list, k: int):
    """Of (query, score, document) parts: each document's best score a query, and of those the k best a query, ties to the smaller id."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    q, s = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
    docs = pa.concat_arrays([h[2] for h in held]).dictionary_encode()
    by_id = pc.array_sort_indices(docs.dictionary).to_numpy()
    place = np.empty(len(by_id), np.int64)
    place[by_id] = np.arange(len(by_id))
    d = place[docs.indices.to_numpy()]
    at = np.lexsort((d, -s, q))
    q, s, d = q[at], s[at], d[at]
    first = np.sort(np.unique(q * len(by_id) + d, return_index=True)[1])
    q, s, d = q[first], s[first], d[first]
    starts = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.zeros(0, np.int64)
    sizes = np.diff(np.r_[starts, len(q)])
    low = np.arange(len(q)) - np.repeat(starts, sizes) < k
    full = starts[sizes >= k]
    return (q[low], s[low], docs.dictionary.take(pa.array(by_id[d[low]]))), (q[full], s[full + k - 1])


class Packed:
    """Stored units, and what of them a search needs; see the top of this file.

    `usable` is false where a unit's key is there twice, as its rows are one unit then, or a document has no id.
    The driver holds the questions' terms, at most `retrieve.Index.COPIED` rows, and a count a term.
    """

    def __init__(self, units: DataFrame, text: Column, terms: DataFrame, keys: tuple[str, ...] = ("doc_id",)):
        self.asked = sorted((r["q_id"], r["term"], r["qtf"]) for r in terms.select("q_id", "term", "qtf").collect())
        self.words = sorted({t for _, t, _ in self.asked})
        self.rows = rows = stored(numbered(units, text, list(keys), self.words), "units")
        one = rows.agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("avg_len"), F.count_if(F.col("doc_id").isNull()).alias("void")).first()
        self.n, self.avg_len = one["n"], one["avg_len"] or 0.0
        self.df = dict(rows.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count(F.lit(1))).collect())
        self.usable = not one["void"] and rows.groupBy("key").count().filter("count > 1").isEmpty()

    def _blocks(self, names: list[str]) -> list[tuple]:
        """Per block of queries: its first number, its size, and (where a term's entries begin, their queries, their weights) by term."""
        import numpy as np

        number, word = {q: i for i, q in enumerate(names)}, {t: i for i, t in enumerate(self.words)}
        asked = [x for x in self.asked if x[0] in number]
        q, t, qtf = [np.array(x) for x in ([number[a] for a, _, _ in asked], [word[b] for _, b, _ in asked], [float(c) for _, _, c in asked])]
        df = np.array([self.df.get(i, 0) for i in range(len(self.words))], float)
        weight = qtf * np.log(1 + (self.n - df + 0.5) / (df + 0.5))[t]
        out = []
        for first in range(0, len(names), BLOCK):
            own = np.flatnonzero((q >= first) & (q < first + BLOCK))
            own = own[np.argsort(t[own], kind="stable")]
            out.append((first, min(BLOCK, len(names) - first), np.searchsorted(t[own], np.arange(len(self.words) + 1)), q[own] - first, weight[own]))
        return out

    def _products(self, names: list[str], k1: float, b: float):
        """A function of a batch of units: (first query, number of queries, rows of the batch, their scores as a matrix) by blocks."""
        import numpy as np

        blocks, average = self._blocks(names), self.avg_len

        def products(batch):
            terms, tfs = batch.column("terms"), batch.column("tfs").flatten().to_numpy().astype(float)
            sizes = terms.value_lengths().to_numpy()
            some, sizes = np.flatnonzero(sizes), sizes[sizes > 0]
            if not len(some):
                return
            seen, local = np.unique(terms.flatten().to_numpy(), return_inverse=True)
            ratio = batch.column("len").to_numpy()[some] / average if average > 0 else np.zeros(len(some))
            part = tfs * (k1 + 1) / (tfs + np.repeat(k1 * (1 - b + b * ratio), sizes))
            ends = np.cumsum(sizes)
            for first, width, begins, queries, weights in blocks:
                counts = begins[seen + 1] - begins[seen]
                entry = np.repeat(begins[seen] - np.r_[0, np.cumsum(counts)[:-1]], counts) + np.arange(counts.sum())
                by_term = np.zeros((len(seen), width))
                by_term[np.repeat(np.arange(len(seen)), counts), queries[entry]] = weights[entry]
                at = 0
                while at < len(some):
                    start = ends[at] - sizes[at]
                    to = max(at + 1, int(np.searchsorted(ends, start + POSTINGS, side="right")))
                    span = slice(start, ends[to - 1])
                    yield first, width, some[at:to], np.add.reduceat(by_term[local[span]] * part[span, None], ends[at:to] - sizes[at:to] - start, axis=0)
                    at = to

        return products

    def _dealt(self) -> DataFrame:
        least = self.rows.sparkSession.sparkContext.defaultParallelism
        rows = self.rows.select("doc_id", "len", "terms", "tfs")
        return rows if rows.rdd.getNumPartitions() >= least else rows.repartition(least, "doc_id")

    def top(self, k: int, k1: float, b: float, names: list[str] | None = None) -> DataFrame:
        """(q_id, doc_id, score): the k best documents a query, or of the queries in `names`, each by its best unit."""
        import numpy as np
        import pyarrow as pa

        spark, names = self.rows.sparkSession, sorted({q for q, _, _ in self.asked} if names is None else names)
        if not names or not self.n:
            return spark.createDataFrame([], "q_id string, doc_id string, score double")
        products = self._products(names, k1, b)
        most = max(4 * k * len(names), 500_000)

        def search(batches):
            floor, held, n_held = np.zeros(len(names)), [], 0
            for batch in batches:
                ids = batch.column("doc_id")
                for first, width, rows, scores in products(batch):
                    u, c = np.nonzero((scores > 0) & (scores >= floor[first : first + width] - 1e-8))
                    score = np.round(scores[u, c], 9)
                    c = c + first
                    u, c, score = (x[score >= floor[c]] for x in (u, c, score))
                    if len(u):
                        held.append((c, score, ids.take(pa.array(rows[u]))))
                        n_held += len(u)
                    if n_held > most:
                        best, (q, s) = kept(held, k)
                        held, n_held = [best], len(best[0])
                        floor[q] = s
            if held:
                q, s, d = kept(held, k)[0]
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()).take(pa.array(q)), d, pa.array(s)], names=["q_id", "doc_id", "score"])

        return self._dealt().mapInArrow(search, "q_id string, doc_id string, score double").repartition("q_id").groupBy("q_id", "doc_id").agg(F.max("score").alias("score"))

    def of_parents(self, wanted: dict[str, list[str]], names: list[str], k1: float, b: float) -> DataFrame:
        """(q_id, doc_id, score): every unit of the parents in `wanted` for the queries named there; a unit's parent is its id up to the first NUL."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        products, number = self._products(names, k1, b), {q: i for i, q in enumerate(names)}
        queries = {p: np.array(sorted(number[q] for q in qs)) for p, qs in wanted.items()}
        parents = pa.array(sorted(wanted), pa.string())

        def search(batches):
            for batch in batches:
                own = pa.array([x.split("\0", 1)[0] for x in batch.column("doc_id").to_pylist()], pa.string())
                some = pc.is_in(own, value_set=parents)
                batch, own = batch.filter(some), own.filter(some).to_pylist()
                found = []
                for first, width, rows, scores in products(batch):
                    for u, row in enumerate(rows):
                        c = queries[own[row]] - first
                        c = c[(c >= 0) & (c < width)]
                        found += [(names[i + first], row, s) for i, s in zip(c, np.round(scores[u, c], 9)) if scores[u, i] > 0]
                q, row, score = zip(*found) if found else ((), (), ())
                yield pa.RecordBatch.from_arrays([pa.array(q, pa.string()), batch.column("doc_id").take(pa.array(row, pa.int64())), pa.array(score, pa.float64())], names=["q_id", "doc_id", "score"])

        return self._dealt().mapInArrow(search, "q_id string, doc_id string, score double")

    def places(self, wanted: list[tuple[str, str, float]], names: list[str], k1: float, b: float) -> list[int]:
        """The place of each (query, unit, its score) in its query's order of all units, by score and then id; counted, nothing is sorted or shuffled.

        Wanted units stand in a list from the last to the first of a query, behind a mark before each query's
        own, and a task counts where its units fall between them.
        """
        from bisect import bisect_right

        import numpy as np
        import pyarrow as pa

        products, number = self._products(names, k1, b), {q: i for i, q in enumerate(names)}
        ids = sorted({u for _, u, _ in wanted})
        place, many, digits = {u: i for i, u in enumerate(ids)}, len(ids) + 1, 1e9
        q = np.array([*range(len(names)), *[number[a] for a, _, _ in wanted]], np.int64)
        score = np.array([*[0] * len(names), *np.rint(np.array([s for _, _, s in wanted]) * digits)], np.int64)
        after = np.array([*[0] * len(names), *[many - place[u] for _, u, _ in wanted]], np.int64)
        order = np.lexsort((after, score, q))
        shift = 62 - len(names).bit_length()  # of 4,096 queries, scores up to 560,000 have room
        key = (q << shift)[order] + score[order]
        run = np.cumsum(np.r_[0, key[1:] != key[:-1]])
        within = run * (many + 1) + after[order]
        lowest = np.full(len(names), np.inf)
        np.minimum.at(lowest, q[len(names) :], score[len(names) :] / digits)

        def count(batches):
            found = np.zeros(len(key) + 1, np.int64)
            for batch in batches:
                units, behind = batch.column("doc_id"), {}
                for first, width, rows, scores in products(batch):
                    u, c = np.nonzero((scores > 0) & (scores >= lowest[first : first + width] - 1e-8))
                    own = (c + first << shift) + np.rint(scores[u, c] * digits).astype(np.int64)
                    at = np.searchsorted(key, own)
                    tied = np.flatnonzero(key[np.minimum(at, len(key) - 1)] == own)
                    here, which = np.unique(rows[u[tied]], return_inverse=True)
                    for row in here.tolist():
                        if row not in behind:
                            behind[row] = many - bisect_right(ids, units[row].as_py())
                    level = np.array([behind[row] for row in here.tolist()], np.int64)[which]
                    at[tied] = np.searchsorted(within, run[at[tied]] * (many + 1) + level, "right")
                    found += np.bincount(at, minlength=len(found))
            at = np.flatnonzero(found)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(found[at])], names=["at", "n"])

        counts = np.zeros(len(key) + 1, np.int64)
        for r in self._dealt().mapInArrow(count, "at bigint, n bigint").groupBy("at").agg(F.sum("n").alias("n")).collect():
            counts[r["at"]] = r["n"]
        beyond = np.r_[np.cumsum(counts[::-1])[::-1], 0]  # units at this place of the list or behind, of this query and those after it
        ends = np.searchsorted(q[order], np.arange(len(names)), "right")
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        back = back[len(names) :]
        return (1 + beyond[back + 1] - beyond[ends[q[len(names) :]] + 1]).tolist()
