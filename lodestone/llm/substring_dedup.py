"""Substring deduplication with compressed FM-indexes, one a shard.

A window is `length` consecutive words.  A word goes if a window that covers it
has the same words as a window that starts in a document with a smaller id.

Routing.  Every window picks, among the hashes of its runs of GRAM words, the
least (the leftmost of equals), its anchor; equal windows pick equal anchors.
A twice-seen Bloom filter of anchors (bounded, broadcast) tells which anchors
may occur in two documents; only text around those goes on, as segments: the
words of consecutive windows with one anchor.  Equal segments are added up
before anything else, with their smallest and largest document.

Matching.  The distinct segments are dealt out by anchor.  A shard takes whole
anchors up to about SHARD_WORDS words and builds an FM-index: suffix order by
prefix doubling, the Burrows-Wheeler transform in a wavelet tree of packed bit
vectors with block ranks, and the block starts of equal (length - 1)- and
length-word prefixes.  All segments of the shard are then streamed through it
from right to left together: a backward step extends each match by a word, and
a match that would pass `length` words is first cut back by one.  Where the
matching statistic reaches `length`, the smallest document of the suffix
interval is the window's first occurrence.

Hot anchors.  An anchor with more than `hot` distinct segments (boilerplate
inside many different texts) is split before it is indexed.  Windows of one
anchor are aligned at it, so each has a place from -(length - GRAM) to 0, and
all windows of a range of places contain the same core: the words from the last
place to the end of the first window.  A hot key's range of places is halved,
and each half of a segment goes on under the hash of its core, which has 29
words after one step and 40, 45, 48, 49 and 50 after the next.  Equal windows
share every core.  A segment makes two rows a step, halves that became equal are
added up again, and a core of one document goes no further; at the last step a
key has one distinct segment.  So each leaf fits an FM-index, and its matches
climb back over (parent, child) rows.

Defined results: a null or empty text has no words; a row without an id removes
nothing and loses nothing; rows with equal ids are one document and don't
remove each other's words, whether their texts are equal or not; texts shorter
than a window stay as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.bloom import filter_bits, seen_twice, twice_seen
from lodestone.llm.common import written

LENGTH, GRAM = 50, 8
SHARD_WORDS, HOT = 120_000, 1_000
BATCH_WORDS = 120_000


# --- anchors ---------------------------------------------------------------


def _word_hashes(words: list[bytes]) -> np.ndarray:
    from xxhash import xxh3_64_intdigest as h

    return np.array([h(w) for w in words], np.uint64)


def _anchors(hashes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window of a word sequence: place and hash of its anchor."""
    n = len(hashes)
    gram = np.zeros(n - GRAM + 1, np.uint64)
    for i in range(GRAM):
        gram = gram * np.uint64(0x9E3779B97F4A7C15) + hashes[i : n - GRAM + 1 + i]
    gram = (gram ^ (gram >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    gram ^= gram >> np.uint64(29)
    size = length - GRAM + 1  # runs of GRAM words in a window
    best, span = np.arange(len(gram)), 1
    while span * 2 <= size:
        a, b = best[: len(best) - span], best[span:]
        best, span = np.where(gram[a] <= gram[b], a, b), span * 2
    if span < size:
        a, b = best[: n - length + 1], best[size - span : size - span + n - length + 1]
        best = np.where(gram[a] <= gram[b], a, b)
    return best, gram[best]


def _batches_of_words(column: pa.Array) -> Iterator[tuple[list[int], list[bytes], np.ndarray]]:
    """Documents of a batch in groups: their rows, all words, and where each begins."""
    rows, words, starts = [], [], []
    for i, x in enumerate(column):
        w = (x.as_py() or b"").split()
        rows.append(i)
        starts.append(len(words))
        words += w
        if len(words) >= BATCH_WORDS:
            yield rows, words, np.array([*starts, len(words)])
            rows, words, starts = [], [], []
    if rows:
        yield rows, words, np.array([*starts, len(words)])


def _runs(words: list[bytes], starts: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Runs of windows with one anchor: first window, windows, anchor, document number, place of the anchor."""
    none = np.zeros(0, np.int64)
    if len(words) < length:
        return none, none, none.astype(np.uint64), none, none
    place, anchor = _anchors(_word_hashes(words), length)
    window = np.arange(len(place))
    doc = np.searchsorted(starts, window, "right") - 1
    whole = window + length <= starts[doc + 1]
    new = np.ones(len(place), bool)
    new[1:] = (place[1:] != place[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    ends = np.concatenate([first[1:], [len(place)]])
    counted = np.concatenate([[0], np.cumsum(whole)])
    n = counted[ends] - counted[first]  # windows that don't reach into the next document come first
    keep = n > 0
    first, n = first[keep], n[keep]
    return first, n, anchor[first], doc[first], place[first]


def _hashes_of(length: int):
    def hashes(batch: pa.RecordBatch) -> list[np.ndarray]:
        out = []
        for _, words, starts in _batches_of_words(batch.column(0)):
            _, _, anchor, doc, _ = _runs(words, starts, length)
            if len(anchor):
                pairs = np.unique(np.stack([doc.astype(np.uint64), anchor], axis=1), axis=0)
                out += [pairs[:, 1]]
        # one array a group of documents: an anchor that two of them share is in it twice
        return out

    return hashes


# --- FM-index --------------------------------------------------------------


class WaveletTree:
    """Ranks of symbols in a sequence, by levels of packed bits with block counts."""

    def __init__(self, sequence: np.ndarray, symbols: int):
        self.levels = max(int(symbols - 1).bit_length(), 1)
        self.words, self.blocks, self.zeros = [], [], []
        x = sequence.astype(np.int64)
        for level in range(self.levels - 1, -1, -1):
            bit = (x >> level) & 1
            padded = np.zeros((len(x) // 64 + 1) * 64, np.uint8)
            padded[: len(x)] = bit
            packed = np.packbits(padded, bitorder="little").view("<u8")
            self.words.append(packed)
            self.blocks.append(np.concatenate([[0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)]).astype(np.int32))
            self.zeros.append(int(len(x) - bit.sum()))
            x = np.concatenate([x[bit == 0], x[bit == 1]])

    def _ones(self, k: int, i: np.ndarray) -> np.ndarray:
        block, rest = i >> 6, (i & 63).astype(np.uint64)
        mask = (np.uint64(1) << rest) - np.uint64(1)
        return self.blocks[k][block] + np.bitwise_count(self.words[k][block] & mask)

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol among the first i places."""
        low = np.zeros_like(i)
        for k in range(self.levels):
            one = ((symbol >> (self.levels - 1 - k)) & 1).astype(bool)
            a, b = self._ones(k, low), self._ones(k, i)
            low, i = np.where(one, self.zeros[k] + a, low - a), np.where(one, self.zeros[k] + b, i - b)
        return i - low


class FMIndex:
    """Index of a word sequence; 0 separates segments, words are 1 .. symbols - 1."""

    def __init__(self, text: np.ndarray, symbols: int, length: int):
        n = len(text)
        rank, h = np.unique(text, return_inverse=True)[1].astype(np.int64), 1
        ranks = {1: rank}
        while h < length:
            after = np.zeros(n, np.int64)
            after[: n - h] = rank[h:] + 1
            rank = np.unique(rank * (n + 2) + after, return_inverse=True)[1].astype(np.int64)
            h *= 2
            if h < length:
                ranks = {h: rank}  # the longest prefix within a window is all that block starts need
        order = np.argsort(rank, kind="stable")
        self.order, self.tree = order, WaveletTree(text[order - 1], symbols)
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=symbols))])
        self.start = {m: self._starts(ranks, m, order, n) for m in (length - 1, length)}

    @staticmethod
    def _starts(ranks: dict[int, np.ndarray], m: int, order: np.ndarray, n: int) -> np.ndarray:
        """Block starts of equal m-word prefixes, in suffix order, and the end."""
        h = max(x for x in ranks if x <= m)
        tail = np.full(n, -1, np.int64)
        tail[: n - (m - h)] = ranks[h][m - h :]
        a, b = ranks[h][order], tail[order]
        return np.concatenate([[0], np.flatnonzero((a[1:] != a[:-1]) | (b[1:] != b[:-1])) + 1, [n]])

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the matches with one more word in front."""
        base = self.before[symbol]
        return base + self.tree.rank(symbol, low), base + self.tree.rank(symbol, high)

    def cut_back(self, low: np.ndarray, high: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the first m words of the matches."""
        k = np.searchsorted(self.start[m], low, "right") - 1
        return self.start[m][k], self.start[m][k + 1]


def first_documents(segments: list[np.ndarray], docs: np.ndarray, symbols: int, length: int) -> list[np.ndarray]:
    """For every window of every segment, the smallest document that has it."""
    sizes = np.array([len(x) for x in segments])
    text = np.concatenate([np.append(x, 0) for x in segments])
    starts = np.concatenate([[0], np.cumsum(sizes + 1)])[:-1]
    index = FMIndex(text, symbols, length)
    owner = np.repeat(np.arange(len(segments)), sizes + 1)
    blocks = index.start[length]
    least = np.minimum.reduceat(docs[owner[index.order]], blocks[:-1])
    out = [np.zeros(max(n - length + 1, 0), docs.dtype) for n in sizes]
    # The longest segments first, so that those still being streamed are a prefix.
    by_size = np.argsort(-sizes, kind="stable")
    low, high = np.zeros(len(segments), np.int64), np.full(len(segments), len(text), np.int64)
    found = np.zeros(starts[-1] + sizes[-1] + 1, docs.dtype)
    for step in range(int(sizes.max())):
        active = by_size[: np.searchsorted(-sizes[by_size], -step, "left")]
        place = starts[active] + sizes[active] - 1 - step
        a, b = low[active], high[active]
        if step >= length:
            a, b = index.cut_back(a, b, length - 1)
        a, b = index.extend(text[place], a, b)
        low[active], high[active] = a, b
        if step >= length - 1:
            found[place] = least[np.searchsorted(blocks, a, "right") - 1]
    for k, (s, o) in enumerate(zip(starts, out)):
        out[k] = found[s : s + len(o)]
    return out


# --- operator --------------------------------------------------------------


def _segments(docs: DataFrame, length: int, shared, bits: int) -> DataFrame:
    """(key, segment, doc, row, start, at, words) of the runs with suspected anchors.

    `at` is the first window's place, counted from the anchor.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for b in batches:
            ids, hashes = b.column(0), b.column(1)
            for rows, words, starts in _batches_of_words(b.column(2)):
                first, n, anchor, doc, place = _runs(words, starts, length)
                hit = np.flatnonzero(seen_twice(anchor, shared.value, bits))
                texts = [b" ".join(words[s : s + m + length - 1]) for s, m in zip(first[hit].tolist(), n[hit].tolist())]
                if texts:
                    of = pa.array(np.array(rows)[doc[hit]])
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(anchor[hit].astype(np.int64)),
                            pa.array([xxhash.xxh3_128_digest(t) for t in texts], pa.binary()),
                            ids.take(of),
                            hashes.take(of),
                            pa.array(first[hit] - starts[doc[hit]]),
                            pa.array((first - place)[hit].astype(np.int32)),
                            pa.array(texts, pa.binary()),
                        ],
                        ["key", "segment", "doc", "row", "start", "at", "words"],
                    )

    return written(docs.mapInArrow(cut, "key bigint, segment binary, doc bigint, row bigint, start bigint, at int, words binary"), "segments")


def _indexed(distinct: DataFrame, length: int, shard_words: int) -> DataFrame:
    """(segment, firsts): for each window of a segment, its first document, by FM-indexes."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def shard(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
            number: dict[bytes, int] = {}
            segments = [np.array([number.setdefault(w, len(number) + 1) for w in r[4].split(b" ")], np.int64) for r in rows]
            firsts = first_documents(segments, np.array([r[2] for r in rows], np.int64), len(number) + 1, length)
            hits = [(r[1], f.tolist()) for r, f in zip(rows, firsts) if (f < r[3]).any()]
            if hits:
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in hits], pa.binary()), pa.array([x for _, x in hits], pa.list_(pa.int64()))], ["segment", "firsts"])

        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns)):
                if size >= shard_words and row[0] != held[-1][0]:
                    yield from shard(held)
                    held, size = [], 0
                held.append(row)
                size += row[4].count(b" ") + 2
        if held:
            yield from shard(held)

    dealt = distinct.repartition("key").sortWithinPartitions("key").select("key", "segment", "low", "high", "words")
    return dealt.mapInArrow(search, "segment binary, firsts array<bigint>")


def halves(words: list[bytes], at: int, lo: int, hi: int, length: int) -> Iterator[tuple[int, int, int, int]]:
    """The two halves of a segment of windows at places `at` and on, within lo..hi.

    Yields (lo, hi, first place, last place) of each half that has a window.
    """
    end, middle = at + len(words) - length, (lo + hi) // 2
    for a, z in ((lo, middle), (middle + 1, hi)):
        if max(at, a) <= min(end, z):
            yield a, z, max(at, a), min(end, z)


def _split(hot: DataFrame, length: int) -> DataFrame:
    """Both halves of the segments of hot keys, each under its core: (parent, shift) say where from."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        kinds = {"parent": pa.binary(), "shift": pa.int64(), "key": pa.int64(), "segment": pa.binary(), "low": pa.int64(), "high": pa.int64(), "at": pa.int32(), "lo": pa.int32(), "hi": pa.int32(), "words": pa.binary()}
        for b in batches:
            out = []
            for parent, low, high, at, lo, hi, data in zip(*(b.column(c).to_pylist() for c in ("segment", "low", "high", "at", "lo", "hi", "words"))):
                words = data.split(b" ")
                for a, z, s, e in halves(words, at, lo, hi, length):
                    part, core = b" ".join(words[s - at : e - at + length]), b" ".join(words[z - at : a - at + length])
                    where = a.to_bytes(4, "little", signed=True) + s.to_bytes(4, "little", signed=True)
                    key = xxhash.xxh3_64_intdigest(where[:4] + core) - (1 << 63)
                    out.append((parent, s - at, key, xxhash.xxh3_128_digest(where + part), low, high, s, a, z, part))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out), kinds.values())], list(kinds))

    return hot.mapInArrow(split, "parent binary, shift bigint, key bigint, segment binary, low bigint, high bigint, at int, lo int, hi int, words binary")


def _matches(distinct: DataFrame, length: int, hot: int, shard_words: int) -> DataFrame:
    """(segment, some): windows of a segment with their first documents, hot keys split first.

    distinct: (key, segment, low, high, at, lo, hi, words).
    """
    names, leaves, children = distinct.columns, None, []
    now = distinct
    while True:
        counts = now.groupBy("key").agg(F.count(F.lit(1)).alias("_n"), F.min("low").alias("_a"), F.max("high").alias("_b")).filter("_a < _b")
        # One place is one window: its key has one distinct segment and needs no split.
        counts = written(counts.select("key", (F.col("_n") > hot).alias("_hot")), "keys")
        known = now.join(counts, "key")
        cold = known.filter(~F.col("_hot") | (F.col("lo") == F.col("hi"))).select(*names)
        leaves = cold if leaves is None else leaves.unionByName(cold)
        if not counts.filter("_hot").head(1):
            break
        split = written(_split(known.filter(F.col("_hot") & (F.col("lo") < F.col("hi"))).select(*names), length), "halves")
        children.append(split.select("parent", "shift", F.col("segment").alias("child")))
        least = {c: F.min(c) for c in names if c not in ("key", "segment")} | {"high": F.max("high")}
        now = written(split.groupBy("key", "segment").agg(*[f.alias(c) for c, f in least.items()]).select(*names), "distinct")
        if not now.head(1):
            break
    some = F.transform("firsts", lambda x, i: F.struct(i.cast("bigint").alias("at"), x.alias("first")))
    matches = written(_indexed(leaves, length, shard_words).select("segment", some.alias("some")), "matches")
    climbed = None
    for links in reversed(children):
        below = matches if climbed is None else matches.unionByName(climbed)
        moved = F.transform("some", lambda e: F.struct((e["at"] + F.col("shift")).alias("at"), e["first"].alias("first")))
        climbed = links.join(below, links["child"] == below["segment"]).select(F.col("parent").alias("segment"), moved.alias("some"))
    return matches if climbed is None else matches.unionByName(climbed)


def removed_ranges(docs: DataFrame, length: int = LENGTH, hot: int = HOT, shard_words: int = SHARD_WORDS) -> DataFrame:
    """(doc, row, begins): where windows that go begin, for rows that lose any.

    docs: (_id long, _row long, _data binary); a row is known by its id and the
    hash `_row` of its text, and rows without an id are left out.
    """
    usable = docs.filter(F.col("_id").isNotNull())
    size = usable.agg(F.sum(F.octet_length("_data"))).first()[0] or 0
    bits = filter_bits(size // 140)  # about one anchor in 22 words
    shared = docs.sparkSession.sparkContext.broadcast(twice_seen(usable.select("_data"), _hashes_of(length), bits))
    found = _segments(usable, length, shared, bits)
    distinct = found.groupBy("key", "segment").agg(F.min("doc").alias("low"), F.max("doc").alias("high"), F.min("at").alias("at"), F.min("words").alias("words"))
    distinct = distinct.select("key", "segment", "low", "high", "at", F.lit(GRAM - length).alias("lo"), F.lit(0).alias("hi"), "words")
    matches = written(_matches(written(distinct, "distinct"), length, hot, shard_words), "matches")
    hits = found.select("segment", "doc", "row", "start").join(matches, "segment")
    mine = F.transform(F.filter("some", lambda e: e["first"] < F.col("doc")), lambda e: F.col("start") + e["at"])
    begins = hits.select("doc", "row", mine.alias("at")).filter(F.size("at") > 0)
    return begins.groupBy("doc", "row").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("at")))).alias("begins"))


def deduplicated(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", length: int = LENGTH, hot: int = HOT, shard_words: int = SHARD_WORDS) -> DataFrame:
    """(doc_id, kept, n_words, n_removed, spans): kept words joined by one space; spans that went."""
    data = F.coalesce(F.col(text), F.lit("")).cast("binary")
    rows = docs.select(F.col(doc_id).cast("bigint").alias("_id"), F.xxhash64(data).alias("_row"), data.alias("_data"))
    gone = removed_ranges(rows, length, hot, shard_words)
    both = rows.join(gone, (rows["_id"] == gone["doc"]) & (rows["_row"] == gone["row"]), "left").select("_id", "_data", "begins")

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept, n, removed, spans = [], [], [], []
            for x, begins in zip(b.column(1), b.column(2)):
                words = x.as_py().split()
                stay, cuts = np.ones(len(words), bool), []
                if begins.is_valid:
                    for s in begins.as_py():
                        if cuts and s <= cuts[-1][1]:
                            cuts[-1][1] = s + length
                        else:
                            cuts.append([s, s + length])
                for s, e in cuts:
                    stay[s:e] = False
                kept.append(b" ".join(words if not cuts else [words[i] for i in np.flatnonzero(stay)]))
                n.append(len(words))
                removed.append(int(len(words) - stay.sum()))
                spans.append(cuts)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.list_(pa.list_(pa.int64())))], ["doc_id", "kept", "n_words", "n_removed", "spans"])

    return both.mapInArrow(strip, "doc_id bigint, kept string, n_words bigint, n_removed bigint, spans array<array<bigint>>")
