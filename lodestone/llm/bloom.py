"""A pair of Bloom filters for once-seen and twice-seen hashes, built in segments."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

MIN_BITS, MAX_BITS, BITS_A_KEY = 16, 29, 8
SEGMENTS = 64


def positions(hashes: np.ndarray, bits: int) -> np.ndarray:
    """Two bit positions a hash: from its high and, by another mix, its low half."""
    second = hashes * np.uint64(0x9E3779B97F4A7C15)
    return np.stack([hashes >> np.uint64(64 - bits), second >> np.uint64(64 - bits)])


def filter_bits(keys: int) -> int:
    """Size of a filter, as a power of two: bounded, else about 8 bits a key."""
    return min(max(int(np.ceil(np.log2(max(keys, 1) * BITS_A_KEY))), MIN_BITS), MAX_BITS)


def twice_seen(rows: DataFrame, hashes_of: Callable[[pa.RecordBatch], list[np.ndarray]], bits: int) -> np.ndarray:
    """The twice-seen filter as a packed bit map of 2 ** bits bits.

    `hashes_of` gives the distinct hashes of each document of a batch.  A task
    sends, by segment, the positions of hashes that it saw and of those that it
    saw twice; a segment marks as seen twice what came twice or was sent so.
    """
    shift = np.uint64(bits - int(np.log2(SEGMENTS)))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hashes = hashes_of(b)
            seen, counts = np.unique(np.concatenate(hashes) if hashes else np.zeros(0, np.uint64), return_counts=True)
            for k, x in enumerate((seen, seen[counts > 1])):
                places = np.unique(positions(x, bits))
                cuts = np.searchsorted(places >> shift, np.arange(SEGMENTS + 1, dtype=np.uint64))
                full = [s for s in range(SEGMENTS) if cuts[s] < cuts[s + 1]]
                data = [(places[cuts[s] : cuts[s + 1]] & np.uint64((1 << int(shift)) - 1)).astype("<u4").tobytes() for s in full]
                if full:
                    yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array([k == 1] * len(full)), pa.array(data, pa.binary())], ["segment", "twice", "places"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = {}, {}
        for b in batches:
            for s, again, places in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                p = np.frombuffer(places.as_buffer(), "<u4")
                for m in (once, twice):
                    m.setdefault(s, np.zeros(1 << int(shift), bool))
                if again:
                    twice[s][p] = True
                else:
                    twice[s][p[once[s][p]]] = True
                    once[s][p] = True
        for s, m in twice.items():
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([np.packbits(m, bitorder="little").tobytes()], pa.binary())], ["segment", "bits"])

    sent = rows.mapInArrow(gather, "segment int, twice boolean, places binary")
    merged = sent.repartition(SEGMENTS, "segment").mapInArrow(merge, "segment int, bits binary")
    out = np.zeros(1 << (bits - 3), np.uint8)
    size = len(out) // SEGMENTS
    for r in merged.toLocalIterator():  # 64 rows, at most 2 ** MAX_BITS bits in all
        out[r.segment * size : (r.segment + 1) * size] = np.frombuffer(r.bits, np.uint8)
    return out


def seen_twice(hashes: np.ndarray, bit_map: np.ndarray, bits: int) -> np.ndarray:
    """For each hash, whether the filter has it."""
    hit = np.ones(len(hashes), bool)
    for p in positions(hashes, bits):
        hit &= (bit_map[p >> np.uint64(3)] >> (p & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
    return hit
