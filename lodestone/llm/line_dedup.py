"""Line deduplication with two Bloom filters.

A line's key is the line stripped of white space at both ends, A-Z in lower
case.  Pass one gathers the filter bits of all keys: each task sends the bit
positions of the keys it saw once or more, and of those it saw twice, to the
segment of the filters that holds them; a segment keeps a once-seen and a
twice-seen bit map of fixed size (a bit that two tasks saw once is seen twice).
The twice-seen filter, at most 2 ** 29 bits however large the corpus, is
broadcast.  Pass two sends only the keys that it suspects into a shuffle, added
up per batch first, where they are counted exactly and their first occurrence is
chosen.  Pass three takes the lines out: the confirmed keys are broadcast if
their measured size is at most `broadcast_bytes`; else suspected keys are joined
with them and brought back to their document by its id.

A key that occurs in at least `least` documents is repeated.  Either all its
lines go (`keep="none"`), or all but the one with the smallest (id, line number)
(`keep="first"`).

Defined results: a null or empty text is one empty line; a line without
characters besides white space is never dropped; every row counts as a document
of its own, so repeated rows add up; rows with a null id come after all others
in the order of occurrences; where rows share the id of a first occurrence, the
line stays in each of them.  An input column named `_lines` is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.bloom import filter_bits, seen_twice, twice_seen
from lodestone.llm.common import written

BROADCAST_BYTES = 16 << 20


def _keys(data: bytes) -> list[bytes]:
    """The keys of all lines; bytes.lower and bytes.strip know ASCII alone."""
    return [x.strip() for x in data.lower().split(b"\n")]


def _hashed(keys: list[bytes]) -> np.ndarray:
    from xxhash import xxh3_64_intdigest as h

    return np.array([h(k) for k in keys], np.uint64)


def _suspected(keys: list[bytes], bit_map: np.ndarray, bits: int) -> list[bytes]:
    keys = [k for k in keys if k]
    if not keys:
        return keys
    hit = seen_twice(_hashed(keys), bit_map, bits)
    return [k for k, x in zip(keys, hit) if x]


def _hashes_of(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [_hashed([k for k in set(_keys(x.as_py())) if k]) for x in batch.column(0)]


def repeated_keys(docs: DataFrame, least: int, shared, bits: int) -> DataFrame:
    """Written table (key, first_id, first_line) of the keys in at least `least` rows."""
    id_type = docs.schema["_id"].dataType.simpleString()

    def suspects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found: dict[bytes, list] = {}
            for doc, x in zip(b.column(0).to_pylist(), b.column(1)):
                lines = _keys(x.as_py())
                place: dict[bytes, int] = {}
                for i, k in enumerate(lines):
                    place.setdefault(k, i)
                for k in _suspected(list(place), shared.value, bits):
                    at = (doc is None, doc, place[k])
                    had = found.setdefault(k, [0, at])
                    had[0] += 1
                    if at[0] < had[1][0] or (at[0] == had[1][0] and at[1:] < had[1][1:] if not at[0] else False):
                        had[1] = at
            keys = list(found)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.binary()), pa.array([found[k][0] for k in keys], pa.int64()), pa.array([found[k][1][1] for k in keys], b.column(0).type), pa.array([found[k][1][2] for k in keys], pa.int64())],
                ["key", "n", "first_id", "first_line"],
            )

    sent = docs.mapInArrow(suspects, f"key binary, n bigint, first_id {id_type}, first_line bigint")
    first = F.min(F.struct(F.col("first_id").isNull().alias("none"), "first_id", "first_line"))
    counted = sent.groupBy("key").agg(F.sum("n").alias("n"), first.alias("first")).filter(F.col("n") >= least)
    return written(counted.select("key", "first.first_id", "first.first_line"), "lines")


def _without(doc, data: bytes, repeated: dict, keep_first: bool) -> tuple[bytes, int, int]:
    """The kept text, its number of lines before, and how many went."""
    lines, kept = data.split(b"\n"), []
    for i, (line, key) in enumerate(zip(lines, _keys(data))):
        first = repeated.get(key)
        if first is None or (keep_first and first == (doc, i)):
            kept.append(line)
    return b"\n".join(kept), len(lines), len(lines) - len(kept)


def deduplicated(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", least: int = 2, keep: str = "first", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """The input with its text replaced, and the struct `_lines`: n_lines, n_dropped."""
    spark, keep_first = docs.sparkSession, keep == "first"
    others = [c for c in docs.columns if c not in (text, "_lines")]
    narrow = docs.select(F.col(doc_id).alias("_id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("_data"))
    whole = F.coalesce(F.col(text), F.lit(""))
    lines = docs.agg(F.sum(1 + F.octet_length(whole) - F.octet_length(F.replace(whole, F.lit("\n"), F.lit(""))))).first()[0] or 0
    bits = filter_bits(lines)
    shared = spark.sparkContext.broadcast(twice_seen(narrow.select("_data"), _hashes_of, bits))
    repeated = repeated_keys(narrow, least, shared, bits)
    size = repeated.agg(F.sum(F.octet_length("key") + 40)).first()[0] or 0
    rows = docs.select(F.col(doc_id).alias("_id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("_data"), F.struct(*[F.col(f"`{c}`") for c in others]).alias("_rest") if others else F.lit(None).cast("struct<x:int>").alias("_rest"))
    if size <= broadcast_bytes:
        held = repeated.toArrow()  # at most broadcast_bytes
        found = spark.sparkContext.broadcast({k: (i, n) for k, i, n in zip(*(held[c].to_pylist() for c in ("key", "first_id", "first_line")))})
        rows = rows.withColumn("_found", F.lit(None).cast("array<struct<key:binary,first_line:bigint>>"))
    else:
        found, rows = None, _joined(rows, narrow, repeated, shared, bits, keep_first)

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, out = b.column(0).to_pylist(), []
            for i, (x, own) in enumerate(zip(b.column(1), b.column(3))):
                table = found.value if found is not None else {y["key"]: (ids[i], y["first_line"]) for y in own.as_py() or ()}
                out.append(_without(ids[i], x.as_py(), table, keep_first))
            kept, n, dropped = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column(2), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(n, pa.int64()), pa.array(dropped, pa.int64())], ["_rest", "_text", "n_lines", "n_dropped"])

    rest = rows.schema["_rest"].dataType.simpleString()
    done = rows.select("_id", "_data", "_rest", "_found").mapInArrow(strip, f"_rest {rest}, _text string, n_lines bigint, n_dropped bigint")
    columns = [F.col("_text").alias(c) if c == text else F.col("_rest")[c].alias(c) for c in docs.columns if c != "_lines"]
    return done.select(*columns, F.struct("n_lines", "n_dropped").alias("_lines"))


def _joined(rows: DataFrame, narrow: DataFrame, repeated: DataFrame, shared, bits: int, keep_first: bool) -> DataFrame:
    """Brings every document its own repeated keys: (key, first_line or -1).

    A document is known by its id and the hash of its text, so that rows
    without an id don't meet in one group.
    """
    id_type = narrow.schema["_id"].dataType.simpleString()
    narrow = narrow.select("_id", "_data", F.xxhash64("_data").alias("_row"))

    def suspects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            owner, keys = [], []
            for i, x in enumerate(b.column(1)):
                own = _suspected(list(set(_keys(x.as_py()))), shared.value, bits)
                owner += [i] * len(own)
                keys += own
            at = pa.array(owner, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(2).take(at), pa.array(keys, pa.binary())], ["doc", "row", "key"])

    own = narrow.mapInArrow(suspects, f"doc {id_type}, row bigint, key binary").join(repeated, "key")
    line = F.when(F.col("doc").eqNullSafe(F.col("first_id")), F.col("first_line")).otherwise(F.lit(-1).cast("bigint"))
    brought = own.groupBy("doc", "row").agg(F.collect_set(F.struct("key", line.alias("first_line"))).alias("_found"))
    return rows.join(brought, (F.xxhash64(rows["_data"]) == brought["row"]) & rows["_id"].eqNullSafe(brought["doc"]), "left")
