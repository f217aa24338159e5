"""Packing documents into fixed windows: concatenate and cut.

Pass one encodes every document once and writes its ids to the shared folder,
with the number of the writing partition and the ids before the document in
that partition.  The token totals of the partitions, one row each, give every
partition its global offset by a prefix sum.  Pass two places each document at
partition offset plus local offset in one endless stream and cuts the stream
every `window` ids; a document that crosses a cut gives one boundary record a
window.  Only the very last window is padded.

The written ids, not a second run of the encoder, fix the order, so a lost
executor or a retried task cannot move a document.  No row is shuffled.

Defined results: a null text is empty and consists of the closing id alone;
repeated rows are packed as often as they occur; an empty table gives no piece.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.llm.common import written
from lodestone.llm.tokens import default_vocabulary, worker_encoder

WINDOW, END_ID = 1024, 0
#: Rows of an output batch hold at most about so many ids.
BATCH_IDS = 2_000_000


def encoded(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", path: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Written table (doc_id, part, local, n, ids): ids as little-endian unsigned 32-bit."""
    path = path or default_vocabulary()
    narrow = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    id_type = narrow.schema["doc_id"].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    schema = pa.schema([("doc_id", to_arrow_type(id_type)), ("part", pa.int64()), ("local", pa.int64()), ("n", pa.int64()), ("ids", pa.binary())])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(path)
        part, local = TaskContext.get().partitionId(), 0
        for b in batches:
            start, rows = 0, []
            for k, x in enumerate(b.column(1)):
                ids = encoder.ids(x.as_py())
                ids.append(end_id)
                rows.append((local, len(ids), np.array(ids, "<u4").tobytes()))
                local += len(ids)
                if k + 1 == b.num_rows or local - rows[0][0] > BATCH_IDS:
                    at, n, data = zip(*rows)
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(start, len(rows)), pa.array([part] * len(rows), pa.int64()), pa.array(at, pa.int64()), pa.array(n, pa.int64()), pa.array(data, pa.binary())], schema=schema)
                    start, rows = k + 1, []

    return written(narrow.mapInArrow(encode, f"doc_id {id_type.simpleString()}, part bigint, local bigint, n bigint, ids binary"), "ids")


def packed(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", path: str | None = None, window: int = WINDOW, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids)."""
    stream = encoded(docs, text, doc_id, path, end_id)
    totals = stream.groupBy("part").agg(F.sum("n").alias("total"))
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    base = totals.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    placed = stream.join(F.broadcast(base), "part").select("doc_id", "n", "ids", (F.col("base") + F.col("local")).alias("at"))
    id_type = placed.schema["doc_id"].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    fields = [("doc_id", to_arrow_type(id_type))] + [(c, pa.int64()) for c in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")]
    schema = pa.schema(fields + [("ids", pa.binary())] * with_ids)
    ddl = f"doc_id {id_type.simpleString()}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint" + ", ids binary" * with_ids

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            owner, rows = [], []
            for k, (n, ids, at) in enumerate(zip(b.column(1).to_pylist(), b.column(2), b.column(3).to_pylist())):
                data, start = memoryview(ids.as_buffer()), 0
                while start < n:
                    sequence, offset = divmod(at + start, window)
                    length = min(n - start, window - offset)
                    piece = data[4 * start : 4 * (start + length)]
                    owner.append(k)
                    rows.append((start, length, zlib.crc32(piece), n, sequence, offset, *([bytes(piece)] if with_ids else [])))
                    start += length
            if rows:
                columns = [b.column(0).take(pa.array(owner))] + [pa.array(x, schema.field(i + 1).type) for i, x in enumerate(zip(*rows))]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return placed.mapInArrow(cut, ddl)
