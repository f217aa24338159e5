"""The bounded thread ledger on a stream: one state a thread, limits checked before a turn is kept."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUTPUT = "thread bigint, seq bigint, accepted boolean, reason string, kept bigint, bytes bigint"
STATE = "seq bigint, kept bigint, bytes bigint"


def ledger_stream(turns: DataFrame, max_turns: int = 3, max_bytes: int = 2_000) -> DataFrame:
    """turns(thread, seq, input, response) as a stream -> a row a turn: kept, or why it was rejected.

    Turns of a thread are taken in sequence order within a micro-batch; a
    sequence number that doesn't follow the last one seen is rejected.
    """

    def append(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen, kept, size = state.get if state.exists else (0, 0, 0)
        out = []
        for row in pd.concat(list(frames)).sort_values("seq").itertuples():  # one thread's turns of a micro-batch
            n = len(row.input.encode()) + len(row.response.encode())
            reason = "not_contiguous" if row.seq != seen + 1 else "turn_limit" if kept + 1 > max_turns else "byte_limit" if size + n > max_bytes else ""
            if reason != "not_contiguous":
                seen = row.seq
            if not reason:
                kept, size = kept + 1, size + n
            out.append((key[0], row.seq, not reason, reason, kept, size))
        state.update((int(seen), int(kept), int(size)))
        yield pd.DataFrame(out, columns=["thread", "seq", "accepted", "reason", "kept", "bytes"])

    return turns.groupBy("thread").applyInPandasWithState(append, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout)


CLOSING = "thread bigint, kind string, seq bigint, accepted boolean, reason string, kept bigint, bytes bigint"


def closing_stream(events: DataFrame, idle: str = "30 minutes", max_turns: int = 3, max_bytes: int = 2_000) -> DataFrame:
    """events(thread, kind, seq, input, response, ts): turns and closes of threads -> a row an event, and a summary a thread.

    `ts` carries a watermark.  A thread opens with its first turn.  A close gives a
    summary row with reason `closed`; later turns and closes are rejected while the
    closed thread is remembered.  A thread without an event for `idle` of event time
    gives a summary with reason `expired` if it was open, and its state goes,
    so state is bounded by the threads of that time.
    """
    wait = int(events.sparkSession.sql(f"SELECT CAST(unix_micros(TIMESTAMP '1970-01-01 00:00:00' + INTERVAL {idle}) - unix_micros(TIMESTAMP '1970-01-01 00:00:00') AS BIGINT) AS n").first().n // 1000)
    names = ["thread", "kind", "seq", "accepted", "reason", "kept", "bytes"]

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen, kept, size, closed, last = state.get if state.exists else (0, 0, 0, False, 0)
        if state.hasTimedOut:
            state.remove()
            rows = [] if closed else [(key[0], "summary", seen, True, "expired", kept, size)]
            yield pd.DataFrame(rows, columns=names)
            return
        out = []
        for row in pd.concat(list(frames)).sort_values(["ts", "seq"]).itertuples():  # one thread's events of a micro-batch
            last = max(last, int(row.ts.timestamp() * 1000))
            if closed:
                out.append((key[0], row.kind, row.seq, False, "thread_closed", kept, size))
            elif row.kind == "close":
                closed = True
                out.append((key[0], "summary", seen, True, "closed", kept, size))
            else:
                n = len((row.input or "").encode()) + len((row.response or "").encode())
                reason = "not_contiguous" if row.seq != seen + 1 else "turn_limit" if kept + 1 > max_turns else "byte_limit" if size + n > max_bytes else ""
                if reason != "not_contiguous":
                    seen = row.seq
                if not reason:
                    kept, size = kept + 1, size + n
                out.append((key[0], "turn", row.seq, not reason, reason, kept, size))
        state.update((int(seen), int(kept), int(size), bool(closed), int(last)))
        state.setTimeoutTimestamp(max(last, state.getCurrentWatermarkMs()) + wait)
        yield pd.DataFrame(out, columns=names)

    kept_state = STATE + ", closed boolean, last bigint"
    return events.groupBy("thread").applyInPandasWithState(step, CLOSING, kept_state, "append", GroupStateTimeout.EventTimeTimeout)


def latency_stream(events: DataFrame, late: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """Counts and mean latency by node and event-time window, late rows dropped after the watermark."""
    from pyspark.sql import functions as F

    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", window), "event_type").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("average"))
