"""Conversation threads: bounded ledgers, transitions and latencies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.operators import ordered

# The transition table of the bounded workflow.
TRANSITIONS = [
    ("received", "validate_request", "validated"), ("validated", "retrieve_candidate_pool", "retrieved"), ("retrieved", "prepare_context", "context_prepared"),
    ("context_prepared", "select_compose", "decided_compose"), ("context_prepared", "select_refuse", "decided_refuse"), ("decided_compose", "compose_grounded_answer", "answered"),
    ("answered", "verify_grounded_answer", "verified"), ("verified", "observe_diagnostics", "observed"), ("observed", "complete", "complete"), ("observed", "refuse", "refuse"), ("decided_refuse", "refuse", "refuse"),
]


def turns(conversations: DataFrame) -> DataFrame:
    """(thread, seq, input, response, bytes): a user turn and the assistant turn right after it."""
    w = W.partitionBy("conv_id").orderBy("turn")
    spoken = conversations.filter("role <> 'system'")
    both = spoken.withColumn("next_role", F.lead("role").over(w)).withColumn("response", F.lead("text").over(w))
    both = both.filter("role = 'user' and next_role = 'assistant'")
    size = F.octet_length("text") + F.octet_length("response")
    return both.select(F.col("conv_id").alias("thread"), F.row_number().over(w).alias("seq"), F.col("text").alias("input"), "response", size.alias("bytes"))


def ledger(rows: DataFrame, max_turns: int = 3, max_bytes: int = 2_000) -> DataFrame:
    """(thread, offered, kept, bytes): turns appended in order under both limits.

    A turn that would pass a limit is rejected and doesn't count; later ones may
    still fit, so the fold is ordered, over one thread's turns at a time.
    """
    listed = rows.groupBy("thread").agg(F.array_sort(F.collect_list(F.struct("seq", "bytes"))).alias("t"))
    start = F.struct(F.lit(0).alias("kept"), F.lit(0).cast("bigint").alias("bytes"))

    def put(acc, x):
        fits = (acc["kept"] < max_turns) & (acc["bytes"] + x["bytes"] <= max_bytes)
        return F.when(fits, F.struct((acc["kept"] + 1).alias("kept"), (acc["bytes"] + x["bytes"]).alias("bytes"))).otherwise(acc)

    done = listed.withColumn("state", F.aggregate("t", start, put))
    return done.select("thread", F.size("t").alias("offered"), F.col("state.kept").alias("kept"), F.col("state.bytes").alias("bytes"))


def transition_check(actions: DataFrame, dimension: DataFrame) -> DataFrame:
    """(state, action, next_state or null, n): a null next state is an invalid step."""
    n = actions.groupBy("state", "action").agg(F.count(F.lit(1)).alias("n"))
    return n.join(F.broadcast(dimension), ["state", "action"], "left").select("state", "action", "next_state", "n")


def shards(rows: DataFrame, key: str, size: int) -> DataFrame:
    """Contiguous chunks of `size` keys in key order, with a hash of each."""
    d = ordered.numbered(rows.select(key).distinct(), [F.col(key)], "_n")
    numbered = d.withColumn("shard", F.floor((F.col("_n") - 1) / size))
    return numbered.groupBy("shard").agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("first_key"), F.max(key).alias("last_key"), F.sha2(F.array_join(F.array_sort(F.collect_list(F.col(key).cast("string"))), "\n").cast("binary"), 256).alias("digest"))


def node_latency(events: DataFrame, node: str, value: str) -> DataFrame:
    v = F.col(value)
    return events.groupBy(F.col(node).alias("node")).agg(F.count(v).alias("n"), F.round(F.avg(v), 4).alias("average"), *[F.round(F.percentile(v, F.lit(p)), 4).alias(f"p{int(p * 100)}") for p in (0.5, 0.95, 0.99)], F.round(F.max(v), 4).alias("highest"))


def concurrency(events: DataFrame, start: str, seconds: str, limit: int, by: str) -> DataFrame:
    """Admitted and rejected requests per group: at each start, the requests still open before it."""
    t = F.unix_micros(F.col(start).cast("timestamp")) / F.lit(1e6)
    points = events.select(by, t.alias("at"), F.lit(1).alias("d")).unionAll(events.select(by, (t + F.col(seconds)).alias("at"), F.lit(-1).alias("d")))
    w = W.partitionBy(by).orderBy("at", "d").rowsBetween(W.unboundedPreceding, 0)
    running = points.withColumn("open", F.sum("d").over(w)).filter("d = 1")
    return running.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.max("open").alias("peak"), F.count_if(F.col("open") > limit).alias("over_limit"))
