"""The iterative workflow: whole action sequences against a transition table, and the one evidence inspection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators.retrieve import top_k

# The transition table of the workflow with one authorised inspection.
START = "received"
ITERATIVE = [
    ("received", "validate", "validated"), ("validated", "retrieve", "retrieved"), ("retrieved", "prepare", "initial_context_prepared"),
    ("initial_context_prepared", "initial_compose", "initial_decided_compose"), ("initial_context_prepared", "initial_inspect", "initial_decided_inspect"),
    ("initial_context_prepared", "initial_clarify", "initial_decided_clarify"), ("initial_context_prepared", "initial_refuse", "initial_decided_refuse"),
    ("initial_decided_inspect", "inspect", "alternate_evidence_inspected"), ("alternate_evidence_inspected", "final_compose", "final_decided_compose"),
    ("alternate_evidence_inspected", "final_clarify", "final_decided_clarify"), ("alternate_evidence_inspected", "final_refuse", "final_decided_refuse"),
    ("initial_decided_compose", "compose", "answered"), ("final_decided_compose", "compose", "answered"), ("answered", "verify", "verified"), ("verified", "observe", "observed"),
    ("observed", "complete", "complete"), ("observed", "refuse", "refuse"), ("initial_decided_clarify", "clarify", "clarify"), ("final_decided_clarify", "clarify", "clarify"),
    ("initial_decided_refuse", "refuse", "refuse"), ("final_decided_refuse", "refuse", "refuse"),
]
TERMINAL = ("complete", "refuse", "clarify")
INSPECTED = 10


def turn_actions(conversations: DataFrame, inspect: int = 1000, clarify: int = 600, refuse: int = 300) -> DataFrame:
    """(run, seq, action): a run is a user turn with what follows it up to the next user turn.

    The user turn validates, retrieves and prepares; an answer of `inspect` bytes
    or more is composed at once, a shorter one after an inspection, a still
    shorter one asks for clarity, the shortest refuses.  A system turn is
    validated as part of the run that follows it.
    """
    from pyspark.sql import Window as W

    w = W.partitionBy("conv_id").orderBy("turn")
    user = F.sum((F.col("role") == "user").cast("int")).over(w) + (F.col("role") == "system").cast("int")
    size = F.octet_length("text")
    tail = ["compose", "verify", "observe", "complete"]
    words = lambda *x: F.array(*[F.lit(a) for a in x])
    did = (
        F.when(F.col("role") == "system", words("validate")).when(F.col("role") == "user", words("validate", "retrieve", "prepare")).when(size >= inspect, words("initial_compose", *tail))
        .when(size >= clarify, words("initial_inspect", "inspect", "final_compose", *tail)).when(size >= refuse, words("initial_clarify", "clarify")).otherwise(words("initial_refuse", "refuse"))
    )
    runs = conversations.select(F.concat_ws("/", F.col("conv_id").cast("string"), user.cast("string")).alias("run"), "turn", did.alias("did"))
    each = runs.select("run", "turn", F.posexplode("did").alias("at", "action"))
    return top_k(each, ["run"], [F.col("turn"), F.col("at")], None, "seq").select("run", "seq", "action")


def checked_sequences(steps: DataFrame, transitions: list[tuple[str, str, str]] = ITERATIVE, start: str = START, terminal: tuple[str, ...] = TERMINAL) -> DataFrame:
    """(run, steps, valid_steps, state, status): each run's actions in order through the table.

    The table has no cycle, so a valid run has fewer steps than the table has
    rows; what lies beyond that many steps is counted, not carried.  Status: a
    terminal state reached by the last step, `invalid` (a step that its state
    doesn't allow), `gap` (sequence numbers not 1, 2, ...), else `incomplete`.
    """
    most = len(transitions) + 1
    n = steps.groupBy("run").agg(F.count(F.lit(1)).alias("steps"), F.min("seq").alias("low"), F.max("seq").alias("high"), F.count_distinct("seq").alias("own"))
    first = top_k(steps, ["run"], [F.col("seq")], most, "_n").groupBy("run").agg(F.array_sort(F.collect_list(F.struct("seq", "action"))).alias("a"))  # at most `most` steps
    table = F.map_from_entries(F.array(*[F.struct(F.lit(f"{s}|{a}"), F.lit(t)) for s, a, t in transitions]))
    begin = F.struct(F.lit(start).alias("state"), F.lit(0).alias("n"), F.lit(True).alias("ok"))

    def step(acc, x):
        to = F.element_at(table, F.concat(acc["state"], F.lit("|"), x["action"]))
        return F.when(acc["ok"] & to.isNotNull(), F.struct(to.alias("state"), (acc["n"] + 1).alias("n"), F.lit(True).alias("ok"))).otherwise(F.struct(acc["state"].alias("state"), acc["n"].alias("n"), F.lit(False).alias("ok")))

    done = n.join(first.withColumn("end", F.aggregate("a", begin, step)), "run")
    contiguous = (F.col("low") == 1) & (F.col("high") == F.col("steps")) & (F.col("own") == F.col("steps"))
    status = F.when(~contiguous, "gap").when(~F.col("end.ok"), "invalid").when(F.col("end.state").isin(*terminal), F.col("end.state")).otherwise("incomplete")
    return done.select("run", "steps", F.col("end.n").alias("valid_steps"), F.col("end.state").alias("state"), status.alias("status"))


def alternate_evidence(pool: DataFrame, depth: int = INSPECTED) -> DataFrame:
    """(q_id, listed, documents, problem): the pool's first `depth` documents as alternate evidence.

    A problem is `too_few` candidates, or ranks that aren't 1 to `depth`.
    """
    first = top_k(pool, ["q_id"], [F.col("rank"), F.col("doc_id")], depth, "_n")
    per = first.groupBy("q_id").agg(F.count(F.lit(1)).alias("listed"), F.count_if(F.col("rank") == F.col("_n")).alias("right"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", "doc_id"))), lambda x: x["doc_id"]), ",").alias("documents"))
    problem = F.when(F.col("listed") < depth, "too_few").when(F.col("right") < depth, "ranks_not_contiguous").otherwise("")
    return per.select("q_id", "listed", F.when(problem == "", F.col("documents")).otherwise("").alias("documents"), problem.alias("problem"))
