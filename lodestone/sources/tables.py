"""The long tables that operators work on, from the supplied Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import text as T

QUERY_TOKENS, GOLD_TOKENS = 12, 8
MOST_RUNS = 100_000  # passages whose beginnings are copied to the tasks


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """docs(doc_id string, title, text, lang, source): the title is the text up to its first stop."""
    title = F.regexp_extract("text", r"^[^.!?\n]*", 0)
    return table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), title.alias("title"), "text", "lang", "source")


def sections(docs: DataFrame) -> DataFrame:
    """sections(doc_id, section_id, pos, title, text): the lines of a document that aren't blank."""
    lines = docs.select("doc_id", "title", F.posexplode(F.split("text", "\n")).alias("pos", "text"))
    return lines.filter(F.trim("text") != "").withColumn("section_id", F.concat(F.lit("s"), F.col("pos").cast("string")))


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """questions(q_id, title, text): benchmark passages; the title is their first tokens."""
    first = F.array_join(F.slice(T.tokens(F.col("text")), 1, QUERY_TOKENS), " ")
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("q_id"), first.alias("title"), "text")


def _runs_of(runs: list[list[str]]):
    """Arrow batches of (doc_id, text in lower case) to (doc_id, run): runs of tokens of which each is in `runs` and the first begins one."""
    import numpy as np
    import pyarrow as pa

    words, firsts = sorted({t for r in runs for t in r}), sorted({r[0] for r in runs})
    numbers = T.token_numbers(words)

    def find(batches):
        begins = np.append(np.isin(words, firsts), False)  # the last is of tokens that aren't known, numbered -1
        for batch in batches:
            n, sizes = numbers(batch.column("text"))
            misses = np.r_[0, np.cumsum(n < 0)]
            at = np.arange(len(n) - GOLD_TOKENS + 1)
            owner = np.repeat(np.arange(len(sizes)), sizes)
            at = at[(misses[at + GOLD_TOKENS] == misses[at]) & begins[n[at]] & (owner[at] == owner[at + GOLD_TOKENS - 1])]
            made = pa.array([" ".join(words[j] for j in n[i : i + GOLD_TOKENS]) for i in at.tolist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(owner[at])), made], names=["doc_id", "run"])

    return find


def gold(docs: DataFrame, asked: DataFrame) -> DataFrame:
    """gold(q_id, gold): the first document, by string id, with the passage's first eight tokens in a row.

    Tokens are numbered in the tasks, and runs are made only where eight tokens in
    a row occur in the passages' beginnings and the first begins one, so that few
    reach the equi-join.
    """
    wanted = asked.select("q_id", F.slice(T.tokens(F.col("text")), 1, GOLD_TOKENS).alias("k")).filter(F.size("k") == GOLD_TOKENS)
    wanted = wanted.select("q_id", F.array_join("k", " ").alias("run"))
    runs = [r["run"].split(" ") for r in wanted.limit(MOST_RUNS + 1).collect()]
    if len(runs) <= MOST_RUNS:
        have = docs.select("doc_id", F.lower("text").alias("text")).mapInArrow(_runs_of(runs), "doc_id string, run string")
    else:
        n = F.size("toks")
        toks = docs.select("doc_id", T.tokens(F.col("text")).alias("toks")).filter(n >= GOLD_TOKENS)
        every = F.transform(F.sequence(F.lit(1), n - GOLD_TOKENS + 1), lambda i: F.array_join(F.slice("toks", i, GOLD_TOKENS), " "))
        have = toks.select("doc_id", F.explode(F.array_distinct(every)).alias("run"))
    return have.join(wanted, "run").groupBy("q_id").agg(F.min("doc_id").alias("gold"))
