"""A corpus pipeline: quality rules, line dedup, near-dedup, mixing, packing.

Each stage reads what its predecessor kept, as Parquet, and applies one
operator to all of it.  All but the last return the columns of `documents`, and
any others that the table has, whatever their names.

Defined results: a null text counts as empty and fails the quality rules, as an
empty one does, so neither reaches the later stages; very long texts are read
whole; rows that repeat an id count as one document, which stays or goes as a
whole; ties between copies go to the smallest id; a null source is a source of its own in the mix; an empty table, or one of
which no document is kept, gives no pieces.  A document goes if the links of the
near-dedup lead, over any number of steps, to one with a smaller id that stays: it
may be less than 0.8 alike to that one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import line_dedup, mixing, packing, quality_rules, simhash
from lodestone.llm.common import written


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.filtered(docs)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of ten or more documents stay in the first of them only."""
    done = line_dedup.deduplicated(docs, least=10, keep="first").drop("_lines")
    return done.withColumn("n_chars", F.char_length("text").cast("bigint")) if "n_chars" in docs.columns else done


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents alike in 0.8 or more of their five-word shingles, one stays."""
    return simhash.without_similar(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.packed(docs)


STAGES = [("quality rules", keep_quality), ("line dedup", drop_repeated_lines), ("near dedup", drop_near_copies), ("mixing", mix_sources), ("packing", pack)]

#: SimHash linking and hash-ordered sampling of its output have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, f"stage{k}")
    return docs
