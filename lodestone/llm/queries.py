"""One query for each operator, with production parameters, over whole tables.

`QUERIES` maps a name to (spark, sf_dir) -> DataFrame; `ORACLES` holds DuckDB
SQL for those that SQL can express.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import exact_search, filter_audit, language_id, line_dedup, mixing, packing, quality_model, quality_rules, simhash, substring_dedup, tokens, vector_codes, warc
from lodestone.llm.common import crc_mod, forgotten, scratch_dir
from lodestone.llm.oracles import ORACLES  # noqa: F401


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    done = line_dedup.deduplicated(docs, least=10, keep="none")
    return done.select("doc_id", "_lines.n_lines", "_lines.n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op2_exact_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return exact_search.top_k(vectors, F.col("vec_id") % 20 == 0)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return language_id.identified(docs, crc_mod(F.col("doc_id"), 4) == 2)


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = substring_dedup.deduplicated(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judged(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return judged.select("doc_id", *[f"_quality.{x}" for x in names])


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    taken = (F.col("copies") * F.col("size")).alias("taken")
    return mixing.shares(_table(spark, sf_dir, "documents").select("doc_id", "text", "source")).select("doc_id", "size", "source_size", "target", taken)


def op10_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "labels").select("doc_id", "quality")
    return quality_model.classified(docs, labels, lambda c: crc_mod(c, 5) == 0)


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents").select("doc_id", "text", "source"), _table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    return filter_audit.audited(docs, labels)


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = forgotten(spark, f"{scratch_dir(spark)}/lodestone-warc-{uuid.uuid4().hex}")
    warc.archived(_table(spark, sf_dir, "pages").select("page_id", "url", "html"), path)
    return warc.summary(spark, path)


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compressed(_table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))


QUERIES = {f.__name__: f for f in (op1_line_dedup, op2_exact_search, op3_language_id, op4_simhash, op5_substring_dedup, op6_packing, op7_quality_rules, op8_token_counts, op9_mixing, op10_quality_model, op11_filter_audit, op12_warc, op13_vector_codes)}
