"""File formats: JSON corpora, questions, JSONL splits, CSV profiles, zips, caches and fingerprints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUESTION = "QUESTION_ID string, QUESTION_TITLE string, QUESTION_TEXT string, DOCUMENT string, ANSWER string, START_OFFSET string, END_OFFSET string, ANSWERABLE string, DOC_IDS array<string>"
SECTION = "struct<id:string,text:string,start:string,end:string>"
EVALUATION = "id string, question string, answer string, is_impossible boolean, contexts array<struct<filename:string,text:string>>"
CONTRACT = ("QuestionId", "AnswerId", "QuestionText", "ProcessedAnswerText", "Url", "Split")
SPLIT = "split_name string, protocol_version string, assigned_split string, split_subtype string, source_split string, sample_id string, question_id string, question_title string, question_text string, answerable boolean, answer string, answer_doc_id string, candidate_doc_ids array<string>, answer_span struct<start_offset:int,end_offset:int>"


def yes_no(value: Column) -> Column:
    """Y or N after trimming, in any case; anything else stops the query."""
    v = F.upper(F.trim(value))
    return F.when(v == "Y", F.lit(True)).when(v == "N", F.lit(False)).otherwise(F.raise_error(F.concat(F.lit("neither Y nor N: "), F.coalesce(value, F.lit("null")))).cast("boolean"))


def optional_long(value: Column) -> Column:
    """Null, "" and "-" are null; junk fails under ANSI mode."""
    return F.when(value.isNull() | value.isin("", "-"), F.lit(None).cast("bigint")).otherwise(value.cast("bigint"))


def questions(spark: SparkSession, path: str, array: bool = True) -> DataFrame:
    """A JSON array of questions with upper-case fields, or without `array` one object a line."""
    raw = spark.read.schema(QUESTION).option("multiLine", array).option("mode", "FAILFAST").json(path)
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    return raw.select(
        F.col("QUESTION_ID").alias("q_id"), blank("QUESTION_TITLE").alias("title"), blank("QUESTION_TEXT").alias("text"), blank("ANSWER").alias("answer"), yes_no(F.col("ANSWERABLE")).alias("answerable"),
        F.nullif(F.col("DOCUMENT"), F.lit("")).alias("answer_doc_id"), F.coalesce("DOC_IDS", F.array().cast("array<string>")).alias("doc_ids"), optional_long(F.col("START_OFFSET")).alias("start_offset"), optional_long(F.col("END_OFFSET")).alias("end_offset"),
    )



def corpus(spark: SparkSession, path: str) -> DataFrame:
    """An object of documents by id: (doc_id, title, text, sections)."""
    raw = spark.read.text(path, wholetext=True)
    kind = f"map<string,struct<id:string,title:string,text:string,sections:array<{SECTION}>>>"
    rows = raw.select(F.explode(F.from_json("value", kind)).alias("key", "d"))
    return rows.select(F.coalesce(F.nullif(F.col("d.id"), F.lit("")), "key").alias("doc_id"), F.coalesce("d.title", F.lit("")).alias("title"), F.coalesce("d.text", F.lit("")).alias("text"), "d.sections")


def sections(documents: DataFrame) -> DataFrame:
    each = documents.select("doc_id", F.posexplode("sections").alias("pos", "s"))
    return each.select("doc_id", F.col("s.id").alias("section_id"), "pos", F.col("s.text").alias("text"), optional_long(F.col("s.start")).alias("start_offset"), optional_long(F.col("s.end")).alias("end_offset"))


def gold_section(gold: DataFrame, sections_: DataFrame) -> DataFrame:
    """The first section whose inclusive offsets hold the gold offset: an equi-join with a range."""
    from lodestone.operators.retrieve import top_k

    j = gold.join(sections_, "doc_id").filter(F.col("at").between(F.col("start_offset"), F.col("end_offset")))
    return top_k(j, ["q_id"], [F.col("pos")], 1, "n").select("q_id", "doc_id", "section_id", "pos")


def split_samples(spark: SparkSession, path: str) -> DataFrame:
    """One JSON object a line; a missing field or a repeated sample id stops the query."""
    rows = spark.read.schema(SPLIT).option("mode", "FAILFAST").json(path)
    needed = ("split_name", "assigned_split", "sample_id", "question_id", "question_text", "answerable")
    return unique(required(rows, needed), "sample_id")


def required(rows: DataFrame, columns) -> DataFrame:
    bad = F.concat_ws(",", *[F.when(F.col(c).isNull(), F.lit(c)) for c in columns])
    return rows.filter(F.when(bad != "", F.raise_error(F.concat(F.lit("missing: "), bad)).cast("boolean")).otherwise(F.lit(True)))


def unique(rows: DataFrame, key: str) -> DataFrame:
    n = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    return rows.join(n, key).filter(F.when(F.col("_n") > 1, F.raise_error(F.concat(F.lit(f"repeated {key}: "), F.col(key).cast("string"))).cast("boolean")).otherwise(F.lit(True))).drop("_n").select(*rows.columns)


def evaluation_samples(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of evaluation samples with their contexts; a missing field stops the query."""
    raw = spark.read.schema(EVALUATION).option("multiLine", True).option("mode", "FAILFAST").json(path)
    return required(raw, ("id", "question", "answer", "is_impossible")).withColumn("contexts", F.coalesce("contexts", F.array().cast(raw.schema["contexts"].dataType)))


def json_lines(spark: SparkSession, path: str, schema: str, exact: bool = False) -> DataFrame:
    """One JSON object a line; anything else stops the query and names the file.

    Blank lines are skipped.  With `exact` they stop the query too, and so does
    a row whose fields aren't those of the schema.
    """
    kind = spark.createDataFrame([], schema).schema
    lines = spark.read.text(path).select(F.trim("value").alias("line"), F.col("_metadata.file_name").alias("file"))
    stop = lambda why: F.raise_error(F.concat(F.lit(f"{why} in "), F.col("file"))).cast("boolean")
    fields = F.json_object_keys("line")
    sound = F.when(fields.isNull(), stop("not a JSON object"))
    if exact:
        named = F.array(*[F.lit(n) for n in sorted(kind.names)])
        sound = F.when(F.col("line") == "", stop("blank line")).when(fields.isNull(), stop("not a JSON object")).when(F.array_sort(fields) != named, stop("fields are not exact"))
    else:
        lines = lines.filter("line <> ''")
    rows = lines.filter(sound.otherwise(F.lit(True)))
    return rows.select(F.from_json("line", kind, {"mode": "FAILFAST"}).alias("r")).select("r.*")


def write_json_lines(rows: DataFrame, path: str) -> None:
    """One JSON object a row, null fields included, so that `json_lines(exact=True)` reads it back."""
    rows.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def contract_rows(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(rows, rejects(reason, n)) of a CSV with a header.

    A row needs every field of CONTRACT and a question that isn't empty once
    normalised; a rejected row counts once for each field it lacks.
    """
    from lodestone.functions.text import question_key

    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    stripped = raw.select(*[F.regexp_replace(F.coalesce(F.col(f"`{c}`"), F.lit("")), r"(?U)^\s+|\s+$", "").alias(c) for c in raw.columns])
    lacks = F.array_compact(F.array(*[F.when(F.col(c) == "", F.lit(f"missing_{c}")) for c in CONTRACT]))
    empty = F.when(F.col("norm") == "", F.array(F.lit("empty_normalized_question"))).otherwise(F.array().cast("array<string>"))
    judged = stripped.withColumn("norm", question_key(F.col("QuestionText"))).withColumn("_why", F.when(F.size(lacks) > 0, lacks).otherwise(empty))
    return judged.filter(F.size("_why") == 0).drop("_why"), judged.select(F.explode("_why").alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def write_questions(samples: DataFrame, path: str) -> None:
    """Split samples as upper-case question rows, a folder a split; `questions(array=False)` reads a folder back."""
    offset = lambda c: F.coalesce(F.col(f"answer_span.{c}").cast("string"), F.lit("-"))
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    rows = samples.select(
        F.col("assigned_split").alias("split"), F.col("sample_id").alias("QUESTION_ID"), blank("question_title").alias("QUESTION_TITLE"), F.col("question_text").alias("QUESTION_TEXT"), blank("answer_doc_id").alias("DOCUMENT"),
        F.when(F.col("answerable"), blank("answer")).otherwise(F.lit("")).alias("ANSWER"), offset("start_offset").alias("START_OFFSET"), offset("end_offset").alias("END_OFFSET"), F.when(F.col("answerable"), F.lit("Y")).otherwise(F.lit("N")).alias("ANSWERABLE"),
        F.coalesce("candidate_doc_ids", F.array().cast("array<string>")).alias("DOC_IDS"), F.col("split_name").alias("FROZEN_SPLIT_NAME"), F.col("protocol_version").alias("FROZEN_PROTOCOL_VERSION"), F.col("assigned_split").alias("ASSIGNED_SPLIT"),
        F.col("split_subtype").alias("SPLIT_SUBTYPE"), F.col("source_split").alias("SOURCE_SPLIT"), F.col("question_id").alias("SOURCE_QUESTION_ID"),
    )
    rows.write.partitionBy("split").mode("overwrite").option("ignoreNullFields", False).json(path)


def write_splits(samples: DataFrame, path: str) -> None:
    samples.write.partitionBy("assigned_split").mode("overwrite").json(path)


def csv_profile(spark: SparkSession, path: str, columns: list[str], key: str) -> DataFrame:
    """One row: rows, malformed, missing by column, repeated keys."""
    schema = ", ".join(f"`{c}` string" for c in columns) + ", `_bad` string"
    rows = spark.read.schema(schema).option("header", True).option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").csv(path)
    missing = [F.count_if(F.coalesce(F.trim(F.col(c)), F.lit("")) == "").alias(f"missing_{c}") for c in columns]
    return rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("_bad").isNotNull()).alias("malformed"), *missing, (F.count(key) - F.count_distinct(key)).alias("repeated"))


def zip_names(spark: SparkSession, path: str) -> DataFrame:
    """Distinct base names of the files in zip archives."""
    import pandas as pd

    def names(frames):
        import io
        import zipfile

        for f in frames:
            found = {n.rsplit("/", 1)[-1] for c in f["content"] for n in zipfile.ZipFile(io.BytesIO(c)).namelist() if not n.endswith("/")}
            yield pd.DataFrame({"name": sorted(found)}, dtype=object)

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(names, "name string").distinct()


def fingerprints(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.format("binaryFile").load(path)
    return raw.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def cache_path(root: str, model: str, max_chars: int, prefix: str = "") -> str:
    import re

    safe = lambda s: re.sub(r"[^A-Za-z0-9]+", "_", s).strip("_").lower() or "none"
    return f"{root}/model={safe(model)}/max_chars={max_chars}/prefix={safe(prefix)}"


def cached_embeddings(spark: SparkSession, path: str, documents: DataFrame, encode) -> DataFrame:
    """Read-through cache: reused only if it has exactly the ids of `documents`."""
    want = documents.select("doc_id")
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        have = spark.read.parquet(path)
        ids = have.select("doc_id")
        if want.exceptAll(ids).isEmpty() and ids.exceptAll(want).isEmpty():
            return have
    encode(documents).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
