"""Pieces that several operators share."""

from __future__ import annotations

import atexit
import re
import shutil
import sys
import tempfile
import types
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of every contract of this subpackage: [\x20\x09-\x0D].
SPACES = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir.

    Only where that setting is absent and all runs on this machine (tests, a
    laptop) a folder of its own is chosen; a cluster must name one.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    held = worker_cache("scratch")
    if "dir" not in held:
        local = tempfile.mkdtemp(prefix="lodestone-")
        atexit.register(shutil.rmtree, local, ignore_errors=True)
        held["dir"] = "file://" + local
    return held["dir"]


def written(df: DataFrame, label: str) -> DataFrame:
    """Writes a table to the shared folder and reads it back.

    It cuts the lineage: a lost executor costs no recomputation before it.
    The folder goes when the driver's Python ends.
    """
    spark = df.sparkSession
    path = forgotten(spark, f"{scratch_dir(spark)}/lodestone-{label}-{uuid.uuid4().hex}")
    df.write.option("compression", "zstd").option("parquet.block.size", 16 << 20).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forgotten(spark: SparkSession, path: str) -> str:
    """The path, whose files go when the driver's Python ends."""
    atexit.register(_forget, spark, path)
    return path


def _forget(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the session may be gone; the shared folder is scratch space
        pass


def worker_cache(name: str) -> dict:
    """A dictionary that lives as long as this Python process, so that a reused
    worker need not load a vocabulary again for its next task."""
    kept = sys.modules.setdefault("_lodestone_cache", types.ModuleType("_lodestone_cache"))
    return kept.__dict__.setdefault(name, {})


def folded(text: Column) -> Column:
    """A-Z in lower case, all else as it is."""
    return F.translate(text, UPPER, LOWER)


def crc_mod(id_column: Column, modulus: int) -> Column:
    """crc32 of the id as text, by modulus (a null id counts as an empty text)."""
    return F.crc32(F.coalesce(id_column.cast("string"), F.lit(""))) % F.lit(modulus)


def let(value: Column, body) -> Column:
    """body(value) with value computed once, for use inside lambda functions."""
    return F.element_at(F.transform(F.array(value), body), 1)


#: A key above this share of all rows is hot; at most HOT_KEYS keys can be.
HOT_KEYS = 1000


def looked_up(rows: DataFrame, table: DataFrame, key: str, weight: str, spread: Column) -> DataFrame:
    """Left join on `key`, unique in `table` and not null, where a key may hold a large share of `rows`.

    The HOT_KEYS keys of the largest `weight` (their number of rows) are
    broadcast; any other key holds at most a 1 / HOT_KEYS of the rows.  Rows of
    hot keys are dealt out by `spread` in the join with the other keys, which
    they can't match.  The weight column is left out of the result.
    """
    values = [c for c in table.columns if c not in (key, weight)]
    hot = table.orderBy(F.col(weight).desc(), key).limit(HOT_KEYS).select(key, F.struct(*values).alias("_hot"))
    rest = table.join(F.broadcast(hot), key, "left_anti").select(key, F.lit(0).cast("bigint").alias("_salt"), F.struct(*values).alias("_rest"))
    one = rows.join(F.broadcast(hot), key, "left").withColumn("_salt", F.when(F.col("_hot").isNull(), F.lit(0).cast("bigint")).otherwise(spread.bitwiseOR(F.lit(1))))
    both = one.join(rest, [key, "_salt"], "left").withColumn("_got", F.coalesce("_hot", "_rest"))
    return both.select(*[F.col(f"`{c}`") for c in rows.columns], *[F.col("_got")[c].alias(c) for c in values])
