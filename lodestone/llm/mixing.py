"""Mixing sources to target weights by Pareto order sampling.

Every source gets a target number of words.  A source whose target is r times
its size gives floor(r) whole copies of each document for certain; the rest is
an unequal-probability sample.  The inclusion probability of a document grows
with the number of binary digits of its size: p = min(1, c * digits), where c
makes the expected words equal to what the source still needs.  Documents with
p = 1 give one more copy for certain; the others are ranked by their random odds
u / (1 - u) divided by their inclusion odds p / (1 - p), and the lowest ranks are
taken up to the number of words that is left.

Nothing is ordered in one place.  A source has at most 64 size classes, which
give c.  A histogram over the rank's leading bits finds, per source, the bucket
in which the sample ends; two more over the next bits refine that bucket.  All
are partial aggregates of at most 256 buckets a source, so one that holds a
third of all rows costs no more than its share.  The document nearest in size to
what is still missing closes the sample.  Windows without a partition key run
over the list of sources only, one row each.

Defined results: a null text has size 0; a null source is a source of its own,
ordered last; documents of size 0 take 0 words.  Rows with equal ids and sizes
rank alike and are taken together; rows without an id rank by their text.
Reruns agree, as ranks come from hashes.  An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.llm.common import SPACES, written

WEIGHTS = (5, 2, 1)
TOTAL_SHARE, MAX_REPEAT = 1.5, 2
KEY = ["source", "no_source"]
LEVEL_BITS, LEVELS = 8, 3  # each histogram has 256 buckets a source
STEPS = 2 ** (LEVEL_BITS * LEVELS)


def word_count(text: Column) -> Column:
    """Number of [^\\x20\\x09-\\x0D]+ in a text (null: 0).

    A word begins wherever a character that isn't white space follows white
    space or the start; replacing runs of other characters by one mark and
    removing the white space leaves one mark a word.
    """
    marks = F.translate(F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\x20\x09-\x0D]+", "x"), SPACES, "")
    return F.char_length(marks).cast("bigint")


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = TOTAL_SHARE, most: float = MAX_REPEAT) -> DataFrame:
    """(source, source_size) -> also `target`, by water-filling.

    One row a source: the windows here run over the list of sources alone.
    Sources are put in the order in which they reach their bound; the first k
    of them stop there, the others share what is left by weight, with the
    smallest k that lets none of the others go above its bound.
    """
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    k = F.row_number().over(by_name) - 1
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (k % len(weights)).cast("int") + 1)
    cap = (F.lit(float(most)) * F.col("source_size")).alias("cap")
    named = sizes.select("source", "source_size", weight.alias("weight"), cap)
    order = [F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()]
    before, whole = W.orderBy(*order).rowsBetween(W.unboundedPreceding, -1), W.partitionBy(F.lit(1))
    total = F.lit(float(share)) * F.sum("source_size").over(whole)
    left = total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    open_weight = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    level = named.withColumn("level", left / open_weight)
    fits = F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level"))
    final = level.withColumn("final", F.first(fits, ignorenulls=True).over(W.orderBy(*order).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    target = F.least(F.col("cap"), F.coalesce(F.col("final") * F.col("weight"), F.col("cap")))
    return final.select("source", "source_size", target.alias("target"))


def _unit(doc_id: Column, text: Column, seed: int) -> Column:
    """A number in (0, 1) from the id, or the text where there is none: 52 bits of a salted md5."""
    own = F.concat(F.lit("null|"), F.md5(F.coalesce(text, F.lit("")).cast("binary")))
    salted = F.concat(F.lit(f"{seed}|"), F.coalesce(doc_id.cast("string"), own))
    bits = F.conv(F.substring(F.md5(salted.cast("binary")), 1, 13), 16, 10).cast("bigint")
    return (bits.cast("double") + 0.5) / F.lit(float(2**52))


def digits(size: Column) -> Column:
    """Binary digits of a size (0: one): the weight of a document's inclusion."""
    return F.char_length(F.bin(F.greatest(size, F.lit(1)))).cast("int")


def _rank(unit: Column, p: Column) -> Column:
    """The quotient of odds on a grid of 2 ** 24 steps; 0 is kept for certain copies.

    q in [0, inf) becomes q / (1 + q) in [0, 1), which keeps its order.
    """
    q = (unit / (1 - unit)) / (p / (1 - p))
    place = F.greatest(F.least((q / (1 + q) * F.lit(float(STEPS))).cast("bigint"), F.lit(STEPS - 1)), F.lit(1))
    return F.when(p >= 1, F.lit(0)).when(p > 0, place).otherwise(F.lit(STEPS - 1))


def _keyed(docs: DataFrame, text: str, source: str, doc_id: str, seed: int) -> Column:
    """A struct: source as text and whether it is null, size, unit."""
    name = F.col(f"`{source}`").cast("string")
    words, unit = word_count(F.col(f"`{text}`")), _unit(F.col(f"`{doc_id}`"), F.col(f"`{text}`"), seed)
    return F.struct(F.coalesce(name, F.lit("")).alias("source"), name.isNull().alias("no_source"), words.alias("size"), unit.alias("unit"))


def inclusion(sized: DataFrame, aim: DataFrame) -> DataFrame:
    """(*KEY, c): p = min(1, c * digits) makes the expected words of a source its `need`.

    Size classes reach p = 1 from the largest down; the first k of them do, the
    others share what is left, with the smallest k that lets none pass 1.
    """
    classes = sized.filter("size > 0").groupBy(*KEY, digits(F.col("size")).alias("d")).agg(F.sum("size").alias("words"))
    classes = classes.join(aim.select(*KEY, "need").filter("need > 0"), KEY)
    down = W.partitionBy(*KEY).orderBy(F.col("d").desc())
    before, onward = down.rowsBetween(W.unboundedPreceding, -1), down.rowsBetween(W.currentRow, W.unboundedFollowing)
    c = (F.col("need") - F.coalesce(F.sum("words").over(before), F.lit(0))) / F.sum(F.col("d") * F.col("words")).over(onward)
    return classes.withColumn("c", c).filter(F.col("c") * F.col("d") <= 1).groupBy(*KEY).agg(F.max_by("c", "d").alias("c"))


def _p(size: Column, c: Column) -> Column:
    return F.least(F.lit(1.0), F.coalesce(c, F.lit(0.0)) * digits(size))


def _end(ranked: DataFrame, level: int) -> DataFrame:
    """Per source: the leading bits of the rank at which the running sum of sizes
    goes above `need`, and what is still needed when they begin."""
    step = F.shiftright("rank", LEVEL_BITS * (LEVELS - 1 - level)).alias("end")
    histogram = ranked.groupBy(*KEY, "need", step).agg(F.sum("size").alias("n"))
    w = W.partitionBy(*KEY).orderBy("end").rowsBetween(W.unboundedPreceding, 0)
    run = histogram.withColumn("run", F.sum("n").over(w)).filter(F.col("run") > F.col("need"))
    need = (F.col("need") - (F.col("run") - F.col("n"))).alias("need")
    return run.groupBy(*KEY).agg(F.min(F.struct("end", need)).alias("e")).select(*KEY, "e.end", "e.need")


def plan(sized: DataFrame, weights=WEIGHTS, share: float = TOTAL_SHARE, most: float = MAX_REPEAT) -> DataFrame:
    """One row a source: source_size, target, copies, c, cut, closer.

    A document of the source is taken `copies` times, and once more if its rank
    is below `cut` or its unit is `closer`.
    """
    sizes = sized.groupBy(*KEY).agg(F.sum("size").alias("source_size"))
    named = sizes.select(F.when(~F.col("no_source"), F.col("source")).alias("source"), "source_size")
    aim = targets(named, weights, share, most).withColumn("no_source", F.col("source").isNull()).withColumn("source", F.coalesce("source", F.lit("")))
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    aim = aim.withColumn("copies", F.floor(ratio).cast("bigint"))
    aim = written(aim.withColumn("need", F.col("target") - F.col("copies") * F.col("source_size")), "aim")
    aim = written(aim.join(inclusion(sized, aim), KEY, "left"), "inclusion")
    rank = _rank(F.col("unit"), _p(F.col("size"), F.col("c")))
    ranked = sized.join(aim, KEY).withColumn("rank", rank)
    end = written(_end(ranked, 0), "end")
    for level in range(1, LEVELS):
        at = F.shiftright("rank", LEVEL_BITS * (LEVELS - level))
        end = written(_end(ranked.drop("need").join(end, KEY).filter(at == F.col("end")).drop("end"), level), "end")
    fine = end.select(*KEY, "end", F.col("need").alias("left"))
    cut = written(aim.join(fine, KEY, "left").withColumn("cut", F.coalesce("end", F.when(F.col("c") > 0, F.lit(STEPS)).otherwise(F.lit(0)))).drop("end"), "cut")
    rest = sized.join(cut.filter(F.col("left") > 0), KEY).filter(rank >= F.col("cut"))
    off = F.abs(F.col("size") - F.col("left"))
    nearest = rest.filter(off < F.col("left")).groupBy(*KEY).agg(F.min(F.struct(off.alias("off"), F.col("unit"))).alias("best"))
    out = cut.join(nearest, KEY, "left")
    return written(out.select(*KEY, "source_size", "target", "copies", "c", "cut", F.col("best")["unit"].alias("closer")), "mix")


def _taken(keyed: DataFrame, chosen: DataFrame) -> DataFrame:
    """Joins rows that hold the struct `m` with the plan: the struct gains source_size, target and copies."""
    m, p = F.col("m"), F.struct("source_size", "target", "copies", "c", "cut", "closer").alias("p")
    both = keyed.join(chosen.select(F.struct(*KEY).alias("k"), p), (m["source"] == F.col("k.source")) & (m["no_source"] == F.col("k.no_source")))
    more = (_rank(m["unit"], _p(m["size"], F.col("p.c"))) < F.col("p.cut")) | F.coalesce(m["unit"] == F.col("p.closer"), F.lit(False))
    got = F.col("p.copies") + more.cast("bigint")
    return both.withColumn("m", F.struct(m["size"].alias("size"), F.col("p.source_size").alias("source_size"), F.col("p.target").alias("target"), got.alias("copies"))).drop("k", "p")


def shares(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", weights=WEIGHTS, share: float = TOTAL_SHARE, most: float = MAX_REPEAT, seed: int = 9) -> DataFrame:
    """(doc_id, size, source_size, target, copies) of every row, from one pass over the texts."""
    sized = written(docs.select(F.col(f"`{doc_id}`").alias("doc_id"), _keyed(docs, text, source, doc_id, seed).alias("m")), "sized")
    return _taken(sized, plan(sized.select("m.*"), weights, share, most)).select("doc_id", "m.*")


def with_copies(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", weights=WEIGHTS, share: float = TOTAL_SHARE, most: float = MAX_REPEAT, seed: int = 9) -> DataFrame:
    """The input with the struct `_m`: size, source_size, target, copies.  An input column `_m` is replaced."""
    m = _keyed(docs, text, source, doc_id, seed)
    sized = written(docs.select(m.alias("m")).select("m.*"), "sized")
    names = [c for c in docs.columns if c != "_m"]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), m.alias("m"))
    return _taken(rows, plan(sized, weights, share, most)).select(*[F.col("row")[c].alias(c) for c in names], F.col("m").alias("_m"))


def mixed(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", weights=WEIGHTS, share: float = TOTAL_SHARE, most: float = MAX_REPEAT, seed: int = 9) -> DataFrame:
    """The input with each row as often as the mix takes it."""
    m = _keyed(docs, text, source, doc_id, seed)
    sized = written(docs.select(m.alias("m")).select("m.*"), "sized")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), m.alias("m"))
    out = _taken(rows, plan(sized, weights, share, most)).filter("m.copies > 0")
    return out.select("row", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("m.copies")))).select(*[F.col("row")[c].alias(c) for c in docs.columns])
