"""Filter interaction audit: what each filter removes, in every order, per part.

Every document gets a mask, one bit a filter that it fails.  A part (a source)
is then no more than the counts of its masks, at most 2 ** n of them, which Spark
sums with partial aggregates: a part that holds a third of all rows costs its
share.  All orders follow from those counts by one polynomial a part.  With
x_i = 1 where filter i is on, the documents removed are

    R(x) = sum over masks m of count(m) * (1 - product over i in m of (1 - x_i))
         = sum over T, not empty, of (-1) ** (|T| + 1) * N(T) * product of x_i, i in T

where N(T) counts the documents that fail all of T.  A corner of the cube, x in
{0, 1}, gives what a set of filters removes together, hence what survives a
prefix of an order.  The integral of the partial derivative along the diagonal,
sum over T with i of coefficient(T) / |T|, is the Shapley value of filter i; it is
computed in exact rationals and scaled by the number of orders.  The polynomials
of good and of toxic documents have the same form.

Filters A to E of `MASKED`: A under 50 words; B under 65 % of the words distinct;
C over 5 % of the code points in A-Z; D any of #$%&*|; E identical to the text of
a row with a smaller id, anywhere in the table.

Defined results: a null text is empty (it fails A, and E where a smaller id has
an empty or null text); a null part is the empty string; a row without an id
fails E never and has no label; rows with equal ids don't fail E by each other;
a document with several label rows is good, or toxic, if any of them says so; an
empty table gives no part.  Columns of other names take no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from itertools import permutations
from math import factorial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import SPACES

LETTERS = "ABCDE"
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 50, 65, 5
MEASURES = ("n", "good", "toxic")
SCHEMA = "part string, filter_order string, step int, kept bigint, removed bigint, redundant bigint, unique_fails bigint, good_lost bigint, toxic_lost bigint, shapley bigint"


def own_failures(text: Column) -> list[Column]:
    """Conditions A to D of a text that isn't null."""
    words = F.array_remove(F.split(F.translate(text, SPACES[1:], " " * len(SPACES[1:])), " "), "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals, points = F.length(F.regexp_replace(text, "[^A-Z]+", "")), F.length(text)
    return [n < LEAST_WORDS, distinct.cast("bigint") * 100 < n.cast("bigint") * LEAST_DISTINCT, capitals.cast("bigint") * 100 > points.cast("bigint") * MOST_CAPITALS, text.rlike(r"[#$%&*|]")]


def mask_counts(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", part: str = "source", quality: str = "quality", toxic: str = "toxic") -> DataFrame:
    """(part, mask, n, good, toxic): bit i of the mask is set if filter i fails.

    Only a digest of a text leaves its row.  Copies meet by digest in a partial
    minimum alone; a row then looks up whether its own (digest, id) is the first
    one, so that a large group of copies is spread over all tasks.
    """
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    bits = [F.shiftleft(f.cast("int"), i) for i, f in enumerate(own_failures(F.col("body")))]
    own = bits[0].bitwiseOR(bits[1]).bitwiseOR(bits[2]).bitwiseOR(bits[3])
    name = F.coalesce(F.col(f"`{part}`").cast("string"), F.lit(""))
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), name.alias("part"), body.alias("body"))
    rows = rows.select("doc_id", "part", F.unhex(F.sha2(F.col("body").cast("binary"), 256)).alias("digest"), own.alias("own"))
    # One shuffle of the digests serves both uses below: the same aggregate, so that its exchange is made once.
    rows = rows.groupBy("doc_id", "part", "digest", "own").agg(F.count(F.lit(1)).alias("n")).filter("n > 0")
    firsts = rows.groupBy(F.col("digest").alias("same")).agg(F.min("doc_id").alias("least")).withColumn("first", F.lit(True))
    # Null-safe equality keeps the planner from adding filters to one of the two uses, which would part their exchanges.
    copy = F.shiftleft((F.col("first").isNull() & F.col("doc_id").isNotNull()).cast("int"), 4)
    judged = rows.join(firsts, F.col("digest").eqNullSafe(F.col("same")) & F.col("doc_id").eqNullSafe(F.col("least")), "left").withColumn("mask", F.col("own").bitwiseOR(copy))
    says = [F.max((F.coalesce(F.col(f"`{c}`"), F.lit(0)) == 1).cast("int")).alias(n) for c, n in ((quality, "good"), (toxic, "toxic"))]
    marks = labels.filter(F.col(f"`{doc_id}`").isNotNull()).groupBy(F.col(f"`{doc_id}`").alias("doc_id")).agg(*says).withColumn("salt", F.lit(0).cast("bigint"))
    salt = F.when(F.col("doc_id").isNull(), F.xxhash64("digest", "part")).otherwise(F.lit(0).cast("bigint"))  # rows without an id are spread
    both = judged.withColumn("salt", salt).join(marks, ["doc_id", "salt"], "left")
    both = both.select("part", "mask", "n", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))
    return both.groupBy("part", "mask").agg(F.sum("n").alias("n"), *[F.sum(F.col("n") * F.col(c)).alias(c) for c in MEASURES[1:]])


def polynomial(counts: list[int]) -> list[int]:
    """Coefficients of R by set of filters, from the counts by mask."""
    holds = list(counts)
    step = 1
    while step < len(holds):  # sums over supersets: N(T)
        holds = [c + (0 if t & step else holds[t | step]) for t, c in enumerate(holds)]
        step *= 2
    return [0] + [c if t.bit_count() % 2 else -c for t, c in enumerate(holds) if t]


def corner(coefficients: list[int], on: int) -> int:
    """R where the filters of the set `on` are on: what they remove together."""
    return sum(c for t, c in enumerate(coefficients) if t & on == t)


def shapley(coefficients: list[int], i: int) -> Fraction:
    """The integral over t in [0, 1] of dR/dx_i at (t, ..., t); t ** (|T| - 1) gives 1 / |T|."""
    return sum((Fraction(c, t.bit_count()) for t, c in enumerate(coefficients) if t >> i & 1), Fraction(0))


def steps_of(part: str, counts: dict[str, list[int]], letters: str = LETTERS) -> list[tuple]:
    """The rows of one part: each order, each step."""
    n, everything = len(letters), (1 << len(letters)) - 1
    polys = {m: polynomial(counts[m]) for m in MEASURES}
    gone = {m: [corner(polys[m], s) for s in range(everything + 1)] for m in MEASURES}
    total = sum(counts["n"])
    value = [int(shapley(polys["n"], i) * factorial(n)) for i in range(n)]
    rows = []
    for order in permutations(range(n)):
        name, before = "".join(letters[i] for i in order), 0
        for k, i in enumerate(order, 1):
            after = before | 1 << i
            lost = {m: gone[m][after] - gone[m][before] for m in MEASURES}
            alone = gone["n"][everything] - gone["n"][everything & ~(1 << i)]
            rows.append((part, name, k, total - gone["n"][after], lost["n"], gone["n"][1 << i] - lost["n"], alone, lost["good"], lost["toxic"], value[i]))
            before = after
    return rows


def interactions(masks: DataFrame, letters: str = LETTERS) -> DataFrame:
    """(part, mask, n, good, toxic) -> a row for each part, order of the letters and step.

    A part is one row of 2 ** len(letters) counts a measure; parts are dealt over
    the tasks and no task holds more than one part's orders at a time.
    """
    size, schema = 1 << len(letters), SCHEMA
    wide = masks.groupBy("part").agg(F.collect_list(F.struct("mask", *MEASURES)).alias("cells"))  # at most `size` of them

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.string(), pa.int32()] + [pa.int64()] * 7
        names = [x.split()[0] for x in schema.split(", ")]
        for b in batches:
            for row in b.to_pylist():
                counts = {m: [0] * size for m in MEASURES}
                for cell in row["cells"]:
                    for m in MEASURES:
                        counts[m][cell["mask"]] = cell[m]
                rows = steps_of(row["part"], counts, letters)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    return wide.mapInArrow(expand, schema)


def audited(docs: DataFrame, labels: DataFrame, **columns: str) -> DataFrame:
    """All orders of the five filters over every part of the documents."""
    return interactions(mask_counts(docs, labels, **columns))
