"""Quality rules: a threshold table compiled into one native projection.

Every measure is a built-in column expression over the whole text.  `RULES`
names a measure, a comparison and a bound; `verdict` folds the table into one
Boolean column, so a scan evaluates all rules in a single pass without a
shuffle or a user function.

Defined results: a null or empty text has no words, so it fails the base rule
(fewer than 50 words).  Repeated rows are judged one by one.  Columns of the
input other than the text are not read; clashing names cannot occur, as the
measures live in one struct until the end.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import SPACES, folded, let

MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50

# Frequent function words of the four languages of the corpus.
STOP_WORDS = (
    "the of to and in is that for it as was with be by on not he this are or his from at which but have an had they you "
    "le de un être et à il ne je son que se qui ce dans en du elle au pour pas sur avec la les des une est par "
    "der die und das von zu mit sich den für nicht als auch es werden aus er hat dass sie nach bei einer um am im dem ein eine ist "
    "el los las una y por con para del lo como más pero sus o este sí porque entre"
).split()


@dataclass(frozen=True)
class Rule:
    """A document passes if `measure` `op` `bound` holds."""

    measure: str
    op: str
    bound: float


#: Ratios: to words unless the name says otherwise.
RULES = (
    Rule("chars_per_word", "<=", 14.0),
    Rule("chars_per_word", ">=", 2.0),
    Rule("symbols_per_word", "<=", 0.20),
    Rule("shouts_per_word", "<=", 0.40),
    Rule("stop_word_ratio", ">=", 0.02),
    Rule("dup_line_ratio", "<=", 0.50),
    Rule("bullet_line_ratio", "<=", 0.90),
)


def _without(text: Column, characters: str) -> Column:
    return F.translate(text, characters, "")


def _count_of(text: Column, characters: str) -> Column:
    return F.char_length(text) - F.char_length(_without(text, characters))


def _repeat_words(words: Column) -> Column:
    """Words that lie in a three-word window found twice or more in the text.

    Windows are compared by a chained 64-bit hash.  Equal neighbours in hash
    order mark their positions; in position order, each marked window adds the
    words that the one before it doesn't cover.
    """
    n = F.size(words)
    window = lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))
    hashes = F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), window)).otherwise(F.array().cast("array<bigint>"))

    def positions(h: Column) -> Column:
        keyed = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def marked(s: Column) -> Column:
            same = lambda a, b: F.coalesce(a["h"] == b["h"], F.lit(False))
            hits = F.filter(s, lambda x, k: same(F.get(s, k - 1), x) | same(F.get(s, k + 1), x))
            return F.array_sort(F.transform(hits, lambda x: x["i"]))

        return let(keyed, marked)

    def covered(p: Column) -> Column:
        gain = F.transform(p, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - x, F.lit(3))))
        return F.aggregate(gain, F.lit(0).cast("bigint"), lambda a, x: a + x)

    zero = F.lit(0).cast("bigint")
    return let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), zero).otherwise(let(positions(h), covered)))


def measured(docs: DataFrame, text: str, into: str) -> DataFrame:
    """Adds one struct column with the counts that the rules use."""
    t = F.coalesce(F.col(text), F.lit(""))
    words = F.filter(F.split(t, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    lines = F.filter(F.split(t, "\n"), lambda x: F.char_length(_without(x, SPACES)) > 0)
    bigint = lambda c: c.cast("bigint")
    of_words = let(
        words,
        lambda w: F.struct(
            bigint(F.size(w)).alias("n"),
            _repeat_words(w).alias("repeated"),
            bigint(F.size(F.filter(w, lambda x: folded(x).isin(STOP_WORDS)))).alias("stop"),
        ),
    )
    of_lines = let(
        lines,
        lambda x: F.struct(
            bigint(F.size(x)).alias("n"),
            bigint(F.size(x) - F.size(F.array_distinct(x))).alias("dup"),
            bigint(F.size(F.filter(x, lambda y: F.ltrim(y).substr(1, 1).isin("-", "*", "|")))).alias("bullet"),
        ),
    )
    counts = docs.withColumn(into, F.struct(of_words.alias("words"), of_lines.alias("lines")))
    words, lines = F.col(into)["words"], F.col(into)["lines"]
    return counts.withColumn(
        into,
        F.struct(
            words["n"].alias("n_words"),
            bigint(F.char_length(_without(t, SPACES))).alias("word_chars"),
            bigint(_count_of(t, "#*$%&|<>")).alias("n_symbols"),
            lines["dup"].alias("n_dup_lines"),
            words["repeated"].alias("n_repeat_words"),
            words["stop"].alias("n_stop_words"),
            bigint(_count_of(t, "!")).alias("n_shouts"),
            lines["n"].alias("n_lines"),
            lines["bullet"].alias("n_bullet_lines"),
        ),
    )


def ratios(m: Column) -> dict[str, Column]:
    """What the rule table may name, from the counts."""
    per = lambda x, y: x / F.greatest(y, F.lit(1).cast("bigint"))
    return {
        "chars_per_word": per(m["word_chars"], m["n_words"]),
        "symbols_per_word": per(m["n_symbols"], m["n_words"]),
        "shouts_per_word": per(m["n_shouts"], m["n_words"]),
        "stop_word_ratio": per(m["n_stop_words"], m["n_words"]),
        "dup_line_ratio": per(m["n_dup_lines"], m["n_lines"]),
        "bullet_line_ratio": per(m["n_bullet_lines"], m["n_lines"]),
    }


def base_failed(m: Column) -> Column:
    """Too short, or mostly repeated three-word windows."""
    return (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > MAX_REPEAT_PERCENT * m["n_words"])


def verdict(m: Column, rules=RULES) -> Column:
    """All rules of the table as one Boolean column."""
    named, passed = ratios(m), F.lit(True)
    for r in rules:
        side = named[r.measure]
        passed = passed & {"<=": side <= r.bound, ">=": side >= r.bound, "<": side < r.bound, ">": side > r.bound}[r.op]
    return passed


def judged(docs: DataFrame, text: str = "text", rules=RULES) -> DataFrame:
    """The input with a struct column `_quality`: counts, base_failed, kept.

    A column of that name in the input is replaced.
    """
    out = measured(docs.drop("_quality"), text, "_quality")
    m = F.col("_quality")
    failed = base_failed(m)
    return out.withColumn("_quality", F.struct("_quality.*", failed.alias("base_failed"), (~failed & verdict(m, rules)).alias("kept")))


def filtered(docs: DataFrame, text: str = "text", rules=RULES) -> DataFrame:
    """Only the rows that pass; columns as they came."""
    names = [F.col(f"`{c}`") for c in docs.columns if c != "_quality"]
    return judged(docs, text, rules).filter(F.col("_quality.kept")).select(*names)
