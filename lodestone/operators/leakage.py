"""Leakage, duplicates and splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import ordered, similar
from lodestone.sources.scratch import stored


def exact_overlaps(left: DataFrame, right: DataFrame, left_text: str = "text", right_text: str = "text") -> DataFrame:
    """All pairs with equal, non-empty normalised text."""
    a = left.withColumn("norm", T.question_key(F.col(left_text))).filter("norm <> ''").drop(left_text)
    b = right.withColumn("norm", T.question_key(F.col(right_text))).filter("norm <> ''").drop(right_text)
    return a.join(b, "norm").drop("norm")


def internal_duplicates(rows: DataFrame, id_: str, text: str = "text") -> DataFrame:
    """Ids whose normalised text occurs more than once, with their class.

    The class is named by its smallest id; sizes come from a partial aggregate,
    so a class that holds a third of the rows isn't gathered.
    """
    keyed = rows.select(F.col(id_).alias("id"), F.sha2(T.question_key(F.col(text)).cast("binary"), 256).alias("norm"))
    classes = keyed.groupBy("norm").agg(F.min("id").alias("class_id"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    return keyed.join(classes, "norm").select("id", "class_id", "n")


def similar_sets(rows: DataFrame, id_: str, terms: Column, threshold: float = 0.9) -> DataFrame:
    """(left_id, right_id, similarity, n_left, n_right): pairs of term-set classes with Jaccard >= threshold.

    Equal sets are one class, named by its smallest id.  No similar pair is lost;
    how pairs meet, and how few sets are shuffled, is told in `similar`.
    """
    classes, pairs = similar.similar_classes(rows, id_, terms, threshold)
    named = lambda side: classes.select(F.col("c").alias(side), F.col("id").alias(f"{side}_id"), F.col("members").alias(f"n_{side}"))
    both = pairs.join(named("a"), "a").join(named("b"), "b").filter("a_id <> b_id")
    left, right = (F.struct(F.col(f"{x}_id").alias("id"), F.col(f"n_{x}").alias("n")) for x in "ab")
    swap = F.col("a_id") > F.col("b_id")
    both = both.select(F.when(swap, right).otherwise(left).alias("l"), F.when(swap, left).otherwise(right).alias("r"), F.round("similarity", 4).alias("similarity"))
    return both.select(F.col("l.id").alias("left_id"), F.col("r.id").alias("right_id"), "similarity", F.col("l.n").alias("n_left"), F.col("r.n").alias("n_right"))


def set_members(rows: DataFrame, id_: str, terms: Column, pairs: DataFrame) -> DataFrame:
    """(id, representative, members, n_links): every row with terms, beside the pairs of `similar_sets`.

    The representative is the smallest id with an equal set; n_links counts the
    other classes that are similar to its class.
    """
    sets = rows.select(F.col(id_).alias("id"), F.array_sort(F.array_distinct(terms)).alias("terms")).filter(F.size("terms") > 0)
    keyed = stored(sets.select("id", F.unhex(F.sha2(F.array_join("terms", " ").cast("binary"), 256)).alias("key")), "keys")  # texts are cut into terms once
    classes = keyed.groupBy("key").agg(F.min("id").alias("representative"), F.count(F.lit(1)).alias("members"))
    links = pairs.select(F.explode(F.array("left_id", "right_id")).alias("representative")).groupBy("representative").agg(F.count(F.lit(1)).alias("n_links"))
    named = classes.join(links, "representative", "left")
    return keyed.join(named, "key").select("id", "representative", "members", F.coalesce("n_links", F.lit(0)).alias("n_links"))


def near_sets(left: DataFrame, left_id: str, left_terms: Column, right: DataFrame, right_id: str, right_terms: Column, threshold: float = 0.9) -> DataFrame:
    """(left_id, right_id, similarity): all pairs of rows of two tables whose term sets have Jaccard >= threshold.

    Prefixes of rare terms meet within length bounds, as in `similar_sets`; ids are unique.
    """
    sets = lambda d, id_, terms: d.select(F.col(id_).alias("id"), F.array_distinct(terms).alias("terms")).withColumn("n", F.size("terms")).filter("n > 0")
    a, b = sets(left, left_id, left_terms), sets(right, right_id, right_terms)
    each = lambda d: d.select("id", "n", F.explode("terms").alias("term"))
    frequency = each(a).union(each(b).select(F.col("id").cast(a.schema["id"].dataType), "n", "term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    by_rarity = W.partitionBy("id").orderBy("df", "term")

    def prefix(d, side):
        kept = each(d).join(frequency, "term").withColumn("at", F.row_number().over(by_rarity)).filter(F.col("at") <= F.col("n") - F.ceil(threshold * F.col("n")) + 1)
        return kept.select(F.col("id").alias(f"{side}_id"), F.col("n").alias(f"{side}_n"), "term")

    bounds = (F.col("right_n") >= F.ceil(threshold * F.col("left_n"))) & (F.col("right_n") <= F.floor(F.col("left_n") / threshold))
    candidates = prefix(a, "left").join(prefix(b, "right"), "term").filter(bounds).select("left_id", "right_id").distinct()
    named = lambda d, side: d.select(F.col("id").alias(f"{side}_id"), F.col("terms").alias(f"{side}_terms"))
    both = candidates.join(named(a, "left"), "left_id").join(named(b, "right"), "right_id")
    shared = F.size(F.array_intersect("left_terms", "right_terms"))
    similarity = shared / (F.size("left_terms") + F.size("right_terms") - shared)
    return both.withColumn("similarity", similarity).filter(F.col("similarity") >= threshold).select("left_id", "right_id", F.round("similarity", 4).alias("similarity"))


def contained_passages(passages: DataFrame, passage_id: str, docs: DataFrame, doc_id: str, text: str = "text") -> DataFrame:
    """(passage_id, doc_id): all documents that hold the whole normalised passage, word by word; ids are unique.

    A passage is looked up by its first 8, 4 or 1 words, whichever it has, among
    the word runs of the documents; whole texts decide.
    """
    runs = (8, 4, 1)
    words = F.split("norm", " ")
    normal = lambda d, id_, name: d.select(F.col(id_).alias(name), T.question_key(F.col(text)).alias("norm")).filter("norm <> ''")
    key = lambda ws, at, k: F.xxhash64(F.lit(k), F.array_join(F.slice(ws, at, k), " "))
    asked = normal(passages, passage_id, "_passage").withColumn("_words", words)
    first = F.coalesce(*[F.when(F.size("_words") >= k, key(F.col("_words"), F.lit(1), k)) for k in runs])
    asked = asked.select("_passage", F.col("norm").alias("_asked"), first.alias("_key"))
    held = normal(docs, doc_id, "_doc")
    split = held.withColumn("_words", words)
    starts = lambda k: F.when(F.size("_words") >= k, F.sequence(F.lit(1), F.size("_words") - k + 1)).otherwise(F.array().cast("array<int>"))
    keys_of = lambda k: F.transform(starts(k), lambda i: key(F.col("_words"), i, k))
    every = F.flatten(F.array(*[keys_of(k) for k in runs]))
    found = split.select("_doc", F.explode(F.array_distinct(every)).alias("_key")).join(asked.select("_passage", "_key"), "_key").select("_passage", "_doc").distinct()
    padded = lambda c: F.concat(F.lit(" "), F.col(c), F.lit(" "))
    both = found.join(asked.select("_passage", "_asked"), "_passage").join(held, "_doc").filter(F.contains(padded("norm"), padded("_asked")))
    return both.select(F.col("_passage").alias(passage_id), F.col("_doc").alias(doc_id))


def order_hash(seed: str, key: Column) -> Column:
    """A reproducible order that stands in for a seeded shuffle."""
    return F.sha2(F.concat(F.lit(seed + "|"), key.cast("string")).cast("binary"), 256)


def disjoint_selection(ids: DataFrame, id_: str, ratio: float, seed: str) -> DataFrame:
    """ceil(n ratio) distinct ids, the first by hash order."""
    d = ids.select(F.col(id_).alias("id")).distinct().withColumn("h", order_hash(seed, F.col("id")))
    placed = ordered.numbered(d, [F.col("h"), F.col("id")], "_n")
    most = placed.agg(F.ceil(F.count(F.lit(1)) * F.lit(ratio)).alias("_most"))
    return placed.join(F.broadcast(most)).filter(F.col("_n") <= F.col("_most")).select("id")  # one row


def fold_round_robin(keys: DataFrame, key: str, folds: int) -> DataFrame:
    """Position in key order, modulo the number of folds."""
    d = ordered.numbered(keys.select(key).distinct(), [F.col(key)], "_n")
    return d.select(key, ((F.col("_n") - 1) % folds).alias("fold"))


def greedy_folds(groups: DataFrame, key: str, size: str, folds: int) -> DataFrame:
    """Largest groups first into the smallest fold: an ordered fold over the list of groups."""
    item = F.struct((-F.col(size)).alias("s"), F.sha2(F.col(key).cast("string").cast("binary"), 256).alias("h"), F.col(key).alias("k"))
    listed = groups.agg(F.array_sort(F.collect_list(item)).alias("g"))  # one row a group, groups are question sets
    start = F.struct(F.array_repeat(F.lit(0).cast("bigint"), folds).alias("load"), F.array().cast(f"array<struct<k:{dict(groups.dtypes)[key]},fold:int>>").alias("out"))

    def put(acc, x):
        at = F.array_position(acc["load"], F.array_min(acc["load"])).cast("int")
        load = F.transform(acc["load"], lambda v, i: F.when(i == at - 1, v - x["s"]).otherwise(v))
        return F.struct(load.alias("load"), F.concat(acc["out"], F.array(F.struct(x["k"].alias("k"), at.alias("fold")))).alias("out"))

    done = listed.select(F.explode(F.aggregate("g", start, put)["out"]).alias("r"))
    return done.select(F.col("r.k").alias(key), F.col("r.fold").alias("fold"))


def leakage_report(exact: DataFrame, near: DataFrame, total: DataFrame, clean: str = "clean") -> DataFrame:
    """Counts and decision of a leakage audit; `clean` names what was looked for in vain."""
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    both = count(total, "rows").join(count(exact, "exact")).join(count(near, "near"))
    return both.withColumn("decision", F.when((F.col("exact") > 0) | (F.col("near") > 0), "leakage_found").otherwise(clean))


def exact_precheck(external: DataFrame, development: DataFrame, id_: str, dev_id: str, split: str) -> DataFrame:
    """One row: development questions, exact pairs, distinct external rows in them, and whether there are none.

    Both tables have a `text`.  The counts of equal texts are multiplied, so a
    text that a third of the rows hold never becomes pairs.
    """
    norm = T.question_key(F.col("text"))
    a = external.select(F.col(id_).alias("_id"), norm.alias("norm")).distinct().groupBy("norm").agg(F.count(F.lit(1)).alias("n_external"))
    b = development.select(F.struct(split, dev_id).alias("_dev"), norm.alias("norm"))
    by_norm = b.groupBy("norm").agg(F.count(F.lit(1)).alias("n_dev"))
    met = a.join(by_norm, "norm").filter("norm <> ''").agg(F.coalesce(F.sum(F.col("n_external") * F.col("n_dev")), F.lit(0)).alias("exact_pairs"), F.coalesce(F.sum("n_external"), F.lit(0)).alias("external_rows"))
    asked = b.agg(F.count(F.lit(1)).alias("development_questions"))
    return asked.join(met).withColumn("passed", F.col("exact_pairs") == 0)
