"""Boosted regression trees over whole questions, all left-out folds at once.

A question is one row: its candidates' features, labels and weights as arrays, at
most a pool's depth long, so questions are dealt over tasks and never cut.  A
model is told which folds it must not see; every pass over the rows serves all
models.  Trees grow level by level.  In a pass each task scores its questions,
takes the objective's gradients, and adds them up by model, node, feature and
bin; a grouped sum merges these histograms, whose size depends on none of the
data, and the driver picks the best cut of every node.  Sums are integers
(multiples of 2 ** -24), so a fit doesn't depend on how rows are dealt.

Leaves hold rate * -G / (H + l2), or, for the pinball loss, rate times a quantile
of the leaf's residuals (percentile_approx, exact up to 10,000 values).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators.objectives import Objective

UNIT = float(2**24)
ANY = -1  # an outer key that every model may see


@dataclass
class Model:
    """Trees of a model that sees no fold of `without`, and of rows with an outer key that key alone."""

    without: frozenset[int]
    outer: int = ANY
    cuts: list[list[float]] = field(default_factory=list)
    base: float = 0.0
    class_weights: tuple[float, float] = (1.0, 1.0)
    trees: list[tuple] = field(default_factory=list)  # (features, cut values, leaves), level by level

    def sees(self, fold: np.ndarray, outer: np.ndarray) -> np.ndarray:
        return ~np.isin(fold, list(self.without)) & ((outer == ANY) | (outer == self.outer))

    def nodes(self, x: np.ndarray, tree: tuple, depth: int) -> np.ndarray:
        at = np.zeros(len(x), int)
        for level in range(depth):
            f, cut = (np.asarray(a)[2**level - 1 + at] for a in tree[:2])
            at = 2 * at + (x[np.arange(len(x)), np.maximum(f, 0)] > cut)
        return at

    def score(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for tree in self.trees:
            depth = int(np.log2(len(tree[2])))
            out += np.asarray(tree[2])[self.nodes(x, tree, depth)]
        return out


def left_out(folds: int) -> list[Model]:
    """A model for each fold that doesn't see it."""
    return [Model(frozenset([k])) for k in range(folds)]


def left_out_pairs(folds: int) -> list[Model]:
    """Also a model for each pair of folds, for choices inside an outer fold."""
    return left_out(folds) + [Model(frozenset([a, b])) for a in range(folds) for b in range(a + 1, folds)]


def grouped(rows: DataFrame, features: list[str], label: str, item: str, weight: str | None = None, outer: str | None = None) -> DataFrame:
    """(q_id, fold, outer, items, x, y, w): a question a row; rows must have q_id and fold.

    Without a weight column the rows of a question weigh 1 together.
    """
    each = F.struct(F.col(item).cast("string").alias("item"), F.array(*[F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in features]).alias("x"), F.col(label).cast("double").alias("y"), (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("w"))
    keys = ["q_id", "fold", (F.col(outer).cast("int") if outer else F.lit(ANY)).alias("outer")]
    listed = rows.select(*keys, each.alias("e")).groupBy("q_id", "fold", "outer").agg(F.array_sort(F.collect_list("e")).alias("e"))  # a question's candidates
    n = F.lit(1.0) if weight else F.size("e")
    return listed.select("q_id", F.col("fold").cast("int").alias("fold"), "outer", F.col("e.item").alias("items"), F.flatten("e.x").alias("x"), F.col("e.y").alias("y"), F.transform("e.w", lambda w: w / n).alias("w"))


def _flat(column: pa.ListArray) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False)


def _unpacked(b: pa.RecordBatch, width: int):
    """x, y, w of a batch's rows, first row and size of each question, fold and outer key of each row."""
    y, w = (_flat(b.column(b.schema.get_field_index(c))).astype(float) for c in ("y", "w"))
    x = _flat(b.column(b.schema.get_field_index("x"))).astype(float).reshape(len(y), width)
    sizes = np.diff(b.column(b.schema.get_field_index("y")).offsets.to_numpy())
    fold, outer = (np.repeat(b.column(b.schema.get_field_index(c)).to_numpy(), sizes) for c in ("fold", "outer"))
    return x, y, w, np.cumsum(sizes) - sizes, sizes, fold, outer


def _seen(b: pa.RecordBatch, width: int, model: Model):
    """The rows of the questions that a model may see."""
    x, y, w, starts, sizes, fold, outer = _unpacked(b, width)
    ok = model.sees(fold, outer)
    kept = sizes[ok[starts]] if len(starts) else sizes
    w = w * np.where(y > 0, model.class_weights[1], model.class_weights[0]) if model.class_weights != (1.0, 1.0) else w
    return x[ok], y[ok], w[ok], np.cumsum(kept) - kept


def _prepared(groups: DataFrame, models: list[Model], width: int, bins: int, balanced: bool, quantile: float | None) -> None:
    """Cut values of every feature, class weights and the first score, from the rows that each model sees."""
    flat = groups.select("fold", "outer", F.explode(F.arrays_zip(F.sequence(F.lit(0), F.size("y") - 1).alias("i"), "y")).alias("e"), "x")
    at = lambda f: F.element_at("x", F.col("e.i") * width + (f + 1))
    wide = flat.select("fold", "outer", F.col("e.y").alias("y"), *[at(f).alias(f"f{f}") for f in range(width)])
    places = [(i + 1) / bins for i in range(bins - 1)]
    asked = []
    for m, model in enumerate(models):
        own = ~F.col("fold").isin(list(model.without)) & ((F.col("outer") == ANY) | (F.col("outer") == model.outer))
        asked += [F.percentile_approx(F.when(own, F.col(f"f{f}")), F.array(*map(F.lit, places)), F.lit(1000)).alias(f"c{m}_{f}") for f in range(width)]
        asked += [F.count_if(own & (F.col("y") > 0)).alias(f"p{m}"), F.count_if(own).alias(f"n{m}")]
        if quantile is not None:
            asked.append(F.percentile_approx(F.when(own, F.col("y")), F.lit(quantile), F.lit(10_000)).alias(f"b{m}"))
    got = wide.agg(*asked).first()
    for m, model in enumerate(models):
        model.cuts = [sorted(set(got[f"c{m}_{f}"] or [])) for f in range(width)]
        pos, n = got[f"p{m}"], got[f"n{m}"]
        if balanced and 0 < pos < n:
            model.class_weights = (n / (2 * (n - pos)), n / (2 * pos))
        if quantile is not None:
            model.base = float(got[f"b{m}"] or 0.0)


def _histograms(groups: DataFrame, models: list[Model], partial: list[tuple], level: int, objective: Objective, width: int, bins: int) -> dict[int, np.ndarray]:
    """model -> (node, feature, bin, [gradient, Hessian, rows])."""
    nodes = 2**level

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((3, len(models) * nodes * width * bins), np.int64)
        for b in batches:
            for m, model in enumerate(models):
                x, y, w, starts = _seen(b, width, model)
                if not len(y):
                    continue
                g, h = objective(y, w, model.score(x), starts)
                node = model.nodes(x, partial[m], level)
                parts = [np.rint(g * UNIT).astype(np.int64), np.rint(h * UNIT).astype(np.int64), np.ones(len(y), np.int64)]
                for f in range(width):
                    cell = ((m * nodes + node) * width + f) * bins + np.searchsorted(model.cuts[f], x[:, f], side="left")
                    for t, v in zip(total, parts):
                        np.add.at(t, cell, v)
        used = np.flatnonzero(total.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(used), *[pa.array(t[used]) for t in total]], ["cell", "g", "h", "n"])

    found = groups.select("fold", "outer", "x", "y", "w").mapInArrow(sums, "cell bigint, g bigint, h bigint, n bigint")
    out = np.zeros((len(models) * nodes * width * bins, 3))
    for r in found.groupBy("cell").agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.sum("n").alias("n")).collect():  # at most models x nodes x features x bins
        out[r.cell] = r.g / UNIT, r.h / UNIT, r.n
    return dict(enumerate(out.reshape(len(models), nodes, width, bins, 3)))


def _cut(cells: np.ndarray, cuts: list[list[float]], l2: float, least: int):
    """The best cut of a node: (feature, value, left sums, right sums), or no cut."""
    whole = cells[0].sum(axis=0)
    best, found = 1e-9, (-1, np.inf, whole, np.zeros(3))
    value = lambda s: s[..., 0] ** 2 / (s[..., 1] + l2)
    for f, edges in enumerate(cuts):
        if not edges:
            continue
        left = cells[f].cumsum(axis=0)[: len(edges)]
        right = whole - left
        gain = np.where((left[:, 2] >= least) & (right[:, 2] >= least), value(left) + value(right) - value(whole), -1.0)
        i = int(gain.argmax())
        if gain[i] > best:
            best, found = float(gain[i]), (f, float(edges[i]), left[i], right[i])
    return found


def fit(groups: DataFrame, width: int, models: list[Model], objective: Objective, trees: int = 12, depth: int = 2, rate: float = 0.3, l2: float = 0.1, least: int = 5, bins: int = 16, balanced: bool = False) -> list[Model]:
    """Grows every model by `trees` trees; one pass over the rows a level."""
    quantile = getattr(objective, "quantile", None)
    _prepared(groups, models, width, bins, balanced, quantile)
    for _ in range(trees):
        size = 2**depth - 1
        partial = [(np.full(size, -1), np.full(size, np.inf), np.zeros(2**depth)) for _ in models]
        for level in range(depth):
            cells = _histograms(groups, models, partial, level, objective, width, bins)
            for m, model in enumerate(models):
                for node in range(2**level):
                    f, cut, left, right = _cut(cells[m][node], model.cuts, l2, least)
                    partial[m][0][2**level - 1 + node], partial[m][1][2**level - 1 + node] = f, cut
                    if level == depth - 1:
                        for side, s in ((0, left), (1, right)):
                            partial[m][2][2 * node + side] = -rate * s[0] / (s[1] + l2) if s[2] else 0.0
        if quantile is not None:
            _refitted(groups, models, partial, depth, width, rate, quantile)
        for model, tree in zip(models, partial):
            model.trees.append(tree)
    return models


def _refitted(groups: DataFrame, models: list[Model], partial: list[tuple], depth: int, width: int, rate: float, quantile: float) -> None:
    def residuals(batches):
        for b in batches:
            for m, model in enumerate(models):
                x, y, _, _ = _seen(b, width, model)
                leaf = model.nodes(x, partial[m], depth)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(y), m)), pa.array(leaf), pa.array(y - model.score(x))], ["m", "leaf", "r"])

    found = groups.select("fold", "outer", "x", "y", "w").mapInArrow(residuals, "m bigint, leaf bigint, r double")
    for r in found.groupBy("m", "leaf").agg(F.percentile_approx("r", F.lit(quantile), F.lit(10_000)).alias("q")).collect():  # models x leaves
        partial[r.m][2][r.leaf] = rate * r.q


def scored(groups: DataFrame, width: int, models: list[Model], by: dict[int, list[tuple[int, int]]] | None = None) -> DataFrame:
    """(q_id, fold, outer, item, y, model_score) of every candidate.

    `by` gives, for a fold, pairs (outer key, model), used on rows of that key or
    of none; without it the model that was left without the fold scores it, under
    the row's own outer key.
    """

    def apply(batches):
        for b in batches:
            x, y, _, starts, sizes, fold, outer = _unpacked(b, width)
            items = b.column(b.schema.get_field_index("items")).flatten()
            q_ids = b.column(b.schema.get_field_index("q_id")).take(pa.array(np.repeat(np.arange(b.num_rows), sizes)))
            for m, model in enumerate(models):
                for key in {k for pairs in by.values() for k, i in pairs if i == m} if by else {None}:
                    own = np.isin(fold, [f for f, pairs in by.items() if (key, m) in pairs]) & ((outer == ANY) | (outer == key)) if by else np.isin(fold, list(model.without)) & ((outer == ANY) | (outer == model.outer))
                    at = np.flatnonzero(own)
                    if len(at):
                        outers = pa.array(outer[at].astype(np.int32) if key is None else np.full(len(at), key, np.int32))
                        yield pa.RecordBatch.from_arrays([q_ids.take(pa.array(at)), pa.array(fold[at].astype(np.int32)), outers, items.take(pa.array(at)), pa.array(y[at]), pa.array(model.score(x[at]))], ["q_id", "fold", "outer", "item", "y", "model_score"])

    return groups.mapInArrow(apply, "q_id string, fold int, outer int, item string, y double, model_score double")


def out_of_fold(rows: DataFrame, features: list[str], label: str, item: str, folds: int, objective: Objective, weight: str | None = None, **options) -> DataFrame:
    """Each row's score by the model that didn't see its fold."""
    from lodestone.sources.scratch import stored

    groups = stored(grouped(rows, features, label, item, weight), "groups")
    return scored(groups, len(features), fit(groups, len(features), left_out(folds), objective, **options))
