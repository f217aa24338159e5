"""Logistic models by Newton steps, all left-out folds and heads at once.

A step is one pass: every task adds up gradients and Hessians of its rows for each
model, a grouped sum merges them (models x features squared numbers, whatever
the number of rows), and the driver solves the small systems.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators.objectives import sigmoid

STEPS = 12


def design(rows: DataFrame, features: list[str], labels: list[str], keys: list[str], weight: str | None = None) -> DataFrame:
    """(keys, fold, x, y, w): features and labels as arrays; one label a head."""
    x = F.array(*[F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in features])
    return rows.select(*keys, F.col("fold").cast("int").alias("fold"), x.alias("x"), F.array(*[F.col(c).cast("double") for c in labels]).alias("y"), (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("w"))


def _arrays(b: pa.RecordBatch, width: int, heads: int):
    get = lambda c: b.column(b.schema.get_field_index(c))
    x = get("x").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(b.num_rows, width)
    y = get("y").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(b.num_rows, heads)
    return x, y, get("w").to_numpy(zero_copy_only=False).astype(float), get("fold").to_numpy(zero_copy_only=False)


def _summed(rows: DataFrame, shape: tuple[int, ...], add) -> np.ndarray:
    """An array of `shape`, added up over all batches by `add(total, batch)`."""
    size = int(np.prod(shape))

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for b in batches:
            add(total, b)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), pa.array(total.reshape(-1))], ["cell", "v"])

    out = np.zeros(size)
    for r in rows.select("fold", "x", "y", "w").mapInArrow(partial, "cell bigint, v double").groupBy("cell").agg(F.sum("v").alias("v")).collect():
        out[r.cell] = r.v
    return out.reshape(shape)


def left_out(folds: int) -> list[frozenset[int]]:
    return [frozenset([k]) for k in range(folds)]


def left_out_pairs(folds: int) -> list[frozenset[int]]:
    """Also a model for each pair of folds, for choices inside an outer fold."""
    return left_out(folds) + [frozenset([a, b]) for a in range(folds) for b in range(a + 1, folds)]


def fit(rows: DataFrame, width: int, heads: int, models: list[frozenset[int]], intercept: bool = True, l2: float = 1.0, balanced: bool = False, steps: int = STEPS) -> np.ndarray:
    """Weights (model, head, feature [+ intercept]); a model sees no fold of its set.

    Minimises l2 / 2 |v|^2 plus the weighted log-loss, v being the weights of
    features over their standard deviation; an intercept isn't penalised.
    """
    k, d = len(models), width + int(intercept)
    without = [sorted(m) for m in models]

    def moments(total, b):
        x, y, w, fold = _arrays(b, width, heads)
        for m in range(k):
            ok = ~np.isin(fold, without[m])
            total[m, 0, :width] += x[ok].sum(axis=0)
            total[m, 1, :width] += (x[ok] ** 2).sum(axis=0)
            total[m, 2, 0] += ok.sum()
            total[m, 3, :heads] += y[ok].sum(axis=0)

    got = _summed(rows, (k, 4, max(width, heads, 1)), moments)
    n = np.maximum(got[:, 2, :1], 1)
    mean = got[:, 0, :width] / n if intercept else np.zeros((k, width))
    scale = np.sqrt(np.maximum(got[:, 1, :width] / n - mean**2, 0))
    scale[scale < 1e-12] = 1.0
    share = np.clip(got[:, 3, :heads] / n, 1e-9, 1 - 1e-9)
    v = np.zeros((k, heads, d))

    def gradients(total, b):
        x, y, w, fold = _arrays(b, width, heads)
        for m in range(k):
            ok = ~np.isin(fold, without[m])
            z = x[ok] / scale[m]
            if intercept:
                z = np.hstack([z, np.ones((len(z), 1))])
            for h in range(heads):
                t = y[ok, h]
                p = sigmoid(z @ v[m, h])
                own = w[ok] * np.where(t > 0, 0.5 / share[m, h], 0.5 / (1 - share[m, h])) if balanced else w[ok]
                total[m, h, 0] += (own * (p - t)) @ z
                total[m, h, 1:] += (z * (own * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ z

    penalty = np.diag([l2] * width + [1e-9] * int(intercept))
    for _ in range(steps):
        total = _summed(rows, (k, heads, d + 1, d), gradients)
        moved = 0.0
        for m in range(k):
            for h in range(heads):
                step = np.linalg.solve(total[m, h, 1:] + penalty, total[m, h, 0] + penalty @ v[m, h])
                step *= min(1.0, 8.0 / max(1e-12, np.abs(step).max()))
                v[m, h] -= step
                moved = max(moved, float(np.abs(step).max()))
        if moved < 1e-7:
            break
    out = v.copy()
    out[:, :, :width] /= scale[:, None, :]
    return out


def by_fold(models: list[frozenset[int]], folds: int) -> dict[int, list[tuple[int, int]]]:
    """For a fold, the pairs (fold, model) that score it as held out."""
    return {k: [(k, models.index(frozenset([k])))] for k in range(folds)}


def by_outer(models: list[frozenset[int]], folds: int) -> dict[int, list[tuple[int, int]]]:
    """For a fold, pairs (outer fold, model): the model saw neither the outer fold nor the row's own."""
    return {k: [(o, models.index(frozenset({k, o}))) for o in range(folds)] for k in range(folds)}


def scored(rows: DataFrame, weights: np.ndarray, width: int, by: dict[int, list[tuple[int, int]]], probability: bool = True) -> DataFrame:
    """The rows, once a pair of `by`, with `outer` and `model_scores`, one a head.

    The weights are literals of the plan: models x heads x features numbers.
    """
    names = [c for c in rows.columns if c not in ("x", "w", "outer")]
    pair = lambda o, m: F.struct(F.lit(o).alias("outer"), F.array(*[F.array(*[F.lit(float(z)) for z in head]) for head in weights[m]]).alias("heads"))
    choice = F.array()
    for k, pairs in by.items():
        choice = F.when(F.col("fold") == k, F.array(*[pair(o, m) for o, m in pairs])).otherwise(choice) if k else F.when(F.col("fold") == k, F.array(*[pair(o, m) for o, m in pairs]))
    with_one = F.concat("x", F.array(F.lit(1.0))) if weights.shape[2] > width else F.col("x")

    def value(head):
        s = F.aggregate(F.zip_with(head, with_one, lambda a, b: a * b), F.lit(0.0), lambda acc, z: acc + z)
        return 1 / (1 + F.exp(-s)) if probability else s

    each = rows.select(*names, with_one.alias("x"), F.explode(choice).alias("own"))
    with_one = F.col("x")
    return each.select(*names, F.col("own.outer").alias("outer"), F.transform("own.heads", value).alias("model_scores"))
