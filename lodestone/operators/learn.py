"""Learned scorers with grouped cross-validation, on pyspark.ml.

Folds are lists of questions; the driver loops over folds only, never over rows.
"""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators import ordered
from lodestone.operators.retrieve import top_k
from lodestone.sources.scratch import stored


def scorer(kind: str, features: list[str], label: str) -> Pipeline:
    """Balanced logistic regression, ridge regression, or boosted trees (in place of rankers that Spark lacks)."""
    stages = [VectorAssembler(inputCols=features, outputCol="_raw"), StandardScaler(inputCol="_raw", outputCol="_x", withMean=True)]
    if kind == "ridge":
        last = LinearRegression(featuresCol="_x", labelCol=label, regParam=1.0, elasticNetParam=0.0, predictionCol="predicted")
    elif kind == "boosted":
        last = GBTClassifier(featuresCol="_x", labelCol=label, weightCol="_weight", maxIter=10, maxDepth=3, seed=7)
    else:
        last = LogisticRegression(featuresCol="_x", labelCol=label, weightCol="_weight", fitIntercept=kind != "pairwise", maxIter=20)
    return Pipeline(stages=[*stages, last])


def balanced(rows: DataFrame, label: str) -> DataFrame:
    n = rows.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    both = rows.join(F.broadcast(n), label)  # one row a class
    return both.withColumn("_weight", 1.0 / F.col("_n")).drop("_n")


def scored(model, rows: DataFrame, kind: str) -> DataFrame:
    out = model.transform(rows)
    score = F.col("predicted") if kind == "ridge" else vector_to_array("probability")[1]
    return out.withColumn("model_score", score)


def out_of_fold(rows: DataFrame, kind: str, features: list[str], label: str, folds: int, fold: str = "fold") -> DataFrame:
    """Each row scored by a model that didn't see its fold."""
    rows, out = stored(rows, "learned"), None
    for k in range(folds):
        train = rows.filter(F.col(fold) != k)
        model = scorer(kind, features, label).fit(train if kind == "ridge" else balanced(train, label))
        part = scored(model, rows.filter(F.col(fold) == k), kind).select(*rows.columns, "model_score")
        out = part if out is None else out.unionByName(part)
    return out


def argmax(rows: DataFrame, score: str = "model_score", tie: str = "place") -> DataFrame:
    return top_k(rows, ["q_id"], [F.col(score).desc(), F.col(tie)], 1, "n").drop("n")


def selection_metrics(selected: DataFrame, rows: DataFrame, value: str = "f1", margin: float = 0.0, tie: str = "place") -> DataFrame:
    """Baseline (first place), selected and oracle averages, gap closed, wins and losses."""
    base = argmax(rows.withColumn("_s", -F.col(tie)), "_s").select("q_id", F.col(value).alias("b"))
    best = rows.groupBy("q_id").agg(F.max(value).alias("o"))
    j = selected.select("q_id", F.col(value).alias("s")).join(base, "q_id").join(best, "q_id")
    avg = lambda c: F.round(F.avg(c), 4)
    d = F.col("s") - F.col("b")
    gap = F.when(F.sum(F.col("o") - F.col("b")) > 0, F.sum(d) / F.sum(F.col("o") - F.col("b"))).otherwise(0.0)
    return j.agg(F.count(F.lit(1)).alias("questions"), avg("b").alias("baseline"), avg("s").alias("selected"), avg("o").alias("oracle"), F.round(gap, 4).alias("gap_closed"), F.count_if(d > margin).alias("improved"), F.count_if(d < -margin).alias("regressed"), F.count_if(F.abs(d) <= margin).alias("tied"))


def guarded(rows: DataFrame, rank_max: int, margin: float) -> DataFrame:
    """A selected candidate replaces the first one only within its limits; reasons say why not."""
    first = top_k(rows, ["q_id"], [F.col("place")], 1, "n").select("q_id", F.col("model_score").alias("base_score"), F.col("doc_id").alias("base_doc"))
    j = argmax(rows).join(first, "q_id")
    reasons = F.array_compact(F.array(F.when(F.col("rank") > rank_max, "selected_rank_above_limit"), F.when(F.col("model_score") - F.col("base_score") < margin, "score_margin_too_small")))
    return j.select("q_id", "doc_id", "base_doc", F.array_join(reasons, ",").alias("blocked"), (F.size(reasons) == 0).alias("accepted"))


def auc(rows: DataFrame, score: str, label: str) -> DataFrame:
    """ROC AUC by ranks: ties count half."""
    per = rows.groupBy(score).agg(F.count_if(F.col(label) == 1).alias("_pos"), F.count_if(F.col(label) == 0).alias("_neg"))
    below = ordered.running(per, [F.col(score)], F.col("_neg"), "_below")
    each = below.withColumn("wins", F.col("_pos") * (F.col("_below") + F.col("_neg") / 2))
    return each.agg(F.round(F.sum("wins") / (F.sum("_pos") * F.sum("_neg")), 6).alias("auc"))
