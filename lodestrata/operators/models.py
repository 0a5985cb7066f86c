"""Classifiers, cross-validation, scoring and importances with pyspark.ml."""

from __future__ import annotations

import json
from functools import reduce

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .newton import bootstrap_fits, ensemble_spread, fold_fits, fold_scores
from .validation import average_precision, fold_means, roc_auc, threshold_metrics


def _assembled(features: list[str], model) -> Pipeline:
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="features"), model])


def logistic(features: list[str], n: int, weight: str | None = None) -> Pipeline:
    """L2 logistic regression whose penalty matches an inverse strength of 1 over `n` rows."""
    model = LogisticRegression(featuresCol="features", labelCol="label", regParam=1.0 / max(1, n), elasticNetParam=0.0, standardization=False)
    return _assembled(features, model.setWeightCol(weight) if weight else model)


def forest(features: list[str], trees: int = 500, depth: int = 20, leaf: int = 5, seed: int = 42) -> Pipeline:
    return _assembled(features, RandomForestClassifier(featuresCol="features", labelCol="label", numTrees=trees, maxDepth=depth, minInstancesPerNode=leaf, seed=seed))  # C10


def boosted(features: list[str], rounds: int = 500, depth: int = 8, rate: float = 0.05, sample: float = 0.8, seed: int = 42) -> Pipeline:
    return _assembled(features, GBTClassifier(featuresCol="features", labelCol="label", maxIter=rounds, maxDepth=depth, stepSize=rate, subsamplingRate=sample, seed=seed))  # C9


def balanced(rows: DataFrame) -> DataFrame:
    """Adds `weight`: classes count alike."""
    n = rows.groupBy("label").agg(F.count("*").alias("_c"))
    k = n.agg(F.sum("_c").alias("_n"), F.count("*").alias("_k"))
    return rows.join(F.broadcast(n.crossJoin(k)), "label").withColumn("weight", F.col("_n") / (F.col("_k") * F.col("_c"))).drop("_c", "_n", "_k")


def score(model: PipelineModel, rows: DataFrame, name: str = "score") -> DataFrame:
    return model.transform(rows).withColumn(name, vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction")


def _plain_logistic(estimator: Pipeline) -> bool:
    last = estimator.getStages()[-1]
    return isinstance(last, LogisticRegression) and not last.getStandardization() and last.getElasticNetParam() == 0 and not last.isSet("weightCol")


def cross_validate(rows: DataFrame, estimator: Pipeline, fold: str = "fold") -> DataFrame:
    """Rows with `score` by the model of the other folds; folds whose training rows have one class are skipped.

    Regressions (without weights) are fitted for all folds in the same jobs; other estimators fold by fold.
    """
    folds = [r[0] for r in rows.where(F.col(fold).isNotNull()).select(fold).distinct().orderBy(fold).collect()]  # a few folds
    if folds and _plain_logistic(estimator):
        features = estimator.getStages()[0].getInputCols()
        beta = fold_fits(rows, features, fold, folds, estimator.getStages()[-1].getRegParam())
        return rows.dropna(subset=[fold, *features]).withColumn("score", fold_scores(features, fold, folds, beta)).where("score is not null and not isnan(score)")
    parts = []
    for f in folds:
        train = rows.where(F.col(fold) != f)
        if train.select("label").distinct().count() < 2:
            continue
        parts.append(score(estimator.fit(train), rows.where(F.col(fold) == f)))
    return reduce(DataFrame.unionByName, parts) if parts else rows.withColumn("score", F.lit(None).cast("double")).limit(0)


def fold_metrics(scored: DataFrame, fold: str = "fold") -> DataFrame:
    """fold, n_test, pr_auc, roc_auc and threshold metrics; rank metrics are NULL where a fold has one class."""
    one = scored.groupBy(fold).agg(F.count("*").alias("n_test"), (F.min("label") == F.max("label")).alias("_one"))
    t = threshold_metrics(scored, by=[fold]).withColumn("_t", F.format_string("%.1f", "threshold"))
    wide = t.groupBy(fold).pivot("_t", ["0.3", "0.5", "0.7"]).agg(F.first("f1").alias("f1"), F.first("precision").alias("precision"), F.first("recall").alias("recall"))
    wide = wide.toDF(*(c if c == fold else "_at_".join(reversed(c.split("_"))).replace(".", "") for c in wide.columns))
    out = one.join(average_precision(scored, [fold], "pr_auc"), fold, "left").join(roc_auc(scored, [fold], "roc_auc"), fold, "left").join(wide, fold, "left")
    return out.withColumn("pr_auc", F.when(~F.col("_one"), F.col("pr_auc"))).withColumn("roc_auc", F.when(~F.col("_one"), F.col("roc_auc"))).drop("_one")


def train_validated(rows: DataFrame, estimator: Pipeline, fold: str = "fold") -> tuple[PipelineModel, DataFrame, DataFrame]:
    """(model on all rows, metrics of each fold, their means) (C11)."""
    metrics = fold_metrics(cross_validate(rows, estimator, fold), fold)
    return estimator.fit(rows), metrics, fold_means(metrics, [c for c in metrics.columns if c not in (fold, "n_test")])


def bootstrap_coefficients(rows: DataFrame, features: list[str], replicates: int, key: str, penalty: float, seed: int = 0) -> np.ndarray:
    """Coefficients [replicates, features + 1] of a logistic regression of each Poisson resample, all fitted in the same jobs.

    NaN for resamples with one class. `penalty` is that of the library's regression (regParam).
    """
    return bootstrap_fits(rows, features, key, replicates, penalty, seed)


def sign_stability(coefficients: np.ndarray, features: list[str], spark) -> DataFrame:
    """feature, mean, low, high (2.5 and 97.5 %), consistency, stable: coefficients over the resamples."""
    data = [(k, f, float(c)) for k, row in enumerate(coefficients) for f, c in zip(features, row[:-1], strict=True) if not np.isnan(c)]
    t = spark.createDataFrame(data, "replicate int, feature string, c double")
    up = F.avg((F.col("c") > 0).cast("double"))
    out = t.groupBy("feature").agg(F.avg("c").alias("mean"), F.percentile("c", F.lit(0.025)).alias("low"), F.percentile("c", F.lit(0.975)).alias("high"), F.greatest(up, 1 - up).alias("consistency"))
    return out.withColumn("stable", F.col("consistency") >= 0.95)


def predict_cells(cells: DataFrame, model: PipelineModel, features: list[str], ensemble: np.ndarray | list[PipelineModel] = ()) -> DataFrame:
    """Adds prob (0-100) and uncertainty (population deviation over the ensemble x 100); NULL where a feature is missing.

    `ensemble` holds models, or the coefficients of `bootstrap_coefficients`. Cells are scored where they lie, without a join: those that
    lack a feature go beside the others.
    """
    none = F.lit(None).cast("double")
    lost = cells.where(" or ".join(f"`{f}` is null or isnan(`{f}`)" for f in features)).withColumns({"prob": none, "uncertainty": none})
    out = score(model, cells.dropna(subset=features), "prob").withColumn("prob", F.col("prob") * 100)
    if isinstance(ensemble, np.ndarray):
        beta = ensemble[~np.isnan(ensemble).any(axis=1)]
        spread = ensemble_spread(features, beta) if len(beta) else F.lit(0.0)
        return out.withColumn("uncertainty", spread * 100).select(*cells.columns, "prob", "uncertainty").unionByName(lost)
    for k, m in enumerate(ensemble):
        out = score(m, out, f"_p{k}")
    n = len(ensemble)
    if not n:
        return out.withColumn("uncertainty", F.lit(0.0)).unionByName(lost)
    out = out.withColumn("_p", F.array(*(F.col(f"_p{k}") for k in range(n)))).withColumn("_m", F.aggregate("_p", F.lit(0.0), lambda a, p: a + p) / n)
    spread = F.sqrt(F.aggregate("_p", F.lit(0.0), lambda a, p: a + (p - F.col("_m")) * (p - F.col("_m"))) / n) * 100
    return out.withColumn("uncertainty", spread).select(*cells.columns, "prob", "uncertainty").unionByName(lost)


def permutation_importance(model: PipelineModel, rows: DataFrame, features: list[str], key: str) -> DataFrame:
    """name, importance: mean change of the score when a feature takes another row's value, by a hash order.

    For models that are no trees (those have `attributions`): it needs no model internals, and one pass for each feature.
    """
    from pyspark.sql import Window

    order = Window.partitionBy("_g").orderBy(F.xxhash64(F.lit(7), key))
    base = score(model, rows.withColumn("_g", F.pmod(F.xxhash64(key), F.lit(64))), "_base")
    parts = []
    for f in features:
        moved = base.withColumn(f, F.coalesce(F.lead(f).over(order), F.first(f).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))))
        parts.append(score(model, moved, "_new").agg(F.lit(f).alias("name"), F.avg(F.abs(F.col("_new") - F.col("_base"))).alias("importance")))
    return reduce(DataFrame.unionByName, parts)


def save_model(model: PipelineModel, path: str, metadata: dict) -> None:
    """The model, and its metadata as a JSON row beside it (K4)."""
    model.write().overwrite().save(f"{path}/model")
    SparkSession.getActiveSession().createDataFrame([(json.dumps(metadata, default=str),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/metadata")


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(f"{path}/model")

