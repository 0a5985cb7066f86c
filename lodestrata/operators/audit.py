"""The whole audit of a classifier: folds, refits, resamples and the certificate."""

from __future__ import annotations

from dataclasses import asdict, dataclass
from functools import reduce

from pyspark.ml import Pipeline
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import models, validation


@dataclass(frozen=True)
class Settings:
    """Limits and sizes of the audit. Distances are in the units of x and y (metres)."""

    block: float = 25_000.0
    random_folds: int = 5
    spatial_folds: int = 5
    replicates: int = 200
    bins: int = 10
    max_gap: float = 0.30
    max_ece: float = 0.10
    leak: float = 0.95
    stable: float = 0.5


def pooled_precision(rows: DataFrame, estimator: Pipeline) -> DataFrame:
    """One row, `ap`: average precision of all out-of-fold scores together; NULL where they have one class only."""
    held = models.cross_validate(rows, estimator).select("label", "score")
    both = held.agg((F.min("label") < F.max("label")).alias("both"))
    return validation.average_precision(held).crossJoin(F.broadcast(both)).select(F.when(F.col("both"), F.col("ap")).alias("ap"))


def audit(rows: DataFrame, features: list[str], estimator: Pipeline, key: str = "id", settings: Settings = Settings()) -> DataFrame:
    """One row: the scores, `tests` (name, passed, score, threshold), tests_passed, grade, passed and certificate.

    `rows` have `key`, label (0 or 1), x, y and the features; rows with a missing feature are left out. Random folds are stratified by
    class, spatial ones are square blocks dealt in turn. The estimator is a logistic regression without standardisation, whose resamples
    are fitted together; those with one class are left out. A test whose score is NULL does not pass.
    """
    s = settings
    rows = rows.select(key, "label", "x", "y", *features).dropna(subset=["label", "x", "y", *features]).cache()
    try:
        mixed = validation.stratified_folds(rows, key, "label", s.random_folds)
        blocks = validation.spatial_blocks(rows, s.block)
        spread = blocks.join(F.broadcast(validation.round_robin_folds(blocks, s.spatial_folds)), "block")  # one row a block
        random_ap = pooled_precision(mixed, estimator).withColumnRenamed("ap", "pr_random")
        spatial_ap = pooled_precision(spread, estimator).withColumnRenamed("ap", "pr_spatial")
        base = rows.agg(F.count("*").alias("n_samples"), F.sum("label").cast("long").alias("n_positives"), F.avg("label").alias("prior"))
        fits = models.bootstrap_coefficients(rows, features, s.replicates, key, estimator.getStages()[-1].getRegParam())
        steady = models.sign_stability(fits, features, rows.sparkSession).agg(F.avg(F.col("stable").cast("double")).alias("stable_fraction"))
        held = models.score(estimator.fit(mixed.where("fold <> 0")), mixed.where("fold = 0"))
        ece = validation.calibration_error(held, s.bins)
        leaks = validation.label_correlation(rows, features, s.leak).agg(F.coalesce(F.max(F.abs("r")), F.lit(0.0)).alias("max_corr"))
        one = reduce(DataFrame.crossJoin, (F.broadcast(t) for t in (random_ap, spatial_ap, base, steady, ece, leaks)))  # one row each
        graded = validation.audit_from_scores(one, s.max_gap, s.max_ece, s.leak, s.stable)
        named = ";".join(f"{k}={v}" for k, v in sorted(asdict(s).items()))
        sealed = validation.certificate(rows, [key], ["label", "x", "y", *features], named).withColumnRenamed("certificate", "data")
        shown = F.concat_ws("|", F.col("data"), *(F.coalesce(F.round(c, 9).cast("string"), F.lit("NULL")) for c in ("pr_random", "pr_spatial", "prior", "stable_fraction", "ece", "max_corr")), F.col("grade"))
        out = graded.crossJoin(F.broadcast(sealed)).withColumn("certificate", F.sha2(shown, 256)).drop("data")
        return rows.sparkSession.createDataFrame(out.collect(), out.schema)  # one row
    finally:
        rows.unpersist()


def baselines(rows: DataFrame, features: list[str], estimator: Pipeline, key: str = "id") -> DataFrame:
    """name, ap: the best single feature, the estimator over the folds in `fold`, and labels in a hash order."""
    best = validation.best_single_feature(rows, features).select(F.concat(F.lit("best_feature:"), "feature").alias("name"), "ap")
    fitted = pooled_precision(rows, estimator).select(F.lit("model").alias("name"), "ap")
    chance = validation.random_baseline(rows, key).select(F.lit("random").alias("name"), "ap")
    return best.unionByName(fitted).unionByName(chance)
