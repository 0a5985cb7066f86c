"""Boosted trees with sampled columns and rows, stopped early on held-out average precision.

Each round fits one regression tree of pyspark.ml to the gradients of the log-loss, over a share of the features and a draw of the
rows that any run repeats. Margins of training and held-out rows are columns that grow by one tree's prediction; their lineage is cut every
few rounds. After `patience` rounds without a better average precision the best round's trees are kept.
"""

from __future__ import annotations

import math
import random
from dataclasses import dataclass, field

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressionModel, DecisionTreeRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .sampling import draw
from .shared import cut
from .validation import average_precision

#: Rounds between cuts of the lineage.
EVERY = 5


@dataclass
class Boosted:
    """Trees with the features that each reads; `history` holds the average precision after each round, `best` the round kept."""

    start: float
    rate: float
    trees: list[tuple[DecisionTreeRegressionModel, list[str]]] = field(default_factory=list)
    history: list[float] = field(default_factory=list)
    best: int = -1

    def score(self, rows: DataFrame, name: str = "score") -> DataFrame:
        """Adds the probability of class 1 by the kept trees."""
        out = rows.withColumn("_margin", F.lit(self.start))
        for tree, features in self.trees[: self.best + 1]:
            out = _grown(out, tree, features, self.rate)
        return out.withColumn(name, _sigmoid(F.col("_margin"))).drop("_margin")


def _sigmoid(margin: Column) -> Column:
    return 1 / (1 + F.exp(-margin))


def _grown(rows: DataFrame, tree: DecisionTreeRegressionModel, features: list[str], rate: float) -> DataFrame:
    seen = VectorAssembler(inputCols=features, outputCol="_x", handleInvalid="keep").transform(rows)
    return tree.transform(seen).withColumn("_margin", F.col("_margin") + rate * F.col("_tree")).drop("_x", "_tree")


def fit_boosted(train: DataFrame, held: DataFrame, features: list[str], key: str, rounds: int = 500, depth: int = 8, rate: float = 0.05, rows_share: float = 0.8, columns_share: float = 0.8, patience: int = 50, seed: int = 42) -> Boosted:
    """Boosted trees on `train` (label 0 or 1, `key` a whole number), stopped by `held`. Leaves take a Newton step of their rows' gradients.

    A training set with one class gives no trees, and held-out rows with one class cannot tell a best round: then all rounds are kept.
    """
    counted = train.agg(F.count("*").alias("n"), F.sum("label").alias("p")).first()
    n, p = counted["n"], counted["p"] or 0
    model = Boosted(math.log(p / (n - p)) if 0 < p < n else 0.0, rate)
    if not 0 < p < n:
        return model
    chance = random.Random(seed)
    y = F.col("label").cast("double")
    now, later = (rows.select(key, "label", *(F.col(f).cast("double").alias(f) for f in features)).withColumn("_margin", F.lit(model.start)) for rows in (train, held))
    now, later = cut(now), cut(later)
    top = -1.0
    for k in range(rounds):
        some = sorted(chance.sample(features, max(1, round(columns_share * len(features)))), key=features.index)
        q = _sigmoid(F.col("_margin"))
        # a tree fitted to gradient / curvature with the curvature as weight has Newton steps as its leaves' means
        curve = F.greatest(q * (1 - q), F.lit(1e-6))
        drawn = now.where(draw(seed + k, key) < rows_share).withColumn("_w", curve).withColumn("_g", (y - q) / curve)
        seen = VectorAssembler(inputCols=some, outputCol="_x", handleInvalid="keep").transform(drawn)
        tree = DecisionTreeRegressor(featuresCol="_x", labelCol="_g", weightCol="_w", predictionCol="_tree", maxDepth=depth, seed=seed).fit(seen)
        model.trees.append((tree, some))
        now, later = _grown(now, tree, some, rate), _grown(later, tree, some, rate)
        if (k + 1) % EVERY == 0:
            now, later = cut(now), cut(later)
        ap = average_precision(later.select("label", F.col("_margin").alias("score"))).first()["ap"]
        model.history.append(ap if ap is not None else math.nan)
        if ap is None or ap > top:
            top, model.best = ap if ap is not None else top, k
        elif k - model.best >= patience:
            break
    return model
