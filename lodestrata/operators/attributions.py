"""Tree attributions: exact Shapley values of forests and boosted trees, by the covers of their paths.

The fitted ensemble's node table becomes one row a leaf: the leaf's value, and for each feature on its path the interval that leads
there and the share of the training cover that stays on the path when the feature is not known. A leaf is then a game of its own:
a feature brings 1 or 0 where the row's value is known, its share where it is not. The Shapley weights of all coalitions come
from the coefficients of one product of linear factors, from which each feature's factor is divided out; rows are
handled as vectors, leaf by leaf, in Arrow batches. The model goes to the tasks once, as a broadcast variable: its size is bounded by trees
and leaves, not by rows.

Attributions of a forest sum to its probability of class 1 less the base value, those of boosted trees to their margin. A missing value
goes where the model sends it, to the right. Categorical splits raise.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassificationModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import scratch, ship

#: Features that tell where people have looked, not what lies there.
BIAS_FEATURES = ("distance_to_road", "deposit_density_50km")
#: Rows that are handled as one vector.
ROWS = 4096


@dataclass
class Leaf:
    """value: times the tree's weight; features: each one once, in its interval (low, high] with its share of the cover."""

    value: float
    features: np.ndarray
    low: np.ndarray
    high: np.ndarray
    share: np.ndarray


def node_table(model: PipelineModel) -> DataFrame:
    """tree, id, left, right, feature, threshold, cover, value, weight: the nodes of a fitted forest or boosted ensemble."""
    ensemble = model.stages[-1]
    spark = SparkSession.getActiveSession()
    path = scratch(spark, "models")
    ensemble.write().save(path)
    n = F.col("nodeData")
    nodes = spark.read.parquet(f"{path}/data").withColumn("split", n["split"]).withColumn("stats", n["impurityStats"])
    if nodes.where("split.numCategories > 0").limit(1).count():
        raise ValueError("categorical splits have no intervals")
    total = F.aggregate("stats", F.lit(0.0), lambda a, b: a + b)
    if isinstance(ensemble, RandomForestClassificationModel):  # trees vote by their classes' shares
        cover, value, weights = total, F.try_divide(F.col("stats")[1], total), [1 / len(ensemble.trees)] * len(ensemble.trees)
    else:
        cover, value, weights = F.col("stats")[0], n["prediction"], ensemble.treeWeights
    of_tree = F.broadcast(spark.createDataFrame(list(enumerate(map(float, weights))), "treeID int, weight double"))
    return nodes.join(of_tree, "treeID").select(
        F.col("treeID").alias("tree"), n["id"].alias("id"), n["leftChild"].alias("left"), n["rightChild"].alias("right"), F.col("split.featureIndex").alias("feature"),
        F.get("split.leftCategoriesOrThreshold", F.lit(0)).alias("threshold"), cover.alias("cover"), value.alias("value"), "weight",
    )


def leaves(nodes: list) -> list[Leaf]:
    """The paths of an ensemble's nodes (rows of `node_table`)."""
    by_tree: dict[int, dict[int, object]] = {}
    for n in nodes:
        by_tree.setdefault(n["tree"], {})[n["id"]] = n
    out = []
    for tree in by_tree.values():
        stack = [(0, {})]
        while stack:
            at, path = stack.pop()
            n = tree[at]
            if n["left"] < 0:
                held = sorted(path.items())
                out.append(Leaf(n["value"] * n["weight"], *(np.array(x) for x in ([f for f, _ in held], [v[0] for _, v in held], [v[1] for _, v in held], [v[2] for _, v in held]))))
                continue
            low, high, share = path.get(n["feature"], (-math.inf, math.inf, 1.0))
            for child, interval in ((n["left"], (low, min(high, n["threshold"]))), (n["right"], (max(low, n["threshold"]), high))):
                stack.append((child, path | {n["feature"]: (*interval, share * tree[child]["cover"] / n["cover"])}))
    return out


def base_value(paths: list[Leaf]) -> float:
    """The expectation by the cover."""
    return sum(p.value * float(np.prod(p.share)) for p in paths)


def attribute(paths: list[Leaf], x: np.ndarray) -> np.ndarray:
    """Attributions [rows, features] of `x` [rows, features]."""
    out = np.zeros(x.shape)
    for p in paths:
        d = len(p.features)
        if not d:
            continue
        v = x[:, p.features]
        after = ~(v <= p.low) | np.isneginf(p.low)  # a missing value goes to the right
        on = (after & ((v <= p.high) | np.isposinf(p.high))).astype(np.float64)
        full = np.zeros((len(x), d + 1))
        full[:, 0] = 1.0
        for j in range(d):
            full[:, 1 : j + 2] = full[:, 1 : j + 2] * p.share[j] + full[:, : j + 1] * on[:, j : j + 1]
            full[:, 0] *= p.share[j]
        weight = np.array([math.factorial(k) * math.factorial(d - 1 - k) / math.factorial(d) for k in range(d)])
        for j in range(d):
            z, known = p.share[j], on[:, j] > 0
            # the product without factor j: divided by (z + t) from the highest power down, or by z
            rest = full[:, :d] / z
            down = np.zeros(len(x))
            total = np.zeros(len(x))
            for k in range(d - 1, -1, -1):
                down = full[:, k + 1] - z * down
                total += weight[k] * np.where(known, down, rest[:, k])
            out[:, p.features[j]] += p.value * (on[:, j] - z) * total
    return out


def attributions(model: PipelineModel, rows: DataFrame, features: list[str], keys: list[str]) -> DataFrame:
    """`keys`, base and a column of attributions for each feature, named as it is. Rows with a missing feature are attributed too."""
    return attribute_rows(leaves(node_table(model).collect()), rows, features, keys)  # as large as the model


def attribute_rows(paths: list[Leaf], rows: DataFrame, features: list[str], keys: list[str]) -> DataFrame:
    """As `attributions`, by the paths of any trees over `features`."""
    spark = rows.sparkSession
    ship(spark)
    sent, base = spark.sparkContext.broadcast(paths), base_value(paths)
    kept = rows.select(*keys, *(F.col(f).cast("double").alias(f) for f in features))

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for i in range(0, len(batch), ROWS):
                part = batch.iloc[i : i + ROWS]
                found = pd.DataFrame(attribute(sent.value, part[features].to_numpy(np.float64)), columns=features, index=part.index)
                yield pd.concat([part[keys], pd.Series(base, index=part.index, name="base"), found], axis=1)

    shape = ", ".join([*(f"`{k}` {kept.schema[k].dataType.simpleString()}" for k in keys), "base double", *(f"`{f}` double" for f in features)])
    return kept.mapInPandas(task, shape)


def mean_attribution(found: DataFrame, features: list[str]) -> DataFrame:
    """name, importance: mean size of each feature's attributions; one aggregate row, turned."""
    one = found.agg(*(F.avg(F.abs(f)).alias(f) for f in features))
    return one.select(F.explode(F.array(*(F.struct(F.lit(f).alias("name"), F.col(f).alias("importance")) for f in features))).alias("x")).select("x.name", "x.importance")


def exploration_bias(importances: DataFrame, marks: tuple[str, ...] = BIAS_FEATURES) -> DataFrame:
    """biased, features: whether features that tell of exploration are among the five most important, and which (C14)."""
    top = importances.orderBy(F.desc("importance"), "name").limit(5)
    held = F.sort_array(F.collect_list(F.when(F.col("name").isin(*marks), F.col("name"))))
    return top.agg(held.alias("features")).select((F.size("features") > 0).alias("biased"), "features")
