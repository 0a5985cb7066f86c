"""Exploration intensity, negatives and training sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .focal import box_mean_reflect
from .validation import _scalars


#: A prime that keeps the products below within 64 bits, and the factor of the draws.
PRIME, FACTOR = 2147483647, 48271


def draw(seed: int, *key: Column | str) -> Column:
    """A number in (0, 1) from whole numbers: the same in every run, on every partitioning and in any engine.

    Each number goes through a product and a square modulo a prime, so neighbouring keys are not on a line.
    """
    h = F.lit(seed).cast("long")
    for k in key:
        k = F.col(k) if isinstance(k, str) else k
        h = F.pmod(h * FACTOR + k.cast("long"), F.lit(PRIME))
        h = F.pmod(h * h + 12345, F.lit(PRIME))
    return (h + 0.5) / float(PRIME)


def exploration_intensity(cells: DataFrame, width: int, height: int, radius: int, road: str | None = None) -> DataFrame:
    """row, col, intensity: box mean of deposit counts `n`, 0 to 1, averaged with 1 - road distance / its maximum (A1-A3).

    Where all distances are 0, all are near; a cell without a distance keeps the mean of deposits alone.
    """
    mean = box_mean_reflect(cells.withColumn("z", F.coalesce("n", F.lit(0)).cast("double")), width, height, radius, name="m")
    s = _scalars(mean.select("row", "col", "m"), F.min("m").alias("lo"), F.max("m").alias("hi"))
    out = s.select("row", "col", F.when(F.col("hi") > F.col("lo"), (F.col("m") - F.col("lo")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0))).otherwise(1.0).alias("intensity"))
    if road:
        r = _scalars(cells.select("row", "col", road), F.max(road).alias("far"))
        near = r.select("row", "col", F.when(F.col(road).isNotNull(), 1 - F.coalesce(F.try_divide(F.col(road), F.col("far")), F.lit(0.0))).alias("near"))
        out = out.join(near, ["row", "col"]).select("row", "col", F.coalesce((F.col("intensity") + F.col("near")) / 2, F.col("intensity")).alias("intensity"))
    return out


def weighted_sample(cells: DataFrame, n: int, weight: str = "intensity", least: float = 0.2, seed: int = 42, key: tuple[str, ...] = ("row", "col")) -> DataFrame:
    """`n` cells without replacement, by weight (T8): the n smallest of -log(u) / weight. All cells where none reaches `least`."""
    ok = cells.where(F.col(weight) >= least)
    pool = cells.withColumn(weight, F.lit(1.0)) if ok.isEmpty() else ok
    return pool.orderBy(-F.log(draw(seed, *key)) / F.col(weight), *key).limit(n)


def random_points(spark, ring: list[tuple[float, float]], n: int, seed: int = 42, tries: int = 50) -> DataFrame:
    """`n` points in a polygon by rejection from its bounding box, at most `tries` x n draws."""
    from ..functions.geometry import in_polygon

    xs, ys = [p[0] for p in ring], [p[1] for p in ring]
    d = spark.range(tries * n).withColumn("x", min(xs) + draw(seed, "id") * (max(xs) - min(xs))).withColumn("y", min(ys) + draw(seed + 1, "id") * (max(ys) - min(ys)))
    return d.where(in_polygon(F.col("x"), F.col("y"), ring)).orderBy("id").limit(n)


#: Fixed value: the buffer that is tried when the deposits' buffers leave no cell.
SMALL_BUFFER = 1000.0


def negatives(cells: DataFrame, deposits: DataFrame, buffer: float, ratio: int, seed: int = 42) -> DataFrame:
    """Negative cells (row, col, x, y, intensity) outside the deposits' buffers, `ratio` for each deposit.

    With a column `intensity` cells are drawn by it, else alike. Where the buffers leave no cell, they shrink to `SMALL_BUFFER`.
    """
    from .proximity import exclude_near

    weighted = cells if "intensity" in cells.columns else cells.withColumn("intensity", F.lit(1.0))
    keyed = weighted.withColumn("_k", F.struct("row", "col"))
    at = deposits.select(F.col("x").alias("rx"), F.col("y").alias("ry"))
    free = exclude_near(keyed, at, buffer, "_k")
    if buffer > SMALL_BUFFER and free.isEmpty():
        free = exclude_near(keyed, at, SMALL_BUFFER, "_k")
    return weighted_sample(free.drop("_k"), ratio * deposits.count(), seed=seed)


def background_sample(cells: DataFrame, n: int = 2000, value: str = "z", key: tuple[str, ...] = ("row", "col")) -> DataFrame:
    """At most `n` cells whose value is there, not 0 and under 100 in size, in a hash order of the place."""
    ok = cells.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")) & (F.col(value) != 0) & (F.abs(value) < 100))
    order = F.pmod(sum((F.col(k).cast("long") * m for k, m in zip(key, (7919, 104729), strict=False)), F.lit(0)), F.lit(1000003))
    return ok.orderBy(order, *key).limit(n)


def training_rows(positives: DataFrame, negative: DataFrame) -> DataFrame:
    """Both with `label`, and a sample id to carry through joins instead of coordinates."""
    both = positives.select("x", "y", F.lit(1).alias("label")).unionByName(negative.select("x", "y", F.lit(0).alias("label")))
    return both.withColumn("sample_id", F.xxhash64("x", "y", "label"))


def training_set(positives: DataFrame, negative: DataFrame, cells: DataFrame, features: list[str], x0: float, y0: float, cell: float) -> DataFrame:
    """x, y, label and the features of all samples, without those that lack one.

    Labels stay with their sample: joining them back by coordinates would multiply repeated points.
    """
    from .proximity import sample_cells

    return sample_cells(training_rows(positives, negative), cells, features, x0, y0, cell).select("x", "y", "label", *features)


def label_fanout(samples: DataFrame, labels: DataFrame) -> DataFrame:
    """Labels joined back by equal coordinates: n x m rows for repeated ones (J4); kept for comparison with `training_rows`."""
    return samples.join(labels, ["x", "y"], "left")


def bootstrap_rows(rows: DataFrame, replicates: int, key: str, seed: int = 0) -> DataFrame:
    """Poisson(1) resamples: `replicate` and `copies` for each row drawn."""
    import math

    fan = rows.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1)))).withColumn("_u", draw(seed, key, "replicate"))
    steps, total = [], 0.0
    for k in range(8):
        total += math.exp(-1) / math.factorial(k)
        steps.append(F.col("_u") > total)
    copies = sum((s.cast("int") for s in steps), F.lit(0))
    return fan.withColumn("copies", copies).drop("_u").where("copies > 0")
