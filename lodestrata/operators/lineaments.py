"""Lineaments: edges of hillshades voted into lines.

The Hough accumulator is an explode over angles and a count by (angle, distance); a line's cells are then cut into runs at gaps.
The order of votes plays no part, so the result is the same in every run (a probabilistic variant's is not).
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.mapalgebra import azimuth
from .focal import gaussian, hysteresis, sobel, with_maximum, with_neighbours
from .quantiles import exact_quantiles
from .shared import cut


def edges(grid: DataFrame, width: int, height: int, sigma: float = 1.5, low: float = 0.05, high: float = 0.15) -> DataFrame:
    """row, col, edge: smoothed, Sobel magnitude over its maximum, hysteresis."""
    smooth = gaussian(grid, width, height, sigma).select("row", "col", F.col("smooth").alias("z"))
    m = with_neighbours(smooth).select("row", "col", sobel().alias("raw"))
    m = with_maximum(m, "raw", "top").select("row", "col", F.coalesce(F.try_divide("raw", "top"), F.lit(0.0)).alias("m"))
    return hysteresis(m, low, high).select("row", "col", "edge")


def hough_lines(cells: DataFrame, angles: int = 180, votes: int = 50, least: float = 10.0, gap: float = 3.0) -> DataFrame:
    """angle, rho, r0, c0, r1, c1, n: runs of edge cells along lines with `votes` or more, of a length of `least` cells or more.

    Runs along a line are islands of cells at most `gap` apart. A cell votes `angles` times, on purpose and bounded.
    """
    fan = cells.withColumn("angle", F.explode(F.sequence(F.lit(0), F.lit(angles - 1)))).withColumn("t", F.col("angle") * (math.pi / angles))
    fan = fan.withColumn("rho", F.round(F.col("col") * F.cos("t") + F.col("row") * F.sin("t")).cast("int"))
    fan = fan.withColumn("along", F.col("row") * F.cos("t") - F.col("col") * F.sin("t"))
    strong = fan.groupBy("angle", "rho").agg(F.count("*").alias("v")).where(F.col("v") >= votes)
    on = fan.join(strong, ["angle", "rho"])
    w = Window.partitionBy("angle", "rho").orderBy("along", "row", "col")
    on = on.withColumn("new", F.coalesce((F.col("along") - F.lag("along").over(w) > gap).cast("int"), F.lit(1)))
    on = on.withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    ends = on.groupBy("angle", "rho", "run").agg(F.min(F.struct("along", "row", "col")).alias("a"), F.max(F.struct("along", "row", "col")).alias("b"), F.count("*").alias("n"))
    ends = ends.where(F.col("b.along") - F.col("a.along") >= least)
    return ends.select("angle", "rho", F.col("a.row").alias("r0"), F.col("a.col").alias("c0"), F.col("b.row").alias("r1"), F.col("b.col").alias("c1"), "n")


def lineaments(shades: DataFrame, width: int, height: int, x0: float, y0: float, cell: float, shared: int = 2, votes: int = 50, least_m: float = 500.0, gap_m: float = 100.0) -> DataFrame:
    """azimuth, length_m, ax, ay, bx, by from shades (row, col, azimuth, z): cells that are edges under `shared` or more lights."""
    from functools import reduce

    lights = [r["azimuth"] for r in shades.select("azimuth").distinct().orderBy("azimuth").collect()]  # a handful of lights
    each = [edges(shades.where(F.col("azimuth") == a).select("row", "col", "z"), width, height).where("edge = 1") for a in lights]
    cells = reduce(DataFrame.unionByName, each).groupBy("row", "col").agg(F.count("*").alias("n")).where(F.col("n") >= shared)
    lines = hough_lines(cells.select("row", "col"), votes=votes, least=least_m / cell, gap=gap_m / cell)
    x, y = (lambda c: x0 + (F.col(c) + 0.5) * cell), (lambda r: y0 - (F.col(r) + 0.5) * cell)
    out = lines.select(x("c0").alias("ax"), y("r0").alias("ay"), x("c1").alias("bx"), y("r1").alias("by"))
    dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    return out.withColumn("azimuth", azimuth(dx, dy)).withColumn("length_m", F.hypot(dx, dy)).where(F.col("length_m") >= least_m)


def percentile_edges(shade: DataFrame, width: int, height: int, share: float = 0.85, every: int = 4, sigma: float = 2.0) -> DataFrame:
    """row, col of strong edges of one shade, in cells `every` times as wide (C20).

    The shade as bytes between its extremes, smoothed; its Sobel magnitude over a percentile of those that are over 0; every few rows and
    columns.
    """
    low, high = shade.agg(F.min("z"), F.max("z")).first()
    span = (high - low if low is not None else 0.0) + 1e-10
    level = F.floor(F.coalesce((F.col("z") - F.lit(low)) / span, F.lit(0.0)) * 255).cast("double")
    smooth = gaussian(shade.select("row", "col", level.alias("z")), width, height, sigma).select("row", "col", F.col("smooth").alias("z"))
    size = cut(with_neighbours(smooth).select("row", "col", sobel().alias("m")))
    limit = exact_quantiles(size.where("m > 0"), {"m": "m"}, [share])["m"][0]
    if limit is None:
        return size.select("row", "col").limit(0)
    strong = size.where((F.col("m") > limit) & (F.col("row") % every == 0) & (F.col("col") % every == 0))
    return strong.select((F.col("row") / every).cast("int").alias("row"), (F.col("col") / every).cast("int").alias("col"))


def script_lineaments(shade: DataFrame, width: int, height: int, x0: float, y0: float, cell: float, share: float = 0.85, every: int = 4, votes: int = 30, least: float = 50.0, gap: float = 10.0, least_m: float = 500.0) -> DataFrame:
    """azimuth (0 to 180), length_m, ax, ay, bx, by of lines through the strong edges of one shade, longer than `least_m` (C20)."""
    lines = hough_lines(percentile_edges(shade, width, height, share, every), votes=votes, least=least, gap=gap)
    x, y = (lambda c: x0 + F.col(c) * every * cell), (lambda r: y0 - F.col(r) * every * cell)
    out = lines.select(x("c0").alias("ax"), y("r0").alias("ay"), x("c1").alias("bx"), y("r1").alias("by"))
    dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    return out.withColumn("azimuth", F.pmod(F.degrees(F.atan2(dx, dy)), F.lit(180.0))).withColumn("length_m", F.hypot(dx, dy)).where(F.col("length_m") > least_m)
