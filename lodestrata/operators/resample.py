"""Grid transforms: stack, mosaic, resample, clip, tiling."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quantiles import exact_quantiles


def stack(layers: dict[str, DataFrame], how: str = "full_outer") -> DataFrame:
    """Layers (row, col, z) side by side, columns by sorted name (J1; J2 with how="inner"): one shuffle on (row, col).

    The outer stack aggregates a union instead of joining layer by layer, so a cell is moved once whatever the number of layers.
    """
    names = sorted(layers)
    tall = reduce(DataFrame.unionByName, (layers[n].select("row", "col", F.lit(n).alias("layer"), F.col("z").cast("double").alias("z")) for n in names))
    out = tall.groupBy("row", "col").agg(*(F.max(F.when(F.col("layer") == n, F.col("z"))).alias(n) for n in names), *(F.max(F.when(F.col("layer") == n, 1)).alias(f"_{n}") for n in names))
    if how == "inner":
        out = out.where(reduce(lambda a, b: a & b, (F.col(f"_{n}").isNotNull() for n in names)))
    return out.drop(*(f"_{n}" for n in names))


def mosaic(tiles: DataFrame) -> DataFrame:
    """row, col, z of the first tile (smallest `ord`) that has a value there."""
    return tiles.where("z is not null").groupBy("row", "col").agg(F.min_by("z", "ord").alias("z"))


def bilinear(grid: DataFrame, target: DataFrame, x: Column, y: Column) -> DataFrame:
    """Values at fractional places of `target` rows (source column x, source row y, of cell centres): mean of the four cells around,
    by distance, over those that have a value (G1, G2)."""
    t = target.withColumn("_x", x).withColumn("_y", y)
    t = t.withColumn("_c", F.floor("_x").cast("int")).withColumn("_r", F.floor("_y").cast("int"))
    t = t.withColumn("_fx", F.col("_x") - F.col("_c")).withColumn("_fy", F.col("_y") - F.col("_r"))
    t = t.withColumn("_k", F.explode(F.expr("sequence(0, 3)")))
    right, low = F.col("_k") % 2, F.floor(F.col("_k") / 2)
    weight = F.when(right == 1, F.col("_fx")).otherwise(1 - F.col("_fx")) * F.when(low == 1, F.col("_fy")).otherwise(1 - F.col("_fy"))
    t = t.select(*target.columns, (F.col("_r") + low).cast("int").alias("sr"), (F.col("_c") + right).cast("int").alias("sc"), weight.alias("w"))
    source = grid.where("z is not null").select(F.col("row").alias("sr"), F.col("col").alias("sc"), "z")
    joined = t.where("w > 0").join(source, ["sr", "sc"], "left")
    total = F.sum(F.when(F.col("z").isNotNull(), F.col("w")))
    return joined.groupBy(*target.columns).agg((F.sum(F.col("w") * F.col("z")) / F.nullif(total, F.lit(0.0))).alias("z"))


def resample(grid: DataFrame, width: int, height: int, cell: float, to: float) -> DataFrame:
    """The grid at another cell size: max(1, int(extent / to)) cells a side, bilinear."""
    w, h = max(1, int(width * cell / to)), max(1, int(height * cell / to))
    spark = grid.sparkSession
    target = spark.range(w * h).select(F.floor(F.col("id") / w).cast("int").alias("row"), (F.col("id") % w).cast("int").alias("col"))
    sx, sy = width * cell / w / cell, height * cell / h / cell
    return bilinear(grid, target, (F.col("col") + 0.5) * sx - 0.5, (F.col("row") + 0.5) * sy - 0.5)


def clip(grid: DataFrame, ring: list[tuple[float, float]], x0: float, y0: float, cell: float) -> DataFrame:
    """Cells whose centre lies in the ring, moved to the ring's bounding box."""
    from ..functions.geometry import cell_of, centre_of, in_polygon

    xs, ys = [p[0] for p in ring], [p[1] for p in ring]
    top, left = cell_of(F.lit(min(xs)), F.lit(max(ys)), x0, y0, cell)
    low, right = cell_of(F.lit(max(xs)), F.lit(min(ys)), x0, y0, cell)
    x, y = centre_of(F.col("row"), F.col("col"), x0, y0, cell)
    kept = grid.where(F.col("row").between(top, low) & F.col("col").between(left, right) & in_polygon(x, y, ring))
    return kept.withColumn("row", F.col("row") - top).withColumn("col", F.col("col") - left)


def chips(grid: DataFrame, width: int, height: int, size: int, stride: int) -> DataFrame:
    """Cells with the offsets (row_off, col_off) of every full window that holds them: a hopping window in space."""

    def offsets(at: str, n: int) -> Column:
        first = F.greatest(F.lit(0), F.ceil((F.col(at) - size + 1) / stride)).cast("int")
        last = F.least(F.floor(F.col(at) / stride), F.lit((n - size) // stride)).cast("int")
        return F.explode(F.when(first <= last, F.transform(F.sequence(first, F.greatest(first, last)), lambda k: k * stride)))

    if width < size or height < size:
        return grid.withColumn("row_off", F.lit(0)).withColumn("col_off", F.lit(0)).limit(0)
    return grid.withColumn("row_off", offsets("row", height)).withColumn("col_off", offsets("col", width))


def valid_fraction(chipped: DataFrame, bands: list[str], least: float) -> DataFrame:
    """Chips whose share of band values over 0 is `least` or more."""
    share = sum((F.avg(F.when(F.col(b) > 0, 1.0).otherwise(0.0)) for b in bands), F.lit(0.0)) / len(bands)
    return chipped.groupBy("row_off", "col_off").agg(share.alias("valid"), F.count("*").alias("cells")).where(F.col("valid") >= least)


def centred_chips(centres: DataFrame, width: int, height: int, size: int) -> DataFrame:
    """Chips centred on points (row, col) that lie fully inside, each in four rotations."""
    half = size // 2
    out = centres.withColumn("row_off", F.col("row") - half).withColumn("col_off", F.col("col") - half)
    out = out.where(F.col("row_off").between(0, height - size) & F.col("col_off").between(0, width - size))
    return out.withColumn("rotation", F.explode(F.array(*(F.lit(a) for a in (0, 90, 180, 270)))))


def random_chips(tiles: DataFrame, centres: DataFrame, size: int, apart: float, n: int = 50, attempts: int = 500, seed: int = 42) -> DataFrame:
    """Up to `n` chips a tile (tile: a number, width, height) whose middle is `apart` cells or more from every centre (tile, row, col)."""
    from .sampling import draw

    tried = tiles.where((F.col("width") >= size) & (F.col("height") >= size)).withColumn("attempt", F.explode(F.sequence(F.lit(0), F.lit(attempts - 1))))
    tried = tried.withColumn("row_off", F.floor(draw(seed, F.lit(1), "tile", "attempt") * (F.col("height") - size + 1)).cast("int"))
    tried = tried.withColumn("col_off", F.floor(draw(seed, F.lit(2), "tile", "attempt") * (F.col("width") - size + 1)).cast("int"))
    at = centres.select("tile", F.col("row").alias("cr"), F.col("col").alias("cc"))
    near = tried.join(at, "tile").where(F.hypot(F.col("row_off") + size // 2 - F.col("cr"), F.col("col_off") + size // 2 - F.col("cc")) < apart)
    free = tried.join(near.select("tile", "attempt").distinct(), ["tile", "attempt"], "left_anti")
    return free.selectExpr("tile", "row_off", "col_off", "attempt", "row_number() over (partition by tile order by attempt) as k").where(F.col("k") <= n).drop("k")


def reproject(grid: DataFrame, width: int, height: int, target: tuple[float, float, float], source: tuple[float, float, float], back) -> DataFrame:
    """The grid in another coordinate system, bilinear (G1): row, col, z of a target of `width` x `height` cells.

    `target` and `source` are (left, top, cell) of both grids; `back` maps columns x, y of the target's system to those of the source's.
    Cells that fall outside the source have no row with a value.
    """
    (tx, ty, tc), (sx, sy, sc) = target, source
    cells = grid.sparkSession.range(width * height).select(F.floor(F.col("id") / width).cast("int").alias("row"), (F.col("id") % width).cast("int").alias("col"))
    x, y = back(tx + (F.col("col") + 0.5) * tc, ty - (F.col("row") + 0.5) * tc)
    return bilinear(grid, cells, (x - sx) / sc - 0.5, (sy - y) / sc - 0.5)


def scene_bands(bands: dict[str, DataFrame], ring: list[tuple[float, float]], x0: float, y0: float, cell: float, scale: float = 10_000.0) -> DataFrame:
    """Bands of a scene on one grid, clipped to the ring, as reflectance, side by side by name (G13, S22, M16); missing bands are left out."""
    return stack({name: clip(b, ring, x0, y0, cell).withColumn("z", F.col("z") / scale) for name, b in bands.items()})


def band_subset(stacked: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """row, col and the bands that are kept, in that order."""
    return stacked.select("row", "col", *keep)


def composite(stacked: DataFrame, bands: tuple[str, str, str], low: float = 0.02, high: float = 0.98, gamma: float = 1.0) -> DataFrame:
    """row, col, red, green, blue: a composite's channels 0 to 1, stretched between percentiles of each band."""
    from ..functions.mapalgebra import stretch

    cuts = exact_quantiles(stacked, {b: b for b in bands}, [low, high])
    return stacked.select("row", "col", *(stretch(F.col(b), *(F.lit(v).cast("double") for v in cuts[b]), gamma).alias(c) for b, c in zip(bands, ("red", "green", "blue"), strict=True)))


def mosaic_reproject_clip(tiles: DataFrame, cell: float, ring: list[tuple[float, float]], to: float, forth, back) -> tuple[DataFrame, float, float]:
    """(row, col, z within the ring; left; top) of tiles in another coordinate system.

    `tiles` has ord, left, top, row, col, z: each tile's corner, and its cells of size `cell`; the first tile with a value holds where they overlap.
    The target covers the ring's bounding box with cells of size `to`. `forth` and `back` map columns x, y between both systems.
    """
    from ..functions.geometry import centre_of, in_polygon

    spark = tiles.sparkSession
    x, y = forth(F.col("x"), F.col("y"))
    corners = [tuple(r) for r in spark.createDataFrame(ring, "x double, y double").select(x, y).collect()]  # the ring's
    left, right, low, top = (f(c[i] for c in corners) for i, f in ((0, min), (0, max), (1, min), (1, max)))
    bounds = tiles.agg(F.min("left").alias("left"), F.max("top").alias("top")).first()
    if bounds["left"] is None:
        return tiles.select("row", "col", "z").limit(0), left, top
    placed = tiles.withColumn("row", F.col("row") + F.round((F.lit(bounds["top"]) - F.col("top")) / cell).cast("int")).withColumn("col", F.col("col") + F.round((F.col("left") - F.lit(bounds["left"])) / cell).cast("int"))
    width, height = max(1, math.ceil((right - left) / to)), max(1, math.ceil((top - low) / to))
    whole = reproject(mosaic(placed), width, height, (left, top, to), (bounds["left"], bounds["top"], cell), back)
    cx, cy = centre_of(F.col("row"), F.col("col"), left, top, to)
    return whole.where(in_polygon(cx, cy, corners)), left, top


def to_grid(band: DataFrame, scale: int, width: int, height: int) -> DataFrame:
    """row, col, z of a band whose cells are `scale` times as wide, on the fine grid of `width` x `height` cells, bilinear."""
    if scale == 1:
        return band.select("row", "col", "z")
    target = band.sparkSession.range(width * height).select(F.floor(F.col("id") / width).cast("int").alias("row"), (F.col("id") % width).cast("int").alias("col"))
    return bilinear(band, target, (F.col("col") + 0.5) / scale - 0.5, (F.col("row") + 0.5) / scale - 0.5)


def preprocess_scene(bands: dict[str, tuple[DataFrame, float, float, float]], ring: list[tuple[float, float]], to: float, forth, back, scale: float = 10_000.0) -> DataFrame:
    """row, col and a column of reflectance for each band of a scene, in another coordinate system and within the ring.

    `bands` maps names to (row, col, z; left; top; cell): bands may have cells of different sizes, since each is brought to the target's
    alone. Bands that are None are left out, and keep no place: columns are told by name.
    """
    layers = {}
    for name, band in bands.items():
        if band is None:
            continue
        grid, left, top, cell = band
        tile = grid.select(F.lit(0).alias("ord"), F.lit(float(left)).alias("left"), F.lit(float(top)).alias("top"), "row", "col", "z")
        layers[name] = mosaic_reproject_clip(tile, cell, ring, to, forth, back)[0].withColumn("z", F.col("z") / scale)
    return stack(layers)
