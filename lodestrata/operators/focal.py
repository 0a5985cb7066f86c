"""Focal operators over a grid (row, col, z): neighbours by frames within blocks, kernels by frames.

Neighbours need one shuffle: cells are dealt by blocks of `BLOCK` x `BLOCK` cells with a halo of one cell, sorted once by their place in the
block, and each neighbour is a range frame of that order, which an absent cell leaves empty. A block is one task's share whatever
the raster's size. Box and Gaussian kernels are separable frames along rows and columns.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F



def along_row():
    return Window.partitionBy("row").orderBy("col")


def along_col():
    return Window.partitionBy("col").orderBy("row")


#: Order of the eight neighbours.
NEIGHBOURS = ("nw", "n", "ne", "w", "e", "sw", "s", "se")


#: Side of a block in cells.
BLOCK = 256
#: Rows and columns from a cell to each neighbour.
STEPS = {"nw": (-1, -1), "n": (-1, 0), "ne": (-1, 1), "w": (0, -1), "e": (0, 1), "sw": (1, -1), "s": (1, 0), "se": (1, 1)}


def with_halo(grid: DataFrame) -> DataFrame:
    """The grid with the block (_br, _bc) of each cell; cells at a block's edge come again for the blocks beside it."""
    homes = []
    for at in (F.col("row").cast("long"), F.col("col").cast("long")):
        place, home = F.pmod(at, F.lit(BLOCK)), F.floor(at / BLOCK)
        homes.append(F.when(place == 0, F.array(home, home - 1)).when(place == BLOCK - 1, F.array(home, home + 1)).otherwise(F.array(home)))
    return grid.withColumn("_br", F.explode(homes[0])).withColumn("_bc", F.explode(homes[1]))


def beside(grid: DataFrame, wanted: dict[str, tuple[int, int, Column | str]]) -> DataFrame:
    """Adds columns: for each name the value of the cell so many rows and columns (-1, 0 or 1) away; NULL where that cell is absent."""
    row, col = F.col("row").cast("long"), F.col("col").cast("long")
    dealt = with_halo(grid).withColumn("_at", (row - F.col("_br") * BLOCK + 1) * (BLOCK + 2) + col - F.col("_bc") * BLOCK + 1)
    order = Window.partitionBy("_br", "_bc").orderBy("_at")
    frame = lambda dr, dc: order.rangeBetween(dr * (BLOCK + 2) + dc, dr * (BLOCK + 2) + dc)
    dealt = dealt.withColumns({name: F.first(value).over(frame(dr, dc)) for name, (dr, dc, value) in wanted.items()})
    own = (F.col("_br") == F.floor(row / BLOCK)) & (F.col("_bc") == F.floor(col / BLOCK))
    return dealt.where(own).select(*grid.columns, *wanted)


def with_neighbours(grid: DataFrame, value: str = "z") -> DataFrame:
    """Adds nw n ne w e sw s se; NULL outside the grid and for cells that are absent or NULL."""
    return beside(grid, {name: (*step, value) for name, step in STEPS.items()})


def horn(dx: float, dy: float, value: str = "z") -> tuple[Column, Column]:
    """dz/dx and dz/dy (rows grow to the south) of the 3 x 3 window; NULL at edges and beside nodata."""
    c = {k: F.col(k) for k in NEIGHBOURS}
    here = F.col(value).isNotNull()
    gx = ((c["ne"] + 2 * c["e"] + c["se"]) - (c["nw"] + 2 * c["w"] + c["sw"])) / (8.0 * dx)
    gy = ((c["sw"] + 2 * c["s"] + c["se"]) - (c["nw"] + 2 * c["n"] + c["ne"])) / (8.0 * dy)
    both = here & gx.isNotNull() & gy.isNotNull()
    return F.when(both, gx), F.when(both, gy)


def gradient(grid: DataFrame, dx: float, dy: float) -> DataFrame:
    gx, gy = horn(dx, dy)
    return with_neighbours(grid).withColumn("gx", gx).withColumn("gy", gy)


def slope() -> Column:
    return F.degrees(F.atan(F.sqrt(F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy"))))  # W2


def aspect() -> Column:
    """Up-slope bearing; -1 where flat."""
    bearing = F.pmod(90.0 - F.degrees(F.atan2(-F.col("gy"), F.col("gx"))), F.lit(360.0))
    return F.when((F.col("gx") == 0) & (F.col("gy") == 0), -1.0).when(F.col("gx").isNotNull(), bearing)


def curvature(dx: float, dy: float) -> tuple[Column, Column]:
    """Plan and profile curvature; NULL where flat."""
    z, gx, gy = F.col("z"), F.col("gx"), F.col("gy")
    xx = (F.col("e") - 2.0 * z + F.col("w")) / (dx * dx)
    yy = (F.col("s") - 2.0 * z + F.col("n")) / (dy * dy)
    xy = ((F.col("ne") - F.col("nw")) - (F.col("se") - F.col("sw"))) / (4.0 * dx * dy)
    p, q = gx * gx, gy * gy
    steep = F.when(p + q > 0, p + q)
    plan = -(q * xx - 2.0 * gx * gy * xy + p * yy) / F.pow(steep, F.lit(1.5))
    profile = -(p * xx + 2.0 * gx * gy * xy + q * yy) / (steep * F.sqrt(1.0 + steep))
    return plan, profile


def hillshade(azimuth: Column | float, altitude: float = 45.0) -> Column:
    """Illumination 0 to 255 (W5); `azimuth` may be a column."""
    az = F.radians(450.0 - (azimuth if isinstance(azimuth, Column) else F.lit(float(azimuth))))
    alt = math.radians(altitude)
    tilt = F.atan(F.sqrt(F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy")))
    facing = F.atan2(-F.col("gy"), F.col("gx"))
    light = math.sin(alt) * F.cos(tilt) + math.cos(alt) * F.sin(tilt) * F.cos(az - facing)
    return F.when(F.col("gx").isNotNull(), F.least(F.greatest(light, F.lit(0.0)), F.lit(1.0)) * 255.0)


def multi_hillshade(grid: DataFrame, azimuths: list[float], altitude: float = 45.0) -> DataFrame:
    """(row, col, azimuth, shade) from a grid with gx and gy: a few rows for each cell by `explode`, no second pass."""
    fan = grid.withColumn("azimuth", F.explode(F.array(*(F.lit(float(a)) for a in azimuths))))
    return fan.select("row", "col", "azimuth", hillshade(F.col("azimuth"), altitude).alias("shade"))


def central_gradient(grid: DataFrame, step: float = 1.0, value: str = "z", names: tuple[str, str] = ("gx", "gy"), nodata: float | None = 0.0) -> DataFrame:
    """Central differences along rows and columns, one-sided at the edges; 0 is nodata (W7). An absent cell is an edge, a NULL one is not known."""
    g = grid if nodata is None else grid.withColumn(value, F.nullif(value, F.lit(nodata)))
    wanted = {}
    for side in ("w", "e", "n", "s"):
        wanted |= {f"_{side}": (*STEPS[side], value), f"_has_{side}": (*STEPS[side], F.lit(True))}
    out = beside(g, wanted)
    here = F.col(value)
    for name, before, after in ((names[0], "w", "e"), (names[1], "n", "s")):
        a, b = F.col(f"_{before}"), F.col(f"_{after}")
        first, last = F.col(f"_has_{before}").isNull(), F.col(f"_has_{after}").isNull()
        out = out.withColumn(name, F.when(first, (b - here) / step).when(last, (here - a) / step).otherwise((b - a) / (2.0 * step)))
    return out.drop(*wanted)


def script_curvature(step: float = 1.0) -> Column:
    """Second differences along both axes added, over `z` with neighbours (W7): positive in hollows."""
    z = F.col("z")
    return (F.col("e") - 2.0 * z + F.col("w")) / (step * step) + (F.col("s") - 2.0 * z + F.col("n")) / (step * step)


def variant_terrain(dx: Column, dy: Column) -> dict[str, Column]:
    """Slope, aspect and slope-normalised terms of the script variant."""
    return {"slope": F.degrees(F.atan(F.sqrt(dx * dx + dy * dy))), "aspect": F.pmod(F.degrees(F.atan2(-dy, dx)), F.lit(360.0))}


def sobel(value: str = "z") -> Column:
    """Gradient magnitude by Sobel kernels over neighbours that are there; edges repeat the nearest cell."""
    z = F.col(value)
    west, east, north, south = (F.coalesce(F.col(k), z) for k in ("w", "e", "n", "s"))
    nw, ne = F.coalesce("nw", "n", "w", value), F.coalesce("ne", "n", "e", value)
    sw, se = F.coalesce("sw", "s", "w", value), F.coalesce("se", "s", "e", value)
    gx = (ne + 2 * east + se) - (nw + 2 * west + sw)
    gy = (sw + 2 * south + se) - (nw + 2 * north + ne)
    return F.hypot(gx, gy)


def with_maximum(df: DataFrame, value: str, name: str) -> DataFrame:
    """The global maximum as a column: a scalar aggregate, broadcast (one row), instead of a window over all rows."""
    return df.crossJoin(F.broadcast(df.agg(F.max(value).alias(name))))


def hysteresis(grid: DataFrame, low: float, high: float, value: str = "m") -> DataFrame:
    """Edges: cells over `low` beside or at a cell over `high`, with 4 neighbours."""
    strong = grid.withColumn("strong", F.coalesce(F.col(value) >= high, F.lit(False)).cast("int")).withColumn("any", F.coalesce(F.col(value) >= low, F.lit(False)).cast("int"))
    near = {f"_strong_{side}": (*STEPS[side], "strong") for side in ("w", "e", "n", "s")}
    around = F.greatest("strong", *(F.coalesce(n, F.lit(0)) for n in near))
    return beside(strong, near).withColumn("edge", F.when((F.col("any") == 1) & (around == 1), 1).otherwise(0)).drop("strong", "any", *near)


def box_mean(grid: DataFrame, before: int, after: int, value: str = "z", name: str = "mean") -> DataFrame:
    """Mean over the rectangle [-before, after] of cells that are there: separable sums and counts (W11 clipped, W12)."""
    row, col = along_row().rangeBetween(-before, after), along_col().rangeBetween(-before, after)
    g = grid.withColumn("_s", F.sum(value).over(row)).withColumn("_n", F.count(value).over(row))
    return g.withColumn(name, F.sum("_s").over(col) / F.nullif(F.sum("_n").over(col), F.lit(0))).drop("_s", "_n")


def mirrored(grid: DataFrame, width: int, height: int, r: int, value: str = "z") -> DataFrame:
    """The grid with r rows and columns of halo, mirrored with the edge cell repeated. Needs r <= width and height."""

    def copies(at: Column, n: int) -> Column:
        places = F.array(at, F.when(at < r, -1 - at), F.when(at >= n - r, 2 * n - 1 - at))
        return F.explode(F.filter(places, lambda x: x.isNotNull()))

    g = grid.select("row", "col", value)
    g = g.select(copies(F.col("row"), height).alias("row"), "col", value)
    return g.select("row", copies(F.col("col"), width).alias("col"), value)


def inside(grid: DataFrame, width: int, height: int) -> DataFrame:
    return grid.where(F.col("row").between(0, height - 1) & F.col("col").between(0, width - 1))


def box_mean_reflect(grid: DataFrame, width: int, height: int, r: int, value: str = "z", name: str = "mean") -> DataFrame:
    """Box mean of size 2 r + 1 with mirrored edges."""
    return inside(box_mean(mirrored(grid, width, height, r, value), r, r, value, name), width, height)


def gaussian_weights(sigma: float) -> list[float]:
    r = int(4 * sigma + 0.5)
    w = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-r, r + 1)]
    return [x / sum(w) for x in w]


def gaussian(grid: DataFrame, width: int, height: int, sigma: float, value: str = "z", name: str = "smooth") -> DataFrame:
    """Gaussian smoothing with mirrored edges, nodata as 0 (W8): two passes of weighted offsets over a halo."""
    w = gaussian_weights(sigma)
    r = len(w) // 2
    g = mirrored(grid.withColumn(value, F.coalesce(value, F.lit(0.0))), width, height, r, value)
    for axis, window in (("_x", along_row()), (name, along_col())):
        source = value if axis == "_x" else "_x"
        total = sum((F.coalesce(F.lag(source, -k).over(window), F.lit(0.0)) * w[k + r] for k in range(-r, r + 1)), F.lit(0.0))
        g = g.withColumn(axis, total)
    return inside(g, width, height).drop("_x")


#: The lights of the script variant.
SCRIPT_LIGHTS = (0, 45, 90, 135, 180, 225, 270, 315)


def script_hillshade(dx: Column, dy: Column, azimuth: float = 315.0, altitude: float = 45.0) -> Column:
    """Illumination 0 to 255 of the script variant (W7): light from a compass bearing over a gradient whose y grows with the rows; NULL where that is."""
    tilt = F.atan(F.sqrt(dx * dx + dy * dy))
    facing = F.atan2(-dy, dx)
    az, alt = math.radians(azimuth), math.radians(altitude)
    light = (math.cos(alt) * F.cos(tilt) + math.sin(alt) * F.sin(tilt) * F.cos(az - facing)) * 255.0
    return F.when(light.isNotNull(), F.least(F.greatest(light, F.lit(0.0)), F.lit(255.0)))


def script_terrain(grid: DataFrame, step: float = 1.0) -> DataFrame:
    """row, col, slope, aspect, plan_curvature, profile_curvature and hillshade_<azimuth> of the script variant.

    Curvatures are differences of the differences, over (gx^2 + gy^2 + 1e-10)^1.5, clipped to [-1, 1]; 0 is nodata.
    """
    g = central_gradient(grid.select("row", "col", "z"), step)
    g = central_gradient(g, step, "gx", ("gxx", "gxy"), None)
    g = central_gradient(g, step, "gy", ("gyx", "gyy"), None)
    x, y = F.col("gx"), F.col("gy")
    below = F.pow(x * x + y * y + 1e-10, F.lit(1.5))
    plan = -((F.col("gxx") * y * y - 2 * F.col("gxy") * x * y + F.col("gyy") * x * x) / below)
    profile = -((F.col("gxx") * x * x + 2 * F.col("gxy") * x * y + F.col("gyy") * y * y) / below)
    clip = lambda c: F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(-1.0)), F.lit(1.0)))
    shape = variant_terrain(x, y)
    lights = [script_hillshade(x, y, a).alias(f"hillshade_{a}") for a in SCRIPT_LIGHTS]
    return g.select("row", "col", shape["slope"].alias("slope"), shape["aspect"].alias("aspect"), clip(plan).alias("plan_curvature"), clip(profile).alias("profile_curvature"), *lights)


def drainage_proxy(grid: DataFrame, width: int, height: int, size: int, step: float = 1.0) -> DataFrame:
    """row, col, density: the gradient's size, 0 where it is not known, smoothed by a box of `size` cells with mirrored edges.

    An even box reaches one cell further back than forth.
    """
    g = central_gradient(grid, step).select("row", "col", F.coalesce(F.hypot("gx", "gy"), F.lit(0.0)).alias("z"))
    before, after = size // 2, size - size // 2 - 1
    return inside(box_mean(mirrored(g, width, height, before), before, after, name="density"), width, height).select("row", "col", "density")
