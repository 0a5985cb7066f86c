"""Sinks, flow directions and accumulation over a dense grid."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .focal import BLOCK, NEIGHBOURS, box_mean, with_halo, with_neighbours
from .shared import cut, ship

#: Fixed values: (row, column) offsets of the neighbours in their order.
OFFSETS = ((-1, -1), (-1, 0), (-1, 1), (0, -1), (0, 1), (1, -1), (1, 0), (1, 1))


#: What stands for cells that are not there or not known.
HIGH = 1e30


def _filled(z: np.ndarray, own: np.ndarray) -> np.ndarray:
    """`z` with each cell of `own` below all its neighbours raised to the lowest of them, until none is; other cells stay."""
    z = z.copy()
    while True:
        padded = np.pad(z, 1, constant_values=HIGH)
        low = np.minimum.reduce([padded[1 + i : 1 + i + z.shape[0], 1 + j : 1 + j + z.shape[1]] for i, j in OFFSETS])
        pit = own & (z < low)
        if not pit.any():
            return z
        z[pit] = low[pit]


def fill_sinks(grid: DataFrame, rounds: int = 1000) -> DataFrame:
    """Raises each cell below all its neighbours to the lowest of them, until none is.

    Outside the grid and nodata count as very high. Raising is monotone, so its end is the same in any order: blocks of cells, with a
    halo of their neighbours' last values, are filled to their own end in one task each, and rounds go on until no block changes a cell. So rounds
    grow with the blocks that a pit spans, not with its depth. More than `rounds` raise.
    """
    ship(grid.sparkSession)

    def run(table: pa.Table) -> pa.Table:
        row, col, z, br, bc = (table[c].to_numpy() for c in ("row", "col", "z", "_br", "_bc"))
        r, c = row - br * BLOCK + 1, col - bc * BLOCK + 1
        cells = np.full((BLOCK + 2, BLOCK + 2), HIGH)
        own = np.zeros(cells.shape, bool)
        known = ~np.isnan(z)
        cells[r[known], c[known]] = z[known]
        mine = (r >= 1) & (r <= BLOCK) & (c >= 1) & (c <= BLOCK)
        own[r[known & mine], c[known & mine]] = True
        new = np.where(known, _filled(cells, own)[r, c], np.nan)[mine]
        old = z[mine]
        return pa.table({"row": table["row"].filter(pa.array(mine)), "col": table["col"].filter(pa.array(mine)), "z": pa.array(new, pa.float64(), mask=np.isnan(new)), "raised": pa.array(new > old)})

    now = grid.select(F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), F.col("z").cast("double").alias("z"))
    for _ in range(rounds):
        dealt = with_halo(now).select("row", "col", "z", "_br", "_bc")
        now = cut(dealt.groupBy("_br", "_bc").applyInArrow(run, "row int, col int, z double, raised boolean"))
        if now.where("raised").isEmpty():
            return now.select("row", "col", "z")
        now = now.select("row", "col", "z")
    raise RuntimeError(f"sinks are not filled after {rounds} rounds")


def d8(grid: DataFrame) -> DataFrame:
    """row, col, z, direction (0-7 in neighbour order; NULL without a lower neighbour): the steepest drop, the first of equals."""
    drops = [F.struct(((F.col("z") - F.col(n)) / (math.sqrt(2) if a and b else 1.0)).alias("drop"), F.lit(-k).alias("k")) for k, (n, (a, b)) in enumerate(zip(NEIGHBOURS, OFFSETS, strict=True))]
    best = F.array_max(F.filter(F.array(*drops), lambda s: s["drop"] > 0))
    return with_neighbours(grid).select("row", "col", "z", (-best["k"]).alias("direction"))


def accumulation(directions: DataFrame, rounds: int = 64) -> DataFrame:
    """row, col, acc: 1 + the number of cells upstream.

    Pointer doubling: after k rounds a cell has counted all cells up to 2^k steps upstream, so the rounds grow with the
    logarithm of the longest path. Drops are positive, so there are no cycles.
    """
    # guarded by `when`: element_at of literals counts as never NULL, even at a NULL index
    step = lambda i: F.when(F.col("direction").isNotNull(), F.element_at(F.array(*(F.lit(o[i]) for o in OFFSETS)), F.col("direction") + 1))
    now = directions.select("row", "col", (F.col("row") + step(0)).alias("tr"), (F.col("col") + step(1)).alias("tc"), F.lit(1).cast("long").alias("acc"))
    now = cut(now)
    for _ in range(rounds):
        sent = now.where("tr is not null").groupBy(F.col("tr").alias("row"), F.col("tc").alias("col")).agg(F.sum("acc").alias("more"))
        nxt = now.select(F.col("row").alias("tr"), F.col("col").alias("tc"), F.col("tr").alias("nr"), F.col("tc").alias("nc"))
        now = now.join(sent, ["row", "col"], "left").join(nxt, ["tr", "tc"], "left")
        now = cut(now.select("row", "col", F.col("nr").alias("tr"), F.col("nc").alias("tc"), (F.col("acc") + F.coalesce("more", F.lit(0))).alias("acc")))
        if now.where("tr is not null").isEmpty():
            return now.select("row", "col", "acc")
    raise RuntimeError(f"flow paths are longer than 2^{rounds} cells, or run in circles")


def drainage_density(grid: DataFrame, threshold: int = 100, radius: int = 15) -> DataFrame:
    """row, col, density: share of stream cells in the square around, clipped at the edges; NULL at nodata."""
    filled = fill_sinks(grid)
    acc = accumulation(d8(filled))
    streams = filled.join(acc, ["row", "col"]).select("row", "col", "z", (F.col("acc") >= threshold).cast("double").alias("stream"))
    return box_mean(streams, radius, radius, "stream", "density").select("row", "col", F.when(F.col("z").isNotNull(), F.col("density")).alias("density"))
