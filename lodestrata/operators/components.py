"""Connected components of grid cells and ranked target zones."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .focal import BLOCK
from .graph import star_rounds
from .shared import cut, ship


def _labelled(ids: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The smallest of `ids` that each place reaches over the links (u, v) between places; `ids` ascend."""
    label = np.arange(len(ids))
    while True:
        low = np.minimum(label[u], label[v])
        new = label.copy()
        np.minimum.at(new, label[u], low)
        np.minimum.at(new, label[v], low)
        while ((up := new[new]) != new).any():
            new = up
        if (new == label).all():
            return ids[label]
        label = new


def connected_cells(cells: DataFrame, width: int, rounds: int = 60) -> DataFrame:
    """row, col, component (smallest row * width + col) of cells that touch by an edge.

    Blocks of cells label themselves first, in one task each; then distributed union-find joins the labels that meet at blocks' edges:
    its table holds pairs of labels, not cells.
    """
    ship(cells.sparkSession)
    ids = cells.select("row", "col", (F.col("row").cast("long") * width + F.col("col")).alias("id"), F.floor(F.col("row") / BLOCK).alias("_br"), F.floor(F.col("col") / BLOCK).alias("_bc"))

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("id")
        row, col, named = (table[c].to_numpy() for c in ("row", "col", "id"))
        if not len(named):
            return table.select(["row", "col", "id"]).append_column("label", table["id"])
        u, v = [], []
        for step, fits in ((1, col < width - 1), (width, np.ones(len(col), bool))):
            at = np.minimum(np.searchsorted(named, named + step), len(named) - 1)
            hit = fits & (named[at] == named + step) & (row // BLOCK == row[at] // BLOCK) & (col // BLOCK == col[at] // BLOCK)
            u.append(np.flatnonzero(hit))
            v.append(at[hit])
        label = _labelled(named, np.concatenate(u), np.concatenate(v))
        return pa.table({"row": table["row"], "col": table["col"], "id": table["id"], "label": pa.array(label, pa.int64())})

    kinds = f"row {cells.schema['row'].dataType.simpleString()}, col {cells.schema['col'].dataType.simpleString()}, id long, label long"
    local = cut(ids.dropDuplicates(["id"]).groupBy("_br", "_bc").applyInArrow(run, kinds))
    edge = lambda at: local.where(F.pmod(F.col(at), F.lit(BLOCK)).isin(0, BLOCK - 1)).select("id", "label", at)
    links = []
    for at, step, last in (("col", 1, F.col("col") < width - 1), ("row", width, F.lit(True))):
        a = edge(at).where((F.pmod(F.col(at), F.lit(BLOCK)) == BLOCK - 1) & last).select((F.col("id") + step).alias("id"), F.col("label").alias("u"))
        links.append(a.join(edge(at).where(F.pmod(F.col(at), F.lit(BLOCK)) == 0).select("id", F.col("label").alias("v")), "id").select("u", "v"))
    pairs = links[0].unionByName(links[1]).where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    now = star_rounds(pairs, rounds)
    label = now.groupBy(F.col("u").alias("label")).agg(F.min("v").alias("component"))
    return local.join(label, "label", "left").select("row", "col", F.coalesce("component", "label").alias("component"))


def target_zones(grid: DataFrame, width: int, threshold: float, cell: float, least_area: float, x0: float = 0.0, y0: float = 0.0, uncertainty: str | None = None) -> DataFrame:
    """Zones of touching cells with prob >= threshold and an area of `least_area` km2 or more, by mean probability.

    Columns: zone_rank, component, n_cells, area_km2, mean_probability, mean_uncertainty, centroid_x, centroid_y. Figures are rounded
    half to even before they are ranked; equal ones keep the order of their first cell.
    """
    hot = grid.where(F.col("prob") >= threshold)
    labelled = connected_cells(hot.select("row", "col"), width).join(hot, ["row", "col"])
    n = F.count("*").alias("n_cells")
    mean_u = F.avg(uncertainty) if uncertainty else F.lit(0.0)
    zones = labelled.groupBy("component").agg(n, F.avg("prob").alias("p"), mean_u.alias("u"), F.avg("col").alias("c"), F.avg("row").alias("r"))
    area = F.col("n_cells") * (cell * cell / 1e6)
    zones = zones.where(area >= least_area).select(
        "component", "n_cells", F.bround(area, 2).alias("area_km2"), F.bround("p", 1).alias("mean_probability"), F.bround("u", 1).alias("mean_uncertainty"),
        F.bround(x0 + (F.col("c") + 0.5) * cell, 5).alias("centroid_x"), F.bround(y0 - (F.col("r") + 0.5) * cell, 5).alias("centroid_y"),
    )
    return zones.selectExpr("row_number() over (order by mean_probability desc, component) as zone_rank", "*")


#: Sides of a cell: (row, column) of the cell beyond, and the side's corners as (row, column) offsets, clockwise.
SIDES = (((-1, 0), (0, 0), (0, 1)), ((0, 1), (0, 1), (1, 1)), ((1, 0), (1, 1), (1, 0)), ((0, -1), (1, 0), (0, 0)))


def zone_outlines(labelled: DataFrame, x0: float = 0.0, y0: float = 0.0, cell: float = 1.0) -> DataFrame:
    """component, ax, ay, bx, by: the sides of cells (row, col, component) that no cell of the same zone shares.

    Sides run clockwise, so they join into rings around a zone and, the other way round, around its holes.
    """
    side = F.explode(F.array(*(F.struct(*(F.lit(v).alias(n) for n, v in zip(("dr", "dc", "ar", "ac", "br", "bc"), (*beyond, *a, *b), strict=True))) for beyond, a, b in SIDES)))
    sides = labelled.select("component", "row", "col", side.alias("s"))
    sides = sides.select("component", "row", "col", "s.*").withColumn("nr", F.col("row") + F.col("dr")).withColumn("nc", F.col("col") + F.col("dc"))
    there = labelled.select("component", F.col("row").alias("nr"), F.col("col").alias("nc"))
    x, y = (lambda c: x0 + (F.col("col") + F.col(c)) * cell), (lambda r: y0 - (F.col("row") + F.col(r)) * cell)
    return sides.join(there, ["component", "nr", "nc"], "left_anti").select("component", x("ac").alias("ax"), y("ar").alias("ay"), x("bc").alias("bx"), y("br").alias("by"))


def _traced(group: pa.Table) -> pa.Table:
    """The sides of a block's own cells, chained as far as the block goes.

    Rows of `part` 0 are corners (at the end of a side where the ring turns): with `ring` the smallest side of a ring that lies in the block, and
    `place`; of a ring that leaves it, with `chain` the first side of the stretch in the block, and `place` from there. Rows of `part` 1 are
    such stretches: `chain`, `next` (the first side of the next one), `n` (sides), `ring` (the smallest side) and `place` (where that is).
    """
    component, row, col, own, cell = (group[c].to_numpy(zero_copy_only=False) for c in ("component", "row", "col", "own", "cell"))
    zone = np.unique(component, return_inverse=True)[1].astype(np.int64)
    r, c = row - row.min() + 1 if len(row) else row, col - col.min() + 1 if len(col) else col
    wide = int(c.max()) + 2 if len(c) else 1
    tall = int(r.max()) + 2 if len(r) else 1
    name = (zone * tall + r) * wide + c
    order = np.argsort(name, kind="stable")
    order = order[np.concatenate([[True], np.diff(name[order]) > 0])] if len(order) else order
    component, row, col, own, cell, name = (x[order] for x in (component, row, col, own, cell, name))

    def at(which: np.ndarray, dr: int, dc: int) -> np.ndarray:
        """Places of the cells of the same zone beside those at `which`, -1 where there is none."""
        want = name[which] + dr * wide + dc
        place = np.minimum(np.searchsorted(name, want), len(name) - 1)
        return np.where(name[place] == want, place, -1)

    ids, nexts, turns, ends, whose = [], [], [], [], []
    mine = np.flatnonzero(own)
    for k, ((dr, dc), _, (er, ec)) in enumerate(SIDES):
        x = mine[at(mine, dr, dc) < 0]
        (fr, fc) = SIDES[(k + 1) % 4][0]  # the way that a side runs is the way out of the next side
        ahead, beyond = at(x, fr, fc), at(x, fr + dr, fc + dc)
        # the next side is the same cell's, that of the cell ahead in the same direction, or that of the cell ahead and beyond
        to = np.where(ahead < 0, x, np.where(beyond < 0, ahead, beyond))
        side = np.where(ahead < 0, (k + 1) % 4, np.where(beyond < 0, k, (k + 3) % 4))
        ids.append(cell[x] * 4 + k)
        nexts.append(cell[to] * 4 + side)
        turns.append(side != k)
        ends.append((row[x] + er, col[x] + ec))
        whose.append(component[x])
    ids, nexts, turns, whose = (np.concatenate(v) for v in (ids, nexts, turns, whose))
    er, ec = (np.concatenate([e[i] for e in ends]) for i in (0, 1))
    zone = np.unique(whose, return_inverse=True)[1] if len(whose) else np.zeros(0, np.int64)
    order = np.lexsort((ids, zone))
    ids, nexts, turns, whose, zone, er, ec = (x[order] for x in (ids, nexts, turns, whose, zone, er, ec))
    n = len(ids)
    link = np.full(n, -1)
    for z, first, last in zip(*_runs(zone), strict=True):
        place = first + np.minimum(np.searchsorted(ids[first:last], nexts[first:last]), last - first - 1)
        link[first:last] = np.where(ids[place] == nexts[first:last], place, -1)
    # steps back to the first side of the stretch; on a closed ring to its smallest side, where it is cut
    back = np.full(n, -1)
    back[link[link >= 0]] = np.flatnonzero(link >= 0)
    low, jump = np.arange(n), np.where(back < 0, np.arange(n), back)
    for _ in range(max(1, n.bit_length())):  # the smallest side among those before: sides ascend within a zone
        low, jump = np.minimum(low, low[jump]), jump[jump]
    closed = back[jump] >= 0
    cut_at = closed & (low == np.arange(n))
    head, step = np.where((back < 0) | cut_at, np.arange(n), back), np.where((back < 0) | cut_at, 0, 1)
    for _ in range(max(1, n.bit_length())):
        head, step = head[head], step + step[head]
    length = np.bincount(head, minlength=n)
    corner = turns
    shut = closed & corner
    opened = ~closed & corner
    none = lambda k: pa.nulls(k, pa.int64())
    whole = lambda v: pa.array(v, pa.int64())
    names = ["part", "component", "ring", "chain", "next", "n", "place", "row", "col"]

    def rows(part, component, ring, chain, after, size, place, r, c):
        k = len(component)
        return pa.table([whole(np.full(k, part)), whole(component), *(none(k) if v is None else whole(v) for v in (ring, chain, after, size, place, r, c))], names=names)

    out = [rows(0, whose[shut], ids[head[shut]], None, None, None, step[shut] - length[head[shut]], er[shut], ec[shut])]
    out.append(rows(0, whose[opened], None, ids[head[opened]], None, None, step[opened], er[opened], ec[opened]))
    last = np.flatnonzero((link < 0) & ~closed)
    least = np.full(n, n)
    np.minimum.at(least, head, np.arange(n))
    heads = head[last]
    out.append(rows(1, whose[last], ids[least[heads]], ids[heads], nexts[last], length[heads], step[least[heads]], None, None))
    return pa.concat_tables(out)


def _runs(groups: np.ndarray) -> tuple[list, list, list]:
    """Value, first place and end of each run of equal values."""
    edge = np.concatenate([[0], np.flatnonzero(np.diff(groups)) + 1, [len(groups)]]) if len(groups) else np.zeros(1, np.int64)
    return groups[edge[:-1]].tolist(), edge[:-1].tolist(), edge[1:].tolist()


def ring_points(labelled: DataFrame, width: int, rounds: int = 60) -> DataFrame:
    """component, ring, place, row, col: the corners of each zone's rings in order, clockwise around the zone.

    `labelled` has row, col, component. Blocks of cells, with a rim of one cell, chain their own sides in one task each, which is all for a
    ring within a block. Stretches of rings that leave their block are chained by pointer jumping: in each round a stretch learns the smallest
    side among twice as many that follow, which names its ring; then, with the ring cut there, how many sides lead to its end. Both
    take rounds that grow with the logarithm of the number of blocks that a ring passes. Where two cells of a zone touch at a corner only, the side
    that follows is the same cell's: zones are joined by edges. Corners on a straight line are left out.
    """
    ship(labelled.sparkSession)
    cells = labelled.select(F.col("component").cast("long").alias("component"), F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col")).dropna()
    block = lambda c, d: F.floor((F.col(c) + d) / BLOCK)
    around = lambda c: F.array_distinct(F.array(block(c, -1), block(c, 0), block(c, 1)))
    cells = cells.withColumn("_br", F.explode(around("row"))).withColumn("_bc", F.explode(around("col")))
    cells = cells.withColumn("own", (F.col("_br") == block("row", 0)) & (F.col("_bc") == block("col", 0))).withColumn("cell", F.col("row") * width + F.col("col"))
    kinds = ", ".join(f"{c} long" for c in ("part", "component", "ring", "chain", "next", "n", "place", "row", "col"))
    traced = cut(cells.groupBy("_br", "_bc").applyInArrow(_traced, kinds))
    done = traced.where("part = 0 and ring is not null").select("component", "ring", "place", "row", "col")
    chains = traced.where("part = 1").select("component", "chain", "next", "n", F.col("ring").alias("low"), F.col("place").alias("at"))
    if chains.isEmpty():
        return done
    now, seen = chains.select("component", "chain", "next", "low"), None
    for _ in range(rounds):
        ahead = now.select("component", F.col("chain").alias("next"), F.col("next").alias("_next"), F.col("low").alias("_low"))
        now = cut(now.join(ahead, ["component", "next"]).select("component", "chain", F.col("_next").alias("next"), F.least("low", "_low").alias("low")))
        stats = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("chain", "low").bitwiseAND(F.lit(0xFFFFFFFF)))).first())
        if stats == seen or not stats[0]:
            break
        seen = stats
    else:
        raise RuntimeError(f"rings are not complete after {rounds} rounds")
    named = cut(chains.join(now.select("component", "chain", F.col("low").alias("ring")), ["component", "chain"]))
    first = named.where("low = ring").select("component", "ring", F.col("chain").alias("first"), F.col("at").alias("skip"))
    named = named.join(first, ["component", "ring"])
    left = cut(named.select("component", "chain", F.when(F.col("next") != F.col("first"), F.col("next")).alias("next"), F.col("n").alias("steps")))
    for _ in range(rounds):
        if not left.where("next is not null").limit(1).count():
            break
        ahead = left.select("component", F.col("chain").alias("next"), F.col("next").alias("_next"), F.col("steps").alias("_steps"))
        left = cut(left.join(ahead, ["component", "next"], "left").select("component", "chain", F.col("_next").alias("next"), (F.col("steps") + F.coalesce("_steps", F.lit(0))).alias("steps")))
    else:
        raise RuntimeError(f"rings are not in order after {rounds} rounds")
    # sides to the end of the ring, which is cut before its smallest side
    corners = traced.where("part = 0 and ring is null").select("component", "chain", "place", "row", "col")
    known = named.select("component", "chain", "ring", "first", "skip").join(left.select("component", "chain", "steps"), ["component", "chain"])
    before = (F.col("chain") == F.col("first")) & (F.col("place") < F.col("skip"))
    place = F.when(before, F.col("place") - F.col("skip")).otherwise(F.col("place") - F.col("skip") - F.col("steps"))
    joined = corners.join(known, ["component", "chain"]).select("component", "ring", place.alias("place"), "row", "col")
    return done.unionByName(joined)


def zone_polygons(labelled: DataFrame, width: int, x0: float = 0.0, y0: float = 0.0, cell: float = 1.0) -> DataFrame:
    """component, ring, hole, n_points, area (in square units, negative for holes), points (closed): a row for each ring.

    A ring is one value, so its corners meet in one row; all before works on single sides.
    """
    at = F.struct("place", (F.lit(x0) + F.col("col") * cell).alias("x"), (F.lit(y0) - F.col("row") * cell).alias("y"))
    rings = ring_points(labelled, width).groupBy("component", "ring").agg(F.sort_array(F.collect_list(at)).alias("p"))
    rings = rings.withColumn("points", F.transform(F.concat("p", F.slice("p", 1, 1)), lambda q: F.struct(q["x"].alias("x"), q["y"].alias("y"))))
    around = F.aggregate(F.arrays_zip(F.slice("points", F.lit(2), F.size("points")).alias("b"), F.slice("points", F.lit(1), F.size("points") - 1).alias("a")), F.lit(0.0), lambda s, e: s + (e["b"]["x"] * e["a"]["y"] - e["a"]["x"] * e["b"]["y"]))
    rings = rings.withColumn("area", around / 2)
    return rings.select("component", "ring", (F.col("area") < 0).alias("hole"), F.size("p").alias("n_points"), "area", "points")
