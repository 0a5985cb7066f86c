"""Queries of samples, training sets, composites, reprojection and script variants, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.geometry import from_web_mercator, in_bounds, web_mercator
from ..functions.mapalgebra import PRESETS
from ..operators import focal, proximity, resample, sampling, validation
from ..sources import catalog
from ..sources.config import clamp_end, table
from ..sources.raster import nodata_out
from .common import NEIGHBOURS, ORDERS, PART, POINTS, height, orders_grid, part_grid, points, r
from .pixels import RING, _ring_sql
from .rasters import RC, _mirror
from .scores import BLOCKS, EXPLORATION, SIGNAL, draw_sql, signal_check


def background_sample(spark, d):
    g = part_grid(spark, d).withColumn("z", F.col("z") / 20)
    return sampling.background_sample(g, 500).select("row", "col", r("z").alias("z"))


BACKGROUND = f'WITH {PART} SELECT {RC}, round(z / 20, 6) + 0.0 AS z FROM g WHERE z / 20 <> 0 AND abs(z / 20) < 100 ORDER BY (r::BIGINT * 7919 + c::BIGINT * 104729) % 1000003, r, c LIMIT 500'


def set_operations(spark, d):
    left = table(spark, d, "customer").select((F.col("c_custkey") % 700).alias("k"))
    right = table(spark, d, "supplier").select((F.col("s_suppkey") * 3).alias("k"))
    return validation.set_operations(left, right, "k")


SETS = "WITH a AS (SELECT DISTINCT c_custkey % 700 AS k FROM customer), b AS (SELECT DISTINCT s_suppkey * 3 AS k FROM supplier) SELECT CASE WHEN a.k IS NULL THEN 'right' WHEN b.k IS NULL THEN 'left' ELSE 'both' END AS kind, coalesce(a.k, b.k) AS value FROM a FULL JOIN b ON a.k = b.k"


def road_intensity(spark, d):
    g = part_grid(spark, d).withColumn("n", F.when(F.col("z") % 7 < 1, 1).otherwise(0)).withColumn("road", F.when(F.col("col") != 13, F.abs(F.col("col") - 20) * 30.0))
    return sampling.exploration_intensity(g, 50, height(g), 3, "road").select("row", "col", r("intensity").alias("intensity"))


ROADS = f'SELECT "row", col, round(CASE WHEN col <> 13 THEN (intensity + 1 - abs(col - 20) * 30.0 / max(abs(col - 20) * 30.0) OVER ()) / 2 ELSE intensity END, 6) + 0.0 AS intensity FROM ({EXPLORATION.replace("round(CASE WHEN", "(CASE WHEN").replace("END, 6) + 0.0 AS intensity", "END) AS intensity")})'


def script_terrain(spark, d):
    """All layers of the script variant; some heights are nodata."""
    g = part_grid(spark, d).withColumn("z", F.when(F.col("z") % 97 >= 3, F.col("z")).otherwise(0.0))
    t = focal.script_terrain(g, 30.0)
    return t.select("row", "col", *(r(c, 5).alias(c) for c in t.columns[2:]))


def second_differences(spark, d):
    shaped = focal.with_neighbours(part_grid(spark, d)).select("row", "col", focal.script_curvature(30.0).alias("curvature"))
    return shaped.select("row", "col", r("curvature").alias("curvature"))


_CENTRAL = """gr AS (SELECT r, c, z, CASE WHEN w IS NULL THEN (e - z) / 30 WHEN e IS NULL THEN (z - w) / 30 ELSE (e - w) / 60 END AS gx, CASE WHEN n IS NULL THEN (s - z) / 30 WHEN s IS NULL THEN (z - n) / 30 ELSE (s - n) / 60 END AS gy, (e - 2 * z + w) / 900.0::DOUBLE + (s - 2 * z + n) / 900.0::DOUBLE AS k FROM n)"""
SECOND = f"WITH {PART}, {NEIGHBOURS}, {_CENTRAL} SELECT {RC}, round(k, 6) + 0.0 AS curvature FROM gr"


def _difference(value: str, source: str, along: str, step: str = "30.0::DOUBLE") -> str:
    """A difference of `value` over the table `source` (r, c): along rows (`c`) or columns (`r`), one-sided beside absent cells."""
    at = {"r": ("a.r - 1 = p.r AND a.c = p.c", "a.r + 1 = q.r AND a.c = q.c"), "c": ("a.r = p.r AND a.c - 1 = p.c", "a.r = q.r AND a.c + 1 = q.c")}[along]
    case = f"CASE WHEN p.r IS NULL THEN (q.{value} - a.{value}) / {step} WHEN q.r IS NULL THEN (a.{value} - p.{value}) / {step} ELSE (q.{value} - p.{value}) / (2 * {step}) END"
    return f"SELECT a.r, a.c, {case} AS v FROM {source} a LEFT JOIN {source} p ON {at[0]} LEFT JOIN {source} q ON {at[1]}"


def _script_sql() -> str:
    part = "g AS (SELECT (p_partkey // 50)::INT AS r, (p_partkey % 50)::INT AS c, CASE WHEN p_retailprice % 97 >= 3 THEN p_retailprice END AS z FROM part)"
    steps = [part, f"x AS ({_difference('z', 'g', 'c')})", f"y AS ({_difference('z', 'g', 'r')})", "k AS (SELECT r, c, x.v AS gx, y.v AS gy FROM x JOIN y USING (r, c))"]
    steps += [f"{name} AS ({_difference(value, 'k', along)})" for name, value, along in (("xx", "gx", "c"), ("xy", "gx", "r"), ("yy", "gy", "r"))]
    steps.append("m AS (SELECT k.r, k.c, gx, gy, xx.v AS a, xy.v AS b, yy.v AS d, pow(gx * gx + gy * gy + 1e-10, 1.5) AS n, atan(sqrt(gx * gx + gy * gy)) AS tilt, atan2(-gy, gx) AS facing FROM k JOIN xx USING (r, c) JOIN xy USING (r, c) JOIN yy USING (r, c))")
    clip = lambda v: f"CASE WHEN {v} IS NOT NULL THEN round(least(greatest({v}, -1.0), 1.0), 5) + 0.0 END"
    light = lambda z: f"CASE WHEN gx IS NOT NULL AND gy IS NOT NULL THEN round(least(greatest((cos(radians(45)) * cos(tilt) + sin(radians(45)) * sin(tilt) * cos(radians({z}) - facing)) * 255, 0.0), 255.0), 5) + 0.0 END AS hillshade_{z}"
    curves = f"{clip('-((a * gy * gy - 2 * b * gx * gy + d * gx * gx) / n)')} AS plan_curvature, {clip('-((a * gx * gx + 2 * b * gx * gy + d * gy * gy) / n)')} AS profile_curvature"
    return f"WITH {', '.join(steps)} SELECT {RC}, round(degrees(tilt), 5) + 0.0 AS slope, round(((degrees(facing) % 360) + 360) % 360, 5) + 0.0 AS aspect, {curves}, {', '.join(map(light, focal.SCRIPT_LIGHTS))} FROM m"


SCRIPT = _script_sql()


def drainage_proxy(spark, d):
    g = part_grid(spark, d)
    return focal.drainage_proxy(g, 50, height(g), 4, 30.0).select("row", "col", r("density").alias("density"))


PROXY = f"WITH gg AS (SELECT (p_partkey // 50)::INT AS r, (p_partkey % 50)::INT AS c, p_retailprice AS z FROM part), {NEIGHBOURS.replace('FROM g ', 'FROM gg g ').replace('JOIN g g_', 'JOIN gg g_')}, {_CENTRAL}, g AS (SELECT r, c, coalesce(sqrt(gx * gx + gy * gy), 0) AS z FROM gr), {_mirror(2)}, k AS (SELECT r, c, sum(z) OVER o AS s, count(z) OVER o AS q FROM m WHERE c IS NOT NULL WINDOW o AS (PARTITION BY r ORDER BY c RANGE BETWEEN 2 PRECEDING AND 1 FOLLOWING)), b AS (SELECT r, c, sum(s) OVER o / sum(q) OVER o AS v FROM k WINDOW o AS (PARTITION BY c ORDER BY r RANGE BETWEEN 2 PRECEDING AND 1 FOLLOWING)) SELECT {RC}, round(v, 6) + 0.0 AS density FROM b, h WHERE r BETWEEN 0 AND h - 1 AND c BETWEEN 0 AND 49"

#: Left, top and cell of the stand-in source in degrees, and of the target in metres.
SOURCE, TARGET, TW, TH = (20.0, -10.0, 0.1), (2230000.0, -1120000.0, 12000.0), 44, 36


def reproject_mercator(spark, d):
    return resample.reproject(part_grid(spark, d), TW, TH, TARGET, SOURCE, from_web_mercator).select("row", "col", r("z", 4).alias("z"))


REPROJECT = "WITH " + PART + f""", t AS (SELECT tr, tc, {TARGET[0]}::DOUBLE + (tc + 0.5::DOUBLE) * {TARGET[2]} AS mx, {TARGET[1]}::DOUBLE - (tr + 0.5::DOUBLE) * {TARGET[2]} AS my FROM (SELECT unnest(range({TW})) AS tc), (SELECT unnest(range({TH})) AS tr)),
u AS (SELECT tr, tc, (degrees(mx / 6378137.0) - {SOURCE[0]}) / {SOURCE[2]}::DOUBLE - 0.5 AS x, ({SOURCE[1]} - degrees(2 * atan(exp(my / 6378137.0)) - pi() / 2)) / {SOURCE[2]}::DOUBLE - 0.5 AS y FROM t),
k AS (SELECT tr, tc, floor(y)::INT + i AS r, floor(x)::INT + j AS c, (CASE WHEN j = 1 THEN x - floor(x) ELSE 1 - (x - floor(x)) END) * (CASE WHEN i = 1 THEN y - floor(y) ELSE 1 - (y - floor(y)) END) AS w FROM u, (SELECT unnest([0, 1]) AS i), (SELECT unnest([0, 1]) AS j))
SELECT tr::INT AS "row", tc::INT AS col, round(sum(w * z) / sum(w) FILTER (z IS NOT NULL), 4) + 0.0 AS z FROM k LEFT JOIN g USING (r, c) WHERE w > 0 GROUP BY 1, 2"""

#: A ring in degrees over two overlapping tiles.
AREA = [(20.3, -10.4), (24.6, -10.2), (25.9, -12.8), (22.1, -13.4), (20.6, -12.1)]
STEP = 9000.0


def mosaic_to_mercator(spark, d):
    """Two tiles, one of them with holes, as one raster in another system within a ring."""
    g = part_grid(spark, d)
    a = g.select(F.lit(0).alias("ord"), F.lit(20.0).alias("left"), F.lit(-10.0).alias("top"), "row", "col", F.when(F.col("z") % 3 >= 1, F.col("z")).alias("z"))
    b = g.select(F.lit(1).alias("ord"), F.lit(21.0).alias("left"), F.lit(-10.5).alias("top"), "row", "col", "z")
    found, _, _ = resample.mosaic_reproject_clip(a.unionByName(b), 0.1, AREA, STEP, web_mercator, from_web_mercator)
    return found.select("row", "col", r("z", 4).alias("z"))


def _reprojected(source: str, left0: float, top0: float, cell: float, value: str = "z") -> str:
    """Rows of the grid in the CTEs `source` (the last is g) within AREA in the target system."""
    import math

    ring = [(math.radians(x) * 6378137.0, math.log(math.tan(math.pi / 4 + math.radians(y) / 2)) * 6378137.0) for x, y in AREA]
    left, top = min(x for x, _ in ring), max(y for _, y in ring)
    wide, high = math.ceil((max(x for x, _ in ring) - left) / STEP), math.ceil((top - min(y for _, y in ring)) / STEP)
    crossed = " + ".join(f"CASE WHEN (my < {ay!r}) <> (my < {by!r}) AND mx < ({bx!r} - {ax!r}) * (my - ({ay!r})) / ({by!r} - ({ay!r})) + ({ax!r}) THEN 1 ELSE 0 END" for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1], strict=True))
    return f"""WITH {source}, t AS (SELECT tr, tc, {left!r}::DOUBLE + (tc + 0.5::DOUBLE) * {STEP} AS mx, {top!r}::DOUBLE - (tr + 0.5::DOUBLE) * {STEP} AS my FROM (SELECT unnest(range({wide})) AS tc), (SELECT unnest(range({high})) AS tr)),
i AS (SELECT * FROM t WHERE ({crossed}) % 2 = 1), u AS (SELECT tr, tc, (degrees(mx / 6378137.0) - {left0}) / {cell}::DOUBLE - 0.5 AS x, ({top0} - degrees(2 * atan(exp(my / 6378137.0)) - pi() / 2)) / {cell}::DOUBLE - 0.5 AS y FROM i),
k AS (SELECT tr, tc, floor(y)::INT + i AS r, floor(x)::INT + j AS c, (CASE WHEN j = 1 THEN x - floor(x) ELSE 1 - (x - floor(x)) END) * (CASE WHEN i = 1 THEN y - floor(y) ELSE 1 - (y - floor(y)) END) AS w FROM u, (SELECT unnest([0, 1]) AS i), (SELECT unnest([0, 1]) AS j))
SELECT tr::INT AS "row", tc::INT AS col, sum(w * z) / sum(w) FILTER (z IS NOT NULL) AS {value} FROM k LEFT JOIN g USING (r, c) WHERE w > 0 GROUP BY 1, 2"""


def _mosaic_sql() -> str:
    tiles = "p0 AS (SELECT (p_partkey // 50)::INT AS r, (p_partkey % 50)::INT AS c, p_retailprice AS z FROM part), o AS (SELECT r, c, CASE WHEN z % 3 >= 1 THEN z END AS z, 0 AS o FROM p0 UNION ALL SELECT r + 5, c + 10, z, 1 FROM p0), g AS (SELECT r, c, arg_min(z, o) AS z FROM o WHERE z IS NOT NULL GROUP BY 1, 2)"
    return f'SELECT "row", col, round(z, 4) + 0.0 AS z FROM ({_reprojected(tiles, 20.0, -10.0, 0.1)})'


def scene_to_mercator(spark, d):
    """Two bands of one scene with cells of different sizes, in another system within a ring; a third is missing."""
    fine = part_grid(spark, d)
    coarse = fine.groupBy(F.floor(F.col("row") / 2).cast("int").alias("row"), F.floor(F.col("col") / 2).cast("int").alias("col")).agg(F.max("z").alias("z"))
    t = resample.preprocess_scene({"B04": (fine, 20.0, -10.0, 0.1), "B08": None, "B11": (coarse, 20.0, -10.0, 0.2)}, AREA, STEP, web_mercator, from_web_mercator)
    return t.select("row", "col", r("B04").alias("B04"), r("B11").alias("B11"))


def _scene_mercator_sql() -> str:
    part = "SELECT (p_partkey // 50)::INT AS r, (p_partkey % 50)::INT AS c, p_retailprice AS z FROM part"
    fine, coarse = _reprojected(f"g AS ({part})", 20.0, -10.0, 0.1, "a"), _reprojected(f"f AS ({part}), g AS (SELECT r // 2 AS r, c // 2 AS c, max(z) AS z FROM f GROUP BY 1, 2)", 20.0, -10.0, 0.2, "b")
    return f'SELECT "row", col, round(a / 1e4, 6) + 0.0 AS "B04", round(b / 1e4, 6) + 0.0 AS "B11" FROM ({fine}) FULL JOIN ({coarse}) USING ("row", col)'


X0, Y0, CELL = -40000.0, 60000.0, 800.0


def _scene(spark, d):
    g = orders_grid(spark, d)
    bands = {"B04": g, "B08": g.withColumn("z", F.col("z") % 5000), "B02": g.withColumn("z", F.col("z") % 777), "B03": g.withColumn("z", F.col("z") % 1999)}
    return resample.scene_bands(bands, RING, X0, Y0, CELL)


def scene_bands(spark, d):
    return resample.band_subset(_scene(spark, d), ("B02", "B04", "B08")).select("row", "col", *(r(b).alias(b) for b in ("B02", "B04", "B08")))


def _scene_sql() -> str:
    top, left = int((Y0 - max(p[1] for p in RING)) // CELL), int((min(p[0] for p in RING) - X0) // CELL)
    return f"{ORDERS}, h AS (SELECT *, {X0}::DOUBLE + (c + 0.5::DOUBLE) * {CELL} AS x, {Y0}::DOUBLE - (r + 0.5::DOUBLE) * {CELL} AS y FROM g), sc AS (SELECT r - {top} AS r, c - {left} AS c, z / 1e4 AS b04, (z % 5000) / 1e4 AS b08, (z % 777) / 1e4 AS b02, (z % 1999) / 1e4 AS b03 FROM h WHERE {_ring_sql('x', 'y')})"


SCENE = f'WITH {_scene_sql()} SELECT {RC}, round(b02, 6) + 0.0 AS "B02", round(b04, 6) + 0.0 AS "B04", round(b08, 6) + 0.0 AS "B08" FROM sc'


def composite_presets(spark, d):
    """Every preset whose bands the scene has."""
    scene = _scene(spark, d)
    have = {k: v for k, v in PRESETS.items() if set(v) <= set(scene.columns)}
    out = None
    for name, bands in sorted(have.items()):
        one = resample.composite(scene, bands, gamma=1.2).select(F.lit(name).alias("preset"), "row", "col", *(r(c, 5).alias(c) for c in ("red", "green", "blue")))
        out = one if out is None else out.unionByName(one)
    return out


def _composite_sql() -> str:
    shade = lambda b: f"round(pow(least(greatest(({b} - (SELECT quantile_cont({b}, 0.02) FROM sc)) / (SELECT quantile_cont({b}, 0.98) - quantile_cont({b}, 0.02) FROM sc), 0.0), 1.0), 1 / 1.2::DOUBLE), 5) + 0.0"
    each = [f"SELECT '{n}' AS preset, {RC}, {shade(a)} AS red, {shade(b)} AS green, {shade(c)} AS blue FROM sc" for n, a, b, c in (("false_color", "b08", "b04", "b03"), ("true_color", "b04", "b03", "b02"))]
    return f"WITH {_scene_sql()} " + " UNION ALL ".join(each)


def training_set(spark, d):
    p = points(spark, d)
    pos = p.where("label = 1").select("x", "y")
    far = proximity.exclude_near(p.where("label = 0"), pos.select(F.col("x").alias("rx"), F.col("y").alias("ry")), 4000.0, "id").select("x", "y")
    t = sampling.training_set(pos, far, part_grid(spark, d), ["z"], -50000.0, 50000.0, 2000.0)
    return t.select("x", "y", "label", "z")


TRAINING = f"WITH {PART}, {POINTS}, q AS (SELECT x, y, label FROM p a WHERE label = 1 OR NOT EXISTS (SELECT 1 FROM p b WHERE b.label = 1 AND sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= 4000)) SELECT x, y, label, z FROM (SELECT *, floor((50000.0 - y) / 2000)::INT AS r, floor((x + 50000.0) / 2000)::INT AS c FROM q) JOIN g USING (r, c)"


def nodata_sink(spark, d):
    g = part_grid(spark, d).withColumn("z", F.when(F.col("z") % 3 >= 1, F.col("z")))
    return g.select("row", "col", nodata_out("z").alias("z"))


def points_in_bounds(spark, d):
    return points(spark, d).where(in_bounds(F.col("x"), F.col("y"), (-30000.0, -20000.0, 25000.0, 40000.0))).select("id", "x", "y")


def signal_verdict(spark, d):
    return validation.signal_verdict(signal_check(spark, d))


VERDICT = f"WITH q AS ({SIGNAL}) SELECT count(*) FILTER (signal IN ('STRONG', 'MODERATE')) AS n_signals, CASE WHEN count(*) FILTER (signal IN ('STRONG', 'MODERATE')) >= 3 THEN 'PROMISING' WHEN count(*) FILTER (signal IN ('STRONG', 'MODERATE')) >= 1 THEN 'PARTIAL' ELSE 'NO_SIGNAL' END AS verdict FROM q"


def centred_chips(spark, d):
    g = orders_grid(spark, d)
    return resample.centred_chips(g.where("row % 7 = 3 and col % 11 = 5").select("row", "col"), 100, height(g), 12)


CENTRED = f'WITH {ORDERS}, k AS (SELECT r, c, r - 6 AS a, c - 6 AS b, (SELECT max(r) + 1 FROM g) AS h FROM g WHERE r % 7 = 3 AND c % 11 = 5) SELECT {RC}, a AS row_off, b AS col_off, unnest([0, 90, 180, 270]) AS rotation FROM k WHERE a BETWEEN 0 AND h - 12 AND b BETWEEN 0 AND 88'


def block_positives(spark, d):
    b = validation.spatial_blocks(points(spark, d), 10000.0)
    return b.groupBy("block").agg(F.sum("label").cast("long").alias("positives"), r(F.avg("label")).alias("prior"))


def clamped_dates(spark, d):
    day = F.col("o_orderdate").cast("date")
    return table(spark, d, "orders").select("o_orderkey", F.least(day, F.lit(clamp_end("2011-01-01", "1995-06-30")).cast("date")).cast("string").alias("until"))


def projected_bounds(spark, d):
    """Suppliers on a stand-in sphere, both ways through the projection."""
    k = F.col("s_suppkey")
    lon, lat = (k % 340) - 170.0, (k % 160) - 80.0
    x, y = web_mercator(lon, lat)
    back = from_web_mercator(x, y)
    return table(spark, d, "supplier").select("s_suppkey", r(back[0], 7).alias("lon"), r(back[1], 7).alias("lat"))


def bootstrap_rows(spark, d):
    return sampling.bootstrap_rows(table(spark, d, "labels").select("doc_id"), 4, "doc_id").select("doc_id", "replicate", "copies")


def _bootstrap_sql() -> str:
    import math

    totals = [sum(math.exp(-1) / math.factorial(j) for j in range(k + 1)) for k in range(8)]
    copies = " + ".join(f"(u > {t!r}::DOUBLE)::INT" for t in totals)
    return f"WITH f AS (SELECT doc_id, unnest(range(4))::INT AS replicate FROM labels), q AS (SELECT doc_id, replicate, {draw_sql('u', 0, 'doc_id', 'replicate')} FROM f), k AS (SELECT doc_id, replicate, {copies} AS copies FROM q) SELECT * FROM k WHERE copies > 0"


def random_points(spark, d):
    """As many points in the ring as there are suppliers."""
    n = table(spark, d, "supplier").count()
    return sampling.random_points(spark, RING, n).select("id", r("x", 4).alias("x"), r("y", 4).alias("y"))


def _random_points_sql() -> str:
    xs, ys = [p[0] for p in RING], [p[1] for p in RING]
    return f"WITH n AS (SELECT count(*) AS n FROM supplier), k AS (SELECT unnest(range(50 * n)) AS id FROM n), u AS (SELECT id, {draw_sql('u', 42, 'id')}, {draw_sql('v', 43, 'id')} FROM k), p AS (SELECT id, {min(xs)}::DOUBLE + u * {max(xs) - min(xs)} AS x, {min(ys)}::DOUBLE + v * {max(ys) - min(ys)} AS y FROM u) SELECT id, round(x, 4) + 0.0 AS x, round(y, 4) + 0.0 AS y FROM p WHERE {_ring_sql('x', 'y')} ORDER BY id LIMIT (SELECT n FROM n)"


def random_chips(spark, d):
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("tile"), (F.col("n_nationkey") * 7 + 30).alias("width"), (F.col("n_nationkey") * 5 + 25).alias("height"))
    s = table(spark, d, "supplier").select(F.col("s_nationkey").alias("tile"), (F.col("s_suppkey") * 13 % 100).alias("row"), (F.col("s_suppkey") * 29 % 100).alias("col"))
    return resample.random_chips(n, s, 32, 12.0, 20, 60).select("tile", "row_off", "col_off", "attempt")


CHIPS = f"""WITH t AS (SELECT n_nationkey AS tile, n_nationkey * 7 + 30 AS w, n_nationkey * 5 + 25 AS h FROM nation), k AS (SELECT tile, w, h, unnest(range(60))::INT AS attempt FROM t WHERE w >= 32 AND h >= 32), u AS (SELECT *, {draw_sql("u", 42, "1", "tile", "attempt")}, {draw_sql("v", 42, "2", "tile", "attempt")} FROM k),
q AS (SELECT tile, attempt, floor(u * (h - 31))::INT AS row_off, floor(v * (w - 31))::INT AS col_off FROM u), s AS (SELECT s_nationkey AS tile, s_suppkey * 13 % 100 AS r, s_suppkey * 29 % 100 AS c FROM supplier),
f AS (SELECT *, row_number() OVER (PARTITION BY tile ORDER BY attempt) AS i FROM q WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.tile = q.tile AND sqrt((q.row_off + 16 - r) * (q.row_off + 16 - r) + (q.col_off + 16 - c) * (q.col_off + 16 - c)) < 12))
SELECT tile, row_off, col_off, attempt FROM f WHERE i <= 20"""


def granule_pages(spark, d):
    k = F.col("o_orderkey")
    lon, lat = (k % 360) - 180, (F.floor(k / 360) % 160) - 80
    cat = table(spark, d, "orders").select(k.alias("granule_id"), lon.alias("west"), (lon + 1).alias("east"), lat.alias("south"), (lat + 1).alias("north"), F.col("o_orderdate").cast("date").alias("day"), F.col("o_orderstatus").alias("version"))
    return catalog.granule_pages(cat, (-60.0, -40.0, 60.0, 40.0), "1992-01-01", "1998-12-31", "O", 20, 5).select("granule_id", "page")


GRANULES = """SELECT granule_id, ((row_number() OVER (ORDER BY day DESC, granule_id) - 1) // 20 + 1)::INT AS page FROM (SELECT o_orderkey AS granule_id, (o_orderkey % 360) - 180 AS lon, ((o_orderkey // 360) % 160) - 80 AS lat, o_orderdate::DATE AS day FROM orders WHERE o_orderstatus = 'O')
WHERE lon <= 60 AND lon + 1 >= -60 AND lat <= 40 AND lat + 1 >= -40 AND day BETWEEN DATE '1992-01-01' AND DATE '1998-12-31' ORDER BY day DESC, granule_id LIMIT 100"""


QUERIES = {
    "bootstrap_rows": (bootstrap_rows, _bootstrap_sql()),
    "random_points": (random_points, _random_points_sql()),
    "random_chips": (random_chips, CHIPS),
    "granule_pages": (granule_pages, GRANULES),
    "background_sample": (background_sample, BACKGROUND),
    "set_operations": (set_operations, SETS),
    "road_intensity": (road_intensity, ROADS),
    "script_terrain": (script_terrain, SCRIPT),
    "second_differences": (second_differences, SECOND),
    "mosaic_to_mercator": (mosaic_to_mercator, _mosaic_sql()),
    "scene_to_mercator": (scene_to_mercator, _scene_mercator_sql()),
    "drainage_proxy": (drainage_proxy, PROXY),
    "reproject_mercator": (reproject_mercator, REPROJECT),
    "scene_bands": (scene_bands, SCENE),
    "composite_presets": (composite_presets, _composite_sql()),
    "training_set": (training_set, TRAINING),
    "nodata_sink": (nodata_sink, f"WITH {PART} SELECT {RC}, CASE WHEN z % 3 >= 1 THEN z ELSE -9999.0::DOUBLE END AS z FROM g"),
    "points_in_bounds": (points_in_bounds, f"WITH {POINTS} SELECT id, x, y FROM p WHERE x BETWEEN -30000 AND 25000 AND y BETWEEN -20000 AND 40000"),
    "signal_verdict": (signal_verdict, VERDICT),
    "centred_chips": (centred_chips, CENTRED),
    "block_positives": (block_positives, BLOCKS + " SELECT block, sum(label)::BIGINT AS positives, round(avg(label), 6) + 0.0 AS prior FROM b GROUP BY 1"),
    "clamped_dates": (clamped_dates, "SELECT o_orderkey, least(o_orderdate::DATE, DATE '1995-06-30')::VARCHAR AS until FROM orders"),
    "projected_bounds": (projected_bounds, "SELECT s_suppkey, (s_suppkey % 340) - 170.0::DOUBLE AS lon, (s_suppkey % 160) - 80.0::DOUBLE AS lat FROM supplier"),
}
