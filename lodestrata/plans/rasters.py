"""Queries of grids, terrain, hydrology, proximity and zones, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import components, focal, hydrology, lineaments, proximity, resample
from ..sources.config import table
from .common import HORN, NEIGHBOURS, ORDERS, PART, POINTS, SEGMENTS, height, orders_grid, part_grid, points, r, segments

RC = 'r AS "row", c AS col'


def feature_stack_join(spark, d):
    return resample.stack({"price": part_grid(spark, d), "total": orders_grid(spark, d)})


def band_stack_inner(spark, d):
    return resample.stack({"price": part_grid(spark, d), "total": orders_grid(spark, d)}, "inner")


def mosaic_first_valid(spark, d):
    a = part_grid(spark, d).withColumn("z", F.when(F.col("z") % 3 >= 1, F.col("z"))).withColumn("ord", F.lit(0))
    b = part_grid(spark, d).select((F.col("row") + 5).alias("row"), (F.col("col") + 10).alias("col"), "z", F.lit(1).alias("ord"))
    return resample.mosaic(a.unionByName(b))


def bilinear_resample(spark, d):
    g = part_grid(spark, d)
    t = resample.resample(g, 50, height(g), 30.0, 50.0)
    return t.select("row", "col", r("z", 5).alias("z"))


BILINEAR = "WITH " + PART + """, m AS (SELECT 50 AS w, max(r) + 1 AS h FROM g), n AS (SELECT w, h, greatest(1, (w * 30.0 / 50.0)::DOUBLE // 1)::INT AS tw, greatest(1, floor(h * 30.0 / 50.0))::INT AS th FROM m),
t AS (SELECT tr, tc, (tc + 0.5::DOUBLE) * (w / tw::DOUBLE) - 0.5 AS x, (tr + 0.5::DOUBLE) * (h / th::DOUBLE) - 0.5 AS y FROM (SELECT *, unnest(range(tw)) AS tc FROM (SELECT *, unnest(range(th)) AS tr FROM n))),
k AS (SELECT tr, tc, floor(y)::INT + i AS r, floor(x)::INT + j AS c, (CASE WHEN j = 1 THEN x - floor(x) ELSE 1 - (x - floor(x)) END) * (CASE WHEN i = 1 THEN y - floor(y) ELSE 1 - (y - floor(y)) END) AS w FROM t, (SELECT unnest([0, 1]) AS i), (SELECT unnest([0, 1]) AS j))
SELECT tr::INT AS "row", tc::INT AS col, round(sum(w * z) / sum(w), 5) + 0.0 AS z FROM k JOIN g USING (r, c) WHERE w > 0 GROUP BY 1, 2"""


def clip_to_polygon(spark, d):
    from .pixels import RING

    return resample.clip(orders_grid(spark, d), RING, -40000.0, 60000.0, 800.0)


def _clip_sql() -> str:
    from .pixels import RING, _ring_sql

    top, left = int((60000.0 - max(p[1] for p in RING)) // 800), int((min(p[0] for p in RING) + 40000.0) // 800)
    low, right = int((60000.0 - min(p[1] for p in RING)) // 800), int((max(p[0] for p in RING) + 40000.0) // 800)
    return f'WITH {ORDERS}, h AS (SELECT *, -40000.0::DOUBLE + (c + 0.5::DOUBLE) * 800 AS x, 60000.0::DOUBLE - (r + 0.5::DOUBLE) * 800 AS y FROM g) SELECT r - {top} AS "row", c - {left} AS col, z FROM h WHERE r BETWEEN {top} AND {low} AND c BETWEEN {left} AND {right} AND {_ring_sql("x", "y")}'


def point_sample_features(spark, d):
    t = proximity.sample_cells(points(spark, d), part_grid(spark, d), ["z"], -50000.0, 50000.0, 2000.0)
    return t.select("id", "label", "row", "col", "z")


def coordinate_label_fanout(spark, d):
    from ..operators.sampling import label_fanout

    p = points(spark, d).withColumn("x", F.round(F.col("x") / 2000) + 0.0).withColumn("y", F.round(F.col("y") / 2000) + 0.0)
    return label_fanout(p.select("id", "x", "y"), p.select("x", "y", "label"))


def nearest_feature_distance(spark, d):
    g = part_grid(spark, d).withColumn("mark", F.col("z") % 29 < 1)
    return proximity.nearest_marked(g, 30.0, 20.0).select("row", "col", r("distance", 5).alias("distance"))


NEAREST = "WITH " + PART + f""", f AS (SELECT r AS fr, c AS fc FROM g WHERE z % 29 < 1)
SELECT {RC}, round(sqrt(min((c - fc) * 30.0 * (c - fc) * 30.0 + (r - fr) * 20.0 * (r - fr) * 20.0)), 5) + 0.0 AS distance FROM g LEFT JOIN f ON true GROUP BY r, c"""


def _suppliers(spark, d):
    k = F.col("s_suppkey")
    return table(spark, d, "supplier").select((k * 37 % 500 * 3.0).alias("rx"), (k * 91 % 400 * 3.0).alias("ry"))


def _cells(spark, d):
    return part_grid(spark, d).withColumn("x", (F.col("col") + 0.5) * 30.0).withColumn("y", (F.col("row") + 0.5) * 30.0)


def buffered_density(spark, d):
    t = proximity.buffered_counts(_cells(spark, d), _suppliers(spark, d), [50.0, 100.0, 200.0], ["row", "col"])
    return t


BUFFERED = "WITH " + PART + f""", f AS (SELECT s_suppkey * 37 % 500 * 3.0::DOUBLE AS x, s_suppkey * 91 % 400 * 3.0::DOUBLE AS y FROM supplier),
q AS (SELECT r, c, sqrt(((c + 0.5::DOUBLE) * 30 - x) * ((c + 0.5::DOUBLE) * 30 - x) + ((r + 0.5::DOUBLE) * 30 - y) * ((r + 0.5::DOUBLE) * 30 - y)) AS d FROM g, f)
SELECT {RC}, count(*) FILTER (d <= 50) AS within_50, count(*) FILTER (d <= 100) AS within_100, count(*) FILTER (d <= 200) AS within_200 FROM q GROUP BY r, c"""


def lineament_density(spark, d):
    s = segments(spark, d).select(((F.col("ax") + F.col("bx")) / 2).alias("rx"), ((F.col("ay") + F.col("by")) / 2).alias("ry"))
    cells = part_grid(spark, d).withColumn("x", -50000.0 + F.col("col") * 2000.0).withColumn("y", 50000.0 - F.col("row") * 2000.0)
    return proximity.density(cells, s, 5000.0, ["row", "col"]).select("row", "col", r("density").alias("density"))


LINDENS = "WITH " + PART + ", " + SEGMENTS + f""", m AS (SELECT (ax + bx) / 2 AS x, (ay + b_y) / 2 AS y FROM s)
SELECT {RC}, round(count(*) FILTER (sqrt((-50000.0 + c * 2000.0 - x) * (-50000.0 + c * 2000.0 - x) + (50000.0 - r * 2000.0 - y) * (50000.0 - r * 2000.0 - y)) <= 5000) / (pi() * 5000.0 * 5000.0 / 1e6), 6) + 0.0 AS density FROM g, m GROUP BY r, c"""


def segment_intersections(spark, d):
    return proximity.segment_crossings(segments(spark, d), 20000.0, 3)


CROSSINGS = "WITH " + SEGMENTS + """, q AS (SELECT l.id AS a, k.id AS b, l.ax, l.ay, l.bx, l.b_y, k.ax AS cx, k.ay AS cy, k.bx AS dx, k.b_y AS dy FROM s l JOIN s k ON l.id < k.id),
w AS (SELECT *, nullif((bx - ax) * (dy - cy) - (b_y - ay) * (dx - cx), 0) AS det FROM q), t AS (SELECT *, ((cx - ax) * (dy - cy) - (cy - ay) * (dx - cx)) / det AS t, ((cx - ax) * (b_y - ay) - (cy - ay) * (bx - ax)) / det AS u FROM w)
SELECT a, b, round(ax + t * (bx - ax), 3) + 0.0 AS x, round(ay + t * (b_y - ay), 3) + 0.0 AS y FROM t WHERE t BETWEEN 0 AND 1 AND u BETWEEN 0 AND 1"""


def rasterize_points(spark, d):
    return proximity.rasterize_points(points(spark, d), -60000.0, 60000.0, 6000.0)


def rasterize_segments(spark, d):
    return proximity.rasterize_lines(segments(spark, d), -60000.0, 60000.0, 5003.0)


LINES = "WITH " + SEGMENTS + """, q AS (SELECT *, unnest(range(floor((60000.0 - greatest(ay, b_y)) / 5003.0)::INT, floor((60000.0 - least(ay, b_y)) / 5003.0)::INT + 1)) AS r FROM s),
w AS (SELECT *, unnest(range(floor((least(ax, bx) + 60000.0) / 5003.0)::INT, floor((greatest(ax, bx) + 60000.0) / 5003.0)::INT + 1)) AS c FROM q),
k AS (SELECT id, r, c, (bx - ax) * (60000.0 - (r + i) * 5003.0 - ay) - (b_y - ay) * (-60000.0 + (c + j) * 5003.0 - ax) AS v FROM w, (SELECT unnest([0, 1]) AS i), (SELECT unnest([0, 1]) AS j))
SELECT DISTINCT r::INT AS "row", c::INT AS col FROM (SELECT id, r, c FROM k GROUP BY id, r, c HAVING min(v) <= 0 AND max(v) >= 0)"""


def circle_mask(spark, d):
    g = part_grid(spark, d)
    return proximity.circle_mask(g, g.where("row % 17 = 3 and col % 19 = 5"), 4.0)


CIRCLE = f'WITH {PART}, k AS (SELECT r AS cr, c AS cc FROM g WHERE r % 17 = 3 AND c % 19 = 5) SELECT {RC}, coalesce(max((sqrt((r - cr) * (r - cr) + (c - cc) * (c - cc)) <= 4)::INT), 0) AS mask FROM g LEFT JOIN k ON true GROUP BY r, c'


def buffer_exclusion(spark, d):
    p = points(spark, d)
    other = p.where("label = 1").select(F.col("x").alias("rx"), F.col("y").alias("ry"))
    return proximity.exclude_near(p.where("label = 0"), other, 3000.0, "id").select("id", "x", "y")


def tile_assignment(spark, d):
    n = table(spark, d, "nation")
    k = F.col("n_nationkey")
    t = n.select(F.col("n_name").alias("tile"), k.alias("ord"), ((k % 5 - 2.6) * 15000.0).alias("x0"), ((k % 5 - 1.2) * 15000.0).alias("x1"), (F.floor(k / 5) * 15000.0 - 38000.0).alias("y0"), (F.floor(k / 5) * 15000.0 - 18000.0).alias("y1"))
    return proximity.assign_tiles(points(spark, d).select("id", "x", "y"), t).select("id", "tile")


ASSIGN = "WITH " + POINTS + """, t AS (SELECT n_name AS tile, n_nationkey AS o, (n_nationkey % 5 - 2.6::DOUBLE) * 15000 AS x0, (n_nationkey % 5 - 1.2::DOUBLE) * 15000 AS x1, (n_nationkey // 5) * 15000.0::DOUBLE - 38000 AS y0, (n_nationkey // 5) * 15000.0::DOUBLE - 18000 AS y1 FROM nation)
SELECT id, arg_max(tile, o) AS tile FROM p JOIN t ON x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1 GROUP BY id"""


def dedupe_two_sources(spark, d):
    p = points(spark, d).select("id", "x", "y", (F.col("id") % 2 == 1).alias("secondary"))
    return proximity.merge_sources(p, 1500.0).select("id", "secondary")


def _terrain(spark, d):
    return focal.gradient(part_grid(spark, d), 30.0, 30.0)


def horn_gradient(spark, d):
    return _terrain(spark, d).select("row", "col", r("gx").alias("gx"), r("gy").alias("gy"))


def slope(spark, d):
    return _terrain(spark, d).select("row", "col", r(focal.slope()).alias("slope"))


def aspect(spark, d):
    return _terrain(spark, d).select("row", "col", r(focal.aspect(), 5).alias("aspect"))


def curvature(spark, d):
    plan, profile = focal.curvature(30.0, 30.0)
    return _terrain(spark, d).select("row", "col", r(plan).alias("plan_curv"), r(profile).alias("profile_curv"))


def hillshade_multi(spark, d):
    return focal.multi_hillshade(_terrain(spark, d), [45.0 * k for k in range(8)]).select("row", "col", "azimuth", r("shade", 4).alias("shade"))


CURV = "WITH " + PART + ", " + HORN + f""", k AS (SELECT *, gx * gx AS p, gy * gy AS q, (e - 2 * z + w) / 900.0::DOUBLE AS xx, (s - 2 * z + n) / 900.0::DOUBLE AS yy, ((ne - nw) - (se - sw)) / 3600.0::DOUBLE AS xy FROM h)
SELECT {RC}, CASE WHEN p + q > 0 THEN round(-(q * xx - 2 * gx * gy * xy + p * yy) / pow(p + q, 1.5), 6) + 0.0 END AS plan_curv, CASE WHEN p + q > 0 THEN round(-(p * xx + 2 * gx * gy * xy + q * yy) / ((p + q) * sqrt(1 + p + q)), 6) + 0.0 END AS profile_curv FROM k"""
SHADE = "WITH " + PART + ", " + HORN + f""" SELECT {RC}, a::DOUBLE AS azimuth, CASE WHEN gx IS NOT NULL THEN round(least(greatest(sin(radians(45)) * cos(atan(sqrt(gx * gx + gy * gy))) + cos(radians(45)) * sin(atan(sqrt(gx * gx + gy * gy))) * cos(radians(450.0 - a) - atan2(-gy, gx)), 0), 1) * 255, 4) + 0.0 END AS shade FROM h, (SELECT unnest(range(0, 360, 45)) AS a)"""


def central_gradient_variant(spark, d):
    t = focal.central_gradient(part_grid(spark, d), 30.0)
    v = focal.variant_terrain(F.col("gx"), F.col("gy"))
    return t.select("row", "col", r("gx").alias("gx"), r("gy").alias("gy"), r(v["slope"]).alias("slope"))


CENTRAL = "WITH " + PART + f""", k AS (SELECT r, c, nullif(z, 0) AS z FROM g), n AS (SELECT *, lag(z) OVER h AS w, lead(z) OVER h AS e, lag(z) OVER v AS n, lead(z) OVER v AS s, lag(1) OVER h AS hw, lead(1) OVER h AS he, lag(1) OVER v AS hn, lead(1) OVER v AS hs FROM k WINDOW h AS (PARTITION BY r ORDER BY c), v AS (PARTITION BY c ORDER BY r)),
q AS (SELECT r, c, CASE WHEN hw IS NULL THEN (e - z) / 30 WHEN he IS NULL THEN (z - w) / 30 ELSE (e - w) / 60 END AS gx, CASE WHEN hn IS NULL THEN (s - z) / 30 WHEN hs IS NULL THEN (z - n) / 30 ELSE (s - n) / 60 END AS gy FROM n)
SELECT {RC}, round(gx, 6) + 0.0 AS gx, round(gy, 6) + 0.0 AS gy, round(degrees(atan(sqrt(gx * gx + gy * gy))), 6) + 0.0 AS slope FROM q"""


def _sobel(spark, d):
    m = focal.with_neighbours(orders_grid(spark, d)).select("row", "col", focal.sobel().alias("raw"))
    return focal.with_maximum(m, "raw", "top").select("row", "col", (F.col("raw") / F.col("top")).alias("m"))


def sobel_edges(spark, d):
    return _sobel(spark, d).select("row", "col", r("m").alias("m"))


SOBEL = "WITH " + ORDERS + ", " + NEIGHBOURS + """, k AS (SELECT r, c, z, coalesce(nw, n, w, z) AS nw, coalesce(n, z) AS n, coalesce(ne, n, e, z) AS ne, coalesce(w, z) AS w, coalesce(e, z) AS e, coalesce(sw, s, w, z) AS sw, coalesce(s, z) AS s, coalesce(se, s, e, z) AS se FROM n),
m0 AS (SELECT r, c, sqrt(pow((ne + 2 * e + se) - (nw + 2 * w + sw), 2) + pow((sw + 2 * s + se) - (nw + 2 * n + ne), 2)) AS m FROM k), m AS (SELECT r, c, m / (SELECT max(m) FROM m0) AS m FROM m0)"""


def hysteresis(spark, d):
    return focal.hysteresis(_sobel(spark, d), 0.3, 0.5).select("row", "col", "edge")


HYST = SOBEL + """, f AS (SELECT r, c, (m >= 0.5)::INT AS st, (m >= 0.3)::INT AS an FROM m)
SELECT r AS "row", c AS col, CASE WHEN an = 1 AND greatest(st, coalesce(lag(st) OVER h, 0), coalesce(lead(st) OVER h, 0), coalesce(lag(st) OVER v, 0), coalesce(lead(st) OVER v, 0)) = 1 THEN 1 ELSE 0 END AS edge FROM f WINDOW h AS (PARTITION BY r ORDER BY c), v AS (PARTITION BY c ORDER BY r)"""


def box_density_clipped(spark, d):
    return focal.box_mean(orders_grid(spark, d), 3, 3).select("row", "col", r("mean", 5).alias("mean"))


BOX = "WITH " + ORDERS + f""", k AS (SELECT r, c, sum(z) OVER (PARTITION BY r ORDER BY c RANGE BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS s, count(z) OVER (PARTITION BY r ORDER BY c RANGE BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS n FROM g)
SELECT {RC}, round(sum(s) OVER w / sum(n) OVER w, 5) + 0.0 AS mean FROM k WINDOW w AS (PARTITION BY c ORDER BY r RANGE BETWEEN 3 PRECEDING AND 3 FOLLOWING)"""


def box_density_reflect(spark, d):
    g = part_grid(spark, d)
    return focal.box_mean_reflect(g, 50, height(g), 2).select("row", "col", r("mean", 5).alias("mean"))


def _mirror(radius: int) -> str:
    return f"h AS (SELECT max(r) + 1 AS h FROM g), m1 AS (SELECT unnest([r, CASE WHEN r < {radius} THEN -1 - r END, CASE WHEN r >= h - {radius} THEN 2 * h - 1 - r END]) AS r, c, z FROM g, h), m AS (SELECT r, unnest([c, CASE WHEN c < {radius} THEN -1 - c END, CASE WHEN c >= 50 - {radius} THEN 99 - c END]) AS c, z FROM m1 WHERE r IS NOT NULL)"


REFLECT = f"WITH {PART}, {_mirror(2)}, k AS (SELECT r, c, avg(z) OVER (PARTITION BY r ORDER BY c RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS s FROM m WHERE c IS NOT NULL), q AS (SELECT r, c, avg(s) OVER (PARTITION BY c ORDER BY r RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS v FROM k) SELECT {RC}, round(v, 5) + 0.0 AS mean FROM q, h WHERE r BETWEEN 0 AND h - 1 AND c BETWEEN 0 AND 49"


def gaussian_smooth(spark, d):
    g = part_grid(spark, d)
    return focal.gaussian(g, 50, height(g), 0.8).select("row", "col", r("smooth", 5).alias("smooth"))


def _gauss_sql() -> str:
    w = focal.gaussian_weights(0.8)
    n = len(w) // 2
    fold = lambda v, o: " + ".join(f"coalesce({'lag' if k < 0 else 'lead'}({v}, {abs(k)}) OVER {o}, 0) * {w[k + n]!r}::DOUBLE" for k in range(-n, n + 1))
    return f"WITH {PART}, {_mirror(n)}, k AS (SELECT r, c, {fold('z', 'o')} AS s FROM m WHERE c IS NOT NULL WINDOW o AS (PARTITION BY r ORDER BY c)), q AS (SELECT r, c, {fold('s', 'o')} AS v FROM k WINDOW o AS (PARTITION BY c ORDER BY r)) SELECT {RC}, round(v, 5) + 0.0 AS smooth FROM q, h WHERE r BETWEEN 0 AND h - 1 AND c BETWEEN 0 AND 49"


def d8_direction(spark, d):
    return hydrology.d8(part_grid(spark, d)).select("row", "col", "direction")


D8 = "WITH " + PART + ", " + NEIGHBOURS + f""", k AS (SELECT r, c, [(z - nw) / sqrt(2.0), z - n, (z - ne) / sqrt(2.0), z - w, z - e, (z - sw) / sqrt(2.0), z - s, (z - se) / sqrt(2.0)] AS a FROM n),
q AS (SELECT r, c, a, list_max(a) AS top FROM k) SELECT {RC}, CASE WHEN top > 0 THEN (list_position(a, top) - 1)::INT END AS direction FROM q"""


def _valley(spark, d):
    return part_grid(spark, d).withColumn("z", F.col("z") + 40.0 * F.abs(F.col("col") - 25) + 30.0 * F.col("row"))


def sink_fill(spark, d):
    return hydrology.fill_sinks(_valley(spark, d)).select("row", "col", r("z", 4).alias("z"))


def flow_accumulation(spark, d):
    return hydrology.accumulation(hydrology.d8(_valley(spark, d))).select("row", "col", "acc")


VALLEY = PART.replace("p_retailprice AS z", "p_retailprice + 40.0 * abs(p_partkey % 50 - 25) + 30.0 * (p_partkey // 50) AS z")
FLOW = "WITH RECURSIVE " + VALLEY + ", " + NEIGHBOURS + """, k AS (SELECT r, c, [(z - nw) / sqrt(2.0), z - n, (z - ne) / sqrt(2.0), z - w, z - e, (z - sw) / sqrt(2.0), z - s, (z - se) / sqrt(2.0)] AS a FROM n),
q AS (SELECT r, c, CASE WHEN list_max(a) > 0 THEN list_position(a, list_max(a)) END AS i FROM k), t AS (SELECT r, c, r + [-1, -1, -1, 0, 0, 1, 1, 1][i] AS tr, c + [-1, 0, 1, -1, 1, -1, 0, 1][i] AS tc FROM q),
w AS (SELECT r, c, r AS ar, c AS ac FROM t UNION ALL SELECT w.r, w.c, t.tr, t.tc FROM w JOIN t ON t.r = w.ar AND t.c = w.ac WHERE t.tr IS NOT NULL)
SELECT ar::INT AS "row", ac::INT AS col, count(*) AS acc FROM w GROUP BY 1, 2"""


_ROUNDS = 30
_FILL = VALLEY.replace("g AS", "v AS", 1) + ", f AS (SELECT 0 AS k, r, c, z FROM v UNION ALL SELECT k + 1, r, c, CASE WHEN z < low THEN low ELSE z END FROM (SELECT a.k, a.r, a.c, a.z, least(" + ", ".join(f"coalesce(n{i}.z, 1e30)" for i in range(8)) + ") AS low FROM f a " + " ".join(f"LEFT JOIN f n{i} ON n{i}.r = a.r + {x} AND n{i}.c = a.c + {y}" for i, (x, y) in enumerate(hydrology.OFFSETS)) + f") WHERE k < {_ROUNDS})"
FILLED = f'WITH RECURSIVE {_FILL} SELECT {RC}, round(z, 4) + 0.0 AS z FROM f WHERE k = {_ROUNDS}'
DRAINAGE = FLOW.replace(VALLEY, f"{_FILL}, g AS (SELECT r, c, z FROM f WHERE k = {_ROUNDS})", 1).replace('SELECT ar::INT AS "row", ac::INT AS col, count(*) AS acc FROM w GROUP BY 1, 2', """, a AS (SELECT ar AS r, ac AS c, (count(*) >= 20)::INT::DOUBLE AS s FROM w GROUP BY 1, 2), x AS (SELECT r, c, sum(s) OVER o AS s, count(s) OVER o AS n FROM a WINDOW o AS (PARTITION BY r ORDER BY c RANGE BETWEEN 5 PRECEDING AND 5 FOLLOWING)), y AS (SELECT r, c, sum(s) OVER o / sum(n) OVER o AS density FROM x WINDOW o AS (PARTITION BY c ORDER BY r RANGE BETWEEN 5 PRECEDING AND 5 FOLLOWING)) SELECT r::INT AS "row", c::INT AS col, round(density, 6) + 0.0 AS density FROM y""")


def drainage_density(spark, d):
    return hydrology.drainage_density(_valley(spark, d), 20, 5).select("row", "col", r("density").alias("density"))


def _zones(spark, d):
    return orders_grid(spark, d).withColumn("prob", F.col("z") / 5000.0).withColumn("unc", F.col("z") % 7)


def connected_components(spark, d):
    return components.connected_cells(_zones(spark, d).where("prob >= 70").select("row", "col"), 100)


CC = "WITH RECURSIVE " + ORDERS + """, k AS (SELECT r * 100 + c AS id, r, c, z FROM g WHERE z / 5000.0 >= 70), e AS (SELECT a.id AS a, b.id AS b FROM k a JOIN k b ON (a.r = b.r AND abs(a.c - b.c) = 1) OR (a.c = b.c AND abs(a.r - b.r) = 1)),
w AS (SELECT id, id AS to_id FROM k UNION SELECT w.id, e.b FROM w JOIN e ON e.a = w.to_id), l AS (SELECT id, min(to_id)::BIGINT AS component FROM w GROUP BY id)"""
CONNECTED = CC + ' SELECT r AS "row", c AS col, component FROM k JOIN l USING (id)'


def cluster_targets(spark, d):
    return components.target_zones(_zones(spark, d), 100, 70.0, 300.0, 0.25, 0.0, 0.0, "unc")


TARGETS = CC + """, z AS (SELECT component, count(*) AS n_cells, round_even(count(*) * 0.09::DOUBLE, 2) AS area_km2, round_even(avg(z / 5000.0), 1) AS mean_probability, round_even(avg(z % 7), 1) AS mean_uncertainty, round_even((avg(c) + 0.5) * 300, 5) AS centroid_x, round_even(-(avg(r) + 0.5) * 300, 5) AS centroid_y FROM k JOIN l USING (id) GROUP BY component HAVING count(*) * 0.09::DOUBLE >= 0.25)
SELECT row_number() OVER (ORDER BY mean_probability DESC, component)::INT AS zone_rank, * FROM z"""


def zone_outlines(spark, d):
    return components.zone_outlines(connected_components(spark, d), 0.0, 0.0, 300.0)


OUTLINES = CC + """, k2 AS (SELECT r, c, component FROM k JOIN l USING (id)), s AS (SELECT r, c, component, unnest([{'dr': -1, 'dc': 0, 'ar': 0, 'ac': 0, 'br': 0, 'bc': 1}, {'dr': 0, 'dc': 1, 'ar': 0, 'ac': 1, 'br': 1, 'bc': 1}, {'dr': 1, 'dc': 0, 'ar': 1, 'ac': 1, 'br': 1, 'bc': 0}, {'dr': 0, 'dc': -1, 'ar': 1, 'ac': 0, 'br': 0, 'bc': 0}]) AS s FROM k2)
SELECT s.component, (s.c + s.s.ac) * 300.0::DOUBLE AS ax, -(s.r + s.s.ar) * 300.0::DOUBLE AS ay, (s.c + s.s.bc) * 300.0::DOUBLE AS bx, -(s.r + s.s.br) * 300.0::DOUBLE AS by FROM s WHERE NOT EXISTS (SELECT 1 FROM k2 WHERE k2.component = s.component AND k2.r = s.r + s.s.dr AND k2.c = s.c + s.s.dc)"""


def hough_lineaments(spark, d):
    g = part_grid(spark, d)
    e = lineaments.edges(g, 50, height(g), 1.5, 0.3, 0.5).where("edge = 1").select("row", "col")
    return lineaments.hough_lines(e, 90, 12, 8.0, 4.0)


QUERIES = {
    "feature_stack_join": (feature_stack_join, f'WITH {PART}, o AS (SELECT (o_orderkey // 100)::INT AS r, (o_orderkey % 100)::INT AS c, o_totalprice AS z FROM orders) SELECT r AS "row", c AS col, g.z AS price, o.z AS total FROM g FULL JOIN o USING (r, c)'),
    "band_stack_inner": (band_stack_inner, f'WITH {PART}, o AS (SELECT (o_orderkey // 100)::INT AS r, (o_orderkey % 100)::INT AS c, o_totalprice AS z FROM orders) SELECT r AS "row", c AS col, g.z AS price, o.z AS total FROM g JOIN o USING (r, c)'),
    "mosaic_first_valid": (mosaic_first_valid, f'WITH {PART}, u AS (SELECT r, c, CASE WHEN z % 3 >= 1 THEN z END AS z, 0 AS o FROM g UNION ALL SELECT r + 5, c + 10, z, 1 FROM g) SELECT {RC}, arg_min(z, o) AS z FROM u WHERE z IS NOT NULL GROUP BY r, c'),
    "bilinear_resample": (bilinear_resample, BILINEAR),
    "clip_to_polygon": (clip_to_polygon, _clip_sql()),
    "point_sample_features": (point_sample_features, f'WITH {PART}, {POINTS} SELECT id, label, {RC}, z FROM (SELECT id, label, floor((50000.0 - y) / 2000)::INT AS r, floor((x + 50000.0) / 2000)::INT AS c FROM p) JOIN g USING (r, c)'),
    "coordinate_label_fanout": (coordinate_label_fanout, f"WITH {POINTS}, q AS (SELECT id, round(x / 2000) + 0.0 AS x, round(y / 2000) + 0.0 AS y, label FROM p) SELECT a.id, a.x, a.y, b.label FROM q a JOIN q b ON a.x = b.x AND a.y = b.y"),
    "nearest_feature_distance": (nearest_feature_distance, NEAREST),
    "buffered_density": (buffered_density, BUFFERED),
    "lineament_density": (lineament_density, LINDENS),
    "segment_intersections": (segment_intersections, CROSSINGS),
    "rasterize_points": (rasterize_points, f'WITH {POINTS} SELECT floor((60000.0 - y) / 6000)::INT AS "row", floor((x + 60000.0) / 6000)::INT AS col, count(*) AS n FROM p GROUP BY 1, 2'),
    "rasterize_segments": (rasterize_segments, LINES),
    "circle_mask": (circle_mask, CIRCLE),
    "buffer_exclusion": (buffer_exclusion, f"WITH {POINTS} SELECT id, x, y FROM p a WHERE label = 0 AND NOT EXISTS (SELECT 1 FROM p b WHERE b.label = 1 AND sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= 3000)"),
    "tile_assignment": (tile_assignment, ASSIGN),
    "dedupe_two_sources": (dedupe_two_sources, None),
    "horn_gradient": (horn_gradient, f"WITH {PART}, {HORN} SELECT {RC}, CASE WHEN gx IS NOT NULL AND gy IS NOT NULL THEN round(gx, 6) + 0.0 END AS gx, CASE WHEN gx IS NOT NULL AND gy IS NOT NULL THEN round(gy, 6) + 0.0 END AS gy FROM h"),
    "slope": (slope, f"WITH {PART}, {HORN} SELECT {RC}, round(degrees(atan(sqrt(gx * gx + gy * gy))), 6) + 0.0 AS slope FROM h"),
    "aspect": (aspect, f"WITH {PART}, {HORN}, k AS (SELECT *, (90 - degrees(atan2(-gy, gx))) AS a FROM h) SELECT {RC}, CASE WHEN gx = 0 AND gy = 0 THEN -1.0 WHEN gx IS NOT NULL THEN round(((a % 360) + 360) % 360, 5) + 0.0 END AS aspect FROM k"),
    "curvature": (curvature, CURV),
    "hillshade_multi": (hillshade_multi, SHADE),
    "central_gradient_variant": (central_gradient_variant, CENTRAL),
    "sobel_edges": (sobel_edges, SOBEL + ' SELECT r AS "row", c AS col, round(m, 6) + 0.0 AS m FROM m'),
    "hysteresis": (hysteresis, HYST),
    "box_density_clipped": (box_density_clipped, BOX),
    "box_density_reflect": (box_density_reflect, REFLECT),
    "gaussian_smooth": (gaussian_smooth, _gauss_sql()),
    "d8_direction": (d8_direction, D8),
    "sink_fill": (sink_fill, FILLED),
    "flow_accumulation": (flow_accumulation, FLOW),
    "drainage_density": (drainage_density, DRAINAGE),
    "connected_components": (connected_components, CONNECTED),
    "cluster_targets": (cluster_targets, TARGETS),
    "zone_outlines": (zone_outlines, OUTLINES),
    "hough_lineaments": (hough_lineaments, None),
}
