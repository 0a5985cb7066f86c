"""Queries of map algebra, catalogues and sources, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import mapalgebra as m
from ..functions.geometry import cell_of, centre_of, in_polygon
from ..operators import resample, validation
from ..operators.quantiles import grouped_quantiles
from ..sources import catalog, reports, vector
from ..sources.config import table
from .common import ORDERS, PART, POINTS, orders_grid, part_grid, points, r, segments

BANDS = {"B02": "l_tax", "B04": "l_discount", "B08": "l_quantity", "B8A": "l_quantity", "B11": "l_extendedprice", "B12": "l_tax", "B05": "l_extendedprice", "B07": "l_discount", "B10": "l_tax", "B13": "l_quantity", "B14": "l_discount"}
KEY = ("l_orderkey", "l_linenumber")


def _bands() -> dict:
    return {b: F.col(c) for b, c in BANDS.items()}


def safe_ratio_bands(spark, d):
    ratios = m.indices({k: v for k, v in (m.SCENE_INDICES | m.THERMAL_INDICES).items() if v[0] is m.safe_ratio}, _bands())
    return table(spark, d, "lineitem").select(*KEY, *ratios)


def normalized_diff_bands(spark, d):
    diffs = m.indices({k: v for k, v in m.SCENE_INDICES.items() if v[0] is m.normalized_diff}, _bands())
    t = table(spark, d, "lineitem").select(*KEY, *diffs)
    return t.select(*KEY, *(r(c).alias(c) for c in t.columns if c not in KEY))


def _sql_ratio(kind) -> str:
    out = []
    for name, (f, a, b) in (m.SCENE_INDICES | m.THERMAL_INDICES).items():
        if f is kind:
            a, b = BANDS[a], BANDS[b]
            e = f"{a} / nullif({b}, 0)" if kind is m.safe_ratio else f"({a} - {b}) / nullif({a} + {b}, 0)"
            out.append(f"{e} AS {name}" if kind is m.safe_ratio else f"round({e}, 6) + 0.0 AS {name}")
    return f"SELECT l_orderkey, l_linenumber, {', '.join(out)} FROM lineitem"


def clamped_ratio_clip(spark, d):
    """Some numerators and denominators are missing."""
    return table(spark, d, "lineitem").select(*KEY, r(m.clamped_ratio(F.nullif("l_discount", F.lit(0.05)), F.nullif("l_tax", F.lit(0.02)))).alias("clamped"))


def band_standardize(spark, d):
    t = table(spark, d, "lineitem")
    return t.select(*KEY, *(r(m.standardize(m.reflectance(F.col(c)), m.CHIP_MEANS[i] / 1e4, m.CHIP_STDS[i] / 1e4)).alias(f"z_{c[2:]}") for i, c in enumerate(("l_quantity", "l_extendedprice"))))


def tile_zscore(spark, d):
    t = validation.tile_zscore(table(spark, d, "customer"), "c_mktsegment", "c_acctbal")
    return t.select("c_custkey", "c_mktsegment", r("z").alias("z"))


def percentile_stretch_rgb(spark, d):
    t = table(spark, d, "lineitem")
    bands = ("l_quantity", "l_extendedprice", "l_tax")
    cut = grouped_quantiles(t, "l_returnflag", list(bands), [0.02, 0.98])
    cut = cut.select("l_returnflag", *(F.col(c)[i].alias(f"{n}_{c}") for c in bands for i, n in enumerate(("lo", "hi"))))
    j = t.join(F.broadcast(cut), "l_returnflag")  # one row a flag
    shades = j.groupBy("l_returnflag").agg(*(r(F.avg(m.stretch(F.col(c), F.col(f"lo_{c}"), F.col(f"hi_{c}"), 1.2))).alias(f"mean_{c[2:]}") for c in bands), F.count("*").alias("n"))
    return shades


STRETCH = """WITH q AS (SELECT l_returnflag, {cuts} FROM lineitem GROUP BY 1)
SELECT l_returnflag, {means}, count(*) AS n FROM lineitem JOIN q USING (l_returnflag) GROUP BY 1"""
_B = ("l_quantity", "l_extendedprice", "l_tax")
STRETCH = STRETCH.format(
    cuts=", ".join(f"quantile_cont({c}, 0.02) AS lo_{c}, quantile_cont({c}, 0.98) AS hi_{c}" for c in _B),
    means=", ".join(f"round(avg(pow(CASE WHEN hi_{c} <= lo_{c} THEN 0.0 ELSE least(greatest(({c} - lo_{c}) / (hi_{c} - lo_{c}), 0.0), 1.0) END, 1 / 1.2::DOUBLE)), 6) + 0.0 AS mean_{c[2:]}" for c in _B),
)


def minmax_intensity(spark, d):
    g = part_grid(spark, d)
    b = g.agg(F.min("z").alias("lo"), F.max("z").alias("hi"))
    return g.crossJoin(F.broadcast(b)).select("row", "col", r(m.min_max(F.col("z"), F.col("lo"), F.col("hi"))).alias("v"))


def line_azimuth_length(spark, d):
    s = segments(spark, d)
    dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    t = s.select("id", m.azimuth(dx, dy).alias("az"), m.length(dx, dy).alias("len")).where("len >= 5000")
    return t.select("id", r("az", 5).alias("azimuth"), r("len", 4).alias("length_m"))


def qgis_ramp_stops(spark, d):
    b = table(spark, d, "orders").agg(F.min("o_totalprice").alias("vmin"), F.max("o_totalprice").alias("vmax"))
    return reports.ramp_stops(b).select("stop", r("value", 4).alias("value"))


def cmap_guess(spark, d):
    named = F.concat_ws("_", F.element_at(F.array(*(F.lit(k) for k, _ in m.COLOUR_MAPS), F.lit("other")), (F.col("p_partkey") % 11 + 1).cast("int")), "p_type")
    return table(spark, d, "part").select("p_partkey", m.guess_colour_map(named).alias("cmap"))


def _cmap_sql() -> str:
    names = ", ".join(f"'{k}'" for k, _ in m.COLOUR_MAPS)
    cases = " ".join(f"WHEN contains(lower(nm), '{k}') THEN '{v}'" for k, v in m.COLOUR_MAPS)
    return f"SELECT p_partkey, CASE {cases} ELSE 'viridis' END AS cmap FROM (SELECT p_partkey, [{names}, 'other'][(p_partkey % 11 + 1)::INT] || '_' || p_type AS nm FROM part)"


X0, Y0, CELL = -60000.0, 60000.0, 2500.0
RING = [(-20000.0, -20000.0), (30000.0, -10000.0), (10000.0, 5000.0), (25000.0, 30000.0), (-15000.0, 25000.0)]


def affine_cell_lookup(spark, d):
    row, col = cell_of(F.col("x"), F.col("y"), X0, Y0, CELL)
    x, y = centre_of(row, col, X0, Y0, CELL)
    return points(spark, d).select("id", row.alias("row"), col.alias("col"), r(x, 3).alias("cx"), r(y, 3).alias("cy"))


def polygon_filter(spark, d):
    g = orders_grid(spark, d)
    x, y = centre_of(F.col("row"), F.col("col"), -40000.0, 60000.0, 800.0)
    return g.where(in_polygon(x, y, RING)).select("row", "col", "z")


def _ring_sql(x: str, y: str) -> str:
    return "(" + " + ".join(f"CASE WHEN (({y}) < {ay}) <> (({y}) < {by}) AND ({x}) < ({bx} - {ax}) * (({y}) - ({ay})) / ({by} - ({ay})) + ({ax}) THEN 1 ELSE 0 END" for (ax, ay), (bx, by) in zip(RING, RING[1:] + RING[:1], strict=True) if ay != by) + ") % 2 = 1"


def valid_fraction_chips(spark, d):
    from .common import height

    g = orders_grid(spark, d).withColumn("a", F.col("z") - 250000).withColumn("b", F.col("z") - 50000)
    t = resample.valid_fraction(resample.chips(g, 100, height(g), 10, 5), ["a", "b"], 0.6)
    return t.select("row_off", "col_off", r("valid").alias("valid"), "cells")


CHIPS = "WITH " + ORDERS + """, w AS (SELECT max(r) + 1 AS h FROM g),
o AS (SELECT ro, co FROM (SELECT unnest(range(0, 95, 5)) AS co), (SELECT unnest(range(0, (SELECT h FROM w) - 9, 5)) AS ro) WHERE co <= 90)
SELECT ro::INT AS row_off, co::INT AS col_off, round((avg((z > 250000)::INT) + avg((z > 50000)::INT)) / 2, 6) + 0.0 AS valid, count(*) AS cells
FROM g JOIN o ON r BETWEEN ro AND ro + 9 AND c BETWEEN co AND co + 9 GROUP BY 1, 2 HAVING (avg((z > 250000)::INT) + avg((z > 50000)::INT)) / 2 >= 0.6"""


def scene_search(spark, d):
    o = table(spark, d, "orders")
    k = F.col("o_orderkey")
    lon, lat = (k % 360) - 180, (F.floor(k / 360) % 160) - 80
    cat = o.select(k.alias("scene_id"), lon.alias("west"), (lon + 1).alias("east"), lat.alias("south"), (lat + 1).alias("north"), F.col("o_orderdate").cast("date").alias("day"), F.when(k % 13 != 0, F.col("o_totalprice") % 100).alias("cloud"))
    t = catalog.search_scenes(cat, (-60.0, -40.0, 60.0, 40.0), "1994-01-01", "1997-12-31", 100.0)
    return t.select("scene_id", r(F.coalesce("cloud", F.lit(100.0)), 4).alias("cloud"))


SCENES = """SELECT scene_id, round(coalesce(cloud, 100.0), 4) + 0.0 AS cloud FROM (SELECT o_orderkey AS scene_id, (o_orderkey % 360) - 180 AS lon, ((o_orderkey // 360) % 160) - 80 AS lat, o_orderdate::DATE AS d,
CASE WHEN o_orderkey % 13 <> 0 THEN o_totalprice % 100 END AS cloud FROM orders)
WHERE lon <= 60 AND lon + 1 >= -60 AND lat <= 40 AND lat + 1 >= -40 AND d BETWEEN DATE '1994-01-01' AND DATE '1997-12-31' AND coalesce(cloud, 100.0) <= 100 ORDER BY coalesce(cloud, 100.0), scene_id LIMIT 100"""


def asset_links(spark, d):
    p = table(spark, d, "pages")
    rel = F.element_at(F.array(F.lit("http://x/data#"), F.lit("enclosure"), F.lit("browse")), (F.col("page_id") % 3 + 1).cast("int"))
    links = F.array(F.struct(F.col("url").alias("href"), rel.alias("rel")), F.struct(F.concat("url", F.lit(".xml")).alias("href"), F.lit("http://x/data#").alias("rel")))
    return p.select("page_id", F.explode(catalog.data_links(links)).alias("url")).select("page_id", catalog.file_name(F.col("url")).alias("file"))


LINKS = r"""SELECT page_id, list_last(string_split(string_split(url, '?')[1], '/')) AS file FROM
(SELECT page_id, url, ['http://x/data#', 'enclosure', 'browse'][(page_id % 3 + 1)::INT] AS rel FROM pages UNION ALL SELECT page_id, url || '.xml', 'http://x/data#' FROM pages)
WHERE starts_with(url, 'http') AND (suffix(rel, 'data#') OR suffix(rel, 'enclosure')) AND NOT regexp_matches(url, '(?i)\.(xml|jpg|png)$')"""


def tile_names(spark, d):
    k = F.col("n_nationkey")
    box = table(spark, d, "nation").select("n_nationkey", (k * 13 % 170 - 85.5).alias("west"), (k * 13 % 170 - 83.7).alias("east"), (k * 7 % 90 - 45.2).alias("south"), (k * 7 % 90 - 44.1).alias("north"))
    return catalog.tile_names(box).select("n_nationkey", "tile")


TILES = """SELECT n_nationkey, format('{}{:02d}{}{:03d}', CASE WHEN lat >= 0 THEN 'N' ELSE 'S' END, abs(lat), CASE WHEN lon >= 0 THEN 'E' ELSE 'W' END, abs(lon)) AS tile FROM
(SELECT n_nationkey, lat, unnest(range(floor(n_nationkey * 13 % 170 - 85.5)::INT, floor(n_nationkey * 13 % 170 - 83.7)::INT + 1)) AS lon FROM
(SELECT n_nationkey, unnest(range(floor(n_nationkey * 7 % 90 - 45.2)::INT, floor(n_nationkey * 7 % 90 - 44.1)::INT + 1)) AS lat FROM nation))"""


def geojson_explode(spark, d):
    e = table(spark, d, "events")
    made = F.format_string('{"features":[{"geometry":{"type":"Point","coordinates":[%d,%d]},"properties":%s},{"geometry":{"type":"Line","coordinates":[]},"properties":{"k":"1"}}]}', F.col("event_id") % 90, F.col("user_id") % 45, "props")
    schema = "struct<features: array<struct<geometry: struct<type: string, coordinates: array<double>>, properties: map<string, string>>>>"
    f = e.select("event_id", F.explode(F.from_json(made, schema)["features"]).alias("f"))
    xy = F.when(F.col("f.geometry.type") == "Point", F.col("f.geometry.coordinates"))
    return f.select("event_id", F.col("f.geometry.type").alias("kind"), F.try_element_at(xy, F.lit(1)).alias("x"), F.try_element_at(xy, F.lit(2)).alias("y"), vector.first_value(F.col("f.properties"), "k").alias("k"))


GEOJSON = """SELECT event_id, 'Point' AS kind, (event_id % 90)::DOUBLE AS x, (user_id % 45)::DOUBLE AS y, props->>'k' AS k FROM events
UNION ALL SELECT event_id, 'Line', NULL, NULL, '1' FROM events"""


def commodity_filter(spark, d):
    p = table(spark, d, "part").withColumn("kind", F.when(F.col("p_partkey") % 7 != 0, F.col("p_type")))
    return vector.commodity_filter(p, ["brass", "copper", "promo"], "kind").select("p_partkey", "kind")


def asset_key_lookup(spark, d):
    k = F.col("p_partkey") % 3
    assets = F.when(k == 0, F.create_map(F.lit("B04"), "p_name")).when(k == 1, F.create_map(F.lit("b04"), "p_name")).otherwise(F.create_map(F.lit("x_B04_10m"), "p_name", F.lit("B08"), "p_brand"))
    return table(spark, d, "part").select("p_partkey", catalog.asset_key(assets, "B04").alias("asset"))


def search_fallback(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    return catalog.with_fallback(o.where("o_orderstatus = 'absent'"), o)


def chip_rotations(spark, d):
    g = part_grid(spark, d).withColumn("quarter", F.explode(F.expr("array(0, 1, 2, 3)")))
    rr, cc = m.rotate_cell(F.col("row") % 8, F.col("col") % 8, 8, F.col("quarter"))
    chip = lambda c: F.floor(F.col(c) / 8).cast("int")
    return g.select(chip("row").alias("chip_row"), chip("col").alias("chip_col"), "quarter", rr.alias("row"), cc.alias("col"), "z")


def valid_signal_filter(spark, d):
    v = F.try_divide(F.col("l_discount"), F.col("l_tax")) * 20
    return table(spark, d, "lineitem").select(*KEY, v.alias("v")).where(m.valid_signal(F.col("v"))).select(*KEY, r("v").alias("v"))


def mercator_points(spark, d):
    from ..functions.geometry import from_utm, utm, web_mercator

    k = F.col("vec_id")
    lon, lat = 27.0 + (k % 60) / 10.0, -20.0 + (k % 37) / 10.0
    mx, my = web_mercator(lon, lat)
    ux, uy = utm(lon, lat, 36, True)
    blon, blat = from_utm(ux, uy, 36, True)
    back = F.abs(blon - lon) + F.abs(blat - lat) < 1e-7
    return table(spark, d, "embeddings").select("vec_id", *(r(c, 2).alias(n) for c, n in ((mx, "mx"), (my, "my"), (ux, "ux"), (uy, "uy"))), back.alias("round_trip"))


def _mercator_sql() -> str:
    """Both projections; the transverse one by the Krueger series, written out from its constants."""
    from ..functions.geometry import _A, _ALPHA, _K0, _N

    e = 2 * _N**0.5 / (1 + _N)
    waves = lambda a, b: "".join(f" + {c!r}::DOUBLE * {a}({2 * j} * xi) * {b}({2 * j} * eta)" for j, c in enumerate(_ALPHA, 1))
    return f"""WITH p AS (SELECT vec_id, 27.0::DOUBLE + (vec_id % 60) / 10.0::DOUBLE AS lon, -20.0::DOUBLE + (vec_id % 37) / 10.0::DOUBLE AS lat FROM embeddings),
t AS (SELECT *, sinh(atanh(sin(radians(lat))) - {e!r}::DOUBLE * atanh({e!r}::DOUBLE * sin(radians(lat)))) AS t, radians(lon - 33) AS d FROM p), q AS (SELECT *, atan2(t, cos(d)) AS xi, atanh(sin(d) / sqrt(1 + t * t)) AS eta FROM t)
SELECT vec_id, round(radians(lon) * 6378137.0, 2) + 0.0 AS mx, round(ln(tan(pi() / 4 + radians(lat) / 2)) * 6378137.0, 2) + 0.0 AS my, round(500000 + {_K0 * _A!r}::DOUBLE * (eta{waves("cos", "sinh")}), 2) + 0.0 AS ux,
  round(10000000 + {_K0 * _A!r}::DOUBLE * (xi{waves("sin", "cosh")}), 2) + 0.0 AS uy, true AS round_trip FROM q"""


MERCATOR = _mercator_sql()

LOOKUP = f"""WITH {POINTS}, q AS (SELECT id, floor(({Y0} - y) / {CELL})::INT AS r, floor((x - ({X0})) / {CELL})::INT AS c FROM p)
SELECT id, r AS "row", c AS col, round({X0} + (c + 0.5) * {CELL}, 3) + 0.0 AS cx, round({Y0} - (r + 0.5) * {CELL}, 3) + 0.0 AS cy FROM q"""

QUERIES = {
    "safe_ratio_bands": (safe_ratio_bands, _sql_ratio(m.safe_ratio)),
    "normalized_diff_bands": (normalized_diff_bands, _sql_ratio(m.normalized_diff)),
    "clamped_ratio_clip": (clamped_ratio_clip, "SELECT l_orderkey, l_linenumber, CASE WHEN l_discount <> 0.05 THEN round(least(greatest(l_discount / CASE WHEN l_tax > 0 AND l_tax <> 0.02 THEN l_tax ELSE 1e-6 END, -10.0), 10.0), 6) + 0.0 END AS clamped FROM lineitem"),
    "band_standardize": (band_standardize, f"SELECT l_orderkey, l_linenumber, round((l_quantity / 10000.0::DOUBLE - {m.CHIP_MEANS[0]}::DOUBLE / 1e4) / ({m.CHIP_STDS[0]}::DOUBLE / 1e4), 6) + 0.0 AS z_quantity, round((l_extendedprice / 10000.0::DOUBLE - {m.CHIP_MEANS[1]}::DOUBLE / 1e4) / ({m.CHIP_STDS[1]}::DOUBLE / 1e4), 6) + 0.0 AS z_extendedprice FROM lineitem"),
    "tile_zscore": (tile_zscore, "SELECT c_custkey, c_mktsegment, round((c_acctbal - avg(c_acctbal) OVER w) / nullif(stddev_pop(c_acctbal) OVER w, 0), 6) + 0.0 AS z FROM customer WINDOW w AS (PARTITION BY c_mktsegment)"),
    "percentile_stretch_rgb": (percentile_stretch_rgb, STRETCH),
    "minmax_intensity": (minmax_intensity, f'WITH {PART} SELECT r AS "row", c AS col, round((z - (SELECT min(z) FROM g)) / (SELECT max(z) - min(z) FROM g), 6) + 0.0 AS v FROM g'),
    "line_azimuth_length": (line_azimuth_length, "WITH " + POINTS + ", s AS (SELECT a.id, b.x - a.x AS dx, b.y - a.y AS dy FROM p a JOIN p b ON b.id = a.id + 1), t AS (SELECT id, ((degrees(atan2(dx, dy)) % 360) + 360) % 360 AS a, sqrt(dx * dx + dy * dy) AS l FROM s) SELECT id, round(CASE WHEN a >= 180 THEN a - 180 ELSE a END, 5) + 0.0 AS azimuth, round(l, 4) + 0.0 AS length_m FROM t WHERE l >= 5000"),
    "qgis_ramp_stops": (qgis_ramp_stops, "SELECT k::INT AS stop, round(lo + k * (hi - lo) / 9, 4) + 0.0 AS value FROM (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders), (SELECT unnest(range(10)) AS k)"),
    "cmap_guess": (cmap_guess, _cmap_sql()),
    "affine_cell_lookup": (affine_cell_lookup, LOOKUP),
    "polygon_filter": (polygon_filter, f'WITH {ORDERS}, h AS (SELECT *, -40000.0::DOUBLE + (c + 0.5::DOUBLE) * 800 AS x, 60000.0::DOUBLE - (r + 0.5::DOUBLE) * 800 AS y FROM g) SELECT r AS "row", c AS col, z FROM h WHERE {_ring_sql("x", "y")}'),
    "valid_fraction_chips": (valid_fraction_chips, CHIPS),
    "scene_search": (scene_search, SCENES),
    "asset_links": (asset_links, LINKS),
    "tile_names": (tile_names, TILES),
    "geojson_explode": (geojson_explode, GEOJSON),
    "commodity_filter": (commodity_filter, "SELECT p_partkey, p_type AS kind FROM part WHERE p_partkey % 7 <> 0 AND regexp_matches(p_type, '(?i)brass|copper|promo')"),
    "asset_key_lookup": (asset_key_lookup, "SELECT p_partkey, ['B04', 'b04', 'x_B04_10m'][(p_partkey % 3 + 1)::INT] AS asset FROM part"),
    "search_fallback": (search_fallback, "SELECT o_orderkey, o_orderstatus FROM orders"),
    "chip_rotations": (chip_rotations, f'WITH {PART}, q AS (SELECT r // 8 AS i, c // 8 AS j, r % 8 AS r, c % 8 AS c, z, unnest([0, 1, 2, 3]) AS k FROM g) SELECT i::INT AS chip_row, j::INT AS chip_col, k AS quarter, (CASE k WHEN 1 THEN 7 - c WHEN 2 THEN 7 - r WHEN 3 THEN c ELSE r END)::INT AS "row", (CASE k WHEN 1 THEN r WHEN 2 THEN 7 - c WHEN 3 THEN 7 - r ELSE c END)::INT AS col, z FROM q'),
    "valid_signal_filter": (valid_signal_filter, "SELECT l_orderkey, l_linenumber, round(v, 6) + 0.0 AS v FROM (SELECT l_orderkey, l_linenumber, l_discount / nullif(l_tax, 0) * 20 AS v FROM lineitem) WHERE v IS NOT NULL AND abs(v) < 100 AND v <> 0"),
    "mercator_points": (mercator_points, MERCATOR),
}
