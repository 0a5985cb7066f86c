"""Queries of polygons, structures, point scores, raster files and services, with their SQL."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import functions as F

from ..operators import components, proximity, validation
from ..operators.shared import local_path, scratch
from ..sources import catalog, raster, services, tiff_sink, vector
from ..sources.config import table
from .common import PART, POINTS, SEGMENTS, height, part_grid, points, r, segments
from .rasters import CC, RC, connected_components


def zone_polygons(spark, d):
    """Rings of each zone: outer ones and holes, corners and area."""
    t = components.zone_polygons(connected_components(spark, d), 100, 0.0, 0.0, 300.0)
    closed = F.element_at("points", 1) == F.element_at("points", -1)
    return t.groupBy("component").agg(F.count("*").alias("rings"), F.count(F.when(F.col("hole"), 1)).alias("holes"), F.sum("n_points").cast("long").alias("corners"), r(F.sum("area"), 3).alias("area"), F.min(closed).alias("closed"))


#: Holes by Euler's number of cells, shared edges and full squares; corners by the cells around each grid corner.
POLYGONS = CC + """, k2 AS (SELECT r, c, component FROM k JOIN l USING (id)),
n AS (SELECT component, count(*) AS cells FROM k2 GROUP BY 1),
sh AS (SELECT a.component, count(*) AS edges FROM k2 a JOIN k2 b ON a.component = b.component AND ((a.r = b.r AND a.c + 1 = b.c) OR (a.c = b.c AND a.r + 1 = b.r)) GROUP BY 1),
q AS (SELECT a.component, count(*) AS squares FROM k2 a JOIN k2 b ON a.component = b.component AND a.r = b.r AND a.c + 1 = b.c JOIN k2 x ON a.component = x.component AND a.r + 1 = x.r AND a.c = x.c JOIN k2 y ON a.component = y.component AND a.r + 1 = y.r AND a.c + 1 = y.c GROUP BY 1),
v AS (SELECT component, r + i AS vr, c + j AS vc, count(*) AS n, sum(CASE WHEN i = j THEN 1 ELSE 0 END) AS d FROM k2, (SELECT unnest([0, 1]) AS i), (SELECT unnest([0, 1]) AS j) GROUP BY 1, 2, 3),
t AS (SELECT component, sum(CASE WHEN n IN (1, 3) THEN 1 WHEN n = 2 AND d <> 1 THEN 2 ELSE 0 END)::BIGINT AS corners FROM v GROUP BY 1)
SELECT component, 2 - (cells - coalesce(edges, 0) + coalesce(squares, 0)) AS rings, 1 - (cells - coalesce(edges, 0) + coalesce(squares, 0)) AS holes, corners, round(cells * 90000.0::DOUBLE, 3) + 0.0 AS area, true AS closed
FROM n LEFT JOIN sh USING (component) LEFT JOIN q USING (component) JOIN t USING (component)"""


def nearest_structure(spark, d):
    """Distance of each point's mirror image to the nearest segment."""
    p = points(spark, d).select("id", (-F.col("x")).alias("x"), (F.col("y") / 2).alias("y"))
    return proximity.nearest_segment(p, segments(spark, d), 500.0).select("id", r("distance", 4).alias("distance"))


_TO = "least(greatest(coalesce(((x - ax) * (bx - ax) + (y - ay) * (b_y - ay)) / nullif((bx - ax) * (bx - ax) + (b_y - ay) * (b_y - ay), 0), 0), 0), 1)"
_NEAR = f"SELECT id, min(sqrt((x - ax - t * (bx - ax)) * (x - ax - t * (bx - ax)) + (y - ay - t * (b_y - ay)) * (y - ay - t * (b_y - ay)))) AS distance FROM (SELECT k.id, x, y, ax, ay, bx, b_y, {_TO} AS t FROM k, s) GROUP BY 1"
NEAREST = f"WITH {SEGMENTS}, k AS (SELECT id, -x AS x, y / 2 AS y FROM p) SELECT id, round(distance, 4) + 0.0 AS distance FROM ({_NEAR})"


def _sides(spark, d):
    """Five consecutive points make a polygon, which may cross itself."""
    p = points(spark, d).select("id", "x", "y", F.floor(F.col("id") / 5).alias("polygon"))
    following = F.when(F.col("id") % 5 < 4, F.col("id") + 1).otherwise(F.col("id") - 4).alias("id")
    return p.select("polygon", following, F.col("x").alias("ax"), F.col("y").alias("ay")).join(p.select("id", F.col("x").alias("bx"), F.col("y").alias("by")), "id").drop("id")


def polygon_cells(spark, d):
    return proximity.rasterize_polygons(_sides(spark, d), -50000.0, 50000.0, 2503.0)


POLYGON_CELLS = "WITH " + POINTS + """, e AS (SELECT a.id // 5 AS polygon, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS b_y FROM p a JOIN p b ON b.id = CASE WHEN a.id % 5 < 4 THEN a.id + 1 ELSE a.id - 4 END),
w AS (SELECT polygon, min(ax) AS x0, max(ax) AS x1, min(ay) AS y0, max(ay) AS y1 FROM e GROUP BY 1), k AS (SELECT polygon, r, unnest(range(floor((x0 + 50000.0) / 2503.0)::INT, floor((x1 + 50000.0) / 2503.0)::INT + 1)) AS c FROM (SELECT *, unnest(range(floor((50000.0 - y1) / 2503.0)::INT, floor((50000.0 - y0) / 2503.0)::INT + 1)) AS r FROM w)),
m AS (SELECT *, -50000.0::DOUBLE + (c + 0.5::DOUBLE) * 2503.0 AS x, 50000.0::DOUBLE - (r + 0.5::DOUBLE) * 2503.0 AS y FROM k)
SELECT polygon, r::INT AS "row", c::INT AS col FROM m JOIN e USING (polygon) GROUP BY 1, 2, 3 HAVING count(*) FILTER ((ay > y) <> (b_y > y) AND x < (bx - ax) * (y - ay) / (b_y - ay) + ax) % 2 = 1"""


def centreline_cells(spark, d):
    return proximity.rasterize_centrelines(segments(spark, d), -60000.0, 60000.0, 5003.0)


CENTRELINES = "WITH " + SEGMENTS + """, q AS (SELECT *, abs(bx - ax) >= abs(b_y - ay) AS flat, (ax + 60000.0) / 5003.0 - 0.5 AS x0, (bx + 60000.0) / 5003.0 - 0.5 AS x1, (60000.0 - ay) / 5003.0 - 0.5 AS y0, (60000.0 - b_y) / 5003.0 - 0.5 AS y1 FROM s),
w AS (SELECT flat, CASE WHEN flat THEN x0 ELSE y0 END AS u0, CASE WHEN flat THEN x1 ELSE y1 END AS u1, CASE WHEN flat THEN y0 ELSE x0 END AS v0, CASE WHEN flat THEN y1 ELSE x1 END AS v1 FROM q),
t AS (SELECT *, unnest(range(ceil(least(u0, u1))::BIGINT, floor(greatest(u0, u1))::BIGINT + 1)) AS u FROM w),
z AS (SELECT flat, u, floor(v0 + (u - u0) / (u1 - u0) * (v1 - v0) + 0.5)::BIGINT AS v FROM t UNION ALL SELECT flat, floor(u0 + 0.5)::BIGINT, floor(v0 + 0.5)::BIGINT FROM w WHERE ceil(least(u0, u1)) > floor(greatest(u0, u1)))
SELECT DISTINCT (CASE WHEN flat THEN v ELSE u END)::INT AS "row", (CASE WHEN flat THEN u ELSE v END)::INT AS col FROM z"""


def classify_points(spark, d):
    """Points scored from raw components: profile of class 1, segments as structures."""
    e = table(spark, d, "embeddings")
    p = points(spark, d).join(e.select(F.col("vec_id").alias("id"), F.col("embedding")[2].cast("double").alias("f2"), F.col("embedding")[3].cast("double").alias("f3")), "id")
    shifted = segments(spark, d).select(*((F.col(c) + 1234.5).alias(c) for c in ("ax", "ay", "bx", "by")))
    t = validation.classify_points(p, ["f2", "f3"], F.col("label") == 1, shifted, 3000.0)
    return t.select("id", r("mahalanobis").alias("mahalanobis"), r("structure_distance", 3).alias("structure_distance"), r("cluster_density").alias("cluster_density"), r("composite_score").alias("composite_score"), "classification")


CLASSIFY = "WITH " + SEGMENTS.replace("SELECT a.id, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS b_y", "SELECT a.id, a.x + 1234.5 AS ax, a.y + 1234.5 AS ay, b.x + 1234.5 AS bx, b.y + 1234.5 AS b_y") + f""", k AS (SELECT p.*, embedding[3]::DOUBLE AS u, embedding[4]::DOUBLE AS v FROM p JOIN embeddings ON vec_id = id),
g AS (SELECT avg(u) AS mu, avg(v) AS mv, var_pop(u) AS a, covar_pop(u, v) AS b, var_pop(v) AS c FROM k WHERE label = 1), h AS (SELECT mu, mv, a + 1e-6 * (a + c) / 2 AS a, b, c + 1e-6 * (a + c) / 2 AS c FROM g),
m AS (SELECT id, sqrt((c * (u - mu) * (u - mu) - 2 * b * (u - mu) * (v - mv) + a * (v - mv) * (v - mv)) / (a * c - b * b)) AS m FROM k, h), n AS ({_NEAR}),
f AS (SELECT k.id, count(o.id) AS n FROM k LEFT JOIN (SELECT * FROM k WHERE label = 1) o ON sqrt((k.x - o.x) * (k.x - o.x) + (k.y - o.y) * (k.y - o.y)) <= 3000 GROUP BY 1),
z AS (SELECT id, m, distance, n / (max(n) OVER ())::DOUBLE AS dens, 0.5 * (1 - (m - min(m) OVER ()) / (max(m) OVER () - min(m) OVER ())) + 0.3 * (1 - (distance - min(distance) OVER ()) / (max(distance) OVER () - min(distance) OVER ())) + 0.2 * n / (max(n) OVER ())::DOUBLE AS s FROM m JOIN n USING (id) JOIN f USING (id))
SELECT id, round(m, 6) + 0.0 AS mahalanobis, round(distance, 3) + 0.0 AS structure_distance, round(dens, 6) + 0.0 AS cluster_density, round(s, 6) + 0.0 AS composite_score, CASE WHEN s >= 0.65 THEN 'ore_bearing' ELSE 'barren' END AS classification FROM z"""


def geotiff_round_trip(spark, d):
    """The grid written as one tiled file by all tasks, and read back."""
    g = part_grid(spark, d)
    folder = local_path(scratch(spark, "rasters"))
    Path(folder).mkdir(parents=True, exist_ok=True)
    path = f"{folder}/price.tif"
    tiff_sink.write_geotiff(g, path, tiff_sink.Geometry(50, height(g), 16, 500000.0, 8000000.0, 30.0, 32736, "price"))
    return raster.read_tiff(spark, path).select("row", "col", "band", r("z", 3).alias("z"))


TIFF = f"WITH {PART}, h AS (SELECT unnest(range((SELECT max(r) + 1 FROM g))) AS r) SELECT h.r::INT AS \"row\", w.c::INT AS col, 1 AS band, round(z::FLOAT::DOUBLE, 3) + 0.0 AS z FROM h, (SELECT unnest(range(50)) AS c) w LEFT JOIN g ON g.r = h.r AND g.c = w.c"


def _saved_pages(rows, size: int) -> str:
    """Writes features (`feature`, in the order of `at`) as pages of a service to a folder of their own; its path."""
    return services.save_pages(rows, size, local_path(scratch(rows.sparkSession, "pages")))


def service_scenes(spark, d):
    """Orders as scenes of a service, read page by page with box, days and cloud pushed to it."""
    o = table(spark, d, "orders")
    k = F.col("o_orderkey")
    west, south = (k % 60).cast("double"), (k % 37).cast("double")
    feature = F.struct(
        F.concat(F.lit("S"), k).alias("id"), F.array(west, south, west + 2, south + 2).alias("bbox"),
        F.struct(F.date_format("o_orderdate", "yyyy-MM-dd'T'00:00:00'Z'").alias("datetime"), (k % 101).cast("double").alias("eo:cloud_cover")).alias("properties"),
        F.create_map(F.lit("B04"), F.struct(F.concat(F.lit("s3://x/"), k).alias("href"))).alias("assets"),
    )
    folder = _saved_pages(o.select(k.alias("at"), F.to_json(feature).alias("feature")), 500)
    scenes = services.read_service(spark, "scenes", folder, pageSize=500, streams=3, fetch="lodestrata.sources.services:fetch_folder")
    return catalog.search_scenes(scenes, (10.0, 5.0, 25.0, 20.0), "1994-01-01", "1996-12-31", 30.0, 1000).select("scene_id", F.col("day").cast("string").alias("day"), "cloud", "west", "south", F.col("assets")["B04"].alias("href"))


SCENES = """SELECT 'S' || o_orderkey AS scene_id, o_orderdate::DATE::VARCHAR AS day, (o_orderkey % 101)::DOUBLE AS cloud, (o_orderkey % 60)::DOUBLE AS west, (o_orderkey % 37)::DOUBLE AS south, 's3://x/' || o_orderkey AS href FROM orders
WHERE o_orderkey % 60 <= 25 AND o_orderkey % 60 + 2 >= 10 AND o_orderkey % 37 <= 20 AND o_orderkey % 37 + 2 >= 5 AND o_orderdate::DATE BETWEEN DATE '1994-01-01' AND DATE '1996-12-31' AND o_orderkey % 101 <= 30 ORDER BY cloud, scene_id LIMIT 1000"""


def service_deposits(spark, d):
    """Suppliers as features of a service, read page by page within a box, then chosen by commodity."""
    from ..sources.vector import commodity_filter

    k = F.col("s_suppkey")
    place = F.array((20 + k % 90 / 10).cast("double"), (-30 + k % 70 / 10).cast("double"))
    kind = F.element_at(F.array(F.lit("Copper"), F.lit("Nickel, Chromium"), F.lit("Gold")), (k % 3 + 1).cast("int"))
    feature = F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("Point").alias("type"), place.alias("coordinates")).alias("geometry"), F.struct(F.col("s_name").alias("SITE_NAME"), kind.alias("commod1"), F.lit("vein").alias("dep_type")).alias("properties"))
    folder = _saved_pages(table(spark, d, "supplier").select(k.alias("at"), F.to_json(feature).alias("feature")), 40)
    found = services.read_service(spark, "deposits", folder, pageSize=40, streams=4, fetch="lodestrata.sources.services:fetch_folder")
    return commodity_filter(services.in_box(found, (22.0, -29.0, 27.0, -25.0)), ["chrom", "gold"]).select("name", "commodity", r("latitude").alias("latitude"), r("longitude").alias("longitude"), "deposit_type")


DEPOSITS = """WITH s AS (SELECT s_name AS name, ['Copper', 'Nickel, Chromium', 'Gold'][s_suppkey % 3 + 1] AS commodity, -30 + s_suppkey % 70 / 10.0::DOUBLE AS latitude, 20 + s_suppkey % 90 / 10.0::DOUBLE AS longitude FROM supplier)
SELECT name, commodity, round(latitude, 6) + 0.0 AS latitude, round(longitude, 6) + 0.0 AS longitude, 'vein' AS deposit_type FROM s WHERE longitude BETWEEN 22 AND 27 AND latitude BETWEEN -29 AND -25 AND commodity <> 'Copper'"""


def geojson_pages(spark, d):
    """Suppliers as feature collections in files, read back and normalised."""
    k = F.col("s_suppkey")
    place = F.when(k % 11 != 4, F.array((20 + k % 90 / 10).cast("double"), (-30 + k % 70 / 10).cast("double")))
    kind = F.when(place.isNotNull(), "Point").otherwise("Polygon")
    feature = F.struct(F.lit("Feature").alias("type"), F.struct(kind.alias("type"), place.alias("coordinates")).alias("geometry"), F.struct(F.col("s_name").alias("DEP_NAME"), F.lit("Ni").alias("commod1"), F.lit("Cu").alias("commod2"), F.lit("vein").alias("dep_type")).alias("properties"))
    folder = _saved_pages(table(spark, d, "supplier").select(k.alias("at"), F.to_json(feature, {"ignoreNullFields": "false"}).alias("feature")), 30)
    found = vector.normalise_deposits(vector.read_geojson(spark, f"{folder}/*.json"))
    return found.select("name", "commodity", r("latitude").alias("latitude"), r("longitude").alias("longitude"), "deposit_type")


PAGES = "SELECT s_name AS name, 'Cu' AS commodity, round(-30 + s_suppkey % 70 / 10.0::DOUBLE, 6) + 0.0 AS latitude, round(20 + s_suppkey % 90 / 10.0::DOUBLE, 6) + 0.0 AS longitude, 'vein' AS deposit_type FROM supplier WHERE s_suppkey % 11 <> 4"


def feature_xml(spark, d):
    """Suppliers as a feature service's XML, some with elements for both coordinates and some with a position, read back."""
    k = F.col("s_suppkey")
    lat, lon = (-30 + k % 70 / 10).cast("double"), (20 + k % 90 / 10).cast("double")
    own = k % 3 != 1
    out = scratch(spark, "xml")
    rows = table(spark, d, "supplier").select(F.struct(F.col("s_name").alias("site_name"), F.lit("Ni").alias("commod1"), F.lit("vein").alias("dep_type"), F.when(own, lat).alias("latitude"), F.when(own, lon).alias("longitude"), F.when(k % 3 == 1, F.concat_ws(" ", lat, lon)).alias("pos")).alias("mrds"))
    rows.write.format("xml").option("rowTag", "featureMember").option("rootTag", "FeatureCollection").save(out)
    found = vector.read_feature_xml(spark, out, "featureMember")
    return found.select("name", "commodity", r("latitude").alias("latitude"), r("longitude").alias("longitude"), "deposit_type")


XML = "SELECT s_name AS name, 'Ni' AS commodity, round(-30 + s_suppkey % 70 / 10.0::DOUBLE, 6) + 0.0 AS latitude, round(20 + s_suppkey % 90 / 10.0::DOUBLE, 6) + 0.0 AS longitude, 'vein' AS deposit_type FROM supplier"


def dataset_features(spark, d):
    """An audit dataset written and read back: its features with their means."""
    out = scratch(spark, "dataset")
    p = points(spark, d).join(table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding")[2].cast("double").alias("f2"), F.col("embedding")[3].cast("double").alias("f3")), "id")
    p.select("label", "x", "y", "f2", "f3").write.parquet(out)
    df, features = vector.read_dataset(spark, out)
    one = df.agg(*(F.avg(f).alias(f) for f in features), F.count("*").alias("n"))
    return one.select(F.explode(F.array(*(F.struct(F.lit(f).alias("feature"), r(f).alias("mean"), F.col("n")) for f in features))).alias("t")).select("t.*")


DATASET = "SELECT unnest(['f2', 'f3']) AS feature, unnest([round(avg(embedding[3]::DOUBLE), 6) + 0.0, round(avg(embedding[4]::DOUBLE), 6) + 0.0]) AS mean, count(*) AS n FROM embeddings"


def planned_downloads(spark, d):
    """Files that links name, each once, and what would be fetched."""
    links = table(spark, d, "pages").select(F.concat(F.col("url"), F.lit("/t"), F.col("page_id") % 50, F.lit(".tif?k="), F.col("page_id")).alias("url"))
    return catalog.download(links, "/not/there").select("name", "state")


DOWNLOADS = "SELECT DISTINCT regexp_extract(split_part(url || '/t' || (page_id % 50) || '.tif?k=' || page_id, '?', 1), '[^/]*$') AS name, 'planned' AS state FROM pages"


def band_files(spark, d):
    """The file of a band among all parts' paths: the exact name if it is there, else the first that matches."""
    k = F.col("p_partkey")
    files = table(spark, d, "part").select(F.concat(F.lit("data/"), k % 13, F.lit("/T36_"), F.element_at(F.array(*map(F.lit, ("B04_20m", "b04", "B04", "B11_x"))), (k % 4 + 1).cast("int")), F.lit(".tif")).alias("path")).distinct()
    both = [catalog.band_file(files, band, "T36").withColumn("band", F.lit(band)) for band in ("B04", "B11")]
    return both[0].unionByName(both[1]).select("band", "path")


BANDS = """WITH f AS (SELECT DISTINCT 'data/' || (p_partkey % 13) || '/T36_' || ['B04_20m', 'b04', 'B04', 'B11_x'][p_partkey % 4 + 1] || '.tif' AS path FROM part)
SELECT 'B04' AS band, min(path) FILTER (path LIKE '%/T36_B04.tif') AS path FROM f UNION ALL SELECT 'B11', min(path) FILTER (path LIKE '%/T36_B11_x.tif') FROM f"""


def result_files(spark, d):
    """Metrics written as result files and as GeoJSON features, read back."""
    from ..sources.reports import write_results

    out = scratch(spark, "results")
    rows = points(spark, d).groupBy("label").agg(F.count("*").alias("n"), r(F.avg("x"), 4).alias("x"), r(F.avg("y"), 4).alias("y"))
    write_results(rows, f"{out}/json")
    vector.as_geojson(rows, vector.point_geometry("x", "y"), ["label", "n"]).write.text(f"{out}/geojson")
    back = spark.read.schema("label int, n long, x double, y double").json(f"{out}/json")
    made = spark.read.schema("geometry struct<coordinates: array<double>>, properties struct<label: int, n: long>").json(f"{out}/geojson")
    made = made.select(F.col("properties.label").alias("label"), F.col("properties.n").alias("n_feature"), F.col("geometry.coordinates")[0].alias("x_feature"))
    return back.join(made, "label")


RESULTS = f"WITH {POINTS} SELECT label, count(*) AS n, round(avg(x), 4) + 0.0 AS x, round(avg(y), 4) + 0.0 AS y, count(*) AS n_feature, round(avg(x), 4) + 0.0 AS x_feature FROM p GROUP BY 1"


QUERIES = {
    "zone_polygons": (zone_polygons, POLYGONS),
    "nearest_structure": (nearest_structure, NEAREST),
    "polygon_cells": (polygon_cells, POLYGON_CELLS),
    "centreline_cells": (centreline_cells, CENTRELINES),
    "classify_points": (classify_points, CLASSIFY),
    "geotiff_round_trip": (geotiff_round_trip, TIFF),
    "service_scenes": (service_scenes, SCENES),
    "service_deposits": (service_deposits, DEPOSITS),
    "geojson_pages": (geojson_pages, PAGES),
    "feature_xml": (feature_xml, XML),
    "dataset_features": (dataset_features, DATASET),
    "planned_downloads": (planned_downloads, DOWNLOADS),
    "band_files": (band_files, BANDS),
    "result_files": (result_files, RESULTS),
}
