"""Operators without SQL, edge cases and formats, against numpy or by hand."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from lodestrata.functions import mapalgebra as m
from lodestrata.operators import components, focal, hydrology, proximity, sampling, validation
from lodestrata.sources import catalog, raster, reports, vector


def grid(spark, a):
    return spark.createDataFrame([(i, j, None if np.isnan(v) else float(v)) for i, r in enumerate(a) for j, v in enumerate(r)], "row int, col int, z double")


def as_array(df, name, shape):
    out = np.full(shape, np.nan)
    for r in df.select("row", "col", name).collect():
        out[r["row"], r["col"]] = np.nan if r[name] is None else r[name]
    return out


def test_ratio_edges(spark):
    t = spark.createDataFrame([(1.0, 0.0), (None, 2.0), (3.0, 2.0)], "a double, b double")
    assert [r[0] for r in t.select(m.safe_ratio(F.col("a"), F.col("b"))).collect()] == [None, None, 1.5]


def test_plane_has_constant_slope(spark):
    a = np.add.outer(np.arange(5) * 3.0, np.arange(6) * 4.0)
    s = as_array(focal.gradient(grid(spark, a), 1.0, 1.0).withColumn("s", focal.slope()), "s", a.shape)
    assert np.allclose(s[1:-1, 1:-1], np.degrees(np.arctan(5.0))) and np.isnan(s[0]).all() and np.isnan(s[:, -1]).all()


def test_flat_aspect_is_minus_one(spark):
    a = np.ones((3, 3))
    assert as_array(focal.gradient(grid(spark, a), 1.0, 1.0).withColumn("s", focal.aspect()), "s", a.shape)[1, 1] == -1


def fill(a):
    z = a.copy()
    z[np.isnan(z)] = 1e30
    lost = np.isnan(a)
    while True:
        p = np.pad(z, 1, constant_values=1e30)
        low = np.min([p[1 + i : p.shape[0] - 1 + i, 1 + j : p.shape[1] - 1 + j] for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j], axis=0)
        pit = (z < low) & ~lost
        if not pit.any():
            return np.where(lost, np.nan, z)
        z[pit] = low[pit]


def test_sink_fill_matches_numpy(spark):
    a = np.random.default_rng(1).random((7, 8))
    a[2, 3] = np.nan
    assert np.allclose(as_array(hydrology.fill_sinks(grid(spark, a)), "z", a.shape), fill(a), equal_nan=True)


def test_accumulation_counts_all_cells_at_outlets(spark):
    a = np.add.outer(np.arange(6) * 10.0, np.abs(np.arange(7) - 3) * 1.0)
    d = hydrology.d8(grid(spark, a))
    acc = hydrology.accumulation(d).join(d.where("direction is null"), ["row", "col"])
    assert acc.agg(F.sum("acc")).first()[0] == a.size


def test_components_of_a_spiral_and_of_nothing(spark):
    cells = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (3, 3), (2, 3), (4, 0)], "row int, col int")
    got = {(r["row"], r["col"]): r["component"] for r in components.connected_cells(cells, 5).collect()}
    assert got == {(0, 0): 0, (0, 1): 0, (1, 1): 0, (2, 3): 13, (3, 3): 13, (4, 0): 20}
    assert components.connected_cells(cells.limit(0), 5).count() == 0


def test_range_join_matches_brute_force(spark):
    rng = np.random.default_rng(0)
    p, q = rng.random((80, 2)) * 10 - 5, rng.random((60, 2)) * 10 - 5
    left = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(p)], "id int, x double, y double")
    right = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(q)], "k int, rx double, ry double")
    got = {(r["id"], r["k"]) for r in proximity.range_pairs(left, right, 1.3).collect()}
    assert got == {(i, j) for i in range(80) for j in range(60) if np.hypot(*(p[i] - q[j])) <= 1.3}


def test_merge_prefers_the_primary_source(spark):
    t = spark.createDataFrame([(1, 0.0, 0.0, False), (2, 1.0, 0.0, True), (3, 50.0, 0.0, True), (4, 50.5, 0.0, False)], "id long, x double, y double, secondary boolean")
    assert sorted(r["id"] for r in proximity.merge_sources(t, 5.0).collect()) == [1, 4]


def test_perfect_ranking_and_single_class(spark):
    t = spark.createDataFrame([(0.9, 1), (0.8, 1), (0.1, 0)], "score double, label int")
    assert validation.average_precision(t).first()["ap"] == 1 and validation.roc_auc(t).first()["auc"] == 1
    one = t.where("label = 1")
    assert validation.roc_auc(one).first()["auc"] is None and validation.pr_auc_trapezoid(one).first()["pr_auc"] is None


def test_greedy_folds_by_hand(spark):
    t = spark.createDataFrame([(b, 1) for b, n in ((0, 5), (1, 3), (2, 2), (3, 2)) for _ in range(n)] + [(4, 0)], "block int, label int")
    got = {r["block"]: r["fold"] for r in validation.greedy_folds(t, 2).collect()}
    assert got == {0: 0, 1: 1, 2: 1, 3: 0, 4: 1}


def test_certain_probability_falls_into_the_last_bin(spark):
    t = spark.createDataFrame([(1.0, 1), (0.0, 0)], "score double, label int")
    assert validation.calibration_error(t).first()["ece"] == 0


def test_weighted_sample_repeats(spark):
    t = spark.range(100).select(F.col("id").cast("int").alias("row"), F.lit(0).alias("col"), (F.col("id") / 100).alias("intensity"))
    a, b = ({r["row"] for r in sampling.weighted_sample(t.repartition(n), 10).collect()} for n in (1, 7))
    assert a == b and min(a) >= 20


def test_tiff_round_trip(spark, tmp_path):
    a = np.random.default_rng(2).random((130, 20))
    a[5, 5] = np.nan
    raster.write_tiff(a, str(tmp_path / "a.tif"), 100.0, 200.0, 30.0)
    got = raster.read_tiff(spark, str(tmp_path / "a.tif"))
    assert np.allclose(as_array(got, "z", a.shape), a.astype("f4"), equal_nan=True)
    assert raster.read_tiff(spark, str(tmp_path / "a.tif"), (64, 70)).select("row").distinct().count() == 7
    assert raster.Tiff((tmp_path / "a.tif").read_bytes()).transform == (100.0, 30.0, 200.0, -30.0)


def test_vectors(spark, tmp_path):
    (tmp_path / "f.json").write_text('{"features":[{"type":"Feature","properties":{"Site_Name":"A","COMMOD1":"Nickel"},"geometry":{"type":"Point","coordinates":[30.5,-19.5]}},{"properties":{},"geometry":{"type":"LineString","coordinates":[[1,2],[3,4]]}}]}')
    d = vector.normalise_deposits(vector.read_geojson(spark, str(tmp_path / "f.json")))
    assert [tuple(r) for r in d.collect()] == [("A", "Nickel", -19.5, 30.5, None)]
    (tmp_path / "f.xml").write_text("<r><site><name>B</name><pos>-19 30</pos></site><site><name>C</name><pos/></site></r>")
    assert [(r["name"], r["latitude"], r["longitude"]) for r in vector.read_feature_xml(spark, str(tmp_path / "f.xml"), "site").collect()] == [("B", -19.0, 30.0)]
    assert vector.empty_deposits(spark).count() == 0


def test_reports_escape():
    assert "<script>" not in reports.html_report("<script>", {"a": 1.0})
    assert reports.qgis_style([(0.0, "#000"), (1.0, "#fff")], "x").count("<item") == 2


def test_missing_cloud_counts_as_full(spark):
    t = spark.sql("select 1L scene_id, 0.0D west, 1.0D east, 0.0D south, 1.0D north, date'2020-01-01' day, cast(null as double) cloud")
    assert catalog.search_scenes(t, (0, 0, 1, 1), "2020-01-01", "2020-01-02", 50).count() == 0


def test_gradient_beside_absent_cells_is_null(spark):
    cells = [(r, c, float(c)) for r in range(6) for c in range(7) if (r, c) != (2, 3)]
    g = focal.gradient(spark.createDataFrame(cells, "row int, col int, z double"), 1.0, 1.0)
    got = {(r["row"], r["col"]): (r["gx"], r["gy"]) for r in g.collect()}
    for (r, c), v in got.items():
        whole = 1 <= r <= 4 and 1 <= c <= 5 and max(abs(r - 2), abs(c - 3)) > 1
        assert v == ((1.0, 0.0) if whole else (None, None))


def test_correlation_with_a_large_mean_is_flagged(spark):
    rows = [(k % 2, 6e5 + k % 2 + 1e-3 * (k % 7), 1e9 + k % 2 + 0.01 * (k % 5), 3.0) for k in range(200)]
    got = {r["feature"]: r for r in validation.label_correlation(spark.createDataFrame(rows, "label int, easting double, large double, same double"), ["easting", "large", "same"]).collect()}
    assert got["easting"]["r"] > 0.999 and got["easting"]["flagged"] and got["large"]["flagged"]
    assert got["same"]["r"] is None and not got["same"]["flagged"]


def test_equal_points_keep_their_tiles(spark):
    p = spark.createDataFrame([(1.0, 1.0), (1.0, 1.0), (9.0, 9.0)], "x double, y double")
    t = spark.createDataFrame([("a", 0, 0.0, 2.0, 0.0, 2.0), ("b", 1, 0.5, 3.0, 0.5, 30.0)], "tile string, ord int, x0 double, x1 double, y0 double, y1 double")
    assert [r["tile"] for r in proximity.assign_tiles(p, t).collect()] == ["b", "b"]


def test_names_of_commodities_are_plain_text(spark):
    d = spark.createDataFrame([("Copper (Cu)",), ("Cobalt",), (None,)], "commodity string")
    assert [r[0] for r in vector.commodity_filter(d, ["(cu)"]).collect()] == ["Copper (Cu)"]


def test_certificate_levels(spark):
    rows = spark.range(500).selectExpr("id", "id * 3 as v")
    one = {validation.certificate(x, ["id"], ["v"], "s", levels).first()[0] for levels in (1, 2) for x in (rows, rows.orderBy("v", ascending=False).repartition(5))}
    assert len(one) == 2
    assert validation.certificate(rows.where("id <> 7"), ["id"], ["v"], "s").first()[0] not in one


def test_long_lines_make_the_cells_they_touch(spark):
    rng = random.Random(1)
    segments = [(i, *(rng.uniform(-50, 50) for _ in range(4))) for i in range(30)] + [(30, 1.0, 2.0, 40.0, 2.0), (31, 3.0, -40.0, 3.0, 30.0), (32, 5.5, 5.5, 5.5, 5.5)]
    got = {(r["row"], r["col"]) for r in proximity.rasterize_lines(spark.createDataFrame(segments, "id int, ax double, ay double, bx double, by double"), -60.0, 60.0, 7.0).collect()}
    want = set()
    for _, ax, ay, bx, by in segments:
        for row in range(18):
            for col in range(18):
                inside = math.floor((60 - max(ay, by)) / 7) <= row <= math.floor((60 - min(ay, by)) / 7) and math.floor((min(ax, bx) + 60) / 7) <= col <= math.floor((max(ax, bx) + 60) / 7)
                corners = [(bx - ax) * (60 - (row + i) * 7 - ay) - (by - ay) * (-60 + (col + j) * 7 - ax) for i in (0, 1) for j in (0, 1)]
                if inside and min(corners) <= 0 <= max(corners):
                    want.add((row, col))
    assert got == want


def test_negatives_fall_back_to_the_small_buffer(spark):
    cells = spark.createDataFrame([(0, k, 600.0 * k, 0.0) for k in range(8)], "row int, col int, x double, y double")
    deposits = spark.createDataFrame([(0.0, 0.0)], "x double, y double")
    got = sampling.negatives(cells, deposits, 9000.0, 3).collect()
    assert len(got) == 3 and min(r["x"] for r in got) > 1000


def test_audit_grades_a_leaking_feature(spark):
    from lodestrata.operators import audit, models

    rng = random.Random(4)
    rows = [(k, k % 2, 1000.0 * rng.randrange(200), 1000.0 * rng.randrange(200), k % 2 + rng.gauss(0, 0.01), rng.gauss(0, 1)) for k in range(160)]
    df = spark.createDataFrame(rows, "id long, label int, x double, y double, leak double, noise double")
    one = audit.audit(df, ["leak", "noise"], models.logistic(["leak", "noise"], 160), settings=audit.Settings(replicates=4)).first()
    tests = {t["name"]: t for t in one["tests"]}
    assert not tests["feature_label_leakage"]["passed"] and tests["feature_label_leakage"]["score"] > 0.99
    assert tests["spatial_leakage"]["passed"] and tests["beats_class_prior"]["passed"] and len(one["certificate"]) == 64
    names = [r["name"] for r in audit.baselines(validation.stratified_folds(df, "id", "label", 3), ["leak", "noise"], models.logistic(["leak", "noise"], 160)).collect()]
    assert names == ["best_feature:leak", "model", "random"]


def pack_lzw(data):
    out, table, width, word = [(256, 9)], {bytes([i]): i for i in range(256)}, 9, b""
    n = 258
    for b in data:
        if word + bytes([b]) in table:
            word += bytes([b])
            continue
        out.append((table[word], width))
        table[word + bytes([b])] = n
        n += 1
        word = bytes([b])
        if n + 1 > 1 << width:
            width += 1
        if n >= 4093:
            out.append((table[word], width))
            out.append((256, width))
            table, width, n, word = {bytes([i]): i for i in range(256)}, 9, 258, b""
    if word:
        out.append((table[word], width))
    out.append((257, width))
    bits = "".join(f"{c:0{w}b}" for c, w in out)
    return int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")


def test_lzw():
    from lodestrata.sources import raster

    rng = random.Random(0)
    for data in (b"a", b"aaaaaaaaaa" * 50, bytes(rng.randrange(4) for _ in range(3000)), bytes(rng.randrange(256) for _ in range(2000))):
        assert raster.unpack_lzw(pack_lzw(data)) == data


def test_float_predictor_and_big_files(spark, tmp_path):
    import struct

    import numpy as np

    from lodestrata.sources import raster

    a = np.arange(12, dtype="<f4").reshape(3, 4) * 1.37 - 5
    planes = np.frombuffer(a.astype(">f4").tobytes(), np.uint8).reshape(3, 4, 4).transpose(0, 2, 1).reshape(3, 16)
    strip = pack_lzw(np.diff(planes.astype(np.int16), axis=1, prepend=0).astype(np.uint8).tobytes())
    fields = [(256, 4, 4), (257, 4, 3), (258, 3, 32), (259, 3, 5), (273, 16, 0), (277, 3, 1), (278, 4, 3), (279, 16, len(strip)), (317, 3, 3), (339, 3, 3)]
    at = 16 + 8 + 20 * len(fields) + 8
    body = b"".join(struct.pack("<HHQ", t, k, 1) + struct.pack("<Q", at if t == 273 else v) for t, k, v in fields)
    (tmp_path / "x.tif").write_bytes(b"II" + struct.pack("<HHHQ", 43, 8, 0, 16) + struct.pack("<Q", len(fields)) + body + struct.pack("<Q", 0) + strip)
    got = {(r["row"], r["col"]): r["z"] for r in raster.read_tiff(spark, str(tmp_path / "x.tif")).collect()}
    assert got == {(r, c): float(a[r, c]) for r in range(3) for c in range(4)}


def test_results_as_json(spark, tmp_path):
    from lodestrata.sources import reports

    reports.write_results(spark.createDataFrame([("t", 0.5)], "tile string, auc double"), str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r")).collect() == [("0.5", "t")] or spark.read.json(str(tmp_path / "r")).first()["auc"] == 0.5


def test_downloads_fetch_each_file_once(spark, tmp_path):
    def fetch(url, path):
        path.write_text(url)

    (tmp_path / "b.tif").write_text("old")
    links = spark.createDataFrame([("http://x/a.tif?k=1",), ("http://x/a.tif?k=2",), ("http://x/b.tif",)], "url string")
    got = {r["name"]: r["state"] for r in catalog.download(links, str(tmp_path), fetch).collect()}
    assert got == {"a.tif": "fetched", "b.tif": "there"}
    assert (tmp_path / "a.tif").read_text() == "http://x/a.tif?k=1" and (tmp_path / "b.tif").read_text() == "old"
    assert sorted(p.name for p in tmp_path.iterdir()) == ["a.tif", "b.tif"]


def test_lineaments_of_a_straight_step(spark):
    from lodestrata.operators import lineaments

    a = np.zeros((24, 24))
    a[:, 12:] = 100.0
    g = grid(spark, a)
    edges = lineaments.edges(g, 24, 24, 1.0, 0.3, 0.5).where("edge = 1")
    assert {r["col"] for r in edges.collect()} <= {10, 11, 12, 13} and edges.count() >= 24


def test_models_save_and_load(spark, tmp_path):
    from lodestrata.operators import models

    rng = random.Random(3)
    rows = spark.createDataFrame([(k % 2, k % 2 + rng.gauss(0, 0.3), rng.gauss(0, 1), k % 3, k) for k in range(90)], "label int, a double, b double, fold int, id long")
    model, metrics, means = models.train_validated(models.balanced(rows), models.logistic(["a", "b"], 90, "weight"))
    assert metrics.count() == 3 and means.first()["mean_pr_auc"] > 0.9
    models.save_model(model, str(tmp_path / "m"), {"features": ["a", "b"]})
    again = models.load_model(str(tmp_path / "m"))
    assert models.score(again, rows).select("score").collect() == models.score(model, rows).select("score").collect()
    importance = {r["name"]: r["importance"] for r in models.permutation_importance(model, rows, ["a", "b"], "id").collect()}
    assert importance["a"] > importance["b"]
    boosted = models.boosted(["a", "b"], rounds=3, depth=2).fit(rows)
    cells = rows.withColumn("row", F.col("id").cast("int")).withColumn("col", F.lit(0)).select("row", "col", "a", "b")
    scored = models.predict_cells(cells.withColumn("a", F.when(F.col("row") != 5, F.col("a"))), boosted, ["a", "b"], [model, again])
    got = {r["row"]: r for r in scored.collect()}
    assert got[5]["prob"] is None and all(0 <= r["prob"] <= 100 and r["uncertainty"] == 0 for k, r in got.items() if k != 5)


def test_configuration_and_areas(spark, tmp_path):
    import json

    import pytest

    from lodestrata.sources import config

    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "s.yaml").write_text("a: {b: 1}\n")
    try:
        found = config.load_config(str(tmp_path / "c" / "s.yaml"))
        assert found["a"] == {"b": 1} and str(found["_base_dir"]) == str(tmp_path)
    except ImportError:
        pass
    with pytest.raises(FileNotFoundError):
        config.load_config(str(tmp_path / "none.yaml"))
    ring = [[0, 0], [4, 0], [4, 3], [0, 0]]
    (tmp_path / "a.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {}, "geometry": {"type": "Polygon", "coordinates": [ring]}}]}))
    assert config.area_ring(spark, str(tmp_path / "a.geojson"))[:3] == [(0.0, 0.0), (4.0, 0.0), (4.0, 3.0)]


def test_cells_by_row_ranges(spark, tmp_path):
    raster.write_cells(spark.range(100).selectExpr("cast(id as int) as row", "0 as col", "cast(id as double) as z"), str(tmp_path / "cells"), 10)
    part = raster.read_cells(spark, str(tmp_path / "cells"), (12, 17), 10)
    assert sorted(r["row"] for r in part.collect()) == list(range(12, 18)) and "PartitionFilters: [isnotnull(row_block" in part._jdf.queryExecution().toString()


def test_lineaments_need_several_lights(spark):
    from lodestrata.operators import lineaments

    a = np.zeros((40, 40))
    a[:, 20:] = 100.0
    b = np.zeros((40, 40))
    b[25:, :] = 100.0
    shades = grid(spark, a).withColumn("azimuth", F.lit(0.0)).unionByName(grid(spark, a).withColumn("azimuth", F.lit(90.0))).unionByName(grid(spark, b).withColumn("azimuth", F.lit(180.0)))
    got = lineaments.lineaments(shades, 40, 40, 0.0, 0.0, 30.0, votes=25, least_m=600.0).collect()
    # the step that two lights show runs north to south; the one of a single light is no line
    assert got and all(r["length_m"] >= 600 and min(r["azimuth"], 180 - r["azimuth"]) < 30 for r in got)  # the edge is some cells wide
    assert all(abs(r[x] - 600) < 200 for r in got for x in ("ax", "bx"))


def test_truncated_cells_differ_left_of_the_corner(spark):
    from lodestrata.functions import geometry

    p = spark.createDataFrame([(-5.0, 3.0), (15.0, -25.0)], "x double, y double")
    row, col = geometry.corner_cell(F.col("x"), F.col("y"), 0.0, 0.0, 10.0)
    assert p.select(row, col).collect() == [(0, 0), (2, 1)]
    row, col = geometry.cell_of(F.col("x"), F.col("y"), 0.0, 0.0, 10.0)
    assert p.select(row, col).collect() == [(-1, -1), (2, 1)]


def test_datasets_need_their_columns(spark, tmp_path):
    import pytest

    spark.createDataFrame([(1, 2.0, 3.0, 4.0)], "label int, x double, y double, f double").write.parquet(str(tmp_path / "d"))
    df, features = vector.read_dataset(spark, str(tmp_path / "d"))
    assert features == ["f"] and df.count() == 1
    (tmp_path / "d.csv").write_text("label,x,f\n1,2,3\n")
    with pytest.raises(ValueError, match="y"):
        vector.read_dataset(spark, str(tmp_path / "d.csv"))


def test_band_files_and_empty_sources(spark):
    files = spark.createDataFrame([("/a/S2_B04_x.tif",), ("/a/S2_B04.tif",), ("/a/S2_B08_10m.tif",)], "path string")
    assert catalog.band_file(files, "B04", "S2").first()["path"] == "/a/S2_B04.tif"
    assert catalog.band_file(files, "B08", "S2").first()["path"] == "/a/S2_B08_10m.tif"
    assert catalog.band_file(files, "B11", "S2").count() == 0
    assert vector.empty_deposits(spark).columns == ["name", "commodity", "latitude", "longitude", "deposit_type"]


def test_geojson_out_and_in(spark, tmp_path):
    import json

    rows = spark.createDataFrame([("m", 27.5, -12.0)], "name string, x double, y double")
    feature = json.loads(vector.as_geojson(rows, vector.point_geometry("x", "y"), ["name"]).first()["value"])
    assert feature == {"type": "Feature", "properties": {"name": "m"}, "geometry": {"type": "Point", "coordinates": [27.5, -12.0]}}
    (tmp_path / "f.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": [feature]}))
    got = vector.normalise_deposits(vector.read_geojson(spark, str(tmp_path / "f.geojson"))).first()
    assert (got["name"], got["latitude"], got["longitude"], got["commodity"]) == ("m", -12.0, 27.5, None)


def test_reports_of_an_audit():
    row = {"grade": "B", "tests_passed": 4, "certificate": "ab", "tests": [{"name": "calibration", "passed": False, "score": 0.2, "threshold": 0.1}]}
    text = reports.audit_markdown(row, "lr")
    assert "Grade **B**" in text and "| calibration | fail | 0.2000 | 0.1000 |" in text and "`ab`" in text
    page = reports.html_report("<t>", {"a": 1.5}, images={"map": b"\x89PNG"})
    assert "&lt;t&gt;" in page and "data:image/png;base64,iVBORw==" in page
