"""Attributions, raster files, services, rings, quantiles, batched fits, structures and script variants against plain versions."""

import itertools
import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestrata.operators import attributions, boosting, components, focal, hydrology, lineaments, models, newton, proximity, quantiles, sampling, validation
from lodestrata.sources import raster, reports, services, tiff_sink


def grid(spark, a):
    return spark.createDataFrame([(i, j, None if np.isnan(v) else float(v)) for i, row in enumerate(a) for j, v in enumerate(row)], "row int, col int, z double")


# -- attributions


def expectation(nodes, row, known, at=0):
    n = nodes[at]
    if n["left"] < 0:
        return n["value"]
    if n["feature"] in known:
        return expectation(nodes, row, known, n["left"] if row[n["feature"]] <= n["threshold"] else n["right"])
    return sum(nodes[c]["cover"] / n["cover"] * expectation(nodes, row, known, c) for c in (n["left"], n["right"]))


@pytest.fixture(scope="module")
def six(spark):
    rng = random.Random(5)
    rows = []
    for k in range(400):
        x = [round(rng.gauss(0, 1), 2) for _ in range(6)]
        rows.append((k, int(x[0] + x[1] * x[2] + 0.5 * rng.gauss(0, 1) > 0), *x))
    return spark.createDataFrame(rows, "id long, label int, " + ", ".join(f"x{i} double" for i in range(6))), [f"x{i}" for i in range(6)]


@pytest.mark.parametrize("kind", ["forest", "boosted"])
def test_attributions_are_shapley_values(spark, six, kind):
    rows, features = six
    model = (models.forest(features, trees=4, depth=5) if kind == "forest" else models.boosted(features, rounds=3, depth=4)).fit(rows)
    table = attributions.node_table(model).collect()
    trees = {}
    for n in table:
        trees.setdefault(n["tree"], {})[n["id"]] = n
    some = rows.where("id < 12").withColumn("x3", F.when(F.col("id") == 7, F.lit(float("nan"))).otherwise(F.col("x3")))
    found = attributions.attributions(model, some, features, ["id"]).collect()
    assert len(found) == 12
    base = sum(t[0]["weight"] * expectation(t, None, ()) for t in trees.values())
    held = {r["id"]: [r[f] for f in features] for r in some.collect()}
    for r in found:
        x = held[r["id"]]
        value = {s: sum(t[0]["weight"] * expectation(t, x, s) for t in trees.values()) for n in range(7) for s in itertools.combinations(range(6), n)}
        assert r["base"] == pytest.approx(base)
        for i, f in enumerate(features):
            others = [s for s in value if i not in s]
            want = sum(math.factorial(len(s)) * math.factorial(5 - len(s)) / 720 * (value[tuple(sorted((*s, i)))] - value[s]) for s in others)
            assert r[f] == pytest.approx(want, abs=1e-9)
    if kind == "forest":
        scored = {r["id"]: r["score"] for r in models.score(model, some.where("id <> 7")).collect()}
        assert all(r["base"] + sum(r[f] for f in features) == pytest.approx(scored[r["id"]]) for r in found if r["id"] != 7)


def test_mean_attribution_and_bias(spark, six):
    rows, features = six
    model = models.forest(features, trees=10, depth=4).fit(rows)
    one = attributions.mean_attribution(attributions.attributions(model, rows, features, ["id"]), features)
    order = [r["name"] for r in one.orderBy(F.desc("importance")).collect()]
    assert set(order[:3]) == {"x0", "x1", "x2"}
    named = one.replace({"x0": "distance_to_road"}, subset=["name"])
    assert attributions.exploration_bias(named).first() == (True, ["distance_to_road"])
    assert attributions.exploration_bias(one).first()["biased"] is False


# -- raster files


@pytest.mark.parametrize("data", [b"", b"a", b"abc" * 5000, bytes(range(256)) * 40, random.Random(1).randbytes(40_000), b"\0" * 100_000])
def test_lzw_round_trip(data):
    assert raster.unpack_lzw(tiff_sink.pack_lzw(data)) == data


@pytest.mark.parametrize("compression", ["lzw", "deflate", "none"])
def test_geotiff_round_trip(spark, tmp_path, compression):
    rng = np.random.default_rng(2)
    a = rng.normal(100, 30, (70, 45)).astype(np.float32).astype(np.float64)
    a[3, 4], a[32:48, 16:32] = np.nan, np.nan
    path = str(tmp_path / "x.tif")
    g = tiff_sink.Geometry(45, 70, 16, 1000.0, 2000.0, 30.0, 32736, 'clay & "ratio"', compression=compression)
    cells = grid(spark, a).where("not (row between 32 and 47 and col between 16 and 31)").repartition(4)
    tiff_sink.write_geotiff(cells, path, g)
    back = np.full(a.shape, -1.0)
    for r in raster.read_tiff(spark, path).collect():
        back[r["row"], r["col"]] = np.nan if r["z"] is None else r["z"]
    assert np.array_equal(back, a, equal_nan=True)
    t = raster.Tiff(raster.Ranges(path))
    assert t.transform == (1000.0, 30.0, 2000.0, -30.0) and t.compression == tiff_sink.CODES[compression] and 0 in t.counts
    _, tags = raster.read_tags(raster.Ranges(path))
    assert tags[tiff_sink.GEO_KEYS] == (1, 1, 0, 3, 1024, 0, 1, 1, 1025, 0, 1, 1, 3072, 0, 1, 32736) and b"clay &amp; &quot;ratio&quot;" in tags[tiff_sink.METADATA][0]
    assert [p.name for p in tmp_path.iterdir()] == ["x.tif"]


def test_big_geotiff(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tiff_sink, "CLASSIC", 0)
    path = str(tmp_path / "b.tif")
    tiff_sink.write_geotiff(grid(spark, np.arange(12.0).reshape(3, 4)), path, tiff_sink.Geometry(4, 3, 2, nodata=-9999.0))
    assert (tmp_path / "b.tif").read_bytes()[2:4] == b"\x2b\0"
    assert sorted(tuple(r)[:2] + (r["z"],) for r in raster.read_tiff(spark, path).collect()) == [(i, j, 4.0 * i + j) for i in range(3) for j in range(4)]


def test_failed_write_leaves_nothing(spark, tmp_path):
    from lodestrata.operators.shared import ship

    ship(spark)
    spark.dataSource.register(tiff_sink.TiffSink)
    (tmp_path / "x.tif").write_bytes(b"old")
    rows = spark.createDataFrame([(0, 500, b"ab"), (1, 502, None)], "tile int, place long, data binary").repartition(2)
    options = {"path": str(tmp_path / "x.tif"), "job": "j", "big": "false", "geometry": json.dumps({"width": 4, "height": 2, "tile": 2})}
    with pytest.raises(Exception, match="(?s).*"):
        rows.write.format("tiff_file").options(**options).mode("append").save()
    assert (tmp_path / "x.tif").read_bytes() == b"old" and [p.name for p in tmp_path.iterdir()] == ["x.tif"]


# -- services


def test_pages_with_a_total_are_partitions(spark, tmp_path):
    feature = lambda k: {"id": f"S{k:02d}", "bbox": [k, 0, k + 1, 1], "properties": {"datetime": f"2020-01-{k + 1:02d}T10:00:00Z", "eo:cloud_cover": k * 4.0}, "assets": {"B04": {"href": f"h{k}"}}}
    for page in range(3):
        (tmp_path / f"page-{page + 1}.json").write_text(json.dumps({"numberMatched": 25, "features": [feature(k) for k in range(10 * page, min(25, 10 * page + 10))]}))
    df = services.read_service(spark, "scenes", str(tmp_path), pageSize=10, fetch="lodestrata.sources.services:fetch_folder")
    assert df.rdd.getNumPartitions() == 3 and df.count() == 25
    some = df.where("west <= 9 and east >= 3 and cloud <= 30 and day >= date'2020-01-05'")
    assert sorted(r["scene_id"] for r in some.collect()) == ["S04", "S05", "S06", "S07"]
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "Filter (" not in plan, plan  # the service has them all


def test_service_parameters():
    c = [services.Condition(services.LessThanOrEqual, "west", 9.0), services.Condition(services.GreaterThanOrEqual, "east", 3.0), services.Condition(services.LessThanOrEqual, "cloud", 30.0), services.Condition(services.GreaterThanOrEqual, "day", "2020-01-05")]
    p = services.parameters("scenes", c, 2, 10, "sentinel")
    assert p == {"page": 2, "collections": "sentinel", "limit": 10, "bbox": "3,-90,9,90", "sortby": "eo:cloud_cover", "datetime": "2020-01-05/..", "query": '{"eo:cloud_cover": {"lte": 30.0}}'}
    g = services.parameters("granules", c[:2], 1, 200, "AST_L1T", "004")
    assert g["bounding_box"] == "3,-90,9,90" and g["version"] == "004" and g["page_num"] == 1 and "temporal" not in g


def test_granules_and_xml(spark, tmp_path):
    entry = lambda k: {"title": f"G{k}", "time_start": "2004-05-06T01:02:03Z", "boxes": ["-20 30 -19 31"], "version_id": "004", "links": [{"href": f"http://x/{k}.hdf", "rel": "a/data#"}]}
    (tmp_path / "g").mkdir()
    for page, n in ((1, 3), (2, 3), (3, 1)):
        (tmp_path / "g" / f"page-{page}.json").write_text(json.dumps({"feed": {"entry": [entry(10 * page + k) for k in range(n)]}}))
    df = services.read_service(spark, "granules", str(tmp_path / "g"), pageSize=3, streams=2, fetch="lodestrata.sources.services:fetch_folder")
    rows = df.collect()
    assert len(rows) == 7 and rows[0]["west"] == 30.0 and rows[0]["north"] == -19.0 and rows[0]["links"][0]["rel"] == "a/data#"
    (tmp_path / "x").mkdir()
    member = "<gml:featureMember xmlns:gml='http://www.opengis.net/gml'><d><site_name>A</site_name><commod1>Ni</commod1><dep_type>vein</dep_type>{}</d></gml:featureMember>"
    body = "<all>" + member.format("<latitude>-20.5</latitude><longitude>30.25</longitude>") + member.format("<pos>-21 31</pos>") + member.format("") + "</all>"
    (tmp_path / "x" / "page-1.xml").write_text(body)
    df = services.read_service(spark, "deposits", str(tmp_path / "x"), fetch="lodestrata.sources.services:fetch_folder")
    assert sorted(tuple(r) for r in df.collect()) == [("A", "Ni", -21.0, 31.0, "vein"), ("A", "Ni", -20.5, 30.25, "vein")]
    (tmp_path / "x" / "page-1.xml").write_text("<broken")
    with pytest.raises(Exception, match="(?s).*"):
        df.collect()
    assert services.read_service(spark, "deposits", str(tmp_path / "x"), fetch="lodestrata.sources.services:fetch_folder", onError="empty").count() == 0


# -- rings


def test_rings_of_holes_and_corners(spark):
    rng = random.Random(4)
    cells = [(i, j) for i in range(30) for j in range(30) if rng.random() < 0.62]
    labelled = components.connected_cells(spark.createDataFrame(cells, "row int, col int"), 30)
    zones = {}
    for r in labelled.collect():
        zones.setdefault(r["component"], set()).add((r["row"], r["col"]))
    got = components.zone_polygons(labelled, 30).collect()
    assert {r["component"] for r in got} == set(zones)
    for name, own in zones.items():
        rings = [r for r in got if r["component"] == name]
        assert sum(r["area"] for r in rings) == pytest.approx(len(own)) and sum(not r["hole"] for r in rings) == 1
        odd = lambda x, y, rings=rings: sum((a["y"] > y) != (b["y"] > y) and x < (b["x"] - a["x"]) * (y - a["y"]) / (b["y"] - a["y"]) + a["x"] for r in rings for a, b in itertools.pairwise(r["points"])) % 2
        for r in rings:
            assert r["points"][0] == r["points"][-1] and len({(p["x"], p["y"]) for p in r["points"]}) >= 4
            assert all((a["x"] == b["x"]) != (a["y"] == b["y"]) for a, b in itertools.pairwise(r["points"]))
        assert {(i, j) for i in range(30) for j in range(30) if odd(j + 0.5, -i - 0.5)} == own


def test_rings_are_chained_within_blocks(spark, monkeypatch):
    """Rings of one block take no rounds; those cut by blocks of 4 x 4 cells are the same."""
    rng = random.Random(11)
    cells = [(i, j) for i in range(23) for j in range(19) if rng.random() < 0.7]
    labelled = components.connected_cells(spark.createDataFrame(cells, "row int, col int"), 19).cache()
    whole = sorted(map(tuple, components.ring_points(labelled, 19, rounds=0).collect()))
    monkeypatch.setattr(components, "BLOCK", 4)
    assert whole and sorted(map(tuple, components.ring_points(labelled, 19).collect())) == whole


def test_components_across_blocks(spark, monkeypatch):
    monkeypatch.setattr(components, "BLOCK", 4)
    rng = random.Random(9)
    cells = {(i, j) for i in range(25) for j in range(17) if rng.random() < 0.6}
    got = {(r["row"], r["col"]): r["component"] for r in components.connected_cells(spark.createDataFrame(sorted(cells), "row int, col int"), 17).collect()}
    seen = {}
    for start in sorted(cells):
        if start in seen:
            continue
        stack, seen[start] = [start], start[0] * 17 + start[1]
        while stack:
            i, j = stack.pop()
            for at in ((i + 1, j), (i - 1, j), (i, j + 1), (i, j - 1)):
                if at in cells and at not in seen:
                    seen[at] = seen[start]
                    stack.append(at)
    assert got == seen


def test_neighbours_across_blocks(spark, monkeypatch):
    monkeypatch.setattr(focal, "BLOCK", 4)
    rng = random.Random(2)
    cells = {(i, j): rng.randrange(99) for i in range(-5, 11) for j in range(-3, 9) if rng.random() < 0.7}
    df = spark.createDataFrame([(i, j, float(v) if v > 9 else None) for (i, j), v in cells.items()], "row int, col int, z double")
    rows = focal.with_neighbours(df).collect()
    assert len(rows) == len(cells)
    value = lambda i, j: None if cells.get((i, j), 0) <= 9 else float(cells[i, j])
    for r in rows:
        assert all(r[name] == value(r["row"] + i, r["col"] + j) for name, (i, j) in focal.STEPS.items())


def test_sinks_across_blocks(spark, monkeypatch):
    for module in (focal, hydrology):
        monkeypatch.setattr(module, "BLOCK", 5)
    rng = np.random.default_rng(3)
    a = rng.integers(0, 30, (13, 17)).astype(float)
    a[2:9, 3:12] = 1.0 + np.arange(63).reshape(7, 9) % 7
    a[4, 4] = np.nan
    want = a.copy()
    while True:
        p = np.pad(np.where(np.isnan(want), 1e30, want), 1, constant_values=1e30)
        low = np.min([p[1 + i : 14 + i, 1 + j : 18 + j] for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j], axis=0)
        pit = want < low
        if not pit.any():
            break
        want[pit] = low[pit]
    got = np.full(a.shape, -1.0)
    for r in hydrology.fill_sinks(grid(spark, a)).collect():
        got[r["row"], r["col"]] = np.nan if r["z"] is None else r["z"]
    assert np.array_equal(got, want, equal_nan=True)


# -- quantiles


@pytest.mark.parametrize("few", [1, 7, 50_000])
def test_quantiles_are_exact(spark, monkeypatch, few):
    monkeypatch.setattr(quantiles, "FEW", few)
    monkeypatch.setattr(quantiles, "ACCURACY", 20)
    rng = random.Random(few)
    rows = [(k % 3, None if k % 17 == 0 else float("nan") if k % 19 == 0 else rng.choice((0.0, 5.0, rng.gauss(0, 1), math.exp(20 * rng.random()))), 7.0, None) for k in range(900)]
    df = spark.createDataFrame(rows, "g int, a double, b double, c double")
    shares = [0.0, 0.02, 0.37, 0.5, 0.98, 1.0]
    got = quantiles.exact_quantiles(df, {"a": "a", "b": "b", "c": "c"}, shares)
    held = [r[1] for r in rows if r[1] is not None and r[1] == r[1]]
    assert got["a"] == pytest.approx(np.quantile(held, shares).tolist(), rel=1e-12) and got["b"] == [7.0] * 6 and got["c"] == [None] * 6
    by = {r["g"]: r["a"] for r in quantiles.grouped_quantiles(df, "g", ["a"], [0.5]).collect()}
    assert all(by[g] == pytest.approx([np.quantile([r[1] for r in rows if r[0] == g and r[1] is not None and r[1] == r[1]], 0.5)]) for g in range(3))


# -- batched regressions


def test_bootstrap_fits_equal_single_ones(spark, six):
    from pyspark.ml.classification import LogisticRegression

    rows, features = six
    beta = newton.bootstrap_fits(rows, features, "id", 6, 0.01, seed=3)
    again = sampling.bootstrap_rows(rows, 6, "id", seed=3).withColumn("copies", F.col("copies").cast("double"))
    for k in range(6):
        one = models._assembled(features, LogisticRegression(featuresCol="features", labelCol="label", weightCol="copies", regParam=0.01, elasticNetParam=0.0, standardization=False, tol=1e-12, maxIter=500)).fit(again.where(F.col("replicate") == k)).stages[-1]
        assert beta[k] == pytest.approx([*one.coefficients, one.intercept], abs=1e-6)
    assert np.isnan(newton.bootstrap_fits(rows.where("label = 1"), features, "id", 2, 0.01)).all()


def test_folds_are_fitted_together(spark, six):
    rows, features = six
    folded = rows.withColumn("fold", (F.col("id") % 4).cast("int"))
    got = {r["id"]: r["score"] for r in models.cross_validate(folded, models.logistic(features, 400)).collect()}
    assert len(got) == 400
    one = models.logistic(features, 400).fit(folded.where("fold <> 2"))
    assert all(got[r["id"]] == pytest.approx(r["score"], abs=1e-3) for r in models.score(one, folded.where("fold = 2")).collect())
    lone = folded.withColumn("label", (F.col("fold") == 0).cast("int"))
    assert {r["fold"] for r in models.cross_validate(lone, models.logistic(features, 400)).select("fold").distinct().collect()} == {1, 2, 3}


def test_cells_with_an_ensemble(spark, six):
    rows, features = six
    cells = rows.select(F.col("id").cast("int").alias("row"), F.lit(0).alias("col"), *(F.when(F.col("id") != 5, F.col(f)).alias(f) for f in features))
    beta = newton.bootstrap_fits(rows, features, "id", 5, 0.01)
    got = {r["row"]: r for r in models.predict_cells(cells, models.forest(features, trees=3, depth=3).fit(rows), features, beta).collect()}
    assert len(got) == 400 and got[5]["prob"] is None and got[5]["uncertainty"] is None
    x = np.array([got[8][f] for f in features])
    p = 1 / (1 + np.exp(-(beta[:, :-1] @ x + beta[:, -1])))
    assert got[8]["uncertainty"] == pytest.approx(p.std() * 100)


def test_boosting_stops_early(spark, six):
    rows, features = six
    noisy = rows.withColumn("label", F.when(F.col("id") % 3 == 0, 1 - F.col("label")).otherwise(F.col("label")))
    model = boosting.fit_boosted(noisy.where("id % 5 <> 0"), noisy.where("id % 5 = 0"), features, "id", rounds=40, depth=3, rate=0.5, patience=3)
    assert len(model.history) < 40 and model.best == max(range(len(model.history)), key=lambda k: (model.history[k], -k)) and len(model.history) == model.best + 4
    assert all(len(some) == 5 for _, some in model.trees)
    ap = validation.average_precision(model.score(noisy.where("id % 5 = 0"))).first()["ap"]
    assert ap == pytest.approx(model.history[model.best])


# -- structures


def test_nearest_segments_with_hot_buckets(spark, monkeypatch):
    monkeypatch.setattr(proximity, "HOT", 5)
    rng = random.Random(6)
    segments = [tuple(rng.gauss(0, 3) for _ in range(4)) for _ in range(60)] + [(1.0, 1.0, 1.0, 1.0)] * 3 + [(-200.0, 40.0, 180.0, 40.0), (None, 0.0, 1.0, 1.0)]
    points = [(k, rng.gauss(0, 3), rng.gauss(0, 3)) for k in range(80)] + [(100, 5000.0, -3000.0), (101, None, 1.0), (102, 1.0, 1.0)]
    s = spark.createDataFrame(segments, "ax double, ay double, bx double, by double")
    p = spark.createDataFrame(points, "id long, x double, y double")
    got = {r["id"]: r["distance"] for r in proximity.nearest_segment(p, s, 0.5).collect()}

    def distance(x, y, ax, ay, bx, by):
        n = (bx - ax) ** 2 + (by - ay) ** 2
        t = min(1, max(0, ((x - ax) * (bx - ax) + (y - ay) * (by - ay)) / n)) if n else 0
        return math.hypot(x - ax - t * (bx - ax), y - ay - t * (by - ay))

    assert got[101] is None and len(got) == len(points)
    for k, x, y in points:
        if k != 101:
            assert got[k] == pytest.approx(min(distance(x, y, *q) for q in segments[:-1]), abs=1e-9)
    assert {r["distance"] for r in proximity.nearest_segment(p, s.limit(0), 0.5).collect()} == {None}


@pytest.mark.parametrize("n", [1, 2, 7, 64, 300])
def test_least_parabola(n):
    rng = np.random.default_rng(n)
    x = np.arange(n) * 3.0
    for m in (1, max(1, n // 3), n):
        at = np.sort(rng.choice(x, m, replace=False))
        height = rng.integers(0, 40, m).astype(float) ** 2
        want = ((x[:, None] - at[None, :]) ** 2 + height[None, :]).min(axis=1)
        assert np.allclose(proximity._least_parabola(at, height, x), want)


def test_mahalanobis(spark, six):
    rows, features = six
    got = {r["id"]: r["mahalanobis"] for r in validation.mahalanobis(rows.withColumn("x0", F.when(F.col("id") != 3, F.col("x0") + 1e6)), features, F.col("label") == 1, ridge=1e-9).collect()}
    held = np.array([[r[f] for f in features] for r in rows.where("label = 1 and id <> 3").collect()])
    inverse, mean = np.linalg.inv(np.cov(held.T, bias=True)), held.mean(0)
    assert got[3] is None
    for r in rows.where("id between 10 and 30").collect():
        d = np.array([r[f] for f in features]) - mean
        assert got[r["id"]] == pytest.approx(math.sqrt(d @ inverse @ d), rel=1e-5)


def test_script_edges_follow_the_edge_magnitude(spark):
    a = np.zeros((40, 44))
    a[:, 21:] = 90.0
    cells = {(r["row"], r["col"]) for r in lineaments.percentile_edges(grid(spark, a), 44, 40, 0.85, 4).collect()}
    assert cells == {(i, 5) for i in range(10)}  # the step lies at column 20.5; strong cells are 20 and 21
    assert lineaments.percentile_edges(grid(spark, np.ones((8, 8))), 8, 8).count() == 0
    lines = lineaments.script_lineaments(grid(spark, a), 44, 40, 0.0, 0.0, 30.0, votes=8, least=8.0).collect()
    assert lines and all(r["length_m"] > 500 and min(r["azimuth"], 180 - r["azimuth"]) < 10 for r in lines)


def test_missing_values_stay_missing(spark):
    from lodestrata.functions import mapalgebra as m

    one = spark.createDataFrame([(None, 2.0, None, 1.0), (50.0, None, 0.0, 0.0), (1.0, 2.0, 3.0, 4.0)], "n double, d double, gx double, gy double")
    got = one.select(m.clamped_ratio(F.col("n"), F.col("d")), focal.script_hillshade(F.col("gx"), F.col("gy"))).collect()
    assert got[0] == (None, None) and got[1][0] == 10.0 and got[2][0] == 0.5 and 0 <= got[2][1] <= 255
    rows = spark.createDataFrame([(0.05, 0)] * 10 + [(None, 1)] * 10 + [(0.9, None)] * 10, "score double, label int")
    assert validation.calibration_error(rows).first()["ece"] == pytest.approx(0.05)


def test_style_has_a_ramp():
    import xml.etree.ElementTree as ET

    found = ET.fromstring(reports.qgis_style([(0.0, "#000000"), (1.0, "#102030"), (4.0, "#ffffff")], "clay").partition(">")[2])
    ramp = found.find(".//colorramp")
    assert ramp.get("name") == "[clay]" and {p.get("k"): p.get("v") for p in ramp} == {"color1": "0,0,0,255", "color2": "255,255,255,255", "stops": "0.25;16,32,48,255"}


# -- archives and merging


def to_values(data):
    """Stands in for a decoder."""
    return np.frombuffer(data, "<u2").reshape(4, 5)


def test_scene_archive(spark, tmp_path):
    import zipfile

    from lodestrata.sources import archive

    fine = np.arange(48.0).reshape(6, 8) * 100
    coarse = np.arange(12.0).reshape(3, 4) * 1000
    coarse[1, 1] = np.nan
    for name, a in (("b04", fine), ("b11", coarse)):
        raster.write_tiff(a, str(tmp_path / f"{name}.tif"))
    path = str(tmp_path / "scene.zip")
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("X/other.txt", "no")
        z.write(tmp_path / "b04.tif", "X/R10m/T36_B04_10m.tif", zipfile.ZIP_STORED)
        z.write(tmp_path / "b11.tif", "X/R20m/T36_B11_20m.tif", zipfile.ZIP_DEFLATED)
        z.write(tmp_path / "b11.tif", "X/R60m/T36_B04_60m.tif", zipfile.ZIP_DEFLATED)
    listed = archive.members(path)
    assert [m.name for m in listed][1:3] == ["X/R10m/T36_B04_10m.tif", "X/R20m/T36_B11_20m.tif"] and archive.band_member(listed, "B04").name.endswith("10m.tif") and archive.band_member(listed, "B8A") is None
    got = {(r["row"], r["col"]): r for r in archive.read_scene(spark, path, ["B04", "B11", "B12"]).collect()}
    assert len(got) == 48 and set(next(iter(got.values())).asDict()) == {"row", "col", "B04", "B11"}
    for (i, j), r in got.items():
        assert r["B04"] == fine[i, j] / 1e4
        y, x = (i + 0.5) / 2 - 0.5, (j + 0.5) / 2 - 0.5
        total = weight = 0.0
        for a in (math.floor(y), math.floor(y) + 1):
            for b in (math.floor(x), math.floor(x) + 1):
                w = (1 - abs(y - a)) * (1 - abs(x - b))
                if 0 <= a < 3 and 0 <= b < 4 and not np.isnan(coarse[a, b]):
                    total, weight = total + w * coarse[a, b], weight + w
        assert (r["B11"] is None) == (weight == 0) and (not weight or r["B11"] == pytest.approx(total / weight / 1e4))
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("T36_B02.jp2", np.arange(20, dtype="<u2").tobytes(), zipfile.ZIP_DEFLATED)
    with pytest.raises(Exception, match="no decoder"):
        archive.read_archive(spark, path, ["B02"]).collect()
    with pytest.raises(Exception, match="no zip"):
        archive.members(str(tmp_path / "b04.tif"))


def test_merging_of_sources_by_brute_force(spark):
    rng = random.Random(21)
    points = [(k, round(rng.random() * 20, 2), round(rng.random() * 20, 2), rng.random() < 0.5) for k in range(150)]
    gone = set()
    for i, xi, yi, _ in points:
        if i in gone:
            continue
        for j, xj, yj, second in points:
            if j > i and j not in gone and math.hypot(xi - xj, yi - yj) < 1.5:
                gone.add(j if second else i)
    got = proximity.merge_sources(spark.createDataFrame(points, "id long, x double, y double, secondary boolean"), 1.5)
    assert {r["id"] for r in got.collect()} == {p[0] for p in points} - gone and 10 < len(gone) < 140


def test_png_round_trip(spark, tmp_path, monkeypatch):
    import struct
    import zlib

    from lodestrata.sources import png_sink

    monkeypatch.setattr(png_sink, "STRIP", 5)
    rng = np.random.default_rng(8)
    a = rng.integers(0, 256, (17, 9, 3))
    rows = [(i, j, *(x / 255 for x in a[i, j].tolist())) for i in range(17) for j in range(9) if not (5 <= i < 10 or (i, j) == (0, 3))]
    rows.append((1, 40, 0.5, 0.5, 0.5))
    a[5:10], a[0, 3] = 255, 255
    path = tmp_path / "x.png"
    png_sink.write_png(spark.createDataFrame(rows, "row int, col int, red double, green double, blue double").repartition(3), str(path), 9, 17)
    data, at, idat, kinds = path.read_bytes(), 8, b"", []
    while at < len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        assert struct.unpack(">I", data[at + 8 + n : at + 12 + n])[0] == zlib.crc32(data[at + 4 : at + 8 + n])
        kinds.append(kind)
        idat += data[at + 8 : at + 8 + n] if kind == b"IDAT" else b""
        at += 12 + n
    assert kinds[0] == b"IHDR" and kinds[-1] == b"IEND"
    raw = np.frombuffer(zlib.decompress(idat), np.uint8).reshape(17, 28)  # zlib holds the whole to its sum
    assert not raw[:, 0].any() and np.array_equal(raw[:, 1:].reshape(17, 9, 3), a)
    assert [p.name for p in tmp_path.iterdir()] == ["x.png"]


def test_baselines_by_hand(spark, six):
    from lodestrata.operators import audit

    rows, features = six
    folded = rows.withColumn("fold", (F.col("id") % 3).cast("int"))
    held = [(r["id"], r["label"], [r[f] for f in features]) for r in rows.collect()]

    def precision(scores):
        seen = hits = 0
        total, out = sum(y for _, y in scores), 0.0
        for s in sorted({s for s, _ in scores}, reverse=True):
            own = [y for t, y in scores if t == s]
            seen, hits = seen + len(own), hits + sum(own)
            out += sum(own) / total * hits / seen
        return out

    best = max((precision([(sign * x[i], y) for _, y, x in held]), f) for i, f in enumerate(features) for sign in (1, -1))
    got = {r["name"]: r["ap"] for r in audit.baselines(folded, features, models.logistic(features, 400)).collect()}
    assert got[f"best_feature:{best[1]}"] == pytest.approx(best[0])
    assert got["random"] == pytest.approx(precision([(i * 7919 % 10007, y) for i, y, _ in held]))
    assert got["model"] == pytest.approx(precision([(r["score"], r["label"]) for r in models.cross_validate(folded, models.logistic(features, 400)).collect()]))


def test_tiff_files_of_a_folder(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for k in range(3):
        raster.write_tiff(np.full((4, 5), float(k)), str(tmp_path / "in" / f"t{k}.tif"))
    (tmp_path / "note.txt").write_text("no")
    got = raster.read_tiff_files(spark, str(tmp_path)).groupBy("path").agg(F.count("*").alias("n"), F.avg("z").alias("z")).collect()
    assert sorted((r["path"][-6:], r["n"], r["z"]) for r in got) == [("t0.tif", 20, 0.0), ("t1.tif", 20, 1.0), ("t2.tif", 20, 2.0)]


@pytest.mark.parametrize("few", [1, 50_000])
def test_grouped_quantiles(spark, monkeypatch, few):
    monkeypatch.setattr(quantiles, "FEW", few)
    monkeypatch.setattr(quantiles, "ACCURACY", 100)
    rng = random.Random(few)
    rows = [(None if k % 4 == 3 else "xyz"[k % 4], rng.choice((None, float("nan"), 0.0, 5.0, rng.gauss(0, 1), rng.gauss(0, 1))), k % 5, None if k % 4 else 1.5) for k in range(1200)]
    df = spark.createDataFrame(rows, "g string, a double, b int, c double")
    shares = [0.0, 0.02, 0.5, 0.98, 1.0]
    got = {r["g"]: r for r in quantiles.grouped_quantiles(df, "g", ["a", "b", "c"], shares).collect()}
    assert set(got) == {"x", "y", "z", None}
    for g, r in got.items():
        for i, name in enumerate("abc", 1):
            held = [x[i] for x in rows if x[0] == g and x[i] is not None and x[i] == x[i]]
            assert r[name] == ([None] * 5 if not held else pytest.approx(np.quantile(held, shares).tolist(), rel=1e-12)), (g, name)
