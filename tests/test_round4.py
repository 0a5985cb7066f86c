"""Open rings, tall rasters, sums of many tasks, hot buckets and large clusters, each against a plain version."""

import numpy as np

from lodestrata.operators import newton, proximity, validation


def test_open_rings_run_to_the_box_of_their_corners(spark):
    rings = {1: [(0.2, 0.1), (4.9, 0.7), (4.1, 4.8), (0.3, 3.9)], 2: [(0.5, 0.5), (4.5, 0.5), (4.5, 2.5), (0.5, 2.5)], 3: [(3.0, 3.5), (1.0, 0.5), (5.0, 4.5)]}
    sides = [(k, *a, *b) for k, ring in rings.items() for a, b in zip(ring, ring[1:] + ring[:1], strict=True) if k == 2 or b != ring[0]]
    want = set()
    for k in rings:
        own = [s[1:] for s in sides if s[0] == k]
        x0, x1, y0, y1 = (f(s[i] for s in own) for i in (0, 1) for f in (min, max))
        for r in range(int(np.floor(6 - y1)), int(np.floor(6 - y0)) + 1):
            for c in range(int(np.floor(x0)), int(np.floor(x1)) + 1):
                x, y = c + 0.5, 6 - (r + 0.5)
                if sum((ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax for ax, ay, bx, by in own) % 2:
                    want.add((k, r, c))
    got = proximity.rasterize_polygons(spark.createDataFrame(sides, "polygon long, ax double, ay double, bx double, by double"), 0.0, 6.0, 1.0).collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_nearest_marked_cell_of_a_tall_raster(spark):
    kept = [(r, c) for r in range(60) for c in range(7)]
    marks = {(r, c) for r, c in kept if (r * 13 + c * 7) % 23 == 0}
    grid = spark.createDataFrame([(r, c, (r, c) in marks, f"{r}/{c}") for r, c in kept] + [(None, 2, False, "lost"), (3, None, False, "lost")], "row int, col int, mark boolean, also string").repartition(5)
    out = proximity.nearest_marked(grid, 30.0, 20.0)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "unboundedfollowing" not in plan  # such a frame reads the rest of its column again for each cell
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 11)  # rows that go on in the next batch
    try:
        got = {r["also"]: r["distance"] for r in out.where("also <> 'lost'").collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == len(kept)
    for r, c in kept:
        assert abs(got[f"{r}/{c}"] - min(np.hypot((r - i) * 20, (c - j) * 30) for i, j in marks)) < 1e-9
    assert [r["distance"] for r in out.where("also = 'lost'").collect()] == [None, None]


def test_the_driver_gets_one_short_row_a_replicate(spark):
    k, tasks, replicates = 3, 40, 4
    sums = np.arange(1.0, 1 + 3 + k + k * k)
    sums[:2] = 8, 2
    parts = spark.createDataFrame([(r, sums.tobytes()) for r in range(replicates) for _ in range(tasks)], "replicate int, values binary").repartition(tasks)
    found = newton._directions(parts, k, np.zeros((replicates, k)), np.ones(k)).collect()
    assert sorted(r["replicate"] for r in found) == list(range(replicates))
    step = np.linalg.lstsq(sums[3 + k :].reshape(k, k) / 8 + np.eye(k), sums[3 : 3 + k] / 8, rcond=None)[0]
    for r in found:
        got = np.frombuffer(r["values"], np.float64)
        assert np.allclose(got, [8 * tasks, 2 * tasks, sums[2] * tasks, *step])


def _crossings(segments):
    want = {}
    for i, ax, ay, bx, by in segments:
        for j, cx, cy, dx, dy in segments:
            det = (bx - ax) * (dy - cy) - (by - ay) * (dx - cx)
            if i < j and det:
                t, u = ((cx - ax) * (dy - cy) - (cy - ay) * (dx - cx)) / det, ((cx - ax) * (by - ay) - (cy - ay) * (bx - ax)) / det
                if 0 <= t <= 1 and 0 <= u <= 1:
                    want[i, j] = (ax + t * (bx - ax), ay + t * (by - ay))
    return want


def test_crossings_of_hot_buckets_count_once(spark, monkeypatch):
    monkeypatch.setattr(proximity, "HOT", 16)
    draw = np.random.default_rng(5)
    whole = draw.integers(-6, 7, (120, 4)).astype(float)  # ends, crossings and whole segments on the buckets' borders
    free = draw.normal(0, 4, (80, 4)).round(2)
    segments = [(i, *map(float, s)) for i, s in enumerate([*whole, *free])]
    out = proximity.segment_crossings(spark.createDataFrame(segments, "id long, ax double, ay double, bx double, by double"), 2.0)
    assert "l_id#" not in "".join(line for line in out._jdf.queryExecution().executedPlan().toString().splitlines() if "Aggregate" in line)  # pairs are not compared again
    got = out.collect()
    want = _crossings(segments)
    assert len(got) == len(want) and all(np.allclose(want[r["a"], r["b"]], (r["x"], r["y"]), rtol=0, atol=1e-9) for r in got)


def _merged(points, radius):
    gone = set()
    for i, x, y, _ in points:
        if i in gone:
            continue
        for j, p, q, second in points:
            if i < j and j not in gone and np.hypot(x - p, y - q) < radius:
                gone.add(j if second else i)
    return {p[0] for p in points} - gone


def test_sources_of_one_large_cluster(spark, monkeypatch):
    draw = np.random.default_rng(6)
    cluster, chain = draw.normal(0, 6, (400, 2)).round(1), np.stack([np.arange(300) * 0.9, np.arange(300) % 3 * 0.1], 1)
    for share, at, most, large in ((0.5, cluster, 0, 150), (1.0, cluster, 0, 150), (1.0, chain, 1000, 400)):
        points = [(i, float(x), float(y), bool(draw.random() < share)) for i, (x, y) in enumerate(at)]
        lost = [(1000, None, 1.0, True), (1001, None, 1.0, True), (1002, 2.0, None, False)]
        grouped = type(spark.range(1).groupBy("id"))
        with monkeypatch.context() as m:
            m.setattr(proximity, "OPEN", most, raising=False)
            m.setattr(grouped, "applyInArrow", _small(grouped.applyInArrow, large))
            got = [r["id"] for r in proximity.merge_sources(spark.createDataFrame([*points, *lost], "id long, x double, y double, secondary boolean"), 1.0).collect()]
        assert sorted(got) == sorted(_merged(points, 1.0) | {1000, 1001, 1002})


def _small(whole, large):
    """`applyInArrow` that refuses groups of a whole cluster."""

    def apply(self, run, kinds):
        def guarded(table):
            assert table.num_rows <= large
            return run(table)

        return whole(self, guarded, kinds)

    return apply


def test_ranges_of_scores_are_made_once(spark):
    draw = np.random.default_rng(7)
    rows = [(int(draw.random() < 0.3), float(a), float(b)) for a, b in draw.normal(0, 1, (500, 2)).round(2)]
    curve = validation._curve(spark.createDataFrame(rows, "label int, a double, score double"), [])
    assert "percentile_approx" not in curve._jdf.queryExecution().optimizedPlan().toString()  # two summaries of the same scores may differ
    got = {r["score"]: (r["tp"], r["seen"]) for r in curve.collect()}
    assert got == {s: (sum(y for y, _, x in rows if x >= s), sum(x >= s for _, _, x in rows)) for s in {r[2] for r in rows}}
