"""Folds, ranking metrics and the five-test audit."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .quantiles import exact_quantiles
from .shared import cut, ship


def _scalars(df: DataFrame, *aggregates: Column) -> DataFrame:
    """`df` with global aggregates as columns: one row, broadcast."""
    return df.crossJoin(F.broadcast(df.agg(*aggregates)))


# -- folds


def spatial_blocks(points: DataFrame, side: float, only_y: bool = False) -> DataFrame:
    """Adds `block`: square blocks numbered by row * columns + column (C1); strips of latitude with `only_y` (D3)."""
    p = _scalars(points, F.min("x").alias("_x0"), F.min("y").alias("_y0"), F.max("x").alias("_x1"))
    row = F.floor((F.col("y") - F.col("_y0")) / side).cast("int")
    col = F.lit(0) if only_y else F.floor((F.col("x") - F.col("_x0")) / side).cast("int")
    cols = F.lit(1) if only_y else F.floor((F.col("_x1") - F.col("_x0")) / side).cast("int") + 1
    return p.withColumn("block", row * cols + col).drop("_x0", "_y0", "_x1")


def strike_segments(points: DataFrame, n: int = 5, azimuth: float = 15.0) -> DataFrame:
    """Adds `block`: quantile segments along a strike direction."""
    at = F.radians(F.lit(azimuth))
    p = points.withColumn("_p", F.col("x") * F.sin(at) + F.col("y") * F.cos(at))
    cuts = exact_quantiles(p, {"p": "_p"}, [(k + 1) / n for k in range(n - 1)])["p"]
    above = sum(((F.col("_p") >= F.lit(b)).cast("int") for b in cuts), F.lit(0))
    return p.withColumn("block", above).drop("_p")


def greedy_folds(points: DataFrame, n_folds: int = 5) -> DataFrame:
    """block, positives, fold: blocks by positives, each to the fold with the fewest so far, the first of equals (C4).

    The order-dependent step folds over one array of blocks (a block is at least kilometres wide, so they are few).
    """
    blocks = points.groupBy("block").agg(F.sum("label").cast("long").alias("positives"))
    order = F.sort_array(F.collect_list(F.struct((-F.col("positives")).alias("n"), "block"))).alias("bs")
    one = blocks.agg(order).withColumn("k", F.least(F.lit(n_folds), F.size("bs")))
    state = F.expr(
        "aggregate(bs, named_struct('load', transform(sequence(1, k), i -> 0L), 'out', cast(array() as array<struct<block: int, positives: bigint, fold: int>>)),"
        " (s, b) -> named_struct("
        "   'load', transform(s.load, (v, i) -> if(i = array_position(s.load, array_min(s.load)) - 1, v - b.n, v)),"
        "   'out', concat(s.out, array(named_struct('block', b.block, 'positives', -b.n, 'fold', cast(array_position(s.load, array_min(s.load)) - 1 as int))))), s -> s.out)"
    )
    return one.select(F.inline(state))


#: Prime over which hash orders are spread: also the number of buckets of an order.
ORDER_PRIME = 10007


def stratified_folds(rows: DataFrame, key: str, label: str, k: int = 5) -> DataFrame:
    """Adds `fold`: rows of each class in a hash order, dealt in turn.

    A row's place is its place within its bucket of the order and the number of rows in the buckets before it: no task sorts a class.
    """
    at = F.pmod(F.col(key) * 7919, F.lit(ORDER_PRIME))
    rows = rows.withColumn("_b", at)
    before = Window.partitionBy(label).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy(label, "_b").agg(F.count("*").alias("_n")).withColumn("_s", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    within = F.row_number().over(Window.partitionBy(label, "_b").orderBy(key)) - 1
    placed = rows.withColumn("_i", within)
    same = placed[label].eqNullSafe(starts[label]) & (placed["_b"] == starts["_b"])
    return placed.join(starts, same).select(*(placed[c] for c in rows.columns if c != "_b"), F.pmod(F.col("_s") + F.col("_i"), F.lit(k)).cast("int").alias("fold"))


def round_robin_folds(points: DataFrame, k: int = 5) -> DataFrame:
    """block, fold: blocks in a hash order, dealt in turn (C5). The order is arithmetic, so any engine repeats it; no task sorts all blocks."""
    blocks = points.select("block").distinct().withColumn("_all", F.lit(0))
    return stratified_folds(blocks, "block", "_all", k).select("block", "fold")


def hold_out_counts(rows: DataFrame, tile: str, label: str) -> DataFrame:
    """For each tile left out: rows and positives inside, and in training outside."""
    inside = rows.groupBy(tile).agg(F.count("*").alias("n_test"), F.sum(label).cast("long").alias("pos_test"))
    total = inside.agg(F.sum("n_test").alias("n"), F.sum("pos_test").alias("p"))
    return inside.crossJoin(F.broadcast(total)).select(tile, "n_test", "pos_test", (F.col("n") - F.col("n_test")).alias("n_train"), (F.col("p") - F.col("pos_test")).alias("pos_train"))


# -- ranking metrics: grouped by score first, so the ordered step sees each score once

#: Ranges of scores over which a curve is cut.
RANGES = 128


def _curve(rows: DataFrame, by: list[str]) -> DataFrame:
    """Each different score with its counts p, n, the counts tp, seen from the highest score down to it, and all of them.

    Scores are cut into about `RANGES` ranges of equal size; running sums go within a range, from the sum of the ranges above it,
    so no task holds all scores. The ranges are small and checkpointed; the other uses of the counts read one shuffle (Spark reuses equal exchanges).
    """
    ok = rows.where("score is not null and label is not null")
    steps = ok.groupBy(*by, "score").agg(F.sum("label").cast("double").alias("p"), F.count("*").cast("double").alias("n"))
    cuts = steps.groupBy(*by).agg(F.percentile_approx("score", F.array(*(F.lit(k / RANGES) for k in range(1, RANGES))), F.lit(10_000)).alias("_cuts"), F.max(F.col("p") + F.col("n")).alias("_top"))
    cuts = cut(cuts.where("_top > 0").withColumn("_cuts", F.array_distinct("_cuts")).drop("_top"))  # a summary depends on the order of its parts: made once, else sums of ranges and ranges of rows may differ

    both = steps.join(cuts, by) if by else steps.crossJoin(F.broadcast(cuts))
    steps = both.withColumn("_range", F.size(F.filter("_cuts", lambda c: c > F.col("score")))).drop("_cuts")
    above = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    all_ = Window.partitionBy(*by)
    totals = steps.groupBy(*by, "_range").agg(F.sum("p").alias("_p"), F.sum("n").alias("_n"))
    zero = F.lit(0.0)
    totals = totals.select(
        *by, "_range", F.coalesce(F.sum("_p").over(above), zero).alias("_tp"), F.coalesce(F.sum("_n").over(above), zero).alias("_seen"), F.sum("_p").over(all_).alias("all_p"), F.sum("_n").over(all_).alias("all_n")
    )
    upto = Window.partitionBy(*by, "_range").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    joined = steps.withColumn("tp", F.sum("p").over(upto)).withColumn("seen", F.sum("n").over(upto)).join(totals, [*by, "_range"])
    return joined.withColumn("tp", F.col("tp") + F.col("_tp")).withColumn("seen", F.col("seen") + F.col("_seen")).drop("_tp", "_seen", "_range")


def average_precision(rows: DataFrame, by: list[str] | None = None, name: str = "ap") -> DataFrame:
    """Sum of recall steps times precision, tied scores as one step; NULL without positives."""
    by = by or []
    return _curve(rows, by).groupBy(*by).agg(F.sum(F.try_divide(F.col("p"), F.col("all_p")) * F.col("tp") / F.col("seen")).alias(name))


def roc_auc(rows: DataFrame, by: list[str] | None = None, name: str = "auc") -> DataFrame:
    """Mann-Whitney, ties one half; NULL with a single class (A10)."""
    by = by or []
    neg = F.col("n") - F.col("p")
    below = (F.col("all_n") - F.col("all_p")) - (F.col("seen") - F.col("tp"))
    wins = F.sum(F.col("p") * (below + neg / 2))
    return _curve(rows, by).groupBy(*by).agg(F.try_divide(wins, F.max("all_p") * (F.max("all_n") - F.max("all_p"))).alias(name))


def pr_auc_trapezoid(rows: DataFrame, by: list[str] | None = None, name: str = "pr_auc") -> DataFrame:
    """Trapezoids under precision over recall from (0, 1); NULL with a single class."""
    by = by or []
    c = _curve(rows, by)
    r, q = F.try_divide("tp", "all_p"), F.col("tp") / F.col("seen")
    r0 = F.try_divide(F.col("tp") - F.col("p"), F.col("all_p"))
    q0 = F.coalesce(F.try_divide(F.col("tp") - F.col("p"), F.col("seen") - F.col("n")), F.lit(1.0))
    return c.groupBy(*by).agg(F.when(F.max("all_p") < F.max("all_n"), F.sum((r - r0) * (q + q0) / 2)).alias(name))


def threshold_metrics(rows: DataFrame, thresholds: tuple[float, ...] = (0.3, 0.5, 0.7), by: list[str] | None = None) -> DataFrame:
    """Precision, recall and F1 at score >= t; 0 where undefined."""
    by = by or []
    fan = rows.withColumn("threshold", F.explode(F.array(*(F.lit(t) for t in thresholds))))
    hit = F.col("score") >= F.col("threshold")
    tp, fp, fn = (F.sum(F.when(c, 1).otherwise(0)).cast("double") for c in (hit & (F.col("label") == 1), hit & (F.col("label") == 0), ~hit & (F.col("label") == 1)))
    out = fan.groupBy(*by, "threshold").agg(tp.alias("tp"), fp.alias("fp"), fn.alias("fn"))
    or0 = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    t, p, n = F.col("tp"), F.col("fp"), F.col("fn")
    return out.select(*by, "threshold", or0(t, t + p).alias("precision"), or0(t, t + n).alias("recall"), or0(2 * t, 2 * t + p + n).alias("f1"))


def fold_means(metrics: DataFrame, columns: list[str]) -> DataFrame:
    """Mean of each metric over the folds that have it."""
    return metrics.agg(*(F.avg(c).alias(f"mean_{c}") for c in columns), F.count("*").alias("folds"))


def calibration_error(rows: DataFrame, bins: int = 10, name: str = "ece") -> DataFrame:
    """Expected calibration error over equal bins, the last one closed; rows without score or label are left out."""
    binned = rows.where("score is not null and not isnan(score) and label is not null").withColumn("bin", F.least(F.floor(F.col("score") * bins), F.lit(bins - 1)))
    each = binned.groupBy("bin").agg(F.count("*").alias("n"), F.avg("label").alias("acc"), F.avg("score").alias("conf"))
    return each.agg((F.sum(F.col("n") * F.abs(F.col("acc") - F.col("conf"))) / F.sum("n")).alias(name))


def label_correlation(rows: DataFrame, features: list[str], threshold: float = 0.95) -> DataFrame:
    """feature, n, r, flagged: Pearson correlation with the label over rows that have both; NULL where either is constant.

    Tasks sum moments about their own means in numpy, a row a feature and task; these combine about the common means, so large means (projected
    coordinates) lose nothing.
    """
    import numpy as np
    import pandas as pd

    ship(rows.sparkSession)

    def task(batches):
        held: list[np.ndarray] = []
        for batch in batches:
            y = batch["y"].to_numpy(np.float64)[:, None]
            x = batch[[f"x{i}" for i in range(len(features))]].to_numpy(np.float64)
            on = ~np.isnan(x) & ~np.isnan(y)
            n = on.sum(0)
            x0, y0 = np.where(on, x, 0.0), np.where(on, y, 0.0)
            mx, my = x0.sum(0) / np.maximum(n, 1), y0.sum(0) / np.maximum(n, 1)
            dx, dy = np.where(on, x0 - mx, 0.0), np.where(on, y0 - my, 0.0)
            held.append(np.array([n, mx, my, (dx * dx).sum(0), (dy * dy).sum(0), (dx * dy).sum(0)]))
        if held:
            n, mx, my, xx, yy, xy = np.stack(held, 1)
            total = np.maximum(n.sum(0), 1)
            cx, cy = (n * mx).sum(0) / total, (n * my).sum(0) / total
            yield pd.DataFrame({"feature": features, "n": n.sum(0).astype(np.int64), "mx": cx, "my": cy, "xx": (xx + n * (mx - cx) ** 2).sum(0), "yy": (yy + n * (my - cy) ** 2).sum(0), "xy": (xy + n * (mx - cx) * (my - cy)).sum(0)})

    asked = rows.select(F.col("label").cast("double").alias("y"), *(F.col(f).cast("double").alias(f"x{i}") for i, f in enumerate(features)))
    parts = cut(asked.mapInPandas(task, "feature string, n long, mx double, my double, xx double, yy double, xy double"))
    means = parts.groupBy("feature").agg(F.sum("n").alias("all"), F.try_divide(F.sum(F.col("n") * F.col("mx")), F.sum("n")).alias("cx"), F.try_divide(F.sum(F.col("n") * F.col("my")), F.sum("n")).alias("cy"))
    both = parts.join(means, "feature")
    dx, dy = F.col("mx") - F.col("cx"), F.col("my") - F.col("cy")
    about = lambda c, d: F.sum(F.col(c) + F.col("n") * d)
    m = both.groupBy("feature").agg(F.max("all").alias("n"), about("xy", dx * dy).alias("c"), F.sqrt(about("xx", dx * dx)).alias("sv"), F.sqrt(about("yy", dy * dy)).alias("sy"))
    r = F.try_divide(F.col("c"), F.col("sv") * F.col("sy"))
    return m.where("n > 0").select("feature", "n", r.alias("r")).withColumn("flagged", F.coalesce((F.abs("r") >= threshold) & (F.col("n") >= 5), F.lit(False)))


def best_single_feature(rows: DataFrame, features: list[str]) -> DataFrame:
    """The feature (as it is or turned round) with the highest average precision, the first of equals.

    One curve serves both directions: read from its other end, a step's counts are all less those before it.
    """
    tall = rows.unpivot(["label"], features, "feature", "score").where("score is not null and not isnan(score)")
    p, tp, seen, all_p, all_n = (F.col(c) for c in ("p", "tp", "seen", "all_p", "all_n"))
    share = F.try_divide(p, all_p)
    ways = _curve(tall, ["feature"]).groupBy("feature").agg(F.sum(share * tp / seen).alias("0"), F.sum(share * (all_p - tp + p) / (all_n - seen + F.col("n"))).alias("1"), F.max("all_n").alias("n"))
    both = ways.where("n >= 10").unpivot(["feature"], ["0", "1"], "turned", "ap")
    place = reduce(lambda c, kv: c.when(F.col("feature") == kv[1], kv[0]), enumerate(features[1:], 1), F.when(F.col("feature") == features[0], 0))
    return both.select("feature", F.col("turned").cast("int").alias("turned"), "ap").orderBy(F.desc("ap"), place, "turned").limit(1)


def random_baseline(rows: DataFrame, key: str, name: str = "ap") -> DataFrame:
    """Average precision of labels in a hash order."""
    return average_precision(rows.withColumn("score", F.pmod(F.col(key) * 7919, F.lit(10007)).cast("double")), name=name)


# -- summaries


def signal_check(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Deposits against background for each index: z, percentile and class (A19). `rows` has value and is_deposit."""
    by = by or []
    ok = rows.where("value is not null and not isnan(value) and abs(value) < 100 and value <> 0")
    dep, bg = F.when(F.col("is_deposit"), F.col("value")), F.when(~F.col("is_deposit"), F.col("value"))
    s = ok.groupBy(*by).agg(F.count(dep).alias("n_dep"), F.count(bg).alias("n_bg"), F.avg(dep).alias("mean_dep"), F.avg(bg).alias("mean_bg"), F.stddev_pop(bg).alias("std_bg")).where("n_dep >= 2 and n_bg >= 100")
    z = F.coalesce(F.try_divide(F.col("mean_dep") - F.col("mean_bg"), F.col("std_bg")), F.lit(0.0))
    s = s.withColumn("z", z)
    below = (ok.join(F.broadcast(s), by) if by else ok.crossJoin(F.broadcast(s))).where(~F.col("is_deposit"))
    p = below.groupBy(*by, *[c for c in s.columns if c not in by]).agg((F.avg((F.col("value") < F.col("mean_dep")).cast("double")) * 100).alias("percentile"))
    size = F.abs("z")
    return p.withColumn("signal", F.when(size > 1.5, "STRONG").when(size > 0.8, "MODERATE").when(size > 0.3, "WEAK").otherwise("NONE"))


def signal_verdict(signals: DataFrame) -> DataFrame:
    """Overall verdict from the number of strong or moderate signals."""
    n = F.count(F.when(F.col("signal").isin("STRONG", "MODERATE"), 1))
    return signals.agg(n.alias("n_signals")).withColumn("verdict", F.when(F.col("n_signals") >= 3, "PROMISING").when(F.col("n_signals") >= 1, "PARTIAL").otherwise("NO_SIGNAL"))


def hold_out_summary(tiles: DataFrame, gate: float = 0.45, pooled: DataFrame | None = None) -> DataFrame:
    """Mean, positives-weighted mean, lift and gate of tile scores (tile, auc, positives, base).

    `pooled` (label, score of all tiles' rows) adds pooled_auc, the area over all of them together.
    """
    w = F.try_divide(F.sum(F.col("positives") * F.col("auc")), F.sum(F.when(F.col("auc").isNotNull(), F.col("positives"))).cast("double"))
    out = tiles.agg(F.avg("auc").alias("mean_auc"), w.alias("weighted_auc"), F.avg("base").alias("base"))
    out = out.withColumn("lift", F.try_divide("mean_auc", "base")).withColumn("passed", F.coalesce(F.col("mean_auc") >= gate, F.lit(False)))
    return out if pooled is None else out.crossJoin(F.broadcast(pr_auc_trapezoid(pooled, name="pooled_auc")))


def set_operations(left: DataFrame, right: DataFrame, column: str) -> DataFrame:
    """kind ("both", "left", "right"), value: the values of a column in both tables, or in one only."""
    sides = left.select(F.col(column).alias("value"), F.lit(1).alias("side")).unionByName(right.select(F.col(column).alias("value"), F.lit(2).alias("side")))
    held = sides.where("value is not null").groupBy("value").agg(F.bit_or("side").alias("side"))
    return held.select(F.when(F.col("side") == 3, "both").when(F.col("side") == 1, "left").otherwise("right").alias("kind"), "value")


#: Name parts that mark rock type, and those that mark prospectivity.
LITHOLOGY = ("ferrous_iron", "spectral_ferrous_iron", "clay_ratio", "spectral_clay_ratio", "ndvi", "spectral_ndvi")
PROSPECTIVITY = (
    "lineament_density", "distance_to_lineaments", "fault_intersection_density", "slope", "aspect", "iron_oxide", "spectral_iron_oxide", "ferric_iron",
    "spectral_ferric_iron", "clay_swir", "spectral_clay_swir", "plan_curvature", "profile_curvature", "drainage_density",
)


def lithology_diagnosis(importances: DataFrame) -> DataFrame:
    """What the five most important features (name, importance) map."""
    top = importances.orderBy(F.desc("importance"), "name").limit(5)
    has = lambda marks: F.sum(F.greatest(*(F.col("name").contains(m).cast("int") for m in marks)))
    out = top.agg(has(LITHOLOGY).alias("n_lithology"), has(PROSPECTIVITY).alias("n_prospectivity"))
    return out.withColumn("diagnosis", F.when(F.col("n_lithology") >= 4, "lithology").when(F.col("n_prospectivity") >= 3, "prospectivity").otherwise("ambiguous"))


def point_scores(points: DataFrame, mahalanobis: str, distance: str, cluster: str, cut: float = 0.65) -> DataFrame:
    """Adds spectral and structural scores (inverted min-max), the composite .5/.3/.2 and the class."""
    p = _scalars(points, *(f(c).alias(f"_{n}{i}") for i, c in enumerate((mahalanobis, distance)) for n, f in (("lo", F.min), ("hi", F.max))))
    inverted = lambda c, i: 1 - F.coalesce(F.try_divide(F.col(c) - F.col(f"_lo{i}"), F.col(f"_hi{i}") - F.col(f"_lo{i}")), F.lit(1.0))
    p = p.withColumn("spectral_similarity", inverted(mahalanobis, 0)).withColumn("structural_proximity", inverted(distance, 1))
    composite = 0.5 * F.col("spectral_similarity") + 0.3 * F.col("structural_proximity") + 0.2 * F.col(cluster)
    p = p.withColumn("composite_score", composite).drop("_lo0", "_hi0", "_lo1", "_hi1")
    return p.withColumn("classification", F.when(F.col("composite_score") >= cut, "ore_bearing").otherwise("barren"))


def mahalanobis(points: DataFrame, features: list[str], reference: Column, name: str = "mahalanobis", ridge: float = 1e-6) -> DataFrame:
    """Adds the Mahalanobis distance of each row's features to the profile of the rows that `reference` marks; NULL where a feature is missing.

    One pass sums the moments of the reference, centred on its first row's values so that large means lose nothing; the driver factors
    one small matrix, and the distance is an expression: the length of the solution of a triangular system. `ridge` times the mean
    variance is added to the diagonal, so a constant feature does no harm.
    """
    import numpy as np

    k = len(features)
    known = reference & F.lit(True)
    for f in features:
        known &= F.col(f).isNotNull() & ~F.isnan(F.col(f).cast("double"))
    used = points.where(known)
    first = used.select(*(F.col(f).cast("double") for f in features)).first()
    if first is None:
        return points.withColumn(name, F.lit(None).cast("double"))
    c = [F.col(f).cast("double") - float(first[i]) for i, f in enumerate(features)]
    pairs = [(i, j) for i in range(k) for j in range(i + 1)]
    sums = used.agg(F.count("*").alias("n"), *(F.sum(x).alias(f"s{i}") for i, x in enumerate(c)), *(F.sum(c[i] * c[j]).alias(f"p{i}_{j}") for i, j in pairs)).first()
    n, mean = sums["n"], np.array([sums[f"s{i}"] for i in range(k)]) / sums["n"]
    cov = np.zeros((k, k))
    for i, j in pairs:
        cov[i, j] = cov[j, i] = sums[f"p{i}_{j}"] / n - mean[i] * mean[j]
    low = np.linalg.cholesky(cov + np.eye(k) * ridge * max(float(np.trace(cov)) / k, 1e-300))
    out, solved = points, []
    for i in range(k):  # forward substitution, a column at a time
        at = c[i] - float(mean[i]) - sum((F.col(solved[j]) * float(low[i, j]) for j in range(i)), F.lit(0.0))
        solved.append(f"_m{i}")
        out = out.withColumn(solved[-1], at / float(low[i, i]))
    return out.withColumn(name, F.sqrt(sum((F.col(s) * F.col(s) for s in solved[1:]), F.col(solved[0]) * F.col(solved[0])))).drop(*solved)


def classify_points(points: DataFrame, features: list[str], reference: Column, structures: DataFrame, radius: float, cut_at: float = 0.65) -> DataFrame:
    """Scores points (id, x, y, features) from raw inputs: distances to the reference's profile and to the nearest structure, and density.

    `structures` are segments (ax, ay, bx, by). Density is the number of marked points within `radius`, over the largest such number.
    """
    from .proximity import buffered_counts, nearest_segment

    rows = mahalanobis(points, features, reference)
    near = nearest_segment(points.select("id", "x", "y"), structures, radius).select("id", F.col("distance").alias("structure_distance"))
    marked = points.where(reference).select(F.col("x").alias("rx"), F.col("y").alias("ry"))
    dense = buffered_counts(points.select("id", "x", "y"), marked, [radius], ["id"]).select("id", F.col(f"within_{radius:g}").alias("n_near"))
    both = rows.join(near, "id", "left").join(dense, "id", "left")
    both = _scalars(both.withColumn("_n", F.coalesce("n_near", F.lit(0))), F.max("_n").alias("_top"))
    both = both.withColumn("cluster_density", F.coalesce(F.try_divide(F.col("_n").cast("double"), F.col("_top").cast("double")), F.lit(0.0))).drop("_n", "_top", "n_near")
    return point_scores(both, "mahalanobis", "structure_distance", "cluster_density", cut_at)


def tile_zscore(rows: DataFrame, tile: str, value: str, name: str = "z") -> DataFrame:
    """Standardises within a tile: moments by a combining aggregate, joined back, so a large tile is no single partition."""
    m = rows.groupBy(tile).agg(F.avg(value).alias("_m"), F.stddev_pop(value).alias("_s"))
    return rows.join(m, tile).withColumn(name, F.try_divide(F.col(value) - F.col("_m"), F.col("_s"))).drop("_m", "_s")


# -- audit


def grade(passed: Column, total: int = 5) -> Column:
    share = passed / total
    return F.when(share >= 1, "A").when(share >= 0.8, "B").when(share >= 0.6, "C").when(share >= 0.4, "D").otherwise("F")


def audit_from_scores(scores: DataFrame, max_gap: float = 0.30, max_ece: float = 0.10, leak: float = 0.95, stable: float = 0.5) -> DataFrame:
    """The five tests and the grade from one row: pr_random, pr_spatial, prior, stable_fraction, ece, max_corr."""
    ok = lambda c: F.coalesce(c, F.lit(False))
    tests = {
        "spatial_leakage": (F.col("pr_random") - F.col("pr_spatial"), F.lit(max_gap), ok(F.col("pr_random") - F.col("pr_spatial") <= max_gap)),
        "beats_class_prior": (F.col("pr_spatial") - F.col("prior"), F.lit(0.0), ok(F.col("pr_spatial") > F.col("prior"))),
        "bootstrap_stability": (F.col("stable_fraction"), F.lit(stable), ok(F.col("stable_fraction") >= stable)),
        "calibration": (F.col("ece"), F.lit(max_ece), ok(F.col("ece") <= max_ece)),
        "feature_label_leakage": (F.col("max_corr"), F.lit(leak), ok(F.col("max_corr") < leak)),
    }
    items = F.array(*(F.struct(F.lit(n).alias("name"), p.alias("passed"), s.cast("double").alias("score"), t.alias("threshold")) for n, (s, t, p) in tests.items()))
    out = scores.withColumn("tests", items).withColumn("tests_passed", F.size(F.filter("tests", lambda t: t["passed"])))
    return out.withColumn("grade", grade(F.col("tests_passed"))).withColumn("passed", F.col("tests_passed") == len(tests))


def certificate(rows: DataFrame, key: list[str], columns: list[str], settings: str = "", levels: int = 1) -> DataFrame:
    """A hash of settings and rows (C22): a tree over the rows' SHA-256, equal for equal tables whatever their order.

    Rows meet in groups by the first 2 x `levels` hex digits of their hash; the groups' hashes meet in groups by two digits
    less, and so on. Each more level lets 256 times as many rows in with groups of the same size: 1 is for some hundred
    thousand rows, 3 for some 10 billion.
    """
    text = F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("NULL")) for c in [*key, *columns]))
    now = rows.select(F.sha2(text, 256).alias("h")).select("h", F.substring("h", 1, 2 * levels).alias("b"))
    for level in range(levels - 1, -1, -1):
        now = now.groupBy("b").agg(F.sha2(F.array_join(F.sort_array(F.collect_list("h")), ""), 256).alias("p"))
        now = now.select(F.concat("b", "p").alias("h"), F.substring("b", 1, 2 * level).alias("b"))
    return now.agg(F.sha2(F.concat(F.lit(settings), F.array_join(F.sort_array(F.collect_list("h")), "")), 256).alias("certificate"))
