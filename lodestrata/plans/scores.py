"""Queries of folds, metrics, audit, sampling and models, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import sampling, validation
from ..sources.config import table
from .common import POINTS, SCORED, part_grid, points, r, scored

DIMS = 64


def _features(spark, d, n: int = DIMS):
    e = table(spark, d, "embeddings")
    return e.select(F.col("vec_id").alias("id"), (F.col("label") == 0).cast("int").alias("label"), *(F.col("embedding")[i].cast("double").alias(f"f{i}") for i in range(n)), F.round(F.col("embedding")[0].cast("double") * 1e5, 2).alias("x"), F.round(F.col("embedding")[1].cast("double") * 1e5, 2).alias("y"))


def spatial_blocks(spark, d):
    return validation.spatial_blocks(points(spark, d), 25000.0).select("id", "block")


def latitude_strips(spark, d):
    return validation.spatial_blocks(points(spark, d), 15000.0, True).select("id", "block")


def strike_segments(spark, d):
    return validation.strike_segments(points(spark, d)).select("id", "block")


def loto_counts(spark, d):
    c = table(spark, d, "customer").withColumn("pos", (F.col("c_acctbal") > 5000).cast("int"))
    return validation.hold_out_counts(c, "c_mktsegment", "pos")


def greedy_folds(spark, d):
    return validation.greedy_folds(validation.spatial_blocks(points(spark, d), 10000.0), 5)


def round_robin_folds(spark, d):
    return validation.round_robin_folds(validation.spatial_blocks(points(spark, d), 10000.0), 5)


BLOCKS = "WITH " + POINTS + ", k AS (SELECT (max(floor((x - x0) / 10000)) OVER ())::INT + 1 AS n, id, label, floor((y - y0) / 10000)::INT AS br, floor((x - x0) / 10000)::INT AS bc FROM p, (SELECT min(x) AS x0, min(y) AS y0 FROM p)), b AS (SELECT id, label, br * n + bc AS block FROM k)"
ROUND_ROBIN = BLOCKS + " SELECT block, ((row_number() OVER (ORDER BY (block * 7919) % 10007, block) - 1) % 5)::INT AS fold FROM (SELECT DISTINCT block FROM b)"


def stratified_folds(spark, d):
    return validation.stratified_folds(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "quality").select("doc_id", "fold")


def average_precision(spark, d):
    return validation.average_precision(scored(spark, d)).select(r("ap").alias("ap"))


def average_precision_by_source(spark, d):
    return validation.average_precision(scored(spark, d), ["source"]).select("source", r("ap").alias("ap"))


def roc_auc(spark, d):
    return validation.roc_auc(scored(spark, d)).select(r("auc").alias("auc"))


def pr_auc_trapezoid(spark, d):
    return validation.pr_auc_trapezoid(scored(spark, d)).select(r("pr_auc").alias("pr_auc"))


STEPS = "WITH " + SCORED + ", t AS (SELECT score, sum(label)::DOUBLE AS p, count(*)::DOUBLE AS n FROM s GROUP BY 1), u AS (SELECT *, sum(p) OVER o AS tp, sum(n) OVER o AS seen, sum(p) OVER () AS pp, sum(n) OVER () AS nn FROM t WINDOW o AS (ORDER BY score DESC))"


def threshold_metrics(spark, d):
    return validation.threshold_metrics(scored(spark, d)).select(F.col("threshold").cast("double").alias("threshold"), r("precision").alias("precision"), r("recall").alias("recall"), r("f1").alias("f1"))


THRESHOLDS = "WITH " + SCORED + ", q AS (SELECT t, count(*) FILTER (score >= t AND label = 1)::DOUBLE AS tp, count(*) FILTER (score >= t AND label = 0)::DOUBLE AS fp, count(*) FILTER (score < t AND label = 1)::DOUBLE AS fn FROM s, (SELECT unnest([0.3::DOUBLE, 0.5, 0.7]) AS t) GROUP BY t) SELECT t AS threshold, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) + 0.0 AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) + 0.0 AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) + 0.0 AS f1 FROM q"


def fold_mean_metrics(spark, d):
    m = validation.average_precision(scored(spark, d), ["source"]).join(validation.roc_auc(scored(spark, d), ["source"]), "source")
    return validation.fold_means(m, ["ap", "auc"]).select(r("mean_ap").alias("mean_ap"), r("mean_auc").alias("mean_auc"), "folds")


def calibration_ece(spark, d):
    """Some scores and labels are missing."""
    s = scored(spark, d).withColumn("score", F.when(F.col("doc_id") % 7 != 3, F.col("score"))).withColumn("label", F.when(F.col("doc_id") % 11 != 5, F.col("label")))
    return validation.calibration_error(s).select(r("ece").alias("ece"))


def feature_label_correlation(spark, d):
    t = validation.label_correlation(_features(spark, d).withColumn("constant", F.lit(1.0)), [*(f"f{i}" for i in range(DIMS)), "constant"], 0.3)
    return t.select("feature", "n", r("r").alias("r"), "flagged")


CORR = "WITH t AS (SELECT unnest(range(64)) AS i, embedding, (label = 0)::INT::DOUBLE AS y FROM embeddings), v AS (SELECT 'f' || i AS feature, embedding[i + 1]::DOUBLE AS v, y FROM t), q AS (SELECT feature, count(*) AS n, corr(v, y) AS r FROM v GROUP BY 1) SELECT feature, n, round(r, 6) + 0.0 AS r, abs(r) >= 0.3 AND n >= 5 AS flagged FROM q UNION ALL SELECT 'constant', count(*), NULL, false FROM embeddings"


def best_single_feature(spark, d):
    t = validation.best_single_feature(_features(spark, d), [f"f{i}" for i in range(DIMS)])
    return t.select("feature", "turned", r("ap").alias("ap"))


BEST = "WITH t AS (SELECT unnest(range(64)) AS i, embedding, (label = 0)::INT AS y FROM embeddings), v AS (SELECT i, turned, CASE WHEN turned = 1 THEN -embedding[i + 1]::DOUBLE ELSE embedding[i + 1]::DOUBLE END AS score, y FROM t, (SELECT unnest([0, 1]) AS turned)), s AS (SELECT i, turned, score, sum(y)::DOUBLE AS p, count(*)::DOUBLE AS n FROM v GROUP BY 1, 2, 3), u AS (SELECT *, sum(p) OVER o AS tp, sum(n) OVER o AS seen, sum(p) OVER (PARTITION BY i, turned) AS pp FROM s WINDOW o AS (PARTITION BY i, turned ORDER BY score DESC)) SELECT 'f' || i AS feature, turned, round(sum(p / pp * tp / seen), 6) + 0.0 AS ap FROM u GROUP BY i, turned ORDER BY sum(p / pp * tp / seen) DESC, i, turned LIMIT 1"


def random_baseline(spark, d):
    return validation.random_baseline(table(spark, d, "labels").select("doc_id", F.col("quality").alias("label")), "doc_id").select(r("ap").alias("ap"))


def signal_check(spark, d):
    p = table(spark, d, "part").unpivot([F.col("p_partkey"), F.col("p_brand")], [(F.col("p_retailprice") / 100).alias("price"), F.col("p_size").cast("double").alias("size")], "index", "value")
    t = validation.signal_check(p.withColumn("is_deposit", F.col("p_partkey") % 97 == 0), ["index"])
    return t.select("index", "n_dep", "n_bg", r("mean_dep", 4).alias("mean_dep"), r("mean_bg", 4).alias("mean_bg"), r("std_bg", 4).alias("std_bg"), r("z", 5).alias("z"), r("percentile", 5).alias("percentile"), "signal")


SIGNAL = "WITH v AS (SELECT p_partkey % 97 = 0 AS dep, 'price' AS idx, p_retailprice / 100 AS v FROM part UNION ALL SELECT p_partkey % 97 = 0, 'size', p_size::DOUBLE FROM part), o AS (SELECT * FROM v WHERE abs(v) < 100 AND v <> 0), s AS (SELECT idx, count(*) FILTER (dep) AS n_dep, count(*) FILTER (NOT dep) AS n_bg, avg(v) FILTER (dep) AS md, avg(v) FILTER (NOT dep) AS mb, stddev_pop(v) FILTER (NOT dep) AS sd FROM o GROUP BY 1 HAVING count(*) FILTER (dep) >= 2 AND count(*) FILTER (NOT dep) >= 100), z AS (SELECT *, coalesce((md - mb) / nullif(sd, 0), 0) AS z FROM s) SELECT idx AS index, n_dep, n_bg, round(md, 4) + 0.0 AS mean_dep, round(mb, 4) + 0.0 AS mean_bg, round(sd, 4) + 0.0 AS std_bg, round(z, 5) + 0.0 AS z, round(100.0::DOUBLE * (SELECT avg((o.v < z.md)::INT) FROM o WHERE o.idx = z.idx AND NOT o.dep), 5) + 0.0 AS percentile, CASE WHEN abs(z) > 1.5 THEN 'STRONG' WHEN abs(z) > 0.8 THEN 'MODERATE' WHEN abs(z) > 0.3 THEN 'WEAK' ELSE 'NONE' END AS signal FROM z"


def loto_summary(spark, d):
    s = scored(spark, d)
    t = validation.pr_auc_trapezoid(s, ["source"], "auc").join(s.groupBy("source").agg(F.sum("label").alias("positives"), F.avg("label").alias("base")), "source")
    return validation.hold_out_summary(t, pooled=s).select(*(r(c).alias(c) for c in ("mean_auc", "weighted_auc", "lift", "pooled_auc")), "passed")


def audit_grade(spark, d):
    """The whole audit of a logistic regression over all components, with all its resamples."""
    from ..operators import audit, models

    f = [f"f{i}" for i in range(DIMS)]
    t = audit.audit(_features(spark, d), f, models.logistic(f, 500))
    return t.select(F.explode("tests").alias("t"), "grade", "tests_passed").select("t.name", "t.passed", r("t.score", 4).alias("score"), "grade", "tests_passed")


def audit_tests(spark, d):
    """The five tests over scored rows: sources stand in for spatial folds and for resamples."""
    s = scored(spark, d)
    by = validation.average_precision(s, ["source"])
    prior = s.agg(F.avg("label").alias("prior"))
    steady = by.crossJoin(F.broadcast(prior)).agg(F.avg((F.col("ap") > F.col("prior")).cast("double")).alias("stable_fraction"))
    one = validation.average_precision(s, name="pr_random")
    for more in (validation.fold_means(by, ["ap"]).select(F.col("mean_ap").alias("pr_spatial")), prior, steady, validation.calibration_error(s), s.agg(F.abs(F.try_divide(F.covar_pop("score", F.col("label").cast("double")), F.stddev_pop("score") * F.stddev_pop("label"))).alias("max_corr"))):
        one = one.crossJoin(F.broadcast(more))  # one row each
    t = validation.audit_from_scores(one)
    return t.select(F.explode("tests").alias("t"), "grade", "tests_passed").select("t.name", "t.passed", r("t.score", 5).alias("score"), "grade", "tests_passed")


AUDIT = "WITH " + SCORED + """, t0 AS (SELECT source, score, sum(label)::DOUBLE AS p, count(*)::DOUBLE AS n FROM s GROUP BY 1, 2),
u0 AS (SELECT *, sum(p) OVER o AS tp, sum(n) OVER o AS seen, sum(p) OVER (PARTITION BY source) AS pp FROM t0 WINDOW o AS (PARTITION BY source ORDER BY score DESC)), m AS (SELECT source, sum(p / nullif(pp, 0) * tp / seen) AS ap FROM u0 GROUP BY 1),
t1 AS (SELECT score, sum(label)::DOUBLE AS p, count(*)::DOUBLE AS n FROM s GROUP BY 1), u1 AS (SELECT *, sum(p) OVER o AS tp, sum(n) OVER o AS seen, sum(p) OVER () AS pp FROM t1 WINDOW o AS (ORDER BY score DESC)), a AS (SELECT sum(p / nullif(pp, 0) * tp / seen) AS ap FROM u1),
b AS (SELECT least(floor(score * 10), 9) AS b, count(*) AS n, abs(avg(label) - avg(score)) AS e FROM s GROUP BY 1), k AS (SELECT (SELECT ap FROM a) AS pr, (SELECT avg(ap) FROM m) AS ps, (SELECT avg(label) FROM s) AS prior, (SELECT sum(n * e) / sum(n) FROM b) AS ece, (SELECT abs(corr(score, label)) FROM s) AS c),
f AS (SELECT k.*, (SELECT avg((ap > k.prior)::INT) FROM m) AS st FROM k), t AS (SELECT unnest([{'name': 'spatial_leakage', 'passed': coalesce(pr - ps <= 0.30, false), 'score': pr - ps}, {'name': 'beats_class_prior', 'passed': coalesce(ps > prior, false), 'score': ps - prior}, {'name': 'bootstrap_stability', 'passed': coalesce(st >= 0.5, false), 'score': st}, {'name': 'calibration', 'passed': coalesce(ece <= 0.10, false), 'score': ece}, {'name': 'feature_label_leakage', 'passed': coalesce(c < 0.95, false), 'score': c}]) AS t FROM f),
n AS (SELECT count(*) FILTER (t.passed)::INT AS tests_passed FROM t) SELECT t.name AS name, t.passed AS passed, round(t.score, 5) + 0.0 AS score, CASE tests_passed WHEN 5 THEN 'A' WHEN 4 THEN 'B' WHEN 3 THEN 'C' WHEN 2 THEN 'D' ELSE 'F' END AS grade, tests_passed FROM t, n"""


def baseline_table(spark, d):
    from ..operators import audit, models

    f = [f"f{i}" for i in range(DIMS)]
    rows = validation.stratified_folds(_features(spark, d), "id", "label", 3)
    return audit.baselines(rows, f, models.logistic(f, 500)).select("name", r("ap", 4).alias("ap"))


def certificate_hash(spark, d):
    return validation.certificate(table(spark, d, "labels"), ["doc_id"], ["quality", "toxic"], "v1")


CERT = "WITH e AS (SELECT sha256(doc_id::VARCHAR || '|' || quality::VARCHAR || '|' || toxic::VARCHAR) AS h FROM labels), p AS (SELECT left(h, 2) AS b, sha256(string_agg(h, '' ORDER BY h)) AS p FROM e GROUP BY 1) SELECT sha256('v1' || string_agg(b || p, '' ORDER BY b || p)) AS certificate FROM p"


def point_score_classify(spark, d):
    k = F.col("s_suppkey")
    s = table(spark, d, "supplier").select("s_suppkey", F.col("s_acctbal").alias("mahal"), (k * 37 % 91).cast("double").alias("dist"), ((k % 11) / 10.0).alias("dens"))
    t = validation.point_scores(s, "mahal", "dist", "dens")
    return t.select("s_suppkey", r("composite_score").alias("composite_score"), "classification")


POINT = "WITH s AS (SELECT s_suppkey, s_acctbal AS m, (s_suppkey * 37 % 91)::DOUBLE AS d, (s_suppkey % 11) / 10.0::DOUBLE AS c FROM supplier), q AS (SELECT s_suppkey, 0.5 * (1 - (m - min(m) OVER ()) / (max(m) OVER () - min(m) OVER ())) + 0.3 * (1 - (d - min(d) OVER ()) / (max(d) OVER () - min(d) OVER ())) + 0.2 * c AS v FROM s) SELECT s_suppkey, round(v, 6) + 0.0 AS composite_score, CASE WHEN v >= 0.65 THEN 'ore_bearing' ELSE 'barren' END AS classification FROM q"


#: Stand-in feature names, dealt to the brands of parts.
_NAMED = ("ferrous_iron", "clay_ratio", "slope", "ndvi", "lineament_density", "aspect", "silica", "iron_oxide", "elevation")


def lithology_diagnosis(spark, d):
    """Brands' mean prices as importances, each under a feature's name."""
    p = table(spark, d, "part").groupBy("p_brand").agg(F.round(F.avg("p_retailprice"), 4).alias("importance"))
    pick = F.element_at(F.array(*map(F.lit, _NAMED)), F.ascii(F.substring("p_brand", -1, 1)) % len(_NAMED) + 1)
    return validation.lithology_diagnosis(p.select(F.concat(pick, F.lit("_"), "p_brand").alias("name"), "importance"))


def _lithology_sql() -> str:
    names = ", ".join(f"'{n}'" for n in _NAMED)
    has = lambda marks: f"count(*) FILTER ({' OR '.join(f'contains(name, {m!r})' for m in marks)})"
    return f"WITH p AS (SELECT p_brand, round(avg(p_retailprice), 4) AS importance FROM part GROUP BY 1), q AS (SELECT [{names}][ascii(right(p_brand, 1)) % {len(_NAMED)} + 1] || '_' || p_brand AS name, importance FROM p ORDER BY 2 DESC, 1 LIMIT 5), n AS (SELECT {has(validation.LITHOLOGY)} AS n_lithology, {has(validation.PROSPECTIVITY)} AS n_prospectivity FROM q) SELECT *, CASE WHEN n_lithology >= 4 THEN 'lithology' WHEN n_prospectivity >= 3 THEN 'prospectivity' ELSE 'ambiguous' END AS diagnosis FROM n"


def weighted_negatives(spark, d):
    c = part_grid(spark, d).withColumn("x", F.col("col") * 30.0).withColumn("y", F.col("row") * 30.0).withColumn("intensity", (F.col("z") % 100) / 100)
    return sampling.negatives(c, c.where("row % 10 = 3 and col % 10 = 4").select("x", "y"), 90.0, 5)


def draw_sql(name: str, seed: int, *keys: str) -> str:
    """`sampling.draw` as select items, the last of which is `name`."""
    from ..operators.sampling import FACTOR, PRIME

    items, last = [], str(seed)
    for i, k in enumerate(keys):
        items += [f"({last}::BIGINT * {FACTOR} + ({k})::BIGINT) % {PRIME} AS {name}_a{i}", f"({name}_a{i} * {name}_a{i} + 12345) % {PRIME} AS {name}_b{i}"]
        last = f"{name}_b{i}"
    return ", ".join([*items, f"({last} + 0.5) / {PRIME}.0::DOUBLE AS {name}"])


NEGATIVES = f"""WITH g AS (SELECT (p_partkey // 50)::INT AS r, (p_partkey % 50)::INT AS c, p_retailprice AS z FROM part), k AS (SELECT r, c, z, c * 30.0::DOUBLE AS x, r * 30.0::DOUBLE AS y, (z % 100) / 100 AS intensity FROM g),
e AS (SELECT x, y FROM k WHERE r % 10 = 3 AND c % 10 = 4), f AS (SELECT * FROM k WHERE NOT EXISTS (SELECT 1 FROM e WHERE sqrt((k.x - e.x) * (k.x - e.x) + (k.y - e.y) * (k.y - e.y)) <= 90)), w AS (SELECT count(*) > 0 AS found FROM f WHERE intensity >= 0.2), p AS (SELECT r, c, z, x, y, CASE WHEN found THEN intensity ELSE 1.0::DOUBLE END AS intensity FROM f, w WHERE intensity >= 0.2 OR NOT found), u AS (SELECT *, {draw_sql("u", 42, "r", "c")} FROM p)
SELECT r AS "row", c AS col, z, x, y, intensity FROM u ORDER BY -ln(u) / intensity, r, c LIMIT (SELECT 5 * count(*) FROM e)"""


def exploration_intensity(spark, d):
    from .common import height

    g = part_grid(spark, d).withColumn("n", F.when(F.col("z") % 7 < 1, 1).otherwise(0))
    return sampling.exploration_intensity(g, 50, height(g), 3).select("row", "col", r("intensity").alias("intensity"))


def lr_spatial_cv(spark, d):
    from ..operators import models

    rows = _features(spark, d)
    blocks = validation.spatial_blocks(rows, 10000.0)
    folded = blocks.join(F.broadcast(validation.round_robin_folds(blocks, 3)), "block")  # one row a block
    scored_ = models.cross_validate(folded, models.logistic([f"f{i}" for i in range(DIMS)], 500))
    return models.fold_metrics(scored_)


#: Replicates that the scoring of rasters takes.
ENSEMBLE = 20


def rf_predict(spark, d):
    """A forest's probability of each cell and the spread of an ensemble of regressions over it."""
    from ..operators import models

    rows, f = _features(spark, d), [f"f{i}" for i in range(DIMS)]
    model = models.forest(f, trees=100, depth=8).fit(rows)
    cells = rows.withColumn("row", F.col("id").cast("int")).withColumn("col", F.lit(0)).select("row", "col", *f)
    ensemble = models.bootstrap_coefficients(rows, f, ENSEMBLE, "id", 1 / 500)
    return models.predict_cells(cells, model, f, ensemble).select("row", "col", r("prob").alias("prob"), r("uncertainty").alias("uncertainty"))


def bootstrap_uncertainty(spark, d):
    from ..operators import models

    rows, f = _features(spark, d), [f"f{i}" for i in range(DIMS)]
    fits = models.bootstrap_coefficients(rows, f, 200, "id", 1 / 500)
    return models.sign_stability(fits, f, spark).select("feature", *(r(c).alias(c) for c in ("mean", "low", "high", "consistency")), "stable")


def forest_attributions(spark, d):
    """Mean size of a forest's Shapley values for each feature, over all rows."""
    from ..operators import attributions, models

    rows, f = _features(spark, d), [f"f{i}" for i in range(DIMS)]
    model = models.forest(f, trees=100, depth=8).fit(rows)
    found = attributions.attributions(model, rows, f, ["id"])
    return attributions.mean_attribution(found, f).select("name", r("importance", 9).alias("importance"))


#: Two trees of given splits: tree, node, left, right, feature, threshold, and the rows that reach the node.
GIVEN = (
    (0, 0, 1, 2, 0, 0.0, "true"), (0, 1, 3, 4, 1, 0.0, "f0 <= 0"), (0, 2, 5, 6, 2, 0.01, "f0 > 0"), (0, 3, -1, -1, -1, 0.0, "f0 <= 0 and f1 <= 0"), (0, 4, -1, -1, -1, 0.0, "f0 <= 0 and f1 > 0"),
    (0, 5, -1, -1, -1, 0.0, "f0 > 0 and f2 <= 0.01"), (0, 6, -1, -1, -1, 0.0, "f0 > 0 and f2 > 0.01"),
    (1, 0, 1, 2, 1, -0.05, "true"), (1, 1, -1, -1, -1, 0.0, "f1 <= -0.05"), (1, 2, 3, 4, 1, 0.05, "f1 > -0.05"), (1, 3, -1, -1, -1, 0.0, "f1 > -0.05 and f1 <= 0.05"), (1, 4, -1, -1, -1, 0.0, "f1 > 0.05"),
)


def _given(spark, d):
    """Shapley values of two given trees whose covers and values are those of the table."""
    from ..operators import attributions

    rows = _features(spark, d, 3)
    reach = [F.expr(node[6]) for node in GIVEN]
    stats = rows.agg(*(F.struct(F.count(F.when(c, 1)).alias("n"), F.avg(F.when(c, F.col("label"))).alias("mean")).alias(f"s{i}") for i, c in enumerate(reach))).first()
    nodes = [dict(zip(("tree", "id", "left", "right", "feature", "threshold"), node[:6], strict=True)) | {"cover": float(stats[i]["n"]), "value": stats[i]["mean"] or 0.0, "weight": 0.5} for i, node in enumerate(GIVEN)]
    return attributions.attribute_rows(attributions.leaves(nodes), rows, ["f0", "f1", "f2"], ["id"])


def given_attributions(spark, d):
    return _given(spark, d).select("id", *(r(c, 9).alias(c) for c in ("base", "f0", "f1", "f2")))


def attribution_ranking(spark, d):
    """Mean sizes of the attributions, and whether features of exploration lead."""
    from ..operators import attributions

    names = {"f0": "slope", "f1": "distance_to_road", "f2": "clay_ratio"}
    ranked = attributions.mean_attribution(_given(spark, d).withColumnsRenamed(names), list(names.values()))
    warned = attributions.exploration_bias(ranked).select("biased", F.array_join("features", ",").alias("bias_features"))
    return ranked.crossJoin(F.broadcast(warned)).select("name", r("importance", 9).alias("importance"), "biased", "bias_features")  # one row


def _given_sql() -> str:
    """The same by the definition: values of all coalitions of the first tree's features; the second tree has one feature."""
    from itertools import combinations
    from math import factorial

    left = lambda s: "CASE WHEN b THEN l1 ELSE l2 END" if 1 in s else "(n1 * l1 + n2 * l2) / (n1 + n2)"
    right = lambda s: "CASE WHEN c THEN l3 ELSE l4 END" if 2 in s else "(n3 * l3 + n4 * l4) / (n3 + n4)"
    whole = lambda s: f"(CASE WHEN a THEN {left(s)} ELSE {right(s)} END)" if 0 in s else f"(((n1 + n2) * ({left(s)}) + (n3 + n4) * ({right(s)})) / (n1 + n2 + n3 + n4))"
    phi = {}
    for i in range(3):
        others = [s for k in range(3) for s in combinations([j for j in range(3) if j != i], k)]
        phi[i] = " + ".join(f"{factorial(len(s)) * factorial(2 - len(s)) / 6!r} * ({whole({*s, i})} - {whole(set(s))})" for s in others)
    means = ", ".join(f"avg(y) FILTER ({w}) AS l{k}, count(*) FILTER ({w})::DOUBLE AS n{k}" for k, w in enumerate(("f0 <= 0 AND f1 <= 0", "f0 <= 0 AND f1 > 0", "f0 > 0 AND f2 <= 0.01", "f0 > 0 AND f2 > 0.01", "f1 <= -0.05", "f1 > -0.05 AND f1 <= 0.05", "f1 > 0.05"), 1))
    other = "(CASE WHEN f1 <= -0.05 THEN l5 WHEN f1 <= 0.05 THEN l6 ELSE l7 END - (n5 * l5 + n6 * l6 + n7 * l7) / (n5 + n6 + n7))"
    return f"""WITH e AS (SELECT vec_id AS id, (label = 0)::INT AS y, embedding[1]::DOUBLE AS f0, embedding[2]::DOUBLE AS f1, embedding[3]::DOUBLE AS f2 FROM embeddings), m AS (SELECT {means} FROM e),
x AS (SELECT *, f0 <= 0 AS a, f1 <= 0 AS b, f2 <= 0.01 AS c FROM e, m)
SELECT id, round(0.5 * ({whole(set())} + (n5 * l5 + n6 * l6 + n7 * l7) / (n5 + n6 + n7)), 9) + 0.0 AS base, round(0.5 * ({phi[0]}), 9) + 0.0 AS f0, round(0.5 * ({phi[1]} + {other}), 9) + 0.0 AS f1, round(0.5 * ({phi[2]}), 9) + 0.0 AS f2 FROM x"""


def boosted_early_stop(spark, d):
    """Rounds of a boosted ensemble with sampled columns, and its average precision on held-out rows where it stopped."""
    from ..operators import boosting

    rows, f = _features(spark, d), [f"f{i}" for i in range(DIMS)]
    folded = validation.stratified_folds(rows, "id", "label", 5)
    model = boosting.fit_boosted(folded.where("fold <> 0"), folded.where("fold = 0"), f, "id", rounds=20, depth=3, patience=5)
    return spark.createDataFrame([(k, v, k <= model.best) for k, v in enumerate(model.history)], "round int, ap double, kept boolean").select("round", r("ap").alias("ap"), "kept")


#: Replicates and penalty of the regressions over one feature, which SQL repeats step by step.
REPLICATES, PENALTY = 40, 0.002


def _one_feature(spark, d):
    e = table(spark, d, "embeddings")
    return e.select(F.col("vec_id").alias("id"), (F.col("label") == 0).cast("int").alias("label"), (F.col("embedding")[0].cast("double") * 4).alias("x"))


def logistic_fold_scores(spark, d):
    """Out-of-fold scores of a regression over one feature, in three folds."""
    from ..operators import models

    rows = _one_feature(spark, d).withColumn("fold", (F.col("id") % 3).cast("int"))
    return models.cross_validate(rows, models.logistic(["x"], round(1 / PENALTY))).select("id", "fold", r("score").alias("score"))


def bootstrap_signs(spark, d):
    """Sign stability of one coefficient over Poisson resamples."""
    from ..operators import models

    beta = models.bootstrap_coefficients(_one_feature(spark, d), ["x"], REPLICATES, "id", PENALTY)
    return models.sign_stability(beta, ["x"], spark).select("feature", *(r(c).alias(c) for c in ("mean", "low", "high", "consistency")), "stable")


def ensemble_uncertainty(spark, d):
    """Spread of the resamples' predictions over cells, some of which lack the feature."""
    from ..operators import models

    rows = _one_feature(spark, d)
    cells = rows.select(F.floor(F.col("id") / 50).cast("int").alias("row"), (F.col("id") % 50).cast("int").alias("col"), F.when(F.col("id") % 13 != 5, F.col("x")).alias("x"))
    beta = models.bootstrap_coefficients(rows, ["x"], REPLICATES, "id", PENALTY)
    return models.predict_cells(cells, models.logistic(["x"], 500).fit(rows), ["x"], beta).select("row", "col", r("uncertainty").alias("uncertainty"))


def _newton_sql(weighted: str) -> str:
    """CTEs up to `b` (g, b0, b1): for each group g of `weighted` (g, x, y, w) the regression's intercept and coefficient, by Newton's steps."""
    return f"""w AS ({weighted}), n AS (SELECT g, sum(w)::DOUBLE AS n FROM w GROUP BY 1),
s(k, g, b0, b1) AS (SELECT 0, g, 0.0::DOUBLE, 0.0::DOUBLE FROM n UNION ALL SELECT k + 1, g, b0 + (h11 * g0 - h01 * g1) / (h00 * h11 - h01 * h01), b1 + (h00 * g1 - h01 * g0) / (h00 * h11 - h01 * h01)
  FROM (SELECT k, g, b0, b1, sum(w * (y - p)) / any_value(n) AS g0, sum(w * x * (y - p)) / any_value(n) - {PENALTY} * b1 AS g1, sum(w * p * (1 - p)) / any_value(n) AS h00, sum(w * p * (1 - p) * x) / any_value(n) AS h01, sum(w * p * (1 - p) * x * x) / any_value(n) + {PENALTY} AS h11
    FROM (SELECT s.k, s.g, s.b0, s.b1, n.n, w.x, w.y, w.w, 1 / (1 + exp(-(s.b0 + s.b1 * w.x))) AS p FROM s JOIN w ON w.g = s.g JOIN n ON n.g = s.g WHERE s.k < 14) GROUP BY k, g, b0, b1)),
b AS (SELECT g, b0, b1 FROM s WHERE k = 14)"""


def _resamples_sql() -> str:
    import math

    limits, total = [], 0.0
    for k in range(8):
        total += math.exp(-1) / math.factorial(k)
        limits.append(total)
    copies = " + ".join(f"(u > {v!r}::DOUBLE)::INT" for v in limits)
    fan = f"SELECT *, {draw_sql('u', 0, 'id', 'rep')} FROM r, (SELECT unnest(range({REPLICATES})) AS rep)"
    return _newton_sql(f"SELECT rep AS g, x, y, ({copies})::DOUBLE AS w FROM ({fan})")


_ONE = "WITH RECURSIVE r AS (SELECT vec_id AS id, (label = 0)::INT AS y, embedding[1]::DOUBLE * 4 AS x FROM embeddings), "
FOLD_SCORES = _ONE + _newton_sql("SELECT f AS g, x, y, 1.0::DOUBLE AS w FROM r, (SELECT unnest([0, 1, 2]) AS f) WHERE id % 3 <> f") + " SELECT id, (id % 3)::INT AS fold, round(1 / (1 + exp(-(b0 + b1 * x))), 6) + 0.0 AS score FROM r JOIN b ON g = id % 3"
SIGNS = _ONE + _resamples_sql() + ", t AS (SELECT avg(b1) AS mean, quantile_cont(b1, 0.025) AS low, quantile_cont(b1, 0.975) AS high, avg((b1 > 0)::INT) AS up FROM b) SELECT 'x' AS feature, round(mean, 6) + 0.0 AS mean, round(low, 6) + 0.0 AS low, round(high, 6) + 0.0 AS high, round(greatest(up, 1 - up), 6) + 0.0 AS consistency, greatest(up, 1 - up) >= 0.95 AS stable FROM t"
SPREAD = _ONE + _resamples_sql() + " SELECT (id // 50)::INT AS \"row\", (id % 50)::INT AS col, CASE WHEN id % 13 <> 5 THEN round(100 * stddev_pop(1 / (1 + exp(-(b0 + b1 * x)))), 6) + 0.0 END AS uncertainty FROM r, b GROUP BY id"

GREEDY = BLOCKS.replace("WITH ", "WITH RECURSIVE ", 1) + """, n AS (SELECT block, sum(label)::BIGINT AS positives FROM b GROUP BY 1), o AS (SELECT *, row_number() OVER (ORDER BY positives DESC, block) AS i FROM n),
w AS (SELECT 0::BIGINT AS i, list_transform(range(least(5, (SELECT count(*) FROM n))), lambda x: 0::BIGINT) AS load, NULL::INT AS block, NULL::BIGINT AS positives, NULL::INT AS fold
  UNION ALL SELECT o.i, list_transform(w.load, lambda v, k: CASE WHEN k = list_position(w.load, list_min(w.load)) THEN v + o.positives ELSE v END), o.block, o.positives, (list_position(w.load, list_min(w.load)) - 1)::INT FROM w JOIN o ON o.i = w.i + 1)
SELECT block, positives, fold FROM w WHERE i > 0"""
_BY_SOURCE = "WITH " + SCORED + """, t AS (SELECT source, score, sum(label)::DOUBLE AS p, count(*)::DOUBLE AS n FROM s GROUP BY 1, 2),
u AS (SELECT *, sum(p) OVER o AS tp, sum(n) OVER o AS seen, sum(p) OVER (PARTITION BY source) AS pp, sum(n) OVER (PARTITION BY source) AS nn FROM t WINDOW o AS (PARTITION BY source ORDER BY score DESC))"""
FOLD_MEANS = _BY_SOURCE + """, m AS (SELECT source, sum(p / nullif(pp, 0) * tp / seen) AS ap, sum(p * ((nn - pp) - (seen - tp) + (n - p) / 2)) / nullif(max(pp) * (max(nn) - max(pp)), 0) AS auc FROM u GROUP BY 1)
SELECT round(avg(ap), 6) + 0.0 AS mean_ap, round(avg(auc), 6) + 0.0 AS mean_auc, count(*) AS folds FROM m"""
LOTO = _BY_SOURCE + """, v AS (SELECT source, score, pp, nn, tp / nullif(pp, 0) AS r, tp / seen AS q FROM u), x AS (SELECT *, coalesce(lag(r) OVER o, 0) AS r0, coalesce(lag(q) OVER o, 1) AS q0 FROM v WINDOW o AS (PARTITION BY source ORDER BY score DESC)),
t1 AS (SELECT score, sum(label)::DOUBLE AS p, count(*)::DOUBLE AS n FROM s GROUP BY 1), u1 AS (SELECT score, sum(p) OVER o / sum(p) OVER () AS r, sum(p) OVER o / sum(n) OVER o AS q FROM t1 WINDOW o AS (ORDER BY score DESC)), y AS (SELECT r, q, coalesce(lag(r) OVER o, 0) AS r0, coalesce(lag(q) OVER o, 1) AS q0 FROM u1 WINDOW o AS (ORDER BY score DESC)),
a AS (SELECT source, max(pp) AS positives, max(pp) / max(nn) AS base, CASE WHEN max(pp) < max(nn) THEN sum((r - r0) * (q + q0) / 2) END AS auc FROM x GROUP BY 1)
SELECT round(avg(auc), 6) + 0.0 AS mean_auc, round(sum(positives * auc) / sum(positives) FILTER (auc IS NOT NULL), 6) + 0.0 AS weighted_auc, round(avg(auc) / avg(base), 6) + 0.0 AS lift, coalesce(avg(auc) >= 0.45, false) AS passed, (SELECT round(sum((r - r0) * (q + q0) / 2), 6) + 0.0 FROM y) AS pooled_auc FROM a"""


def _exploration_sql() -> str:
    from .rasters import _mirror

    part = "g AS (SELECT (p_partkey // 50)::INT AS r, (p_partkey % 50)::INT AS c, CASE WHEN p_retailprice % 7 < 1 THEN 1.0 ELSE 0.0 END::DOUBLE AS z FROM part)"
    return f"WITH {part}, {_mirror(3)}, k AS (SELECT r, c, sum(z) OVER o AS s, count(z) OVER o AS n FROM m WHERE c IS NOT NULL WINDOW o AS (PARTITION BY r ORDER BY c RANGE BETWEEN 3 PRECEDING AND 3 FOLLOWING)), q AS (SELECT r, c, sum(s) OVER o / sum(n) OVER o AS v FROM k WINDOW o AS (PARTITION BY c ORDER BY r RANGE BETWEEN 3 PRECEDING AND 3 FOLLOWING)), b AS (SELECT r, c, v FROM q, h WHERE r BETWEEN 0 AND h - 1 AND c BETWEEN 0 AND 49) SELECT r AS \"row\", c AS col, round(CASE WHEN max(v) OVER () > min(v) OVER () THEN (v - min(v) OVER ()) / (max(v) OVER () - min(v) OVER ()) ELSE 1.0 END, 6) + 0.0 AS intensity FROM b"


EXPLORATION = _exploration_sql()

QUERIES = {
    "spatial_blocks": (spatial_blocks, BLOCKS.replace("10000", "25000") + " SELECT id, block FROM b"),
    "latitude_strips": (latitude_strips, f"WITH {POINTS} SELECT id, floor((y - (SELECT min(y) FROM p)) / 15000)::INT AS block FROM p"),
    "strike_segments": (strike_segments, f"WITH {POINTS}, q AS (SELECT id, x * sin(radians(15)) + y * cos(radians(15)) AS v FROM p), c AS (SELECT quantile_cont(v, [0.2, 0.4, 0.6, 0.8]) AS b FROM q) SELECT id, len(list_filter(b, lambda t: v >= t))::INT AS block FROM q, c"),
    "loto_counts": (loto_counts, "WITH c AS (SELECT c_mktsegment, count(*) AS n, count(*) FILTER (c_acctbal > 5000) AS p FROM customer GROUP BY 1) SELECT c_mktsegment, n AS n_test, p AS pos_test, (sum(n) OVER () - n)::BIGINT AS n_train, (sum(p) OVER () - p)::BIGINT AS pos_train FROM c"),
    "greedy_folds": (greedy_folds, GREEDY),
    "round_robin_folds": (round_robin_folds, ROUND_ROBIN),
    "stratified_folds": (stratified_folds, "SELECT doc_id, ((row_number() OVER (PARTITION BY quality ORDER BY (doc_id * 7919) % 10007, doc_id) - 1) % 5)::INT AS fold FROM labels"),
    "average_precision": (average_precision, STEPS + " SELECT round(sum(p / pp * tp / seen), 6) + 0.0 AS ap FROM u"),
    "average_precision_by_source": (average_precision_by_source, "WITH " + SCORED + ", t AS (SELECT source, score, sum(label)::DOUBLE AS p, count(*)::DOUBLE AS n FROM s GROUP BY 1, 2), u AS (SELECT *, sum(p) OVER o AS tp, sum(n) OVER o AS seen, sum(p) OVER (PARTITION BY source) AS pp FROM t WINDOW o AS (PARTITION BY source ORDER BY score DESC)) SELECT source, round(sum(p / nullif(pp, 0) * tp / seen), 6) + 0.0 AS ap FROM u GROUP BY 1"),
    "roc_auc": (roc_auc, STEPS + " SELECT round(sum(p * ((nn - pp) - (seen - tp) + (n - p) / 2)) / nullif(max(pp) * (max(nn) - max(pp)), 0), 6) + 0.0 AS auc FROM u"),
    "pr_auc_trapezoid": (pr_auc_trapezoid, STEPS + ", v AS (SELECT tp / pp AS r, tp / seen AS q, score FROM u), w AS (SELECT r, q, coalesce(lag(r) OVER o, 0) AS r0, coalesce(lag(q) OVER o, 1) AS q0 FROM v WINDOW o AS (ORDER BY score DESC)) SELECT round(sum((r - r0) * (q + q0) / 2), 6) + 0.0 AS pr_auc FROM w"),
    "threshold_metrics": (threshold_metrics, THRESHOLDS),
    "fold_mean_metrics": (fold_mean_metrics, FOLD_MEANS),
    "calibration_ece": (calibration_ece, "WITH " + SCORED + ", b AS (SELECT least(floor(score * 10), 9) AS b, count(*) AS n, abs(avg(label) - avg(score)) AS e FROM s WHERE doc_id % 7 <> 3 AND doc_id % 11 <> 5 GROUP BY 1) SELECT round(sum(n * e) / sum(n), 6) + 0.0 AS ece FROM b"),
    "feature_label_correlation": (feature_label_correlation, CORR),
    "best_single_feature": (best_single_feature, BEST),
    "random_baseline": (random_baseline, "WITH t AS (SELECT (doc_id * 7919) % 10007 AS score, sum(quality)::DOUBLE AS p, count(*)::DOUBLE AS n FROM labels GROUP BY 1), u AS (SELECT *, sum(p) OVER o AS tp, sum(n) OVER o AS seen, sum(p) OVER () AS pp FROM t WINDOW o AS (ORDER BY score DESC)) SELECT round(sum(p / pp * tp / seen), 6) + 0.0 AS ap FROM u"),
    "signal_check": (signal_check, SIGNAL),
    "loto_summary": (loto_summary, LOTO),
    "audit_grade": (audit_grade, None),
    "audit_tests": (audit_tests, AUDIT),
    "baseline_table": (baseline_table, None),
    "certificate_hash": (certificate_hash, CERT),
    "point_score_classify": (point_score_classify, POINT),
    "lithology_diagnosis": (lithology_diagnosis, _lithology_sql()),
    "weighted_negatives": (weighted_negatives, NEGATIVES),
    "exploration_intensity": (exploration_intensity, EXPLORATION),
    "lr_spatial_cv": (lr_spatial_cv, None),
    "rf_predict": (rf_predict, None),
    "bootstrap_uncertainty": (bootstrap_uncertainty, None),
    "logistic_fold_scores": (logistic_fold_scores, FOLD_SCORES),
    "bootstrap_signs": (bootstrap_signs, SIGNS),
    "ensemble_uncertainty": (ensemble_uncertainty, SPREAD),
    "forest_attributions": (forest_attributions, None),
    "given_attributions": (given_attributions, _given_sql()),
    "attribution_ranking": (attribution_ranking, f"WITH g AS ({_given_sql()}) SELECT unnest(['slope', 'distance_to_road', 'clay_ratio']) AS name, unnest([round(avg(abs(f0)), 9) + 0.0, round(avg(abs(f1)), 9) + 0.0, round(avg(abs(f2)), 9) + 0.0]) AS importance, true AS biased, 'distance_to_road' AS bias_features FROM g"),
    "boosted_early_stop": (boosted_early_stop, None),
}
