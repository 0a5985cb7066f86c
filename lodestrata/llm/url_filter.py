"""URL filter by rules and a character language-model ratio (operator 10).

A rule (host, path, verdict) fits its host and all subdomains where the URL's path starts with the rule's; the longest fits
first. URLs under no rule are judged by two variable-order Markov models over the characters of host and path, one
learned from all URLs that the rules accept, one from all they reject: orders 0 to `ORDER`, blended by Witten-Bell
smoothing down to a uniform distribution. A URL's score is the mean over its characters of the log-likelihood
difference. The threshold is calibrated on ruled URLs that the models which score them have not learned: by a hash they fall into `FOLDS`
folds, each scored by models of the others; the threshold parts accepted and rejected ones best (balanced accuracy over
a histogram).

All is done with DataFrame functions: n-gram counts combine before the shuffle, each order's probabilities come from
joins of tables of different n-grams, and every different host and path is scored once. Null URLs and URLs without
`://` have an empty host and path and score by the empty string. With one kind of ruled URLs only, or none (an empty
table too), the threshold is 0; a tie goes to the border nearest 0. Repeated rows and rows with equal or null ids each get their
row; very long URLs are scored whole; extra columns are not read. Control characters 2 and 3 of a URL count as one
character, since they mark the text's ends here.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, table

ORDER = 5
BINS = 2048
FOLDS = 2
#: Rows of the table of n-gram scores up to which it is broadcast (about 60 bytes each); beyond, the join shuffles.
BROADCAST_GRAMS = 1_000_000
#: Marks around the text; the text's own such characters read as OTHER.
BEFORE, AFTER, OTHER = "\u0002", "\u0003", "\u0001"


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


#: The rules of the registered query.
RULES = (Rule("net", "/", "block"), Rule("example.net", "/en/", "allow"), Rule("example.com", "/de/", "block"), Rule("org", "/fr/", "allow"))

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_columns(rules: tuple[Rule, ...]) -> tuple[Column, Column]:
    """(name, verdict) of the longest rule that fits the columns host and path, else null."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.name), r.name)):
        fits = ((F.col("host") == r.host) | F.col("host").endswith("." + r.host)) & F.col("path").startswith(r.path)
        name, verdict = F.when(fits, F.lit(r.name)).otherwise(name), F.when(fits, F.lit(r.verdict)).otherwise(verdict)
    return name, verdict


def _grams(bodies: DataFrame, order: int) -> DataFrame:
    padded = F.concat(F.lit(BEFORE * order), F.translate("body", BEFORE + AFTER, OTHER * 2), F.lit(AFTER))
    return bodies.withColumn("gram", F.explode(F.regexp_extract_all(padded, F.lit(f"(?s)(?=(.{{{order + 1}}}))"), F.lit(1))))


def gram_scores(grams: DataFrame, order: int, by: tuple[str, ...] = ()) -> DataFrame:
    """(by,) gram, score: the log-ratio of its last character after the others in the two models. `grams` has gram, good, bad.

    Each value of the columns `by` has models of its own.
    """
    sums = [F.sum("good").alias("good"), F.sum("bad").alias("bad")]
    full = materialize(grams.groupBy(*by, "gram").agg(*sums))
    below: DataFrame | None = None
    for k in range(order + 1):
        level = full if k == order else materialize(full.groupBy(*by, F.expr(f"right(gram, {k + 1})").alias("gram")).agg(*sums))
        level = level.withColumn("context", F.expr(f"left(gram, {k})")).withColumn("rest", F.expr(f"right(gram, {k})"))
        kinds = level.groupBy(*by, "context").agg(
            F.sum("good").alias("ng"), F.sum("bad").alias("nb"), F.sum(F.signum("good")).alias("tg"), F.sum(F.signum("bad")).alias("tb")
        )
        joined = level.join(kinds, [*by, "context"])
        if below is None:
            joined = joined.withColumn("qg", F.lit(1 / 256)).withColumn("qb", F.lit(1 / 256))
        else:
            joined = joined.join(below, [*by, "rest"])
        blend = lambda n, total, types, lower: F.when(F.col(total) > 0, (F.col(n) + F.col(types) * F.col(lower)) / (F.col(total) + F.col(types))).otherwise(F.col(lower))
        done = materialize(joined.select(*by, "gram", blend("good", "ng", "tg", "qg").alias("pg"), blend("bad", "nb", "tb", "qb").alias("pb")))
        below = done.select(*by, F.col("gram").alias("rest"), F.col("pg").alias("qg"), F.col("pb").alias("qb"))
    return done.select(*by, "gram", (F.log("pg") - F.log("pb")).alias("score"))


def best_threshold(cells: list[tuple[int, int, int]], low: float, step: float) -> float:
    """The bin border with the best balanced accuracy: (bin, accepted, rejected) counts; the one nearest 0 of equals."""
    good, bad = sum(c[1] for c in cells), sum(c[2] for c in cells)
    if not good or not bad:
        return 0.0
    best, at = -1.0, 0.0
    g = b = 0
    for i, n, m in [(-1, 0, 0), *sorted(cells)]:
        g, b = g + n, b + m
        border = low + (i + 1) * step
        value = (good - g) / good + b / bad
        if value > best + 1e-12 or (abs(value - best) <= 1e-12 and abs(border) < abs(at)):
            best, at = value, border
    return at


def judge_urls(pages: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "page_id", url_col: str = "url", order: int = ORDER) -> DataFrame:
    """One row per row of `pages`: id, host, path, rule, verdict, score (of the models, for every URL)."""
    host, path = host_and_path(F.col(url_col))
    name, verdict = rule_columns(rules)
    rows = pages.select(F.col(id_col), host.alias("host"), path.alias("path")).withColumn("rule", name).withColumn("_ruled", verdict).withColumn("body", F.concat("host", "path"))
    rows = materialize(rows)
    bodies = rows.groupBy("body").agg(F.sum(F.when(F.col("_ruled") == "allow", 1).otherwise(0)).alias("good"), F.sum(F.when(F.col("_ruled") == "block", 1).otherwise(0)).alias("bad"))
    bodies = materialize(bodies.withColumn("fold", F.pmod(F.xxhash64("body"), F.lit(FOLDS)).cast("int")))
    # model FOLDS learns from all bodies, model k from those outside fold k; n-grams that model k has not seen fall back on shorter ones
    models = F.filter(F.array(*(F.lit(k) for k in range(FOLDS + 1))), lambda k: k != F.col("fold"))
    grams = _grams(bodies, order).withColumn("model", F.explode(models)).select("model", "gram", "good", "bad")
    own = _grams(bodies.where("good > 0 or bad > 0"), order).select(F.col("fold").alias("model"), "gram", F.lit(0).alias("good"), F.lit(0).alias("bad"))
    scores = materialize(gram_scores(grams.unionByName(own), order, ("model",)))
    few = scores.count() <= BROADCAST_GRAMS
    tried = _grams(bodies.select("body", F.lit(FOLDS).alias("model")).unionByName(bodies.where("good > 0 or bad > 0").select("body", F.col("fold").alias("model"))), order)
    each = tried.join(F.broadcast(scores) if few else scores, ["model", "gram"])
    each = materialize(each.groupBy("body", "model").agg(F.avg("score").alias("score")))
    scored = rows.join(each.where(F.col("model") == FOLDS).drop("model"), "body")
    ruled = bodies.where("good > 0 or bad > 0").join(each.where(F.col("model") < FOLDS), "body")
    low, high = ruled.agg(F.min("score"), F.max("score")).first()
    step = ((high - low) / BINS if low is not None and high > low else 1.0) or 1.0
    cells = ruled.groupBy(F.least(F.floor((F.col("score") - F.lit(low)) / F.lit(step)), F.lit(BINS - 1)).cast("int").alias("bin"))
    cells = cells.agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")).collect()  # BINS rows at most
    threshold = best_threshold([tuple(r) for r in cells], low or 0.0, step)
    model = F.when(F.col("score") >= threshold, "allow").otherwise("block")
    return scored.select(id_col, "host", "path", "rule", F.coalesce("_ruled", model).alias("verdict"), F.round("score", 9).alias("score"))


def op10_url_filter(spark, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"))
