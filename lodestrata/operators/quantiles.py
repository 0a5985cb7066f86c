"""Exact quantiles without a task that holds all values.

An order statistic is closed in on from both sides: a summary of bounded size (percentile_approx) names two values of the data around it, one
more pass counts exactly what lies below, on and between them, and what lies outside is left out. Values at the borders leave
with every pass, so each pass makes progress whatever the distribution, and a pass leaves a few ten-thousandths of the
rows; below `FEW` values a task sorts what is left. All columns, groups' shares and both neighbours of an interpolated quantile share each pass.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Values between two borders that one task sorts.
FEW = 50_000
#: Size of the summary: borders lie within some 2 / ACCURACY of the wanted place.
ACCURACY = 10_000


@dataclass
class _Search:
    """Values at `places` (neighbours) of a column's sorted values; all lie within (low, high), which `n` values do, `below` lie under them."""

    name: str
    column: Column
    places: tuple[int, ...]
    n: int
    below: int = 0
    low: float = -math.inf
    high: float = math.inf

    @property
    def inside(self) -> Column:
        c = self.column
        held = c.isNotNull() & ~F.isnan(c)
        if self.low > -math.inf:
            held &= c > self.low
        if self.high < math.inf:
            held &= c < self.high
        return F.when(held, c)


def _step(df: DataFrame, searches: list[_Search], found: dict) -> list[_Search]:
    """One round: values where they are few; else borders around the places and exact counts. Returns what is still sought."""
    few, many = [s for s in searches if s.n <= FEW], [s for s in searches if s.n > FEW]
    wanted = [F.slice(F.sort_array(F.collect_list(s.inside)), s.places[0] - s.below + 1, s.places[-1] - s.places[0] + 1) for s in few]
    for s in many:
        low, high = (min(1.0, max(0.0, (k - s.below + 0.5) / s.n + slack)) for k, slack in ((s.places[0], -2.0 / ACCURACY), (s.places[-1], 2.0 / ACCURACY)))
        wanted.append(F.percentile_approx(s.inside, F.array(F.lit(low), F.lit(high)), F.lit(ACCURACY)))
    row = df.agg(*(c.alias(f"c{i}") for i, c in enumerate(wanted))).first()
    for s, values in zip(few, row, strict=False):
        found.update({(s.name, k): v for k, v in zip(s.places, values, strict=True)})
    if not many:
        return []
    counts = []
    for s, (a, b) in zip(many, row[len(few) :], strict=True):
        v = s.inside
        counts += [F.count(F.when(v < a, 1)), F.count(F.when(v == a, 1)), F.count(F.when((v > a) & (v < b), 1)), F.count(F.when((v == b) & (v > a), 1))]
    each = list(df.agg(*(c.alias(f"n{i}") for i, c in enumerate(counts))).first())
    left: dict = {}
    for i, (s, (a, b)) in enumerate(zip(many, row[len(few) :], strict=True)):
        under, at_a, between, at_b = each[4 * i : 4 * i + 4]
        for k in s.places:
            rest = k - s.below
            if rest < under:
                part = (s.low, a, s.below, under)
            elif rest < (done := under + at_a):
                found[s.name, k] = a
                continue
            elif rest < done + between:
                part = (a, b, s.below + done, between)
            elif rest < (done := done + between + at_b):
                found[s.name, k] = b
                continue
            else:
                part = (b, s.high, s.below + done, s.n - done)
            left.setdefault((s.name, s.places, part), []).append(k)
    column = {s.name: s.column for s in many}
    return [_Search(name, column[name], tuple(ks), n, below, low, high) for (name, _, (low, high, below, n)), ks in left.items()]


def exact_quantiles(df: DataFrame, columns: dict[str, Column | str], shares: list[float]) -> dict[str, list[float | None]]:
    """For each name the quantiles of its column at `shares`, interpolated between neighbours; None without values; NULL and NaN aside.

    Runs jobs at once: one to count, and one or two for each round.
    """
    columns = {name: (F.col(c) if isinstance(c, str) else c).cast("double") for name, c in columns.items()}
    sizes = dict(zip(columns, df.agg(*(F.count(F.when(~F.isnan(c), c)).alias(f"n{i}") for i, c in enumerate(columns.values()))).first(), strict=True))
    places = {name: [(n - 1) * q for q in shares] if n else [] for name, n in sizes.items()}
    searches = [_Search(name, columns[name], ks, sizes[name]) for name, at in places.items() for ks in sorted({tuple(sorted({math.floor(x), math.ceil(x)})) for x in at})]
    found: dict = {}
    while searches:
        searches = _step(df, searches, found)
    between = lambda name, x: (a := found[name, math.floor(x)]) + (found[name, math.ceil(x)] - a) * (x - math.floor(x))
    return {name: [between(name, x) for x in at] or [None] * len(shares) for name, at in places.items()}


def grouped_quantiles(df: DataFrame, by: str, columns: list[str], shares: list[float]) -> DataFrame:
    """`by` and, for each column, an array of its quantiles in the group. Groups are few (classes, bands): the driver holds their quantiles.

    The first round is one for all groups, by a summary and counts within each; where more than `FEW` values may lie between its borders, each
    group's columns are sought one by one as in `exact_quantiles`.
    """
    slack = 2.0 / ACCURACY
    value = {c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) for c in columns}
    asked = F.array(*(F.lit(min(1.0, max(0.0, q + s))) for q in shares for s in (-slack, slack)))
    first = df.groupBy(by).agg(*(F.count(v).alias(f"n{i}") for i, v in enumerate(value.values())), *(F.percentile_approx(v, asked, F.lit(ACCURACY)).alias(f"q{i}") for i, v in enumerate(value.values()))).collect()
    kind = df.schema[by].dataType.simpleString()
    out: dict = {r[by]: {} for r in first}
    if all(6 * slack * r[f"n{i}"] <= FEW for r in first for i in range(len(columns))):
        borders = F.broadcast(df.sparkSession.createDataFrame([(r[by], *(r[f"q{i}"] for i in range(len(columns)))) for r in first], f"_g {kind}, " + ", ".join(f"_q{i} array<double>" for i in range(len(columns)))))
        parts = []
        for i, v in enumerate(value.values()):
            for j in range(len(shares)):
                a, b = F.col(f"_q{i}")[2 * j], F.col(f"_q{i}")[2 * j + 1]
                parts += [F.count(F.when(v < a, 1)).alias(f"u{i}_{j}"), F.count(F.when(v == a, 1)).alias(f"a{i}_{j}"), F.sort_array(F.collect_list(F.when((v > a) & (v < b), v))).alias(f"m{i}_{j}"), F.count(F.when((v == b) & (v > a), 1)).alias(f"b{i}_{j}")]
        counted = {r["_g"]: r for r in df.join(borders, F.col(by).eqNullSafe(F.col("_g"))).groupBy("_g").agg(*parts).collect()}
        for r in first:
            c = counted[r[by]]
            for i, name in enumerate(columns):
                found = []
                for j, q in enumerate(shares):
                    if not r[f"n{i}"]:
                        found.append(None)
                        continue
                    low, high, under, inside = r[f"q{i}"][2 * j], r[f"q{i}"][2 * j + 1], c[f"u{i}_{j}"], c[f"m{i}_{j}"]
                    at, ends = (r[f"n{i}"] - 1) * q, []
                    for k in (math.floor(at), math.ceil(at)):
                        rest = k - under
                        if 0 <= rest < c[f"a{i}_{j}"]:
                            ends.append(low)
                        elif 0 <= (rest := rest - c[f"a{i}_{j}"]) < len(inside):
                            ends.append(inside[rest])
                        elif 0 <= rest - len(inside) < c[f"b{i}_{j}"]:
                            ends.append(high)
                    found.append(ends[0] + (ends[1] - ends[0]) * (at - math.floor(at)) if len(ends) == 2 else math.nan)
                if not any(x is not None and math.isnan(x) for x in found):
                    out[r[by]][name] = found
    left = {(g, c): F.when(F.col(by).eqNullSafe(F.lit(g)), F.col(c)) for g, held in out.items() for c in columns if c not in held}
    more = exact_quantiles(df, {str(i): e for i, e in enumerate(left.values())}, shares) if left else {}
    for i, (g, c) in enumerate(left):
        out[g][c] = more[str(i)]
    return df.sparkSession.createDataFrame([(g, *(held[c] for c in columns)) for g, held in out.items()], ", ".join([f"`{by}` {kind}", *(f"`{c}` array<double>" for c in columns)]))
