"""Divergence of sources within each language, over exact term probabilities (operator 13).

1. one `bytes.translate` lowers A-Z and blanks all that is neither letter nor byte over 127, `bytes.split` gives the terms and a
   Counter a document its frequencies. Tasks add them up (for `HELD` different terms at a time), so a row for each language,
   source and term leaves a task: occurrences and documents,
2. these sums are aggregated by Spark. A language keeps the terms that `least_docs` of its documents hold,
3. a kept term's probability in a group (language, source) of N kept occurrences is, with V kept terms,
   p = 1 + floor(10^9 (count + 2) / (N + 2V)), in decimals of 38 digits, so exact at any size. p of a term that the group lacks
   depends on the group alone,
4. the divergence of p from q is f = floor((p - q)^2 / (p + q)). Over two sources it sums to four sparse parts: terms that both
   hold (an equi-join of the sums), terms that one holds, by their different probabilities, and all other terms at once. So
   terms that few sources hold cost nothing for the others,
5. a group's telling terms are those more frequent there than in the language, the `ranks` highest f of them.

Null text, language and source read as ''. Each (language, source) that occurs is a group, even without terms; the only source
of its language has no pairs. Equal rows count each. Equal values rank by the item's bytes. Very long texts are read whole. An
empty table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, prepare, table, text_slices

#: What is neither letter nor byte over 127 reads as a space.
LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: Different terms of all groups that a task holds before it hands them on.
HELD = 200_000
SCALE = 1_000_000_000


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    totals: dict[tuple[str, str], Counter] = {}
    docs: dict[tuple[str, str], Counter] = {}

    def handed_on() -> Iterator[pa.RecordBatch]:
        for (lang, source), total in totals.items():
            held = docs[lang, source]
            terms = [None, *total]  # the null term tells that the group is there
            columns = [pa.array([lang] * len(terms)), pa.array([source] * len(terms)), pa.array([None, *(t.decode() for t in total)], pa.string())]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([0, *total.values()], pa.int64()), pa.array([0, *(held[t] for t in total)], pa.int64())], names=["lang", "source", "term", "n", "docs"])
        totals.clear()
        docs.clear()

    size = 0
    for batch, data, offsets in text_slices(batches):
        whole = data.tobytes().translate(LETTERS)
        groups = zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), strict=True)
        for group, a, b in zip(groups, offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            own = Counter(whole[a:b].split())
            total = totals.setdefault(group, Counter())
            size -= len(total)
            total.update(own)
            size += len(total)
            docs.setdefault(group, Counter()).update(own.keys())
            if size >= HELD:
                yield from handed_on()
                size = 0
    yield from handed_on()


def term_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """lang, source, term, n (occurrences), docs; a row with a null term for each group."""
    prepare(docs.sparkSession)
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = docs.select(text(text_col).alias("text"), text(lang_col).alias("lang"), text(source_col).alias("source"))
    counted = rows.mapInArrow(_count, "lang string, source string, term string, n long, docs long")
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _probability(count: str, total: str, terms: str) -> Column:
    """1 + floor(10^9 (count + 2) / (total + 2 terms)), exact; null without kept terms."""
    wide = lambda c: f"cast({c} as decimal(20, 0))"
    return F.expr(f"if({terms} > 0, 1 + (({wide(count)} + 2) * {SCALE}) div ({wide(total)} + 2 * {wide(terms)}), null)")


def _f(p: str, q: str) -> str:
    """floor((p - q)^2 / (p + q)), in whole numbers."""
    return f"(({p} - {q}) * ({p} - {q})) div ({p} + {q})"


def source_divergence(docs: DataFrame, least_docs: int = 10, ranks: int = 10, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """lang, source, part (`pair` or `term`), item, value, rank."""
    counts = materialize(term_counts(docs, text_col, lang_col, source_col))
    kept = counts.where("term is not null").groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("docs").alias("docs")).where(F.col("docs") >= least_docs).drop("docs")
    held = materialize(counts.join(kept, ["lang", "term"]).select("lang", "source", "term", "n", "total"))
    langs = kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("total").alias("all_n"))
    sizes = held.groupBy("lang", "source").agg(F.sum("n").alias("group_n"))
    groups = counts.where("term is null").select("lang", "source").join(sizes, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0, ["group_n", "terms", "all_n"])
    groups = materialize(groups.withColumn("absent", _probability("0", "group_n", "terms")))
    rated = held.join(groups, ["lang", "source"]).withColumn("p", _probability("n", "group_n", "terms")).withColumn("q", _probability("total", "all_n", "terms"))
    rated = materialize(rated.select("lang", "source", "term", "absent", "p", "q"))

    left = groups.select("lang", F.col("source").alias("a"), F.col("absent").alias("a0"), "terms")
    right = groups.select("lang", F.col("source").alias("b"), F.col("absent").alias("b0"))
    neither = left.join(right, "lang").where("a < b").select("lang", "a", "b", F.expr(f"coalesce(terms * ({_f('a0', 'b0')}), 0)").alias("value"))
    alike = rated.groupBy("lang", "source", "absent", "p").agg(F.count("*").alias("k")).select("lang", F.col("source").alias("a"), F.col("absent").alias("a0"), "p", "k")
    one = alike.join(right, "lang").where("a <> b").select("lang", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.expr(f"k * ({_f('p', 'b0')} - {_f('a0', 'b0')})").alias("value"))
    first = rated.select("lang", "term", F.col("source").alias("a"), F.col("absent").alias("a0"), F.col("p").alias("pa"))
    second = rated.select("lang", "term", F.col("source").alias("b"), F.col("absent").alias("b0"), F.col("p").alias("pb"))
    both = first.join(second, ["lang", "term"]).where("a < b").select("lang", "a", "b", F.expr(f"{_f('pa', 'pb')} - {_f('pa', 'b0')} - {_f('a0', 'pb')} + {_f('a0', 'b0')}").alias("value"))
    summed = neither.unionByName(one.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))).unionByName(both.groupBy("lang", "a", "b").agg(F.sum("value").alias("value")))
    summed = summed.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    ways = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    pairs = summed.withColumn("way", ways).select("lang", "way.source", F.lit("pair").alias("part"), "way.item", "value")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.withColumn("rank", F.row_number().over(order))

    terms = rated.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.expr(_f("p", "q")).alias("value"))
    terms = terms.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= ranks)
    return pairs.unionByName(terms)


def op13_source_divergence(spark, sf_dir: str) -> DataFrame:
    return source_divergence(table(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents),
o AS (SELECT k, lang, source, unnest(ws) AS w FROM d), kept AS (SELECT lang, w, count(*) AS total FROM o GROUP BY 1, 2 HAVING count(DISTINCT k) >= 10),
lang_ AS (SELECT lang, count(*)::HUGEINT AS v, sum(total)::HUGEINT AS n FROM kept GROUP BY 1), grp AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, w, count(*) AS n FROM o JOIN kept USING (lang, w) GROUP BY 1, 2, 3), size_ AS (SELECT lang, source, sum(n)::HUGEINT AS gn FROM c GROUP BY 1, 2),
p AS (SELECT g.lang, g.source, k.w, coalesce(c.n, 0) AS n, 1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 2) // (coalesce(s.gn, 0) + 2 * l.v) AS p, 1 + 1000000000::HUGEINT * (k.total + 2) // (l.n + 2 * l.v) AS q
  FROM grp g JOIN kept k USING (lang) JOIN lang_ l USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.w = k.w LEFT JOIN size_ s ON s.lang = g.lang AND s.source = g.source),
x AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.w = b.w AND a.source <> b.source GROUP BY 1, 2, 3),
pair AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value, 0)::BIGINT AS value FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source),
term AS (SELECT lang, source, 'term' AS part, w AS item, ((p - q) * (p - q) // (p + q))::BIGINT AS value FROM p WHERE n > 0 AND p > q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM (SELECT * FROM pair UNION ALL SELECT * FROM term))
SELECT * FROM r WHERE part = 'pair' OR rank <= 10
"""
