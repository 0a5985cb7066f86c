"""Importance resampling towards a target distribution over hashed n-grams (operator 12).

1. a text's A-Z are lower-cased, what parts words becomes single spaces, and for each n up to `longest` an overlapping
   search of the regex library emits the spans of all runs of n words: a run begins and ends where a boundary lookaround
   finds no further letter. The span's bytes go straight to CRC-32, modulo `buckets`,
2. the features' buckets are written beside the ids, so texts are read once; tasks count buckets by themselves, and one row a
   bucket and task is shuffled. The target's texts are counted alike,
3. a bucket's gain is floor(1000 ln((t + 1)(S + buckets) / ((s + 1)(T + buckets)))); a document's weight is the floored mean of
   its features' gains (`buckets` numbers go to the tasks, whatever the tables' size),
4. a document's score is its weight and Gumbel noise from the SHA-256 of seed and id: the highest scores are a draw without
   replacement in proportion to exp(weight / 1000),
5. the highest `percent` of the documents with `least_words` words are drawn. Counts over `STEP`-wide ranges of scores (some
   hundred numbers, whatever the table's size) leave out what cannot be drawn; the rest is dealt by ranges of score and id,
   sorted there, and a row's rank is its place in its range after the rows of the ranges before it.

Null texts have no words, weight 0 and no rank, as have texts under `least_words` words. A null id reads as the empty text in
the noise and comes last among equal scores. Rows with equal ids get a row each; those that are equal in weight too are ranked in any
order. Very long texts are read whole. Empty tables give no rows; an empty target counts 0 everywhere. Extra columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, prepare, table, text_slices

SEPARATORS = regex.compile(rb"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")
STEP = 256


def runs(n: int) -> regex.Pattern:
    """Runs of n words of a collapsed text."""
    return regex.compile(rb"(?<![^ ])[^ ]+(?: [^ ]+){%d}(?![^ ])" % (n - 1))


def features(raw: bytes, patterns: list[regex.Pattern], buckets: int) -> tuple[int, list[int]]:
    """(words, bucket of each feature) of a text."""
    text = SEPARATORS.sub(b" ", raw.lower()).strip(b" ")
    found = [zlib.crc32(m[0]) % buckets for p in patterns for m in p.finditer(text, overlapped=True)]
    return (text.count(b" ") + 1 if text else 0), found


def feature_rows(docs: DataFrame, longest: int, buckets: int, text_col: str = "text", id_col: str | None = None) -> DataFrame:
    """(id,) n_words, buckets of each text."""
    prepare(docs.sparkSession)
    keep = [F.col(id_col).alias("id")] if id_col else []
    rows = docs.select(*keep, F.col(text_col).alias("text"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patterns = [runs(n) for n in range(1, longest + 1)]
        for batch, data, offsets in text_slices(batches):
            whole = data.tobytes()
            found = [features(whole[a:b], patterns, buckets) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            ends = np.cumsum([0, *(len(x) for _, x in found)])
            flat = np.fromiter((b for _, x in found for b in x), np.int32, ends[-1])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))
            ids = [batch.column("id")] if id_col else []
            yield pa.RecordBatch.from_arrays([*ids, pa.array([n for n, _ in found], pa.int64()), lists], names=[*["id"] * len(ids), "n_words", "buckets"])

    key = f"id {rows.schema['id'].dataType.simpleString()}, " if id_col else ""
    return rows.mapInArrow(task, f"{key}n_words long, buckets array<int>")


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(all buckets, offsets) of an array of lists."""
    at = column.offsets.to_numpy()
    return column.values.to_numpy(zero_copy_only=False)[at[0] : at[-1]], at - at[0]


def bucket_counts(rows: DataFrame, buckets: int) -> np.ndarray:
    """Features in each bucket."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            if batch.num_rows:
                total += np.bincount(_flat(batch.column("buckets"))[0], minlength=buckets)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array(total[held])], names=["bucket", "n"])

    counted = rows.select("buckets").mapInArrow(task, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()  # `buckets` rows at most
    out = np.zeros(buckets, np.int64)
    out[counted["bucket"].to_numpy(np.int64)] = counted["n"].to_numpy(np.int64)
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Each bucket's gain, of the counts in the corpus and in the target."""
    s, t, n = source.astype(np.float64), target.astype(np.float64), len(source)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + n) / ((s + 1) * (t.sum() + n)))).astype(np.int64)


def weigh(rows: DataFrame, gain: np.ndarray) -> DataFrame:
    """id, n_words, n_features, weight."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            flat, at = _flat(batch.column("buckets"))
            upto = np.concatenate([[0], np.cumsum(gain[flat])])
            size = np.diff(at).astype(np.int64)
            weight = np.where(size > 0, (upto[at[1:]] - upto[at[:-1]]) // np.maximum(size, 1), 0)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("n_words"), pa.array(size), pa.array(weight)], names=["id", "n_words", "n_features", "weight"])

    return rows.mapInArrow(task, f"id {rows.schema['id'].dataType.simpleString()}, n_words long, n_features long, weight long")


def with_noise(rows: DataFrame, seed: int) -> DataFrame:
    """Adds `score`: the weight and Gumbel noise of the id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0)))
    return rows.withColumn("score", F.col("weight") + noise)


def draw(scored: DataFrame, percent: int, least_words: int) -> DataFrame:
    """Adds `rank` to the highest `percent` of the rows with `least_words` words; null for others. `scored` is a written table."""
    fits = F.coalesce(F.col("n_words") >= least_words, F.lit(False))
    counts = scored.where(fits).groupBy(F.floor(F.col("score") / STEP).alias("range")).agg(F.count("*").alias("n")).collect()  # as many as scores have ranges
    wanted = percent * sum(r["n"] for r in counts) // 100
    seen, low = 0, None
    for r in sorted(counts, key=lambda r: -r["range"]):
        if seen >= wanted:
            break
        seen, low = seen + r["n"], r["range"] * STEP
    if low is None:
        return scored.withColumn("rank", F.lit(None).cast("long"))
    likely = fits & (F.col("score") >= low)
    order = (F.desc("score"), F.asc_nulls_last("id"))
    ranged = scored.where(likely).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    ranged = materialize(ranged)
    part = F.shiftright("_at", 33)
    sizes = ranged.groupBy(part.alias("_part")).agg(F.count("*").alias("_n")).orderBy("_part").collect()  # a row a partition
    starts, before = [], 0
    for r in sizes:
        starts.append((r["_part"], before))
        before += r["_n"]
    starts = F.broadcast(scored.sparkSession.createDataFrame(starts, "_part long, _start long"))
    placed = ranged.withColumn("_part", part).join(starts, "_part").withColumn("rank", F.col("_start") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1)
    placed = placed.withColumn("rank", F.when(F.col("rank") <= wanted, F.col("rank"))).select(*scored.columns, "rank")
    return placed.unionByName(scored.where(~likely).withColumn("rank", F.lit(None).cast("long")))


def resample(docs: DataFrame, target: DataFrame, longest: int = 1, buckets: int = 10_000, seed: int = 2024, percent: int = 10, least_words: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: id, n_words, n_features, weight, score, rank (null where not drawn)."""
    rows = materialize(feature_rows(docs, longest, buckets, text_col, id_col))
    gain = gains(bucket_counts(rows, buckets), bucket_counts(feature_rows(target, longest, buckets, text_col), buckets))
    scored = materialize(with_noise(weigh(rows, gain), seed))
    return draw(scored, percent, least_words).withColumnRenamed("id", id_col)


def op12_importance(spark, sf_dir: str) -> DataFrame:
    drawn = resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


#: CRC-32 by its table, which the rule of the polynomial makes.
OP12_SQL = r"""
WITH table_ AS (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
features AS (SELECT 0 AS side, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM documents
  UNION ALL SELECT 1, NULL, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) FROM benchmark),
words AS (SELECT w, hex(encode(w)) AS x FROM (SELECT DISTINCT w FROM features)),
octets AS (SELECT w, list_transform(range(len(x) // 2), lambda i: instr('123456789ABCDEF', x[2 * i + 1]) * 16 + instr('123456789ABCDEF', x[2 * i + 2])) AS b FROM words),
hashed AS (SELECT w, xor(list_reduce(list_prepend(4294967295, b), lambda c, o: xor(c >> 8, t[(xor(c, o) & 255) + 1])), 4294967295) % 10000 AS bucket FROM octets, table_),
found AS (SELECT side, doc_id, bucket FROM features JOIN hashed USING (w)),
counts AS (SELECT bucket, count(*) FILTER (side = 0) AS s, count(*) FILTER (side = 1) AS t FROM found GROUP BY 1),
gain AS (SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (sum(s) OVER () + 10000)::DOUBLE / ((s + 1)::DOUBLE * (sum(t) OVER () + 10000)::DOUBLE)))::BIGINT AS g FROM counts),
sums AS (SELECT doc_id, count(*) AS n, sum(g)::BIGINT AS g FROM found JOIN gain USING (bucket) WHERE side = 0 GROUP BY 1),
weights AS (SELECT doc_id, coalesce(n, 0) AS n_features, CASE WHEN n > 0 THEN (g - ((g % n) + n) % n) // n ELSE 0 END AS weight, instr('123456789abcdef', sha[1]) * 268435456::BIGINT + instr('123456789abcdef', sha[2]) * 16777216 + instr('123456789abcdef', sha[3]) * 1048576 + instr('123456789abcdef', sha[4]) * 65536 + instr('123456789abcdef', sha[5]) * 4096 + instr('123456789abcdef', sha[6]) * 256 + instr('123456789abcdef', sha[7]) * 16 + instr('123456789abcdef', sha[8]) AS h
  FROM (SELECT doc_id, sha256('2024:' || doc_id::VARCHAR) AS sha FROM documents) LEFT JOIN sums USING (doc_id)),
scores AS (SELECT doc_id, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM weights),
ranked AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r, count(*) OVER () AS n FROM scores WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN r <= 10 * n // 100 THEN r END AS rank FROM scores LEFT JOIN ranked USING (doc_id)
"""
