"""The corpus pipeline: toxicity, lines, near-duplicates, decontamination, packing.

Each stage takes (spark, docs, sf_dir) with the columns of `documents` and returns them for the rows that it keeps; the last one
returns packed pieces. Stages hand over through Parquet in the shared folder.

Rows are told apart by a hash of id and text (`_keyed`), so null and equal ids lose nothing: a decision holds for the rows with this
id and this text. Null and empty texts are kept by every stage. Further columns are dropped by the first stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm.common import free, materialize, table
from lodestrata.llm.decontaminate import contamination
from lodestrata.llm.line_dedup import dedup_lines
from lodestrata.llm.near_dup import near_duplicates
from lodestrata.llm.packing import pack_documents
from lodestrata.llm.toxicity import held_out, score_toxicity

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


KEY = "row_key"


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(*COLUMNS, F.xxhash64("doc_id", "text").alias(KEY))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents with a toxicity of one half or more; labels of held-out rows are not learned."""
    scored = score_toxicity(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"), held_out())
    bad = scored.where("score >= 0.5").select(F.col("doc_id").alias("bad_id"), F.col("row").alias("bad_row")).distinct()
    fits = F.col("doc_id").eqNullSafe(F.col("bad_id")) & (F.xxhash64("text") == F.col("bad_row"))
    return docs.join(bad, fits, "left_anti").select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one of each group of near-equal lines; documents of which no line is left go. n_chars follows the text."""
    out = dedup_lines(docs)
    out = out.where("lines_removed = 0 or trim(both ' \t\r\n\f' from text) <> ''")
    changed = F.when(F.col("lines_removed") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return out.withColumn("n_chars", changed).select(*COLUMNS)


def near_dups(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each component of near-duplicates (null ids come last); equal rows are copies too."""
    keyed = _keyed(docs)
    found = materialize(near_duplicates(keyed, KEY).distinct().join(keyed.select(KEY, "doc_id").distinct(), KEY))
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", KEY)).alias("first")
    stay = found.groupBy("component_id").agg(first).select(F.col(f"first.{KEY}").alias(KEY))
    gone = materialize(found.select(KEY).join(stay, KEY, "left_anti"))
    kept = keyed.join(gone, KEY, "left_anti")
    rows, different = keyed.where("trim(both ' \t\r\n\f' from text) <> ''").agg(F.count("*"), F.countDistinct(KEY)).first()
    if rows > different:  # equal rows: one stays, unless it is empty
        blank = F.coalesce(F.expr("trim(both ' \t\r\n\f' from text) = ''"), F.lit(True))
        kept = kept.where(~blank).dropDuplicates([KEY]).unionByName(kept.where(blank))
    return kept.select(*COLUMNS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a passage of a test item, as it is or edited."""
    keyed = _keyed(docs)
    leaks = contamination(keyed, table(spark, sf_dir, "benchmark"), KEY).select(KEY).distinct()
    return keyed.join(leaks, KEY, "left_anti").select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of at most 2048 tokens."""
    import public_tokenizers

    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), 0)


STAGES = [("toxicity", toxicity), ("line_dedup", lines), ("near_dup", near_dups), ("decontamination", decontaminate), ("packing", packing)]
#: No SQL: nearest neighbours, MinHash and tokens are not expressible. Tests hold the stages against plain versions, text for text; the
#: first one against the scores, whose neighbours a plain version holds in turn.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over `documents`."""
    docs = table(spark, sf_dir, "documents")
    before: list[DataFrame] = []
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = materialize(docs)
            free(*before)
            before = [docs]
    return docs
