"""Shared plumbing of the corpus operators: tables, the shared folder, Arrow batches and components."""

from __future__ import annotations

import atexit
import contextlib
import gc
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import star_rounds
from ..operators.shared import ship as prepare  # noqa: F401  the operators take it from here

#: Bytes of text that a Python task handles at once; longer documents are handled alone.
SLICE_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from spark.checkpoint.dir; a folder of our own only where it is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir names no shared folder")
        spark.sparkContext.setCheckpointDir("/tmp/checkpoints")
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def materialize(df: DataFrame, compression: str = "zstd") -> DataFrame:
    """Writes `df` as Parquet in the shared folder and reads it back: cuts lineage and survives lost executors.

    The folder goes with `free`, or when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{uuid.uuid4().hex}"
    with _small_batches(spark):
        df.write.option("compression", compression).parquet(path)
    atexit.register(_drop, spark, path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def _small_batches(spark: SparkSession) -> Iterator[None]:
    """Within it, Arrow batches hold a thousand rows at most: texts may be long. The session's own setting comes back."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    own = spark.conf.get(name)
    spark.conf.set(name, str(min(1000, int(own)) if int(own) > 0 else 1000))
    try:
        yield
    finally:
        spark.conf.set(name, own)


def free(*tables: DataFrame) -> None:
    """Deletes written tables (and unions of such) that nothing reads any more, and lets Spark drop the shuffle files that nobody refers to."""
    for df in tables:
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            if re.search(r"/tables/[0-9a-f]{32}$", folder):  # the names that `materialize` gives
                _drop(df.sparkSession, folder)
    if tables:
        gc.collect()
        tables[0].sparkSession.sparkContext._jvm.System.gc()


def fresh(name: str, df: DataFrame) -> str:
    """A column name that `df` does not have."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name = f"_{name}"
    return name


def _drop(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session may be gone already
        return


def text_slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(slice of a batch, its texts' bytes, offsets of the texts and the end) with about `limit` bytes each; null texts are empty."""
    for batch in batches:
        if not batch.num_rows:
            continue
        texts = batch.column(column)
        if texts.null_count:
            texts = pc.fill_null(texts, "")
        texts = texts.cast(pa.large_string()) if not pa.types.is_large_string(texts.type) else texts
        _, offsets, data = texts.buffers()
        at = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
        raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
        first = 0
        while first < len(texts):
            last = max(first + 1, int(np.searchsorted(at, at[first] + limit, "right")) - 1)
            yield batch.slice(first, last - first), raw[at[first] : at[last]], at[first : last + 1] - at[first]
            first = last


#: Edges that one task may join by itself (16 bytes each); more go through the distributed rounds.
TASK_EDGES = 500_000


def _join_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    above: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := above.get(x, x)) != x:
            above[x] = above.get(up, up)
            x = up
        return x

    for batch in batches:
        for u, v in zip(batch.column("u").to_pylist(), batch.column("v").to_pylist(), strict=True):
            a, b = root(u), root(v)
            above.setdefault(a, a)
            above.setdefault(b, b)
            above.setdefault(u, a)
            above.setdefault(v, b)
            if a != b:
                above[max(a, b)] = min(a, b)
    nodes = [x for x in above if root(x) != x]
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([root(x) for x in nodes], pa.int64())], names=["node", "component"])


def components_of_longs(edges: DataFrame) -> DataFrame:
    """As `components`, for links between longs: one task joins up to TASK_EDGES links (the count is checked), more go through the rounds."""
    now = materialize(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    if now.count() <= TASK_EDGES:
        return materialize(now.coalesce(1).mapInArrow(_join_edges, "node long, component long"))
    return components(now.select(F.col("u").alias("a"), F.col("v").alias("b")))


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of the undirected `edges` (a, b): component is the smallest node reachable, which itself is left out."""
    done = star_rounds(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")), keep=materialize)
    return done.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
