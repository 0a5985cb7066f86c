"""Plumbing that operators share: the shared folder, lineage cuts and the package on the executors."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from decimal import ROUND_HALF_UP, Decimal, localcontext
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors see: that of spark.checkpoint.dir; one of our own only where it is unset and all runs on one machine."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir names no shared folder")
        spark.sparkContext.setCheckpointDir("/tmp/checkpoints")
        named = spark.sparkContext.getCheckpointDir()
    return named.rstrip("/")


def drop_folder(spark: SparkSession, path: str) -> None:
    """Deletes a folder, in whatever store it lies; no error where the session has ended."""
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session may be gone already
        return


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder's path in the shared one; it goes when the driver ends."""
    path = f"{shared_folder(spark)}/{name}/{uuid.uuid4().hex}"
    atexit.register(drop_folder, spark, path)
    return path


def local_path(path: str) -> str:
    """A path of the local (or a shared) file system, without its scheme."""
    return "/" + path.removeprefix("file:").lstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Checkpoints `df` in the folder that spark.checkpoint.dir names; in one of our own only where it is unset and all runs on one machine."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir names no shared folder")
        context.setCheckpointDir(named or "/tmp/checkpoints")
    return df.checkpoint()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors' Python, once a context."""
    context = spark.sparkContext
    if getattr(context, "_lodestrata_sent", False):
        return
    root = Path(__file__).resolve().parents[2]
    archive = Path(tempfile.mkdtemp()) / "lodestrata_code.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for path in sorted((root / "lodestrata").rglob("*.py")):
            out.write(path, path.relative_to(root))
    context.addPyFile(str(archive))
    atexit.register(shutil.rmtree, archive.parent, True)
    context._lodestrata_sent = True


def half_up(values: np.ndarray, digits: int) -> np.ndarray:
    """`values` rounded as Spark's `round` does, by their shortest decimal form; a negative zero is 0. Only what lies close to a half is rounded one by one."""
    scale = 10.0**digits
    with np.errstate(all="ignore"):
        up = np.abs(values) * scale
        out = np.copysign(np.floor(up + 0.5) / scale, values)
        close = np.isfinite(values) & ~((np.abs(up - np.floor(up) - 0.5) > 1e-3) & (up < 1e12))
    for k in np.flatnonzero(close).tolist():
        with localcontext() as exact:
            exact.prec = 400
            out[k] = float(Decimal(repr(float(values[k]))).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP))
    return np.where(np.isfinite(values), out, values) + 0.0
