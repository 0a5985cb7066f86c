"""Configuration and areas of interest."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def load_config(path: str) -> dict:
    """A YAML file as a dict, with `_base_dir`, the folder above the file's; an error if missing or empty."""
    import yaml

    file = Path(path)
    if not file.is_file():
        raise FileNotFoundError(path)
    found = yaml.safe_load(file.read_text())
    if not isinstance(found, dict) or not found:
        raise ValueError(f"{path} holds no settings")
    return found | {"_base_dir": str(file.resolve().parent.parent)}


def area_ring(spark: SparkSession, path: str) -> list[tuple[float, float]]:
    """The outer ring of the first polygon of a FeatureCollection, a Feature or a bare geometry."""
    raw = spark.read.option("multiLine", True).json(path)
    shapes = ("features[0].geometry.coordinates[0]", "geometry.coordinates[0]", "coordinates[0]")
    for shape in shapes:
        if shape.split("[")[0].split(".")[0] in raw.columns:
            ring = raw.select(F.expr(shape).alias("r")).first()["r"]
            if ring:
                return [(float(p[0]), float(p[1])) for p in ring]
    raise ValueError(f"{path} holds no polygon")


def clamp_end(end: str, last: str = "2008-04-01") -> str:
    """The sensor's last good day bounds a search."""
    return min(end, last)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
