"""Vector sources and sinks: GeoJSON, deposit services, audit datasets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DEPOSIT_FIELDS = "name string, commodity string, latitude double, longitude double, deposit_type string"


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """One row per feature: `properties` as a map, `kind`, `coordinates` as JSON text, and x, y of points."""
    schema = "features array<struct<geometry: struct<type: string, coordinates: string>, properties: map<string, string>>>"
    raw = spark.read.schema(schema).option("multiLine", True).json(path)
    f = raw.select(F.explode("features").alias("f")).select("f.properties", F.col("f.geometry.type").alias("kind"), F.col("f.geometry.coordinates").alias("coordinates"))
    xy = F.when(F.col("kind") == "Point", F.from_json("coordinates", "array<double>"))
    return f.withColumn("x", xy[0]).withColumn("y", xy[1])


def first_value(properties: Column, *parts: str, last: bool = False) -> Column:
    """The value of the first (or last) key that has one of `parts` in it, in any case."""
    hits = F.filter(F.map_keys(properties), lambda k: F.lower(k).rlike("|".join(parts)))
    return F.try_element_at(properties, F.try_element_at(hits, F.lit(-1 if last else 1)))


def normalise_deposits(features: DataFrame) -> DataFrame:
    """Features as name, commodity, latitude, longitude, deposit_type; missing fields are NULL, features without place go."""
    p = F.col("properties")
    out = features.select(
        first_value(p, "name").alias("name"), first_value(p, "commod", last=True).alias("commodity"), F.col("y").alias("latitude"), F.col("x").alias("longitude"),
        first_value(p, "dep_type", "deposit", last=True).alias("deposit_type"),
    )
    return out.where("latitude is not null and longitude is not null")


def commodity_filter(deposits: DataFrame, commodities: list[str], column: str = "commodity") -> DataFrame:
    """Rows whose commodity matches any of the names, in any case; NULL does not."""
    held = [F.lower(F.col(column)).contains(name.lower()) for name in commodities]
    return deposits.where(F.coalesce(F.greatest(*held) if len(held) > 1 else held[0], F.lit(False)))


def read_feature_xml(spark: SparkSession, path: str, row_tag: str) -> DataFrame:
    """Deposits of a feature service's XML: latitude and longitude elements, or a position with the latitude first."""
    raw = spark.read.format("xml").option("rowTag", row_tag).option("ignoreNamespace", True).load(path)

    def leaves(schema, at: str = "") -> list[str]:
        out = []
        for f in schema.fields:
            name = f"{at}`{f.name}`"
            out += leaves(f.dataType, name + ".") if f.dataType.typeName() == "struct" else [name]
        return out

    names = leaves(raw.schema)
    pick = lambda *parts: next((F.col(n).cast("string") for n in names for q in parts if q in n.split(".")[-1].lower()), F.lit(None).cast("string"))
    pos = F.split(F.trim(pick("pos")), r"\s+")
    lat = F.coalesce(pick("lat").try_cast("double"), F.try_element_at(pos, F.lit(1)).try_cast("double"))
    lon = F.coalesce(pick("lon").try_cast("double"), F.try_element_at(pos, F.lit(2)).try_cast("double"))
    out = raw.select(pick("name").alias("name"), pick("commod").alias("commodity"), lat.alias("latitude"), lon.alias("longitude"), pick("dep_type", "deposit").alias("deposit_type"))
    return out.where("latitude is not null and longitude is not null")


def empty_deposits(spark: SparkSession) -> DataFrame:
    """A source that has no data yet: the right columns, no rows."""
    return spark.createDataFrame([], DEPOSIT_FIELDS)


def read_dataset(spark: SparkSession, path: str) -> tuple[DataFrame, list[str]]:
    """An audit dataset in Parquet or CSV and its features: all columns but label, x and y, in the file's order."""
    df = spark.read.option("header", True).option("inferSchema", True).csv(path) if path.endswith(".csv") else spark.read.parquet(path)
    missing = {"label", "x", "y"} - set(df.columns)
    if missing:
        raise ValueError(f"missing columns: {sorted(missing)}")
    return df, [c for c in df.columns if c not in ("label", "x", "y")]


def as_geojson(rows: DataFrame, geometry: Column, properties: list[str]) -> DataFrame:
    """One column `value`: a GeoJSON feature per row, for `.write.text` (K3)."""
    return rows.select(F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(*properties).alias("properties"), geometry.alias("geometry"))).alias("value"))


def point_geometry(x: str, y: str) -> Column:
    return F.struct(F.lit("Point").alias("type"), F.array(F.col(x), F.col(y)).alias("coordinates"))


def line_geometry(ax: str, ay: str, bx: str, by: str) -> Column:
    return F.struct(F.lit("LineString").alias("type"), F.array(F.array(F.col(ax), F.col(ay)), F.array(F.col(bx), F.col(by))).alias("coordinates"))
