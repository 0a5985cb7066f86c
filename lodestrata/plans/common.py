"""Stand-in rasters and points over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.config import table

PART_WIDTH, ORDERS_WIDTH = 50, 100


def part_grid(spark, d: str) -> DataFrame:
    """Retail price as elevation, 50 cells wide."""
    k = F.col("p_partkey")
    return table(spark, d, "part").select(F.floor(k / PART_WIDTH).cast("int").alias("row"), (k % PART_WIDTH).cast("int").alias("col"), F.col("p_retailprice").alias("z"))


def orders_grid(spark, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    return table(spark, d, "orders").select(F.floor(k / ORDERS_WIDTH).cast("int").alias("row"), (k % ORDERS_WIDTH).cast("int").alias("col"), F.col("o_totalprice").alias("z"))


def height(grid: DataFrame) -> int:
    return (grid.agg(F.max("row")).first()[0] or 0) + 1


def points(spark, d: str) -> DataFrame:
    """Embeddings as points: first two components in metres, class 0 as the label."""
    e = table(spark, d, "embeddings")
    return e.select(F.col("vec_id").alias("id"), F.round(F.col("embedding")[0].cast("double") * 1e5, 2).alias("x"), F.round(F.col("embedding")[1].cast("double") * 1e5, 2).alias("y"), (F.col("label") == 0).cast("int").alias("label"))


def segments(spark, d: str) -> DataFrame:
    p = points(spark, d)
    q = p.select((F.col("id") - 1).alias("id"), F.col("x").alias("bx"), F.col("y").alias("by"))
    return p.select("id", F.col("x").alias("ax"), F.col("y").alias("ay")).join(q, "id")


def scored(spark, d: str) -> DataFrame:
    """A classifier's stand-in: labels of documents with a coarse score of their length."""
    docs = table(spark, d, "documents").select("doc_id", "n_chars", "source")
    return docs.join(table(spark, d, "labels"), "doc_id").select("doc_id", "source", F.col("quality").alias("label"), ((F.col("n_chars") % 97) / 97.0).alias("score"))


def r(c: Column | str, digits: int = 6) -> Column:
    """Rounded for comparison, without a negative zero."""
    return F.round(c, digits) + F.lit(0.0)


PART = "g AS (SELECT (p_partkey // 50)::INT AS r, (p_partkey % 50)::INT AS c, p_retailprice AS z FROM part)"
ORDERS = "g AS (SELECT (o_orderkey // 100)::INT AS r, (o_orderkey % 100)::INT AS c, o_totalprice AS z FROM orders)"
POINTS = "p AS (SELECT vec_id AS id, round(embedding[1]::DOUBLE * 1e5, 2) AS x, round(embedding[2]::DOUBLE * 1e5, 2) AS y, (label = 0)::INT AS label FROM embeddings)"
SEGMENTS = POINTS + ", s AS (SELECT a.id, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS b_y FROM p a JOIN p b ON b.id = a.id + 1)"
SCORED = "s AS (SELECT d.doc_id, d.source, l.quality AS label, (d.n_chars % 97) / 97.0::DOUBLE AS score FROM documents d JOIN labels l USING (doc_id))"
_AROUND = {"nw": (-1, -1), "n": (-1, 0), "ne": (-1, 1), "w": (0, -1), "e": (0, 1), "sw": (1, -1), "s": (1, 0), "se": (1, 1)}
NEIGHBOURS = f"n AS (SELECT g.r, g.c, g.z, {', '.join(f'g_{k}.z AS {k}' for k in _AROUND)} FROM g {' '.join(f'LEFT JOIN g g_{k} ON g_{k}.r = g.r + {i} AND g_{k}.c = g.c + {j}' for k, (i, j) in _AROUND.items())})"
HORN = NEIGHBOURS + """, h AS (SELECT *, ((ne + 2 * e + se) - (nw + 2 * w + sw)) / (8.0 * 30) AS gx, ((sw + 2 * s + se) - (nw + 2 * n + ne)) / (8.0 * 30) AS gy FROM n)"""
