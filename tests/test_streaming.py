from pyspark.sql import functions as F

from lodestrata.functions import mapalgebra as m
from lodestrata.streaming.scoring import apply_to_arriving, read_arriving


def test_arriving_cells_are_scored_once(spark, tmp_path):
    spark.range(40).select(F.col("id").cast("double").alias("a"), F.lit(2.0).alias("b")).repartition(4).write.parquet(str(tmp_path / "in"))
    stream = read_arriving(spark, str(tmp_path / "in"), "a double, b double", 2)
    apply_to_arriving(stream, lambda d: d.select(m.safe_ratio(F.col("a"), F.col("b")).alias("r")), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).agg(F.count("*"), F.sum("r")).first() == (40, 390.0)
