"""PNG images of composites, written by many tasks (K7).

Strips of rows are compressed side by side: a strip is a run of deflate blocks that ends at a byte's border, so strips put one after another
are one stream, and each is a chunk of the file with its own check sum. Only lengths and Adler sums of the strips (some bytes a strip)
come to the driver; they give each chunk's place and the sum of the whole, and the file comes into being by one rename.
"""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource

from ..operators.shared import drop_folder, scratch, ship
from .tiff_sink import PlacedWriter

#: Fixed values of the format.
SIGNATURE, ADLER = b"\x89PNG\r\n\x1a\n", 65521
#: Rows of a strip.
STRIP = 128


class PlacedSink(DataSource):
    """format("placed_file"): rows (tile, place, data) become one file; options path and job."""

    @classmethod
    def name(cls) -> str:
        return "placed_file"

    def schema(self) -> str:
        return "tile int, place long, data binary"

    def writer(self, schema, overwrite: bool) -> PlacedWriter:
        return PlacedWriter(self.options)


def chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def joined_adler(first: int, second: int, size: int) -> int:
    """The Adler sum of two byte strings put together, from theirs and the second's length."""
    a1, b1, a2, b2 = first & 0xFFFF, first >> 16, second & 0xFFFF, second >> 16
    a = (a1 + a2 - 1) % ADLER
    b = (b1 + b2 + size % ADLER * (a1 - 1)) % ADLER
    return b << 16 | a


def strip(pixels: np.ndarray) -> tuple[bytes, int, int]:
    """(chunk, Adler sum, bytes) of rows of RGB pixels [rows, width, 3]."""
    raw = np.concatenate([np.zeros((len(pixels), 1), np.uint8), pixels.reshape(len(pixels), -1)], axis=1).tobytes()
    packer = zlib.compressobj(6, zlib.DEFLATED, -15)
    return chunk(b"IDAT", packer.compress(raw) + packer.flush(zlib.Z_FULL_FLUSH)), zlib.adler32(raw), len(raw)


def write_png(composite: DataFrame, path: str, width: int, height: int, empty: int = 255) -> None:
    """Writes row, col, red, green, blue (0 to 1) as an image that all executors see; cells that are absent or NULL are of the shade `empty`.

    Of several rows of one cell the brightest values stay.
    """
    spark = composite.sparkSession
    ship(spark)

    def task(group: pa.Table) -> pa.Table:
        k = group["tile"][0].as_py()
        rows = min(STRIP, height - k * STRIP)
        pixels, seen = np.zeros((rows, width, 3), np.int64), np.zeros((rows, width, 3), bool)
        r, c = group["row"].to_numpy() - k * STRIP, group["col"].to_numpy()
        for i, name in enumerate(("red", "green", "blue")):
            v = np.array(group[name].to_numpy(), np.float64)
            on = ~np.isnan(v) & (c >= 0)
            np.maximum.at(pixels[:, :, i], (r[on], c[on]), np.clip(np.floor(v[on] * 255 + 0.5), 0, 255).astype(np.int64))
            seen[r[on], c[on], i] = True
        data, adler, size = strip(np.where(seen, pixels, empty).astype(np.uint8))
        return pa.table({"tile": pa.array([k], pa.int32()), "data": pa.array([data], pa.binary()), "adler": pa.array([adler], pa.int64()), "size": pa.array([size], pa.int64())})

    inside = composite.where(f"row between 0 and {height - 1} and col between 0 and {width - 1}").select(F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), *(F.col(c).cast("double").alias(c) for c in ("red", "green", "blue")))
    none = F.lit(None).cast("double")
    strips = -(-height // STRIP)
    start = spark.range(strips).select((F.col("id") * STRIP).alias("row"), F.lit(-1).cast("long").alias("col"), none.alias("red"), none.alias("green"), none.alias("blue"))  # so that each strip is there
    dealt = inside.unionByName(start).withColumn("tile", F.floor(F.col("row") / STRIP).cast("int"))
    folder = scratch(spark, "strips")
    dealt.groupBy("tile").applyInArrow(task, "tile int, data binary, adler long, size long").write.option("compression", "uncompressed").parquet(folder)
    done = spark.read.schema("tile int, data binary, adler long, size long").parquet(folder)
    listed = sorted(tuple(r) for r in done.select("tile", F.length("data"), "adler", "size").collect())  # some numbers a strip
    opening = SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"IDAT", b"\x78\x9c")
    at, total, places = len(opening), 1, [(-1, 0, opening)]
    starts = []
    for k, n, adler, size in listed:
        starts.append((k, at))
        at, total = at + n, joined_adler(total, adler, size)
    places.append((-2, at, chunk(b"IDAT", b"\x03\x00" + struct.pack(">I", total)) + chunk(b"IEND", b"")))
    spark.dataSource.register(PlacedSink)
    where = F.broadcast(spark.createDataFrame(starts, "tile int, place long"))
    rows = done.select("tile", "data").join(where, "tile").select("tile", "place", "data").unionByName(spark.createDataFrame([(k, p, bytearray(d)) for k, p, d in places], "tile int, place long, data binary"))
    rows.write.format("placed_file").options(path=path, job=uuid.uuid4().hex).mode("append").save()
    drop_folder(spark, folder)
