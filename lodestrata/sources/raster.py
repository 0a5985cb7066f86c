"""Raster sources and sinks: a Python data source for GeoTIFF bands (uncompressed, deflated or LZW; classic or big files), Parquet tiles.

`TiffSource` reads each file's strips or tiles as partitions and yields row, col, band and value, nodata as NULL; row filters
go to the reader, so only the blocks that meet them are read and decoded: a file is read by byte ranges, never whole.
"""

from __future__ import annotations

import math
import struct
import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..operators.shared import ship

#: Fixed values of the format: tag numbers and the sizes of field types.
WIDTH, HEIGHT, BITS, COMPRESSION, STRIPS, SAMPLES, ROWS, COUNTS, PLANAR, PREDICTOR = 256, 257, 258, 259, 273, 277, 278, 279, 284, 317
TILE_W, TILE_H, TILES, TILE_COUNTS, FORMAT, PIXEL_SCALE, TIE_POINT, NODATA = 322, 323, 324, 325, 339, 33550, 33922, 42113
TYPES = {1: "B", 2: "s", 3: "H", 4: "I", 5: "II", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 16: "Q"}


class Ranges:
    """Bytes of a file that every machine sees, by ranges."""

    def __init__(self, path: str):
        self.path = path

    def __getitem__(self, span: slice) -> bytes:
        with Path(self.path).open("rb") as f:
            f.seek(span.start)
            return f.read(span.stop - span.start)


def read_tags(data: bytes | Ranges) -> tuple[str, dict[int, tuple]]:
    """Byte order and tags of the first image; big files have 64-bit places."""
    head = data[0:16]
    order = {b"II": "<", b"MM": ">"}[head[:2]]
    version = struct.unpack_from(order + "H", head, 2)[0]
    if version not in (42, 43):
        raise ValueError("not a TIFF file")
    big = version == 43
    at = struct.unpack_from(order + ("Q" if big else "I"), head, 8 if big else 4)[0]
    count, entry, room = ("Q", 20, 8) if big else ("H", 12, 4)
    n_tags = struct.unpack(order + count, data[at : at + struct.calcsize(order + count)])[0]
    at += struct.calcsize(order + count)
    listed, tags = data[at : at + entry * n_tags], {}
    for k in range(n_tags):
        tag, kind, n = struct.unpack_from(order + ("HHQ" if big else "HHI"), listed, entry * k)
        code = TYPES.get(kind)
        if code is None:
            continue
        size = struct.calcsize(order + code) * n
        raw = listed[entry * (k + 1) - room : entry * (k + 1)]
        if size > room:
            start = struct.unpack(order + ("Q" if big else "I"), raw)[0]
            raw = data[start : start + size]
        tags[tag] = (raw[:n],) if code == "s" else struct.unpack_from(f"{order}{n * len(code)}{code[0]}", raw)
    return order, tags


#: Fixed values of LZW in TIFF: codes that clear the table and end the data, widths of codes.
CLEAR, END, NARROW, WIDE = 256, 257, 9, 12


def unpack_lzw(data: bytes) -> bytes:
    """LZW as TIFF has it: codes from the highest bit on, one wider as soon as the table has one entry less than the width allows."""
    out: list[bytes] = []
    held = bits = 0
    width, table, last = NARROW, [], b""
    for byte in data:
        held, bits = (held << 8 | byte) & 0xFFFFFF, bits + 8
        if bits < width:
            continue
        bits -= width
        code = held >> bits & (1 << width) - 1
        if code == END:
            break
        if code == CLEAR or not table:
            table, width, last = [bytes([i]) for i in range(256)] + [b"", b""], NARROW, b""
            if code == CLEAR:
                continue
        if not last:
            word = table[code]
        else:
            word = table[code] if code < len(table) else last + last[:1]
            table.append(last + word[:1])
        out.append(word)
        last = word
        if len(table) + 1 >= 1 << width and width < WIDE:
            width += 1
    return b"".join(out)


class Tiff:
    """Blocks of a TIFF file as arrays."""

    def __init__(self, data: bytes | Ranges):
        self.data = data
        self.order, t = read_tags(data)
        one = lambda tag, default=None: t[tag][0] if tag in t else default
        self.width, self.height, self.samples = one(WIDTH), one(HEIGHT), one(SAMPLES, 1)
        kind = {1: "u", 2: "i", 3: "f"}[one(FORMAT, 1)]
        self.dtype = np.dtype(f"{self.order}{kind}{one(BITS, 8) // 8}")
        self.compression, self.predictor, self.planar = one(COMPRESSION, 1), one(PREDICTOR, 1), one(PLANAR, 1)
        if self.compression not in (1, 5, 8, 32946) or self.predictor not in (1, 2, 3):
            raise ValueError("compression of this file is not read here")
        tiled = TILE_W in t
        self.block_w = one(TILE_W) if tiled else self.width
        self.block_h = one(TILE_H) if tiled else min(one(ROWS, self.height), self.height)
        self.offsets, self.counts = (t[TILES], t[TILE_COUNTS]) if tiled else (t[STRIPS], t[COUNTS])
        self.tiled = tiled
        self.across = -(-self.width // self.block_w)
        text = one(NODATA)
        self.nodata = float(text.split(b"\0")[0]) if text else None
        scale, tie = t.get(PIXEL_SCALE), t.get(TIE_POINT)
        self.transform = (tie[3] - tie[0] * scale[0], scale[0], tie[4] + tie[1] * scale[1], -scale[1]) if scale and tie else (0.0, 1.0, 0.0, -1.0)

    def block(self, k: int) -> tuple[int, int, np.ndarray]:
        """(first row, first col, [rows, cols, samples]) of block k, cut at the image's edge."""
        per = self.across * -(-self.height // self.block_h)
        plane, k0 = divmod(k, per) if self.planar == 2 else (0, k)
        if not self.counts[k]:  # a tile that was not written
            r, c = (x * y for x, y in zip(divmod(k0, self.across), (self.block_h, self.block_w), strict=True))
            empty = math.nan if self.dtype.kind == "f" else self.nodata or 0
            return r, c, np.full((min(self.block_h, self.height - r), min(self.block_w, self.width - c), 1 if self.planar == 2 else self.samples), empty, self.dtype)
        raw = self.data[self.offsets[k] : self.offsets[k] + self.counts[k]]
        raw = raw if self.compression == 1 else unpack_lzw(raw) if self.compression == 5 else zlib.decompress(raw)
        r, c = divmod(k0, self.across)
        r, c = r * self.block_h, c * self.block_w
        high = self.block_h if self.tiled else min(self.block_h, self.height - r)
        n = 1 if self.planar == 2 else self.samples
        if self.predictor == 3:
            # differences of bytes along a row, whose most significant bytes come first, then the next ones, and so on
            size = self.dtype.itemsize
            rows = np.frombuffer(raw, np.uint8, high * self.block_w * n * size).reshape(high, self.block_w * size, n)
            rows = np.cumsum(rows, axis=1, dtype=np.uint8).reshape(high, size, self.block_w * n)
            a = np.ascontiguousarray(rows.transpose(0, 2, 1)).view(self.dtype.newbyteorder(">")).reshape(high, self.block_w, n)
        else:
            a = np.frombuffer(raw, self.dtype, high * self.block_w * n).reshape(high, self.block_w, n)
        if self.predictor == 2:
            a = np.cumsum(a, axis=1, dtype=self.dtype)
        del plane
        return r, c, a[: self.height - r, : self.width - c]

    def plane(self, k: int) -> int:
        return k // (self.across * -(-self.height // self.block_h)) if self.planar == 2 else 0


def _cells(tiff: Tiff, blocks: list[int] | range, first: int, last: int) -> Iterator[pa.RecordBatch]:
    """row, col, band, z of the blocks' cells in the rows from `first` to `last`; nodata is NULL."""
    for k in blocks:
        r, c, a = tiff.block(k)
        rows, cols, n = a.shape
        row, col = np.repeat(np.arange(r, r + rows), cols), np.tile(np.arange(c, c + cols), rows)
        keep = (row >= first) & (row <= last)
        for s in range(n):
            v = a[:, :, s].ravel().astype(np.float64)
            lost = np.isnan(v) | ((v == tiff.nodata) if tiff.nodata is not None else False)
            yield pa.RecordBatch.from_arrays(
                [pa.array(row[keep], pa.int32()), pa.array(col[keep], pa.int32()), pa.array(np.full(keep.sum(), 1 + s + tiff.plane(k)), pa.int32()), pa.array(v[keep], pa.float64(), mask=lost[keep])],
                names=["row", "col", "band", "z"],
            )


class _Block(InputPartition):
    def __init__(self, path: str, blocks: list[int]):
        self.path, self.blocks = path, blocks


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.first, self.last = options["path"], int(options.get("rowFrom", 0)), int(options.get("rowTo", 1 << 31))
        self.per = int(options.get("blocksPerPartition", 16))

    def partitions(self) -> list[_Block]:
        tiff = Tiff(Ranges(self.path))
        per = tiff.across * -(-tiff.height // tiff.block_h)
        rows = lambda k: (k % per) // tiff.across * tiff.block_h
        want = [k for k in range(len(tiff.offsets)) if rows(k) <= self.last and rows(k) + tiff.block_h > self.first]
        return [_Block(self.path, want[i : i + self.per]) for i in range(0, len(want), self.per)]

    def read(self, partition: _Block) -> Iterator[pa.RecordBatch]:
        yield from _cells(Tiff(Ranges(partition.path)), partition.blocks, self.first, self.last)


class TiffSource(DataSource):
    """format("tiff_cells"): option path (a folder that all executors see), rowFrom and rowTo."""

    @classmethod
    def name(cls) -> str:
        return "tiff_cells"

    def schema(self) -> str:
        return "row int, col int, band int, z double"

    def reader(self, schema) -> _Reader:
        return _Reader(self.options)


def read_tiff(spark: SparkSession, path: str, rows: tuple[int, int] | None = None) -> DataFrame:
    ship(spark)
    spark.dataSource.register(TiffSource)
    reader = spark.read.format("tiff_cells").option("path", path)
    if rows:
        reader = reader.option("rowFrom", rows[0]).option("rowTo", rows[1])
    return reader.load()


def read_tiff_files(spark: SparkSession, path: str) -> DataFrame:
    """path, row, col, band, z of all TIFF files under `path`, in any store that Spark reads; each file is one task's, whole (at most 2 GB)."""
    ship(spark)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                tiff = Tiff(data.as_py())
                for cells in _cells(tiff, range(len(tiff.offsets)), 0, 1 << 31):
                    yield pa.RecordBatch.from_arrays([pa.array([name] * cells.num_rows, pa.string()), *cells.columns], names=["path", *cells.schema.names])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{tif,tiff,TIF,TIFF}").option("recursiveFileLookup", True).load(path)
    return files.select("path", "content").mapInArrow(task, "path string, row int, col int, band int, z double")


def write_tiff(array: np.ndarray, path: str, x0: float = 0.0, y0: float = 0.0, cell: float = 1.0, nodata: float = -9999.0) -> None:
    """A small single-band float32 GeoTIFF, deflated in strips of 64 rows; NaN becomes `nodata` (K1, K2)."""
    a = np.where(np.isnan(array), nodata, array).astype("<f4")
    strips = [zlib.compress(a[r : r + 64].tobytes()) for r in range(0, len(a), 64)]
    text = f"{nodata:g}".encode() + b"\0"
    fields = [
        (WIDTH, "I", (a.shape[1],)), (HEIGHT, "I", (a.shape[0],)), (BITS, "H", (32,)), (COMPRESSION, "H", (8,)), (STRIPS, "I", None), (SAMPLES, "H", (1,)), (ROWS, "I", (64,)),
        (COUNTS, "I", tuple(map(len, strips))), (FORMAT, "H", (3,)), (PIXEL_SCALE, "d", (cell, cell, 0.0)), (TIE_POINT, "d", (0.0, 0.0, 0.0, x0, y0, 0.0)), (NODATA, "s", text),
    ]
    code = {v: k for k, v in TYPES.items()}
    data_at = 8 + 2 + 12 * len(fields) + 4
    extra = b""
    size = lambda kind, v: len(v) * (1 if kind == "s" else struct.calcsize("<" + kind))
    room = sum(size(k, v) for t, k, v in fields if v and size(k, v) > 4) + (4 * len(strips) if len(strips) > 1 else 0)
    starts = np.cumsum([data_at + room] + [len(s) for s in strips[:-1]]).tolist()
    body = b""
    for tag, kind, v in fields:
        v = tuple(starts) if tag == STRIPS else v
        raw = v if kind == "s" else struct.pack(f"<{len(v)}{kind}", *v)
        if len(raw) <= 4:
            place = raw.ljust(4, b"\0")
        else:
            place = struct.pack("<I", data_at + len(extra))
            extra += raw
        body += struct.pack("<HHI", tag, code[kind], len(v)) + place
    Path(path).write_bytes(b"II*\0" + struct.pack("<IH", 8, len(fields)) + body + b"\0\0\0\0" + extra + b"".join(strips))


def write_cells(cells: DataFrame, path: str, block: int = 512) -> None:
    """Cells as Parquet by blocks of rows, so that row ranges prune files."""
    cells.withColumn("row_block", F.floor(F.col("row") / block).cast("int")).write.mode("overwrite").partitionBy("row_block").parquet(path)


def read_cells(spark: SparkSession, path: str, rows: tuple[int, int] | None = None, block: int = 512) -> DataFrame:
    df = spark.read.parquet(path)
    return df.where(F.col("row_block").between(rows[0] // block, rows[1] // block) & F.col("row").between(*rows)) if rows else df


def nodata_out(value: str, nodata: float = -9999.0):
    """NULL as the number that stands for nodata on disk (K2)."""
    return F.coalesce(F.col(value), F.lit(nodata))
