"""GeoTIFF sink: one tiled float32 file written by many tasks, with one commit (K1, K2).

1. cells meet in tiles, one group a tile (its size is the tile's, whatever the raster's), are encoded there, and the encoded
   tiles are kept as a table in the shared folder,
2. their lengths alone come to the driver (8 bytes a tile) and give each tile's place in the file,
3. tasks write their tiles at these places of a hidden file beside the target, through the data source `tiff_file`; a task that runs
   twice writes the same bytes at the same places,
4. the commit gathers the places that the tasks report, writes the header and renames the file. A job that fails removes
   the hidden file, so the target is either whole or not touched.

Tiles without a cell take no place (offset 0). NaN and NULL cells become nodata, NaN unless told otherwise. Of several rows of one
cell the largest value stays. The target lies in a folder that all executors see; files of 4 GB or more become big files.
"""

from __future__ import annotations

import json
import os
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import asdict, dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from ..operators.shared import drop_folder, scratch, ship
from .raster import BITS, CLEAR, COMPRESSION, END, FORMAT, HEIGHT, NARROW, NODATA, PIXEL_SCALE, PREDICTOR, SAMPLES, TIE_POINT, TILE_COUNTS, TILE_H, TILE_W, TILES, TYPES, WIDTH

#: Fixed values of the format: further tags, compressions, entries at which an LZW table is cleared.
PHOTOMETRIC, PLANAR, GEO_KEYS, METADATA = 262, 284, 34735, 42112
CODES = {"none": 1, "lzw": 5, "deflate": 8}
FULL = 4094
CLASSIC = (1 << 32) - (1 << 20)


@dataclass(frozen=True)
class Geometry:
    """What the header tells besides the tiles' places."""

    width: int
    height: int
    tile: int = 256
    x0: float = 0.0
    y0: float = 0.0
    cell: float = 1.0
    epsg: int = 0
    band_name: str = ""
    nodata: float = float("nan")
    compression: str = "lzw"

    @property
    def across(self) -> int:
        return -(-self.width // self.tile)

    @property
    def tiles(self) -> int:
        return self.across * -(-self.height // self.tile)


def pack_lzw(data: bytes) -> bytes:
    """LZW as TIFF has it: codes from the highest bit on, one wider when the table outgrows the width, cleared before it is full."""
    out = bytearray()
    held = bits = 0
    table: dict[int, int] = {}
    width, free = NARROW, END + 1

    def put(code: int) -> None:
        nonlocal held, bits
        held, bits = held << width | code, bits + width
        while bits >= 8:
            bits -= 8
            out.append(held >> bits & 255)
        held &= (1 << bits) - 1

    put(CLEAR)
    prefix = -1
    for byte in data:
        if prefix < 0:
            prefix = byte
            continue
        key = prefix << 8 | byte
        code = table.get(key)
        if code is not None:
            prefix = code
            continue
        put(prefix)
        prefix, table[key] = byte, free
        free += 1
        if free == FULL:
            put(CLEAR)
            table.clear()
            width, free = NARROW, END + 1
        elif free >= 1 << width:
            width += 1
    if prefix >= 0:
        put(prefix)
        free += 1
        if free == FULL:
            put(CLEAR)
            width = NARROW
        elif free >= 1 << width:
            width += 1
    put(END)
    if bits:
        out.append(held << 8 - bits & 255)
    return bytes(out)


def encode_tile(values: np.ndarray, compression: str) -> bytes:
    """A float32 tile: with compression, bytes of each row by significance and as differences (predictor 3)."""
    if compression == "none":
        return values.astype("<f4").tobytes()
    high, wide = values.shape
    planes = np.ascontiguousarray(values.astype(">f4")).view(np.uint8).reshape(high, wide, 4).transpose(0, 2, 1).reshape(high, 4 * wide)
    raw = np.diff(planes, axis=1, prepend=np.uint8(0)).astype(np.uint8).tobytes()
    return pack_lzw(raw) if compression == "lzw" else zlib.compress(raw)


def header(g: Geometry, offsets: np.ndarray, counts: np.ndarray, big: bool) -> bytes:
    """All that stands before the tiles."""
    name = g.band_name.replace("&", "&amp;").replace("<", "&lt;").replace('"', "&quot;")
    about = f'<GDALMetadata><Item name="band_name">{name}</Item><Item name="DESCRIPTION" sample="0" role="description">{name}</Item></GDALMetadata>'
    place = "Q" if big else "I"
    fields = [(WIDTH, "I", (g.width,)), (HEIGHT, "I", (g.height,)), (BITS, "H", (32,)), (COMPRESSION, "H", (CODES[g.compression],)), (PHOTOMETRIC, "H", (1,)), (SAMPLES, "H", (1,)), (PLANAR, "H", (1,))]
    fields += [(PREDICTOR, "H", (3,))] if g.compression != "none" else []
    fields += [(TILE_W, "I", (g.tile,)), (TILE_H, "I", (g.tile,)), (TILES, place, tuple(offsets.tolist())), (TILE_COUNTS, place, tuple(counts.tolist())), (FORMAT, "H", (3,))]
    fields += [(PIXEL_SCALE, "d", (g.cell, g.cell, 0.0)), (TIE_POINT, "d", (0.0, 0.0, 0.0, g.x0, g.y0, 0.0))]
    if g.epsg:
        degrees = g.epsg in range(4000, 5000)
        keys = [(1024, 2 if degrees else 1), (1025, 1), (2048 if degrees else 3072, g.epsg)]
        fields.append((GEO_KEYS, "H", (1, 1, 0, len(keys), *(x for key, value in keys for x in (key, 0, 1, value)))))
    fields += [(METADATA, "s", about.encode() + b"\0")] if g.band_name else []
    fields.append((NODATA, "s", f"{g.nodata:g}".encode() + b"\0"))
    code = {v: k for k, v in TYPES.items()}
    room, entry = (8, "<HHQ") if big else (4, "<HHI")
    body, extra = b"", b""
    extra_at = (16 if big else 8) + (8 if big else 2) + (struct.calcsize(entry) + room) * len(fields) + room
    for tag, kind, v in sorted(fields):
        raw = v if kind == "s" else struct.pack(f"<{len(v)}{kind}", *v)
        if len(raw) > room:
            at, extra = extra_at + len(extra), extra + raw + bytes(len(raw) % 2)
            raw = struct.pack("<Q" if big else "<I", at)
        body += struct.pack(entry, tag, code[kind], len(v)) + raw.ljust(room, b"\0")
    start = struct.pack("<2sHHHQQ", b"II", 43, 8, 0, 16, len(fields)) if big else struct.pack("<2sHIH", b"II", 42, 8, len(fields))
    return start + body + bytes(room) + extra


@dataclass
class _Written(WriterCommitMessage):
    places: list


class PlacedWriter(DataSourceArrowWriter):
    """Tasks write their rows (tile, place, data) at their places of a hidden file; the commit renames it, an abort removes it."""

    def __init__(self, options: dict):
        self.path, self.job = Path(options["path"]), options["job"]
        self.hidden = self.path.with_name(f".{self.path.name}.{self.job}")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        done = []
        with os.fdopen(os.open(self.hidden, os.O_WRONLY | os.O_CREAT, 0o644), "wb") as f:
            for batch in iterator:
                for k, at, data in zip(*(batch.column(c).to_pylist() for c in ("tile", "place", "data")), strict=True):
                    f.seek(at)
                    f.write(data)
                    done.append((k, at, len(data)))
            f.flush()
            os.fsync(f.fileno())
        return _Written(done)

    def commit(self, messages: list) -> None:
        self.hidden.replace(self.path)

    def abort(self, messages: list) -> None:
        self.hidden.unlink(missing_ok=True)


class _Writer(PlacedWriter):
    def __init__(self, options: dict):
        super().__init__(options)
        self.big, self.geometry = options["big"] == "true", Geometry(**json.loads(options["geometry"]))

    def commit(self, messages: list) -> None:
        offsets, counts = np.zeros(self.geometry.tiles, np.uint64), np.zeros(self.geometry.tiles, np.uint64)
        for m in messages:
            for k, at, size in m.places if m else ():
                offsets[k], counts[k] = at, size
        with os.fdopen(os.open(self.hidden, os.O_WRONLY | os.O_CREAT, 0o644), "wb") as f:
            f.write(header(self.geometry, offsets, counts, self.big))
            f.flush()
            os.fsync(f.fileno())
        super().commit(messages)


class TiffSink(DataSource):
    """format("tiff_file"): rows (tile, place, data) become one file; `write_geotiff` sets its options."""

    @classmethod
    def name(cls) -> str:
        return "tiff_file"

    def schema(self) -> str:
        return "tile int, place long, data binary"

    def writer(self, schema, overwrite: bool) -> _Writer:
        return _Writer(self.options)


def encoded_tiles(cells: DataFrame, g: Geometry, value: str = "z") -> DataFrame:
    """tile, data of the cells (row, col, `value`) within the geometry."""

    def task(group: pa.Table) -> pa.Table:
        k = group["tile"][0].as_py()
        grid = np.full((g.tile, g.tile), -np.inf)
        v = np.array(group["v"].to_numpy(), np.float64)
        r, c = group["row"].to_numpy() - k // g.across * g.tile, group["col"].to_numpy() - k % g.across * g.tile
        known = ~np.isnan(v)
        some = np.zeros(grid.shape, bool)
        some[r[known], c[known]] = True
        np.maximum.at(grid, (r[known], c[known]), v[known])
        return pa.table({"tile": pa.array([k], pa.int32()), "data": pa.array([encode_tile(np.where(some, grid, g.nodata), g.compression)], pa.binary())})

    inside = cells.where(f"row between 0 and {g.height - 1} and col between 0 and {g.width - 1}")
    tile = (F.floor(F.col("row") / g.tile) * g.across + F.floor(F.col("col") / g.tile)).cast("int")
    return inside.select(tile.alias("tile"), F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), F.col(value).cast("double").alias("v")).groupBy("tile").applyInArrow(task, "tile int, data binary")


def write_geotiff(cells: DataFrame, path: str, geometry: Geometry, value: str = "z") -> None:
    """Writes cells (row, col, `value`) to the file `path`, which all executors see."""
    spark = cells.sparkSession
    ship(spark)
    spark.dataSource.register(TiffSink)
    folder = scratch(spark, "tiles")
    encoded_tiles(cells, geometry, value).write.option("compression", "uncompressed").parquet(folder)
    tiles = spark.read.schema("tile int, data binary").parquet(folder)
    sizes = sorted((r[0], r[1]) for r in tiles.select("tile", F.length("data")).collect())  # two numbers a tile
    total = sum(n for _, n in sizes)
    big = total + 64 * geometry.tiles > CLASSIC
    none = np.zeros(geometry.tiles, np.uint64)
    at, places = len(header(geometry, none, none, big)), []
    for k, n in sizes:
        places.append((k, at))
        at += n + n % 2
    placed = tiles.join(F.broadcast(spark.createDataFrame(places, "tile int, place long")), "tile").select("tile", "place", "data")
    options = {"path": path, "job": uuid.uuid4().hex, "big": str(big).lower(), "geometry": json.dumps(asdict(geometry))}
    placed.write.format("tiff_file").options(**options).mode("append").save()
    drop_folder(spark, folder)
