"""Scenes as zip archives: bands read in place by byte ranges.

The archive's directory tells where each member lies, so nothing is unpacked to disk. A stored member is read block by block through its
byte ranges, many tasks a band; a deflated one is inflated by one task a band, which a compressed stream asks for. Members are
TIFF files; for others (JPEG 2000) `decode` names a function (`module:function`) that turns bytes into an array of rows and columns,
since no decoder for them is at hand here.
"""

from __future__ import annotations

import importlib
import re
import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..operators.resample import stack, to_grid
from ..operators.shared import ship
from .raster import Ranges, Tiff

#: Fixed values of the format: signatures and layouts of the records.
END_SIGN, END64_SIGN, LOCATOR_SIGN, ENTRY_SIGN = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02"
END_RECORD, ENTRY, LOCAL = struct.Struct("<4s4H2LH"), struct.Struct("<4s6H3L5H2L"), struct.Struct("<4s5H3L2H")
STORED, DEFLATED = 0, 8
TAIL = 22 + 65_535 + 20


class Member(NamedTuple):
    name: str
    method: int
    packed: int
    size: int
    header: int


class Part:
    """Bytes of a stored member, by ranges."""

    def __init__(self, path: str, start: int, size: int):
        self.file, self.start, self.size = Ranges(path), start, size

    def __getitem__(self, span: slice) -> bytes:
        return self.file[self.start + span.start : self.start + min(span.stop, self.size)]


def members(path: str) -> list[Member]:
    """The archive's directory, also a large one (64 bit)."""
    from pathlib import Path

    total, file = Path(path).stat().st_size, Ranges(path)
    start = max(0, total - TAIL)
    tail = file[start:total]
    at = tail.rfind(END_SIGN)
    if at < 0:
        raise ValueError(f"{path} is no zip archive")
    *_, count, size, offset, _ = END_RECORD.unpack_from(tail, at)
    if at >= 20 and tail[at - 20 : at - 16] == LOCATOR_SIGN:
        where = struct.unpack_from("<Q", tail, at - 12)[0]
        record = file[where : where + 56]
        if record[:4] == END64_SIGN:
            count, size, offset = struct.unpack_from("<3Q", record, 32)
    listed, out, at = file[offset : offset + size], [], 0
    for _ in range(count):
        sign, _, _, _, method, _, _, _, packed, whole, n, extra, comment, *_, header = ENTRY.unpack_from(listed, at)
        if sign != ENTRY_SIGN:
            raise ValueError(f"{path}: broken directory")
        name, more = listed[at + 46 : at + 46 + n].decode("utf-8", "replace"), listed[at + 46 + n : at + 46 + n + extra]
        while len(more) >= 4:  # large numbers stand in a field of their own
            kind, length = struct.unpack_from("<HH", more)
            if kind == 1:
                wide = list(struct.unpack_from(f"<{length // 8}Q", more, 4))
                whole, packed, header = (wide.pop(0) if v == 0xFFFFFFFF and wide else v for v in (whole, packed, header))
            more = more[4 + length :]
        out.append(Member(name, method, packed, whole, header))
        at += 46 + n + extra + comment
    return out


def start_of(path: str, m: Member) -> int:
    """Where the member's bytes begin."""
    *_, n, extra = LOCAL.unpack(Ranges(path)[m.header : m.header + LOCAL.size])
    return m.header + LOCAL.size + n + extra


def band_member(found: list[Member], band: str) -> Member | None:
    """The member that holds a band: its name has the band between marks; of several the one of the finest resolution, by its name."""
    fits = [m for m in found if re.search(rf"(^|[_/]){re.escape(band)}(_\d+m)?\.(tiff?|jp2)$", m.name, re.IGNORECASE)]
    return min(fits, key=lambda m: (int(x[1]) if (x := re.search(r"_(\d+)m\.", m.name)) else 0, m.name), default=None)


class _Piece(InputPartition):
    def __init__(self, band: str, member: Member, start: int, blocks: list[int] | None):
        self.band, self.member, self.start, self.blocks = band, member, start, blocks


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.bands = options["path"], options["bands"].split(",")
        self.decode, self.per = options.get("decode", ""), int(options.get("blocksPerPartition", 16))

    def partitions(self) -> list[_Piece]:
        found, out = members(self.path), []
        for band in self.bands:
            m = band_member(found, band)
            if m is None:
                continue
            start = start_of(self.path, m)
            if m.method == STORED and m.name.lower().endswith((".tif", ".tiff")):
                n = len(Tiff(Part(self.path, start, m.size)).offsets)
                out += [_Piece(band, m, start, list(range(k, min(n, k + self.per)))) for k in range(0, n, self.per)]
            else:
                out.append(_Piece(band, m, start, None))
        return out

    def _whole(self, p: _Piece) -> bytes:
        raw = Ranges(self.path)[p.start : p.start + p.member.packed]
        if p.member.method == DEFLATED:
            return zlib.decompress(raw, -15)
        if p.member.method != STORED:
            raise ValueError(f"{p.member.name}: compression {p.member.method} is not read here")
        return raw

    def read(self, p: _Piece) -> Iterator[pa.RecordBatch]:
        if p.member.name.lower().endswith((".tif", ".tiff")):
            tiff = Tiff(Part(self.path, p.start, p.member.size) if p.blocks is not None else self._whole(p))
            for k in p.blocks if p.blocks is not None else range(len(tiff.offsets)):
                r, c, a = tiff.block(k)
                if tiff.plane(k) == 0:
                    yield self._cells(p.band, r, c, a[:, :, 0], tiff.nodata)
            return
        if not self.decode:
            raise ValueError(f"{p.member.name}: no decoder was named for this format")
        module, _, name = self.decode.partition(":")
        yield self._cells(p.band, 0, 0, np.asarray(getattr(importlib.import_module(module), name)(self._whole(p))), None)

    def _cells(self, band: str, r: int, c: int, a: np.ndarray, nodata: float | None) -> pa.RecordBatch:
        rows, cols = a.shape
        v = a.ravel().astype(np.float64)
        lost = np.isnan(v) | ((v == nodata) if nodata is not None else False)
        columns = [pa.array([band] * len(v), pa.string()), pa.array(np.repeat(np.arange(r, r + rows), cols), pa.int32()), pa.array(np.tile(np.arange(c, c + cols), rows), pa.int32()), pa.array(v, pa.float64(), mask=lost)]
        return pa.RecordBatch.from_arrays(columns, names=["band", "row", "col", "z"])


class ArchiveSource(DataSource):
    """format("scene_archive"): options path (a folder that all executors see), bands, decode."""

    @classmethod
    def name(cls) -> str:
        return "scene_archive"

    def schema(self) -> str:
        return "band string, row int, col int, z double"

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options)


def read_archive(spark: SparkSession, path: str, bands: list[str], decode: str = "") -> DataFrame:
    """band, row, col, z of the bands that the archive has."""
    ship(spark)
    spark.dataSource.register(ArchiveSource)
    return spark.read.format("scene_archive").options(path=path, bands=",".join(bands), decode=decode).load()


def read_scene(spark: SparkSession, path: str, bands: list[str], decode: str = "", scale: float = 10_000.0) -> DataFrame:
    """row, col and a column of reflectance for each band, all on the grid of the finest one."""
    cells = read_archive(spark, path, bands, decode)
    sizes = {r["band"]: (r["w"] + 1, r["h"] + 1) for r in cells.groupBy("band").agg(F.max("col").alias("w"), F.max("row").alias("h")).collect()}  # a row a band
    width, height = max((w for w, _ in sizes.values()), default=0), max((h for _, h in sizes.values()), default=0)
    layers = {b: to_grid(cells.where(F.col("band") == b), max(1, round(width / w)), width, height).withColumn("z", F.col("z") / scale) for b, (w, _) in sizes.items()}
    return stack(layers)
