"""Media columns in Ogg (operator 4): a writer, a verifying reader and their columns.

`write_ogg` laces packets into pages (255-byte segments, packets continued over pages), one logical stream each, with the
pages of all streams interleaved; `read_ogg` finds pages, verifies their checksums, takes the streams apart, reassembles
packets from the lacing values and derives times from granule positions. Damaged pages are skipped and counted; packets
that such a page cuts are dropped and counted too.

A text's payload is stored as unsigned 8-bit samples, one granule each: packets of `FRAME` samples go to the streams in
turn. Null texts are empty; empty texts give one packet of padding. Equal payloads give equal files. Repeated rows and rows
with equal or null ids get a file each; a very long text is one file, stored whole over as many pages as it takes; an
empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, prepare, table, text_slices

FRAME = 576
PAD = b"\xff"
STREAMS = 2
RATE = 8000
#: Fixed values of the format: capture pattern, version, header flags.
CAPTURE, CONTINUED, FIRST, LAST = b"OggS", 1, 2, 4
HEADER = struct.Struct("<4sBBqIIIB")
#: First packet of a stream of samples: mark, stream, streams, frame, rate.
OPENING = struct.Struct("<8sBBHI")
MARK = b"PCM8BITS"

_MIRROR = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))


def checksum(page: bytes) -> int:
    """Ogg's page checksum: polynomial 0x04C11DB7, highest bit first, from zero. Done by the mirrored zlib CRC."""
    mirrored = zlib.crc32(page.translate(_MIRROR), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(mirrored.to_bytes(4, "little").translate(_MIRROR), "big")


def _page(flags: int, granule: int, serial: int, number: int, lacing: bytes, body: bytes) -> bytes:
    head = HEADER.pack(CAPTURE, 0, flags, granule, serial, number, 0, len(lacing)) + lacing
    crc = checksum(head + body)
    return b"".join((head[:22], crc.to_bytes(4, "little"), head[26:], body))


def pages_of(packets: list[tuple[bytes, int]], serial: int) -> list[bytes]:
    """The pages of one logical stream; each packet comes with the granule position at its end. The first stands alone."""
    out: list[bytes] = []
    lacing, body, granule, flags = bytearray(), [], -1, FIRST

    def flush(more: int, last: bool) -> None:
        nonlocal lacing, body, granule, flags
        out.append(_page(flags | (LAST if last else 0), granule, serial, len(out), bytes(lacing), b"".join(body)))
        lacing, body, granule, flags = bytearray(), [], -1, more

    for k, (packet, end) in enumerate(packets):
        left = len(packet) // 255 + 1
        at = 0
        while left:
            if len(lacing) == 255:
                flush(CONTINUED if at else 0, False)
            take = min(left, 255 - len(lacing))
            left -= take
            if left:
                lacing += b"\xff" * take
                body.append(packet[at : at + 255 * take])
                at += 255 * take
            else:
                lacing += b"\xff" * (take - 1) + bytes([len(packet) % 255])
                body.append(packet[at:])
                granule = end
        if k == 0 and len(packets) > 1:
            flush(0, False)
    flush(0, True)
    return out


def write_ogg(streams: dict[int, list[tuple[bytes, int]]]) -> bytes:
    """A physical stream of the logical ones (serial -> packets with granule positions), pages in turn."""
    pages = [pages_of(packets, serial) for serial, packets in streams.items() if packets]
    out = []
    for k in range(max(map(len, pages), default=0)):
        out += [p[k] for p in pages if k < len(p)]
    return b"".join(out)


@dataclass
class Stream:
    packets: list[bytes] = field(default_factory=list)
    granules: list[int] = field(default_factory=list)  # of the pages that end packets
    times: list[int] = field(default_factory=list)  # granule position after each packet, -1 if its page does not say
    pages: int = 0
    lost: int = 0
    ended: bool = False
    partial: list[bytes] | None = None
    next_page: int = 0


def read_ogg(data: bytes) -> tuple[dict[int, Stream], int]:
    """The logical streams by serial, and the number of damaged pages."""
    streams: dict[int, Stream] = {}
    bad, at = 0, 0
    while (at := data.find(CAPTURE, at)) >= 0:
        if at + 27 > len(data):
            bad += 1
            break
        _, version, flags, granule, serial, number, crc, n = HEADER.unpack_from(data, at)
        body = at + 27 + n
        lacing = data[at + 27 : body]
        end = body + sum(lacing)
        if version or len(lacing) < n or end > len(data) or checksum(b"".join((data[at : at + 22], b"\0\0\0\0", data[at + 26 : end]))) != crc:
            bad += 1
            at += 4
            continue
        s = streams.setdefault(serial, Stream())
        if number != s.next_page:
            s.lost += s.partial is not None
            s.partial = None
        s.next_page = number + 1
        s.pages += 1
        s.ended |= bool(flags & LAST)
        skip = bool(flags & CONTINUED) and s.partial is None
        if not flags & CONTINUED and s.partial is not None:
            s.lost += 1
            s.partial = None
        finished = 0
        size, start = 0, body
        for value in lacing:
            size += value
            if value < 255:
                piece = data[start : start + size]
                if skip:
                    s.lost += 1
                    skip = False
                else:
                    s.packets.append(b"".join((*(s.partial or ()), piece)))
                    s.times.append(-1)
                    finished += 1
                s.partial = None
                start += size
                size = 0
        if lacing and lacing[-1] == 255 and not skip:
            s.partial = [*(s.partial or ()), data[start : start + size]]
        if finished:
            s.times[-1] = granule
            s.granules.append(granule)
        at = end
    return streams, bad


def payload(text: bytes) -> bytes:
    """The text with padding up to a positive multiple of FRAME."""
    return text + PAD * (-len(text) % FRAME if text else FRAME)


def store(samples: bytes, streams: int = STREAMS) -> bytes:
    """Samples as an Ogg file: frames go to the streams in turn; serials come from the samples."""
    base = zlib.crc32(samples) & 0xFFFFFFF0
    laid: dict[int, list[tuple[bytes, int]]] = {}
    for s in range(streams):
        frames = [samples[i : i + FRAME] for i in range(s * FRAME, len(samples), streams * FRAME)]
        laid[base + s] = [(OPENING.pack(MARK, s, streams, FRAME, RATE), 0), *((f, FRAME * (i + 1)) for i, f in enumerate(frames))]
    return write_ogg(laid)


def restore(data: bytes) -> tuple[bytes, str]:
    """(samples, features) of a file that `store` wrote; features tell of damage."""
    streams, bad = read_ogg(data)
    found, rate, longest, pages, packets, lost = {}, RATE, 0, 0, 0, 0
    for s in streams.values():
        pages += s.pages
        lost += s.lost
        if s.packets and s.packets[0][:8] == MARK and len(s.packets[0]) == OPENING.size:
            _, place, _, _, rate = OPENING.unpack(s.packets[0])
            found[place] = s.packets[1:]
            packets += len(s.packets) - 1
            longest = max([longest, *s.granules])
    order = [found[k] for k in sorted(found)]
    samples = b"".join(f[k] for k in range(max(map(len, order), default=0)) for f in order if k < len(f))
    level = np.frombuffer(samples, np.uint8)
    mean = int(level.astype(np.int64).sum()) * 1000 // max(1, len(level))
    feature = f"streams={len(found)};pages={pages};packets={packets};bad_pages={bad};lost_packets={lost};rate={rate};last_granule={longest};ms={longest * 1000 // rate};mean_milli={mean};crossings={int(np.count_nonzero((level[1:] < 128) != (level[:-1] < 128)))}"
    return samples, feature


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, data, offsets in text_slices(batches):
        whole = data.tobytes()
        files = [store(payload(whole[a:b])) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(np.diff(offsets)), pa.array(files, pa.binary())], names=["id", "n_bytes", "media"])


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for blob in batch.column("media"):
            data = blob.as_py()
            samples, feature = restore(data)
            rows.append((len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-32:]), len(data), hashlib.sha256(data).hexdigest(), feature))
        columns = list(zip(*rows, strict=True)) if rows else [()] * 6
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), batch.column("n_bytes"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))],
            names=["id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"],
        )


def encode_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes and media: each text as an Ogg file."""
    prepare(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_encode, f"id {rows.schema['id'].dataType.simpleString()}, n_bytes long, media binary").withColumnRenamed("id", id_col)


def media_features(media: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Digests and features of stored media, read back page by page."""
    rows = media.select(F.col(id_col).alias("id"), "n_bytes", "media")
    fields = f"id {rows.schema['id'].dataType.simpleString()}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return rows.mapInArrow(_decode, fields).withColumnRenamed("id", id_col)


def op4_media_columns(spark, sf_dir: str) -> DataFrame:
    stored = materialize(encode_media(table(spark, sf_dir, "documents").select("doc_id", "text")))
    return media_features(stored)
