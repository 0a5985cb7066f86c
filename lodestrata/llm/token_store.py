"""Token ids in a binary format with Elias-Fano document boundaries (operator 6).

A segment holds the ids of consecutive documents in ascending order of the document's id:

    magic "EFTK", version, id width (2 or 4 bytes), documents, ids before the segment in its part (64 bit), ids,
    low-bit count, byte lengths of the parts,
    document ids (delta-coded varints), low bits (packed), high bits (unary), select samples, ids (little-endian)

The boundaries (offsets of the documents' ends within the segment) are an Elias-Fano sequence: `low` bits of each offset
packed, the rest in unary in a bit vector, with the place of every `SAMPLE`-th one as the select structure. Offset i is
read from them alone: about 2 + log2(ids / documents) bits a document; no 64-bit table.

A file is a table of segments in the shared folder, one segment a row, about `SEGMENT_IDS` ids each: written and read by
Spark, so it lies in any store that Spark reaches. Texts are dealt out by ranges of document ids, so many bytes of text a
part (`PART_BYTES`) whatever the size of the table; each part is sorted, encoded and packed in one pass. A directory of the
parts' sizes (one number a part) gives each part's start.

Null and empty texts hold only the end id. Rows with equal ids keep all their documents, in the order of their texts; equal rows are
documents of their own. Null ids come first, as the smallest long. A very long text is one document; segments end after the
document that fills them. An empty table gives no segments. Extra columns are not read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, prepare, table, text_slices
from .encode import encoder

MAGIC, VERSION = b"EFTK", 1
SAMPLE = 64
SEGMENT_IDS = 1 << 18
#: Bytes of text of a part.
PART_BYTES = 12 << 20
LEAST_ID = -(1 << 63)
HEAD = struct.Struct("<4sBBHIQQ4I")


class EliasFano:
    """A non-decreasing sequence of `n` numbers up to `limit`."""

    def __init__(self, n: int, low: int, lows: bytes, highs: bytes, samples: np.ndarray):
        self.n, self.low, self.lows, self.highs, self.samples = n, low, lows, highs, samples

    @classmethod
    def build(cls, values: np.ndarray, limit: int) -> EliasFano:
        n = len(values)
        low = max(0, int(limit // max(1, n)).bit_length() - 1)
        values = values.astype(np.uint64)
        bits = ((values[:, None] >> np.arange(low, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8).ravel() if low else np.zeros(0, np.uint8)
        places = (values >> np.uint64(low)).astype(np.int64) + np.arange(n)
        unary = np.zeros(int(limit >> low) + n + 1, np.uint8)
        unary[places] = 1
        return cls(n, low, np.packbits(bits, bitorder="little").tobytes(), np.packbits(unary, bitorder="little").tobytes(), places[::SAMPLE].astype(np.uint32))

    def select(self, i: int) -> int:
        """Number `i` of the sequence: from the sampled one before it, over bytes, then over bits."""
        at = int(self.samples[i // SAMPLE])
        left = i % SAMPLE
        byte = at >> 3
        word = self.highs[byte] >> (at & 7) << (at & 7)
        while (ones := word.bit_count()) <= left:
            left -= ones
            byte += 1
            word = self.highs[byte]
        for _ in range(left):
            word &= word - 1
        place = 8 * byte + (word & -word).bit_length() - 1
        high = place - i
        value = 0
        for k in range(self.low):
            b = i * self.low + k
            value |= (self.lows[b >> 3] >> (b & 7) & 1) << k
        return high << self.low | value

    def all(self) -> np.ndarray:
        """The whole sequence at once."""
        unary = np.unpackbits(np.frombuffer(self.highs, np.uint8), bitorder="little")
        high = np.flatnonzero(unary)[: self.n] - np.arange(self.n)
        if not self.low:
            return high
        bits = np.unpackbits(np.frombuffer(self.lows, np.uint8), bitorder="little")[: self.n * self.low].reshape(self.n, self.low)
        return (high << self.low) | (bits.astype(np.int64) << np.arange(self.low)).sum(1)


def _varints(values: list[int]) -> bytes:
    out = bytearray()
    for v in values:
        v = v << 1 if v >= 0 else (-v << 1) - 1
        while v > 127:
            out.append(v & 127 | 128)
            v >>= 7
        out.append(v)
    return bytes(out)


def _from_varints(data: bytes, n: int) -> list[int]:
    out, at = [], 0
    for _ in range(n):
        v = shift = 0
        while data[at] & 128:
            v |= (data[at] & 127) << shift
            shift += 7
            at += 1
        v |= data[at] << shift
        at += 1
        out.append(v >> 1 if not v & 1 else -((v + 1) >> 1))
    return out


def pack_segment(doc_ids: list[int], ids: list[bytes], before: int) -> bytes:
    """A segment of documents; `ids` are little-endian 32-bit integers."""
    lengths = np.array([len(x) // 4 for x in ids], np.int64)
    flat = np.frombuffer(b"".join(ids), np.uint32)
    width = 2 if not len(flat) or flat.max() < 1 << 16 else 4
    ends = np.cumsum(lengths)
    ef = EliasFano.build(ends, int(ends[-1]) if len(ends) else 0)
    names = _varints([b - a for a, b in zip([0, *doc_ids[:-1]], doc_ids, strict=True)])
    head = HEAD.pack(MAGIC, VERSION, width, ef.low, len(doc_ids), before, len(flat), len(names), len(ef.lows), len(ef.highs), 4 * len(ef.samples))
    return b"".join((head, names, ef.lows, ef.highs, ef.samples.astype("<u4").tobytes(), flat.astype("<u2" if width == 2 else "<u4").tobytes()))


class Segment:
    """Random access to the documents of a packed segment."""

    def __init__(self, data: bytes):
        magic, version, width, low, n, self.before, total, a, b, c, d = HEAD.unpack_from(data)
        if magic != MAGIC or version != VERSION:
            raise ValueError("not a segment")
        at = np.cumsum([HEAD.size, a, b, c, d]).tolist()
        self.doc_ids = []
        last = 0
        for step in _from_varints(data[at[0] : at[1]], n):
            last += step
            self.doc_ids.append(last)
        self.ends = EliasFano(n, low, data[at[1] : at[2]], data[at[2] : at[3]], np.frombuffer(data, "<u4", d // 4, at[3]))
        self.ids = np.frombuffer(data, "<u2" if width == 2 else "<u4", total, at[4])

    def __len__(self) -> int:
        return self.ends.n

    def bounds(self, i: int) -> tuple[int, int]:
        """[first, end) of document i within the segment, by two selects."""
        return (self.ends.select(i - 1) if i else 0), self.ends.select(i)

    def document(self, i: int) -> np.ndarray:
        a, b = self.bounds(i)
        return self.ids[a:b]


def _pack(path: str, end_id: int):
    """Encodes and packs the documents of a part, which come in order."""
    fields = pa.schema([("part", pa.int32()), ("n_ids", pa.int64()), ("segment", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, end = encoder(path), end_id.to_bytes(4, "little")
        part = TaskContext.get().partitionId()
        docs, ids, held, before = [], [], 0, 0

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"part": [part], "n_ids": [held], "segment": [pack_segment(docs, ids, before)]}, schema=fields)

        for batch, _, _ in text_slices(batches):
            for doc, blob in zip(batch.column("id").to_pylist(), tokens.many(batch.column("text").fill_null("").to_pylist()), strict=True):
                docs.append(doc)
                ids.append(blob + end)
                held += len(ids[-1]) // 4
                if held >= SEGMENT_IDS:
                    yield flush()
                    docs, ids, held, before = [], [], 0, before + held
        if docs:
            yield flush()

    return run


def _read_back(starts: dict[int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, blob in zip(batch.column("part").to_pylist(), batch.column("segment"), strict=True):
                s = Segment(blob.as_py())
                ends = [s.ends.select(i) for i in range(len(s))]
                wide = s.ids.astype("<u4")
                rows, begin, base = [], 0, s.before + starts[part]
                for end in ends:
                    rows.append((base + begin, end - begin, zlib.crc32(wide[begin:end])))
                    begin = end
                columns = (pa.array(c, pa.int64()) for c in (s.doc_ids, *zip(*rows, strict=True)))
                yield pa.RecordBatch.from_arrays(list(columns), names=["id", "start", "n_tokens", "ids_crc32"])

    return run


def write_tokens(docs: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", part_bytes: int = PART_BYTES) -> DataFrame:
    """Encodes the texts and writes their segments to the shared folder; returns that table (part, n_ids, segment)."""
    prepare(docs.sparkSession)
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LEAST_ID)).alias("id"), F.col(text_col).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    dealt = rows.repartitionByRange(max(1, -(-size // part_bytes)), "id").sortWithinPartitions("id", "text")
    return materialize(dealt.mapInArrow(_pack(tokenizer, end_id), "part int, n_ids long, segment binary"))


def read_tokens(segments: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """id, start (ids of all documents before), n_tokens, ids_crc32 of every document, read back from the segments."""
    sizes = {r["part"]: r["n"] for r in segments.groupBy("part").agg(F.sum("n_ids").alias("n")).collect()}  # one number a part
    starts, total = {}, 0
    for part in sorted(sizes):
        starts[part] = total
        total += sizes[part]
    out = segments.select("part", "segment").mapInArrow(_read_back(starts), "id long, start long, n_tokens long, ids_crc32 long")
    return out.withColumn("id", F.nullif("id", F.lit(LEAST_ID))).withColumnRenamed("id", id_col)


def op6_token_output(spark, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("word_bpe_49k.json")
    return read_tokens(write_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer, 2))
