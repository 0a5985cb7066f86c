"""Repeated passages by super-k-mer partitioning (operator 9).

A window is `width` consecutive words. Consecutive windows whose smallest word-`m`-gram hash (the minimiser) is the same
travel as one packed string, a super-k-mer, to the bucket of that minimiser; equal windows have equal minimisers, so
each bucket alone sorts its windows and finds the repeats exactly: windows are sorted by a 64-bit hash, and the bytes of windows with
equal hashes are compared.

Before anything travels, each slice of text sorts its own windows: of equal windows only the earliest goes on, so
a passage held by a third of all documents reaches its bucket at most once a slice. Super-k-mers bound for one bucket
travel as one compressed block a slice.

Rows with equal ids but other texts count by (id, start) as the contract says; equal rows are not earlier than each
other. A null id sorts after all others. Null and empty texts have no words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .common import prepare, table, text_slices

MINIMISER_WORDS = 4
#: Bytes of packed strings that a bucket is meant to hold, and of text that a task packs at once.
BUCKET_BYTES = 5 << 20
SLICE = 3 << 20
LAST_ID = (1 << 63) - 1
_U = np.uint64


_RADIX = 0xD1342543DE82EF95


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(1, _U)
    while len(out) < n:
        out = np.concatenate([out, out * _U(pow(base, len(out), 1 << 64))])
    return out[:n]


def _window_hashes(words: W.Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(first word, hash) of the windows."""
    m = len(words.start) - width + 1
    if m <= 0:
        return np.zeros(0, np.int64), np.zeros(0, _U)
    at = np.flatnonzero(words.doc[:m] == words.doc[width - 1 :])
    sums = np.zeros(len(words.start) + 1, _U)
    np.cumsum(words.hash * _powers(_RADIX, len(words.start)), out=sums[1:])
    return at, W.mix((sums[at + width] - sums[at]) * _powers(pow(_RADIX, -1, 1 << 64), len(words.start))[at])


@dataclass
class Windows:
    """Windows in the order of (ident, start): hashes, first words, and their bytes body[begin:end] (words joined by one space)."""

    hash: np.ndarray
    ident: np.ndarray
    start: np.ndarray
    at: np.ndarray
    body: bytes
    begin: np.ndarray
    end: np.ndarray

    def repeated(self) -> np.ndarray:
        """Which windows have an equal one at a smaller (ident, start)?"""
        n = len(self.hash)
        if not n:
            return np.zeros(0, bool)
        order = np.argsort(self.hash, kind="stable")
        x = self.hash[order]
        new = np.ones(n, bool)
        new[1:] = x[1:] != x[:-1]
        head = np.empty(n, np.int64)
        head[order] = order[np.maximum.accumulate(np.where(new, np.arange(n), 0))]
        flag = (self.ident != self.ident[head]) | (self.start != self.start[head])
        return flag if self._equal(np.flatnonzero(flag), head) else self._by_bytes()

    def _equal(self, some: np.ndarray, head: np.ndarray) -> bool:
        """Are the bytes of all these windows those of their heads? Runs that go on side by side are compared at once."""
        if not len(some):
            return True
        mine, other = self.at[some], self.at[head[some]]
        cut = np.flatnonzero(np.concatenate([[True], (np.diff(mine) != 1) | (np.diff(other) != 1)]))
        first, last = some[cut], some[np.append(cut[1:], len(some)) - 1]
        spans = (self.begin[first], self.end[last], self.begin[head[first]], self.end[head[last]])
        return all(self.body[a:b] == self.body[c:d] for a, b, c, d in zip(*(x.tolist() for x in spans), strict=True))

    def _by_bytes(self) -> np.ndarray:
        """As `repeated`, without hashes of our own: for windows that differ in spite of equal hashes."""
        seen: dict[bytes, tuple[int, int]] = {}
        places = zip(self.ident.tolist(), self.start.tolist(), strict=True)
        return np.array([seen.setdefault(self.body[a:b], p) != p for a, b, p in zip(self.begin.tolist(), self.end.tolist(), places, strict=True)], bool)


def _runs(keep: np.ndarray, *same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """[first, last] of each run of consecutive places in `keep` over which the arrays in `same` do not change."""
    if not len(keep):
        return keep, keep
    cut = np.ones(len(keep), bool)
    cut[1:] = keep[1:] != keep[:-1] + 1
    for s in same:
        cut[1:] |= s[1:] != s[:-1]
    first = np.flatnonzero(cut)
    last = np.append(first[1:], len(keep)) - 1
    return keep[first], keep[last]


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    have, size = values, 1
    while size * 2 <= width:
        have = np.minimum(have[: len(have) - size], have[size:])
        size *= 2
    rest = width - size
    return np.minimum(have[: len(have) - rest], have[rest:]) if rest else have


def normal_form(words: W.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words each followed by one space, as bytes, and each word's start and end there."""
    length = words.end - words.start
    start = np.concatenate([[0], np.cumsum(length + 1)[:-1]]) if len(length) else np.zeros(0, np.int64)
    out = np.full(int((length + 1).sum()), 32, np.uint8)
    shift = np.repeat(words.start - start, length)
    place = np.repeat(start - np.concatenate([[0], np.cumsum(length)[:-1]]), length) + np.arange(int(length.sum())) if len(length) else np.zeros(0, np.int64)
    out[place] = words.data[place + shift]
    return out, start, start + length


_BLOCK_FIELDS = "bucket int, id long, tag long, ranges array<int>, block binary"


def _packer(width: int, m: int, buckets: int):
    schema = pa.schema([("bucket", pa.int32()), ("id", pa.int64()), ("tag", pa.int64()), ("ranges", pa.list_(pa.int32())), ("block", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1)
        for batch, data, offsets in text_slices(batches, limit=SLICE):
            ids, tags = (batch.column(c).to_numpy() for c in ("id", "tag"))
            if (ids[1:] < ids[:-1]).any():
                order = np.argsort(ids, kind="stable")
                data = np.concatenate([data[offsets[i] : offsets[i + 1]] for i in order.tolist()])
                offsets = np.concatenate([[0], np.cumsum(np.diff(offsets)[order])])
                ids, tags = ids[order], tags[order]
            words = W.split(data, offsets)
            at, hashes = _window_hashes(words, width)
            if not len(at):
                continue
            first = words.first()
            doc = words.doc[at]
            flat, ws, we = normal_form(words)
            whole = flat.tobytes()
            flag = Windows(hashes, ids[doc], at - first[doc], at, whole, ws[at], we[at + width - 1]).repeated()
            rows = {"bucket": [], "id": [], "tag": [], "ranges": [], "block": []}
            lo, hi = _runs(at[flag], doc[flag])
            owner = words.doc[lo]
            pairs = np.stack([lo - first[owner], hi - first[owner] + width], 1).astype(np.int32)
            for d, cut in zip(*_split_by(owner), strict=True):
                rows["bucket"].append(int(ids[d]) % buckets)  # found already; they only pass through
                rows["id"].append(int(ids[d]))
                rows["tag"].append(int(tags[d]))
                rows["ranges"].append(pairs[cut[0] : cut[1]].ravel())
                rows["block"].append(None)
            alone = ~flag
            piece_at, piece_hash = W.grams(words, m)
            dense = np.full(len(words.start), np.iinfo(np.uint64).max, _U)
            dense[piece_at] = piece_hash
            least = _sliding_min(dense, width - m + 1)[at]
            lo, hi = _runs(at[alone], doc[alone], least[alone])
            low = np.full(len(words.start), 0, _U)
            low[at] = least
            bucket = (W.mix(low[lo]) % _U(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            lo, hi, bucket = lo[order], hi[order], bucket[order]
            begin, end = ws[lo].tolist(), we[hi + width - 1].tolist()
            owner = words.doc[lo]
            heads = (ids[owner], tags[owner], lo - first[owner])
            for k, cut in zip(*_split_by(bucket), strict=True):
                i, j = cut
                body = b"\n".join([whole[x:y] for x, y in zip(begin[i:j], end[i:j], strict=True)])
                rows["bucket"].append(int(k))
                rows["id"].append(None)
                rows["tag"].append(None)
                rows["ranges"].append(None)
                rows["block"].append(squeeze.compress(b"".join(((j - i).to_bytes(8, "little"), *(np.diff(h[i:j], prepend=0).tobytes() for h in heads), body))))
            yield pa.RecordBatch.from_pydict(rows, schema=schema)

    return run


def _split_by(values: np.ndarray) -> tuple[list, list]:
    """The values of runs of equal ones, and each run's [first, end)."""
    if not len(values):
        return [], []
    cut = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
    ends = np.append(cut[1:], len(values))
    return values[cut].tolist(), list(zip(cut.tolist(), ends.tolist(), strict=True))


def _counter(width: int):
    def run(group: pa.Table) -> pa.Table:
        heads, bodies = [], []
        known = group.filter(pc.is_null(group["block"])).select(["id", "tag", "ranges"])
        for block in group["block"].drop_null():
            raw = zstandard.decompress(block.as_py())
            n = int.from_bytes(raw[:8], "little")
            heads.append(np.cumsum(np.frombuffer(raw, np.int64, n * 3, 8).reshape(3, n), axis=1).T)
            bodies.append(raw[8 + 24 * n :])
        if not heads:
            return known
        head = np.concatenate(heads)
        whole = b"\n".join(bodies)
        data = np.frombuffer(whole, np.uint8)
        ends = np.append(np.flatnonzero(data == 10), len(data))
        begins = np.concatenate([[0], ends[:-1] + 1])
        words = W.split(data, np.concatenate([begins, [len(data)]]))
        at, hashes = _window_hashes(words, width)
        first = words.first()
        piece = words.doc[at]
        ident, start = head[piece, 0], head[piece, 2] + at - first[piece]
        order = np.lexsort((start, ident))
        flag = np.empty(len(at), bool)
        by = at[order]
        flag[order] = Windows(hashes[order], ident[order], start[order], by, whole, words.start[by], words.end[by + width - 1]).repeated()
        lo, hi = _runs(at[flag], piece[flag])
        owner = words.doc[lo]
        shift = head[owner, 2] - first[owner]
        order = np.lexsort((lo + shift, head[owner, 1], head[owner, 0]))
        ids, tags = head[owner, 0][order], head[owner, 1][order]
        pairs = np.stack([lo + shift, hi + shift + width], 1).astype(np.int32)[order]
        cut = np.flatnonzero(np.concatenate([[True], (ids[1:] != ids[:-1]) | (tags[1:] != tags[:-1])])) if len(ids) else np.zeros(0, np.int64)
        ranges = pa.ListArray.from_arrays(pa.array(2 * np.append(cut, len(ids)), pa.int32()), pa.array(pairs.ravel()))
        return pa.concat_tables([known, pa.table({"id": ids[cut], "tag": tags[cut], "ranges": ranges}).cast(known.schema)])

    return run


def _remover(keep_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in text_slices(batches):
            words = W.split(data, offsets)
            first = words.first()
            delta = np.zeros(len(words.start) + 1, np.int64)
            lists = batch.column("ranges")
            values = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            owner = np.repeat(np.arange(len(lists)), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            places = values + first[owner]
            np.add.at(delta, places[0::2], 1)
            np.add.at(delta, places[1::2], -1)
            kept = np.cumsum(delta[:-1]) == 0
            some = W.Words(words.data, words.start[kept], words.end[kept], words.doc[kept], words.hash[:0], words.n_docs, words.at)
            flat, ws, we = normal_form(some)
            whole = flat.tobytes()
            cuts = some.first()
            texts = [whole[ws[i] : we[j - 1]] if j > i else b"" for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
            columns = [batch.column("id"), pa.array(np.diff(first)), pa.array(np.diff(first) - np.diff(cuts)), pa.array([hashlib.sha256(t).hexdigest() for t in texts])]
            names = ["id", "n_words", "n_removed", "kept_sha256"]
            if keep_text:
                columns.append(pa.array(texts, pa.binary()).cast(pa.string()))
                names.append("kept_text")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 20, keep_text: bool = True, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """One row per row of `docs`: id, n_words, n_removed, kept_sha256, and kept_text if `keep_text`.

    A word goes if a window of `width` words that covers it also starts earlier: at a smaller id, or earlier in the
    same document. Windows are judged on the input.
    """
    prepare(docs.sparkSession)
    docs = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST_ID)).alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    size, rows, ids = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count("*"), F.countDistinct("id")).first()
    buckets = max(16, 3 * size // bucket_bytes)  # packed strings hold about three times the text
    tagged = docs.withColumn("tag", F.lit(0).cast("long") if rows == ids else F.xxhash64("text"))  # tells apart texts under one id
    packed = tagged.mapInArrow(_packer(width, min(MINIMISER_WORDS, width), buckets), _BLOCK_FIELDS)
    crossed = packed.groupBy("bucket").applyInArrow(_counter(width), "id long, tag long, ranges array<int>")
    ranges = crossed.groupBy("id", "tag").agg(F.flatten(F.collect_list("ranges")).alias("ranges"))
    fields = "id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * keep_text
    out = tagged.join(ranges, ["id", "tag"], "left").select("id", "text", "ranges").mapInArrow(_remover(keep_text), fields)
    return out.withColumn("id", F.nullif("id", F.lit(LAST_ID))).withColumnRenamed("id", id_col)


def op9_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), keep_text=False)


#: The same rule by plain windows, for DuckDB.
OP9_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (
  SELECT doc_id, i, array_to_string(ws[i:i + 19], ' ') AS body
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS i FROM w WHERE len(ws) >= 20)),
dup AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY body ORDER BY doc_id, i) AS k FROM win) WHERE k > 1),
gone AS (SELECT DISTINCT doc_id, j FROM (SELECT doc_id, unnest(range(i, i + 20)) AS j FROM dup)),
each AS (SELECT doc_id, ws[j] AS word, j FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS j FROM w)),
kept AS (SELECT e.doc_id, string_agg(e.word, ' ' ORDER BY e.j) AS body, count(*) AS n FROM each e ANTI JOIN gone g ON e.doc_id = g.doc_id AND e.j = g.j GROUP BY e.doc_id)
SELECT w.doc_id, len(w.ws)::BIGINT AS n_words, (len(w.ws) - coalesce(k.n, 0))::BIGINT AS n_removed, sha256(coalesce(k.body, '')) AS kept_sha256
FROM w LEFT JOIN kept k USING (doc_id)
"""
