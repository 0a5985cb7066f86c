"""Packing documents into sequences by swap-based local search (operator 8).

Documents become pieces of at most `size` tokens (only longer ones are cut; the odd piece comes first). Pieces are dealt out
by a hash of the document and piece into groups of about `GROUP` pieces; each group is packed alone:

1. best-fit decreasing over lengths gives the first bins,
2. local search on the underfull bins: exchange one piece for one, two pieces for one, or move one, whenever that raises the
   sum of squared fills; a full bin is done, a bin that runs empty goes. It ends when no exchange helps.

The number of groups follows from the number of pieces, so a group's size (and a task's memory) does not grow.
Null and empty texts are one piece with the end id. Each row of the input is a document of its own; rows with equal or null ids
keep separate pieces, and equal rows are packed each. Pieces of equal length are ordered by id, then piece. A very long text
is cut into pieces by one task. An empty table gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort
from collections import Counter, defaultdict
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, prepare, table, text_slices
from .encode import encoder

SIZE = 2048
GROUP = 20_000


def best_fit(lengths: np.ndarray, size: int) -> list[list[int]]:
    """Bins of piece numbers by best-fit decreasing; ties by number."""
    order = np.lexsort((np.arange(len(lengths)), -lengths))
    bins: list[list[int]] = []
    by_room: dict[int, list[int]] = defaultdict(list)
    rooms: list[int] = []  # the different rooms there are, ascending
    for i in order.tolist():
        need = int(lengths[i])
        at = bisect_left(rooms, need)
        if at == len(rooms):
            bins.append([i])
            b, room = len(bins) - 1, size
        else:
            room = rooms[at]
            b = by_room[room].pop()
            if not by_room[room]:
                rooms.pop(at)
            bins[b].append(i)
        left = room - need
        if left:
            if not by_room[left]:
                insort(rooms, left)
            by_room[left].append(b)
    return bins


class _Offers:
    """What the underfull bins can give: single pieces and pairs of pieces, by their length together."""

    def __init__(self, lengths: list[int]):
        self.lengths = lengths
        self.heaps: tuple[dict, dict] = ({}, {})  # length -> (fill, bin, version), the emptiest bin first
        self.counts: tuple[dict, dict] = ({}, {})
        self.sizes: tuple[list[int], list[int]] = ([], [])
        self.version: dict[int, int] = {}
        self.held: dict[int, tuple[list[int], list[int]]] = {}

    def amounts(self, pieces: list[int]) -> tuple[list[int], list[int]]:
        """Different lengths of single pieces and of pairs; pieces of equal length serve alike."""
        n = Counter(self.lengths[x] for x in pieces)
        kinds = sorted(n)
        pairs = {g + h for i, g in enumerate(kinds) for h in kinds[i + 1 :]} | {2 * g for g in kinds if n[g] > 1}
        return kinds, sorted(pairs)

    def add(self, b: int, pieces: list[int], fill: int) -> None:
        version = self.version[b] = self.version.get(b, 0) + 1
        self.held[b] = self.amounts(pieces)
        for amounts, heaps, counts, sizes in zip(self.held[b], self.heaps, self.counts, self.sizes, strict=True):
            for t in amounts:
                heappush(heaps.setdefault(t, []), (fill, b, version))
                counts[t] = counts.get(t, 0) + 1
                if counts[t] == 1:
                    insort(sizes, t)

    def drop(self, b: int) -> None:
        self.version[b] += 1
        for amounts, heaps, counts, sizes in zip(self.held.pop(b), self.heaps, self.counts, self.sizes, strict=True):
            for t in amounts:
                counts[t] -= 1
                if not counts[t]:
                    sizes.pop(bisect_left(sizes, t))
                    del heaps[t]

    def emptiest(self, kind: int, t: int) -> tuple[int, int]:
        """(fill, bin) of the emptiest bin that can give `t`."""
        heap = self.heaps[kind][t]
        while self.version[heap[0][1]] != heap[0][2]:
            heappop(heap)
        return heap[0][:2]

    def best(self, pieces: list[int], fill: int, size: int) -> tuple[int, int, int, int, int] | None:
        """(gain, given, taken, pieces taken, bin) of the exchange that fills a bin most: a move, one for one, or two for one either way.

        A source that is fuller counts only where the bin ends up fuller than that: so the sum of squares grows.
        """
        room, gain, found = size - fill, 0, None
        singles, pairs = self.amounts(pieces)
        for many, given in ((0, [0]), (1, singles), (2, pairs)):
            for g in given:
                for kind in (0, 1) if many < 2 else (0,):
                    sizes = self.sizes[kind]
                    k = bisect_right(sizes, room + g) - 1
                    while k >= 0 and sizes[k] - g > gain:
                        other, b = self.emptiest(kind, sizes[k])
                        if other - fill < sizes[k] - g:
                            gain, found = sizes[k] - g, (g, sizes[k], kind + 1, b)
                            break
                        k -= 1
                if gain == room:
                    return gain, *found
        return (gain, *found) if found else None

    def pick(self, pieces: list[int], total: int, many: int) -> list[int]:
        """One or two pieces of that length together."""
        place: dict[int, int] = {}
        for x in pieces:
            if many == 1 and self.lengths[x] == total:
                return [x]
            if many == 2 and total - self.lengths[x] in place:
                return [place[total - self.lengths[x]], x]
            place.setdefault(self.lengths[x], x)
        raise ValueError("no such pieces")


def local_search(bins: list[list[int]], lengths: np.ndarray, size: int) -> list[list[int]]:
    """Moves and exchanges between underfull bins that raise the sum of squared fills, until none does.

    The fullest bin takes from the emptiest that have what fills it best. The sum grows with each exchange, so this ends.
    """
    sizes = [int(x) for x in lengths]
    bins = [list(b) for b in bins]
    fill = [sum(sizes[x] for x in b) for b in bins]
    offers = _Offers(sizes)
    for b, f in enumerate(fill):
        if f < size:
            offers.add(b, bins[b], f)
    todo: list[tuple[int, int]] = []
    changed = True
    while todo or changed:
        if not todo:  # once more over all bins, until a round without an exchange
            todo, changed = [(-fill[b], b) for b in offers.held], False
            heapify(todo)
            if not todo:
                break
        f, b = heappop(todo)
        if b not in offers.held or fill[b] != -f:
            continue
        offers.drop(b)
        while fill[b] < size and (found := offers.best(bins[b], fill[b], size)):
            gain, given, taken, many, y = found
            give = [] if not given else offers.pick(bins[b], given, 1 if given in offers.amounts(bins[b])[0] else 2)
            take = offers.pick(bins[y], taken, many)
            if len(give) == 2 and many == 2:
                raise ValueError("two for two is no exchange here")
            offers.drop(y)
            bins[b] = [x for x in bins[b] if x not in give] + take
            bins[y] = [x for x in bins[y] if x not in take] + give
            fill[b] += gain
            fill[y] -= gain
            changed = True
            if bins[y]:
                offers.add(y, bins[y], fill[y])
                heappush(todo, (-fill[y], y))
        if fill[b] < size:
            offers.add(b, bins[b], fill[b])
    return [b for b in bins if b]


def pack(lengths: np.ndarray, size: int = SIZE) -> list[list[int]]:
    """Bins of piece numbers, none over `size`."""
    return local_search(best_fit(lengths, size), lengths, size)


def _pieces(path: str, end_id: int, size: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = encoder(path)
        end = end_id.to_bytes(4, "little")
        for batch, _, _ in text_slices(batches):
            owner, piece, start, length, crc, body = [], [], [], [], [], []
            for i, ids in enumerate(tokens.many(batch.column("text").fill_null("").to_pylist())):
                ids += end
                n = len(ids) // 4
                at, k = 0, 0
                while at < n:
                    to = at + (n % size or size) if not at else at + size
                    part = ids[4 * at : 4 * to]
                    owner.append(i)
                    piece.append(k)
                    start.append(at)
                    length.append(to - at)
                    crc.append(zlib.crc32(part))
                    body.append(part)
                    at, k = to, k + 1
            columns = [batch.column("id").take(pa.array(owner, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            names = ["id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                columns.append(pa.array([np.frombuffer(x, "<u4").astype(np.int32) for x in body], pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def _packer(size: int):
    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([("id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending"), ("length", "ascending")])
        lengths = group["length"].to_numpy()
        base = group["part"][0].as_py() << 32
        bin_of, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
        for b, pieces in enumerate(pack(lengths, size)):
            pieces = np.array(sorted(pieces))
            bin_of[pieces] = base + b
            offset[pieces] = np.cumsum(lengths[pieces]) - lengths[pieces]
        return group.drop_columns(["part"]).append_column("sequence_id", pa.array(bin_of)).append_column("offset", pa.array(offset))

    return run


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int, size: int = SIZE, id_col: str = "doc_id", text_col: str = "text", group: int = GROUP, with_ids: bool = False) -> DataFrame:
    """A row per piece: id, piece, start, length, ids_crc32, (ids), sequence_id, offset."""
    spark = docs.sparkSession
    prepare(spark)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    fields = f"id {rows.schema['id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    pieces = materialize(rows.mapInArrow(_pieces(tokenizer, end_id, size, with_ids), fields))
    groups = max(1, round(pieces.count() / group))
    dealt = pieces.withColumn("part", F.pmod(F.xxhash64("id", "piece", "ids_crc32", F.monotonically_increasing_id()), F.lit(groups)))
    return dealt.groupBy("part").applyInArrow(_packer(size), f"{fields}, sequence_id long, offset long").withColumnRenamed("id", id_col)


def op8_best_fit_packing(spark, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    return pack_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer, 0)
