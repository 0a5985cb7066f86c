"""Benchmark decontamination by rare seeds and Smith-Waterman alignment (operator 7).

1. one pass counts, over all documents, in how many each word of the test items occurs (one small table a task),
2. an alignment of score `least` matches at least m of an item's L words, whatever is edited. Items are cut into n-grams of `SEED` words.
   Any set of them whose words, less one for each n-gram, outnumber the L - m words that may stay unmatched has one of which two
   words match (pigeonhole). So each item's rarest n-grams, as many as that takes, are its seeds; a document hits a seed
   that two of its words hit. (Where a low `least` leaves too few n-grams, single words are the seeds, L - m + 1 of them.) The order
   by count only saves work,
3. a second pass joins documents to items on the seeds, keeps the pairs that share m of the item's words, takes the
   stretches of text in which m words of the item lie close enough, and aligns them with the item word by word.

Test items are taken in blocks of bounded size; each block's words are the only thing sent to all tasks.
Words are lower-cased runs of characters other than white space and ASCII punctuation. Items of fewer than `n` words and
null items match nothing; documents that are null or empty match nothing; rows with null ids keep them. A document with
several passages of an item gets one row, with the best passage, the first of equally good ones. Repeated rows and rows
with equal ids get rows of their own; equal items match each. A very long text is searched whole, in the stretches that hold
enough of an item's words. Empty tables give an empty result. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .common import prepare, table, text_slices

N = 4
#: Alignment score: a match, a mismatch, a gap; the score of a pair is the best local sum over that of the whole item.
MATCH, MISMATCH, GAP = 2, -1, -1
LEAST_SCORE = 0.6
#: Words of a seed.
SEED = 3
#: Words of test items handled (and broadcast) at once.
BLOCK_WORDS = 1_000_000

#: Lower case; ASCII punctuation reads as a space.
FOLD = W.LOWER.copy()
FOLD[[c for c in range(33, 127) if not chr(c).isalnum()]] = 32


class Items:
    """Test items of a block: words, the different words (`gram`), and each item's code and number of each of its words."""

    def __init__(self, texts: list[str], n: int):
        raw = [t.encode() for t in texts]
        offsets = np.concatenate([[0], np.cumsum([len(t) for t in raw])]).astype(np.int64)
        words = W.split(FOLD[np.frombuffer(b"".join(raw), np.uint8)], offsets)
        first = words.first()
        self.words = [words.hash[first[i] : first[i + 1]] for i in range(len(texts))]
        self.length = np.diff(first)
        long = self.length[words.doc] >= n
        self.gram, code = np.unique(words.hash[long], return_inverse=True)
        self.laid, self.owner = code, words.doc[long]  # all words in their order
        pair, self.times = np.unique(words.doc[long] * max(1, len(self.gram)) + code, return_counts=True)
        self.item, self.code = pair // max(1, len(self.gram)), pair % max(1, len(self.gram))

    def need(self, least: float) -> np.ndarray:
        """How many words of each item an alignment of score `least` matches at least."""
        return np.ceil(least * self.length - 1e-9).astype(np.int64)

    def seeds(self, count: np.ndarray, least: float) -> Seeds:
        """The rarest n-grams of each item, as many as any alignment of score `least` must match two words of."""
        spare = self.length - self.need(least)
        place = np.arange(len(self.owner)) - np.searchsorted(self.owner, self.owner)
        parts = []
        for size in (SEED, 1):
            # n-grams that stand end to end; of single words one match is enough
            _, gram = np.unique(self.owner * (int(self.length.max(initial=0)) + 1) + place // size, return_inverse=True)
            of = np.zeros(gram.max(initial=-1) + 1, np.int64)
            of[gram] = self.owner
            worth = np.bincount(gram, minlength=len(of)) - (size > 1)
            enough = np.bincount(of, weights=worth, minlength=len(self.length)) > spare
            use = enough if size > 1 else ~parts[0][0]
            # how often two words of it occur: by the two most frequent ones
            order = np.lexsort((-count[self.laid], gram))
            head = np.searchsorted(gram[order], np.arange(len(of)))
            second = order[np.minimum(head + 1, len(order) - 1)] if len(order) else order
            often = count[self.laid[order[head]]] * np.where(gram[second] == np.arange(len(of)), count[self.laid[second]], 1) if len(of) else of
            rank = np.lexsort((np.arange(len(of)), often, of))
            before = np.cumsum(worth[rank]) - worth[rank]
            before -= before[np.searchsorted(of[rank], of[rank])] if len(of) else 0
            kept = np.zeros(len(of), bool)
            kept[rank[before <= spare[of[rank]]]] = True
            parts.append((use, gram, of, kept & use[of], 1 + (size > 1)))
        codes, grams, items, needs, base = [], [], [], [], 0
        for _, gram, of, kept, need in parts:
            on = kept[gram]
            codes.append(self.laid[on])
            grams.append(gram[on] + base)
            items.append(of)
            needs.append(np.full(len(of), need))
            base += len(of)
        pair, times = np.unique(np.concatenate(codes) * max(1, base) + np.concatenate(grams), return_counts=True)
        return Seeds(pair // max(1, base), pair % max(1, base), times, np.concatenate(items), np.concatenate(needs))


class Seeds(NamedTuple):
    """Words of seeds, sorted by `code`: the seed and how often the word is in it; each seed's item and how many of its words must be there."""

    code: np.ndarray
    seed: np.ndarray
    times: np.ndarray
    item: np.ndarray
    need: np.ndarray


class Lookup:
    """Which values occur in a sorted array: a bit map first, then a binary search."""

    def __init__(self, values: np.ndarray):
        self.values = values
        self.shift = np.uint64(64 - 22)
        self.map = np.zeros(1 << 22, bool)
        self.map[(values >> self.shift).astype(np.int64)] = True

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index into hashes, first place in the values) of those that occur."""
        some = np.flatnonzero(self.map[(hashes >> self.shift).astype(np.int64)])
        place = np.searchsorted(self.values, hashes[some])
        hit = place < len(self.values)
        hit[hit] = self.values[place[hit]] == hashes[some[hit]]
        return some[hit], place[hit]


def align(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """(score, item's and text's index of the last aligned word) of the best local alignment."""
    ramp = -GAP * np.arange(len(text) + 1)
    above = np.zeros(len(text) + 1, np.int64)
    best, bi, bj = 0, -1, -1
    for i, word in enumerate(item):
        row = np.maximum(above + GAP, 0)
        row[1:] = np.maximum(row[1:], above[:-1] + np.where(text == word, MATCH, MISMATCH))
        row = np.maximum.accumulate(row + ramp) - ramp
        j = int(row.argmax())
        if row[j] > best:
            best, bi, bj = int(row[j]), i, j - 1
        above = row
    return best, bi, bj


def _count(grams: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = Lookup(grams)
        total = np.zeros(len(grams), np.int64)
        for _, data, offsets in text_slices(batches):
            words = W.split(FOLD[data], offsets)
            hit, place = lookup.find(words.hash)
            pairs = np.unique(words.doc[hit] * len(grams) + place)
            total += np.bincount(pairs % len(grams), minlength=len(grams))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["code", "df"])

    return run


def _expand(low: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, place) of the ranges [low, low + many) of all rows."""
    row = np.repeat(np.arange(len(low)), many)
    return row, np.arange(many.sum()) - np.repeat(np.cumsum(many) - many - low, many)


#: Words of items looked up at once.
LOOKED_UP = 2_000_000


def _candidates(present: np.ndarray, block: Items, seeds: Seeds, need: np.ndarray) -> np.ndarray:
    """Pairs document * items + item that hit a seed and share enough words; `present` are the sorted pairs document * words + word."""
    kinds, n, m = max(1, len(block.gram)), max(1, len(block.words)), max(1, len(seeds.item))
    docs = present // kinds
    low, high = (np.searchsorted(seeds.code, present % kinds, side) for side in ("left", "right"))
    begin = np.searchsorted(block.item, np.arange(n + 1))
    out = []
    # whole documents at a time, so that neither step lays out much at once
    ends = np.cumsum(high - low)
    at = 0
    while at < len(present):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + LOOKED_UP, "right")))
        to = int(np.searchsorted(docs, docs[to - 1], "right"))
        row, place = _expand(low[at:to], (high - low)[at:to])
        hit, which = np.unique(docs[at:to][row] * m + seeds.seed[place], return_inverse=True)
        hit = hit[np.bincount(which, weights=seeds.times[place], minlength=len(hit)) >= seeds.need[hit % m]] if len(hit) else hit
        out.append(np.unique(hit // m * n + seeds.item[hit % m]) if len(hit) else hit)
        at = to
    pairs = np.unique(np.concatenate(out)) if out else np.zeros(0, np.int64)
    many = np.diff(begin)[pairs % n]
    ends = np.cumsum(many)
    keep = np.zeros(len(pairs), bool)
    at = 0
    while at < len(pairs):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + LOOKED_UP, "right")))
        row, place = _expand(begin[pairs[at:to] % n], many[at:to])
        key = pairs[at:to][row] // n * kinds + block.code[place]
        found = np.searchsorted(present, key)
        hit = present[np.minimum(found, len(present) - 1)] == key
        keep[at:to] = np.bincount(row[hit], weights=block.times[place[hit]], minlength=to - at) >= need[pairs[at:to] % n]
        at = to
    return pairs[keep]


def _stretches(there: np.ndarray, need: int, span: int) -> Iterator[tuple[int, int]]:
    """[a, b) of the text that hold all runs of `span` places with `need` of the places `there` or more."""
    if len(there) < need:
        return
    first = np.flatnonzero(there[need - 1 :] - there[: len(there) - need + 1] < span)
    if not len(first):
        return
    a, b = there[first], there[first + need - 1] + 1
    new = np.flatnonzero(np.concatenate([[True], a[1:] >= b[:-1]]))
    yield from zip(a[new].tolist(), b[np.append(new[1:], len(a)) - 1].tolist(), strict=True)


def _search(block: Items, seeds: Seeds, least: float):
    need = block.need(least)
    # matches, mismatches and gaps in the text of an alignment that reaches the score, at most
    span = np.floor((1 + MATCH * (1 - least)) * block.length + 1e-9).astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = Lookup(block.gram)
        kinds, n = max(1, len(block.gram)), max(1, len(block.words))
        of_item, marked = np.searchsorted(block.item, np.arange(n + 1)), np.zeros(kinds, bool)
        for batch, data, offsets in text_slices(batches):
            words = W.split(FOLD[data], offsets)
            hit, code = lookup.find(words.hash)
            pairs = _candidates(np.unique(words.doc[hit] * kinds + code), block, seeds, need)
            first = words.first()
            begin = np.searchsorted(hit, first)
            found: dict[tuple[int, int], tuple] = {}
            for d, i in zip((pairs // n).tolist(), (pairs % n).tolist(), strict=True):
                body, whole = block.words[i], words.hash[first[d] : first[d + 1]]
                own = slice(of_item[i], of_item[i + 1])
                marked[block.code[own]] = True
                codes = code[begin[d] : begin[d + 1]]
                held = marked[codes]
                marked[block.code[own]] = False
                places, codes = hit[begin[d] : begin[d + 1]][held] - first[d], codes[held]
                for a, b in _stretches(places, int(need[i]), int(span[i])):
                    text, within = whole[a:b], codes[np.searchsorted(places, a) : np.searchsorted(places, b)]
                    marked[within] = True
                    enough = block.times[own][marked[block.code[own]]].sum() >= need[i]
                    marked[within] = False
                    if not enough:
                        continue
                    score, ei, ej = align(body, text)
                    share = score / (MATCH * len(body))
                    if share >= least and share > found.get((d, i), (0.0,))[0]:
                        _, _, back = align(body[: ei + 1][::-1], text[: ej + 1][::-1])
                        found[d, i] = (share, a + ej - back, a + ej + 1)
            keys = sorted(found)
            ids = batch.column("id")
            yield pa.RecordBatch.from_arrays(
                [
                    ids.take(pa.array([d for d, _ in keys], pa.int64())), pa.array([i for _, i in keys], pa.int32()),
                    *(pa.array([found[k][f] for k in keys], kind) for f, kind in enumerate((pa.float64(), pa.int32(), pa.int32()))),
                ],
                names=["id", "item", "score", "first_word", "end_word"],
            )

    return run


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", n: int = N, least: float = LEAST_SCORE) -> DataFrame:
    """A row for each (document, test item) aligned with a score of `least` or more: both ids, score, words [first, end)."""
    spark = docs.sparkSession
    prepare(spark)
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    items = items.select(F.col(item_col).alias("item_id"), F.coalesce(item_text, F.lit("")).alias("text"))
    size = items.agg(F.sum(F.size(F.split("text", r"\s+")))).first()[0] or 0
    blocks = -(-size // BLOCK_WORDS) or 1
    id_type, item_type = docs.schema["id"].dataType.simpleString(), items.schema["item_id"].dataType
    parts = []
    for b in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == b).orderBy("item_id", "text").collect()  # bounded by BLOCK_WORDS
        block = Items([r["text"] for r in rows], n)
        count = np.zeros(len(block.gram), np.int64)
        if len(block.gram):
            for r in docs.mapInArrow(_count(block.gram), "code long, df long").groupBy("code").agg(F.sum("df").alias("df")).collect():
                count[r["code"]] = r["df"]
        names = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(rows)], f"item int, {item_col} {item_type.simpleString()}")
        found = docs.mapInArrow(_search(block, block.seeds(count, least), least), f"id {id_type}, item int, score double, first_word int, end_word int")
        parts.append(found.join(F.broadcast(names), "item").select(F.col("id").alias(id_col), item_col, "score", "first_word", "end_word"))
    return reduce(DataFrame.unionByName, parts)


def op7_decontamination(spark, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
