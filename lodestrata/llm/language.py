"""Language of each document as a mixture (operator 3).

Training counts byte n-grams (n = 2 to 4, hashed into `BINS` bins) of the lower-cased letters of every learnable text, by
language, in one pass with one table a task and language. A space stands before and after each text, so that a single letter
has n-grams too. A document's proportions come from expectation-maximisation over the mixture of the languages' n-gram
distributions. Languages join one by one: every language that is not in the mixture yet is tried, and the one with the largest likelihood
joins if it gains more than the penalty (`PENALTY` x log of the number of n-grams, as in BIC). Maximisation ends where no share moves
by more than `STILL`, after `ROUNDS` rounds at most; the gain is then that of the shares reached.

The language named is the one with the largest share (ties: the first in alphabetical order); `score` is that share.
Texts that are null or have no letter are `und` with score 0. Rows without a language teach nothing; with nothing to
learn from, every text is `und`. Equal texts get equal results, repeated rows and rows with equal or null ids a row
each; very long texts are handled whole, alone in their slice; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .common import prepare, table, text_slices

BINS = 1 << 16
ORDERS = (2, 3, 4)
ROUNDS = 40
STILL = 1e-3
PENALTY = 2.0
SMOOTH = 0.5

#: Lower case; ASCII characters other than letters read as a space, so that n-grams hold letters and word ends.
LETTERS = W.LOWER.copy()
LETTERS[[c for c in range(128) if not chr(c).isalpha()]] = 32


def gram_bins(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text number, bin) of all n-grams that lie within one text and hold more than white space."""
    n_docs = len(offsets) - 1
    owner = np.repeat(np.arange(n_docs), np.diff(offsets) + 2)
    padded = np.full(len(data) + 2 * n_docs, 32, np.uint32)
    padded[np.arange(len(data)) + 2 * np.repeat(np.arange(n_docs), np.diff(offsets)) + 1] = LETTERS[data]
    data = padded
    docs, bins = [], []
    for n in ORDERS:
        m = len(data) - n + 1
        if m <= 0:
            continue
        code = np.zeros(m, np.uint32)
        for k in range(n):
            code = (code << np.uint32(8)) | data[k : k + m]
        keep = (owner[:m] == owner[n - 1 :]) & ((data[:m] != 32) | (data[1 : m + 1] != 32))
        code = code[keep] * np.uint32(0x9E3779B1) + np.uint32(n * 0x85EBCA6B & 0xFFFFFFFF)
        code ^= code >> np.uint32(15)
        bins.append(((code * np.uint32(0x2C1B3C6D)) >> np.uint32(16)).astype(np.int64))
        docs.append(owner[:m][keep])
    if not bins:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(docs), np.concatenate(bins)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[str, np.ndarray] = {}
    for batch, data, offsets in text_slices(batches, limit=1 << 20):
        langs = batch.column("lang").to_pylist()
        names = sorted(set(langs))
        code = np.array([names.index(x) for x in langs])
        doc, at = gram_bins(data, offsets)
        counts = np.bincount(code[doc] * BINS + at, minlength=len(names) * BINS).reshape(len(names), BINS)
        for name, row in zip(names, counts, strict=True):
            total[name] = total.get(name, 0) + row
    for name, row in total.items():
        some = np.flatnonzero(row)
        yield pa.RecordBatch.from_arrays([pa.array([name] * len(some), pa.string()), pa.array(some, pa.int32()), pa.array(row[some])], names=["lang", "bin", "n"])


def mixture(doc: np.ndarray, count: np.ndarray, like: np.ndarray, n_docs: int, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """(shares [documents x languages], log-likelihoods) by expectation-maximisation from equal shares.

    `like` has the n-grams' probabilities in each language, `doc` and `count` their documents (ascending) and counts. A document
    whose shares move by `STILL` at most is done.
    """
    n_lang = like.shape[1]
    share = np.full((n_docs, n_lang), 1 / n_lang)
    fit = np.zeros(n_docs)
    total = np.bincount(doc, weights=count, minlength=n_docs)
    open_docs = total > 0
    for left in range(rounds, -1, -1):
        rows = np.flatnonzero(open_docs[doc]) if not open_docs.all() else slice(None)
        d, c, p = doc[rows], count[rows], like[rows]
        if not len(d):
            break
        at = np.flatnonzero(open_docs)
        first = np.searchsorted(d, at)
        part = share[d] * p
        whole = np.maximum(part.sum(1), 1e-300)
        fit[at] = np.add.reduceat(c * np.log(whole), first)
        if not left:
            break
        new = np.add.reduceat(part * (c / whole)[:, None], first, axis=0) / total[at, None]
        moved = np.abs(new - share[at]).max(1)
        share[at] = new
        open_docs[at[moved <= STILL]] = False
    return share, fit


def pair(doc: np.ndarray, count: np.ndarray, old: np.ndarray, new: np.ndarray, n_docs: int, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """(share of the second, log-likelihoods) of mixtures of two distributions: as `mixture`, in one unknown a document."""
    share, fit = np.full(n_docs, 0.5), np.zeros(n_docs)
    total = np.bincount(doc, weights=count, minlength=n_docs)
    at = np.flatnonzero(total > 0)
    step = new - old
    for left in range(rounds, -1, -1):
        if not len(at):
            break
        first = np.searchsorted(doc, at)
        mixed = old + share[doc] * step
        back = share[at] * np.add.reduceat(count * new / mixed, first) / total[at]
        still = np.abs(back - share[at]) <= STILL
        share[at] = back
        if left and not still.any():
            continue
        ended = at if not left else at[still]
        rows = np.isin(doc, ended) if left else slice(None)
        d = doc[rows]
        final = np.log(old[rows] + share[d] * step[rows])
        fit[ended] = np.add.reduceat(count[rows] * final, np.searchsorted(d, ended))
        if not left:
            break
        at, rest = at[~still], ~rows
        doc, count, old, new, step = doc[rest], count[rest], old[rest], new[rest], step[rest]
    return share, fit


def choose(doc: np.ndarray, count: np.ndarray, like: np.ndarray, n_docs: int, penalty: float = PENALTY) -> np.ndarray:
    """Shares with languages chosen forwards by penalised likelihood; zero for the others."""
    n_lang = like.shape[1]
    total = np.bincount(doc, weights=count, minlength=n_docs)
    single = np.stack([np.bincount(doc, weights=count * logs, minlength=n_docs) for logs in np.log(like).T], 1)
    chosen = np.zeros((n_docs, n_lang), bool)
    chosen[np.arange(n_docs), single.argmax(1)] = True
    shares = chosen.astype(float)
    fit = single.max(1)
    cost = penalty * np.log(total + 1)
    at = np.arange(n_docs)
    rows = np.arange(len(doc))
    for size in range(1, n_lang):
        # every language that is not in the mixture yet is tried, one at a time
        best, mixed, who = np.full(len(at), -np.inf), np.zeros((len(at), n_lang)), np.zeros(len(at), np.int64)
        of = np.searchsorted(at, doc[rows])
        part, n = like[rows], count[rows]
        for j in range(n_lang):
            tried = ~chosen[at, j]
            some = np.flatnonzero(tried[of])
            if not len(some):
                continue
            local = (np.cumsum(tried) - 1)[of[some]]
            mine = np.flatnonzero(tried)
            if size == 1:
                old = part[some, chosen[at].argmax(1)[of[some]]]
                second, new_fit = pair(local, n[some], old, part[some, j], len(mine))
                new_shares = shares[at[mine]] * (1 - second)[:, None]
                new_shares[:, j] = second
            else:
                allowed = chosen[at[mine]].copy()
                allowed[:, j] = True
                new_shares, new_fit = mixture(local, n[some], part[some] * allowed[local], len(mine))
            better = new_fit > best[mine]
            best[mine[better]], mixed[mine[better]], who[mine[better]] = new_fit[better], new_shares[better], j
        win = best > fit[at] + cost[at]
        won = at[win]
        chosen[won, who[win]] = True
        shares[won], fit[won] = mixed[win], best[win]
        at = won
        if not len(at):
            break
        rows = rows[np.isin(doc[rows], at)]
    return shares


def _predict(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, table_ = shared.value
        for batch, data, offsets in text_slices(batches, limit=1 << 20):
            n = batch.num_rows
            texts = batch.column("text")
            letters = pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False).to_numpy(zero_copy_only=False)
            names, scores = np.full(n, "und", object), np.zeros(n)
            mix_: list = [[] for _ in range(n)]
            if len(langs):
                doc, at = gram_bins(data, offsets)
                pair, count = np.unique(doc * BINS + at, return_counts=True)
                doc, at = pair // BINS, pair % BINS
                shares = choose(doc, count.astype(float), table_[at], n)
                best = shares.argmax(1)
                for i in np.flatnonzero(letters).tolist():
                    names[i], scores[i] = langs[best[i]], min(1.0, shares[i, best[i]])
                    mix_[i] = [(langs[j], float(shares[i, j])) for j in np.flatnonzero(shares[i] > 0)]
            kind = pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))
            mix_ = pa.array([[{"lang": a, "share": b} for a, b in m] for m in mix_], kind)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(names, pa.string()), pa.array(scores), mix_], names=["id", "lang_pred", "score", "mixture"])

    return run


def identify(docs: DataFrame, train: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per row of `docs`: id, lang_pred, score, mixture (languages with their shares); learned from `train`."""
    spark = docs.sparkSession
    prepare(spark)
    known = train.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).where("lang is not null and text is not null")
    counts = known.mapInArrow(_count, "lang string, bin int, n long").groupBy("lang", "bin").agg(F.sum("n").alias("n"))
    grouped = counts.groupBy("lang").agg(F.collect_list("bin").alias("bin"), F.collect_list("n").alias("n")).orderBy("lang").collect()  # BINS entries a language
    langs = np.array([r["lang"] for r in grouped], object)
    like = np.full((BINS, len(langs)), SMOOTH)
    for j, r in enumerate(grouped):
        like[np.array(r["bin"]), j] += np.array(r["n"])
    if len(langs):
        like /= like.sum(0)
    shared = spark.sparkContext.broadcast((langs, like))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    fields = f"id {rows.schema['id'].dataType.simpleString()}, lang_pred string, score double, mixture array<struct<lang string, share double>>"
    return rows.mapInArrow(_predict(shared), fields).withColumnRenamed("id", id_col)


HELD_OUT = "crc32(cast(doc_id as string)) % 3 = 1"


def op3_language(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    train = docs.where(f"coalesce(not ({HELD_OUT}), true)").select("text", "lang")
    found = identify(docs.select("doc_id", "text"), train)
    return found.select("doc_id", F.expr(f"coalesce({HELD_OUT}, false)").alias("held_out"), "lang_pred", "score", "mixture")
