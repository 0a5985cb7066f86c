"""Toxicity by the nearest labelled examples under exact TF-IDF cosine (operator 2).

1. the classifier is fitted on at most `max_examples` labelled rows a class, in the order of a hash of the id; this
   bound is the only one. Shares of the classes come from all labels,
2. terms are whole words and word beginnings of 4, 5 and 6 bytes. Those of the examples that tell the classes apart form the
   vocabulary, however many: half their G statistic exceeds the logarithm of the number of terms tested by `MARGIN`, so
   that about one chance finding in exp(MARGIN) vocabularies is expected, and the classes' rates differ by `LEAST_LIFT` or more.
   Terms in fewer than `MIN_DF` examples are not tested. The cosine is over this vocabulary, not over all words: common words,
   which all texts share, would hide the telling ones, and their lists hold half of the examples each,
3. every document becomes a sparse vector over it, once; document frequencies over all documents give the IDF,
4. the index of the examples: inverted lists in blocks of examples, with each term's largest weight in each block,
5. a document's neighbours are found block by block in the order of the blocks' upper bounds until the bound is below
   the k-th best similarity, so the k nearest are exact,
6. votes weighted by 1 / (distance + EASE) against a prior, mapped to a probability by a logistic fit on the left-out
   votes of `calibration` of the examples, evenly taken.

Null and empty texts have no terms and score as a document without evidence, as does any text without a term of the
vocabulary. Labels other than 0 and 1, and null labels and ids, teach nothing. A document labelled twice with both labels
counts as toxic. Equal texts get equal scores; repeated rows get a row each; rows with equal ids are scored one by one, and
each teaches with the label of its id. Of equally similar examples those first in the index vote. Very long texts are handled
whole, alone in their slice. An empty table gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .common import materialize, prepare, table, text_slices
from .decontaminate import FOLD, Lookup

BEGINNINGS = (4, 5, 6)
MIN_DF = 4
MARGIN = 2.3
#: The term's rates in the classes differ by this factor at least.
LEAST_LIFT = 4.0
#: Bound of the labelled sample that the index holds, for each class.
MAX_EXAMPLES = 6000
#: Examples whose left-out votes the logistic fit takes.
CALIBRATION = 3000
K = 15
BLOCK = 128
EASE = 0.05
#: Weight of the prior vote, as that of a neighbour at distance one half.
PRIOR_VOTES = 1.0


def terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text number, term hash) of each word and word beginning."""
    words = W.split(FOLD[data], offsets)
    docs, hashes = [words.doc], [words.hash]
    for n in BEGINNINGS:
        long = np.flatnonzero(words.end - words.start > n)
        docs.append(words.doc[long])
        hashes.append(W.mix(W.hash_spans(words.data, words.at, words.start[long], np.full(len(long), n)) ^ np.uint64(n)))
    return np.concatenate(docs), np.concatenate(hashes)


def _class_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, data, offsets in text_slices(batches):
        toxic = batch.column("toxic").to_numpy()
        doc, term = terms(data, offsets)
        order = np.lexsort((doc, term))
        doc, term = doc[order], term[order]
        new = np.ones(len(doc), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (term[1:] != term[:-1])
        doc, term = doc[new], term[new]
        found, code = np.unique(term, return_inverse=True)
        bad = np.bincount(code, weights=toxic[doc], minlength=len(found)).astype(np.int64)
        total = np.bincount(code, minlength=len(found))
        yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(bad), pa.array(total)], names=["term", "bad", "n"])


def _vectors(vocabulary: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = Lookup(vocabulary)
        for batch, data, offsets in text_slices(batches):
            doc, term = terms(data, offsets)
            hit, place = lookup.find(term)
            pair, count = np.unique(doc[hit] * max(1, len(vocabulary)) + place, return_counts=True)
            owner, code = pair // max(1, len(vocabulary)), pair % max(1, len(vocabulary))
            bounds = pa.array(np.searchsorted(owner, np.arange(len(offsets))), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("row"), pa.ListArray.from_arrays(bounds, pa.array(code, pa.int32())), pa.ListArray.from_arrays(bounds, pa.array(count, pa.int32()))],
                names=["id", "row", "codes", "counts"],
            )

    return run


class Index:
    """Block-max inverted index over the examples' unit vectors."""

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, idf: np.ndarray, weight: np.ndarray):
        unit = [self.unit(c, n, idf) for c, n in vectors]
        # examples with the same strongest term stand together, so blocks differ in their bounds
        order = np.array(sorted(range(len(unit)), key=lambda i: (int(vectors[i][0][unit[i].argmax()]) if len(unit[i]) else -1, i)), np.int64)
        self.idf, self.labels, self.votes = idf, labels[order], weight[order]
        self.n = len(unit)
        code = np.concatenate([np.zeros(0, np.int64), *(vectors[i][0] for i in order)]).astype(np.int64)
        value = np.concatenate([np.zeros(0), *(unit[i] for i in order)])
        owner = np.repeat(np.arange(self.n), [len(vectors[i][0]) for i in order])
        by = np.lexsort((owner, code))
        self.owner, self.value = owner[by], value[by]
        self.first = np.searchsorted(code[by], np.arange(len(idf) + 1))
        self.blocks = -(-self.n // BLOCK)
        self.most = np.zeros((len(idf), max(1, self.blocks)), np.float64)
        np.maximum.at(self.most, (code, owner // BLOCK), value)
        self.vectors = [vectors[i] for i in order]
        # where each list enters each block: lists are sorted by term, then example
        cell = code[by] * max(1, self.blocks) + self.owner // BLOCK
        self.cut = np.searchsorted(cell, np.arange(len(idf) * max(1, self.blocks) + 1))

    @staticmethod
    def unit(codes: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
        w = (1 + np.log(np.asarray(counts, float))) * idf[codes] if len(codes) else np.zeros(0)
        norm = np.sqrt((w * w).sum())
        return w / norm if norm else w

    def nearest(self, codes: np.ndarray, counts: np.ndarray, k: int, without: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """(examples, similarities) of the k most similar with a similarity over 0, the most similar first."""
        if not len(codes) or not self.n:
            return np.zeros(0, np.int64), np.zeros(0)
        q = self.unit(codes, counts, self.idf)
        bound = q @ self.most[codes]
        ids, sims = np.zeros(0, np.int64), np.zeros(0)
        order = np.argsort(-bound, kind="stable")
        at, step = 0, 4
        while at < len(order):
            floor = sims[k - 1] if len(sims) >= k else 0.0
            take = order[at : at + step]
            take = take[bound[take] > floor]
            if not len(take):
                break
            at += step
            step *= 4
            cells = (codes[:, None] * self.blocks + take[None, :]).ravel()
            first, size = self.cut[cells], self.cut[cells + 1] - self.cut[cells]
            places = np.repeat(first - np.cumsum(size) + size, size) + np.arange(size.sum())
            some, back = np.unique(self.owner[places], return_inverse=True)
            near = np.bincount(back, weights=self.value[places] * np.repeat(np.repeat(q, len(take)), size), minlength=len(some))
            if without >= 0:
                near[some == without] = 0
            some, near = some[near > 0], near[near > 0]
            ids, sims = np.concatenate([ids, some]), np.concatenate([sims, near])
            best = np.lexsort((ids, -sims))[:k]
            ids, sims = ids[best], sims[best]
        return ids, sims

    def vote(self, codes: np.ndarray, counts: np.ndarray, k: int, prior: float, without: int = -1) -> tuple[float, np.ndarray, np.ndarray]:
        ids, sims = self.nearest(codes, counts, k, without)
        w = self.votes[ids] / (1 - np.minimum(sims, 1) + EASE)
        base = PRIOR_VOTES / (0.5 + EASE)
        return float(((w * self.labels[ids]).sum() + base * prior) / (w.sum() + base)), ids, sims


def fit_logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 1.0) -> tuple[float, float]:
    """Slope and intercept of a weighted logistic fit by Newton's method, to targets kept off 0 and 1 as Platt does."""
    good, bad = w[y == 0].sum(), w[y == 1].sum()
    y = np.where(y == 1, (bad + 1) / (bad + 2), 1 / (good + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        s = w * p * (1 - p)
        g = np.array([(w * (y - p) * x).sum() - ridge * a, (w * (y - p)).sum()])
        h = np.array([[(s * x * x).sum() + ridge, (s * x).sum()], [(s * x).sum(), s.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        a, b = a + float(step[0]), b + float(step[1])
        if abs(step).max() < 1e-8:
            break
    return a, b


def _logit(p: np.ndarray | float) -> np.ndarray:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


def _scorer(shared, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, prior, a, b, names = shared.value
        known: dict[bytes, tuple] = {}
        for batch in batches:
            codes, counts = batch.column("codes"), batch.column("counts")
            bounds = np.concatenate([[0], np.cumsum(codes.value_lengths().to_numpy())])
            code, count = codes.flatten().to_numpy(), counts.flatten().to_numpy()
            scores, ids, sims = [], [], []
            for i, j in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                c, n = code[i:j], count[i:j]
                key = c.tobytes() + b"/" + n.tobytes()
                got = known.get(key)
                if got is None:
                    v, near, sim = index.vote(c.astype(np.int64), n, k, prior)
                    got = (float(1 / (1 + np.exp(-np.clip(a * _logit(v) + b, -30, 30)))), names[near[:3]].tolist(), sim[:3].tolist())
                    if len(known) < 50_000:
                        known[key] = got
                scores.append(got[0])
                ids.append(got[1])
                sims.append(got[2])
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("row"), pa.array(scores, pa.float64()), pa.array(ids, pa.list_(pa.int64())), pa.array(sims, pa.list_(pa.float64()))],
                names=["id", "row", "score", "near_ids", "near_similarity"],
            )

    return run


def _frequencies(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size + 1, np.int64)  # the last one counts the rows
        for batch in batches:
            total += np.bincount(batch.column("codes").flatten().to_numpy(), minlength=size + 1)
            total[size] += batch.num_rows
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["code", "n"])

    return run


def score_toxicity(
    docs: DataFrame, labels: DataFrame, held_out: str | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", k: int = K, max_examples: int = MAX_EXAMPLES, calibration: int = CALIBRATION
) -> DataFrame:
    """One row per row of `docs`: id, row (hash of the text), score, near_ids and near_similarity (the three nearest examples).

    `held_out` is a condition over `id`; labels of rows that fulfil it are not learned.
    """
    spark = docs.sparkSession
    prepare(spark)
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    known = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("toxic")).where("id is not null and toxic in (0, 1)")
    if held_out:
        known = known.where(f"not ({held_out})")
    known = materialize(known.groupBy("id").agg(F.max("toxic").alias("toxic")))
    n_bad, n_all = known.agg(F.coalesce(F.sum("toxic"), F.lit(0)), F.count("*")).first()
    n_good = n_all - n_bad
    order = known.withColumn("order", F.crc32(F.concat(F.col("id").cast("string"), F.lit("/example"))))
    sample = [order.where(f"toxic = {y}").orderBy("order", "id").limit(max_examples) for y in (0, 1)]
    sample = materialize(sample[0].unionByName(sample[1]))
    taught = docs.join(F.broadcast(sample), "id").select("text", "toxic")  # bounded by max_examples
    count = taught.mapInArrow(_class_counts, "term long, bad long, n long").groupBy("term").agg(F.sum("bad").alias("bad"), F.sum("n").alias("n"))
    count = materialize(count.where(F.col("n") >= MIN_DF))
    in_bad, in_all = sample.agg(F.coalesce(F.sum("toxic"), F.lit(0)), F.count("*")).first()
    in_good = in_all - in_bad
    cells = ((F.col("bad"), in_bad, F.col("n")), (F.col("n") - F.col("bad"), in_good, F.col("n")), (in_bad - F.col("bad"), in_bad, in_all - F.col("n")), (in_good - F.col("n") + F.col("bad"), in_good, in_all - F.col("n")))
    half_g = sum((F.when((seen > 0) & (row * F.lit(in_class) > 0), seen * F.log(seen.cast("double") * in_all / (row * F.lit(in_class)))).otherwise(0.0) for seen, in_class, row in cells), F.lit(0.0))
    rates = ((F.col("bad") + 0.5) / (in_bad + 1), (F.col("n") - F.col("bad") + 0.5) / (in_good + 1))
    lift = F.greatest(rates[0] / rates[1], rates[1] / rates[0])
    chosen = count.where((F.round(half_g, 6) >= float(np.log(max(1, count.count()))) + MARGIN) & (lift >= LEAST_LIFT))
    vocabulary = np.array([r["term"] for r in chosen.select("term").collect()], np.int64).view(np.uint64)  # terms of the examples
    vocabulary.sort()

    rows = docs.withColumn("row", F.xxhash64("text"))
    vectors = materialize(rows.mapInArrow(_vectors(vocabulary), "id long, row long, codes array<int>, counts array<int>"))
    df = np.zeros(len(vocabulary) + 1)
    for r in vectors.select("codes").mapInArrow(_frequencies(len(vocabulary)), "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).collect():
        df[r["code"]] = r["n"]
    idf = np.log((df[-1] + 1) / (df[:-1] + 1)) + 1

    picked = vectors.join(F.broadcast(sample), "id").select("id", "row", "codes", "counts", "toxic", "order").orderBy("order", "id", "row").collect()  # bounded by max_examples
    y = np.array([r["toxic"] for r in picked], float)
    share = {0: n_good / max(1, (y == 0).sum()), 1: n_bad / max(1, (y == 1).sum())}
    low = min(share.values()) or 1.0
    weight = np.array([share[int(v)] / low for v in y])
    index = Index([(np.array(r["codes"], np.int64), np.array(r["counts"], np.int64)) for r in picked], y, idf, weight)
    names = np.array([r["id"] for r in sorted_like(picked, index)], np.int64)
    prior = n_bad / n_all if n_all else 0.0
    probe = np.unique(np.linspace(0, max(0, index.n - 1), min(index.n, calibration)).astype(np.int64))
    votes = np.array([index.vote(*index.vectors[i], k, prior, without=int(i))[0] for i in probe])
    a, b = fit_logistic(_logit(votes), index.labels[probe], index.votes[probe]) if len(set(index.labels[probe])) == 2 else (1.0, 0.0)
    shared = spark.sparkContext.broadcast((index, prior, a, b, names))
    return vectors.mapInArrow(_scorer(shared, k), "id long, row long, score double, near_ids array<long>, near_similarity array<double>").withColumnRenamed("id", id_col)


def sorted_like(picked: list, index: Index) -> list:
    """The picked rows in the order of the index."""
    by = {}
    for r in picked:
        by.setdefault((tuple(r["codes"]), tuple(r["counts"]), r["toxic"]), []).append(r)
    return [by[tuple(c.tolist()), tuple(n.tolist()), int(y)].pop(0) for (c, n), y in zip(index.vectors, index.labels, strict=True)]


def held_out(column: str = "id") -> str:
    return f"crc32(cast({column} as string)) % 5 = 0"


def op2_toxicity(spark, sf_dir: str) -> DataFrame:
    scored = score_toxicity(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"), held_out())
    return scored.select("doc_id", F.expr(held_out("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "near_ids", "near_similarity")
