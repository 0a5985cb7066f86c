"""Near-duplicate documents by bottom-k sketches of one hash function (operator 5).

A document's set holds its distinct 5-word shingles as 64-bit hashes. One hash function orders them; the k smallest are
the sketch. Steps:

1. documents with equal sets form a class; only its smallest id goes on,
2. inverted lists: runs of three consecutive retained values are the list keys (two for sets of up to 8). At a
   similarity of 0.75 over three quarters of the union's smallest values are shared, so a shared run is missed with a
   probability under 1e-6 (k = 64), and never where the whole set is retained,
3. each list member is paired with the list's smallest id (never all pairs), the union sketch (the k smallest values of both
   together) estimates their similarity, and pairs near enough are confirmed on full sets,
4. in lists that still hold several components, members are compared by sketch in square blocks within the tasks; a block returns
   a spanning forest of the pairs that pass (each pair counts in the list of its smallest shared key alone). Documents
   that these pairs connect form a cluster, which holds every pair that passed; a cluster's full sets are compared exactly, block
   by block, without the blocks of one component, and each block returns a spanning forest of the links,
5. components of the confirmed links.

Rows with equal ids count as one document with several texts; rows with a null id keep a null component. Empty or null
texts have an empty set and no links. Repeated rows get a row each, with the same values. A very long text is one set, made whole
in its task. An empty table gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import words as W
from .common import components_of_longs, materialize, prepare, text_slices

_U = np.uint64
SKETCH = 64
#: Share of the union sketch in both sets, below which a similarity J of 0.75 has a probability of about 1e-7: it is Binomial(64, J), mean 48.
LEAST_SHARED = 0.44
#: Members of a list that one task compares with as many others.
BLOCK = 512
#: Ids up to which a semi-join broadcasts them (8 bytes each); beyond, it shuffles.
BROADCAST_IDS = 200_000


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sorted distinct hashes, text of each, first hash of each text and the end)."""
    words = W.split(data, offsets, lower=True)
    at, hashes = W.grams(words, n)
    owner = words.doc[at]
    first = words.first()
    count = np.diff(first)
    short = np.flatnonzero((count > 0) & (count < n))
    if len(short):
        whole = np.array([_whole(words.hash[first[i] : first[i + 1]]) for i in short], np.uint64)
        owner, hashes = np.concatenate([owner, short]), np.concatenate([hashes, whole])
    order = np.lexsort((hashes, owner))
    owner, hashes = owner[order], hashes[order]
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (hashes[1:] != hashes[:-1])
    owner, hashes = owner[new], hashes[new]
    return hashes, owner, np.searchsorted(owner, np.arange(len(offsets)))


def _whole(word_hashes: np.ndarray) -> int:
    total = len(word_hashes)
    for h in word_hashes.tolist():
        total = (total * 0xD1342543DE82EF95 + h) & 0xFFFFFFFFFFFFFFFF
    return int(W.mix(np.array([total], np.uint64))[0])


def _lists(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values.view(np.int64)))


def _sketcher(n: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in text_slices(batches):
            hashes, owner, first = shingle_sets(data, offsets, n)
            size = np.diff(first)
            sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(W.mix(hashes ^ np.uint64(salt)))]) for salt in (0x5851F42D4C957F2D, 0x14057B7EF767814F)]
            a, b = (s[first[1:]] - s[first[:-1]] for s in sums)
            kept = np.arange(len(hashes)) - first[owner] < k
            bounds = np.concatenate([[0], np.cumsum(np.minimum(size, k))])
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(size), pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), _lists(hashes[kept], bounds)],
                names=["id", "n", "set_a", "set_b", "sketch"],
            )

    return run


def _full_sets(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in text_slices(batches):
            hashes, _, first = shingle_sets(data, offsets, n)
            yield pa.RecordBatch.from_arrays([batch.column("id"), _lists(hashes, first)], names=["id", "full"])

    return run


def _common(a: pa.Array, b: pa.Array) -> np.ndarray:
    """Size of the intersection of the sets in each row of two list columns."""
    out = np.zeros(len(a), np.int64)
    if not len(a):
        return out
    (xa, oa), (xb, ob) = ((x.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(x.value_lengths().to_numpy(zero_copy_only=False))])) for x in (a, b))
    rows = np.concatenate([np.repeat(np.arange(len(a)), np.diff(oa)), np.repeat(np.arange(len(b)), np.diff(ob))])
    values = np.concatenate([xa, xb])
    order = np.lexsort((values, rows))
    rows, values = rows[order], values[order]
    same = (rows[1:] == rows[:-1]) & (values[1:] == values[:-1])
    return np.bincount(rows[1:][same], minlength=len(a))


def _union_shared(a: pa.Array, b: pa.Array, k: int) -> np.ndarray:
    """How many of the k smallest values of the union of two sketches are in both, in each row."""
    out = np.zeros(len(a), np.int64)
    if not len(a):
        return out
    values = [x.flatten().to_numpy(zero_copy_only=False).view(_U) for x in (a, b)]
    rows = [np.repeat(np.arange(len(x)), x.value_lengths().to_numpy(zero_copy_only=False)) for x in (a, b)]
    row, value = np.concatenate(rows), np.concatenate(values)
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    again = np.zeros(len(row), bool)
    again[1:] = (row[1:] == row[:-1]) & (value[1:] == value[:-1])
    rank = np.cumsum(~again)
    rank -= np.concatenate([[0], rank])[np.searchsorted(row, row)]
    return np.bincount(row[again & (rank <= k)], minlength=len(a))


def _sketch_filter(k: int, percent: int):
    """Pairs whose union sketch (the k smallest values of both sets together) has enough values of both; exact for whole sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            na, nb = (batch.column(c).to_numpy() for c in ("na", "nb"))
            shared = _union_shared(batch.column("sketch_a"), batch.column("sketch_b"), 2 * k)
            among = _union_shared(batch.column("sketch_a"), batch.column("sketch_b"), k)
            whole = (na <= k) & (nb <= k)
            keep = np.where(whole, 100 * shared >= percent * (na + nb - shared), among >= LEAST_SHARED * k * (percent / 75))
            yield batch.select(["a", "b", "na", "nb"]).filter(pa.array(keep))

    return run


def _near(shared: np.ndarray, na: np.ndarray, nb: np.ndarray, k: int, percent: int) -> np.ndarray:
    """Can the sets have the similarity? Exact where both sketches hold whole sets.

    The values that two sketches share are as many as those of the union sketch at least, so this keeps what the estimate keeps.
    """
    need = -(-percent * (na + nb) // (100 + percent))  # size of the intersection
    least = need - np.maximum(0, na - k) - np.maximum(0, nb - k)
    least = np.maximum(least, np.where((na > k) & (nb > k), LEAST_SHARED * k * (percent / 75), 0))
    return shared >= np.maximum(least, 1)


def _xxhash(*columns: np.ndarray) -> np.ndarray:
    """Spark's xxhash64 of columns of longs."""
    p1, p2, p3, p4, p5 = (_U(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    h = np.full(len(columns[0]), 42, _U)
    for c in columns:
        x = c.view(_U) * p2
        h = (h + p5 + _U(8)) ^ (((x << _U(31)) | (x >> _U(33))) * p1)
        h = ((h << _U(27)) | (h >> _U(37))) * p1 + p4
        h ^= h >> _U(33)
        h *= p2
        h ^= h >> _U(29)
        h *= p3
        h ^= h >> _U(32)
    return h.view(np.int64)


def _keys(values: np.ndarray, owner: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, member) of all list keys of sketches laid end to end; `RUNS` in Spark."""
    three = np.flatnonzero(owner[:-2] == owner[2:])
    two = np.flatnonzero((owner[:-1] == owner[1:]) & (n[owner[:-1]] <= 8))
    keys = [_xxhash(values[three], values[three + 1], values[three + 2]), _xxhash(values[two], values[two + 1])]
    return np.concatenate(keys), np.concatenate([owner[three], owner[two]])


RUNS = (
    "concat(if(size(sketch) >= 3, transform(sequence(0, size(sketch) - 3), i -> xxhash64(sketch[i], sketch[i + 1], sketch[i + 2])), array()),"
    " if(n between 2 and 8, transform(sequence(0, size(sketch) - 2), i -> xxhash64(sketch[i], sketch[i + 1])), array()))"
)


def _grid(code: np.ndarray, owner: np.ndarray, members: int, width: int) -> np.ndarray:
    out = np.zeros((members, width), np.float32)
    out[owner, code] = 1
    return out


def _shared(code: np.ndarray, owner: np.ndarray, left: int, members: int, diagonal: bool, width: int = 8192) -> np.ndarray:
    """How many codes each member of the left part and each of the right part (all, on the diagonal) have in common."""
    _, code, count = np.unique(code, return_inverse=True, return_counts=True)
    often = count > 1
    place = (np.cumsum(often) - 1)[code]
    keep = often[code]
    place, owner = place[keep], owner[keep]
    out = np.zeros((left, members if diagonal else members - left), np.float32)
    order = np.argsort(place, kind="stable")
    place, owner = place[order], owner[order]
    for first in range(0, int(often.sum()), width):
        i, j = np.searchsorted(place, (first, first + width))
        grid = _grid(place[i:j] - first, owner[i:j], members, min(width, int(often.sum()) - first))
        out += grid[:left] @ (grid if diagonal else grid[left:]).T
    return out


def _forest(i: np.ndarray, j: np.ndarray, score: np.ndarray, component: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the pairs, those that connect the components that all pairs connect: each component's best pair, contracted and repeated."""
    label = np.unique(component, return_inverse=True)[1]
    out: list[np.ndarray] = []
    at = np.arange(len(i))
    while len(at):
        best = np.zeros(len(at), bool)
        for side in (i, j):
            c = label[side[at]]
            order = np.lexsort((at, -score[at], c))
            best[order[np.concatenate([[True], np.diff(c[order]) != 0])]] = True
        chosen = at[best]
        out.append(chosen)
        up = np.arange(label.max() + 1)
        for x, y in zip(label[i[chosen]].tolist(), label[j[chosen]].tolist(), strict=True):
            while up[x] != x:
                x = up[x]
            while up[y] != y:
                y = up[y]
            up[max(x, y)] = min(x, y)
        while (up[up] != up).any():
            up = up[up]
        label = up[label]
        at = at[label[i[at]] != label[j[at]]]
    chosen = np.concatenate(out) if out else at
    return i[chosen], j[chosen]


def _block_pairs(k: int, percent: int):
    def block(key: int, n: np.ndarray, ids: np.ndarray, component: np.ndarray, sketch: np.ndarray, size: np.ndarray, left: int, diagonal: bool):
        members = len(ids)
        owner = np.repeat(np.arange(members), size)
        rows, cols = (slice(0, left), slice(0, members) if diagonal else slice(left, members))
        shared = _shared(sketch, owner, left, members, diagonal)
        fits = _near(shared, n[rows, None], n[None, cols], k, percent) & (component[rows, None] != component[None, cols])
        fits &= (ids[rows, None] < ids[None, cols]) if diagonal else (ids[rows, None] != ids[None, cols])
        if not fits.any():
            return None
        keys, of = _keys(sketch, owner, n)
        smaller = keys < key
        fits &= _shared(keys[smaller], of[smaller], left, members, diagonal) == 0
        i, j = np.nonzero(fits)
        score = shared[i, j]
        i, j = _forest(i, j + cols.start, score, component)
        i, j = np.where(ids[i] > ids[j], i, j), np.where(ids[i] > ids[j], j, i)
        return np.stack([ids[i], ids[j]])

    return _by_block(block, "sketch")


def _exact_blocks(percent: int):
    def block(key: int, n: np.ndarray, ids: np.ndarray, component: np.ndarray, values: np.ndarray, size: np.ndarray, left: int, diagonal: bool):
        members = len(ids)
        rows, cols = (slice(0, left), slice(0, members) if diagonal else slice(left, members))
        shared = _shared(values, np.repeat(np.arange(members), size), left, members, diagonal).astype(np.int64)
        fits = (100 * shared >= percent * (size[rows, None] + size[None, cols] - shared)) & (component[rows, None] != component[None, cols])
        i, j = np.nonzero(fits)
        i, j = _forest(i, j + cols.start, shared[i, j], component)
        return np.stack([np.maximum(ids[i], ids[j]), np.minimum(ids[i], ids[j])])

    return _by_block(block, "full")


def _by_block(block, values_of: str):
    """Runs `block` over the parts of a group with equal key, bi and bj; it returns pairs (a, b)."""

    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        key, bi, bj, side, n, ids, component = (group[c].to_numpy() for c in ("key", "bi", "bj", "side", "n", "id", "component"))
        order = np.lexsort((ids, side, bj, bi, key))
        sketches = group[values_of].combine_chunks().take(pa.array(order))
        size = sketches.value_lengths().to_numpy()
        values = sketches.flatten().to_numpy()
        at = np.concatenate([[0], np.cumsum(size)])
        key, bi, bj, side, n, ids, component = (x[order] for x in (key, bi, bj, side, n, ids, component))
        new = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (bi[1:] != bi[:-1]) | (bj[1:] != bj[:-1])]))
        out = []
        for x, y in zip(new.tolist(), [*new[1:].tolist(), len(key)], strict=True):
            diagonal = bi[x] == bj[x]
            left = y - x if diagonal else int((side[x:y] == 0).sum())
            if left and (diagonal or left < y - x):
                found = block(key[x], n[x:y], ids[x:y], component[x:y], values[at[x] : at[y]], size[x:y], left, diagonal)
                if found is not None:
                    out.append(found)
        rows = np.concatenate(out, 1) if out else np.zeros((2, 0), np.int64)
        return pa.table({c: pa.array(r.astype(np.int64)) for c, r in zip(("a", "b"), rows, strict=True)})

    return run


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = 256
            for i in range(0, batch.num_rows, step):
                part = batch.slice(i, step)
                shared = _common(part.column("full_a"), part.column("full_b"))
                union = part.column("na").to_numpy() + part.column("nb").to_numpy() - shared
                yield part.select(["a", "b"]).filter(pa.array(100 * shared >= percent * union))

    return run


def _sets_of(ids: DataFrame, docs: DataFrame, ngram: int) -> DataFrame:
    """id and full set of the documents named."""
    ids = materialize(ids)
    few = ids.count() <= BROADCAST_IDS
    return materialize(docs.join(F.broadcast(ids) if few else ids, "id", "left_semi").mapInArrow(_full_sets(ngram), "id long, full array<long>").dropDuplicates(["id"]))


def _verified(pairs: DataFrame, docs: DataFrame, ngram: int, percent: int) -> DataFrame:
    """The pairs (a, b, na, nb) whose full sets are similar enough."""
    full = _sets_of(pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct(), docs, ngram)
    both = pairs.join(full.select(F.col("id").alias("a"), F.col("full").alias("full_a")), "a")
    both = both.join(full.select(F.col("id").alias("b"), F.col("full").alias("full_b")), "b")
    return materialize(both.select("a", "b", "na", "nb", "full_a", "full_b").mapInArrow(_confirm(percent), "a long, b long"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ngram: int = 5, percent: int = 75, k: int = SKETCH) -> DataFrame:
    """One row per row of `docs`: id, n_shingles, component_id (smallest id reachable over links), kept.

    Links join texts whose shingle sets have at least `percent` hundredths of their union in common.
    """
    spark = docs.sparkSession
    prepare(spark)
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    sketches = materialize(docs.mapInArrow(_sketcher(ngram, k), "id long, n long, set_a long, set_b long, sketch array<long>"))
    some = sketches.where("n > 0 and id is not null")
    classes = some.groupBy("set_a", "set_b", "n").agg(F.min("id").alias("class"))
    member = materialize(some.select("id", "set_a", "set_b", "n").join(classes, ["set_a", "set_b", "n"]).select("id", "class").distinct())
    firsts = materialize(some.join(classes.select(F.col("class").alias("id"), "set_a", "set_b", "n"), ["id", "set_a", "set_b", "n"]).dropDuplicates(["id", "set_a", "set_b"]))

    keys = firsts.select("id", "n", F.explode(F.expr(RUNS)).alias("key"))
    lists = keys.groupBy("key").agg(F.min(F.struct("id", "n")).alias("low"), F.count("*").alias("m")).where("m > 1")
    shared = materialize(keys.join(lists, "key").select("key", "id", "n", F.col("low.id").alias("rep"), F.col("low.n").alias("rep_n"), "m"))

    fits = f"100 * least(n, rep_n) >= {percent} * greatest(n, rep_n)"
    stars = shared.where("id <> rep").where(fits).groupBy(F.col("id").alias("a"), F.col("rep").alias("b")).agg(F.first("n").alias("na"), F.first("rep_n").alias("nb"))
    thin = firsts.select("id", "n", "sketch")
    stars = stars.join(thin.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sketch_a")), ["a", "na"])
    stars = stars.join(thin.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sketch_b")), ["b", "nb"])
    stars = materialize(stars.select("a", "b", "na", "nb", "sketch_a", "sketch_b").mapInArrow(_sketch_filter(k, percent), "a long, b long, na long, nb long"))
    links = _verified(stars, docs, ngram, percent)

    label = F.coalesce("component", "id").alias("component")
    labels = components_of_longs(links).withColumnRenamed("node", "id")
    within = shared.where("m > 2").join(labels, "id", "left").select("key", "id", "n", "m", label)
    mixed = within.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.max("m").alias("m")).where("lo <> hi")
    rows = within.join(mixed.select("key", F.ceil(F.col("m") / F.lit(BLOCK)).cast("int").alias("parts")), "key").join(thin, ["id", "n"])
    rows = rows.withColumn("own", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).withColumn("other", F.explode(F.expr("sequence(0, parts - 1)")))
    rows = rows.select("key", "id", "n", "component", "sketch", F.least("own", "other").alias("bi"), F.greatest("own", "other").alias("bj"), (F.col("own") > F.col("other")).cast("int").alias("side"))
    # lists and blocks of lists are dealt out many to a group: a group holds some thousand rows
    groups = max(64, within.count() // 2000)
    rows = rows.withColumn("part", F.pmod(F.xxhash64("key", "bi", "bj"), F.lit(groups)))
    passed = materialize(rows.groupBy("part").applyInArrow(_block_pairs(k, percent), "a long, b long").distinct())
    if not passed.isEmpty():
        cluster = components_of_longs(passed.unionByName(links)).select(F.col("node").alias("id"), F.col("component").alias("key"))
        cluster = cluster.unionByName(cluster.select(F.col("key").alias("id"), "key").distinct()).join(labels, "id", "left").select("id", "key", label)
        several = cluster.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("key")
        placed = Window.partitionBy("key").orderBy("component", "id")
        cluster = materialize(cluster.join(several, "key").withColumn("at", F.floor((F.row_number().over(placed) - 1) / BLOCK).cast("int")))
        blocks = cluster.groupBy("key", "at").agg(F.min("component").alias("lo"), F.max("component").alias("hi"))
        other = blocks.select("key", F.col("at").alias("bj"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"))
        meet = materialize(blocks.withColumnRenamed("at", "bi").join(other, "key").where("bi <= bj and not (lo = hi and lo2 = hi2 and lo = lo2)").select("key", "bi", "bj"))
        sides = meet.select("key", F.col("bi").alias("at"), "bi", "bj", F.lit(0).alias("side")).unionByName(meet.where("bi < bj").select("key", F.col("bj").alias("at"), "bi", "bj", F.lit(1).alias("side")))
        full = _sets_of(cluster.select("id").distinct(), docs, ngram)
        rows = cluster.join(full, "id").join(sides, ["key", "at"]).select("key", "id", F.size("full").cast("long").alias("n"), "component", "full", "bi", "bj", "side")
        links = links.unionByName(materialize(rows.groupBy("key", "bi", "bj").applyInArrow(_exact_blocks(percent), "a long, b long").distinct()))

    edges = links.unionByName(member.where("id <> class").select(F.col("id").alias("a"), F.col("class").alias("b")))
    final = components_of_longs(edges)
    out = sketches.select("id", "n").join(final.withColumnRenamed("node", "id"), "id", "left")
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"))


def op5_minhash_near_dup(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


#: The same links and components by plain sets, for DuckDB.
OP5_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))
    WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS body FROM w),
n AS (SELECT doc_id, count(*) AS c FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.body = b.body AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT x, y FROM p JOIN n na ON na.doc_id = x JOIN n nb ON nb.doc_id = y WHERE 100 * k >= 75 * (na.c + nb.c - k)),
b AS (SELECT x, y FROM e UNION SELECT y, x FROM e),
r AS (SELECT doc_id, doc_id AS t FROM documents UNION SELECT r.doc_id, b.y FROM r JOIN b ON b.x = r.t)
SELECT r.doc_id, coalesce(any_value(n.c), 0)::BIGINT AS n_shingles, min(r.t) AS component_id, min(r.t) = r.doc_id AS kept FROM r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id
"""
