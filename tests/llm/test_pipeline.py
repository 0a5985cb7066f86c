"""The pipeline's stages against brute force, each on its own input, with null and equal ids."""

import random

import pytest

from lodestrata.llm.toxicity import held_out, score_toxicity

pytest.importorskip("public_tokenizers")
pipeline = pytest.importorskip("corpus_pipeline")
D = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(t):
    w = (t or "").lower().split()
    return frozenset(tuple(w[j : j + 5]) for j in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(2)
    item = spark.read.parquet(f"{D}/benchmark.parquet").orderBy("item_id").first()["text"]
    body = lambda n: " ".join(f"w{rng.randrange(400)}" for _ in range(n))
    a, b, c = body(60), body(60), body(50)
    near = " ".join(a.split()[:55] + ["x", "y"])
    leak = f"{body(20)} {item} {body(20)}"
    rows = [(5, a), (6, near), (None, a), (None, leak), (7, b), (7, c), (8, b), (9, leak.upper()), (9, body(30)), (10, None), (11, ""), (12, c), (12, c), (13, body(40))]
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA), item


def rows_of(df):
    return sorted(((r["doc_id"] is None, r["doc_id"] or 0), r["text"] or "", r["text"] is None) for r in df.collect())


def test_near_dups(spark, docs):
    df, _ = docs
    left = pipeline.near_dups(spark, df, D)
    assert left.columns == list(pipeline.COLUMNS)
    have = df.collect()
    sets = [shingles(r["text"]) for r in have]
    up = list(range(len(have)))
    for i in range(len(have)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = up[i], up[j]
                up = [min(a, b) if u in (a, b) else u for u in up]
    groups = {}
    for u, r in zip(up, have, strict=True):
        groups.setdefault(u, []).append(r)
    # the smallest id stays, null ids come last
    want = [min(((r["doc_id"] is None, r["doc_id"] or 0), r["text"] or "", r["text"] is None) for r in g) for g in groups.values()]
    assert sorted(x[0] for x in rows_of(left)) == sorted(x[0] for x in want)
    assert sum(1 for r in left.collect() if not r["text"]) == 2


def test_decontamination(spark, docs):
    df, item = docs
    left = pipeline.decontaminate(spark, df, D)
    want = [r for r in df.collect() if item.lower() not in (r["text"] or "").lower()]
    assert rows_of(left) == sorted(((r["doc_id"] is None, r["doc_id"] or 0), r["text"] or "", r["text"] is None) for r in want)


def test_toxicity(spark):
    df = spark.read.parquet(f"{D}/documents.parquet").select(*pipeline.COLUMNS)
    twice = df.unionByName(df.where("doc_id < 5").selectExpr("cast(null as long) as doc_id", *pipeline.COLUMNS[1:]))
    scored = score_toxicity(twice.select("doc_id", "text"), spark.read.parquet(f"{D}/labels.parquet"), held_out())
    want = sorted((r["doc_id"] is not None, r["doc_id"] or 0) for r in scored.where("score < 0.5").collect())
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0) for r in pipeline.toxicity(spark, twice, D).collect()) == want


def test_lines_and_packing(spark, docs):
    df, _ = docs
    left = pipeline.lines(spark, df, D)
    # one-line texts that repeat or nearly repeat an earlier one lose their line and go; empty and null texts stay
    assert sum(1 for r in left.collect() if not r["text"]) == 2 and len({r["text"] for r in left.collect() if r["text"]}) == len({r["text"].lower() for r in df.collect() if r["text"]}) - 1
    out = pipeline.packing(spark, left, D)
    assert out.where("piece = 0").count() == left.count() and out.groupBy("sequence_id").sum("length").agg({"sum(length)": "max"}).first()[0] <= 2048


def test_lines_text_for_text(spark):
    """Each document's text after the stage, against all pairs of lines."""
    df = spark.read.parquet(f"{D}/documents.parquet").select(*pipeline.COLUMNS)
    texts = {r["doc_id"]: r["text"] for r in df.collect()}
    norm = lambda x: x.strip(" \t\r\f").lower()
    keys = sorted({norm(x) for t in texts.values() for x in t.split("\n")} - {""})
    sets = [frozenset(k.encode()[j : j + 8] for j in range(max(1, len(k.encode()) - 7))) for k in keys]
    up = list(range(len(keys)))
    for i in range(len(keys)):
        for j in range(i):
            if 3 * len(sets[i]) <= 4 * len(sets[j]) and 3 * len(sets[j]) <= 4 * len(sets[i]) and up[i] != up[j] and len(sets[i] & sets[j]) >= 0.75 * len(sets[i] | sets[j]):
                a, b = up[i], up[j]
                up = [min(a, b) if u in (a, b) else u for u in up]
    group, seen, want = dict(zip(keys, up, strict=True)), set(), {}
    for i in sorted(texts):
        kept, gone = [], 0
        for line in texts[i].split("\n"):
            g = group.get(norm(line))
            gone += g in seen and g is not None
            if g is None or g not in seen:
                kept.append(line)
            seen.add(g)
        if not gone or "\n".join(kept).strip(" \t\r\n\f"):
            want[i] = "\n".join(kept)
    got = {r["doc_id"]: r["text"] for r in pipeline.lines(spark, df, D).collect()}
    wrong = [i for i in texts if got.get(i) != want.get(i)]
    assert len(wrong) <= 2 and all(r["n_chars"] == len(r["text"]) for r in pipeline.lines(spark, df, D).collect())


def test_packing_keeps_every_token(spark, docs):
    import zlib

    import public_tokenizers
    from tokenizers import Tokenizer

    df, _ = docs
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = []
    for r in df.collect():
        ids = [*t.encode(r["text"] or "", add_special_tokens=False).ids, 0]
        want.append((r["doc_id"] is None, r["doc_id"] or 0, len(ids), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))))
    got = [(r["doc_id"] is None, r["doc_id"] or 0, r["length"], r["ids_crc32"]) for r in pipeline.packing(spark, df, D).collect()]
    assert sorted(got) == sorted(want)  # no text here is longer than a sequence


def test_whole_run(spark):
    out = pipeline.run(spark, D)
    left = {r["doc_id"] for r in out.select("doc_id").distinct().collect()}
    assert len(left) > 120 and out.groupBy("sequence_id").sum("length").agg({"sum(length)": "max"}).first()[0] <= 2048
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{D}/documents.parquet").select("doc_id", "text").collect()}
    items = [r["text"] for r in spark.read.parquet(f"{D}/benchmark.parquet").collect()]
    assert not [i for i in left if any(x in (texts[i] or "") for x in items)]
    kept = [texts[i] for i in left if len(shingles(texts[i])) > 1]
    assert len(kept) == len(set(kept)) and [n for n, _ in pipeline.STAGES] == ["toxicity", "line_dedup", "near_dup", "decontamination", "packing"]
