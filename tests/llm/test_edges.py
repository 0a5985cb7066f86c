"""Nulls, equal and repeated rows, empty tables, long texts and clashing column names, for every corpus operator."""

import hashlib
import random
import zlib

import pytest

from lodestrata.llm import decontaminate, language, line_dedup, media, near_dup, packing, substring_dedup, token_store, toxicity, url_filter

public = pytest.importorskip("public_tokenizers")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, _id int, row string, gone int, line_count string, score string"


@pytest.fixture(scope="module")
def odd(spark):
    rng = random.Random(1)
    body = lambda n: " ".join(f"w{rng.randrange(500)}" for _ in range(n))
    a, b, long = body(40), body(40), body(190_000)  # about 1 MB
    texts = [(1, a), (1, a), (1, b), (None, a), (None, "x " + body(30)), (2, None), (3, ""), (4, " \n\t"), (5, long), (6, "q" * 1_000_000), (7, b), (7, b)]
    return spark.createDataFrame([(i, t, "en", "s", 1, "i", 9, "r", 0, "c", "s") for i, t in texts], SCHEMA), texts


def texts_of(rows):
    return sorted(((r[0] is not None, r[0] or 0), *r[1:]) for r in rows)


def key(i):
    return (i is not None, i or 0)


def test_lines(odd):
    df, texts = odd
    got = line_dedup.dedup_lines(df)
    assert set(got.columns) == {*df.columns, "lines_removed"}
    rows = got.collect()
    assert len(rows) == len(texts) and all(r["_id"] == 9 and r["gone"] == 0 and r["score"] == "s" for r in rows)
    kept = sorted((key(r["doc_id"]), r["text"] is None, r["text"] or "") for r in rows)
    # null ids come first, so the null id keeps line a; equal rows are one place and keep the same
    a, b = texts[0][1], texts[2][1]
    want = [(None, a), (None, texts[4][1]), (1, ""), (1, ""), (1, b), (2, None), (3, ""), (4, texts[7][1]), (5, texts[8][1]), (6, texts[9][1]), (7, ""), (7, "")]
    assert kept == sorted((key(i), t is None, t or "") for i, t in want)


def test_near_duplicates(odd):
    df, texts = odd
    rows = near_dup.near_duplicates(df).collect()
    assert len(rows) == len(texts)
    found = {(r["doc_id"], r["component_id"]) for r in rows}
    assert found == {(1, 1), (None, None), (2, 2), (3, 3), (4, 4), (5, 5), (6, 6), (7, 1)}


def test_repeats(odd):
    df, texts = odd
    rows = substring_dedup.remove_repeats(df, keep_text=False).collect()
    assert len(rows) == len(texts)
    removed = sorted((key(r["doc_id"]), r["n_words"], r["n_removed"]) for r in rows)
    n = lambda t: len((t or "").split())
    assert [x for x in removed if x[0] in ((True, 1), (True, 7), (True, 2), (True, 6))] == [((True, 1), 40, 0)] * 3 + [((True, 2), 0, 0), ((True, 6), 1, 0)] + [((True, 7), 40, 40)] * 2
    assert ((False, 0), 40, 40) in removed and sum(x[1] for x in removed) == sum(n(t) for _, t in texts)


def test_tokens_and_packing(odd):
    from tokenizers import Tokenizer

    df, texts = odd
    path = public.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    ids = lambda x: [*t.encode(x or "", add_special_tokens=False).ids, 2]
    crc = lambda x: zlib.crc32(b"".join(i.to_bytes(4, "little") for i in x))
    rows = token_store.read_tokens(token_store.write_tokens(df, path, 2, part_bytes=200_000)).collect()
    at = 0
    for (i, x), r in zip(sorted(texts, key=lambda p: (key(p[0]), p[1] is not None, p[1] or "")), sorted(rows, key=lambda r: r["start"]), strict=True):
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (i, at, len(ids(x)), crc(ids(x)))
        at += r["n_tokens"]
    path = public.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    ids = lambda x: [*t.encode(x or "", add_special_tokens=False).ids, 0]
    want = []
    for i, x in texts:
        tokens, first = ids(x), 0
        while first < len(tokens):
            end = first + 2048 if first or len(tokens) % 2048 == 0 else len(tokens) % 2048
            want.append((key(i), first, end - first, crc(tokens[first:end])))
            first = end
    rows = packing.pack_documents(df, path, 0).collect()
    assert sorted((key(r["doc_id"]), r["start"], r["length"], r["ids_crc32"]) for r in rows) == sorted(want)
    fill = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert fill.get(r["sequence_id"], 0) == r["offset"]
        fill[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(fill.values()) <= 2048 and len(fill) <= -(-sum(fill.values()) // 2048) + 1


def test_media_language_toxicity(odd, spark):
    df, texts = odd
    rows = media.media_features(media.encode_media(df)).collect()
    assert sorted((key(r["doc_id"]), r["n_bytes"]) for r in rows) == sorted((key(i), len((t or "").encode())) for i, t in texts)
    rows = language.identify(df, df).collect()
    assert sorted((key(r["doc_id"]), r["lang_pred"]) for r in rows) == sorted((key(i), "en" if (t or "").strip() else "und") for i, t in texts)
    labels = spark.createDataFrame([(1, 1), (7, 0), (None, 1), (3, 5), (4, None)], "doc_id long, toxic int")
    rows = toxicity.score_toxicity(df, labels).collect()
    assert len(rows) == len(texts) and all(0 <= r["score"] <= 1 for r in rows)
    assert len({r["score"] for r in rows if r["doc_id"] == 7}) == 1


def test_contamination_keeps_ids(odd, spark):
    df, texts = odd
    items = spark.createDataFrame([(1, texts[0][1]), (2, texts[0][1]), (3, None), (4, ""), (None, texts[2][1])], "item_id int, text string")
    found = sorted(map(str, ((r["doc_id"], r["item_id"], r["score"]) for r in decontaminate.contamination(df, items).collect())))
    want = [(i, j, 1.0) for i, t in texts for j, u in ((1, texts[0][1]), (2, texts[0][1]), (None, texts[2][1])) if t and t.startswith(u)]
    assert found == sorted(map(str, want))


def test_urls(spark):
    urls = [(1, "http://a.net/x"), (1, "http://a.net/x"), (None, None), (2, "http://b.org/" + "y" * 100_000), (3, "http://\u0002\u0003/\u0003")]
    rows = url_filter.judge_urls(spark.createDataFrame(urls, "page_id long, url string").selectExpr("*", "1 as model", "2 as body", "3 as score", "4 as host")).collect()
    assert len(rows) == 5 and all(r["verdict"] in ("allow", "block") for r in rows)
    assert {r["verdict"] for r in url_filter.judge_urls(spark.createDataFrame([(1, "http://c.org/z")], "page_id long, url string"), rules=()).collect()} == {"allow"}


def test_empty_tables(odd, spark):
    none = odd[0].limit(0)
    items = spark.createDataFrame([], "item_id int, text string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    path = public.path("byte_bpe_50k.json")
    for df in (
        line_dedup.dedup_lines(none), near_dup.near_duplicates(none), substring_dedup.remove_repeats(none), media.media_features(media.encode_media(none)), language.identify(none, none),
        toxicity.score_toxicity(none, labels), decontaminate.contamination(none, items), decontaminate.contamination(odd[0], items), packing.pack_documents(none, path, 0),
        token_store.read_tokens(token_store.write_tokens(none, path, 2)), url_filter.judge_urls(spark.createDataFrame([], "page_id long, url string")),
    ):
        assert df.count() == 0


def morse(n, a="a", b="b"):
    s = [0]
    while len(s) < n:
        s += [1 - x for x in s]
    return "".join((a, b)[x] for x in s)


def test_words_that_sums_of_powers_take_for_equal(spark):
    x, y = morse(1024), morse(1024, "b", "a")
    tail = " ".join(f"t{k}" for k in range(30))
    df = spark.createDataFrame([(1, f"{x} one two three four"), (2, f"{y} one two three four"), (3, f"{x} {tail}"), (4, f"{y} {tail}")], "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in near_dup.near_duplicates(df.where("doc_id < 3")).collect()} == {1: 1, 2: 2}
    got = {r["doc_id"]: r["n_removed"] for r in substring_dedup.remove_repeats(df.where("doc_id > 2")).collect()}
    assert got == {3: 0, 4: 30}


def test_windows_with_equal_hashes_are_compared(monkeypatch):
    import numpy as np

    body = b"a b a c a b "
    at = np.array([0, 1, 2, 3, 4])
    ends = np.array([3, 5, 7, 9, 11])
    same = substring_dedup.Windows(np.zeros(5, np.uint64), np.ones(5, np.int64), at, at, body, 2 * at, ends)
    assert same.repeated().tolist() == [False, False, False, False, True]


def test_hubs_of_edited_lines(spark):
    rng = random.Random(6)
    letters = "abcdefghijklmnopqrstuvwxyz"
    base = [rng.choice(letters) for _ in range(240)]
    lines = ["".join(base)]
    for _ in range(300):
        x = base[:]
        for k in rng.sample(range(240), 3):
            x[k] = rng.choice(letters)
        lines.append("".join(x))
    got = line_dedup.dedup_lines(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")).where("lines_removed = 0").collect()
    sets = [frozenset(x[j : j + 8] for j in range(len(x) - 7)) for x in lines]
    up = list(range(len(lines)))
    for i in range(len(lines)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.75 * len(sets[i] | sets[j]):
                a, b = up[i], up[j]
                up = [min(a, b) if u in (a, b) else u for u in up]
    assert {r["doc_id"] for r in got} == set(up)


def test_line_dedup_by_brute_force_text_for_text(spark):
    rng = random.Random(8)
    vocab = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9))) for _ in range(400)]
    say = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    pool = [say(rng.randrange(3, 40)) for _ in range(150)]
    for k in range(150):
        w = pool[k].split(" ")
        for _ in range(rng.randrange(1, 3)):
            w[rng.randrange(len(w))] = rng.choice(vocab)
        pool.append(" ".join(w))
    docs = {i: "\n".join(rng.choice((x, x.upper(), f"  {x}\r", "")) for x in rng.sample(pool, rng.randrange(0, 9))) for i in range(160)}
    norm = lambda x: x.strip(" \t\r\f").lower()
    keys = sorted({norm(x) for t in docs.values() for x in t.split("\n")} - {""})
    sets = [frozenset(k.encode()[j : j + 8] for j in range(max(1, len(k) - 7))) for k in keys]
    up = list(range(len(keys)))
    for i in range(len(keys)):
        for j in range(i):
            if up[i] != up[j] and len(sets[i] & sets[j]) >= 0.75 * len(sets[i] | sets[j]):
                a, b = up[i], up[j]
                up = [min(a, b) if u in (a, b) else u for u in up]
    component, seen, want = dict(zip(keys, up, strict=True)), set(), {}
    for i, t in docs.items():
        kept = []
        for x in t.split("\n"):
            c = component.get(norm(x))
            if c is None or c not in seen:
                kept.append(x)
            seen.add(c)
        want[i] = "\n".join(kept)
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(spark.createDataFrame(list(docs.items()), "doc_id long, text string")).collect()}
    wrong = [i for i in docs if hashlib.sha256(got[i].encode()).digest() != hashlib.sha256(want[i].encode()).digest()]
    assert len(wrong) <= 0.01 * len(docs)
