"""The corpus operators against brute force, on small and on awkward documents."""

import hashlib
import random
import re
import zlib
from array import array

import duckdb
import numpy as np
import pytest

from lodestrata.llm import decontaminate, encode, language, line_dedup, media, near_dup, packing, substring_dedup, token_store, toxicity, url_filter
from lodestrata.llm.common import components, components_of_longs

D = "/root/testdata/sf0.001"
public = pytest.importorskip("public_tokenizers")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, extra int"
WORDS = re.compile(rb"[^\x20\x09-\x0D]+")
LOWER = bytes(i + 32 if 65 <= i < 91 else i for i in range(256))


@pytest.fixture(scope="module")
def awkward(spark):
    rng = random.Random(3)
    vocab = [f"w{k}" for k in range(300)]
    body = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    base = body(60)
    words = base.split()
    texts = [base, base, base.upper(), " ".join(words[:58] + ["x", "y"]), None, "", "   \n\t", "one", "one", "a b c", "é ü 日本 語", body(5000), base + "\n" + body(25), "\n".join([body(9)] * 3), "x" * 3000]
    rows = [(i, t, "en" if i % 2 else None, "s", 1, "clash", i) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA), texts


def shingles(t):
    w = [x.translate(LOWER) for x in WORDS.findall((t or "").encode())]
    return frozenset(tuple(w[j : j + 5]) for j in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute_components(pairs, nodes):
    up = {n: n for n in nodes}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def brute_near(texts):
    sets = {i: shingles(t) for i, t in texts.items()}
    ids = sorted(sets)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    return sets, brute_components(links, ids)


def documents(n=None):
    q = f"select doc_id, text from read_parquet('{D}/documents.parquet') order by 1"
    return dict(duckdb.sql(q).fetchall()[:n])


@pytest.mark.parametrize("which", ["awkward", "table"])
def test_near_duplicates(spark, awkward, which):
    df, texts = (awkward[0], dict(enumerate(awkward[1]))) if which == "awkward" else (spark.read.parquet(f"{D}/documents.parquet"), documents())
    sets, component = brute_near(texts)
    for r in near_dup.near_duplicates(df).collect():
        assert (r["n_shingles"], r["component_id"], r["kept"]) == (len(sets[r["doc_id"]]), component[r["doc_id"]], component[r["doc_id"]] == r["doc_id"])


def test_near_duplicates_of_a_large_group_of_edited_copies(spark):
    rng = random.Random(5)
    base = [f"b{k}" for k in range(90)]
    texts = {}
    for i in range(160):
        w = base[:]
        for _ in range(rng.randrange(5)):
            w[rng.randrange(90)] = f"e{rng.randrange(10**6)}"
        texts[i] = " ".join(w)
    _, component = brute_near(texts)
    got = near_dup.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string"))
    assert {r["doc_id"]: r["component_id"] for r in got.collect()} == component


def test_near_duplicates_where_one_text_holds_the_other(spark):
    # of 20,000 such pairs these three share the fewest retained values: 34 or 35 of 64
    texts = {}
    for i, seed in enumerate((6695, 16784, 19456)):
        words = [f"s{seed}x{k}" for k in range(1004)]
        texts |= {2 * i: " ".join(words), 2 * i + 1: " ".join(words[:754])}
    _, component = brute_near(texts)
    got = near_dup.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string"))
    assert {r["doc_id"]: r["component_id"] for r in got.collect()} == component == {i: i // 2 * 2 for i in range(6)}


def test_substrings(spark, awkward):
    assert substring_dedup.remove_repeats(awkward[0].limit(0)).count() == 0
    con = duckdb.connect()
    con.register("documents", awkward[0].select("doc_id", "text").toPandas().astype({"doc_id": "int64"}))
    want = {r[0]: r[1:] for r in con.sql(substring_dedup.OP9_SQL.replace("FROM documents", "FROM (SELECT doc_id, text FROM documents)")).fetchall()}
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring_dedup.remove_repeats(awkward[0]).collect()}
    assert got == want


def test_decontamination_finds_copies_edits_and_nothing_else(spark):
    rng = random.Random(1)
    fill = lambda n: [f"f{rng.randrange(5000)}" for _ in range(n)]
    item = [f"q{k}" for k in range(30)]
    edited = [w if k % 9 else f"z{k}" for k, w in enumerate(item)]
    docs = [(0, " ".join(fill(80) + item + fill(40))), (1, " ".join(fill(50) + edited + fill(9))), (2, " ".join(fill(200))), (3, None), (4, ""), (5, " ".join(item[:8] + fill(90)))]
    got = decontaminate.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(7, " ".join(item)), (8, "too short"), (9, None)], "item_id int, text string"))
    found = {r["doc_id"]: r for r in got.collect()}
    assert set(found) == {0, 1} and found[0]["score"] == 1 and (found[0]["first_word"], found[0]["end_word"]) == (80, 110)


@pytest.mark.parametrize("every", [4, 5, 6, 7, 8])
def test_decontamination_finds_copies_whose_rarest_words_are_edited(spark, every):
    rng = random.Random(every)
    fill = lambda n: [f"f{rng.randrange(5000)}" for _ in range(n)]
    item = [f"q{k}" for k in range(30)]
    edited = [w if k % every != every - 1 else f"z{k}" for k, w in enumerate(item)]
    inserted = [x for k, w in enumerate(item) for x in ([w, f"y{k}"] if k % 2 else [w])]
    docs = [(i, " ".join(fill(40) + edited + fill(40))) for i in range(3)] + [(3, " ".join(fill(40) + item)), (4, " ".join(inserted + fill(9))), (5, " ".join(item[:17] + fill(90) + item[17:]))]
    texts = {i: np.array([int(hashlib.md5(w.encode()).hexdigest()[:8], 16) for w in t.split()]) for i, t in docs}
    body = np.array([int(hashlib.md5(w.encode()).hexdigest()[:8], 16) for w in item])
    want = {i: plain_alignment(body, t) / 60 for i, t in texts.items()}
    got = decontaminate.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(7, " ".join(item))], "item_id int, text string"))
    assert {r["doc_id"]: r["score"] for r in got.collect()} == {i: x for i, x in want.items() if x >= 0.6} and want[0] >= 0.6 and want[4] >= 0.6


def test_decontamination_matches_brute_force(spark):
    rng = np.random.default_rng(2)
    docs = {i: rng.integers(0, 9 + 6 * (i % 3), rng.integers(0, 50)) for i in range(40)}
    items = {i: rng.integers(0, 9, rng.integers(4, 14)) for i in range(8)}
    spell = lambda rows: [(i, " ".join(f"w{x}" for x in r)) for i, r in rows.items()]
    got = decontaminate.contamination(spark.createDataFrame(spell(docs), "doc_id long, text string"), spark.createDataFrame(spell(items), "item_id int, text string"))
    want = {(d, i): plain_alignment(b, t) / (2 * len(b)) for d, t in docs.items() for i, b in items.items()}
    assert {(r["doc_id"], r["item_id"]): r["score"] for r in got.collect()} == {k: x for k, x in want.items() if x >= 0.6}


def plain_alignment(a, b):
    h = np.zeros((len(a) + 1, len(b) + 1), int)
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i, j] = max(0, h[i - 1, j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
    return h.max()


def test_alignment():
    rng = np.random.default_rng(0)
    for _ in range(60):
        a, b = rng.integers(0, 4, rng.integers(1, 12)), rng.integers(0, 4, rng.integers(1, 15))
        assert decontaminate.align(a, b)[0] == plain_alignment(a, b)


def test_nearest_is_exact():
    rng = np.random.default_rng(0)
    vectors = []
    for _ in range(700):
        c = np.unique(rng.integers(0, 90, rng.integers(0, 12)))
        vectors.append((c, rng.integers(1, 4, len(c))))
    idf = rng.random(90) + 1
    index = toxicity.Index(vectors, rng.integers(0, 2, 700).astype(float), idf, np.ones(700))
    dense = np.zeros((700, 90))
    for i, (c, n) in enumerate(index.vectors):
        dense[i, c] = index.unit(c, n, idf)
    for _ in range(50):
        c = np.unique(rng.integers(0, 90, rng.integers(1, 20)))
        n = rng.integers(1, 4, len(c))
        e = dense[:, c] @ index.unit(c, n, idf)
        assert np.allclose(index.nearest(c, n, 15)[1], np.sort(e[e > 0])[::-1][:15])


def test_toxicity_on_held_out_rows(spark):
    d = "/root/testdata/sf0.01"
    got = toxicity.op2_toxicity(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("held_out").collect()
    assert sum(r["predicted"] == r["toxic"] for r in got) >= 0.95 * len(got)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r["score"] >= 0.5 for r in toxicity.score_toxicity(spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string"), none).collect()} == {False}


def test_language(spark, awkward):
    got = language.op3_language(spark, D).join(spark.read.parquet(f"{D}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r["lang_pred"] == r["lang"] for r in got) >= 0.95 * len(got)
    docs = awkward[0]
    und = {r["doc_id"] for r in language.identify(docs, docs).where("lang_pred = 'und'").collect()}
    assert und == {4, 5, 6}
    assert {r["lang_pred"] for r in language.identify(docs, docs.limit(0)).collect()} == {"und"}


def test_language_mixture_shares():
    rng = np.random.default_rng(0)
    like = rng.dirichlet(np.ones(50), 3).T
    doc, count = np.zeros(50, int), 400 * (0.7 * like[:, 0] + 0.3 * like[:, 2])
    share = language.choose(doc, count, like, 1)[0]
    assert abs(share[0] - 0.7) < 0.05 and share[1] == 0


def test_ogg_round_trip_and_damage():
    rng = random.Random(0)
    for n in (0, 1, 254, 255, 256, 65025, 65026, 200_000):
        streams = {7: [(b"x", 0), (rng.randbytes(n), 5), (rng.randbytes(255), 9), (b"", 10)], 9: [(b"a", 0)]}
        data = media.write_ogg(streams)
        got, bad = media.read_ogg(data)
        assert not bad and {k: s.packets for k, s in got.items()} == {k: [p for p, _ in v] for k, v in streams.items()}
    hurt = bytearray(data)
    hurt[len(hurt) // 2] ^= 1
    assert media.read_ogg(bytes(hurt))[1] >= 1


def test_media_columns(spark, awkward):
    got = {r["doc_id"]: r for r in media.media_features(media.encode_media(awkward[0])).collect()}
    for i, t in enumerate(awkward[1]):
        b = (t or "").encode()
        p = b + b"\xff" * (-len(b) % 576 if b else 576)
        assert (got[i]["n_bytes"], got[i]["payload_bytes"], got[i]["payload_sha256"], got[i]["tail_crc32"]) == (len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]))


ODD = ["", " ", " a", "a ", "a  b", "a\n\nb", "a \nb", "a\n b", "it's we'll 'S\n's x'RE", "É é\nß", "日本 語", "a\tb", "<|endoftext|> x", "İ i̇ Σ", "a\r\nb", "...\n... !!", "ŉ ſ ﬁ", "1 23\n456 ×÷", "I'm 'd ''s '\n's", "\na", "a\n"]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_encoder_equals_the_library(name, monkeypatch):
    texts = ODD + [t for t in documents(60).values()]
    monkeypatch.setattr(encode, "PIECES", 500)
    e = encode.Encoder(public.path(name))
    assert e.many(texts) == [e.whole(t) for t in texts]


def test_elias_fano():
    rng = np.random.default_rng(0)
    for n, top in ((0, 0), (1, 0), (1, 9), (5, 0), (1000, 50), (1000, 10**7), (130, 99)):
        v = np.sort(rng.integers(0, top + 1, n))
        e = token_store.EliasFano.build(v, int(v[-1]) if n else 0)
        assert e.all().tolist() == v.tolist() == [e.select(i) for i in range(n)]


def test_token_output(spark, awkward):
    from tokenizers import Tokenizer

    path = public.path("word_bpe_49k.json")
    k = Tokenizer.from_file(path)
    got = {r["doc_id"]: r for r in token_store.read_tokens(token_store.write_tokens(awkward[0], path, 2, part_bytes=9000)).collect()}
    at = 0
    for i, t in enumerate(awkward[1]):
        ids = array("I", k.encode(t or "", add_special_tokens=False).ids + [2])
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def test_packing(spark, awkward):
    for seed in range(60):
        rng = np.random.default_rng(seed)
        lengths = rng.integers(1, 60, rng.integers(1, 30))
        bins = packing.pack(lengths, 60)
        assert sorted(x for b in bins for x in b) == list(range(len(lengths))) and max(lengths[b].sum() for b in bins) <= 60 and len(bins) <= len(packing.best_fit(lengths, 60))
    got = packing.pack_documents(awkward[0], public.path("byte_bpe_50k.json"), 0, size=64).toPandas()
    for _, g in got.sort_values("piece").groupby("doc_id"):
        assert (g["length"].iloc[1:] == 64).all() and (g["start"] == g["length"].cumsum() - g["length"]).all()
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert g["length"].sum() <= 64 and (g["offset"] == g["length"].cumsum() - g["length"]).all()


def test_lines(spark, awkward):
    rows = {r["doc_id"]: r for r in line_dedup.dedup_lines(awkward[0]).collect()}
    assert rows[0]["text"] == awkward[1][0] and rows[1]["text"] == "" and rows[2]["text"] == "" and rows[4]["text"] is None and rows[6]["text"] == awkward[1][6]
    assert rows[13]["lines_removed"] == 2 and rows[8]["lines_removed"] == 1 and rows[0]["extra"] == 0 and rows[0]["id"] == "clash"
    assert line_dedup.dedup_lines(awkward[0].limit(0)).count() == 0


def test_lines_match_brute_force(spark):
    texts = documents()
    places = {}
    for i, t in texts.items():
        for p, line in enumerate(t.split("\n")):
            line = line.strip(" \t\r\f").lower()
            if line:
                places.setdefault(line, set()).add((i, p))
    keys = sorted(places)
    sets = [frozenset(k.encode()[j : j + 8] for j in range(max(1, len(k.encode()) - 7))) for k in keys]
    pairs = [(a, b) for a in range(len(keys)) for b in range(a + 1, len(keys)) if 100 * min(len(sets[a]), len(sets[b])) >= 75 * max(len(sets[a]), len(sets[b])) and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    component = brute_components(pairs, range(len(keys)))
    groups = {}
    for k, c in component.items():
        groups[c] = groups.get(c, set()) | places[keys[k]]
    want = sum(len(g) - 1 for g in groups.values())
    got = line_dedup.dedup_lines(spark.read.parquet(f"{D}/documents.parquet")).selectExpr("sum(lines_removed)").first()[0]
    assert 0.99 * want <= got <= want


def test_lines_of_a_large_family_with_similar_pairs(spark):
    rng = random.Random(4)
    text = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(n))
    common = text(700)
    lines = [common + both + text(110) for both in (text(60) for _ in range(100)) for _ in range(2)]
    sets = [frozenset(x[j : j + 8] for j in range(len(x) - 7)) for x in lines]
    near = [(a, b) for a in range(200) for b in range(a) if len(sets[a] & sets[b]) >= 0.75 * len(sets[a] | sets[b])]
    assert near == [(2 * k + 1, 2 * k) for k in range(100)]
    # a pair shares a key with a probability of 0.99; most keys hold many lines of the family, which are not similar enough
    got = line_dedup.dedup_lines(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")).where("lines_removed = 1").collect()
    assert {r["doc_id"] for r in got} <= {2 * k + 1 for k in range(100)} and len(got) >= 97


def test_urls(spark):
    urls = ["http://a.net/x", "http://a.net", "HTTPS://Sub.EXAMPLE.net/en/1?q#f", "http://example.com/de/", "http://x.org/fr/a", "http://x.org/en/a", None, "no scheme", "http://ÀB.com/Ü"]
    got = url_filter.judge_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).collect()
    r = {x["page_id"]: (x["host"], x["path"], x["rule"]) for x in got}
    assert r[0] == ("a.net", "/x", "net/") and r[1] == ("a.net", "", None) and r[2] == ("sub.example.net", "/en/1", "example.net/en/")
    assert r[3][2] == "example.com/de/" and r[4][2] == "org/fr/" and r[5][2] is None and r[6] == ("", "", None) == r[7] and r[8][0] == "Àb.com"
    assert all(x["verdict"] in ("allow", "block") for x in got) and len(got) == len(urls)


def test_markov_scores_match_counts(spark):
    bodies = spark.createDataFrame([("aab", 2, 0), ("abb", 0, 1)], "body string, good long, bad long")
    got = {r["gram"]: r["score"] for r in url_filter.gram_scores(url_filter._grams(bodies, 1).select("gram", "good", "bad"), 1).collect()}
    # good: aab twice; bad: abb once; order 1 blends into order 0, that into 1 / 256
    p0 = lambda n, total, kinds: (n + kinds / 256) / (total + kinds)
    good = (2 + 2 * p0(2, 8, 3)) / (4 + 2)
    bad = (1 + 1 * p0(2, 4, 3)) / (1 + 1)
    assert np.isclose(got["ab"], np.log(good) - np.log(bad))


def test_components_agree(spark):
    rng = np.random.default_rng(0)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 120, (90, 2))]
    want = brute_components(pairs, {x for p in pairs for x in p})
    edges = spark.createDataFrame(pairs, "a long, b long")
    for f in (components, components_of_longs):
        got = {r["node"]: r["component"] for r in f(edges).collect()}
        assert {n: got.get(n, n) for n in want} == want
    assert components(edges.limit(0)).count() == 0
