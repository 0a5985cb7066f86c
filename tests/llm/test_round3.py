"""Operators 11 to 13 against plain versions of their rules, and their odd cases."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction
from hashlib import sha256

import duckdb
import pytest

from lodestrata.llm import divergence, importance, license_scan

S1, S2 = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans({c: c + 32 for c in range(65, 91)})
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, term string, n int, rank int, score string, _at string, buckets int"


def plain_words(text):
    return WORD.findall((text or "").translate(LOWER))


def plain_ends(form, start, part, most):
    """{end: edits} of matches of `part` from `start` on, `most` edits at most, by the edit distance's table."""
    row = list(range(len(part) + 1))
    out = {start: row[-1]} if row[-1] <= most else {}
    for i in range(start, min(len(form), start + len(part) + most)):
        new = [row[0] + 1]
        for j, c in enumerate(part, 1):
            new.append(min(row[j - 1] + (form[i] != c), row[j] + 1, new[-1] + 1))
        row = new
        if row[-1] <= most:
            out[i + 1] = row[-1]
    return out


def plain_edits(words, n):
    """Fewest edits of a match of notice `n` that starts and ends at words; None without one."""
    form = " " + " ".join(words) + " "
    best = None
    for start in (i + 1 for i, c in enumerate(form[:-1]) if c == " "):
        states = {start: 0}
        for k, (part, most) in enumerate(n.parts):
            after = {}
            for at, edits in states.items():
                if k:
                    if form[at : at + 1] != " ":
                        continue
                    at += 1
                ends = plain_ends(form, at, part, most) if most else ({at + len(part): 0} if form.startswith(part, at) else {})
                for end, more in ends.items():
                    after[end] = min(after.get(end, 99), edits + more)
            states = after
        for end, edits in states.items():
            if form[end : end + 1] == " " and end > start and (best is None or edits < best):
                best = edits
    return best


def mangled(rng, text, edits):
    for _ in range(edits):
        i = rng.randrange(len(text))
        text = rng.choice((text[:i] + text[i + 1 :], text[:i] + rng.choice("abcdelnu ") + text[i:], text[:i] + rng.choice("abcdelnu") + text[i + 1 :]))
    return text


def test_notices_against_edit_distance(spark):
    rng = random.Random(7)
    notices = [license_scan.notice(*n) for n in license_scan.NOTICES]
    texts = []
    for n in notices:
        for edits in range(n.edits + 3):
            for _ in range(3):
                texts.append(f"Zürich lorem {mangled(rng, n.text, edits)}. Ipsum, {mangled(rng, rng.choice(notices).text.upper(), rng.randrange(3))} dolor")
    rows = license_scan.scan_notices(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    found = 0
    for r in rows:
        text = texts[r["doc_id"]]
        words = plain_words(text)
        least = {(n.label, n.text): plain_edits(words, n) for n in notices}
        want = {label for (label, _), e in least.items() if e is not None} | set(filter(None, r["base_labels"].split(",")))
        assert set(filter(None, r["labels"].split(","))) == want, text
        score = max([0.0, *(1 - e / len(t) for (_, t), e in least.items() if e is not None)])
        assert r["score"] == pytest.approx(1.0 if r["n_base"] else score), text
        for s in r["spans"]:
            assert plain_words(text[s["start"] : s["end"]]) == words[s["first_word"] : s["first_word"] + s["n_words"]]
            found += s["edits"] > 0
    assert found > 50


def test_notice_query(spark):
    texts = dict(duckdb.sql(f"select doc_id, text from read_parquet('{S2}/documents.parquet')").fetchall())
    notices = [license_scan.notice(*n) for n in license_scan.NOTICES]
    rows = license_scan.op11_license_scan(spark, S2).collect()
    assert len(rows) == len(texts)
    some = 0
    for r in rows:
        words = plain_words(texts[r["doc_id"]])
        places = [(i, label) for p, label in license_scan.PHRASES for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
        starts = [i for i, _ in places]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (len(words), len(places), min(starts, default=None), max(starts, default=None))
        assert r["base_labels"] == ",".join(sorted({x for _, x in places}))
        some += r["n_base"]
        if "licen" in texts[r["doc_id"]].lower():
            near = [w for k in (i for i, w in enumerate(words) if w.startswith("licen")) for w in ["", *words[max(0, k - 8) : k + 8]]]
            assert {n.label for n in notices if plain_edits(near, n) is not None} | {x for _, x in places} == set(filter(None, r["labels"].split(",")))
    assert some > 5


@pytest.fixture(scope="module")
def odd(spark):
    rng = random.Random(3)
    body = " ".join(f"w{'abcdefghij'[rng.randrange(10)]}{rng.randrange(50)}" for _ in range(30))
    long = " ".join(rng.choice(("Under the MIT licence", "alpha", "beta9", "éa")) for _ in range(120_000))
    texts = [(1, body, "en", "a"), (1, body, "en", "a"), (None, body, "en", None), (2, None, "en", "b"), (3, "", None, "b"), (4, "\x00 ,.;", "de", ""), (5, long, "en", "b"), (6, "q" * 1_000_000, "en", "c")]
    texts += [(10 + i, body + f" x{i}", "en", "ab"[i % 2]) for i in range(12)]
    return spark.createDataFrame([(i, t, x, s, 1, "i", "t", 2, 3, "s", "a", 4) for i, t, x, s in texts], SCHEMA), texts


def test_odd_notices(odd):
    df, texts = odd
    rows = license_scan.scan_notices(df).collect()
    assert len(rows) == len(texts)
    by = {r["doc_id"]: r for r in rows}
    assert by[2]["n_words"] == by[3]["n_words"] == by[4]["n_words"] == 0 and by[2]["labels"] == "" and by[2]["score"] == 0.0
    hits = texts[6][1].count("MIT")
    assert by[5]["n_base"] == 0 and by[5]["labels"] == "mit" and len(by[5]["spans"]) == hits and {s["edits"] for s in by[5]["spans"]} == {1}
    assert sum(r["doc_id"] == 1 for r in rows) == 2 and None in by
    assert license_scan.scan_notices(df.limit(0)).count() == 0
    assert license_scan.scan_notices(df, (), ()).where("labels <> '' or score > 0").count() == 0


def test_overlapping_phrases():
    s = license_scan.Scanner((("a b a", "x"), ("b", "y")), ())
    got = license_scan.scan(s, b"A b, a B a! ab a")
    assert (got["n_base"], got["first_word"], got["last_word"], got["base_labels"]) == (4, 0, 3, "x,y")


@pytest.mark.parametrize("longest", [1, 3])
def test_features(longest):
    rng = random.Random(longest)
    text = "".join(rng.choice("aB9 é\n.-") for _ in range(3000))
    words = plain_words(text)
    want = [zlib.crc32(" ".join(words[i : i + n]).encode()) % 977 for n in range(1, longest + 1) for i in range(len(words) - n + 1)]
    assert importance.features(text.encode(), [importance.runs(n) for n in range(1, longest + 1)], 977) == (len(words), want)


def plain_resample(docs, target, longest, buckets, seed, percent, least):
    def found(text):
        w = plain_words(text)
        return [zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in range(1, longest + 1) for i in range(len(w) - n + 1)]

    s, t = Counter(b for _, x in docs for b in found(x)), Counter(b for x in target for b in found(x))
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets))))
    out = []
    for i, x in docs:
        f = found(x)
        weight = sum(map(gain, f)) // len(f) if f else 0
        h = int(sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, len(plain_words(x)), len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    fit = sorted((-r[4], r[0] is None, r[0] or 0) for r in out if r[1] >= least)
    return out, fit[: percent * len(fit) // 100]


@pytest.mark.parametrize(("longest", "percent"), [(1, 100), (2, 50), (1, 0)])
def test_resampling(spark, odd, longest, percent):
    df, texts = odd
    target = spark.createDataFrame([("alpha beta9 wa1",), (None,), ("wb2 wb2 wc3 x1",)], "text string")
    got = importance.resample(df, target, longest, 101, 7, percent, 5)
    assert got.columns == ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    rows = got.collect()
    want, drawn = plain_resample([(i, x) for i, x, _, _ in texts], ["alpha beta9 wa1", None, "wb2 wb2 wc3 x1"], longest, 101, 7, percent, 5)
    key = lambda r: tuple((x is not None, x or 0) for x in r)
    assert sorted(map(key, (r[:5] for r in rows))) == sorted(map(key, want))
    ranked = sorted((r for r in rows if r["rank"] is not None), key=lambda r: r["rank"])
    assert [r["rank"] for r in ranked] == list(range(1, len(drawn) + 1))
    assert [(-r["score"], r["doc_id"] is None, r["doc_id"] or 0) for r in ranked] == drawn


def test_resampling_of_nothing(spark, odd):
    df, _ = odd
    none = spark.createDataFrame([], "text string")
    assert importance.resample(df.limit(0), none).count() == 0
    assert importance.resample(df, none).where("rank is not null").count() == 1  # 17 rows have 20 words


def plain_divergence(docs, least, ranks):
    docs = [(t or "", x or "", s or "") for t, x, s in docs]
    terms = [TERM.findall(t.translate(LOWER)) for t, _, _ in docs]
    df, n = defaultdict(Counter), defaultdict(Counter)
    groups = {(x, s) for _, x, s in docs}
    for w, (_, x, s) in zip(terms, docs, strict=True):
        df[x].update(set(w))
        n[x, s].update(w)
        n[x].update(w)
    kept = {x: [w for w, k in df[x].items() if k >= least] for x, _ in groups}

    def p(x, key):
        total = sum(n[key][w] for w in kept[x])
        return {w: 1 + (10**9 * (n[key][w] + 2)) // (total + 2 * len(kept[x])) for w in kept[x]}

    f = lambda a, b: math.floor(Fraction((a - b) ** 2, a + b))
    out = []
    for x, s in groups:
        own = p(x, (x, s))
        pairs = [(sum(f(own[w], q) for w, q in p(x, (x, o)).items()), o) for y, o in groups if y == x and o != s]
        whole = p(x, x)
        tell = [(f(own[w], whole[w]), w) for w in kept[x] if n[x, s][w] and own[w] > whole[w]]
        for part, rows, most in (("pair", pairs, None), ("term", tell, ranks)):
            out += [(x, s, part, item, v, k) for k, (v, item) in enumerate(sorted(rows, key=lambda r: (-r[0], r[1].encode()))[:most], 1)]
    return sorted(out)


@pytest.mark.parametrize("least", [1, 2, 10, 99])
def test_divergence(odd, least):
    df, texts = odd
    got = sorted(map(tuple, divergence.source_divergence(df, least, 4).collect()))
    assert got == plain_divergence([r[1:] for r in texts], least, 4)


def test_divergence_of_nothing(odd):
    assert divergence.source_divergence(odd[0].limit(0)).count() == 0


def test_divergence_hands_on(odd, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(divergence, "HELD", 3)
    rows = [r[1:] for r in odd[1][:8]]
    batch = pa.RecordBatch.from_arrays([pa.array([r[k] or "" for r in rows], pa.string()) for k in range(3)], names=["text", "lang", "source"])
    total = Counter()
    for out in divergence._count(iter([batch])):
        for r in out.to_pylist():
            if r["term"] is not None:
                total[r["lang"], r["source"], r["term"]] += r["n"]
    want = Counter((x or "", s or "", w) for t, x, s in rows for w in TERM.findall((t or "").translate(LOWER)))
    assert total == want


@pytest.mark.parametrize(("query", "sql"), [(importance.op12_importance, importance.OP12_SQL), (divergence.op13_source_divergence, divergence.OP13_SQL)])
def test_sql(spark, query, sql):
    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.sql(f"create view {t} as select * from read_parquet('{S1}/{t}.parquet')")
    got = query(spark, S1)
    want = c.sql(f"select {', '.join(got.columns)} from ({sql})").fetchall()
    key = lambda r: tuple((x is not None, x or 0) if not isinstance(x, str) else (True, x) for x in r)
    assert sorted(map(key, map(tuple, got.collect()))) == sorted(map(key, want))


@pytest.mark.parametrize(("short", "long"), [(10, 11), (12, 13), (15, 17), (16, 19), (20, 24), (27, 33), (60, 75), (71, 92), (200, 260)])
def test_lines_with_letters_added(spark, short, long):
    """Pairs of all lengths at similarities of 0.75 to 0.83, on both sides of the border between the kinds of minima."""
    from lodestrata.llm import line_dedup

    rng = random.Random(short)
    text = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(n))
    firsts = [text(short) for _ in range(1000)]
    lines = [x for first in firsts for x in (first, first + text(long - short))]
    got = line_dedup.dedup_lines(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")).where("lines_removed = 1").collect()
    assert {r["doc_id"] for r in got} <= set(range(1, 2000, 2)) and len(got) >= 980


def test_short_lines_by_brute_force(spark):
    from lodestrata.llm import line_dedup

    rng = random.Random(12)
    words = ["ab", "abc", "abcdefgh", "abcdefg\x00", "abcdefg", "xyxyxyxyxyxyxyxy", "xyxyxyxyxy", "é" * 5, "é" * 6]
    words += ["".join(rng.choice("ab") for _ in range(rng.randrange(1, 20))) for _ in range(300)]
    keys = sorted(set(words))
    sets = [frozenset(k.encode()[j : j + 8] for j in range(max(1, len(k.encode()) - 7))) for k in keys]
    up = list(range(len(keys)))
    for i in range(len(keys)):
        for j in range(i):
            if up[i] != up[j] and len(sets[i] & sets[j]) >= 0.75 * len(sets[i] | sets[j]):
                a, b = up[i], up[j]
                up = [min(a, b) if u in (a, b) else u for u in up]
    got = line_dedup.dedup_lines(spark.createDataFrame(list(enumerate(keys)), "doc_id long, text string")).where("lines_removed = 0").count()
    assert len(set(up)) <= got <= len(set(up)) + 3


def test_blocks_of_a_family(spark, monkeypatch):
    """Lines around the limit in blocks of a few lines each: all links but those that no shared key shows."""
    from lodestrata.llm import line_dedup

    monkeypatch.setattr(line_dedup, "BLOCK", 7)
    rng = random.Random(13)
    text = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    common = text(300)
    lines = [common + text(30) + tail for tail in (text(50) for _ in range(20)) for _ in range(4)]
    sets = [frozenset(x[j : j + 8] for j in range(len(x) - 7)) for x in lines]
    near = {(b, a) for a in range(80) for b in range(a) if len(sets[a] & sets[b]) >= 0.75 * len(sets[a] | sets[b])}
    assert {(4 * k + i, 4 * k + j) for k in range(20) for i in range(4) for j in range(i + 1, 4)} <= near
    up = list(range(80))
    for a, b in near:
        x, y = up[a], up[b]
        up = [min(x, y) if u in (x, y) else u for u in up]
    got = line_dedup.dedup_lines(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")).where("lines_removed = 0").count()
    assert len(set(up)) <= got <= len(set(up)) + 1


@pytest.mark.parametrize("least", [0.6, 0.75, 0.2])
def test_seeds_are_hit_whatever_is_edited(least):
    """Every choice of the words that must match leaves a seed enough of its words."""
    import itertools

    import numpy as np

    from lodestrata.llm import decontaminate

    rng = random.Random(int(10 * least))
    items = [" ".join(rng.choice("abcdefghij") + str(rng.randrange(1 + k % 4)) for _ in range(n)) for k, n in enumerate([4, 5, 6, 7, 8, 9, 10, 11, 3, 30, 57])]
    block = decontaminate.Items(items, 4)
    count = np.array([rng.randrange(100) for _ in block.gram])
    seeds = block.seeds(count, least)
    assert (np.diff(seeds.code) >= 0).all()
    for i, text in enumerate(items):
        words = block.words[i]
        codes = np.searchsorted(block.gram, words)
        m = int(block.need(least)[i])
        if len(words) < 4:
            assert not (seeds.item[seeds.seed] == i).any()
            continue
        own = [{c: t for c, s, t in zip(seeds.code.tolist(), seeds.seed.tolist(), seeds.times.tolist(), strict=True) if s == g} for g in range(len(seeds.item)) if seeds.item[g] == i]
        need = [int(seeds.need[g]) for g in range(len(seeds.item)) if seeds.item[g] == i]
        choices = itertools.combinations(range(len(words)), m) if len(words) < 12 else (rng.sample(range(len(words)), m) for _ in range(300))
        for chosen in choices:
            there = {int(codes[k]) for k in chosen}
            assert any(sum(t for c, t in seed.items() if c in there) >= n for seed, n in zip(own, need, strict=True) if seed), (text, chosen)
