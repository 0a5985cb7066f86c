"""Queries that SQL cannot express against plain versions of the same rule."""

import math
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from lodestrata.llm import language, near_dup, packing, toxicity, url_filter

S1, S2 = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
FOLD = bytes(c + 32 if 65 <= c < 91 else 32 if 33 <= c < 127 and not chr(c).isalnum() else c for c in range(256))


def rows(sql):
    return duckdb.sql(sql).fetchall()


def plain_terms(text):
    words = (text or "").encode().translate(FOLD).split()
    return Counter([("w", w) for w in words] + [(n, w[:n]) for n in (4, 5, 6) for w in words if len(w) > n])


def test_toxicity_query(spark):
    texts = dict(rows(f"select doc_id, text from read_parquet('{S2}/documents.parquet')"))
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    labels = {i: t for i, t in rows(f"select doc_id, toxic from read_parquet('{S2}/labels.parquet')") if not held(i) and i in texts}
    vectors = {i: plain_terms(t) for i, t in texts.items()}
    n, n_bad = len(labels), sum(labels.values())
    seen, bad = Counter(), Counter()
    for i, y in labels.items():
        for t in vectors[i]:
            seen[t] += 1
            bad[t] += y
    tested = [t for t in seen if seen[t] >= 4]

    def half_g(t):
        cells = ((bad[t], n_bad, seen[t]), (seen[t] - bad[t], n - n_bad, seen[t]), (n_bad - bad[t], n_bad, n - seen[t]), (n - n_bad - seen[t] + bad[t], n - n_bad, n - seen[t]))
        return sum(o * math.log(o * n / (r * c)) for o, c, r in cells if o > 0 and r * c > 0)

    def lift(t):
        a, b = (bad[t] + 0.5) / (n_bad + 1), (seen[t] - bad[t] + 0.5) / (n - n_bad + 1)
        return max(a / b, b / a)

    vocabulary = {t for t in tested if round(half_g(t), 6) >= math.log(len(tested)) + 2.3 and lift(t) >= 4}
    assert len(vocabulary) > 20
    df = Counter(t for v in vectors.values() for t in v if t in vocabulary)
    idf = {t: math.log((len(texts) + 1) / (df[t] + 1)) + 1 for t in vocabulary}

    def unit(v):
        w = {t: (1 + math.log(c)) * idf[t] for t, c in v.items() if t in vocabulary}
        norm = math.sqrt(sum(x * x for x in w.values()))
        return {t: x / norm for t, x in w.items()}

    units = {i: unit(v) for i, v in vectors.items()}
    got = {r["doc_id"]: r for r in toxicity.op2_toxicity(spark, S2).collect()}
    assert set(got) == set(texts)
    for i, r in got.items():
        sims = sorted((sum(x * units[j].get(t, 0.0) for t, x in units[i].items()) for j in labels), reverse=True)
        near = [s for s in sims if s > 1e-12][:3]
        assert r["held_out"] == held(i) and np.allclose(r["near_similarity"], near, atol=1e-9)
        assert 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) and all(j in labels for j in r["near_ids"])
        for j, s in zip(r["near_ids"], r["near_similarity"], strict=True):
            assert abs(sum(x * units[j].get(t, 0.0) for t, x in units[i].items()) - s) < 1e-9


def plain_mixture(counts, like, allowed, rounds=40, still=1e-3):
    share = {j: 1 / len(allowed) for j in allowed}
    total = sum(counts.values())
    for _ in range(rounds):
        new = dict.fromkeys(allowed, 0.0)
        for g, c in counts.items():
            whole = sum(share[j] * like[g][j] for j in allowed)
            for j in allowed:
                new[j] += c * share[j] * like[g][j] / whole
        new = {j: x / total for j, x in new.items()}
        moved = max(abs(new[j] - share[j]) for j in allowed)
        share = new
        if moved <= still:
            break
    return share, sum(c * math.log(sum(share[j] * like[g][j] for j in allowed)) for g, c in counts.items())


def test_language_of_mixed_texts():
    rng = np.random.default_rng(3)
    like = rng.dirichlet(np.full(300, 0.2), 4).T + 1e-5
    like /= like.sum(0)
    for k in range(12):
        true = rng.dirichlet(np.full(4, 0.4))
        drawn = rng.multinomial(400, like @ true)
        counts = {int(g): int(c) for g, c in enumerate(drawn) if c}
        logs = [sum(c * math.log(like[g][j]) for g, c in counts.items()) for j in range(4)]
        chosen, fit = [int(np.argmax(logs))], max(logs)
        shares = {chosen[0]: 1.0}
        while len(chosen) < 4:
            tries = {j: plain_mixture(counts, like, [*chosen, j]) for j in range(4) if j not in chosen}
            j = max(tries, key=lambda x: tries[x][1])
            if tries[j][1] <= fit + 2.0 * math.log(sum(counts.values()) + 1):
                break
            chosen.append(j)
            shares, fit = tries[j]
        got = language.choose(np.zeros(len(counts), int), np.array(list(counts.values()), float), like[list(counts)], 1)[0]
        assert {j for j in range(4) if got[j] > 0} == set(chosen) and all(abs(got[j] - shares[j]) < 0.01 for j in chosen), k


def test_url_query(spark):
    pages = rows(f"select page_id, url from read_parquet('{S1}/pages.parquet')")
    parts, lower = {}, str.maketrans(url_filter.UPPER, url_filter.LOWER)
    for i, url in pages:
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        path = rest[end:]
        parts[i] = (rest[:end].translate(lower), path[: min([path.find(c) for c in "?#" if c in path], default=len(path))])

    def ruled(host, path):
        fits = [r for r in url_filter.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        return max(fits, key=lambda r: len(r.name), default=None)

    good, bad = Counter(), Counter()
    for h, p in parts.values():
        rule = ruled(h, p)
        good[h + p] += rule is not None and rule.verdict == "allow"
        bad[h + p] += rule is not None and rule.verdict == "block"
    bodies = sorted(good)
    fold = {r[0]: r[1] for r in spark.createDataFrame([(b,) for b in bodies], "b string").selectExpr("b", f"cast(pmod(xxhash64(b), {url_filter.FOLDS}) as int)").collect()}
    order = url_filter.ORDER

    def model(count, without):
        grams = [defaultdict(Counter) for _ in range(order + 1)]
        for b in bodies:
            if count[b] and fold[b] != without:
                t = url_filter.BEFORE * order + b + url_filter.AFTER
                for at in range(order, len(t)):
                    for k in range(order + 1):
                        grams[k][t[at - k : at]][t[at]] += count[b]
        return grams

    def chance(grams, context, c, k):
        below = chance(grams, context, c, k - 1) if k else 1 / 256
        here = grams[k].get(context[len(context) - k :] if k else "")
        return (here[c] + len(here) * below) / (sum(here.values()) + len(here)) if here else below

    def score(models, b):
        t = url_filter.BEFORE * order + b + url_filter.AFTER
        return sum(math.log(chance(models[0], t[at - order : at], t[at], order)) - math.log(chance(models[1], t[at - order : at], t[at], order)) for at in range(order, len(t))) / (len(t) - order)

    whole = (model(good, None), model(bad, None))
    folds = [(model(good, f), model(bad, f)) for f in range(url_filter.FOLDS)]
    held = {b: score(folds[fold[b]], b) for b in bodies if good[b] or bad[b]}
    low, high = min(held.values()), max(held.values())
    step = (high - low) / url_filter.BINS
    cells = defaultdict(lambda: [0, 0])
    for b, s in held.items():
        k = min(int((s - low) // step), url_filter.BINS - 1)
        cells[k][0] += good[b]
        cells[k][1] += bad[b]
    threshold = url_filter.best_threshold([(k, *v) for k, v in cells.items()], low, step)
    got = {r["page_id"]: r for r in url_filter.op10_url_filter(spark, S1).collect()}
    assert len(got) == len(pages)
    for i, (h, p) in parts.items():
        rule = ruled(h, p)
        s = score(whole, h + p)
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (h, p, rule and rule.name)
        assert abs(got[i]["score"] - s) < 1e-6
        if rule or abs(s - threshold) > 1e-6:
            assert got[i]["verdict"] == (rule.verdict if rule else "allow" if s >= threshold else "block")


def test_local_search_ends_where_no_exchange_helps():
    for seed in range(25):
        rng = random.Random(seed)
        size = 40
        lengths = np.array([rng.randrange(1, 30) for _ in range(rng.randrange(4, 16))])
        bins = packing.pack(lengths, size)
        fill = [int(lengths[b].sum()) for b in bins]
        squares = sum(f * f for f in fill)
        assert sorted(i for b in bins for i in b) == list(range(len(lengths))) and max(fill) <= size
        for x in range(len(bins)):
            for y in range(len(bins)):
                if x == y or fill[x] == size or fill[y] == size:
                    continue
                one = [(0,), *((int(lengths[i]),) for i in bins[x]), *((int(lengths[i] + lengths[j]),) for i in bins[x] for j in bins[x] if i < j)]
                for (give,) in one:
                    for take in bins[y]:
                        a, b = fill[x] - give + int(lengths[take]), fill[y] + give - int(lengths[take])
                        if a <= size and b <= size:
                            assert squares - fill[x] ** 2 - fill[y] ** 2 + a * a + b * b <= squares


def test_union_sketch_counts():
    import pyarrow as pa

    rng = np.random.default_rng(0)
    sets = [(np.sort(rng.choice(400, rng.integers(1, 90), False)), np.sort(rng.choice(400, rng.integers(1, 90), False))) for _ in range(60)]
    a, b = (pa.array([s[k][:20].tolist() for s in sets], pa.list_(pa.int64())) for k in (0, 1))
    got = near_dup._union_shared(a, b, 20)
    for (x, y), n in zip(sets, got, strict=True):
        union = sorted({*x[:20].tolist(), *y[:20].tolist()})[:20]
        assert n == len(set(union) & set(x[:20].tolist()) & set(y[:20].tolist()))


pytest.importorskip("public_tokenizers")
