"""Phrases, centroids and languages: edge cases and brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from lanthorn.llm import centroids, collocations, languages

DOCS = "doc_id long, text string, lang string, phrase string, n int"

# 11


def plain_collocations(docs, longest=3, least=10, covered=50, top=2000):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    f, n = Counter(), Counter()
    for _, text, lang in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(low)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + k])) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    common = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    rows = {}
    for (lang, w), a in common.items():
        score, k, left, right = min((10**6 * a * a // (f[lang, w[:k]] * f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w)))
        inside = any(other == lang and len(v) > len(w) and any(v[i : i + len(w)] == w for i in range(len(v) - len(w) + 1)) and 100 * b >= covered * a for (other, v), b in common.items())
        if not inside:
            rows.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), left, right))
    return {(lang, i + 1, w.decode(), -a, left, right, n[lang], -s) for lang, mine in rows.items() for i, (s, a, w, left, right) in enumerate(sorted(mine)[:top])}


def found_collocations(spark, docs, p=collocations.Phrases()):
    df = spark.createDataFrame([(i, t, g, "x", 1) for i, t, g in docs], DOCS)
    return {tuple(r) for r in collocations.collocations(df, p).collect()}


def random_docs(seed, count=300):
    rng = random.Random(seed)
    words = ["Alpha", "beta", "gamma", "delta", "été", "ÉTÉ", "x", "new", "york", "city", "a b", "日本"]
    docs = []
    for i in range(count):
        out = []
        for _ in range(rng.randint(0, 40)):
            out += [rng.choice(["new york city", "New\tYork  city", "beta gamma", rng.choice(words), rng.choice(words)]), rng.choice([" ", " ", " ", "  ", "\t", ", ", ".", "\r\n", "\v", "?!"])]
        docs.append((i, "".join(out), rng.choice(["en", "en", "de", None, "und", ""])))
    return [*docs, *docs[:20], (None, None, "en"), (1, "", None), (2, " \t\n", "zz"), (3, "one", "zz")]


@pytest.mark.parametrize("seed", range(2))
def test_phrases_against_brute_force(spark, seed):
    docs = random_docs(seed)
    want = plain_collocations(docs)
    assert want and found_collocations(spark, docs) == want


def test_phrases_of_other_lengths_counts_and_ranks(spark):
    docs = random_docs(5, 150)
    p = collocations.Phrases(longest=4, least=3, covered=70, top=7)
    assert found_collocations(spark, docs, p) == plain_collocations(docs, 4, 3, 70, 7)


def test_phrases_with_a_full_sketch(spark):
    """One row of few cells lets much pass that is rare; the counts still settle it."""
    rng = random.Random(3)
    docs = [(i, " ".join(str(rng.randint(0, 3000)) for _ in range(400)) + (" so it goes" if i % 3 else ""), "en") for i in range(300)]
    p = collocations.Phrases(rows=1, most_cells=1 << 16, least=2)
    assert found_collocations(spark, docs, p) == plain_collocations(docs, least=2)


def test_no_phrases(spark):
    assert found_collocations(spark, []) == set()
    assert found_collocations(spark, [(1, None, None), (2, "one two", "en")]) == set()


def test_tally_of_clashing_hashes(monkeypatch):
    tally = collocations.Tally()
    data = np.frombuffer(b"a b a b c", np.uint8)
    one = lambda *x: np.array(x, np.uint64)
    monkeypatch.setattr(collocations, "WAITING", 1)
    # Two phrases share the first hash; a third comes in two blocks.
    tally.add(data, one(5, 5, 9), one(1, 2, 3), np.array([0, 2, 4]), np.array([1, 3, 7]))
    tally.add(data, one(9, 5), one(3, 1), np.array([4, 0]), np.array([7, 1]))
    got = [x for b in tally.rows("en") for x in b.to_pylist()]
    assert sorted((x["phrase"], x["size"], x["f"]) for x in got) == [("", 0, 0), ("a", 1, 2), ("a b", 2, 2), ("b", 1, 1)]


@pytest.mark.parametrize("context", [0, 1, 2])
def test_parts_of_a_long_text(context):
    rng = random.Random(context)
    for most in (7, 20, 64):
        text = "".join(rng.choice(["ab", "c", "longerword" * rng.randint(1, 4), " ", " ", "  ", "\n"]) for _ in range(300)).encode()
        size = context + 1

        def grams(data, head=0):
            g = collocations.Grams.of(data, 0, head)
            at = np.flatnonzero(g.fresh & (g.reach >= size))
            return Counter(b" ".join(data[s:e].split()) for s, e in zip(g.start[at - size + 1], g.end[at], strict=True))

        cut = list(collocations.parts(text, context, most))
        assert sum((grams(*x) for x in cut), Counter()) == grams(text)
        assert len(cut) > 3


# 12

P = centroids.Clustering(k=5, rounds=3, dimension=4, scale=16.0)
VECTORS = "vec_id long, embedding array<double>, cluster int, id long"


def plain_clusters(rows, p):
    kept = [(i, [math.floor(p.scale * x) for x in v]) for i, v in rows if v is not None and len(v) == p.dimension and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted((hashlib.sha256(f"{p.salt}{i}".encode()).hexdigest(), x) for i, x in kept if i is not None)[: p.k]
    c = [x for _, x in first]
    gap = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    mine = lambda: [min((gap(x, y), k) for k, y in enumerate(c)) for _, x in kept]
    for _ in range(p.rounds):
        now = mine()
        for k in range(len(c)):
            own = [x for (_, x), (_, m) in zip(kept, now, strict=True) if m == k]
            if own:
                c[k] = [sum(t) // len(own) for t in zip(*own, strict=True)]
    now = mine()
    inertia = Counter()
    for d, k in now:
        inertia[k] += d
    digest = [hashlib.sha256(",".join(map(str, x)).encode()).hexdigest() for x in c]
    return sorted(((i, k, d, inertia[k], sum(inertia.values()), digest[k]) for (i, _), (d, k) in zip(kept, now, strict=True)), key=str)


def found_clusters(spark, rows, p=P, parts=3):
    df = spark.createDataFrame([(i, v, 9, 9) for i, v in rows], VECTORS).repartition(parts)
    return sorted(map(tuple, centroids.clusters(df, p).collect()), key=str)


def test_centroids_against_brute_force(spark):
    rng = random.Random(1)
    rows = [(i, [rng.choice([-1.0, -0.5, 0.0, 0.25, 0.3]) for _ in range(4)]) for i in range(200)]
    rows += [*rows[:10], (7, [0.1, 0.2, 0.3, 0.4]), (None, [0.1, 0.2, 0.3, 0.4])]
    odd = [(900, None), (901, [1.0, 2.0]), (902, [1.0, None, 0.0, 0.0]), (903, [float("nan")] * 4), (904, [float("inf"), 0.0, 0.0, 0.0]), (905, [])]
    assert found_clusters(spark, rows + odd) == plain_clusters(rows + odd, P)


def test_few_and_no_vectors(spark):
    rows = [(1, [0.0] * 4), (2, [1.0] * 4)]
    assert found_clusters(spark, rows) == plain_clusters(rows, P)
    assert found_clusters(spark, []) == []
    assert found_clusters(spark, [(None, [0.0] * 4)]) == [(None, None, None, None, None, None)]


def test_components_that_do_not_fit(spark):
    rows = [(1, [0.0] * 4), (2, [1.0] * 4)]
    got = found_clusters(spark, [*rows, (3, [1e300, 0.0, 0.0, 0.0])])
    assert got == sorted([*plain_clusters(rows, P), (3, None, None, None, None, None)], key=str)


@pytest.mark.parametrize("size", [3, 1000, 1 << 20, 1 << 27])
def test_nearest_is_exact(size):
    """Many ties and near ties, up to the largest components."""
    rng = np.random.default_rng(size)
    c = rng.integers(-size, size + 1, (30, 64))
    c[7] = c[3]
    c[9, 0] += 1
    x = np.concatenate([rng.integers(-size, size + 1, (300, 64)), c, (c[:15] + c[15:]) // 2, c[3:4] + rng.integers(-1, 2, (50, 64))]).clip(-(1 << 27), 1 << 27)
    want = [min((sum((int(a) - int(b)) ** 2 for a, b in zip(v, y, strict=True)), k) for k, y in enumerate(c))[1] for v in x]
    assert centroids.nearest(x, c).tolist() == want
    assert centroids.largest(64) == 1 << 27


# 13

WORDS = {"en": "the of and with this that from have".split(), "de": "der die und nicht eine schön straße über".split(), "ru": "и не что это как ничего слово".split()}


def speech(rng, lang, n):
    return " ".join(rng.choice(WORDS[lang]) for _ in range(n))


def language_docs(seed=1, n=150):
    rng = random.Random(seed)
    docs = [(i, speech(rng, lang, rng.randint(1, 60)), lang) for i in range(n) for lang in [rng.choice(list(WORDS))]]
    return [*docs, (n, None, "en"), (n + 1, "12 34 !", "de"), (n + 2, "", None), (None, speech(rng, "ru", 5), "ru"), *docs[:3]]


def plain_model(docs, p):
    """Triples of letters by language, one at a time."""
    counts, documents = {}, Counter()
    for i, text, lang in docs:
        if lang is not None and i is not None and zlib.crc32(str(i).encode()) % 4 != 2:
            documents[lang] += 1
            counts.setdefault(lang, Counter()).update(plain_triples(text or "", p.buckets))
    return languages.Languages.of({k: np.array([c[b] for b in range(p.buckets)]) for k, c in counts.items()}, documents, p)


def plain_triples(text, buckets):
    x = [0, *(ord(c.lower()[0]) if c.isalpha() else 0 for c in text), 0]
    out, mask = [], (1 << 64) - 1
    for i in range(1, len(x) - 1):
        if x[i]:
            h = sum(x[i - 1 + j] * int(languages._FACTORS[j]) for j in range(3)) & mask
            h = ((h ^ (h >> 30)) * 0xBF58476D1CE4E5B9) & mask
            h = ((h ^ (h >> 27)) * 0x94D049BB133111EB) & mask
            out.append((h ^ (h >> 31)) % buckets)
    return out


def plain_mixture(model, text):
    """The same steps with dictionaries and loops."""
    p, n = model.p, Counter(plain_triples(text or "", model.buckets))
    if not any(c.isalpha() for c in text or ""):
        return []
    chance = lambda b, k: float(model.chance[b, k])
    total, names = sum(n.values()), range(len(model.names))
    one = [sum(c * math.log(chance(b, k)) for b, c in n.items()) / p.overlap + model.prior[k] for k in names]
    chosen, share = [max(names, key=lambda k: (one[k], -k))], [1.0]
    likelihood = lambda ks, ss: sum(c * math.log(sum(s * chance(b, k) for k, s in zip(ks, ss, strict=True))) for b, c in n.items())
    value, cost = likelihood(chosen, share), p.penalty * p.overlap * math.log(total + 1)
    while len(chosen) < len(model.names):
        mixed = {b: sum(s * chance(b, k) for k, s in zip(chosen, share, strict=True)) for b in n}
        slope = {k: sum(c * chance(b, k) / mixed[b] for b, c in n.items()) / total - 1 for k in names if k not in chosen}
        more = max(slope, key=lambda k: (slope[k], -k))
        if slope[more] * total <= cost:
            break
        ks, ss = [*chosen, more], [*(s * 0.9 for s in share), 0.1]
        for _ in range(p.rounds):
            new = [0.0] * len(ks)
            for b, c in n.items():
                each = [s * chance(b, k) for k, s in zip(ks, ss, strict=True)]
                new = [x + c * y / sum(each) / total for x, y in zip(new, each, strict=True)]
            done, ss = max(abs(a - b) for a, b in zip(ss, new, strict=True)) < p.close, new
            if done:
                break
        if likelihood(ks, ss) - value <= cost or ss[-1] < p.least_share:
            break
        chosen, share, value = ks, ss, likelihood(ks, ss)
    return sorted(((model.names[k], s / sum(share)) for k, s in zip(chosen, share, strict=True)), key=lambda x: -x[1])


def test_languages_against_brute_force(spark):
    docs, p = language_docs(), languages.Mixture(buckets=1 << 12)
    rng = random.Random(9)
    asked = [*docs, *((1000 + i, speech(rng, "en", 20) + " " + speech(rng, "de", 5 * i) + ". " + speech(rng, "ru", 3 * i), "en") for i in range(8)), (2000, "́", "en")]
    df = spark.createDataFrame([(i, t, g, "x", 1) for i, t, g in asked], DOCS)
    model = languages.learn(spark.createDataFrame([(i, t, g, "x", 1) for i, t, g in docs], DOCS), p)
    plain = plain_model(docs, p)
    assert model.names == plain.names and np.array_equal(model.chance, plain.chance) and np.array_equal(model.prior, plain.prior)
    got = {(r["doc_id"], r["lang_pred"], tuple((x["lang"], round(x["share"], 6)) for x in r["languages"])) for r in languages.predictions(df, model).collect()}
    want = {(i, (m := plain_mixture(plain, t) or [("und", 0)])[0][0], tuple((x, round(s, 6)) for x, s in m if x != "und")) for i, t, _ in asked}
    assert got == want
    assert any(len(x[2]) == 3 for x in got)


def test_languages_of_others(spark):
    docs = language_docs(4, 400)
    df = spark.createDataFrame([(i, t, g, "x", 1) for i, t, g in docs], DOCS)
    rows = languages.predictions(df, languages.learn(df)).collect()
    truth = {i: g for i, t, g in docs if t and re.search(r"[^\W\d_]", t)}
    held = [r for r in rows if r["held_out"] and r["doc_id"] in truth]
    assert len(held) > 50 and sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) / len(held) > 0.98
    assert len(rows) == len(docs)
    for r in rows:
        assert 0 <= r["score"] <= 1
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        assert (r["lang_pred"] == "und") == (r["doc_id"] not in truth and r["doc_id"] is not None)


def test_nothing_to_learn(spark):
    none = spark.createDataFrame([], DOCS)
    model = languages.learn(none)
    assert languages.predictions(none, model).collect() == []
    some = spark.createDataFrame([(1, "words", None, "x", 1)], DOCS)
    assert [(r["lang_pred"], r["score"]) for r in languages.predictions(some, languages.learn(some)).collect()] == [("und", 0.0)]


def test_many_languages_keep_the_model_small(spark):
    docs = spark.createDataFrame([(i, chr(0x4E00 + i) * 5, f"l{i}", "x", 1) for i in range(100)], DOCS)
    model = languages.learn(docs, languages.Mixture(most_bytes=100 * 8 * 1024))
    assert len(model.names) == len({i for i in range(100) if zlib.crc32(str(i).encode()) % 4 != 2}) and model.buckets <= 2048


def test_triples_do_not_see_the_parts_of_a_long_text(monkeypatch):
    text = "Größe naïve 日本語 😀 x y İstanbul é. " * 20
    whole = languages.counted(text, 1 << 16)
    for chunk in (1, 2, 7, 100):
        monkeypatch.setattr(languages, "CHUNK", chunk)
        parts = languages.counted(text, 1 << 16)
        assert all(np.array_equal(a, b) for a, b in zip(whole, parts, strict=True))
