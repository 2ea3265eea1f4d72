"""The ten operators: edge cases, brute force, round trips, held-out accuracy."""

import hashlib
import math
import os
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lanthorn.llm import ann, bpe, chat, components, ctw, decontam, dedup, license_scan, quality, token_counts, toxicity
from lanthorn.llm._words import words
from lanthorn.llm.queries import vocabulary_path

EDGE = [
    (1, "the cat sat on the mat and then it went away again", "x"),
    (2, "the cat sat on the mat and then it went away again", "y"),
    (3, None, None),
    (4, "", "z"),
    (5, " \t\n", "z"),
    (6, "one", "z"),
    (7, "word " * 20_000, "long"),
    (7, "word " * 20_000, "long"),
    (None, "the cat sat on the mat and then it went away again", "n"),
    (8, "Größe naïve 日本語 😀 <|endoftext|> x y", "u"),
]
# Columns whose names clash with those that the operators use inside.
SCHEMA = "doc_id long, text string, id string"


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame(EDGE, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def rows(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


# 1


def test_license_edges(spark, edge, empty):
    named = spark.createDataFrame([("cat", "The cat sat on the mat, and then it went away again!"), ("short", "too short"), ("none", None)], "template_id string, template string")
    got = {(r["doc_id"], r["template_id"]): r["containment"] for r in license_scan.license_matches(edge, named).collect()}
    assert got == {(1, "cat"): 1.0, (2, "cat"): 1.0, (None, "cat"): 1.0}
    assert license_scan.license_matches(empty, named).collect() == []
    assert license_scan.license_matches(edge, named.where("false")).collect() == []


def test_license_against_brute_force(spark):
    rng, vocabulary = random.Random(1), [f"w{i}" for i in range(40)]
    notice = license_scan.NOTICES["GPL-3.0"]
    docs = []
    for i in range(60):
        body = [rng.choice(vocabulary) for _ in range(rng.randint(0, 60))]
        part = notice.split()
        if i % 3:
            part[rng.randrange(len(part))] = "changed" if i % 3 == 2 else part[0]
        at = rng.randint(0, len(body))
        docs.append((i, " ".join(body[:at] + (part if i % 4 else []) + body[at:])))

    def shingles(text):
        w = "".join(c for c in text.lower() if c not in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~").split()
        return {tuple(w[k : k + 5]) for k in range(len(w) - 4)}

    want = {(i, t): len(shingles(n) & shingles(x)) / len(shingles(n)) for i, x in docs for t, n in license_scan.NOTICES.items() if len(shingles(n) & shingles(x)) >= 0.8 * len(shingles(n))}
    got = {(r["doc_id"], r["template_id"]): r["containment"] for r in license_scan.license_matches(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == want and want


def test_license_tables_beyond_the_literals(spark, edge):
    """Many templates are joined instead of written into the plan, with the same rows out."""
    named = spark.createDataFrame([*license_scan.NOTICES.items(), ("short", "All rights reserved."), ("one", "reserved"), ("none", None), (None, "a b c d e f")], "template_id string, template string")
    texts = [(i, f"x {n} y z {n.upper()}") for i, n in enumerate(license_scan.NOTICES.values())] + [(90, "all RIGHTS reserved"), (91, "reserved"), (92, "rights, reserved all"), (93, None), (94, ""), (None, "reserved all rights reserved")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    few, many = (sorted(map(tuple, license_scan.license_matches(docs, named, p=license_scan.Scan(most_windows=n)).collect()), key=str) for n in (4096, 0))
    assert few == many and len(few) > len(license_scan.NOTICES)
    assert sorted(r[1] for r in few if r[0] in (90, 91, 92)) == ["one", "one", "one", "short"]


def test_license_short_templates_and_bodies(spark):
    docs = [(1, "Intro. All rights\nreserved."), (2, "ALL RIGHTS RESERVED"), (3, "all rights were reserved"), (4, "overall rights reserved"), (5, None), (None, "a b, all rights reserved!")]
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    named = spark.createDataFrame([("short", "All rights reserved."), ("one", "Intro")], "template_id string, template string")
    got = {(r["doc_id"], r["template_id"], r["template_shingles"], r["matched_shingles"], r["containment"]) for r in license_scan.license_matches(docs, named).collect()}
    assert got == {(1, "short", 1, 1, 1.0), (2, "short", 1, 1, 1.0), (None, "short", 1, 1, 1.0), (1, "one", 1, 1, 1.0)}
    mit = "Copyright (c) 2020 X\n\n" + license_scan.NOTICES["MIT-text"].replace(". ", ".\n\n")
    got = license_scan.license_matches(spark.createDataFrame([(1, mit)], "doc_id long, text string")).collect()
    assert [(r["template_id"], r["containment"]) for r in got] == [("MIT-text", 1.0)]


# 2


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary_path())


def test_bpe_as_the_library(library):
    enc = bpe.Encoder(bpe.Vocabulary(bpe.read_vocabulary(vocabulary_path())))
    rng = random.Random(2)
    parts = ["a", "b", " ", "  ", "\n", "\t", "é", "日", "😀", "'s", "<|endoftext|>", "1", "22", "!", " ", " ", "\x1c", "\x85", "the", "ing", "aaaa", "\x00", "²", " a"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(1500)] + ["a" * 3000, "xyz" * 500, " " * 50]
    assert enc.encode(texts) == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert [enc.vocabulary.decode(i) for i in enc.encode(texts)] == texts


def test_bpe_edges(edge, empty, library):
    got = bpe.bpe_digests(edge, vocabulary_path()).collect()
    assert len(got) == len(EDGE)
    for r, (_, text, _) in zip(sorted(got, key=lambda r: (str(r["doc_id"]), r["n_tokens"])), sorted(EDGE, key=lambda e: (str(e[0]), 0)), strict=True):
        ids = library.encode(text or "", add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256((text or "").encode()).hexdigest()
    assert bpe.bpe_digests(empty, vocabulary_path()).collect() == []
    kept = bpe.bpe_encode(edge, vocabulary_path()).collect()
    assert kept[0]["id"] == "x" and kept[0]["decoded"] == EDGE[0][1]


# 3


def exact(vectors, query, own, k):
    return sorted((-float(np.dot(v, query)), i) for i, v in vectors if i != own)[:k]


@pytest.mark.parametrize("indexed_from", [0, ann.OneBit.indexed_from])
def test_nearest(spark, indexed_from):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(8, 32))
    data = [(i, (centres[i % 8] + rng.normal(size=32) * 0.4).astype(np.float32).tolist()) for i in range(1200)]
    data += [(2000 + i, data[0][1]) for i in range(60)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>")
    got = ann.nearest(df, F.col("id") % 20 == 0, p=ann.OneBit(vector_block=500, query_block=30, indexed_from=indexed_from)).collect()
    vectors = [(i, np.array(v, np.float32).astype(np.float64)) for i, v in data]
    right = total = 0
    for qid, q in vectors:
        if qid % 20 == 0:
            mine = sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == qid)
            assert [m[0] for m in mine] == list(range(1, 21))
            want = exact(vectors, q, qid, 20)
            right += len({m[1] for m in mine} & {i for _, i in want})
            total += 20
            assert all(abs(s - float(np.dot(dict(vectors)[i], q))) < 1e-9 for _, i, s in mine)
    assert right / total >= (0.9 if indexed_from == 0 else 0.995)
    same = [r["vec_id"] for r in sorted((r for r in got if r["query_id"] == 2000), key=lambda r: r["rank"]) if r["vec_id"] == 0 or r["vec_id"] > 2000]
    assert same and same == [0, *range(2001, 2060)][: len(same)]


def test_nearest_with_repeated_ids(spark):
    """Rows, ids and vectors that repeat don't crowd out other ids."""
    rng = np.random.default_rng(4)
    data = [(1, [3.0, 3.0, 0.0])] * 50 + [(2, [3.0 + k / 100, 3.0, 1.0]) for k in range(40)]
    data += [(i, rng.normal(size=3).tolist()) for i in range(20, 60)] + [(20, [0.5, 0.5, 0.5]), (None, [9.0, 9.0, 9.0])]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    got = ann.nearest(df, F.col("id") % 20 == 0).collect()
    for q in (20, 40):
        best: dict = {}
        for own in (v for i, v in data if i == q):
            for i, v in data:
                if i is not None and i != q:
                    best[i] = max(best.get(i, -1e9), float(np.dot(own, v)))
        want = sorted((-s, i) for i, s in best.items())[:20]
        mine = sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == q)
        assert [i for _, i, _ in mine] == [i for _, i in want] and np.allclose([s for _, _, s in mine], [-s for s, _ in want])


def test_nearest_edges(spark):
    nan = float("nan")
    data = [(0, [1.0, 0.0]), (1, None), (2, [0.0, 0.0]), (3, [nan, 1.0]), (4, [None, 1.0]), (5, [2.0, 0.0]), (20, [0.0, 3.0, 1.0]), (None, [1.0, 1.0]), (6, []), (7, [float("inf"), 1.0])]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    got = ann.nearest(df, F.col("id") % 20 == 0).collect()
    assert [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got] == [(0, 1, 5, 2.0)]
    assert ann.nearest(df.where("false"), F.col("id") % 20 == 0).collect() == []


# 4


def brute_ctw(train, text, depth):
    """Log probability of a text after training, each node on its own."""
    counts: dict = {}

    def steps(body):
        padded = b"\0" * depth + body
        for i in range(depth, len(padded)):
            node = 1
            for k in range(7, -1, -1):
                bit = padded[i] >> k & 1
                yield [(padded[i - d : i], node) for d in range(depth + 1)], bit
                node = node * 2 + bit

    for body in train:
        for path, bit in steps(body):
            for key in path:
                counts.setdefault(key, [0, 0])[bit] += 1
    kt = lambda a, b: math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.log(math.pi) - math.lgamma(a + b + 1)
    total: dict = {}
    for key in sorted(counts, key=lambda k: -len(k[0])):
        own = kt(*counts[key])
        below = sum(total[c, key[1]] for c in {c for c, n in counts if len(c) == len(key[0]) + 1 and c.endswith(key[0]) and n == key[1]})
        total[key] = own if len(key[0]) == depth else np.logaddexp(math.log(0.5) + own, math.log(0.5) + below)
    out = 0.0
    for path, bit in steps(text):
        p = 0.0
        for key in reversed(path):
            c = counts.get(key, [0, 0])
            here = (c[1] + 0.5) / (sum(c) + 1)
            if len(key[0]) == depth:
                p = here
            else:
                stop = math.exp(math.log(0.5) + kt(*c) - total[key]) if key in total else 0.5
                p = stop * here + (1 - stop) * p
        out += math.log10(p if bit else 1 - p)
    return out


def test_ctw_against_brute_force(spark):
    texts = ["ab abc ab", "abc abd Ab\tc", "b", None, "", "zz ab q"]
    ids = list(range(len(texts)))
    df = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string")
    got = rows(ctw.text_scores(df, p=ctw.Tree(depth=3, buckets=4, block_bytes=64)))
    split = {i: words(t) for i, t in zip(ids, texts, strict=True)}
    learn = [i for i in ids if zlib.crc32(str(i).encode()) % 5 != 1]
    tokens = Counter(w for i in learn for w in [*split[i], None])
    n, v = sum(tokens.values()), len(tokens)
    for i in ids:
        assert got[i]["held_out"] == (i not in learn) and got[i]["train_tokens"] == n and got[i]["n_tokens"] == len(split[i]) + 1
        assert got[i]["n_known"] == sum(tokens[w] > 0 for w in [*split[i], None])
        assert got[i]["base_score"] == pytest.approx(sum(math.log10((tokens[w] + 0.5) / (n + 0.5 * (v + 1))) for w in [*split[i], None]))
        assert got[i]["score"] == pytest.approx(brute_ctw([b" ".join(split[k]) + b"\n" for k in learn], b" ".join(split[i]) + b"\n", 3))


def test_ctw_groups_get_their_own_share():
    """Of a bucket's values a group of blocks gets those of its keys, each once."""
    held = {0: ([1, 5, 9], [2, 0, 1]), 1: ([5, 7], [3, 0]), 2: ([7], [0])}
    pack = lambda v, t: ctw._pack(np.array(v, t).tobytes())
    table = pa.table({"bucket": pa.array([4] * 3, pa.int32()), "group": pa.array(list(held), pa.int32()), "keys": pa.array([pack(k, np.uint64) for k, _ in held.values()]), "counts": pa.array([pack(c, np.int64) for _, c in held.values()])})
    shares = ctw._word_shares(table).to_pylist()
    got = {r["group"]: (ctw._unpack(r["keys"], np.uint64).tolist(), ctw._unpack(r["of"], np.int64).tolist()) for r in shares}
    assert got == {0: ([1, 5, 9], [2, 3, 1]), 1: ([5, 7], [3, 0]), 2: ([7], [0])}
    assert sum(r["distinct"] for r in shares) == 3


@pytest.mark.parametrize("depth, split", [(2, 1), (5, 2), (5, 3), (6, 3), (7, 4)])
def test_ctw_depths_against_brute_force(spark, depth, split):
    texts = ["abcabcabcd abcabcabce", "xabcabcabcd", "the cat sat on the cat", "cat sat on thecat", "é日 abcabc"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    tree = ctw.Tree(depth=depth, split=split, buckets=3, block_bytes=20, blocks_a_group=2)
    got = rows(ctw.text_scores(df, F.col("id") != 1, p=tree))
    plain = [b" ".join(words(t)) + b"\n" for t in texts]
    for i in range(len(texts)):
        assert got[i]["score"] == pytest.approx(brute_ctw([b for k, b in enumerate(plain) if k != 1], plain[i], depth))


def test_blocks_are_bounded_by_their_texts(spark):
    """Long texts between short ones, all within one Arrow batch."""
    texts = ["word " * n for n in (3, 9000, 2, 4000, 100, 100, 5000, 1, 20_000, 7)] * 3
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    p = ctw.Tree(block_bytes=20_000)
    sizes = []
    for r in ctw._blocks(df, "doc_id", "text", F.lit(True), p).select("doc").collect():
        raw = ctw._unpack(bytes(r["doc"]))
        n = int(np.frombuffer(raw[:8], np.int64)[0])
        sizes.append(np.frombuffer(raw[8 + 8 * n : 8 + 16 * n], np.int64))
    assert sum(map(len, sizes)) == len(texts)
    assert all(len(x) == 1 or x.sum() <= p.block_bytes for x in sizes)


def test_ctw_edges(edge, empty, spark):
    with pytest.raises(ValueError):
        ctw.Tree(depth=8)
    got = ctw.text_scores(edge).collect()
    assert len(got) == len(EDGE) and all(math.isfinite(r["score"]) and math.isfinite(r["base_score"]) for r in got)
    assert ctw.text_scores(empty).collect() == []
    nothing = ctw.text_scores(spark.createDataFrame([(1, "ab")], "doc_id long, text string"), F.lit(False)).first()
    assert nothing["score"] == pytest.approx(-3 * 8 * math.log10(2)) and nothing["train_tokens"] == 0


def test_log_gamma():
    x = np.array([0.5, 1, 1.5, 7, 100.5, 1e6])
    assert np.allclose(ctw._log_gamma(x), [math.lgamma(v) for v in x], rtol=1e-12, atol=1e-11)


# 5 and 6


def labelled_texts(spark, n=600):
    rng = random.Random(5)
    plain = lambda k: " ".join(rng.choice("alpha beta gamma delta epsilon zeta eta theta iota".split()) for _ in range(k))
    docs, labels = [], []
    for i in range(n):
        bad, toxic = i % 4 == 0, i % 3 == 0
        text = plain(rng.randint(10, 60))
        if bad:
            text = " ".join(w.upper() + "!!" for w in text.split())
        if toxic:
            text += " " + rng.choice(["Rotten,", "vile!", "rottenly"])
        docs.append((i, text, "src"))
        labels.append((i, int(not bad), int(toxic)))
    return spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_quality(spark, edge, empty):
    docs, labels = labelled_texts(spark)
    ranking = quality.train(docs, labels)
    scored = quality.quality_scores(docs, ranking).join(labels, "doc_id").where("held_out").toPandas()
    assert len(scored) > 50 and (scored.predicted == scored.quality).mean() > 0.97 and scored.score.between(0, 1).all()
    assert len(quality.quality_scores(edge, ranking).collect()) == len(EDGE)
    assert quality.quality_scores(empty, ranking).collect() == []
    assert set(quality.keep_good(docs, ranking).columns) == set(docs.columns)
    one = quality.train(docs, labels.where("quality = 1"))
    assert quality.quality_scores(edge, one).where("predicted = 0").count() == 0
    assert quality.train(docs, labels.where("false")).weights.any() == np.False_


def test_toxicity(spark, edge, empty):
    docs, labels = labelled_texts(spark)
    machine = toxicity.train(docs, labels)
    scored = toxicity.toxicity_scores(docs, machine).join(labels, "doc_id").where("held_out").toPandas()
    assert len(scored) > 50 and (scored.predicted == scored.toxic).mean() > 0.97 and scored.score.between(0, 1).all()
    assert len(toxicity.toxicity_scores(edge, machine).collect()) == len(EDGE)
    assert toxicity.toxicity_scores(empty, machine).collect() == []
    assert toxicity.keep_clean(docs, machine).count() == docs.count() - labels.where("toxic = 1").count()
    assert toxicity.toxicity_scores(edge, toxicity.train(docs, labels.where("false"))).count() == len(EDGE)


def test_pairs_count_beyond_their_terms():
    """Two terms that are harmless alone and toxic together."""
    a, b = 11, 22
    sets, y = [], []
    for k in range(400):
        s = {100 + k % 7} | ({a} if k % 2 else set()) | ({b} if k % 4 < 2 else set())
        sets.append(np.array(sorted(s), np.int32))
        y.append(int(a in s and b in s))
    m = toxicity.fit(sets, np.array(y), epochs=200)
    score = lambda *t: m.score([np.array(sorted(m.column[x] for x in t if x in m.column), np.int32)], 1)[0]
    assert score(a, b) > 0.5 > max(score(a), score(b))


def test_neutral_terms_are_learned_among_many():
    """Two terms as common in toxic rows as in others, toxic only when one stands alone,
    among more noise terms than are learned first."""
    a, b, rng = 1, 2, np.random.default_rng(0)
    sets, y = [], []
    for k in range(1600):
        s = ({a} if k & 1 else set()) | ({b} if k & 2 else set()) | set((10 + rng.choice(1500, 4, replace=False)).tolist())
        sets.append(np.array(sorted(s), np.int32))
        y.append((k & 1) ^ (k >> 1 & 1))
    assert not {a, b} & set(toxicity.choose(sets, np.array(y), 1024, 4))
    m = toxicity.fit(sets, np.array(y), epochs=400)
    score = lambda *t: m.score([np.array(sorted(m.column[x] for x in t), np.int32)], 1)[0]
    assert min(score(a), score(b)) > 0.5 > max(score(a, b), score())


# 7


def brute_components(texts, k, percent):
    sets = {}
    for i, t in texts:
        w = words(t)
        if w:
            sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)}
    parent = {i: i for i, _ in texts}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for x in ids:
        for y in ids:
            if x < y and 100 * len(sets[x] & sets[y]) >= percent * len(sets[x] | sets[y]):
                a, b = sorted((root(x), root(y)))
                parent[b] = a
    return {i: (len(sets.get(i, ())), root(i)) for i, _ in texts}


def test_near_duplicates_with_shared_ids(spark):
    """An id with several texts is linked with what any of them is linked with; one row of
    each group stays."""
    rng = random.Random(8)
    body = lambda: [f"w{rng.randrange(5000)}" for _ in range(80)]
    near = lambda b: " ".join([*b[:-1], f"z{rng.randrange(9)}"])
    a, b, c = body(), body(), body()
    data = [(7, " ".join(a)), (7, " ".join(b)), (8, near(a)), (9, near(b)), (9, near(b)), (10, " ".join(c)), (10, " ".join(c)), (3, " ".join(body())), (None, " ".join(c)), (None, " ".join(body())), (None, "only here"), (None, "only here"), (4, None), (4, ""), (5, None)]
    docs = spark.createDataFrame([(i, t, f"r{k}") for k, (i, t) in enumerate(data)], "doc_id long, text string, n_shingles string")
    for p in (dedup.MinHash(), dedup.MinHash(most_paired=1)):
        got = {(r["doc_id"], r["component_id"]) for r in dedup.near_duplicates(docs, p=p).where("doc_id is not null").collect()}
        assert got == {(7, 7), (8, 7), (9, 7), (10, 10), (3, 3), (4, 4), (5, 5)}
    kept = dedup.keep_first(docs)
    assert kept.columns == docs.columns
    kept = sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str)
    assert len(kept) == 8 and [i for i, _ in kept if i is not None].count(7) == 1
    assert {i for i, _ in kept} == {7, 10, 3, 4, 5, None} and [t for i, t in kept if i is None and t != "only here"] == [data[9][1]]


@pytest.mark.parametrize("small", [16, 2])
def test_near_duplicates_against_brute_force(spark, small):
    """Clouds of near copies in which not all pairs are links; ``small`` decides whether
    groups give pairs or go through stars and blocks."""
    rng = random.Random(7)
    texts, i = [], 0
    for _ in range(4):
        base = [f"v{rng.randrange(500)}" for _ in range(80)]
        for _ in range(25):
            copy = list(base)
            for _ in range(rng.randint(0, 6)):
                copy[rng.randrange(len(copy))] = f"v{rng.randrange(500)}"
            texts.append((i, " ".join(copy)))
            i += 1
    texts += [(i, texts[0][1].upper()), (i + 1, ""), (i + 2, None), (i + 3, "two words"), (i + 4, "Two  words")]
    p = dedup.MinHash(shingle=3, percent=85, most_paired=small, block=7)
    got = dedup.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string"), p=p).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute_components(texts, 3, 85)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_near_duplicates_edges(edge, empty):
    got = dedup.near_duplicates(edge, p=dedup.MinHash(shingle=3, percent=85)).collect()
    assert len(got) == len(EDGE)
    by = {r["doc_id"]: r for r in got}
    assert by[2]["component_id"] == 1 and not by[2]["kept"] and by[3]["component_id"] == 3 and by[3]["n_shingles"] == 0
    assert by[None]["component_id"] is None and by[None]["kept"] and by[7]["component_id"] == 7
    assert dedup.near_duplicates(empty).collect() == []


def test_components(spark):
    rng = random.Random(9)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(k, k + 1) for k in range(300, 340)] + [(5, 5), (None, 3)]
    got = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    parent = {}

    def root(i):
        while parent.setdefault(i, i) != i:
            i = parent[i]
        return i

    for u, v in edges:
        if u is not None and u != v:
            a, b = sorted((root(u), root(v)))
            parent[b] = a
    assert got == {i: root(i) for i in parent}


# 8


def brute_tiles(doc, item, least):
    """Greedy string tiling as it is defined: all maximal matches, longest first."""
    used_d, used_i, out = set(), set(), []
    while True:
        best = None
        for t in range(len(item)):
            for d in range(len(doc)):
                n = 0
                while t + n < len(item) and d + n < len(doc) and item[t + n] == doc[d + n] and t + n not in used_i and d + n not in used_d:
                    n += 1
                if n >= least and (best is None or (-n, t, d) < best):
                    best = (-n, t, d)
        if best is None:
            return sorted(out)
        n, t, d = -best[0], best[1], best[2]
        used_i.update(range(t, t + n))
        used_d.update(range(d, d + n))
        out.append((t, d, n))


@pytest.mark.parametrize("block_bytes", [16 << 20, 90])
def test_contamination_against_brute_force(spark, block_bytes):
    """Random documents and items over few words, so that matches cross, repeat and overlap;
    with nulls, empty texts, repeated ids and rows, other columns with the same names."""
    rng = random.Random(23)
    said = lambda low, high: " ".join(rng.choice("Aa b c d".split()) for _ in range(rng.randint(low, high)))
    items = [(k, said(0, 18), "x") for k in range(9)] + [(9, None, "x"), (10, "", "x")]
    items.append(items[3])
    cut = lambda t: " ".join(t.split()[rng.randint(0, 3) : rng.randint(6, 18)])
    shuffled = lambda: " ".join([cut(rng.choice(items)[1] or ""), said(0, 4), cut(rng.choice(items)[1] or ""), said(0, 9)])
    docs = [(k, shuffled() if k % 3 else said(0, 45), k) for k in range(40)] + [(40, None, 0), (41, "", 0), (5, said(20, 30), 0), (6, said(20, 30), 0)]
    docs.append(docs[7])
    p = decontam.Tiling(coverage=0.6, block_bytes=block_bytes)
    bench = spark.createDataFrame(items, "item_id long, text string, n_words string")
    df = spark.createDataFrame(docs, "doc_id long, text string, item_id long")
    split = lambda t: (t or "").lower().split()
    pairs, n_items, known = [], Counter(), {}
    best = {i: (0.0, float("-inf")) for i, _, _ in docs}
    for i, text, _ in docs:
        for j, item, _ in items:
            found = brute_tiles(split(text), split(item), p.least)
            if found:
                matched, size = sum(n for _, _, n in found), len(split(item))
                pairs.append((i, len(split(text)), j, size, matched, len(found)))
                n_items[i] += matched / size >= p.coverage
                best[i] = max(best[i], (matched / size, -j))
                known.setdefault((i, j, matched), set()).add(len(found))
    got = [tuple(r) for r in decontam.matched_items(df, bench, p=p).where("item_id is not null").collect()]
    assert sorted(got) == sorted(pairs)
    assert len(pairs) > 40
    out = {r["doc_id"]: r for r in decontam.contamination(df, bench, p=p).collect()}
    assert set(out) == set(best)
    for i, (cover, j) in best.items():
        r = out[i]
        assert (r["n_items"], r["contaminated"]) == (n_items[i], n_items[i] > 0) and r["coverage"] == pytest.approx(cover)
        assert not cover or (r["item_id"] == -j and r["tiles"] in known[i, -j, r["matched_words"]])
    kept = [r["doc_id"] for r in decontam.keep_clean(df, bench, p=p).collect()]
    clean = lambda text: all(sum(n for _, _, n in brute_tiles(split(text), split(item), p.least)) < p.coverage * len(split(item)) for _, item, _ in items if split(item))
    assert sorted(kept) == sorted(i for i, text, _ in docs if clean(text)) and 0 < len(kept) < len(docs)


def test_tiling_against_brute_force():
    rng = random.Random(11)
    for _ in range(60):
        item = np.array([rng.randrange(4) for _ in range(rng.randint(3, 25))])
        doc = np.array([rng.randrange(4) for _ in range(rng.randint(3, 40))])
        seeds = [(t, d) for t in range(len(item) - 2) for d in range(len(doc) - 2) if (item[t : t + 3] == doc[d : d + 3]).all()]
        assert sorted(decontam.tiles(doc, item, seeds, 3)) == brute_tiles(doc.tolist(), item.tolist(), 3)


def test_contamination(spark, edge, empty):
    item = " ".join(f"t{k}" for k in range(30))
    w = item.split()
    docs = spark.createDataFrame([(1, "a b " + item.upper() + " c"), (2, " ".join(w[15:] + ["x"] + w[:15])), (3, " ".join(w[:12])), (4, None), (5, "")], "doc_id long, text string")
    bench = spark.createDataFrame([(7, item), (8, "tiny one"), (9, None)], "item_id long, text string")
    for p in (decontam.Tiling(), decontam.Tiling(block_bytes=40)):
        got = rows(decontam.contamination(docs, bench, p=p))
        assert {i: r["contaminated"] for i, r in got.items()} == {1: True, 2: True, 3: False, 4: False, 5: False}
        assert got[2]["tiles"] == 2 and got[2]["coverage"] == 1.0 and got[3]["matched_words"] == 12 and got[1]["item_id"] == 7
    assert decontam.contamination(edge, bench).where("contaminated").count() == 0
    assert decontam.contamination(empty, bench).collect() == []
    assert decontam.contamination(docs, bench.where("false")).where("contaminated").count() == 0


# 9


def test_escaping():
    rng = random.Random(13)
    parts = ["<", "s>", "</s>", "<s>", "[", "INST]", "[/INST]", "[INST]", "␛", "a", "\n", "<|endoftext|>", "|"]
    for _ in range(500):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(0, 9)))
        e = chat.escape(t)
        assert chat.unescape(e) == t and not any(c in e for c in chat.CONTROLS)


def test_chat(spark):
    said = "</s>[INST] ok [/INST]"
    turns = [(1, 1, "assistant", said), (1, 0, "user", "hi 😀é"), (2, 0, None, None), (2, 1, "assistant", None), (2, 1, "assistant", "b"), (3, None, "system", "s"), (None, 0, "user", "<s>"), (4, 0, "assistant", "long " * 3000), (4, 1, "user", "日本" * 500), (4, 2, "assistant", "é" * 999)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    for chunk in (1 << 20, 10):
        got = rows(chat.chat_digests(df, vocabulary_path(), chunk), "conv_id")
        for conv in {t[0] for t in turns}:
            mine = sorted(((t[1] if t[1] is not None else -1, t[2] or "", t[3] or "") for t in turns if t[0] == conv))
            loss = "".join(t for _, r, t in mine if r == "assistant")
            assert got[conv]["n_turns"] == len(mine)
            assert got[conv]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in mine).encode()).hexdigest()
            assert got[conv]["loss_chars"] == len(loss) and got[conv]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
            assert got[conv]["formatted_chars"] == len(chat.render([(r, t) for _, r, t in mine])[0])
    whole, parts = (rows(chat.chat_digests(df, vocabulary_path(), c), "conv_id")[4]["n_tokens"] for c in (1 << 20, 10))
    assert whole == parts
    out = chat.format_chats(df, vocabulary_path()).where("conv_id = 1").first()
    assert len(out["ids"]) == len(out["loss_mask"]) and any(out["loss_mask"])
    assert chat.chat_digests(df.where("false"), vocabulary_path()).collect() == []


# 10


def greedy(word, initial, continuing):
    n, at, pieces = 0, 0, initial
    while at < len(word):
        size = next((s for s in range(len(word) - at, 0, -1) if word[at : at + s] in pieces), 0)
        if not size:
            return -1
        n, at, pieces = n + 1, at + size, continuing
    return n


def test_automaton_against_brute_force():
    rng = random.Random(17)
    for _ in range(60):
        make = lambda: {bytes(rng.choice(b"ab") for _ in range(rng.randint(1, 5))) for _ in range(rng.randint(1, 8))}
        first, rest = make(), make()
        one, two = token_counts.Automaton(first), token_counts.Automaton(first, rest)
        for _ in range(60):
            w = bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 12)))
            assert one.count(w) == greedy(w, first, first)
            assert two.count(w) == greedy(w, first, rest)


def test_token_counts(edge, empty):
    pieces = token_counts.byte_pieces(bpe.read_vocabulary(vocabulary_path()))
    got = token_counts.token_counts(edge, vocabulary_path()).collect()
    want = sorted(sum(greedy(b" " + w, pieces, pieces) for w in words(t)[:300]) for _, t, _ in EDGE if not t or len(t) < 5000)
    assert sorted(r["n_tokens"] for r in got if r["n_words"] < 5000) == want and all(r["n_unknown"] == 0 for r in got)
    assert token_counts.token_counts(empty, vocabulary_path()).collect() == []


# The pipeline


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no tables here")
def test_pipeline(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, sf).cache()
        assert after.columns == before.columns and after.count() <= before.count()
        if name == "near-duplicates":
            texts = [(r["doc_id"], r["text"]) for r in before.collect()]
            assert {r["doc_id"] for r in after.collect()} == {i for i, (_, c) in brute_components(texts, 5, 80).items() if i == c}
        before = after
    out = corpus_pipeline.STAGES[-1][1](spark, before, sf)
    assert out.count() == before.count() and out.columns[0] == "doc_id"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    assert before.join(labels.where("quality = 1 and toxic = 0"), "doc_id").count() > 0.3 * labels.where("quality = 1 and toxic = 0").count()
