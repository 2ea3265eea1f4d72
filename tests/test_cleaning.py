"""Cleaning, highlights and verdicts against plain versions, and how their time grows."""

import random
import time

import pytest
from pyspark.sql import functions as F

from lanthorn.functions.dialect import leaders
from lanthorn.operators import confirm, metrics, sanitize
from lanthorn.operators.resolve import FINDING

TABLE = f"doc_id long, text string, findings array<{FINDING}>"
PREFIX, TOKEN = {"EMAIL": "Email", "PHONE": "Phone", "PASSWORD": "?"}, {"EMAIL": "[EMAIL]", "PHONE": "[PHONE]", "PASSWORD": "[PASSWORD]"}


def finding(i, category, value, start, end, tier="high", confidence=0.9, enabled=True):
    return (f"f{i}", i, category, value, start, end, "pattern", "x", 0.9, False, False, confidence, tier, enabled, None, [])


def documents(seed, n=12):
    """Findings that repeat values in other cases, overlap, or are switched off."""
    rng, out = random.Random(seed), [(-1, None, []), (-2, "", []), (-3, "no findings ✓", [])]
    for d in range(n):
        text, found = "é", []
        for i in range(rng.choice([1, 5, 300, 700])):
            text += rng.choice(["", " und ", "日本 ", " 😀, "])
            value = rng.choice([f"u{rng.randint(0, 400)}@x.org", f"U{rng.randint(0, 9)}@X.org", "030 1234"])
            found.append(finding(i, "PHONE" if value[0] == "0" else rng.choice(["EMAIL", "EMAIL", "PASSWORD"]), value, len(text), len(text) + len(value), enabled=rng.random() < 0.95))
            if rng.random() < 0.1:
                found.append(finding(i + 10_000, "EMAIL", value[2:], len(text) + 2, len(text) + len(value)))
            text += value
        rng.shuffle(found)
        out.append((d, text + rng.choice(["", " end"]), found))
    return out


def fnv(value):
    h = 2166136261
    for c in value:
        h = ((h ^ ord(c)) * 16777619) & 0xFFFFFFFF
    return abs(h - (1 << 32) if h > 0x7FFFFFFF else h)


def stand_in(category, value, bump):
    seed = fnv(value)
    if category == "PHONE":
        return f"+1 555 01{(seed + bump) % 9000 % 100:02d}"
    first, last = sanitize.FIRST[(seed + bump) % len(sanitize.FIRST)], sanitize.LAST[(seed + bump * 3) % len(sanitize.LAST)]
    return f"{first}.{last}@example.com".lower()


def plain(text, findings, mode, tokens, prefixes):
    known, rows, parts, cursor, pos = {}, [], [], 0, 0
    for f in sorted((f for f in findings if f["enabled"]), key=lambda f: f["start"]):
        if f["start"] < cursor:
            continue
        key = (f["category"], f["value"].lower())
        if key not in known:
            if mode == "redact" or f["category"] == "PASSWORD":
                known[key] = tokens[f["category"]]
            elif mode == "pseudonymize":
                known[key] = f"{prefixes[f['category']]}_{sum(c == f['category'] for c, _ in known) + 1:03d}"
            else:
                taken, bump = set(known.values()), 0
                while bump < sanitize.MOST_BUMPS and stand_in(f["category"], f["value"], bump) in taken:
                    bump += 1
                known[key] = stand_in(f["category"], f["value"], bump)
        r = known[key]
        pos += f["start"] - cursor
        rows.append((f["id"], f["category"], f["value"], r, pos, pos + len(r)))
        parts += [text[cursor : f["start"]], r]
        pos, cursor = pos + len(r), f["end"]
    return "".join(parts) + text[cursor:], rows, {r[2]: r[3] for r in rows}


@pytest.mark.parametrize("mode", sanitize.MODES)
def test_cleaning_against_a_plain_version(spark, mode):
    docs = spark.createDataFrame(documents(1), TABLE)
    named = {r["category"]: (r["t"], r["p"]) for r in spark.createDataFrame([(c,) for c in TOKEN], "category string").select("category", sanitize.attribute(F.col("category"), "token").alias("t"), sanitize.attribute(F.col("category"), "prefix").alias("p")).collect()}
    for r in sanitize.cleaned(docs, mode).collect():
        if r["text"] is None:
            assert r["clean"]["text"] is None and r["clean"]["replacements"] == []
            continue
        text, rows, pairs = plain(r["text"], r["findings"], mode, {c: t for c, (t, _) in named.items()}, {c: p for c, (_, p) in named.items()})
        assert (r["clean"]["text"], [tuple(x) for x in r["clean"]["replacements"]], r["clean"]["value_map"]) == (text, rows, pairs)


def test_highlights_against_a_plain_version(spark):
    for r in spark.createDataFrame(documents(2), TABLE).select("text", "findings", metrics.highlights(F.col("text"), F.col("findings")).alias("h")).collect():
        want, at = [], 0
        for f in sorted(r["findings"], key=lambda f: f["start"]):
            if f["start"] >= at:
                want += [(r["text"][at : f["start"]], None), (r["text"][f["start"] : f["end"]], f["id"])]
                at = f["end"]
        want = [x for x in [*want, ((r["text"] or "")[at:], None)] if x[1] is not None or x[0]]
        assert [tuple(x) for x in r["h"] or []] == want


def test_leaders(spark):
    rng = random.Random(3)
    rows = [[(rng.choice(["a", "b", "c", None]), rng.randint(0, 3)) for _ in range(n)] for n in (0, 1, 5, 600)]
    df = spark.createDataFrame([(x,) for x in rows], "x array<struct<k:string,r:int>>")
    for r in df.select("x", leaders(F.col("x"), lambda e: e["k"], lambda e, i: e["r"]).alias("at"), leaders(F.col("x"), lambda e: e["k"]).alias("first")).collect():
        same = lambda k, x=r["x"]: [i for i, e in enumerate(x) if e["k"] == k]
        assert r["at"] == [min(same(e["k"]), key=lambda i: (r["x"][i]["r"], i)) for e in r["x"]]
        assert r["first"] == [min(same(e["k"])) for e in r["x"]]


def test_verdicts_and_one_answer(spark):
    """Each verdict goes to the finding with its id, whatever their order."""
    found = [finding(i, "PERSON", f"Name{i % 40}", 10 * i, 10 * i + 6, tier="medium" if i % 3 else "high", confidence=0.5 + i % 7 / 100) for i in range(120)]
    back = [("r" + f[0][1:], *f[1:]) for f in (finding(i, "PERSON", f"Back{i}", 2000 + 10 * i, 2006 + 10 * i, tier="low", confidence=0.2) for i in range(6))]
    decide = ["confirm", "reject", "unknown"]
    given = [(f[0], decide[k % 3], 0.8, f"note {f[0]}") for k, f in enumerate([*found, *back]) if k % 5]
    random.Random(1).shuffle(given)
    by = confirm.DeepContext()
    df = spark.createDataFrame([(found, back, given), (found, back, [])], f"findings array<{FINDING}>, recoverable array<{FINDING}>, given array<{confirm.VERDICT}>")
    rows = df.select(confirm.apply_verdicts(F.col("findings"), F.col("recoverable"), F.col("given"), by).alias("out")).collect()
    verdict = {g[0]: g for g in given}
    want = []
    for f in found:
        d = verdict.get(f[0], (None, None))[1] if f[12] == "medium" else None
        if d != "reject":
            want.append((f[0], by.id if d else None, max(f[11], 0.8) if d == "confirm" else f[11]))
    want += [(f[0], by.id, 0.8) for f in back if verdict.get(f[0], (None, None))[1] == "confirm"]
    assert [(r["id"], r["confirmed_by"], r["confidence"]) for r in rows[0]["out"]] == want
    assert [r["id"] for r in rows[1]["out"]] == [f[0] for f in found]
    mixed = [finding(0, "PERSON", "Ann", 0, 3, confidence=0.6), finding(1, "ORGANISATION", "ANN", 5, 8, confidence=0.8), finding(2, "LOCATION", "ann", 9, 12, confidence=0.8), finding(3, "PERSON", "Bob", 14, 17)]
    out = spark.createDataFrame([(mixed,)], f"f array<{FINDING}>").select(confirm.one_answer(F.col("f")).alias("o")).first()["o"]
    assert [(r["category"], r["confidence"], len(r["signals"])) for r in out] == [("ORGANISATION", 0.8, 1), ("ORGANISATION", 0.8, 0), ("ORGANISATION", 0.8, 1), ("PERSON", 0.9, 0)]


def long_document(n):
    at, found, words = 0, [], []
    for i in range(n):
        words.append(f"user{i % (n // 2)}@mail{i % 7}.example.com")
        found.append(finding(i, "EMAIL", words[-1], at, at + len(words[-1])))
        at += len(words[-1]) + 10
    return 1, " wrote on ".join(words), found


@pytest.mark.parametrize("mode", sanitize.MODES)
def test_cleaning_grows_with_the_findings(spark, mode):
    """Four times the findings take less than six times as long."""
    took = []
    for n in (500, 4000, 16_000):
        df = spark.createDataFrame([long_document(n)], TABLE).cache()
        df.count()
        best = []
        for _ in range(2):
            began = time.time()
            row = sanitize.cleaned(df, mode).select(F.size("clean.replacements").alias("n"), F.size(metrics.highlights(F.col("text"), F.col("findings"))).alias("h")).first()
            best.append(time.time() - began)
        assert (row["n"], row["h"]) == (n, 2 * n - 1)
        took.append(min(best))
        df.unpersist()
    assert took[2] < 6 * max(took[1], 0.5)
