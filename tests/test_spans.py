"""One search a rule: patterns that Java searches faster match the same, marks in texts do no harm."""

from __future__ import annotations

import random

import regex
from pyspark.sql import functions as F

from lanthorn.functions import classes as C
from lanthorn.functions.dialect import MARK, for_java, portable, spans
from lanthorn.operators.rules import RULES
from lanthorn.plans.corpora import note_sql


def _texts(spark):
    rng = random.Random(7)
    note = spark.range(3, 4).select(F.expr(note_sql("id"))).first()[0]
    marks = "strictly confidential, press release; do not share. 2027 target Q3 FY27 internal use only"
    source = f"{note} {marks} a@b.c x-y-10 pass is 'abc' Bearer abcdefghijklmnopqrst= CUST-123 é9 _a@b.co"
    cut = lambda: source[(i := rng.randrange(len(source))) : i + rng.randrange(2, 90)]
    return [source] + [rng.choice(("", " ", "_", "é", "-", "\n")).join(cut() for _ in range(rng.randrange(1, 5))) for _ in range(300)]


def test_the_same_matches(spark):
    texts = _texts(spark)
    patterns = [r.regex for _, r in RULES.values()] + [portable(p, True) for p in (C.CONFIDENTIAL_MARK, C.PUBLIC_MARK, C.ROADMAP_ROW)]
    patterns += [portable(p.removeprefix("="), not p.startswith("=")) for c in C.CLASSES for p in c.patterns]
    for p in patterns:
        plain, fast = regex.compile(p), regex.compile(for_java(p))
        assert [[m.span() for m in plain.finditer(t)] for t in texts] == [[m.span() for m in fast.finditer(t)] for t in texts], p


def test_a_rule_searches_a_text_once(spark, capsys):
    df = spark.createDataFrame([("a",)], "text string").select(spans(F.col("text"), RULES["email"][1].regex).alias("s"))
    df.explain()
    plan = capsys.readouterr().out
    # The search with marks, and what stands by for texts that hold the mark.
    assert plan.count("regexp_replace(") == 1 and plan.count("regexp_extract_all(") == 1 and "RLIKE" not in plan


def test_marks_in_texts(spark):
    pattern, text = RULES["password"][1].regex, "say password: \"abc1\" and pwd = 'xyz2'"
    rows = spark.createDataFrame([(0, text), (1, f"{MARK}{text}{MARK}{MARK}"), (2, text.replace("b", MARK)), (3, f"none {MARK}"), (4, None), (5, "")], "id int, text string")
    found = {r[0]: [(s["value"], s["start"], s["end"], s["at"]) for s in r[1]] for r in rows.select("id", spans(F.col("text"), pattern, (1, 2, 3))).collect()}
    assert found[0] == [("abc1", 15, 19, 4), ("xyz2", 32, 36, 25)]
    assert found[1] == [(v, s + 1, e + 1, a + 1) for v, s, e, a in found[0]]
    assert found[2] == [(f"a{MARK}c1", 15, 19, 4), ("xyz2", 32, 36, 25)]
    assert found[3] == found[4] == found[5] == []
