"""Steps of the cleaning do no work twice, and short ways give what long ones give."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from lanthorn.functions.categories import CATEGORIES
from lanthorn.functions.dialect import FEW, folded, leaders
from lanthorn.operators.resolve import FINDING
from lanthorn.operators.sanitize import VARIED, apart, cleaned, synthetic


def plan(df, capsys) -> str:
    df.explain()
    return capsys.readouterr().out


@pytest.mark.parametrize("mode", ["redact", "pseudonymize", "synthetic"])
def test_what_is_not_asked_for_is_not_made(spark, capsys, mode):
    df = cleaned(spark.createDataFrame([("a", [])], f"text string, findings array<{FINDING}>"), mode)
    assert "map_from_entries" not in plan(df.select("clean.text", "clean.replacements"), capsys) and "map_from_entries" in plan(df.select("clean.value_map"), capsys)


def test_a_step_that_gives_both_is_taken_once(spark, capsys):
    step = lambda s, x: F.struct((s + F.ascii(F.concat(x.cast("string"), F.lit("once")))).alias("state"), F.array(s).alias("out"))
    df = spark.createDataFrame([([1, 2, 3],)], "x array<int>").select(folded(F.col("x"), F.lit(0), "array<int>", step).alias("f"))
    assert df.first()["f"].asDict() == {"state": 150, "out": [0, 49, 99]} and plan(df, capsys).count("once") == 1


def test_categories_that_no_bump_changes(spark):
    names = [c[0] for c in CATEGORIES]
    df = spark.createDataFrame([(n,) for n in names], "c string").crossJoin(spark.range(60))
    made = lambda b: synthetic(F.col("c"), F.lit(7).cast("bigint"), b)
    got = {r["c"]: r["n"] for r in df.groupBy("c").agg(F.count_distinct(made(F.col("id"))).alias("n")).collect()}
    assert {c for c, n in got.items() if n > 1} == set(VARIED)


@pytest.mark.parametrize("n", [0, 1, FEW, FEW + 1])
@pytest.mark.parametrize("null", [False, True])
@pytest.mark.parametrize("last", [False, True])
def test_leaders_of_few_and_many(spark, n, null, last):
    rnd = random.Random(n)
    keys = [None if null and k % 5 == 3 else f"k{rnd.randint(0, 9)}" for k in range(n)]
    got = spark.createDataFrame([(keys,)], "k array<string>").select(leaders(F.col("k"), lambda k: k, last=last).alias("at")).first()["at"]
    assert got == [(n - 1 - keys[::-1].index(k)) if last else keys.index(k) for k in keys]


def test_findings_out_of_order_or_touching_are_set_apart(spark):
    row = lambda k, s, e: (f"f{k}", k, "EMAIL", "x", s, e, "pattern", "r", 0.9, False, False, 0.9, "high", True, None, [])
    for spans in ([(0, 3), (3, 5), (9, 12)], [(5, 9), (0, 3)], [(0, 6), (4, 8), (6, 7)], [(2, 4), (2, 4)], [(-1, 2), (3, 4)], []):
        got = spark.createDataFrame([([row(k, *x) for k, x in enumerate(spans)],)], f"f array<{FINDING}>").select(apart(F.col("f")).alias("f")).first()["f"]
        want, end = [], 0
        for s, e in sorted(spans, key=lambda x: x[0]):
            if s >= end:
                want.append((s, e))
                end = e
        assert [(x["start"], x["end"]) for x in got] == want
