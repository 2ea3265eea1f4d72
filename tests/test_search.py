"""Rules search a text in one Arrow pass; what they find is what plain searches find."""

from __future__ import annotations

import time

import pytest
from pyspark.sql import functions as F
from test_spans import _texts
from test_whole_scan import plain_matches

from lanthorn.operators.rules import LAYERS, RULES, luhn, rule_candidates
from lanthorn.plans.scan import scan


def test_candidates_are_the_plain_matches_that_pass_their_check(spark):
    texts = [*_texts(spark), None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {r["id"]: r["r"] for r in df.select("id", rule_candidates(F.col("text"), LAYERS).alias("r")).collect()}
    for i, text in enumerate(texts):
        for layer, rules in LAYERS.items():
            want = [(r.name, v, at, at + len(v)) for r in rules for v, at in plain_matches(r, text or "") if r.check is None or r.groups or r.check(v, text, at)]
            have = [(c["rule"], c["value"], c["start"], c["end"]) for c in got[i][layer]]
            unsure = {r.name for r in rules if r.check is not None and r.groups}
            assert [x for x in have if x[0] not in unsure] == [x for x in want if x[0] not in unsure] and set(have) <= set(want)


def test_bytes_that_are_no_text(spark):
    df = spark.range(1).select(F.expr("cast(concat(X'ff', cast(' mail a@b.co' as binary)) as string)").alias("text"))
    (row,) = df.select(rule_candidates(F.col("text"), {"pattern": [RULES["email"][1]]}).alias("r")).collect()
    assert [(c["value"], c["start"]) for c in row["r"]["pattern"]] == [("a@b.co", 7)]


@pytest.mark.parametrize(("number", "right"), [("4111111111111111", True), ("4111111111111112", False), ("79927398713", False), ("8001015009087", True), ("000000000000", True)])
def test_luhn(number, right):
    assert luhn(number) is right


def test_the_scan_searches_no_rule_in_expressions(spark, capsys):
    df = spark.createDataFrame([("a",)], "text string")
    scan(df).select("candidates").explain()
    plan = capsys.readouterr().out
    assert "regexp_replace(" not in plan and plan.count("ArrowEvalPython") == 2  # rules, entities


def test_marks_and_letters_of_odd_case(spark):
    texts = ["﷐ CUST-123 ﷐mail a@b.co﷐", "ſr-1234 Caſe 12345 ticKet 777 KEY=İ ticKet 999", "b@c.de é x@y.zz"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {r["id"]: [(c["rule"], c["value"], c["start"]) for layer in LAYERS for c in r["r"][layer]] for r in df.select("id", rule_candidates(F.col("text"), LAYERS).alias("r")).collect()}
    for i, text in enumerate(texts):
        want = [(r.name, v, at) for _, r in RULES.values() if r.check is None for v, at in plain_matches(r, text)]
        assert [x for x in got[i] if x[0] in {r.name for _, r in RULES.values() if r.check is None}] == want and want


def test_time_follows_the_length(spark):
    """One text of many labels: a search that starts anew at each of them reads it thousands of times."""
    df = spark.range(1).select(F.expr("repeat('ab.', 30000) || ' .local'").alias("text"))
    began = time.time()
    (row,) = df.select(rule_candidates(F.col("text"), {"business": [RULES["domain"][1]]}).alias("r")).collect()
    assert not row["r"]["business"] and time.time() - began < 10
