"""Differences of findings: rows are made once, nothing is joined."""

from __future__ import annotations

from pyspark.sql import functions as F

from lanthorn.operators import metrics

ROWS = [(1, 0, "a", "EMAIL"), (1, 0, "a", "PHONE"), (1, 3, "b", "EMAIL"), (1, 3, "b", "EMAIL"), (2, 0, "c", "PHONE"), (3, 0, "d", "CARD"), (4, None, "e", "CARD")]


def test_once_without_a_join(spark, capsys):
    rows = spark.createDataFrame(ROWS, "doc_id long, start int, value string, category string")
    found = metrics.delta_of(rows, F.col("category") != "EMAIL", F.col("category") != "PHONE")
    found.explain()
    plan = capsys.readouterr().out
    assert "Join" not in plan and plan.count("Scan ") == 1
    assert {tuple(r) for r in found.collect()} == {(1, 0, 2), (2, 1, 0), (4, 1, 1)}
    two = metrics.delta(rows.where("category <> 'EMAIL'"), rows.where("category <> 'PHONE'"))
    assert {tuple(r) for r in two.collect()} == {tuple(r) for r in found.collect()}
