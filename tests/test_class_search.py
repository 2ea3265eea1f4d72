"""Classes are weighed in one Arrow pass."""

from __future__ import annotations

from pyspark.sql import functions as F

from lanthorn.functions.classes import CLASSES
from lanthorn.operators.classify import classified


def test_the_plan_looks_for_no_term_in_expressions(spark, capsys):
    classified(spark.createDataFrame([("a",)], "text string")).select("classification").explain()
    plan = capsys.readouterr().out
    assert plan.count("ArrowEvalPython") == 1 and "Contains(" not in plan and "contains(" not in plan


def test_classes_of_their_own_words(spark):
    rows = [(k, f"About {c.label}\nIt has {' and '.join(c.strong + c.terms)}.") for k, c in enumerate(CLASSES)] + [(-1, None), (-2, "")]
    got = {r["k"]: r["c"] for r in classified(spark.createDataFrame(rows, "k int, text string")).select("k", F.col("classification").alias("c")).collect()}
    of = {"documentType": lambda c: [c["document_type"]], "topic": lambda c: c["topics"], "function": lambda c: c["functions"]}
    right = sum(c.id in [x["id"] for x in of[c.dimension](got[k]) if x] for k, c in enumerate(CLASSES))
    assert right >= 0.9 * len(CLASSES)
    assert got[-1]["summary"] == got[-2]["summary"] == "No clear document type"
