"""All that is read from a text alone is read in one pass; lines that expressions look at are not missed."""

from __future__ import annotations

from pyspark.sql import functions as F

from lanthorn.operators.sensitivity import ROADMAP, SECTIONS, headings, headings_of, held_of, roadmap_rows, roadmap_rows_of
from lanthorn.plans.scan import scan

TEXTS = ["", "PRICING STRATEGY\nQ1 2026 a\n\nH2 FY27 b\n2028 release", "ſtrategy\n--- Roadmap ---\n# forecast é\nq4 '29\nQ3 2027", "\n" * 450 + "ROADMAP\nQ1 2027"]


def test_a_text_is_read_once_for_rules_words_and_classes(spark, capsys):
    scan(spark.createDataFrame([("a",)], "text string")).select("findings").explain()
    assert capsys.readouterr().out.count("ArrowEvalPython") == 2  # what the text holds, entities; there were four


def test_lines_that_may_count(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "text string").withColumn("w", held_of(F.col("text")))
    subject = lambda found: F.filter(found, lambda h: h.rlike("(?i)roadmap|strategy|pricing|forecast|q[1-4] 20"))
    rows = df.select(subject(headings("text")).alias("a"), subject(headings_of(F.col("w")[SECTIONS])).alias("b"), roadmap_rows(F.col("text")).alias("c"), roadmap_rows_of(F.col("w")[ROADMAP]).alias("d")).collect()
    assert all(r["a"] == r["b"] and r["c"] == r["d"] for r in rows) and rows[1]["b"] == ["PRICING STRATEGY"] and rows[1]["d"] == 3
