"""Classes are weighed on whole texts, however long."""

from __future__ import annotations

import duckdb
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from lanthorn.functions.classes import CLASSES
from lanthorn.operators.classify import ENOUGH_TERMS, LEAST_RAW, TERM, Evidence, classified, weighed
from lanthorn.plans.oracle import ORACLE_SQL
from lanthorn.plans.queries import class_confidence
from lanthorn.plans.scan import scan

LONG = "word " * 5000 + "This is a mutual non-disclosure agreement. The receiving party shall not disclose."


def test_what_stands_late_counts(spark):
    df = spark.createDataFrame([(1, LONG)], "doc_id long, text string")
    assert classified(df).first()["classification"]["document_type"]["id"] == "nda"
    assert scan(df).select(F.col("classification.document_type.id")).first()[0] == "nda"


def test_the_query_and_its_sql_read_to_the_end(spark, tmp_path):
    con = duckdb.connect()
    con.execute("create table documents as select 1::bigint as doc_id, ? as text", [LONG])
    con.execute("create table customer as select 1::bigint as c_custkey")
    for t in ("documents", "customer"):
        con.execute(f"copy {t} to '{tmp_path}/{t}.parquet' (format parquet)")
    want = con.execute(ORACLE_SQL["class_confidence"]).fetchall()
    got = [tuple(r) for r in class_confidence(spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(want) and (1, "documentType", "nda") in [r[:3] for r in got]



def test_classes_by_terms_alone(spark):
    assert TERM * (ENOUGH_TERMS - 1) <= LEAST_RAW < TERM * ENOUGH_TERMS
    texts = [" ".join(c.terms[:n]) for c in CLASSES for n in range(1, len(c.terms) + 1)]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string").coalesce(1).select("i", weighed(F.col("text"), F.lit("")).alias("w")).collect()
    for r in rows:
        t = texts[r["i"]]
        each = ((k, Evidence.made(c).weighed(t, t.lower(), "")[0]) for k, c in enumerate(CLASSES))
        assert [(x["k"], x["raw"]) for x in r["w"]] == [(k, raw) for k, raw in each if raw > LEAST_RAW]
    assert sum(len(r["w"]) for r in rows) > 10


def test_a_few_terms_are_not_weighed():
    server = next(Evidence.made(c) for c in CLASSES if c.id == "it_security")
    low = ["server", "server network backup patch outage database"]
    held = pc.match_substring_regex(pa.array(low), server.needed).to_numpy(zero_copy_only=False)
    assert server.plausible(pa.array(low), low, held) == [1]
