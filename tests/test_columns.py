"""Entity candidates are handed over column by column, and classes weighed where they may apply."""

from __future__ import annotations

import gc

import pyarrow as pa
from pyspark.sql import functions as F

from lanthorn.functions.classes import CLASSES
from lanthorn.functions.vocab import Vocabulary
from lanthorn.operators.classify import Evidence, weighed
from lanthorn.operators.entities import Columns, Context, Recogniser, propose, proposed
from lanthorn.operators.rules import CANDIDATE_ARROW

TEXTS = ["Mr John Smith's desk, 12 Long Road", "", "she visited London. Mary from the sales team", "Acme Ltd is our largest customer"]


def test_columns_hold_what_is_proposed():
    parts, out, want = (Recogniser(Vocabulary()), Context(Vocabulary())), Columns(), []
    for t in TEXTS:
        out.add(proposed(t, [], [], *parts))
        want.append(propose(t, [], [], *parts))
    assert out.array().to_pylist() == pa.array(want, pa.list_(CANDIDATE_ARROW)).to_pylist() and sum(map(len, want)) >= 4


def test_columns_leave_nothing_to_collect():
    parts, out = (Recogniser(Vocabulary()), Context(Vocabulary())), Columns()
    gc.collect()
    before = len(gc.get_objects())
    for _ in range(300):
        out.add(proposed(TEXTS[2], [], [], *parts))
    gc.collect()
    assert len(gc.get_objects()) - before < 300


def test_classes_are_weighed_where_something_speaks_for_them(spark):
    texts = [None, "", "the Nda", "NDA: receiving party", "ſtatement of worK deliverables, milestones and assumptions", *(f"{p} {' '.join(c.strong)}" for c in CLASSES for p in c.terms)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string").select("i", weighed(F.col("text"), F.lit("")).alias("w"))
    got = {r["i"]: [(x["k"], x["raw"]) for x in r["w"]] for r in df.collect()}
    for i, t in enumerate(texts):
        rows = ((k, Evidence.made(c).weighed(t or "", (t or "").lower(), "")[0]) for k, c in enumerate(CLASSES)) if t else ()
        assert got[i] == [(k, raw) for k, raw in rows if raw > 0.4]
