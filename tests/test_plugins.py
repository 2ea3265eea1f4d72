"""Plug-ins, toggles, reasons, banners and growth with the length of a text."""

import json
import random
import time

import pytest
from pyspark.sql import functions as F

from lanthorn.operators import confirm, metrics
from lanthorn.operators.rules import CANDIDATE
from lanthorn.plans.queries import _rule
from lanthorn.plans.scan import scan
from lanthorn.sources import files
from lanthorn.streaming import check

LABELS = {"person": "PERSON", "org": "ORGANISATION"}


def two_words():
    """A model that knows some words; made here, so that workers get it by value."""
    words = (("Zorbla", "person", 0.9), ("Quintex", "org", 0.7), ("Consultant", "person", 0.9), ("weak", "person", 0.2))
    return lambda text: [(i, i + len(w), k, x) for w, k, x in words if (i := text.find(w)) >= 0]


def test_best_overlap_and_model():
    spans = [(0, 5, "person", 0.5), (3, 9, "org", 0.8), (20, 25, "person", 0.99)]
    assert confirm.best_overlap(spans, 4, 6) == (3, 9, "org", 0.8) and confirm.best_overlap(spans, 9, 20) is None
    model = confirm.ModelConfirmer(two_words(), LABELS)
    assert model("Zorbla", "we saw Zorbla", 7)[:2] == ("confirm", 0.9)
    assert model("Report", "the Report is", 4)[:2] == ("reject", 0.8)
    assert confirm.like_a_name("PERSON", "Zorbla") and not any(confirm.like_a_name(*x) for x in (("PERSON", "zorbla"), ("PERSON", "Z1 X"), ("PERSON", "Lead Consultant"), ("ORGANISATION", "API"), ("PERSON", "X")))


def test_model_discovers(spark):
    df = spark.createDataFrame([(1, "then Sarah is here with Quintex and zz. Consultant"), (2, "nothing here")], "doc_id long, text string")
    model = confirm.ModelConfirmer(two_words(), LABELS)
    scanned = scan(df).withColumn("declined", F.array().cast("array<struct<start:int,end:int>>"))
    rows = {r["doc_id"]: r for r in confirm.confirmed(scanned, model).select("doc_id", "escalation", "findings").collect()}
    assert rows[1]["escalation"]["discovered"] == 1 and [(f["value"], f["category"], f["id"]) for f in rows[1]["findings"] if f["id"].startswith("d")] == [("Quintex", "ORGANISATION", "d1")]
    assert rows[2]["escalation"]["discovered"] == 0 and not rows[2]["escalation"]["invoked"]


def test_detector_and_classifier_of_ones_own(spark):
    df = spark.createDataFrame([(1, "code ZZ here")], "doc_id long, text string")
    mine = F.array(F.struct(F.lit("PROJECT_CODE"), F.lit("ZZ"), F.lit(5), F.lit(7), F.lit("mine"), F.lit("My rule"), F.lit(0.9), F.lit(False), F.lit(False), F.array().cast("array<struct<id:string,weight:double,note:string>>")).cast(CANDIDATE))
    seen = []

    def classifier(df, *args):
        from lanthorn.operators.classify import classified

        seen.append(args)
        return classified(df, *args)

    row = scan(df, extra=mine, classifier=classifier).first()
    assert [(f["value"], f["layer"]) for f in row["findings"]] == [("ZZ", "mine")] and seen


def test_toggles_reasons_and_banner(spark):
    df = spark.createDataFrame([(1, "mail a.b@example.com. Sarah's laptop. " + " ".join(f"x{i}@example.com" for i in range(14)))], "doc_id long, text string")
    scanned = scan(df)
    off = check.without_overridden(scanned, spark.createDataFrame([(1, "f0")], "doc_id long, id string"))
    row = off.select("findings", check.banner(F.col("findings")).alias("b"), F.transform("findings", check.best_reason).alias("why")).first()
    assert [f["enabled"] for f in row["findings"]][:2] == [False, True] and len(row["b"]["shown"]) == 12 and row["b"]["more"] == len(row["findings"]) - 12
    assert {f["value"]: w for f, w in zip(row["findings"], row["why"], strict=True) if w} == {"Sarah": "Used possessively, as a person would be"}


def test_accuracy_timing_and_cases(spark, tmp_path):
    df = spark.createDataFrame([("a", "a", ["a", "b"]), ("b", "a", ["a", "b"]), (None, None, []), ("c", None, ["a"])], "t string, p string, r array<string>")
    row = df.agg(*metrics.accuracy(F.col("t"), F.col("p"), F.col("r"))).first()
    assert (row["n"], row["exact"], row["within"]) == (4, 0.5, 0.75)
    (tmp_path / "x.json").write_text(json.dumps([{"text": "Mark\nsaid", "value": "Mark", "person": True}, {"text": "b", "value": "b", "person": False}], indent=1))
    assert [(r["value"], r["person"]) for r in files.read_cases(spark, str(tmp_path), "text string, value string, person boolean").collect()] == [("Mark", True), ("b", False)]


def test_grows_with_length(spark):
    """Four times the matches take less than six times as long."""
    text = lambda n: " ".join(f"user{i}@mail{i % 7}.example.com wrote on" for i in range(n))
    run = lambda n: spark.createDataFrame([(1, text(n))], "doc_id long, text string").select(F.size(_rule("email"))).first()[0]
    run(100)
    took = []
    for n in (4000, 16_000):
        began = time.time()
        assert run(n) == n
        took.append(time.time() - began)
    assert took[1] < 6 * max(took[0], 0.3)


def test_distinct_windows_are_looked_at_once(spark, tmp_path):
    """As the look a document at a time; one call a window, however many documents have it."""
    log = str(tmp_path / "calls")

    def many(texts):
        with open(log, "a") as f:
            f.writelines(str(hash(t)) + "\n" for t in texts)
        return [[(i, i + 5, "person", 0.9)] if (i := t.find("Sarah")) >= 0 else [] for t in texts]

    texts = ["then Sarah is here with Mark.", "then Sarah is here with Mark.", "Grace was late", "Mark called about the report.", None, "", "plain words"]
    df = spark.createDataFrame([(i, texts[i % len(texts)]) for i in range(42)], "doc_id long, text string").repartition(3)
    scanned = scan(df)
    class Confirming(confirm.ModelConfirmer):
        """Only confirms, so that every call is one for a window."""

        @property
        def discover(self):
            raise AttributeError

    model = Confirming(lambda t: many([t])[0], LABELS, many=many)
    once = lambda by: sorted(confirm.confirmed_once(scanned, ["doc_id"], by).select("doc_id", "findings", "escalation", "risk").collect())
    each = lambda by: sorted(confirm.confirmed(scanned, by).select("doc_id", "findings", "escalation", "risk").collect())
    assert once(None) == each(None)
    got = once(model)
    calls = len(open(log).readlines())
    windows = scanned.select(F.explode(F.concat(F.filter("findings", lambda f: f["tier"] == "medium"), "recoverable")).alias("f"), "text").select(confirm.request(F.col("f"), F.col("text"))["window"]).distinct().count()
    assert calls == windows > 1
    assert got == each(model) and any(r["escalation"]["confirmed"] for r in got)
    broken = once(type("Broken", (confirm.DeepContext,), {"__call__": lambda self, *x: 1 / 0})())
    assert {r["escalation"]["error"] for r in broken if r["escalation"]["invoked"]} == {"division by zero"}
    assert once(None)[0]["doc_id"] == 0 and len(broken) == 42


def test_percentiles_of_any_size(spark):
    """Ties, nulls, skewed groups and groups of one, against sorting."""
    rng = random.Random(4)
    rows = [(rng.choice(["hot", "hot", "hot", "b", None]), rng.choice([None, float(rng.randint(0, 30)), rng.expovariate(0.01)])) for _ in range(40_000)] + [("one", 5.0), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    percents = [0, 1, 50, 95, 99, 100]

    def plain(mine):
        v = sorted(x for x in mine if x is not None)
        return [v[min(len(v) - 1, p * len(v) // 100)] for p in percents] if v else None

    want = {g: plain([v for k, v in rows if k == g]) for g in {g for g, _ in rows}}
    got = {r["g"]: list(r)[1:] for r in metrics.ranked_percentile(df, "v", percents, "g").collect()}
    assert got == {g: x for g, x in want.items() if x}
    assert list(metrics.ranked_percentile(df, "v", percents).first()) == plain([v for _, v in rows])
    assert metrics.ranked_percentile(df.where("false"), "v", percents, "g").collect() == []


@pytest.mark.parametrize("part_rows", [20, 60, 100_000])
def test_rolling_in_stretches(spark, part_rows):
    """Stretches shorter and longer than the window, a null key, a hot key, null values."""
    rng = random.Random(6)
    rows = [(rng.choice(["hot", "hot", "hot", "b", None]), i, rng.choice([None, float(rng.randint(0, 100))])) for i in range(1500)] + [("one", 1, 2.0)]
    df = spark.createDataFrame(rows, "g string, at long, v double").repartition(5)
    got = {(r["g"], r["at"]): (r["rolling_mean"], r["rolling_n"]) for r in metrics.rolling(df, "v", "at", "g", rows=50, part_rows=part_rows).collect()}
    want, seen = {}, {}
    for g, at, v in sorted(rows, key=lambda r: r[1]):
        mine = seen.setdefault(g, [])
        mine.append(v)
        last = [x for x in mine[-50:] if x is not None]
        want[g, at] = (sum(last) / len(last) if last else None, len(last))
    assert got == want and len(got) == len(rows)
    assert metrics.rolling(df.where("false"), "v", "at", "g").collect() == []
    assert len(metrics.rolling(df, "v", "at", rows=3, part_rows=part_rows).collect()) == len(rows)


def test_newest_without_a_key(spark):
    df = spark.range(5000).repartition(7)
    assert sorted(r["id"] for r in metrics.newest(df, "id").collect()) == list(range(4800, 5000))
    assert "Window" not in metrics.newest(df, "id")._jdf.queryExecution().executedPlan().toString()
