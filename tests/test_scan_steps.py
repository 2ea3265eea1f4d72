"""Steps of the scan and of policy decisions do less and give the same."""

from __future__ import annotations

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lanthorn.functions.categories import CATEGORIES
from lanthorn.functions.dialect import FEW
from lanthorn.functions.vocab import Vocabulary
from lanthorn.operators.entities import Recogniser
from lanthorn.operators.resolve import FINDING, SPAN, _touching
from lanthorn.operators.risk import Policy, evaluate
from lanthorn.operators.sensitivity import _LISTS, words_in


def test_words_are_those_that_a_text_contains():
    rnd, every = random.Random(3), [w for words in _LISTS for w in words]
    texts = ["", "İ restricteD", *(" ".join(rnd.choice([rnd.choice(every).upper(), "x", "ſ", "é."]) for _ in range(rnd.randint(0, 8))) for _ in range(300))]
    want = [[[w for w in words if w in t.lower()] for t in texts] for words in _LISTS]
    assert words_in(pa.array(texts)) == want


@pytest.mark.parametrize("n", [0, 1, 5, FEW, FEW + 20])
def test_groups_of_touching_spans(spark, n):
    rnd = random.Random(n)
    some = sorted((s := rnd.randint(0, 6 * n), k, s + rnd.randint(1, 9), k) for k in range(n))
    got = spark.createDataFrame([(some,)], f"s array<{SPAN}>").select(_touching(F.col("s")).alias("g")).first()["g"]
    want, upto = [], -1
    for x in some:
        if not want or x[0] >= upto:
            want.append([])
        want[-1].append(x)
        upto = max(upto, x[2])
    assert [[tuple(x) for x in g] for g in got] == want


def test_decisions_look_a_category_up_once(spark, capsys):
    df = spark.createDataFrame([([],)], f"f array<{FINDING}>").select(evaluate(F.col("f")).alias("e"))
    df.explain(extended=True)
    assert capsys.readouterr().out.split("== Optimized Logical Plan ==")[1].split("== Physical Plan ==")[0].lower().count("element_at") <= 2


def test_decisions(spark):
    rnd, names = random.Random(5), {c[0]: c for c in CATEGORIES}
    row = lambda k, c, tier, x, on: (f"f{k}", k, c, "x", 0, 1, "pattern", "r", 0.9, False, False, x, tier, on, None, [])
    cases = [[row(k, rnd.choice([*names]), rnd.choice(["high", "medium"]), rnd.choice([0.6, 0.9]), rnd.random() < 0.9) for k in range(rnd.randint(0, 9))] for _ in range(60)]
    policy, ranks, grave = Policy(internal="allow", uncertain="warn"), ("allow", "warn", "block"), ("low", "medium", "high", "critical")
    got = spark.createDataFrame(list(enumerate(cases)), f"i int, f array<{FINDING}>").select("i", evaluate(F.col("f"), policy).alias("e")).collect()
    for r in got:
        called = []
        for k, f in enumerate(cases[r["i"]]):
            if f[13]:
                want = ranks.index(getattr(policy, names[f[2]][2]))
                rank = want if f[12] == "high" else min(want, 1)
                if rank:
                    called.append((-grave.index(names[f[2]][3]), -f[11], k, rank, names[f[2]][1].lower()))
        called.sort()
        labels = [c[4] for c in called]
        most = sorted(dict.fromkeys(labels), key=lambda x: -labels.count(x))[:4]
        says = ", ".join(f"{labels.count(x)} {x}{'' if labels.count(x) == 1 else 's'}" for x in most)
        assert (r["e"]["decision"], [d["ord"] for d in r["e"]["drivers"]], r["e"]["summary"]) == (ranks[max((c[3] for c in called), default=0)], [c[2] for c in called], says)


def test_single_words_are_judged_once(monkeypatch):
    recogniser, asked = Recogniser(Vocabulary()), []
    named = recogniser.named
    monkeypatch.setattr(recogniser, "named", lambda text, group, titled: asked.append(group[0].text) or named(text, group, titled))
    found = [p for t in ("a Zorbla here", "Mr Zorbla", "no Zorbla") for p in recogniser.propose(t, False)]
    assert [p[4] for p in found] == [0.3, 0.85, 0.3] and asked == ["Zorbla", "Zorbla"]
