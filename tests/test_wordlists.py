"""Word lists of a million names, in files that workers map."""

import pickle
import random
import resource

import pytest
from pyspark.sql import functions as F

from lanthorn.functions import wordlists
from lanthorn.functions.vocab import Vocabulary
from lanthorn.operators.entities import entity_candidates
from lanthorn.operators.rules import CANDIDATE


def spelled(i):
    return "zo" + "".join("bcdfghjklm"[int(d)] + "a" for d in str(i))


def million():
    return map(spelled, range(1_000_000))


def test_as_a_set(tmp_path):
    rng = random.Random(1)
    words = ["".join(rng.choice("abcé日😀 ") for _ in range(rng.randint(0, 6))) for _ in range(4000)]
    listed = {wordlists.usual(w) for w in words} - {""}
    path = str(tmp_path / "words")
    assert wordlists.build(words, path) == len(listed)
    got = wordlists.WordList(path)
    assert got == listed and sorted(got) == sorted(listed, key=str.encode) and len(got) == len(listed)
    asked = [*listed, *("".join(rng.choice("abcé日😀 ") for _ in range(rng.randint(0, 8))) for _ in range(4000)), "", None, 3, "\ud800"]
    assert [w in got for w in asked] == [w in listed for w in asked]
    assert not got.isdisjoint(["zzz", next(iter(listed))]) and got.isdisjoint(["zzz"])
    assert wordlists.build([], str(tmp_path / "none")) == 0
    assert len(wordlists.WordList(str(tmp_path / "none"))) == 0 and "x" not in wordlists.WordList(str(tmp_path / "none"))


def test_too_long_a_list(tmp_path, monkeypatch):
    monkeypatch.setattr(wordlists, "MOST_BYTES", 100)
    with pytest.raises(ValueError, match="too large"):
        wordlists.build(["word"] * 3 + ["other"], str(tmp_path / "w"))


def test_a_million_names_in_tasks(spark):
    """Names of the list are found; a task carries a file name and a worker hardly grows."""
    v = Vocabulary.shipped(spark, given_names=million())
    assert len(pickle.dumps(v)) < 20_000 and v.family_names == Vocabulary().family_names
    names = [spelled(k) for k in (0, 777_777, 999_999)] + ["zoba" * 9, "zxqvy"]
    df = spark.createDataFrame([(k, f"Then {n.capitalize()} Qwertzui came.") for k, n in enumerate(names)], "doc_id long, text string").repartition(2)
    none = F.array().cast(f"array<{CANDIDATE}>")
    best = lambda v: [r["b"] or 0 for r in df.select("doc_id", F.array_max(F.transform(entity_candidates(F.col("text"), none, v), lambda c: c["base"])).alias("b")).orderBy("doc_id").collect()]
    with_list, without = best(v), best(Vocabulary())
    assert [x > y for x, y in zip(with_list, without, strict=True)] == [True, True, True, False, False]

    def grown(batches):
        import pyarrow as pa

        before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
        for batch in batches:
            hits = sum(w in v.given_names for w in batch.column(0).to_pylist())
            yield pa.RecordBatch.from_pydict({"hits": [hits], "kb": [resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before]})

    rows = spark.range(2000).select(F.concat(F.lit("zobaq"), F.col("id")).alias("w")).union(spark.createDataFrame([(spelled(5),)], "w string")).coalesce(2).mapInArrow(grown, "hits long, kb long").collect()
    assert sum(r["hits"] for r in rows) == 1 and max(r["kb"] for r in rows) < 64 << 10
