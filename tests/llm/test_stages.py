"""The pipeline's stages: rows kept against the operators' own scores or a plain version,
with nulls, empty and repeated rows, clashing columns and empty tables."""

import random

import corpus_pipeline
import pytest

from lanthorn.llm import quality, toxicity
from lanthorn.llm._words import words

SCHEMA = "doc_id long, text string, id string, label int"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(11)
    plain = lambda k: " ".join(rng.choice("alpha beta gamma delta epsilon zeta eta theta iota".split()) for _ in range(k))
    item = [f"b{i}" for i in range(40)]
    docs, labels = [], []
    for i in range(240):
        text = plain(rng.randint(10, 50))
        if i % 4 == 0:
            text = " ".join(w.upper() + "!!" for w in text.split())
        if i % 3 == 0:
            text += " rotten vile"
        if i % 10 == 5:
            text += " " + " ".join([*item[20:], *item[:20]] if i % 20 == 5 else item[:20])
        docs.append((i, text, f"x{i}", i))
        labels.append((i, int(i % 4 != 0), int(i % 3 == 0)))
    docs += [(1, docs[1][1], "again", 0), (None, docs[2][1], "n", 0), (None, " ".join(item), "n", 0), (500, None, None, None), (501, "", "e", 0), (502, " \n", "e", 0), (503, "word " * 30_000, "long", 0)]
    folder = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, " ".join(item)), (2, None), (3, "too short")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return spark.createDataFrame(docs, SCHEMA).coalesce(2), docs, str(folder), item


def kept(df):
    return sorted((str(r["doc_id"]), str(r["id"]), r["text"] or "") for r in df.collect())


def test_classifier_stages(spark, tables):
    df, docs, folder, _ = tables
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    good = {r["doc_id"] for r in quality.quality_scores(df, quality.train(df, labels)).where("predicted = 1 and doc_id is not null").collect()}
    clean = {r["doc_id"] for r in toxicity.toxicity_scores(df, toxicity.train(df, labels)).where("predicted = 0 and doc_id is not null").collect()}
    for stage, want in ((corpus_pipeline.quality_stage, good), (corpus_pipeline.toxicity_stage, clean)):
        got = stage(spark, df, folder)
        assert got.schema == df.schema
        assert [k for k in kept(got) if k[0] != "None"] == sorted((str(i), str(x), t or "") for i, t, x, _ in docs if i in want)
        assert 0 < len(want) < 240 and stage(spark, df.where("false"), folder).collect() == []


def test_decontamination_stage(spark, tables):
    df, docs, folder, item = tables

    def covered(text):
        """Words of the item that stand in runs of five or more of the text, each once."""
        w = [x.decode() for x in words(text)]
        runs = {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
        return len({k + j for k in range(len(item) - 4) if tuple(item[k : k + 5]) in runs for j in range(5)})

    got = corpus_pipeline.decontamination_stage(spark, df, folder)
    assert got.schema == df.schema
    assert kept(got) == sorted((str(i), str(x), t or "") for i, t, x, _ in docs if covered(t) < 32)
    assert corpus_pipeline.decontamination_stage(spark, df.where("false"), folder).collect() == []


def test_last_stages(spark, tables):
    df, docs, folder, _ = tables
    got = corpus_pipeline.near_dedup_stage(spark, df, folder)
    assert got.schema == df.schema
    ids = [k[0] for k in kept(got)]
    assert ids.count("1") == 1 and {"500", "501", "502", "503"} <= set(ids) and corpus_pipeline.near_dedup_stage(spark, df.where("false"), folder).collect() == []
    assert sum(t == docs[2][1] for _, _, t in kept(got)) == 1
    assert corpus_pipeline.encoding_stage(spark, df, folder).count() == len(docs)
