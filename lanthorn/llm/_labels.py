"""Labelled training rows: a bounded sample, the same for the same table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The bound on the rows that a classifier learns from.
MOST_LABELLED = 8000


def bucket(key, parts: int):
    """``crc32`` of the id as text, modulo ``parts``; the rule that holds rows out."""
    return F.crc32(key.cast("string")) % parts


def labelled(docs: DataFrame, labels: DataFrame, label: str, may_learn, key: str = "doc_id", text: str = "text", most: int = MOST_LABELLED) -> DataFrame:
    """``(id, text, label)`` of at most ``most`` documents: those that ``may_learn`` (a
    condition on ``id``) with the smallest hashed ids. Rows without id or label are left
    out. A repeated id counts once, with the largest of its labels and the text of smallest
    hash, so a hot id can't fill the sample."""
    rows = labels.select(F.col("doc_id").cast("long").alias("id"), F.col(label).cast("int").alias("label")).where("id is not null and label is not null").where(may_learn)
    rows = rows.groupBy("id").agg(F.max("label").alias("label"))
    mine = docs.select(docs[key].cast("long").alias("id"), docs[text].alias("text"))
    sample = rows.orderBy(F.xxhash64("id", F.lit(11)), "id").limit(most)
    found = mine.join(F.broadcast(sample), "id")  # at most ``most`` rows
    return found.groupBy("id", "label").agg(F.min_by(F.struct("text"), F.struct(F.xxhash64("text"), "text")).alias("t")).select("id", F.col("t.text").alias("text"), "label")
