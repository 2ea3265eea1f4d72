"""Records of assessments, without the text, and labels for them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.categories import attribute
from .metrics import newest

LABELS = ("public", "internal", "confidential", "unknown")
MOST_RECORDS = 200


def records(scanned: DataFrame, key: str = "doc_id", text: str = "text", with_sample: bool = False) -> DataFrame:
    """A record for each scanned document: its fingerprint and what the system thought.
    All findings count, enabled or not."""
    count = lambda g: F.size(F.filter("findings", lambda f: attribute(f["category"], "group") == g)).alias(g)
    fingerprint = F.struct(
        F.length(text).alias("chars"), F.struct(*map(count, ("personal", "internal", "confidential", "secret"))).alias("finding_counts"), F.col("document.state").alias("document_state"), F.round("document.confidence", 3).alias("document_confidence"),
        F.col("document.topics").alias("topics"), F.transform("document.signals", lambda s: s["id"]).alias("signal_ids"), F.size(F.filter("findings", lambda f: f["tier"] == "medium")).alias("ambiguous_count"),
        (F.col("escalation.invoked") if "escalation" in scanned.columns else F.lit(False)).alias("escalated"),
    )
    sample = F.col(text) if with_sample else F.lit(None).cast("string")
    return scanned.select(F.concat(F.lit("a"), F.col(key).cast("string")).alias("id"), F.current_timestamp().alias("at"), fingerprint.alias("fingerprint"), F.col("document.state").alias("system_state"), F.lit("unreviewed").alias("user_decision"), F.lit(None).cast("string").alias("label"), sample.alias("sample"))


def labelled(records: DataFrame, labels: DataFrame) -> DataFrame:
    """Records with the labels ``(id, label, decision)``; ids without a record change
    nothing."""
    new = labels.select("id", F.col("label").alias("__label"), F.coalesce("decision", F.lit("overridden")).alias("__decision"))
    out = records.join(new, "id", "left")
    return out.withColumn("user_decision", F.coalesce("__decision", "user_decision")).withColumn("label", F.coalesce("__label", "label")).select(*records.columns)


def bounded(records: DataFrame) -> DataFrame:
    return newest(records, "at", rows=MOST_RECORDS)


def exported(records: DataFrame) -> DataFrame:
    """Records as JSON lines, one each, with the format's version."""
    return records.select(F.to_json(F.struct(F.lit(1).alias("version"), *records.columns)).alias("value"))
