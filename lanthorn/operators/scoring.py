"""Confidence: base score plus signed signals, then agreement within the document."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.dialect import let

HIGH, MEDIUM = 0.8, 0.55
# Categories with signals of their own.
OWN_SIGNALS = ("URL", "REFERENCE_ID", "PROJECT_CODE", "RELEASE_PLAN", "PRICING_TERM")
SIGNAL = "struct<id:string,weight:double,note:string>"
SCORED = "struct<ord:int,category:string,value:string,start:int,end:int,layer:string,rule:string,base:double,unresolved:boolean,single:boolean,confidence:double,tier:string,signals:array<struct<id:string,weight:double,note:string>>>"


def tier(confidence: Column) -> Column:
    return F.when(confidence >= HIGH, "high").when(confidence >= MEDIUM, "medium").otherwise("low")


def clamp(x: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))


def signal(id: str, weight: float, note: Column | str) -> Column:
    return F.struct(F.lit(id).alias("id"), F.lit(weight).alias("weight"), (F.lit(note) if isinstance(note, str) else note).alias("note")).cast(SIGNAL)


def weights(signals: Column) -> Column:
    """The sum of the weights, added from left to right."""
    return F.aggregate(signals, F.lit(0.0), lambda total, s: total + s["weight"])


def no_signals() -> Column:
    return F.array().cast(f"array<{SIGNAL}>")


def link_signals(value: Column) -> Column:
    """Whether a link carries something that identifies: a query, a fragment, or a long
    path segment of letters and digits."""
    segments = F.slice(F.split(value, "/"), 4, 1 << 20)
    carries = F.contains(value, F.lit("?")) | F.contains(value, F.lit("#")) | F.exists(segments, lambda s: (F.length(s) >= 20) & s.rlike("[0-9]") & s.rlike("[A-Za-z]"))
    return F.array(F.when(carries, signal("link-carries-data", 0.05, "The link carries parameters that may identify someone")).otherwise(signal("public-link", -0.45, "An ordinary public web link with nothing identifying in it")))


def reference_signals(value: Column) -> Column:
    year = signal("year-like", -0.3, "The number looks like a year, so this is probably a period rather than a reference")
    return F.when(value.rlike("-(?:19|20)[0-9]{2}$"), F.array(year)).otherwise(no_signals())


def with_signals(c: Column, document_state: Column) -> Column:
    """A candidate's signals and those of its own category."""
    own = F.when(c["category"] == "URL", link_signals(c["value"])).when(c["category"] == "REFERENCE_ID", reference_signals(c["value"])).otherwise(no_signals())
    inside = c["category"].isin("PROJECT_CODE", "RELEASE_PLAN", "PRICING_TERM") & (document_state != "general")
    internal = F.when(inside, F.array(signal("document-internal", 0.1, "The surrounding document already reads as internal"))).otherwise(no_signals())
    # Most candidates have none of their own; joining arrays takes longer than asking.
    return F.when(c["category"].isin(*OWN_SIGNALS), F.concat(c["signals"], own, internal)).otherwise(c["signals"])


def _key(c: Column) -> Column:
    return F.concat(c["category"], F.lit("::"), F.lower(c["value"]))


def _row(c: Column, ord: Column, confidence: Column, signals: Column) -> Column:
    same = [c[f].alias(f) for f in ("category", "value", "start", "end", "layer", "rule", "base", "unresolved", "single")]
    return F.struct(ord.alias("ord"), *same, confidence.alias("confidence"), tier(confidence).alias("tier"), signals.alias("signals")).cast(SCORED)


def score(candidates: Column, document_state: Column) -> Column:
    """``array<scored>``: every candidate with its place in the order, confidence, tier
    and signals. A value that is certain once lifts its uncertain mentions by 0.15."""

    def first(c: Column, i: Column) -> Column:
        return let(with_signals(c, document_state), lambda s: let(clamp(c["base"] + weights(s)), lambda x: _row(c, i.cast("int"), x, s)))

    def lift(scored: Column) -> Column:
        certain = F.array_distinct(F.transform(F.filter(scored, lambda c: c["confidence"] >= HIGH), _key))
        agree = signal("consistent-mention", 0.15, "The same value is clearly sensitive elsewhere in this content")
        return let(certain, lambda known: F.transform(scored, lambda c: F.when((c["confidence"] < HIGH) & F.array_contains(known, _key(c)), _row(c, c["ord"], clamp(c["confidence"] + 0.15), F.array_append(c["signals"], agree))).otherwise(c)))

    return let(F.transform(candidates, first), lift)
