"""Checking prompts as they arrive: a stateless scan, counters, and what was cleared."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.categories import attribute
from ..functions.vocab import Vocabulary
from ..operators.confirm import DeepContext, confirmed, needs_confirming
from ..operators.risk import Policy, evaluate, unavailable
from ..operators.sanitize import preview
from ..plans.scan import scan

MOST_CHARS, LEAST_CHARS = 1_000_000, 12


def worth_checking(text: Column) -> Column:
    return F.length(F.trim(text)) >= LEAST_CHARS


MOST_SHOWN = 12


def banner(findings: Column) -> Column:
    """``struct<shown, more>``: the labels of the first dozen findings and how many follow."""
    labels = F.transform(F.slice(findings, 1, MOST_SHOWN), lambda f: attribute(f["category"], "label"))
    return F.struct(labels.alias("shown"), F.greatest(F.size(findings) - MOST_SHOWN, F.lit(0)).alias("more"))


def best_reason(finding: Column) -> Column:
    """Why an unsure finding was kept: the note of its weightiest signal that doesn't speak
    against it, the first of equals; null for a sure one."""
    noted = F.filter(finding["signals"], lambda s: (s["weight"] >= 0) & (s["note"] != ""))
    keyed = F.transform(noted, lambda s, i: F.struct((-s["weight"]).alias("w"), i.alias("i"), s["note"].alias("note")))
    return F.when(finding["tier"] == "medium", F.array_min(keyed)["note"])


def without_overridden(scanned: DataFrame, overrides: DataFrame, key: str = "doc_id") -> DataFrame:
    """Findings that a user switched off, ``(key, id)``, are no longer enabled."""
    off = overrides.groupBy(F.col(key).alias("__key")).agg(F.collect_set("id").alias("__off"))
    none = F.array().cast("array<string>")
    df = scanned.join(off, scanned[key] == F.col("__key"), "left")
    return df.withColumn("findings", F.transform("findings", lambda f: f.withField("enabled", f["enabled"] & ~F.array_contains(F.coalesce("__off", none), f["id"])))).drop("__key", "__off")


def wire_findings(findings: Column) -> Column:
    """What a client is shown of each finding."""
    reason = lambda f: F.try_element_at(F.filter(f["signals"], lambda s: (s["weight"] > 0) & (s["note"] != "")), F.lit(1))["note"]
    return F.transform(findings, lambda f: F.struct(f["id"].alias("id"), f["value"].alias("value"), attribute(f["category"], "label").alias("label"), preview(f, "redact").alias("replacement"), f["tier"].alias("tier"), reason(f).alias("reason")))


def checked(prompts: DataFrame, text: str = "text", policy: Policy = Policy(), vocabulary: Vocabulary = Vocabulary()) -> DataFrame:
    """Prompts with ``decision``, ``headline``, ``summary``, ``wire`` and ``deeper``: whether
    a second look could change the answer. Works on streams and tables alike. A prompt of
    over a million characters is not scanned; the policy says what then happens."""
    too_long = F.length(text) > MOST_CHARS
    df = prompts.withColumn("__prompt", F.col(text)).withColumn(text, F.when(too_long, F.lit(None)).otherwise(F.col(text)))
    df = scan(df, text, vocabulary).withColumn("__outcome", evaluate(F.col("findings"), policy))
    decision, headline, summary = unavailable(policy)
    or_unavailable = lambda c, u: F.when(F.length("__prompt") > MOST_CHARS, u).otherwise(F.col(f"__outcome.{c}"))
    df = df.withColumns({"decision": or_unavailable("decision", decision), "headline": or_unavailable("headline", headline), "summary": or_unavailable("summary", summary), "wire": wire_findings(F.col("findings"))})
    deeper = (F.col("decision") != "allow") & needs_confirming(F.col("findings"), F.col("recoverable"))
    return df.withColumn("deeper", deeper).withColumn(text, F.col("__prompt")).drop("__prompt", "__outcome")


def deep_checked(first: DataFrame, text: str = "text", policy: Policy = Policy(), confirmer: DeepContext | None = None) -> DataFrame:
    """The second stage for the rows that it can change; the others pass as they are. One
    pass: ``first`` is read once."""
    again = confirmed(first, confirmer, text, F.col("deeper")).withColumn("__outcome", evaluate(F.col("findings"), policy))
    new = {c: F.col(f"__outcome.{c}") for c in ("decision", "headline", "summary")} | {"wire": wire_findings(F.col("findings"))}
    return again.withColumns({c: F.when(F.col("deeper"), v).otherwise(F.col(c)) for c, v in new.items()}).select(*first.columns)


def counters(checked: DataFrame, time: str | None = None, every: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Prompts by decision; with a time column, in windows with a watermark."""
    aggregates = [F.count(F.lit(1)).alias("checked"), *(F.count_if(F.col("decision") == d).alias(d) for d in ("allow", "warn", "block")), F.sum(F.size("findings")).alias("findings")]
    if time is None:
        return checked.agg(*aggregates)
    return checked.withWatermark(time, late).groupBy(F.window(time, every)).agg(*aggregates)


def not_cleared(checked: DataFrame, time: str, text: str = "text", remember: str = "1 hour") -> DataFrame:
    """Checked prompts without those whose text was allowed before, within the time
    remembered. What was blocked or warned about is never dropped, however often it is
    sent. The state holds a digest for each allowed text."""
    once = F.when(F.col("decision") == "allow", F.sha2(text, 256)).otherwise(F.expr("uuid()"))
    return checked.withColumn("__once", once).withWatermark(time, remember).dropDuplicatesWithinWatermark(["__once"]).drop("__once")


#: Sites by the end of their host name; what only looks alike matches none.
def site(host: Column, sites: dict[str, str]) -> Column:
    out = F.lit(None).cast("string")
    for suffix, name in sorted(sites.items(), key=lambda s: len(s[0])):
        out = F.when((F.lower(host) == suffix) | F.endswith(F.lower(host), F.lit("." + suffix)), name).otherwise(out)
    return out
