"""Risk scores and policy decisions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.categories import CATEGORIES, SEVERITIES, SEVERITY_WEIGHT
from ..functions.dialect import let

DECISIONS = ("allow", "warn", "block")


def _kinds() -> Column:
    """What counts of each category, to be looked up once for a finding."""
    of = lambda c: F.struct(F.lit(SEVERITY_WEIGHT[c[3]]).alias("weight"), F.lit(c[3] == "critical").alias("critical"), F.lit(c[2]).alias("group"))
    return F.create_map(*(x for c in CATEGORIES for x in (F.lit(c[0]), of(c))))


def active(findings: Column) -> Column:
    return F.filter(findings, lambda f: f["enabled"])


def risk(findings: Column) -> Column:
    """``struct<score, level, counts>`` of the enabled findings; severities weigh in by
    confidence on a curve that flattens towards 100."""

    def of(rows: Column) -> Column:
        total = F.aggregate(rows, F.lit(0.0), lambda t, f: t + f["weight"])
        score = let(total, lambda t: F.when(t == 0, 0).otherwise(F.floor(100 * (1 - F.exp(-t / 60)) + 0.5)).cast("int"))
        critical = F.exists(rows, lambda f: f["critical"])
        level = lambda s: F.when((s >= 60) | critical, "high").when(s >= 25, "moderate").when(s > 0, "low").otherwise("safe")
        count = lambda g: F.size(F.filter(rows, lambda f: f["group"] == g))
        counts = F.struct(*(count(g).alias(g) for g in ("personal", "internal", "confidential", "secret")), F.size(rows).alias("total"))
        return let(score, lambda s: F.struct(s.alias("score"), level(s).alias("level"), counts.alias("counts")))

    weighed = lambda f: let(F.try_element_at(_kinds(), f["category"]), lambda k: F.struct((k["weight"] * f["confidence"]).alias("weight"), k["critical"].alias("critical"), k["group"].alias("group")))
    return let(F.transform(active(findings), weighed), of)


@dataclass(frozen=True)
class Policy:
    """What to do about each group; what an unsure finding can bring about at most; and
    what to do when nothing could be checked."""

    secret: str = "block"
    personal: str = "warn"
    confidential: str = "warn"
    internal: str = "warn"
    uncertain: str = "warn"
    unavailable: str = "warn"

    def rank(self, field: str) -> int:
        return DECISIONS.index(getattr(self, field))


OBSERVE_ONLY = Policy("warn", "allow", "allow", "allow", "allow", "allow")


def _calling(findings: Column, policy: Policy) -> Column:
    """What calls for more than allowing, gravest first, then surest: its rank, label, and the
    finding. What counts of its category is looked up once."""
    of = lambda c: F.struct(F.lit(policy.rank(c[2])).alias("rank"), F.lit(SEVERITIES.index(c[3])).alias("severity"), F.lit(c[1].lower()).alias("label"))
    kinds = F.create_map(*(x for c in CATEGORIES for x in (F.lit(c[0]), of(c))))

    def one(f: Column, i: Column) -> Column:
        rank = lambda k: F.when(f["tier"] == "high", k["rank"]).otherwise(F.least(k["rank"], F.lit(policy.rank("uncertain"))))
        return let(F.try_element_at(kinds, f["category"]), lambda k: F.struct((-k["severity"]).alias("s"), (-f["confidence"]).alias("x"), i.alias("i"), rank(k).alias("rank"), k["label"].alias("label"), f.alias("f")))

    calls = lambda rows: F.filter(F.transform(rows, one), lambda k: k["rank"] > 0)
    return F.array_sort(let(active(findings), calls))


def drivers(findings: Column, policy: Policy) -> Column:
    """The findings that call for more than allowing, gravest first, then surest."""
    return F.transform(_calling(findings, policy), lambda k: k["f"])


def _summed_up(labels: Column) -> Column:
    """Up to four kinds with their counts, most first; ties by first appearance."""

    def of(all: Column) -> Column:
        counted = F.transform(F.array_distinct(all), lambda x, i: F.struct(F.when(x.isNull(), 0).otherwise(F.size(F.array_remove(all, x)) - F.size(all)).alias("n"), i.alias("i"), x.alias("x")))
        text = lambda k: F.concat((-k["n"]).cast("string"), F.lit(" "), k["x"], F.when(k["n"] == -1, "").otherwise("s"))
        return F.array_join(F.transform(F.slice(F.array_sort(counted), 1, 4), text), ", ")

    return let(labels, of)


def evaluate(findings: Column, policy: Policy = Policy()) -> Column:
    """``struct<decision, headline, drivers, summary>``."""

    def of(found: Column) -> Column:
        rank = F.coalesce(F.array_max(F.transform(found, lambda k: k["rank"])), F.lit(0))
        outcome = lambda rank: F.struct(
            F.try_element_at(F.array(*map(F.lit, DECISIONS)), rank + 1).alias("decision"),
            F.when(rank == 2, "Sensitive information detected").when(rank == 1, "Check this before sending").otherwise("Nothing sensitive found").alias("headline"),
            F.transform(found, lambda k: k["f"]).alias("drivers"), _summed_up(F.transform(found, lambda k: k["label"])).alias("summary"),
        )
        return let(rank, outcome)

    return let(_calling(findings, policy), of)


def unavailable(policy: Policy = Policy()) -> tuple[str, str, str]:
    """Decision, headline and summary where nothing could be checked."""
    return policy.unavailable, "Could not check this content", "the checker did not respond"
