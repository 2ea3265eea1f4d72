"""From scored candidates to findings: filters, overlaps, and what was left out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.categories import attribute
from ..functions.dialect import FEW, folded, let
from .scoring import SCORED

MOST_RECOVERABLE, RECOVERABLE_FLOOR, MOST_DECLINED = 12, 0.15, 500
FINDING = SCORED.replace("struct<ord", "struct<id:string,ord", 1).replace("tier:string", "tier:string,enabled:boolean,confirmed_by:string")


def usable(c: Column, delimiter: Column | None = None) -> Column:
    """Values that lie on one line (keys may not) and in one cell."""
    ok = (c["category"] == "PRIVATE_KEY") | ~c["value"].rlike("[\r\n]")
    if delimiter is None:
        return ok
    return ok & F.coalesce(~F.contains(c["value"], delimiter) | (delimiter == ""), F.lit(True))


# A candidate's place among the others; strings stay where they are, since sorts and folds copy.
SPAN = "struct<start:int,ord:int,end:int,at:int>"


def _of(scored: Column, span: Column) -> Column:
    return F.element_at(scored, span["at"] + 1)


def by_rank(scored: Column, spans: Column) -> Column:
    """Higher priority first, then longer, then surer, then earlier in the order."""
    key = lambda s, c: F.struct((-attribute(c["category"], "priority")).alias("p"), (s["start"] - s["end"]).alias("l"), (-c["confidence"]).alias("x"), s["ord"].alias("o"), s.alias("s"))
    return F.transform(F.array_sort(F.transform(spans, lambda s: let(_of(scored, s), lambda c: key(s, c)))), lambda k: k["s"])


def by_start(scored: Column) -> Column:
    """The candidates by start. They are computed once, since each span asks for its own."""
    return let(scored, lambda rows: F.transform(spans_by_start(rows), lambda s: _of(rows, s)))


def spans_by_start(scored: Column) -> Column:
    """The spans of the candidates."""
    return F.array_sort(F.transform(scored, lambda c, i: F.struct(c["start"].alias("start"), c["ord"].alias("ord"), c["end"].alias("end"), i.alias("at")).cast(SPAN)))


def _upto(spans: Column) -> Column:
    """For each span, by start, where it and all before it end."""
    few = F.aggregate(spans, F.array().cast("array<int>"), lambda ends, c: F.array_append(ends, F.greatest(c["end"], F.try_element_at(ends, F.lit(-1)))))
    further = lambda end, c: let(F.greatest(end, c["end"]), lambda x: F.struct(x.alias("state"), F.array(x).alias("out")))
    return F.when(F.size(spans) <= FEW, few).otherwise(folded(spans, F.lit(-1), "array<int>", further)["out"])


def _touching(spans: Column) -> Column:
    """Spans, by start, in groups that touch each other; those of different groups
    don't clash. Each group ends where the next span starts after all before."""

    def of(spans: Column, upto: Column) -> Column:
        n = F.size(spans)
        begins = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (F.element_at(spans, i + 1)["start"] >= F.element_at(upto, F.greatest(i, F.lit(1)))))
        some = lambda b, end: F.when(end == b + 1, F.array(F.element_at(spans, b + 1))).otherwise(F.transform(F.sequence(b + 1, end), lambda i: F.element_at(spans, i)))
        return let(begins, lambda at: F.transform(at, lambda b, k: some(b, F.coalesce(F.try_element_at(at, k + 2), n))))

    none = F.array().cast(f"array<array<{SPAN}>>")
    return let(spans, lambda spans: F.when(F.size(spans) == 0, none).otherwise(let(_upto(spans), lambda upto: of(spans, upto))))


def without_overlaps(scored: Column) -> Column:
    """The spans of what stays, by start: the first of each clash, in order of rank. Only what
    touches is compared."""
    none = F.array().cast(f"array<{SPAN}>")

    def take(kept: Column, c: Column) -> Column:
        clash = F.exists(kept, lambda k: (k["start"] < c["end"]) & (c["start"] < k["end"]))
        return F.when(clash, kept).otherwise(F.array_append(kept, c))

    settle = lambda group: F.when(F.size(group) < 2, group).otherwise(F.aggregate(by_rank(scored, group), none, take))
    return F.array_sort(F.flatten(F.transform(_touching(spans_by_start(scored)), settle)))


def numbered(scored: Column, spans: Column, prefix: str) -> Column:
    """Findings of the spans, named by their place."""
    fields = ("ord", "category", "value", "start", "end", "layer", "rule", "base", "unresolved", "single", "confidence", "tier")
    row = lambda c, i: F.struct(F.concat(F.lit(prefix), i.cast("string")).alias("id"), *(c[f].alias(f) for f in fields), F.lit(True).alias("enabled"), F.lit(None).cast("string").alias("confirmed_by"), c["signals"].alias("signals")).cast(FINDING)
    return F.transform(spans, lambda s, i: let(_of(scored, s), lambda c: row(c, i)))


def findings(scored: Column, delimiter: Column | None = None) -> Column:
    believable = F.filter(scored, lambda c: (c["tier"] != "low") & usable(c, delimiter))
    return let(believable, lambda rows: numbered(rows, without_overlaps(rows), "f"))


def recoverable(scored: Column, found: Column, delimiter: Column | None = None) -> Column:
    """The dozen likeliest names that no list knows, outside the findings."""

    def wanted(c: Column) -> Column:
        covered = F.exists(found, lambda f: (f["start"] <= c["start"]) & (c["start"] < f["end"]))
        return (c["tier"] == "low") & c["unresolved"] & (c["confidence"] >= RECOVERABLE_FLOOR) & usable(c, delimiter) & ~covered

    keyed = lambda rows: F.array_sort(F.transform(rows, lambda c, i: F.struct((-c["confidence"]).alias("x"), c["ord"].alias("o"), i.alias("at"))))
    return let(F.filter(scored, wanted), lambda rows: numbered(rows, F.slice(keyed(rows), 1, MOST_RECOVERABLE), "r"))


def declined(scored: Column, offered: Column, delimiter: Column | None = None) -> Column:
    """Spans that were turned down and not offered again, in the order of the candidates."""

    def wanted(c: Column) -> Column:
        again = F.exists(offered, lambda o: (o["start"] == c["start"]) & (o["end"] == c["end"]))
        return (c["tier"] == "low") & usable(c, delimiter) & ~again

    return F.slice(F.transform(F.filter(scored, wanted), lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"))), 1, MOST_DECLINED)


