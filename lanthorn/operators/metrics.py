"""Scores over corpora, percentiles, groups and differences of findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.categories import attribute
from ..functions.dialect import cut_between, let
from .sanitize import apart


def by_value(findings: DataFrame, key: str = "doc_id") -> DataFrame:
    """A row for each value of a category in a document: mentions, first place, best
    confidence."""
    return findings.groupBy(key, "category", F.lower("value").alias("value")).agg(F.count(F.lit(1)).alias("mentions"), F.min("start").alias("first_start"), F.max("confidence").alias("confidence"))


def by_group(findings: DataFrame, key: str = "doc_id") -> DataFrame:
    """Findings and the best confidence of each group in a document."""
    return findings.groupBy(key, attribute(F.col("category"), "group").alias("group")).agg(F.count(F.lit(1)).alias("n"), F.max("confidence").alias("confidence"))


def strongest_mentions(findings: DataFrame, key: str = "doc_id") -> DataFrame:
    """The surest mention of each value in a document, the first of equals."""
    w = Window.partitionBy(key, F.lower("value")).orderBy(F.desc("confidence"), "start")
    return findings.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def confusion(truth: Column, predicted: Column) -> list[Column]:
    """Aggregates: counts, precision, recall and F1; zero where nothing was counted."""
    hit, extra, missed = F.count_if(truth & predicted), F.count_if(~truth & predicted), F.count_if(truth & ~predicted)
    ratio = lambda a, b: a / F.greatest(b, F.lit(1))
    return [hit.alias("true_positives"), extra.alias("false_positives"), missed.alias("false_negatives"), ratio(hit, hit + extra).alias("precision"), ratio(hit, hit + missed).alias("recall"), ratio(2 * hit, 2 * hit + extra + missed).alias("f1")]


def accuracy(truth: Column, predicted: Column, ranked: Column) -> list[Column]:
    """Aggregates: rows, the share whose prediction is right, and the share whose truth is
    among the ``ranked`` ones. A null truth means that nothing should be predicted."""
    share = lambda c: F.avg(F.coalesce(c, F.lit(False)).cast("int"))
    nothing = truth.isNull() & (ranked.isNull() | (F.size(ranked) == 0))
    return [F.count(F.lit(1)).alias("n"), share(truth.eqNullSafe(predicted)).alias("exact"), share(nothing | F.array_contains(ranked, truth)).alias("within")]


def timing(df: DataFrame, value: str, *by: str) -> DataFrame:
    """Median, fastest and mean of each group."""
    return df.groupBy(*by).agg(F.median(value).alias("median"), F.min(value).alias("fastest"), F.avg(value).alias("mean"))


#: Parts of a group that the sketch of its percentiles tells apart.
ACCURACY = 10_000


def ranked_percentile(df: DataFrame, value: str, percents: list[int], *by: str) -> DataFrame:
    """The value at place ``floor(p / 100 * n)`` of the sorted values, without
    interpolation; nulls have no place.

    A mergeable sketch bounds each percentile, all tasks count what lies below the bounds,
    and only the values between them, some thousandths of a group, are put in order: no
    task gets a group. The result is exact; should a sketch break its own bound, the query
    fails."""
    rows = df.where(F.col(value).isNotNull()).select(*by, F.col(value).alias("__v"))
    wide = lambda p, way: min(1.0, max(0.0, p / 100 + way * 4 / ACCURACY))
    ends = F.array(*(F.lit(wide(p, way)) for p in percents for way in (-1, 1)))
    sketch = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("__all"), F.min("__v").alias("__min"), F.max("__v").alias("__max"), F.percentile_approx("__v", ends, F.lit(ACCURACY)).alias("__ends"))
    low = lambda k: F.lit(wide(percents[k], -1) > 0).cast("int")
    end = lambda k, way: F.element_at("__ends", 2 * k + 1 + way)
    bounds = [F.struct(F.lit(p).alias("p"), F.when(low(k) == 1, end(k, 0)).otherwise(F.col("__min")).alias("low"), (end(k, 1) if wide(p, 1) < 1 else F.col("__max")).alias("high"), F.least(F.col("__all") - 1, F.floor(F.lit(p / 100) * F.col("__all"))).alias("place")) for k, p in enumerate(percents)]
    sketch = sketch.select(*(F.col(c).alias(f"__by_{i}") for i, c in enumerate(by)), F.array(*bounds).alias("__bounds"))
    same = [F.col(c).eqNullSafe(F.col(f"__by_{i}")) for i, c in enumerate(by)]
    met = rows.join(sketch, same) if by else rows.crossJoin(sketch)  # a single row
    each = met.select(*by, "__v", F.explode("__bounds").alias("b")).where(F.col("__v") <= F.col("b.high"))
    # What lies below is one row a percentile and task, what lies between one a value.
    near = F.when(F.col("__v") >= F.col("b.low"), F.col("__v"))
    counted = each.groupBy(*by, "b.p", "b.place", near.alias("__near")).agg(F.count(F.lit(1)).alias("__n"))
    w = Window.partitionBy(*by, "p").orderBy(F.asc_nulls_first("__near"))
    run = counted.withColumn("__upto", F.sum("__n").over(w))
    here = (F.col("__upto") > F.col("place")) & (F.col("__upto") - F.col("__n") <= F.col("place"))
    found = run.where(here).select(*by, "p", F.when(F.col("__near").isNull(), F.raise_error(F.lit("a percentile lies outside its sketch's bounds"))).otherwise(F.col("__near")).alias("__v"))
    return found.groupBy(*by).agg(*(F.max(F.when(F.col("p") == p, F.col("__v"))).alias(f"p{p}") for p in percents))


#: Rows of a key that a task orders, about, and ranges that a table is ordered in at most.
PART_ROWS, MOST_PARTS = 100_000, 256


def _range(value: Column, bounds: list, first: int = 0) -> Column:
    """How many of the sorted bounds lie below the value, by halving."""
    if not bounds:
        return F.lit(first)
    mid = len(bounds) // 2
    return F.when(value > F.lit(bounds[mid]), _range(value, bounds[mid + 1 :], first + mid + 1)).otherwise(_range(value, bounds[:mid], first))


def rolling(df: DataFrame, value: str, order: str, *by: str, rows: int = 200, part_rows: int = PART_ROWS) -> DataFrame:
    """The mean and count of the last ``rows`` values up to each row, by ``order``, whose
    equal values have no order among them; a null comes first.

    No task orders a key: ranges of ``order`` (bounds from a sketch) are counted and numbered,
    which gives each row its place, and places are then taken in stretches of ``part_rows``,
    each with the ``rows - 1`` before it. Ranges are at most ``MOST_PARTS``; rows of one key
    with the same ``order`` stay in one."""
    n, part = df.count(), max(part_rows, rows)
    parts = min(MOST_PARTS, -(-n // part))
    shares = F.array(*(F.lit(k / parts) for k in range(1, parts)))
    bounds = sorted(set(df.agg(F.percentile_approx(order, shares, F.lit(10 * MOST_PARTS))).first()[0] or [])) if parts > 1 else []
    ranged = df.withColumn("__range", F.when(F.col(order).isNull(), 0).otherwise(_range(F.col(order), bounds)))
    held = ranged.groupBy(*by, "__range").agg(F.count(F.lit(1)).alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row a range
    held = held.select(*(F.col(c).alias(f"__by_{i}") for i, c in enumerate(by)), F.col("__range").alias("__of"), before.alias("__before"))
    same = [F.col("__range") == F.col("__of"), *(F.col(c).eqNullSafe(F.col(f"__by_{i}")) for i, c in enumerate(by))]
    place = F.col("__before") + F.row_number().over(Window.partitionBy(*by, "__range").orderBy(order)) - 1
    placed = ranged.join(held, same).withColumn("__place", place).withColumn("__own", F.floor(F.col("__place") / part))
    also = F.when(F.col("__place") % part > part - rows, F.array("__own", F.col("__own") + 1)).otherwise(F.array("__own"))
    w = Window.partitionBy(*by, "__part").orderBy("__place").rowsBetween(1 - rows, 0)
    found = placed.withColumn("__part", F.explode(also)).withColumn("rolling_mean", F.avg(value).over(w)).withColumn("rolling_n", F.count(value).over(w))
    return found.where("__part = __own").select(*df.columns, "rolling_mean", "rolling_n")


def newest(df: DataFrame, order: str, *by: str, rows: int = 200) -> DataFrame:
    """The last ``rows`` rows of each key. Without a key every task keeps its last ones and
    no task sorts the table."""
    if not by:
        return df.orderBy(F.desc(order)).limit(rows)
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(order)))).where(F.col("__n") <= rows).drop("__n")


def delta_of(rows: DataFrame, before: Column, after: Column, key: str = "doc_id") -> DataFrame:
    """How many findings a second scan withdrew and added, by place and value, where a row says
    whether it is of the first scan and of the second. The rows are made once and not joined."""
    n = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    held = rows.groupBy(key, "start", "value").agg(n(before).alias("__before"), n(after).alias("__after"))
    # What has no place or no value equals nothing.
    alone = lambda other: (F.col(other) == 0) | F.col(key).isNull() | F.col("start").isNull() | F.col("value").isNull()
    only = lambda mine, other: F.sum(F.when(alone(other), F.col(mine)).otherwise(F.lit(0)))
    return held.groupBy(key).agg(only("__before", "__after").alias("withdrawn"), only("__after", "__before").alias("added")).where("withdrawn > 0 or added > 0")


def delta(before: DataFrame, after: DataFrame, key: str = "doc_id") -> DataFrame:
    """How many findings a second scan withdrew and added, by place and value."""
    of = lambda df, first: df.select(key, "start", "value", F.lit(first).alias("__first"))
    return delta_of(of(before, True).unionAll(of(after, False)), F.col("__first"), ~F.col("__first"), key)


def corpus_score(found: DataFrame, expected: DataFrame, rejected: DataFrame, key: str = "doc_id") -> DataFrame:
    """Against texts with values that must be found (``value``, ``category`` or null) and
    values that must not: one row of counts, recall and trap resistance. A found value
    counts if it equals or holds the other."""
    f = found.select(key, F.col("value").alias("__found"), F.col("category").alias("__category")).distinct()
    held = F.contains(F.col("__found"), F.col("value"))
    right = F.col("category").isNull() | (F.col("category") == F.col("__category"))
    hit = expected.join(f, key).where(held & right).select(key, "value").distinct()
    trap = rejected.join(f, key).where(held).select(key, "value").distinct()
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    one = count(expected, "expected").crossJoin(count(hit, "found")).crossJoin(count(rejected, "traps")).crossJoin(count(trap, "sprung"))  # four single rows
    ratio = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    return one.withColumn("recall", ratio("found", "expected")).withColumn("trap_resistance", 1 - ratio("sprung", "traps"))


def highlights(text: Column, findings: Column) -> Column:
    """``array<struct<text, finding>>``: the text in parts, plain ones with a null finding;
    a finding that starts inside the one before is passed over. The findings are in order."""
    make = lambda t, i: F.struct(t.alias("text"), i.cast("string").alias("finding"))
    kept = lambda parts: F.filter(parts, lambda p: p["finding"].isNotNull() | (p["text"] != ""))

    def of(found: Column) -> Column:
        parts = cut_between(text, found, lambda gap, inside, i: F.array(make(gap, F.lit(None)), make(inside, F.element_at(found, i + 1)["id"])))
        end = F.when(F.size(found) > 0, F.element_at(found, -1)["end"]).otherwise(0)
        return kept(F.concat(parts, F.array(make(F.substring(text, end + 1, F.length(text)), F.lit(None)))))

    return let(apart(findings), of)
