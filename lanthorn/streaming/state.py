"""What a stream remembers between batches: latencies and counts, and texts that need no
second question. Both are keyed states in RocksDB, checkpointed with the stream.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _state_store(spark: SparkSession) -> None:
    """Lists and timers need a store with column families; it is a setting of the session.
    The session's stream manager starts what keeps track of stores, which tables need too."""
    _ = spark.streams
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


#: Latencies that a key remembers, and the percentiles shown of them.
REMEMBERED, PERCENTS = 200, (50, 95, 99)
COUNTERS = ("checked", "allow", "warn", "block", "escalations", "sanitized")

_SAMPLE = "struct<at:bigint,id:bigint,ms:double>"
_PARTIAL = f"key string, counts array<bigint>, newest array<{_SAMPLE}>"
METRICS = ", ".join(["key string", *(f"{c} bigint" for c in COUNTERS), "samples int", *(f"p{p} double" for p in PERCENTS)])

_METRICS_ROW, _OUTCOME_ROW = Row("key", *COUNTERS, "samples", *(f"p{p}" for p in PERCENTS)), Row("user", "at", "id", "action", "outcome")


def at_percent(ordered: list[float], percent: float) -> float | None:
    """The value at place ``floor(percent / 100 * n)`` of the sorted values, the last at
    most; null for none."""
    return ordered[min(len(ordered) - 1, percent * len(ordered) // 100)] if ordered else None


def _partials(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row a key of each batch: its counts and newest latencies. What is shuffled to the
    state doesn't grow with a key's rows."""
    schema = pa.schema([("key", pa.string()), ("counts", pa.list_(pa.int64())), ("newest", pa.list_(pa.struct([("at", pa.int64()), ("id", pa.int64()), ("ms", pa.float64())])))])
    for batch in batches:
        held: dict[str, tuple[list[int], list[tuple]]] = {}
        columns = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("key", "at", "id", "ms", "marks")]
        for key, at, i, ms, marks in zip(*columns, strict=True):
            counts, newest = held.setdefault(key, ([0] * len(COUNTERS), []))
            for k, n in enumerate(marks):
                counts[k] += n
            if at is not None and i is not None and ms is not None:
                (heapq.heappush if len(newest) < REMEMBERED else heapq.heappushpop)(newest, (at, i, ms))
        rows = [{"key": k, "counts": c, "newest": [{"at": a, "id": i, "ms": m} for a, i, m in n]} for k, (c, n) in held.items()]
        yield pa.RecordBatch.from_pylist(rows, schema)


class Latencies(StatefulProcessor):
    """Counts of all rows of a key and the latest ``REMEMBERED`` latencies by time and id."""

    def __init__(self, forget_ms: int | None):
        self.forget_ms = forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.counts = handle.getValueState("counts", ", ".join(f"{c} bigint" for c in COUNTERS), self.forget_ms)
        self.newest = handle.getListState("newest", "at bigint, id bigint, ms double", self.forget_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802
        counts = list(self.counts.get() or []) or [0] * len(COUNTERS)
        newest = [tuple(x) for x in self.newest.get()]
        heapq.heapify(newest)
        for row in rows:
            counts = [a + b for a, b in zip(counts, row["counts"], strict=True)]
            for x in row["newest"]:
                (heapq.heappush if len(newest) < REMEMBERED else heapq.heappushpop)(newest, (x["at"], x["id"], x["ms"]))
        self.counts.update(tuple(counts))
        if newest:
            self.newest.put(sorted(newest))
        ordered = sorted(ms for _, _, ms in newest)
        yield _METRICS_ROW(*key, *counts, len(ordered), *(at_percent(ordered, p) for p in PERCENTS))

    def close(self) -> None:
        pass


def latency_metrics(checks: DataFrame, key: Column, at: str, id: str, ms: str, decision: Column | None = None, escalated: Column | None = None, sanitized: Column | None = None, forget: int | None = None) -> DataFrame:
    """``METRICS`` of each key after each batch that has rows of it: how many were checked,
    by decision, escalated and sanitised, and P50, P95 and P99 of the last 200 latencies.

    The latest are those of the latest ``at``, equal ones by ``id``, so the result doesn't
    depend on how rows are dealt to batches. Rows without time, id or latency are counted
    but give no latency; a null key is a key of its own, ``''``. A row that comes again is
    counted again. ``forget``: milliseconds after which a key without rows is forgotten; the
    stream then has batches without rows too, so it needs a trigger that goes on.
    On a table the same plan gives one row a key."""
    _state_store(checks.sparkSession)
    one = lambda c: F.coalesce(c.cast("int"), F.lit(0)).cast("bigint")
    chosen = F.lit(None).cast("string") if decision is None else decision
    marks = [F.lit(1).cast("bigint"), *(one(chosen == d) for d in ("allow", "warn", "block")), *(one(F.lit(False) if c is None else c) for c in (escalated, sanitized))]
    rows = checks.select(F.coalesce(key.cast("string"), F.lit("")).alias("key"), F.unix_micros(F.col(at).cast("timestamp")).alias("at"), F.col(id).cast("bigint").alias("id"), F.col(ms).cast("double").alias("ms"), F.array(*marks).alias("marks"))
    return rows.mapInArrow(_partials, _PARTIAL).groupBy("key").transformWithState(Latencies(forget), METRICS, "Update", "None" if forget is None else "ProcessingTime")


#: Cleared texts that a user's state holds before it starts afresh.
MOST_APPROVED = 50
LEAST_CHARS = 12
OUTCOMES = "user string, at bigint, id bigint, action string, outcome string"


class Approvals(StatefulProcessor):
    """The texts that a user may send without being asked, as digests."""

    def __init__(self, idle_ms: int | None):
        self.idle_ms = idle_ms  # None: no timers, as on a table

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.approved = handle.getMapState("approved", "digest string", "n int")
        self.overridden = handle.getValueState("overridden", "digest string")
        self.until = handle.getValueState("until", "ms bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802
        held = {k[0] for k in self.approved.keys()}  # noqa: SIM118  at most MOST_APPROVED + 1
        before = set(held)
        overridden = self.overridden.get()[0] if self.overridden.exists() else None
        afresh, latest = False, 0

        def approve(digest: str) -> None:
            nonlocal held, afresh
            if len(held) > MOST_APPROVED:
                held, afresh = set(), True
            held.add(digest)

        for at, i, action, decision, digest in sorted((r["micros"], r["id"], r["action"], r["decision"] or "", r["digest"] or "") for r in rows):
            latest = max(latest, at // 1000)
            if action == "send_anyway":
                overridden, outcome = digest, "sent anyway"
                approve(digest)
            elif action == "cleaned":
                approve(digest)
                outcome = "cleaned"
            elif not digest:
                outcome = "short"
            elif digest in held or digest == overridden:
                outcome = "cleared before"
            elif decision == "allow":
                approve(digest)
                outcome = "allowed"
            else:
                outcome = "held"
            yield _OUTCOME_ROW(*key, at, i, action, outcome)
        if afresh:
            self.approved.clear()
            before = set()
        for digest in held - before:
            self.approved.updateValue((digest,), (1,))
        if overridden is not None:
            self.overridden.update((overridden,))
        if self.idle_ms is None:
            return
        was = self.until.get()[0] if self.until.exists() else None
        until = max(was or 0, latest + self.idle_ms, timerValues.getCurrentWatermarkInMs() + 1)
        if until != was:
            if was is not None:
                self.handle.deleteTimer(was)
            self.handle.registerTimer(until)
            self.until.update((until,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802
        self.approved.clear()
        self.overridden.clear()
        self.until.clear()
        yield from ()

    def close(self) -> None:
        pass


def approvals(prompts: DataFrame, user: str, at: str, id: str, text: str, action: str, decision: str, late: str = "10 minutes", idle_hours: float = 12.0) -> DataFrame:
    """``(user, at, id, action, outcome)``: for each prompt of a user whether they must be asked. In order of time
    and id: a text of fewer than twelve characters is ``short``; one that was allowed,
    cleaned or sent anyway before is ``cleared before``; an allowed one is remembered; the
    rest is ``held``, each time it comes. ``action`` is ``submit``, ``send_anyway`` (the user
    sends what was held) or ``cleaned`` (``text`` is what cleaning left). A user's state
    holds the digests of at most 51 texts: the next one starts it afresh, but what was sent
    anyway last stays known. It goes after ``idle_hours`` of the stream's time without
    prompts.

    Rows of a batch are ordered in it; rows later than the watermark are dropped by Spark.
    Rows without time, id or user are left out, a null text is short, a repeated row is
    judged again. A batch's rows of one user are sorted together, as digests."""
    _state_store(prompts.sparkSession)
    said = F.trim(F.coalesce(F.col(text), F.lit("")))
    digest = F.when((F.length(said) >= LEAST_CHARS) | (F.col(action) != "submit"), F.sha2(said, 256))
    rows = prompts.select(F.col(user).cast("string").alias("user"), F.col(at).cast("timestamp").alias("at"), F.col(id).cast("bigint").alias("id"), F.coalesce(F.col(action), F.lit("submit")).alias("action"), F.col(decision).alias("decision"), digest.alias("digest"), F.unix_micros(F.col(at).cast("timestamp")).alias("micros"))
    rows = rows.where("user is not null and at is not null and id is not null")
    kept = rows.withWatermark("at", late) if prompts.isStreaming else rows
    idle = round(idle_hours * 3_600_000) if prompts.isStreaming else None
    out = kept.groupBy("user").transformWithState(Approvals(idle), OUTCOMES, "Append", "None" if idle is None else "EventTime")
    return out.withColumn("at", F.timestamp_micros("at"))
