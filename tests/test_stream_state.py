"""States of streams over restarts, and the second stage over replays."""

import datetime
import hashlib
import random
import shutil
import time

import pytest
from pyspark.sql import functions as F

from lanthorn.streaming import check, stages, state

START = datetime.datetime(2026, 3, 1, tzinfo=datetime.timezone.utc)


def after(seconds):
    return START + datetime.timedelta(seconds=seconds)


def run(df, path, mode, name=None, foreach=None):
    """One run over what is there, from the checkpoint of the one before."""
    writer = df.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True)
    query = writer.foreachBatch(foreach).start()
    query.awaitTermination(300)
    if query.exception():
        raise query.exception()


# Latencies.

CHECKS = "site string, ts timestamp, event long, ms double, decision string"


def checks(seed, n):
    rng = random.Random(seed)
    return [(rng.choice(["a", "a", "a", "b", None]), after(rng.randint(0, 5000)), seed * 100_000 + i, rng.choice([None, *map(float, range(40))]), rng.choice(["allow", "warn", "block", None])) for i in range(n)]


def plain_metrics(rows):
    out = {}
    for key in {r[0] or "" for r in rows}:
        mine = [r for r in rows if (r[0] or "") == key]
        ms = sorted(x[3] for x in sorted((r for r in mine if r[3] is not None), key=lambda r: r[1:3])[-200:])
        at = lambda p: ms[min(len(ms) - 1, p * len(ms) // 100)] if ms else None
        count = lambda d: sum(r[4] == d for r in mine)
        out[key] = (len(mine), count("allow"), count("warn"), count("block"), count("block"), 0, len(ms), at(50), at(95), at(99))
    return out


def metrics_of(df):
    return state.latency_metrics(df, F.col("site"), "ts", "event", "ms", F.col("decision"), escalated=F.col("decision") == "block")


def test_latencies_over_restarts(spark, tmp_path):
    """Three runs, each from the checkpoint of the one before; late rows come in the last."""
    source, seen, all_rows = str(tmp_path / "in"), {}, []

    def keep(batch, _):
        seen.update({r["key"]: tuple(r)[1:] for r in batch.collect()})

    for step, n in enumerate((150, 700, 90)):
        rows = checks(step, n)
        all_rows += rows
        spark.createDataFrame(rows, CHECKS).repartition(3).write.mode("append").parquet(source)
        run(metrics_of(spark.readStream.schema(CHECKS).parquet(source)), tmp_path, "update", foreach=keep)
        assert seen == plain_metrics(all_rows)
    assert seen["a"][6] == 200 > seen["b"][6]


def test_forgotten_keys(spark, tmp_path):
    """What is remembered for a millisecond is gone in the next run."""
    source, seen = str(tmp_path / "in"), []
    rows = [("a", after(1), 1, 5.0, "allow")]
    for _ in range(2):
        spark.createDataFrame(rows, CHECKS).coalesce(1).write.mode("append").parquet(source)
        df = state.latency_metrics(spark.readStream.schema(CHECKS).parquet(source), F.col("site"), "ts", "event", "ms", forget=1)
        query = df.writeStream.outputMode("update").option("checkpointLocation", f"{tmp_path}/checkpoint").foreachBatch(lambda b, _: seen.extend(r["checked"] for r in b.collect())).start()
        had, until = len(seen), time.time() + 60
        while len(seen) == had and time.time() < until:
            time.sleep(0.2)
        query.stop()
    assert seen == [1, 1]


def test_latencies_of_a_table(spark):
    rows = [*checks(7, 500), ("none", None, 1, 1.0, "allow"), ("none", START, 2, None, "allow")]
    got = {r["key"]: tuple(r)[1:] for r in metrics_of(spark.createDataFrame(rows, CHECKS)).collect()}
    want = plain_metrics(rows[:-2]) | {"none": (2, 2, 0, 0, 0, 0, 0, None, None, None)}
    assert got == want
    assert metrics_of(spark.createDataFrame([], CHECKS)).collect() == []


# Approvals.

PROMPTS = "person string, ts timestamp, event long, said string, did string, decision string"


def plain_approvals(rows):
    out, users = [], {}
    for person, ts, event, said, did, decision in sorted((r for r in rows if None not in (r[0], r[1], r[2])), key=lambda r: r[1:3]):
        user = users.setdefault(person, {"approved": set(), "overridden": None})
        text, did = (said or "").strip(" "), did or "submit"

        def approve(user=user, text=text):
            if len(user["approved"]) > 50:
                user["approved"] = set()
            user["approved"].add(text)

        if did == "send_anyway":
            user["overridden"] = text
            approve()
            outcome = "sent anyway"
        elif did == "cleaned":
            approve()
            outcome = "cleaned"
        elif len(text) < 12:
            outcome = "short"
        elif text in user["approved"] or text == user["overridden"]:
            outcome = "cleared before"
        elif decision == "allow":
            approve()
            outcome = "allowed"
        else:
            outcome = "held"
        out.append((person, ts.replace(tzinfo=None), event, did, outcome))
    return sorted(out)


def prompts(seed, n, first):
    rng, rows = random.Random(seed), []
    for i in range(n):
        text = rng.choice([None, "short", f"  a text number {rng.randint(0, 70)}", f"a text number {rng.randint(0, 70)}"])
        secret = f"a secret number {rng.randint(0, 5)}"
        said, did, decision = rng.choice([(text, "submit", "allow"), (text, None, "allow"), (secret, "submit", "block"), (secret, "send_anyway", "block"), (text, "cleaned", "allow"), (text, "submit", None)])
        rows.append((rng.choice(["u1", "u1", "u2"]), after(first + i), seed * 10_000 + i, said, did, decision))
    return rows


def outcomes_of(df):
    return state.approvals(df, "person", "ts", "event", "said", "did", "decision", late="10 minutes", idle_hours=1)


def test_approvals_over_restarts(spark, tmp_path):
    """The 52nd text starts a user's state afresh; it lives over restarts."""
    source, seen, all_rows = str(tmp_path / "in"), [], []

    def keep(batch, _):
        seen.extend((r["user"], r["at"], r["id"], r["action"], r["outcome"]) for r in batch.collect())

    for step in range(3):
        rows = prompts(step, 400, step * 400)
        all_rows += rows
        spark.createDataFrame([*rows, (None, START, 1, "no user at all", None, None)], PROMPTS).repartition(3).write.mode("append").parquet(source)
        run(outcomes_of(spark.readStream.schema(PROMPTS).parquet(source)), tmp_path, "append", foreach=keep)
        assert sorted(seen) == plain_approvals(all_rows)
    assert {x[4] for x in seen} == {"held", "allowed", "short", "cleared before", "cleaned", "sent anyway"}
    assert sum(x[4] == "allowed" for x in seen if x[0] == "u1") > 52


def test_exactly_one_too_many(spark):
    """51 texts are held, the 52nd clears them; what was sent anyway stays known."""
    secret = (*("u",), after(0), 0, "a secret to be sent", "send_anyway", "block")
    rows = [secret, *(("u", after(i), i, f"some harmless text {i}", "submit", "allow") for i in range(1, 52))]
    again = lambda k, said: ("u", after(100 + k), 100 + k, said, "submit", "block")
    df = spark.createDataFrame([*rows, again(0, "a secret to be sent"), again(1, "some harmless text 1"), again(2, "some harmless text 51")], PROMPTS)
    got = {r["id"]: r["outcome"] for r in outcomes_of(df).collect()}
    assert [got[100], got[101], got[102]] == ["cleared before", "held", "cleared before"]


def test_idle_users_are_forgotten(spark, tmp_path):
    source, seen = str(tmp_path / "in"), {}

    def keep(batch, _):
        seen.update({r["id"]: r["outcome"] for r in batch.collect()})

    for k, (person, second) in enumerate([("u", 0), ("other", 9000), ("other", 9001), ("u", 9002)]):
        spark.createDataFrame([(person, after(second), k, "a harmless text again", "submit", "allow" if k < 3 else "block")], PROMPTS).coalesce(1).write.mode("append").parquet(source)
        run(outcomes_of(spark.readStream.schema(PROMPTS).parquet(source)), tmp_path, "append", foreach=keep)
    assert seen == {0: "allowed", 1: "allowed", 2: "cleared before", 3: "held"}


# The second stage.

TEXTS = [(1, "Mark called about the report."), (2, "my password: hunter22 please"), (3, "what is the weather today"), (4, "Grace was late, and so was the train.")]


class Failing(stages.TwoStages):
    """Dies after the first stage was written."""

    def put(self, rows, stage, batch_id):
        if stage == 2:
            raise RuntimeError("the driver was lost")
        super().put(rows, stage, batch_id)


def files_of(folder):
    return {str(p.relative_to(folder)): hashlib.md5(p.read_bytes()).hexdigest() for p in folder.rglob("*.parquet")}


def test_second_stage_over_replays(spark, tmp_path):
    source, out = str(tmp_path / "in"), tmp_path / "out"
    df = spark.createDataFrame(TEXTS, "id long, text string")
    df.coalesce(1).write.parquet(source)
    first = lambda: check.checked(spark.readStream.schema(df.schema).parquet(source))
    with pytest.raises(Exception, match="the driver was lost"):
        run(first(), tmp_path, "append", foreach=Failing(str(out), "p", ["id"]))
    early = {r["id"]: r for r in stages.answers(spark, str(out), "p", ["id"]).collect()}
    assert len(early) == 4 and {r["stage"] for r in early.values()} == {1}
    begun = files_of(out)
    run(first(), tmp_path, "append", foreach=stages.TwoStages(str(out), "p", ["id"]))  # the batch comes again
    done = files_of(out)
    assert begun.items() <= done.items()
    shutil.rmtree(tmp_path / "checkpoint")  # all of it comes again
    run(first(), tmp_path, "append", foreach=stages.TwoStages(str(out), "p", ["id"]))
    assert files_of(out) == done
    late = {r["id"]: r for r in stages.answers(spark, str(out), "p", ["id"]).collect()}
    want = {r["id"]: r for r in check.deep_checked(check.checked(df)).collect()}
    deeper = {r["id"] for r in check.checked(df).collect() if r["deeper"]}
    assert deeper and len(deeper) < 4
    assert {i: (r["decision"], r["headline"], r["summary"]) for i, r in late.items()} == {i: (r["decision"], r["headline"], r["summary"]) for i, r in want.items()}
    assert {i for i, r in late.items() if r["stage"] == 2} == deeper
