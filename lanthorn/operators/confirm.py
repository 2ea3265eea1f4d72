"""The second look at uncertain findings: windows, votes, verdicts.

Only documents that have something uncertain go through the confirmer; the rest pass by.
The confirmer is a parameter: a function of ``(value, window, offset)`` returning
``(decision, confidence, note)``. It runs as an Arrow UDF over the requests of a batch.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import vocab as V
from ..functions.dialect import leaders, let, portable, settled
from .resolve import FINDING, by_start
from .risk import risk
from .scoring import MEDIUM, tier

RADIUS, MOST_OCCURRENCES, CERTAIN = 160, 12, 0.2
# Patterns of the votes.
PRONOUNS = r"\b(?:he|she|they|him|her|them|his|hers|their)\b"
ROLES = r"\b(?:manager|engineer|director|analyst|consultant|administrator|technician|colleague|customer|client|contact|owner|lead|architect|specialist|representative|advisor|coordinator|supervisor|developer)\b"

Confirmer = Callable[[str, str, int], tuple[str, float, str | None]]


class DeepContext:
    """Votes on each occurrence of a value in its window: is it used as a name?"""

    id, label = "deep-context", "Deep context check"

    def __init__(self, vocabulary: V.Vocabulary = V.Vocabulary()):
        self.nouns = vocabulary.everyday_nouns
        self.pronoun, self.role = (regex.compile(portable(p, True)) for p in (PRONOUNS, ROLES))
        self.next_word = regex.compile(portable(r"[\s,)]*([A-Za-z']+)"))

    def vote(self, clause: str, value: str) -> tuple[float, list[str]]:
        lower = clause.lower()
        at = lower.find(value.lower())
        m = self.next_word.match(clause[at + len(value) :]) if at >= 0 else None
        following = m[1].lower() if m else ""
        follows = [(-0.35, f'it modifies the word "{following}"')] if following in self.nouns else [(-0.25, f'it is followed by "{following}"')] if following in V.FUNCTION_WORDS else []
        says = [
            (0.3, "the sentence describes someone doing something", not V.PERSON_VERBS.isdisjoint(re.findall("[a-z']+", lower))),
            (0.2, "a personal pronoun appears in the same sentence", bool(self.pronoun.search(clause))),
            (0.2, "a job role is mentioned nearby", bool(self.role.search(clause))),
        ]
        votes = [(w, note) for w, note, ok in says if ok] + follows
        return sum((w for w, _ in votes), 0.0), [note for _, note in votes]

    @staticmethod
    def occurrences(window: str, value: str) -> list[int]:
        low, needle, out, at = window.lower(), value.lower(), [], 0
        while needle and len(out) < MOST_OCCURRENCES and (at := low.find(needle, at)) >= 0:
            out.append(at)
            at += len(needle)
        return out

    @staticmethod
    def clause(window: str, at: int) -> str:
        left = max((window.rfind(c, 0, at) for c in ".!?;\n"), default=-1) + 1
        ends = [e for c in ".!?;\n" if (e := window.find(c, at)) >= 0]
        return window[left : min(ends, default=len(window))]

    def __call__(self, value: str, window: str, offset: int):
        votes = [self.vote(self.clause(window, at), value) for at in self.occurrences(window, value) or [offset]]
        score = sum((s for s, _ in votes), 0.0) / len(votes)
        notes = list(dict.fromkeys(n for _, ns in votes for n in ns))
        # The value counts as plain text, whatever characters it has.
        if re.search(rf"(?<![A-Za-z]){re.escape(value.lower())}(?![A-Za-z])", window.replace(value, "")):
            score -= 0.3
            notes.append("the same word is used in lower case nearby")
        if value.lower() in V.DOUBLE_MEANINGS:
            score -= 0.1
        note = f"Looked more closely: {'; '.join(notes)}." if notes else None
        if score >= CERTAIN:
            return "confirm", min(1.0, 0.6 + score), note
        if score <= -CERTAIN:
            return "reject", min(1.0, 0.6 - score), note
        return "unknown", 0.5, note


def best_overlap(spans: list[tuple[int, int, str, float]], start: int, end: int) -> tuple[int, int, str, float] | None:
    """The surest of a model's ``(start, end, label, score)`` that touches a place."""
    return max((s for s in spans if s[0] < end and start < s[1]), key=lambda s: s[3], default=None)


class ModelConfirmer(DeepContext):
    """Any span model as a confirmer and discoverer: a function of a text that returns
    ``(start, end, label, score)``, and what its labels mean. It runs in the Arrow UDFs, so
    whatever it loads is loaded once a worker."""

    id, label = "model", "language model"
    threshold, widest, absent = 0.45, 12, 0.8

    def __init__(self, model: Callable[[str], list[tuple[int, int, str, float]]], labels: dict[str, str], vocabulary: V.Vocabulary = V.Vocabulary(), many: Callable[[list[str]], list[list[tuple[int, int, str, float]]]] | None = None):
        super().__init__(vocabulary)
        self.model, self.labels, self.many = model, labels, many

    def _usable(self, text: str, spans: list[tuple[int, int, str, float]]) -> list[tuple[int, int, str, float]]:
        return [s for s in spans if s[3] >= self.threshold and s[2] in self.labels and len(text[s[0] : s[1]].split()) <= self.widest]

    def spans(self, text: str) -> list[tuple[int, int, str, float]]:
        return self._usable(text, self.model(text))

    def spans_of(self, texts: list[str]) -> list[list[tuple[int, int, str, float]]]:
        """Of many texts, in one call where the model takes a list (``many``)."""
        many = self.many or (lambda some: [self.model(t) for t in some])
        return [self._usable(t, s) for t, s in zip(texts, many(texts), strict=True)]

    def __call__(self, value: str, window: str, offset: int):
        return self.judged(value, offset, self.spans(window))

    def judged(self, value: str, offset: int, spans: list[tuple[int, int, str, float]]):
        best = best_overlap(spans, offset, offset + len(value))
        if best is None:
            return "reject", self.absent, f"The {self.label} does not see a name here."
        return "confirm", best[3], f"The {self.label} reads this as {self.labels[best[2]].lower()}."

    def discover(self, text: str) -> list[tuple[str, str, int, int, float]]:
        return [(self.labels[k], text[s:e], s, e, x) for s, e, k, x in self.spans(text)]


REQUEST = "struct<id:string,value:string,window:string,offset:int,window_start:int>"


def request(f: Column, text: Column) -> Column:
    """A finding with its window: 160 characters on both sides, out to whole words."""
    n = F.length(text)
    low, high = F.greatest(f["start"] - RADIUS, F.lit(0)), F.least(f["end"] + RADIUS, n)
    head = lambda s: F.length(F.regexp_extract(s, "^[A-Za-z0-9_]*", 0))
    # 256 characters tell where nearly all words end; a longer word is followed to its end.
    near = head(F.reverse(F.substring(text, F.greatest(low - 255, F.lit(1)), F.least(low, F.lit(256)))))
    before = F.when(low <= 0, 0).when(near < 256, near).otherwise(head(F.reverse(F.substring(text, F.lit(1), low))))
    near = head(F.substring(text, high + 1, F.lit(256)))
    after = F.when(near < 256, near).otherwise(head(F.substring(text, high + 1, n)))
    first = low - before
    return F.struct(f["id"].alias("id"), f["value"].alias("value"), F.substring(text, first + 1, high + after - first).alias("window"), (f["start"] - first).cast("int").alias("offset"), first.cast("int").alias("window_start")).cast(REQUEST)


VERDICT = "struct<id:string,decision:string,confidence:double,note:string>"
_VERDICT_ARROW = pa.list_(pa.struct([("id", pa.string()), ("decision", pa.string()), ("confidence", pa.float64()), ("note", pa.string())]))


def verdicts(requests: Column, confirmer: Confirmer) -> Column:
    """``array<verdict>``. Requests of a batch that are equal are decided once; one that
    fails is unknown, so the first findings stand."""

    @F.arrow_udf(T._parse_datatype_string(f"array<{VERDICT}>"))
    def run(batch: pa.Array) -> pa.Array:
        known: dict = {}

        def decide(r: dict) -> dict:
            key = (r["value"], r["window"], r["offset"])
            if key not in known:
                try:
                    known[key] = confirmer(*key)
                except Exception as e:  # noqa: BLE001  a confirmer may be anything
                    known[key] = ("failed", 0.0, str(e))
            return dict(zip(("id", "decision", "confidence", "note"), (r["id"], *known[key]), strict=True))

        return pa.array([[decide(r) for r in rows or []] for rows in batch.to_pylist()], _VERDICT_ARROW)

    return run(requests)


def _vouched(f: Column, v: Column, by: DeepContext) -> Column:
    confidence = F.greatest(f["confidence"], v["confidence"])
    note = F.struct(F.lit(f"confirmed:{by.id}").alias("id"), F.lit(0.0).alias("weight"), F.coalesce(v["note"], F.lit(f"Checked again by the {by.label}.")).alias("note"))
    return f.withField("confidence", confidence).withField("tier", tier(F.greatest(confidence, F.lit(MEDIUM)))).withField("confirmed_by", F.lit(by.id)).withField("signals", F.array_append(f["signals"], note)).cast(FINDING)


def _checked(f: Column, v: Column, by: DeepContext) -> Column:
    note = F.struct(F.lit(f"checked:{by.id}").alias("id"), F.lit(0.0).alias("weight"), v["note"].alias("note"))
    return f.withField("confirmed_by", F.lit(by.id)).withField("signals", F.when(v["note"].isNotNull(), F.array_append(f["signals"], note)).otherwise(f["signals"])).cast(FINDING)


def apply_verdicts(findings: Column, recoverable: Column, given: Column, by: DeepContext) -> Column:
    """Confirmed findings rise, rejected ones go, unknown ones stay with a note;
    recoverable ones join if confirmed."""
    failed = F.exists(given, lambda v: v["decision"] == "failed")
    none = F.lit(None).cast(VERDICT)
    # Verdicts first, then who may have one: the first of an id is its verdict.
    ids = lambda rows: F.transform(rows, lambda r: r["id"])
    at = leaders(F.concat(ids(given), ids(findings), ids(recoverable)), lambda i: i)
    n, m = F.size(given), F.size(findings)

    def of(place: Column, before: Column) -> Column:
        """The verdict of the row at a place of those after ``before`` others, or null."""
        led = lambda p: F.element_at(p, place + before + 1)
        return lambda p: F.when(led(p) < n, F.element_at(given, F.least(led(p) + 1, n))).otherwise(none)

    def judged(f: Column, v: Column) -> Column:
        return F.when(v.isNull() | (f["tier"] != "medium"), f).when(v["decision"] == "confirm", _vouched(f, v, by)).when(v["decision"] == "unknown", _checked(f, v, by))

    def result(p: Column) -> Column:
        kept = F.array_compact(F.transform(findings, lambda f, i: let(of(i, n)(p), lambda v: judged(f, v))))
        back = F.array_compact(F.transform(recoverable, lambda f, i: let(of(i, n + m)(p), lambda v: F.when(v["decision"] == "confirm", _vouched(f, v, by)))))
        return F.when(failed, findings).otherwise(F.concat(kept, back))

    return F.when(n == 0, findings).otherwise(let(at, result))


DISCOVERY = "struct<category:string,value:string,start:int,end:int,confidence:double>"
_DISCOVERY_ARROW = pa.list_(pa.struct([("category", pa.string()), ("value", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("confidence", pa.float64())]))
#: What may be discovered, and how sure a model must be of it.
DISCOVERABLE, LEAST_SURE = ("PERSON", "ORGANISATION", "LOCATION"), 0.45


def like_a_name(category: str, value: str) -> bool:
    """Whether what a model sees can be a name: it starts with a capital and has two
    letters; not all of its words are acronyms or start sentences; none is a job or an
    institution; a person has no digits."""
    words = value.split()
    lower = [w.lower() for w in words]
    plain = all(w.upper() in V.ACRONYMS for w in words) or all(w in V.STARTERS for w in lower)
    return len(value) >= 2 and value[:1].isupper() and not plain and not any(w in V.JOB_WORDS or w in V.INSTITUTIONS for w in lower) and not (category == "PERSON" and any(c.isdigit() for c in value))


def discoveries(text: Column, discover: Callable[[str], list[tuple]]) -> Column:
    """``array<discovery>`` that a model sees in a text: of the categories that it may
    discover, sure enough, with the text that stands at the place. A failure sees nothing."""

    @F.arrow_udf(T._parse_datatype_string(f"array<{DISCOVERY}>"))
    def run(batch: pa.Array) -> pa.Array:
        def of(t: str | None) -> list[dict]:
            try:
                seen = discover(t) if t else []
            except Exception:  # noqa: BLE001  a model may be anything
                return []
            fits = lambda c, v, s, e, x: c in DISCOVERABLE and x >= LEAST_SURE and t[s:e] == v and like_a_name(c, v)
            return [dict(zip(("category", "value", "start", "end", "confidence"), x, strict=True)) for x in seen if fits(*x)]

        return pa.array([of(t) for t in batch.to_pylist()], _DISCOVERY_ARROW)

    return run(text)


def discovered(resolved: Column, declined: Column, entities: Column, by_id: str, by_label: str) -> Column:
    """Findings with those entities of a model that touch nothing taken, first come first
    served. ``entities`` is ``array<struct<category, value, start, end, confidence>>``."""
    note = lambda: F.array(F.struct(F.lit(f"discovered:{by_id}").alias("id"), F.lit(0.0).alias("weight"), F.lit(f"The word lists did not recognise this, but the {by_label} identified it.").alias("note")))

    def add(found: Column, e: Column) -> Column:
        touches = lambda spans: F.exists(spans, lambda s: (s["start"] < e["end"]) & (e["start"] < s["end"]))
        n = F.size(F.filter(found, lambda f: f["id"].startswith("d"))) + 1
        row = F.struct(
            F.concat(F.lit("d"), n.cast("string")).alias("id"), F.lit(None).cast("int").alias("ord"), e["category"].alias("category"), e["value"].alias("value"), e["start"].alias("start"), e["end"].alias("end"), F.lit("entity").alias("layer"),
            F.lit(f"Spotted by the {by_label}").alias("rule"), e["confidence"].alias("base"), F.lit(False).alias("unresolved"), F.lit(False).alias("single"), e["confidence"].alias("confidence"), tier(F.greatest(e["confidence"], F.lit(MEDIUM))).alias("tier"),
            F.lit(True).alias("enabled"), F.lit(by_id).alias("confirmed_by"), note().alias("signals"),
        ).cast(FINDING)
        return F.when(touches(found) | touches(declined), found).otherwise(F.array_append(found, row))

    return F.aggregate(entities, resolved, add)


def one_answer(findings: Column) -> Column:
    """A value has one category in a document: that of its surest mention, the first of
    equals."""
    note = F.struct(F.lit("consistent-category").alias("id"), F.lit(0.0).alias("weight"), F.lit("Matched to the same value elsewhere in this content.").alias("note"))
    changed = lambda f, b: f.withField("category", b["category"]).withField("confidence", F.greatest(f["confidence"], b["confidence"])).withField("tier", b["tier"]).withField("signals", F.array_append(f["signals"], note)).cast(FINDING)
    settle = lambda f, b: F.when(b["category"] == f["category"], f).otherwise(changed(f, b))
    best = leaders(findings, lambda f: F.lower(f["value"]), lambda f, i: -f["confidence"])
    return by_start(let(best, lambda at: F.transform(findings, lambda f, i: let(F.element_at(findings, F.element_at(at, i + 1) + 1), lambda b: settle(f, b)))))


def needs_confirming(findings: Column, recoverable: Column) -> Column:
    return F.exists(findings, lambda f: f["tier"] == "medium") | (F.size(recoverable) > 0)


def _asking(scanned: DataFrame, text: str, only: Column | None) -> tuple[DataFrame, Column]:
    """``scanned`` with ``__requests``, and whether a row has any."""
    asks = lambda f: request(f, F.coalesce(F.col(text), F.lit("")))
    need = needs_confirming(F.col("findings"), F.col("recoverable"))
    need = need if only is None else need & F.coalesce(only, F.lit(False))
    asked = F.concat(F.transform(F.filter("findings", lambda f: f["tier"] == "medium"), asks), F.transform("recoverable", asks))
    return scanned.withColumn("__requests", F.when(need, asked).otherwise(F.array().cast(f"array<{REQUEST}>"))), need


def _answered(df: DataFrame, by: DeepContext, text: str, need: Column) -> DataFrame:
    """Findings, risk and ``escalation`` from ``__verdicts``."""
    t = F.coalesce(F.col(text), F.lit(""))
    df = settled(df, "__resolved", apply_verdicts(F.col("findings"), F.col("recoverable"), F.col("__verdicts"), by))
    failed = F.exists("__verdicts", lambda v: v["decision"] == "failed")
    if hasattr(by, "discover"):
        df = settled(df, "__seen", F.when(need & ~failed, discoveries(t, by.discover)).otherwise(F.array().cast(f"array<{DISCOVERY}>")))
        df = settled(df, "__resolved", discovered(F.col("__resolved"), F.col("declined"), F.col("__seen"), by.id, by.label))
    count = lambda ids, d: F.size(F.filter("__verdicts", lambda v: v["id"].startswith(ids) & (v["decision"] == d)))
    error = F.try_element_at(F.filter("__verdicts", lambda v: v["decision"] == "failed"), F.lit(1))["note"]
    stats = F.struct(
        F.size(F.filter("findings", lambda f: f["tier"] == "medium")).alias("ambiguous"), F.size("recoverable").alias("recoverable"), need.alias("invoked"), count("f", "confirm").alias("confirmed"), count("f", "reject").alias("rejected"), count("f", "unknown").alias("unresolved"),
        count("r", "confirm").alias("recovered"), F.size(F.filter("__resolved", lambda f: f["id"].startswith("d"))).alias("discovered"), error.alias("error"),
    )
    df = df.withColumn("escalation", stats)
    df = settled(df, "__final", F.when((F.size("__verdicts") > 0) & ~failed, one_answer(F.col("__resolved"))).otherwise(F.col("findings")))
    df = df.withColumn("findings", F.col("__final"))
    return df.withColumn("risk", risk(F.col("findings"))).drop("__requests", "__verdicts", "__resolved", "__final", "__seen")


def confirmed(scanned: DataFrame, confirmer: DeepContext | None = None, text: str = "text", only: Column | None = None) -> DataFrame:
    """``scanned`` with findings and risk after the second look, and ``escalation``. A
    confirmer with ``discover``, a function of a text that returns ``(category, value, start,
    end, confidence)`` of what it sees, also adds what touches nothing taken or declined.
    ``only`` limits the second look to some rows."""
    by = confirmer or DeepContext()
    df, need = _asking(scanned, text, only)
    return _answered(settled(df, "__verdicts", verdicts(F.col("__requests"), by)), by, text, need)


#: Windows that a model is given at a time.
TOGETHER = 64
_JUDGED = "place string, value string, offset int, decision string, confidence double, note string"


def _judge(by: Confirmer) -> Callable:
    """Judges distinct windows, a row each with all that is asked of it."""

    def failing(work: Callable, *args):
        try:
            return work(*args), None
        except Exception as e:  # noqa: BLE001  a confirmer may be anything
            return None, str(e)

    def run(batches):
        schema = pa.schema([("place", pa.string()), ("value", pa.string()), ("offset", pa.int32()), ("decision", pa.string()), ("confidence", pa.float64()), ("note", pa.string())])
        for batch in batches:
            for at in range(0, batch.num_rows, TOGETHER):
                rows, out = batch.slice(at, TOGETHER).to_pylist(), []
                seen, error = failing(by.spans_of, [r["window"] for r in rows]) if hasattr(by, "spans_of") else ([None] * len(rows), None)
                for k, r in enumerate(rows):
                    for a in r["asked"]:
                        value, offset = a["value"], a["offset"]
                        found = error
                        if error is None:
                            verdict, found = failing(by.judged, value, offset, seen[k]) if hasattr(by, "spans_of") else failing(by, value, r["window"], offset)
                        out.append((r["place"], value, offset, *(("failed", 0.0, found) if found is not None else verdict)))
                columns = list(zip(*out, strict=True)) or [[]] * len(schema)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return run


def confirmed_once(scanned: DataFrame, keys: list[str], confirmer: DeepContext | None = None, text: str = "text", only: Column | None = None) -> DataFrame:
    """As ``confirmed``, but every distinct window of the whole table is looked at once, in
    batches, however many documents have it: for models, whose look is dear.

    ``keys`` name a row; rows that share their keys get each other's verdicts, so they must
    be unique. Windows are told apart by SHA-256; what is asked of one is bounded by its
    length. Windows are made distinct before they are shuffled, and verdicts return by a
    join whose hot windows Spark can split. ``scanned`` is read twice: write it first where
    the scan is dearer than that."""
    by = confirmer or DeepContext()
    df, need = _asking(scanned, text, only)
    place = F.sha2("r.window", 256)
    asked = df.select(*keys, F.posexplode("__requests").alias("__n", "r")).select(*keys, "__n", "r.id", "r.value", "r.offset", "r.window", place.alias("place"))
    windows = asked.groupBy("place", "window").agg(F.collect_set(F.struct("value", "offset")).alias("asked"))
    judged = windows.mapInArrow(_judge(by), _JUDGED)
    told = asked.drop("window").join(judged, ["place", "value", "offset"])
    verdict = F.struct("id", "decision", "confidence", "note").cast(VERDICT)
    each = told.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("__n", verdict.alias("v")))).alias("__told"))
    none = F.array().cast(f"array<{VERDICT}>")
    both = df.join(each, keys, "left").withColumn("__verdicts", F.coalesce(F.transform("__told", lambda t: t["v"]), none)).drop("__told")
    return _answered(both, by, text, need)
