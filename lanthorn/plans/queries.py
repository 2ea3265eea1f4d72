"""The queries of the engine, each over whole tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.categories import category_table
from ..functions.dialect import built_once, settled
from ..operators import classify, confirm, feedback, improve, metrics, resolve, risk, sanitize, scoring, sensitivity
from ..operators.rules import RULES, rule_candidates
from ..sources import files
from ..streaming import check, state
from .cases import case_texts
from .corpora import PAPERS_FROM, corpus, gathered, notes, papers, table
from .scan import finding_rows, scan, with_candidates

#: The rules whose findings SQL can follow through to the end.
CORE = ("secret", "card", "email", "phone", "ipv4")


@built_once
def _rule(name: str):
    layer, rule = RULES[name]
    return rule_candidates(F.col("text"), {layer: [rule]})[layer]


@built_once
def _core_candidates():
    return rule_candidates(F.col("text"), {"pattern": [RULES[r][1] for r in CORE]})["pattern"]


def _with_core_candidates(df: DataFrame) -> DataFrame:
    return settled(df, "candidates", _core_candidates())


@built_once
def _core_scored():
    return scoring.score(F.col("candidates"), F.lit("general"))


@built_once
def _core_findings():
    return resolve.findings(F.col("scored"))


@built_once
def _core_risk():
    return risk.risk(F.col("findings"))


def rule_query(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every match of one rule, with its place."""
    rows = settled(corpus(spark, sf_dir), "__rules", _rule(name)).select("doc_id", F.inline("__rules"))
    return rows.select("doc_id", "value", "start", "end")


def core_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with_core_candidates(corpus(spark, sf_dir))


def core_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return settled(core_candidates(spark, sf_dir), "scored", _core_scored())


def core(spark: SparkSession, sf_dir: str) -> DataFrame:
    return settled(core_scored(spark, sf_dir), "findings", _core_findings())


def whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scan with all rules, entities and document states."""
    return scan(corpus(spark, sf_dir))


def candidate_counts(spark, sf_dir, found=core_candidates):
    rows = found(spark, sf_dir).select("doc_id", F.inline("candidates"))
    return rows.groupBy("layer", "rule", "category").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id").alias("n_docs"))


def tier_assignment(spark, sf_dir, found=core_scored):
    rows = found(spark, sf_dir).select("doc_id", F.inline("scored"))
    return rows.groupBy("category", "tier").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("confidence"), 6).alias("mean_confidence"))


def overlap_resolved(spark, sf_dir, found=core):
    return finding_rows(found(spark, sf_dir), "doc_id").select("doc_id", "id", "category", "value", "start", "end", F.round("confidence", 6).alias("confidence"))


def risk_per_document(spark, sf_dir, found=core):
    df = settled(found(spark, sf_dir), "risk", _core_risk())
    return df.select("doc_id", F.col("risk.score").alias("score"), F.col("risk.level").alias("level"), *(F.col(f"risk.counts.{g}").alias(g) for g in ("personal", "internal", "confidential", "secret", "total")))


def risk_level_histogram(spark, sf_dir, found=core):
    return risk_per_document(spark, sf_dir, found).groupBy("level").agg(F.count(F.lit(1)).alias("n"), F.max("score").alias("max_score"))


def findings_by_value(spark, sf_dir, found=core):
    rows = finding_rows(found(spark, sf_dir), "doc_id").select("doc_id", "category", "value", "start", "confidence")
    return metrics.by_value(gathered(rows, spark, sf_dir)).withColumn("confidence", F.round("confidence", 6))


def findings_by_group(spark, sf_dir, found=core):
    return metrics.by_group(finding_rows(found(spark, sf_dir), "doc_id")).withColumn("confidence", F.round("confidence", 6))


def category_join(spark, sf_dir, found=core):
    """Findings joined with the category table, which has 29 rows."""
    rows = finding_rows(found(spark, sf_dir), "doc_id").join(F.broadcast(category_table(spark)), "category")
    return rows.groupBy("group", "severity", "label").agg(F.count(F.lit(1)).alias("n"))


def policy_decision(spark, sf_dir, found=core):
    df = settled(found(spark, sf_dir), "outcome", risk.evaluate(F.col("findings")))
    return df.select("doc_id", F.col("outcome.decision").alias("decision"), F.col("outcome.headline").alias("headline"), F.size("outcome.drivers").alias("n_drivers"), F.col("outcome.summary").alias("summary"))


def strongest_mention(spark, sf_dir, found=core):
    return metrics.strongest_mentions(finding_rows(found(spark, sf_dir), "doc_id")).select("doc_id", F.lower("value").alias("value"), "category", F.round("confidence", 6).alias("confidence"), "start")


def redacted_text(spark, sf_dir, found=core):
    return sanitize.cleaned(found(spark, sf_dir), "redact").select("doc_id", F.col("clean.text").alias("text"))


def pseudonym_map(spark, sf_dir, found=core):
    df = sanitize.cleaned(found(spark, sf_dir), "pseudonymize")
    rows = df.select("doc_id", F.inline("clean.replacements")).select("doc_id", "category", F.lower("value").alias("value"), "replacement")
    return gathered(rows, spark, sf_dir).distinct()


def output_offsets(spark, sf_dir, found=core):
    df = sanitize.cleaned(found(spark, sf_dir), "redact")
    return df.select("doc_id", F.inline("clean.replacements")).select("doc_id", "id", "replacement", F.col("start").alias("out_start"), F.col("end").alias("out_end"))


def synthetic_text(spark, sf_dir, found=core):
    return sanitize.cleaned(found(spark, sf_dir), "synthetic").select("doc_id", F.col("clean.text").alias("text"), F.to_json("clean.value_map").alias("value_map"))


def residual_findings(spark, sf_dir):
    """What a second scan still finds in cleaned notes."""
    df = notes(spark, sf_dir)
    df = settled(settled(_with_core_candidates(df), "scored", _core_scored()), "findings", _core_findings())
    df = sanitize.cleaned(df, "synthetic").select("doc_id", F.col("clean.text").alias("text"), F.col("clean.replacements").alias("replacements"))
    df = settled(settled(_with_core_candidates(df), "scored", _core_scored()), "findings", _core_findings())
    return df.select("doc_id", F.size("findings").alias("n_again"), F.size(sanitize.residual(F.col("findings"), F.col("replacements"))).alias("n_residual"))


def full_residual_findings(spark, sf_dir):
    """What a second whole scan still finds in cleaned documents and notes."""
    df = sanitize.cleaned(whole(spark, sf_dir), "synthetic").select("doc_id", F.col("clean.text").alias("text"), F.col("clean.replacements").alias("replacements"))
    return scan(df).select("doc_id", F.size("findings").alias("n_again"), F.size(sanitize.residual(F.col("findings"), F.col("replacements"))).alias("n_residual"))


def scan_delta(spark, sf_dir, found=core):
    """What changes where a policy that leaves e-mail addresses alone gives way to one that
    leaves phone numbers alone."""
    rows = finding_rows(found(spark, sf_dir), "doc_id")
    return metrics.delta_of(rows, F.col("category") != "EMAIL", F.col("category") != "PHONE")


def url_signals(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").select("page_id", F.explode(scoring.link_signals(F.col("url"))).alias("s"))
    return rows.select("page_id", F.col("s.id").alias("signal"), F.col("s.weight").alias("weight"))


def highlights(spark, sf_dir, found=core):
    return found(spark, sf_dir).select("doc_id", F.posexplode(metrics.highlights(F.col("text"), F.col("findings"))).alias("part", "p")).select("doc_id", "part", F.col("p.text").alias("text"), F.col("p.finding").alias("finding"))


def class_confidence(spark, sf_dir):
    df = papers(spark, sf_dir).select("doc_id", "text", F.lit("").alias("__name"))
    df = settled(settled(df, "__weighed", classify.weighed(F.col("text"), F.col("__name"))), "ranked", _every_class())
    return df.select("doc_id", F.inline("ranked")).select("doc_id", "dimension", "id", F.round("confidence", 6).alias("confidence"))


@built_once
def _every_class():
    return F.concat(*(classify.ranked(d, F.col("__weighed")) for d in ("documentType", "topic", "function")))


def classification(spark, sf_dir):
    df = classify.classified(papers(spark, sf_dir))
    return df.select("doc_id", F.col("classification.document_type.id").alias("document_type"), F.transform("classification.topics", lambda t: t["id"]).alias("topics"), F.transform("classification.functions", lambda f: f["id"]).alias("functions"), F.col("classification.summary").alias("summary"))


def heading_lines(spark, sf_dir):
    return papers(spark, sf_dir).select("doc_id", F.posexplode(sensitivity.headings(F.col("text"))).alias("place", "heading"))


def roadmap_rows(spark, sf_dir):
    return corpus(spark, sf_dir).unionAll(papers(spark, sf_dir)).select("doc_id", sensitivity.roadmap_rows(F.col("text")).alias("n")).where("n > 0")


def sensitivity_state(spark, sf_dir):
    df = scan(papers(spark, sf_dir))
    return df.select("doc_id", F.col("document.state").alias("state"), F.round("document.confidence", 6).alias("confidence"), F.transform("document.signals", lambda s: s["id"]).alias("signals"))


def entity_candidates(spark, sf_dir):
    rows = with_candidates(corpus(spark, sf_dir)).select("doc_id", F.inline("candidates")).where("layer = 'entity'")
    return rows.groupBy("category", "rule").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id").alias("n_docs"))


def scan_findings(spark, sf_dir):
    return finding_rows(scan(corpus(spark, sf_dir)), "doc_id").select("doc_id", "id", "category", "value", "start", "end", "tier", "layer", "rule", F.round("confidence", 6).alias("confidence"), F.transform("signals", lambda s: s["id"]).alias("signals"))


def scan_risk(spark, sf_dir):
    return scan(corpus(spark, sf_dir)).select("doc_id", "risk.score", "risk.level", F.size("findings").alias("n_findings"), F.size("recoverable").alias("n_recoverable"), F.size("declined").alias("n_declined"))


def recoverable_topk(spark, sf_dir):
    return scan(corpus(spark, sf_dir)).select("doc_id", F.inline("recoverable")).select("doc_id", "id", "value", "start", F.round("confidence", 6).alias("confidence"))


def confirmed_findings(spark, sf_dir):
    df = confirm.confirmed(scan(corpus(spark, sf_dir)))
    return df.select("doc_id", "escalation.ambiguous", "escalation.recoverable", "escalation.confirmed", "escalation.rejected", "escalation.unresolved", "escalation.recovered", F.size("findings").alias("n_findings"), "risk.score")


def prompt_rewrite(spark, sf_dir):
    df = settled(table(spark, sf_dir, "conversations").where("role = 'user'"), "x", improve.improved(F.col("text")))
    return df.select("conv_id", "turn", "x.text", "x.intent", "x.domain", "x.note")


def prompt_intent(spark, sf_dir):
    df = table(spark, sf_dir, "conversations").where("role = 'user'")
    return df.select("conv_id", "turn", improve.intent(F.col("text")).alias("intent"), improve.domain(F.col("text")).alias("domain"), improve.has_context(F.col("text")).alias("has_context"))


def feedback_records(spark, sf_dir, found=core):
    df = found(spark, sf_dir)
    if "document" not in df.columns:
        df = df.withColumn("document", F.struct(F.lit("general").alias("state"), F.lit(0.0).alias("confidence"), F.array().cast("array<string>").alias("topics"), F.array().cast(f"array<{scoring.SIGNAL}>").alias("signals")))
    return feedback.records(df).select("id", "fingerprint.chars", "fingerprint.finding_counts.personal", "fingerprint.finding_counts.secret", "system_state", "user_decision")


def latency_percentiles(spark, sf_dir):
    return metrics.ranked_percentile(table(spark, sf_dir, "events"), "value", [50, 95, 99], "event_type")


def rolling_latency(spark, sf_dir):
    rows = metrics.rolling(table(spark, sf_dir, "events"), "value", "event_id", "event_type")
    return rows.select("event_id", "event_type", F.round(F.col("rolling_mean") + 1e-7, 4).alias("rolling_mean"), "rolling_n")


def newest_events(spark, sf_dir):
    return metrics.newest(table(spark, sf_dir, "events"), "event_id", "event_type").select("event_id", "event_type")


def quality_confusion(spark, sf_dir, found=core):
    """How well a risk above zero tells toxic documents: a confusion count."""
    rows = table(spark, sf_dir, "labels").join(risk_per_document(spark, sf_dir, found).select("doc_id", "score"), "doc_id")
    return rows.agg(*metrics.confusion(F.col("toxic") == 1, F.col("score") > 0))


def table_rows_as_text(spark, sf_dir):
    """Rows of a table as spreadsheet lines, scanned with the delimiter kept whole."""
    df = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), files.row_text("c_name", "c_mktsegment", "c_acctbal").alias("text"))
    return df.select("doc_id", "text")


def stream_check(spark, sf_dir):
    """The first stage of checking on user turns; the same plan runs on a stream."""
    turns = table(spark, sf_dir, "conversations").where("role = 'user'").where(check.worth_checking(F.col("text")))
    return check.checked(turns).select("conv_id", "turn", "decision", "headline", "summary", F.size("wire").alias("n_wire"), "deeper")


def stream_metrics(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").where("role = 'user'").where(check.worth_checking(F.col("text")))
    return check.counters(check.checked(turns))


def latency_state(spark, sf_dir):
    """The state of a stream's latencies, by event type: counts and percentiles of the last 200."""
    kind = F.col("event_type")
    decision = F.when(F.col("value") < 100, "allow").when(F.col("value") < 200, "warn").otherwise("block")
    return state.latency_metrics(table(spark, sf_dir, "events"), kind, "ts", "event_id", "value", decision, escalated=F.col("value") >= 200)


def cleared_turns(spark, sf_dir):
    """Which user turns would be asked about, by conversation, where digits stop a turn."""
    turns = table(spark, sf_dir, "conversations").where("role = 'user'")
    turns = turns.select("*", F.timestamp_seconds("turn").alias("at"), F.lit("submit").alias("action"), F.when(F.col("text").rlike("[0-9]"), "block").otherwise("allow").alias("decision"))
    return state.approvals(turns, "conv_id", "at", "turn", "text", "action", "decision").select(F.col("user").cast("long").alias("conv_id"), F.col("id").alias("turn"), "outcome")


def class_accuracy(spark, sf_dir):
    """How often a paper that is made in the words of a class is given that class: first, and
    among the first three of its dimension."""
    places = F.create_map(*(F.lit(x) for k, c in enumerate(classify.CLASSES) for x in (f"{c.dimension}:{c.id}", k)))
    known = F.element_at(F.array(*(F.struct(F.lit(c.dimension).alias("dimension"), F.lit(c.id).alias("truth")) for c in classify.CLASSES)), (F.col("c_custkey") % len(classify.CLASSES) + 1).cast("int"))
    papers_of = table(spark, sf_dir, "customer").select((F.col("c_custkey") + PAPERS_FROM).alias("doc_id"), known.alias("c")).select("doc_id", "c.*")
    given = class_confidence(spark, sf_dir).withColumn("k", F.element_at(places, F.concat_ws(":", "dimension", "id")))
    best = given.groupBy("doc_id", "dimension").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("confidence")).alias("x"), "k", "id"))), lambda x: x["id"]).alias("ranked"))  # as many as classes
    rows = papers_of.join(best, ["doc_id", "dimension"], "left").withColumn("ranked", F.slice(F.coalesce("ranked", F.array().cast("array<string>")), 1, 3))
    right = metrics.accuracy(F.col("truth"), F.try_element_at("ranked", F.lit(1)), F.col("ranked"))
    return rows.groupBy("dimension").agg(*right).select("dimension", "n", F.round("exact", 6).alias("exact"), F.round("within", 6).alias("within"))


def token_islands(spark, sf_dir):
    """Capitalised words and the runs they form, without Python: a window over matches."""
    from ..functions.dialect import spans

    df = notes(spark, sf_dir).select("doc_id", "text", F.posexplode(spans(F.col("text"), r"\p{Lu}[\p{L}'’-]*")).alias("i", "s")).where(F.length("s.value") > 1)
    w = Window.partitionBy("doc_id").orderBy("i")
    gap = F.substring(F.col("text"), F.lag("s.end").over(w) + 1, F.col("s.start") - F.lag("s.end").over(w))
    new = F.when(gap == " ", 0).otherwise(1)
    rows = df.select("doc_id", "i", F.col("s.value").alias("value"), F.col("s.start").alias("start"), new.alias("new")).withColumn("island", F.sum("new").over(w))
    return rows.groupBy("doc_id", "island").agg(F.count(F.lit(1)).alias("n"), F.min("start").alias("start"))


def entity_cases(spark, sf_dir):
    """Every scored candidate in sentences whose outcome is written down by hand."""
    rows = scan(case_texts(spark, sf_dir)).select("doc_id", F.inline("scored"))
    return rows.select("doc_id", "category", "value", F.round("confidence", 6).alias("confidence"), F.array_join(F.transform("signals", lambda s: s["id"]), ",").alias("signals"), "unresolved")


def case_findings(spark, sf_dir):
    """What is found and what may be recovered in these sentences."""
    df = scan(case_texts(spark, sf_dir))
    part = lambda c: df.select("doc_id", F.lit(c).alias("kind"), F.explode(c).alias("f")).select("doc_id", "kind", "f.category", "f.value", "f.tier", F.round("f.confidence", 6).alias("confidence"))
    return part("findings").unionAll(part("recoverable"))


def case_risk(spark, sf_dir):
    """Risk and policy of these sentences."""
    df = scan(case_texts(spark, sf_dir)).withColumn("outcome", risk.evaluate(F.col("findings")))
    return df.select("doc_id", F.col("risk.score").alias("score"), F.col("risk.level").alias("level"), F.col("outcome.decision").alias("decision"), F.size("findings").alias("n_findings"))


def banner_counts(spark, sf_dir, found=core):
    """What a banner shows of a document's findings, and how many more there are."""
    df = settled(found(spark, sf_dir), "banner", check.banner(F.col("findings")))
    return df.select("doc_id", F.array_join("banner.shown", ", ").alias("shown"), F.col("banner.more").alias("more"))


def latency_summary(spark, sf_dir):
    return metrics.timing(table(spark, sf_dir, "events"), "value", "event_type").select("event_type", F.round("median", 6).alias("median"), "fastest", F.round("mean", 6).alias("mean"))


def label_accuracy(spark, sf_dir):
    """How often a document's language is that of its own source's most frequent one."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    counts = docs.groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n"))
    usual = counts.groupBy("source").agg(F.max_by("lang", F.struct("n", "lang")).alias("usual"), F.array_sort(F.collect_set("lang")).alias("langs"))
    return docs.join(usual, "source").groupBy("source").agg(*metrics.accuracy(F.col("lang"), F.col("usual"), F.col("langs"))).select("source", "n", F.round("exact", 6).alias("exact"), F.round("within", 6).alias("within"))


_FUNCTIONS = (
    entity_cases, case_findings, case_risk, banner_counts, latency_summary, label_accuracy,
    candidate_counts, tier_assignment, overlap_resolved, risk_per_document, risk_level_histogram, findings_by_value, findings_by_group, category_join, policy_decision, strongest_mention, redacted_text, pseudonym_map, output_offsets,
    synthetic_text, residual_findings, full_residual_findings, scan_delta, url_signals, highlights, class_confidence, classification, heading_lines, roadmap_rows, sensitivity_state, entity_candidates, scan_findings, scan_risk, recoverable_topk, confirmed_findings,
    prompt_rewrite, prompt_intent, feedback_records, latency_percentiles, rolling_latency, newest_events, quality_confusion, table_rows_as_text, stream_check, stream_metrics, latency_state, cleared_turns, class_accuracy, token_islands,
)
# The same questions, asked of the whole scan; SQL can't follow it.
_WHOLE = (
    candidate_counts, tier_assignment, overlap_resolved, risk_per_document, risk_level_histogram, findings_by_value, findings_by_group, category_join, policy_decision, strongest_mention,
    redacted_text, pseudonym_map, output_offsets, synthetic_text, scan_delta, highlights, feedback_records, quality_confusion,
)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f"rule_{name}": partial(rule_query, name) for name in RULES} | {f.__name__: f for f in _FUNCTIONS} | {f"full_{f.__name__}": partial(f, found=whole) for f in _WHOLE}
