"""Rewriting a prompt: what it wants, what it is about, and a template for that."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.dialect import let, portable
from .classify import STRIP

# Keywords of the intents and of the domains.
INTENTS = {
    "troubleshoot": ("fail", "failed", "failing", "failure", "error", "errors", "issue", "problem", "broken", "crash", "crashed", "not working", "does not work", "doesn’t work", "timeout", "timed out", "stuck", "hung", "unable", "cannot", "troubleshoot", "diagnose", "root cause", "why did", "why is", "debug"),
    "summarise": ("summarise", "summarize", "summary", "tl;dr", "key points", "main points", "brief me", "overview", "recap", "digest"),
    "draft": ("write", "draft", "reply", "respond", "response", "email", "e-mail", "message", "letter", "note to", "communicate", "announcement", "update the customer"),
    "analyse": ("analyse", "analyze", "analysis", "trend", "trends", "insight", "insights", "spreadsheet", "data", "numbers", "figures", "report", "compare", "breakdown", "statistics", "forecast"),
    "explain": ("explain", "what is", "what are", "how does", "how do", "meaning of", "difference between", "help me understand"),
    "review": ("review", "feedback", "improve this", "check this", "proofread", "critique", "sanity check", "is this correct"),
    "code": ("code", "script", "function", "powershell", "python", "bash", "sql query", "javascript", "regex", "stack trace", "exception", "compile"),
}
DOMAINS = {
    "backup and recovery": ("backup", "restore", "recovery", "repository", "snapshot", "replica", "replication", "retention", "tape", "immutable", "veeam", "vbr", "job run"),
    "virtualisation": ("vmware", "esxi", "vcenter", "hyper-v", "virtual machine", "vm ", "hypervisor", "datastore"),
    "database": ("sql", "database", "query", "index", "deadlock", "table", "postgres", "oracle"),
    "network": ("network", "firewall", "vlan", "latency", "dns", "vpn", "packet", "routing", "bandwidth", "port"),
    "security": ("security", "breach", "malware", "ransomware", "phishing", "vulnerability", "audit", "compliance"),
    "storage": ("storage", "disk", "volume", "lun", "nas", "san", "capacity", "quota"),
}
# Templates. {ask}, {Ask}, {domain}, {subject} and {where} are filled in.
STEPS = {
    "troubleshoot": ("Rewritten as a structured troubleshooting request.", "Identify the three most likely root causes, ordered by likelihood.", "For each cause, state the evidence that would confirm or rule it out — the specific logs, settings or checks to look at.", "Recommend the single next step to take first, and why."),
    "summarise": ("Rewritten as a focused summary request.", "Open with a three-sentence overview.", "List the key points as short bullets, most important first.", "Call out any decisions, risks, owners or deadlines mentioned."),
    "draft": ("Rewritten as a clear writing brief.", "Keep it under 150 words, professional and easy to scan.", "Acknowledge the situation, say what happens next, and give a timeframe.", "Stay factual — do not promise anything the notes do not support."),
    "analyse": ("Rewritten as an analysis brief.", "Describe the three most significant patterns, outliers or anomalies.", "Quantify each one — which values, how large the effect, over what period.", "Recommend what to investigate or act on next."),
    "explain": ("Rewritten as a clear explanation request.", "Start with a two-sentence plain-English definition.", "Explain why it matters in practice, with one concrete example.", "Note the most common misunderstanding about it."),
    "review": ("Rewritten as a review brief.", "Point out anything unclear, inconsistent, missing or incorrect — quote the exact text.", "Suggest a specific improvement for each issue.", "Finish with a corrected version."),
    "code": ("Rewritten as a technical code request.", "Explain what the code does and exactly where it goes wrong.", "Provide a corrected version, commenting only the non-obvious logic.", "List the edge cases worth testing."),
    "general": ("Rewritten as a clearer, more specific instruction.", "Answer directly first, then give the reasoning behind it.", "Flag anything you are uncertain about, and what extra detail would sharpen the answer.", "Finish with a recommended next step."),
}
CLOSING = "Keep the answer concise and practical. If something essential is missing, say what it is instead of guessing."
GREETING = r"^(?:hi|hey|hello|good (?:morning|afternoon|evening))\b[^.\n]*[,.]?\s*"
FILLER = r"^(?:please\s+|can you\s+|could you\s+|would you\s+|i need (?:you )?to\s+|i want (?:you )?to\s+|help me\s+(?:to\s+)?|pls\s+|just\s+)+"
MOST_ASK = 160


def strongest(lower: Column, table: dict[str, tuple[str, ...]]) -> Column:
    """The entry with the most terms in the text, the first of equals; null without any."""
    rows = [F.struct((-F.size(F.filter(F.array(*map(F.lit, v)), lambda t: F.contains(lower, t)))).alias("n"), F.lit(i).alias("i"), F.lit(k).alias("k")) for i, (k, v) in enumerate(table.items())]
    return let(F.array_min(F.array(*rows)), lambda best: F.when(best["n"] < 0, best["k"]))


def intent(text: Column) -> Column:
    return F.coalesce(strongest(F.lower(text), INTENTS), F.lit("general"))


def domain(text: Column) -> Column:
    return strongest(F.lower(text), DOMAINS)


def has_context(text: Column) -> Column:
    """More than two lines with text, or more than 220 characters."""
    return (F.size(F.filter(F.split(text, "\n", -1), lambda x: F.regexp_replace(x, STRIP, "") != "")) > 2) | (F.length(text) > 220)


def ask(text: Column) -> Column:
    """The first sentence without greeting and filler, at most 160 characters."""
    paragraph = F.element_at(F.split(text, portable(r"\n\s*\n"), 2), 1)
    sentence = F.element_at(F.split(paragraph, portable(r"(?<=[.?!])\s+"), 2), 1)
    x = F.regexp_replace(F.regexp_replace(sentence, portable(GREETING, True), ""), portable(FILLER, True), "")
    x = F.regexp_replace(F.regexp_replace(F.regexp_replace(x, portable(r"\s+"), " "), STRIP, ""), "[?.!]+$", "")
    return let(x, lambda a: F.when(F.length(a) > MOST_ASK, F.concat(F.regexp_replace(F.substring(a, 1, MOST_ASK - 3), portable(r"\s+$"), ""), F.lit("…"))).otherwise(a))


def _capital(x: Column) -> Column:
    return F.concat(F.upper(F.substring(x, 1, 1)), F.substring(x, 2, 1 << 20))


def _lead(kind: Column, a: Column, d: Column, where: Column) -> Column:
    words = F.array_join(F.slice(F.split(a, " ", -1), 1, 8), " ")
    subject = F.coalesce(F.concat(d, F.lit(" question")), F.when(F.length(words) > 3, F.lower(words)).otherwise("request"))
    say = lambda *x: F.concat(*(F.lit(y) if isinstance(y, str) else y for y in x))
    some = a != ""
    # The first lines of the templates.
    return (
        F.when(kind == "troubleshoot", say("Act as an experienced ", F.coalesce(d, F.lit("IT")), " engineer. Diagnose the problem described ", where, "."))
        .when(kind == "summarise", say("Summarise the content ", where, " for a busy colleague."))
        .when(kind == "draft", say(F.when(some, _capital(a)).otherwise("Draft a professional reply"), ", using the information ", where, "."))
        .when(kind == "analyse", say("Analyse the data ", where, " and tell me what it shows."))
        .when(kind == "explain", say("Explain ", F.when(some, F.regexp_replace(a, portable(r"^explain\s+", True), "")).otherwise(say("the topic ", where)), " clearly, for a knowledgeable but non-specialist reader."))
        .when(kind == "review", say("Review the content ", where, " critically."))
        .when(kind == "code", say("Act as an experienced ", F.coalesce(d, F.lit("software")), " engineer. Work through the code ", where, "."))
        .otherwise(F.when(some, say(_capital(a), ", using the information ", where, ".")).otherwise(say("Help with the ", subject, " ", where, ".")))
    )


def improved(prompt: Column) -> Column:
    """``struct<text, intent, domain, ask, note>``. An empty or null prompt has nothing to
    improve."""
    table = lambda k: F.create_map(*(F.lit(x) for i, v in STEPS.items() for x in (i, v[k])))

    def of(text: Column) -> Column:
        def built(s: Column) -> Column:
            kind, a, d = s["kind"], s["ask"], s["domain"]
            context = has_context(text)
            steps = [F.concat(F.lit(f"{k}. "), F.element_at(table(k), kind)) for k in (1, 2, 3)]
            details = F.when(context, F.concat(F.lit('\n\nDetails:\n"""\n'), text, F.lit('\n"""'))).when((a != "") & ~kind.isin("general", "draft", "explain"), F.concat(F.lit("\n\nContext: "), a, F.lit("."))).otherwise("")
            lead = _lead(kind, a, d, F.when(context, "below").otherwise("here"))
            out = F.concat(lead, F.lit("\n\nPlease:\n"), F.concat_ws("\n", *steps), details, F.lit(f"\n\n{CLOSING}"))
            return F.struct(out.alias("text"), kind.alias("intent"), d.alias("domain"), a.alias("ask"), F.element_at(table(0), kind).alias("note"))

        some = let(F.struct(intent(text).alias("kind"), ask(text).alias("ask"), domain(text).alias("domain")), built)
        empty = F.struct(F.lit("").alias("text"), F.lit("general").alias("intent"), F.lit(None).cast("string").alias("domain"), F.lit("").alias("ask"), F.lit("Nothing to improve yet.").alias("note"))
        return F.when(text == "", empty).otherwise(some)

    return let(F.regexp_replace(F.coalesce(prompt, F.lit("")), STRIP, ""), of)
