"""Sentences with what must be found in them, written down by hand from the rules of
scoring: categories, values, confidences and signals. ``{G}`` and ``{F}`` stand for a given
name and a family name that change with the customer; Zorbla and Quintex are known to no
list. A text for each customer takes the sentences in turn.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .corpora import spread, table

CASES_FROM = 3_000_000_000
GIVEN, FAMILY = ("Sarah", "Kevin", "Laura"), ("Mitchell", "Campbell", "Roberts")

# Each: a sentence, then (category, value, confidence, signals, whether no list knows it).
P, O, L = "PERSON", "ORGANISATION", "LOCATION"
CASES: list[tuple[str, list[tuple[str, str, float, str, bool]]]] = [
    ("We heard that {G} {F} left early.", [(P, "{G} {F}", 1.0, "person-verb", False)]),
    ("It was Mr {F} again.", [(P, "{F}", 1.0, "title", False)]),
    ("please ask Dr {G} {F} now", [(P, "{G} {F}", 1.0, "title", False)]),
    ("Speak to engineer {G} about it.", [(P, "Speak", 0.0, "function-word-after,sentence-start", True), (P, "{G}", 0.9, "person-cue", False)]),
    ("a visit by the {G} was late.", [(P, "{G}", 0.35, "determiner-before,no-person-context", False)]),
    ("{G}'s laptop is slow.", [(P, "{G}", 0.73, "possessive,sentence-start", False)]),
    ("and yesterday Mark said no.", [(P, "Mark", 0.8, "person-verb,ambiguous-word", False)]),
    ("we saw Zorbla Quintex there.", [(P, "Zorbla Quintex", 0.2, "function-word-after", True)]),
    ("we saw Zorbla, nothing more", [(P, "Zorbla", 0.2, "no-person-context", True)]),
    ("we heard Zorbla said so; a zorbla is old", [(P, "Zorbla", 0.35, "person-verb,lowercase-elsewhere", True)]),
    ("we heard Zorbla said so, mail zorbla.q@example.com", [("EMAIL", "zorbla.q@example.com", 0.99, "", False), (P, "Zorbla", 1.0, "person-verb,identity-link", True)]),
    ("we saw {G} {F} there. later {F} agreed", [(P, "{G} {F}", 0.96, "", False), (P, "{F}", 0.95, "person-verb,known-person-token", True)]),
    ("then {G} from the finance team", [(P, "{G}", 1.0, "role-context", False)]),
    ("then {G} {F}, senior account manager", [(P, "{G} {F}", 1.0, "job-title", False)]),
    ("we use {G} report daily", [(P, "{G}", 0.45, "common-noun-after", False)]),
    ("we use Zorbla Report daily", [(P, "Zorbla Report", 0.05, "no-person-context,common-noun-inside", True)]),
    ("{G} {F}\nwrote to us", [(P, "{G} {F}", 1.0, "document-heading", False)]),
    ("we met Zorbla Logistics there", [(O, "Zorbla Logistics", 0.92, "", False)]),
    ("we met Zorbla (Pty) Ltd", [(O, "Zorbla (Pty) Ltd", 0.95, "", False), (P, "Pty", 0.2, "no-person-context", True), (P, "Ltd", 0.3, "", True)]),
    ("now Quintex is our largest customer", [(O, "Quintex", 0.85, "", False)]),
    ("now the vendor Quintex called", [(O, "Quintex", 0.78, "", False)]),
    ("now the vendor QUINTEX called", [(O, "QUINTEX", 0.88, "", False)]),
    ("now the vendor Quintex called, a quintex", [(O, "Quintex", 0.48, "lowercase-elsewhere", False)]),
    ("we like France a lot", []),
    ("we live in London now", [(L, "London", 0.92, "locative", False)]),
    ("so the London report came", [(L, "London", 0.22, "determiner-before,common-noun-after", False)]),
    ("go to 12 Baker Street", [("POSTAL_ADDRESS", "12 Baker Street", 0.85, "", False), (P, "Baker Street", 0.15, "common-noun-inside", True)]),
    ("then {G} said so. we use {G} daily", [(P, "{G}", 1.0, "person-verb", False), (P, "{G}", 0.75, "no-person-context,consistent-mention", False)]),
    ("{G} is here", [(P, "{G}", 0.45, "no-person-context,sentence-start", False)]),
    ("we met Zorbla Consultant", []),
    ("we use Sql-Prod daily", [("INTERNAL_HOST", "Sql-Prod", 0.86, "", False)]),
    ("then {G} Quintex said so", [(P, "{G} Quintex", 1.0, "person-verb", False)]),
    ("then Zorbla {F} said so", [(P, "Zorbla {F}", 1.0, "person-verb", False)]),
    ("then Zorbla {G} {F} said so", [(P, "{G} {F}", 1.0, "person-verb", False)]),
    ("the API is down", []),
    ("in case-48213 we wrote", [("CASE_ID", "case-48213", 0.93, "", False)]),
]


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


def _named(text: str, key: str) -> str:
    """A sentence with the names of a key filled in."""
    pick = lambda names, at: f"CASE {at} % {len(names)} " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(names)) + " END"
    return f"replace(replace({text}, '{{G}}', {pick(GIVEN, key)}), '{{F}}', {pick(FAMILY, f'({key} + 1)')})"


def case_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sentence for each customer. Keys go through the sentences, and after each round
    through the names."""
    sentence = "CASE c_custkey % {} {} END".format(len(CASES), " ".join(f"WHEN {i} THEN {_quoted(t)}" for i, (t, _) in enumerate(CASES)))
    rows = spread(table(spark, sf_dir, "customer"))
    return rows.select((F.col("c_custkey") + CASES_FROM).alias("doc_id"), F.expr(_named(f"({sentence})".replace("''", "\\'"), "c_custkey")).alias("text"))


def expected_sql(where: str = "true") -> str:
    """Rows ``doc_id, category, value, confidence, signals, unresolved`` of what must be found."""
    rows = ", ".join(f"({i}, {_quoted(c)}, {_quoted(v)}, {x}::double, {_quoted(s)}, {str(u).lower()})" for i, (_, found) in enumerate(CASES) for c, v, x, s, u in found)
    return f"""select c_custkey + {CASES_FROM} as doc_id, category, {_named('value', 'c_custkey')} as value, confidence, signals, unresolved
from customer join (values {rows}) as e(k, category, value, confidence, signals, unresolved) on c_custkey % {len(CASES)} = k where {where}"""
