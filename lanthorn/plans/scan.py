"""The scan: one narrow projection chain over documents, without a shuffle.

A document is a row from start to end, its candidates and findings arrays in it, so the
whole scan runs where the text is read. Explode the arrays only for what must be grouped
over documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dialect import built_once, settled
from ..functions.vocab import Vocabulary
from ..operators.classify import classified, weighed
from ..operators.entities import entity_candidates
from ..operators.resolve import declined, findings, recoverable
from ..operators.risk import risk
from ..operators.rules import CANDIDATE, LAYERS, rule_candidates
from ..operators.scoring import score
from ..operators.sensitivity import assessed, held_of


@built_once
def _rules(text: str) -> Column:
    return rule_candidates(F.col(text), LAYERS)


@built_once
def _scored() -> Column:
    return score(F.col("candidates"), F.col("document.state"))


@built_once
def _outcome(name: str) -> Column:
    scored, found = F.col("scored"), F.col("findings")
    make = {"findings": lambda: findings(scored), "recoverable": lambda: recoverable(scored, found), "declined": lambda: declined(scored, F.col("recoverable")), "risk": lambda: risk(found)}
    return make[name]()


def with_candidates(df: DataFrame, text: str = "text", vocabulary: Vocabulary = Vocabulary()) -> DataFrame:
    """``df`` with ``candidates``, unscored, in the order that settles ties: patterns,
    entities, business rules, confidential rules."""
    return _joined(settled(df, "__rules", _rules(text)), text, vocabulary)


def _joined(df: DataFrame, text: str, vocabulary: Vocabulary) -> DataFrame:
    r = F.col("__rules")
    df = df.withColumn("__entity", entity_candidates(F.col(text), F.concat(*(r[x] for x in LAYERS)), vocabulary))
    df = settled(df, "candidates", F.concat(r["pattern"], F.col("__entity"), r["business"], r["confidential"]))
    return df.drop("__rules", "__entity")


@built_once
def _words(text: str) -> Column:
    return held_of(F.coalesce(F.col(text), F.lit("")))


@built_once
def _weighed(text: str) -> Column:
    return weighed(F.coalesce(F.col(text), F.lit("")), F.lit(""))


def read(df: DataFrame, text: str, classes: bool) -> DataFrame:
    """``df`` with all that is read from a text alone, side by side, so that a text goes to
    Python once for it and takes no candidates along: matches of the rules, words, and, where no
    file name counts, what speaks for each class."""
    made = {"__rules": _rules(text), "__words": _words(text)} | ({"__weighed": _weighed(text)} if classes else {})
    return df.withColumns({name: F.when(F.spark_partition_id() >= 0, value) for name, value in made.items()})


def scan(df: DataFrame, text: str = "text", vocabulary: Vocabulary = Vocabulary(), file_name: Column | None = None, sheets: Column | None = None, headings: Column | None = None, delimiter: Column | None = None, extra: Column | None = None, classifier: Callable[..., DataFrame] = classified) -> DataFrame:
    """``df`` with ``candidates``, ``classification``, ``document``, ``scored``,
    ``findings``, ``recoverable``, ``declined`` and ``risk``. A null text has no findings.
    ``extra`` adds the candidates of a detector of one's own, last in the order that settles
    ties; ``classifier`` stands in for ``classified``."""
    df = read(df, text, classifier is classified and file_name is None and sheets is None)
    df = _joined(df, text, vocabulary)
    if extra is not None:
        df = settled(df, "candidates", F.concat("candidates", F.coalesce(extra, F.array()).cast(f"array<{CANDIDATE}>")))
    df = classifier(df, text, file_name, sheets).drop("__weighed")
    df = assessed(df, text, file_name, sheets, headings)
    df = settled(df, "scored", _scored())
    plain = delimiter is None
    df = settled(df, "findings", _outcome("findings") if plain else findings(F.col("scored"), delimiter))
    df = settled(df, "recoverable", _outcome("recoverable") if plain else recoverable(F.col("scored"), F.col("findings"), delimiter))
    df = df.withColumn("declined", _outcome("declined") if plain else declined(F.col("scored"), F.col("recoverable"), delimiter))
    return df.withColumn("risk", _outcome("risk"))


def finding_rows(scanned: DataFrame, *keys: str) -> DataFrame:
    """A row for each finding."""
    return scanned.select(*keys, F.inline("findings"))
