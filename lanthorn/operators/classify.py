"""What kind of document a text is, what it is about, and whose it is.

Each class adds up evidence: patterns, strong terms, terms, terms against it, the file
name. All classes are weighed in one pass over the whole text, an Arrow UDF without a
join; a pattern is searched only where the literal that it needs occurs.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.classes import CLASSES, FILE_HINTS, TOPIC_FUNCTION, TYPE_TOPIC, DocClass
from ..functions.dialect import ODD_CASE, built_once, for_re2, portable, required_literal, settled
from .rules import valid_texts

CUT = 0.45
CLASS = "struct<dimension:string,id:string,label:string,confidence:double,evidence:array<string>,inferred:boolean>"
STRIP = portable(r"^\s+|\s+$")
_STRIP = regex.compile(STRIP)
# Below the cut, whatever the rounding.
LEAST_RAW = 0.4
# Weights of the evidence.
PATTERN, STRONG, TERM, AGAINST, FILE_NAME = 0.5, 0.3, 0.08, -0.35, 0.3
# As many terms as it takes to be above ``LEAST_RAW`` without anything else.
ENOUGH_TERMS = 6
TOPIC_SHARE, FUNCTION_SHARE = 0.7, 0.65


@dataclass(frozen=True)
class Evidence:
    """A class with its patterns compiled, each with the literal that it needs."""

    of: DocClass
    patterns: tuple[tuple[regex.Pattern, bool, str], ...]
    hint: regex.Pattern | None

    @staticmethod
    def made(c: DocClass) -> Evidence:
        def compiled(pattern: str) -> tuple[regex.Pattern, bool, str]:
            heeds_case = pattern.startswith("=")
            pattern = pattern.removeprefix("=")
            literal = "" if pattern.startswith("(?m)") else required_literal(pattern)
            return regex.compile(portable(pattern, not heeds_case)), heeds_case, (literal if heeds_case else literal.lower()) if len(literal) > 2 else ""

        hint = FILE_HINTS.get(c.id)
        return Evidence(c, tuple(map(compiled, c.patterns)), regex.compile(portable(hint, True)) if hint else None)

    @property
    def needed(self) -> str:
        """For RE2: what a lower-cased text has where more than terms speaks for the class."""
        patterns = (f"(?:{for_re2(p.removeprefix('='))})" for p in self.of.patterns)
        return "(?i)" + "|".join((*patterns, *map(regex.escape, self.of.strong), f"(?-i:[{ODD_CASE}])"))

    def plausible(self, lowered: pa.Array, lower: list[str], held: np.ndarray) -> list[int]:
        """The rows of texts that may reach the cut: those held, and those with enough terms."""
        rows = np.flatnonzero(held).tolist()
        if len(self.of.terms) >= ENOUGH_TERMS:
            some = pc.match_substring_regex(lowered, "|".join(map(regex.escape, self.of.terms))).to_numpy(zero_copy_only=False) & ~held
            rows += [k for k in np.flatnonzero(some).tolist() if sum(t in lower[k] for t in self.of.terms) >= ENOUGH_TERMS]
        return rows

    def weighed(self, text: str, lower: str, file_name: str) -> tuple[float, list[str]]:
        """The weights that apply, added up, and why."""
        raw, why = 0.0, []
        for pattern, heeds_case, literal in self.patterns:
            if literal in (text if heeds_case else lower) and (m := pattern.search(text)):
                raw += PATTERN
                why.append(f'says "{_STRIP.sub("", m[0])[:40]}"')
        strong, terms = ([t for t in some if t in lower] for some in (self.of.strong, self.of.terms))
        if strong:
            raw += STRONG * min(len(strong), 3)
            why.append(f"mentions {', '.join(strong[:3])}")
        if terms:
            raw += TERM * min(len(terms), 6)
            if not strong:
                why.append(f"uses {', '.join(terms[:3])}")
        for t in self.of.against:
            if t in lower:
                raw += AGAINST
        if self.hint is not None and file_name and self.hint.search(file_name):
            raw += FILE_NAME
            why.append("the file name matches")
        return raw, why


WEIGHED = "struct<k:int,raw:double,evidence:array<string>>"
_WEIGHED_ARROW = pa.list_(pa.struct([("k", pa.int32()), ("raw", pa.float64()), ("evidence", pa.list_(pa.string()))]))


def weighed(text: Column, file_name: Column) -> Column:
    """What speaks for each class, of those that may reach the cut, by its place in the list."""
    some = [Evidence.made(c) for c in CLASSES]

    @F.arrow_udf(T._parse_datatype_string(f"array<{WEIGHED}>"))
    def run(texts: pa.Array, names: pa.Array) -> pa.Array:
        texts, names = valid_texts(texts), valid_texts(names)
        plain = texts.to_pylist()
        lower = [(t or "").lower() for t in plain]
        lowered, out = pa.array(lower, pa.string()), [[] for _ in plain]
        named = pc.fill_null(pc.not_equal(names, ""), False)
        for k, e in enumerate(some):
            held = pc.or_(pc.match_substring_regex(lowered, e.needed), named)
            for row in e.plausible(lowered, lower, held.to_numpy(zero_copy_only=False)):
                raw, why = e.weighed(plain[row] or "", lower[row], names[row].as_py())
                if raw > LEAST_RAW:
                    out[row].append({"k": k, "raw": raw, "evidence": why})
        return pa.array(out, _WEIGHED_ARROW)

    return run(text, file_name)


def ranked(dimension: str, rows: Column) -> Column:
    """The classes of a dimension that reach the cut, surest first, ties by the list."""
    names = F.array(*(F.struct(F.lit(c.dimension).alias("dimension"), F.lit(c.id).alias("id"), F.lit(c.label).alias("label")) for c in CLASSES))
    mine = [k for k, c in enumerate(CLASSES) if c.dimension == dimension]

    def surer(r: Column) -> Column:
        name, x = F.element_at(names, r["k"] + 1), 1 - F.exp(-r["raw"] / 0.8)
        c = F.struct(*(name[f].alias(f) for f in ("dimension", "id", "label")), x.alias("confidence"), r["evidence"].alias("evidence"), F.lit(False).alias("inferred")).cast(CLASS)
        return F.struct((-x).alias("x"), r["k"].alias("i"), c.alias("c"))

    keyed = F.filter(F.transform(F.filter(rows, lambda r: r["k"].isin(mine)), surer), lambda k: k["c"]["confidence"] >= CUT)
    return F.transform(F.array_sort(keyed), lambda k: k["c"])


def _inferred(dimension: str, mapping: dict[str, str], source: Column, share: float, why: str) -> Column:
    """The class that another one stands for; null if it stands for none."""
    labels = {c.id: c.label for c in CLASSES if c.dimension == dimension}
    to_map = lambda d: F.create_map(*(F.lit(x) for kv in d.items() for x in kv))
    target = F.try_element_at(to_map(mapping), source["id"])
    evidence = F.array(F.concat(F.lit(f"inferred from the {why} ("), F.lower(source["label"]), F.lit(")")))
    row = F.struct(F.lit(dimension).alias("dimension"), target.alias("id"), F.try_element_at(to_map(labels), target).alias("label"), (source["confidence"] * share).alias("confidence"), evidence.alias("evidence"), F.lit(True).alias("inferred")).cast(CLASS)
    return F.when(target.isNotNull(), row)


@built_once
def _ranked_all() -> Column:
    rows = F.col("__weighed")
    return F.struct(ranked("documentType", rows).alias("types"), F.slice(ranked("topic", rows), 1, 3).alias("topics"), F.slice(ranked("function", rows), 1, 2).alias("functions"))


def classified(df: DataFrame, text: str = "text", file_name: Column | None = None, sheets: Column | None = None) -> DataFrame:
    """``df`` with ``classification``: struct of ``topics``, ``document_type``,
    ``functions`` and ``summary``. A null text is empty."""
    name = F.concat_ws(" ", F.nullif(file_name, F.lit("")) if file_name is not None else F.lit(None).cast("string"), sheets if sheets is not None else F.lit(None).cast("string"))
    df = df.withColumn("__whole", F.coalesce(F.col(text), F.lit(""))).withColumn("__name", name)
    if "__weighed" not in df.columns:
        df = settled(df, "__weighed", weighed(F.col("__whole"), F.col("__name")))
    df = settled(df, "__ranked", _ranked_all())
    df = df.withColumns({"__types": F.col("__ranked.types"), "__topics": F.col("__ranked.topics"), "__functions": F.col("__ranked.functions")})
    kind = F.try_element_at("__types", F.lit(1))
    own = lambda found, guess: F.when((F.size(found) > 0) | guess.isNull(), found).otherwise(F.array(guess))
    df = settled(df, "__all_topics", own(F.col("__topics"), _inferred("topic", TYPE_TOPIC, kind, TOPIC_SHARE, "document type")))
    subject = F.try_element_at("__all_topics", F.lit(1))
    df = settled(df, "__all_functions", own(F.col("__functions"), _inferred("function", TOPIC_FUNCTION, subject, FUNCTION_SHARE, "subject")))
    parts = F.array_compact(F.array(kind["label"], F.when(F.size("__all_topics") > 0, F.array_join(F.transform("__all_topics", lambda t: t["label"]), " and ")), F.concat(F.try_element_at("__all_functions", F.lit(1))["label"], F.lit(" area"))))
    summary = F.when(F.size(parts) > 0, F.array_join(parts, " · ")).otherwise("No clear document type")
    df = df.withColumn("classification", F.struct(F.col("__all_topics").alias("topics"), kind.alias("document_type"), F.col("__all_functions").alias("functions"), summary.alias("summary")))
    return df.drop("__whole", "__name", "__weighed", "__ranked", "__types", "__topics", "__functions", "__all_topics", "__all_functions")
