"""Whether a document as a whole is meant to stay inside.

Signals come in families. One family alone, unless it is strong, can't make a document
internal, however many signals it has.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import classes as C
from ..functions.dialect import built_once, for_java, for_re2, let, portable, settled
from .classify import STRIP
from .rules import valid_texts
from .scoring import clamp, signal, weights

# Thresholds.
SENSITIVE, INTERNAL, LEAST_FAMILIES, STRONG_TERMS = 0.65, 0.35, 2, 3
MOST_LINES = 400


def strip(x: Column) -> Column:
    return F.regexp_replace(x, STRIP, "")


def lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def headings(text: Column) -> Column:
    return headings_of(F.slice(lines(text), 1, MOST_LINES))


def headings_of(some: Column) -> Column:
    """Lines that read as headings: marked, in capitals, or in title case."""
    # A heading has at most 80 characters besides the space and dashes around it.
    rest = lambda line: F.length(F.translate(line, " -\t\r\u00a0\u3000", ""))
    bare = lambda line: strip(F.regexp_replace(strip(line), portable(r"^-{2,}\s*|\s*-{2,}$"), ""))
    rows = F.transform(F.filter(some, lambda line: rest(line) <= 80), lambda line: F.struct(line.alias("line"), bare(line).alias("bare")))

    def is_heading(r: Column) -> Column:
        t = r["bare"]
        capitals = (t == F.upper(t)) & t.rlike("[A-Z]{3}")
        shape = r["line"].rlike(portable(r"^#{1,6}\s")) | capitals | t.rlike(portable(C.TITLE_LINE))
        return (t != "") & (F.length(t) <= 80) & ~t.rlike("[.!?,;]$") & shape

    return F.transform(F.filter(rows, is_heading), lambda r: F.regexp_replace(r["bare"], portable(r"^#{1,6}\s*"), ""))


def roadmap_rows(text: Column) -> Column:
    return roadmap_rows_of(lines(text))


def roadmap_rows_of(some: Column) -> Column:
    return F.size(F.filter(some, lambda line: line.rlike("[0-9]") & line.rlike(for_java(portable(C.ROADMAP_ROW, True)))))


# Lists of words, by their place in ``held_of``.
_LISTS = (C.CONFIDENTIAL_WORDS, C.PUBLIC_WORDS, *(terms for _, _, terms in C.SUBJECTS))


# Places behind those lists: lines that may name a section, and lines that may be rows of a plan.
SECTIONS, ROADMAP = len(_LISTS), len(_LISTS) + 1


def lines_with(texts: pa.Array, pattern: str, most: int | None = None) -> list[list[str]]:
    """For each text those of its (first) lines that hold a match for RE2."""
    cut = pc.split_pattern(texts, "\n")
    begins = cut.offsets.to_numpy()
    at = np.flatnonzero(pc.match_substring_regex(cut.values, pattern).to_numpy(zero_copy_only=False))
    rows = np.searchsorted(begins, at, "right") - 1
    if most is not None:
        kept = at - begins[rows] < most
        at, rows = at[kept], rows[kept]
    out: list[list[str]] = [[] for _ in range(len(texts))]
    for row, line in zip(rows.tolist(), cut.values.take(pa.array(at)).to_pylist(), strict=True):
        out[row].append(line)
    return out


def words_in(texts: pa.Array) -> list[list[list[str]]]:
    """For each list the words of it that each text contains. They are looked for one by one only
    where RE2 finds any of the list."""
    lower = [t.lower() for t in texts.to_pylist()]
    lowered, out = pa.array(lower, pa.string()), []
    for words in _LISTS:
        held: list[list[str]] = [[] for _ in lower]
        some = pc.match_substring_regex(lowered, "|".join(map(regex.escape, words)))
        for row in np.flatnonzero(some.to_numpy(zero_copy_only=False)).tolist():
            held[row] = [w for w in words if w in lower[row]]
        out.append(held)
    return out


def held_of(text: Column) -> Column:
    """For each list the words that a text, never null, contains, in the order of the list; then
    the lines that expressions are to look at for sections and for rows of a plan. RE2 ignores
    the case of more letters than they do, so no line is missed."""
    section, row_of_plan = (for_re2(p, True) for p in (C.SECTION_SUBJECT, C.ROADMAP_ROW))

    @F.arrow_udf(T._parse_datatype_string("array<array<string>>"))
    def run(texts: pa.Array) -> pa.Array:
        texts = valid_texts(texts)
        rows = zip(*words_in(texts), lines_with(texts, section, MOST_LINES), lines_with(texts, row_of_plan), strict=True)
        return pa.array(list(rows), pa.list_(pa.list_(pa.string())))

    return run(text)


def _found(text: Column, needed: Column, pattern: str) -> Column:
    """The first match, sought only where one of the words that it needs occurs."""
    java = for_java(portable(pattern, True))
    return F.when((F.size(needed) > 0) & text.rlike(java), strip(F.regexp_extract(text, java, 0)))


def _quoted(before: str, x: Column, after: str) -> Column:
    return F.concat(F.lit(before), x.cast("string"), F.lit(after))


SIGNED = "struct<signal:struct<id:string,weight:double,note:string>,family:string,strong:boolean>"


def _row(signal_: Column, family: Column | str | None, strong: Column | None = None) -> Column:
    family = F.lit(family) if not isinstance(family, Column) else family
    return F.struct(signal_.alias("signal"), family.cast("string").alias("family"), (strong if strong is not None else F.lit(False)).alias("strong")).cast(SIGNED)


def _subject(hits: Column, id: str, label: str) -> Column:
    def of(hits: Column) -> Column:
        n = F.size(hits)
        note = F.concat(F.lit(f"Discusses {label} ("), F.array_join(F.slice(hits, 1, 3), ", "), F.lit(")"))
        pick = lambda w: signal(f"topic:{id}", w, note)
        s = F.when(n >= STRONG_TERMS, pick(0.35)).when(n >= 2, pick(0.25)).otherwise(pick(0.12))
        return F.when(n > 0, _row(s, F.when(n >= 2, F.lit(f"topic:{id}")), n >= STRONG_TERMS))

    return let(hits, of)


def signed(text: Column, words: Column, candidates: Column, classification: Column, file_name: Column | None, sheets: Column | None, given_headings: Column | None) -> Column:
    """``array<struct<signal, family, strong>>``, those that apply, in order."""
    no_names = F.array().cast("array<string>")
    sheets = F.coalesce(sheets, no_names) if sheets is not None else no_names
    given = F.coalesce(given_headings, no_names) if given_headings is not None else no_names
    name = file_name if file_name is not None else F.lit(None).cast("string")
    mark, public = _found(text, words[0], C.CONFIDENTIAL_MARK), _found(text, words[1], C.PUBLIC_MARK)
    rows = [F.when(mark.isNotNull(), _row(signal("marker", 0.35, _quoted('Marked "', mark, '" in the content itself')), "markers"))]
    rows += [_subject(words[k], id, label) for k, (id, label, _) in enumerate(C.SUBJECTS, 2)]
    in_name = F.regexp_extract(name, portable(C.FILE_MARK, True), 0)
    rows.append(F.when(in_name != "", _row(signal("filename-marker", 0.3, _quoted('Whoever saved this named the file "', in_name, '"')), "markers")))
    rows.append(F.when(name.rlike(portable(C.FILE_SUBJECT, True)) & (name != ""), _row(signal("filename", 0.2, _quoted('The file name itself says "', name, '"')), "metadata")))
    named = F.concat(sheets, given, F.when(F.size(given) > 0, given).otherwise(headings_of(words[SECTIONS])))
    section = F.try_element_at(F.filter(named, lambda h: h.rlike(portable(C.SECTION_SUBJECT, True))), F.lit(1))
    rows.append(let(section, lambda h: F.when(h.isNotNull(), _row(signal("heading", 0.15, _quoted('Section or sheet named "', h, '"')), "metadata"))))
    ids = F.size(F.filter(candidates, lambda c: c["category"].isin("CUSTOMER_ID", "CASE_ID", "CONTRACT_ID", "EMPLOYEE_ID")))
    rows.append(let(ids, lambda n: F.when(n >= 5, _row(signal("identifier-table", 0.2, _quoted("Contains ", n, " customer or contract references — reads like an internal list")), "structure"))))
    companies = F.size(F.array_distinct(F.transform(F.filter(candidates, lambda c: c["category"] == "ORGANISATION"), lambda c: c["value"])))
    rows.append(let(companies, lambda n: F.when(n >= 3, _row(signal("customer-list", 0.12, _quoted("Names ", n, " different companies — possibly a customer list")), "structure"))))
    rows.append(let(roadmap_rows_of(words[ROADMAP]), lambda n: F.when(n >= 3, _row(signal("roadmap-rows", 0.18, _quoted("", n, " lines carry future quarters or target dates")), "structure"))))
    kind = classification["document_type"]
    sure = kind["confidence"] >= 0.8
    article = F.when(kind["label"].rlike("^[aeiouAEIOU]"), "an").otherwise("a")
    note = F.concat(F.lit("Reads like "), article, F.lit(" "), F.lower(kind["label"]))
    typed = lambda w: F.struct(F.concat(F.lit("type:"), kind["id"]).alias("id"), F.lit(w).alias("weight"), note.alias("note")).cast("struct<id:string,weight:double,note:string>")
    rows.append(F.when(kind["id"].isin(*C.SENSITIVE_TYPES), _row(F.when(sure, typed(0.4)).otherwise(typed(0.25)), "document-type", sure)))
    topic = F.try_element_at(F.filter(classification["topics"], lambda t: t["id"].isin(*C.SENSITIVE_TOPICS)), F.lit(1))
    about = lambda t: F.struct(F.concat(F.lit("subject:"), t["id"]).alias("id"), F.lit(0.15).alias("weight"), F.concat(F.lit("The subject is "), F.lower(t["label"])).alias("note")).cast("struct<id:string,weight:double,note:string>")
    rows.append(let(topic, lambda t: F.when(t.isNotNull(), _row(about(t), "subject"))))
    rows.append(F.when(public.isNotNull(), _row(signal("public-language", -0.35, _quoted('Reads as already-public material ("', public, '")')), None)))
    return F.array_compact(F.array(*rows))


def combined(rows: Column) -> Column:
    """State, confidence, wording and families from the signals that apply."""
    families = F.array_distinct(F.filter(F.transform(rows, lambda r: r["family"]), lambda f: f.isNotNull()))
    strong = F.exists(rows, lambda r: r["strong"])
    total = clamp(weights(F.transform(rows, lambda r: r["signal"])))
    labels = F.create_map(*(F.lit(x) for i, label, _ in C.SUBJECTS for x in (f"topic:{i}", label)))

    def of(fams: Column) -> Column:
        held_back = (F.size(fams) < LEAST_FAMILIES) & ~strong
        confidence = F.when(held_back, F.least(total, F.lit(INTERNAL - 0.01))).otherwise(total)

        def worded(x: Column) -> Column:
            state = F.when(x >= SENSITIVE, "sensitive").when(x >= INTERNAL, "internal").otherwise("general")
            headline = F.when(x >= SENSITIVE, "Potential company confidential information").when(x >= INTERNAL, "Possibly internal information").otherwise("Nothing suggests this is internal-only")
            named = F.slice(F.array_compact(F.transform(fams, lambda f: F.try_element_at(labels, f))), 1, 3)
            summary = F.when(x < INTERNAL, "We found no signs that this is meant to stay inside the company.").when(F.size(named) > 0, F.concat(F.lit("This looks like it covers "), F.array_join(named, ", "), F.lit(" — worth a second thought before sharing it with an AI tool."))).otherwise("Several signals suggest this is meant for internal use.")
            return F.struct(state.alias("state"), x.alias("confidence"), headline.alias("headline"), summary.alias("summary"), F.transform(rows, lambda r: r["signal"]).alias("signals"), fams.alias("topics"))

        return let(confidence, worded)

    return let(families, of)


@built_once
def _signed_plain() -> Column:
    return signed(F.col("__full"), F.col("__words"), F.col("candidates"), F.col("classification"), None, None, None)


@built_once
def _combined() -> Column:
    return combined(F.col("__signed"))


def assessed(df: DataFrame, text: str = "text", file_name: Column | None = None, sheets: Column | None = None, given_headings: Column | None = None) -> DataFrame:
    """``df`` (with ``candidates`` and ``classification``) with ``document``."""
    df = df.withColumn("__full", F.coalesce(F.col(text), F.lit("")))
    if "__words" not in df.columns:
        df = settled(df, "__words", held_of(F.col("__full")))
    plain = file_name is None and sheets is None and given_headings is None
    made = _signed_plain() if plain else signed(F.col("__full"), F.col("__words"), F.col("candidates"), F.col("classification"), file_name, sheets, given_headings)
    df = settled(df, "__signed", made)
    return settled(df, "document", _combined()).drop("__full", "__words", "__signed")
