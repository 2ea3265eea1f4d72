"""People, companies, places and street addresses.

Which capitalised words belong together, and what their surroundings say, depends on
word lists and on the order of decisions; this is an Arrow UDF over whole batches. Each
document is read once: its words become runs, each run goes through a chain of
recognisers until one claims it, and what they propose gets its context signals.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from dataclasses import dataclass
from functools import cached_property, lru_cache
from string import ascii_letters

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import vocab as V
from ..functions.dialect import SPACES, for_re2, portable
from .rules import CANDIDATE, SIGNAL_ARROW, candidate_arrays, valid_texts

# Base scores.
BASE = {
    "titled_full": 0.9, "titled_single": 0.85, "given_family": 0.96, "given_or_family": 0.85, "given": 0.7, "unknown_phrase": 0.45, "unknown_word": 0.3,
    "company_word": 0.92, "company_ending": 0.95, "owned": 0.85, "capitals_after_cue": 0.88, "after_cue": 0.78, "place": 0.72, "street": 0.85,
}
# Patterns.
TITLES = "mr|mrs|ms|miss|dr|prof|sir|madam|mnr|mev|dhr"
STREET = r"\b\d{1,5}[A-Za-z]?\s+(?:[A-Z][A-Za-z'-]+\s+){0,3}(?:Street|St\.?|Road|Rd\.?|Avenue|Ave\.?|Drive|Dr\.?|Lane|Ln\.?|Boulevard|Blvd\.?|Way|Close|Crescent|Court|Ct\.?|Place|Terrace|Park|Square)\b(?:,?\s*(?:Unit|Suite|Apt|Flat|Block)\s*\w+)?"
OWNERSHIP = r"\s+(?:is|are|remains|became|has been)\s+(?:one of\s+)?(?:our|a|an|the|their)\s+(?:largest\s+|biggest\s+|key\s+|new\s+|existing\s+|current\s+|main\s+|top\s+)?(?:customer|client|partner|reseller|vendor|supplier|tenant|account|prospect|distributor)\b"
TEAM = r"\s+(?:from|in|of|on|at)\s+(?:the\s+)?(?:[a-z]+\s+){0,2}(?:team|teams|department|dept|office|desk|group|division|unit|side|accounts|accounting|finance|sales|support|marketing|engineering|operations|ops|legal|procurement|payroll|hr|it|security|billing|logistics)\b"
JOB = r"\s*[,(]\s*(?:senior|junior|lead|head|chief|principal|associate|assistant|deputy|acting|global|regional)?\s*(?:account|sales|support|service|technical|solutions|customer|project|product|programme|program|delivery|operations|finance|hr|it|security|marketing|field|pre-sales|presales)?\s*(?:manager|director|engineer|architect|consultant|specialist|analyst|administrator|admin|lead|officer|executive|president|partner|advisor|adviser|representative|rep|coordinator|supervisor|technician|developer|designer|owner|scientist)\b"


def _compiled(pattern: str, ignore_case: bool = False):
    return regex.compile(portable(pattern, ignore_case))


_CAPITALISED = regex.compile(r"\p{Lu}[\p{L}'’-]*")
# For ASCII texts, which ``re`` reads faster.
_CAPITALISED_ASCII, _LOWER_ASCII = re.compile("[A-Z][A-Za-z'-]*"), re.compile("[a-z][a-z'-]{2,}")
_LETTERS = frozenset(ascii_letters)
_CONTRACTION = regex.compile(r"['’](?:s|d|m|re|ve|ll|t)$", regex.I | regex.A)
_TITLE = re.compile(rf"(?:{TITLES})\.?", re.I | re.A)
_BARE_TITLE = re.compile(TITLES)
_END_DIGITS, _PARTED, _EMAIL_PARTS = re.compile("[0-9]+$"), re.compile("[-_.]"), re.compile(r"[._+\-0-9]+")
_STREET, _OWNED, _TEAM, _JOB = _compiled(STREET), _compiled(OWNERSHIP, True), _compiled(TEAM), _compiled(JOB, True)
_OWN = _compiled(r"['’]s\b")
_AFTER = re.compile(r"[ \t,)]*([A-Za-z']+)")
_ENDING = regex.compile(rf"[{SPACES}]+(?:{'|'.join(map(re.escape, V.COMPANY_ENDINGS))})(?![A-Za-z])")
_CAPITALS = re.compile(r"[A-Z][A-Z0-9&.]+")
_SHORT_ACRONYM = re.compile(r"[A-Z0-9]{2,6}")
_LOWER_WORD = regex.compile(r"\p{Ll}[\p{Ll}'-]{2,}")
_GAP = regex.compile(f"[{SPACES}]+")
_SPACE = frozenset(c for c in map(chr, range(0x10000)) if _GAP.fullmatch(c))
# What can stand between a name and a job title.
_BEFORE_JOB = _SPACE | {",", "("}
_PHRASE_GAP = regex.compile(f"[{SPACES}/-]+")


class Word:
    __slots__ = ("text", "start", "end", "lower")

    def __init__(self, text: str, start: int):
        self.text, self.start, self.end, self.lower = text, start, start + len(text), text.lower()


def runs(text: str) -> list[list[Word]]:
    """Capitalised words, without contractions, of two letters or more; words that a
    single space parts are one run."""
    out: list[list[Word]] = []
    for m in (_CAPITALISED_ASCII if text.isascii() else _CAPITALISED).finditer(text):
        word = m[0]
        if "'" in word or "’" in word:
            word = _CONTRACTION.sub("", word)
        if len(word) < 2:
            continue
        w = Word(word, m.start())
        if out and w.start - out[-1][-1].end == 1 and text[w.start - 1] == " ":
            out[-1].append(w)
        else:
            out.append([w])
    return out


def _together(group: list[Word]) -> str:
    return group[0].lower if len(group) == 1 else "".join([w.lower for w in group])


def word_before(text: str, at: int) -> str:
    if at == 0 or (text[at - 1] not in _LETTERS and text[at - 1] not in " \t\n"):
        return ""
    before = text[max(0, at - 60) : at].removesuffix("\n").rstrip(" \t")
    return before[len(before.rstrip(ascii_letters)) :].lower()


# Names come again and again; what is kept of them is bounded.
MOST_KEPT = 1 << 14


@lru_cache(maxsize=MOST_KEPT)
def _phrase_words(phrase: str) -> frozenset[str]:
    return frozenset(_PHRASE_GAP.split(phrase.lower()))


def any_word(phrase: str, known: frozenset[str]) -> bool:
    return not known.isdisjoint(_phrase_words(phrase))


@lru_cache(maxsize=MOST_KEPT)
def is_infrastructure(name: str) -> bool:
    return any(_END_DIGITS.sub("", part).upper() in V.INFRASTRUCTURE for part in _PARTED.split(name))


@lru_cache(maxsize=MOST_KEPT)
def _is_title(word: str) -> bool:
    return _TITLE.fullmatch(word) is not None


@lru_cache(maxsize=MOST_KEPT)
def acronym(word: str) -> bool:
    return word.upper() in V.ACRONYMS


class Recogniser:
    """Proposes ``(category, start, end, rule, base, single, unresolved)``."""

    def __init__(self, vocabulary: V.Vocabulary):
        self.v = vocabulary
        #: What single words are, by whether a title stands before them.
        self.single: dict[tuple[str, bool], tuple] = {}

    def given(self, w: Word) -> bool:
        return w.lower in self.v.given_names

    def family(self, w: Word) -> bool:
        return w.lower in self.v.family_names

    def propose(self, text: str, street: bool):
        for run in runs(text):
            if len(run) == 1:
                w = run[0]
                if acronym(w.text) or w.lower in V.STARTERS:
                    continue
                cue = word_before(text, w.start)
                claimed = self.claimed(text, run, cue, _is_title(cue))
            else:
                if all(acronym(w.text) for w in run) or all(w.lower in V.STARTERS for w in run):
                    continue
                claimed = self.claimed(text, *self.without_cues(text, run))
            if claimed:
                yield claimed
        for m in _STREET.finditer(text) if street else ():
            yield "POSTAL_ADDRESS", m.start(), m.end(), "Street address", BASE["street"], False, False

    @staticmethod
    def without_cues(text: str, run: list[Word]) -> tuple[list[Word], str, bool]:
        """Leading titles, cues and sentence starters are context, save for the last word."""
        cue = word_before(text, run[0].start)
        titled = _is_title(cue)
        for k, w in enumerate(run):
            if k == len(run) - 1:
                return run[k:], cue, titled
            title = _is_title(w.text)
            known = w.lower in V.PERSON_CUES or w.lower in V.SEEKING_CUES or w.lower in V.COMPANY_CUES or w.lower in V.STARTERS
            if not (title or known):
                return run[k:], cue, titled
            if title:
                titled = True
            else:
                cue = w.lower
        raise AssertionError("a run has a word")

    def claimed(self, text: str, group: list[Word], cue: str, titled: bool):
        """What the first recogniser that knows the run says. Those are asked whose least
        condition holds."""
        end, out = group[-1].end, None
        if len(group) > 1:
            out = self.company_by_word(text, group, cue, titled)
        if out is None and text[end : end + 1] in _SPACE:
            out = self.company_by_ending(text, group, cue, titled)
            if out is None:
                out = self.company_owned(text, group, cue, titled)
        if out is None and cue in V.COMPANY_CUES:
            out = self.company_by_cue(text, group, cue, titled)
        if out is None:
            name = _together(group)
            if name in V.COUNTRIES:
                return ()
            out = self.place(text, group, cue, titled) if name in V.PLACES else self.person(text, group, cue, titled)
        return out

    # Each recogniser returns a proposal, () to drop the run, or None to pass it on.

    def company_by_word(self, text, group, cue, titled):
        last = group[-1]
        if len(group) > 1 and last.lower.removesuffix(".") in V.COMPANY_WORDS and _GAP.split(text[group[0].start : last.end].lower())[0] not in V.MODIFIERS:
            return "ORGANISATION", group[0].start, last.end, f'Company name ending in "{last.text}"', BASE["company_word"], False, False
        return None

    def company_by_ending(self, text, group, cue, titled):
        end = group[-1].end
        m = text[end : end + 1] in _SPACE and _ENDING.match(text, end)
        if m and not acronym(group[0].text):
            return "ORGANISATION", group[0].start, m.end(), "Company name with trading suffix", BASE["company_ending"], False, False
        return None

    def company_owned(self, text, group, cue, titled):
        start, end = group[0].start, group[-1].end
        if text[end : end + 1] in _SPACE and _OWNED.match(text, end) and not acronym(text[start:end]):
            return "ORGANISATION", start, end, "Named as a customer, client or partner", BASE["owned"], len(group) == 1, False
        return None

    def company_by_cue(self, text, group, cue, titled):
        if cue not in V.COMPANY_CUES:
            return None
        start, end = group[0].start, group[-1].end
        value = text[start:end]
        if self.given(group[0]) or any_word(value, V.JOB_WORDS) or any_word(value, V.INSTITUTIONS) or acronym(value):
            return None
        base = BASE["capitals_after_cue" if _CAPITALS.fullmatch(group[0].text) else "after_cue"]
        return "ORGANISATION", start, end, f'Company name after "{cue}"', base, len(group) == 1, False

    def place(self, text, group, cue, titled):
        if _together(group) in V.PLACES:
            return "LOCATION", group[0].start, group[-1].end, "Known city or country", BASE["place"], len(group) == 1, False
        return None

    def person(self, text, group, cue, titled):
        if len(group) == 1:
            w = group[0]
            kind = self.single.get((w.text, titled))
            if kind is None:
                if len(self.single) >= MOST_KEPT:
                    self.single.clear()
                kind = self.single[w.text, titled] = self.named(text, group, titled)[3:]
            return kind and ("PERSON", w.start, w.end, *kind)
        return self.named(text, group, titled)

    def named(self, text, group, titled):
        """A person by the words alone, or ()."""
        names = [w for w in group if not acronym(w.text)]
        while len(names) > 1 and not self.given(names[0]) and not self.family(names[0]) and self.given(names[1]):
            names = names[1:]
        if not names or is_infrastructure(text[names[0].start : names[-1].end]):
            return ()
        head, tail, several = names[0], names[-1], 2 <= len(names) <= 4
        base, rule, unresolved = self.person_rank(titled, several, len(names) == 1, self.given(head), self.family(tail))
        value = text[head.start : tail.end]
        if unresolved:
            role = any_word(value, V.JOB_WORDS) or any_word(value, V.INSTITUTIONS)
            certificate = len(names) > 1 and _SHORT_ACRONYM.fullmatch(tail.text) and not _SHORT_ACRONYM.fullmatch(head.text)
            if role or certificate:
                return ()
        return "PERSON", head.start, tail.end, rule, base, len(names) == 1, unresolved

    @staticmethod
    def person_rank(titled: bool, several: bool, one: bool, given: bool, family: bool) -> tuple[float, str, bool]:
        table = (
            (titled and several, "titled_full", "Title followed by a full name"),
            (titled, "titled_single", "Title followed by a name"),
            (several and given and family, "given_family", "Known given name and surname"),
            (several and given, "given_or_family", "Known given name followed by a capitalised surname"),
            (several and family, "given_or_family", "Capitalised word followed by a known surname"),
            (one and given, "given", "Known given name"),
        )
        for fits, base, rule in table:
            if fits:
                return BASE[base], rule, False
        return (BASE["unknown_phrase"], "Capitalised words that may be a name", True) if several else (BASE["unknown_word"], "Capitalised word that may be a name", True)


@dataclass
class Surroundings:
    """What a document says about its own words."""

    text: str
    machine_spans: list[tuple[int, int]]
    emails: list[str]
    people: list[str]

    @cached_property
    def lower_words(self) -> set[str]:
        """Lower-case words of the prose; spans that machines read are left out."""
        parts, at = [], 0
        for s, e in sorted(self.machine_spans):
            if e > at:
                parts += [self.text[at : max(s, at)], " "]
                at = e
        prose = "".join(parts) + self.text[at:]
        return set((_LOWER_ASCII if prose.isascii() else _LOWER_WORD).findall(prose))

    @cached_property
    def email_parts(self) -> set[str]:
        return {p for e in self.emails for p in _EMAIL_PARTS.split(e.split("@")[0].lower()) if len(p) >= 3}

    @cached_property
    def strong_names(self) -> set[str]:
        return {t for v in self.people for t in _GAP.split(v.lower()) if len(t) >= 3}

    @cached_property
    def heading_end(self) -> int:
        """Where the first three lines with text end."""
        seen = at = 0
        while at < len(self.text) and seen < 3:
            end = self.text.find("\n", at)
            seen += bool(self.text[at : len(self.text) if end < 0 else end].strip())
            if end < 0:
                return len(self.text)
            at = end + 1
        return at

    def alone_on_line(self, start: int, end: int) -> bool:
        left = self.text.rfind("\n", 0, start) + 1
        right = self.text.find("\n", end)
        return not self.text[left:start].strip() and not self.text[end : len(self.text) if right < 0 else right].strip()

    def starts_sentence(self, at: int) -> bool:
        while at > 0 and (c := self.text[at - 1]).isspace():
            if c == "\n":
                return True
            at -= 1
        return at == 0 or self.text[at - 1] in ".!?:;"

    @cached_property
    def line_ends(self) -> list[int]:
        return [m.start() for m in re.finditer(r"[\r\n]", self.text)] + [len(self.text)]

    def line_end(self, at: int) -> int:
        """Where the line that holds a place ends."""
        return self.line_ends[bisect_left(self.line_ends, at)]


def _quote(word: str) -> str:
    return f'"{word}"'


class Context:
    """Signals ``(id, weight, note)`` for what surrounds a candidate."""

    def __init__(self, vocabulary: V.Vocabulary):
        self.nouns = vocabulary.everyday_nouns

    def person(self, doc: Surroundings, value: str, start: int, end: int, single: bool, unresolved: bool):
        soft, before, rest = single or unresolved, word_before(doc.text, start), (doc.text, end, doc.line_end(end))
        m = _AFTER.match(*rest)
        after, lower, out = m[1].lower() if m else "", value.lower(), []
        introduced = False
        if _BARE_TITLE.fullmatch(before):
            introduced = True
            out.append(("title", 0.3, f"Introduced by the title {_quote(before)}"))
        elif before in V.PERSON_CUES:
            introduced = True
            out.append(("person-cue", 0.3 if unresolved else 0.2, f"Follows {_quote(before)}, which usually introduces a person"))
        elif soft and before in V.DETERMINERS:
            out.append(("determiner-before", -0.25, f"Preceded by {_quote(before)}, so it reads as an ordinary word"))
        out += self._person_after(rest, after, soft and not introduced)
        if single and not unresolved and lower in V.DOUBLE_MEANINGS:
            out.append(("ambiguous-word", -0.3, f"{_quote(value)} is also an everyday word"))
        tokens = [lower] if _SPACE.isdisjoint(lower) else _GAP.split(lower)
        noun = next((t for t in tokens if t in self.nouns), None) if unresolved and not single else None
        if noun:
            out.append(("common-noun-inside", -0.3, f"{_quote(noun)} is an everyday word, so this reads as a thing rather than a person"))
        if not single and start <= doc.heading_end and doc.alone_on_line(start, end):
            out.append(("document-heading", 0.15, "Stands alone at the top of the document, where a name is introduced"))
        elif soft and doc.starts_sentence(start):
            out.append(("sentence-start", -0.15, "Capitalised only because it starts a sentence"))
        if single and lower in doc.lower_words:
            out.append(("lowercase-elsewhere", -0.35, "The same word appears in lower case elsewhere, so it is probably ordinary language"))
        if not doc.email_parts.isdisjoint(tokens):
            out.append(("identity-link", 0.3, "The same name appears in an email address in this content"))
        if single and lower in doc.strong_names:
            out.append(("known-person-token", 0.25, "Part of a full name used elsewhere in this content"))
        return out

    def _person_after(self, rest: tuple[str, int, int], after: str, doubtful: bool):
        text, end, _ = rest
        c = text[end : end + 1]
        if c in _SPACE and _TEAM.match(*rest):
            return [("role-context", 0.4, "Followed by a team or department, as a person would be")]
        if c in _BEFORE_JOB and _JOB.match(*rest):
            return [("job-title", 0.3, "Followed by a job title")]
        if c in ("'", "’") and _OWN.match(*rest):
            return [("possessive", 0.18, "Used possessively, as a person would be")]
        if after in V.PERSON_VERBS:
            return [("person-verb", 0.4, f"Followed by {_quote(after)}, something a person does")]
        if not doubtful or not after:
            return []
        if after in self.nouns:
            return [("common-noun-after", -0.25, f"Followed by {_quote(after)}, so it reads as a description")]
        if after in V.FUNCTION_WORDS:
            return [("function-word-after", -0.25, f"Followed by {_quote(after)}, so it reads as ordinary language")]
        return [("no-person-context", -0.1, "Nothing nearby suggests a person")]

    def company(self, doc: Surroundings, value: str, start: int, base: float, single: bool):
        before, out = word_before(doc.text, start), []
        if single and base < 0.85 and before in V.DETERMINERS:
            out.append(("determiner-before", -0.2, f"Preceded by {_quote(before)}, so it reads as ordinary language"))
        if single and value.lower() in doc.lower_words:
            out.append(("lowercase-elsewhere", -0.3, "The same word appears in lower case elsewhere"))
        return out

    def place(self, doc: Surroundings, start: int, end: int):
        before, out = word_before(doc.text, start), []
        m = _AFTER.match(doc.text, end, doc.line_end(end))
        after = m[1].lower() if m else ""
        if before in V.LOCATIVES:
            out.append(("locative", 0.2, f"Follows {_quote(before)}, so it names an actual place"))
        elif before in V.DETERMINERS:
            out.append(("determiner-before", -0.25, f"Preceded by {_quote(before)}, so it is describing something"))
        if after in self.nouns:
            out.append(("common-noun-after", -0.25, f"Followed by {_quote(after)} — a general reference, not an address"))
        return out


FIELDS = ("category", "start", "end", "rule", "base", "single", "unresolved", "value", "signals")


def proposed(text: str, machine_spans, emails, recogniser: Recogniser, context: Context, street: bool = True) -> list[tuple]:
    """The entity candidates of one document, in the order of ``FIELDS``. ``street`` says that the
    text may hold a street address."""
    found = list(recogniser.propose(text, street))
    people = [text[s:e] for c, s, e, _, base, _, _ in found if c == "PERSON" and base >= 0.9]
    doc = Surroundings(text, machine_spans, emails, people)
    out = []
    for proposal in found:
        category, start, end, _, base, single, unresolved = proposal
        if category == "PERSON":
            signals = context.person(doc, text[start:end], start, end, single, unresolved)
        elif category == "ORGANISATION":
            signals = context.company(doc, text[start:end], start, base, single)
        else:
            signals = context.place(doc, start, end) if category == "LOCATION" else ()
        out.append((*proposal, text[start:end], signals))
    return out


def propose(text: str, machine_spans, emails, recogniser: Recogniser, context: Context) -> list[dict]:
    """The same by name."""
    rows = (dict(zip(FIELDS, p, strict=True)) for p in proposed(text, machine_spans, emails, recogniser, context))
    return [{**row, "layer": "entity", "signals": [dict(zip(("id", "weight", "note"), s, strict=True)) for s in row["signals"]]} for row in rows]


class Columns:
    """Candidates of a batch, column by column: rows of their own would keep the garbage
    collector busy."""

    def __init__(self):
        self.ends: list[int] = []
        self.fields: list[list] = [[] for _ in FIELDS[:-1]]
        self.signals: list[list] = [[], [], []]
        self.signal_ends: list[int] = []

    def add(self, found: list[tuple]) -> None:
        ids, weights, notes = self.signals
        for p in found:
            for column, x in zip(self.fields, p):
                column.append(x)
            for id, weight, note in p[-1]:
                ids.append(id)
                weights.append(weight)
                notes.append(note)
            self.signal_ends.append(len(ids))
        self.ends.append(len(self.signal_ends))

    def array(self) -> pa.Array:
        category, start, end, rule, base, single, unresolved, value = self.fields
        texts = lambda some: pa.array(some, pa.string())
        id, weight, note = self.signals
        held = pa.StructArray.from_arrays([texts(id), pa.array(weight, pa.float64()), texts(note)], fields=list(SIGNAL_ARROW))
        signals = pa.ListArray.from_arrays(pa.array([0, *self.signal_ends], pa.int32()), held)
        columns = [texts(category), texts(value), pa.array(start, pa.int32()), pa.array(end, pa.int32()), texts(["entity"] * len(value)), texts(rule), pa.array(base, pa.float64()), pa.array(unresolved, pa.bool_()), pa.array(single, pa.bool_()), signals]
        return candidate_arrays(np.array(self.ends, np.int64), columns)


def entity_candidates(text: Column, rule_found: Column, vocabulary: V.Vocabulary) -> Column:
    """``array<candidate>`` of a text, given what the rules found in it. A failure on a
    document fails the query: no candidates would look like a text without names."""
    # Categories that machines read.
    machine = ("EMAIL", "URL", "CONNECTION_STRING", "API_KEY", "ACCESS_TOKEN", "PRIVATE_KEY", "NETWORK_PATH", "INTERNAL_HOST", "UUID")

    @F.arrow_udf(T._parse_datatype_string(f"array<{CANDIDATE}>"))
    def run(texts: pa.Array, spans: pa.Array, emails: pa.Array) -> pa.Array:
        recogniser, context, out = Recogniser(vocabulary), Context(vocabulary), Columns()
        texts = valid_texts(texts)
        streets = pc.fill_null(pc.match_substring_regex(texts, for_re2(STREET)), False).to_pylist()
        inside, upto = pc.list_flatten(spans), np.cumsum(pc.fill_null(pc.list_value_length(spans), 0).to_numpy(zero_copy_only=False)).tolist()
        pairs = list(zip(inside.field("start").to_pylist(), inside.field("end").to_pylist(), strict=True))
        at = 0
        for t, last, e, street in zip(texts.to_pylist(), upto, emails.to_pylist(), streets, strict=True):
            out.add(proposed(t, pairs[at:last], e, recogniser, context, street) if t else [])
            at = last
        return out.array()

    spans = F.transform(F.filter(rule_found, lambda c: c["category"].isin(*machine)), lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end")))
    emails = F.transform(F.filter(rule_found, lambda c: c["category"] == "EMAIL"), lambda c: c["value"])
    return run(text, spans, emails)
