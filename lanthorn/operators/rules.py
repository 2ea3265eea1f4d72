"""Rules: patterns with a category, a base score and a check of what they matched."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from functools import cached_property
from string import ascii_letters

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.dialect import MARK, ODD_CASE, SPACES, for_re2, portable
from ..functions.vocab import INFRASTRUCTURE, NOT_PROJECTS

CANDIDATE = "struct<category:string,value:string,start:int,end:int,layer:string,rule:string,base:double,unresolved:boolean,single:boolean,signals:array<struct<id:string,weight:double,note:string>>>"


class Batch:
    """Texts of a batch, and their characters as one array."""

    def __init__(self, texts: pa.Array):
        self.plain: list[str | None] = texts.to_pylist()

    @cached_property
    def points(self) -> np.ndarray:
        return np.frombuffer("".join([t or "" for t in self.plain]).encode("utf-32-le"), np.uint32)

    @cached_property
    def ends(self) -> np.ndarray:
        return np.cumsum([len(t or "") for t in self.plain])

    def character(self, rows: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The character at a place of a text, 0 outside of it."""
        ends = self.ends[rows]
        begins = np.where(rows > 0, self.ends[rows - 1], 0)
        inside = (at >= 0) & (begins + at < ends)
        return np.where(inside, self.points[np.where(inside, begins + at, 0)], 0)


@dataclass(frozen=True)
class Rule:
    id: str
    name: str
    category: str
    base: float
    pattern: str
    ignore_case: bool = False
    groups: tuple[int, ...] = ()
    trim: bool = False
    check: Callable[[str, str, int], bool] | None = None  # value, text, place of the match
    checks: Callable[[pa.Array, Batch, np.ndarray, np.ndarray], np.ndarray] | None = None  # the same of many: values, texts, their rows, places

    @property
    def regex(self) -> str:
        return portable(self.pattern, self.ignore_case)


_DIGIT, _NOT_DIGIT, _SEPARATOR, _UPPER = re.compile("[0-9]"), re.compile("[^0-9]"), re.compile("[-_.]"), re.compile("[A-Z]")
_DATE, _DOTTED = re.compile(r"[0-9]{4}[-/.][0-9]{1,2}[-/.][0-9]{1,2}"), re.compile(r"[0-9]+(?:\.[0-9]+){2,}")
_BEFORE_PHONE, _AFTER_PHONE, _PARTS = re.compile(r"[A-Za-z0-9._/@:$£€¥-]"), re.compile(r"[A-Za-z/@:-]|\.[0-9]"), re.compile(portable(r"[\s().-]"))
_VERSION = regex.compile(portable(r"\b(?:version|v|rel|release|build|patch)\.?\s*", True) + r"\x85?\Z")
# What a digit adds to a Luhn sum where it is doubled.
_DOUBLED = (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)
# What the checks of many matches need: the same conditions, for RE2 and for characters.
_BESIDE = ascii_letters
_OCTET = "(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])"
_AFTER_VERSION = "".join(c for c in map(chr, range(0x10000)) if re.match(f"[{SPACES}]", c)) + "\x85."
_VERSION_ENDS = tuple("NVLEDHnvledh")
_NAMED = f"(?i)(?:^|-)(?:{'|'.join(re.escape(w) for w in sorted(INFRASTRUCTURE) if w.isalpha())})[0-9]*(?:-|$)"


def luhn(number: str) -> bool:
    """Whether the last of twelve digits or more is the check digit of the others."""
    return len(number) >= 12 and (sum(map(int, number[-1::-2])) + sum(_DOUBLED[int(d)] for d in number[-2::-2])) % 10 == 0


def _card(value: str, text: str, at: int) -> bool:
    number = _NOT_DIGIT.sub("", value)
    return 13 <= len(number) <= 19 and luhn(number)


def _phone(value: str, text: str, at: int) -> bool:
    n = len(_NOT_DIGIT.sub("", value))
    after = at + len(value)
    return (
        9 <= n <= 15
        and not (at and _BEFORE_PHONE.match(text, at - 1))
        and not _AFTER_PHONE.match(text, after)
        and not _DATE.search(value)
        and not _DOTTED.fullmatch(value.strip(" "))
        and (n >= 10 or value[0] == "+" or _PARTS.search(value) is not None)
    )


def _ipv4(value: str, text: str, at: int) -> bool:
    return all(int(o) <= 255 for o in value.split(".")) and not _VERSION.search(text[max(at - 14, 0) : at])


def _hold(values: pa.Array, pattern: str) -> np.ndarray:
    return pc.match_substring_regex(values, pattern).to_numpy(zero_copy_only=False)


def luhns(values: pa.Array) -> np.ndarray:
    """``luhn`` of the digits of each value."""
    numbers = pc.replace_substring_regex(values, "[^0-9]", "")
    long = pc.binary_length(numbers).to_numpy()
    digits = np.frombuffer("".join(numbers.to_pylist()).encode(), np.uint8) - 48
    owner, ends = np.repeat(np.arange(len(long)), long), np.cumsum(long)
    even = (ends[owner] - 1 - np.arange(len(digits))) % 2 == 0
    sums = np.bincount(owner, np.where(even, digits, np.array(_DOUBLED)[digits]), len(long))
    return (long >= 12) & (sums % 10 == 0)


def _any_of(codes: np.ndarray, characters: str) -> np.ndarray:
    return np.isin(codes, [ord(c) for c in characters])


def _phones(values: pa.Array, batch: Batch, rows: np.ndarray, at: np.ndarray) -> np.ndarray:
    n = pc.binary_length(pc.replace_substring_regex(values, "[^0-9]", "")).to_numpy()
    after = at + pc.utf8_length(values).to_numpy()
    before, next_, then = (batch.character(rows, k) for k in (at - 1, after, after + 1))
    apart = ~_any_of(before, _BESIDE + "0123456789._/@:$£€¥-") & ~_any_of(next_, _BESIDE + "/@:-") & ~((next_ == ord(".")) & _any_of(then, "0123456789"))
    dated = _hold(values, _DATE.pattern) | _hold(values, f"^(?:{_DOTTED.pattern})$")
    return (9 <= n) & (n <= 15) & apart & ~dated & ((n >= 10) | _hold(values, r"^\+|[ \t().-]"))


def _ipv4s(values: pa.Array, batch: Batch, rows: np.ndarray, at: np.ndarray) -> np.ndarray:
    kept = _hold(values, rf"^(?:{_OCTET}\.){{3}}{_OCTET}$")
    for k in np.flatnonzero(kept).tolist():
        i = int(at[k])
        before = batch.plain[rows[k]][max(i - 14, 0) : i]
        kept[k] = before.rstrip(_AFTER_VERSION)[-1:] not in _VERSION_ENDS or not _VERSION.search(before)
    return kept


def _hosts(values: pa.Array, batch: Batch, rows: np.ndarray, at: np.ndarray) -> np.ndarray:
    return _hold(values, _NAMED)


def _host(value: str, text: str, at: int) -> bool:
    return any(part.rstrip("0123456789").upper() in INFRASTRUCTURE for part in _SEPARATOR.split(value))


def _licence_key(value: str, text: str, at: int) -> bool:
    return _DIGIT.search(value) is not None and _UPPER.search(value) is not None


_PEM = "(?:RSA |EC |DSA |OPENSSH |PGP )?PRIVATE KEY-----"

# Patterns, categories and base scores, in the order that settles ties.
PATTERN_RULES = [
    Rule("pem_block", "PEM private key block", "PRIVATE_KEY", 1.0, rf"-----BEGIN {_PEM}[\s\S]*?-----END {_PEM}"),
    Rule("aws_key", "AWS access key ID", "API_KEY", 0.99, r"\b(?:AKIA|ASIA|ABIA|ACCA)[0-9A-Z]{16}\b"),
    Rule("github_token", "GitHub token", "ACCESS_TOKEN", 0.99, r"\bgh[pousr]_[A-Za-z0-9]{30,}\b"),
    Rule("slack_token", "Slack token", "ACCESS_TOKEN", 0.98, r"\bxox[baprse]-[A-Za-z0-9-]{10,}\b"),
    Rule("google_key", "Google API key", "API_KEY", 0.98, r"\bAIza[0-9A-Za-z_-]{35}\b"),
    Rule("stripe_key", "Stripe key", "API_KEY", 0.98, r"\b[srp]k_(?:live|test)_[A-Za-z0-9]{16,}\b"),
    Rule("model_key", "Model provider key", "API_KEY", 0.97, r"\bsk-(?:ant-)?[A-Za-z0-9_-]{20,}\b"),
    Rule("jwt", "JSON web token", "ACCESS_TOKEN", 0.97, r"\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\b"),
    Rule("bearer", "Bearer authorization header", "ACCESS_TOKEN", 0.9, r"\bBearer\s+([A-Za-z0-9_\-.=+/]{16,})", True, (1,)),
    Rule("database_url", "Database connection string", "CONNECTION_STRING", 0.95, r"""\b(?:mongodb(?:\+srv)?|postgres(?:ql)?|mysql|mariadb|redis|amqps?|mssql|jdbc:[a-z]+)://[^\s"'<>]+""", True),
    Rule("odbc_string", "ODBC style connection string", "CONNECTION_STRING", 0.95, r"\b(?:Server|Data Source)\s*=\s*[^;\n]{2,}?;[^\n]*?(?:Password|Pwd)\s*=\s*[^;\n]+", True),
    Rule("password", "Password assignment", "PASSWORD", 0.93, r"""\b(?:password|passwd|pwd|passphrase|pass)\s*(?:is|:|=|=>)\s*(?:"([^"\n]{3,64})"|'([^'\n]{3,64})'|([^\s"'<>,;]{3,64}))""", True, (1, 2, 3)),
    Rule("secret", "Secret or key assignment", "API_KEY", 0.92, r"""\b(?:api[_-]?key|apikey|secret[_-]?key|client[_-]?secret|access[_-]?token|auth[_-]?token|private[_-]?token|app[_-]?secret|token)\s*(?:is|:|=|=>)\s*(?:"([^"\n]{6,120})"|'([^'\n]{6,120})'|([A-Za-z0-9_\-.=+/]{8,120}))""", True, (1, 2, 3)),
    Rule("card", "Payment card number (Luhn checked)", "CREDIT_CARD", 0.95, r"\b(?:\d[ -]?){12,18}\d\b", check=_card, checks=lambda v, *_: luhns(v)),
    Rule("iban", "IBAN", "BANK_ACCOUNT", 0.9, r"\b[A-Z]{2}\d{2}[ ]?(?:[A-Z0-9]{4}[ ]?){2,7}[A-Z0-9]{1,4}\b", check=lambda v, t, at: len(v.replace(" ", "")) >= 15, checks=lambda v, *_: _hold(v, "^(?: *[^ ]){15}")),
    Rule("email", "Email address", "EMAIL", 0.99, r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+\b"),
    Rule("ssn", "US social security number", "NATIONAL_ID", 0.9, r"\b\d{3}-\d{2}-\d{4}\b"),
    Rule("labelled_id", "Identity number with a label", "NATIONAL_ID", 0.95, r"\b(?:id|identity|national\s+id|passport)\s*(?:number|no|nr|#)?\s*[:.]?\s*(\d[\d\s-]{6,18}\d)", True, (1,)),
    Rule("id13", "National ID number (13 digit, checksum)", "NATIONAL_ID", 0.85, r"\b\d{13}\b", check=lambda v, t, at: luhn(v), checks=lambda v, *_: luhns(v)),
    Rule("phone", "Phone number", "PHONE", 0.85, r"\+?\d[\d \t().-]{7,18}\d", check=_phone, checks=_phones),
    Rule("ipv4", "IPv4 address", "IP_ADDRESS", 0.97, r"\b(?:\d{1,3}\.){3}\d{1,3}\b", check=_ipv4, checks=_ipv4s),
    Rule("ipv6", "IPv6 address", "IP_ADDRESS", 0.9, r"\b(?:[0-9A-Fa-f]{1,4}:){3,7}[0-9A-Fa-f]{1,4}\b"),
    Rule("mac", "MAC address", "MAC_ADDRESS", 0.95, r"\b(?:[0-9A-Fa-f]{2}[:-]){5}[0-9A-Fa-f]{2}\b"),
    Rule("uuid", "UUID / GUID", "UUID", 0.98, r"\b[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\b"),
    Rule("url", "Web link", "URL", 0.95, r"""\b(?:https?://|www\.)[^\s<>"'`)\]]+""", True, trim=True),
]
BUSINESS_RULES = [
    Rule("host", "Internal server or host name", "INTERNAL_HOST", 0.86, r"\b[A-Za-z][A-Za-z0-9]{0,14}(?:-[A-Za-z0-9]{1,14}){1,3}\b", check=_host, checks=_hosts),
    Rule("domain", "Internal domain name", "INTERNAL_HOST", 0.92, r"\b[a-z0-9][a-z0-9-]*(?:\.[a-z0-9-]+)*\.(?:local|internal|corp|lan|intra|intranet|priv|home)\b", True),
    Rule("share", "Network share path", "NETWORK_PATH", 0.94, r"\\\\[A-Za-z0-9._-]+(?:\\[A-Za-z0-9._$-]+)+", trim=True),
    Rule("customer_id", "Customer or account number", "CUSTOMER_ID", 0.93, r"\b(?:CUST|CUSTOMER|ACCT|ACCOUNT|CLIENT|CLI)[-_ ]?#?\d{3,10}\b", True),
    Rule("case_id", "Support case or ticket number", "CASE_ID", 0.93, r"\b(?:CASE|TICKET|TKT|SR|INC|REQ|RITM|CHG|PRB|SUPPORT)[-_ ]?#?\d{3,10}\b", True),
    Rule("contract_id", "Contract, order or invoice number", "CONTRACT_ID", 0.9, r"\b(?:CTR|CONTRACT|AGR|AGREEMENT|PO|SO|QUOTE|QT|INV|INVOICE|SUB|SUBSCRIPTION)[-_ ]?#?\d{3,10}\b", True),
    Rule("employee_id", "Employee number", "EMPLOYEE_ID", 0.9, r"\b(?:EMP|EMPL|STAFF|EID|BADGE|PERSONNEL)[-_ ]?#?\d{3,10}\b", True),
    Rule("licence_key", "Licence or product key", "LICENSE_KEY", 0.88, r"\b[A-Z0-9]{4,6}(?:-[A-Z0-9]{4,6}){3,5}\b", check=_licence_key, checks=lambda v, *_: _hold(v, "[0-9].*[A-Z]|[A-Z].*[0-9]")),
    Rule("reference", "Internal reference code", "REFERENCE_ID", 0.62, r"\b[A-Z]{2,6}-\d{4,9}\b"),
]
_MONTH = "(?:January|February|March|April|May|June|July|August|September|October|November|December)"
CONFIDENTIAL_RULES = [
    Rule("project", "Internal project name", "PROJECT_CODE", 0.8, r"\b(?:Project|Programme|Program|Initiative|Codename|Workstream)\s+([A-Z][A-Za-z0-9]{2,20})\b", groups=(1,), check=lambda v, t, at: v.lower() not in NOT_PROJECTS),
    Rule("release_date", "Unreleased release date", "RELEASE_PLAN", 0.75, rf"\b(?:GA|general availability|launch(?:es|ed|ing)?|releas(?:e|es|ed|ing)|ship(?:s|ped|ping)?|beta|EAP|early access|tech preview|goes live|go live)\b[^.\n]{{0,20}}?\b(?:Q[1-4]\s*(?:FY)?\s*'?\d{{2,4}}|H[12]\s*(?:FY)?\s*'?\d{{2,4}}|{_MONTH}\s+\d{{4}})", True),
    Rule("beta_timing", "Internal beta timing", "RELEASE_PLAN", 0.78, r"\b(?:internal|private|closed|limited)\s+(?:beta|preview|release|rollout)\s+(?:begins|starts|opens|launches|is planned for|is scheduled for)\s+(?:in\s+)?(?:[A-Z][a-z]+|Q[1-4]|H[12])\b", True),
    Rule("discount", "Commercial discount or margin", "PRICING_TERM", 0.78, r"\b\d{1,2}(?:\.\d)?\s?%\s*(?:discount|margin|uplift|commission|rebate|increase|reduction)\b", True),
    Rule("priced_term", "Priced commercial term", "PRICING_TERM", 0.72, r"\b(?:discount|margin|list price|price|pricing|rate|uplift|quota|budget|contract value|deal value|cost)\b[^.\n]{0,24}?(?:R|ZAR|\$|US\$|USD|€|EUR|£|GBP)\s?\d[\d ,]*(?:\.\d+)?\s?(?:m|k|bn|million|thousand|billion)?", True),
]
LAYERS = {"pattern": PATTERN_RULES, "business": BUSINESS_RULES, "confidential": CONFIDENTIAL_RULES}
RULES = {r.id: (layer, r) for layer, rules in LAYERS.items() for r in rules}


@dataclass(frozen=True)
class Search:
    """A rule with its pattern compiled, for RE2 and for texts that RE2 is not given."""

    rule: Rule
    pattern: regex.Pattern
    fast: str
    marked: str

    @staticmethod
    def of(rule: Rule) -> Search:
        return Search(rule, regex.compile(rule.regex), for_re2(rule.pattern, rule.ignore_case), MARK + "".join(f"\\{g}{MARK}" for g in (0, *rule.groups)))

    def matches(self, text: str) -> Iterator[tuple[str, int]]:
        """Value and start of what the rule accepts."""
        found = (self.accepted(text, m[0], m.start(), [m[g] for g in self.rule.groups]) for m in self.pattern.finditer(text))
        return filter(None, found)

    def matches_of(self, texts: pa.Array, rows: np.ndarray, batch: Batch) -> tuple[np.ndarray, pa.Array, np.ndarray]:
        """Rows, values and starts of what the rule accepts in texts of a batch that hold matches.
        Marks around each match and behind its groups cut the texts, and places add up the
        lengths of the cuts."""
        rule, every = self.rule, len(self.rule.groups) + 2
        cuts = pc.split_pattern(pc.replace_substring_regex(texts, self.fast, self.marked), MARK)
        begins, pieces = cuts.offsets.to_numpy(), cuts.values
        owner = np.repeat(np.arange(len(rows)), np.diff(begins))
        kind = (np.arange(len(pieces)) - begins[owner]) % every
        long = np.where(kind < 2, pc.utf8_length(pieces).to_numpy(zero_copy_only=False), 0)
        upto = np.cumsum(long) - long
        which = np.flatnonzero(kind == 1)
        values, rows, at = pieces.take(pa.array(which)), rows[owner[which]], (upto - upto[begins[owner]])[which]
        starts = at
        if rule.groups:
            held = [pieces.take(pa.array(which + k)) for k in range(1, every - 1)]
            match, values = values, pc.coalesce(*(pc.if_else(pc.equal(g, ""), None, g) for g in held), values)
            starts = at + np.fromiter(map(str.rindex, match.to_pylist(), values.to_pylist()), np.int64, len(values))
        if rule.trim:
            short = pc.utf8_rtrim(values, ".,;:!?")
            values = pc.if_else(pc.equal(short, ""), values, short)
        if rule.checks is not None:
            kept = rule.checks(values, batch, rows, at)
        elif rule.check is not None:
            kept = np.fromiter((rule.check(v, batch.plain[row], k) for v, row, k in zip(values.to_pylist(), rows.tolist(), at.tolist())), bool, len(values))
        else:
            return rows, values, starts
        return rows[kept], values.filter(pa.array(kept)), starts[kept]

    def accepted(self, text: str, match: str, at: int, groups: Sequence[str | None]) -> tuple[str, int] | None:
        """Value and start of a match that passes the check. The value is the first of the groups
        that matched, at its last place in the match; ``trim`` drops punctuation from its end."""
        rule, value, start = self.rule, match, at
        if groups:
            value = next(filter(None, groups), match)
            start += match.rindex(value)
        if rule.trim:
            value = value.rstrip(".,;:!?") or value
        return (value, start) if rule.check is None or rule.check(value, text, at) else None


def valid_texts(texts: pa.Array) -> pa.Array:
    """The texts; bytes that are no UTF-8 are replaced, as Java does."""
    try:
        texts.validate(full=True)
        return texts
    except pa.ArrowInvalid:
        return pa.array([None if b is None else b.decode("utf-8", "replace") for b in texts.cast(pa.binary()).to_pylist()], pa.string())


SIGNAL_ARROW = pa.struct([("id", pa.string()), ("weight", pa.float64()), ("note", pa.string())])
CANDIDATE_ARROW = pa.struct([("category", pa.string()), ("value", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("layer", pa.string()), ("rule", pa.string()), ("base", pa.float64()), ("unresolved", pa.bool_()), ("single", pa.bool_()), ("signals", pa.list_(SIGNAL_ARROW))])


def candidate_arrays(ends: np.ndarray, columns: list[pa.Array]) -> pa.Array:
    """``array<candidate>`` of a column for each field; a text's candidates end where ``ends`` says."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.StructArray.from_arrays(columns, fields=list(CANDIDATE_ARROW)))


@dataclass
class Found:
    """Matches of a layer, rule by rule, in columns."""

    rows: list[np.ndarray] = field(default_factory=list)
    which: list[np.ndarray] = field(default_factory=list)
    values: list[pa.Array] = field(default_factory=list)
    starts: list[np.ndarray] = field(default_factory=list)

    def add(self, k: int, rows: np.ndarray, values: pa.Array, starts: np.ndarray) -> None:
        self.rows.append(rows)
        self.which.append(np.full(len(rows), k, np.int32))
        self.values.append(values)
        self.starts.append(starts)

    def candidates(self, layer: str, rules: list[Rule], texts: int) -> pa.Array:
        rows, which, starts = (np.concatenate([np.zeros(0, np.int64), *x]).astype(np.int32) for x in (self.rows, self.which, self.starts))
        order = np.lexsort((which, rows))  # stable: matches of a rule stay in the order of the text
        of = lambda kind, *given: pa.array(given, kind).take(pa.array(which[order]))
        values, first, n = pa.concat_arrays([pa.array([], pa.string()), *self.values]).take(pa.array(order)), pa.array(starts[order]), len(order)
        last = pc.add(first, pc.utf8_length(values))
        no = pa.array(np.zeros(n, bool))
        none = pa.ListArray.from_arrays(pa.array(np.zeros(n + 1, np.int32)), pa.array([], SIGNAL_ARROW))
        columns = [of(pa.string(), *(r.category for r in rules)), values, first, last, pa.repeat(layer, n), of(pa.string(), *(r.name for r in rules)), of(pa.float64(), *(r.base for r in rules)), no, no, none]
        return candidate_arrays(np.cumsum(np.bincount(rows, minlength=texts)), columns)


#: Texts that are searched at a time: what is made of them on the way stays small.
AT_A_TIME = 4_000
#: Texts that RE2 is not given: those that hold the mark, and letters that it folds otherwise.
_ODD = f"[{MARK}{ODD_CASE}]"


def rule_candidates(text: Column, layers: dict[str, list[Rule]]) -> Column:
    """A struct with the candidates of each layer, in the order of its rules, then of the text; a
    null text has none. Java tells Spark no places of matches, so an Arrow UDF searches: RE2
    puts marks around the matches in all texts of a batch, in time that follows their length,
    and only texts with a match are read further."""
    searches = {layer: [Search.of(r) for r in rules] for layer, rules in layers.items()}

    @F.arrow_udf(T._parse_datatype_string(f"struct<{','.join(f'{layer}:array<{CANDIDATE}>' for layer in layers)}>"))
    def run(texts: pa.Array) -> pa.Array:
        texts = valid_texts(texts)
        return pa.concat_arrays([searched(texts.slice(k, AT_A_TIME)) for k in range(0, max(len(texts), 1), AT_A_TIME)])

    def searched(texts: pa.Array) -> pa.Array:
        batch = Batch(texts)
        odd = pc.fill_null(pc.match_substring_regex(texts, _ODD), False)
        by_hand = np.flatnonzero(odd.to_numpy(zero_copy_only=False)).tolist()
        if by_hand:
            texts = pc.if_else(odd, None, texts)
        out = []
        for layer, some in searches.items():
            found = Found()
            for k, search in enumerate(some):
                held = pc.fill_null(pc.match_substring_regex(texts, search.fast), False)
                rows = np.flatnonzero(held.to_numpy(zero_copy_only=False))
                if len(rows):
                    found.add(k, *search.matches_of(texts.filter(held), rows, batch))
                for row in by_hand:
                    matches = list(search.matches(batch.plain[row]))
                    values, starts = zip(*matches) if matches else ((), ())
                    found.add(k, np.full(len(values), row), pa.array(values, pa.string()), np.array(starts, np.int64))
            out.append(found.candidates(layer, layers[layer], len(batch.plain)))
        return pa.StructArray.from_arrays(out, names=list(layers))

    return run(text)
