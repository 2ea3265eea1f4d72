"""Regular expressions with ASCII word boundaries and Unicode white space, for Java and
for Python, and the positions of their matches as Column expressions.

Rules are written with ``\\b``, ``\\w``, ``\\d`` in their ASCII sense and ``\\s`` with all
Unicode spaces. Java's ``\\b`` is Unicode-aware and its ``\\s`` is ASCII, so both are
spelled out here, once.
"""

from __future__ import annotations

import re
from contextlib import contextmanager
from functools import wraps

from pyspark import SparkContext
from pyspark.errors import utils as errors
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# White space as the rules understand it.
SPACES = "\\t\\n\\x0b\\f\\r \\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff"
BOUNDARY = "(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"


WORD_START = "(?<![A-Za-z0-9_])"
_QUANTIFIER, _CLASS = re.compile(r"[+*]|\{[0-9]+(?:,[0-9]*)?\}"), re.compile(r"(\[[^\]]*\])")


def _alternatives(group: str) -> list[str]:
    """The alternatives of a group's body."""
    out, depth, start, i = [], 0, 0, 0
    while i < len(group):
        if group[i] == "\\":
            i += 1
        elif group[i] == "[":
            i = group.index("]", i + 2)
        elif group[i] in "()":
            depth += 1 if group[i] == "(" else -1
        elif group[i] == "|" and depth == 0:
            out.append(group[start:i])
            start = i + 1
        i += 1
    return [*out, group[start:]]


def starts_with_word(pattern: str) -> bool:
    """Whether what the pattern matches surely starts with a word character; a simple
    reading that says no where it can't tell."""
    if pattern[:2] == "\\d" or (pattern[:1].isascii() and pattern[:1].isalnum()):
        return pattern[2 if pattern[:1] == "\\" else 1 :][:1] not in ("?", "*") and pattern[1:3] != "{0"
    if pattern[:1] == "[":
        end = pattern.index("]", 2)
        return all((c.isascii() and c.isalnum()) or c == "_" or (c == "-" and 1 < k < end - 1) for k, c in enumerate(pattern[1:end], 1)) and pattern[end + 1 : end + 2] not in ("?", "*")
    if pattern[:3] == "(?:":
        depth, i = 0, 0
        while i < len(pattern):
            if pattern[i] == "\\":
                i += 1
            elif pattern[i] == "[":
                i = pattern.index("]", i + 2)
            elif pattern[i] in "()":
                depth += 1 if pattern[i] == "(" else -1
                if depth == 0:
                    break
            i += 1
        return pattern[i + 1 : i + 2] not in ("?", "*") and all(map(starts_with_word, _alternatives(pattern[3:i])))
    return False


def portable(pattern: str, ignore_case: bool = False) -> str:
    """The pattern for ``java.util.regex`` and Python's ``regex``."""
    out, in_class, i = [], False, 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            pair = pattern[i : i + 2]
            if pair == "\\b" and not in_class:
                # Before a word character, a boundary is that none stands before it.
                out.append(WORD_START if starts_with_word(pattern[i + 2 :]) else BOUNDARY)
            elif pair == "\\s":
                out.append(SPACES if in_class else f"[{SPACES}]")
            elif pair == "\\S" and not in_class:
                out.append(f"[^{SPACES}]")
            elif pair == "\\w":
                out.append("A-Za-z0-9_" if in_class else "[A-Za-z0-9_]")
            elif pair == "\\d":
                out.append("0-9" if in_class else "[0-9]")
            else:
                out.append(pair)
            i += 2
            continue
        if c == "[" and not in_class:
            in_class = True
        elif c == "]" and in_class:
            in_class = False
        out.append(c)
        i += 1
    return ("(?i)" if ignore_case else "") + "".join(out)


def for_re2(pattern: str, ignore_case: bool = False) -> str:
    """The pattern for RE2, whose ``\\b``, ``\\w`` and ``\\d`` are ASCII anyway. Under ``ignore_case``
    letters of ``ODD_CASE`` may match otherwise than for ``portable``."""
    spaces = SPACES.replace("\\u", "\\x{")
    spaces = re.sub(r"(\\x\{[0-9a-f]{4})", r"\1}", spaces)

    def spelled(m: re.Match) -> str:
        if m[0] == "\\s":
            return f"[{spaces}]"
        if m[0] == "\\S":
            return f"[^{spaces}]"
        return m[0].replace("\\s", spaces) if m[0][0] == "[" else m[0]

    return ("(?i)" if ignore_case else "") + re.sub(r"\[\^?\]?(?:\\.|[^\]\\])*\]|\\.", spelled, pattern, flags=re.S)


#: Letters whose other case is an ASCII letter.
ODD_CASE = "\u017f\u212a\u0130\u0131"
_DIGITS, _UPPER, _LOWER = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _listed(inside: str) -> str:
    """The inside of a class with its ranges of ASCII letters and digits written out: Java looks
    listed characters up in a table and asks one range after the other."""
    out, i = [], 0
    while i < len(inside):
        if inside[i] == "\\":
            out.append(inside[i : i + 2])
            i += 2
            continue
        run = next((r[r.index(inside[i]) : r.index(inside[i + 2]) + 1] for r in (_DIGITS, _UPPER, _LOWER) if inside[i] in r and inside[i + 1 : i + 2] == "-" and inside[i + 2 : i + 3] in r and i + 2 < len(inside)), None)
        out.append(run or inside[i])
        i += 3 if run else 1
    return "".join(out)


def _closing(pattern: str, i: int) -> int:
    """The place of the bracket that closes the group that opens at ``i``."""
    depth = 0
    while True:
        if pattern[i] == "\\":
            i += 1
        elif pattern[i] == "[":
            i = pattern.index("]", i + 2)
        elif pattern[i] in "()":
            depth += 1 if pattern[i] == "(" else -1
            if depth == 0:
                return i
        i += 1


def _optional(pattern: str, i: int) -> bool:
    return pattern[i : i + 1] in ("?", "*") or pattern[i : i + 2] == "{0"


def firsts(pattern: str) -> frozenset[str] | None:
    """The characters that a match can start with; None where a simple reading can't tell."""
    parts = _alternatives(pattern)
    if len(parts) > 1:
        sets = [firsts(x) for x in parts]
        return None if None in sets else frozenset().union(*sets)
    if pattern[:3] == "(?:":
        end = _closing(pattern, 0)
        inner, without = firsts(pattern[3:end]), pattern[end + 1 : end + 2] == "?" and pattern[end + 2 : end + 3] not in ("?", "+")
        if without:
            rest = firsts(pattern[end + 2 :])
            return None if None in (inner, rest) else inner | rest
        return None if _optional(pattern, end + 1) else inner
    if pattern[:1] == "[":
        end = pattern.index("]", 2)
        inside = _listed(pattern[1:end])
        plain = inside.isascii() and "\\" not in inside and "[" not in inside and "&&" not in inside and inside[0] != "^" and "-" not in inside[1:-1]
        return frozenset(inside) if plain and not _optional(pattern, end + 1) else None
    c, at = (pattern[1:2], 2) if pattern[:1] == "\\" and not pattern[1:2].isalnum() else (pattern[:1], 1)
    literal = c.isascii() and (c.isalnum() or at == 2 or c in " @:/-_%&#,;=\"'")
    return frozenset(c) if c and literal and not _optional(pattern, at) else None


def _either_case(chars: frozenset[str]) -> frozenset[str]:
    return frozenset(x for c in chars for x in (c, c.lower(), c.upper()))


def for_java(pattern: str) -> str:
    """A portable pattern that matches the same and that Java searches faster: ranges are written
    out, what a match starts with is asked before what stands in front of it, and runs that
    can't end earlier are not taken back."""
    flag, body = ("(?i)", pattern[4:]) if pattern.startswith("(?i)") else ("", pattern)
    parts = _alternatives(body)
    if len(parts) > 1:
        sets = [firsts(x.removeprefix(WORD_START).removeprefix(BOUNDARY)) for x in parts]
        some = "" if None in sets else _ahead(frozenset().union(*sets))
        return f"{flag}{some}(?:{'|'.join(for_java(flag + x)[len(flag) :] for x in parts)})"
    cased = _either_case if flag else frozenset
    lead = next((x for x in (WORD_START, BOUNDARY) if body.startswith(x)), "")
    start = firsts(body[len(lead) :]) if lead else None
    out, i = [], len(lead)
    while i < len(body):
        if body[i] == "\\":
            out.append(body[i : i + 2])
            i += 2
        elif body[i] == "[":
            end = body.index("]", i + 2)
            inside = _listed(body[i + 1 : end])
            out.append(f"[{inside}]")
            held = firsts(body[i : end + 1])
            i = end + 1
            quantifier = _QUANTIFIER.match(body, i)
            if quantifier:
                out.append(quantifier[0])
                i = quantifier.end()
                after = firsts(body[i:]) if "|" not in body[i:] or body[i : i + 3] == "(?:" else None
                if held and after and not cased(held) & cased(after) and body[i : i + 1] not in ("?", "+"):
                    out.append("+")
        else:
            out.append(body[i])
            i += 1
    ahead = _ahead(start) if start else ""
    lead = "".join(f"[{_listed(x[1:-1])}]" if x.startswith("[") else x for x in _CLASS.split(lead))
    return flag + ahead + lead + "".join(out)


def _ahead(chars: frozenset[str]) -> str:
    return f"(?=[{''.join(c if c.isalnum() else chr(92) + c for c in sorted(chars))}])"


def required_literal(pattern: str) -> str:
    """The longest run of letters, digits, spaces or ``@`` that every match has; empty if
    there is none outside groups, classes and alternatives."""
    best, run, depth, i = "", "", 0, 0
    if "|" in pattern.replace("\\|", "") and "(" not in pattern:
        return ""
    while i < len(pattern):
        c = pattern[i]
        optional = pattern[i + 1 : i + 2] in ("?", "*", "{")
        if c == "\\":
            run, i = "", i + 2
            continue
        if c == "[":
            end = pattern.index("]", i + 2)
            run, i = "", end + 1
            continue
        if c in "()":
            depth += 1 if c == "(" else -1
            run = ""
        elif depth == 0 and c == "|":
            return ""
        elif depth == 0 and (c.isalnum() or c in " @&") and not optional:
            run += c
            best = max(best, run, key=len)
        else:
            run = ""
        i += 1
    return best


def let(value: Column, body) -> Column:
    """``body`` of the value, which is computed once however often it is used. A fold over
    nothing ends with it: unlike ``transform`` it doesn't copy what it hands on."""
    return F.aggregate(F.array().cast("array<int>"), value, lambda held, _: held, body)


def settled(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with a column that the optimizer can't copy into later expressions: it is
    computed once for each row, and plans stay small. The condition always holds; Spark
    doesn't move what depends on the partition."""
    return df.withColumn(name, F.when(F.spark_partition_id() >= 0, value))


@contextmanager
def _without_call_sites():
    """PySpark looks up the calling line for each expression it makes, which takes longer
    than all else where a plan has thousands."""
    before = getattr(errors, "_enable_debugging_cache", None)
    errors._enable_debugging_cache = False
    try:
        yield
    finally:
        errors._enable_debugging_cache = before


_built: dict = {}


def built_once(make):
    """Keeps a column that a function makes from plain values, for each application."""

    @wraps(make)
    def get(*args):
        key = (SparkContext._active_spark_context.applicationId, make.__module__, make.__qualname__, args)
        if key not in _built:
            if len(_built) > 500:
                _built.clear()
            with _without_call_sites():
                _built[key] = make(*args)
        return _built[key]

    return get


#: Elements that a fold takes at a time.
AT_A_TIME = 256


def folded(items: Column, start: Column, kind: str, step) -> Column:
    """``struct<state, out>`` of a fold with output: ``step(state, item)`` returns the next
    state and an array of what it adds, of type ``kind``, or a struct of both where they
    come from one computation.
    Arrays grow by copying, so the items are taken in parts and the parts joined. Items are
    found by their place, since a slice reads its whole array."""
    none = F.array().cast(kind)
    pair = lambda state, out: F.struct(state.alias("state"), out.alias("out"))

    def one(s: Column, x: Column) -> Column:
        made = step(s["state"], x)
        return let(made if isinstance(made, Column) else pair(*made), lambda r: pair(r["state"], F.when(F.size(r["out"]) > 0, F.concat(s["out"], r["out"])).otherwise(s["out"])))

    def over(items: Column) -> Column:
        def part(s: Column, k: Column) -> Column:
            mine = F.sequence(k * AT_A_TIME + 1, F.least((k + 1) * AT_A_TIME, F.size(items)))
            inner = F.aggregate(mine, pair(s["state"], none), lambda s, i: one(s, F.element_at(items, i)))
            return let(inner, lambda r: pair(r["state"], F.concat(s["out"], r["out"])))

        return F.aggregate(_parts(items), pair(start, none), part)

    return let(items, over)


def _parts(items: Column) -> Column:
    """0, 1, ... for each part of an array."""
    return F.when(F.size(items) > 0, F.sequence(F.lit(0), ((F.size(items) - 1) / AT_A_TIME).cast("int"))).otherwise(F.array().cast("array<int>"))


#: Items whose groups are found by comparing all keys, which takes less than sorting so few.
FEW = 64


def leaders(items: Column, key, rank=None, last: bool = False) -> Column:
    """``array<int>``: for each item the place, from 0, of the leader of its group: among the
    items with the same ``key(item)``, a string, the one of least ``rank(item, place)``, the
    first of equals. Without a rank the first one leads, or the last one. By sorting where there
    are many, so time follows n log n."""
    order = rank or ((lambda x, i: -i) if last else (lambda x, i: i))
    keyed = F.transform(items, lambda x, i: F.struct(key(x).alias("k"), order(x, i).alias("r"), i.alias("i")))

    def step(s: Column, x: Column) -> tuple[Column, Column]:
        at = F.when((s["at"] >= 0) & s["k"].eqNullSafe(x["k"]), s["at"]).otherwise(x["i"])
        return F.struct(x["k"].alias("k"), at.alias("at")), F.array(F.struct(x["i"].alias("i"), at.alias("at")))

    zero = F.struct(F.lit(None).cast("string").alias("k"), F.lit(-1).alias("at"))
    found = folded(F.array_sort(keyed), zero, "array<struct<i:int,at:int>>", step)["out"]
    sorted_ = F.transform(F.array_sort(found), lambda p: p["at"])
    if rank is not None:
        return sorted_
    place = lambda keys, k: (F.array_position(keys, k) - 1).cast("int")
    back = lambda keys: let(F.reverse(keys), lambda r: F.transform(keys, lambda k: F.size(keys) - 1 - place(r, k)))
    compared = back if last else (lambda keys: F.transform(keys, lambda k: place(keys, k)))
    # A null key has no place in an array.
    few = lambda keys: F.when((F.size(keys) <= FEW) & ~F.exists(keys, lambda k: k.isNull()), compared(keys)).otherwise(sorted_)
    return let(F.transform(items, key), few)


def places(items: Column) -> Column:
    """0, 1, ... for each item."""
    return F.transform(items, lambda x, i: i)


def cut_between(text: Column, spans: Column, make) -> Column:
    """``make(gap, inside, place)``, an array, for each of the spans, which are in order and
    apart: the text between it and the one before, and the text inside it; the arrays are
    joined. Spans are taken in parts and each part's text is cut out first, since every cut
    counts characters from the start."""

    end_of = lambda i: F.when(i == 0, 0).otherwise(F.element_at(spans, F.greatest(i, F.lit(1)))["end"])  # noqa: E731  of the i-th, from 1

    def part(k: Column) -> Column:
        first, last = k * AT_A_TIME, F.least((k + 1) * AT_A_TIME, F.size(spans))

        def cuts(piece: Column) -> Column:
            def one(n: Column) -> Column:
                base, before, x = end_of(first), end_of(n - 1), F.element_at(spans, n)
                return make(F.substring(piece, before - base + 1, x["start"] - before), F.substring(piece, x["start"] - base + 1, x["end"] - x["start"]), n - 1)

            return F.flatten(F.transform(F.sequence(first + 1, last), one))

        return let(F.substring(text, end_of(first) + 1, end_of(last) - end_of(first)), cuts)

    return F.flatten(F.transform(_parts(spans), part))


#: Stands for no character, so hardly any text holds it.
MARK = "\ufdd0"
SPAN = "struct<value:string,start:int,end:int,match:string,at:int>"


def spans(text: Column, pattern: str, groups: tuple[int, ...] = (), trim: bool = False) -> Column:
    """``array<struct<value, start, end, match, at>>`` of all matches, as half-open
    code-point positions. ``at`` and ``match`` are the whole match. ``value`` is the first
    of ``groups`` that matched, placed at its last occurrence in the match; without groups
    the whole match. ``trim`` drops punctuation from the value's end.

    One search puts marks around the matches, where the text is then cut; a text that holds the
    mark itself is searched once for each part. Positions add up the lengths of what lies
    between the matches, in one fold.
    """
    n = lambda c: F.length(c)
    pattern = for_java(pattern)
    names = [f"g{k}" for k in groups]
    none = F.array().cast(f"array<{SPAN}>")

    def searched_again() -> Column:
        parts = [F.regexp_extract_all(text, F.lit(pattern), F.lit(k)).alias(g) for g, k in zip(names, groups, strict=True)]
        whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
        zipped = F.arrays_zip(F.split(text, pattern, -1).alias("between"), whole.alias("whole"), *parts)
        return F.filter(zipped, lambda x: x["whole"].isNotNull())

    def cut(marked: Column) -> Column:
        every, fields = len(groups) + 2, ("between", "whole", *names)
        row = lambda parts, i: F.struct(*(F.element_at(parts, i * every + k).alias(f) for k, f in enumerate(fields, 1)))
        return let(F.split(marked, MARK, -1), lambda parts: F.transform(F.sequence(F.lit(0), ((F.size(parts) - 1) / every).cast("int") - 1), lambda i: row(parts, i)))

    def step(pos: Column, x: Column) -> tuple[Column, Column]:
        at = pos + n(x["between"])
        match = x["whole"]
        value = F.coalesce(*(F.nullif(x[k], F.lit("")) for k in names), match) if names else match
        start = at + n(match) - (F.position(F.reverse(value), F.reverse(match)) - 1) - n(value) if names else at
        if trim:
            short = F.regexp_replace(value, "[.,;:!?]+$", "")
            value = F.when(n(short) > 0, short).otherwise(value)
        row = F.struct(value.alias("value"), start.cast("int").alias("start"), (start + n(value)).cast("int").alias("end"), match.alias("match"), at.cast("int").alias("at"))
        return (at + n(match)).cast("int"), F.array(row)

    def found(marked: Column) -> Column:
        items = F.when(F.contains(text, F.lit(MARK)), searched_again()).otherwise(cut(marked))
        return F.when(F.contains(marked, F.lit(MARK)), folded(items, F.lit(0), f"array<{SPAN}>", step)["out"]).otherwise(none)

    marked = F.regexp_replace(text, F.lit(pattern), F.lit(MARK + "".join(f"${k}{MARK}" for k in (0, *groups))))
    return F.coalesce(let(marked, found), none)
