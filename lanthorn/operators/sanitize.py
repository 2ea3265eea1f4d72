"""Replacing findings: tokens, numbered pseudonyms or synthetic values.

A document is one row. Equal values find each other by sorting; pseudonym numbers and the
positions in the output are running sums, and the text is cut in parts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.categories import attribute
from ..functions.dialect import built_once, cut_between, folded, leaders, let, places, portable, settled
from .resolve import FINDING
from .risk import active

MODES = {"redact": "category tokens", "pseudonymize": "numbered pseudonyms", "synthetic": "realistic stand-ins"}
MOST_BUMPS = 50

# Pools that synthetic values are drawn from.
FIRST = ("Alex", "Jordan", "Taylor", "Morgan", "Casey", "Riley", "Avery", "Quinn", "Rowan", "Drew", "Harper", "Emerson")
LAST = ("Taylor", "Brooks", "Rivera", "Bennett", "Hayes", "Clarke", "Foster", "Nolan", "Reeves", "Sandoval")
COMPANIES = ("Northwind Traders", "Contoso", "Fabrikam", "Globex", "Blue Harbour Group", "Cygnus Logistics", "Vertex Foods", "Solstice Bank")
TOWNS = ("Springfield", "Fairview", "Rivertown", "Lakeside", "Norwood")
HOSTS = ("APP-NODE-07", "DB-SRV-12", "WEB-EDGE-03", "FILE-STORE-05", "MAIL-RELAY-02", "BKP-REPO-09")
PROJECTS = ("Aurora", "Meridian", "Lighthouse", "Cobalt", "Skyline")
# Categories that have more than one synthetic value.
VARIED = (
    "PERSON", "EMAIL", "PHONE", "ORGANISATION", "LOCATION", "POSTAL_ADDRESS", "IP_ADDRESS", "MAC_ADDRESS", "INTERNAL_HOST", "NETWORK_PATH", "URL", "CUSTOMER_ID", "CASE_ID", "CONTRACT_ID", "EMPLOYEE_ID", "REFERENCE_ID",
    "PROJECT_CODE", "RELEASE_PLAN", "PRICING_TERM", "LICENSE_KEY", "UUID", "NATIONAL_ID",
)


def padded(n: Column, width: int) -> Column:
    """Zeros up to the width; longer numbers stay whole."""
    s = n.cast("string")
    return F.lpad(s, F.greatest(F.length(s), F.lit(width)), F.lit("0"))


def fnv(value: Column) -> Column:
    """The 32-bit FNV-1a hash over code points, as the absolute value of a signed int."""
    codes = F.filter(F.transform(F.split(value, ""), F.ascii), lambda c: c > 0)
    h = F.aggregate(codes, F.lit(2166136261).cast("bigint"), lambda h, c: (h.bitwiseXOR(c.cast("bigint")) * F.lit(16777619).cast("bigint")).bitwiseAND(F.lit(4294967295).cast("bigint")))
    return let(h, lambda x: F.abs(F.when(x > 2147483647, x - 4294967296).otherwise(x)))


def _pick(pool: tuple[str, ...], n: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, pool)), (n % len(pool) + 1).cast("int"))


def synthetic(category: Column, seed: Column, bump: Column) -> Column:
    """A stand-in for the value whose ``fnv`` is given; ``bump`` moves on to the next one."""

    def of(seed: Column) -> Column:
        at, n = seed + bump, (seed + bump) % 9000
        first, last = _pick(FIRST, at), _pick(LAST, seed + bump * 3)
        say = lambda form, *x: F.concat(*(y for pair in zip(map(F.lit, form), [*x, F.lit("")], strict=True) for y in pair))
        # The forms of synthetic values.
        forms = {
            "PERSON": say(["", " ", ""], first, last),
            "EMAIL": say(["", ".", "@example.com"], F.lower(first), F.lower(last)),
            "PHONE": say(["+1 555 01", ""], padded(n % 100, 2)),
            "ORGANISATION": _pick(COMPANIES, at),
            "LOCATION": _pick(TOWNS, at),
            "POSTAL_ADDRESS": say(["", " Example Street, ", ""], (10 + n % 80).cast("string"), _pick(TOWNS, at)),
            "IP_ADDRESS": say(["203.0.113.", ""], (10 + n % 240).cast("string")),
            "MAC_ADDRESS": say(["00:1B:44:11:3A:", ""], F.lpad(F.hex(n % 256), 2, "0")),
            "INTERNAL_HOST": _pick(HOSTS, at),
            "NETWORK_PATH": say(["\\\\", "\\shared"], _pick(HOSTS, at)),
            "URL": say(["https://example.com/page-", ""], padded(n % 100, 2)),
            "CUSTOMER_ID": say(["CUST-", ""], padded(n + 100000, 6)),
            "CASE_ID": say(["CASE-", ""], padded(n + 20000, 5)),
            "CONTRACT_ID": say(["CTR-", ""], padded(n + 30000, 5)),
            "EMPLOYEE_ID": say(["EMP-", ""], padded(n + 40000, 5)),
            "REFERENCE_ID": say(["REF-", ""], padded(n + 50000, 5)),
            "PROJECT_CODE": _pick(PROJECTS, at),
            "RELEASE_PLAN": say(["Q", " 20", ""], (1 + n % 4).cast("string"), (30 + n % 5).cast("string")),
            "PRICING_TERM": say(["", "% discount"], (5 + n % 20).cast("string")),
            "LICENSE_KEY": say(["EXMP-", "-", "-", ""], padded(n, 4), padded(n * 7 % 10000, 4), padded(n * 13 % 10000, 4)),
            "UUID": say(["00000000-0000-4000-8000-", ""], padded(n, 12)),
            "CREDIT_CARD": F.lit("4111 1111 1111 1111"),
            "BANK_ACCOUNT": F.lit("GB29 NWBK 6016 1331 9268 19"),
            "NATIONAL_ID": say(["999-00-", ""], padded(n % 10000, 4)),
        }
        chosen = F.when(category == "PERSON", forms.pop("PERSON"))
        for name, form in forms.items():
            chosen = chosen.when(category == name, form)
        return chosen.otherwise(attribute(category, "token"))

    return of(seed)


def identity(finding: Column) -> Column:
    """What counts as the same value: category, and the text without case and spacing."""
    return F.concat(finding["category"], F.lit("::"), F.regexp_replace(F.lower(finding["value"]), portable(r"\s+"), " "))


def _is_token(finding: Column, mode: str) -> Column:
    return (attribute(finding["category"], "group") == "secret") | F.lit(mode == "redact")


def preview(finding: Column, mode: str) -> Column:
    """What a finding would become by itself."""
    token, prefix = attribute(finding["category"], "token"), attribute(finding["category"], "prefix")
    other = F.concat(prefix, F.lit("_001")) if mode == "pseudonymize" else let(fnv(finding["value"]), lambda seed: synthetic(finding["category"], seed, F.lit(0)))
    return F.when(_is_token(finding, mode), token).otherwise(other)


def apart(findings: Column) -> Column:
    """Findings by start, without those that start inside the one kept before."""
    keyed = F.transform(findings, lambda f, i: F.struct(f["start"].alias("s"), i.alias("i"), f.alias("f")))
    ordered = F.transform(F.array_sort(keyed), lambda k: k["f"])
    none = F.array().cast(f"array<{FINDING}>")
    keep = lambda end, f: (F.when(f["start"] < end, end).otherwise(f["end"]), F.when(f["start"] < end, none).otherwise(F.array(f.cast(FINDING))))
    # Those of a scan are in order and apart already.
    bounds = F.transform(findings, lambda f: F.struct(f["start"].alias("s"), f["end"].alias("e")))
    behind = lambda at, i: F.when(i == 0, F.lit(0)).otherwise(F.element_at(at, F.greatest(i, F.lit(1)))["e"])
    sound = let(bounds, lambda at: F.forall(F.transform(at, lambda b, i: F.coalesce((b["s"] >= behind(at, i)) & (b["e"] >= b["s"]), F.lit(False))), lambda ok: ok))
    return F.when(sound, findings.cast(f"array<{FINDING}>")).otherwise(folded(ordered, F.lit(0), f"array<{FINDING}>", keep)["out"])


def _numbers(found: Column, first: Column) -> Column:
    """The number of each finding that leads its value among those of its category."""
    keyed = F.array_sort(F.transform(found, lambda f, i: F.struct(f["category"].alias("c"), i.alias("i"), (F.element_at(first, i + 1) == i).alias("new"))))

    def step(s: Column, x: Column) -> tuple[Column, Column]:
        n = F.when(s["c"].eqNullSafe(x["c"]), s["n"]).otherwise(0) + x["new"].cast("int")
        return F.struct(x["c"].alias("c"), n.alias("n")), F.array(F.struct(x["i"].alias("i"), n.alias("n")))

    zero = F.struct(F.lit(None).cast("string").alias("c"), F.lit(0).alias("n"))
    return F.transform(F.array_sort(folded(keyed, zero, "array<struct<i:int,n:int>>", step)["out"]), lambda x: x["n"])


def _stand_ins(found: Column, first: Column) -> Column:
    """A synthetic value for each finding that leads its value: the first of fifty that no
    other has, else the last. What is taken is a set, no larger than the pools."""

    def free(f: Column, seed: Column, taken: Column) -> Column:
        make = lambda b: synthetic(f["category"], seed, b)
        used = lambda x: F.array_contains(taken, x)
        more = lambda x: F.aggregate(
            F.sequence(F.lit(2), F.lit(MOST_BUMPS)), F.struct(x.alias("x"), F.lit(False).alias("over")),
            lambda s, b: F.when(s["over"], s).otherwise(F.when(used(s["x"]), F.struct(make(b).alias("x"), F.lit(False).alias("over"))).otherwise(F.struct(s["x"].alias("x"), F.lit(True).alias("over")))),
            lambda s: s["x"],
        )
        # Mostly the first or the second is free; a category with a single one has no other.
        second = lambda x: F.when(used(x) & f["category"].isin(*VARIED), let(make(F.lit(1)), lambda y: F.when(used(y), more(y)).otherwise(y))).otherwise(x)
        return let(make(F.lit(0)), second)

    def step(taken: Column, i: Column) -> Column:
        f = F.element_at(found, i + 1)
        both = lambda taken, x: F.struct(taken.alias("state"), F.array(x).alias("out"))
        row = lambda x: both(F.when(F.array_contains(taken, x), taken).otherwise(F.array_append(taken, x)), x)
        value = F.when(_is_token(f, "synthetic"), attribute(f["category"], "token")).otherwise(let(fnv(f["value"]), lambda seed: free(f, seed, taken)))
        return F.when(F.element_at(first, i + 1) == i, let(value, row)).otherwise(both(taken, F.lit("")))

    return folded(places(found), F.array().cast("array<string>"), "array<string>", step)["out"]


def _own(found: Column, first: Column, mode: str) -> Column:
    """What those that lead their value get: a number or a synthetic value."""
    return _stand_ins(found, first) if mode == "synthetic" else _numbers(found, first)


def _replacements(found: Column, first: Column, own: Column, mode: str) -> Column:
    """What each finding becomes: the same for the same value."""
    token = lambda f: attribute(f["category"], "token")
    if mode == "redact":
        return F.transform(found, token)
    if mode == "synthetic":
        return F.transform(first, lambda at: F.element_at(own, at + 1))
    name = lambda f, n: F.when(_is_token(f, mode), token(f)).otherwise(F.concat(attribute(f["category"], "prefix"), F.lit("_"), padded(n, 3)))
    return F.transform(found, lambda f, i: name(f, F.element_at(own, F.element_at(first, i + 1) + 1)))


ROW = "struct<id:string,category:string,value:string,replacement:string,start:int,end:int>"


def _placed(found: Column, given: Column) -> Column:
    """A row for each replacement, with its place in the output."""

    def step(moved: Column, x: Column) -> tuple[Column, Column]:
        f, r = x["f"], x["r"]
        start = f["start"] + moved
        row = F.struct(f["id"].alias("id"), f["category"].alias("category"), f["value"].alias("value"), r.alias("replacement"), start.alias("start"), (start + F.length(r)).alias("end"))
        return moved + F.length(r) - (f["end"] - f["start"]), F.array(row.cast(ROW))

    pairs = F.zip_with(found, given, lambda f, r: F.struct(f.alias("f"), r.alias("r")))
    return folded(pairs, F.lit(0), f"array<{ROW}>", step)["out"]


def _joined(text: Column, found: Column, given: Column) -> Column:
    parts = cut_between(text, found, lambda gap, inside, i: F.array(gap, F.element_at(given, i + 1)))
    end = F.when(F.size(found) > 0, F.element_at(found, -1)["end"]).otherwise(0)
    return F.concat(F.array_join(parts, ""), F.substring(text, end + 1, F.length(text)))


def _value_map(rows: Column, at: Column) -> Column:
    last = F.filter(rows, lambda r, i: F.element_at(at, i + 1) == i)
    return F.map_from_entries(F.transform(last, lambda r: F.struct(r["value"].alias("key"), r["replacement"].alias("value"))))


@built_once
def _step(name: str, mode: str, text: str, findings: str) -> Column:
    found, given, rows = F.col("__found"), F.col("__given"), F.col("__rows")
    make = {
        "found": lambda: let(active(F.col(findings)), apart), "first": lambda: leaders(found, identity), "own": lambda: _own(found, F.col("__first"), mode), "given": lambda: _replacements(found, F.col("__first"), F.col("__own"), mode), "rows": lambda: _placed(found, given),
        "last": lambda: leaders(rows, lambda r: r["value"], last=True), "text": lambda: _joined(F.col(text), found, given), "map": lambda: _value_map(rows, F.col("__last")),
    }
    return make[name]()


def cleaned(df: DataFrame, mode: str = "redact", name: str = "clean", text: str = "text", findings: str = "findings") -> DataFrame:
    """``df`` with ``name``, a ``struct<text, replacements, value_map>``. A finding that
    starts inside the one before is skipped; a value's last replacement stands in the map. A
    null text stays null. Time follows the number of findings, but for sorting. What a query
    doesn't ask for of the struct is not made."""
    if mode not in MODES:
        raise ValueError(f"mode is one of {', '.join(MODES)}")
    steps = ("found", *(() if mode == "redact" else ("first", "own")), "given", "rows", "last", "text", "map")
    for step in steps:
        df = settled(df, f"__{step}", _step(step, mode, text, findings))
    return df.withColumn(name, F.struct(F.col("__text").alias("text"), F.col("__rows").alias("replacements"), F.col("__map").alias("value_map"))).drop(*(f"__{step}" for step in steps))


def apply_value_map(text: Column, value_map: Column) -> Column:
    """The text with every key replaced, longest first; equal lengths by key."""
    keyed = F.transform(F.map_entries(value_map), lambda e: F.struct((-F.length(e["key"])).alias("n"), e["key"].alias("k"), e["value"].alias("v")))
    return F.aggregate(F.array_sort(keyed), text, lambda t, e: F.when(e["k"] == "", t).otherwise(F.replace(t, e["k"], e["v"])))


def residual(findings: Column, replacements: Column) -> Column:
    """Findings of a second scan that are not the stand-ins themselves."""
    own = F.transform(replacements, lambda r: r["replacement"])
    return F.filter(findings, lambda f: ~F.array_contains(own, f["value"]))
