"""License scans with DataFrame functions only.

A text is cut into windows of six words, a new one every two, so that any run of five
words lies whole in some window, which then has that 5-word shingle and at most one more.
40 minima, each a band of one row, retrieve a template that has a window with any equal
minimum. Two windows with a shingle in common have a similarity of a third or more, so
they fail to meet with probability (2/3)^40 < 1e-7. Retrieved templates are verified by
exact containment: the share of the template's shingles that the text's windows hold,
compared by 64-bit hashes.

A template of fewer than five words is one shingle of all its words; a text holds it where
these words stand in a row, compared as words.

Band values of up to ``most_windows`` template windows are literals of the plan, so windows
are compared where they are made and only retrieved ones are shuffled. Beyond that number
band values and shingles are tables, joined on band and value; the results are the same.
"""

from __future__ import annotations

import string
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._licenses import BODIES

WINDOW, STEP, SHINGLE = 6, 2, 5

# Fixed texts: notices by which public licences are declared, and bodies of licences.
NOTICES = {
    "MIT": "Released under the MIT License.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "BSD-3-Clause": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "LGPL-2.1": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License.",
    "all-rights-reserved": "All rights reserved. No part of this publication may be reproduced.",
    **BODIES,
}


@dataclass(frozen=True)
class Scan:
    minima: int = 40
    containment: float = 0.8
    most_windows: int = 4096
    seed: int = 99


def tokens(text: Column) -> Column:
    """Words in lower case (A-Z), without ASCII punctuation."""
    source = string.ascii_uppercase + "\t\n\x0b\x0c\r" + string.punctuation
    return F.array_remove(F.split(F.translate(text, source, string.ascii_lowercase + " " * 5), " "), "")


def _windows(text: Column, step: int) -> Column:
    """The windows of a text, each as the hashes of its first and last shingle. Splitting
    the text is bound to a variable, so it happens once."""

    def of(words: Column) -> Column:
        n = F.size(words)
        starts = F.sequence(F.lit(1), F.greatest(n - (SHINGLE - 1), F.lit(1)), F.lit(step))
        shingle = lambda i: F.xxhash64(F.slice(words, i, SHINGLE))
        pair = lambda i: F.struct(shingle(i).alias("h0"), shingle(F.least(i + 1, n - (SHINGLE - 1))).alias("h1"))
        low = lambda h: h.bitwiseAND(F.lit(LOW).cast("long"))
        with_low = lambda w: F.struct(w["h0"], w["h1"], low(w["h0"]).alias("g0"), low(w["h1"]).alias("g1"))
        return F.when(n >= SHINGLE, F.transform(F.transform(starts, pair), with_low))

    return F.element_at(F.transform(F.array(tokens(text)), of), 1)


def _short(text: Column, templates: list[tuple[str, int, str]]) -> Column:
    """The short templates, ``(template_id, h, words)``, whose words stand in a text."""

    def of(plain: Column) -> Column:
        hit = lambda t, h, words: F.when(plain.contains(f" {words} "), F.struct(F.lit(t).alias("template_id"), F.lit(h).alias("h")))
        return F.array_compact(F.array(*(hit(*x) for x in templates)))

    return F.element_at(F.transform(F.array(F.concat(F.lit(" "), F.array_join(tokens(text), " "), F.lit(" "))), of), 1)


def _short_runs(mine: DataFrame) -> DataFrame:
    """``(doc_id, words)``: every run of fewer than ``SHINGLE`` words of each text."""

    def run(words: Column, k: int) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(words) - k + 1, F.lit(1)))
        return F.when(F.size(words) >= k, F.transform(starts, lambda i: F.array_join(F.slice(words, i, k), " "))).otherwise(F.array().cast("array<string>"))

    def of(words: Column) -> Column:
        return F.array_distinct(F.concat(*(run(words, k) for k in range(1, SHINGLE))))

    return mine.select("doc_id", F.explode(F.element_at(F.transform(F.array(tokens(F.col("text"))), of), 1)).alias("words"))


LOW = (1 << 31) - 1


def _functions(p: Scan) -> list[str]:
    """For each band the least of a universal hash (multiply by an odd number, modulo
    2^31) over a window's shingles, as SQL. Short enough for the JVM to compile all."""
    odd = np.random.default_rng(p.seed).integers(1, 1 << 30, p.minima) * 2 + 1
    return [f"least((g0 * {a}L) & {LOW}L, (g1 * {a}L) & {LOW}L)" for a in odd.tolist()]


def notices(spark, named: dict[str, str] | None = None) -> DataFrame:
    return spark.createDataFrame(sorted((named or NOTICES).items()), "template_id string, template string")


def license_matches(docs: DataFrame, templates: DataFrame | None = None, key: str = "doc_id", text: str = "text", p: Scan = Scan()) -> DataFrame:
    """``(doc_id, template_id, template_shingles, matched_shingles, containment)`` where a
    text holds at least ``p.containment`` of a template's distinct shingles. A template of
    fewer than five words is one shingle; null or empty texts and templates, and
    templates without an id, match nothing.
    Rows that share an id are read as one document; a null id takes part as one. An empty
    table matches nothing; of other columns, whatever their names, none is read; time and
    memory follow a text's length, which is unbounded."""
    spark = docs.sparkSession
    templates = (notices(spark) if templates is None else templates).select("template_id", "template")
    mine = docs.select(docs[key].cast("long").alias("doc_id"), docs[text].alias("text"))
    minima = _functions(p)
    model = templates.select("template_id", F.inline(_windows(F.col("template"), 1)))
    model = model.select("template_id", "h0", "h1", F.array(*map(F.expr, minima)).alias("m"))
    few = templates.select("template_id", tokens(F.col("template")).alias("w")).where(F.size("w").between(1, SHINGLE - 1))
    few = few.select("template_id", F.xxhash64("w").alias("h"), F.array_join("w", " ").alias("words")).distinct()
    rows, short = (df.limit(p.most_windows + 1).collect() for df in (model, few))
    long_literals, short_literals = (len(x) <= p.most_windows for x in (rows, short))
    values = [f"{least} in ({', '.join(f'{v}L' for v in sorted({r['m'][j] for r in rows}))})" for j, least in enumerate(minima)] if rows and long_literals else []
    bands = model.select("template_id", F.posexplode("m").alias("band", "m")).distinct()
    held = model.select("template_id", F.explode(F.array("h0", "h1")).alias("h")).unionAll(few.select("template_id", "h")).distinct()
    sizes = held.groupBy("template_id").agg(F.count("*").alias("template_shingles"))
    if long_literals and short_literals:
        # At most ``most_windows`` times ``minima`` rows each.
        bands, held, sizes = map(F.broadcast, (bands, held, sizes))
    cut = mine.select("doc_id", F.inline(_windows(F.col("text"), STEP)))
    cut = cut.where(" or ".join(values)) if values else cut.where(F.lit(bool(rows)))
    hits = cut.select("doc_id", "h0", "h1", F.posexplode(F.array(*map(F.expr, minima))).alias("band", "m"))
    hits = hits.join(bands, ["band", "m"]).select("doc_id", "template_id", F.explode(F.array("h0", "h1")).alias("h"))
    found = hits.join(held, ["template_id", "h"]).select("doc_id", "template_id", "h")
    if short and short_literals:
        found = found.unionAll(mine.select("doc_id", F.inline(_short(F.col("text"), sorted(tuple(r) for r in short)))).select("doc_id", "template_id", "h"))
    elif short:
        found = found.unionAll(_short_runs(mine).join(few.select("template_id", "h", "words"), "words").select("doc_id", "template_id", "h"))
    matched = found.groupBy("doc_id", "template_id").agg(F.count_distinct("h").alias("matched_shingles"))
    out = matched.join(sizes, "template_id")
    return out.where(F.col("matched_shingles") >= p.containment * F.col("template_shingles")).select("doc_id", "template_id", "template_shingles", "matched_shingles", (F.col("matched_shingles") / F.col("template_shingles")).alias("containment"))
