"""Phrases that occur together: merged count-min sketches, exact counts, scores.

A sketch never counts too little. Each task adds the hashed n-grams of its texts to a sketch
of saturating bytes; the parts of all tasks are added up slice by slice, and what stays is
one bit a cell: whether the cell has reached the least count. Sizes are taken in turn. A
phrase is put into its sketch only if the phrases without its first and without its last
word have passed theirs, since it can't be commoner than they are; so a sketch holds little
of the corpus's long tail. A last pass counts exactly what passed all sketches: in a task by
128 bits of hash, over tasks by the phrases' texts. Whatever is frequent passes, and whatever passes wrongly is dropped by its exact
count.

The width of a sketch follows the text (``cells_for``) up to a bound. Beyond the bound more
rare phrases pass and are counted exactly, in a shuffle that has no bound; nothing is lost.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._store import written
from ._words import batches, mix, record

LOWER_AND_PIECES = bytes(32 if c == 9 else 10 if c in b".,;:!?\n\v\f\r" else c + 32 if 65 <= c <= 90 else c for c in range(256))


@dataclass(frozen=True)
class Phrases:
    """``longest`` words a phrase; ``least`` occurrences; a phrase goes if a longer one around
    it has ``covered`` per cent of its occurrences; ``top`` phrases of each language."""

    longest: int = 3
    least: int = 10
    covered: int = 50
    top: int = 2000
    rows: int = 4
    fewest_cells: int = 1 << 16
    most_cells: int = 1 << 25

    def cells_for(self, size: int, text_bytes: int) -> int:
        """Cells a row of the sketch: a power of two, about a cell for 64 bytes of text."""
        cells = 1 << max(0, text_bytes // (256 if size == 1 else 64) - 1).bit_length()
        return min(self.most_cells, max(self.fewest_cells, cells))


#: Bytes of text that are hashed at a time.
BLOCK = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_LETTERS = np.random.default_rng(11).integers(0, 1 << 63, (2, 256), dtype=np.uint64) | np.uint64(1)


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    fill = lambda x: np.cumprod(np.full(n, x, np.uint64), dtype=np.uint64)
    return fill(_BASE), fill(pow(_BASE, -1, 1 << 64))


def pieces(text: str | None) -> bytes:
    """The text with A-Z lower-cased, a line feed for what ends a piece and one space for
    spaces and tabs, so that a phrase is a slice of it."""
    out = (text or "").encode().translate(LOWER_AND_PIECES)
    while b"  " in out:
        out = out.replace(b"  ", b" ")
    return out


def parts(text: bytes, context: int, most: int = 2 * BLOCK) -> Iterator[tuple[bytes, int]]:
    """A long text in parts of about ``most`` bytes: ``(part, words of the one before that
    stand at its head)``. Cut between pieces, else between words, which then overlap by
    ``context``. A part is never shorter than a few words, however long those are."""
    at, head, size = 0, 0, most
    while len(text) - at > size:
        end = text.rfind(b"\n", at + 1, at + size)
        if end > 0:
            yield text[at:end], head
            at, head, size = end, 0, most
            continue
        end = starts = at + len(text[at : max(at, text.rfind(b" ", at, at + size))].rstrip(b" "))
        for _ in range(context):
            word_end = at + len(text[at:starts].rstrip(b" "))
            starts = max(at, text.rfind(b" ", at, word_end) + 1)
        if starts <= at:  # too few words: look further
            size *= 2
            continue
        yield text[at:end], head
        at, head, size = starts, context, most
    yield text[at:], head


@dataclass(frozen=True)
class Grams:
    """The words of a block: where they start and end, their hashes, and for each word how
    many words, itself included, lie between it and the start of its piece or the context."""

    data: bytes
    start: np.ndarray
    end: np.ndarray
    hashes: np.ndarray
    reach: np.ndarray
    fresh: np.ndarray

    @staticmethod
    def of(data: bytes, seed: int, head: int = 0) -> Grams:
        a = np.frombuffer(data, np.uint8)
        inside = np.zeros(len(a) + 2, bool)
        inside[1:-1] = (a != 32) & (a != 10)
        edge = np.flatnonzero(inside[1:] != inside[:-1])
        start, end = edge[::2], edge[1::2]
        line = np.cumsum(a == 10)[start]
        at = np.arange(len(start))
        first = np.maximum.accumulate(np.where(np.diff(line, prepend=-1) != 0, at, 0))
        return Grams(data, start, end, word_hashes(a, start, end, seed), at - first + 1, at >= head)

    def longer(self, before: np.ndarray) -> np.ndarray:
        """Hashes of the phrases that end at each word, from those of one word less."""
        out = np.zeros_like(before)
        out[1:] = mix(before[:-1] * np.uint64(0xD6E8FEB86659FD93) + self.hashes[1:])
        return out


def word_hashes(a: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int, kind: int = 0) -> np.ndarray:
    """A hash of the bytes of each word; those of other ``kind`` are independent."""
    if not len(start):
        return np.zeros(0, np.uint64)
    up, down = _powers(max(2 * BLOCK, 1 << (len(a) - 1).bit_length()))
    run = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_LETTERS[kind][a] * up[: len(a)], dtype=np.uint64)])
    return mix((run[end] - run[start]) * down[start] + np.uint64(seed))


def _cell(hashes: np.ndarray, row: int, cells: int) -> np.ndarray:
    return (mix(hashes + np.uint64((row + 1) * 0xA0761D6478BD642F % (1 << 64))) & np.uint64(cells - 1)).astype(np.uint32)


class Passed:
    """What passes the merged sketch of a size: packed bits, one a cell."""

    def __init__(self, rows: int, cells: int):
        self.rows, self.cells, self.bits = rows, cells, np.zeros((rows, cells // 8), np.uint8)

    def of(self, hashes: np.ndarray) -> np.ndarray:
        out = np.ones(len(hashes), bool)
        for row in range(self.rows):
            cell = _cell(hashes, row, self.cells)
            out &= (self.bits[row][cell >> 3] >> (7 - (cell & 7)).astype(np.uint8) & 1).astype(bool)
        return out


def survivors(grams: Grams, passed: list[Passed]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For sizes 1, 2, ...: the hashes of the phrases that end at each word, and which of them
    may be frequent as far as the sketches of shorter ones (and their own) tell."""
    hashes, may = grams.hashes, np.ones(len(grams.hashes), bool)
    for size in range(1, len(passed) + 2):
        if size > 1:
            hashes = grams.longer(hashes)
            may = may & np.concatenate([[False], may[:-1]]) & (grams.reach >= size)
        if size <= len(passed):
            at = np.flatnonzero(may)
            may[at] = passed[size - 1].of(hashes[at])
        yield hashes, may


def _blocks(source, context: int) -> Iterator[tuple[str, Grams]]:
    """Texts of a language, joined to blocks of bounded size."""
    seeds, held, sizes = {}, {}, {}

    def give(lang: str) -> Iterator[tuple[str, Grams]]:
        data = b"\n".join(held.pop(lang))
        sizes.pop(lang)
        for part, head in parts(data, context):
            yield lang, Grams.of(part, seeds[lang], head)

    for langs, texts in batches(source, ["lang", "text"], 200):
        for lang, text in zip(langs, texts, strict=True):
            if text:
                if lang not in seeds:
                    seeds[lang] = xxhash.xxh64_intdigest(lang.encode())
                held.setdefault(lang, []).append(pieces(text))
                sizes[lang] = sizes.get(lang, 0) + len(held[lang][-1]) + 1
                if sizes[lang] >= BLOCK:
                    yield from give(lang)
                elif len(held) > 64:
                    yield from give(max(sizes, key=sizes.get))
    for lang in list(held):
        yield from give(lang)


#: Hashes that are added to a sketch at a time, and cells that travel together.
ADDED, SLICE = 1 << 21, 1 << 16


def _add(sketch: np.ndarray, hashes: np.ndarray) -> None:
    for row, cells in enumerate(sketch):
        at = np.sort(_cell(hashes, row, len(cells)))
        first = np.flatnonzero(np.diff(at, prepend=at[0] + 1))
        count = np.diff(first, append=len(at))
        cell = at[first]
        cells[cell] = np.minimum(cells[cell] + count, 255)


_SLICE = pa.schema([("slice", pa.int32()), ("cells", pa.binary())])


def _sketched(shipped, p: Phrases, size: int, cells: int):
    """Sketches of the phrases of ``size`` words in a task's texts, in slices."""

    def run(source):
        sketch, held, n = np.zeros((p.rows, cells), np.uint8), [], 0
        for _, grams in _blocks(source, size - 1):
            *_, (hashes, may) = survivors(grams, shipped.value)
            held.append(hashes[may & grams.fresh])
            n += len(held[-1])
            if n >= ADDED:
                _add(sketch, np.concatenate(held))
                held, n = [], 0
        if n:
            _add(sketch, np.concatenate(held))
        pack = zstandard.ZstdCompressor(level=1).compress
        for i, part in enumerate(sketch.reshape(-1, SLICE)):
            if part.any():
                yield record(_SLICE, [i], [pack(part.tobytes())])

    return run


def _merged(least: int):
    """Adds up the parts of each slice; what stays is whether a cell has reached ``least``."""

    def run(source):
        sums, unpack = {}, zstandard.ZstdDecompressor().decompress
        for slices, cells in batches(source, ["slice", "cells"], 64):
            for i, blob in zip(slices, cells, strict=True):
                part = np.frombuffer(unpack(blob), np.uint8)
                sums[i] = np.minimum(sums.get(i, np.zeros(SLICE, np.uint16)) + part, 255)
        for i, total in sums.items():
            yield record(_SLICE, [i], [np.packbits(total >= least).tobytes()])

    return run


def passing(texts: DataFrame, p: Phrases, text_bytes: int) -> list[Passed]:
    """What may be frequent, for each size up to the longest: a pass over the texts a size.
    The driver gets a bit a cell, at most ``rows * most_cells / 8`` bytes."""
    if not 1 <= p.least <= 255:
        raise ValueError("the least count is 1 to 255, the range of a cell")
    context, out = texts.sparkSession.sparkContext, []
    for size in range(1, p.longest + 1):
        cells = p.cells_for(size, text_bytes)
        slices = texts.mapInArrow(_sketched(context.broadcast(out), p, size, cells), "slice int, cells binary")
        found = Passed(p.rows, cells)
        flat = found.bits.reshape(-1, SLICE // 8)
        for r in slices.repartition("slice").mapInArrow(_merged(p.least), "slice int, cells binary").collect():
            flat[r["slice"]] = np.frombuffer(r["cells"], np.uint8)
        out.append(found)
    return out


def grouped(first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(order, starts)`` that bring equal pairs together. Pairs that share only the first
    number are rare, so one sort does unless there are any."""
    order = np.argsort(first, kind="stable")
    a, b = first[order], second[order]
    if ((a[1:] == a[:-1]) & (b[1:] != b[:-1])).any():
        order = np.lexsort((second, first))
        a, b = first[order], second[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return order, np.flatnonzero(new)


def cut_out(data: np.ndarray, start: np.ndarray, length: np.ndarray, most: int = 20_000) -> np.ndarray:
    """The bytes of some slices, one after the other; ``most`` slices at a time, since every
    byte takes an index on the way."""
    out, done = np.empty(int(length.sum()), np.uint8), 0
    for at in range(0, len(start), most):
        n = length[at : at + most]
        ends = np.cumsum(n)
        out[done : done + ends[-1]] = data[np.arange(ends[-1]) + np.repeat(start[at : at + most] - (ends - n), n)]
        done += ends[-1]
    return out


class Tally:
    """Counts of the phrases of a language: a phrase is its bytes, told apart by two
    independent 64-bit hashes. About 50 bytes a phrase."""

    def __init__(self):
        self.first, self.second = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        self.n, self.length = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.text = np.zeros(0, np.uint8)
        self.words, self.waiting, self.held = 0, [], 0

    def __len__(self) -> int:
        return len(self.first) + self.held

    def add(self, data: np.ndarray, first: np.ndarray, second: np.ndarray, start: np.ndarray, end: np.ndarray) -> None:
        self.waiting.append(self.reduced(first, second, np.ones(len(first), np.int64), start, end - start, data))
        self.held += len(self.waiting[-1][0])
        if self.held > max(WAITING, len(self.first) // 4):
            self.settle()

    @staticmethod
    def reduced(first, second, n, start, length, data):
        order, starts = grouped(first, second)
        kept = order[starts]
        return first[kept], second[kept], np.add.reduceat(n[order], starts) if len(starts) else n, length[kept], cut_out(data, start[kept], length[kept])

    def settle(self) -> None:
        parts = [(self.first, self.second, self.n, self.length, self.text), *self.waiting]
        first, second, n, length, text = (np.concatenate(x) for x in zip(*parts, strict=True))
        self.first, self.second, self.n, self.length, self.text = self.reduced(first, second, n, np.cumsum(length) - length, length, text)
        self.waiting, self.held = [], 0

    def rows(self, lang: str) -> Iterator[pa.RecordBatch]:
        """All phrases with their counts, and all words as size 0."""
        self.settle()
        yield record(_COUNT, [lang], [""], [0], [self.words])
        ends = np.concatenate([[0], np.cumsum(self.length)])
        spaces = np.concatenate([[0], np.cumsum(self.text == 32)])
        sizes = spaces[ends[1:]] - spaces[ends[:-1]] + 1
        for at in range(0, len(self.n), 50_000):
            here = ends[at : at + 50_001]
            offsets = pa.py_buffer((here - here[0]).astype(np.int32))
            phrases = pa.StringArray.from_buffers(len(here) - 1, offsets, pa.py_buffer(self.text[here[0] : here[-1]].tobytes()))
            yield record(_COUNT, [lang] * (len(here) - 1), phrases, pa.array(sizes[at : at + 50_000], pa.int32()), pa.array(self.n[at : at + 50_000], pa.int64()))


#: Different phrases that a task holds before it passes them on, and that wait to be merged.
COUNTED, WAITING = 1_000_000, 100_000
_COUNT = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("size", pa.int32()), ("f", pa.int64())])


def _counted(shipped):
    """``(lang, phrase, size, f)`` of what passed, and the number of all words as size 0."""

    def run(source):
        passed, tallies = shipped.value, {}
        for lang, grams in _blocks(source, len(passed) - 1):
            mine = tallies.setdefault(lang, Tally())
            mine.words += int(grams.fresh.sum())
            data = np.frombuffer(grams.data, np.uint8)
            second = dataclasses.replace(grams, hashes=word_hashes(data, grams.start, grams.end, 0, 1))
            other, found = second.hashes, []
            for size, (hashes, may) in zip(range(1, len(passed) + 1), survivors(grams, passed), strict=False):
                other = other if size == 1 else second.longer(other)
                at = np.flatnonzero(may & grams.fresh)
                found.append((hashes[at] + np.uint64(size), other[at], grams.start[at - size + 1], grams.end[at]))
            mine.add(data, *(np.concatenate(x) for x in zip(*found, strict=True)))
            if sum(map(len, tallies.values())) > COUNTED:
                for known, tally in tallies.items():
                    yield from tally.rows(known)
                tallies = {}
        for known, tally in tallies.items():
            yield from tally.rows(known)

    return run


#: Text of a task: what a task passes on, a sketch and the phrases that it has seen, grows
#: more slowly than its text, so small partitions are read together.
TASK_BYTES = 128 << 20
#: Candidates that are sorted together, about.
PHRASES_OF_A_SHARE = 100_000


def counts(texts: DataFrame, p: Phrases) -> DataFrame:
    """``(lang, phrase, size, f)``: the exact counts of all phrases that occur at least
    ``least`` times, and of all words together as size 0, phrase ''."""
    text_bytes = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    context = texts.sparkSession.sparkContext
    texts = texts.coalesce(max(2 * context.defaultParallelism, text_bytes // TASK_BYTES))
    shipped = context.broadcast(passing(texts, p, text_bytes))
    parts = texts.mapInArrow(_counted(shipped), "lang string, phrase string, size int, f long")
    return parts.groupBy("lang", "phrase", "size").agg(F.sum("f").alias("f")).where((F.col("f") >= p.least) | (F.col("size") == 0))


def collocations(docs: DataFrame, p: Phrases = Phrases(), text: str = "text", lang: str = "lang") -> DataFrame:
    """``(lang, rank, phrase, a, l, r, n, score)``: the best phrases of each language.

    A null text is empty, a null language ``und``; repeated rows count each. Texts without
    words and empty tables give nothing. A text is read whole, in parts of bounded size (a
    single word is held whole). Other columns don't matter. Equal scores are ranked by count,
    then by the phrase's bytes, so ranks are the same in every run.
    """
    texts = docs.select(F.coalesce(docs[lang].cast("string"), F.lit("und")).alias("lang"), docs[text].cast("string").alias("text"))
    known = written(counts(texts, p))
    words, piece = F.split("phrase", " "), lambda i, n: F.array_join(F.slice("w", i, n), " ")
    candidates = known.where("size >= 2").select("lang", "phrase", "size", F.col("f").alias("a"), words.alias("w"))
    # Every cut, and the counts of its two parts: those are at least as common, so they are known.
    cut = F.explode(F.transform(F.sequence(F.lit(1), F.col("size") - 1), lambda k: F.struct(k.alias("k"), piece(F.lit(1), k).alias("left"), piece(k + 1, F.col("size") - k).alias("right"))))
    cuts = candidates.select("lang", "phrase", "a", cut.alias("cut")).select("lang", "phrase", "a", "cut.*")
    part = lambda name, count: known.where("size > 0").select("lang", F.col("phrase").alias(name), F.col("f").alias(count))
    whole = cuts.join(part("left", "l"), ["lang", "left"]).join(part("right", "r"), ["lang", "right"])
    wide = lambda c: F.col(c).cast("decimal(38,0)")
    scored = whole.withColumns({"aa": (wide("a") * wide("a") * F.lit(1_000_000).cast("decimal(38,0)")).cast("decimal(38,0)"), "lr": (wide("l") * wide("r")).cast("decimal(38,0)")})
    scored = scored.withColumn("score", F.expr("cast(aa div lr as bigint)"))
    best = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("b"))
    # Phrases within longer ones that have most of their occurrences.
    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.col("size") - 1), lambda m: F.transform(F.sequence(F.lit(1), F.col("size") - m + 1), lambda i: piece(i, m))))
    around = candidates.where("size > 2").select("lang", F.explode(F.array_distinct(inner)).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("around"))
    left = best.join(around, ["lang", "phrase"], "left").where(F.coalesce(100 * F.col("around").cast("decimal(20,0)") < p.covered * F.col("a").cast("decimal(20,0)"), F.lit(True)))
    totals = known.where("size = 0").select("lang", F.col("f").alias("n"))
    # The best of each part of the phrases, then the best of those: no task sorts all of a language.
    order = (F.desc("b.score"), F.desc("a"), "phrase")
    place = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    shares = max(8, candidates.count() // PHRASES_OF_A_SHARE)
    left = left.withColumn("share", F.pmod(F.xxhash64("phrase"), F.lit(shares)))
    ranked = left.withColumn("rank", place("lang", "share")).where(F.col("rank") <= p.top)
    ranked = ranked.withColumn("rank", place("lang")).where(F.col("rank") <= p.top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", F.col("b.l").alias("l"), F.col("b.r").alias("r"), "n", F.col("b.score").alias("score"))
