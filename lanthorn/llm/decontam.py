"""Benchmark decontamination by greedy string tiling.

Runs of ``least`` words that a document and a benchmark item share are its seeds, found
by joining rolling hashes of word numbers. Each pair with seeds is tiled: the longest
match that touches no marked word is marked, again and again, so passages whose parts
were moved about still count. The share of an item's words under tiles is its coverage.

The benchmark goes to the executors in blocks of a bounded size. Each block costs a pass
over the documents, so a benchmark of any size is covered whole.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._words import batches, record, rows_where, words


@dataclass(frozen=True)
class Tiling:
    least: int = 5
    coverage: float = 0.8
    block_bytes: int = 16 << 20


def rolling(numbers: np.ndarray, width: int) -> np.ndarray:
    """Karp-Rabin hashes of every run of ``width`` numbers, modulo 2^64."""
    n = len(numbers) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        h = np.zeros(n, np.uint64)
        for k in range(width):
            h = h * np.uint64(0x9E3779B97F4A7C15) + numbers[k : k + n].astype(np.uint64) + np.uint64(1)
    return h ^ (h >> np.uint64(29))


def tiles(doc: np.ndarray, item: np.ndarray, seeds: list[tuple[int, int]], least: int) -> list[tuple[int, int, int]]:
    """Greedy tiles ``(item start, doc start, length)`` from the seeds' ``(item, doc)``
    positions, of which the first of each match is enough. The longest comes first, ties by item position, then by document
    position. A match that earlier tiles cut is offered again in its free parts."""
    seeds = sorted(seeds, key=lambda s: (s[1] - s[0], s[0]))
    heap, end = [], (None, -1)
    for t, d in seeds:
        if end[0] == d - t and t < end[1]:
            continue
        size = least
        while t + size < len(item) and d + size < len(doc) and item[t + size] == doc[d + size]:
            size += 1
        end = (d - t, t + size - least + 1)
        heap.append((-size, t, d))
    heapq.heapify(heap)
    used_item, used_doc, out = np.zeros(len(item), bool), {}, []
    while heap:
        size, t, d = heapq.heappop(heap)
        size = -size
        free = [not used_item[t + k] and d + k not in used_doc for k in range(size)]
        if all(free):
            used_item[t : t + size] = True
            used_doc.update(dict.fromkeys(range(d, d + size)))
            out.append((t, d, size))
            continue
        k = 0
        while k < size:
            e = k
            while e < size and free[e]:
                e += 1
            if e - k >= least:
                heapq.heappush(heap, (k - e, t + k, d + k))
            k = e + 1
    return out


class Benchmark:
    """Word numbers and hashed runs of some items."""

    def __init__(self, items: list[tuple[int, str]], least: int):
        self.least, self.number = least, {}
        self.items, hashes, where = [], [], []
        for i, (item_id, text) in enumerate(items):
            numbers = np.array([self.number.setdefault(w, len(self.number)) for w in words(text)], np.int64)
            self.items.append((item_id, numbers))
            runs = rolling(numbers, least)
            hashes.append(runs)
            where += [(i, t) for t in range(len(runs))]
        flat = np.concatenate(hashes) if hashes else np.empty(0, np.uint64)
        order = np.argsort(flat, kind="stable")
        self.hashes, self.where = flat[order], np.array(where, np.int64).reshape(-1, 2)[order]
        #: Places in the benchmark, one apart for runs that follow each other in an item.
        gaps = np.concatenate([np.arange(len(h)) + start for h, start in zip(hashes, np.cumsum([0, *(len(h) + 1 for h in hashes)]), strict=False)]) if hashes else np.empty(0, np.int64)
        self.order = gaps.astype(np.int64)[order]

    def matches(self, tokens: list[bytes]) -> list[tuple[int, int, int, int]]:
        """``(item id, words in the item, words tiled, tiles)`` of each item with a seed."""
        if len(tokens) < self.least or not len(self.hashes):
            return []
        get = self.number.get
        doc = np.fromiter((get(w, -1) for w in tokens), np.int64, len(tokens))
        known = np.concatenate([[0], np.cumsum(doc >= 0)])
        at = np.flatnonzero(known[self.least :] - known[: -self.least] == self.least)
        if not len(at):
            return []
        windows = doc[at[:, None] + np.arange(self.least)]
        with np.errstate(over="ignore"):
            h = np.zeros(len(at), np.uint64)
            for k in range(self.least):
                h = h * np.uint64(0x9E3779B97F4A7C15) + windows[:, k].astype(np.uint64) + np.uint64(1)
        h ^= h >> np.uint64(29)
        low, high = np.searchsorted(self.hashes, h), np.searchsorted(self.hashes, h, "right")
        seeds: dict[int, list[tuple[int, int]]] = {}
        before, last = np.empty(0, np.int64), -2
        for k in np.flatnonzero(high > low):
            here = np.arange(low[k], high[k])
            # What only goes on with a match of the words before is no new start.
            new = here if at[k] != last + 1 else here[np.isin(self.order[here], self.order[before] + 1, invert=True)]
            before, last = here, at[k]
            for i, t in self.where[new].tolist():
                if np.array_equal(self.items[i][1][t : t + self.least], windows[k]):
                    seeds.setdefault(i, []).append((t, int(at[k])))
        out = []
        for i, s in sorted(seeds.items()):
            item_id, numbers = self.items[i]
            marked = tiles(doc, numbers, s, self.least)
            out.append((item_id, len(numbers), sum(m[2] for m in marked), len(marked)))
        return out


def _blocks(benchmark: DataFrame, item_key: str, item_text: str, p: Tiling):
    """Lists of items; each is collected by itself and has about ``block_bytes``."""
    items = benchmark.select(F.col(item_key).cast("long").alias("item_id"), F.col(item_text).alias("text"))
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = max(1, -(-total // p.block_bytes))
    for k in range(n):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).orderBy("item_id", "text").toLocalIterator()
        yield [(r["item_id"], r["text"]) for r in rows]


def matched_items(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", p: Tiling = Tiling()) -> DataFrame:
    """``(doc_id, n_words, item_id, item_words, matched_words, tiles)``: a row for each
    document and item that share a seed, and for each block one row with a null item
    for a document with none. Null and empty texts have no words; items of fewer words
    than a seed can't match. Repeated rows, of documents or items, each give rows of their
    own. A very long text is one row of its task, and its memory follows its length; one that
    repeats itself meets an item at every repeat, so its time follows the product. Other columns
    don't matter, whatever their names. An empty table gives an empty result."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("item_id", pa.int64()), ("item_words", pa.int64()), ("matched_words", pa.int64()), ("tiles", pa.int64())])
    context = docs.sparkSession.sparkContext
    mine = docs.select(docs[key].cast("long").alias("doc_id"), docs[text].alias("text"))
    out = None
    for items in _blocks(benchmark, item_key, item_text, p):
        shipped = context.broadcast(items)

        def run(source, shipped=shipped):
            bench = Benchmark(shipped.value, p.least)
            for ids, texts in batches(source, ["doc_id", "text"]):
                rows = []
                for i, t in zip(ids, texts, strict=True):
                    tokens = words(t)
                    rows += [(i, len(tokens), *m) for m in bench.matches(tokens)] or [(i, len(tokens), None, None, None, None)]
                yield record(schema, *(list(c) for c in zip(*rows, strict=True)))

        part = mine.mapInArrow(run, "doc_id long, n_words long, item_id long, item_words long, matched_words long, tiles long")
        out = part if out is None else out.unionByName(part)
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", p: Tiling = Tiling()) -> DataFrame:
    """Per document id ``n_words``, ``n_items`` that are covered to the threshold, the
    best item (highest coverage, then smallest id) with its coverage, matched words and
    tiles, and ``contaminated``. Rows that share an id give one row, contaminated if any
    of them is; an item that several of them cover counts for each. An empty benchmark
    contaminates nothing, an empty table gives an empty result. Very long and repetitive texts
    and other columns are as in ``matched_items``."""
    rows = matched_items(docs, benchmark, key, text, item_key, item_text, p)
    covered = F.when(F.col("item_words") > 0, F.col("matched_words") / F.col("item_words")).otherwise(F.lit(0.0))
    rows = rows.withColumn("coverage", covered)
    best = F.max_by(F.struct("item_id", "coverage", "matched_words", "tiles"), F.struct("coverage", -F.coalesce("item_id", F.lit(0))))
    hit = F.col("coverage") >= p.coverage
    return rows.groupBy("doc_id").agg(F.max("n_words").alias("n_words"), F.count_if(hit).alias("n_items"), best.alias("b")).select(
        "doc_id", "n_words", "n_items", F.col("b.item_id").alias("item_id"), F.col("b.coverage").alias("coverage"), F.coalesce("b.matched_words", F.lit(0)).alias("matched_words"), F.coalesce("b.tiles", F.lit(0)).alias("tiles"), (F.col("n_items") > 0).alias("contaminated")
    )


def keep_clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_key: str = "item_id", item_text: str = "text", p: Tiling = Tiling()) -> DataFrame:
    """The rows of ``docs`` that cover no item to the threshold, all columns as they were.
    Each row is judged by its text alone, so ids may be null or repeated; null and empty
    texts stay. An empty benchmark keeps all. A block of the benchmark reads what the blocks
    before left."""
    for items in _blocks(benchmark, item_key, item_text, p):
        shipped = docs.sparkSession.sparkContext.broadcast(items)

        def decide(shipped=shipped):
            bench = Benchmark(shipped.value, p.least)
            clean = lambda t: all(m[2] < p.coverage * m[1] for m in bench.matches(words(t)))
            return lambda texts: np.array([clean(t) for t in texts], bool)

        docs = rows_where(docs, F.col(text), decide)
    return docs
