"""Toxicity by a factorization machine over hashed terms.

A text's terms are its distinct words, lower-cased (A-Z) and stripped of ASCII
punctuation, and these words' beginnings, hashed to buckets. The score adds a weight for each term and, for each pair
of terms, the inner product of their factors, so a pair can count for more (or less) than
its terms alone. Every bucket of the training rows is learned: the ones tied most to the
label (chi-squared) first and by themselves, then all together, from there.

Labels are learned from a bounded sample (``MOST_LABELLED`` rows, ``MOST_TERMS`` terms); scoring reads whole
texts of all rows.
"""

from __future__ import annotations

import pickle
import string
import zlib
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._labels import MOST_LABELLED, bucket, labelled
from ._store import written
from ._words import batches, record, rows_where, words

CUT = 0.5
BUCKETS = 1 << 20
#: The bound on the terms of all rows that the machine learns from.
MOST_TERMS = 12 << 20
_PUNCTUATION = string.punctuation.encode()


def term_buckets(word: bytes) -> list[int]:
    """The buckets of a word and of its beginnings of three to eight bytes."""
    word = word.strip(_PUNCTUATION)
    return [zlib.crc32(word) % BUCKETS, *(zlib.crc32(word[:n], 1) % BUCKETS for n in range(3, min(9, len(word))))]


class Column:
    """The numbers of the learned buckets, in their order."""

    def __init__(self, buckets: np.ndarray):
        self.numbers = np.full(BUCKETS, -1, np.int32)
        self.numbers[buckets] = np.arange(len(buckets), dtype=np.int32)

    def __contains__(self, bucket: int) -> bool:
        return self.numbers[bucket] >= 0

    def __getitem__(self, bucket: int) -> int:
        return self.numbers[bucket]


class Terms:
    """The buckets of whole texts; of a bounded number of words they are remembered.
    ``column`` numbers the buckets that matter (default: all, by themselves)."""

    def __init__(self, column: Column | None = None, limit: int = 100_000):
        self.column, self.limit, self.known = column, limit, {}

    def of(self, text: str | None) -> np.ndarray:
        distinct, column = set(words(text)), self.column
        if len(self.known) > self.limit:
            self.known.clear()
        for w in distinct.difference(self.known):
            found = term_buckets(w)
            self.known[w] = np.array(found if column is None else [column[b] for b in found if b in column], np.int32).tobytes()
        return np.unique(np.frombuffer(b"".join(map(self.known.__getitem__, distinct)), np.int32))


@dataclass(frozen=True)
class Machine:
    """Over the learned buckets: a bias, a weight and some factors for each."""

    column: Column
    bias: float
    weight: np.ndarray
    factor: np.ndarray

    def score(self, columns: Iterable[np.ndarray], n: int) -> np.ndarray:
        """Of ``n`` texts, given the learned buckets of each."""
        out = np.empty(n)
        for i, at in enumerate(columns):
            f = self.factor[at]
            out[i] = self.bias + self.weight[at].sum() + 0.5 * (f.sum(axis=0) ** 2 - (f**2).sum(axis=0)).sum()
        return 1 / (1 + np.exp(-np.clip(out, -60, 60)))


def choose(rows: list[np.ndarray], y: np.ndarray, most: int, least_rows: int) -> list[int]:
    """The buckets whose presence is tied most to the label, ties by number."""
    seen, toxic = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for r, mark in zip(rows, y, strict=True):
        seen[r] += 1
        toxic[r] += mark
    n, positive = len(y), y.sum()
    a, b = toxic, seen - toxic
    c, d = positive - a, n - positive - b
    with np.errstate(divide="ignore", invalid="ignore"):
        chi = n * (a * d - b * c) ** 2 / ((a + b) * (c + d) * (a + c) * (b + d))
    chi = np.where((seen >= least_rows) & np.isfinite(chi), chi, 0)
    order = np.lexsort((np.arange(BUCKETS), -chi))[:most]
    return [int(b) for b in order if chi[b] > 0]


def fit(rows: list[np.ndarray], y: np.ndarray, most: int = 1024, least_rows: int = 4, rank: int = 8, epochs: int = 40, rate: float = 0.1, decay: float = 1e-3, most_weight: float = 4.0, seed: int = 3) -> Machine:
    """From each row's distinct buckets and its label. Adagrad on logistic loss, in which the rarer toxic rows weigh up to ``most_weight``.
    ``most`` and ``least_rows`` bound the buckets that are learned first, not the machine's.
    With one label only, the score is that label's share."""
    y = y.astype(np.float64)
    n, positive = len(y), y.sum()
    bias = float(np.log((positive + 0.5) / (n - positive + 0.5)))
    weigh = np.where(y == 1, np.clip((n - positive) / max(positive, 1), 1, most_weight), 1.0)
    buckets = choose(rows, y, most, least_rows) if 0 < positive < n else []
    m, rng = len(buckets), np.random.default_rng(seed)
    w, f = np.zeros(m), rng.normal(0, 0.01, (m, rank))
    gw, gf, gb = np.full(m, 1e-8), np.full((m, rank), 1e-8), 1e-8
    x = np.zeros((n, m), np.uint8)
    numbers = np.full(BUCKETS, -1, np.int32)
    numbers[buckets] = np.arange(m, dtype=np.int32)
    for i, r in enumerate(rows):
        at = numbers[r]
        x[i, at[at >= 0]] = 1
    for _ in range(epochs if m else 0):
        for at in np.array_split(rng.permutation(n), max(1, n // 256)):
            part = x[at].astype(np.float64)
            total = part @ f
            z = bias + part @ w + 0.5 * (total**2 - part @ f**2).sum(axis=1)
            g = (1 / (1 + np.exp(-np.clip(z, -60, 60))) - y[at]) * weigh[at] / len(at)
            dw = g @ part + decay * w / 10
            df = part.T @ (g[:, None] * total) - (g @ part)[:, None] * f + decay * f
            db = g.sum()
            gw, gf, gb = gw + dw**2, gf + df**2, gb + db**2
            w -= rate * dw / np.sqrt(gw)
            f -= rate * 0.3 * df / np.sqrt(gf)
            bias -= rate * db / np.sqrt(gb)
    return fit_all(rows, y, weigh, buckets, float(bias), w, f, 3 * epochs, rate, decay, rng)


def blocks(rows: list[np.ndarray], order: np.ndarray, size: int = 256):
    """The rows in blocks: their numbers, their distinct columns, each entry's place among
    these and where each row's entries start; and the entries by column: their rows and
    where each column's start. Rows without entries are left out."""
    order = np.array([i for i in order if len(rows[i])], np.int64)
    for at in np.array_split(order, max(1, len(order) // size)) if len(order) else ():
        sizes = np.array([len(rows[i]) for i in at])
        columns, entry = np.unique(np.concatenate([rows[i] for i in at]), return_inverse=True)
        by = np.argsort(entry, kind="stable")
        owner = np.repeat(np.arange(len(at), dtype=np.int32), sizes)[by]
        yield at, columns, entry.astype(np.int32), np.cumsum(sizes) - sizes, owner, np.searchsorted(entry[by], np.arange(len(columns)))


def fit_all(rows: list[np.ndarray], y: np.ndarray, weigh: np.ndarray, first: list[int], bias: float, weight: np.ndarray, factor: np.ndarray, steps: int, rate: float, decay: float, rng, start: float = 0.1) -> Machine:
    """The machine over all buckets of the rows, from what the ``first`` ones learned, by
    sparse Adagrad in ``steps`` steps (a block of 256 rows each, as many passes as that takes):
    a block updates its own columns, whose decay makes up for the blocks without them. Sums of squares begin at ``start``, so a rare bucket moves little."""
    if not first and (y == y[:1]).all():
        return Machine(Column(np.empty(0, np.int32)), bias, weight, factor)
    known = np.unique(np.concatenate(rows))
    m, rank = len(known), factor.shape[1]
    w, f = np.zeros(m, np.float32), rng.normal(0, 0.01, (m, rank)).astype(np.float32)
    at = np.searchsorted(known, np.array(first, np.int32))
    w[at], f[at] = weight, factor
    gw, gf, gb = np.full(m, start, np.float32), np.full((m, rank), start, np.float32), start
    parts = list(blocks([np.searchsorted(known, r).astype(np.int32) for r in rows], rng.permutation(len(rows))))
    touched = np.zeros(m, np.float32)
    for part in parts:
        touched[part[1]] += 1
    late = len(parts) / np.maximum(touched, 1)
    for _ in range(-(-steps // max(len(parts), 1)) if parts else 0):
        for k in rng.permutation(len(parts)):
            at, columns, entry, starts, owner, firsts = parts[k]
            wl, fl, d = w[columns], f[columns], decay * late[columns]
            total = np.add.reduceat(fl[entry], starts, axis=0)
            z = bias + np.add.reduceat((wl - 0.5 * (fl**2).sum(axis=1))[entry], starts) + 0.5 * (total**2).sum(axis=1)
            g = ((1 / (1 + np.exp(-np.clip(z, -60, 60))) - y[at]) * weigh[at] / len(at)).astype(np.float32)
            both = np.add.reduceat(np.column_stack([g, g[:, None] * total])[owner], firsts, axis=0)
            dw = both[:, 0] + d * wl / 10
            df = both[:, 1:] - both[:, :1] * fl + d[:, None] * fl
            gw[columns] += dw**2
            gf[columns] += df**2
            db = float(g.sum())
            gb += db**2
            w[columns] = wl - rate * dw / np.sqrt(gw[columns])
            f[columns] = fl - rate * 0.3 * df / np.sqrt(gf[columns])
            bias -= rate * db / np.sqrt(gb)
    return Machine(Column(known), float(bias), w, f)


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", held_out: tuple[int, int] = (5, 0), key: str = "doc_id", text: str = "text", most: int = MOST_LABELLED, most_terms: int = MOST_TERMS) -> Machine:
    """From the labelled documents that are not held out: at most ``most``, and in the order
    of their hashed ids only as far as they have ``most_terms`` terms together (four bytes
    each), so one task can learn from them. Without any, every text gets the same score; so it
    is where the first row alone has more terms than ``most_terms``."""
    schema = pa.schema([("place", pa.int64()), ("label", pa.int32()), ("terms", pa.binary())])

    def run(source):
        terms = Terms()
        for places, texts, marks in batches(source, ["place", "text", "label"], 500):
            yield record(schema, places, marks, [terms.of(t).tobytes() for t in texts])

    may_learn = bucket(F.col("id"), held_out[0]) != held_out[1]
    rows = labelled(docs, labels, label, may_learn, key, text, most).select(F.xxhash64("id", F.lit(11)).alias("place"), "text", "label")
    sample = written(rows.mapInArrow(run, "place long, label int, terms binary"))
    sizes = sorted((r["place"], r["n"]) for r in sample.select("place", F.octet_length("terms").alias("n")).collect())
    upto = int(np.searchsorted(np.cumsum([n for _, n in sizes]), 4 * most_terms, "right"))
    if not upto:
        return fit([], np.zeros(0, np.int64))

    def learn(source):
        found = sorted((t, mark) for marks, terms in batches(source, ["label", "terms"], 500) for mark, t in zip(marks, terms, strict=True))
        machine = fit([np.frombuffer(t, np.int32) for t, _ in found], np.array([y == 1 for _, y in found], np.int64))
        yield pa.RecordBatch.from_pydict({"machine": pa.array([pickle.dumps(machine)], pa.binary())})

    within = sample.where(F.col("place") <= sizes[upto - 1][0])  # bounded by ``most_terms``
    return pickle.loads(within.coalesce(1).mapInArrow(learn, "machine binary").first()[0])


def toxicity_scores(docs: DataFrame, machine: Machine, held_out: tuple[int, int] = (5, 0), key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for each row. A text without known terms, as
    an empty or null one, gets the bias's score, equal texts equal scores; repeated ids and
    rows stay, a null id is not held out, an empty table gives an empty result. A text is
    read whole, however long. Other columns don't matter."""
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])
    shipped = docs.sparkSession.sparkContext.broadcast(machine)

    def run(source):
        terms = Terms(shipped.value.column)
        for ids, texts in batches(source, ["doc_id", "text"]):
            yield record(schema, ids, shipped.value.score(map(terms.of, texts), len(texts)))

    scored = docs.select(docs[key].cast("long").alias("doc_id"), docs[text].alias("text")).mapInArrow(run, "doc_id long, score double")
    out = F.coalesce(bucket(F.col("doc_id"), held_out[0]) == held_out[1], F.lit(False))
    return scored.select("doc_id", out.alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, machine: Machine, text: str = "text") -> DataFrame:
    """The rows of ``docs`` below the cut, all columns as they were and whatever their
    names. Each row is judged by its text alone; cases as for ``toxicity_scores``."""
    shipped = docs.sparkSession.sparkContext.broadcast(machine)

    def decide():
        terms = Terms(shipped.value.column)
        return lambda texts: shipped.value.score(map(terms.of, texts), len(texts)) < CUT

    return rows_where(docs, docs[text], decide)
