"""Quality by Bradley-Terry ranking.

Preference pairs (a document labelled good before one labelled bad) train a linear score
by logistic loss on the difference of their features. The score's quantile that parts the
labels best becomes the threshold; it maps to a score of 0.7.

Features describe a whole text: how often each pair of character classes follows, word
length, repeated and distinct words, length. Labels are learned from a bounded sample
(``MOST_LABELLED`` rows); nothing else is sampled.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._labels import MOST_LABELLED, bucket, labelled
from ._words import batches, record, rows_where

CUT = 0.7
_CLASSES = 14


def _class_table() -> np.ndarray:
    table = np.full(256, 10, np.uint8)
    for of, members in enumerate((range(97, 123), range(65, 91), range(48, 58), b" \t", b"\n\r\x0b\x0c", b".", b",", b"!", b"?", b"|")):
        table[list(members)] = of
    table[list(b"\"'()[]{}:;-")] = 11
    table[128:] = 12
    table[[*range(9), *range(14, 32), 127]] = 13
    return table


_CLASS = _class_table()
N_FEATURES = _CLASSES * _CLASSES + 7


def features(text: str | None) -> np.ndarray:
    """The features of one text; all zero for a null or empty one."""
    out = np.zeros(N_FEATURES, np.float32)
    data = (text or "").encode("utf-8", "surrogatepass")
    if not data:
        return out
    kinds = _CLASS[np.frombuffer(data, np.uint8)].astype(np.intp)
    pairs = np.bincount(kinds[:-1] * _CLASSES + kinds[1:], minlength=_CLASSES * _CLASSES)
    out[: _CLASSES * _CLASSES] = np.sqrt(pairs / len(data))
    tokens = data.lower().split()
    n = len(tokens)
    if n:
        lines = data.count(b"\n") + 1
        out[-7:] = (math.log1p(n), len(set(tokens)) / n, sum(map(eq, tokens, tokens[1:])) / n, len(data) / n / 10, math.log1p(n / lines), data.count(b" | ") / n, len(set(tokens)) / math.sqrt(n) / 10)
    return out


@dataclass(frozen=True)
class Ranking:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -6, 6).astype(np.float64) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        z = self.raw(x) - self.threshold + math.log(CUT / (1 - CUT))
        return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def fit(x: np.ndarray, y: np.ndarray, steps: int = 500, pairs: int = 4096, rate: float = 0.02, decay: float = 1e-3, seed: int = 5) -> Ranking:
    """Learns from features and labels. With one label only, all scores are equal: they
    reach the cut if that label is 1 or there is none."""
    mean = x.mean(axis=0) if len(x) else np.zeros(N_FEATURES)
    scale = np.maximum(x.std(axis=0), 1e-3) if len(x) else np.ones(N_FEATURES)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y != 1)
    weights = np.zeros(N_FEATURES)
    if not len(good) or not len(bad):
        return Ranking(mean, scale, weights, 0.0 if len(good) or not len(bad) else 1.0)
    z = np.clip((x - mean) / scale, -6, 6).astype(np.float32)
    rng, m, v = np.random.default_rng(seed), np.zeros(N_FEATURES), np.zeros(N_FEATURES)
    for t in range(1, steps + 1):
        gap = z[rng.choice(good, pairs)] - z[rng.choice(bad, pairs)]
        wrong = 1 / (1 + np.exp(np.clip(gap @ weights, -60, 60)))
        grad = -(wrong @ gap) / pairs + decay * weights
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        weights -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    raw = z.astype(np.float64) @ weights
    cuts = np.quantile(raw, np.arange(0.005, 1, 0.005))
    accuracy = [(raw[good] >= c).mean() + (raw[bad] < c).mean() for c in cuts]
    best = np.flatnonzero(np.isclose(accuracy, max(accuracy)))
    at = cuts[best[len(best) // 2]]
    below = raw[raw < at]
    return Ranking(mean, scale, weights, float((at + below.max()) / 2 if len(below) else at))


def _collect_features(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    schema = pa.schema([("label", pa.int32()), ("x", pa.binary())])

    def run(source):
        for texts, marks in batches(source, ["text", "label"]):
            yield record(schema, marks, [features(t).tobytes() for t in texts])

    found = sorted((bytes(r["x"]), r["label"]) for r in rows.select("text", "label").mapInArrow(run, "label int, x binary").collect())
    x = np.frombuffer(b"".join(b for b, _ in found), np.float32).reshape(-1, N_FEATURES)
    return x, np.array([y for _, y in found], np.int64)


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", held_out: tuple[int, int] = (4, 2), key: str = "doc_id", text: str = "text", most: int = MOST_LABELLED) -> Ranking:
    """From the labelled documents that are not held out, at most ``most`` (each a feature
    vector of fixed size on the driver). Without any, every text reaches the cut."""
    may_learn = bucket(F.col("id"), held_out[0]) != held_out[1]
    return fit(*_collect_features(labelled(docs, labels, label, may_learn, key, text, most)))


def quality_scores(docs: DataFrame, ranking: Ranking, held_out: tuple[int, int] = (4, 2), key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for each row. Null and empty texts get the
    score of a text without features, equal texts equal scores; repeated ids and rows stay,
    a null id is not held out, an empty table gives an empty result. A text is read whole,
    however long. Other columns don't matter."""
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])
    shipped = docs.sparkSession.sparkContext.broadcast(ranking)

    def run(source):
        for ids, texts in batches(source, ["doc_id", "text"]):
            yield record(schema, ids, shipped.value.score(np.stack([features(t) for t in texts])))

    scored = docs.select(docs[key].cast("long").alias("doc_id"), docs[text].alias("text")).mapInArrow(run, "doc_id long, score double")
    out = F.coalesce(bucket(F.col("doc_id"), held_out[0]) == held_out[1], F.lit(False))
    return scored.select("doc_id", out.alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, ranking: Ranking, text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose score reaches the cut, all columns as they were and
    whatever their names. Each row is judged by its text alone; cases as for
    ``quality_scores``."""
    shipped = docs.sparkSession.sparkContext.broadcast(ranking)
    return rows_where(docs, docs[text], lambda: lambda texts: shipped.value.score(np.stack([features(t) for t in texts])) >= CUT)
