"""Nearest neighbours by inner product over randomly rotated one-bit codes.

A vector, less its block's mean, is padded, rotated at random and kept as the signs of its
components: packed bits, its length and the inner product of the rotated unit vector with
its code (the correction). A query is rotated and rounded to four bits a component, so
an estimate is a few bit counts. The estimate's error is at most
``epsilon * sqrt((1 - f^2) / f^2 / (d - 1))`` with high probability, f being the
correction. Only vectors whose upper bound reaches the k-th best lower bound are compared
exactly. Following Gao and Long, "RaBitQ" (2024).

In a dimension of ``indexed_from`` vectors or more every vector belongs to the list of its
nearest centre; below that lists cost more than they save and all vectors are looked at.
Centres are fitted on a bounded
sample of the vectors (``sample`` rows, ``sample_bytes``); about the square root of the row
count, they keep the work below the product of queries and vectors. A query asks the lists
whose centres have the largest inner product with it, as many as it takes for the sample's own
neighbours to be found with a share of ``recall``. Lists and their queries meet in blocks of
bounded size. In a block, equal vectors are one candidate with its smallest ids.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class OneBit:
    k: int = 20
    epsilon: float = 1.9
    widen: int = 2
    vector_block: int = 16_384
    query_block: int = 4_096
    sample: int = 16_384
    sample_bytes: int = 32 << 20
    most_lists: int = 4_096
    recall: float = 0.99
    indexed_from: int = 1 << 17
    seed: int = 7


@lru_cache(maxsize=4)
def rotation(d: int, width: int, seed: int) -> np.ndarray:
    """The first d rows of a random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((width, width)))
    return (q * np.sign(np.diag(r)))[:d].astype(np.float32)


class Codes:
    """Packed codes and correction scalars of some vectors."""

    def __init__(self, vectors: np.ndarray, p: OneBit):
        n, d = vectors.shape
        self.p, self.d, self.width = p, d, -(-d * p.widen // 64) * 64
        self.centre = vectors.mean(axis=0)
        rest = vectors - self.centre
        self.length = np.linalg.norm(rest, axis=1)
        unit = rest / np.where(self.length > 0, self.length, 1)[:, None]
        turned = unit.astype(np.float32) @ rotation(d, self.width, p.seed)
        signs = turned > 0
        self.bits = np.packbits(signs, axis=1).view(np.uint64)
        self.ones = signs.sum(axis=1).astype(np.float32)
        root = np.sqrt(self.width)
        self.f = np.maximum(np.abs(turned).sum(axis=1) / root, 1e-6).astype(np.float64)
        self.slack = p.epsilon * np.sqrt(np.maximum(1 - self.f**2, 0) / self.f**2 / max(self.width - 1, 1)) * self.length

    def bounds(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Estimated inner products of each query with all vectors, and their slack."""
        norm = np.linalg.norm(queries, axis=1)[:, None]
        turned = (queries / norm).astype(np.float32) @ rotation(self.d, self.width, self.p.seed)
        low = turned.min(axis=1, keepdims=True)
        step = np.maximum((turned.max(axis=1, keepdims=True) - low) / 15, 1e-12)
        level = np.clip(np.rint((turned - low) / step), 0, 15).astype(np.uint8)
        dot = np.zeros((len(queries), len(self.bits)), np.float32)
        for j in range(4):
            plane = np.packbits((level >> j) & 1, axis=1).view(np.uint64)
            for word in range(plane.shape[1]):
                dot += np.float32(1 << j) * np.bitwise_count(plane[:, word, None] & self.bits[:, word])
        est = (2 * step * dot + 2 * low * self.ones - step * level.sum(axis=1, dtype=np.float32)[:, None] - self.width * low) / np.sqrt(self.width)
        rounding = step / 2 / self.f * self.length * norm
        return est / self.f * self.length * norm + (queries @ self.centre)[:, None], self.slack * norm + rounding


#: Estimates that are held at a time.
AT_A_TIME = 1 << 20


def _candidates(codes: Codes, queries: np.ndarray, want: int) -> list[np.ndarray]:
    """For each query the vectors whose upper bound reaches the ``want``-th best lower one."""
    est, slack = codes.bounds(queries)
    n = est.shape[1]
    if n <= want:
        return [np.arange(n)] * len(queries)
    least = np.partition(est - slack, n - want, axis=1)[:, n - want, None]
    return [np.flatnonzero(r) for r in est + slack >= least]


def search(ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, p: OneBit) -> list[tuple[int, int, float]]:
    """``(query id, vector id, score)``: the k nearest ids of a block, without the query's
    own. Rows with equal id and vector are one candidate; an id with several vectors counts
    with its best score, and enough vectors are looked at for k other ids."""
    raw = np.ascontiguousarray(vectors).view(np.dtype((np.void, vectors.dtype.itemsize * vectors.shape[1]))).ravel()
    kind = np.unique(raw, return_inverse=True)[1]
    order = np.lexsort((ids, kind))
    order = order[np.concatenate([[True], (ids[order[1:]] != ids[order[:-1]]) | (kind[order[1:]] != kind[order[:-1]])])]
    ids, vectors, kind = ids[order], vectors[order], kind[order]
    several = int(np.unique(ids, return_counts=True)[1].max())
    want = (p.k + 1) * several
    first = np.flatnonzero(np.concatenate([[True], kind[1:] != kind[:-1]]))
    last = np.minimum(np.append(first[1:], len(ids)), first + want)
    distinct = vectors[first]
    codes, out = Codes(distinct, p), []
    step = max(1, AT_A_TIME // len(distinct))
    candidates = chain.from_iterable(_candidates(codes, queries[at : at + step], want) for at in range(0, len(queries), step))
    for query_id, query, chosen in zip(query_ids.tolist(), queries, candidates, strict=True):
        score = (distinct[chosen] * query).sum(axis=1)  # the same for equal vectors, wherever they stand
        if len(score) > want:
            best_scores = score >= np.partition(score, len(score) - want)[len(score) - want]
            chosen, score = chosen[best_scores], score[best_scores]
        best: dict[int, float] = {}
        for s, i in sorted((-s, i) for c, s in zip(chosen.tolist(), score.tolist(), strict=True) for i in ids[first[c] : last[c]].tolist() if i != query_id):
            if i not in best:
                best[i] = -s
                if len(best) == p.k:
                    break
        out += [(query_id, i, s) for i, s in best.items()]
    return out


@dataclass(frozen=True)
class Lists:
    """Centres, and how many lists a query asks."""

    centres: np.ndarray
    probes: int

    def of(self, vectors: np.ndarray) -> np.ndarray:
        return (vectors @ self.centres.T - (self.centres**2).sum(axis=1) / 2).argmax(axis=1)

    def asked(self, queries: np.ndarray) -> np.ndarray:
        return np.argsort(-(queries @ self.centres.T), axis=1, kind="stable")[:, : self.probes]


def fit_lists(sample: np.ndarray, n: int, p: OneBit, rounds: int = 8, asking: int = 2048) -> Lists:
    """Centres by k-means for ``n`` vectors, and how many lists the sample's own queries need.
    The sample is sparser than the table, so its neighbours lie farther off than the real
    ones and the number errs on the safe side."""
    rng = np.random.default_rng(p.seed)
    centres = sample[rng.permutation(len(sample))[: max(1, min(p.most_lists, round(n**0.5 / 2), len(sample) // 8))]]
    for _ in range(rounds):
        mine = Lists(centres, 1).of(sample)
        sums, counts = np.zeros_like(centres), np.bincount(mine, minlength=len(centres))
        np.add.at(sums, mine, sample)
        centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
    counts = np.bincount(Lists(centres, 1).of(sample), minlength=len(centres))
    centres, counts = centres[counts > 0], counts[counts > 0]
    lists = Lists(centres, len(centres))
    k = min(p.k, len(sample) - 1)
    if len(centres) == 1 or k < 1:
        return lists
    mine, needed = lists.of(sample), []
    for at in range(0, min(asking, len(sample)), 256):
        queries = sample[at : min(at + 256, asking)]
        product = queries @ sample.T
        product[np.arange(len(queries)), at + np.arange(len(queries))] = -np.inf
        near = np.argpartition(-product, k - 1, axis=1)[:, :k]
        place = np.argsort(lists.asked(queries), axis=1)  # of each list in a query's order
        needed.append(np.take_along_axis(place, mine[near], axis=1).ravel())
    needed = np.sort(np.concatenate(needed))
    enough = int(np.searchsorted(np.cumsum(np.sort(counts)), p.k + 1)) + 1  # lists that surely hold k others
    return Lists(centres, min(len(centres), max(enough, int(needed[int(np.ceil(p.recall * len(needed))) - 1]) + 2)))


def _block(p: OneBit):
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def run(table: pa.Table) -> pa.Table:
        flag = np.array(table.column("query").to_pylist(), bool)
        ids = table.column("id").to_numpy()
        d = table.column("d")[0].as_py()
        v = table.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, d).astype(np.float64)
        found = search(ids[~flag], v[~flag], ids[flag], v[flag], p) if flag.any() and (~flag).any() else []
        columns = list(zip(*found, strict=True)) or [[], [], []]
        return pa.table([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return run


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """Vectors that take part: not null, not zero, all components finite numbers."""
    v = F.col(vector).cast("array<double>")
    ok = F.forall("v", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))) & F.exists("v", lambda x: x != 0)
    return vectors.select(F.col(key).cast("long").alias("id"), v.alias("v")).where("id is not null and v is not null").where(F.coalesce(ok, F.lit(False))).withColumn("d", F.size("v"))


#: Only the dimensions with the most rows get lists; the others are searched whole.
MOST_INDEXED = 16


def _with_lists(rows: DataFrame, lists: dict[int, Lists], asks: bool) -> DataFrame:
    """``rows`` with ``list``: of the vector itself, or an array of those that a query asks."""
    shipped = rows.sparkSession.sparkContext.broadcast(lists)

    @F.arrow_udf("array<int>" if asks else "int")
    def place(v: pa.Array, d: pa.Array) -> pa.Array:
        sizes, out = d.to_numpy(), [[0] if asks else 0] * len(d)
        for dimension in np.unique(sizes):
            if (index := shipped.value.get(int(dimension))) is not None:
                at = np.flatnonzero(sizes == dimension)
                mine = v.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(len(at), dimension)
                for i, found in zip(at.tolist(), (index.asked if asks else index.of)(mine).tolist(), strict=True):
                    out[i] = found
        return pa.array(out, pa.list_(pa.int32()) if asks else pa.int32())

    return rows.withColumn("list", place("v", "d"))


def _fitted(rows: DataFrame, p: OneBit) -> dict[int, Lists]:
    """Lists for the dimensions with the most rows, each from a sample of distinct ids."""
    lists = {}
    for r in rows.groupBy("d").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= p.indexed_from).orderBy(F.desc("n"), "d").limit(MOST_INDEXED).collect():
        most = max(1, min(p.sample, p.sample_bytes // (8 * r["d"])))
        cut = int(min(1.0, most / r["n"]) * (1 << 30))
        mine = rows.where((F.col("d") == r["d"]) & (F.pmod(F.xxhash64("id", F.lit(p.seed)), F.lit(1 << 30)) < cut))
        sample = sorted((x["id"], x["v"]) for x in mine.groupBy("id").agg(F.min("v").alias("v")).limit(2 * most).collect())
        if len(sample) > 8:
            lists[r["d"]] = fit_lists(np.array([v for _, v in sample], np.float64), r["n"], p)
    return lists


def nearest(vectors: DataFrame, is_query, key: str = "vec_id", vector: str = "embedding", p: OneBit = OneBit()) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for each row that ``is_query`` (a condition on
    ``id``) its k nearest rows of the same dimension, itself left out; ties go to the
    smaller id. Scores are exact inner products in double precision. Unusable vectors (null,
    zero, with null or non-finite components) and null ids take no part. Rows that share an
    id are one candidate and one query: the best of its distinct vectors counts. An empty
    table gives an empty result. Other columns don't matter."""
    rows = usable(vectors, key, vector)
    lists = _fitted(rows, p)
    base = _with_lists(rows, lists, False)
    asked = _with_lists(rows.where(is_query), lists, True).select("d", "id", "v", F.explode("list").alias("list"))
    held = base.groupBy("d", "list").agg(F.count(F.lit(1)).alias("n"))
    wanted = asked.groupBy("d", "list").agg(F.count(F.lit(1)).alias("q"))
    pieces = lambda n, most: F.ceil(F.col(n) / most).cast("int")
    # A row for each list: at most ``most_lists`` for an indexed dimension, one for another.
    sizes = F.broadcast(held.join(wanted, ["d", "list"]).select("d", "list", pieces("n", p.vector_block).alias("vb"), pieces("q", p.query_block).alias("qb")))
    mine = F.xxhash64("id")
    held = base.join(sizes, ["d", "list"]).select("d", "list", "id", "v", F.lit(False).alias("query"), F.pmod(mine, F.col("vb")).alias("i"), F.explode(F.expr("sequence(0, qb - 1)")).alias("j"))
    wanted = asked.join(sizes, ["d", "list"]).select("d", "list", "id", "v", F.lit(True).alias("query"), F.explode(F.expr("sequence(0, vb - 1)")).alias("i"), F.pmod(mine, F.col("qb")).alias("j"))
    found = held.unionByName(wanted).groupBy("d", "list", "i", "j").applyInArrow(_block(p), "query_id long, vec_id long, score double")
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= p.k).select("query_id", "rank", "vec_id", "score")
