"""Centroid clustering in whole numbers, with float32 products as a screen.

Components become whole numbers, so distances, sums and floors are exact and a run gives the
same clusters on any cluster. Most of the work is a float32 matrix product. Its rounding
error is bounded by ``g * |x| * |c|`` with ``g = n u / (1 - n u)``, u = 2^-24 and n the
number of roundings that a term can meet, in whatever order the terms are added (Higham,
"Accuracy and Stability of Numerical Algorithms", 3.1). That makes an interval for every
distance. Centroids whose interval lies above another's upper end are out; where more than
one is left, their distances are computed again in 64-bit integers and the lowest number
wins a tie.

A round is one pass: a task adds up the vectors of each centroid, Spark adds up the tasks,
and the driver gets a row a centroid.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._words import record


@dataclass(frozen=True)
class Clustering:
    """``k`` centroids of ``dimension`` components ``floor(scale * x)``, moved ``rounds``
    times; the first are the rows with the smallest SHA-256 of ``salt`` and their id."""

    k: int = 40
    rounds: int = 5
    dimension: int = 64
    scale: float = 256.0
    salt: str = "2:"


#: Components beyond this don't fit: a squared distance must stay below 2^63.
def largest(dimension: int) -> int:
    return 1 << ((61 - (dimension - 1).bit_length()) // 2)


#: Vectors that are compared at a time.
STEP = 8192


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The number of the nearest centroid of each vector, the lowest of equals; exact."""
    d = x.shape[1]
    roundings = d + 4  # the conversions, the products and the sums of a term, and one to spare
    g = roundings * 2.0**-24 / (1 - roundings * 2.0**-24)
    c2, x2 = (c * c).sum(axis=1), (x * x).sum(axis=1)
    # |x|^2 is the same for all centroids of a vector, so it is left out of the distances.
    rough = c2 - 2.0 * (x.astype(np.float32) @ c.astype(np.float32).T)
    error = 2.0 * g * np.sqrt(x2.astype(np.float64))[:, None] * np.sqrt(c2.astype(np.float64))
    error = error * (1 + 2.0**-40) + (c2 + np.abs(rough)) * 2.0**-50
    open_ = rough - error <= (rough + error).min(axis=1, keepdims=True)
    out = rough.argmin(axis=1)
    several = np.flatnonzero(open_.sum(axis=1) > 1)
    if len(several):
        row, k = np.nonzero(open_[several])
        distance = np.empty(len(row), np.int64)
        for at in range(0, len(row), STEP):
            gap = x[several[row[at : at + STEP]]] - c[k[at : at + STEP]]
            distance[at : at + STEP] = (gap * gap).sum(axis=1)
        order = np.lexsort((k, distance, row))
        first = order[np.flatnonzero(np.diff(row[order], prepend=-1))]
        out[several] = k[first]
    return out


def distances(x: np.ndarray, c: np.ndarray, mine: np.ndarray) -> np.ndarray:
    gap = x - c[mine]
    return (gap * gap).sum(axis=1)


def whole(vectors: pa.Array, p: Clustering) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(kept, fits, components)``: which rows have the right length and finite components,
    which of those have components that fit, and the whole numbers of the latter."""
    n = pc.fill_null(pc.list_value_length(vectors), -1).to_numpy(zero_copy_only=False)
    kept = n == p.dimension
    flat = vectors.filter(pa.array(kept)).flatten()
    if flat.type != pa.float64():
        flat = flat.cast(pa.float64())
    x = flat.to_numpy(zero_copy_only=False).reshape(-1, p.dimension)  # a null becomes a NaN
    finite = np.isfinite(x).all(axis=1)
    kept[np.flatnonzero(kept)[~finite]] = False
    with np.errstate(over="ignore"):
        x = np.floor(p.scale * x[finite])
    fits = (np.abs(x) <= largest(p.dimension)).all(axis=1)
    return kept, fits, x[fits].astype(np.int64)


def _read(source, p: Clustering) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Rows that take part, in steps: their batch, whether they fit, their components."""
    for batch in source:
        for at in range(0, batch.num_rows, STEP):
            part = batch.slice(at, STEP)
            kept, fits, x = whole(part.column(part.schema.get_field_index("v")), p)
            yield part.filter(pa.array(kept)), fits, x


def _sums(shipped, p: Clustering):
    """For each centroid the number, the sum and the distances of a task's vectors."""
    schema = pa.schema([("k", pa.int32()), ("n", pa.int64()), ("s", pa.list_(pa.int64())), ("high", pa.int64()), ("low", pa.int64())])

    def run(source):
        c = shipped.value
        n, s = np.zeros(len(c), np.int64), np.zeros(c.shape, np.int64)
        high, low = np.zeros(len(c), np.int64), np.zeros(len(c), np.int64)  # of the distances: they may pass 64 bits
        for _, _, x in _read(source, p):
            mine = nearest(x, c)
            far = distances(x, c, mine)
            order = np.argsort(mine, kind="stable")
            first = np.flatnonzero(np.diff(mine[order], prepend=-1))
            n += np.bincount(mine, minlength=len(c))
            if len(first):
                s[mine[order[first]]] += np.add.reduceat(x[order], first, axis=0)
            np.add.at(high, mine, far >> 32)
            np.add.at(low, mine, far & 0xFFFFFFFF)
        some = np.flatnonzero(n)
        if len(some):
            yield record(schema, some.tolist(), n[some].tolist(), s[some].tolist(), high[some].tolist(), low[some].tolist())

    return run


def _gathered(rows: DataFrame, c: np.ndarray, p: Clustering) -> dict[int, tuple[int, list[int], int]]:
    """``{number: (vectors, sums, inertia)}`` of the centroids that have any."""
    shipped = rows.sparkSession.sparkContext.broadcast(c)
    parts = rows.select("v").mapInArrow(_sums(shipped, p), "k int, n long, s array<long>, high long, low long")
    big = lambda x: F.sum(x.cast("decimal(19,0)"))
    total = parts.groupBy("k").agg(F.sum("n").alias("n"), big(F.col("high")).alias("high"), big(F.col("low")).alias("low"), *(big(F.col("s")[i]).alias(f"s{i}") for i in range(p.dimension)))
    return {r["k"]: (r["n"], [int(r[f"s{i}"]) for i in range(p.dimension)], (int(r["high"]) << 32) + int(r["low"])) for r in total.collect()}


def _first(rows: DataFrame, p: Clustering) -> np.ndarray:
    """The first centroids: at most k rows come to the driver."""
    schema = pa.schema([("id", pa.int64()), ("x", pa.list_(pa.int64()))])

    def run(source):
        for batch, fits, x in _read(source, p):
            yield record(schema, batch.filter(pa.array(fits)).column(batch.schema.get_field_index("id")), x.tolist())

    digest = F.sha2(F.concat(F.lit(p.salt), F.col("id").cast("string")), 256)
    found = rows.where("id is not null").mapInArrow(run, "id long, x array<long>").orderBy(digest, "x").limit(p.k).collect()
    return np.array([r["x"] for r in found], np.int64).reshape(-1, p.dimension)


def fit(rows: DataFrame, p: Clustering) -> np.ndarray:
    """The centroids after all rounds; one without vectors stays where it is."""
    c = _first(rows, p)
    for _ in range(p.rounds if len(c) else 0):
        for k, (n, sums, _) in _gathered(rows, c, p).items():
            c[k] = [s // n for s in sums]
    return c


def _assigned(shipped, p: Clustering):
    schema = pa.schema([("vec_id", pa.int64()), ("cluster", pa.int32()), ("distance", pa.int64())])

    def run(source):
        c = shipped.value
        for batch, fits, x in _read(source, p):
            mine, far = np.full(len(fits), -1, np.int64), np.zeros(len(fits), np.int64)
            if len(c):
                mine[fits] = nearest(x, c)
                far[fits] = distances(x, c, mine[fits])
            none = mine < 0
            yield record(schema, batch.column(batch.schema.get_field_index("id")), pa.array(mine, pa.int32(), mask=none), pa.array(far, pa.int64(), mask=none))

    return run


def clusters(vectors: DataFrame, p: Clustering = Clustering(), key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256)`` of each
    vector of ``dimension`` finite components; null vectors, those of other lengths and those
    with null or non-finite components take no part.

    Repeated rows and ids are vectors of their own; rows with a null id belong to a cluster
    but never begin one. Fewer vectors than centroids make fewer centroids, an empty table an
    empty result. A vector with a component beyond ``largest(dimension)``, whose distance no
    long could hold, stays without a cluster and moves none; so does every vector where none
    can begin a cluster. An inertia beyond a long is null. Other columns don't matter.
    """
    rows = vectors.select(vectors[key].cast("long").alias("id"), vectors[vector].alias("v"))
    c = fit(rows, p)
    inertia = {k: far for k, (_, _, far) in _gathered(rows, c, p).items()} if len(c) else {}
    fit_long = lambda n: n if n < 1 << 63 else None
    about = [(k, fit_long(inertia.get(k, 0)), fit_long(sum(inertia.values())), hashlib.sha256(",".join(map(str, x)).encode()).hexdigest()) for k, x in enumerate(c.tolist())]
    named = rows.sparkSession.createDataFrame(about, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    found = rows.mapInArrow(_assigned(rows.sparkSession.sparkContext.broadcast(c), p), "vec_id long, cluster int, distance long")
    return found.join(F.broadcast(named), "cluster", "left").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # k rows
