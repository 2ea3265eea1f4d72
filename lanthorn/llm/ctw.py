"""Language-model scores by context-tree weighting over bytes.

A text is its words (lower-cased A-Z) with one space between and a line feed as its end.
Each byte is eight binary choices; each choice has a context tree whose contexts are the
``depth`` bytes before. A node's Krichevsky-Trofimov estimate is mixed half and half with
the product over its children, so all depths take part, weighted by how well they
predicted the training texts. Learning is counting, which partial counts make cheap.

Run over blocks of documents:

1. Documents are packed into blocks of bounded size, written once. A block also lists its
   distinct words and its distinct (context, byte) strings with their training counts,
   dealt into buckets whose number follows the input. Strings whose last ``split`` context
   bytes agree share a bucket, so each bucket holds whole subtrees.
2. Buckets add up the counts, first over groups of ``blocks_a_group`` blocks, then over the
   groups, so no task holds more than these or the distinct strings of a bucket. Subtrees
   are weighted from the leaves up to depth ``split``; the nodes above are joined as tables;
   then the mixture's weights go down to the leaves, which gives the log probability of
   every string.
3. The values return to their blocks, a group at a time: each group gets those of its own
   words and strings, not the model. Blocks add them up for each document.

No model is broadcast or collected. What moves follows the distinct strings of the blocks,
so it grows with the input. Words are told apart by 64-bit hashes.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ._labels import bucket as crc_bucket
from ._store import written
from ._words import WordHashes, batches, mix, record, words

HALF = math.log(0.5)
U = np.uint64


@dataclass(frozen=True)
class Tree:
    """``depth`` context bytes, 2 to 7; a bucket holds the subtrees below ``split`` of them.
    There are ``buckets`` at least, and one for each ``bucket_bytes`` of text."""

    depth: int = 5
    split: int = 3
    block_bytes: int = 8 << 20
    blocks_a_group: int = 256
    bucket_bytes: int = 32 << 20
    buckets: int = 64
    most_buckets: int = 4096

    def __post_init__(self):
        if not 2 <= self.depth <= 7:
            raise ValueError("a string of depth + 1 bytes is one number: the depth is 2 to 7")
        object.__setattr__(self, "split", max(1, min(self.split, self.depth - 1)))


def _log_gamma_half(n: np.ndarray) -> np.ndarray:
    """ln Gamma(n + 1/2) for counts n >= 0."""
    return _log_gamma(n + 0.5)


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series, after the argument is raised to at least 8."""
    x = np.asarray(x, np.float64)
    shift = np.zeros_like(x)
    y = x.copy()
    for _ in range(8):
        low = y < 8
        shift[low] += np.log(y[low])
        y[low] += 1
    z = 1 / (y * y)
    series = (1 / 12 - z * (1 / 360 - z * (1 / 1260 - z * (1 / 1680 - z / 1188)))) / y
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + series - shift


def kt_log(n0, n1) -> np.ndarray:
    """Log of the Krichevsky-Trofimov probability of n0 zeros and n1 ones."""
    n0, n1 = np.asarray(n0, np.float64), np.asarray(n1, np.float64)
    return _log_gamma_half(n0) + _log_gamma_half(n1) - math.log(math.pi) - _log_gamma(n0 + n1 + 1)


def mixed(own, below) -> np.ndarray:
    """Log of the node's weighted probability."""
    return np.logaddexp(HALF + own, HALF + below)


# Strings of depth + 1 bytes, as numbers; the low byte is the one to predict.


def canonical(text: str | None) -> bytes:
    """The words with one space between."""
    return b" ".join(words(text))


def strings(texts: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Every byte's context and the byte, in one number; and where each text starts.
    Zero bytes stand before a text."""
    pad = b"\0" * depth
    flat = np.frombuffer(pad + pad.join(texts), np.uint8)
    lengths = np.array([len(t) for t in texts], np.int64)
    out = np.zeros(len(flat) - depth, U)
    for k in range(depth + 1):
        out = (out << U(8)) | flat[k : len(flat) - depth + k]
    starts = np.concatenate([[0], np.cumsum(lengths + depth)[:-1]])
    keep = np.ones(len(out), bool)
    for s, n in zip(starts[1:] - depth, [depth] * (len(starts) - 1), strict=True):
        keep[s : s + n] = False
    return out[keep], np.concatenate([[0], np.cumsum(lengths)])


def distinct_of(g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct numbers and their counts; sorting is what numpy does fastest."""
    g = np.sort(g)
    first = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]])) if len(g) else np.empty(0, np.int64)
    return g[first], np.diff(np.append(first, len(g)))


def string_bucket(g: np.ndarray, p: Tree) -> np.ndarray:
    """By the last bytes of the context."""
    last = (g >> U(8)) & U((1 << (8 * p.split)) - 1)
    return (mix(last + U(1)) % U(p.buckets)).astype(np.int64)


def in_buckets(keys: np.ndarray, where: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The order by bucket, then key (keys come sorted), and each bucket's bounds."""
    order = np.argsort(where, kind="stable")
    return order, np.searchsorted(where[order], np.arange(buckets + 1))


class Block:
    """Documents ``(id, learn, canonical text)`` of a block with their distinct words and
    strings, and their training counts if ``counted``. Words are split off a document at a
    time."""

    def __init__(self, docs: list[tuple[int | None, bool, bytes]], p: Tree, counted: bool = True):
        self.p = p
        trained: Counter = Counter()
        distinct: set[bytes] = set()
        for _, learn, body in docs:
            trained.update(body.split()) if learn and counted else distinct.update(body.split())
        self.words = list(distinct.union(trained))
        h = WordHashes().of(self.words)
        order = np.argsort(h, kind="stable")
        self.word_keys = h[order]
        if counted:
            self.word_counts = np.fromiter((trained.get(self.words[i], 0) for i in order), np.int64, len(order))
        self.words = [self.words[i] for i in order]
        del trained, distinct
        if not counted:
            some = [distinct_of(strings(texts, p.depth)[0])[0] for texts, _ in self._chunks(docs)]
            self.string_keys = distinct_of(np.concatenate(some))[0] if some else np.empty(0, U)
            return
        keys, sums = [], []
        for texts, learn in self._chunks(docs):
            g, n = distinct_of(strings(texts, p.depth)[0])
            keys.append(g)
            sums.append(n * learn)
        flat = np.concatenate(keys) if keys else np.empty(0, U)
        self.string_keys, inverse = np.unique(flat, return_inverse=True)
        self.string_counts = np.bincount(inverse, np.concatenate(sums) if sums else None, minlength=len(self.string_keys)).astype(np.int64)

    @staticmethod
    def _chunks(docs, size: int = 3 << 20):
        for learn in (True, False):
            texts, total = [], 0
            for _, l, body in docs:
                if l is learn:
                    texts.append(body + b"\n")
                    total += len(body)
                    if total >= size:
                        yield texts, int(learn)
                        texts, total = [], 0
            if texts:
                yield texts, int(learn)

    def parts(self):
        """``(kind, bucket, keys, counts)`` of the buckets that have any."""
        b = self.p.buckets
        for kind, keys, counts, where in (
            ("word", self.word_keys, self.word_counts, (self.word_keys % U(b)).astype(np.int64)),
            ("string", self.string_keys, self.string_counts, string_bucket(self.string_keys, self.p)),
        ):
            order, bounds = in_buckets(keys, where, b)
            for k in range(b):
                at = order[bounds[k] : bounds[k + 1]]
                if len(at):
                    yield kind, k, keys[at], counts[at]


_PART = pa.struct([("bucket", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())])
_BLOCK = pa.schema([("block", pa.int64()), ("doc", pa.binary()), ("n_train", pa.int64()), ("docs_train", pa.int64()), ("word", pa.list_(_PART)), ("string", pa.list_(_PART))])


def _pack(b: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(b)


def _unpack(b: bytes, kind=None):
    raw = zstandard.ZstdDecompressor().decompress(b)
    return raw if kind is None else np.frombuffer(raw, kind)


def _blocks(docs: DataFrame, key: str, text: str, learns, p: Tree) -> DataFrame:
    from pyspark import TaskContext

    def rows(number: int, docs: list):
        block = (TaskContext.get().partitionId() << 24) + number
        ids = np.array([-1 if i is None else i for i, _, _ in docs], np.int64)
        flags = np.array([(learn << 1) | (i is None) for i, learn, _ in docs], np.uint8)
        sizes = np.array([len(t) for _, _, t in docs], np.int64)
        head = np.array([len(docs)], np.int64).tobytes() + ids.tobytes() + sizes.tobytes() + flags.tobytes()
        made = Block(docs, p)
        n_train = int(made.word_counts.sum())
        parts: dict[str, list] = {"word": [], "string": []}
        for kind, k, keys, counts in made.parts():
            parts[kind].append({"bucket": k, "keys": _pack(keys.tobytes()), "counts": _pack(counts.tobytes())})
        doc = _pack(head + b"".join(t for _, _, t in docs))
        return record(_BLOCK, [block], [doc], [n_train], [int((flags >> 1).sum())], [parts["word"]], [parts["string"]])

    def run(source):
        held, size, number = [], 0, 0
        for ids, texts, learn in batches(source, ["id", "text", "learn"], 500):
            for i, t, l in zip(ids, texts, learn, strict=True):
                said = canonical(t)
                if held and size + len(said) + 64 > p.block_bytes:
                    yield rows(number, held)
                    held, size, number = [], 0, number + 1
                held.append((i, bool(l), said))
                size += len(said) + 64
        if held:
            yield rows(number, held)

    mine = docs.select(docs[key].cast("long").alias("id"), docs[text].alias("text"))
    mine = mine.withColumn("learn", F.coalesce(learns, F.lit(True)))
    return mine.mapInArrow(run, "block long, doc binary, n_train long, docs_train long, word array<struct<bucket:int,keys:binary,counts:binary>>, string array<struct<bucket:int,keys:binary,counts:binary>>")


def _merged(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys of a bucket's rows and their summed counts."""
    keys = np.concatenate([_unpack(k.as_py(), U) for k in table.column("keys")])
    counts = np.concatenate([_unpack(c.as_py(), np.int64) for c in table.column("counts")])
    every, inverse = np.unique(keys, return_inverse=True)
    return every, np.bincount(inverse, counts, minlength=len(every)).astype(np.int64)


def _sums(table: pa.Table) -> pa.Table:
    """The distinct keys of a bucket in a group of blocks, and their summed counts."""
    every, counts = _merged(table)
    first = table.slice(0, 1)
    return pa.table({"bucket": first.column("bucket"), "group": first.column("group"), "keys": pa.array([_pack(every.tobytes())], pa.binary()), "counts": pa.array([_pack(counts.tobytes())], pa.binary())})


_SUMS = "bucket int, group int, keys binary, counts binary"
_SHARES = "bucket int, group int, keys binary, of binary"


def _shares(table: pa.Table, every: np.ndarray, values: np.ndarray) -> pa.Table:
    """For each group of blocks the values of the bucket's keys that it holds, and no more:
    what goes back to the groups is as large as what came from them, however large the model."""
    of = [_pack(values[np.searchsorted(every, _unpack(k.as_py(), U))].tobytes()) for k in table.column("keys")]
    return pa.table({"bucket": table.column("bucket"), "group": table.column("group"), "keys": table.column("keys"), "of": pa.array(of, pa.binary())})


def _word_shares(table: pa.Table) -> pa.Table:
    """Each group's share of a bucket's word counts. ``distinct``, the number of keys with a
    count, stands in one of the rows."""
    every, counts = _merged(table)
    distinct = [int((counts > 0).sum())] + [0] * (table.num_rows - 1)
    return _shares(table, every, counts).append_column("distinct", pa.array(distinct, pa.int64()))


def _values(kind: type):
    """For each block of a group its keys' values, in its order, from the bucket's."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.table({"block": pa.array([], pa.int64()), "bucket": pa.array([], pa.int32()), "vals": pa.array([], pa.binary())})
        every, of = (_unpack(right.column(c)[0].as_py(), t) for c, t in (("keys", U), ("of", kind)))
        values = [_pack(of[np.searchsorted(every, _unpack(k.as_py(), U))].tobytes()) for k in left.column("keys")]
        return pa.table({"block": left.column("block"), "bucket": left.column("bucket"), "vals": pa.array(values, pa.binary())})

    return run


class Subtrees:
    """Nodes of a bucket's subtrees from ``depth`` down to ``split``. A node is a context of
    d bytes and the bits of the byte so far (1 to 255), in one number."""

    def __init__(self, g: np.ndarray, counts: np.ndarray, p: Tree):
        self.depth, self.split = p.depth, p.split
        depth = p.depth
        byte, context = (g & U(255)).astype(np.int64), g >> U(8)
        self.bits = [(byte >> (7 - k)) & 1 for k in range(8)]
        leaf = np.concatenate([(context << U(8)) | ((byte >> (8 - k)) | (1 << k)).astype(U) for k in range(8)])
        key, self.leaf_of = np.unique(leaf, return_inverse=True)
        bit = np.concatenate(self.bits)
        weight = np.tile(counts, 8)
        n1 = np.bincount(self.leaf_of, weight * bit, minlength=len(key))
        n0 = np.bincount(self.leaf_of, weight * (1 - bit), minlength=len(key))
        own = kt_log(n0, n1)
        self.levels = {depth: (key, n0, n1, own, own)}
        self.parent = {}
        for d in range(depth - 1, p.split - 1, -1):
            key, inverse = np.unique(self._shorter(key, d), return_inverse=True)
            self.parent[d + 1] = inverse
            _, c0, c1, _, total = self.levels[d + 1]
            n0, n1 = (np.bincount(inverse, c, minlength=len(key)) for c in (c0, c1))
            own = kt_log(n0, n1)
            self.levels[d] = (key, n0, n1, own, mixed(own, np.bincount(inverse, total, minlength=len(key))))

    @staticmethod
    def _shorter(key: np.ndarray, d: int) -> np.ndarray:
        return key & U((1 << (8 * d + 8)) - 1)

    def log_probabilities(self, above: np.ndarray, left: np.ndarray) -> np.ndarray:
        """Of each string, given for each node at depth ``split`` the probability of a one
        that shorter contexts add and the weight they leave."""
        for d in range(self.split, self.depth):
            _, n0, n1, own, total = self.levels[d]
            stop = np.exp(HALF + own - total)
            above, left = above + left * stop * (n1 + 0.5) / (n0 + n1 + 1), left * (1 - stop)
            above, left = above[self.parent[d + 1]], left[self.parent[d + 1]]
        _, n0, n1, _, _ = self.levels[self.depth]
        one = above + left * (n1 + 0.5) / (n0 + n1 + 1)
        one = one[self.leaf_of].reshape(8, -1)
        return sum(np.log(np.where(b, one[k], 1 - one[k])) for k, b in enumerate(self.bits))


def _upper_nodes(p: Tree):
    def run(table: pa.Table) -> pa.Table:
        key, n0, n1, _, total = Subtrees(*_merged(table), p).levels[p.split]
        return pa.table({"bucket": pa.array([table.column("bucket")[0].as_py()] * len(key), pa.int32()), "node": pa.array(key.astype(np.int64)), "n0": pa.array(n0), "n1": pa.array(n1), "total": pa.array(total)})

    return run


def _string_logs(p: Tree):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        every, counts = _merged(left)
        order = np.argsort(right.column("node").to_numpy())
        logs = Subtrees(every, counts, p).log_probabilities(*(right.column(c).to_numpy()[order] for c in ("above", "remains")))
        return _shares(left, every, logs)

    return run


@F.pandas_udf(DoubleType())
def _kt_log(n0: pd.Series, n1: pd.Series) -> pd.Series:
    return pd.Series(kt_log(n0.to_numpy(), n1.to_numpy()))


def _weights_above(upper: DataFrame, p: Tree) -> DataFrame:
    """For each node at depth ``split`` what shorter contexts predict, and the weight that
    they leave."""
    half = F.lit(HALF)
    shorter = lambda d: F.col("node").bitwiseAND(F.lit((1 << (8 * d + 8)) - 1))

    def weighted(df: DataFrame) -> DataFrame:
        df = df.withColumn("own", _kt_log("n0", "n1"))
        a, b = half + F.col("own"), half + F.col("below")
        top = F.greatest(a, b)
        df = df.withColumn("total", top + F.log(F.exp(a - top) + F.exp(b - top)))
        stop = F.exp(half + F.col("own") - F.col("total"))
        return df.withColumn("stop", stop).withColumn("one", (F.col("n1") + 0.5) / (F.col("n0") + F.col("n1") + 1))

    sums = (F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.sum("total").alias("below"))
    levels = {p.split: upper}
    for d in range(p.split - 1, -1, -1):
        levels[d] = weighted(levels[d + 1].select(shorter(d).alias("node"), "n0", "n1", "total").groupBy("node").agg(*sums))
    state = levels[0].select("node", (F.col("stop") * F.col("one")).alias("above"), (1 - F.col("stop")).alias("remains"))
    for d in range(1, p.split):
        nodes = levels[d].select("node", "stop", "one", shorter(d - 1).alias("over")).join(state.withColumnRenamed("node", "over"), "over")
        state = nodes.select("node", (F.col("above") + F.col("remains") * F.col("stop") * F.col("one")).alias("above"), (F.col("remains") * (1 - F.col("stop"))).alias("remains"))
    return upper.select("bucket", "node", shorter(p.split - 1).alias("over")).join(state.withColumnRenamed("node", "over"), "over").select("bucket", "node", "above", "remains")


_OUT = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64()), ("n_bytes", pa.int64())])


def _lookup(sorted_keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Values of keys, looked up in sorted order some thousands at a time."""
    out, step = np.empty(len(wanted)), 1 << 16
    for at in range(0, len(wanted), step):
        part = wanted[at : at + step]
        if part.max() >> U(48):
            order = np.argsort(part)
            keys = part[order]
        else:  # the place fits beside the key, and plain numbers sort faster
            packed = np.sort((part << U(16)) | np.arange(len(part), dtype=U))
            order, keys = (packed & U(0xFFFF)).astype(np.int64), packed >> U(16)
        out[at + order] = values[np.searchsorted(sorted_keys, keys)]
    return out


def _score_block(p: Tree, n_all: int, v_all: int, n_end: int):
    floor = math.log10(n_all + 0.5 * (v_all + 1))
    end = math.log10(n_end + 0.5)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        columns: list[tuple] = []
        for packed in left.column("doc"):
            raw = _unpack(packed.as_py())
            n = int(np.frombuffer(raw, np.int64, 1)[0])
            ids, sizes = np.frombuffer(raw, np.int64, 2 * n, 8).reshape(2, n)
            flags = np.frombuffer(raw, np.uint8, n, 8 + 16 * n)
            at, docs = 8 + 17 * n, []
            for i, size, flag in zip(ids.tolist(), sizes.tolist(), flags.tolist(), strict=True):
                docs.append((None if flag & 1 else i, bool(flag & 2), raw[at : at + size]))
                at += size
            block = Block(docs, p, counted=False)
            found = {(k, b): v for k, b, v in zip(right.column("kind").to_pylist(), right.column("bucket").to_pylist(), right.column("vals"), strict=True)}
            values = {"word": np.zeros(len(block.word_keys)), "string": np.zeros(len(block.string_keys))}
            for kind, keys, where, form in (("word", block.word_keys, (block.word_keys % U(p.buckets)).astype(np.int64), np.int64), ("string", block.string_keys, string_bucket(block.string_keys, p), np.float64)):
                order, bounds = in_buckets(keys, where, p.buckets)
                for b in range(p.buckets):
                    if bounds[b + 1] > bounds[b]:
                        values[kind][order[bounds[b] : bounds[b + 1]]] = _unpack(found[kind, b].as_py(), form)
            index = dict(zip(block.words, range(len(block.words)), strict=True))
            word_score, is_known = np.log10(values["word"] + 0.5), values["word"] > 0
            for first in range(0, len(docs), 500):
                some = docs[first : first + 500]
                g, starts = strings([body + b"\n" for _, _, body in some], p.depth)
                totals = np.add.reduceat(_lookup(block.string_keys, values["string"], g), starts[:-1])
                for (i, learn, body), total, size in zip(some, totals.tolist(), np.diff(starts).tolist(), strict=True):
                    tokens = body.split()
                    at = np.fromiter(map(index.__getitem__, tokens), np.int64, len(tokens))
                    known = int(is_known[at].sum()) + (n_end > 0)
                    base = float(word_score[at].sum()) + end - (len(tokens) + 1) * floor
                    columns.append((i, not learn, len(tokens) + 1, known, base, total / math.log(10), size))
        return pa.Table.from_batches([record(_OUT, *(list(c) for c in zip(*columns, strict=True)))] if columns else [], schema=_OUT)

    return run


def text_scores(docs: DataFrame, learns=None, key: str = "doc_id", text: str = "text", p: Tree = Tree()) -> DataFrame:
    """``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score,
    bits_per_byte)`` for each row of ``docs``.

    ``learns`` is a condition on ``id`` that marks training rows (default: crc32 of the id
    as text, modulo 5, is not 1); where it is null the row trains. ``score`` is the tree's
    log10 probability of the text, ``base_score`` that of a smoothed word model. Null and
    empty texts are just an end. Without training rows every byte has probability 1/256.
    Repeated rows and ids repeat, and count as often as they train. A block holds texts
    of ``block_bytes`` together, or one longer text. An empty table gives an empty result. Other columns don't matter.
    """
    if learns is None:
        learns = crc_bucket(F.col("id"), 5) != 1
    size = docs.agg(F.coalesce(F.sum(F.octet_length(docs[text])), F.lit(0))).first()[0]
    p = replace(p, buckets=int(min(max(size // p.bucket_bytes, p.buckets), p.most_buckets)))
    table = written(_blocks(docs, key, text, learns, p))
    heads = table.select("block", "doc", "n_train", "docs_train")
    n_words, n_end, blocks = heads.agg(F.coalesce(F.sum("n_train"), F.lit(0)), F.coalesce(F.sum("docs_train"), F.lit(0)), F.count(F.lit(1))).first()
    groups = blocks // p.blocks_a_group + 1
    kind = lambda k: table.select("block", F.pmod(F.xxhash64("block"), F.lit(groups)).cast("int").alias("group"), F.inline(k))
    summed = lambda k: written(kind(k).groupBy("bucket", "group").applyInArrow(_sums, _SUMS))
    back = lambda k, shares, of: kind(k).groupBy("bucket", "group").cogroup(shares.groupBy("bucket", "group")).applyInArrow(_values(of), "block long, bucket int, vals binary").withColumn("kind", F.lit(k))
    words_of = written(summed("word").groupBy("bucket").applyInArrow(_word_shares, _SHARES + ", distinct long"))
    v_all = words_of.agg(F.coalesce(F.sum("distinct"), F.lit(0))).first()[0] + (n_end > 0)
    strings_of = summed("string")
    upper = written(strings_of.groupBy("bucket").applyInArrow(_upper_nodes(p), "bucket int, node long, n0 double, n1 double, total double"))
    above = written(_weights_above(upper, p))
    logs = strings_of.groupBy("bucket").cogroup(above.groupBy("bucket")).applyInArrow(_string_logs(p), _SHARES)
    values = back("word", words_of.drop("distinct"), np.int64).unionByName(back("string", logs, np.float64))
    scored = heads.select("block", "doc").groupBy("block").cogroup(values.groupBy("block")).applyInArrow(_score_block(p, n_words + n_end, v_all, n_end), "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double, n_bytes long")
    bits = -F.col("score") * math.log2(10) / F.col("n_bytes")
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n_words + n_end).cast("long").alias("train_tokens"), "base_score", "score", bits.alias("bits_per_byte"))
