"""MinHash near-duplicates: universal hash minima, banding, signature verification,
confirmation on full shingle sets, and connected components.

Texts with equal shingle sets are one node from the start, so copies never meet in
pairs; an id with several texts links their nodes. Nodes that share a band value are
candidates. Groups of up to ``most_paired`` nodes give all their pairs. A larger group
gives one pair a node, with its smallest node; nodes that stay outside the group's largest
component are then compared with the rest of their group in blocks of bounded size, so no
link between texts is lost and no group is ever gathered. Bands that hold more than one in
``MOST_HOT`` of all rows are at most ``MOST_HOT``; their rows stay where they are.

Two sets at similarity 0.85 share none of the 42 bands of six minima with probability
(1 - 0.85^6)^42 < 3e-9. A signature is dropped only when it lies more than six standard
deviations below the threshold.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import checkpointed, written
from ._words import WordHashes, batches, mix, record, words
from .components import connected_components


@dataclass(frozen=True)
class MinHash:
    shingle: int = 5
    percent: int = 80
    bands: int = 42
    rows: int = 6
    most_paired: int = 16
    block: int = 512
    seed: int = 20_117


#: Documents whose rows an intermediate file holds, about.
DOCS_A_FILE = 5000
#: The bound on the bands that are broadcast because many rows have them.
MOST_HOT = 10_000


def shingle_set(hashes: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles. Fewer words than k make
    one shingle, no words none."""
    n = len(hashes)
    if n == 0:
        return np.empty(0, np.uint64)
    width = min(k, n)
    with np.errstate(over="ignore"):
        total = np.full(n - width + 1, width, np.uint64)
        for i in range(width):
            total = mix(total * np.uint64(0x9E3779B97F4A7C15) + hashes[i : n - width + 1 + i])
    return np.unique(total)


class Signer:
    def __init__(self, p: MinHash):
        rng = np.random.default_rng(p.seed)
        self.p = p
        self.a = rng.integers(1, 1 << 63, p.bands * p.rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.b = rng.integers(0, 1 << 63, p.bands * p.rows, dtype=np.uint64)

    def minima(self, shingles: np.ndarray) -> np.ndarray:
        """The least value of each hash function, over blocks of shingles."""
        least = np.full(len(self.a), np.iinfo(np.uint64).max, np.uint64)
        with np.errstate(over="ignore"):
            for at in range(0, len(shingles), 512):
                part = shingles[at : at + 512]
                np.minimum(least, (self.a[:, None] * part[None, :] + self.b[:, None]).min(axis=1), out=least)
        return least

    def bands(self, least: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            key = np.arange(self.p.bands, dtype=np.uint64)
            for column in least.reshape(self.p.bands, self.p.rows).T:
                key = mix(key * np.uint64(0x9E3779B97F4A7C15) + (column >> np.uint64(16)))
        return key.view(np.int64)

    @staticmethod
    def signature(least: np.ndarray) -> bytes:
        """One byte of each minimum."""
        return mix(least).astype(np.uint8).tobytes()


def _key(shingles: np.ndarray) -> tuple[int, bytes]:
    """What stands for a set in joins, and what tells it from all others."""
    digest = hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()
    return int.from_bytes(digest[:8], "little", signed=True), digest


def _texts(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(docs[key].cast("long").alias("id"), docs[text].alias("text"), F.xxhash64(docs[text]).alias("hash"))


def _signed(docs: DataFrame, key: str, text: str, p: MinHash) -> DataFrame:
    schema = pa.schema([("id", pa.int64()), ("hash", pa.int64()), ("n_shingles", pa.int64()), ("node", pa.int64()), ("set_key", pa.binary()), ("bands", pa.list_(pa.int64())), ("signature", pa.binary())])

    def run(source):
        signer, hashes = Signer(p), WordHashes()
        for ids, text_hashes, texts in batches(source, ["id", "hash", "text"]):
            rows = []
            for i, h, t in zip(ids, text_hashes, texts, strict=True):
                s = shingle_set(hashes.of(words(t)), p.shingle)
                if len(s):
                    least = signer.minima(s)
                    rows.append((i, h, len(s), *_key(s), signer.bands(least), signer.signature(least)))
                else:
                    rows.append((i, h, 0, None, None, None, None))
            yield record(schema, *(list(c) for c in zip(*rows, strict=True)))

    return _texts(docs, key, text).mapInArrow(run, "id long, hash long, n_shingles long, node long, set_key binary, bands array<long>, signature binary")


def _sets(docs: DataFrame, key: str, text: str, wanted: DataFrame, p: MinHash) -> DataFrame:
    """``(node, rep, shingles)`` of the wanted ``(id, hash)``: the sorted 64-bit hashes, as
    bytes. Texts are told apart by their hash too, so that those of one id are spread."""
    schema = pa.schema([("node", pa.int64()), ("rep", pa.int64()), ("shingles", pa.binary())])

    def run(source):
        hashes = WordHashes()
        for ids, texts in batches(source, ["id", "text"]):
            sets = [shingle_set(hashes.of(words(t)), p.shingle) for t in texts]
            yield record(schema, [_key(s)[0] for s in sets], ids, [s.tobytes() for s in sets])

    return _texts(docs, key, text).join(wanted, ["id", "hash"], "left_semi").dropDuplicates(["id", "hash"]).mapInArrow(run, "node long, rep long, shingles binary")


def _similar(pairs: DataFrame, values: DataFrame, column: str, check) -> DataFrame:
    """``(a, b, rep_a, rep_b)`` of the pairs ``(a, b)`` of nodes whose values pass
    ``check(left, right) -> bool``, applied a batch at a time."""
    left = values.select(F.col("node").alias("a"), F.col("rep").alias("rep_a"), F.col(column).alias("va"))
    right = values.select(F.col("node").alias("b"), F.col("rep").alias("rep_b"), F.col(column).alias("vb"))

    def run(source):
        for batch in source:
            if batch.num_rows:
                keep = [check(x, y) for x, y in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays(batch.columns[:4], names=["a", "b", "rep_a", "rep_b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.join(left, "a").join(right, "b").select("a", "b", "rep_a", "rep_b", "va", "vb").mapInArrow(run, "a long, b long, rep_a long, rep_b long")


def signature_check(p: MinHash):
    """Whether a pair's signatures agree often enough: each byte agrees with
    probability J + (1 - J) / 256."""
    n, j = p.bands * p.rows, p.percent / 100
    agree = j + (1 - j) / 256
    least = n * agree - 6 * (n * agree * (1 - agree)) ** 0.5
    return lambda x, y: np.count_nonzero(np.frombuffer(x, np.uint8) == np.frombuffer(y, np.uint8)) >= least


def set_check(p: MinHash):
    def check(x, y):
        a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
        if 100 * min(len(a), len(b)) < p.percent * max(len(a), len(b)):
            return False
        both = len(np.intersect1d(a, b, assume_unique=True))
        return 100 * both >= p.percent * (len(a) + len(b) - both)

    return check


def _block_links(p: MinHash):
    """Links between the two sides of a block: nodes outside their group's largest
    component, and the group. At most one link for a node and a component."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(table: pa.Table) -> pa.Table:
        rows = table.select(["rep", "component", "probe", "shingles"]).to_pylist()
        sets = [np.unique(np.frombuffer(r["shingles"], np.uint64)) for r in rows]
        sizes = np.array([len(s) for s in sets])
        flat = np.concatenate(sets)
        _, column = np.unique(flat, return_inverse=True)
        probes = [i for i, r in enumerate(rows) if r["probe"]]
        bases = [i for i, r in enumerate(rows) if not r["probe"]]
        starts = np.concatenate([[0], np.cumsum(sizes)])
        width = int(column.max()) + 1 if len(column) else 0
        component = np.array([r["component"] for r in rows])
        found = set()
        for i in probes:
            mark = np.zeros(width, np.int64)
            mark[column[starts[i] : starts[i + 1]]] = 1
            running = np.concatenate([[0], np.cumsum(mark[column])])
            both = running[starts[1:]] - running[starts[:-1]]
            close = (100 * both >= p.percent * (sizes + sizes[i] - both)) & (component != component[i])
            seen = set()
            for j in bases:
                if close[j] and component[j] not in seen:
                    seen.add(component[j])
                    found.add((rows[i]["rep"], rows[j]["rep"]))
        found = sorted(found)
        return pa.table({"a": [x for x, _ in found], "b": [y for _, y in found]}, schema=schema)

    return run


def _rest_links(members: DataFrame, component: DataFrame, sets: DataFrame, p: MinHash) -> DataFrame:
    """Links inside large groups that are not yet one component. ``members`` holds
    ``(band, node, rep)`` of the large groups."""
    placed = members.join(component.withColumnRenamed("node", "rep"), "rep", "left").select("band", "node", "rep", F.coalesce("component", "rep").alias("component"))
    counts = placed.groupBy("band", "component").agg(F.count(F.lit(1)).alias("n"))
    groups = counts.groupBy("band").agg(F.max_by("component", F.struct("n", "component")).alias("largest"), F.sum("n").alias("total"), F.max("n").alias("most")).where("most < total")
    pieces = lambda n: F.ceil(n / p.block).cast("int")
    # A table of its own, so that the join can split a group's rows over tasks.
    open_groups = checkpointed(groups.select("band", "largest", pieces(F.col("total")).alias("base_blocks"), pieces(F.col("total") - F.col("most")).alias("probe_blocks")))
    rows = placed.join(open_groups, "band")
    mine = F.xxhash64("node")
    base = rows.select("band", "node", "rep", "component", F.lit(False).alias("probe"), F.pmod(mine, F.col("base_blocks")).alias("i"), F.explode(F.expr("sequence(0, probe_blocks - 1)")).alias("j"))
    probe = rows.where("component <> largest").select("band", "node", "rep", "component", F.lit(True).alias("probe"), F.explode(F.expr("sequence(0, base_blocks - 1)")).alias("i"), F.pmod(mine, F.col("probe_blocks")).alias("j"))
    blocks = base.unionByName(probe.select(base.columns))
    return blocks.join(sets, ["node", "rep"]).groupBy("band", "i", "j").applyInArrow(_block_links(p), "a long, b long").distinct()


def _grouped(heads: DataFrame, p: MinHash) -> DataFrame:
    """``(band, node, rep, n, first)``: the rows of bands with several nodes, how many they
    are, and the node of the smallest ``rep``. Bands with many rows are bounded in number
    and go to the rows; the rest have few rows each when they are shuffled."""
    members = heads.select("node", "rep", F.explode("bands").alias("band"))
    groups = checkpointed(members.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("rep", "node"))["node"].alias("first")).where("n > 1"))
    many = max(p.most_paired, heads.count() * p.bands // MOST_HOT)
    hot = groups.where(F.col("n") > many)  # at most ``MOST_HOT`` rows, since each stands for more than one in that many
    columns = ["band", "node", "rep", "n", "first"]
    cold = members.join(F.broadcast(hot.select("band")), "band", "left_anti").join(groups.where(F.col("n") <= many), "band")
    return members.join(F.broadcast(hot), "band").select(columns).unionByName(cold.select(columns))


def _shared_links(sized: DataFrame, first: DataFrame) -> DataFrame:
    """``(u, v)``: ids with several texts, and these texts' nodes."""
    several = sized.groupBy("id").agg(F.min("set_key").alias("lo"), F.max("set_key").alias("hi")).where("lo <> hi").select("id")
    return sized.join(several, "id").select("id", "set_key").distinct().join(first, "set_key").select(F.col("id").alias("u"), F.col("rep").alias("v")).where("u <> v")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", p: MinHash = MinHash()) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)`` for each row of ``docs``.

    A document with no words has no shingles and is linked with nothing, as is a null
    text. Rows that share an id are one document, whatever their texts: it is linked with
    what any of them is linked with. A null id is never linked. A very long text is one row
    of its task, and its signature is made in bounded pieces. Repeated rows repeat. An empty
    table gives an empty result. Other columns don't matter.
    """
    signed = written(_signed(docs, key, text, p))
    # Files by the number of documents, so that few documents don't make many small files.
    n = signed.count()
    tables, links_parts = n // DOCS_A_FILE + 1, n // (4 * DOCS_A_FILE) + 1
    sized = signed.where("n_shingles > 0 and id is not null")
    first = sized.groupBy("set_key").agg(F.min(F.struct("id", "hash")).alias("f")).select("set_key", F.col("f.id").alias("rep"), F.col("f.hash").alias("hash"))
    mine = sized.join(first.select(F.col("set_key").alias("k"), F.col("rep").alias("id"), "hash"), ["id", "hash"]).where("k = set_key")
    heads = checkpointed(mine.select("node", F.col("id").alias("rep"), "hash", "bands", "signature").dropDuplicates(["rep", "hash"]).coalesce(tables))
    grouped = checkpointed(_grouped(heads, p).coalesce(tables))
    small = grouped.where(F.col("n") <= p.most_paired).select("band", "node")
    paired = small.groupBy("band").agg(F.array_sort(F.collect_set("node")).alias("ids"))
    pairs = paired.where("size(ids) > 1").select(F.explode(F.expr("flatten(transform(sequence(1, size(ids) - 1), i -> transform(slice(ids, i + 1, size(ids)), x -> struct(ids[i - 1] as a, x as b))))")).alias("p")).select("p.a", "p.b")
    stars = grouped.where((F.col("n") > p.most_paired) & (F.col("node") != F.col("first"))).select(F.least("first", "node").alias("a"), F.greatest("first", "node").alias("b"))
    wanted = grouped.select("node", "rep").distinct().join(heads.select("node", "rep", "hash"), ["node", "rep"]).select(F.col("rep").alias("id"), "hash")
    sets = written(_sets(docs, key, text, wanted, p).coalesce(tables))
    likely = _similar(pairs.unionByName(stars).distinct(), heads, "signature", signature_check(p)).select("a", "b").distinct()
    close = _similar(likely, sets, "shingles", set_check(p)).select(F.col("rep_a").alias("u"), F.col("rep_b").alias("v"))
    links = checkpointed(close.where("u <> v").unionByName(_shared_links(sized, first)).distinct().coalesce(links_parts))
    component = connected_components(links)
    large = grouped.where(F.col("n") > p.most_paired).select("band", "node", "rep")
    more = checkpointed(_rest_links(large, component, sets, p).toDF("u", "v").coalesce(links_parts))
    if not more.isEmpty():
        component = connected_components(links.unionByName(more))
    head_of = first.join(component.withColumnRenamed("node", "rep"), "rep", "left").select(F.col("set_key").alias("k"), F.coalesce("component", "rep").alias("component"))
    rows = signed.select("id", "n_shingles", "set_key")
    out = rows.join(head_of, rows["set_key"] == head_of["k"], "left")
    linked = F.col("id").isNotNull() & (F.col("n_shingles") > 0)
    component_id = F.when(linked, F.col("component")).otherwise(F.col("id"))
    return out.select(F.col("id").alias("doc_id"), "n_shingles", component_id.alias("component_id"), F.coalesce(F.col("id") == component_id, F.lit(True)).alias("kept"))


#: From here on keys stand for rows without an id.
WITHOUT_ID = 1 << 62


def keep_first(docs: DataFrame, key: str = "doc_id", text: str = "text", p: MinHash = MinHash()) -> DataFrame:
    """The rows of ``docs`` that stay when one of each group of near copies does: the one
    with the smallest id, all columns as they were. Of rows with equal ids the one whose
    text has the smallest hash stays. Rows without an id are told apart by their texts and
    stay only in groups without any id. A row without words is a group of its own."""
    own = F.lit(WITHOUT_ID) + F.xxhash64(docs[text]).bitwiseAND(F.lit(WITHOUT_ID - 1))
    keyed = docs.withColumn("__key", F.coalesce(docs[key].cast("long"), own))
    found = near_duplicates(keyed, "__key", text, p)
    kept = checkpointed(found.where("kept and n_shingles > 0").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")))
    wordless = F.coalesce(~F.col(text).rlike("[^\\x20\\x09-\\x0D]"), F.lit(True))
    single = kept.where("n = 1").select(F.col("doc_id").alias("__key"))
    out = keyed.where(~wordless).join(single, "__key", "left_semi").drop("__key")
    repeated = kept.where("n > 1").select(F.col("doc_id").alias("__key"))
    if not repeated.isEmpty():
        rows = keyed.where(~wordless).join(repeated, "__key", "left_semi")
        one = rows.groupBy("__key").agg(F.min_by(F.struct(*docs.columns), F.struct(F.xxhash64(text), text)).alias("__row"))
        out = out.unionByName(one.select("__row.*"))
    return out.unionByName(docs.where(wordless))
