"""Word splitting shared by the operators: bytes of UTF-8 text, A-Z lower-cased,
split at ``[\\x20\\x09-\\x0D]+``."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

MASK64 = (1 << 64) - 1


def words(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z) words of a text; a null text has none.

    ``bytes.lower`` and ``bytes.split`` treat ASCII only, so their white space is
    exactly space and 0x09-0x0D.
    """
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


class WordHashes:
    """64-bit hashes of words, remembered up to a fixed number of words."""

    def __init__(self, limit: int = 200_000):
        self.limit, self.known = limit, {}

    def of(self, tokens: list[bytes]) -> np.ndarray:
        known = self.known
        if len(known) > self.limit:
            known.clear()
        new = set(tokens).difference(known)
        if new:
            digest = xxhash.xxh64_intdigest
            known.update((w, digest(w)) for w in new)
        return np.fromiter(map(known.__getitem__, tokens), dtype=np.uint64, count=len(tokens))


def mix(h: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def batches(source, columns: list[str], most_rows: int = 2000):
    """Python lists of the columns, a bounded number of rows at a time."""
    for batch in source:
        for at in range(0, batch.num_rows, most_rows):
            part = batch.slice(at, most_rows)
            yield [part.column(part.schema.get_field_index(c)).to_pylist() for c in columns]


def record(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)],
        schema=schema,
    )


def rows_where(docs: DataFrame, text: Column, decide: Callable[[], Callable[[list], np.ndarray]], most_rows: int = 500) -> DataFrame:
    """The rows whose text ``decide`` keeps, all columns as they were. Only the texts go to
    Python and only flags come back. ``decide()`` makes the test of a task: a function of a
    list of texts that returns a flag for each."""

    @F.arrow_udf(BooleanType())
    def keep(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        test = decide()
        for batch in batches:
            flags = [test(batch.slice(at, most_rows).to_pylist()) for at in range(0, len(batch), most_rows)]
            yield pa.array(np.concatenate(flags) if flags else [], pa.bool_())

    return docs.where(keep(text))
