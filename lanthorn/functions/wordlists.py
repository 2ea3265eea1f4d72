"""Word lists of any length that tasks can look into without holding them.

A list is one file: a bitmap that tells most absent words at once, and the sorted words with
their offsets, searched by halving. Spark ships the file to each machine once; the Python
workers of a machine map it into memory, so they share its pages, and what is pickled with a
task is the file's name.
"""

from __future__ import annotations

import os
import tempfile
import unicodedata
import uuid
import zlib
from collections.abc import Iterable, Iterator, Set
from functools import lru_cache

import numpy as np
from pyspark import SparkFiles
from pyspark.sql import SparkSession

#: A list's file may not be larger: every machine gets it.
MOST_BYTES = 1 << 30
#: Bits of the bitmap for a word, at least.
BITS = 16


def usual(word: str) -> str:
    """The form in which words are listed."""
    return unicodedata.normalize("NFC", word.strip().lower())


def build(words: Iterable[str], path: str) -> int:
    """Writes the file of a list, each word once; returns how many there are."""
    listed = sorted({usual(w).encode() for w in words} - {b""})
    size = 1 << max(10, (BITS * len(listed) - 1).bit_length())
    bits = np.zeros(size, bool)
    bits[np.fromiter((zlib.crc32(w) for w in listed), np.int64, len(listed)) & (size - 1)] = True
    ends = np.concatenate([[0], np.cumsum(np.fromiter(map(len, listed), np.int64, len(listed)))]).astype(np.int64)
    if (total := 16 + ends.nbytes + size // 8 + int(ends[-1])) > MOST_BYTES:
        raise ValueError(f"a word list of {total} bytes is too large to ship; {MOST_BYTES} are allowed")
    with open(path, "wb") as out:
        out.write(np.array([len(listed), size], np.int64).tobytes() + ends.tobytes() + np.packbits(bits).tobytes() + b"".join(listed))
    return len(listed)


@lru_cache(maxsize=16)
def _mapped(path: str) -> tuple[np.ndarray, int, np.ndarray, np.ndarray]:
    data = np.memmap(path, np.uint8, "r")
    n, size = data[:16].view(np.int64).tolist()
    at = 16 + 8 * (n + 1)
    return data[16:at].view(np.int64), size, data[at : at + size // 8], data[at + size // 8 :]


class WordList(Set):
    """The words of a file that ``build`` made; ``shipped`` by Spark, or at a path."""

    def __init__(self, path: str, shipped: bool = False):
        self.path, self.shipped = path, shipped

    def _parts(self):
        return _mapped(SparkFiles.get(self.path) if self.shipped else self.path)

    def __len__(self) -> int:
        return len(self._parts()[0]) - 1

    def __iter__(self) -> Iterator[str]:
        ends, _, _, text = self._parts()
        return (bytes(text[a:b]).decode() for a, b in zip(ends[:-1], ends[1:], strict=True))

    def __contains__(self, word: object) -> bool:
        if not isinstance(word, str):
            return False
        ends, size, bits, text = self._parts()
        sought = word.encode("utf-8", "surrogatepass")
        place = zlib.crc32(sought) & (size - 1)
        if not bits[place >> 3] >> (7 - (place & 7)) & 1:
            return False
        low, high = 0, len(ends) - 1
        while low < high:
            mid = (low + high) // 2
            here = bytes(text[ends[mid] : ends[mid + 1]])
            if here == sought:
                return True
            low, high = (mid + 1, high) if here < sought else (low, mid)
        return False

    def __hash__(self) -> int:
        return hash((self.path, self.shipped))

    @classmethod
    def _from_iterable(cls, words: Iterable[str]) -> frozenset[str]:
        return frozenset(words)


def ship(spark: SparkSession, words: Iterable[str]) -> WordList:
    """A list that all tasks of the application can look into."""
    name = f"words-{uuid.uuid4().hex}"
    path = os.path.join(tempfile.mkdtemp(prefix="lanthorn-"), name)  # the driver's own copy; Spark fetches it from there
    build(words, path)
    spark.sparkContext.addFile(path)
    return WordList(name, shipped=True)
