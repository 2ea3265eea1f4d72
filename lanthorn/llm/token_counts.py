"""Token counts by a linear longest-match automaton.

The vocabulary's pieces form a trie. A failure link leads from a node to where matching
goes on after the longest pieces of the node's string are popped; how many are popped is
counted in advance. A word is read once, byte by byte, and only counts are added up: no
piece is built. Following Song et al., "Fast WordPiece Tokenization" (2021).
"""

from __future__ import annotations

import json
from collections import deque

import pyarrow as pa
from pyspark.sql import DataFrame

from ._words import batches, record, words
from .bpe import byte_letters, read_vocabulary


class Automaton:
    """``initial`` pieces may start a word, ``continuing`` pieces go on with it (None:
    the same pieces). A word that can't be pieced together counts as one unknown token."""

    def __init__(self, initial: set[bytes], continuing: set[bytes] | None = None):
        self.next: dict[int, int] = {}  # node * 256 + byte -> node
        self.final, self.fail, self.popped = [False], [-1], [0]
        self.start = 0
        for piece in initial:
            self._add(0, piece)
        self.rest = 0 if continuing is None else self._node()
        for piece in continuing or ():
            self._add(self.rest, piece)
        self._link()

    def _node(self) -> int:
        self.final.append(False)
        self.fail.append(-1)
        self.popped.append(0)
        return len(self.final) - 1

    def _add(self, node: int, piece: bytes) -> None:
        for byte in piece:
            step = node * 256 + byte
            if step not in self.next:
                self.next[step] = self._node()
            node = self.next[step]
        self.final[node] = bool(piece)

    def _link(self) -> None:
        children: dict[int, list[tuple[int, int]]] = {}
        for step, node in self.next.items():
            children.setdefault(step // 256, []).append((step % 256, node))
        todo = deque(dict.fromkeys([self.start, self.rest]))
        while todo:
            parent = todo.popleft()
            for byte, node in children.get(parent, ()):
                if self.final[node]:
                    self.fail[node], self.popped[node] = self.rest, 1
                else:
                    at, count = self.fail[parent], self.popped[parent]
                    while at >= 0 and at * 256 + byte not in self.next:
                        count += self.popped[at]
                        at = self.fail[at]
                    if at >= 0:
                        self.fail[node], self.popped[node] = self.next[at * 256 + byte], count
                todo.append(node)

    def count(self, word: bytes) -> int:
        """The number of greedy longest-match pieces; -1 if there is no way through."""
        at, total, step = self.start, 0, self.next
        for byte in word:
            while (goal := step.get(at * 256 + byte)) is None:
                total += self.popped[at]
                at = self.fail[at]
                if at < 0:
                    return -1
            at = goal
        while at not in (self.start, self.rest):
            total += self.popped[at]
            at = self.fail[at]
            if at < 0:
                return -1
        return total


def byte_pieces(content: str) -> set[bytes]:
    """The pieces of a byte-level vocabulary file, as bytes."""
    letters, spec = byte_letters(), json.loads(content)
    added = {t["content"] for t in spec["added_tokens"]}
    return {bytes(letters[c] for c in piece) for piece in spec["model"]["vocab"] if piece not in added}


def token_counts(docs: DataFrame, vocabulary_path: str, key: str = "doc_id", text: str = "text", prefix: bytes = b" ", limit: int = 300_000) -> DataFrame:
    """``(doc_id, n_words, n_tokens, n_unknown)`` for each row. Words are those of the
    lower-cased (A-Z) text, each preceded by ``prefix``. Null and empty texts have no
    words. White space isn't counted and capitals are lower-cased before counting, so the sum is
    that of the words and not the length of an encoding of the text as it stands. A word that the
    vocabulary can't spell counts as two tokens and in ``n_unknown``. Repeated rows repeat, ids
    may be null or repeated. A very long text is one row of its task. An empty table gives an
    empty result. Other columns don't matter, whatever their names. One pass without a shuffle;
    ``limit`` words are remembered at a time."""
    shipped = docs.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary_path))
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_tokens", pa.int64()), ("n_unknown", pa.int64())])

    def run(source):
        automaton, known = Automaton(byte_pieces(shipped.value)), {}
        for ids, texts in batches(source, ["doc_id", "text"]):
            if len(known) > limit:
                known.clear()
            rows = []
            for i, t in zip(ids, texts, strict=True):
                tokens = words(t)
                for w in set(tokens).difference(known):
                    known[w] = automaton.count(prefix + w)
                counts = list(map(known.__getitem__, tokens))
                unknown = counts.count(-1)
                rows.append((i, len(tokens), sum(counts) + 2 * unknown, unknown))
            yield record(schema, *(list(c) for c in zip(*rows, strict=True)))

    return docs.select(docs[key].cast("long").alias("doc_id"), docs[text].alias("text")).mapInArrow(run, "doc_id long, n_words long, n_tokens long, n_unknown long")
