"""Byte-level BPE by depth-first traversal of a trie of distinct words.

The encoding of a prefix is the encoding of a shorter prefix plus one last token.
That token is the only vocabulary entry which ends the prefix and whose boundary
with the shorter prefix's last token no earlier merge would cross. A trie over a
batch's distinct words therefore gives every shared prefix its last token once. The
sorted words are the trie in depth-first order: what two neighbours share is the path
down to the node where they part, and its last tokens stay on a stack. An automaton over
the vocabulary names the entries that end a prefix, longest first.

Null and empty texts encode to no tokens. Repeated rows give repeated results.
"""

from __future__ import annotations

import hashlib
import json
from contextlib import contextmanager
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed: the split pattern of the vocabulary file, as its pre-tokeniser states it.
# White space is named by its Unicode property.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"

MOST_VOCABULARY_BYTES = 64 << 20
SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the vocabulary file: itself if it is
    printable, else the next free code point from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Tokens, merges and added tokens of a tokenizer file in JSON."""

    def __init__(self, content: str):
        spec = json.loads(content)
        letters = byte_letters()
        of = lambda piece: bytes(letters[c] for c in piece)
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        vocab = spec["model"]["vocab"]
        self.id_of = {of(p): i for p, i in vocab.items() if p not in self.added}
        self.bytes_of = {i: b for b, i in self.id_of.items()} | {i: t.encode() for t, i in self.added.items()}
        self.parts: dict[int, tuple[int, int]] = {}
        self.rank = dict.fromkeys(self.id_of.values(), -1)
        self.merged: dict[tuple[int, int], int] = {}
        for rank, merge in enumerate(spec["model"]["merges"]):
            left, right = (of(p) for p in (merge if isinstance(merge, list) else merge.split(" ")))
            a, b, whole = self.id_of[left], self.id_of[right], self.id_of[left + right]
            self.merged[a, b] = rank
            self.parts[whole], self.rank[whole] = (a, b), rank
        self.stays: dict[int, bool] = {}
        self._link()
        self.split = regex.compile(SPLIT).findall
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")").split if self.added else lambda t: [t]

    def _link(self) -> None:
        """The automaton: ``goto`` (state * 256 + byte), and for each state the longest
        token that ends its string; for each token the next shorter one that ends it."""
        self.goto: dict[int, int] = {}
        depth, whole = [0], [-1]
        for piece, token in self.id_of.items():
            at = 0
            for byte in piece:
                step = at * 256 + byte
                if step not in self.goto:
                    self.goto[step] = len(depth)
                    depth.append(depth[at] + 1)
                    whole.append(-1)
                at = self.goto[step]
            whole[at] = token
        self.edges = dict(self.goto)
        self.fail, self.ends = [0] * len(depth), list(whole)
        self.size = [0] * (max(self.bytes_of) + 1)
        for piece, token in self.id_of.items():
            self.size[token] = len(piece)
        self.names = list(map(str, range(len(self.size))))
        self.shorter: dict[int, int] = {}
        for step, state in sorted(self.edges.items(), key=lambda e: depth[e[1]]):
            parent, byte = divmod(step, 256)
            if parent:
                self.fail[state] = self._next(self.fail[parent], byte)
            behind = self.ends[self.fail[state]] if parent else -1
            if whole[state] >= 0:
                self.shorter[whole[state]] = behind
            else:
                self.ends[state] = behind

    def _next(self, state: int, byte: int) -> int:
        """The state after a byte; found by failure links once, then known."""
        step = state * 256 + byte
        while (goal := self.edges.get(state * 256 + byte)) is None and state:
            state = self.fail[state]
        if len(self.goto) > len(self.edges) + 200_000:
            self.goto.clear()
            self.goto.update(self.edges)
        self.goto[step] = goal = goal or 0
        return goal

    def boundary_holds(self, left: int, right: int) -> bool:
        """Whether no merge joins the end of ``left`` to the start of ``right`` while
        both are being built. The pieces that touch are followed back in time."""
        x, y, x_ends, y_ends, holds = left, right, float("inf"), float("inf"), True
        while holds:
            at = self.merged.get((x, y))
            if at is not None and at < x_ends and at <= y_ends:
                holds = False
            elif self.rank[x] > self.rank[y]:
                x_ends, x = self.rank[x], self.parts[x][1]
            elif self.rank[y] >= 0:
                y_ends, y = self.rank[y], self.parts[y][0]
            else:
                break
        if len(self.stays) > 250_000:
            self.stays.clear()
        self.stays[left << 20 | right] = holds
        return holds

    def encode_words(self, distinct: set[str]) -> dict[str, tuple[int, ...]]:
        """Encodings of distinct words, in depth-first order of their trie. ``lasts`` and
        ``states`` belong to the prefixes of the current word."""
        found: dict[str, tuple[int, ...]] = {}
        lasts, states, before = [-1], [0], b""
        goto, ends, size, shorter, stays = self.goto, self.ends, self.size, self.shorter, self.stays
        for word, data in sorted(((w, w.encode("utf-8", "surrogatepass")) for w in distinct), key=lambda x: x[1]):
            shared, most = 0, min(len(before), len(data))
            while shared < most and before[shared] == data[shared]:
                shared += 1
            del lasts[shared + 1 :], states[shared + 1 :]
            state, n = states[shared], shared
            for byte in data[shared:]:
                try:
                    state = goto[state << 8 | byte]
                except KeyError:
                    state = self._next(state, byte)
                n += 1
                token = ends[state]
                while start := n - size[token]:
                    left = lasts[start]
                    try:
                        if stays[left << 20 | token]:
                            break
                    except KeyError:
                        if self.boundary_holds(left, token):
                            break
                    token = shorter[token]
                lasts.append(token)
                states.append(state)
            before, ids = data, []
            while n:
                ids.append(lasts[n])
                n -= size[lasts[n]]
            found[word] = tuple(reversed(ids))
        return found

    def pieces(self, text: str) -> list[str]:
        """The words of a text; added tokens stand by themselves."""
        if not any(t in text for t in self.added):
            return self.split(text)
        return list(chain.from_iterable([p] if p in self.added else self.split(p) for p in self.cut(text) if p))

    def decode(self, ids) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


class Remembered(dict):
    """Two generations of a bounded size: what is in use moves on to the younger one; the
    older one is dropped when that is full."""

    def __init__(self, limit: int):
        super().__init__()
        self.limit, self.older = limit, {}

    def missing(self, keys: set) -> set:
        """The keys that are not known."""
        if len(self) > self.limit:
            self.older = dict(self)
            self.clear()
        older = self.older
        new = {k for k in keys if k not in self}
        again = {k for k in new if k in older}
        self.update((k, older[k]) for k in again)
        return new - again

    def forget(self) -> None:
        self.clear()
        self.older = {}


class Encoder:
    """Encodes texts. Spaces with no other white space beside them part a text into chunks
    that encode by themselves; chunks of up to ``longest`` characters are remembered, so
    memory is bounded by ``limit`` times that."""

    def __init__(self, vocabulary: Vocabulary, limit: int = 150_000, longest: int = 40):
        self.vocabulary, self.longest = vocabulary, longest
        self.chunks = Remembered(limit)

    def encode(self, texts: list[str]) -> list[list[int]]:
        v, out = self.vocabulary, [[] for _ in texts]
        plain = {i: t.split(" ") for i, t in enumerate(texts) if t and not any(a in t for a in v.added)}
        long = self._learn(set(chain.from_iterable(plain.values())))
        firsts = dict(zip(plain, self._pieces([v.split(c[0]) for c in plain.values()]), strict=True))
        get, slow = self.chunks.__getitem__, {}
        for i, chunks in plain.items():
            encoded = list(map(get, chunks[1:]))
            if None in encoded or not chunks[0] or chunks[0][-1].isspace():
                slow[i] = v.pieces(texts[i])
            else:
                out[i] = [*firsts[i], *chain.from_iterable(encoded)]
        slow |= {i: v.pieces(t) for i, t in enumerate(texts) if t and i not in plain}
        for i, ids in zip(slow, self._pieces(list(slow.values())), strict=True):
            out[i] = ids
        for c in long:
            del self.chunks[c]
        return out

    def _learn(self, chunks: set[str]) -> list[str]:
        """Finds each chunk's encoding behind a space; None if white space touches the
        space. Returns the chunks that are too long to be remembered."""
        new = self.chunks.missing(chunks)
        split = {c: self.vocabulary.split(" " + c) for c in new if c and not c[0].isspace() and not c[-1].isspace()}
        word = self.vocabulary.encode_words(set(chain.from_iterable(split.values()))).__getitem__
        self.chunks.update((c, tuple(chain.from_iterable(map(word, p)))) for c, p in split.items())
        self.chunks.update(dict.fromkeys(new.difference(split)))
        return [c for c in new if len(c) > self.longest]

    def _pieces(self, texts: list[list[str]]) -> list[list[int]]:
        """The ids of texts that are split into pieces."""
        added = self.vocabulary.added
        word = self.vocabulary.encode_words({p for pieces in texts for p in pieces if p not in added})
        return [list(chain.from_iterable((added[p],) if p in added else word[p] for p in pieces)) for pieces in texts]


_encoders: dict[str, Encoder] = {}


@contextmanager
def encoder(content: str):
    """One per Python worker and vocabulary. What it remembers of texts goes when the task
    ends, since an idle worker keeps its memory; the vocabulary stays."""
    key = hashlib.sha256(content.encode()).hexdigest()
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(Vocabulary(content))
    try:
        yield _encoders[key]
    finally:
        _encoders[key].chunks.forget()
        pa.default_memory_pool().release_unused()


def _encoded(source, content: str, column: int, most: int = 500):
    """Parts of the batches, each with its texts' ids, and the vocabulary."""
    with encoder(content) as enc:
        for batch in source:
            for at in range(0, batch.num_rows, most):
                part = batch.slice(at, most)
                yield part, enc.encode(part.column(column).to_pylist()), enc.vocabulary


def read_vocabulary(path: str) -> str:
    """The file's text, read on the driver and sent along with the tasks."""
    with open(path, encoding="utf-8") as f:
        content = f.read(MOST_VOCABULARY_BYTES + 1)
    if len(content) > MOST_VOCABULARY_BYTES:
        raise ValueError("the vocabulary file is too large to send to every executor")
    return content


def bpe_encode(docs: DataFrame, vocabulary_path: str, text: str = "text", keep: list[str] | None = None, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``docs``, or only its columns in ``keep``, with ``ids`` array<int> and ``decoded``
    string after them. A kept column of either name is an error; name the new ones
    otherwise then. One pass without a shuffle. Each row is encoded by itself: repeated rows
    repeat, null and empty texts have no tokens and decode to an empty text, an empty table
    gives an empty one, and a very long text is held by its task as one row."""
    shipped = docs.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary_path))
    columns = docs.columns if keep is None else keep
    if {ids.lower(), decoded.lower()} & {c.lower() for c in columns}:
        raise ValueError(f"the table has a column {ids} or {decoded}; choose other names for the results")
    kept = docs.select(*(F.col(f"`{c}`") for c in columns))
    schema = T.StructType([*kept.schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType())), T.StructField(decoded, T.StringType())])

    def run(source):
        for part, found, vocabulary in _encoded(source, shipped.value, 0):
            yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(found, pa.list_(pa.int32())), pa.array(map(vocabulary.decode, found), pa.string())], names=[*part.schema.names[1:], ids, decoded])

    return docs.select(F.col(text).alias("__bpe_text"), *(F.col(f"`{c}`") for c in columns)).mapInArrow(run, schema)


def bpe_digests(docs: DataFrame, vocabulary_path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)`` of each row: the number of tokens
    and SHA-256 digests of the ids, joined by commas, and of the decoded text. Cases are
    defined as for ``bpe_encode``; a null id stays null and other columns don't matter."""
    shipped = docs.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary_path))
    digest = lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()

    def run(source):
        for part, found, vocabulary in _encoded(source, shipped.value, 1):
            joined = [digest(",".join(map(vocabulary.names.__getitem__, i))) for i in found]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(map(len, found), pa.int64()), pa.array(joined, pa.string()), pa.array([digest(vocabulary.decode(i)) for i in found], pa.string())], schema=SCHEMA)

    return docs.select(docs[key].cast("long").alias("doc_id"), docs[text].alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
