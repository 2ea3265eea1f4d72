"""Chat formatting with offset-aligned loss masks.

A conversation is rendered as a whole and encoded once with offsets. Turn spans and token
spans are both sorted, so a binary search finds the tokens of each assistant text. The
control strings are single tokens, hence no token reaches over a turn's edge.

Template of a turn: ``<s>[INST]`` role ``[/INST]`` text ``</s>``. A control string inside
a role or text gets the mark U+241B after its first character; the mark itself is
doubled. Undoing that gives back the exact text.

Rows are dealt out by conversation and streamed in turn order. A conversation longer than
``chunk`` characters is encoded in parts cut between turns, which gives the same tokens,
so a task holds one part at a time.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import read_vocabulary

BEGIN, HEAD, BODY, END = "<s>", "[INST]", "[/INST]", "</s>"
CONTROLS = (BEGIN, HEAD, BODY, END, "<|endoftext|>")
MARK = "␛"
_CONTROL = re.compile("|".join(map(re.escape, CONTROLS)))
_TURN = re.compile(f"{re.escape(BEGIN + HEAD)}(.*?){re.escape(BODY)}(.*?){re.escape(END)}", re.S)


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: m[0][0] + MARK + m[0][1:], text.replace(MARK, MARK + MARK))


def unescape(text: str) -> str:
    return re.sub(f"{MARK}({MARK}?)", r"\1", text)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted text and the spans of the assistant texts in it."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{BEGIN}{HEAD}{escape(role)}{BODY}", escape(text)
        if role == "assistant":
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, END]
        at += len(head) + len(body) + len(END)
    return "".join(parts), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    return [(unescape(r), unescape(t)) for r, t in _TURN.findall(formatted)]


def loss_mask(offsets: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """Which tokens, given their sorted ``(start, end)``, lie in a span."""
    mask = np.zeros(len(offsets), bool)
    if len(offsets):
        for start, end in spans:
            mask[np.searchsorted(offsets[:, 0], start) : np.searchsorted(offsets[:, 1], end, "right")] = start < end
    return mask


def masked_text(formatted: str, offsets: np.ndarray, mask: np.ndarray) -> str:
    """The unescaped text under the mask. Tokens inside a character share its offsets."""
    out, begin, end = [], -1, -1
    for (s, e), on in zip(offsets.tolist(), mask.tolist(), strict=True):
        if on and s <= end:
            end = max(end, e)
            continue
        if end > begin:
            out.append(formatted[begin:end])
        begin, end = (s, e) if on else (-1, -1)
    if end > begin:
        out.append(formatted[begin:end])
    return "".join(map(unescape, out))


_tokenizers: dict[str, object] = {}


def chat_tokenizer(content: str):
    """The vocabulary with the control strings as added tokens; one per worker."""
    from tokenizers import AddedToken, Tokenizer

    key = hashlib.sha256(content.encode()).hexdigest()
    if key not in _tokenizers:
        _tokenizers.clear()
        t = Tokenizer.from_str(content)
        t.add_special_tokens([AddedToken(c, special=True, normalized=False) for c in CONTROLS])
        _tokenizers[key] = t
    return _tokenizers[key]


def encode_turns(tokenizer, turns: list[tuple[str, str]]):
    """``(formatted, ids, offsets, mask)``."""
    formatted, spans = render(turns)
    encoded = tokenizer.encode(formatted, add_special_tokens=False)
    offsets = np.array(encoded.offsets, np.int64).reshape(-1, 2)
    return formatted, encoded.ids, offsets, loss_mask(offsets, spans)


def _in_order(conversations: DataFrame) -> DataFrame:
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    n = max(rows.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"), "1", key=int)
    return rows.repartition(int(n), "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def _parts(source, chunk: int):
    """``(conv_id, turns, last)``: parts of conversations in order."""
    current, turns, size, some = None, [], 0, False
    for batch in source:
        columns = [batch.column(i).to_pylist() for i in (0, 2, 3)]
        for conv, role, text in zip(*columns, strict=True):
            if some and conv != current:
                yield current, turns, True
                turns, size = [], 0
            elif size > chunk:
                yield current, turns, False
                turns, size = [], 0
            current, some = conv, True
            turns.append((role, text))
            size += len(role) + len(text)
    if some:
        yield current, turns, True


def format_chats(conversations: DataFrame, vocabulary_path: str, chunk: int = 4 << 20) -> DataFrame:
    """``(conv_id, part, formatted, ids, loss_mask)``; part counts from 0 within a
    conversation longer than ``chunk`` characters. Null roles and texts are empty, a null
    conversation id is one conversation, null turns come first, and rows of an equal turn
    follow role and text."""
    shipped = conversations.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary_path))
    schema = pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), ("formatted", pa.string()), ("ids", pa.list_(pa.int32())), ("loss_mask", pa.list_(pa.bool_()))])

    def run(source):
        tokenizer, part = chat_tokenizer(shipped.value), 0
        for conv, turns, last in _parts(source, chunk):
            formatted, ids, _, mask = encode_turns(tokenizer, turns)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip([[conv], [part], [formatted], [ids], [mask.tolist()]], schema, strict=True)], schema=schema)
            part = 0 if last else part + 1

    return _in_order(conversations).mapInArrow(run, "conv_id long, part int, formatted string, ids array<int>, loss_mask array<boolean>")


def chat_digests(conversations: DataFrame, vocabulary_path: str, chunk: int = 4 << 20) -> DataFrame:
    """``(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars,
    n_tokens)``, read back from the formatted text, offsets and mask."""
    shipped = conversations.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary_path))
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("n_tokens", pa.int64())])

    def run(source):
        tokenizer, rows = chat_tokenizer(shipped.value), []
        fresh = lambda: [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
        flush = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
        state = fresh()
        for conv, turns, last in _parts(source, chunk):
            formatted, ids, offsets, mask = encode_turns(tokenizer, turns)
            back, loss = parse(formatted), masked_text(formatted, offsets, mask)
            state[0] += len(back)
            for role, text in back:
                state[1].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
            state[2] += len(loss)
            state[3].update(loss.encode("utf-8", "surrogatepass"))
            state[4] += len(formatted)
            state[5] += len(ids)
            if last:
                rows.append((conv, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4], state[5]))
                state = fresh()
            if len(rows) >= 2000:
                yield flush(rows)
                rows = []
        if rows:
            yield flush(rows)

    return _in_order(conversations).mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_tokens long")
