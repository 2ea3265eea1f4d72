"""Languages of a text as a mixture, fitted by expectation-maximisation.

A text is its letters, each with the letters next to it. A language is a distribution over
these triples, learned from the texts of that language; a text of several languages draws
each triple from one of them, in unknown proportions. EM finds the proportions of most
likelihood. Languages are added one at a time, the one first towards which the likelihood
rises most steeply (it is concave in the proportions, so where it rises towards none, no
language helps), and stay only if the gain beats a penalty a language, as in BIC.

Following Lui, Lau and Baldwin, "Automatic Detection and Language Identification of
Multilingual Documents" (2014), with EM in place of sampling.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._labels import bucket
from ._words import batches, mix, record


@dataclass(frozen=True)
class Mixture:
    """A further language must gain ``penalty * log(letters)`` of log-likelihood and have
    ``least_share`` of the letters. Triples overlap, so ``overlap`` of them count as one
    observation."""

    buckets: int = 1 << 16
    most_bytes: int = 64 << 20
    smoothing: float = 0.5
    penalty: float = 2.0
    least_share: float = 0.03
    overlap: float = 3.0
    rounds: int = 30
    close: float = 1e-4
    most_languages: int = 8


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Lower-case code point of every letter and of the marks on letters, 0 for the rest."""
    out = np.zeros(0x110000, np.uint32)
    for c in range(0x110000):
        x = chr(c)
        if unicodedata.category(x)[0] in "LM":
            out[c] = ord(x.lower()[0])
    return out


#: Characters that are read at a time.
CHUNK = 1 << 20
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


def triples(text: str, buckets: int):
    """Bucket of each letter with its neighbours, in parts of bounded size."""
    table, seeds = _letters(), _FACTORS
    for at in range(0, len(text), CHUNK):
        part = text[max(0, at - 1) : at + CHUNK + 1]
        codes = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), np.uint32)
        x = np.zeros(len(codes) + 2, np.uint64)
        x[1:-1] = table[codes]
        inner = slice(1 if at else 0, len(codes) - (at + CHUNK < len(text)))
        where = np.flatnonzero(x[1:-1][inner]) + inner.start
        yield (mix(x[where] * seeds[0] + x[where + 1] * seeds[1] + x[where + 2] * seeds[2]) & np.uint64(buckets - 1)).astype(np.int64)


def counted(text: str | None, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a text and how often each occurs."""
    found = list(triples(text, buckets)) if text else []
    if len(found) > 1:
        sums = np.zeros(buckets, np.int64)
        for part in found:
            sums += np.bincount(part, minlength=buckets)
        at = np.flatnonzero(sums)
        return at, sums[at]
    return np.unique(found[0] if found else np.zeros(0, np.int64), return_counts=True)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


@dataclass(frozen=True)
class Languages:
    """Names, and the probability of each bucket in each language."""

    names: list[str]
    prior: np.ndarray
    chance: np.ndarray
    p: Mixture

    @staticmethod
    def of(counts: dict[str, np.ndarray], documents: dict[str, int], p: Mixture) -> Languages:
        names = sorted(counts)
        n = np.array([counts[x] for x in names], np.float64).reshape(len(names), -1 if names else p.buckets)
        chance = (n + p.smoothing) / (n + p.smoothing).sum(axis=1, keepdims=True)
        docs = np.array([documents[x] for x in names], np.float64) + 1
        return Languages(names, np.log(docs / docs.sum()), np.ascontiguousarray(chance.T.astype(np.float32)), p)

    @property
    def buckets(self) -> int:
        return len(self.chance)

    def proportions(self, chance: np.ndarray, n: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, float]:
        """EM from ``start``: the languages' proportions and the log-likelihood there."""
        share, total = start, n.sum()
        for _ in range(self.p.rounds):
            new = share * ((n / (chance @ share)) @ chance) / total
            done = np.abs(new - share).max() < self.p.close
            share = new
            if done:
                break
        return share, float(n @ np.log(chance @ share))

    def mixture(self, text: str | None) -> tuple[list[tuple[str, float]], float]:
        """``([(language, share)], certainty)``, largest share first; empty without letters.
        The certainty is the leading language's posterior against the languages left out."""
        if not self.names or not has_letter(text):
            return [], 0.0
        at, n = counted(text, self.buckets)
        n = n.astype(np.float64)
        chance, p = self.chance[at].astype(np.float64), self.p
        single = (n @ np.log(chance)) / p.overlap
        posterior = single + self.prior
        lead = int(posterior.argmax())
        chosen, share, value = [lead], np.ones(1), single[lead] * p.overlap
        cost = p.penalty * p.overlap * np.log(n.sum() + 1)
        while len(chosen) < min(len(self.names), p.most_languages):
            slope = (n / (chance[:, chosen] @ share)) @ chance / n.sum() - 1
            slope[chosen] = -np.inf
            more = int(slope.argmax())
            if slope[more] * n.sum() <= cost:  # the gain is below the slope: the likelihood is concave
                break
            trial = [*chosen, more]
            mixed, reached = self.proportions(chance[:, trial], n, np.append(share * 0.9, 0.1))
            if reached - value <= cost or mixed[-1] < p.least_share:
                break
            chosen, share, value = trial, mixed, reached
        share = share / share.sum()
        order = sorted(range(len(chosen)), key=lambda i: (-share[i], -posterior[chosen[i]], self.names[chosen[i]]))
        first = chosen[order[0]]
        rivals = posterior.copy()
        rivals[[i for i in chosen if i != first]] = -np.inf
        odds = np.exp(rivals - rivals.max())
        return [(self.names[chosen[i]], float(share[i])) for i in order], float(odds[first] / odds.sum())


_COUNTS = pa.schema([("lang", pa.string()), ("documents", pa.int64()), ("counts", pa.binary())])
#: Languages that a task counts before it passes them on.
HELD = 64


def _counts(buckets: int):
    pack = zstandard.compress

    def out(held):
        for lang, (documents, sums) in held.items():
            yield record(_COUNTS, [lang], [documents], [pack(sums.tobytes())])

    def run(source):
        held = {}
        for langs, texts in batches(source, ["lang", "text"], 500):
            for lang, text in zip(langs, texts, strict=True):
                if lang not in held:
                    if len(held) >= HELD:
                        yield from out(held)
                        held.clear()
                    held[lang] = [0, np.zeros(buckets, np.int64)]
                mine = held[lang]
                mine[0] += 1
                for part in triples(text or "", buckets):
                    mine[1] += np.bincount(part, minlength=buckets)
        yield from out(held)

    return run


def _summed(buckets: int):
    def run(source):
        held = {}
        for langs, documents, blobs in batches(source, ["lang", "documents", "counts"], 64):
            for lang, n, blob in zip(langs, documents, blobs, strict=True):
                mine = held.setdefault(lang, [0, np.zeros(buckets, np.int64)])
                mine[0] += n
                mine[1] += np.frombuffer(zstandard.decompress(blob), np.int64)
        for lang, (n, sums) in held.items():
            yield record(_COUNTS, [lang], [n], [zstandard.compress(sums.tobytes())])

    return run


def learn(docs: DataFrame, p: Mixture = Mixture(), held_out: tuple[int, int] = (4, 2), key: str = "doc_id", text: str = "text", lang: str = "lang") -> Languages:
    """From all documents with a language that are not held out (a null id is held out of
    learning). The model has ``buckets`` numbers a language; where that would pass
    ``most_bytes``, buckets are halved until it doesn't, so no language is left out."""
    may = bucket(docs[key].cast("long"), held_out[0]) != held_out[1]
    rows = docs.where(may & docs[lang].isNotNull()).select(docs[lang].cast("string").alias("lang"), docs[text].cast("string").alias("text"))
    n, buckets = rows.agg(F.approx_count_distinct("lang", 0.02)).first()[0], p.buckets
    while buckets > 256 and n * buckets * 8 > p.most_bytes:
        buckets //= 2
    parts = rows.mapInArrow(_counts(buckets), "lang string, documents long, counts binary")
    # Parts of a language meet in twelve tasks first, then in one, a sum at a time.
    kind = "lang string, documents long, counts binary"
    some = parts.withColumn("meets", F.spark_partition_id() % 12).repartition("lang", "meets").drop("meets").mapInArrow(_summed(buckets), kind)
    found = some.repartition("lang").mapInArrow(_summed(buckets), kind).collect()
    return Languages.of({r["lang"]: np.frombuffer(zstandard.decompress(r["counts"]), np.int64) for r in found}, {r["lang"]: r["documents"] for r in found}, p)


def predictions(docs: DataFrame, model: Languages, held_out: tuple[int, int] = (4, 2), key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, held_out, lang_pred, score, languages)`` for each row: the language of the
    largest share, that share times the certainty, and ``array<struct<lang, share>>``.

    A null text, one without a letter, and every text where no language was learned, is
    ``und`` with score 0. Equal texts get equal answers; repeated ids and rows stay, a null
    id is not held out, an empty table gives an empty result. A text is read whole, in parts.
    Ties go to the language with more documents, then to the first name. Other columns don't
    matter.
    """
    kind = "doc_id long, lang_pred string, score double, languages array<struct<lang:string,share:double>>"
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("languages", pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())])))])
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(source):
        for ids, texts in batches(source, ["doc_id", "text"], 500):
            found = [shipped.value.mixture(t) for t in texts]
            yield record(schema, ids, [m[0][0] if m else "und" for m, _ in found], [m[0][1] * sure if m else 0.0 for m, sure in found], [[{"lang": x, "share": s} for x, s in m] for m, _ in found])

    scored = docs.select(docs[key].cast("long").alias("doc_id"), docs[text].cast("string").alias("text")).mapInArrow(run, kind)
    out = F.coalesce(bucket(F.col("doc_id"), held_out[0]) == held_out[1], F.lit(False))
    return scored.select("doc_id", out.alias("held_out"), "lang_pred", "score", "languages")
