"""Operator 5. Language identification by bit-sliced Bloom filters of n-grams.

One array of masks serves all languages: a slot has a bit for each language, an n-gram sets its language's
bit in PROBES slots, and the bitwise AND of its slots gives all languages that contain it at once. A text's
n-grams are looked up together; for each language the hits are counted and corrected for the false positives
that the share of its bits that are set leads to; the largest corrected count decides.

A language contains the n-grams (four bytes of UTF-8, A-Z in lower case, all ASCII but letters as one space)
that make up at least LEAST_SHARE of its training n-grams, so a filter has at most 1 / LEAST_SHARE n-grams a
language, however large the corpus. Counts cover all training rows: non-null lang, crc32(doc_id) mod 5 not 0.

Null text and texts without a letter: ``und`` with score 0. Equal counts: the language with more training
rows, then by name. A null doc_id counts as held out. No training rows: ``und``. Every input row gives one row.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.functions.shipping import ship
from wardline.llm.common import doc_chunks, mix
from wardline.llm.kneserney import held_out

LEAST_SHARE = 2e-6
PROBES, SLOTS_PER_GRAM = 3, 8
#: Languages beyond which lang is taken for something else than a language.
MOST_LANGUAGES = 4096
_PLAIN = np.full(256, 0x20, np.uint8)
_PLAIN[ord("a") : ord("z") + 1] = _PLAIN[ord("A") : ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)
_PLAIN[0x80:] = np.arange(0x80, 0x100)


def has_letter(text: str | None) -> bool:
    """Whether a character is a letter by its Unicode category; numerals of any kind are none."""
    return any(map(str.isalpha, text or ""))


def grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The four-byte n-grams of all texts as u4, and where each text's begin (one more: the end)."""
    data = b"".join(b"  " + t + b"  " for t in texts)
    a = _PLAIN[np.frombuffer(data, np.uint8)]
    keep = np.ones(len(a), bool)
    keep[1:] = (a[1:] != 0x20) | (a[:-1] != 0x20)  # runs of spaces are one
    at = np.concatenate([[0], np.cumsum([len(t) + 4 for t in texts])])
    keep[at[:-1]] = True
    place = np.concatenate([[0], np.cumsum(keep)])[at]
    a = np.append(a[keep], np.zeros(4, np.uint8))
    g = np.ndarray((max(len(a) - 4, 0),), "<u4", a.tobytes(), 0, (1,))
    # an n-gram lies in its text
    n = np.maximum(np.diff(place) - 3, 0)
    offset = np.concatenate([[0], np.cumsum(n)])
    doc = np.repeat(np.arange(len(texts)), n)
    return g[place[doc] + np.arange(offset[-1]) - offset[doc]], offset


@dataclass
class Filters:
    """Masks (slots x words of 64 bits), the languages of the bits, and each language's share of set bits."""

    languages: list[str]
    masks: np.ndarray
    fill: np.ndarray

    @classmethod
    def build(cls, languages: list[str], held: list[tuple[int, np.ndarray]]) -> Filters:
        size = 1 << max(10, (SLOTS_PER_GRAM * max([1, *(len(g) for _, g in held)]) - 1).bit_length())
        masks = np.zeros((size, -(-len(languages) // 64)), np.uint64)
        for k, g in held:
            for slot in cls.slots(g, size):
                np.bitwise_or.at(masks[:, k // 64], slot, np.uint64(1) << np.uint64(k % 64))
        fill = np.array([float(((masks[:, k // 64] >> np.uint64(k % 64)) & np.uint64(1)).mean()) for k in range(len(languages))])
        return cls(languages, masks, fill)

    @staticmethod
    def slots(g: np.ndarray, size: int) -> list[np.ndarray]:
        h = mix(g.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
        return [((h >> np.uint64(21 * k)) & np.uint64(size - 1)).astype(np.int64) for k in range(PROBES)]

    def hits(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Corrected counts (texts x languages) and the number of n-grams of each text."""
        g, at = grams(texts)
        n = np.diff(at)
        found = None
        for slot in self.slots(g, len(self.masks)):
            found = self.masks[slot] if found is None else found & self.masks[slot]
        out = np.zeros((len(texts), len(self.languages)))
        some = np.flatnonzero(n)
        if len(some):
            for k in range(len(self.languages)):
                bit = (found[:, k // 64] >> np.uint64(k % 64)).astype(np.uint8) & 1
                out[some, k] = np.add.reduceat(bit, at[some], dtype=np.int64)
        wrong = self.fill**PROBES
        return np.maximum((out - n[:, None] * wrong) / np.maximum(1 - wrong, 1e-9), 0), n


def fit(training: DataFrame) -> Filters:
    """Filters from ``training(text, lang)``; the driver gets at most 1 / LEAST_SHARE n-grams a language."""
    ship(training.sparkSession)
    training = training.where("lang is not null")
    rows = training.groupBy("lang").count().limit(MOST_LANGUAGES + 1).collect()
    if len(rows) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    languages = [r["lang"] for r in sorted(rows, key=lambda r: (-r["count"], r["lang"]))]
    number = {x: k for k, x in enumerate(languages)}

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def flush() -> pa.RecordBatch:
            u, back = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
            n = np.bincount(back, np.concatenate([c for _, c in held])).astype(np.int64)
            return pa.RecordBatch.from_arrays([pa.array((u >> np.uint64(32)).astype(np.int32)), pa.array((u & np.uint64(2**32 - 1)).astype(np.int64)), pa.array(n)], ["language", "gram", "n"])

        for batch, texts in doc_chunks(batches, limit=1 << 20):
            g, at = grams(texts)
            of = np.repeat(np.array([number[x] for x in batch.column("lang").to_pylist()], np.uint64), np.diff(at))
            held.append(np.unique((of << np.uint64(32)) | g, return_counts=True))
            if sum(len(k) for k, _ in held) > 2_000_000:
                yield flush()
                held = []
        if held:
            yield flush()

    counts = training.select("text", "lang").mapInArrow(count, "language int, gram bigint, n bigint").groupBy("language", "gram").agg(F.sum("n").alias("n"))
    totals = F.broadcast(counts.groupBy("language").agg(F.sum("n").alias("total")))  # a row a language
    kept = counts.join(totals, "language").where(F.col("n") >= F.col("total") * LEAST_SHARE).select("language", "gram").toPandas()
    return Filters.build(languages, [(int(k), x["gram"].to_numpy().astype(np.uint32)) for k, x in kept.groupby("language")])


def identify(docs: DataFrame, filters: Filters, keep: list[str] | None = None) -> DataFrame:
    """``docs``' columns ``keep`` with ``lang_pred``, ``score`` and ``coverage``.

    score: the language's share of the corrected counts of all; coverage: its share of the text's n-grams.
    """
    ship(docs.sparkSession)
    keep = keep or ["doc_id"]
    docs = docs.select(*keep, *[c for c in ("text",) if c not in keep])
    sent = docs.sparkSession.sparkContext.broadcast(filters)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = sent.value
        for batch, texts in doc_chunks(batches, limit=1 << 20):
            letters = np.array([has_letter(t) for t in batch.column("text").to_pylist()], bool)
            if f.languages:
                c, n = f.hits(texts)
                best = c.argmax(1)
                most, total = c.max(1), c.sum(1)
                score = np.where(total > 0, most / np.where(total > 0, total, 1), 1 / len(f.languages))
                names = [f.languages[k] if ok else "und" for k, ok in zip(best, letters)]
                coverage = np.minimum(most / np.maximum(n, 1), 1)
            else:
                names, score, coverage = ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
            out = [batch.column(k) for k in keep] + [pa.array(names, pa.string()), pa.array(np.where(letters, score, 0.0)), pa.array(np.where(letters, coverage, 0.0))]
            yield pa.RecordBatch.from_arrays(out, [*keep, "lang_pred", "score", "coverage"])

    schema = ", ".join(f"`{k}` {v}" for k, v in docs.select(*keep).dtypes)
    return docs.mapInArrow(run, f"{schema}, lang_pred string, score double, coverage double")


def accepted(docs: DataFrame, filters: Filters, least_coverage: float = 0.05, least_grams: int = 20) -> DataFrame:
    """The rows and columns of ``docs`` whose language is known.

    Rejected: ``und``, and texts of ``least_grams`` n-grams or more of which the best language covers less
    than ``least_coverage``.
    """
    ship(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(filters)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = sent.value
        for batch, texts in doc_chunks(batches, limit=1 << 20):
            keep = np.array([has_letter(t) for t in batch.column("text").to_pylist()], bool)
            if f.languages:
                c, n = f.hits(texts)
                keep &= (n < least_grams) | (c.max(1) >= least_coverage * n)
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)


def trained(docs: DataFrame) -> Filters:
    """Filters from the rows that are not held out."""
    return fit(docs.where(~held_out(of=5)).select("text", "lang"))


def language_id(docs: DataFrame) -> DataFrame:
    """Learn from the rows of ``docs(doc_id, text, lang)`` that are not held out, and predict all."""
    labelled = docs.select("doc_id", held_out(of=5).alias("held_out"), "text")
    return identify(labelled, trained(docs), ["doc_id", "held_out"])
