"""Operator 9. Secret scans with multipart credential linking.

Base spans come from three patterns (assignments, access identifiers, long hexadecimal runs). Beside
them stand weak candidates: short assigned values, short access identifiers, account names, tokens of
mixed characters, and endpoints. Weak ones are reported only where complementary parts meet: within one
scope (SCOPE code points between two spans of a document) a secret part must have an identifier or an
endpoint near, and an identifier or endpoint must have a secret part near. The join runs over sorted
spans with two bounds that only move forward, so its cost is linear and no pairs are formed.

Null or empty text has no spans. Offsets are code points, the end exclusive. Every input row gives one row.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from wardline.functions.shipping import ship

#: Code points between the parts of one credential at most.
SCOPE = 200
KINDS = ("assign", "access", "hex", "weak_secret", "weak_id", "endpoint")

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")
_ACCOUNT = re.compile(r"""\b(?:user(?:_?name)?|login|account(?:_?id)?|client_?id)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.@-]{3,})""", re.I | re.A)
_MIXED = re.compile(r"(?<![A-Za-z0-9+/_=.-])[A-Za-z0-9+/_-]{20,}={0,2}(?![A-Za-z0-9+/_=.-])")
_ENDPOINT = re.compile(r"(?:https?|ftp|postgres|postgresql|mysql|redis|amqp|mongodb)://[^\s\"'<>]+|(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?::\d{1,5})?(?![\w.])", re.I | re.A)
_KEYWORD = re.compile(r"passw|secret|token|api_?key", re.I | re.A)

Span = tuple[int, int, int]  # start, kind's place in KINDS, end


def base_spans(text: str) -> tuple[list[Span], list[Span]]:
    """The base spans, and the matches that were too short to be one (weak candidates)."""
    base: list[Span] = []
    weak: list[Span] = []
    if _KEYWORD.search(text):
        for m in _ASSIGN.finditer(text):
            (base if m.end(2) - m.start(2) >= 8 else weak).append((m.start(), 0 if m.end(2) - m.start(2) >= 8 else 3, m.end()))
    if "AKIA" in text:
        for m in _ACCESS.finditer(text):
            (base if m.end() - m.start() >= 16 else weak).append((m.start(), 1 if m.end() - m.start() >= 16 else 4, m.end()))
    base += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return base, weak


def weak_spans(text: str, base: list[Span]) -> list[Span]:
    """Account names, mixed tokens and endpoints; those that overlap a base span add nothing and are left out."""
    weak = [(m.start(), 4, m.end()) for m in _ACCOUNT.finditer(text)] if "=" in text or ":" in text else []
    for m in _MIXED.finditer(text):
        t = m[0]
        if any("0" <= c <= "9" for c in t) and any("A" <= c <= "Z" for c in t) and any("a" <= c <= "z" for c in t):
            weak.append((m.start(), 3, m.end()))
    if "://" in text or "." in text:
        weak += [(m.start(), 5, m.end()) for m in _ENDPOINT.finditer(text)]
    if not weak or not base:
        return weak
    # spans of base sorted by start; their ends so far tell whether any covers a point
    order = sorted(base)
    starts = np.array([s for s, _, _ in order])
    ends = np.maximum.accumulate([e for _, _, e in order])
    return [w for w in weak if (k := int(np.searchsorted(starts, w[2]))) == 0 or ends[k - 1] <= w[0]]


def near(spans: list[Span], others: list[Span], scope: int) -> list[bool]:
    """For each span whether some span of ``others`` begins or ends within ``scope`` of it."""
    if not spans or not others:
        return [False] * len(spans)
    other = sorted(others)
    starts = np.array([s for s, _, _ in other])
    ends = np.maximum.accumulate([e for _, _, e in other])
    upto = np.searchsorted(starts, [e + scope for _, _, e in spans], side="right")
    return [bool(k) and bool(ends[k - 1] + scope >= s) for k, (s, _, _) in zip(upto, spans)]


def linked(base: list[Span], weak: list[Span], scope: int = SCOPE) -> list[Span]:
    """The weak candidates that have a complementary part, weak or base, in their scope."""
    if not weak:
        return []
    secrets = [x for x in base if x[1] in (0, 2)] + [x for x in weak if x[1] == 3]
    others = [x for x in base if x[1] == 1] + [x for x in weak if x[1] in (4, 5)]
    own, part = [x for x in weak if x[1] == 3], [x for x in weak if x[1] in (4, 5)]
    return [x for x, ok in zip(own, near(own, others, scope)) if ok] + [x for x, ok in zip(part, near(part, secrets, scope)) if ok]


def listed(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


def find(text: str, scope: int = SCOPE) -> tuple[list[Span], list[Span]]:
    """The base spans of a text and the linked ones that the method adds."""
    base, short = base_spans(text)
    return base, linked(base, short + weak_spans(text, base), scope)


def secret_spans(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """For each row of ``docs(doc_id, text)``: doc_id and ``spans`` array<struct<kind, start, end, value>> by start."""
    ship(docs.sparkSession)
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for t in batch.column("text").to_pylist():
                base, more = find(t or "", scope)
                out.append([{"kind": KINDS[k], "start": s, "end": e, "value": t[s:e]} for s, k, e in sorted(base + more)])
            spans = pa.array(out, pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.string())])))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), spans], ["doc_id", "spans"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, spans array<struct<kind: string, start: bigint, end: bigint, value: string>>")


def secret_digest(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """Counts and lists of spans for each row of ``docs(doc_id, text)``, without the secrets themselves."""
    ship(docs.sparkSession)
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, shas, spans, added = [], [], [], []
            for t in batch.column("text").to_pylist():
                base, more = find(t or "", scope)
                n.append([sum(x[1] == k for x in base) for k in range(3)])
                shas.append(hashlib.sha256(listed(base).encode()).hexdigest())
                spans.append(listed(base + more))
                added.append(len(more))
            counts = [pa.array(c, pa.int64()) for c in zip(*n)] if n else [pa.array([], pa.int64())] * 3
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *counts, pa.array(shas, pa.string()), pa.array(spans, pa.string()), pa.array(added, pa.int64())], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_linked"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, n_linked bigint")
