"""Operator 7. SentencePiece encoding and decoding by a table of distinct chunks.

A chunk is a run of whitespace markers with the characters up to the next marker. Where no piece of
the model has a marker behind another character, no merge crosses a chunk's start, so a text's ids are
its chunks' ids in order: each distinct chunk is segmented once (a table that a worker keeps, bounded
by TABLE_ROWS and halved beyond it), and ids are joined back by position. A model that breaks
the condition is served by whole texts.

Null text: empty. An empty text has the end id alone. Every input row gives one row.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame

from wardline.functions.shipping import ship

#: Rows that a worker's chunk table holds at most between batches; beyond it is halved, which changes no result.
TABLE_ROWS = 150_000
MARK = "▁"
_CHUNK = re.compile(f"{MARK}+[^{MARK}]*")


_pieces: dict[bytes, Pieces] = {}


class Pieces:
    """A model with its table of distinct chunks: ids as text, and the chunk as decoded."""

    @classmethod
    def of(cls, model: bytes) -> Pieces:
        """The worker's table for this model, made once."""
        if model not in _pieces:
            _pieces.clear()
            _pieces[model] = cls(model)
        return _pieces[model]

    def __init__(self, model: bytes):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.table: dict[str, tuple[str, str]] = {}
        ids = range(self.sp.get_piece_size())
        self.apart = not any(MARK in p.lstrip(MARK) for p in map(self.sp.id_to_piece, ids)) and self._keeps_all()

    def _keeps_all(self) -> bool:
        """True if the model changes nothing but spaces to markers and adds one in front."""
        probes = ("a b", "  x  y ", "éﬁ\t\n z", "A")
        return all(self.sp.decode(self.sp.encode(p)) == p for p in probes)

    @staticmethod
    def chunks(text: str) -> list[str]:
        """The text's chunks, each without its first marker and with spaces for the others."""
        if not text:
            return []
        if "  " not in text and MARK not in text and text[0] != " " and text[-1] != " ":
            return text.split(" ")
        marked = MARK + text.replace(" ", MARK)
        return [c[1:].replace(MARK, " ") for c in _CHUNK.findall(marked)]

    def learn(self, texts: list[list[str]]) -> None:
        """Segment the chunks of these texts that the table lacks."""
        if len(self.table) > TABLE_ROWS:
            # the chunks met first are the most frequent
            self.table = dict(islice(self.table.items(), TABLE_ROWS // 2))
        new = {c for t in texts for c in t}.difference(self.table)
        if "" in new:  # a marker alone: the library would take it for an empty text
            new.remove("")
            self.table[""] = (str(self.sp.piece_to_id(MARK)), "")
        keys = list(new)
        ids = self.sp.encode(keys, num_threads=1)
        for key, i, back in zip(keys, ids, self.sp.decode(ids, num_threads=1) if ids else []):
            self.table[key] = (" ".join(map(str, i)), back)

    def encode(self, texts: list[str]) -> Iterator[tuple[str, str]]:
        """For each text its decimal ids joined by a space, the end id last, and the decoded text."""
        end = str(self.sp.eos_id())
        if not self.apart:
            for t in texts:
                ids = self.sp.encode(t, add_eos=True)
                yield " ".join(map(str, ids)), self.sp.decode(ids)
            return
        split = [self.chunks(t) for t in texts]
        self.learn(split)
        table = self.table
        for chunks in split:
            rows = [table[c] for c in chunks]
            # a decoded chunk lacks its first space, which decode() strips from the text's start alone
            yield " ".join([r[0] for r in rows] + [end]), " ".join([r[1] for r in rows])


def _slices(batches: Iterable[pa.RecordBatch], rows: int = 500, limit: int = 1 << 22) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    for batch in batches:
        texts = [t or "" for t in batch.column("text").to_pylist()]
        i = 0
        while i < len(texts):
            j, size = i + 1, len(texts[i])
            while j < len(texts) and j - i < rows and size + len(texts[j]) <= limit:
                size += len(texts[j])
                j += 1
            yield batch.slice(i, j - i), texts[i:j]
            i = j


def model_bytes(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def sentencepiece_encode(docs: DataFrame, model: str) -> DataFrame:
    """``doc_id``, ``ids`` (array<int>, the end id last) and ``decoded`` for each row of ``docs(doc_id, text)``."""
    ship(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model_bytes(model))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces.of(sent.value)
        for batch, texts in _slices(batches):
            ids, back = zip(*pieces.encode(texts))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([[int(x) for x in i.split(" ")] for i in ids], pa.list_(pa.int32())), pa.array(back, pa.string())], ["doc_id", "ids", "decoded"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, ids array<int>, decoded string")


def sentencepiece_digest(docs: DataFrame, model: str) -> DataFrame:
    """``doc_id``, ``n_tokens``, ``ids_sha256`` and ``decoded_sha256`` for each row of ``docs(doc_id, text)``."""
    ship(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model_bytes(model))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces.of(sent.value)
        sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
        for batch, texts in _slices(batches):
            rows = [(i.count(" ") + 1, sha(i), sha(back)) for i, back in pieces.encode(texts)]
            n, a, b = zip(*rows)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
