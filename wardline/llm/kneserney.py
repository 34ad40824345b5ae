"""Operator 1. Interpolated modified Kneser-Ney n-gram model, counted in Spark, kept as sorted hash arrays.

Tokens are words (runs of bytes other than 0x20 and 0x09-0x0D, A-Z in lower case) and one end for each
text. A word's id is its place in the vocabulary's sorted hashes. N-grams are summed in each task, dealt
out by their hash (so a frequent word or context does not fill one task), and summed again. From the
n-grams of one order come its contexts' statistics and the continuation counts of the order below.

Each order is a folder of raw files, one for each range of hashes. A file has its sorted hashes as a directory of
their next bits, with BUCKET of them in an entry on average, and the 32 bits after those; then the values, a byte each,
with a list of the few that need more. Spark writes the files to the shared folder; workers map those that
they are asked for into memory, OPEN_FILES at most at a time, and look up sorted queries. Where that folder is not a
mounted file system, Spark hands the files to each executor first (addFile), which needs local disk for the model.

Nothing is pruned or capped: all distinct n-grams count. N-grams are counted by hashes of 64 bits; a look-up finds
another n-gram's count with a chance of BUCKET in 2 ** 32. Null text: empty, so the end alone. A null doc_id counts as held out. No training text:
probability 1 / (V + 1) with V = 0. Every input row gives one row; repeated rows count repeatedly.
"""

from __future__ import annotations

import json
import os
import struct
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.llm.common import collect_garbage, doc_chunks, hashed_words, mix, new_path, pack, raw_files, remove, unpack

#: Tokens that a task gathers before it sums and sends them; text for each range of hashes.
FLUSH_TOKENS, RANGE_CHARS = 3_000_000, 16 << 20
END = np.uint64(0x5DEECE66D1234567)
_G = np.uint64(0x9E3779B97F4A7C15)
#: The id of the start of a text; words that the vocabulary lacks have UNKNOWN.
START, UNKNOWN = np.uint64(2**63), np.uint64(2**63 + 1)
#: Hashes of an entry of a file's directory, and files that a worker maps at a time.
BUCKET, OPEN_FILES = 16, 1_000


def gram_hashes(columns: list[np.ndarray]) -> np.ndarray:
    h = np.full(len(columns[0]), len(columns), np.uint64)
    for c in columns:
        h = mix(h * _G + c.astype(np.uint64) + np.uint64(1))
    return h


def ranges_of(chars: int, each: int) -> int:
    """A power of two, so that a hash's range is its highest bits."""
    return 1 << max(4, (max(1, -(-chars // each)) - 1).bit_length())


def _cuts(h: np.ndarray, ranges: int) -> np.ndarray:
    """Where each range begins in the sorted hashes (one more: the end)."""
    step = 64 - (ranges.bit_length() - 1)
    return np.append(np.searchsorted(h, np.arange(ranges, dtype=np.uint64) << np.uint64(step)), len(h))


def _slots(h: np.ndarray, ranges: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """For hashes of one range their place in a directory of ``bits`` bits, and the 32 bits that follow."""
    rest = h << np.uint64(ranges.bit_length() - 1)
    slot = (rest >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(h), np.int64)
    return slot, ((rest << np.uint64(bits)) >> np.uint64(32)).astype("<u4")


def array_file(h: np.ndarray, values: list[np.ndarray], ranges: int) -> bytes:
    """The file of a range's sorted hashes and their values.

    n, the directory's bits and the number of values as u64; the directory and the hashes' 32 bits as u32; for each value
    a byte each, 255 for those in its list: their number as u64, their places as u32, and they as u64.
    """
    bits = max(0, (len(h) // BUCKET).bit_length() - 1)
    slot, tail = _slots(h, ranges, bits)
    directory = np.searchsorted(slot, np.arange((1 << bits) + 1)).astype("<u4")
    out = [struct.pack("<3Q", len(h), bits, len(values)), directory.tobytes(), tail.tobytes()]
    for v in values:
        large = np.flatnonzero(v >= 255)
        out += [np.minimum(v, 255).astype(np.uint8).tobytes(), struct.pack("<Q", len(large)), large.astype("<u4").tobytes(), v[large].astype("<u8").tobytes()]
    return b"".join(out)


class HashFile:
    """A file mapped into memory."""

    def __init__(self, raw: np.ndarray, ranges: int):
        self.raw, self.at, self.ranges = raw, 0, ranges
        self.n, self.bits, columns = (int(x) for x in self._next(3, "<u8"))
        self.directory, self.tail = self._next((1 << self.bits) + 1, "<u4"), self._next(self.n, "<u4")
        self.values = []
        for _ in range(columns):
            small = self._next(self.n, "u1")
            (large,) = self._next(1, "<u8").tolist()
            self.values.append((small, self._next(large, "<u4"), self._next(large, "<u8")))

    def _next(self, n: int, kind: str) -> np.ndarray:
        size = n * np.dtype(kind).itemsize
        self.at += size
        return self.raw[self.at - size : self.at].view(kind)

    def value(self, column: int, places: np.ndarray) -> np.ndarray:
        small, where, large = self.values[column]
        out = small[places].astype(np.int64)
        more = np.flatnonzero(out == 255)
        if len(more):
            out[more] = large[np.searchsorted(where, places[more])]
        return out

    def find(self, q: np.ndarray) -> np.ndarray:
        """The places of hashes, -1 where they are absent."""
        if not self.n:
            return np.full(len(q), -1, np.int64)
        slot, tail = _slots(q, self.ranges, self.bits)
        low, high = (self.directory[slot + k].astype(np.int64) for k in (0, 1))
        end = high
        while (open_ := low < high).any():
            middle = (low + high) >> 1
            less = open_ & (self.tail[np.minimum(middle, self.n - 1)] < tail)
            low, high = np.where(less, middle + 1, low), np.where(less, high, np.minimum(high, middle))
        return np.where((low < end) & (self.tail[np.minimum(low, self.n - 1)] == tail), low, -1)


class HashArrays:
    """The files of one table; ``sizes``: how many hashes each has, where places in the whole table are wanted."""

    def __init__(self, folder: str, ranges: int, values: int, sizes: np.ndarray | None = None):
        self.folder, self.ranges, self.width = folder, ranges, values
        self.before = np.zeros(ranges, np.int64) if sizes is None else np.cumsum(sizes) - sizes
        self.files: dict[int, HashFile | None] = {}

    def file(self, r: int) -> HashFile | None:
        """The file of a range, None if it has no hash; the one that was mapped first makes room."""
        if r not in self.files:
            if len(self.files) >= OPEN_FILES:
                del self.files[next(iter(self.files))]
            at = f"{self.folder}/range={r}"
            parts = [f for f in os.listdir(at) if f.startswith("part-")] if os.path.isdir(at) else []
            self.files[r] = HashFile(np.memmap(f"{at}/{parts[0]}", np.uint8, "r"), self.ranges) if parts else None
        return self.files[r]

    def find(self, q: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """For sorted hashes their places in the whole table (-1: absent) and their values (0 if absent)."""
        place = np.full(len(q), -1, np.int64)
        out = [np.zeros(len(q), np.int64) for _ in range(self.width)]
        cuts = _cuts(q, self.ranges)
        for r in np.flatnonzero(np.diff(cuts)).tolist():
            a, b = cuts[r], cuts[r + 1]
            if (file := self.file(r)) is None:
                continue
            at = file.find(q[a:b])
            hit = at >= 0
            place[a:b][hit] = at[hit] + self.before[r]
            for k, o in enumerate(out):
                o[a:b][hit] = file.value(k, at[hit])
        return place, out

    def get(self, q: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """As find(), for hashes in any order."""
        u, back = np.unique(q, return_inverse=True)
        place, values = self.find(u)
        return place[back], [v[back] for v in values]


def local_folder(path: str) -> str:
    """Where a worker finds the shared folder's ``path``."""
    if path.startswith("file:"):
        return "/" + path.removeprefix("file:").lstrip("/")
    if path.startswith("/"):
        return path
    from pyspark import SparkFiles

    return SparkFiles.get(path.rpartition("/")[2])


def _hand_out(spark: SparkSession, path: str) -> None:
    """Make the folder ``path``, whose last name is unique, one that local_folder() finds on each executor."""
    if not path.startswith(("file:", "/")):
        spark.sparkContext.addFile(path, recursive=True)


def held_out(doc_id: str = "doc_id", of: int = 10) -> Column:
    """True if crc32 of the doc_id as text is divisible by ``of``."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % of == 0


@dataclass
class Model:
    """What a worker needs: where the tables lie, and each order's discounts."""

    path: str
    order: int
    word_ranges: int
    #: for each range of words how many there are
    word_sizes: np.ndarray
    ranges: int
    tokens: int
    words: int
    #: for each order its discounts for counts 1, 2 and more, and for order 1 the total and the weight below
    discounts: dict[int, tuple[float, float, float]]
    total: float
    below: float

    def table(self, name: str) -> str:
        return f"{self.path}-{name}"


def discounts_of(n: list[int]) -> tuple[float, float, float]:
    """Of the modified method, from how many n-grams have counts 1 to 4; fixed ones where they can't be had."""
    if min(n[:4]) > 0:
        y = n[0] / (n[0] + 2 * n[1])
        d = tuple(k - (k + 1) * y * n[k] / n[k - 1] for k in (1, 2, 3))
        if all(0 <= x <= k for k, x in zip((1, 2, 3), d)):
            return d
    return 0.5, 1.0, 1.5


def _discount(c: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
    return np.where(c >= 3, d[2], np.where(c == 2, d[1], np.where(c == 1, d[0], 0.0)))


# --- counting ------------------------------------------------------------------------------------


def _rows(columns: dict[str, list], kinds: dict[str, pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[k], v) for k, v in kinds.items()], list(kinds))


def _count_words(docs: DataFrame, ranges: int, path: str) -> None:
    """Files of the vocabulary: hash, count."""
    kinds = {"range": pa.int32(), "h": pa.binary(), "c": pa.binary()}

    def gather(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            h, back = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            c = np.bincount(back, np.concatenate([p[1] for p in parts])).astype(np.uint64)
            cuts = _cuts(h, ranges)
            some = np.flatnonzero(np.diff(cuts))
            return _rows({"range": some, "h": [pack(h[cuts[r] : cuts[r + 1]]) for r in some], "c": [pack(c[cuts[r] : cuts[r + 1]], False) for r in some]}, kinds)

        for _, texts in doc_chunks(batches):
            h, _ = hashed_words([t.lower() for t in texts])
            u, c = np.unique(np.append(h, np.full(len(texts), END)), return_counts=True)
            parts.append((u, c))
            size += len(u)
            if size >= FLUSH_TOKENS:
                yield flush()
                parts, size = [], 0
        if parts:
            yield flush()

    def merge(rows: pa.Table) -> pa.Table:
        h = np.concatenate([unpack(b, "<u8") for b in rows.column("h").to_pylist()])
        c = np.concatenate([unpack(b, "<u8", False) for b in rows.column("c").to_pylist()])
        u, back = np.unique(h, return_inverse=True)
        c = np.bincount(back, c).astype("<u8")
        return pa.table({"range": pa.array([rows.column("range")[0].as_py()], pa.int32()), "words": pa.array([len(u)], pa.int64()), "tokens": pa.array([int(c.sum())], pa.int64()), "data": pa.array([array_file(u, [c], ranges)], pa.binary())})

    raw_files(docs.select("text").mapInArrow(gather, "range int, h binary, c binary").groupBy("range").applyInArrow(merge, "range int, words bigint, tokens bigint, data binary"), "data", "range", path=path)


def _word_ids(vocabulary: HashArrays, h: np.ndarray) -> np.ndarray:
    place, _ = vocabulary.get(h)
    return np.where(place < 0, UNKNOWN, place.astype(np.uint64))


def _padded(ids: np.ndarray, first: np.ndarray, end: np.uint64, order: int) -> tuple[list[np.ndarray], np.ndarray]:
    """The columns of all n-grams that predict a token, and where each text's tokens start (one more: the end)."""
    words = np.diff(first)
    tokens = np.concatenate([[0], np.cumsum(words + 1)])
    flat = np.full(tokens[-1] + (order - 1) * len(words), START)
    doc = np.repeat(np.arange(len(words)), words)
    begin = tokens[:-1] + (order - 1) * np.arange(1, len(words) + 1)
    flat[begin[doc] + np.arange(first[0], first[-1]) - first[doc]] = ids
    flat[begin + words] = end
    of = np.repeat(np.arange(len(words)), words + 1)
    at = np.arange(tokens[-1]) + (order - 1) * (of + 1)
    return [flat[at - k] for k in range(order - 1, -1, -1)], tokens


_GRAMS = {"range": pa.int32(), "ids": pa.list_(pa.binary()), "c": pa.list_(pa.binary())}
_GRAM_SCHEMA = "range int, ids array<binary>, c array<binary>"


def _gram_rows(columns: list[np.ndarray], values: list[np.ndarray], ranges: int) -> dict[str, list]:
    """Rows for each range of hashes, the values of equal grams summed."""
    u, first, back = np.unique(gram_hashes(columns), return_index=True, return_inverse=True)
    sums = [np.bincount(back, v).astype(np.uint64) for v in values]
    cuts = _cuts(u, ranges)
    some = np.flatnonzero(np.diff(cuts))
    # in a range by their first words, which then take few bytes
    order = np.lexsort((*[x[first] for x in columns[1::-1]], np.repeat(np.arange(ranges), np.diff(cuts))))
    columns, sums = [x[first[order]] for x in columns], [v[order] for v in sums]
    packed = lambda parts, r, ascending: [pack(x[cuts[r] : cuts[r + 1]], ascending and k == 0) for k, x in enumerate(parts)]
    return {"range": some, "ids": [packed(columns, r, True) for r in some], "c": [packed(sums, r, False) for r in some]}


def _read_grams(rows: pa.Table) -> tuple[list[np.ndarray], list[np.ndarray]]:
    ids = [[unpack(b, "<u8", k == 0) for k, b in enumerate(row)] for row in rows.column("ids").to_pylist()]
    values = [[unpack(b, "<u8", False) for b in row] for row in rows.column("c").to_pylist()]
    return [np.concatenate(x) for x in zip(*ids)], [np.concatenate(x) for x in zip(*values)]


def _grams(docs: DataFrame, vocabulary_path: str, word_sizes: np.ndarray, ranges: int, order: int) -> DataFrame:
    def gather(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = HashArrays(local_folder(vocabulary_path), len(word_sizes), 1, word_sizes)
        (end,) = _word_ids(vocabulary, np.array([END]))
        parts: list[list[np.ndarray]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            columns = [np.concatenate(x) for x in zip(*parts)]
            return _rows(_gram_rows(columns, [np.ones(len(columns[0]))], ranges), _GRAMS)

        for _, texts in doc_chunks(batches):
            h, first = hashed_words([t.lower() for t in texts])
            columns, _ = _padded(_word_ids(vocabulary, h), first, end, order)
            parts.append(columns)
            size += len(columns[0])
            if size >= FLUSH_TOKENS // order:
                yield flush()
                parts, size = [], 0
        if parts:
            yield flush()

    return docs.select("text").mapInArrow(gather, _GRAM_SCHEMA)


def _count_grams(grams: DataFrame, order: int, ranges: int, path: str) -> None:
    """From rows of grams: their files, and rows of their contexts' and suffixes' statistics, by kind below ``path``."""

    def merge(rows: pa.Table) -> pa.Table:
        import pickle

        columns, (c,) = _read_grams(rows)
        u, first, back = np.unique(gram_hashes(columns), return_index=True, return_inverse=True)
        c = np.bincount(back, c).astype(np.int64)
        columns = [x[first] for x in columns]
        stat = [int((c == k).sum()) for k in (1, 2, 3, 4)] + [int((c >= 3).sum()), int(c.sum())]
        out = [("counts", array_file(u, [c], ranges)), ("stats", json.dumps(stat).encode())]
        if order > 1:
            # a suffix at the start of a text can't be preceded by other words: its own count stands
            below = {"contexts": _gram_rows(columns[:-1], [c, c == 1, c == 2, c >= 3], ranges), "suffixes": _gram_rows(columns[1:], [np.where(columns[1] == START, c, 1)], ranges)}
            out += [(kind, pickle.dumps([(int(r), i, x) for r, i, x in zip(part["range"], part["ids"], part["c"])])) for kind, part in below.items()]
        r = rows.column("range")[0].as_py()
        return pa.table({"kind": [k for k, _ in out], "range": pa.array([r] * len(out), pa.int32()), "data": pa.array([x for _, x in out], pa.binary())})

    raw_files(grams.groupBy("range").applyInArrow(merge, "kind string, range int, data binary"), "data", "kind", "range", path=path)


def _sent(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """The rows that the tasks of _count_grams() left for the next deal."""

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pickle

        for batch in batches:
            for data in batch.column("content").to_pylist():
                rows = pickle.loads(data)  # written by this job a step before
                yield _rows({k: [r[i] for r in rows] for i, k in enumerate(_GRAMS)}, _GRAMS)

    return spark.read.format("binaryFile").load(f"{path}/kind={kind}/*/*.txt").select("content").mapInArrow(read, _GRAM_SCHEMA)


def _count_contexts(spark: SparkSession, path: str, to: str, ranges: int) -> None:
    """Files of contexts: hash, the total of their counts, and how many n-grams that begin with them have counts 1, 2 and more."""

    def merge(rows: pa.Table) -> pa.Table:
        columns, values = _read_grams(rows)
        u, back = np.unique(gram_hashes(columns), return_inverse=True)
        sums = [np.bincount(back, v).astype(np.int64) for v in values]
        return pa.table({"range": pa.array([rows.column("range")[0].as_py()], pa.int32()), "data": pa.array([array_file(u, sums, ranges)], pa.binary())})

    raw_files(_sent(spark, path, "contexts").groupBy("range").applyInArrow(merge, "range int, data binary"), "data", "range", path=to)


def fit(training: DataFrame, order: int = 2) -> Model:
    """Count ``training(text)`` and write the model's tables to the shared folder."""
    if order < 2:
        raise ValueError("order must be 2 or more")
    spark = training.sparkSession
    path = new_path(spark, uuid.uuid4().hex)
    chars = training.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    word_ranges, ranges = ranges_of(chars, 4 * RANGE_CHARS), ranges_of(chars, RANGE_CHARS)
    if training.isEmpty():
        return Model(path, order, word_ranges, np.zeros(word_ranges, np.int64), ranges, 0, 0, {}, 0.0, 1.0)
    _count_words(training, word_ranges, f"{path}-words")
    sizes, tokens = _vocabulary_size(spark, f"{path}-words", word_ranges)
    _hand_out(spark, f"{path}-words")
    found: dict[int, tuple[float, float, float]] = {}
    grams = _grams(training, f"{path}-words", sizes, ranges, order)
    for k in range(order, 0, -1):
        _count_grams(grams, k, ranges, f"{path}-order{k}")
        stat = spark.read.text(f"{path}-order{k}/kind=stats/*/*.txt").where("value != ''").select(F.from_json("value", "array<bigint>").alias("s"))  # one line a range
        n1, n2, n3, n4, more, total = stat.agg(*[F.sum(F.col("s")[i]) for i in range(6)]).first()
        found[k] = discounts_of([n1, n2, n3, n4])
        if k < order:
            remove(spark, f"{path}-order{k + 1}/kind=suffixes")
        collect_garbage(spark)  # what was dealt out for this order leaves the executors' disks
        if k > 1:
            _count_contexts(spark, f"{path}-order{k}", f"{path}-contexts{k}", ranges)
            remove(spark, f"{path}-order{k}/kind=contexts")
            collect_garbage(spark)
            grams = _sent(spark, f"{path}-order{k}", "suffixes")
    d = found[1]
    return Model(path, order, word_ranges, sizes, ranges, tokens, int(sizes.sum()), found, float(total), (d[0] * n1 + d[1] * n2 + d[2] * more) / total)


def _vocabulary_size(spark: SparkSession, path: str, ranges: int) -> tuple[np.ndarray, int]:
    """How many words each range has (a number a range), and how many tokens there are in all."""

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r, data in zip(batch.column("range").to_pylist(), batch.column("content")):
                file = HashFile(np.frombuffer(data.as_buffer(), np.uint8), ranges)
                yield _rows({"range": [r], "words": [file.n], "tokens": [int(file.value(0, np.arange(file.n)).sum())]}, {"range": pa.int32(), "words": pa.int64(), "tokens": pa.int64()})

    files = spark.read.format("binaryFile").load(f"{path}/*/*.txt").select(F.regexp_extract("path", r"range=(\d+)", 1).cast("int").alias("range"), "content")
    sizes, tokens = np.zeros(ranges, np.int64), 0
    for r in files.mapInArrow(read, "range int, words bigint, tokens bigint").collect():
        sizes[r["range"]], tokens = r["words"], tokens + r["tokens"]
    return sizes, tokens


# --- scoring -------------------------------------------------------------------------------------


class Scorer:
    """A model's tables as a worker sees them."""

    def __init__(self, m: Model):
        self.m = m
        self.words = HashArrays(local_folder(m.table("words")), m.word_ranges, 1, m.word_sizes)
        self.counts = {k: HashArrays(local_folder(m.table(f"order{k}")) + "/kind=counts", m.ranges, 1) for k in range(1, m.order + 1)}
        self.contexts = {k: HashArrays(local_folder(m.table(f"contexts{k}")), m.ranges, 4) for k in range(2, m.order + 1)}

    def probabilities(self, columns: list[np.ndarray]) -> np.ndarray:
        """Of the last column's words after the others."""
        m = self.m
        p = np.full(len(columns[0]), 1 / (m.words + 1))
        if not m.words:
            return p
        for k in range(1, m.order + 1):
            h = gram_hashes(columns[m.order - k :])
            _, (c,) = self.counts[k].get(h)
            c = c.astype(np.float64)
            rest = c - _discount(c, m.discounts[k])
            if k == 1:
                p = rest / m.total + m.below * p
                continue
            _, (total, one, two, more) = self.contexts[k].get(gram_hashes(columns[m.order - k : -1]))
            d, seen = m.discounts[k], total > 0
            p = np.where(seen, (rest + (d[0] * one + d[1] * two + d[2] * more) * p) / np.where(seen, total, 1), p)
        return p

    def score(self, texts: list[bytes]) -> tuple[np.ndarray, ...]:
        """Tokens, known tokens, base and score of each text."""
        m = self.m
        h, first = hashed_words([t.lower() for t in texts])
        place, (c,) = self.words.get(np.append(h, END))
        ids = np.where(place < 0, UNKNOWN, place.astype(np.uint64))
        columns, at = _padded(ids[:-1], first, ids[-1], m.order)
        p = np.log10(self.probabilities(columns))
        # the counts in the order of the tokens: each text's words, then the end
        words = np.diff(first)
        count = np.full(at[-1], c[-1], np.float64)
        doc = np.repeat(np.arange(len(words)), words)
        count[at[doc] + np.arange(first[0], first[-1]) - first[doc]] = c[:-1]
        base = np.log10((count + 0.1) / (m.tokens + 0.1 * (m.words + 1)))
        sums = lambda x: np.add.reduceat(x, at[:-1])  # noqa: E731  each text has one token at least
        return np.diff(at), sums((count > 0).astype(np.int64)), sums(base), sums(p)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id``, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score``, ``perplexity``."""
    spark = docs.sparkSession
    for k in range(1, model.order + 1) if model.words else ():
        _hand_out(spark, model.table(f"order{k}"))
        if k > 1:
            _hand_out(spark, model.table(f"contexts{k}"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch, texts in doc_chunks(batches):
            n, known, base, s = scorer.score(texts)
            names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array(np.full(len(n), model.tokens), pa.int64()), pa.array(base), pa.array(s), pa.array(10 ** np.minimum(-s / n, 300.0))], names)

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(run, f"doc_id {kind}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double, perplexity double")


def language_model_scores(docs: DataFrame, order: int = 2) -> DataFrame:
    """Learn from the documents that are not held out, and score all."""
    return score(docs, fit(docs.where(~held_out()).select("text"), order))
