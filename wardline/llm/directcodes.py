"""Operator 8. Token ids as directly addressable codes.

A file holds whole documents in ascending doc_id order. A code is an id's place among the file's ids by
falling frequency; codes are cut into bytes: level 0 has the low byte of each; a continuation bitmap marks
the codes with more, whose next byte lies in level 1, and so on. A rank directory (ones before each block
of 512 bits) turns a position on one level into the position on the next, so any token is read with a few
look-ups and without decoding its neighbours.

Layout (little-endian): magic, documents, documents without a doc_id, tokens, levels, distinct ids as u64; the
distinct ids as u32 in the order of their codes; doc_ids as i64; each document's first token as u64 (one more: the
end); for each level its length as u64, its bytes, its bitmap as u64 words and its directory as u64 (lengths follow
from the level's).

All ids come from the tokenizers library. Where a specification is byte-level BPE without options, ids of a text are
those of its pre-tokens one after the other, so a worker keeps a table of the distinct pre-tokens that it has met, has
the library encode each once, and joins their ids. Texts with characters on whose classes regular expression engines
may disagree, or with special tokens, are encoded by the library whole, as are all texts under other specifications.

Null text: empty, so the end id alone. Rows with a null doc_id follow the others. Rows of one doc_id follow each
other by the hash of their text.
"""

from __future__ import annotations

import json
import os
import re
import struct
import unicodedata
import zlib
from collections.abc import Iterable, Iterator
from itertools import chain, islice, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wardline.llm.common import new_path, raw_files

MAGIC = 0x3343414457  # "WDAC3"
#: Characters of text that go to one range of doc_ids, and tokens after which a range starts another file.
RANGE_CHARS, FILE_TOKENS = 8 << 20, 4 << 20
_BLOCK = 512
#: Characters beyond which a text is encoded whole, and distinct pre-tokens beyond which a worker's table is halved.
_RARE = re.compile("[^\t\n\r\x20-\x7e\u00a1-\u00ac\u00ae-\u024f]")
TABLE_ROWS = 400_000
#: Words that the library encodes at a time.
LINE_WORDS = 2_000
#: Texts that are encoded at a time, and their bytes (a longer text is alone).
RUN_ROWS, RUN_BYTES = 500, 2 << 20


def encode_file(doc_ids: np.ndarray, starts: np.ndarray, ids: np.ndarray, without: int = 0) -> bytes:
    """The file of ``ids``; document k has ``ids[starts[k]:starts[k + 1]]``, and the last ``without`` have no doc_id."""
    count = np.zeros(int(ids.max(initial=0)) + 1, np.int64)
    for k in range(0, len(ids), 1 << 18):  # bincount() copies what it counts to longer integers
        part = np.bincount(ids[k : k + (1 << 18)])  # as long as the vocabulary
        count[: len(part)] += part
    names = np.flatnonzero(count)
    by_count = np.argsort(-count[names], kind="stable")
    code = np.zeros(len(count), np.uint32)
    code[names[by_count]] = np.arange(len(names), dtype=np.uint32)
    levels, rest = [], code[ids]
    while True:
        more = rest >= 256
        words = -(-len(rest) // _BLOCK) * (_BLOCK // 8)
        bits = np.zeros(words, np.uint8)
        packed = np.packbits(more, bitorder="little")
        bits[: len(packed)] = packed
        ones = np.bitwise_count(bits.view(np.uint64)).reshape(-1, _BLOCK // 64).sum(1, dtype=np.uint64)
        directory = np.concatenate([[0], np.cumsum(ones)]).astype("<u8")
        levels.append(struct.pack("<Q", len(rest)) + (rest & np.uint32(255)).astype(np.uint8).tobytes() + bits.tobytes() + directory.tobytes())
        if not more.any():
            break
        rest = rest[more] >> np.uint32(8)
    head = struct.pack("<6Q", MAGIC, len(doc_ids), without, len(ids), len(levels), len(names))
    return head + names[by_count].astype("<u4").tobytes() + doc_ids.astype("<i8").tobytes() + starts.astype("<u8").tobytes() + b"".join(levels)


class CodeFile:
    """Reads a file's bytes; ``file[i]`` is token i of the file."""

    def __init__(self, data: bytes):
        magic, docs, self.without, self.n, levels, names = struct.unpack_from("<6Q", data)
        if magic != MAGIC:
            raise ValueError("not a file of directly addressable codes")
        self.names = np.frombuffer(data, "<u4", names, 48)
        at = 48 + 4 * names
        self.doc_ids = np.frombuffer(data, "<i8", docs, at)
        self.starts = np.frombuffer(data, "<u8", docs + 1, at + 8 * docs).astype(np.int64)
        at += 16 * docs + 8
        self.levels = []
        for _ in range(levels):
            (size,) = struct.unpack_from("<Q", data, at)
            blocks = -(-size // _BLOCK)
            codes = np.frombuffer(data, np.uint8, size, at + 8)
            bits = np.frombuffer(data, np.uint8, blocks * (_BLOCK // 8), at + 8 + size)
            directory = np.frombuffer(data, "<u8", blocks + 1, at + 8 + size + len(bits))
            self.levels.append((codes, bits, directory))
            at += 8 + size + len(bits) + 8 * (blocks + 1)

    def __len__(self) -> int:
        return self.n

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        value, shift = 0, 0
        for codes, bits, directory in self.levels:
            value |= int(codes[i]) << shift
            if not bits[i >> 3] >> (i & 7) & 1:
                break
            block = i // _BLOCK
            before = bits[block * (_BLOCK // 8) : i >> 3]
            i = int(directory[block]) + int(np.bitwise_count(before).sum()) + (int(bits[i >> 3]) & ((1 << (i & 7)) - 1)).bit_count()
            shift += 8
        return int(self.names[value])

    def ids(self) -> np.ndarray:
        """All tokens of the file."""
        out = self.levels[0][0].astype(np.uint32)
        where = None
        for k, (codes, bits, _) in enumerate(self.levels):
            if k:
                out[where] |= codes.astype(np.uint32) << np.uint32(8 * k)
            more = np.unpackbits(bits, count=len(codes), bitorder="little").view(bool)
            where = np.flatnonzero(more) if where is None else where[more]
        return self.names[out]

    def document(self, k: int) -> np.ndarray:
        """The tokens of document k of the file, by look-ups."""
        return np.array([self[i] for i in range(self.starts[k], self.starts[k + 1])], np.uint64)


def _kinds(kind: str) -> str:
    """The characters up to U+024F of a general category, as part of a class."""
    return "".join(re.escape(chr(c)) for c in range(0x250) if unicodedata.category(chr(c))[0] == kind)


def _pre_tokens() -> re.Pattern[str]:
    """The pattern of byte-level pre-tokens, a fixed value, with the letters and numbers up to U+024F spelled out."""
    letters, numbers = _kinds("L"), _kinds("N")
    return re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{letters}]+| ?[{numbers}]+| ?[^\s{letters}{numbers}]+|\s+(?!\S)|\s+")


_encoders: dict[str, Encoder] = {}


class Encoder:
    """A tokenizer with a table of the pre-tokens that it has encoded."""

    def __init__(self, spec: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        parts = json.loads(spec)
        self.special = [a["content"] for a in parts["added_tokens"]]
        model, split = parts["model"], {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
        # what could tie a pre-token's ids to its neighbours, or make them random
        options = (parts["normalizer"], parts.get("truncation"), parts.get("padding"), model.get("dropout"), model.get("continuing_subword_prefix"), model.get("end_of_word_suffix"))
        self.apart = model["type"] == "BPE" and parts["pre_tokenizer"] == split and not any(options)
        self.pattern = _pre_tokens()
        self.spaced = re.compile(f" [{_kinds('L')}]+")
        self.place: dict[str, int] = {}
        self.sizes, self.first, self.ids, self.n_ids = np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, "<u4"), 0

    def _shrink(self) -> None:
        """Keep the pre-tokens that were met first, which are the most frequent, and forget as many others."""
        n = TABLE_ROWS // 2
        self.n_ids = int(self.first[n])
        self.place = dict(islice(self.place.items(), n))
        self.sizes, self.first, self.ids = self.sizes[:n].copy(), self.first[:n].copy(), self.ids[: self.n_ids].copy()

    @classmethod
    def of(cls, spec: str) -> Encoder:
        """The worker's encoder of this specification, made once."""
        if spec not in _encoders:
            _encoders.clear()
            _encoders[spec] = cls(spec)
        return _encoders[spec]

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def _learn(self, words: list[str]) -> None:
        """Have the library encode pre-tokens that the table lacks."""
        plain, rest = [], []
        for w in words:
            (plain if self.spaced.fullmatch(w) else rest).append(w)
        # words that begin with a space are pre-tokens one by one in a line of many, which costs the library less
        sizes, ids, done = [], [], []
        for i in range(0, len(plain), LINE_WORDS):
            line = plain[i : i + LINE_WORDS]
            e = self.tokenizer.encode("".join(line), add_special_tokens=False)
            of = np.array(e.word_ids, np.int64)
            if len(of) == 0 or of[-1] + 1 != len(line):
                rest += line
                continue
            sizes.append(np.bincount(of, minlength=len(line)))
            ids.append(np.array(e.ids, "<u4"))
            done += line
        parts = self._whole(rest)
        words = done + rest
        sizes, ids = np.concatenate([*sizes, np.array([len(p) for p in parts], np.int64)]), np.concatenate([np.zeros(0, "<u4"), *ids, *parts])
        n, upto = len(self.place), self.n_ids + len(ids)
        self.place.update(zip(words, range(n, n + len(words))))
        # room for as much again, so that few calls move what is there
        if n + len(words) > len(self.sizes):
            self.sizes, self.first = (np.concatenate([x[:n], np.zeros(n + 2 * len(words), np.int32)]) for x in (self.sizes, self.first))
        if upto > len(self.ids):
            self.ids = np.concatenate([self.ids[: self.n_ids], np.zeros(upto + len(ids), "<u4")])
        self.sizes[n : n + len(words)] = sizes
        self.first[n : n + len(words)] = self.n_ids + np.cumsum(sizes) - sizes
        self.ids[self.n_ids : upto] = ids
        self.n_ids = upto

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        apart = [self.apart and _RARE.search(t) is None and not any(s in t for s in self.special) for t in texts]
        others = iter(self._whole([t for t, ok in zip(texts, apart) if not ok]))
        found = [self.pattern.findall(t) if ok else [] for t, ok in zip(texts, apart)]
        if len(self.place) > TABLE_ROWS:
            self._shrink()
        flat = list(chain.from_iterable(found))
        words = np.fromiter(map(self.place.get, flat, repeat(-1)), np.int64, len(flat))
        if len(new := np.flatnonzero(words < 0).tolist()):
            self._learn(list(dict.fromkeys(flat[k] for k in new)))
            words[new] = [self.place[flat[k]] for k in new]
        sizes = self.sizes[words].astype(np.int64)
        ends = np.cumsum(sizes)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.first[words] - (ends - sizes), sizes)
        ids = self.ids[at].astype("<u4")
        upto = np.concatenate([[0], ends])[np.cumsum([0, *map(len, found)])]
        return [ids[a:b] if ok else next(others) for a, b, ok in zip(upto[:-1], upto[1:], apart)]


def _runs(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Where the runs of texts begin and end that are encoded at a time."""
    sizes = [n or 0 for n in pc.binary_length(texts).to_pylist()]
    i = 0
    while i < len(sizes):
        j, size = i + 1, sizes[i]
        while j < len(sizes) and j - i < RUN_ROWS and size + sizes[j] <= RUN_BYTES:
            size += sizes[j]
            j += 1
        yield i, j
        i = j


def write_codes(docs: DataFrame, tokenizer: str, path: str, end_id: int = 0) -> None:
    """Encode ``docs(doc_id, text)`` and write the files below ``path``, in ascending doc_id order."""
    spark = docs.sparkSession
    with open(tokenizer, encoding="utf-8") as f:
        spec = spark.sparkContext.broadcast(f.read())
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    chars = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = max(12, -(-chars // RANGE_CHARS))
    dealt = docs.withColumn("tie", F.xxhash64("text")).repartitionByRange(ranges, F.col("doc_id").asc_nulls_last(), "tie").sortWithinPartitions(F.col("doc_id").asc_nulls_last(), "tie")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, shard = Encoder.of(spec.value), TaskContext.get().partitionId() << 24
        doc_ids: list[int | None] = []
        parts: list[np.ndarray] = []
        tokens = 0

        def file() -> pa.RecordBatch:
            starts = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
            data = encode_file(np.array([i or 0 for i in doc_ids], np.int64), starts, np.concatenate(parts), doc_ids.count(None))
            return pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), pa.array([tokens], pa.int64()), pa.array([data], pa.binary())], ["shard", "tokens", "data"])

        end = np.array([end_id], "<u4")
        for batch in batches:
            for i, j in _runs(batch.column("text")):
                rows = batch.slice(i, j - i)
                for d, ids in zip(rows.column("doc_id").to_pylist(), encoder.encode([t or "" for t in rows.column("text").to_pylist()])):
                    doc_ids.append(d)
                    parts.append(np.concatenate([ids, end]))
                    tokens += len(ids) + 1
                    if tokens >= FILE_TOKENS:
                        yield file()
                        doc_ids, parts, tokens, shard = [], [], 0, shard + 1
        if doc_ids:
            yield file()
        pa.default_memory_pool().release_unused()

    raw_files(dealt.select("doc_id", "text").mapInArrow(run, "shard bigint, tokens bigint, data binary"), "data", "shard", "tokens", path=path)


def read_codes(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id``, ``start`` (tokens of all documents before it), ``n_tokens`` and ``ids_crc32`` from the files below ``path``."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path + "/*/*/*.txt")
    found = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(where)
    if not found:
        return spark.createDataFrame([], "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
    files = spark.read.format("binaryFile").load(path + "/*/*/*.txt")
    shard = F.regexp_extract("path", r"shard=(\d+)", 1).cast("bigint").alias("shard")
    tokens = F.regexp_extract("path", r"tokens=(\d+)", 1).cast("bigint").alias("tokens")
    # one row a file: the number of tokens before it
    before = files.select(shard, tokens).select("shard", F.coalesce(F.sum("tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, data in zip(batch.column("shard").to_pylist(), batch.column("content")):
                file = CodeFile(data.as_py())
                ids, at = file.ids().astype("<u4"), file.starts
                crc = [zlib.crc32(ids[a:b]) for a, b in zip(at[:-1], at[1:])]
                n = len(crc)
                doc_ids = pa.array(file.doc_ids.astype(np.int64), mask=np.arange(n) >= n - file.without)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, k), pa.int64()), doc_ids, pa.array(at[:-1], pa.int64()), pa.array(np.diff(at), pa.int64()), pa.array(crc, pa.int64())], ["shard", "doc_id", "local", "n_tokens", "ids_crc32"])

    rows = files.select(shard, "content").mapInArrow(run, "shard bigint, doc_id bigint, local bigint, n_tokens bigint, ids_crc32 bigint")
    return rows.join(before, "shard").select("doc_id", (F.col("before") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")


def direct_codes(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Write the files to the shared folder, read them back, and return what they hold of each document."""
    path = new_path(docs.sparkSession, "codes")
    write_codes(docs, tokenizer, path)
    return read_codes(docs.sparkSession, path)
