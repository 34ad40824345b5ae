"""Operator 3. Substring dedup by repeated-phrase automata.

A window is ``window`` consecutive words of a document. Documents are dealt into blocks by doc_id. Each block
sends the hash of each distinct window with its smallest doc_id, packed, to the task of that range of hashes;
that task tells each block whose own copy is not the first one which doc_id has the window first. So a window that
very many documents share travels once a block at most. Hashes only route; words decide. Pieces of the first
documents that hold such windows are fetched (a piece once from its document, then to the blocks that ask for
it), and in each block the windows that may recur are spelled out from those pieces, compiled into Aho-Corasick
automata of SHARD_WINDOWS windows each, and all documents of the block stream through each automaton. An occurrence in
a document after the first one covers its words.

A window that a hash called repeated, but that no automaton finds, shared its hash with other words (or its passage
did). The first document of such words is looked for among all documents, DOUBTS hashes at a time, and the blocks
that hold them are done again with what that shows, so the result is exact whatever the hashes do.

A shard holds windows of its own block alone, so total work follows the input. Null or empty text: no words. Rows with a
null doc_id keep all words and make no other row's words go. Rows of one doc_id do not affect each other. Every
input row gives one row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.llm.common import collect_garbage, doc_chunks, joined, pack, table, unpack, window_hashes, word_hashes, word_spans
from wardline.llm.kneserney import _cuts, ranges_of

#: Words of a window; bytes of text in a block and in a range of hashes.
WINDOW, BLOCK_BYTES, RANGE_BYTES = 13, 8 << 20, 16 << 20
LEAST_BLOCKS = 64
#: Windows of a piece of a document, and words of the passages that one automaton holds.
PIECE_WINDOWS, SHARD_WORDS = 64, 400_000
#: Hashes that all tasks get at a time, to look for their words.
DOUBTS = 1_000_000
_TOLD = "block int, h binary, home binary, piece binary"
_SENT = "block int, home bigint, words string, h binary, homes binary"


class Words:
    """The words of some texts and the windows of the first ``numbered`` of them."""

    def __init__(self, texts: list[str | None], numbered: int, window: int, bits: int):
        self.window = window
        self.data, at = joined([(t or "").encode() for t in texts])
        self.starts, self.ends = word_spans(self.data)
        self.first = np.searchsorted(self.starts, at)
        # a window lies in one text: it starts window - 1 words or more before its end
        count = np.maximum(np.diff(self.first[: numbered + 1]) - window + 1, 0)
        self.doc = np.repeat(np.arange(numbered), count)
        self.place = np.arange(count.sum()) - (np.cumsum(count) - count)[self.doc]
        self.at = self.first[self.doc] + self.place
        h = window_hashes(word_hashes(self.data, self.starts, self.ends), window)
        self.h = (h[self.at] >> np.uint64(64 - bits)) << np.uint64(64 - bits) if len(h) else np.empty(0, np.uint64)

    def word(self, k: int) -> bytes:
        return self.data[self.starts[k] : self.ends[k]]

    def text_of(self, window: int) -> str:
        return b" ".join(map(self.word, range(self.at[window], self.at[window] + self.window))).decode()

    def inside(self, windows: np.ndarray) -> np.ndarray:
        """The words that the windows cover, in order."""
        edge = np.zeros(len(self.starts) + 1, np.int64)
        np.add.at(edge, self.at[windows], 1)
        np.add.at(edge, self.at[windows] + self.window, -1)
        return np.flatnonzero(np.cumsum(edge)[:-1])


class Block(Words):
    """The rows of a block, those with a doc_id first and in its order."""

    def __init__(self, rows: pa.Table, window: int, bits: int):
        rows = rows.sort_by([("doc_id", "ascending")])  # null at the end
        self.doc_ids = rows.column("doc_id").to_pylist()
        numbered = len(self.doc_ids) - rows.column("doc_id").null_count
        super().__init__(rows.column("text").to_pylist(), numbered, window, bits)
        self.ids = np.array(self.doc_ids[:numbered], np.int64)

    def distinct(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The distinct window hashes, where each occurs first, and each window's place among them."""
        return np.unique(self.h, return_index=True, return_inverse=True)

    def located(self, known: np.ndarray, homes: np.ndarray, pieces: list[tuple[int | None, str]], bits: int) -> tuple[np.ndarray, np.ndarray]:
        """For each window whether it may recur (by its hash), and whether an automaton finds it in a later document.

        ``known``: sorted hashes that another block's document ``homes`` holds before this block's own; ``pieces``:
        texts of such documents, with a null document where the words are known to recur.
        """
        u, first, back = self.distinct()
        own = self.ids[self.doc[first]]
        if len(known) and len(u):
            k = np.minimum(np.searchsorted(known, u), len(known) - 1)
            own = np.where(known[k] == u, np.minimum(homes[k], own), own)
        may = own[back] < self.ids[self.doc]
        found = np.zeros(len(self.h), bool)
        # where the words of each such window stand: in this block's first document, or in a piece
        source = np.full(len(self.h), -1, np.int64)
        mine = may & (own[back] == self.ids[self.doc[first]][back])
        source[mine] = first[back[mine]]
        texts = Words([t for _, t in pieces], len(pieces), self.window, bits)
        home = np.array([i for i, _ in pieces], np.int64)[texts.doc]
        if len(known) and len(texts.h):
            k = np.minimum(np.searchsorted(known, texts.h), len(known) - 1)
            told = np.flatnonzero((known[k] == texts.h) & (homes[k] == home))
            h, at = np.unique(texts.h[told], return_index=True)
            if len(h):
                k = np.minimum(np.searchsorted(h, self.h), len(h) - 1)
                theirs = may & ~mine & (h[k] == self.h)
                source[theirs] = len(self.h) + told[at[k[theirs]]]
        # windows that follow each other both here and there are one passage
        at = np.concatenate([self.at, texts.at + len(self.starts)])
        some = np.flatnonzero(source >= 0)
        new = np.ones(len(some), bool)
        new[1:] = (np.diff(self.at[some]) != 1) | (np.diff(self.doc[some]) != 0) | (np.diff(source[some]) != 1) | (np.diff(at[source[some]]) != 1)
        begin = np.flatnonzero(new)
        spans = np.stack([source[some[begin]], np.diff(np.append(begin, len(some))) + self.window - 1], 1)
        alone = len(self.h) + np.flatnonzero(np.diff(texts.first)[texts.doc] == self.window)  # from the comparison by words
        spans = np.unique(np.concatenate([spans, np.stack([alone, np.full(len(alone), self.window)], 1)]), axis=0)
        self._stream(spans, texts, home, may, found)
        return may, found

    def _stream(self, spans: np.ndarray, texts: Words, home: np.ndarray, may: np.ndarray, found: np.ndarray) -> None:
        """Mark in ``found`` the windows in occurrences of passages in later documents.

        ``spans``: a passage's first window, of this block or then of ``texts``, and its words; ``home``: the documents
        that the windows of ``texts`` are from.
        """
        import ahocorasick

        if not len(spans):
            return
        at = np.concatenate([self.at, texts.at + len(self.starts)])
        starts_in, bound = at[spans[:, 0]], np.concatenate([self.ids[self.doc], home])[spans[:, 0]]
        letters: dict[bytes, int] = {}
        spelled = []
        for x, n in zip(starts_in.tolist(), spans[:, 1].tolist()):
            words, x = (self, x) if x < len(self.starts) else (texts, x - len(self.starts))
            spelled.append([letters.setdefault(words.word(k), len(letters) + 2) for k in range(x, x + n)])
        # a word is a few digits, each of an alphabet of its own, as the automaton looks through a node's branches one by one
        size = len(letters) + 2
        places = 2 if size <= 1 << 16 else 3
        base = next(k for k in range(2, size + 2) if k**places >= size)
        digits = lambda x: np.stack([1 + j * base + x // base**j % base for j in range(places)], -1)
        # the texts that stream through: stretches of words that windows cover, with a gap (0) wherever others, or a text's end, come between
        inside = self.inside(np.flatnonzero(may))
        letter = np.array([letters.get(self.word(k), 1) for k in inside.tolist()], np.int64)
        doc = np.searchsorted(self.first, inside, side="right")
        gap = np.flatnonzero((np.diff(inside) != 1) | (np.diff(doc) != 0)) + 1
        stream = np.insert(digits(letter).reshape(-1), gap * places, 0).astype("<u4").tobytes().decode("utf-32-le")
        word = np.insert(np.repeat(inside, places), gap * places, -1)
        starts = np.full(len(self.starts) + 1, -1, np.int64)
        starts[self.at] = np.arange(len(self.at))
        shard = np.cumsum(spans[:, 1]) // SHARD_WORDS
        for k in np.unique(shard).tolist():
            automaton = ahocorasick.Automaton()
            for p in np.flatnonzero(shard == k).tolist():
                automaton.add_word(digits(np.array(spelled[p], np.int64)).astype("<u4").tobytes().decode("utf-32-le"), p)
            automaton.make_automaton()
            hits = np.fromiter(chain.from_iterable(automaton.iter(stream)), np.int64).reshape(-1, 2)
            size, least = spans[hits[:, 1], 1], bound[hits[:, 1]]
            window = starts[word[hits[:, 0]] - size + 1]
            ok = self.ids[self.doc[window]] > least
            edge = np.zeros(len(self.h) + 1, np.int64)
            np.add.at(edge, window[ok], 1)
            np.add.at(edge, (window + size - self.window + 1)[ok], -1)
            found |= np.cumsum(edge)[:-1] > 0


def _dealt(docs: DataFrame) -> tuple[DataFrame, int, int]:
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(LEAST_BLOCKS, -(-size // BLOCK_BYTES))
    key = F.coalesce("doc_id", F.xxhash64("text"))
    return docs.withColumn("block", F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")), blocks, ranges_of(size, RANGE_BYTES)


def hash_bits(ranges: int) -> int:
    """Bits of a window's hash: 30 more than tell all windows apart, so that hardly any two share theirs."""
    return min(64, (ranges * RANGE_BYTES).bit_length() + 28)


def first_copies(dealt: DataFrame, ranges: int, window: int, bits: int) -> DataFrame:
    """For each ``block`` packed hashes ``h`` of windows whose first copy another block holds, its doc_id ``home`` and the number ``piece`` of the piece."""

    def send(rows: pa.Table) -> pa.Table:
        block = Block(rows, window, bits)
        h, first, _ = block.distinct()
        doc, piece = block.ids[block.doc[first]], (block.place[first] // PIECE_WINDOWS).astype("<u4")
        cuts = _cuts(h, ranges)
        some = np.flatnonzero(np.diff(cuts))
        parts = [[pack(x[cuts[r] : cuts[r + 1]], x is h) for r in some] for x in (h, doc, piece)]
        return pa.table({"range": pa.array(some, pa.int32()), "block": pa.array([rows.column("block")[0].as_py()] * len(some), pa.int32()), **{k: pa.array(x, pa.binary()) for k, x in zip(("h", "home", "piece"), parts)}})

    def confirm(rows: pa.Table) -> pa.Table:
        sent = [(b, unpack(x, "<u8"), unpack(y, "<i8", False), unpack(z, "<u4", False)) for b, x, y, z in zip(*(rows.column(c).to_pylist() for c in ("block", "h", "home", "piece")))]
        all_h, home, piece = (np.concatenate([s[k] for s in sent]) for k in (1, 2, 3))
        order = np.lexsort((home, all_h))
        ordered = all_h[order]
        begin = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
        times = np.diff(np.append(begin, len(home)))
        least, where = np.empty_like(home), np.empty_like(piece)
        least[order], where[order] = np.repeat(home[order][begin], times), np.repeat(piece[order][begin], times)
        out, at = [], 0
        for b, h, d, _ in sent:
            m, w = least[at : at + len(h)], where[at : at + len(h)]
            at += len(h)
            late = m < d
            if late.any():
                out.append((b, pack(h[late]), pack(m[late], False), pack(w[late], False)))
        blocks, hs, homes, pieces = zip(*out) if out else ((), (), (), ())
        return pa.table({"block": pa.array(blocks, pa.int32()), "h": pa.array(hs, pa.binary()), "home": pa.array(homes, pa.binary()), "piece": pa.array(pieces, pa.binary())})

    return dealt.groupBy("block").applyInArrow(send, "range int, block int, h binary, home binary, piece binary").groupBy("range").applyInArrow(confirm, _TOLD)


def asked_pieces(dealt: DataFrame, told: DataFrame, blocks: int, window: int) -> DataFrame:
    """``block``, ``home`` and ``words``: the pieces of first documents that each block has been told of."""

    def ask(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b, x, y in zip(*(batch.column(c).to_pylist() for c in ("block", "home", "piece"))):
                pairs = np.unique(np.stack([unpack(x, "<i8", False), unpack(y, "<u4", False).astype(np.int64)], 1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(pairs), b), pa.int32()), pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["block", "home", "piece"])

    def cut(rows: pa.Table, wanted: pa.Table) -> pa.Table:
        of: dict[int, list[int]] = {}
        for i, k in zip(wanted.column("home").to_pylist(), wanted.column("piece").to_pylist()):
            of.setdefault(i, []).append(k)
        out = []
        for i, t in zip(rows.column("doc_id").to_pylist(), rows.column("text").to_pylist()):
            if i in of:
                words = (t or "").encode().split()  # splits at 0x20 and 0x09-0x0D alone
                for k in of[i]:
                    if len(piece := words[k * PIECE_WINDOWS : (k + 1) * PIECE_WINDOWS + window - 1]) >= window:
                        out.append((i, k, b" ".join(piece).decode()))
        homes, places, texts = zip(*out) if out else ((), (), ())
        return pa.table({"home": pa.array(homes, pa.int64()), "piece": pa.array(places, pa.int64()), "words": pa.array(texts, pa.string())})

    asked = told.mapInArrow(ask, "block int, home bigint, piece bigint")
    wanted = asked.select("home", "piece").distinct().withColumn("block", F.pmod(F.xxhash64("home"), F.lit(blocks)).cast("int"))
    pieces = dealt.groupBy("block").cogroup(wanted.groupBy("block")).applyInArrow(cut, "home bigint, piece bigint, words string")
    pieces = table(pieces, "pieces")
    collect_garbage(dealt.sparkSession)
    return asked.distinct().join(pieces, ["home", "piece"]).select("block", "home", "words")


def _marked(dealt: DataFrame, sent: DataFrame, window: int, bits: int, texts: bool) -> DataFrame:
    schema = "doc_id bigint, block int, n_words bigint, n_removed bigint, kept_sha256 string, doubt array<struct<h: bigint, words: string>>" + (", kept string, removed array<array<bigint>>" if texts else "")

    def mark(rows: pa.Table, sent: pa.Table) -> pa.Table:
        if not len(rows):
            return pa.table({f.name: pa.array([], f.type) for f in out_schema})
        block = Block(rows, window, bits)
        packed = [(unpack(h, "<u8"), unpack(m, "<i8", False)) for h, m in zip(sent.column("h").to_pylist(), sent.column("homes").to_pylist()) if h is not None]
        h = np.concatenate([np.empty(0, np.uint64), *[x for x, _ in packed]])
        homes = np.concatenate([np.empty(0, np.int64), *[x for _, x in packed]])
        order = np.argsort(h)
        pieces = [(i, t) for i, t in zip(sent.column("home").to_pylist(), sent.column("words").to_pylist()) if t is not None]
        may, found = block.located(h[order], homes[order], pieces, bits)
        cover = np.zeros(len(block.starts) + 1, np.int64)
        np.add.at(cover, block.at[found], 1)
        np.add.at(cover, block.at[found] + window, -1)
        gone = np.cumsum(cover)[:-1] > 0
        doubt: list[list[dict]] = [[] for _ in block.doc_ids]
        for k in np.flatnonzero(may & ~found).tolist():
            doubt[block.doc[k]].append({"h": int(block.h[k : k + 1].view(np.int64)[0]), "words": block.text_of(k)})
        out: dict[str, list] = {"doc_id": block.doc_ids, "block": [rows.column("block")[0].as_py()] * len(rows), "n_words": np.diff(block.first).tolist(), "n_removed": [], "kept_sha256": [], "doubt": doubt, "kept": [], "removed": []}
        for a, b in zip(block.first[:-1].tolist(), block.first[1:].tolist()):
            keep = np.flatnonzero(~gone[a:b]) + a
            words = b" ".join([block.data[x:y] for x, y in zip(block.starts[keep].tolist(), block.ends[keep].tolist())])
            out["n_removed"].append(b - a - len(keep))
            out["kept_sha256"].append(hashlib.sha256(words).hexdigest())
            if texts:
                out["kept"].append(words.decode())
                edge = np.flatnonzero(np.diff(np.concatenate([[0], gone[a:b].view(np.int8), [0]])))
                out["removed"].append(edge.reshape(-1, 2).tolist())
        return pa.table({f.name: pa.array(out[f.name], f.type) for f in out_schema})

    out_schema = pa.schema([("doc_id", pa.int64()), ("block", pa.int32()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("doubt", pa.list_(pa.struct([("h", pa.int64()), ("words", pa.string())])))] + [("kept", pa.string()), ("removed", pa.list_(pa.list_(pa.int64())))] * texts)
    return dealt.groupBy("block").cogroup(sent.groupBy("block")).applyInArrow(mark, schema)


def first_of_words(docs: DataFrame, doubts: DataFrame, window: int, bits: int) -> DataFrame:
    """``words`` and ``home``, the smallest doc_id that has them as a window, for windows whose hashes are in ``doubts(h)``; written."""
    hashes = doubts.select("h").distinct()
    turns = -(-hashes.count() // DOUBTS)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where("doc_id is not null")
    out = None
    for turn in range(turns):
        sought = docs.sparkSession.sparkContext.broadcast(np.sort(np.array([r.h for r in hashes.where(F.pmod("h", F.lit(turns)) == turn).collect()], np.int64).view(np.uint64)))

        def look(batches: Iterable[pa.RecordBatch], sought=sought) -> Iterator[pa.RecordBatch]:
            for batch, _ in doc_chunks(batches):
                texts = Words(batch.column("text").to_pylist(), batch.num_rows, window, bits)
                hits = np.flatnonzero(np.isin(texts.h, sought.value))
                ids = batch.column("doc_id").to_numpy()[texts.doc[hits]]
                yield pa.RecordBatch.from_arrays([pa.array([texts.text_of(k) for k in hits.tolist()], pa.string()), pa.array(ids, pa.int64())], ["words", "home"])

        found = table(rows.mapInArrow(look, "words string, home bigint").groupBy("words").agg(F.min("home").alias("home")), "homes")
        out = found if out is None else out.unionByName(found)
    return out


def substring_dedup(docs: DataFrame, window: int = WINDOW, texts: bool = False, bits: int | None = None) -> DataFrame:
    """For each row of ``docs(doc_id, text)``: ``doc_id``, ``n_words``, ``n_removed`` and ``kept_sha256``.

    With ``texts`` also ``kept`` (the words left, joined by a space) and ``removed`` (spans of words).
    ``bits``: of the windows' hashes (see hash_bits()).
    """
    dealt, blocks, ranges = _dealt(docs)
    bits = bits or hash_bits(ranges)
    told = table(first_copies(dealt, ranges, window, bits), "told")
    collect_garbage(docs.sparkSession)  # the windows that were dealt out leave the executors' disks
    null = lambda kind: F.lit(None).cast(kind)
    sent = asked_pieces(dealt, told, blocks, window).select("block", "home", "words", null("binary").alias("h"), null("binary").alias("homes"))
    sent = sent.unionByName(told.select("block", null("bigint").alias("home"), null("string").alias("words"), "h", F.col("home").alias("homes")))
    done = table(_marked(dealt, sent, window, bits, texts), "marked")
    doubts = done.select("block", F.explode("doubt").alias("x")).select("block", "x.h", "x.words").distinct()
    if not doubts.isEmpty():
        doubts = table(doubts, "doubts")
        more = doubts.select("block", "words").distinct().join(first_of_words(docs, doubts, window, bits), "words").select("block", "home", "words", null("binary").alias("h"), null("binary").alias("homes"))
        again = doubts.select("block").distinct()
        redone = _marked(dealt.join(again, "block", "left_semi"), sent.join(again, "block", "left_semi").unionByName(more), window, bits, texts)
        done = done.join(again, "block", "left_anti").unionByName(redone)
    return done.select("doc_id", "n_words", "n_removed", "kept_sha256", *(["kept", "removed"] if texts else []))
