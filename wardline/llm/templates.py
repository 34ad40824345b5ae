"""Operator 6. Benchmark decontamination by template canonicalisation.

Words are runs of letters and digits in lower case; punctuation only ends sentences. A word that begins with a digit or
names a number, a unit of measure, or a capitalised word inside a sentence becomes a typed placeholder: number, unit
or name. A word all in capitals is no name where most words from AROUND before to AROUND after it are in capitals too.
Windows of WINDOW canonical words of the benchmark, with LITERALS words that are no placeholder at least, are
hashed, and beside them all windows of WINDOW words as they are in lower case, so that a copy is found whatever its case and
however many numbers or names it holds; documents' windows are joined with both by hash. Windows that follow each other on one diagonal make
an aligned stretch. Its slots must be consistent: a value of the item stands for one value of the document throughout,
and a name of the document for one of the item (two numbers may become the same one); where that breaks, the stretch
ends and another begins. A document is contaminated by an item that it shares a consistent stretch of LONG words
with, or of SHARE of the item's words. ``exact`` tells a whole copy, all words of the item in its order and equal in
lower case, from a part or a re-parameterised one.

The benchmark is read in blocks of BLOCK_CHARS characters, each against all documents, so what is broadcast has
a fixed size. An item of fewer words than WINDOW is one window; items of fewer than LITERALS words match nothing.
Null or empty texts on either side match nothing; a null doc_id or item_id is returned as such. Repeated items
count once. Repeated documents give repeated rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.functions.shipping import ship
from wardline.llm.common import doc_chunks, window_hashes, word_hashes

WINDOW, LITERALS, AROUND = 8, 4, 4
LONG, SHARE = 13, 0.5
BLOCK_CHARS = 16 << 20
NUMBER, NAME, UNIT = np.uint64(1), np.uint64(2), np.uint64(3)
UNITS = (
    "mm", "cm", "m", "km", "in", "inch", "inches", "ft", "foot", "feet", "yd", "yard", "yards", "mile", "miles", "mg", "g", "kg", "gram", "grams",
    "kilogram", "kilograms", "oz", "ounce", "ounces", "lb", "lbs", "pound", "pounds", "ton", "tons", "tonne", "tonnes", "ml", "l", "liter", "liters",
    "litre", "litres", "gallon", "gallons", "s", "sec", "second", "seconds", "min", "minute", "minutes", "hour", "hours", "day", "days", "week",
    "weeks", "month", "months", "year", "years", "cent", "cents", "dollar", "dollars", "euro", "euros", "usd", "eur", "gbp", "percent", "degree",
    "degrees", "meter", "meters", "metre", "metres", "kilometer", "kilometers", "kilometre", "kilometres", "mph", "kmh", "w", "kw", "kwh", "v",
    "volt", "volts", "byte", "bytes", "kb", "mb", "gb", "tb",
)
#: Numbers as words; ``one`` is left out, as it is a pronoun too.
NUMBER_WORDS = (
    "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve", "thirteen", "fourteen", "fifteen", "sixteen",
    "seventeen", "eighteen", "nineteen", "twenty", "thirty", "forty", "fifty", "sixty", "seventy", "eighty", "ninety", "hundred", "thousand",
    "million", "billion",
)

#: Letters beyond Latin-1 that have a small form of as many bytes.
_SMALL = {c: chr(c).lower() for c in range(0x100, 0x10000) if chr(c).isupper() and len(chr(c).lower()) == 1 and len(chr(c).lower().encode()) == len(chr(c).encode())}
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_WORD = np.zeros(256, bool)
_WORD[[*range(ord("0"), ord("9") + 1), *range(ord("a"), ord("z") + 1), *range(ord("A"), ord("Z") + 1), *range(0x80, 0x100)]] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[ord("0") : ord("9") + 1] = True
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".!?:;\n"]] = True


class Canonical:
    """Texts as canonical words: ``code`` (a placeholder or the word's hash), ``literal`` (the word's hash), ``doc``'s bounds."""

    def __init__(self, texts: list[bytes]):
        data = b"\n\n".join(texts)
        at = np.concatenate([[0], np.cumsum([len(t) + 2 for t in texts])])
        a = np.frombuffer(data, np.uint8)
        word = np.zeros(len(a) + 2, np.int8)
        digit = _DIGIT[a]
        word[1:-1] = _WORD[a]
        if len(a) > 2:  # a point or comma between digits belongs to the number
            word[2:-2] |= digit[:-2] & digit[2:] & ((a[1:-1] == 0x2E) | (a[1:-1] == 0x2C))
        edges = np.flatnonzero(np.diff(word))
        self.starts, self.ends = edges[0::2], edges[1::2]
        low = _LOWER[a]
        if (a >= 0xC4).any():  # other alphabets
            low = _LOWER[np.frombuffer(data.decode().translate(_SMALL).encode(), np.uint8)]
        if len(a) > 1:  # capital letters of Latin-1 in UTF-8
            capital = (a[:-1] == 0xC3) & (a[1:] >= 0x80) & (a[1:] <= 0x9E) & (a[1:] != 0x97)
            low[1:] += capital.astype(np.uint8) * 32
        self.literal = word_hashes(low.tobytes(), self.starts, self.ends)
        code = self.literal.copy()
        self.first = np.searchsorted(self.starts, at)
        if len(code):
            stops = np.concatenate([[0], np.cumsum(_STOP[a] & (word[1:-1] == 0))])
            changed = low[self.starts] != a[self.starts]
            if len(a) > 1:
                for k in (1, 2):  # the rest of a first letter of several bytes
                    after = np.minimum(self.starts + k, len(a) - 1)
                    changed |= (a[self.starts] >= (0xC3, 0xE0)[k - 1]) & (low[after] != a[after]) & (a[after] >= 0x80) & (a[after] < 0xC0)
            inside = np.zeros(len(code), bool)
            inside[1:] = stops[self.starts[1:]] == stops[self.ends[:-1]]
            code[changed & inside & ~self._shouted(a, low)] = NAME
            code[np.isin(self.literal, _UNIT_HASHES)] = UNIT
            code[digit[self.starts] | np.isin(self.literal, _NUMBER_HASHES)] = NUMBER
        self.code = code
        self.is_literal = code > UNIT

    def _shouted(self, a: np.ndarray, low: np.ndarray) -> np.ndarray:
        """Whether each word is all in capitals, as are most words around it in its text."""
        sums = lambda x: np.concatenate([[0], np.cumsum(x)])
        capital, small = sums(low != a), sums((a >= ord("a")) & (a <= ord("z")))
        capital, small = (x[self.ends] - x[self.starts] for x in (capital, small))
        upper = (capital > 0) & (small == 0)
        words = np.diff(self.first)
        at = np.arange(len(upper))
        low_end = np.maximum(at - AROUND, np.repeat(self.first[:-1], words))
        high_end = np.minimum(at + AROUND + 1, np.repeat(self.first[1:], words))
        uppers, lettered = sums(upper), sums(capital + small > 0)
        return upper & (2 * (uppers[high_end] - uppers[low_end]) > lettered[high_end] - lettered[low_end])

    def windows(self, n: int, literal_words: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the windows of n words in one text, and where they start: canonical words with LITERALS literal ones, or all words as they are."""
        h = window_hashes(self.literal if literal_words else self.code, n)
        if not len(h):
            return h, np.empty(0, np.int64)
        words = np.diff(self.first)
        doc = np.repeat(np.arange(len(words)), words)[: len(h)]
        literal = np.concatenate([[0], np.cumsum(self.is_literal)])
        at = np.arange(len(h))
        ok = at + n <= self.first[doc + 1]
        if not literal_words:
            ok &= literal[n : n + len(h)] - literal[: len(h)] >= min(LITERALS, n)
        return h[ok], at[ok]


_UNIT_HASHES = _NUMBER_HASHES = np.empty(0, np.uint64)
_UNIT_HASHES, _NUMBER_HASHES = (np.sort(Canonical([w.encode() for w in words]).literal) for words in (UNITS, NUMBER_WORDS))


class Benchmark:
    """The windows of a block of items, by length and hash."""

    def __init__(self, items: list[tuple[object, str]]):
        self.ids = [i for i, _ in items]
        self.text = Canonical([t.encode() for _, t in items])
        self.words = np.diff(self.text.first)
        self.tables: list[tuple[int, bool, np.ndarray, np.ndarray]] = []
        for n in sorted({int(min(w, WINDOW)) for w in self.words if w >= LITERALS}):
            for literal_words in (False, True):
                h, at = self.text.windows(n, literal_words)
                item = np.searchsorted(self.text.first, at, side="right") - 1
                fits = (self.words[item] == n) | (n == WINDOW)
                order = np.argsort(h[fits], kind="stable")
                self.tables.append((n, literal_words, h[fits][order], at[fits][order]))

    def stretches(self, c: Canonical) -> dict[tuple[int, int], tuple[int, bool]]:
        """For each (text, item) with a consistent stretch: words of the longest, and whether the text holds the whole item as it is."""
        found: list[tuple[np.ndarray, np.ndarray, int]] = []
        for n, literal_words, keys, places in self.tables:
            h, at = c.windows(n, literal_words)
            low, high = np.searchsorted(keys, h), np.searchsorted(keys, h, side="right")
            hit = np.flatnonzero(high > low)
            count = (high - low)[hit]
            own = np.repeat(at[hit], count)
            offset = np.cumsum(count) - count
            theirs = places[np.repeat(low[hit], count) + np.arange(count.sum()) - np.repeat(offset, count)] if len(hit) else at[:0]
            found.append((own, theirs, n))
        own, theirs = (np.concatenate([f[k] for f in found] or [np.empty(0, np.int64)]) for k in (0, 1))
        size = np.concatenate([np.full(len(f[0]), f[2]) for f in found] or [np.empty(0, np.int64)])
        if not len(own):
            return {}
        doc = np.searchsorted(c.first, own, side="right") - 1
        item = np.searchsorted(self.text.first, theirs, side="right") - 1
        order = np.lexsort((own, own - theirs, item, doc))
        own, theirs, size, doc, item = (x[order] for x in (own, theirs, size, doc, item))
        same = (doc[1:] == doc[:-1]) & (item[1:] == item[:-1]) & (np.diff(own) == np.diff(theirs)) & (np.diff(own) <= size[:-1])
        begin = np.flatnonzero(np.concatenate([[True], ~same]))
        last = np.append(begin[1:], len(own)) - 1
        out: dict[tuple[int, int], tuple[int, bool]] = {}
        for a, b in zip(begin.tolist(), last.tolist()):
            d, i = int(doc[a]), int(item[a])
            longest = self._consistent(c, int(own[a]), int(theirs[a]), int(own[b] + size[b] - own[a]))
            start, of = int(own[a] - theirs[a] + self.text.first[i]), slice(int(self.text.first[i]), int(self.text.first[i + 1]))
            whole = start >= c.first[d] and np.array_equal(c.literal[start : min(start + int(self.words[i]), int(c.first[d + 1]))], self.text.literal[of])
            was = out.get((d, i), (0, False))
            out[d, i] = (max(was[0], longest), was[1] or whole)
        return out

    def _consistent(self, c: Canonical, own: int, theirs: int, words: int) -> int:
        """Words of the longest part in which each value of a slot stands for one value, and each name for one name."""
        slots = np.flatnonzero(~c.is_literal[own : own + words] | ~self.text.is_literal[theirs : theirs + words])
        longest, begin, value, back = 0, 0, {}, {}
        for place, x, y, kind in zip(slots.tolist(), self.text.literal[theirs + slots].tolist(), c.literal[own + slots].tolist(), c.code[own + slots].tolist()):
            if value.setdefault(x, y) != y or kind == NAME and back.setdefault(y, x) != x:
                longest, begin, value, back = max(longest, place - begin), place, {x: y}, {y: x}
        return max(longest, words - begin)


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple[object, str]]]:
    items = benchmark.select("item_id", "text").where("text is not null").dropDuplicates()
    chars = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-chars // BLOCK_CHARS)
    for k in range(blocks):
        part = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k)
        yield [(r["item_id"], r["text"]) for r in part.collect()]


def leaks_of(block: Benchmark, texts: list[bytes]) -> list[tuple[int, int, int, bool]]:
    """(text, item, words of the longest consistent stretch, exact) for each text that an item contaminates."""
    found = block.stretches(Canonical(texts))
    return [(d, i, longest, exact) for (d, i), (longest, exact) in sorted(found.items()) if longest >= LONG or longest >= SHARE * block.words[i]]


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc_id``, ``item_id``, ``matched`` (words), ``item_words`` and ``exact`` for each contaminated document and item."""
    ship(docs.sparkSession)
    spark = docs.sparkSession
    kinds = f"doc_id {dict(docs.dtypes)['doc_id']}, item_id {dict(benchmark.dtypes)['item_id']}, matched bigint, item_words bigint, exact boolean"
    out = None
    for items in _blocks(benchmark):
        sent = spark.sparkContext.broadcast(Benchmark(items))

        def run(batches: Iterable[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            block = sent.value
            for batch, texts in doc_chunks(batches):
                rows = leaks_of(block, texts)
                doc = batch.column("doc_id").take(pa.array([r[0] for r in rows], pa.int64()))
                yield pa.RecordBatch.from_arrays([doc, pa.array([block.ids[r[1]] for r in rows], ITEM), pa.array([r[2] for r in rows], pa.int64()), pa.array([int(block.words[r[1]]) for r in rows], pa.int64()), pa.array([r[3] for r in rows], pa.bool_())], ["doc_id", "item_id", "matched", "item_words", "exact"])

        from pyspark.sql.pandas.types import to_arrow_type

        ITEM = to_arrow_type(benchmark.schema["item_id"].dataType)
        part = docs.select("doc_id", "text").mapInArrow(run, kinds)
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], kinds) if out is None else out


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that no item contaminates, with all their columns."""
    ship(docs.sparkSession)
    for items in _blocks(benchmark):
        sent = docs.sparkSession.sparkContext.broadcast(Benchmark(items))

        def run(batches: Iterable[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch, texts in doc_chunks(batches):
                keep = np.ones(len(texts), bool)
                keep[[r[0] for r in leaks_of(sent.value, texts)]] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
