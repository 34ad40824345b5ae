"""Operator 10. SimHash near-duplicates by a hierarchical index in Gray order.

Fingerprints of 64 bits come from word shingles. Two fingerprints within ``max_bits`` agree on at least
one of ``max_bits + 1`` parts, so each part's masked pattern is an upper node of the index: a table of
(part, pattern) groups, dealt over the executors. In a group fingerprints are sorted by Gray rank, so that
neighbours share most bits; a tree over that order keeps in each node the bits that all below share, and
pairs of nodes go down together with their differences accumulated, dropped once they exceed ``max_bits``.
A group above GROUP_ROWS fingerprints is divided exactly once more by the parts of its other bits.

Only distinct fingerprints enter the index; each task returns a spanning forest of its links, not all
pairs. Components grow by alternating large-star and small-star rounds over written tables.

near_dedup() is for a similarity that 64 bits do not tell. Its prints are longer and their index has the same form with wide
nodes: groups by the parts of a print, Gray order and leaves with the bits that all below share, differences accumulated.
What it finds leaves the tasks as clusters of texts, not as pairs, and clusters are confirmed by exact sets.

Null text: empty (fingerprint zero, linked like any other). Rows with a null doc_id get a fingerprint and
a null component and link nothing. Every input row gives one row; repeated doc_ids share a component only
if their texts' fingerprints link them, and then carry the same component_id.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.llm.common import collect_garbage, doc_chunks, drop, hashed_words, joined, mix, table, window_hashes, word_spans

#: Distinct fingerprints of one pattern beyond which its group is divided by the parts of its other bits.
GROUP_ROWS = 20_000
#: Distinct fingerprints, over all patterns, that one task of the index takes on average.
TASK_ROWS = 200_000
LEAF, FANOUT = 16, 8
#: Pairs of nodes that are opened at a time.
OPEN = 8_192
_SEED = 42
#: near_dedup()'s prints have WORDS words of 64 bits. The index has the first HEAD of them, cut into parts of PART bits, and
#: links heads that differ in at most HEAD_BITS.
WORDS, HEAD, PART, HEAD_BITS = 16, 5, 8, 88
PARTS = HEAD * 64 // PART
#: Bits in which whole prints may differ, of texts with at least MANY distinct shingles and of shorter ones.
NEAR_BITS, NEAR_BITS_SHORT, MANY = 212, 240, 32
#: Prints of a leaf of the index of heads, and of a group beyond which it is divided by the other parts.
WIDE_LEAF, WIDE_ROWS = 64, 4_096
#: A cluster that is confirmed at a time has two blocks. A block has HALF_TEXTS texts, or more where it would take over BLOCKS of them, but no
#: more than HALF_HASHES shingle hashes (or one text). One task of near_clusters() takes CLUSTER_ROWS prints on average.
HALF_TEXTS, BLOCKS, HALF_HASHES, CLUSTER_ROWS = 128, 16, 1 << 20, 50_000



def fingerprints(texts: list[bytes], shingle: int = 3) -> np.ndarray:
    """The SimHash of each text: words in lower case (A-Z), shingles joined by one space, XXH64 with seed 42."""
    from xxhash import xxh64_intdigest

    data, at = joined([t.lower() for t in texts])
    starts, ends = word_spans(data)
    first = np.searchsorted(starts, at)
    plain = b" ".join(data.split())  # splits at 0x20 and 0x09-0x0D alone
    to = np.cumsum(ends - starts + 1) - 1
    begin = to - (ends - starts)
    words = np.diff(first)
    count = np.where(words >= shingle, words - shingle + 1, np.minimum(words, 1))
    offset = np.concatenate([[0], np.cumsum(count)])
    # shingle k of document d begins at word first[d] + k and has shingle words, or all of a shorter text
    doc = np.repeat(np.arange(len(texts)), count)
    word = first[doc] + np.arange(offset[-1]) - offset[doc]
    last = word + np.minimum(words[doc], shingle) - 1
    h = np.array([xxh64_intdigest(plain[a:b], _SEED) for a, b in zip(begin[word].tolist(), to[last].tolist())], ">u8")
    out = np.zeros(len(texts), np.uint64)
    some = np.flatnonzero(count)
    if len(some):
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1)
        set_in = np.add.reduceat(bits, offset[some], axis=0, dtype=np.int64)
        out[some] = np.packbits(set_in * 2 > count[some, None], axis=1).view(">u8").reshape(-1)
    return out


def gray_rank(f: np.ndarray) -> np.ndarray:
    """The place of each fingerprint in the reflected Gray order."""
    for s in (1, 2, 4, 8, 16, 32):
        f = f ^ (f >> np.uint64(s))
    return f


def _levels(f: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """From the leaves up, the pattern of each node and the mask of the bits that all below share."""
    levels, size = [], LEAF
    pattern, differ = f, np.zeros(len(f), np.uint64)
    while True:
        at = np.arange(0, len(pattern), size)
        first = pattern[at]
        differ = np.bitwise_or.reduceat(differ | (pattern ^ np.repeat(first, np.diff(np.append(at, len(pattern))))), at)
        pattern = first
        levels.append((pattern, ~differ))
        if len(pattern) == 1:
            return levels
        size = FANOUT


def tree_pairs(f: np.ndarray, max_bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places i < j of ``f`` (in Gray order) whose fingerprints differ in at most ``max_bits`` bits."""
    levels = _levels(f)
    top = len(levels) - 1
    zero = np.zeros(1, np.int64)
    stack = [(top, zero, zero, zero)]  # the root with itself differs in no shared bit
    while stack:
        level, a, b, so_far = stack.pop()
        for k in range(0, len(a), OPEN // (8 if level == 0 else 1)):
            x, y, d = (v[k : k + OPEN // (8 if level == 0 else 1)] for v in (a, b, so_far))
            size, below = (LEAF, len(f)) if level == 0 else (FANOUT, len(levels[level - 1][0]))
            step = np.arange(size)
            i = (x[:, None, None] * size + step[None, :, None] + np.zeros((1, 1, size), np.int64)).reshape(-1)
            j = (y[:, None, None] * size + step[None, None, :] + np.zeros((1, size, 1), np.int64)).reshape(-1)
            up = np.repeat(np.arange(len(x)), size * size)
            ok = (i < below) & (j < below) & ((i < j) if level == 0 else (i <= j))
            i, j, up = i[ok], j[ok], up[ok]
            seen = levels[level][1][x] & levels[level][1][y]  # bits that the pair above has been charged for
            if level == 0:
                d = d[up] + np.bitwise_count((f[i] ^ f[j]) & ~seen[up])
            else:
                pattern, mask = levels[level - 1]
                d = d[up] + np.bitwise_count((pattern[i] ^ pattern[j]) & mask[i] & mask[j] & ~seen[up])
            ok = d <= max_bits
            if not ok.any():
                continue
            if level == 0:
                yield i[ok], j[ok]
            else:
                stack.append((level - 1, i[ok], j[ok], d[ok]))


def forest(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """The smallest place connected to each of n places by the links u-v."""
    label = np.arange(n)
    while True:
        m = np.minimum(label[u], label[v])
        new = label.copy()
        np.minimum.at(new, label[u], m)
        np.minimum.at(new, label[v], m)
        while not np.array_equal(new[new], new):
            new = new[new]
        if np.array_equal(new, label):
            return label
        label = new


def parts(max_bits: int, of: int = 2**64 - 1) -> list[int]:
    """The set bits of ``of`` in max_bits + 1 masks of nearly equal size, from the highest."""
    bits = [i for i in reversed(range(64)) if of >> i & 1]
    n = max_bits + 1
    return [sum(1 << i for i in bits[k * len(bits) // n : (k + 1) * len(bits) // n]) for k in range(n)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def link_forest(nodes: DataFrame, max_bits: int) -> DataFrame:
    """Links ``a``, ``b`` (b the smaller) that connect the same nodes as all links within ``max_bits`` do.

    ``nodes``: distinct ``fp`` (bigint) with its ``node`` (bigint).
    """
    masks = parts(max_bits)
    subs = [parts(max_bits, ~m & (2**64 - 1)) for m in masks]
    keyed = nodes.select("fp", "node", F.explode(F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for t, m in enumerate(masks)])).alias("x")).select("fp", "node", "x.t", "x.key")
    large = keyed.groupBy("t", "key").count().where(F.col("count") > GROUP_ROWS).select("t", "key", F.lit(True).alias("large"))
    by_sub = [F.array(*[F.struct(F.lit(s + 1).alias("s"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("sub")) for s, m in enumerate(sub)]) for sub in subs]
    whole = F.array(F.struct(F.lit(0).alias("s"), F.lit(0).cast("bigint").alias("sub")))
    sub_of = F.element_at(F.array(*by_sub), F.col("t") + 1)
    divided = keyed.join(large, ["t", "key"], "left").withColumn("y", F.explode(F.when(F.col("large"), sub_of).otherwise(whole))).select("fp", "node", "t", "key", "y.s", "y.sub")
    n = nodes.count()
    tasks = max(24, -(-n * len(masks) // TASK_ROWS))
    dealt = divided.withColumn("task", F.pmod(F.xxhash64("t", "key", "s", "sub"), F.lit(tasks)))

    def run(rows: pa.Table) -> pa.Table:
        f = rows.column("fp").to_numpy().view(np.uint64)
        node = rows.column("node").to_numpy()
        t, s = rows.column("t").to_numpy(), rows.column("s").to_numpy()
        key, sub = rows.column("key").to_numpy(), rows.column("sub").to_numpy()
        order = np.lexsort((gray_rank(f), sub, s, key, t))
        f, node, t, s, key, sub = (x[order] for x in (f, node, t, s, key, sub))
        new = np.ones(len(f), bool)
        new[1:] = (t[1:] != t[:-1]) | (key[1:] != key[:-1]) | (s[1:] != s[:-1]) | (sub[1:] != sub[:-1])
        begin = np.flatnonzero(new)
        group, size = np.cumsum(new) - 1, np.diff(np.append(begin, len(f)))
        found: list[tuple[np.ndarray, np.ndarray]] = []
        # groups of a few leaves: neighbours at each distance in the order, all groups at once
        small = size <= 2 * LEAF
        for d in range(1, int(size[small].max(initial=1))):
            i = np.flatnonzero((group[d:] == group[:-d]) & small[group[d:]])
            i = i[np.bitwise_count(f[i] ^ f[i + d]) <= max_bits]
            found.append((i, i + d))
        for g in np.flatnonzero(~small):
            found += [(i + begin[g], j + begin[g]) for i, j in tree_pairs(f[begin[g] : begin[g] + size[g]], max_bits)]
        u, v = (np.concatenate([x[k] for x in found] or [np.empty(0, np.int64)]) for k in (0, 1))
        # a node has as many places as patterns in this task
        names, place = np.unique(node, return_inverse=True)
        label = forest(place[u], place[v], len(names))
        linked = np.flatnonzero(label != np.arange(len(names)))
        return pa.table({"a": names[linked], "b": names[label[linked]]})

    return dealt.groupBy("task").applyInArrow(run, "a bigint, b bigint")


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``root``, the smallest node reachable, for all nodes of ``links(a, b)`` other than roots."""
    edges = table(links.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    state = None
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now[0] == 0 or now == state:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        state = now
        # large star: the larger neighbours of a node go to its smallest neighbour
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        edges = both.join(least, "a").where("b > a and b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small star: a node and its smaller neighbours go to the smallest of them
        least = edges.groupBy("a").agg(F.min("b").alias("m"))
        own = least.select("a", F.col("m").alias("b"))
        edges = table(edges.join(least, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(own).distinct(), "links")


def simhash_table(docs: DataFrame, *shingles: int) -> DataFrame:
    """``doc_id`` and for each shingle length k a fingerprint ``fp<k>`` of each row of ``docs(doc_id, text)``, written to the shared folder."""
    names = [f"fp{k}" for k in shingles]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in doc_chunks(batches, limit=1 << 20):
            prints = [pa.array(fingerprints(texts, k).view(np.int64)) for k in shingles]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *prints], ["doc_id", *names])

    schema = ", ".join(["doc_id bigint", *[f"{c} bigint" for c in names]])
    return table(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, schema), "fingerprints")


def _nodes(prints: DataFrame, name: str) -> DataFrame:
    """The distinct fingerprints of a column with their smallest doc_id and their number of rows."""
    return table(prints.where("doc_id is not null").groupBy(F.col(name).alias("fp")).agg(F.min("doc_id").alias("node"), F.count("*").alias("rows")), "nodes")


def salted(left: DataFrame, right: DataFrame, key: str, rows: int) -> DataFrame:
    """``left`` joined with ``right``, whose ``key`` is unique and whose ``rows`` says how many rows of ``left`` have it.

    Keys with over half a task's share of the ``rows`` in all are dealt over as many tasks as they fill; there are
    at most two such keys a task, so they are broadcast.
    """
    share = max(64, rows // (2 * int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    parts = F.ceil(F.col("rows") / share).cast("int")
    frequent = F.broadcast(right.where(F.col("rows") > share).select(key, parts.alias("parts")))
    left = left.join(frequent, key, "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64(*left.columns), F.col("parts")), F.lit(0)).cast("int")).drop("parts")
    right = right.withColumn("salt", F.explode(F.when(F.col("rows") > share, F.sequence(F.lit(0), parts - 1)).otherwise(F.array(F.lit(0))))).drop("rows")
    return left.join(right, [key, "salt"]).drop("salt")


def simhash_components(docs: DataFrame, shingle: int = 3, max_bits: int = 2) -> DataFrame:
    """``doc_id``, ``fingerprint`` (16 hexadecimal digits) and ``component_id`` for each row of ``docs``."""
    prints = simhash_table(docs, shingle).withColumnRenamed(f"fp{shingle}", "fp")
    nodes = _nodes(prints, "fp")
    roots = components(link_forest(nodes.drop("rows"), max_bits))
    known = table(nodes.join(roots, "node", "left").select("fp", "rows", F.coalesce("root", "node").alias("component_id")), "known")
    numbered = salted(prints.where("doc_id is not null"), known, "fp", known.agg(F.sum("rows")).first()[0] or 0)
    out = numbered.unionByName(prints.where("doc_id is null").withColumn("component_id", F.lit(None).cast("bigint")))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def shingle_hashes(texts: list[bytes], shingle: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of each text's shingles, where each text's begin (one more entry: the end), and a hash of its words in order.

    Words as in fingerprints(). A text of fewer words than a shingle has one, of all its words; one without words has none.
    """
    h, first = hashed_words([t.lower() for t in texts])
    words = np.diff(first)
    count = np.where(words >= shingle, words - shingle + 1, np.minimum(words, 1))
    offset = np.concatenate([[0], np.cumsum(count)])
    doc = np.repeat(np.arange(len(texts)), count)
    at = first[doc] + np.arange(offset[-1]) - offset[doc]
    out = np.empty(offset[-1], np.uint64)
    for n in range(1, shingle + 1):
        some = np.flatnonzero(np.minimum(words, shingle)[doc] == n)
        if len(some):
            out[some] = mix(window_hashes(h, n)[at[some]] + np.uint64(n))
    place = np.arange(len(h)) - np.repeat(first[:-1], words)
    whole = mix(words.astype(np.uint64))
    if len(h):
        whole[words > 0] += np.add.reduceat(mix(h ^ mix(place.astype(np.uint64))), first[:-1][words > 0])
    return out, offset, whole


def wide_prints(h: np.ndarray, offset: np.ndarray) -> np.ndarray:
    """The SimHash of WORDS * 64 bits of each set of shingle hashes ``h[offset[k]:offset[k + 1]]``, none of them empty.

    A bit is 1 if set in over half the hashes. Bits are counted eight to an integer, in its bytes, over 255 hashes at most.
    """
    count = np.diff(offset)
    blocks = -(-count // 255)
    first = np.cumsum(blocks) - blocks
    begin = np.repeat(offset[:-1] - 255 * first, blocks) + 255 * np.arange(blocks.sum())
    out = np.zeros((len(count), WORDS), np.uint64)
    ones = np.uint64(0x0101010101010101)
    for k in range(WORDS):
        v = mix(h + mix(np.full(1, k + 1, np.uint64)))
        for j in range(8):
            sums = np.add.reduceat((v >> np.uint64(j)) & ones, begin).astype("<u8").view(np.uint8).reshape(-1, 8)
            most = 2 * np.add.reduceat(sums, first, axis=0, dtype=np.int64) > count[:, None]
            out[:, k] |= np.ascontiguousarray(most).view("<u8").reshape(-1) << np.uint64(j)
    return out


def _signed_prints(docs: DataFrame, shingle: int) -> DataFrame:
    """``doc_id``, ``tie`` (the text's hash), ``whole`` (a hash of the words), ``n`` (distinct shingles) and ``print`` (their SimHash, empty without words) of each row; written."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in doc_chunks(batches, limit=1 << 20):
            h, offset, whole = shingle_hashes(texts, shingle)
            sets = [np.unique(h[a:b]) for a, b in zip(offset[:-1], offset[1:])]
            n = np.array([len(x) for x in sets], np.int64)
            some = n > 0
            prints = wide_prints(np.concatenate(sets), np.concatenate([[0], np.cumsum(n[some])])) if some.any() else np.empty((0, WORDS), np.uint64)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(some * WORDS)]).astype(np.int32)), pa.array(prints.reshape(-1).view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("tie"), pa.array(whole.view(np.int64)), pa.array(n), lists], ["doc_id", "tie", "whole", "n", "print"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("tie"), "text")
    return table(rows.mapInArrow(run, "doc_id bigint, tie bigint, whole bigint, n bigint, print array<bigint>"), "prints")


def wide_pairs(f: np.ndarray, root: np.ndarray, max_bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places i < j of the prints ``f`` (a row each, in Gray order) of different ``root`` that differ in at most ``max_bits`` bits.

    A leaf is held against the later ones whose shared bits differ from its own in no more, then their prints, with
    differences accumulated word by word.
    """
    n, words = f.shape
    at = np.arange(0, n, WIDE_LEAF)
    pattern, size = f[at], np.diff(np.append(at, n))
    mask = ~np.bitwise_or.reduceat(f ^ np.repeat(pattern, size, axis=0), at, axis=0)
    low, high = np.minimum.reduceat(root, at), np.maximum.reduceat(root, at)
    leaf = np.repeat(np.arange(len(at)), size)
    dense = min(words, 3)  # by then most pairs are dropped
    for x in range(len(at)):
        shared = np.bitwise_count((pattern[x:] ^ pattern[x]) & mask[x:] & mask[x]).sum(axis=1, dtype=np.int64)
        open_ = np.zeros(len(at), bool)
        open_[x:] = (shared <= max_bits) & ((low[x:] != low[x]) | (high[x:] != high[x]) | (low[x] != high[x]))
        own, others = np.arange(at[x], at[x] + size[x]), np.flatnonzero(open_[leaf])
        for k in range(0, len(others), OPEN):
            other = others[k : k + OPEN]
            differ = np.zeros((len(own), len(other)), np.uint8)
            for w in range(dense):
                differ += np.bitwise_count(f[own, w][:, None] ^ f[other, w][None, :])
            i, j = np.nonzero(differ <= max_bits)
            so_far, i, j = differ[i, j].astype(np.int64), own[i], other[j]
            ok = (i < j) & (root[i] != root[j])
            so_far, i, j = so_far[ok], i[ok], j[ok]
            for w in range(dense, words):
                so_far = so_far + np.bitwise_count(f[i, w] ^ f[j, w])
                ok = so_far <= max_bits
                so_far, i, j = so_far[ok], i[ok], j[ok]
            if len(i):
                yield i, j


def _group_pairs(f: np.ndarray, root: np.ndarray, t: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """wide_pairs() of a group whose prints agree on part ``t``; a large one is divided once more by the other parts."""
    if len(f) <= WIDE_ROWS:
        yield from wide_pairs(f, root, HEAD_BITS)
        return
    bytes_ = f.astype("<u8").view(np.uint8).reshape(len(f), -1)
    for p in range(PARTS):
        if p != t:
            order = np.argsort(bytes_[:, p], kind="stable")  # leaves the Gray order within
            edges = np.searchsorted(bytes_[order, p], np.arange(257))
            for a, b in zip(edges[:-1], edges[1:]):
                at = order[a:b]
                if len(at) > 1:
                    yield from ((at[i], at[j]) for i, j in wide_pairs(f[at], root[at], HEAD_BITS))


def _by_part(nodes: DataFrame, task_rows: int, least_tasks: int) -> DataFrame:
    """Each row of ``nodes`` for each part ``t`` of its ``print``, with the ``task`` that takes all rows of the same part and bits."""
    part = lambda t: F.shiftrightunsigned(F.get("print", F.lit(t * PART // 64)), t * PART % 64).bitwiseAND(F.lit((1 << PART) - 1))
    keyed = nodes.select("*", F.posexplode(F.array(*[part(t) for t in range(PARTS)])).alias("t", "key"))
    tasks = max(least_tasks, -(-nodes.count() * PARTS // task_rows))
    return keyed.withColumn("task", F.pmod(F.xxhash64("t", "key"), F.lit(tasks)).cast("int"))


def _in_order(rows: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A task's ``rows`` by part, bits and Gray rank, their prints, heads and bytes of heads, and where each group begins (one more entry: the end)."""
    f = rows.column("print").combine_chunks().flatten().to_numpy().view(np.uint64).reshape(len(rows), -1)
    t = rows.column("t").to_numpy()
    key = np.ascontiguousarray(f[:, :HEAD]).astype("<u8").view(np.uint8).reshape(len(f), -1)[np.arange(len(f)), t]
    order = np.lexsort((gray_rank(f[:, 0]), key, t))
    f, t, key = (x[order] for x in (f, t, key))
    head = np.ascontiguousarray(f[:, :HEAD])
    edges = np.append(np.flatnonzero(np.concatenate([[True], (t[1:] != t[:-1]) | (key[1:] != key[:-1])])), len(f))
    return rows.drop_columns(["print"]).take(pa.array(order)), f, head, head.astype("<u8").view(np.uint8).reshape(len(f), -1), edges


def near_heads(nodes: DataFrame, nearest: bool) -> DataFrame:
    """Pairs ``x``, ``y`` of ``nodes(whole, root, print)`` of different roots whose heads agree on a part and differ in at most HEAD_BITS, written.

    All of them, each once, for small tables (near_clusters() holds them without a row a pair); or with ``nearest`` for each node that is in such a pair the smallest other one that a task has met.
    """
    dealt = _by_part(nodes.select("whole", "root", F.slice("print", 1, HEAD).alias("print")), TASK_ROWS, 24).select("task", "t", "whole", "root", "print")

    def run(rows: pa.Table) -> pa.Table:
        rows, _, f, bytes_, edges = _in_order(rows)
        t, whole, root = (rows.column(c).to_numpy() for c in ("t", "whole", "root"))
        ends: list[tuple[np.ndarray, np.ndarray]] = [(np.empty(0, np.int64), np.empty(0, np.int64))]
        names, place = np.unique(whole, return_inverse=True)
        least = np.full(len(names), len(names))
        for a, b in zip(edges[:-1], edges[1:]):
            own: list[tuple[np.ndarray, np.ndarray]] = []
            for i, j in _group_pairs(f[a:b], root[a:b], int(t[a])):
                i, j = i + a, j + a
                if nearest:
                    np.minimum.at(least, place[i], place[j])
                    np.minimum.at(least, place[j], place[i])
                else:
                    first = ~(bytes_[i, : t[a]] == bytes_[j, : t[a]]).any(axis=1)  # the first part on which they agree is this one
                    own.append((np.minimum(whole[i], whole[j])[first], np.maximum(whole[i], whole[j])[first]))
            if own:
                pairs = np.stack([np.concatenate([o[k] for o in own]) for k in (0, 1)], axis=1)
                ends.append(tuple(np.unique(pairs, axis=0).T) if b - a > WIDE_ROWS else tuple(pairs.T))
        if nearest:
            some = np.flatnonzero(least < len(names))
            ends.append((names[some], names[least[some]]))
        x, y = (np.concatenate([e[k] for e in ends]) for k in (0, 1))
        return pa.table({"x": pa.array(x, pa.int64()), "y": pa.array(y, pa.int64())})

    return table(dealt.groupBy("task").applyInArrow(run, "x bigint, y bigint").distinct(), "heads")


def _near_clusters(p: np.ndarray, head: np.ndarray, bytes_: np.ndarray, root: np.ndarray, n: np.ndarray, t: int, similarity: float) -> np.ndarray:
    """For each print ``p`` of a group that agrees on part ``t``, the first place of its cluster.

    Clusters are connected by pairs of different ``root`` whose sizes ``n`` allow the similarity, whose heads and whole prints are near,
    and which agree on no part before this one. Pairs are met a slice at a time and those within a cluster are not looked at again.
    """
    label = np.arange(len(p))
    for x, y in _group_pairs(head, root, t):
        for k in range(0, len(x), OPEN):
            i, j = x[k : k + OPEN], y[k : k + OPEN]
            least = np.minimum(n[i], n[j])
            ok = (label[i] != label[j]) & (least >= similarity * np.maximum(n[i], n[j]))
            i, j, least = i[ok], j[ok], least[ok]
            ok = ~(bytes_[i, :t] == bytes_[j, :t]).any(axis=1)
            i, j, least = i[ok], j[ok], least[ok]
            ok = np.bitwise_count(p[i] ^ p[j]).sum(axis=1, dtype=np.int64) <= np.where(least < MANY, NEAR_BITS_SHORT, NEAR_BITS)
            if ok.any():
                label = forest(np.append(i[ok], np.arange(len(p))), np.append(j[ok], label), len(p))
    return label


def near_clusters(nodes: DataFrame, similarity: float) -> DataFrame:
    """``t``, ``least``, ``block``, ``w``, ``node``: the members of clusters that hold each pair of ``nodes(whole, root, node, n, print)`` that the index finds and _likely() leaves, written.

    A cluster has its texts as rows, not its pairs, and a node is in one cluster of a part at most. A large one is cut into
    blocks and each two of them are a cluster, so that its texts are BLOCKS - 1 rows each, more only where HALF_HASHES asks for it.
    """
    dealt = _by_part(nodes.select("whole", "root", "node", "n", "print"), CLUSTER_ROWS, 64).select("task", "t", "whole", "root", "node", "n", "print")

    def run(rows: pa.Table) -> pa.Table:
        rows, p, head, bytes_, edges = _in_order(rows)
        t, whole, root, node, n = (rows.column(c).to_numpy() for c in ("t", "whole", "root", "node", "n"))
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(np.empty(0, np.int64),) * 3]  # places, the first of each one's cluster, blocks
        for a, b in zip(edges[:-1], edges[1:]):
            label = _near_clusters(p[a:b], head[a:b], bytes_[a:b], root[a:b], n[a:b], int(t[a]), similarity)
            linked = np.flatnonzero(np.bincount(label)[label] > 1)
            if not len(linked):
                continue
            linked = linked[np.argsort(label[linked], kind="stable")]
            for own in np.split(linked + a, np.flatnonzero(np.diff(label[linked])) + 1):
                blocks = _blocks(n[own])
                for x in range(len(blocks)):
                    for y in range(x + 1, len(blocks)) if len(blocks) > 1 else [x]:
                        both = own[np.union1d(blocks[x], blocks[y])]
                        found.append((both, np.full(len(both), own[0]), np.full(len(both), x * len(blocks) + y)))
        at, first, block = (np.concatenate([x[k] for x in found]) for k in range(3))
        return pa.table({"t": pa.array(t[at], pa.int32()), "least": whole[first], "block": block, "w": whole[at], "node": node[at]})

    return table(dealt.groupBy("task").applyInArrow(run, "t int, least bigint, block bigint, w bigint, node bigint"), "clusters")


def _blocks(n: np.ndarray) -> list[np.ndarray]:
    """Places of texts of ``n`` hashes: all of them if they can be confirmed at a time, else in blocks of half as many."""
    at = np.arange(len(n))
    if len(n) <= 2 * HALF_TEXTS and n.sum() <= 2 * HALF_HASHES:
        return [at]
    by_text, by_hash = at // max(HALF_TEXTS, -(-len(n) // BLOCKS)), (np.cumsum(n) - n) // HALF_HASHES
    return np.split(at, np.flatnonzero((np.diff(by_text) != 0) | (np.diff(by_hash) != 0)) + 1)


def _likely(pairs: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """``a``, ``aw``, ``b``, ``bw`` (nodes and hashes of the words) of the ``pairs(x, y)`` whose sizes allow the similarity and whose whole prints are near."""
    of = lambda end: nodes.select(F.col("whole").alias(f"{end}w"), F.col("node").alias(end), F.col("n").alias(f"{end}n"), F.col("print").alias(f"{end}p"))
    both = pairs.toDF("aw", "bw").join(of("a"), "aw").join(of("b"), "bw")
    least = F.least("an", "bn")
    differ = sum((F.bit_count(F.get("ap", F.lit(k)).bitwiseXOR(F.get("bp", F.lit(k)))) for k in range(WORDS)), F.lit(0))
    near = (least >= similarity * F.greatest("an", "bn")) & (differ <= F.when(least < MANY, NEAR_BITS_SHORT).otherwise(NEAR_BITS))
    return both.where(near).select("a", "aw", "b", "bw")


def _sets(docs: DataFrame, ids: DataFrame, shingle: int) -> DataFrame:
    """``w`` (the hash of the words) and ``s`` (the sorted hashes of the shingles) of the texts whose doc_id is among ``ids(id)``, written."""

    def sets(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in doc_chunks(batches, limit=1 << 20):
            h, offset, whole = shingle_hashes(texts, shingle)
            found = [np.unique(h[a:b]).tobytes() for a, b in zip(offset[:-1], offset[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(whole.view(np.int64)), pa.array(found, pa.binary())], ["w", "s"])

    of = docs.select(F.col("doc_id").cast("bigint").alias("id"), "text").join(ids.distinct(), "id", "left_semi").select("id", "text")
    return table(of.mapInArrow(sets, "w bigint, s binary").dropDuplicates(["w"]), "sets")


def _confirmed(docs: DataFrame, pairs: DataFrame, similarity: float, shingle: int) -> DataFrame:
    """``a``, ``b`` of the ``pairs(a, aw, b, bw)`` (doc_ids and hashes of the words) whose texts' sets of shingles have that Jaccard similarity, written."""
    pairs = table(pairs, "pairs")

    def near(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y")):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                common = len(np.intersect1d(x, y, assume_unique=True)) if min(len(x), len(y)) >= similarity * max(len(x), len(y)) else 0
                keep.append(common >= similarity * (len(x) + len(y) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    of = _sets(docs, pairs.select(F.col("a").alias("id")).union(pairs.select("b")), shingle)
    both = pairs.join(of.toDF("bw", "y"), "bw").join(of.toDF("aw", "x"), "aw").select("a", "b", "x", "y")
    links = table(both.mapInArrow(near, "a bigint, b bigint"), "links")
    drop(pairs, of)
    collect_garbage(docs.sparkSession)
    return links


def set_links(sets: list[np.ndarray], similarity: float) -> np.ndarray:
    """For each of the ``sets`` of hashes the first place that it is connected to by pairs of that Jaccard similarity; all pairs count."""
    n = np.array([len(x) for x in sets], np.int64)
    _, ids = np.unique(np.concatenate(sets), return_inverse=True)
    count = np.bincount(ids)
    first, holder = np.cumsum(count) - count, np.repeat(np.arange(len(sets)), n)[np.argsort(ids, kind="stable")]
    ends: list[tuple[np.ndarray, np.ndarray]] = []
    for x, own in enumerate(np.split(ids, np.cumsum(n)[:-1])):
        own = own[count[own] > 1]
        size = count[own]
        at = np.repeat(first[own] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        common = np.bincount(holder[at], minlength=len(sets))
        y = np.flatnonzero((common > 0) & (common >= similarity * (n[x] + n - common)))
        ends.append((np.full(len(y), x), y))
    return forest(*(np.concatenate([e[k] for e in ends]) for k in (0, 1)), len(sets))


def _confirmed_clusters(docs: DataFrame, clusters: DataFrame, similarity: float, shingle: int) -> DataFrame:
    """Links ``a``, ``b`` (doc_ids) that connect the texts of each of the ``clusters(t, least, block, w, node)`` as all pairs with the similarity do, written."""

    def run(rows: pa.Table) -> pa.Table:
        node = rows.column("node").to_numpy()
        label = set_links([np.frombuffer(v.as_buffer(), np.uint64) for c in rows.column("s").chunks for v in c], similarity)
        linked = np.flatnonzero(label != np.arange(len(node)))
        return pa.table({"a": node[linked], "b": node[label[linked]]})

    of = _sets(docs, clusters.select(F.col("node").alias("id")), shingle)
    links = table(clusters.join(of, "w").select("t", "least", "block", "node", "s").groupBy("t", "least", "block").applyInArrow(run, "a bigint, b bigint"), "links")
    drop(clusters, of)
    collect_garbage(docs.sparkSession)
    return links


def near_links(docs: DataFrame, nodes: DataFrame, similarity: float, shingle: int) -> DataFrame:
    """Links ``a``, ``b`` that connect the same nodes as all pairs that the index of heads finds and that have the similarity do.

    ``nodes``: ``whole``, its ``node``, ``n`` and ``print``. Each node is first held against one of those near it; then, of
    the nodes with any near, all pairs that are not yet connected, in clusters: pairs of texts that are near but not near
    enough grow with the square of a group, so they are never rows.
    """
    worded = nodes.where("n > 0")
    met = near_heads(worded.select("whole", F.col("whole").alias("root"), "print"), nearest=True)
    ends = met.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()
    links = _confirmed(docs, _likely(ends, nodes, similarity), similarity, shingle)
    roots = components(links)
    of = worded.join(met.select(F.col("x").alias("whole")).distinct(), "whole", "left_semi").join(roots, "node", "left")
    apart = table(of.select("whole", F.coalesce("root", "node").alias("root"), "node", "n", "print"), "apart")
    if apart.isEmpty():
        return links
    return links.union(_confirmed_clusters(docs, near_clusters(apart, similarity), similarity, shingle))


def near_dedup(docs: DataFrame, similarity: float = 0.8, shingle: int = 5) -> DataFrame:
    """The rows and columns of ``docs`` without those that are linked to a smaller doc_id; repeated rows stay once.

    A link: texts whose sets of shingles have the Jaccard ``similarity``, or that have the same words in lower case
    (so all texts without words are one group). 64 bits of SimHash do not tell that similarity (copies at 0.8 differ
    in 5 to 14 bits), so prints have 1,024; an index over their first 320 gives candidates, which are confirmed by
    their exact sets. At 0.8 a bit differs with a chance of 0.15: a pair agrees on no part of 8 bits with a chance of
    (1 - 0.85 ** 8) ** 40 = 4e-6 (2e-4 at worst, for sets of 4 and 5). Rows with a null doc_id stay. Of rows with one doc_id
    and several texts those stay whose text is the first of its group.
    """
    if similarity < 0.8:
        raise ValueError("the prints are made for a similarity of 0.8 or more")
    prints = _signed_prints(docs, shingle)
    least = F.min(F.struct("doc_id", "tie")).alias("least")
    nodes = table(prints.where("doc_id is not null").groupBy("whole").agg(least, F.first("n").alias("n"), F.first("print").alias("print")).select("whole", F.col("least.doc_id").alias("node"), F.col("least.tie").alias("tie"), "n", "print"), "nodes")
    roots = components(near_links(docs, nodes, similarity, shingle))
    staying = nodes.select("node", "tie").join(roots.where("node != root").select("node"), "node", "left_anti").select(F.col("node").alias("staying_id"), F.col("tie").alias("staying_tie")).distinct()
    # the keys of this join are unique but for rows that repeat, so no task has a large group
    own = [F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(docs.columns)]
    at = {c: f"c{k}" for k, c in enumerate(docs.columns)}
    rows = docs.select(*own).withColumns({"key_id": F.col(at["doc_id"]).cast("bigint"), "key_tie": F.xxhash64(at["text"])})
    kept = rows.where("key_id is not null").join(staying, (F.col("key_id") == F.col("staying_id")) & (F.col("key_tie") == F.col("staying_tie")), "left_semi")
    if not prints.where("doc_id is not null").groupBy("doc_id", "tie").count().where("count > 1").isEmpty():
        kept = kept.dropDuplicates(["key_id", "key_tie"])
    return kept.unionByName(rows.where("key_id is null")).select(*[F.col(n).alias(c) for c, n in at.items()])
