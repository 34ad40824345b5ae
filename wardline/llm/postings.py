"""Operator 2. Approximate nearest neighbours by balanced posting lists.

Equal vectors are one entry with their smallest TOP + 1 ids, which is all that a list of TOP can need.
Vectors get one more component that makes the largest inner product the smallest distance. Centroids come
from halving a bounded sample (SAMPLE_ROWS) again and again at the median of its main direction, and a few rounds
of k-means that hold a large list's size against it, so lists are balanced. A vector goes to its nearest list and,
at a boundary, to others nearly as near (NEAR; at most REPLICAS lists). Centroids are searched by a graph of their
neighbours, in memory. A query takes the lists whose distance is at most RATIO times the nearest one's, however many,
LEAST_PROBES at least, and more until they own TOP + 1 entries for certain. So the ratio alone decides what is
read: a few lists where vectors have clusters, many where they have none. Lists that follow each other, which came
from the same halves, are dealt out in groups of about BLOCK_ROWS entries, to which a query goes once with the names
of its lists there; groups with more entries or queries are divided, so that no task holds a whole long list.
Inner products are exact, in double precision, of a query with the entries of its lists.

Vectors that are null, zero, of another length than most (which have no inner product with them), or hold null or
non-finite components take no part; so do null ids. Equal scores: the smaller vec_id. Rows of one id count once; if
their vectors differ, with the first of them. Fewer than TOP candidates: all. Centroids are at most MOST_LISTS;
beyond that lists grow, and are divided among more tasks.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.llm.common import table

TOP, QUERY_EVERY = 20, 20
SAMPLE_ROWS, LIST_ROWS, MOST_LISTS = 50_000, 64, 8_192
REPLICAS, NEAR = 4, 1.01
RATIO, LEAST_PROBES = 1.23, 8
BLOCK_ROWS = 4_096
#: Neighbours of a centroid in the graph, and the least width of a search.
GRAPH_NEIGHBOURS, BEAM = 24, 48


def valid_entries(vectors: DataFrame) -> DataFrame:
    """``vec_id``, ``v`` (doubles) and ``vec`` (their bytes) of the rows that take part."""
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")).where("vec_id is not null and v is not null")
    size = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    n = size["n"] if size else 0
    good = rows.where((F.size("v") == n) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("v", lambda x: x != 0))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = np.stack(batch.column("v").to_numpy(zero_copy_only=False)) if batch.num_rows else np.empty((0, n))
            m = m + 0.0  # a negative zero becomes zero
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array([x.tobytes() for x in m], pa.binary())], ["vec_id", "vec"])

    return good.mapInArrow(run, "vec_id bigint, vec binary")


def distinct_entries(rows: DataFrame, top: int) -> DataFrame:
    """Each distinct ``vec`` with its smallest ``top + 1`` ids and the smallest as ``node``."""

    def shrink(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: dict[bytes, list[int]] = {}
            for i, v in sorted(set(zip(batch.column("vec_id").to_pylist(), batch.column("vec").to_pylist()))):
                ids = held.setdefault(v, [])
                if len(ids) <= top:
                    ids.append(i)
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.list_(pa.int64()))], ["vec", "ids"])

    smallest = F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, top + 1).alias("ids")
    few = rows.mapInArrow(shrink, "vec binary, ids array<bigint>").withColumn("salt", F.pmod(F.xxhash64("ids"), F.lit(64)))
    return few.groupBy("vec", "salt").agg(smallest).groupBy("vec").agg(smallest).select(F.col("ids")[0].alias("node"), "vec", "ids")


# --- centroids -----------------------------------------------------------------------------------


def augmented(v: np.ndarray, longest: float) -> np.ndarray:
    """With one more component, so that all entries have the length of the longest."""
    return np.concatenate([v, np.sqrt(np.maximum(longest - (v * v).sum(1), 0))[:, None]], 1)


def halved(v: np.ndarray, rows: int) -> np.ndarray:
    """Means of the parts that halving leaves, each of at most ``rows`` vectors."""
    out, stack = [], [np.arange(len(v))]
    while stack:
        at = stack.pop()
        if len(at) <= rows:
            out.append(v[at].mean(0))
            continue
        x = v[at] - v[at].mean(0)
        d = np.linspace(1, 2, x.shape[1])
        for _ in range(12):
            d = x.T @ (x @ d)
            d /= np.linalg.norm(d) or 1
        order = at[np.argsort(x @ d, kind="stable")]
        stack += [order[: len(at) // 2], order[len(at) // 2 :]]
    return np.array(out)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T, 0)


def balanced(v: np.ndarray, at: np.ndarray, rounds: int = 3) -> np.ndarray:
    """The centroids after some rounds of k-means in which a list's size counts as distance."""
    size = np.full(len(at), len(v) / len(at))
    for _ in range(rounds):
        best = np.empty(len(v), np.int64)
        for i in range(0, len(v), 2048):
            d = _distances(v[i : i + 2048], at)
            best[i : i + 2048] = (d * (0.9 + 0.1 * size * len(at) / len(v))).argmin(1)
        size = np.bincount(best, minlength=len(at)).astype(float)
        order = np.argsort(best, kind="stable")
        some = np.flatnonzero(size)
        at = at.copy()
        at[some] = np.add.reduceat(v[order], (np.cumsum(size) - size).astype(np.int64)[some], axis=0) / size[some, None]
    return at


class Centroids:
    """Centroids with a graph of their nearest neighbours."""

    def __init__(self, at: np.ndarray):
        self.at, k, self.width = at, min(GRAPH_NEIGHBOURS, len(at) - 1), 0
        self.links = np.zeros((len(at), max(k, 1)), np.int64)
        self.entries = np.unique(np.linspace(0, len(at) - 1, min(32, len(at))).astype(np.int64))
        for i in range(0, len(at), 1024) if k else ():
            d = _distances(at[i : i + 1024], at)
            d[np.arange(len(d)), np.arange(i, i + len(d))] = np.inf
            self.links[i : i + 1024] = np.argpartition(d, k - 1, axis=1)[:, :k]
        for i in range(len(at)) if k else ():  # a ring keeps the graph whole
            self.links[i, -1] = (i + 1) % len(at)

    def search(self, q: np.ndarray, want: int) -> tuple[np.ndarray, np.ndarray]:
        """The nearest ``want`` centroids found (all, if fewer) and their distances, nearest first."""
        n, want = len(q), min(want, len(self.at))
        beam = min(max(want, BEAM), len(self.at))
        step = max(2, beam // 24)  # centroids that a query opens at a time
        rows = np.arange(n)[:, None]
        seen = np.zeros((n, len(self.at)), bool)
        seen[:, self.entries] = True
        ids = np.tile(self.entries, (n, 1))
        dist = _distances(q, self.at[self.entries])
        opened = np.zeros(ids.shape, bool)
        square = (self.at * self.at).sum(1)
        own = (q * q).sum(1)
        while True:
            left = np.where(opened | ~np.isfinite(dist), np.inf, dist)
            best = np.argpartition(left, min(step, left.shape[1]) - 1, axis=1)[:, :step]
            live = np.isfinite(np.take_along_axis(left, best, 1))
            if not live.any():
                break
            np.put_along_axis(opened, best, True, 1)
            near = self.links[np.take_along_axis(ids, best, 1)]
            near[~live] = ids[0, 0]  # seen already
            near = near.reshape(n, -1)
            near.sort(axis=1)
            fresh = ~seen[rows, near]
            fresh[:, 1:] &= near[:, 1:] != near[:, :-1]
            seen[rows, near] = True
            some = np.nonzero(fresh)
            at = near[some]
            new = np.full(near.shape, np.inf)
            new[some] = np.maximum(own[some[0]] + square[at] - 2 * np.einsum("ij,ij->i", q[some[0]], self.at[at]), 0)
            ids, dist = np.concatenate([ids, near], 1), np.concatenate([dist, new], 1)
            opened = np.concatenate([opened, np.zeros(new.shape, bool)], 1)
            if ids.shape[1] > beam:
                keep = np.argpartition(dist, beam - 1, axis=1)[:, :beam]
                ids, dist, opened = (np.take_along_axis(x, keep, 1) for x in (ids, dist, opened))
        order = np.argsort(dist, axis=1, kind="stable")[:, :want]
        return np.take_along_axis(ids, order, 1), np.sqrt(np.take_along_axis(dist, order, 1))

    def within(self, q: np.ndarray, ratio: float, least: int, owned: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
        """The lists that each query takes, a row of the first array each, where the second is true."""
        want = max(self.width, 4 * least)
        while True:
            ids, dist = self.search(q, want)
            held = np.cumsum(owned[ids], 1)
            if want >= len(self.at) or ((held[:, -1] > top) & (dist[:, -1] > ratio * dist[:, 0])).all():
                break
            want *= 2  # the ratio, or lists that own few entries, may take more than these
        self.width = want  # where the next queries begin
        use = (dist <= ratio * dist[:, :1]) | (np.arange(ids.shape[1]) < least)
        use |= np.concatenate([np.zeros((len(q), 1)), held[:, :-1]], 1) <= top
        return ids, use & np.isfinite(dist)

    def lists_of(self, v: np.ndarray) -> list[list[int]]:
        """The lists of each vector, its own first."""
        ids, dist = self.search(v, REPLICAS)
        near = np.isfinite(dist) & (dist <= NEAR * dist[:, :1])
        near[:, 0] = True
        return [row[ok].tolist() for row, ok in zip(ids, near)]


def _matrix(batch: pa.RecordBatch | pa.Table, name: str = "vec") -> np.ndarray:
    return np.array([np.frombuffer(b, np.float64) for b in batch.column(name).to_pylist()])


def unique_ids(rows: DataFrame) -> DataFrame:
    """``rows(vec_id, vec)``, of several vectors of one id the first."""
    if rows.groupBy("vec_id").count().where("count > 1").isEmpty():
        return rows
    return table(rows.groupBy("vec_id").agg(F.min("vec").alias("vec")), "vectors")


def postings_and_probes(rows: DataFrame, top: int = TOP, every: int = QUERY_EVERY, ratio: float = RATIO, least: int = LEAST_PROBES) -> tuple[DataFrame, DataFrame, DataFrame] | None:
    """Of ``rows(vec_id, vec)`` the postings (``group``, ``list``, ``own``, ``node``, ``vec``, ``ids``), the lists that queries
    take (``group``, ``lists``, ``query``, ``vec``) and which entry each query is (``query_id``, ``node``); None without rows."""
    spark = rows.sparkSession
    entries = table(distinct_entries(rows, top), "entries")
    n = entries.count()
    if not n:
        return None
    sample = np.array([np.frombuffer(r.vec, np.float64) for r in entries.select("vec").orderBy(F.xxhash64("vec"), "vec").limit(SAMPLE_ROWS).collect()])

    def longest_of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = _matrix(batch)
            yield pa.RecordBatch.from_arrays([pa.array([float((v * v).sum(1).max(initial=0)) if len(v) else 0.0])], ["x"])

    longest = entries.select("vec").mapInArrow(longest_of, "x double").agg(F.max("x")).first()[0]
    lists = min(MOST_LISTS, max(1, -(-n // LIST_ROWS)))
    sample = augmented(sample, longest)
    centroids = Centroids(balanced(sample, halved(sample, max(1, len(sample) // lists))))
    sent = spark.sparkContext.broadcast((centroids, longest))
    together = max(1, BLOCK_ROWS * len(centroids.at) // n)  # lists of a group

    def post(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centroids, longest = sent.value
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                chosen = centroids.lists_of(augmented(_matrix(part), longest))
                at = np.repeat(np.arange(part.num_rows), [len(c) for c in chosen])
                own = np.concatenate([[True] + [False] * (len(c) - 1) for c in chosen])
                out = part.select(["node", "vec", "ids"]).take(pa.array(at))
                yield pa.RecordBatch.from_arrays([pa.array([c for x in chosen for c in x], pa.int32()), pa.array(own), *out.columns], ["list", "own", "node", "vec", "ids"])

    postings = entries.mapInArrow(post, "list int, own boolean, node bigint, vec binary, ids array<bigint>")
    postings = table(postings.withColumn("group", F.floor(F.col("list") / together).cast("int")), "postings")
    # a row a list, of which there are MOST_LISTS or few more
    owned = np.zeros(len(centroids.at), np.int64)
    for r in postings.groupBy("list").agg(F.sum(F.col("own").cast("int")).alias("own")).collect():
        owned[r["list"]] = r["own"]
    asked = rows.where(F.col("vec_id") % every == 0)
    wanted = table(asked.join(entries.select("node", "vec"), "vec").select(F.col("vec_id").alias("query_id"), "node").distinct(), "queries")

    def probe(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centroids, _ = sent.value
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                v = _matrix(part)
                ids, use = centroids.within(np.concatenate([v, np.zeros((len(v), 1))], 1), ratio, least, owned, top)
                own, lists = np.repeat(np.arange(len(v)), use.sum(1)), ids[use]
                order = np.lexsort((lists, own))
                own, lists = own[order], lists[order]
                group = lists // together
                begin = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]) | (group[1:] != group[:-1])]))
                out = part.take(pa.array(own[begin]))
                named = pa.ListArray.from_arrays(pa.array(np.append(begin, len(lists)), pa.int32()), pa.array(lists, pa.int32()))
                yield pa.RecordBatch.from_arrays([pa.array(group[begin], pa.int32()), named, out.column("query"), out.column("vec")], ["group", "lists", "query", "vec"])

    queries = entries.join(wanted.select("node").distinct(), "node", "left_semi").select(F.col("node").alias("query"), "vec")
    return postings, table(queries.mapInArrow(probe, "group int, lists array<int>, query bigint, vec binary"), "probes"), wanted


def nearest_neighbours(vectors: DataFrame, top: int = TOP, every: int = QUERY_EVERY, ratio: float = RATIO, least: int = LEAST_PROBES) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score``: each query's ``top`` nearest of the other rows.

    Queries are the rows of ``vectors(vec_id, embedding)`` whose vec_id is divisible by ``every``.
    """
    made = postings_and_probes(unique_ids(table(valid_entries(vectors), "vectors")), top, every, ratio, least)
    if made is None:
        return vectors.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    postings, probing, wanted = made
    sizes = postings.groupBy("group").agg(F.count("*").alias("rows"))
    asks = probing.groupBy("group").agg(F.count("*").alias("asks"))
    # a row a group, of which there are no more than lists
    shape = F.broadcast(sizes.join(asks, "group").select("group", F.ceil(F.col("rows") / (2 * BLOCK_ROWS)).cast("int").alias("blocks"), F.ceil(F.col("asks") / BLOCK_ROWS).cast("int").alias("turns")))
    by = ["group", "block", "turn"]
    # each block of a group meets each turn of its queries
    left = postings.join(shape, "group").select("group", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.col("turns") - 1)).alias("turn"), "list", "vec", "ids")
    right = probing.join(shape, "group").select("group", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.pmod(F.xxhash64("query"), F.col("turns")).cast("int").alias("turn"), "lists", "query", "vec")

    def compare(entry: pa.Table, query: pa.Table) -> pa.Table:
        kinds = {"query": pa.int64(), "vec_id": pa.int64(), "score": pa.float64()}
        if not len(entry) or not len(query):
            return pa.table({k: pa.array([], v) for k, v in kinds.items()})
        entry = entry.sort_by("list")
        names_of = entry.column("list").to_numpy()
        first = np.flatnonzero(np.concatenate([[True], names_of[1:] != names_of[:-1]]))
        spans = {int(names_of[a]): (a, b) for a, b in zip(first, np.append(first[1:], len(names_of)))}
        v, ids, names = _matrix(entry), entry.column("ids").to_pylist(), query.column("query").to_pylist()
        out: dict[str, list] = {k: [] for k in kinds}
        for i in range(0, len(query), 256):
            q = _matrix(query.slice(i, 256))
            near = np.full((len(q), len(v)), -np.inf)
            takers: dict[int, list[int]] = {}
            for j, lists in enumerate(query.column("lists").slice(i, 256).to_pylist()):
                for name in lists:
                    takers.setdefault(name, []).append(j)
            for name, js in takers.items():
                if name in spans:
                    a, b = spans[name]
                    near[js, a:b] = q[js] @ v[a:b].T
            k = min((top + 1) * REPLICAS, len(v))  # an entry may lie in several of the group's lists
            edge = np.maximum(np.partition(near, len(v) - k, axis=1)[:, len(v) - k], np.finfo(float).min)
            slack = 1e-9 * np.sqrt((q * q).sum(1)) * np.sqrt((v * v).sum(1).max())  # another order of summing
            for j, x in enumerate(q):
                some = np.flatnonzero(near[j] >= edge[j] - slack[j])
                score = np.einsum("j,ij->i", x, v[some])  # the same sum wherever the pair is met
                found = sorted({(-s, i_) for s, c in zip(score.tolist(), some.tolist()) for i_ in ids[c]})[: top + 1]
                out["query"] += [names[i + j]] * len(found)
                out["vec_id"] += [x_ for _, x_ in found]
                out["score"] += [-s for s, _ in found]
        return pa.table({k: pa.array(out[k], v_) for k, v_ in kinds.items()})

    found = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(compare, "query bigint, vec_id bigint, score double")
    # at most top + 1 rows a block and query; a query's own id goes last, as it has no place among them
    best = found.groupBy("query").agg(F.slice(F.array_sort(F.collect_set(F.struct((-F.col("score")).alias("less"), "vec_id"))), 1, top + 1).alias("best"))
    ranked = wanted.join(best, wanted["node"] == best["query"]).select("query_id", F.posexplode(F.slice(F.filter("best", lambda b: b["vec_id"] != F.col("query_id")), 1, top)).alias("rank", "b"))
    return ranked.select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("b.vec_id").alias("vec_id"), (-F.col("b.less")).alias("score"))
