"""The model against a plain Python count, and that it is a distribution."""

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from wardline.llm import kneserney

TEXTS = ["the cat sat on the mat", "The dog sat\non the mat", "a cat and a dog", None, "", "the the the cat", "mat on dog sat cat a", "cat", "cat", "the cat sat on the dog", "x " * 50]


def tokens(text):
    return (text or "").lower().split() + ["</s>"]


def brute(training, order):
    """probability(words) of a token after others, straight from the definition."""
    vocabulary = Counter(w for t in training for w in tokens(t))
    counts = Counter()
    for t in training:
        w = ["<s>"] * (order - 1) + tokens(t)
        counts.update(tuple(w[i : i + order]) for i in range(len(w) - order + 1))
    levels = {order: counts}
    for k in range(order - 1, 0, -1):
        down = Counter()
        for g, c in levels[k + 1].items():
            down[g[1:]] += c if g[1] == "<s>" else 1
        levels[k] = down
    d = {k: kneserney.discounts_of([sum(c == i for c in levels[k].values()) for i in (1, 2, 3, 4)]) for k in levels}
    contexts = {k: defaultdict(list) for k in levels}
    for k, level in levels.items():
        for g, c in level.items():
            contexts[k][g[:-1]].append(c)

    def p(words):
        k = len(words)
        if k == 0:
            return 1 / (len(vocabulary) + 1)
        after = contexts[k].get(words[:-1])
        if not after:
            return p(words[1:])
        cut = lambda c: d[k][min(c, 3) - 1] if c else 0
        c = levels[k].get(words, 0)
        return (c - cut(c)) / sum(after) + sum(map(cut, after)) / sum(after) * p(words[1:])

    return p, vocabulary


@pytest.mark.parametrize("order", [2, 3])
def test_scores(spark, order):
    rows = [(i, t) for i, t in enumerate(TEXTS * 3)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: r for r in kneserney.language_model_scores(docs, order).collect()}
    out = [zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows]
    p, vocabulary = brute([t for (_, t), o in zip(rows, out) if not o], order)
    n = sum(vocabulary.values())
    assert any(out) and len(got) == len(rows)
    for (i, t), o in zip(rows, out):
        w = ["<s>"] * (order - 1) + tokens(t)
        r = got[i]
        assert (r.held_out, r.n_tokens, r.train_tokens) == (o, len(tokens(t)), n)
        assert r.n_known == sum(vocabulary[x] > 0 for x in tokens(t))
        assert r.base_score == pytest.approx(sum(math.log10((vocabulary[x] + 0.1) / (n + 0.1 * (len(vocabulary) + 1))) for x in tokens(t)))
        assert r.score == pytest.approx(sum(math.log10(p(tuple(w[k : k + order]))) for k in range(len(w) - order + 1)))
    for context in (("<s>",) * (order - 1), ("the",) * (order - 1), ("unseen",) * (order - 1)):
        assert sum(p((*context, w)) for w in [*vocabulary, "never"]) == pytest.approx(1)


def test_nothing_to_learn(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert kneserney.language_model_scores(empty).count() == 0
    (row,) = kneserney.language_model_scores(spark.createDataFrame([(None, "a b")], "doc_id bigint, text string")).collect()
    assert (row.held_out, row.n_tokens, row.n_known, row.score) == (True, 3, 0, 0)


def test_extra_columns(spark):
    docs = spark.createDataFrame([(1, "a b", 5, "x"), (1, "a b", 5, "x"), (None, None, 5, "y")], "doc_id bigint, text string, score int, range string")
    assert kneserney.language_model_scores(docs).count() == 3


def test_query_counts_trigrams(spark, tmp_path):
    from wardline.llm import queries

    # wide counts beside narrow ones, and a word that only two words before tell
    rows = [(i, t) for i, t in enumerate(["a b c", "d b e"] * 300 + ["f g h"])]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in queries.op1_kneser_ney(spark, str(tmp_path)).collect()}
    out = [zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows]
    p, _ = brute([t for (_, t), o in zip(rows, out) if not o], 3)
    for i, t in rows[:2] + rows[-1:]:
        w = ["<s>", "<s>", *tokens(t)]
        assert got[i].score == pytest.approx(sum(math.log10(p(tuple(w[k : k + 3]))) for k in range(len(w) - 2)))


@pytest.mark.parametrize("n", [0, 1, 5, 3000])
def test_hash_files(n):
    """Every hash is found with its values, however large; others are not found."""
    g = np.random.default_rng(n)
    ranges = 16
    h = np.unique(g.integers(0, 2**60, n, dtype=np.uint64)) | np.uint64(3 << 60)  # of one range
    values = [g.integers(1, 4, len(h)), np.where(g.random(len(h)) < 0.1, g.integers(250, 2**40, len(h)), 7)]
    file = kneserney.HashFile(np.frombuffer(kneserney.array_file(h, values, ranges) + b"\n", np.uint8), ranges)
    assert (file.find(h) == np.arange(len(h))).all()
    assert all((file.value(k, np.arange(len(h))) == v).all() for k, v in enumerate(values))
    assert (file.find(h ^ np.uint64(1 << 40)) == -1).all()
