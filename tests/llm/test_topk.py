import random

import numpy as np
from helpers import rows
from pyspark.sql import functions as F

from itemlab.llm import topk


def brute(vectors, k):
    usable = [(i, [int(np.floor(64 * float(np.float32(x)))) for x in v]) for i, v in vectors if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, a in {(i, tuple(v)) for i, v in usable if i % 20 == 0}:
        scored = sorted((-sum(x * y for x, y in zip(a, v)), i) for i, v in usable if i != q and len(v) == len(a))
        out += [(q, rank, i, -s) for rank, (s, i) in enumerate(scored[:k], 1)]
    return sorted(out)


def table(spark, vectors):
    shape = "vec_id long, embedding array<float>, label int, id string, block string, dims string, rank string, score string"
    return spark.createDataFrame([(i, v, 0, *"abcde") for i, v in vectors], shape)


def check(spark, vectors, k, **sizes):
    found = rows(topk.search(table(spark, vectors), F.col("vec_id") % 20 == 0, k, **sizes))
    assert sorted(found) == brute(vectors, k)


def test_random_vectors_in_small_blocks(spark):
    rng = random.Random(4)
    vectors = [(i, [rng.gauss(0, 1) for _ in range(6)]) for i in range(400)]
    check(spark, vectors, 7, candidates=60, queries=5)
    check(spark, vectors, 1000)


def test_ties_and_skewed_lists(spark):
    rng = random.Random(5)
    vectors = [(i, [rng.choice([-1.0, 0.0, 0.5, 40.0 if i % 50 == 0 else 0.25]) for _ in range(4)]) for i in range(300)]
    check(spark, vectors, 20, candidates=100)


def test_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    vectors = [(0, [1.0, 2.0]), (20, None), (40, [1.0, None]), (60, [nan, 1.0]), (80, [inf, 0.0]), (100, []), (None, [5.0, 5.0])]
    vectors += [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [-0.01, 0.01]), (3, [1.0, 2.0, 3.0]), (120, [0.0, 0.0]), (140, [9.0, 9.0, 9.0])]
    check(spark, vectors, 20)
    assert rows(topk.search(table(spark, vectors).limit(0), F.col("vec_id") % 20 == 0)) == []
    assert rows(topk.search(table(spark, [(1, [1.0])]), F.col("vec_id") % 20 == 0)) == []


def test_the_search_stops_early_and_is_exact():
    rng = np.random.default_rng(6)
    matrix = np.floor(64 * rng.pareto(1.0, (5000, 3)))
    met = []

    class Counting(np.ndarray):
        def __getitem__(self, key):
            if isinstance(key, np.ndarray):
                met.append(len(key))
            return super().__getitem__(key)

    queries = matrix[:3]
    row, ids, scores = topk.threshold_search(queries, np.arange(3), matrix.view(Counting), np.arange(5000), 10)
    assert sum(met) < 5000
    for q in range(3):
        full = matrix @ queries[q]
        full[q] = -1
        best = np.lexsort((np.arange(5000), -full))[:10]
        assert ids[row == q].tolist() == best.tolist() and np.asarray(scores)[row == q].tolist() == full[best].tolist()


def test_large_numbers_stay_exact():
    for kind, size in ((np.int64, 10**8), (object, 10**18)):
        matrix = np.array([[size, 1], [size, 2], [-size, 3], [size, 2]], dtype=kind)
        row, ids, scores = topk.threshold_search(matrix[:1], np.array([0]), matrix, np.arange(4), 2)
        assert ids.tolist() == [1, 3] and scores.tolist() == [size * size + 2] * 2
