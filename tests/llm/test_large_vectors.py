"""Exact top-k where components are very large, of both signs, and vectors are empty."""

import math
import random

import pytest

from latticework.llm import vafile_topk

MOST = (1 << 63) - 1


def brute(rows, k=10):
    whole = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(1024 * x) for x in v)]
    out = []
    for n, (q, a) in enumerate(whole):
        if q % 100 == 0:
            scores = sorted(((-sum(x * y for x, y in zip(a, b)), i) for m, (i, b) in enumerate(whole) if m != n and len(a) == len(b)))[:k]
            out += [(q, r + 1, i, max(-MOST, min(MOST, -s))) for r, (s, i) in enumerate(scores)]
    return sorted(out)


@pytest.mark.parametrize("large", [1e7, 1e8, 1e9, -1e9, 1e15, -1e30, 1e100, 1e300, -1e300])
def test_large_components(spark, large):
    rnd = random.Random(1)
    rows = [(i, [rnd.gauss(0, 1) for _ in range(6)]) for i in range(0, 800, 10)]
    rows += [(900, [large, *[rnd.gauss(0, 1) for _ in range(5)]]), (901, [-large * 0.99, *[1.0] * 5]), (902, [1.0, large / 3, 0.0, 0.0, 0.0, 0.0]), (1000, [large, large, 0.5, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    assert sorted(map(tuple, vafile_topk.exact_top_k(df).collect())) == brute(rows)


def test_empty_and_broken_vectors(spark):
    rows = [(0, []), (1, []), (2, [1.0]), (100, [2.0]), (3, [float("inf")]), (4, [None]), (5, None), (6, [float("nan")]), (200, [1e308])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, v int")
    assert sorted(map(tuple, vafile_topk.exact_top_k(df).collect())) == brute(rows) == [(0, 1, 1, 0), (100, 1, 2, 2048 * 1024)]
    assert vafile_topk.exact_top_k(df.where("false")).count() == 0
