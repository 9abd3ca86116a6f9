"""Exact top-k search against scoring everything in NumPy."""

import math

import numpy as np
import pytest
from helpers import clashing
from pyspark.sql import functions as F
from stayrate.llm import topk

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, k, every, scale=256.0):
    usable = {}
    for i, v in rows:
        if i is not None and v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v):
            usable.setdefault((len(v), i), []).append(tuple(math.floor(scale * float(np.float32(x))) for x in v))
    one = {key: min(v) for key, v in usable.items()}
    out = []
    for (dims, i), q in one.items():
        if i % every == 0 and dims == min(d for d, j in one if j == i):
            scored = [(-sum(a * b for a, b in zip(q, v)), j) for (d, j), v in one.items() if d == dims and j != i]
            out += [(i, rank + 1, j, -s) for rank, (s, j) in enumerate(sorted(scored)[:k])]
    return sorted(out)


def run(spark, rows, k=5, every=5, **more):
    df = clashing(spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA), "id", "vec", "dims", "part", "block", "low")
    return sorted(tuple(r) for r in topk.top_k(df, F.col("vec_id") % every == 0, k=k, **more).collect())


@pytest.mark.parametrize("block_rows", [8_192, 40])
def test_random_vectors(spark, block_rows):
    rng = np.random.default_rng(3)
    rows = [(int(i), [float(x) for x in rng.normal(size=8)]) for i in rng.permutation(200)]
    assert run(spark, rows, block_rows=block_rows) == brute(rows, 5, 5)


def test_one_vector_on_a_third_of_the_rows(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [0.5, 0.25, -1.0] if i % 3 else [float(x) for x in rng.normal(size=3)]) for i in range(300)]
    assert run(spark, rows, block_rows=64) == brute(rows, 5, 5)


def test_odd_rows(spark):
    rows = [(0, [1.0, 2.0]), (1, None), (2, []), (3, [1.0, None]), (4, [math.nan, 1.0]), (5, [math.inf, 1.0]), (6, [-1.0, 0.1]),
            (7, [1.0, 2.0]), (7, [1.0, 2.0]), (7, [0.5, 9.0]), (None, [3.0, 3.0]), (10, [0.0, 0.0]), (15, [1.0, 1.0, 1.0]), (0, [1.0, 2.0]),
            (20, [-0.001, 0.004])]
    assert run(spark, rows) == brute(rows, 5, 5)


def test_fewer_rows_than_k_and_none(spark):
    assert run(spark, [(0, [1.0]), (1, [2.0])]) == [(0, 1, 1, 131072)]
    assert run(spark, [(0, [1.0])]) == []
    assert run(spark, []) == []
    assert run(spark, [(1, [1.0]), (2, [1.0])]) == []
