import math

import numpy as np
import pytest
from helpers import clashing

from stayrate.llm import lattice

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, least=0.95):
    usable = [(i, np.array(v, dtype=np.float32).astype(float)) for i, (key, v) in enumerate(rows)
              if key is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    links = {i: set() for i in range(len(rows))}
    for i, a in usable:
        for j, b in usable:
            if i != j and len(a) == len(b) and a @ b / np.sqrt((a @ a) * (b @ b)) >= least:
                links[i].add(j)
    out = []
    for i, (key, _) in enumerate(rows):
        reached, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - reached:
                reached.add(j)
                todo.append(j)
        root = key if key is None else min(rows[j][0] for j in reached)
        out.append((key, len(links[i]), root, key is not None and key == root))
    return sorted(out, key=str)


def found(spark, rows, **how):
    df = spark.createDataFrame([(k, v, 1) for k, v in rows], SCHEMA)
    got = lattice.near_copies(clashing(df, "rep", "vec", "cell", "usable"), **how)
    return sorted((tuple(r) for r in got.select("vec_id", "n_links", "component_id", "kept").collect()), key=str)


def cluster(rng, n, noise, dims=32):
    middle = rng.normal(size=dims)
    return [(middle + noise * rng.normal(size=dims)).tolist() for _ in range(n)]


def test_clusters_chains_and_copies(spark):
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(150, 32)).tolist()
    for n, noise in ((40, 0.05), (30, 0.13), (5, 0.01)):
        vectors += cluster(rng, n, noise)
    vectors += [vectors[0]] * 20 + [(2 * np.array(vectors[1])).tolist()]
    rows = list(zip(rng.permutation(len(vectors)).tolist(), vectors))
    expected = brute(rows)
    assert max(r[1] for r in expected) >= 39
    assert found(spark, rows) == expected
    # slices of few rows, many tables and a second block give the same links
    assert found(spark, rows, slice_rows=7) == expected
    assert found(spark, rows, how=lattice.Plan(8, 2, 16, 2.2), slice_rows=16) == expected


def test_defined_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(9, [1.0, 0.0]), (3, [1.0, 0.01]), (4, None), (5, []), (6, [0.0, 0.0]), (7, [nan, 1.0]), (8, [None, 1.0]),
            (10, [inf, 1.0]), (None, [1.0, 0.0]), (9, [0.0, 1.0]), (9, [0.0, 2.0]), (11, [1e30, 0.0]), (12, [1.0, 0.0, 0.0]),
            (13, [-1.0, 0.0]), (9, [1.0, 0.0])]
    assert found(spark, rows) == brute(rows)
    assert found(spark, []) == []


@pytest.mark.parametrize("p", [lattice.plan(10**5), lattice.plan(10**7), lattice.plan(10**9)])
def test_recall_at_the_threshold(p):
    rng = np.random.default_rng(5)
    a, b = rng.normal(size=(2, 3000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b -= (a * b).sum(axis=1, keepdims=True) * a
    b = 0.95 * a + math.sqrt(1 - 0.95**2) * b / np.linalg.norm(b, axis=1, keepdims=True)
    of_a, of_b = lattice.cells(a, p), lattice.cells(b, p)
    met = (of_a == of_b[:, :, :1]).any(axis=(1, 2)) | (of_b == of_a[:, :, :1]).any(axis=(1, 2))
    assert met.mean() >= 0.98, met.mean()


def test_decoding_finds_the_nearest_lattice_point():
    rng = np.random.default_rng(6)
    y = np.rint(rng.uniform(-3, 3, size=(300, 8)) * lattice.UNIT)
    point = lattice.decoded(y)
    assert (point.sum(axis=1) % 4 == 0).all() and len(np.unique(np.abs(lattice.ROOTS).sum(axis=1))) == 2
    assert ((point % 2 == 0).all(axis=1) | (point % 2 == 1).all(axis=1)).all()
    gap = lambda c: ((2 * y - c * lattice.UNIT) ** 2).sum(axis=1)
    assert all((gap(point) <= gap(point + root)).all() for root in lattice.ROOTS)


def test_cells_do_not_depend_on_the_batch():
    x = lattice.units(np.random.default_rng(7).normal(size=(500, 48)))
    p = lattice.plan(10**7)
    assert (lattice.cells(x, p)[13] == lattice.cells(x[13:14], p)[0]).all()
