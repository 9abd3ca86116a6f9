"""Mixing: targets against a direct computation, the balance, the bounds, reruns."""

import math
from collections import defaultdict

import pytest
from helpers import clashing, documents
from stayrate.llm import mixing
from stayrate.llm.queries import QUERIES


def brute_targets(sizes, weights=(5.0, 2.0, 1.0), most=3.0):
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while True:
        free = sum(w for s, w in weight.items() if s not in full)
        level = (total - most * sum(sizes[s] for s in full)) / free if free else 0.0
        more = {s for s in names if s not in full and weight[s] * level > most * sizes[s]}
        if not more:
            return {s: most * sizes[s] if s in full else weight[s] * level for s in names}
        full |= more


def check(rows, docs, near=0.02):
    """Bounds and totals of a mix; ``docs`` maps id to (words, source)."""
    sizes, taken, target = defaultdict(int), defaultdict(int), {}
    smallest = defaultdict(lambda: math.inf)
    for r in rows:
        words, source = docs[r["doc_id"]]
        assert r["size"] == words and 0 <= r["copies"] <= 3 and r["taken"] == r["copies"] * words
        sizes[source] += words
        taken[source] += r["taken"]
        target[source] = r["target"]
        if words:
            smallest[source] = min(smallest[source], words)
    want = brute_targets(dict(sizes))
    for source, aim in want.items():
        assert target[source] == pytest.approx(aim, rel=1e-12)
        assert abs(taken[source] - aim) <= max(near * aim, 3 * smallest[source] if sizes[source] else 0)
    assert all(r["source_size"] == sizes[docs[r["doc_id"]][1]] for r in rows)


def test_tables_come_near_their_targets_and_reruns_agree(spark, sf_dir):
    run = lambda: sorted(map(tuple, QUERIES["op4_entropy_mix"](spark, sf_dir).collect()))
    first, docs = run(), {}
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        docs[r["doc_id"]] = (len((r["text"] or "").encode().split()), r["source"])
    names = ("doc_id", "size", "source_size", "target", "taken", "copies")
    check([dict(zip(names, row)) for row in first], docs, near=0.05)
    assert run() == first


def test_odd_rows(spark):
    rows = [(i, "w " * (i % 17 + 1), "en", "big") for i in range(600)]
    rows += [(1_000 + i, "same words in every copy", "en", "copies") for i in range(900)]
    rows += [(3_000, None, "en", None), (3_001, "one two", "en", None), (3_002, "a b c", "en", None), (3_003, "", "en", "void"),
             (3_004, " one　word", "en", "thin"), (3_005, "x " * 300_000, "en", "long"), (3_006, "z", "en", "")]
    docs = clashing(documents(spark, rows), "size", "part", "source_key", "copies", "rate", "_size")
    found = [r.asDict() for r in mixing.mixed(docs).collect()]
    assert len(found) == len(rows)
    check(found, {r[0]: (len((r[1] or "").encode().split()), r[3]) for r in rows}, near=0.02)
    assert [r["copies"] for r in found if r["size"] == 0] == [1, 1]
    out = mixing.repeated(docs, mixing.shares(docs))
    assert out.columns == docs.columns and out.count() == sum(r["copies"] for r in found)


def test_rates_are_tilted_exponentially(spark):
    rows = [(i, "w " * (i % 40 + 1), "en", "ab"[i % 2]) for i in range(800)]
    by_source = defaultdict(list)
    for r in mixing.mixed(documents(spark, rows)).collect():
        by_source[r["source_key"]].append((r["size"], r["rate"], r["target"]))
    for found in by_source.values():
        assert sum(s * rate for s, rate, _ in found) == pytest.approx(found[0][2], rel=1e-6)
        slopes = [math.log(rate) / s for s, rate, _ in found if s and rate < 3]
        assert max(slopes) - min(slopes) < 1e-9


def test_repeated_rows_null_ids_and_empty(spark):
    rows = [(1, "a b c", "en", "x"), (1, "a b c", "en", "x"), (None, "d e", "en", "y"), (None, "d e", "en", "y"), (2, "f", "en", "z")]
    docs = documents(spark, rows)
    found = mixing.mixed(docs).collect()
    assert len(found) == 5
    assert mixing.repeated(docs, mixing.shares(docs)).count() == sum(r["copies"] for r in found)
    assert mixing.mixed(documents(spark, [])).count() == 0
    nothing = mixing.mixed(documents(spark, [(1, "", "en", "x"), (2, None, "en", "y")])).collect()
    assert [(r["target"], r["taken"]) for r in nothing] == [(0.0, 0), (0.0, 0)]


@pytest.mark.parametrize("ids", ["one id", "no id", "one row", "other columns"])
def test_repeated_and_null_ids_come_near_their_targets(spark, monkeypatch, ids):
    """A source of 500 rows that share an id, or have none, beside two of plain rows; within a document of the target."""
    monkeypatch.setattr(mixing, "PIECE", 64)
    many = {"one id": lambda i: (7, "w " * (i % 9 + 1)), "no id": lambda i: (None, "w " * (i % 9 + 1)),
            "one row": lambda i: (7, "just the same"), "other columns": lambda i: (7, "just the same")}[ids]
    rows = [(*many(i), "en" if ids != "other columns" else f"l{i % 7}", "b") for i in range(500)]
    rows += [(1_000 + i, "v " * (i % 5 + 3), "en", "ac"[i % 2]) for i in range(1_500)]
    docs = documents(spark, rows)
    found = mixing.mixed(docs).collect()
    assert len(found) == len(rows)
    taken, target = defaultdict(int), {}
    for r in found:
        taken[r["source_key"]] += r["taken"]
        target[r["source_key"]] = r["target"]
    assert all(abs(taken[s] - target[s]) <= 9 for s in target), (taken, target)
    out = mixing.repeated(docs, mixing.shares(docs)).collect()
    assert sum(r["source"] == "b" for r in out) == sum(r["copies"] for r in found if r["source_key"] == "=b")
    assert sum(len(r["text"].split()) for r in out if r["source"] == "b") == taken["=b"]
    assert sorted(map(tuple, mixing.repeated(docs, mixing.shares(docs.repartition(5))).collect()), key=str) == sorted(map(tuple, out), key=str)


def test_an_unsolved_balance_is_an_error(spark):
    hist = spark.createDataFrame([("=a", 3, 10), ("=a", 5, 10)], "source_key string, size long, n long")
    aims = spark.createDataFrame([("=a", 80, 100.0)], "source_key string, source_size long, target double")
    with pytest.raises(RuntimeError):
        mixing.tilts(hist, aims, rounds=1)
