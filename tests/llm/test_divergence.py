import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from helpers import clashing, documents

from stayrate.llm import divergence

UNIT = 10**9


def brute(rows, least=10, top=10):
    """rows (text, lang, source)."""
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        words = re.findall("[a-z\x80-\U0010ffff]+", low)
        groups.add((lang, source))
        counts[lang, source].update(words)
        docs[lang].update(set(words))
    out = []
    for lang, source in groups:
        kept = {t for t, n in docs[lang].items() if n >= least}
        v = len(kept)
        own = [s for one, s in groups if one == lang]
        total = {s: sum(counts[lang, s][t] for t in kept) for s in own}

        def p(s, t):
            return 1 + UNIT * (counts[lang, s][t] + 2) // (total[s] + 2 * v)

        def q(t):
            return 1 + UNIT * (sum(counts[lang, s][t] for s in own) + 2) // (sum(total.values()) + 2 * v)

        def f(a, b):
            return (a - b) ** 2 // (a + b)

        pairs = [(sum(f(p(source, t), p(s, t)) for t in kept), s) for s in own if s != source]
        terms = [(f(p(source, t), q(t)), t) for t in kept if counts[lang, source][t] and p(source, t) > q(t)]
        for part, found in (("pair", pairs), ("term", terms)):
            found = sorted(found, key=lambda x: (-x[0], x[1].encode()))
            out += [(lang, source, part, item, value, i + 1) for i, (value, item) in enumerate(found)
                    if part == "pair" or i < top]
    return sorted(out)


def table(spark, rows):
    return documents(spark, [(i, *row) for i, row in enumerate(rows)])


def found(df, **how):
    rows = divergence.audited(df, **how).select("lang", "source", "part", "item", "value", "rank").collect()
    return sorted(tuple(r) for r in rows)


def rows_of(n, sources, seed=1, words=60):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcéßжÀ") for _ in range(rng.randint(1, 4))) for _ in range(words)]
    return [(" ".join(rng.choices(vocabulary, k=rng.randint(0, 20))).title(), rng.choice(["en", "de"]),
             f"s{int(rng.random() ** 2 * sources)}") for _ in range(n)]


def test_equals_brute_force(spark):
    rows = rows_of(300, 5)
    assert found(table(spark, rows)) == brute(rows)


def test_many_sources_span_several_bands(spark, monkeypatch):
    rows = rows_of(400, 75, seed=2, words=30)
    expected = brute(rows)
    assert len({r[1] for r in expected}) > 2 * divergence.BAND and found(table(spark, rows)) == expected


def test_several_stripes(spark, monkeypatch):
    monkeypatch.setattr(divergence, "STRIPE", 16)
    rows = rows_of(300, 6, seed=3, words=90)
    assert found(table(spark, rows)) == brute(rows)


def test_defined_cases(spark):
    rows = [("ab cd ab", "en", "x")] * 11 + [
        (None, "en", "y"), ("", None, None), ("", None, "z"), ("solo", "fr", "x"), ("", "fr", "y"),
        ("ab\x00cd\x7fef", "en", None), ("very " * 50_000, "en", "long"),
    ] + [("tie a, tie b", "es", s) for s in "pq" for _ in range(6)]
    df = clashing(table(spark, rows), "term", "n", "rate", "value", "col", "group_no")
    got = found(df)
    assert got == brute(rows)
    # a language without kept terms has differences of 0, ties go by name
    assert [r for r in got if r[0] == "fr"] == [("fr", "x", "pair", "y", 0, 1), ("fr", "y", "pair", "x", 0, 1)]
    assert found(table(spark, [])) == []


@pytest.mark.parametrize("seed", range(8))
def test_joint_traversal_equals_a_plain_sum(seed):
    rng = np.random.default_rng(seed)
    width, n_a, n_b = int(rng.integers(0, 40)), int(rng.integers(1, 8)), int(rng.integers(1, 8))
    same = seed % 2 == 0

    def side(n):
        base = rng.integers(1, 100, n)
        rows, cols = np.nonzero(rng.random((n, width)) < rng.choice([0.02, 0.3, 0.9]))
        values = rng.integers(100, 10**9, len(rows))
        full = np.repeat(base[:, None], width, 1)
        full[rows, cols] = values
        return divergence.Tree(rows, cols, values, 6), base, full

    a, base_a, full_a = side(n_a)
    b, base_b, full_b = (a, base_a, full_a) if same else side(n_b)
    got = divergence.joint(a, b, 6, width, base_a, base_b, same)
    x, y = full_a[:, None, :].astype(object), full_b[None, :, :].astype(object)
    plain = ((x - y) ** 2 // (x + y)).sum(axis=2) if width else np.zeros((len(base_a), len(base_b)), int)
    upper = np.triu(np.ones_like(got, bool), 1) if same else np.ones_like(got, bool)
    assert (got[upper] == plain.astype(np.int64)[upper]).all()


def test_rates_are_exact_beyond_64_bits(spark):
    from pyspark.sql import functions as F

    n, total = 90_000_000_000, 7 * 10**12 + 13
    got = spark.range(1).select(divergence.rate(F.lit(n), F.lit(total)).alias("p")).first().p
    assert got == 1 + UNIT * (n + 2) // total
