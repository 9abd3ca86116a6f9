"""Quality classifier: held-out accuracy, additivity, odd tables."""

import numpy as np
import pytest
from helpers import clashing, documents
from stayrate.llm import gam
from stayrate.llm.queries import QUERIES


def test_held_out_accuracy(spark, sf_dir):
    big = sf_dir.replace("0.001", "0.01")
    rows = QUERIES["op1_quality_gam"](spark, big).collect()
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{big}/labels.parquet").collect()}
    assert len(rows) == spark.read.parquet(f"{big}/documents.parquet").count()
    held = [(r["score"], r["predicted"], labels[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    good, bad = [s for s, _, q in held if q], [s for s, _, q in held if not q]
    auc = np.mean([(a > b) + (a == b) / 2 for a in good for b in bad])
    assert auc >= 0.98 and np.mean([p == q for _, p, q in held]) >= 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows)


def test_score_is_a_sum_of_table_entries_with_useful_pairs():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(4_000, len(gam.FEATURES)))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    model = gam.fit(x, y, rounds=20)
    assert (0, 1) in model.pairs
    assert ((model.score(x) > 0.5) == y).mean() > 0.95
    bins, row = model.bins(x[:1]), model.base
    row += sum(t[b[0]] for t, b in zip(model.single, bins)) + sum(t[bins[i][0], bins[j][0]] for (i, j), t in model.pairs.items())
    assert abs(model.score(x[:1])[0] - 1 / (1 + np.exp(-row))) < 1e-12
    again = gam.fit(x, y, rounds=20)
    assert (again.score(x) == model.score(x)).all()


ROWS = [(1, "A plain sentence, with some words."), (2, None), (3, ""), (4, " \n "), (5, "x " * 400_000), (6, "ONE ### TWO"),
        (6, "ONE ### TWO"), (None, "no id")]


def test_odd_rows(spark):
    docs = clashing(documents(spark, ROWS), "_label", "score", *gam.FEATURES[:3])
    labels = spark.createDataFrame([(1, 1), (6, 0), (6, 0), (3, None), (None, 1), (99, 1)], "doc_id long, quality int")
    model = gam.train(docs, labels)
    rows = gam.scores(docs, model).collect()
    assert len(rows) == len(ROWS) and all(0 <= r["score"] <= 1 for r in rows)
    by_id = {r["doc_id"]: r["score"] for r in rows}
    assert by_id[2] == by_id[3] == by_id[4]


def test_no_labels_and_one_kind(spark):
    docs = documents(spark, ROWS)
    none = gam.train(docs, spark.createDataFrame([], "doc_id long, quality int"))
    assert {r["score"] for r in gam.scores(docs, none).collect()} == {0.5}
    same = gam.train(docs, spark.createDataFrame([(1, 0), (6, 0)], "doc_id long, quality int"))
    assert all(r["score"] < 0.5 for r in gam.scores(docs, same).collect())
    assert gam.scores(documents(spark, []), none).count() == 0


def test_sample_is_bounded(spark):
    docs = documents(spark, [(i, f"word {i}") for i in range(50)])
    labels = spark.createDataFrame([(i, i % 2) for i in range(50)], "doc_id long, quality int")
    assert gam.train(docs, labels, sample_rows=0).base == 0.0


def test_features_equal_plain_counts():
    """Every feature by loops over letters, words and lines."""
    import math
    import random

    rnd = random.Random(5)
    pieces = ["word", "Word", "WORD", "12", "x#", "end.", "a|b", "!", "é", "\n", "\n\n", " ", "  ", "same same", "?"]
    for _ in range(200):
        text = " ".join(rnd.choice(pieces) for _ in range(rnd.randint(1, 25)))
        raw, words, lines = text.encode(), text.encode().split(), [x for x in text.encode().split(b"\n") if x.strip()]
        if not words:
            continue
        count = lambda test: sum(1 for b in raw if test(b))
        upper, lower = count(lambda b: 65 <= b <= 90), count(lambda b: 97 <= b <= 122)
        blank = count(lambda b: b in b" \t\n\x0b\x0c\r")
        n, size = len(words), len(raw)
        marks = b"#$%&*+/<=>@\\^_`{}~|[]"
        want = (
            math.log1p(n), (size - blank) / n, max(map(len, words)), upper / max(1, upper + lower),
            sum(w.upper() == w and w.lower() != w for w in words) / n, count(lambda b: 48 <= b <= 57) / (size - blank),
            count(lambda b: b in marks) / (size - blank), count(lambda b: b in b".,;:?") / n, count(lambda b: b == 33) / n,
            count(lambda b: b == 124) / n, blank / size, count(lambda b: b > 127) / size, len(set(words)) / n,
            max(words.count(w) for w in words) / n, sum(a == b for a, b in zip(words, words[1:])) / n,
            len(set(lines)) / len(lines), n / len(lines), sum(w[-1] in marks + b"!" for w in words) / n)
        assert gam.features(text) == pytest.approx(want)


def test_a_step_takes_the_best_of_all_cuts():
    """Gains of all cuts of a row of bins, and all two-level trees over a pair's first cut, by plain sums."""
    rng = np.random.default_rng(6)
    for _ in range(100):
        g, h = rng.normal(size=9), rng.random(9) + 0.1
        value = lambda part: g[part].sum() ** 2 / (h[part].sum() + 2.0)
        gains = [value(slice(0, c)) + value(slice(c, None)) - value(slice(None)) for c in range(1, 9)]
        gain, at = gam._split(g, h, 2.0)
        assert (gain, at) == (pytest.approx(max(gains)), int(np.argmax(gains)) + 1) if max(gains) > 1e-9 else at == 0
        leaves = gam._tree(g, h, 1, 2.0)
        if at:
            assert leaves[0] == pytest.approx(g[:at].sum() / (h[:at].sum() + 2.0)) and leaves[-1] == pytest.approx(g[at:].sum() / (h[at:].sum() + 2.0))
