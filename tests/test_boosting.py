"""Shared boosting against a plain NumPy reference, closed forms on toy trees, and repeatability."""

import math

import numpy as np
import pytest
from pyspark import RDD
from pyspark.sql import functions as F

from stayrate.operators import boosting, training, treeshap
from stayrate.session import cut

NAMES = ["a", "b", "c"]


def table(n=300, seed=4):
    rng = np.random.RandomState(seed)
    x = np.stack([rng.normal(size=n).round(2), rng.randint(0, 4, n), rng.gamma(2, 1, n).round(3)], axis=1).astype(float)
    y = (rng.random_sample(n) < 1 / (1 + np.exp(-(2 * x[:, 0] + x[:, 1] - 2)))).astype(int)
    return x, y


@pytest.fixture(scope="module")
def frame(spark):
    x, y = table()
    rows = [(f"C{i:04d}", *map(float, v), int(t)) for i, (v, t) in enumerate(zip(x, y))]
    return cut(spark.createDataFrame(rows, "customer_id string, a double, b double, c double, churn_label int").repartition(3))


def plain(x, y, limits, s, draws=None):
    """The same rule without Spark, node by node over raw rows: margins after all rounds."""
    margin = np.full(len(y), math.log(y.mean() / (1 - y.mean())))
    trees = []
    for r in range(s.rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, p * (1 - p)
        rows, columns = (np.ones(len(y), bool), np.ones(x.shape[1], bool)) if draws is None else draws(r)
        value, leaves = np.zeros(len(y)), []

        def visit(inside, depth):
            seen = inside & rows
            n, gs, hs = seen.sum(), g[seen].sum(), h[seen].sum()
            best = (1e-9, None)
            for f in range(x.shape[1]):
                for limit in limits[f] if depth < s.depth and columns[f] else []:
                    left, right = seen & (x[:, f] <= limit), seen & (x[:, f] > limit)
                    if not left.any() or not right.any():
                        continue
                    gl, gr, hl, hr = g[left].sum(), g[right].sum(), h[left].sum(), h[right].sum()
                    if s.second_order:
                        if min(hl, hr) < s.least_weight:
                            continue
                        gain = gl**2 / (hl + s.l2) + gr**2 / (hr + s.l2) - gs**2 / (hs + s.l2)
                    else:
                        gain = left.sum() * right.sum() / n * (gl / left.sum() - gr / right.sum()) ** 2
                    if gain > best[0] * (1 + 1e-7):
                        best = (gain, (f, limit))
            if best[1] is None:
                leaf = s.rate * gs / (hs + s.l2 if s.second_order else hs)
                value[inside] = leaf
                leaves.append(leaf)
                return
            f, limit = best[1]
            visit(inside & (x[:, f] <= limit), depth + 1)
            visit(inside & (x[:, f] > limit), depth + 1)

        visit(np.ones(len(y), bool), 0)
        trees.append(sorted(leaves))
        margin = margin + value
    return margin


@pytest.mark.parametrize("s", [
    boosting.Settings(12, 0.1, 3), boosting.Settings(12, 0.1, 3, second_order=True, least_weight=1.0),
    boosting.Settings(8, 0.1, 4, second_order=True, row_share=0.8, column_share=0.7)])
def test_margins_equal_a_plain_reference(spark, frame, s):
    limits = boosting.edges(frame, NAMES)
    fit = boosting.Fit("gbt", 0, s)
    model = training.grown(frame.withColumn("groups", F.lit(1)), NAMES, limits, [fit])[0]
    rows = frame.withColumn("h", F.xxhash64("customer_id")).orderBy("customer_id").collect()
    x, y = np.array([[r[n] for n in NAMES] for r in rows]), np.array([r.churn_label for r in rows])
    keys = np.array([r.h for r in rows]).view(np.uint64)

    def draws(r):
        return (boosting._unit(keys, fit.salt, r + 1) < s.row_share,
                boosting._unit(np.arange(1, 4), fit.salt, r + 1, 77) < s.column_share)

    expected = plain(x, y, limits, s, draws)
    assert model.margins(x) == pytest.approx(expected, abs=1e-7)
    found = {r.customer_id: r.margins[0] for r in boosting.margins(frame, [model], ["customer_id"]).collect()}
    assert [found[r.customer_id] for r in rows] == pytest.approx(expected, abs=1e-7)


def test_leaves_equal_the_closed_form():
    """One split of four rows: -1, -1 against 1, 1."""
    label, bins = np.array([0.0, 0, 1, 1]), np.array([[0], [0], [1], [1]], np.uint8)
    block = boosting.Block(np.arange(4, dtype=np.uint64), label, np.ones(4, np.int64), bins, np.zeros((4, 2)))
    fits = [boosting.Fit("gbt", 0, boosting.Settings(1, 0.1, 1)),
            boosting.Fit("gbt_subsampled", 0, boosting.Settings(1, 0.1, 1, second_order=True, l2=1.0, least_weight=0.0))]
    trees = boosting.grow_round(fits, [0, 1], 1, 0, lambda wanted, level: boosting._histograms(block, fits, wanted, level, 0))
    # gradients are +-1/2, curvatures 1/4: 2 * 0.5 / (2 * 0.25) and 2 * 0.5 / (2 * 0.25 + 1)
    assert trees[0].value[1:] == pytest.approx([-0.2, 0.2]) and trees[1].value[1:] == pytest.approx([-0.1 / 1.5, 0.1 / 1.5])
    assert trees[1].gain[0] == pytest.approx(2 / 1.5) and list(trees[0].cover) == [4, 2, 2]


def test_the_same_trees_from_any_order_and_with_any_company(spark, frame, monkeypatch):
    s = training.boosted("gbt_subsampled", rounds=6)
    limits = boosting.edges(frame, NAMES)
    one = training.grown(frame.withColumn("groups", F.lit(1)), NAMES, limits, [boosting.Fit("gbt_subsampled", 0, s)])[0]
    monkeypatch.setattr(boosting, "TASK_ROWS", 40)
    monkeypatch.setattr(boosting, "LINEAGE", 2)
    fits = [boosting.Fit("gbt", 1, training.boosted("gbt", rounds=9)), boosting.Fit("gbt_subsampled", 0, s)]
    half = F.when(F.xxhash64("customer_id") % 2 == 0, 3).otherwise(1)
    other = training.grown(frame.orderBy(F.desc("customer_id")).withColumn("groups", half), NAMES, limits, fits)[1]
    for field in ("feature", "threshold", "value", "cover"):
        assert (getattr(one, field) == getattr(other, field)).all()


def test_a_broken_run_goes_on(spark, frame, monkeypatch):
    monkeypatch.setattr(boosting, "CHUNK", 3)
    fits = [boosting.Fit("gbt", 0, training.boosted("gbt", rounds=8))]
    limits, rows, parts = boosting.edges(frame, NAMES), frame.withColumn("groups", F.lit(1)), []
    whole = training.grown(rows, NAMES, limits, fits, save=parts.append)[0]
    assert [len(p[0]) for p in parts] == [3, 3, 2]
    later = []
    again = training.grown(rows, NAMES, limits, fits, parts[:2], later.append)[0]
    assert (again.value == whole.value).all() and [len(p[0]) for p in later] == [2]
    assert boosting.thawed(boosting.frozen(whole)).value.tolist() == whole.value.tolist()


def test_margins_are_not_stored_every_round(spark, frame, monkeypatch):
    """Latest trees are added while counting; when margins are stored changes no tree."""
    fits = [boosting.Fit("gbt_subsampled", 0, training.boosted("gbt_subsampled", rounds=7))]
    limits, rows, stored, persist = boosting.edges(frame, NAMES), frame.withColumn("groups", F.lit(1)), [], RDD.persist
    monkeypatch.setattr(RDD, "persist", lambda self, *level: stored.append(1) or persist(self, *level))
    some = training.grown(rows, NAMES, limits, fits)[0]
    assert len(stored) == 4  # the start, and after rounds 2, 4 and 6 of 7
    for pending in (1, 5):
        monkeypatch.setattr(boosting, "PENDING", pending)
        other = training.grown(rows, NAMES, limits, fits)[0]
        assert all((getattr(some, f) == getattr(other, f)).all() for f in ("feature", "threshold", "value", "cover"))


def test_bins_are_limits_of_the_data(spark, frame):
    x, _ = table()
    for i, e in enumerate(boosting.edges(frame, NAMES)):
        assert set(e) <= set(x[:, i]) and len(e) < boosting.BINS
        sizes = np.bincount(np.searchsorted(e, x[:, i], side="left"))
        assert sizes.min() > 0 and (len(np.unique(x[:, i])) <= boosting.BINS or sizes.max() <= 3 * len(x) / boosting.BINS)
    again = boosting.edges(frame.repartition(5), NAMES)
    assert all((a == b).all() for a, b in zip(again, boosting.edges(frame, NAMES)))


def test_pattern_tables_equal_the_integral(spark, frame):
    model = training.fit("gbt_subsampled", frame, NAMES, rounds=10)
    x, _ = table(50, 8)
    leaves = treeshap.leaf_tables(spark, model)
    quick, margin = treeshap.contributions_of(x, leaves, treeshap.pattern_tables(leaves))
    slow, same = treeshap.contributions_of(x, leaves, None)
    assert quick == pytest.approx(slow, abs=1e-12) and margin == pytest.approx(same, abs=1e-12)
    assert model.start + margin == pytest.approx(model.margins(x), abs=1e-12)
    assert treeshap.table_bytes({"share": np.zeros((300 * 32, 5))}) <= treeshap.TABLE_BYTES
    # a forest of depth 10 passes the bound and is computed row by row, with the same sums
    a = treeshap.tree_contributions(spark, model, frame, NAMES).collect()
    b = {r.customer_id: r for r in treeshap.tree_contributions(spark, model, frame, NAMES, most_bytes=0).collect()}
    assert all(r[n] == pytest.approx(b[r.customer_id][n], abs=1e-12) for r in a for n in [*NAMES, "margin", "base_value"])


def test_every_task_has_the_same_number_of_blocks(spark, frame, monkeypatch):
    monkeypatch.setattr(boosting, "TASK_ROWS", 40)
    limits, cores = boosting.edges(frame, NAMES), spark.sparkContext.defaultParallelism
    rows = frame.withColumn("groups", F.lit(1))
    blocks = boosting.packed(rows, NAMES, limits, "customer_id", "churn_label")
    sizes = boosting._dealt(blocks).glom().map(len).collect()
    assert len(sizes) == cores and set(sizes) == {sum(sizes) // cores} and sum(sizes) >= 300 / 40
    assert boosting._dealt(blocks).map(lambda row: len(row["label"])).sum() == 300
    monkeypatch.setattr(boosting, "TASK_BLOCKS", 1)
    assert boosting._dealt(blocks).getNumPartitions() == sum(sizes)


def test_fits_of_one_model_share_their_draw(monkeypatch):
    rng = np.random.RandomState(1)
    block = boosting.Block(rng.randint(0, 1 << 60, 90).astype(np.uint64), (rng.random_sample(90) < 0.4).astype(float),
                           rng.randint(1, 4, 90), rng.randint(0, 9, (90, 3)).astype(np.uint8), np.zeros((90, 3)))
    fits = [boosting.Fit("gbt_subsampled", g, training.boosted("gbt_subsampled")) for g in (0, 1)] + [
        boosting.Fit("gbt", 1, training.boosted("gbt"))]
    drawn, unit = [], boosting._unit
    monkeypatch.setattr(boosting, "_unit", lambda keys, *salt: drawn.append(salt) or unit(keys, *salt))
    wanted = {t: (boosting._empty(f.settings), [0]) for t, f in enumerate(fits)}
    sums = boosting._histograms(block, fits, wanted, 0, 3)
    assert len(drawn) == 1
    keep = unit(block.key, fits[0].salt, 4) < 0.8
    for t, f in enumerate(fits):
        used = (block.groups >> f.group & 1 == 1) & (keep if t < 2 else True)
        for i in range(3):
            assert (sums[t, 0, i] == np.bincount(block.bins[used, i], minlength=boosting.BINS)).all()
            assert sums[t, 1, i].sum() == np.rint((block.label[used] - 0.5) * boosting.UNIT).sum()
    # a row's margin moves only under the trees of its own fits
    trees = {t: boosting._empty(f.settings) for t, f in enumerate(fits)}
    for t, tree in trees.items():
        tree.value[0] = t + 1.0
    moved = boosting._advance(block, trees, fits).margin
    assert all((moved[:, t] == (block.groups >> f.group & 1) * (t + 1.0)).all() for t, f in enumerate(fits))


def test_several_fits_grow_side_by_side(spark, frame, monkeypatch):
    """Fits in tasks of their own: no job and nothing stored per level, and the trees of the other way."""
    fits = [boosting.Fit("gbt", 0, training.boosted("gbt", rounds=7)),
            boosting.Fit("gbt_subsampled", 1, training.boosted("gbt_subsampled", rounds=9)),
            boosting.Fit("gbt_subsampled", 2, training.boosted("gbt_subsampled", rounds=4))]  # of no rows
    limits, rows = boosting.edges(frame, NAMES), frame.withColumn("groups", F.when(F.xxhash64("customer_id") % 3 == 0, 1).otherwise(3))
    stored, persist = [], RDD.persist
    monkeypatch.setattr(RDD, "persist", lambda self, *level: stored.append(1) or persist(self, *level))
    monkeypatch.setattr(boosting, "TASK_ROWS", 40)
    some = training.grown(rows, NAMES, limits, fits)
    assert not stored
    monkeypatch.setattr(boosting, "OWN_ROWS", 299)  # one row less than the larger fit has
    other = training.grown(rows, NAMES, limits, fits)
    assert stored
    for a, b in zip(some, other):
        assert a.start == b.start
        assert all((getattr(a, f) == getattr(b, f)).all() for f in ("feature", "threshold", "value", "cover", "gain"))


def test_a_broken_run_side_by_side_goes_on():
    x, y = table()
    bins, key = boosting.binned(x, [np.unique(np.quantile(c, np.linspace(0.1, 0.9, 9))) for c in x.T]), np.arange(300, dtype=np.uint64)
    fit = boosting.Fit("gbt_subsampled", 0, training.boosted("gbt_subsampled", rounds=6))
    whole = boosting.Own(fit, 0.1, key, y, bins).grow([])
    again = boosting.Own(fit, 0.1, key, y, bins).grow(whole[:4])
    assert len(again) == 6 and all((a.value == b.value).all() and (a.feature == b.feature).all() for a, b in zip(whole, again))


def test_features_counted_together_give_each_its_histogram(monkeypatch):
    rng = np.random.RandomState(2)
    tops = np.array([2, 2, 2, 5, 1, 32, 7, 3])
    bins = (rng.random_sample((400, 8)) * tops).astype(np.uint8)
    bins[0] = tops - 1
    label, key, fit = (rng.random_sample(400) < 0.4).astype(np.int8), np.arange(400, dtype=np.uint64), boosting.Fit("gbt", 0, boosting.Settings(3, 0.1, 3))
    for joint, rows in ((1, 1000), (32, 64), (1024, 150), (1024, 400)):
        monkeypatch.setattr(boosting, "JOINT", joint)
        monkeypatch.setattr(boosting, "PASS_ROWS", rows)
        together = boosting._together(tops.tolist())
        assert sorted(f for g in together for f in g) == list(range(8))
        assert all(len(g) == 1 or np.prod(tops[g]) <= joint for g in together) and (joint < 1024 or len(together) == 2)
        own = boosting.Own(fit, 0.2, key, label, bins)
        block = boosting.Block(key, label.astype(float), np.ones(400, np.int64), bins, np.full((400, 1), 0.2))

        def both(wanted, level):
            sums = own.histograms(wanted, level, 0)
            assert (sums == boosting._histograms(block, [fit], wanted, level, 0)).all()
            return sums

        tree = boosting.grow_round([fit], [0], 8, 0, both)[0]
        own.advance(tree)
        assert (own.margin == boosting._advance(block, {0: tree}, [fit]).margin[:, 0]).all()
