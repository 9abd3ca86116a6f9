"""Splitting, balancing, training, contributions and scoring on a small frame with planted effects."""

import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import functions as F

from stayrate.operators import balancing, boosting, evaluation, explain, neighbours, scoring, training, treeshap
from stayrate.session import cut

NAMES = ["adoption", "logins", "delays"]


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.RandomState(5)
    rows = []
    for i in range(400):
        adoption, logins, delays = rng.beta(2, 2), rng.gamma(3, 2.5), float(rng.poisson(0.6))
        odds = 1.0 - 4 * adoption - 0.25 * logins + 0.9 * delays
        rows.append((f"C{i:04d}", adoption, logins, delays, int(rng.random() < 1 / (1 + math.exp(-odds)))))
    return cut(spark.createDataFrame(rows, "customer_id string, adoption double, logins double, delays double, churn_label int").repartition(3))


def counts(df, *by):
    return {tuple(r)[:-1]: r["count"] for r in df.groupBy(*by).count().collect()}


def test_split_is_stratified_and_repeatable(frame):
    split = balancing.stratified_split(frame, "customer_id", "churn_label")
    sizes, whole = counts(split, "churn_label", "in_train"), counts(frame, "churn_label")
    for (label,), n in whole.items():
        assert sizes[(label, False)] == math.floor(n * 0.2 + 0.5)
    again = balancing.stratified_split(frame.repartition(7), "customer_id", "churn_label")
    held = {r.customer_id for r in split.where("not in_train").collect()}
    assert held == {r.customer_id for r in again.where("not in_train").collect()}


def test_folds_are_even(frame):
    sizes = counts(balancing.stratified_folds(frame, "customer_id", "churn_label", 4), "churn_label", "fold")
    for label in (0, 1):
        per_fold = [sizes[(label, f)] for f in range(4)]
        assert max(per_fold) - min(per_fold) <= 1


def minority_points(frame):
    rows = frame.where("churn_label = 1").orderBy("customer_id").collect()
    return {r.customer_id: np.array([r[n] for n in NAMES]) for r in rows}


@pytest.mark.parametrize("bounded", [False, True])
def test_nearest_by_products_equals_plain_distances(monkeypatch, bounded):
    """The same distances to the last bit, ties by key, several keys per point, in blocks of few rows."""
    monkeypatch.setattr(neighbours, "BLOCK", 400)
    monkeypatch.setattr(neighbours, "FEW", 64)
    rng = np.random.default_rng(5)
    z = np.round(rng.normal(1000, 1, (90, 9)), 1)
    z[40:60] = np.round(z[40:60])
    names = [f"k{i:03d}" for i in rng.permutation(150)]
    hosts = pd.DataFrame({"z": list(z), "keys": [sorted(names[i:: 90]) for i in range(90)]})
    guests = pd.DataFrame({"z": list(np.concatenate([z[:30], z[:30] + 0.1]))})
    bound = np.full(60, 2.5) if bounded else None
    row, far, key = neighbours._nearest(guests, hosts, 5, bound)
    for g in range(60):
        all_ = sorted((float(np.sqrt(((guests.z[g] - h.z) ** 2).sum())), k) for h in hosts.itertuples() for k in h.keys)
        want = [x for x in all_[:6] if bound is None or x[0] <= 2.5]
        assert [x for x in zip(far[row == g].tolist(), key[row == g]) if bound is None or x[0] <= 2.5] == want


@pytest.mark.parametrize("whole", [0, 3, 30])
def test_nearest_puts_missing_distances_last(monkeypatch, whole):
    monkeypatch.setattr(neighbours, "BLOCK", 100)
    rng = np.random.default_rng(7)
    z = rng.normal(0, 1, (40, 3))
    z[whole:, 1] = np.nan
    z[1::20, 2] = np.inf
    points = pd.DataFrame({"z": list(z), "keys": [[int(i)] for i in rng.permutation(40)]})
    row, far, key = neighbours._nearest(points, points, 5)
    for g in range(40):
        d = np.sqrt(((z[g] - z) ** 2).sum(axis=1))
        want = sorted((math.isnan(v), 0 if math.isnan(v) else v, k[0]) for v, k in zip(d.tolist(), points["keys"]))[:6]
        assert key[row == g].tolist() == [k for *_, k in want]


@pytest.mark.parametrize("batch_rows", [10, 100_000])
def test_nearest_in_batches_equals_brute_force(spark, batch_rows):
    rng = np.random.default_rng(6)
    z = rng.normal(0, 1, (150, 4)).round(1)
    points = spark.createDataFrame([(i % 2, i, [float(v) for v in z[i]]) for i in range(150)], "grp int, key long, z array<double>")
    found = {r.key: r.near for r in neighbours.nearest(points, 3, cell_rows=20, fan=4, batch_rows=batch_rows).collect()}
    for i in range(150):
        far = sorted((float(np.sqrt(((z[i] - z[j]) ** 2).sum())), j) for j in range(i % 2, 150, 2) if j != i)
        assert found[i] == [j for _, j in far[:3]]


@pytest.mark.parametrize("cell_rows", [4000, 10])
def test_smote_rows_lie_between_near_minority_rows(frame, cell_rows):
    out = balancing.smote(frame, NAMES, "customer_id", "churn_label", cell_rows=cell_rows)
    assert len(set(counts(out, "churn_label").values())) == 1
    points = minority_points(frame)
    keys, matrix = list(points), np.stack(list(points.values()))
    scaled = matrix / matrix.std(axis=0)
    made = out.where("synthetic").collect()
    per_parent = {}
    for row in made:
        parent = row.customer_id.split("#")[0]
        per_parent[parent] = per_parent.get(parent, 0) + 1
        i, new = keys.index(parent), np.array([row[n] for n in NAMES])
        distance = ((scaled - scaled[i]) ** 2).sum(axis=1)
        distance[i] = np.inf
        on_line = []
        for place, j in enumerate(np.argsort(distance)[:5]):
            direction = matrix[j] - matrix[i]
            share = np.dot(new - matrix[i], direction) / np.dot(direction, direction)
            if -1e-9 <= share <= 1 + 1e-9 and np.abs(matrix[i] + share * direction - new).max() < 1e-9:
                on_line.append(place)
        assert on_line  # with one of the five nearest, whatever the size of the cells
    if len(made) >= len(keys):
        assert set(per_parent) == set(keys)
    assert max(per_parent.values()) - min(per_parent.values()) <= 1


def brute_near(matrix, keys, k):
    out = {}
    for i, key in enumerate(keys):
        far = np.sqrt(((matrix - matrix[i]) ** 2).sum(axis=1))
        order = sorted((j for j in range(len(keys)) if j != i), key=lambda j: (far[j], keys[j]))
        out[key] = [keys[j] for j in order[:k]]
    return out


def exact_case(name):
    rng = np.random.RandomState(1)
    if name == "6 wide":
        return rng.normal(size=(900, 6))
    if name == "46 wide":
        return rng.normal(size=(500, 46))
    matrix = rng.normal(size=(700, 4))
    if name == "cluster":  # a third close together, away from the others, and some far away and alone
        matrix[::3] = matrix[::3] * 0.01 + 4
        matrix[1::100] *= 50
    if name == "copies":  # a third equal to one another, and many ties
        matrix = matrix.round(0)
        matrix[::3] = 1.0
    return matrix


@pytest.mark.parametrize("name", ["6 wide", "46 wide", "cluster", "copies"])
def test_neighbours_are_exact(spark, name):
    matrix = exact_case(name)
    keys = [f"P{i * 7919 % 10007:05d}" for i in range(len(matrix))]
    rows = [(0, k, [float(v) for v in x]) for k, x in zip(keys, matrix)]
    rows += [(1, k, [float(v) for v in x]) for k, x in zip(keys[:40], matrix)] + [(2, "alone", [0.0] * matrix.shape[1])]
    points = cut(spark.createDataFrame(rows, "grp int, key string, z array<double>"))
    found = {(r.grp, r.key): r.near for r in neighbours.nearest(points, 5, cell_rows=60, fan=5).collect()}
    assert found[2, "alone"] == []
    assert {k: v for (g, k), v in found.items() if g == 0} == brute_near(matrix, keys, 5)
    assert {k: v for (g, k), v in found.items() if g == 1} == brute_near(matrix[:40], keys[:40], 5)


def test_points_travel_to_parts_not_to_every_cell(spark, monkeypatch):
    """What the neighbour search moves does not grow with the number of cells; and stays exact."""
    rng = np.random.RandomState(3)
    matrix, moved, spread = rng.normal(size=(600, 12)), [], neighbours.spread
    monkeypatch.setattr(neighbours, "spread", lambda df, rows, *keys: moved.append((rows, df.count())) or spread(df, rows, *keys))
    keys = [f"P{i:04d}" for i in range(len(matrix))]
    points = cut(spark.createDataFrame([(0, k, [float(v) for v in x]) for k, x in zip(keys, matrix)], "grp int, key string, z array<double>"))
    found = {r.key: r.near for r in neighbours.nearest(points, 5, cell_rows=20, fan=4).collect()}
    assert found == brute_near(matrix, keys, 5)
    assert len(moved) == 2 and all(0 < n <= 7 * len(matrix) for row in moved for n in row)  # six parts


def test_partitions_of_a_training_table_grow_before_they_multiply(frame):
    parts = lambda rows: training.placed(frame, rows).rdd.getNumPartitions()
    assert [parts(n) for n in (10, 50_001, 150_000, 600_000, 6_000_000, 12_000_000)] == [2, 2, 3, 12, 12, 24]


def test_a_fit_deals_its_rows_once(spark, frame, monkeypatch):
    dealt, placed = spark.sparkContext.accumulator(0), training.placed
    monkeypatch.setattr(training, "placed", lambda train, rows: placed(train, rows).mapInPandas(count, train.schema))

    def count(batches):
        for batch in batches:
            dealt.add(len(batch))
            yield batch

    training.fit("forest", frame, NAMES, numTrees=3, maxDepth=3)
    assert dealt.value == frame.count()


def test_a_forest_keeps_the_nodes_of_its_rows(spark, frame, monkeypatch):
    """Kept up to a bound, as rows would else walk down every tree at every level; the forest is the same."""
    kept = training.estimator("forest", 600_000)
    assert kept.getCacheNodeIds() and not training.estimator("forest", 1 + training.NODE_BYTES // 800).getCacheNodeIds()
    a = training.fit("forest", frame, NAMES, numTrees=5)
    monkeypatch.setattr(training, "NODE_BYTES", 0)
    b = training.fit("forest", frame, NAMES, numTrees=5)
    assert a.stages[-1].toDebugString.split("\n", 1)[1] == b.stages[-1].toDebugString.split("\n", 1)[1]


def test_fits_at_the_same_time_fill_the_cores(spark):
    cores = spark.sparkContext.defaultParallelism
    assert training.at_once(spark, 1000) == max(2, 1 + cores // 2) and training.at_once(spark, 10_000_000) == 2


def test_smote_survives_equal_rows(spark):
    """A third of the minority are copies of one row."""
    rows = [(f"m{i:03d}", 1.0 if i < 60 else i / 50, 2.0 if i < 60 else (i * 37 % 100) / 10, 1) for i in range(180)]
    rows += [(f"M{i:03d}", i / 100, i / 200, 0) for i in range(500)]
    df = spark.createDataFrame(rows, "customer_id string, a double, b double, churn_label int")
    assert counts(balancing.smote(df, ["a", "b"], "customer_id", "churn_label", cell_rows=20), "churn_label") == {(0,): 500, (1,): 500}


def test_groups_are_balanced_on_their_own(spark, frame):
    """All folds in one pass give the rows that each fold gives alone."""
    rows = cut(training.dealt(frame, 3))
    together = training.fold_synthetic(rows, NAMES, 3)
    for fold in range(3):
        alone = balancing.smote(rows.where(F.col("fold") != fold), NAMES, "customer_id", "churn_label").where("synthetic")
        mine = {r.customer_id: r for r in together.where(F.col("held") == fold).collect()}
        assert {r.customer_id for r in alone.collect()} == set(mine)
        assert all(mine[r.customer_id][n] == pytest.approx(r[n], abs=1e-12) for r in alone.collect() for n in NAMES)


@pytest.fixture(scope="module")
def fitted(frame):
    small = {
        "logistic": {}, "forest": {"numTrees": 6, "maxDepth": 4}, "gbt": {"rounds": 25},
        "gbt_subsampled": {"rounds": 25},
    }
    return {name: training.fit(name, frame, NAMES, **small[name]) for name in training.MODELS}


def test_models_find_the_planted_effect(frame, fitted):
    scored = training.score_long(fitted, frame)
    table = {r.model: r for r in evaluation.benchmark(scored).collect()}
    assert set(table) == set(training.MODELS)
    assert all(r.auc_roc > 0.75 and 0 <= r.brier < 0.25 for r in table.values())


def test_auc_agrees_with_mllib(frame, fitted):
    scored = training.score(fitted["logistic"], frame, "churn_label").withColumn("model", F.lit("m"))
    scored = scored.withColumn("probability", F.round("probability", 4))
    ours = evaluation.auc_roc(scored).first().auc_roc
    theirs = BinaryClassificationEvaluator(rawPredictionCol="probability", labelCol="churn_label", numBins=0).evaluate(scored)
    assert ours == pytest.approx(theirs, abs=2e-6)


def test_auc_on_raw_scores(spark):
    """Small scores in perfect order, ties across and within buckets, and agreement with MLlib."""
    tiny = spark.createDataFrame([("m", 1e-5, 0), ("m", 2e-5, 0), ("m", 3e-5, 1), ("m", 4e-5, 1)], "model string, probability double, churn_label int")
    assert evaluation.auc_roc(tiny).first().auc_roc == 1.0
    assert [r.tpr for r in evaluation.roc_curve(tiny).collect() if r.threshold is not None] and evaluation.roc_curve(tiny).count() == 5
    rng = np.random.RandomState(3)
    scores = np.concatenate([rng.beta(0.1, 3, 500), 1 - rng.beta(0.1, 3, 300), rng.randint(0, 5, 400) / 4])
    rows = [("m", float(p), int(rng.random() < 0.2 + 0.6 * p)) for p in scores]
    scored = spark.createDataFrame(rows, "model string, probability double, churn_label int")
    theirs = BinaryClassificationEvaluator(rawPredictionCol="probability", labelCol="churn_label", numBins=0).evaluate(scored)
    assert evaluation._auc(scored).first().auc == pytest.approx(theirs, abs=1e-9)
    running = evaluation._running(scored).orderBy(F.desc("score")).collect()
    assert [r.tp for r in running] == [sum(y for _, p, y in rows if p >= r.score) for r in running]


def test_importance(spark, frame, fitted):
    rows = training.feature_importance(spark, fitted["gbt"], NAMES).collect()
    assert sum(r.importance for r in rows) == pytest.approx(1.0) and {r.label for r in rows} == {"Adoption", "Logins", "Delays"}
    linear = training.feature_importance(spark, fitted["logistic"], NAMES).collect()
    assert all(r.importance >= 0 for r in linear)


@pytest.mark.parametrize("name", ["forest", "gbt", "gbt_subsampled"])
def test_tree_contributions_add_up(spark, frame, fitted, name):
    phi = treeshap.tree_contributions(spark, fitted[name], frame, NAMES).join(
        training.score(fitted[name], frame), "customer_id")
    for row in phi.collect():
        assert row.base_value + sum(row[n] for n in NAMES) == pytest.approx(row.margin, abs=1e-9)
        p = row.margin if name == "forest" else 1 / (1 + math.exp(-row.margin))
        assert p == pytest.approx(row.probability, abs=1e-9)


def test_tree_contributions_equal_the_definition(spark, frame, fitted):
    """Shapley values from all feature subsets, with path-dependent expectations, for some rows."""
    leaves = treeshap.leaf_tables(spark, fitted["gbt"])

    def value(x, known):
        total = 0.0
        for v, fs, lows, highs, shares in zip(*(leaves[k] for k in ("value", "feature", "low", "high", "share"))):
            for f, low, high, share in zip(fs, lows, highs, shares):
                v *= float(low < x[f] <= high) if f in known else share
            total += v
        return total

    phi = {r.customer_id: r for r in treeshap.tree_contributions(spark, fitted["gbt"], frame.orderBy("customer_id").limit(5), NAMES).collect()}
    for row in frame.orderBy("customer_id").limit(5).collect():
        x = [row[n] for n in NAMES]
        for i, name in enumerate(NAMES):
            expected = 0.0
            others = [j for j in range(3) if j != i]
            for size in range(3):
                for subset in itertools.combinations(others, size):
                    weight = math.factorial(size) * math.factorial(2 - size) / 6
                    expected += weight * (value(x, {*subset, i}) - value(x, set(subset)))
            assert phi[row.customer_id][name] == pytest.approx(expected, abs=1e-9)


def test_linear_contributions_add_up(frame, fitted):
    phi = treeshap.linear_model_contributions(fitted["logistic"], frame, NAMES).join(
        training.score(fitted["logistic"], frame), "customer_id")
    for row in phi.collect():
        assert 1 / (1 + math.exp(-row.margin)) == pytest.approx(row.probability, abs=1e-9)


def test_the_plan_of_linear_contributions_stays_small(spark, frame):
    """Under a join Spark lists what is known of the columns: once per feature, not once per subset of them."""
    names = [f"x{i}" for i in range(12)]
    wide = cut(frame.select("customer_id", "churn_label", *[(F.col(NAMES[i % 3]) * (i + 1) + i).alias(n) for i, n in enumerate(names)]))
    found = treeshap.linear_model_contributions(training.fit("logistic", wide, names), wide, names)
    assert found._jdf.queryExecution().optimizedPlan().validConstraints().size() < 100
    joined = frame.select("customer_id", "adoption").join(found, "customer_id").collect()
    assert len(joined) == 400
    assert all(r.margin == pytest.approx(r.base_value + sum(r[n] for n in names), abs=1e-9) for r in joined)


def test_cross_validation_reports_every_fold(frame):
    rows = training.cross_validate(["logistic"], frame, NAMES, folds=3).collect()
    assert sorted(r.fold for r in rows) == [0, 1, 2] and all(r.auc_roc > 0.6 for r in rows)


def test_the_published_settings_are_validated(spark, tmp_path, monkeypatch):
    """Every fit that a run's validation asks for has the published settings."""
    from datetime import date

    from stayrate.plans.models import ModelRun

    asked, fit, grow = [], training.fit, training.grown

    def small(name, train, names, **overrides):
        asked.append((name, overrides))
        return fit("logistic", train, names)

    def short(rows, names, limits, fits, *rest):
        asked.extend((f.name, f.settings) for f in fits)
        return grow(rows, names, limits, [f._replace(settings=f.settings._replace(rounds=2)) for f in fits], *rest)

    run = ModelRun(type("Tables", (), {"spark": spark}), date(2025, 6, 1), str(tmp_path))
    rows = [(f"C{i:03d}", float(i % 7), i % 3 == 0) for i in range(60)]
    run.__dict__["matrix"] = spark.createDataFrame(rows, "customer_id string, x double, y boolean").select(
        "customer_id", "x", F.col("y").cast("int").alias("churn_label"), F.lit(True).alias("in_train"))
    monkeypatch.setattr(training, "fit", small)
    monkeypatch.setattr(training, "grown", short)
    assert run.validated.count() == 20
    mllib = [(n, s) for n, s in asked if n not in boosting.PUBLISHED]
    assert sorted(n for n, _ in mllib) == sorted(["logistic", "forest"] * 5) and not any(o for _, o in mllib)
    grown = [(n, s) for n, s in asked if n in boosting.PUBLISHED]
    # five folds and the whole training part, in the same passes
    assert sorted(n for n, _ in grown) == sorted(["gbt", "gbt_subsampled"] * 6)
    assert all(s == boosting.PUBLISHED[n] for n, s in grown)
    made = training.estimator("forest", 60)
    assert all(made.getOrDefault(key) == value for key, value in training.FOREST.items())
    assert boosting.PUBLISHED["gbt"][:3] == (200, 0.05, 4) and boosting.PUBLISHED["gbt_subsampled"][:6] == (300, 0.05, 5, True, 0.8, 0.8)


def test_the_best_mean_wins(spark):
    rows = [("gbt", 0, 0.8, 0.1), ("gbt", 1, 0.7, 0.1), ("logistic", 0, 0.9, 0.2), ("logistic", 1, 0.7, 0.2), ("forest", 0, 0.8, 0.1),
            ("forest", 1, 0.8, 0.1)]
    best = {r.model: r for r in training.choose(spark.createDataFrame(rows, "model string, fold int, auc_roc double, brier double")).collect()}
    assert [m for m, r in best.items() if r.winner] == ["forest"] and best["logistic"].cv_auc == pytest.approx(0.8)


def test_logistic_can_win(spark):
    """A linear effect in few rows: the logistic model beats shallow ensembles in cross-validation."""
    rng = np.random.RandomState(9)
    rows = []
    for i in range(240):
        x = rng.normal(size=3)
        rows.append((f"L{i:03d}", *map(float, x), int(rng.random() < 1 / (1 + math.exp(-(1.5 * x.sum() - 1))))))
    df = cut(spark.createDataFrame(rows, "customer_id string, adoption double, logins double, delays double, churn_label int"))
    small = {"forest": {"numTrees": 3, "maxDepth": 2}}
    validated = cut(training.cross_validate(["logistic", "forest"], df, NAMES, folds=2, overrides=small))
    assert training.choose(validated).where("winner").first().model == "logistic"


def test_fits_do_not_depend_on_the_order_of_rows(frame):
    """Same probabilities from rows ascending in 2 and descending in 5 partitions, to the noise of adding up."""
    small = {"logistic": {}, "forest": {"numTrees": 5, "maxDepth": 4}, "gbt": {"rounds": 4}, "gbt_subsampled": {"rounds": 4}}
    up = cut(frame.repartitionByRange(2, "customer_id").sortWithinPartitions("customer_id"))
    down = cut(frame.repartitionByRange(5, F.desc("customer_id")).sortWithinPartitions(F.desc("customer_id")))
    for name in training.MODELS:
        a, b = ({r.customer_id: r.probability for r in training.score(training.fit(name, rows, NAMES, **small[name]), frame).collect()}
                for rows in (up, down))
        assert all(a[k] == pytest.approx(b[k], abs=1e-9) for k in a)


def test_tier_follows_the_rounded_probability(spark):
    df = spark.createDataFrame([("a", 0.69996), ("b", 0.69994), ("c", 0.3), ("d", 0.29994)], "customer_id string, probability double")
    assert {r.customer_id: r.risk_tier for r in scoring.tiers(df).collect()} == {
        "a": "Critical", "b": "High", "c": "Medium", "d": "Low"}


def test_top_drivers_skip_negative_parts(spark):
    df = spark.createDataFrame([("a", 0.5, -1.0, 0.7), ("b", -0.1, -0.2, -0.3)], "customer_id string, x double, y double, z double")
    rows = {r.customer_id: r for r in explain.top_drivers(df, ["x", "y", "z"]).collect()}
    assert (rows["a"].top_driver_1, rows["a"].top_driver_2, rows["a"].top_driver_3) == ("z", "x", None)
    assert rows["b"].top_driver_1 is None
