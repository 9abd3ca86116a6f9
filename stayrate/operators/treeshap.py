"""Path-dependent Shapley values of tree ensembles, computed where the rows are.

For a leaf of value v whose path tests features with cover shares z and outcomes o in {0, 1}, the Shapley
value of feature i is  v (o_i - z_i) * integral over t in [0, 1] of prod_{j != i} (z_j (1 - t) + o_j t).
The integrand is a polynomial, so a short Gauss-Legendre rule gives the integral exactly.

A leaf with d features on its path knows 2**d outcome patterns only, so their contributions are computed once, with the
model: a pattern table. A row is then a pattern number per leaf and a look-up. Models whose tables would pass
``TABLE_BYTES`` (a forest of depth 10) compute the integral row by row instead, with the same result.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stayrate.operators import boosting
from stayrate.session import scratch_path

#: Largest pattern tables of a model that are sent to the tasks.
TABLE_BYTES = 64 << 20


def _nodes(spark, classifier) -> tuple[DataFrame, list[float]]:
    """Nodes of a fitted ensemble, read from its saved form, and the tree weights."""
    path = scratch_path(spark, "trees")
    classifier.write().overwrite().save(path)
    data = spark.read.parquet(f"{path}/data")
    n = data.select(F.col("treeID").alias("tree"), "nodeData.*")
    return n.select(
        "tree", "id", "prediction", "impurityStats", "rawCount", "leftChild", "rightChild",
        F.col("split.featureIndex").alias("feature"),
        F.get("split.leftCategoriesOrThreshold", F.lit(0)).alias("threshold"),
    ), list(classifier.treeWeights)


def _forest_leaves(spark, model: PipelineModel) -> list[tuple[float, dict]]:
    """(value, path) of all leaves of a fitted forest, on the scale of probabilities."""
    nodes, weights = _nodes(spark, model.stages[-1])
    trees: dict[int, dict[int, object]] = {}
    for node in nodes.toLocalIterator():
        trees.setdefault(node["tree"], {})[node["id"]] = node
    leaves = []
    for tree, by_id in trees.items():
        stack = [(by_id[0], {})]
        while stack:
            node, path = stack.pop()
            if node["leftChild"] < 0:
                share = node["impurityStats"][1] / sum(node["impurityStats"])
                leaves.append((share * weights[tree] / sum(weights), path))
                continue
            for child, limits in _children(path, node["feature"], node["threshold"], node["leftChild"], node["rightChild"]):
                part = by_id[child]["rawCount"] / node["rawCount"]
                stack.append((by_id[child], _longer(path, node["feature"], limits, part)))
    return leaves


def _children(path: dict, feature: int, cut: float, left: int, right: int):
    low, high, _ = path.get(feature, (-np.inf, np.inf, 1.0))
    return (left, (low, min(high, cut))), (right, (max(low, cut), high))


def _longer(path: dict, feature: int, limits: tuple[float, float], part: float) -> dict:
    return {**path, feature: (*limits, path.get(feature, (0, 0, 1.0))[2] * part)}


def _boosted_leaves(model: boosting.Ensemble) -> list[tuple[float, dict]]:
    """(value, path) of all leaves of a boosted model, on the scale of log-odds."""
    leaves = []
    for feature, threshold, value, cover in zip(model.feature, model.threshold, model.value, model.cover):
        stack = [(0, {})]
        while stack:
            node, path = stack.pop()
            if feature[node] < 0:
                leaves.append((float(value[node]), path))
                continue
            f = int(feature[node])
            for child, limits in _children(path, f, float(threshold[node]), 2 * node + 1, 2 * node + 2):
                stack.append((child, _longer(path, f, limits, cover[child] / cover[node])))
    return leaves


def leaf_tables(spark, model) -> dict[str, np.ndarray]:
    """All leaves of all trees as arrays padded to the longest path: the model, bounded by its own size.

    Per leaf and path feature: feature index, open lower and closed upper limit, cover share; per leaf:
    value times tree weight. Boosted margins are on the log-odds scale, forests on the probability scale.
    """
    leaves = _boosted_leaves(model) if isinstance(model, boosting.Ensemble) else _forest_leaves(spark, model)
    depth = max([1, *(len(path) for _, path in leaves)])
    shape = (len(leaves), depth)
    tables = {
        "value": np.array([value for value, _ in leaves]),
        "feature": np.zeros(shape, dtype=np.int32), "low": np.full(shape, -np.inf),
        "high": np.full(shape, np.inf), "share": np.ones(shape),
    }
    for i, (_, path) in enumerate(leaves):
        for j, (f, (low, high, share)) in enumerate(path.items()):
            tables["feature"][i, j], tables["low"][i, j], tables["high"][i, j], tables["share"][i, j] = f, low, high, share
    return tables


def _rule(depth: int) -> tuple[np.ndarray, np.ndarray]:
    points, weights = np.polynomial.legendre.leggauss((depth + 1) // 2)
    return (points + 1) / 2, weights / 2


def _gains(met: np.ndarray, part: dict[str, np.ndarray]) -> np.ndarray:
    """Contributions (rows x leaves x path features) for outcomes ``met``; a padded place has share 1 and is met."""
    gain = np.zeros(np.broadcast_shapes(met.shape, part["share"].shape))
    for t, w in zip(*_rule(part["share"].shape[1])):
        factors = part["share"] * (1 - t) + met * t
        gain += w * factors.prod(axis=2, keepdims=True) / factors
    return gain * (met - part["share"]) * part["value"][None, :, None]


def table_bytes(tables: dict[str, np.ndarray]) -> int:
    leaves, depth = tables["share"].shape
    return 8 * leaves * (1 << depth) * (depth + 1)


def pattern_tables(tables: dict[str, np.ndarray]) -> np.ndarray:
    """Contributions per leaf, outcome pattern and path feature, and last the leaf's value where all are met."""
    leaves, depth = tables["share"].shape
    patterns = ((np.arange(1 << depth)[:, None] >> np.arange(depth)) & 1).astype(float)
    out = np.empty((leaves, 1 << depth, depth + 1))
    block = max(1, (1 << 20) // (len(patterns) * depth))
    for start in range(0, leaves, block):
        part = {k: v[start:start + block] for k, v in tables.items()}
        gains = _gains(np.broadcast_to(patterns[:, None, :], (len(patterns), len(part["value"]), depth)), part)
        out[start:start + block, :, :depth] = gains.swapaxes(0, 1)
    out[:, :, depth] = tables["value"][:, None] * (np.arange(1 << depth) == (1 << depth) - 1)
    return out


def _met(x: np.ndarray, part: dict[str, np.ndarray]) -> np.ndarray:
    values = x[:, part["feature"]]
    return (values > part["low"]) & (values <= part["high"])


def contributions_of(x: np.ndarray, tables: dict[str, np.ndarray], patterns: np.ndarray | None,
                     leaf_block: int = 512, row_block: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """Contributions (rows x features) and margins without the base."""
    width = x.shape[1]
    phi, margin = np.zeros((len(x), width)), np.zeros(len(x))
    depth = tables["share"].shape[1]
    powers = 1 << np.arange(depth)
    for start in range(0, len(tables["value"]), leaf_block):
        part = {k: v[start:start + leaf_block] for k, v in tables.items()}
        select = np.zeros((part["feature"].size, width))
        select[np.arange(part["feature"].size), part["feature"].ravel()] = 1.0
        for first in range(0, len(x), row_block):
            met = _met(x[first:first + row_block], part)
            if patterns is None:
                gain = _gains(met.astype(float), part)
                margin[first:first + row_block] += met.prod(axis=2) @ part["value"]
            else:
                number = met @ powers
                found = patterns[start + np.arange(len(part["value"]))[None, :], number]
                gain = found[:, :, :depth]
                margin[first:first + row_block] += found[:, :, depth].sum(axis=1)
            phi[first:first + row_block] += gain.reshape(len(met), -1) @ select
    return phi, margin


def tree_contributions(
    spark, model, frame: DataFrame, names: Sequence[str], keep: Sequence[str] = ("customer_id",), most_bytes: int = TABLE_BYTES,
) -> DataFrame:
    """keep columns, base_value, margin, and one contribution column per feature; base + sum = margin."""
    tables = leaf_tables(spark, model)
    start = model.start if isinstance(model, boosting.Ensemble) else 0.0
    patterns = pattern_tables(tables) if table_bytes(tables) <= most_bytes else None
    shared = spark.sparkContext.broadcast((tables, patterns))
    width = len(names)
    rows = frame.select(*keep, F.array(*[F.col(f"`{n}`").cast("double") for n in names]).alias("x"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frame.select(*keep).schema)

    def contributions(batches):
        leaves, known = shared.value
        base = start + float((leaves["value"] * leaves["share"].prod(axis=1)).sum())
        for batch in batches:
            x = np.stack(batch["x"].to_numpy()) if len(batch) else np.zeros((0, width))
            phi, margin = contributions_of(x, leaves, known)
            yield batch.drop(columns="x").assign(base_value=base, margin=start + margin, phi=list(phi))

    found = rows.mapInPandas(contributions, f"{schema}, base_value double, margin double, phi array<double>")
    return found.select(
        *keep, "base_value", "margin", *[F.col("phi")[i].alias(n) for i, n in enumerate(names)]
    )


def linear_model_contributions(
    model: PipelineModel, frame: DataFrame, names: Sequence[str], keep: Sequence[str] = ("customer_id",)
) -> DataFrame:
    """The same columns for a scaled logistic model, as plain column arithmetic."""
    scaler, classifier = model.stages[1], model.stages[2]
    parts = [
        (F.col(f"`{n}`") - float(m)) / float(s or 1.0) * float(c)
        for n, m, s, c in zip(names, scaler.mean, scaler.std, classifier.coefficients)
    ]
    base = F.lit(float(classifier.intercept))
    # a sum of the very expressions that get names below has a plan of 2**features constraints under a join or a filter
    values = F.array(*[F.col(f"`{n}`").cast("double") for n in names])
    rules = F.array(*[
        F.struct(F.lit(float(m)).alias("mean"), F.lit(float(s or 1.0)).alias("sd"), F.lit(float(c)).alias("by"))
        for m, s, c in zip(scaler.mean, scaler.std, classifier.coefficients)])
    found = F.zip_with(values, rules, lambda x, rule: (x - rule["mean"]) / rule["sd"] * rule["by"])
    margin = F.aggregate(found, base, lambda total, part: total + part)
    return frame.select(*keep, base.alias("base_value"), margin.alias("margin"), *[p.alias(n) for p, n in zip(parts, names)])
