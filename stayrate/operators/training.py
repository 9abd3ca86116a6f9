"""Model training on balanced frames, validation by folds, evaluation and scoring of fitted models.

The logistic model and the forest are MLlib pipelines; the two boosted models are grown by ``boosting``, all folds
together.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from multiprocessing.pool import ThreadPool

from pyspark import StorageLevel, inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stayrate.operators import boosting, evaluation
from stayrate.operators.balancing import SEED, smote, smote_groups, stratified_folds
from stayrate.session import cut

KEY, LABEL = "customer_id", "churn_label"

# fixed values: published hyper-parameters
REGULARISATION_C = 0.1
FOREST = {"numTrees": 200, "maxDepth": 10, "minInstancesPerNode": 5, "featureSubsetStrategy": "sqrt"}
#: Rows of a partition of a training table; from ``PARTITIONS`` of them on they grow up to the larger number first. Bagging
#: draws per partition, so their number follows from the rows alone, not from the cluster. Every partition sends the
#: statistics of all open nodes of a forest, far more than its own rows at the smaller size.
PARTITION_ROWS, PARTITIONS, LARGE_PARTITION_ROWS = 50_000, 12, 500_000
#: Fits of folds that run at the same time at least; more where their partitions leave cores idle.
AT_ONCE = 2
#: Nodes of all rows in all trees of a forest (four bytes each) are kept from level to level up to this size; beyond it rows
#: walk down their trees again at every level. The forest is the same.
NODE_BYTES = 1 << 30
MODELS = ["logistic", "forest", "gbt", "gbt_subsampled"]
Model = PipelineModel | boosting.Ensemble


def estimator(name: str, rows: int, **overrides):
    """The MLlib classifier of a model name. ``rows`` turns the penalty of a summed loss into that of a mean loss."""
    common = {"labelCol": LABEL, "featuresCol": "features"}
    if name == "logistic":
        params = {
            "regParam": 1.0 / (REGULARISATION_C * rows), "elasticNetParam": 0.0, "maxIter": 1000, "standardization": False,
        }
        return LogisticRegression(**common, **{**params, **overrides})
    if name == "forest":
        params = {**FOREST, **overrides}
        kept = 4 * rows * params["numTrees"] <= NODE_BYTES
        return RandomForestClassifier(**common, seed=SEED, **{"cacheNodeIds": kept, **params})
    raise ValueError(f"unknown model {name!r}, expected one of {MODELS}")


def boosted(name: str, **overrides) -> boosting.Settings:
    """Settings of a boosted model, as published but for the overrides."""
    return boosting.PUBLISHED[name]._replace(**overrides)


def partitions(rows: int) -> int:
    """Partitions of a training table of so many rows."""
    return max(2, min(math.ceil(rows / PARTITION_ROWS), PARTITIONS), math.ceil(rows / LARGE_PARTITION_ROWS))


def placed(train: DataFrame, rows: int) -> DataFrame:
    """The same rows in the same partitions and order, however they come: by a hash of the key."""
    hashed = F.xxhash64(KEY)
    return train.repartition(partitions(rows), hashed).sortWithinPartitions(hashed, KEY)


def at_once(spark: SparkSession, rows: int) -> int:
    """Fits on so many rows that run at the same time: one more than have a core for each of their partitions."""
    return max(AT_ONCE, 1 + spark.sparkContext.defaultParallelism // partitions(rows))


def fit(name: str, train: DataFrame, names: Sequence[str], **overrides) -> Model:
    """Fit one model. The scaler is part of the pipeline, so scoring cannot miss it."""
    if name in boosting.PUBLISHED:
        fits = [boosting.Fit(name, 0, boosted(name, **overrides))]
        return grown(train.withColumn("groups", F.lit(1)), names, boosting.edges(train, names), fits)[0]
    raw = "raw_features" if name == "logistic" else "features"
    stages = [VectorAssembler(inputCols=list(names), outputCol=raw, handleInvalid="error")]
    if name == "logistic":
        stages.append(StandardScaler(inputCol=raw, outputCol="features", withMean=True, withStd=True))
    rows = train.count()
    stages.append(estimator(name, rows, **overrides))
    held = placed(train, rows).persist(StorageLevel.MEMORY_AND_DISK)  # a fit reads its rows several times
    try:
        return Pipeline(stages=stages).fit(held)
    finally:
        held.unpersist()


def grown(rows: DataFrame, names: Sequence[str], limits, fits: Sequence[boosting.Fit], saved=(), save=lambda part: None) -> list[boosting.Ensemble]:
    """Boosted ensembles of all fits; ``rows`` have a column ``groups``, the bits of the fits they belong to."""
    blocks = boosting.packed(rows, names, limits, KEY, LABEL)
    trees, start = boosting.grow(blocks, len(names), fits, saved, save)
    return [boosting.ensemble(f, trees[t], float(start[t]), names, limits) for t, f in enumerate(fits)]


def score(model: Model, frame: DataFrame, *keep: str) -> DataFrame:
    """customer_id, kept columns, probability of churn."""
    if isinstance(model, boosting.Ensemble):
        found = boosting.margins(frame, [model], [KEY, *keep])
        return found.select(KEY, *keep, (1.0 / (1.0 + F.exp(-F.col("margins")[0]))).alias("probability"))
    return model.transform(frame).select(
        KEY, *keep, vector_to_array(F.col("probability"))[1].alias("probability")
    )


def score_long(models: Mapping[str, Model], frame: DataFrame) -> DataFrame:
    """The evaluation table (model, customer_id, churn_label, probability) of several models."""
    parts = [score(model, frame, LABEL).withColumn("model", F.lit(name)) for name, model in models.items()]
    table = parts[0]
    for part in parts[1:]:
        table = table.unionByName(part)
    return table


def coefficients(spark: SparkSession, model: PipelineModel, names: Sequence[str]) -> DataFrame:
    """One row per feature of a linear model: scaler mean and sd, coefficient on the scaled feature."""
    scaler, classifier = model.stages[1], model.stages[2]
    rows = list(zip(names, map(float, scaler.mean), map(float, scaler.std), map(float, classifier.coefficients)))
    return spark.createDataFrame(rows, "feature string, mean double, sd double, coefficient double")


def feature_importance(spark: SparkSession, model: Model, names: Sequence[str], n: int = 20) -> DataFrame:
    """Normalised gain of tree models, coefficient size of linear ones; the n largest, with readable labels."""
    if isinstance(model, boosting.Ensemble):
        values = model.importances()
    elif hasattr(model.stages[-1], "featureImportances"):
        values = model.stages[-1].featureImportances.toArray()
    else:
        values = abs(model.stages[-1].coefficients.toArray())
    rows = [(name, float(v)) for name, v in zip(names, values)]
    table = spark.createDataFrame(rows, "feature string, importance double")
    label = F.initcap(F.replace(F.col("feature"), F.lit("_"), F.lit(" ")))
    return table.withColumn("label", label).orderBy(F.desc("importance"), "feature").limit(n)


def dealt(train: DataFrame, folds: int) -> DataFrame:
    """The training part with its folds."""
    return stratified_folds(train, KEY, LABEL, folds)


def fold_synthetic(train: DataFrame, names: Sequence[str], folds: int) -> DataFrame:
    """New rows of every fold's training rows, balanced from these rows alone, in one pass; column ``held`` names the fold."""
    held = F.explode(F.filter(F.sequence(F.lit(0), F.lit(folds - 1)), lambda f: f != F.col("fold")))
    return smote_groups(train.withColumn("held", held), names, KEY, LABEL, "held")


def fold_rows(train: DataFrame, made: DataFrame, names: Sequence[str], fold: int) -> DataFrame:
    """The balanced rows that a model of one fold learns from."""
    columns = [KEY, *[F.col(f"`{n}`") for n in names], LABEL]
    return train.where(F.col("fold") != fold).select(*columns).unionByName(made.where(F.col("held") == fold).select(*columns))


def shared_rows(train: DataFrame, made: DataFrame, names: Sequence[str], folds: int, whole: DataFrame | None = None) -> DataFrame:
    """Rows of all folds, each once, with the bits of the fits they belong to; bit ``folds`` is the whole training part.

    ``whole``: the new rows of the whole part, if it is to be fitted too.
    """
    columns = [KEY, *[F.col(f"`{n}`") for n in names], LABEL]
    every = (1 << folds) - 1 + ((1 << folds) if whole is not None else 0)
    bits = lambda c: F.call_function("shiftleft", F.lit(1), F.col(c))
    rows = train.select(*columns, (F.lit(every) - bits("fold")).alias("groups")).unionByName(
        made.select(*columns, bits("held").alias("groups")))
    return rows if whole is None else rows.unionByName(whole.select(*columns, F.lit(1 << folds).alias("groups")))


def fold_scores(
    models: Sequence[str], train: DataFrame, made: DataFrame, names: Sequence[str], folds: int,
    ensembles: Mapping[tuple[str, int], boosting.Ensemble], overrides: Mapping[str, dict] | None = None,
    keep: Callable[[str, Callable[[], DataFrame]], DataFrame] = lambda name, make: cut(make()),
) -> DataFrame:
    """The evaluation table of held-out rows with a column fold; ``keep`` stores each model's part under a name."""
    overrides = overrides or {}

    def one(task: tuple[str, int]) -> DataFrame:
        name, fold = task
        own = f"scored-{name}-{fold}"

        def make() -> DataFrame:
            model = ensembles.get(task) or fit(name, fold_rows(train, made, names, fold), names, **overrides.get(name, {}))
            scored = score(model, train.where(F.col("fold") == fold), LABEL)
            return scored.withColumns({"model": F.lit(name), "fold": F.lit(fold)})

        return keep(own, make)

    longest_first = sorted(models, key=lambda m: m != "forest")
    rows = train.count() * (folds - 1) // folds + made.count() // folds
    with ThreadPool(at_once(train.sparkSession, rows)) as pool:
        tasks = [(m, f) for m in longest_first for f in range(folds)]
        parts = pool.map(inheritable_thread_target(train.sparkSession)(one), tasks, 1)
    table = parts[0]
    for part in parts[1:]:
        table = table.unionByName(part)
    return table


def fold_metrics(scored: DataFrame) -> DataFrame:
    """AUC and Brier score per model and fold."""
    each = scored.withColumn("model", F.concat_ws("#", "model", "fold"))
    line = evaluation.auc_roc(each).join(evaluation.brier(each), "model")
    part = F.split("model", "#")
    return line.select(part[0].alias("model"), part[1].cast("int").alias("fold"), "auc_roc", "brier")


def cross_validate(
    models: Sequence[str], train: DataFrame, names: Sequence[str], folds: int = 5,
    overrides: Mapping[str, dict] | None = None,
) -> DataFrame:
    """AUC and Brier score per model and fold. Balancing happens inside each fold, on its training part alone."""
    overrides = overrides or {}
    rows = cut(dealt(train, folds))
    made = cut(fold_synthetic(rows, names, folds))
    fits = [boosting.Fit(m, f, boosted(m, **overrides.get(m, {}))) for m in models if m in boosting.PUBLISHED for f in range(folds)]
    ensembles = {}
    if fits:
        found = grown(shared_rows(rows, made, names, folds), names, boosting.edges(rows, names), fits)
        ensembles = {(f.name, f.group): e for f, e in zip(fits, found)}
    return fold_metrics(fold_scores(models, rows, made, names, folds, ensembles, overrides))


def choose(validated: DataFrame) -> DataFrame:
    """Mean fold AUC per model, and the winner: highest mean, ties to the first name. One row per model."""
    means = validated.groupBy("model").agg(F.avg("auc_roc").alias("cv_auc"), F.avg("brier").alias("cv_brier"))
    best = means.agg(F.min(F.struct((-F.col("cv_auc")).alias("a"), "model")).alias("b"))
    return means.join(best.select(F.col("b.model").alias("winner_name")), how="cross").select(
        "model", "cv_auc", "cv_brier", (F.col("model") == F.col("winner_name")).alias("winner"))
