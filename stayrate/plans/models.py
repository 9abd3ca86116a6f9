"""A model run: prepared data, validation, and fitted pipelines of one as_of date, in a folder of their own.

Every part is written once and read by all later consumers; a part that is not completely written is made again. The
folder is named by the input files (names, sizes, times) and the date, so a run is found again as long as its input
stands, and a changed input starts a new one.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Mapping, Sequence
from datetime import date
from functools import cached_property
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stayrate.operators import balancing, boosting, engineering, training, treeshap
from stayrate.plans.frames import NUMERIC, customer_frame
from stayrate.session import cut, exists, named_path, stamp
from stayrate.sources.tables import Tables


class ModelRun:
    """``settings`` overrides the published settings by model name; the registered queries pass none."""

    def __init__(self, tables: Tables, as_of: date, folder: str, industries=engineering.INDUSTRIES,
                 settings: Mapping[str, dict] | None = None, folds: int = 5):
        self.tables, self.as_of, self.folder, self.industries = tables, as_of, folder, industries
        self.settings, self.folds = dict(settings or {}), folds

    def _kept(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        spark, path = self.tables.spark, f"{self.folder}/{name}"
        if not exists(spark, f"{path}/_SUCCESS"):
            make().write.mode("overwrite").parquet(path)
        return spark.read.parquet(path)

    @cached_property
    def frame(self) -> DataFrame:
        """The flat customer frame, computed once for all models."""
        return self._kept("frame", lambda: customer_frame(self.tables, self.as_of))

    @cached_property
    def matrix(self) -> DataFrame:
        """Feature matrix with in_train."""
        def make() -> DataFrame:
            m = cut(engineering.matrix(self.frame, NUMERIC, self.industries, complete=True))
            return balancing.stratified_split(m, training.KEY, training.LABEL)

        return self._kept("matrix", make)

    @cached_property
    def names(self) -> list[str]:
        return [c for c in self.matrix.columns if c not in (training.KEY, training.LABEL, "in_train")]

    @property
    def train(self) -> DataFrame:
        return self.matrix.where("in_train").drop("in_train")

    @property
    def test(self) -> DataFrame:
        return self.matrix.where("not in_train").drop("in_train")

    @cached_property
    def balanced(self) -> DataFrame:
        return self._kept("balanced", lambda: balancing.smote(self.train, self.names, training.KEY, training.LABEL))

    @cached_property
    def dealt(self) -> DataFrame:
        return self._kept("dealt", lambda: training.dealt(self.train, self.folds))

    @cached_property
    def fold_synthetic(self) -> DataFrame:
        return self._kept("fold-synthetic", lambda: training.fold_synthetic(self.dealt, self.names, self.folds))

    @cached_property
    def limits(self):
        """Bins of the boosted models: from the training part, without labels, the same for all folds."""
        return boosting.edges(self.train, self.names)

    def _saved(self, name: str, make: Callable[[], object]):
        """A small driver-side part: written as one row, made again unless completely written."""
        spark = self.tables.spark
        row = self._kept(name, lambda: spark.createDataFrame([(bytearray(pickle.dumps(make())),)], "part binary").coalesce(1))
        return pickle.loads(bytes(row.first()["part"]))

    def _ensembles(self, wanted: Sequence[tuple[str, int]]) -> dict[tuple[str, int], boosting.Ensemble]:
        """Boosted models by (name, fold), fold ``folds`` being the whole training part; those missing are grown together."""
        spark, path = self.tables.spark, lambda m: f"ensemble-{m[0]}-{m[1]}"
        missing = [m for m in wanted if not exists(spark, f"{self.folder}/{path(m)}/_SUCCESS")]
        if missing:
            fits = [boosting.Fit(n, g, training.boosted(n, **self.settings.get(n, {}))) for n, g in missing]
            tag, parts = "+".join(f"{n}{g}" for n, g in missing), []
            while exists(spark, f"{self.folder}/grown-{tag}-{len(parts)}/_SUCCESS"):
                parts.append(self._saved(f"grown-{tag}-{len(parts)}", dict))
            known = len(parts)

            def save(part) -> None:
                nonlocal known
                self._saved(f"grown-{tag}-{known}", lambda: part)
                known += 1

            found = training.grown(self._boosted_rows(missing), self.names, self.limits, fits, parts, save)
            self._each(lambda of: self._saved(path(of[0]), lambda: boosting.frozen(of[1])), list(zip(missing, found)))
        return dict(zip(wanted, self._each(lambda m: boosting.thawed(self._saved(path(m), dict)), wanted)))

    def _each(self, do: Callable[[object], object], of: Sequence[object]) -> list:
        """Small parts side by side: each is a write or read of its own."""
        with ThreadPool(min(8, len(of))) as pool:
            return pool.map(inheritable_thread_target(self.tables.spark)(do), of, 1)

    def _boosted_rows(self, wanted: Sequence[tuple[str, int]]) -> DataFrame:
        """Only the rows and bits of the fits that are wanted: a single model needs no folds."""
        if all(group == self.folds for _, group in wanted):
            return self.balanced.withColumn("groups", F.lit(1 << self.folds))
        whole = self.balanced.where("synthetic") if any(g == self.folds for _, g in wanted) else None
        return training.shared_rows(self.dealt, self.fold_synthetic, self.names, self.folds, whole)

    @cached_property
    def validated(self) -> DataFrame:
        """Fold scores of every model as published, on the training part alone."""
        def make() -> DataFrame:
            def scored(models, ensembles) -> DataFrame:
                return training.fold_scores(models, self.dealt, self.fold_synthetic, self.names, self.folds, ensembles,
                                            self.settings, self._kept)

            self.dealt, self.fold_synthetic  # before two threads ask for them
            plain = [m for m in training.MODELS if m not in boosting.PUBLISHED]
            with ThreadPool(1) as side:
                others = side.apply_async(inheritable_thread_target(self.tables.spark)(scored), (plain, {}))
                # the boosted models of the whole part grow in the same passes as those of the folds
                ensembles = self._ensembles([(n, g) for n in boosting.PUBLISHED for g in range(self.folds + 1)])
                parts = scored(list(boosting.PUBLISHED), ensembles)
                return training.fold_metrics(others.get().unionByName(parts))

        return self._kept("validated", make)

    @cached_property
    def winner(self) -> str:
        return training.choose(self.validated).where("winner").first()["model"]

    def model(self, name: str) -> training.Model:
        """Fitted once, saved, and loaded by every later consumer."""
        if name in boosting.PUBLISHED:
            return self._ensembles([(name, self.folds)])[name, self.folds]
        path, done = f"{self.folder}/model-{name}", f"{self.folder}/model-{name}-done"
        if not exists(self.tables.spark, f"{done}/_SUCCESS"):
            training.fit(name, self.balanced, self.names, **self.settings.get(name, {})).write().overwrite().save(path)
            self.tables.spark.range(1).write.mode("overwrite").parquet(done)
        return PipelineModel.load(path)

    def contributions(self, name: str, keep=("customer_id",)) -> DataFrame:
        """keep columns, base_value, margin and one column per feature, for a linear or a tree model."""
        if name == "logistic":
            return treeshap.linear_model_contributions(self.model(name), self.matrix, self.names, keep)
        return treeshap.tree_contributions(self.tables.spark, self.model(name), self.matrix, self.names, keep)

    def version(self, name: str) -> str:
        return f"{name}-{self.as_of:%Y%m%d}"


def probability_of(name: str):
    """Probability from the margin: forests add up probabilities, the others log-odds."""
    margin = F.col("margin")
    return margin if name == "forest" else 1.0 / (1.0 + F.exp(-margin))


def run_of(tables, as_of: date, industries, settings: Mapping[str, dict] | None = None) -> ModelRun:
    """The run over a folder of tables, in this application's part of the shared folder; other settings, another run."""
    spark = tables.spark
    name = f"model-run-{stamp(spark, tables.sf_dir, as_of, sorted((settings or {}).items()))}"
    return ModelRun(tables, as_of, named_path(spark, name), industries, settings)
