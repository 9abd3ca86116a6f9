"""Model evaluation over one long table (model, customer_id, churn_label, probability).

Ranks and curves use the scores as they are; only results are rounded. They work on two levels: distinct scores meet
only scores of their own bucket, and the totals of the buckets, whose number the bucketing rule bounds, carry the
offsets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stayrate.functions.columns import fixed, mean_of, ratio
from stayrate.operators.exploration import class_histogram


def _score_bucket(p: Column, steps_per_octave: int = 256) -> Column:
    """Order-preserving bucket of a probability, of relative width near 0 and near 1: some 300,000 at most."""
    low, high = F.floor(F.log2(p) * steps_per_octave), F.floor(-F.log2(1.0 - p) * steps_per_octave)
    return F.when(p <= 0, -(2**31)).when(p >= 1, 2**31 - 1).when(p < 0.5, low).otherwise(high).cast("int")


def _score_counts(scored: DataFrame) -> DataFrame:
    return scored.groupBy("model", F.col("probability").alias("score")).agg(
        F.count_if(F.col("churn_label") == 1).alias("pos"), F.count_if(F.col("churn_label") == 0).alias("neg")
    ).withColumn("bucket", _score_bucket(F.col("score")))


def _auc(scored: DataFrame) -> DataFrame:
    inside = W.partitionBy("model", "bucket").orderBy("score").rowsBetween(W.unboundedPreceding, -1)
    below = F.coalesce(F.sum("neg").over(inside), F.lit(0)).cast("double")
    buckets = _score_counts(scored).withColumn("won", F.col("pos") * (below + F.col("neg") / F.lit(2.0))).groupBy(
        "model", "bucket").agg(F.sum("won").alias("won"), F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    lower = W.partitionBy("model").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    before = F.coalesce(F.sum("neg").over(lower), F.lit(0)).cast("double")
    return buckets.withColumn("won", F.col("won") + F.col("pos") * before).groupBy("model").agg(
        ratio(F.sum("won"), F.sum("pos").cast("double") * F.sum("neg")).alias("auc")
    )


def auc_roc(scored: DataFrame) -> DataFrame:
    """Share of (churned, retained) pairs in the right order, ties counting half."""
    return _auc(scored).select("model", fixed(F.col("auc"), 6).alias("auc_roc"))


def brier(scored: DataFrame) -> DataFrame:
    miss = F.col("probability") - F.col("churn_label")
    return scored.groupBy("model").agg(fixed(F.avg(miss * miss), 6).alias("brier"))


def confusion_matrix(scored: DataFrame, threshold: float = 0.5) -> DataFrame:
    predicted = (F.col("probability") >= threshold).cast("int")
    counts = scored.groupBy("model", F.col("churn_label").alias("actual"), predicted.alias("predicted")).agg(
        F.count(F.lit(1)).alias("n")
    )
    cells = counts.groupBy("model").agg(*[
        F.coalesce(F.sum(F.when((F.col("actual") == a) & (F.col("predicted") == p), F.col("n"))), F.lit(0)).alias(f"c{a}{p}")
        for a in (0, 1) for p in (0, 1)
    ])
    rows = F.array(*[
        F.struct(F.lit(a).alias("actual"), F.lit(p).alias("predicted"), F.col(f"c{a}{p}").alias("customers"))
        for a in (0, 1) for p in (0, 1)
    ])
    return cells.select("model", F.inline(rows))


def _class_cells(scored: DataFrame, threshold: float) -> DataFrame:
    hit, real = F.col("probability") >= threshold, F.col("churn_label") == 1
    return scored.groupBy("model").agg(
        F.count_if(hit & real).alias("tp"), F.count_if(hit & ~real).alias("fp"),
        F.count_if(~hit & real).alias("fn"), F.count_if(~hit & ~real).alias("tn"),
    )


def _share(part: Column, whole: Column) -> Column:
    return F.coalesce(ratio(part, whole), F.lit(0.0))


def classification_report(scored: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Per class, accuracy, macro and weighted average; undefined shares are 0."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))

    def line(name: str, precision: Column, recall: Column, f1: Column, support: Column) -> Column:
        return F.struct(
            F.lit(name).alias("label"), fixed(precision, 6).alias("precision"), fixed(recall, 6).alias("recall"),
            fixed(f1, 6).alias("f1"), support.alias("support"),
        )

    def scores(right: Column, wrong: Column, missed: Column) -> tuple[Column, Column, Column]:
        return _share(right, right + wrong), _share(right, right + missed), _share(2 * right, 2 * right + wrong + missed)

    kept, gone = scores(tn, fn, fp), scores(tp, fp, fn)
    n_kept, n_gone = tn + fp, tp + fn
    total = n_kept + n_gone
    accuracy = _share(tp + tn, total)
    macro = [(a + b) / 2 for a, b in zip(kept, gone)]
    weighted = [_share(a * n_kept + b * n_gone, total) for a, b in zip(kept, gone)]
    rows = F.array(
        line("0", *kept, n_kept), line("1", *gone, n_gone), line("accuracy", accuracy, accuracy, accuracy, total),
        line("macro avg", *macro, total), line("weighted avg", *weighted, total),
    )
    return _class_cells(scored, threshold).select("model", F.inline(rows))


def _running(scored: DataFrame) -> DataFrame:
    """Per distinct score: positives and negatives at or above it, and totals of the model."""
    counts = _score_counts(scored)
    buckets = counts.groupBy("model", "bucket").agg(F.sum("pos").alias("bp"), F.sum("neg").alias("bn"))
    higher = W.partitionBy("model").orderBy(F.desc("bucket")).rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy("model")
    offsets = buckets.select(
        "model", "bucket", F.coalesce(F.sum("bp").over(higher), F.lit(0)).alias("bp"),
        F.coalesce(F.sum("bn").over(higher), F.lit(0)).alias("bn"),
        F.sum("bp").over(whole).alias("positives"), F.sum("bn").over(whole).alias("negatives"),
    )
    inside = W.partitionBy("model", "bucket").orderBy(F.desc("score")).rowsBetween(W.unboundedPreceding, W.currentRow)
    upto = counts.withColumns({"tp": F.sum("pos").over(inside), "fp": F.sum("neg").over(inside)})
    return upto.join(offsets, ["model", "bucket"]).select(
        "model", "score", (F.col("tp") + F.col("bp")).alias("tp"), (F.col("fp") + F.col("bn")).alias("fp"),
        "positives", "negatives",
    )


def _curve(scored: DataFrame, columns: dict[str, Column], end: dict[str, float]) -> DataFrame:
    """One point per distinct score, and the fixed end point of each model."""
    points = _running(scored).select(
        "model", fixed(F.col("score"), 6).alias("threshold"), *[fixed(c, 6).alias(n) for n, c in columns.items()])
    closing = scored.select("model").distinct().select(
        "model", F.lit(None).cast("double").alias("threshold"), *[F.lit(end[n]).alias(n) for n in columns])
    return points.unionByName(closing)


def roc_curve(scored: DataFrame) -> DataFrame:
    rates = {"fpr": ratio(F.col("fp"), F.col("negatives")), "tpr": ratio(F.col("tp"), F.col("positives"))}
    return _curve(scored, rates, {"fpr": 0.0, "tpr": 0.0})


def pr_curve(scored: DataFrame) -> DataFrame:
    rates = {
        "precision": ratio(F.col("tp"), F.col("tp") + F.col("fp")), "recall": ratio(F.col("tp"), F.col("positives")),
    }
    return _curve(scored, rates, {"precision": 1.0, "recall": 0.0})


def score_density(scored: DataFrame, bins: int = 50) -> DataFrame:
    return class_histogram(scored, ["probability"], bins).drop("feature")


def calibration_bins(scored: DataFrame, bins: int = 10) -> DataFrame:
    """All bins of every model; an empty one has no customers and no means."""
    place = F.least(F.floor(F.col("probability") * bins), F.lit(bins - 1)).cast("int")
    filled = scored.groupBy("model", place.alias("bin")).agg(
        F.count(F.lit(1)).alias("n"),
        fixed(F.avg("probability"), 6).alias("mean_predicted"),
        fixed(mean_of(F.col("churn_label")), 6).alias("observed_rate"),
    )
    every = scored.select("model").distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    return every.join(filled, ["model", "bin"], "left").select(
        "model", "bin", F.coalesce("n", F.lit(0)).alias("customers"), "mean_predicted", "observed_rate")


def benchmark(scored: DataFrame, threshold: float = 0.5) -> DataFrame:
    """One row per model: AUC, Brier, and precision, recall, F1 of the churn class."""
    report = classification_report(scored, threshold).where(F.col("label") == "1")
    return (
        auc_roc(scored).join(brier(scored), "model")
        .join(report.select("model", "precision", "recall", "f1", F.col("support").alias("churned")), "model")
    )
