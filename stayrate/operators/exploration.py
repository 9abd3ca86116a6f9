"""Exploratory statistics of churned against retained customers."""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stayrate.functions.columns import fixed, magnitude_bucket, mean_of, mean_where, ratio

DRIVER_FEATURES = [
    "login_frequency_30d", "feature_adoption_rate", "nps_score", "num_support_tickets", "payment_delays_6m",
    "mrr_trend_90d",
]
CORRELATED = [
    "tenure_months", "monthly_charges", "login_frequency_30d", "feature_adoption_rate", "num_support_tickets",
    "avg_resolution_days", "nps_score", "payment_delays_6m", "mrr_trend_90d", "session_depth_score",
    "last_login_days_ago", "churn_label",
]


def overview(frame: DataFrame) -> DataFrame:
    total = F.sum("customers").over(W.partitionBy())  # two rows
    return frame.groupBy("churn_label").agg(
        F.count(F.lit(1)).alias("customers"), F.sum("monthly_charges").cast("decimal(28,2)").alias("monthly_revenue")
    ).select("churn_label", "customers", fixed(ratio(F.col("customers"), total) * 100, 2).alias("share_pct"), "monthly_revenue")


def revenue_lost_by_size(frame: DataFrame) -> DataFrame:
    return frame.where(F.col("churn_label") == 1).groupBy("company_size").agg(
        F.count(F.lit(1)).alias("churned"),
        F.round(F.sum("monthly_charges") / 1000, 2).cast("decimal(28,2)").alias("revenue_lost_thousands"),
    )


def long_form(frame: DataFrame, features: Sequence[str]) -> DataFrame:
    """(churn_label, feature, value) rows."""
    doubles = frame.select("churn_label", *[F.col(c).cast("double").alias(c) for c in features])
    return doubles.unpivot(["churn_label"], list(features), "feature", "value")


def class_histogram(frame: DataFrame, features: Sequence[str] = DRIVER_FEATURES, bins: int = 40) -> DataFrame:
    """Equal bins over each class's own range, the last one closed; density integrates to one."""
    keys = ["feature", "churn_label"]
    # equal values collapse first: both passes over them are then small
    counts = long_form(frame, features).groupBy(*keys, "value").agg(F.count(F.lit(1)).alias("n"))
    extent = counts.groupBy(*keys).agg(
        F.min("value").alias("lo"), F.max("value").alias("hi"), F.sum("n").alias("total")
    )
    flat = F.col("lo") == F.col("hi")
    extent = extent.select(
        *keys, "total",
        F.when(flat, F.col("lo") - 0.5).otherwise(F.col("lo")).alias("low"),
        F.when(flat, F.lit(1.0 / bins)).otherwise((F.col("hi") - F.col("lo")) / float(bins)).alias("width"),
    )
    place = F.least(F.floor((F.col("value") - F.col("low")) / F.col("width")), F.lit(bins - 1)).cast("int")
    filled = counts.join(extent, keys).groupBy(*keys, place.alias("bin")).agg(F.sum("n").alias("n"))
    every = extent.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    n = F.coalesce("n", F.lit(0))
    return every.join(filled, [*keys, "bin"], "left").select(
        *keys, "bin", fixed(F.col("low") + F.col("bin") * F.col("width"), 6).alias("bin_start"),
        n.alias("customers"), fixed(n / (F.col("total") * F.col("width")), 6).alias("density"),
    )


def class_means(frame: DataFrame, features: Sequence[str] = DRIVER_FEATURES) -> DataFrame:
    means = frame.groupBy("churn_label").agg(*[fixed(F.avg(F.col(c).cast("double")), 6).alias(c) for c in features])
    return means.unpivot(["churn_label"], list(features), "feature", "mean")


def rank_sums(values: DataFrame, keys: Sequence[str], value: str, first: Column) -> DataFrame:
    """Per group: sizes, rank sum of the ``first`` rows with average ranks, and the tie term.

    Equal values collapse to one row. Running counts go over the values of one bucket, then over bucket
    totals, so that no task ever sees all values of a group.
    """
    keys = list(keys)
    counts = values.groupBy(*keys, F.col(value).alias("v")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(first).alias("n1")
    ).withColumn("b", magnitude_bucket(F.col("v")))
    inside = W.partitionBy(*keys, "b").orderBy("v").rowsBetween(W.unboundedPreceding, -1)
    before = F.coalesce(F.sum("n").over(inside), F.lit(0)).cast("double")
    n, n1 = F.col("n").cast("double"), F.col("n1").cast("double")
    ranked = counts.withColumns({"local": n1 * (before + (n + 1) / 2), "tie": n * n * n - n})
    buckets = ranked.groupBy(*keys, "b").agg(
        F.sum("local").alias("local"), F.sum("tie").alias("tie"), F.sum("n").alias("n"), F.sum("n1").alias("n1")
    )
    across = W.partitionBy(*keys).orderBy("b").rowsBetween(W.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("n").over(across), F.lit(0)).cast("double")
    return (
        buckets.withColumn("rank_sum", F.col("local") + offset * F.col("n1"))
        .groupBy(*keys)
        .agg(
            F.sum("n").alias("n"), F.sum("n1").alias("n1"), F.sum("rank_sum").alias("rank_sum"),
            F.sum("tie").alias("tie_term"),
        )
    )


def two_sided_normal_p(z: Column, steps: int = 1200, reach: float = 12.0) -> Column:
    """2 * P(Z > z) for z >= 0 by Simpson's rule; relative error below 1e-8. Meant for a handful of rows."""
    h = reach / steps

    def ordinate(i: Column) -> Column:
        t = i * h
        weight = F.when(i.isin(0, steps), 1.0).when(i % 2 == 1, 4.0).otherwise(2.0)
        return weight * F.exp(-z * t - t * t / 2)

    area = F.aggregate(F.sequence(F.lit(0), F.lit(steps)), F.lit(0.0), lambda acc, i: acc + ordinate(i)) * (h / 3)
    return F.exp(-z * z / 2) * area * (2 / math.sqrt(2 * math.pi))


def mann_whitney(frame: DataFrame, features: Sequence[str] = DRIVER_FEATURES) -> DataFrame:
    """Retained against churned: U of the retained, tie-corrected z with continuity 0.5, two-sided p, stars."""
    sums = rank_sums(long_form(frame, features), ["feature"], "value", F.col("churn_label") == 0)
    n, n1 = F.col("n").cast("double"), F.col("n1").cast("double")
    n2 = n - n1
    u1 = F.col("rank_sum") - n1 * (n1 + 1) / 2
    sd = F.sqrt(n1 * n2 / 12 * ((n + 1) - F.col("tie_term") / (n * (n - 1))))
    z = F.try_divide(F.greatest(u1, n1 * n2 - u1) - n1 * n2 / 2 - 0.5, sd)
    p = F.least(two_sided_normal_p(F.greatest(F.col("z"), F.lit(0.0))), F.lit(1.0))
    return (
        sums.select(
            "feature", F.col("n1").alias("n_retained"), (F.col("n") - F.col("n1")).alias("n_churned"), u1.alias("u"),
            F.col("tie_term"), fixed(z, 6).alias("z"),
        )
        .withColumn("p_value", fixed(F.when(F.col("z").isNotNull(), p), 6))
        .withColumn(
            "stars",
            F.when(F.col("p_value") < 0.001, "***").when(F.col("p_value") < 0.01, "**")
            .when(F.col("p_value") < 0.05, "*").otherwise("ns"),
        )
    )


def correlation_matrix(frame: DataFrame, columns: Sequence[str] = CORRELATED) -> DataFrame:
    """Pearson coefficients of all pairs in one pass over the rows; strict lower triangle."""
    doubles = frame.select(*[F.col(c).cast("double").alias(c) for c in columns])
    pairs = [(b, a) for a, b in combinations(columns, 2)]
    one_row = doubles.agg(F.array(*[
        F.struct(F.lit(a).alias("feature_a"), F.lit(b).alias("feature_b"), F.corr(a, b).alias("r")) for a, b in pairs
    ]).alias("cells"))
    return one_row.select(F.inline("cells")).select("feature_a", "feature_b", fixed(F.col("r"), 6).alias("pearson"))


def driver_lift(frame: DataFrame, thresholds: dict[str, float] | None = None) -> DataFrame:
    """Churn rate below and from a threshold on, and their ratio."""
    thresholds = thresholds or {"feature_adoption_rate": 0.25, "login_frequency_30d": 3.0}
    label = F.col("churn_label")
    cells = []
    for feature, cut in thresholds.items():
        below = F.col(feature) < cut
        cells.append(F.struct(
            F.lit(feature).alias("driver"), F.lit(float(cut)).alias("threshold"),
            F.count_if(below).alias("customers_below"),
            mean_where(below, label).alias("below"), mean_where(~below, label).alias("above"),
        ))
    return frame.agg(F.array(*cells).alias("cells")).select(F.inline("cells")).select(
        "driver", "threshold", "customers_below",
        fixed(F.col("below"), 6).alias("churn_rate_below"), fixed(F.col("above"), 6).alias("churn_rate_above"),
        fixed(ratio(F.col("below"), F.col("above")), 4).alias("lift"),
    )


def rule_accuracy(frame: DataFrame, feature: str = "payment_delays_6m", at_least: float = 2) -> DataFrame:
    hit, churned = F.col(feature) >= at_least, F.col("churn_label") == 1
    both = F.count_if(hit & churned)
    return frame.agg(
        F.count_if(hit).alias("flagged"), both.alias("true_positives"),
        fixed(ratio(F.count_if(hit == churned), F.count(F.lit(1))), 6).alias("accuracy"),
        fixed(ratio(both, F.count_if(hit)), 6).alias("precision"),
        fixed(ratio(both, F.count_if(churned)), 6).alias("recall"),
    )


def nps_slope(frame: DataFrame) -> DataFrame:
    """Change of the churn rate, in percentage points, per 10 NPS points."""
    label, score = F.col("churn_label").cast("double"), F.col("nps_score").cast("double")
    return frame.agg(
        F.count(F.lit(1)).alias("customers"), fixed(F.regr_slope(label, score) * 1000, 6).alias("points_per_10_nps"),
    )
