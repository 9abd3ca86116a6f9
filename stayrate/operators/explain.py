"""Explanations of scores: local contributions, global and segment importance, top drivers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stayrate.functions.columns import fixed


def linear_contributions(frame: DataFrame, terms: dict[str, Column], keep: Sequence[str] = ("customer_id",)) -> DataFrame:
    """Exact contributions of an additive score: each term minus its mean over all rows.

    The means need a pass of their own: give a materialised frame where its rows are costly.
    """
    rows = frame.select(*keep, *[term.alias(name) for name, term in terms.items()])
    means = rows.agg(F.struct(*[F.avg(name).alias(name) for name in terms])).scalar()
    centred = rows.withColumn("_means", means)
    return centred.select(*keep, *[fixed(F.col(name) - F.col("_means")[name], 6).alias(name) for name in terms])


def to_long(contributions: DataFrame, names: Sequence[str], keep: Sequence[str] = ("customer_id",)) -> DataFrame:
    return contributions.unpivot(list(keep), list(names), "feature", "phi")


def _mean_size(contributions: DataFrame, names: Sequence[str], by: Sequence[str]) -> DataFrame:
    # aggregated wide, one mean per feature, so no row is multiplied by the number of features
    means = contributions.groupBy(*by).agg(*[F.avg(F.abs(F.col(f"`{n}`"))).alias(n) for n in names])
    return means.unpivot(list(by), list(names), "feature", "m").select(
        *by, "feature", fixed(F.col("m"), 6).alias("mean_abs_phi")
    )


def global_importance(contributions: DataFrame, names: Sequence[str], n: int = 20) -> DataFrame:
    return _mean_size(contributions, names, []).orderBy(F.desc("mean_abs_phi"), "feature").limit(n)


def importance_by_segment(contributions: DataFrame, names: Sequence[str], segment: str = "company_size") -> DataFrame:
    return _mean_size(contributions, names, [segment])


def driver_columns(parts: dict[str, Column]) -> dict[str, Column]:
    """top_driver_1..3: names of the three largest positive contributions of the row, no shuffle."""
    pairs = F.array(*[F.struct((-part).alias("less"), F.lit(name).alias("name")) for name, part in parts.items()])
    ranked = F.array_sort(F.filter(pairs, lambda pair: pair["less"] < 0))
    return {f"top_driver_{i + 1}": F.get(ranked, F.lit(i)).getField("name") for i in range(3)}


def top_drivers(contributions: DataFrame, names: Sequence[str]) -> DataFrame:
    columns = driver_columns({n: F.col(f"`{n}`") for n in names})
    return contributions.select("customer_id", *[c.alias(n) for n, c in columns.items()])
