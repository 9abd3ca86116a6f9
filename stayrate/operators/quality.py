"""Data-quality reports that take the place of declared constraints."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stayrate.functions.ranking import spread
from stayrate.sources.schemas import CHILD_TABLES, DOMAINS, NATURAL_KEYS, PRIMARY_KEYS, RANGES, REQUIRED
from stayrate.sources.tables import Tables


def _stack(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def table_profile(tables: Tables, names: list[str]) -> DataFrame:
    """Rows and customers per table."""
    return _stack([
        tables.get(name)
        .groupBy("customer_id").agg(F.count(F.lit(1)).alias("n"))
        .agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.count(F.lit(1)).alias("customers"))
        .select(F.lit(name).alias("table_name"), "rows", "customers")
        for name in names
    ])


def not_null(tables: Tables) -> DataFrame:
    """One scan per table: missing values per required column, key columns included."""
    parts = []
    for name, columns in REQUIRED.items():
        checked = [*PRIMARY_KEYS.get(name, []), *columns]
        checked = list(dict.fromkeys([*checked, "customer_id"]))
        counts = tables.get(name).agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in checked])
        parts.append(
            counts.unpivot([], checked, "column_name", "violations")
            .select(F.lit(name).alias("table_name"), "column_name", "violations")
        )
    return _stack(parts)


def domain(tables: Tables) -> DataFrame:
    """Rows per value of every closed-domain column, and whether the value is allowed (NULL is)."""
    return _stack([
        tables.get(name)
        .groupBy(F.col(column).alias("value"))
        .agg(F.count(F.lit(1)).alias("rows"))
        .select(
            F.lit(name).alias("table_name"), F.lit(column).alias("column_name"), "value", "rows",
            F.coalesce(F.col("value").isin(allowed), F.lit(True)).alias("allowed"),
        )
        for (name, column), allowed in DOMAINS.items()
    ])


def value_range(tables: Tables) -> DataFrame:
    parts = []
    for (name, column), (low, high) in RANGES.items():
        value = F.col(column)
        parts.append(
            tables.get(name).agg(
                F.min(value).cast("double").alias("lowest"),
                F.max(value).cast("double").alias("highest"),
                F.count_if(~value.between(low, high)).alias("violations"),
            ).select(F.lit(name).alias("table_name"), F.lit(column).alias("column_name"), "lowest", "highest", "violations")
        )
    return _stack(parts)


def primary_key(tables: Tables) -> DataFrame:
    """Distinct keys, keys that occur more than once, and rows beyond the first of each key; natural keys as well."""
    n = F.col("n")
    return _stack([
        spread(tables.get(name), tables.about_rows(name), *keys)
        .groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
        .agg(
            F.count(F.lit(1)).alias("keys"),
            F.count_if(n > 1).alias("duplicated_keys"),
            F.coalesce(F.sum(n - 1), F.lit(0)).alias("surplus_rows"),
        )
        .select(
            F.lit(name).alias("table_name"), F.lit(", ".join(keys)).alias("key_columns"), "keys", "duplicated_keys",
            "surplus_rows",
        )
        for name, keys in [*PRIMARY_KEYS.items(), *NATURAL_KEYS.items()]
    ])


def foreign_key(tables: Tables) -> DataFrame:
    """Children whose customer is unknown. Rows collapse per customer before they meet the parent."""
    parents = tables.get("customers").select("customer_id")
    return _stack([
        tables.get(name)
        .where(F.col("customer_id").isNotNull())
        .groupBy("customer_id").agg(F.count(F.lit(1)).alias("n"))
        .join(parents, "customer_id", "left_anti")
        .agg(F.count(F.lit(1)).alias("orphan_customers"), F.coalesce(F.sum("n"), F.lit(0)).alias("orphan_rows"))
        .select(F.lit(name).alias("table_name"), "orphan_customers", "orphan_rows")
        for name in CHILD_TABLES
    ])


def single_active(contracts: DataFrame) -> DataFrame:
    """Customers with contracts whose number of Active ones is not exactly one."""
    return (
        contracts.groupBy("customer_id")
        .agg(F.count_if(F.col("status") == "Active").alias("active_contracts"), F.count(F.lit(1)).alias("contracts"))
        .where(F.col("active_contracts") != 1)
    )
