"""Ranks, quantiles and neighbours that never gather a whole group in one task.

Every function works on two levels: rows meet only rows of their own (group, bucket); the bucket totals,
whose number is bounded by the bucketing rule, carry the offsets.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stayrate.functions.columns import magnitude_bucket, stable_bits, stable_unit


#: Rows that one task sorts or groups, and the number of such parts from which a table is dealt by its rows.
PART_ROWS, FEW_PARTS = 250_000, 8


def spread(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """``df`` of about so many rows dealt by a hash of the keys: a task's share is bounded, however many rows there are.

    The session's number of shuffle partitions is fixed, so that a partition would grow with the table. Small tables
    are left to it.
    """
    parts = math.ceil(rows / PART_ROWS)
    return df.repartition(parts, *keys) if parts >= FEW_PARTS else df


def add_rank(df: DataFrame, groups: Sequence[str], bucket: Column, order: Sequence[str], name: str) -> DataFrame:
    """1-based row number per group, as rows before this bucket plus the number inside the bucket."""
    placed = df.withColumn("_bucket", bucket)
    sizes = placed.groupBy(*groups, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy(*groups).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select(*groups, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = W.partitionBy(*groups, "_bucket").orderBy(*order)
    return (
        placed.withColumn("_inside", F.row_number().over(inside))
        .join(offsets, [*groups, "_bucket"])
        .withColumn(name, (F.col("_before") + F.col("_inside")).cast("bigint"))
        .drop("_bucket", "_inside", "_before")
    )


def add_hash_rank(df: DataFrame, groups: Sequence[str], key: str, seed: int, name: str, buckets: int = 4096) -> DataFrame:
    """Rank per group in the order of a stable hash of the key: an exact, repeatable shuffle."""
    hashed = df.withColumn("_u", stable_unit(seed, F.col(key)))
    return add_rank(hashed, groups, F.floor(F.col("_u") * buckets).cast("int"), ["_u", key], name).drop("_u")


def hash_cuts(df: DataFrame, group: str, key: str, seed: int, places: Mapping[object, Sequence[int]]) -> DataFrame:
    """(group, place, _cut_bits, _cut_key): the row at each wanted place of its group, in the order of a stable hash.

    A histogram of the leading bits locates each place; its bin alone is counted again by further bits, until it holds few
    rows, which are sorted. Histograms add up in any order, no rows are ranked, and what the driver gets is bounded by the
    number of places. ``df`` is passed over two to five times and must be stored.
    """
    spark, few, step = df.sparkSession, 4096, 12
    types = {f.name: f.dataType.simpleString() for f in df.schema}
    rows = df.select(F.col(group).alias("_g"), F.col(key).alias("_k"), stable_bits(seed, F.col(key)).alias("_h"))
    open_ = [(g, p, 0, p) for g, wanted in places.items() for p in wanted if p > 0]  # group, place, prefix, rows from it on
    shift, found = 52, []
    schema = f"_g {types[group]}, _prefix bigint"
    while open_:
        below = max(0, shift - step)
        bins = spark.createDataFrame(sorted({(g, prefix) for g, _, prefix, _ in open_}, key=str), schema)
        prefix = F.shiftright("_h", shift).alias("_prefix")
        inside = rows.select("*", prefix).join(F.broadcast(bins), ["_g", "_prefix"])  # one row per place at most
        counts = inside.groupBy("_g", "_prefix", F.shiftright("_h", below).alias("_bin")).agg(F.count(F.lit(1)).alias("n")).collect()
        by_bin: dict[tuple, list] = {}
        for r in sorted(counts, key=lambda r: r["_bin"]):
            by_bin.setdefault((r["_g"], r["_prefix"]), []).append((r["_bin"], r["n"]))
        narrowed, ready = [], []
        for g, place, prefix_, need in open_:
            for number, n in by_bin[g, prefix_]:
                if need <= n:
                    (ready if n <= few or not below else narrowed).append((g, place, number, need))
                    break
                need -= n
        if ready:
            bins = spark.createDataFrame(sorted({(g, number) for g, _, number, _ in ready}, key=str), schema)
            prefix = F.shiftright("_h", below).alias("_prefix")
            last = rows.select("*", prefix).join(F.broadcast(bins), ["_g", "_prefix"]).groupBy("_g", "_prefix", "_h", "_k").agg(
                F.count(F.lit(1)).alias("n")).collect()
            for g, place, number, need in ready:
                for h, k, n in sorted((r["_h"], r["_k"], r["n"]) for r in last if r["_g"] == g and r["_prefix"] == number):
                    need -= n
                    if need <= 0:
                        found.append((g, place, h, k))
                        break
        open_, shift = narrowed, below
    return spark.createDataFrame(found, f"{group} {types[group]}, place bigint, _cut_bits bigint, _cut_key {types[key]}")


def upto_cut(key: str, seed: int) -> Column:
    """Whether a row stands at a cut of ``hash_cuts`` or before it; false without a cut."""
    h = stable_bits(seed, F.col(key))
    at = (h < F.col("_cut_bits")) | ((h == F.col("_cut_bits")) & (F.col(key) <= F.col("_cut_key")))
    return F.coalesce(at, F.lit(False))


def exact_quantile(df: DataFrame, value: str, q: float, name: str) -> DataFrame:
    """One row with the linearly interpolated quantile of a fixed-point column.

    Equal values are collapsed first; bucket totals locate the two order statistics, and only their
    buckets are looked at value by value.
    """
    counts = (
        df.where(F.col(value).isNotNull())
        .groupBy(F.col(value).alias("v"))
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("b", magnitude_bucket(F.col("v")))
    )
    running = W.orderBy("b").rowsBetween(W.unboundedPreceding, W.currentRow)
    # b is bounded by the bucketing rule, so this unpartitioned window sees some thousand rows at most
    totals = counts.groupBy("b").agg(F.sum("n").alias("bn")).withColumn("upto", F.sum("bn").over(running))
    located = totals.select(
        "b", "bn", "upto", F.max("upto").over(W.partitionBy()).alias("total")
    ).withColumn("pos", (F.col("total") - 1) * F.lit(q))
    located = located.where((F.col("upto") > F.floor("pos")) & (F.col("upto") - F.col("bn") <= F.ceil("pos")))
    inside = W.partitionBy("b").orderBy("v").rowsBetween(W.unboundedPreceding, W.currentRow)
    reached = (
        counts.join(F.broadcast(located), "b")  # at most two rows
        .withColumn("cum", F.col("upto") - F.col("bn") + F.sum("n").over(inside))
        .agg(
            F.min(F.when(F.col("cum") > F.floor("pos"), F.col("v").cast("double"))).alias("lo"),
            F.min(F.when(F.col("cum") > F.ceil("pos"), F.col("v").cast("double"))).alias("hi"),
            F.max("pos").alias("pos"),
        )
    )
    part = F.col("pos") - F.floor("pos")
    return reached.select((F.col("lo") + (F.col("hi") - F.col("lo")) * part).alias(name))


def add_neighbour(
    df: DataFrame,
    key: str,
    day: str,
    tie: str,
    values: dict[str, str],
    following: bool = True,
    heavy_rows: int = 250_000,
) -> DataFrame:
    """Values of the next (or previous) row per key in (day, tie) order.

    Ordinary keys need one window. A key with more than ``heavy_rows`` rows is cut into days: its rows are
    compared inside a day, and the first (last) row of every other day is handed over as one extra row.
    The table of heavy keys, at most rows / heavy_rows, is broadcast: no row is sorted to find it.
    ``df`` is counted to deal its rows into tasks of bounded size.
    """
    heavy = (
        df.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > heavy_rows)
        .select(key, F.lit(True).alias("_heavy"))
    )
    edge = F.min_by if following else F.max_by
    step = 1 if following else -1
    rows = df.join(F.broadcast(heavy), key, "left").withColumns({
        "_slice": F.when(F.col("_heavy"), F.col(day)),
        "_carry": F.struct(*[F.col(c).alias(name) for name, c in values.items()]),
    })
    edges = (
        rows.where(F.col("_heavy")).groupBy(key, "_slice").agg(edge("_carry", F.struct(day, tie)).alias("_carry"))
    )
    by_slice = W.partitionBy(key).orderBy("_slice")
    handed = edges.select(
        key, "_slice", F.lag("_carry", -step).over(by_slice).alias("_carry"), F.lit(True).alias("_handed")
    ).where(F.col("_carry").isNotNull())
    # a handed-over row sorts after its day when looking ahead, before it when looking back
    place = F.when(F.col("_handed"), F.lit(step)).otherwise(F.lit(0))
    inside = W.partitionBy(key, "_slice").orderBy(place, day, tie)
    joined = rows.drop("_heavy").withColumn("_handed", F.lit(False)).unionByName(handed, allowMissingColumns=True)
    return (
        spread(joined, df.count(), key, "_slice").withColumn("_found", F.lag("_carry", -step).over(inside))
        .where(~F.col("_handed"))
        .withColumns({name: F.col("_found")[name] for name in values})
        .drop("_slice", "_carry", "_handed", "_found")
    )
