"""Stratified splitting, folds, and synthetic minority rows, all repeatable from hashes of the key."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stayrate.functions.columns import stable_bits, stable_unit
from stayrate.functions.ranking import hash_cuts, upto_cut
from stayrate.operators.neighbours import CELL_ROWS, nearest
from stayrate.session import cut

SEED = 42


def stratified_split(df: DataFrame, key: str, label: str, test_share: float = 0.2, seed: int = SEED) -> DataFrame:
    """Adds in_train. In every class exactly round(share * n) rows are held out, those of lowest hash. ``df`` is stored."""
    sizes = {r[label]: r["n"] for r in df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}
    cuts = hash_cuts(df, label, key, seed, {c: [math.floor(n * test_share + 0.5)] for c, n in sizes.items()})
    marked = df.join(F.broadcast(cuts.drop("place")), label, "left")  # one row per class
    return marked.withColumn("in_train", ~upto_cut(key, seed)).select(*df.columns, "in_train")


def stratified_folds(df: DataFrame, key: str, label: str, folds: int, seed: int = SEED) -> DataFrame:
    """Adds fold 0..folds-1; class counts differ by at most one between folds. ``df`` is stored."""
    sizes = {r[label]: r["n"] for r in df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}
    ends = {c: [n * (i + 1) // folds for i in range(folds - 1)] for c, n in sizes.items()}
    cuts = hash_cuts(df, label, key, seed + 1, ends).groupBy(label).agg(
        F.collect_list(F.struct("_cut_bits", "_cut_key")).alias("_cuts"))
    h = stable_bits(seed + 1, F.col(key))
    after = F.filter("_cuts", lambda c: (h > c["_cut_bits"]) | ((h == c["_cut_bits"]) & (F.col(key) > c["_cut_key"])))
    # a class with fewer rows than folds has places before its first row
    before = F.create_map(*[F.lit(x) for c, e in ends.items() for x in (c, sum(p == 0 for p in e))]) if ends else F.lit(None)
    marked = df.join(F.broadcast(cuts), label, "left")  # one row per class
    fold = before[F.col(label)] + F.coalesce(F.size(after), F.lit(0)) if ends else F.lit(0)
    return marked.withColumn("fold", fold.cast("int")).select(*df.columns, "fold")


def smote_groups(
    train: DataFrame, names: Sequence[str], key: str, label: str, group: str, k: int = 5, seed: int = SEED,
    cell_rows: int = CELL_ROWS,
) -> DataFrame:
    """The new rows of ``smote`` for every group of rows (a column of ``train``) in one pass: group, key, names, label."""
    counts = train.groupBy(group, label).agg(F.count(F.lit(1)).alias("n")).collect()  # groups x classes
    by_group: dict[object, dict[object, int]] = {}
    for row in counts:
        by_group.setdefault(row[group], {})[row[label]] = row["n"]
    plans = []
    for g, sizes in by_group.items():
        minority = min(sizes, key=lambda c: (sizes[c], c))
        missing = max(sizes.values()) - sizes[minority]
        if len(sizes) > 1 and missing:
            plans.append((g, minority, *divmod(missing, sizes[minority])))
    types = {f.name: f.dataType.simpleString() for f in train.schema}
    wanted = train.sparkSession.createDataFrame(
        plans, f"grp {types[group]}, minority {types[label]}, each long, extra long")
    rows = train.withColumn("grp", F.col(group)).join(F.broadcast(wanted), "grp").where(F.col(label) == F.col("minority"))
    values = F.array(*[F.col(f"`{c}`").cast("double") for c in names])
    points = cut(rows.select("grp", F.col(key).alias("key"), values.alias("x"), "minority", "each", "extra"))
    spreads = points.groupBy("grp").agg(F.array(*[
        F.when(F.stddev_pop(F.col("x")[i]) == 0, F.lit(1.0)).otherwise(F.stddev_pop(F.col("x")[i])) for i in range(len(names))
    ]).alias("spread"))
    scaled = points.join(F.broadcast(spreads), "grp").select(  # one row per group
        "grp", "key", F.zip_with("x", "spread", lambda x, s: x / s).alias("z"))
    near = nearest(scaled, k, cell_rows)
    cuts = hash_cuts(points, "grp", "key", seed + 3, {g: [extra] for g, _, _, extra in plans})
    marked = points.join(F.broadcast(cuts.drop("place")), "grp", "left")  # one row per group
    copied = marked.withColumn("_copies", F.col("each") + upto_cut("key", seed + 3).cast("int"))
    copies = copied.where(F.col("_copies") > 0).join(near, ["grp", "key"]).withColumn(
        "_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies"))))
    pick = F.floor(stable_unit(seed + 4, F.col("key"), F.col("_copy")) * F.size("near")).cast("int")
    picked = copies.select("grp", "key", "x", "minority", "_copy", F.get("near", pick).alias("_other"),
                           stable_unit(seed + 5, F.col("key"), F.col("_copy")).alias("_share"))
    others = points.select("grp", F.col("key").alias("_other"), F.col("x").alias("_found"))
    made = picked.join(others, ["grp", "_other"], "left").withColumn("_near", F.coalesce("_found", "x"))
    return made.select(
        F.col("grp").alias(group), F.concat_ws("#", F.col("key"), F.col("_copy").cast("string")).alias(key),
        *[(F.col("x")[i] + F.col("_share") * (F.col("_near")[i] - F.col("x")[i])).alias(c) for i, c in enumerate(names)],
        F.col("minority").alias(label))


def smote(
    train: DataFrame, names: Sequence[str], key: str, label: str, k: int = 5, seed: int = SEED, cell_rows: int = CELL_ROWS
) -> DataFrame:
    """Raise the minority class to the size of the majority with rows between near minority rows.

    A new row lies between a row and one of its k nearest minority rows, by exact distance on features of equal spread.
    A row without any other is repeated. New rows are whole: every minority row gets the same number of copies, give
    or take one. Adds the column synthetic.
    """
    whole = train.select(key, *[F.col(f"`{n}`") for n in names], label, F.lit(False).alias("synthetic"))
    made = smote_groups(train.withColumn("_group", F.lit(0)), names, key, label, "_group", k, seed, cell_rows)
    return whole.unionByName(made.drop("_group").withColumn("synthetic", F.lit(True)))
