"""Exact nearest neighbours inside groups: a join by pivots.

Points are dealt to the nearest of a few pivots, crowded cells again to pivots of their own, until a cell has few
points; every cell knows its centre and radius. A point's k nearest inside its own cell bound its search: only
cells that come as near as that bound are visited, and they are found from the first pivots downwards, by their
distances and radii. So the answer is exact.

Cells lying side by side make up a part, and a task's group holds the cells of one part that visit cells of another:
every point travels at most twice as often as there are parts, however many cells there are, and a few parts do until
one would hold more than ``BATCH_ROWS`` points. Inside, a matrix product finds who may be near, and only these few
distances are summed term by term. In many dimensions the bounds rule out little, and the products grow with the square
of the points.

Equal points count once and carry their k + 1 smallest keys, which is all that any neighbour list can need, so that a
dense heap of copies has no cell of its own size. Ties go to the smaller key.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stayrate.functions.ranking import spread
from stayrate.session import cut

#: Points of a cell, pivots of a split, points of a part at most (but for its last cell), and parts at least.
CELL_ROWS, FAN, BATCH_ROWS, PARTS = 16_384, 16, 131_072, 6
#: Distances held at a time, and those summed term by term at a time.
BLOCK, FEW = 1 << 22, 1 << 16
#: Bounds are compared with distances that were summed in another order.
SLACK = 1e-9


def _distance(a: Column, b: Column) -> Column:
    squares = F.zip_with(a, b, lambda x, y: (x - y) * (x - y))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda total, v: total + v))


def _distinct(points: DataFrame, k: int) -> DataFrame:
    """(grp, pid, z, keys): distinct points with their k + 1 smallest keys; the first of these names the point."""
    nth = F.row_number().over(W.partitionBy("grp", "z").orderBy("key"))
    few = points.withColumn("nth", nth).where(F.col("nth") <= k + 1)
    return few.groupBy("grp", "z").agg(F.array_sort(F.collect_list("key")).alias("keys")).select(
        "grp", F.col("keys")[0].alias("pid"), "z", "keys")


def _cells(points: DataFrame, cell_rows: int, fan: int) -> tuple[DataFrame, DataFrame]:
    """Points with their cell and the width of the cell it was split from; and all cells with centre and radius."""
    columns = ["grp", "pid", "z", "keys", "cell", "wide"]
    open_, done, nodes = points.withColumns({"cell": F.lit(""), "wide": F.lit(math.inf)}).select(*columns), [], []
    while True:
        by = ["grp", "cell"]
        sizes = cut(open_.groupBy(*by).agg(F.count(F.lit(1)).alias("n")))
        done.append(open_.join(sizes.where(F.col("n") <= cell_rows).select(*by), by))
        crowded = sizes.where(F.col("n") > cell_rows)
        if crowded.isEmpty():
            break
        split = open_.join(crowded.select(*by), by)
        nth = F.row_number().over(W.partitionBy(*by).orderBy(F.xxhash64("pid", "cell"), "pid"))
        pivots = split.select(*by, "pid", "z", nth.alias("nth")).where(F.col("nth") <= fan).groupBy(*by).agg(
            F.array_sort(F.collect_list(F.struct("nth", "z"))).alias("pivots"))
        far = F.transform("pivots", lambda p: F.struct(_distance(F.col("z"), p["z"]).alias("d"), p["nth"].alias("nth")))
        dealt = cut(split.drop("wide").join(pivots, by).withColumn("far", far).select(
            "grp", F.col("cell").alias("parent"), "pid", "z", "keys", F.array_min("far").alias("best"),
            F.col("far")[0]["d"].alias("reach"),
            F.col("pivots")[F.array_min("far")["nth"] - 1]["z"].alias("centre")))
        child = F.concat("parent", F.lit("/"), F.col("best.nth").cast("string"))
        widths = dealt.groupBy("grp", "parent").agg((2 * F.max("reach")).alias("wide"))
        nodes.append(cut(dealt.groupBy("grp", "parent", child.alias("cell")).agg(
            F.first("centre").alias("centre"), F.max("best.d").alias("radius"),
            (F.count(F.lit(1)) <= cell_rows).alias("leaf"))))
        open_ = dealt.withColumn("cell", child).join(widths, ["grp", "parent"]).select(*columns)
    placed = done[0]
    for part in done[1:]:
        placed = placed.unionByName(part)
    every = nodes[0] if nodes else None
    for part in nodes[1:]:
        every = every.unionByName(part)
    return cut(placed), every


def _nearest(guests: pd.DataFrame, hosts: pd.DataFrame, k: int, bound: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row of the guest, distance and key of its k + 1 nearest keys among the hosts, ties by key; none beyond ``bound``.

    A distance to or from a missing value is missing and comes last.
    """
    a, b = np.stack(guests["z"].to_numpy()), np.stack(hosts["z"].to_numpy())
    keys = np.concatenate([np.asarray(v, dtype=object) for v in hosts["keys"]])
    held = np.array([len(v) for v in hosts["keys"]])
    first = np.cumsum(held) - held
    place = np.empty(len(keys), np.int64)
    by_key = np.argsort(keys.astype(str) if isinstance(keys[0], str) else keys, kind="stable")
    place[by_key] = np.arange(len(keys))
    # an infinite value has no product: its distances are all summed term by term
    odd_a, odd_b = (~np.isfinite(m).all(axis=1) for m in (a, b))
    middle = b[~odd_b].mean(axis=0) if not odd_b.all() else 0.0
    ca, cb = (np.where(odd[:, None], 0.0, m - middle) for m, odd in ((a, odd_a), (b, odd_b)))
    sa, sb = (ca * ca).sum(axis=1), (cb * cb).sum(axis=1)
    # what the products may be off by, for sums of any order
    slack = 1e-11 * (sa + sb.max()) + SLACK * SLACK
    reach = None if bound is None else (bound * (1 + SLACK) + SLACK) ** 2 + slack
    nth, missing = min(k, len(b) - 1), np.isnan(a).any(axis=1)
    alike = by_key[: k + 1] if bound is None else by_key[:0]  # all are equally far from these
    rows = [np.repeat(np.nonzero(missing)[0], len(alike))]
    far, found = [np.full(len(rows[0]), np.nan)], [np.tile(keys[alike], missing.sum())]
    step, whole = max(1, BLOCK // len(b)), np.nonzero(~missing)[0]
    for start in range(0, len(whole), step):
        some = whole[start:start + step]
        near = ca[some] @ cb.T
        near *= -2
        near += sa[some, None]
        near += sb
        near[odd_a[some]] = np.inf
        near[:, odd_b] = np.inf
        if reach is not None:
            limit = reach[some]
            at, host = np.nonzero(near <= limit[:, None])
        if reach is None or len(at) > 4 * (k + 1) * len(near):
            limit = np.partition(near, nth, axis=1)[:, nth] + 2 * slack[some]
            if reach is not None:
                limit = np.minimum(limit, reach[some])
            at, host = np.nonzero(near <= limit[:, None])
        d = np.concatenate([np.zeros(0), *[
            np.sqrt(((a[some[at[i:i + FEW]]] - b[host[i:i + FEW]]) ** 2).sum(axis=1)) for i in range(0, len(at), FEW)]])
        # a point stands for all its keys
        n = held[host]
        key = np.arange(n.sum()) + np.repeat(first[host] - (np.cumsum(n) - n), n)
        at, d = np.repeat(at, n), np.repeat(d, n)
        order = np.lexsort((place[key], d, at))
        at, d, key = at[order], d[order], key[order]
        kept = np.arange(len(at)) - np.searchsorted(at, at) <= k
        rows.append(some[at[kept]])
        far.append(d[kept])
        found.append(keys[key[kept]])
    return np.concatenate(rows), np.concatenate(far), np.concatenate(found)


def _visits(placed: DataFrame, bounds: DataFrame, nodes: DataFrame) -> DataFrame:
    """(grp, cell, other): leaf cells that a point of a cell may have to visit, found from the top down."""
    own = bounds.groupBy("grp", "cell").agg(F.max("bound").alias("bound"))
    leaves = own.join(nodes.where("leaf").select("grp", "cell", "centre", "radius"), ["grp", "cell"])
    below = nodes.select("grp", "parent", F.col("cell").alias("other"), F.col("centre").alias("o_centre"),
                         F.col("radius").alias("o_radius"), "leaf")
    front, found = leaves.withColumn("parent", F.lit("")), []
    while True:
        gap = _distance(F.col("centre"), F.col("o_centre")) - F.col("radius") - F.col("o_radius")
        near = cut(front.join(below, ["grp", "parent"]).where(gap <= F.col("bound") * (1 + SLACK) + SLACK))
        found.append(near.where("leaf and other <> cell").select("grp", "cell", "other"))
        further = near.where("not leaf")
        if further.isEmpty():
            break
        front = further.select("grp", "cell", "centre", "radius", "bound", F.col("other").alias("parent"))
    every = found[0]
    for part in found[1:]:
        every = every.unionByName(part)
    return every


def _parts(sizes: DataFrame, batch_rows: int) -> DataFrame:
    """(grp, cell, n, part): cells of a group in parts of about equal numbers of points, neighbours by path together."""
    whole = W.partitionBy("grp")  # cells, not points
    before = F.coalesce(F.sum("n").over(whole.orderBy("cell").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    every = F.sum("n").over(whole)
    parts = F.greatest(F.lit(PARTS), F.ceil(every / F.lit(batch_rows)))
    return sizes.select("grp", "cell", "n", F.floor(before * parts / every).cast("int").alias("part"))


class _Best:
    """The nearest found so far of every guest; what cannot be among its k + 1 nearest any more is dropped."""

    def __init__(self, bound: np.ndarray, k: int):
        self.limit, self.k = bound.copy(), k
        self.row, self.far, self.key = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, dtype=object)

    def add(self, row: np.ndarray, far: np.ndarray, key: np.ndarray) -> None:
        row, far, key = (np.concatenate(p) for p in ((self.row, row), (self.far, far), (self.key, key)))
        order = np.lexsort((far, row))
        row, far, key = row[order], far[order], key[order]
        last = np.arange(len(row)) - np.searchsorted(row, row) == self.k
        self.limit[row[last]] = np.minimum(self.limit[row[last]], far[last])
        good = far <= self.limit[row] * (1 + SLACK) + SLACK  # equally far ones are told apart by key, at the end
        self.row, self.far, self.key = row[good], far[good], key[good]

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """As ``add`` got them, at most k + 1 of each guest, ties by key."""
        if not len(self.row):
            return self.row, self.far, self.key
        order = np.lexsort((np.unique(self.key.astype(str) if isinstance(self.key[0], str) else self.key, return_inverse=True)[1],
                            self.far, self.row))
        row = self.row[order]
        kept = order[np.arange(len(row)) - np.searchsorted(row, row) <= self.k]
        return self.row[kept], self.far[kept], self.key[kept]


def nearest(points: DataFrame, k: int, cell_rows: int = CELL_ROWS, fan: int = FAN, batch_rows: int = BATCH_ROWS) -> DataFrame:
    """(grp, key, near): the keys of the k nearest other points of the same group, nearest first, ties by key.

    ``points``: grp, key (unique in a group), z (array of double, all of one length).
    """
    whole = cut(points.select("grp", "key", "z"))
    kind = whole.schema["key"].dataType.simpleString()
    group = whole.schema["grp"].dataType.simpleString()
    distinct = cut(_distinct(whole, k))
    placed, nodes = _cells(distinct, cell_rows, fan)

    def inside(cell: pd.DataFrame) -> pd.DataFrame:
        row, far, key = _nearest(cell, cell, k)
        return pd.DataFrame({"grp": cell["grp"].iloc[0], "cell": cell["cell"].iloc[0], "pid": cell["pid"].to_numpy()[row],
                             "wide": cell["wide"].to_numpy()[row], "d": far, "key": key})

    schema = f"grp {group}, cell string, pid {kind}, wide double, d double, key {kind}"
    own = cut(placed.groupBy("grp", "cell").applyInPandas(inside, schema))
    candidates = own.select("grp", "pid", "d", "key")
    if nodes is not None:
        full = F.count(F.lit(1)) >= k + 1
        bounds = cut(own.groupBy("grp", "cell", "pid").agg(
            F.when(full, F.max("d")).otherwise(F.max("wide")).alias("bound")))
        pairs = cut(_visits(placed, bounds, nodes))
        sizes = cut(_parts(placed.groupBy("grp", "cell").agg(F.count(F.lit(1)).alias("n")), batch_rows))
        own_part = sizes.select("grp", "cell", F.col("part").alias("guest"))
        other_part = sizes.select("grp", F.col("cell").alias("other"), F.col("part").alias("host"), "n")
        visits = pairs.join(own_part, ["grp", "cell"]).join(other_part, ["grp", "other"])
        place = ["grp", "guest", "host"]
        met_cells = visits.groupBy(*place, "other", "n").agg(F.concat_ws(",", F.collect_set("cell")).alias("visitors"))
        moved = met_cells.agg(F.sum("n")).first()[0] or 0
        guests = visits.select(*place, "cell").distinct().join(placed.join(bounds, ["grp", "cell", "pid"]), ["grp", "cell"]).select(
            *place, "cell", "pid", "z", "bound")
        hosts = met_cells.join(placed.select("grp", F.col("cell").alias("other"), "z", "keys"), ["grp", "other"])
        hosts = hosts.select(*[F.col(c).alias(c) for c in (*place, "other", "visitors", "z", "keys")])  # columns of its own beside the guests'

        def across(visitors: pd.DataFrame, cells: pd.DataFrame) -> pd.DataFrame:
            if visitors.empty or cells.empty:
                return pd.DataFrame({c: pd.Series([], dtype=object) for c in ("grp", "pid", "d", "key")})
            best = _Best(visitors["bound"].to_numpy(), k)
            for _, cell in cells.groupby("other"):
                some = np.flatnonzero(visitors["cell"].isin(cell["visitors"].iloc[0].split(",")))
                row, far, key = _nearest(visitors.iloc[some], cell, k, best.limit[some])
                best.add(some[row], far, key)
            row, far, key = best.found()
            return pd.DataFrame({
                "grp": pd.Series(visitors["grp"].to_numpy(dtype=object)[row], dtype=object),
                "pid": pd.Series(visitors["pid"].to_numpy(dtype=object)[row], dtype=object),
                "d": far, "key": pd.Series(key, dtype=object)})

        met = spread(guests, moved, *place).groupBy(*place).cogroup(spread(hosts, moved, *place).groupBy(*place)).applyInPandas(
            across, f"grp {group}, pid {kind}, d double, key {kind}")
        candidates = candidates.unionByName(met)
    nth = F.row_number().over(W.partitionBy("grp", "pid").orderBy("d", "key"))
    best = candidates.withColumn("nth", nth).where(F.col("nth") <= k + 1).groupBy("grp", "pid").agg(
        F.array_sort(F.collect_list(F.struct("nth", "key"))).alias("found"))
    lists = distinct.select("grp", "pid", "z").join(best, ["grp", "pid"]).select("grp", "z", "found")
    others = F.filter(F.transform("found", lambda v: v["key"]), lambda v: v != F.col("key"))
    return whole.join(lists, ["grp", "z"]).select("grp", "key", F.slice(others, 1, k).alias("near"))
