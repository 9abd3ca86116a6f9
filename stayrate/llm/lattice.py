"""Near-copies among embeddings by E8 lattice hashing.

A hash table projects unit vectors on eight random directions (times ``blocks``) and decodes the projection to the
nearest point of the lattice E8, which names the cell. A vector is listed in its own cell and, as a probe, in the
neighbouring cells nearest to its projection; two vectors meet where a cell of one's own is a cell, own or probed, of
the other. All pairs that meet are verified by cosine in double precision. Projections are computed on whole numbers,
so that cells do not depend on the batch or machine that computes them.

Equal vectors count as one with a number of copies. Cells are cut into slices of ``SLICE`` rows on both sides, and a task
holds one slice against one other, so crowded cells are compared in full but never gathered. A pair that meets more
than once counts in the first place alone, which every place can tell from the two vectors; so only sums per
vector and spanning links leave a task, never pairs.

``blocks`` grows with the logarithm of the number of distinct vectors, so that cells stay small (``plan``). Share of
pairs at a cosine of exactly 0.95 that meet, the worst that must be found: see README; nearer pairs meet more often.

Vectors meet those of the same length only. Null and zero vectors and those with null or non-finite components link
with nothing: no links, their own id as component, kept. Rows without id take no part in links and have no component
(null) and are not kept. Rows that repeat an id are vectors of their own. An empty table gives no rows.
"""

from __future__ import annotations

import math
from itertools import combinations, product
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stayrate.llm.graph import components
from stayrate.llm.simhash import _forest
from stayrate.llm.topk import _usable
from stayrate.session import cut

SLICE = 1_024
#: Whole numbers per lattice unit, and per unit of a vector's component and of a direction.
UNIT, FINE, COARSE = 1 << 16, 1 << 14, 1 << 10


class Plan(NamedTuple):
    """Tables, lattice blocks of a cell's name, cells a vector is listed in, and the width of a lattice unit."""

    tables: int
    blocks: int
    listed: int
    width: float


def plan(distinct: int) -> Plan:
    """One block of eight directions up to a quarter of a million vectors, one more for every thousandfold after."""
    blocks = max(1, math.ceil((math.log2(max(distinct, 1)) - 18) / 10) + 1)
    return Plan(4, 1, 8, 1.4) if blocks == 1 else Plan(4 + 2 * (blocks - 2), blocks, 16 * (blocks - 1), 1.4 + 0.8 * (blocks - 1))


def _roots() -> np.ndarray:
    """The 240 shortest vectors of E8, doubled."""
    whole = [np.bincount([i, j], [2 * s, 2 * t], 8) for i, j in combinations(range(8), 2) for s, t in product((1, -1), repeat=2)]
    half = [s for s in product((1, -1), repeat=8) if sum(x < 0 for x in s) % 2 == 0]
    return np.array([*whole, *half], dtype=np.float64)


ROOTS = _roots()
#: Neighbours per block from which a cell's neighbours are made up.
NEAREST = 8


def _even(y: np.ndarray) -> np.ndarray:
    """Nearest point of D8 (whole coordinates, even sum), in units: round, and mend the sum at the worst coordinate."""
    r = np.floor(y / UNIT + 0.5)
    off = y - r * UNIT
    worst = np.abs(off).argmax(axis=1)
    odd = np.nonzero(r.sum(axis=1) % 2)[0]
    r[odd, worst[odd]] += np.where(off[odd, worst[odd]] >= 0, 1, -1)
    return r


def decoded(y: np.ndarray) -> np.ndarray:
    """Nearest point of E8 to rows of eight whole numbers of 1/UNIT, doubled so that it is whole."""
    a = 2 * _even(y)
    b = 2 * _even(y - UNIT // 2) + 1
    far = lambda c: ((2 * y - c * UNIT) ** 2).sum(axis=1)
    return np.where((far(a) <= far(b))[:, None], a, b)


def _directions(dims: int, p: Plan) -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.RandomState([20, dims, p.tables, p.blocks])
    directions = np.rint(draw.normal(size=(dims, p.tables * p.blocks * 8)) * COARSE)
    return directions, np.rint(draw.uniform(0, 2, size=p.tables * p.blocks * 8) * UNIT)


def units(x: np.ndarray) -> np.ndarray:
    """Unit vectors; scaled by the largest component first, so that nothing overflows."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def cells(unit: np.ndarray, p: Plan) -> np.ndarray:
    """Names of the cells (vectors x tables x listed) as 64-bit numbers; the own cell comes first."""
    n, dims = unit.shape
    directions, offsets = _directions(dims, p)
    # sums of whole numbers below 2**53: exact in any order
    y = np.floor(np.rint(unit * FINE) @ directions * (UNIT / (FINE * COARSE * p.width))) + offsets
    y = y.reshape(n * p.tables, p.blocks, 8)
    weights = np.random.RandomState([21, p.blocks]).randint(1, 1 << 62, size=(p.blocks, 8), dtype=np.int64).astype(np.uint64)
    names, far = None, None
    for block in range(p.blocks):
        own = decoded(y[:, block])
        rest = 2 * y[:, block] - own * UNIT  # doubled, in units
        # |rest - root|**2 = |rest|**2 - 2 rest.root + |root|**2, of which the first is common
        gap = (ROOTS * ROOTS).sum(axis=1) * UNIT**2 - 2 * UNIT * (rest @ ROOTS.T)
        near = np.argsort(gap, axis=1, kind="stable")[:, : NEAREST - 1]
        points = np.concatenate([own[:, None], own[:, None] + ROOTS[near]], axis=1).astype(np.int64).astype(np.uint64)
        here = (points * weights[block]).sum(axis=2)
        gaps = np.concatenate([np.zeros((len(own), 1)), np.take_along_axis(gap, near, axis=1)], axis=1)
        if names is None:
            names, far = here, gaps
        else:
            names = (names[:, :, None] * np.uint64(0x9E3779B97F4A7C15) + here[:, None]).reshape(len(own), -1)
            far = (far[:, :, None] + gaps[:, None]).reshape(len(own), -1)
        order = np.argsort(far, axis=1, kind="stable")[:, : p.listed]  # the own cell has gap 0, no other has less
        names, far = np.take_along_axis(names, order, axis=1), np.take_along_axis(far, order, axis=1)
    return names.reshape(n, p.tables, -1).view(np.int64)


def _vectors(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)


def listings(reps: DataFrame, p: Plan) -> DataFrame:
    """(rep, dims, table_no, cell, own): every vector in its own and its probed cells."""

    def work(batches):
        for batch in batches:
            dims = batch.column("dims").to_numpy()
            for d in np.unique(dims):
                some = batch.filter(pa.array(dims == d))
                found = cells(units(_vectors(some.column("vec"), d)), p)
                n, tables, listed = found.shape
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.repeat(some.column("rep").to_numpy(), tables * listed)),
                    pa.array(np.full(found.size, d, np.int32)),
                    pa.array(np.tile(np.repeat(np.arange(tables, dtype=np.int32), listed), n)),
                    pa.array(found.ravel()),
                    pa.array(np.tile(np.arange(listed) == 0, n * tables)),
                ], names=["rep", "dims", "table_no", "cell", "own"])

    schema = "rep long, dims int, table_no int, cell long, own boolean"
    return reps.select("rep", "dims", "vec").mapInArrow(work, schema)


def _first_met(a: np.ndarray, b: np.ndarray, table: int) -> np.ndarray:
    """Whether pairs of cell lists (pairs x tables x listed) that meet in the own cell of a meet here first."""
    own_a, own_b = a[:, :, 0], b[:, :, 0]
    met = (a == own_b[:, :, None]).any(axis=2) | (b == own_a[:, :, None]).any(axis=2)
    first = ~met[:, :table].any(axis=1)
    # in this table they may meet in two cells, each other's own: the smaller counts
    twice = (a[:, table] == own_b[:, table, None]).any(axis=1) & (own_a[:, table] != own_b[:, table])
    return first & ~(twice & (own_b[:, table] < own_a[:, table]))


def _compared(table: int, held: np.ndarray, listed: np.ndarray, rep: np.ndarray, copies: np.ndarray, x: np.ndarray,
              least: float, p: Plan) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Links first met between the rows ``held`` (own cell) and ``listed``: sums per row, and spanning links."""
    unit, raw = units(x), x / np.abs(x).max(axis=1, keepdims=True)
    norm = np.sqrt((raw * raw).sum(axis=1))
    cosine = raw[held] @ raw[listed].T / (norm[held][:, None] * norm[listed][None, :])
    i, j = np.nonzero((cosine >= least) & (rep[held][:, None] != rep[listed][None, :]))
    i, j = held[i], listed[j]
    sums, label = np.zeros(len(rep), np.int64), np.arange(len(rep))
    if len(i):
        used = np.unique(np.concatenate([i, j]))
        at = np.zeros(len(rep), np.int64)
        at[used] = np.arange(len(used))
        names = cells(unit[used], p)
        keep = np.zeros(len(i), bool)
        for start in range(0, len(i), 1 << 16):
            k = slice(start, start + (1 << 16))
            a, b = names[at[i[k]]], names[at[j[k]]]
            same = a[:, table, 0] == b[:, table, 0]
            keep[k] = _first_met(a, b, table) & (~same | (rep[i[k]] < rep[j[k]]))
        i, j = i[keep], j[keep]
        np.add.at(sums, i, copies[j])
        np.add.at(sums, j, copies[i])
        label = _forest(len(rep), i, j)
    return sums, label


def _runs(frame: pa.Table, keys: list[str]) -> list[tuple[int, int]]:
    changed = np.zeros(len(frame), bool)
    changed[:1] = True
    for key in keys:
        values = frame.column(key).to_numpy()
        changed[1:] |= values[1:] != values[:-1]
    starts = np.nonzero(changed)[0]
    return list(zip(starts, [*starts[1:], len(frame)]))


def link_sums(met: DataFrame, least: float, p: Plan) -> DataFrame:
    """(rep, n, other): copies linked, and a linked vector or null; rows of ``met`` come sorted by place.

    A place is a table, cell and pair of slices; ``held`` and ``listed`` say on which side a row takes part.
    """
    keys = ["dims", "table_no", "cell", "slice_a", "slice_b"]

    def done(table: pa.Table):
        for start, stop in _runs(table, keys):
            part = table.slice(start, stop - start).combine_chunks()
            held, listed = (np.nonzero(part.column(c).to_numpy())[0] for c in ("held", "listed"))
            if not len(held) or not len(listed):
                continue
            rep = part.column("rep").to_numpy()
            x = _vectors(part.column("vec").combine_chunks(), part.column("dims")[0].as_py())
            sums, label = _compared(part.column("table_no")[0].as_py(), held, listed, rep,
                                    part.column("copies").to_numpy(), x, least, p)
            some = np.nonzero(sums)[0]
            if len(some):
                other = np.where(label[some] != some, rep[label[some]], -1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rep[some]), pa.array(sums[some]), pa.array(other, mask=other < 0)], names=["rep", "n", "other"])

    def work(batches):
        waiting: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            frame = pa.Table.from_batches([*waiting, batch])
            last = _runs(frame, keys)[-1][0]
            if last:
                yield from done(frame.slice(0, last))
            waiting = frame.slice(last).to_batches()
        if waiting:
            yield from done(pa.Table.from_batches(waiting))

    return met.select(*keys, "rep", "copies", "vec", "held", "listed").mapInArrow(work, "rep long, n long, other long")


def near_copies(vectors: DataFrame, least: float = 0.95, how: Plan | None = None, slice_rows: int = SLICE,
                id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``id_col``, n_links, component_id, kept; one row per row of ``vectors``."""
    rows = cut(vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vec")))
    x = F.col("vec").cast("array<double>")
    usable = F.col("id").isNotNull() & _usable(x) & F.coalesce(F.exists(x, lambda v: v != 0), F.lit(False))
    marked = rows.withColumn("usable", F.coalesce(usable, F.lit(False)))
    reps = cut(marked.where("usable").groupBy("vec").agg(F.min("id").alias("first_id"), F.count("*").alias("copies"))
               .withColumns({"rep": F.monotonically_increasing_id(), "dims": F.size("vec")}))
    p = how or plan(reps.count())
    found = cut(listings(reps, p))
    place = ["dims", "table_no", "cell"]
    sizes = found.groupBy(*place).agg(F.count_if("own").alias("n_held"), F.count("*").alias("n_listed")).where(
        "n_held > 0 and n_listed > 1").select(
        *place, F.ceil(F.col("n_held") / slice_rows).cast("int").alias("parts_a"),
        F.ceil(F.col("n_listed") / slice_rows).cast("int").alias("parts_b"))
    dealt = found.join(sizes, place).withColumns({
        "a": F.pmod(F.xxhash64("rep", F.lit(1)), F.col("parts_a")).cast("int"),
        "b": F.pmod(F.xxhash64("rep", F.lit(2)), F.col("parts_b")).cast("int")})
    # held in slice a against all slices b, listed in slice b against all slices a; one row where both are the same place
    every = lambda parts: F.sequence(F.lit(0), F.col(parts) - 1)
    as_held = F.transform(every("parts_b"), lambda b: F.struct(
        F.col("a").alias("slice_a"), b.alias("slice_b"), F.lit(True).alias("held"), (b == F.col("b")).alias("listed")))
    as_listed = F.transform(
        F.filter(every("parts_a"), lambda a: ~F.col("own") | (a != F.col("a"))), lambda a: F.struct(
            a.alias("slice_a"), F.col("b").alias("slice_b"), F.lit(False).alias("held"), F.lit(True).alias("listed")))
    at = F.when(F.col("own"), F.concat(as_held, as_listed)).otherwise(as_listed)
    places = dealt.select("rep", *place, F.explode(at).alias("at")).select("rep", *place, "at.*")
    met = places.join(reps.select("rep", "copies", "vec"), "rep")
    order = [*place, "slice_a", "slice_b"]
    links = cut(link_sums(met.repartition(*order).sortWithinPartitions(*order, "rep"), least, p))
    sums = links.groupBy("rep").agg(F.sum("n").alias("n"))
    root = components(links.where("other is not null").select(F.col("rep").alias("a"), F.col("other").alias("b")))
    labelled = reps.select("rep", "vec", "first_id", "copies").join(root.withColumnRenamed("node", "rep"), "rep", "left")
    labelled = labelled.join(sums, "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    smallest = labelled.groupBy("root").agg(F.min("first_id").alias("component_id"))
    classes = labelled.join(smallest, "root").select(
        "vec", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    linked = marked.where("usable").join(classes, "vec").select("id", "n_links", "component_id")
    alone = marked.where("not usable").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return linked.unionByName(alone).select(
        F.col("id").alias(id_col), "n_links", "component_id",
        F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))
