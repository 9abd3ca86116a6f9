"""Gradient-boosted trees on binned features, grown for all folds and models at the same time.

Features are binned once into one byte per value. A row knows the fits that it belongs to as bits, so five folds and
the whole training part share its bytes. One Spark aggregate per tree level adds up, for every fit and open node, the
histograms (rows, gradients, curvatures by feature and bin); only the smaller child of a split is counted, its sibling
is what the parent has left. Gradients are whole multiples of 2**-32, so sums do not depend on the order or place of
rows: the same rows give the same trees however they are partitioned.

Two rules of growth, as published:

* first order: splits reduce the squared error of the gradients, a leaf is the sum of gradients over that of curvatures;
* second order: gain and leaves from gradients and curvatures with an L2 penalty, rows drawn by a hash of the key per
  round, columns drawn by a hash per tree.

This is one of the few places with an RDD: margins live with their rows from level to level, and a data frame would
plan each of some 1,500 levels anew. Lineage is cut by ``checkpoint()``; lost executors are recomputed from there. Trees
are handed to ``save`` every ``CHUNK`` rounds, so that a broken run goes on where it stopped. The driver gets histograms,
whose size depends on features, bins and open nodes alone.

Several fits of up to ``OWN_ROWS`` rows are grown side by side instead, each in a task that holds its rows: no job and no
exchange of histograms per level. Sums are whole either way, so both ways give the same trees.
"""

from __future__ import annotations

import json
import math
import zlib
from collections.abc import Callable, Sequence
from functools import partial
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import RDD, StorageLevel, TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stayrate.functions.columns import magnitude_bucket
from stayrate.session import cut, shared_folder

BINS = 32
#: Rows per block, rounds between checkpoints, rounds per saved part.
TASK_ROWS, LINEAGE, CHUNK = 16_384, 20, 50
#: Rounds between stored margins; until then the latest trees are added in the pass that counts, which is cheaper than a
#: second Python stage and a store per round.
PENDING = 2
#: Blocks per task at most, and the number of tasks up to which the driver adds up their histograms itself.
TASK_BLOCKS, FEW_TASKS = 16, 32
UNIT = float(1 << 32)
#: Rows up to which a fit is grown in a task of its own: sums of that many gradients are whole in a double.
OWN_ROWS = 1 << 21
#: Such a task counts features together that have so many bins in common at most, and so many rows at a time.
JOINT, PASS_ROWS = 1024, 1 << 17


class Settings(NamedTuple):
    rounds: int
    rate: float
    depth: int
    second_order: bool = False
    row_share: float = 1.0
    column_share: float = 1.0
    l2: float = 1.0
    least_weight: float = 1.0


# fixed values: published hyper-parameters of the two boosted models
PUBLISHED = {
    "gbt": Settings(200, 0.05, 4),
    "gbt_subsampled": Settings(300, 0.05, 5, second_order=True, row_share=0.8, column_share=0.8),
}


class Fit(NamedTuple):
    """One ensemble to grow: the model's name and settings, and the bit of the rows that it learns from."""

    name: str
    group: int
    settings: Settings

    @property
    def salt(self) -> int:
        """Draws depend on the model, not on what else is grown with it."""
        return zlib.crc32(self.name.encode())


# ------------------------------------------------------------------------------ bins
def edges(frame: DataFrame, names: Sequence[str], bins: int = BINS) -> list[np.ndarray]:
    """Upper limits of the bins of each feature but the last: values of the data, at equal shares of the rows.

    Values are first counted in buckets of relative width, a sketch of bounded size that adds up in any order.
    """
    long = frame.select(F.explode(F.array(*[
        F.struct(F.lit(i).alias("f"), F.col(f"`{n}`").cast("double").alias("v")) for i, n in enumerate(names)])).alias("p"))
    counts = long.select("p.f", "p.v").withColumn("b", magnitude_bucket(F.col("v"))).groupBy("f", "b").agg(
        F.count(F.lit(1)).alias("n"), F.max("v").alias("top"))
    # the bucketing rule bounds the rows per feature
    upto = F.sum("n").over(W.partitionBy("f").orderBy("b").rowsBetween(W.unboundedPreceding, W.currentRow))
    ranked = counts.withColumns({"upto": upto, "all": F.sum("n").over(W.partitionBy("f"))})
    share = F.floor((F.col("upto") * bins - 1) / F.col("all"))
    kinds = ranked.groupBy("f").agg(F.count(F.lit(1)).alias("kinds"))
    placed = ranked.join(kinds, "f").withColumn("share", F.when(F.col("kinds") <= bins, F.col("b")).otherwise(share))
    limits = placed.groupBy("f", "share").agg(F.max("top").alias("top")).collect()
    found = [sorted({r["top"] for r in limits if r["f"] == i})[:-1] for i in range(len(names))]
    return [np.array(e, dtype=np.float64) for e in found]


def binned(x: np.ndarray, limits: Sequence[np.ndarray]) -> np.ndarray:
    """Bin numbers of raw rows; a value on a limit belongs to the bin below."""
    return np.stack([np.searchsorted(e, x[:, i], side="left") for i, e in enumerate(limits)], axis=1).astype(np.uint8)


class Block(NamedTuple):
    """Rows of one task: hash of the key, label, fits, bins, and margins per fit."""

    key: np.ndarray
    label: np.ndarray
    groups: np.ndarray
    bins: np.ndarray
    margin: np.ndarray


def packed(rows: DataFrame, names: Sequence[str], limits: Sequence[np.ndarray], key: str, label: str) -> DataFrame:
    """Rows with a column ``groups`` (bits of their fits) as numbered blocks of bytes, written to the shared folder.

    There are as many blocks as give every core the same number of them.
    """
    cores, parts = rows.sparkSession.sparkContext.defaultParallelism, math.ceil(rows.count() / TASK_ROWS)
    parts = max(1, parts if parts < 2 else math.ceil(parts / cores) * cores)
    schema = "place int, key binary, label binary, groups binary, bins binary"

    def block(held):
        arrays = [np.ascontiguousarray(np.concatenate(p)).tobytes() for p in zip(*held)]
        return pa.RecordBatch.from_arrays(
            [pa.array([TaskContext.get().partitionId()], pa.int32()), *[pa.array([a], pa.binary()) for a in arrays]],
            names=["place", "key", "label", "groups", "bins"])

    def pack(batches):
        held = []
        for batch in batches:
            x = np.stack([batch.column(f"f{i}").to_numpy() for i in range(len(limits))], axis=1)
            held.append((batch.column("h").to_numpy(), batch.column("y").to_numpy().astype(np.int8),
                         batch.column("groups").to_numpy(), binned(x, limits)))
            if sum(len(h) for h, *_ in held) >= 2 * TASK_ROWS:
                yield block(held)
                held = []
        if held:
            yield block(held)

    flat = rows.select(F.xxhash64(key).alias("h"), F.col(label).alias("y"), F.col("groups").cast("long").alias("groups"), *[
        F.col(f"`{name}`").cast("double").alias(f"f{i}") for i, name in enumerate(names)])
    return cut(flat.repartition(parts, "h").mapInArrow(pack, schema))


def _dealt(blocks: DataFrame) -> RDD:
    """The blocks in tasks of the same number of blocks: how their files are read together would leave cores idle."""
    cores = blocks.sparkSession.sparkContext.defaultParallelism
    last = blocks.agg(F.max("place")).first()[0]
    n = 1 if last is None else last + 1
    tasks = min(n, cores * math.ceil(n / (cores * TASK_BLOCKS)))
    return blocks.rdd.map(lambda row: (row["place"], row)).partitionBy(tasks, lambda place: place).values()


def _block(row, width: int, start: np.ndarray) -> Block:
    key = np.frombuffer(row["key"], np.int64).view(np.uint64)
    return Block(key, np.frombuffer(row["label"], np.int8).astype(np.float64), np.frombuffer(row["groups"], np.int64),
                 np.frombuffer(row["bins"], np.uint8).reshape(-1, width), np.repeat(start[None, :], len(key), 0))


# ------------------------------------------------------------------------------ trees
class Tree(NamedTuple):
    """A tree in heap order: children of node i are 2 i + 1 and 2 i + 2; feature -1 marks a leaf."""

    feature: np.ndarray
    bin: np.ndarray
    value: np.ndarray
    cover: np.ndarray
    gain: np.ndarray


def _unit(keys: np.ndarray, *salt: int) -> np.ndarray:
    """Uniform numbers in [0, 1) from hashes: the same rows and columns on every retry."""
    h = keys.astype(np.uint64)
    for s in salt:
        h = (h ^ np.uint64(s)) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
        h = h ^ (h >> np.uint64(29))
    return (h >> np.uint64(11)).astype(np.float64) / float(1 << 53)


def descend(tree: Tree, bins: np.ndarray, levels: int, at: np.ndarray) -> np.ndarray:
    """The node each of the rows ``at`` stands at after so many levels."""
    node = np.zeros(len(at), np.int64)
    if not levels:
        return node
    flat, first, feature = bins.ravel(), at * bins.shape[1], np.maximum(tree.feature, 0).astype(np.int64)
    own = np.arange(len(feature))
    children = np.where(tree.feature < 0, own, [2 * own + 1, 2 * own + 2]).T.ravel()  # a leaf is its own child
    for _ in range(levels):
        right = flat.take(first + feature.take(node)) > tree.bin.take(node)
        node = children.take(2 * node + right)
    return node


def _empty(settings: Settings) -> Tree:
    size = (1 << (settings.depth + 1)) - 1
    return Tree(np.full(size, -1, np.int32), np.zeros(size, np.int32), np.zeros(size), np.zeros(size), np.zeros(size))


def _advance(block: Block, trees: dict[int, Tree], fits: Sequence[Fit]) -> Block:
    """Margins after the trees, in the rows of each fit alone: no other row's margin is asked for."""
    margin = block.margin.copy()
    for t, tree in trees.items():
        at = np.flatnonzero((block.groups >> fits[t].group) & 1)
        margin[at, t] += tree.value.take(descend(tree, block.bins, fits[t].settings.depth, at))
    return block._replace(margin=margin)


def _caught_up(block: Block, pending: Sequence[dict[int, Tree]], fits: Sequence[Fit]) -> Block:
    for trees in pending:
        block = _advance(block, trees, fits)
    return block


def _histograms(block: Block, fits: Sequence[Fit], wanted: dict[int, tuple[Tree, list[int]]], level: int, round_: int) -> np.ndarray:
    """Sums of rows, gradients and curvatures: (fit and node as listed) x 3 x features x bins."""
    width, parts, drawn = block.bins.shape[1], [], {}
    places = block.bins + np.arange(width) * BINS
    for t, (tree, nodes) in wanted.items():
        fit = fits[t]
        used = (block.groups >> fit.group) & 1 == 1
        if fit.settings.row_share < 1:
            draw = fit.salt, fit.settings.row_share  # the fits of one model draw the same rows
            if draw not in drawn:
                drawn[draw] = _unit(block.key, fit.salt, round_ + 1) < fit.settings.row_share
            used &= drawn[draw]
        at = np.flatnonzero(used)
        slot = np.full(2 ** (level + 1), -1)
        slot[np.array(nodes, dtype=np.int64)] = np.arange(len(nodes))
        own = slot.take(descend(tree, block.bins, level, at))
        if level:
            inside = np.flatnonzero(own >= 0)
            at, own = at.take(inside), own.take(inside)
        p = 1.0 / (1.0 + np.exp(-block.margin[at, t]))
        cells = places.take(at, axis=0)
        if len(nodes) > 1:
            cells += (own * (width * BINS))[:, None]
        cells, size = cells.ravel(), len(nodes) * width * BINS
        sums = [np.bincount(cells, minlength=size)]
        for v in (np.rint((block.label[at] - p) * UNIT), np.rint(p * (1 - p) * UNIT)):
            sums.append(np.bincount(cells, weights=np.repeat(v, width), minlength=size))
        parts.append(np.stack(sums).astype(np.int64).reshape(3, len(nodes), width, BINS).swapaxes(0, 1))
    return np.concatenate(parts)


def _leaf(settings: Settings, g: float, h: float) -> float:
    weight = h + settings.l2 if settings.second_order else h
    return settings.rate * g / weight if weight > 1e-150 else 0.0


def _splits(settings: Settings, sums: np.ndarray, columns: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gain, feature and bin of the best split of every node; gain 0 for none. ``sums``: nodes x 3 x features x bins."""
    n, g, h = sums[:, 0], sums[:, 1] / UNIT, sums[:, 2] / UNIT
    nl, gl, hl = (np.cumsum(v, axis=2)[:, :, :-1] for v in (n, g, h))
    na, ga, ha = (v[:, 0].sum(axis=1)[:, None, None] for v in (n, g, h))
    nr, gr, hr = na - nl, ga - gl, ha - hl
    allowed = (nl > 0) & (nr > 0) & columns[None, :, None]
    with np.errstate(divide="ignore", invalid="ignore"):
        if settings.second_order:
            allowed &= (hl >= settings.least_weight) & (hr >= settings.least_weight)
            l2 = settings.l2
            gain = gl**2 / (hl + l2) + gr**2 / (hr + l2) - ga**2 / (ha + l2)
        else:
            gain = nl * nr / na * (gl / nl - gr / nr) ** 2
    gain = np.where(allowed, gain, 0.0).reshape(len(sums), -1)
    best = gain.argmax(axis=1)
    most = gain[np.arange(len(sums)), best]
    feature, at = np.divmod(best, BINS - 1)
    return np.where(most > 1e-9, most, 0.0), feature, at


def grow_round(fits: Sequence[Fit], active: Sequence[int], width: int, round_: int,
               aggregate: Callable[[dict[int, tuple[Tree, list[int]]], int], np.ndarray]) -> dict[int, Tree]:
    """One tree for every active fit, level by level; ``aggregate`` adds up the histograms of the nodes it is given."""
    trees = {t: _empty(fits[t].settings) for t in active}
    columns = {t: _unit(np.arange(1, width + 1), fits[t].salt, round_ + 1, 77) < fits[t].settings.column_share for t in active}
    for t in active:
        if not columns[t].any():
            columns[t][:] = True
    # per fit: open nodes of this level with their sums; a pair (built, sibling) shares the parent's sums
    counted = {t: [0] for t in active}
    parents: dict[int, dict[int, np.ndarray]] = {t: {} for t in active}
    for level in range(max(fits[t].settings.depth for t in active)):
        wanted = {t: (trees[t], nodes) for t, nodes in counted.items() if nodes and level < fits[t].settings.depth}
        if not wanted:
            break
        sums, at = aggregate(wanted, level), 0
        counted = {}
        for t, (tree, nodes) in wanted.items():
            s, found = fits[t].settings, {}
            for node in nodes:
                found[node] = sums[at]
                at += 1
                if node:
                    found[node + 1 if node % 2 else node - 1] = parents[t][node] - found[node]
            counted[t], parents[t] = [], {}
            open_ = sorted(found)
            best = _splits(s, np.stack([found[node] for node in open_]), columns[t])
            for node, gain, feature, cut_at in zip(open_, *best):
                own = found[node]
                n, g, h = own[:, 0].sum(axis=1)
                tree.cover[node], tree.value[node] = n, _leaf(s, g / UNIT, h / UNIT)
                if not gain:
                    continue
                tree.feature[node], tree.bin[node], tree.gain[node] = feature, cut_at, gain
                left, right = 2 * node + 1, 2 * node + 2
                part = own[:, feature, : cut_at + 1].sum(axis=1)
                for child, (cn, cg, ch) in ((left, part), (right, np.array([n, g, h]) - part)):
                    tree.cover[child], tree.value[child] = cn, _leaf(s, cg / UNIT, ch / UNIT)
                small = left if part[0] <= n - part[0] else right
                counted[t].append(small)
                parents[t][small] = own
    return trees


# ------------------------------------------------------------------------------ the ensemble
class Ensemble(NamedTuple):
    """A fitted model: start margin, trees with raw thresholds, feature names and settings."""

    name: str
    names: tuple[str, ...]
    depth: int
    start: float
    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    cover: np.ndarray
    gain: np.ndarray

    def margins(self, x: np.ndarray) -> np.ndarray:
        total, rows = np.full(len(x), self.start), np.arange(len(x))
        for feature, threshold, value in zip(self.feature, self.threshold, self.value):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                f = feature[node]
                node = np.where(f < 0, node, 2 * node + 1 + (x[rows, np.maximum(f, 0)] > threshold[node]))
            total += value[node]
        return total

    def importances(self) -> np.ndarray:
        gains = np.bincount(np.maximum(self.feature, 0).ravel(), weights=np.where(self.feature >= 0, self.gain, 0).ravel(),
                            minlength=len(self.names))
        return gains / (gains.sum() or 1.0)


def ensemble(fit: Fit, trees: Sequence[Tree], start: float, names: Sequence[str], limits: Sequence[np.ndarray]) -> Ensemble:
    size = (1 << (fit.settings.depth + 1)) - 1
    stacked = [np.stack([getattr(t, f) for t in trees]) if trees else np.zeros((0, size)) for f in Tree._fields]
    feature, at, value, cover, gain = stacked
    table = np.full((len(names), BINS), np.inf)
    for i, e in enumerate(limits):
        table[i, : len(e)] = e
    threshold = table[np.maximum(feature, 0).astype(int), at.astype(int)]
    return Ensemble(fit.name, tuple(names), fit.settings.depth, start, feature.astype(np.int32), threshold, value, cover, gain)


def frozen(model: Ensemble) -> str:
    return json.dumps({k: v.tolist() if isinstance(v, np.ndarray) else v for k, v in model._asdict().items()})


def thawed(text: str) -> Ensemble:
    d = json.loads(text)
    arrays = {k: np.array(d[k], dtype=np.int32 if k == "feature" else np.float64) for k in ("feature", "threshold", "value", "cover", "gain")}
    return Ensemble(**{**d, **arrays, "names": tuple(d["names"])})


# ------------------------------------------------------------------------------ a fit in a task of its own
def _together(sizes: Sequence[int]) -> list[list[int]]:
    """Features by numbers of bins, dealt into groups whose bins in common are no more than JOINT."""
    groups: list[list[int]] = []
    for f in sorted(range(len(sizes)), key=lambda f: -sizes[f]):
        fitting = (g for g in groups if math.prod(sizes[i] for i in g) * sizes[f] <= JOINT)
        group = next(fitting, None)
        if group is None:
            groups.append([f])
        else:
            group.append(f)
    return groups


def _apart(sums: np.ndarray, sizes: Sequence[int]) -> list[np.ndarray]:
    """Histograms of each feature of a group from that of their bins in common, the last axis of ``sums``."""
    if len(sizes) == 1:
        return [sums]
    half = len(sizes) // 2
    square = sums.reshape(*sums.shape[:-1], math.prod(sizes[:half]), math.prod(sizes[half:]))
    return _apart(square.sum(axis=-1), sizes[:half]) + _apart(square.sum(axis=-2), sizes[half:])


class Own:
    """All rows of one fit: bins, bins in common of groups of features, margins, and the nodes the rows stand at."""

    def __init__(self, fit: Fit, start: float, key: np.ndarray, label: np.ndarray, bins: np.ndarray):
        self.fit, self.key, self.label, self.bins = fit, key, label, bins
        self.margin, self.node = np.full(len(key), start), np.zeros(len(key), np.int64)
        tops = bins.max(axis=0).astype(int) + 1 if len(bins) else np.ones(bins.shape[1], int)
        self.groups = []
        for features in _together(tops.tolist()):
            code = np.zeros(len(bins), np.uint16)
            for f in features:
                code *= np.uint16(tops[f])
                code += bins[:, f]
            self.groups.append((features, tops[features].tolist(), code))
        self.passes = [slice(a, min(a + PASS_ROWS, len(key))) for a in range(0, len(key), PASS_ROWS)]

    def step(self, tree: Tree) -> None:
        """All rows go down one level."""
        width, own = self.bins.shape[1], np.arange(len(tree.feature))
        feature = np.maximum(tree.feature, 0).astype(np.int64)
        children = np.where(tree.feature < 0, own, [2 * own + 1, 2 * own + 2]).T.ravel()
        first = np.arange(min(len(self.key), PASS_ROWS)) * width
        for some in self.passes:
            node = self.node[some]
            right = self.bins[some].ravel().take(first[: len(node)] + feature.take(node)) > tree.bin.take(node)
            self.node[some] = children.take(2 * node + right)

    def histograms(self, wanted: dict[int, tuple[Tree, list[int]]], level: int, round_: int) -> np.ndarray:
        """What ``_histograms`` gives for the only fit; levels have to come in turn, from 0 on."""
        (tree, nodes), = wanted.values()
        if level:
            self.step(tree)
        else:
            p, share = 1.0 / (1.0 + np.exp(-self.margin)), self.fit.settings.row_share
            self.sums_of = np.rint((self.label - p) * UNIT), np.rint(p * (1 - p) * UNIT)
            self.node[:] = 0
            self.drawn = _unit(self.key, self.fit.salt, round_ + 1) < share if share < 1 else np.ones(len(self.key), bool)
        slot = np.full(2 ** (level + 1), -1)
        slot[np.array(nodes, dtype=np.int64)] = np.arange(len(nodes))
        common = [np.zeros((3, len(nodes) * math.prod(sizes))) for _, sizes, _ in self.groups]
        for some in self.passes:
            own = slot.take(self.node[some])
            at = np.flatnonzero((own >= 0) & self.drawn[some])
            own, (g, h) = own.take(at), (v[some].take(at) for v in self.sums_of)
            for (_, sizes, code), sums in zip(self.groups, common):
                cells = own * math.prod(sizes)
                cells += code[some].take(at)
                for total, weights in zip(sums, (None, g, h)):
                    total += np.bincount(cells, weights, minlength=len(total))
        out = np.zeros((len(nodes), 3, self.bins.shape[1], BINS), np.int64)
        for (features, sizes, _), sums in zip(self.groups, common):
            for f, size, found in zip(features, sizes, _apart(sums.reshape(3, len(nodes), -1), sizes)):
                out[:, :, f, :size] = found.swapaxes(0, 1)
        return out

    def advance(self, tree: Tree) -> None:
        """Margins after a tree whose last level the rows have still to go down."""
        self.step(tree)
        self.margin += tree.value.take(self.node)

    def grow(self, known: Sequence[Tree]) -> list[Tree]:
        """Trees of all rounds; ``known`` are the first of them."""
        trees = list(known)
        for tree in trees:
            self.margin += tree.value.take(descend(tree, self.bins, self.fit.settings.depth, np.arange(len(self.key))))
        for r in range(len(trees), self.fit.settings.rounds):
            tree = grow_round([self.fit], [0], self.bins.shape[1], r, partial(self.histograms, round_=r))[0]
            self.advance(tree)
            trees.append(tree)
        return trees


def _side_by_side(blocks: RDD, width: int, fits: Sequence[Fit], start: np.ndarray, known: dict[int, list[Tree]]) -> dict[int, list[Tree]]:
    """Every fit in a task that gets the fit's rows; the longest begin first."""
    order = sorted(range(len(fits)), key=lambda t: (-fits[t].settings.rounds * fits[t].settings.depth, t))

    def deal(row):
        block = _block(row, width, np.zeros(0))
        for place, t in enumerate(order):
            at = np.flatnonzero((block.groups >> fits[t].group) & 1)
            if len(at):
                yield place, (block.key[at].tobytes(), block.label[at].astype(np.int8).tobytes(), block.bins[at].tobytes())

    def trees(place, held):
        if place < len(order):
            t, rows = order[place], [[b""] * 3, *(parts for _, parts in held)]
            key, label, bins = (b"".join(p) for p in zip(*rows))
            own = Own(fits[t], float(start[t]), np.frombuffer(key, np.uint64), np.frombuffer(label, np.int8),
                      np.frombuffer(bins, np.uint8).reshape(-1, width))
            yield t, own.grow(known[t])

    dealt = blocks.flatMap(deal).partitionBy(len(order), lambda place: place)
    return dict(dealt.mapPartitionsWithIndex(trees).collect())


def starts(blocks: RDD, fits: Sequence[Fit]) -> tuple[np.ndarray, np.ndarray]:
    """Log-odds and number of each fit's own rows."""
    def count(row):
        groups, label = np.frombuffer(row["groups"], np.int64), np.frombuffer(row["label"], np.int8)
        own = [(groups >> f.group) & 1 == 1 for f in fits]
        return np.array([[o.sum(), label[o].sum()] for o in own], dtype=np.int64)

    n, ones = blocks.map(count).treeReduce(np.add).T
    share = (ones + 0.5) / (n + 1.0)
    odds = np.where((ones > 0) & (ones < n), np.log(np.maximum(ones, 1) / np.maximum(n - ones, 1)), np.log(share / (1 - share)))
    return odds, n


def grow(blocks: DataFrame, width: int, fits: Sequence[Fit],
         saved: Sequence[dict[int, list[Tree]]] = (), save: Callable[[dict[int, list[Tree]]], None] = lambda part: None,
         ) -> tuple[dict[int, list[Tree]], np.ndarray]:
    """All ensembles together, from the blocks of ``packed``; and their start margins.

    ``saved`` holds the parts of an earlier run, CHUNK rounds each; ``save`` gets every new part, but for fits side by side.
    """
    shared_folder(blocks.sparkSession)  # names the folder of checkpoint()
    raw = _dealt(blocks)
    start, rows = starts(raw, fits)
    trees = {t: [] for t in range(len(fits))}
    for part in saved:
        for t, some in part.items():
            trees[t].extend(some)
    if len(fits) > 1 and rows.max() <= OWN_ROWS:
        return _side_by_side(raw, width, fits, start, trees), start
    state = raw.map(partial(_block, width=width, start=start)).persist(StorageLevel.MEMORY_AND_DISK)
    held = [state]
    for r in range(max(map(len, trees.values()), default=0)):
        state = state.map(partial(_advance, trees={t: trees[t][r] for t in trees if r < len(trees[t])}, fits=fits))
    first = len(saved) * CHUNK
    if first:
        state = state.persist(StorageLevel.MEMORY_AND_DISK)
        held.append(state)
    part: dict[int, list[Tree]] = {}
    pending: list[dict[int, Tree]] = []
    last = max(f.settings.rounds for f in fits)
    for r in range(first, last):
        active = [t for t, f in enumerate(fits) if r < f.settings.rounds]

        def aggregate(wanted, level, state=state, r=r, pending=tuple(pending)):
            sums = state.map(partial(_caught_up, pending=pending, fits=fits)).map(
                partial(_histograms, fits=fits, wanted=wanted, level=level, round_=r))
            return sums.reduce(np.add) if sums.getNumPartitions() <= FEW_TASKS else sums.treeReduce(np.add)

        grown = grow_round(fits, active, width, r, aggregate)
        for old in held[:-1]:
            old.unpersist()
        held = held[-1:]
        for t, tree in grown.items():
            trees[t].append(tree)
            part.setdefault(t, []).append(tree)
        pending.append(grown)
        if r + 1 < last and (len(pending) == PENDING or (r + 1) % LINEAGE == 0):
            state = state.map(partial(_caught_up, pending=tuple(pending), fits=fits)).persist(StorageLevel.MEMORY_AND_DISK)
            held.append(state)
            pending = []
            if (r + 1) % LINEAGE == 0:
                state.checkpoint()
        if (r + 1) % CHUNK == 0 or r + 1 == last:
            save(part)
            part = {}
    for old in held:
        old.unpersist()
    return trees, start


def margins(frame: DataFrame, models: Sequence[Ensemble], keep: Sequence[str | Column]) -> DataFrame:
    """``keep`` columns and one array column ``margins``, in the order of the models; all have the same features."""
    names = models[0].names
    kept = frame.select(*keep)
    rows = frame.select(*keep, F.array(*[F.col(f"`{n}`").cast("double") for n in names]).alias("_x"))
    shared = frame.sparkSession.sparkContext.broadcast(list(models))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)

    def score(batches):
        for batch in batches:
            x = np.stack(batch["_x"].to_numpy()) if len(batch) else np.zeros((0, len(names)))
            found = np.stack([m.margins(x) for m in shared.value], axis=1)
            yield pd.concat([batch.drop(columns="_x"), pd.Series(list(found), name="margins", index=batch.index)], axis=1)

    return rows.mapInPandas(score, f"{schema}, margins array<double>")
