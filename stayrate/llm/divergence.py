"""How far the sources of a language use its words differently, over a quadtree of the group-term matrix.

Per language, the rows of the matrix are its groups (sources) and the columns its kept terms. The matrix is cut into
blocks of ``BAND`` groups by about ``STRIPE`` terms. A block becomes a K-squared tree with K = 2: a node is a square
quadrant, quadrants without any count have no node, the leaves are the counts. Two bands of one stripe are traversed
jointly, quadrant pair by quadrant pair; where both quadrants are empty, every pair of their groups differs by the
same amount at each of the quadrant's terms, so the whole is priced by one multiplication; only where one of the two
holds counts does the traversal go down.

All arithmetic is on whole numbers: smoothed rates p = 1 + floor(10**9 (count + 2) / (N + 2 V)), differences
floor((p - q)**2 / (p + q)). The rows of one hot language or source are spread over the stripes; a block holds two bands
of one stripe, whatever the size of the corpus. The pairs of one language's groups are the result, so their number is
bounded by it.

Null text, language and source count as the empty string; every row of documents counts as a document, repeated or not;
a language without kept terms has differences of 0; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stayrate.llm.common import map_rows
from stayrate.session import cut

#: Letters A-Z, a-z and everything beyond ASCII.
TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
UNIT = 1_000_000_000
BAND, STRIPE = 32, 1_024
#: Distinct (group, term) pairs counted in a task before they are sent on.
HELD = 500_000


def _plain(docs: DataFrame) -> DataFrame:
    return docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])


def counted(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): partial sums of occurrences and documents, several rows per key."""

    def count(langs, sources, texts):
        held, n = defaultdict(lambda: (Counter(), Counter())), 0
        for lang, source, text in zip(langs, sources, texts):
            words = Counter(TERM.findall(text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")))
            times, seen = held[lang, source]
            n -= len(times)
            times.update(words)
            seen.update(words.keys())
            n += len(times)
            if n >= HELD:
                yield from _sent(held)
                held, n = defaultdict(lambda: (Counter(), Counter())), 0
        yield from _sent(held)

    return map_rows(_plain(docs), "lang string, source string, term string, n long, docs long", count, flush=20_000)


def _sent(held):
    for (lang, source), (times, seen) in held.items():
        for term, n in times.items():
            yield lang, source, term, n, seen[term]


def kept_terms(docs: DataFrame, least_docs: int = 10) -> DataFrame:
    """(lang, source, term, n, lang_n): counts of the terms in at least ``least_docs`` documents of their language.

    One shuffle, on (lang, term), serves the sums per group and per language.
    """
    dealt = counted(docs).repartition("lang", "term")
    sums = dealt.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    of_term = W.partitionBy("lang", "term")
    whole = sums.withColumns({"lang_n": F.sum("n").over(of_term), "lang_docs": F.sum("docs").over(of_term)})
    return whole.where(F.col("lang_docs") >= least_docs).select("lang", "source", "term", "n", "lang_n")


def rate(n: Column, total: Column) -> Column:
    """1 + floor(UNIT (n + 2) / total); 1 where the total is 0."""
    scaled = F.lit(UNIT).cast("decimal(10,0)") * (n + 2).cast("decimal(20,0)")
    share = F.call_function("div", scaled, total.cast("decimal(20,0)"))
    return F.when(total > 0, 1 + share).otherwise(F.lit(1)).cast("long")


def difference(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


class Tree:
    """K-squared tree of a square of side 2**depth: per level, for each node, the numbers of its four children or -1."""

    def __init__(self, rows: np.ndarray, cols: np.ndarray, values: np.ndarray, depth: int):
        keys = np.zeros(len(rows), np.int64)
        for bit in range(depth):
            keys |= ((cols >> bit) & 1) << (2 * bit) | ((rows >> bit) & 1) << (2 * bit + 1)
        order = np.argsort(keys)
        keys, self.values = keys[order], values[order]
        self.children: list[np.ndarray] = []
        for _ in range(depth):
            parents, at = np.unique(keys >> 2, return_inverse=True)
            below = np.full((len(parents), 2, 2), -1, np.int64)
            below[at, (keys >> 1) & 1, keys & 1] = np.arange(len(keys))
            self.children.append(below)
            keys = parents
        self.children.reverse()

    @property
    def root(self) -> int:
        return 0 if len(self.values) else -1

    def below(self, level: int, node: np.ndarray, row: int, col: int) -> np.ndarray:
        if not len(self.values):
            return node
        return np.where(node >= 0, self.children[level][node, row, col], -1)


def joint(a: Tree, b: Tree, depth: int, width: int, base_a: np.ndarray, base_b: np.ndarray, same: bool) -> np.ndarray:
    """Sum of differences over the block's ``width`` terms, for all pairs of a row of a and a row of b.

    ``base_*`` are the rates of count 0 of the real rows. With ``same`` only pairs of a smaller and a larger row count.
    """
    total = np.zeros((len(base_a), len(base_b)), np.int64)
    empty = np.zeros_like(total)
    row_a = row_b = col = np.zeros(1, np.int64)
    node_a, node_b = np.array([a.root]), np.array([b.root])
    for level in range(depth + 1):
        size = 1 << (depth - level)
        void = (node_a < 0) & (node_b < 0)
        if void.any():
            priced = np.zeros((-(-len(base_a) // size), -(-len(base_b) // size)), np.int64)
            np.add.at(priced, (row_a[void], row_b[void]), np.clip(width - col[void] * size, 0, size))
            empty += np.repeat(np.repeat(priced, size, 0), size, 1)[: len(base_a), : len(base_b)]
        node_a, node_b, row_a, row_b, col = (x[~void] for x in (node_a, node_b, row_a, row_b, col))
        if level == depth or not len(col):
            break
        half, parts = size // 2, []
        for i in (0, 1):
            for j in (0, 1):
                for k in (0, 1):
                    r, s, c = 2 * row_a + i, 2 * row_b + j, 2 * col + k
                    real = (r * half < len(base_a)) & (s * half < len(base_b)) & (c * half < width)
                    if same:
                        real &= r <= s
                    parts.append((a.below(level, node_a, i, k)[real], b.below(level, node_b, j, k)[real],
                                  r[real], s[real], c[real]))
        node_a, node_b, row_a, row_b, col = (np.concatenate(x) for x in zip(*parts))
    p = base_a[row_a]
    q = base_b[row_b]
    if len(a.values):
        p = np.where(node_a >= 0, a.values[node_a], p)
    if len(b.values):
        q = np.where(node_b >= 0, b.values[node_b], q)
    np.add.at(total, (row_a, row_b), (p - q) ** 2 // (p + q))
    p, q = base_a[:, None], base_b[None, :]
    return total + empty * ((p - q) ** 2 // (p + q))


def _block(part: pd.DataFrame) -> pd.DataFrame:
    """Sums of one block: rows (group, col, rate), and for every group a row without col that gives its base rate."""
    lang, low, high = part["lang"].iloc[0], int(part["low"].iloc[0]), int(part["high"].iloc[0])
    group, rates, col = (part[c].to_numpy(np.int64) for c in ("group_no", "rate", "col"))
    width, head = int(part["width"].max()), col < 0
    depth = max(1, (max(width, BAND) - 1).bit_length())

    def side(band):
        own = group // BAND == band
        row = group - band * BAND
        base = np.zeros(int((own & head).sum()), np.int64)
        base[row[own & head]] = rates[own & head]
        held = own & ~head
        return Tree(row[held], col[held], rates[held], depth), base

    a, base_a = side(low)
    b, base_b = (a, base_a) if low == high else side(high)
    sums = joint(a, b, depth, width, base_a, base_b, low == high)
    i, j = np.nonzero(np.triu(np.ones_like(sums, bool), 1) if low == high else np.ones_like(sums, bool))
    return pd.DataFrame({"lang": lang, "a": low * BAND + i, "b": high * BAND + j, "value": sums[i, j]})


def pair_sums(cells: DataFrame, groups: DataFrame, sizes: DataFrame) -> DataFrame:
    """(lang, a, b, value) for all pairs of group numbers a < b of a language.

    ``cells``: lang, group_no, stripe, term, rate. ``groups``: lang, group_no, base. ``sizes``: lang, stripes, groups.
    """
    spread = cells.withColumn("col", F.dense_rank().over(W.partitionBy("lang", "stripe").orderBy("term")) - 1)
    spread = cut(spread.select("lang", "stripe", "group_no", "col", "rate"))
    widths = spread.groupBy("lang", "stripe").agg((F.max("col") + 1).alias("width"))
    stripes = sizes.select("lang", F.explode(F.sequence(F.lit(0), F.col("stripes") - 1)).alias("stripe"))
    stripes = stripes.join(widths, ["lang", "stripe"], "left").select(
        "lang", "stripe", F.coalesce("width", F.lit(0)).alias("width"))
    heads = groups.select("lang", "group_no", F.col("base").alias("rate")).join(stripes, "lang").select(
        "lang", "stripe", "group_no", F.lit(-1).alias("col"), "rate", "width")
    rows = spread.withColumn("width", F.lit(0)).unionByName(heads).join(sizes.select("lang", "groups"), "lang")
    band = F.floor(F.col("group_no") / BAND).cast("int")
    last = F.floor((F.col("groups") - 1) / BAND).cast("int")
    met = rows.withColumn("with", F.explode(F.sequence(F.lit(0), last)))
    keyed = met.select("lang", "stripe", F.least(band, F.col("with")).alias("low"),
                       F.greatest(band, F.col("with")).alias("high"), "group_no", "col", "rate", "width")
    sums = keyed.groupBy("lang", "stripe", "low", "high").applyInPandas(_block, "lang string, a long, b long, value long")
    return sums.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def audited(docs: DataFrame, least_docs: int = 10, top: int = 10) -> DataFrame:
    """(lang, source, part, item, value, rank): per group the other groups of its language, and its most raised terms."""
    kept = cut(kept_terms(docs, least_docs))
    langs = kept.groupBy("lang", "term").agg(F.first("lang_n").alias("n")).groupBy("lang").agg(
        F.count("*").alias("v"), F.sum("n").alias("lang_total"))
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    found = _plain(docs).select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(
        langs, "lang", "left")
    numbered = found.select(
        "lang", "source", zero("total"), zero("v"), zero("lang_total"),
        (F.row_number().over(W.partitionBy("lang").orderBy("source")) - 1).cast("long").alias("group_no"))
    groups = cut(numbered.select(
        "*", rate(F.lit(0), F.col("total") + 2 * F.col("v")).alias("base"),
        F.greatest(F.lit(1), F.ceil(F.col("v") / STRIPE)).cast("int").alias("stripes")))
    sizes = groups.groupBy("lang").agg(F.max("stripes").alias("stripes"), F.count("*").alias("groups"))
    cells = kept.join(groups, ["lang", "source"]).select(
        "lang", "source", "group_no", "term", F.pmod(F.xxhash64("term"), F.col("stripes")).cast("int").alias("stripe"),
        rate(F.col("n"), F.col("total") + 2 * F.col("v")).alias("rate"),
        rate(F.col("lang_n"), F.col("lang_total") + 2 * F.col("v")).alias("lang_rate"))
    sums = cut(pair_sums(cells, groups, sizes))
    names = groups.select("lang", "group_no", "source")
    both = sums.union(sums.select("lang", "b", "a", "value"))
    pairs = both.join(names.withColumnRenamed("group_no", "a"), ["lang", "a"]).join(
        names.select("lang", F.col("group_no").alias("b"), F.col("source").alias("item")), ["lang", "b"]).select(
        "lang", "source", F.lit("pair").alias("part"), "item", "value")
    terms = cells.where(F.col("rate") > F.col("lang_rate")).select(
        "lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"),
        difference(F.col("rate"), F.col("lang_rate")).alias("value"))
    ranked = F.row_number().over(W.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    return pairs.withColumn("rank", ranked).unionByName(terms.withColumn("rank", ranked).where(F.col("rank") <= top))
