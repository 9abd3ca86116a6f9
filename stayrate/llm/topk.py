"""Exact top-k search by distributed histogram selection.

All queries are scored against all rows in blocks; a pass adds up one score histogram per query over all blocks,
finds the bin of the k-th best score and narrows the range to that bin. When the bin is one score wide, or holds few
rows, a last pass keeps scores from that bin on and breaks ties by the smaller id. Scores are never stored: each pass
computes them again from the two block tables. Blocks have bounded size, and a block sends on no bins below its own
k-th best score, as the global one cannot lie lower.

Vectors are compared with vectors of the same length. Null ids, null vectors, empty ones and those with null or
non-finite components take no part. Of rows that repeat an id the one with the smallest vector counts (per length, and
for a query of several lengths the shortest). Scores are exact while they stay below 2**53.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stayrate.session import cut

BINS = 512


def _usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: F.coalesce(F.abs(x) < F.lit(math.inf), F.lit(False)))
    return vector.isNotNull() & (F.size(vector) > 0) & F.coalesce(finite, F.lit(False))


def scaled(vectors: DataFrame, scale: float, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, vec, dims): components times ``scale`` as doubles (rounded down where they are used), usable rows only."""
    rows = vectors.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("x"))
    return rows.where(_usable(F.col("x"))).select(
        "id", F.transform("x", lambda x: x * F.lit(float(scale))).alias("vec"), F.size("x").alias("dims"))


def _matrix(frame: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ids and their vectors, rounded down to whole numbers; the smallest vector of an id."""
    vectors = np.floor(np.stack(frame["vec"].to_numpy()).astype(np.float64))
    ids = frame["id"].to_numpy(dtype=np.int64)
    order = np.lexsort((*vectors.T[::-1], ids))
    ids, vectors = ids[order], vectors[order]
    new = np.append(True, ids[1:] != ids[:-1])[: len(ids)]
    return ids[new], vectors[new]


def _scores(rows: pd.DataFrame, queries: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Candidate ids, scores (queries x candidates), and where a candidate is the query itself."""
    ids, vectors = _matrix(rows)
    scores = np.floor(np.stack(queries["vec"].to_numpy()).astype(np.float64)) @ vectors.T
    return ids, scores, ids[None, :] == queries["id"].to_numpy(dtype=np.int64)[:, None]


def _histograms(rows: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
    out = pd.DataFrame({"id": [], "bin": [], "n": []}, dtype="int64")
    if rows.empty or queries.empty:
        return out
    _, scores, own = _scores(rows, queries)
    low, high, width = (queries[c].to_numpy(dtype=np.float64)[:, None] for c in ("low", "high", "width"))
    need = queries["need"].to_numpy(dtype=np.int64)
    bins = np.floor((scores - low) / width)
    inside = (scores >= low) & (scores < high) & ~own
    flat = (np.arange(len(queries))[:, None] * BINS + np.where(inside, bins, 0).astype(np.int64))[inside]
    counts = np.bincount(flat, minlength=len(queries) * BINS).reshape(-1, BINS)
    better = np.cumsum(counts[:, ::-1], axis=1)[:, ::-1] - counts
    query, at = np.nonzero((counts > 0) & (better < need[:, None]))
    return pd.DataFrame({"id": queries["id"].to_numpy()[query], "bin": at, "n": counts[query, at]})


def _winners(rows: pd.DataFrame, queries: pd.DataFrame, k: int) -> pd.DataFrame:
    parts = []
    if not rows.empty and not queries.empty:
        ids, scores, own = _scores(rows, queries)
        low = queries["low"].to_numpy(dtype=np.float64)
        for i, query in enumerate(queries["id"].to_numpy()):
            kept = np.nonzero((scores[i] >= low[i]) & ~own[i])[0]
            kept = kept[np.lexsort((ids[kept], -scores[i][kept]))][:k]
            parts.append(pd.DataFrame({"query_id": query, "vec_id": ids[kept], "score": scores[i][kept].astype("int64")}))
    if not parts:
        return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")
    return pd.concat(parts, ignore_index=True)


def _start(queries: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """State before the first pass: all scores lie within the product of the lengths."""
    norm = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, x: a + (F.abs(x) + 1) * (F.abs(x) + 1)))
    longest = rows.agg(F.max(norm)).first()[0] or 0.0
    bound = F.ceil(norm * F.lit(longest)).cast("double") + 1
    return queries.select(
        "id", "vec", "dims", "part", (-bound).alias("low"), (bound + 1).alias("high"),
        F.ceil((2 * bound + 1) / BINS).cast("double").alias("width"), F.lit(k).cast("long").alias("need"),
        F.lit(False).alias("done"))


def _narrowed(queries: DataFrame, counts: DataFrame, few: int) -> DataFrame:
    """The bin of the k-th best score becomes the range; fewer rows than k: all of them are wanted."""
    down = Window.partitionBy("id").orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    state = queries.select("id", F.col("need").alias("wanted"))
    found = counts.withColumn("upto", F.sum("n").over(down)).join(state, "id").where("upto >= wanted")
    at = found.groupBy("id").agg(F.max(F.struct("bin", "n", "upto")).alias("at")).select("id", "at.*")
    low = F.col("low") + F.col("bin") * F.col("width")
    joined = queries.join(at, "id", "left")
    hit = F.col("bin").isNotNull() & ~F.col("done")
    return joined.select(
        "id", "vec", "dims", "part",
        F.when(hit, low).otherwise(F.col("low")).alias("low"),
        F.when(hit, F.least("high", low + F.col("width"))).otherwise(F.col("high")).alias("high"),
        F.when(hit, F.ceil(F.col("width") / BINS).cast("double")).otherwise(F.col("width")).alias("width"),
        F.when(hit, F.col("need") - (F.col("upto") - F.col("n"))).otherwise(F.col("need")).alias("need"),
        (F.col("done") | F.col("bin").isNull() | (F.col("width") <= 1) | (F.col("n") <= few)).alias("done"))


def top_k(vectors: DataFrame, queries: Column, k: int = 5, scale: float = 256.0, block_rows: int = 8_192,
          id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows for every row where ``queries`` holds, the row itself left out.

    ``block_rows`` bounds the rows of a block; a task holds the scores of one block against 1,024 queries.
    """
    rows = cut(scaled(vectors, scale, id_col, vector_col))
    chosen = rows.join(vectors.where(queries).select(F.col(id_col).alias("id")).distinct(), "id", "left_semi")
    chosen = chosen.groupBy("id", "dims").agg(F.min("vec").alias("vec"))
    chosen = chosen.withColumn("best", F.min("dims").over(Window.partitionBy("id"))).where("dims = best").drop("best")
    n, wanted = rows.count(), max(1, math.ceil(chosen.count() / 1_024))
    blocks = max(1, math.ceil(n / block_rows))
    chosen = chosen.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(wanted)).cast("int"))
    rows = rows.select("id", "vec", "dims", F.pmod(F.xxhash64("id", F.lit(7)), F.lit(blocks)).cast("int").alias("block"),
                       F.explode(F.sequence(F.lit(0), F.lit(wanted - 1))).alias("part"))
    state = cut(_start(chosen, rows.where("part = 0"), k))
    key = ["dims", "block", "part"]

    def over_blocks(queries_now, work, schema):
        spread = queries_now.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        return rows.groupBy(*key).cogroup(spread.groupBy(*key)).applyInPandas(work, schema)

    while state.where("not done").limit(1).count():
        open_ = state.where("not done")
        counts = over_blocks(open_, _histograms, "id long, bin long, n long").groupBy("id", "bin").agg(
            F.sum("n").alias("n"))
        state = cut(_narrowed(state, counts, 4 * k))
    best = over_blocks(state, lambda a, b: _winners(a, b, k), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")
