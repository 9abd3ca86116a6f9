"""Mixing sources to target weights by entropy balancing.

Every document gets a rate: the expected number of its copies in the mix. Of all rates between 0 and ``most`` that
give each source its target number of words, those closest to 1 in relative entropy are exponentially tilted,
``min(most, exp(tilt * size / mean size))`` with one tilt per source. The tilts solve the convex dual; Newton steps,
kept inside a shrinking bracket, run for all sources at once over a table of (source, size, documents), so a pass never
touches the documents themselves. Sums are taken over decimals, so that a rerun ends with the same digits.

Rounding walks the sizes of a source from large to small and carries what a size took too much or too little over to
the next one, so a source ends within half its smallest documents of its target, as far as whole copies allow. One
task holds one row per distinct size of a source, never its documents.

Rows are dealt their copies in groups of one (source, size, id, text hash): the first groups by a hash of these get the
copies that are left over, in part where a group has more rows than copies are left. Groups come from one aggregate, so
an id or a text that holds a third of all rows is one number; its result rows are made in pieces of ``PIECE``.

A null text has size 0. Null sources are a source of their own, the last one. Documents of size 0 get one copy and
take no words. All sizes 0: every target is 0. Repeated ids, null ids and repeated rows are dealt row by row like any
others: of equal rows some may get a copy more. An unsolved balance is an error.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stayrate.llm.common import packed, unpacked
from stayrate.session import cut

WORD = r"[^\x20\x09-\x0D]+"
#: Parts in which the groups of one (source, size) are ranked, and rows that are made at once of a group.
PARTS, PIECE = 1_024, 10_000
GROUP = ["source_key", "size", "id", "text_hash"]
EXACT = "decimal(38,9)"


def words(text: Column) -> Column:
    """Number of words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _keyed(source: Column) -> Column:
    """A source name that is never null."""
    return F.when(source.isNull(), "").otherwise(F.concat(F.lit("="), source.cast("string")))


def targets(sizes: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), most: float = 3.0) -> DataFrame:
    """(source_key, source_size, target) from rows (source_key, source, size): one row per source.

    Sources by code point, null last, get ``weights`` in turn. A target stops at ``most`` times the size of its source;
    what is left over goes to the others by weight until none is above.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    sources = sizes.groupBy("source_key").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"))
    place = (F.row_number().over(order) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), place.cast("int") + 1)
    sources = cut(sources.select("source_key", "source_size", weight.alias("weight")))
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    full, level = F.lit(False), None
    while True:
        rest = sources.agg(
            F.sum(F.when(full, F.col("source_size"))).alias("held"), F.sum(F.when(~full, F.col("weight"))).alias("free"),
        ).first()
        now = (total - most * (rest["held"] or 0)) / rest["free"] if rest["free"] else 0.0
        if now == level:
            break
        level = now
        full = full | (F.col("weight") * F.lit(level) > most * F.col("source_size"))
    target = F.when(full, F.lit(float(most)) * F.col("source_size")).otherwise(F.col("weight") * F.lit(level))
    return cut(sources.select("source_key", "source_size", target.cast("double").alias("target")))


def tilts(hist: DataFrame, aims: DataFrame, most: float = 3.0, close: float = 1e-7, rounds: int = 60) -> DataFrame:
    """(source_key, source_size, target, mean, tilt) that meet the targets; null tilt: every rate is ``most``.

    ``hist`` has (source_key, size, n). A round is one pass over it; it ends when every source is within ``close`` of
    its target.
    """
    means = hist.where("size > 0").groupBy("source_key").agg((F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("mean"))
    at_most = F.col("target") >= most * F.col("source_size")
    state = cut(aims.join(means, "source_key", "left").select(
        "*", F.when(at_most, F.lit(None)).otherwise(F.lit(0.0)).cast("double").alias("tilt"),
        F.lit(-1e3).alias("low"), F.lit(1e3).alias("high")))
    positive = hist.where("size > 0")
    z = F.col("size") / F.col("mean")
    rate = F.least(F.lit(float(most)), F.exp(F.least(F.col("tilt") * z, F.lit(50.0))))
    for _ in range(rounds):
        sums = positive.join(state.where("tilt is not null"), "source_key").select(
            "source_key", (F.col("n") * z * rate).cast(EXACT).alias("value"),
            F.when(rate < most, F.col("n") * z * z * rate).otherwise(0.0).cast(EXACT).alias("slope"),
        ).groupBy("source_key").agg(F.sum("value").cast("double").alias("value"), F.sum("slope").cast("double").alias("slope"))
        wanted = F.col("target") / F.col("mean")
        over = F.col("value") - wanted
        low, high = (F.when(over < 0, F.col("tilt")).otherwise(F.col("low")),
                     F.when(over > 0, F.col("tilt")).otherwise(F.col("high")))
        newton = F.col("tilt") - over / F.col("slope")
        newton = F.when((F.col("slope") > 0) & (newton > low) & (newton < high), newton)
        halved = F.when(low == -1e3, high * 2 - 1).when(high == 1e3, low * 2 + 1).otherwise((low + high) / 2)
        open_ = F.abs(over) > close * wanted
        state = cut(state.join(sums, "source_key", "left").select(
            "source_key", "source_size", "target", "mean",
            F.when(open_, F.coalesce(newton, halved)).otherwise(F.col("tilt")).alias("tilt"),
            F.when(open_, low).otherwise(F.col("low")).alias("low"),
            F.when(open_, high).otherwise(F.col("high")).alias("high"),
            F.coalesce(open_, F.lit(False)).alias("open")))
        if not state.where("open").limit(1).count():
            return state.select("source_key", "source_size", "target", "mean", "tilt")
        state = state.drop("open")
    raise RuntimeError(f"no tilt within {close} of every target after {rounds} rounds")


def _rounded(most: int):
    """Whole copies for the sizes of one source: each document gets ``each``, ``more`` of them get one on top."""

    def walk(frame: pd.DataFrame) -> pd.DataFrame:
        frame, carry, each, more = frame.sort_values("size", ascending=False), 0.0, [], []
        for size, n, rate in zip(frame["size"], frame["n"], frame["rate"]):
            size, n = int(size), int(n)
            if not size:
                copies = n
            else:
                wish = n * rate * size + carry
                copies = min(int(most * n), max(0, int(wish / size + 0.5)))
                carry = wish - copies * size
            each.append(copies // n)
            more.append(copies % n)
        return frame[["source_key", "size"]].assign(each=each, more=more)

    return walk


def _grouped(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """``docs`` with the columns of GROUP and ``source`` beside id, text, source and a packed row."""
    return packed(docs, id_col, text_col, source_col).select(
        F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(source_col).cast("string").alias("source"),
        F.col(source_col).alias("given_source"), "row", _keyed(F.col(source_col)).alias("source_key"),
        words(F.col(text_col)).alias("size"), F.xxhash64(text_col).alias("text_hash"))


def shares(docs: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), most: int = 3, id_col: str = "doc_id",
           text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per GROUP: rows, each (copies of every row), more (rows with one on top), source_size, target, rate."""
    groups = _grouped(docs, id_col, text_col, source_col).groupBy(*GROUP).agg(
        F.count("*").alias("rows"), F.first("source").alias("source"))
    part = F.pmod(F.xxhash64("id", "text_hash"), F.lit(PARTS)).cast("int")
    groups = cut(groups.withColumn("part", part))
    cells = cut(groups.groupBy("source_key", "size", "part").agg(
        F.sum("rows").alias("n"), F.first("source").alias("source")))
    hist = cut(cells.groupBy("source_key", "size").agg(F.sum("n").alias("n")))
    aims = targets(cells.select("source_key", "source", (F.col("size") * F.col("n")).alias("size")), weights, most)
    solved = tilts(hist, aims, most)
    rate = F.when(F.col("tilt").isNull(), F.lit(float(most))).when(F.col("size") == 0, F.lit(1.0)).otherwise(
        F.least(F.lit(float(most)), F.exp(F.least(F.col("tilt") * F.col("size") / F.col("mean"), F.lit(50.0)))))
    rated = hist.join(solved, "source_key").withColumn("rate", rate)
    dealt = rated.select("source_key", "size", "n", "rate").groupBy("source_key").applyInPandas(
        _rounded(most), "source_key string, size long, each long, more long")
    upto = Window.partitionBy("source_key", "size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    left = F.greatest(F.lit(0), F.col("more") - F.coalesce(F.sum("n").over(upto), F.lit(0)))
    parts = cells.join(dealt, ["source_key", "size"]).select("source_key", "size", "part", "each", left.alias("left"))
    parts = parts.join(rated.select("source_key", "size", "source_size", "target", "rate"), ["source_key", "size"])
    order = Window.partitionBy("source_key", "size", "part").orderBy(
        F.xxhash64("id", "text_hash", F.lit(1)), "id", "text_hash").rowsBetween(Window.unboundedPreceding, -1)
    ranked = groups.drop("source").withColumn("before", F.coalesce(F.sum("rows").over(order), F.lit(0)))
    more = F.greatest(F.lit(0), F.least("rows", F.col("left") - F.col("before")))
    return ranked.join(parts, ["source_key", "size", "part"]).select(
        *GROUP, "rows", "each", more.cast("long").alias("more"), "source_size", "target", "rate")


def mixed(docs: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), most: int = 3, id_col: str = "doc_id",
          text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per row of ``docs``: ``id_col``, source_key, size, source_size, target, rate, copies, taken."""
    dealt = shares(docs, weights, most, id_col, text_col, source_col)
    pieces = dealt.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("rows") - 1) / PIECE))))
    first = F.col("piece") * PIECE
    each_row = F.sequence(first, F.least("rows", first + PIECE) - 1)
    rows = pieces.repartition(*[F.col(c) for c in ("id", "text_hash", "piece")]).withColumn("place", F.explode(each_row))
    copies = F.col("each") + (F.col("place") < F.col("more")).cast("long")
    return rows.select(
        F.col("id").alias(id_col), "source_key", "size", "source_size", "target", "rate", copies.alias("copies")
    ).withColumn("taken", F.col("size") * F.col("copies"))


def repeated(docs: DataFrame, dealt: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             source_col: str = "source") -> DataFrame:
    """``docs`` with every row as often as ``dealt`` (from ``shares``) says; the same columns.

    Equal rows are one row with a number; rows that share a group but differ elsewhere take the extra copies in the order
    of a hash of the row.
    """
    rows = _grouped(docs, id_col, text_col, source_col).withColumn("row_hash", F.xxhash64("row"))
    key = [*GROUP, "row_hash"]
    kinds = rows.groupBy(*key).agg(F.count("*").alias("same"))
    within = Window.partitionBy(*GROUP).orderBy("row_hash").rowsBetween(Window.unboundedPreceding, -1)
    placed = kinds.withColumn("before", F.coalesce(F.sum("same").over(within), F.lit(0)))
    wanted = dealt.select(*[F.col(c).alias(f"_{c}") for c in GROUP], "each", "more")
    alike = F.lit(True)
    for c in GROUP:
        alike = alike & F.col(c).eqNullSafe(F.col(f"_{c}"))
    extra = F.greatest(F.lit(0), F.least("same", F.col("more") - F.col("before")))
    copies = placed.join(wanted, alike).select(
        *[F.col(c).alias(f"_{c}") for c in key], (F.col("same") * F.col("each") + extra).alias("_copies"))
    alike = alike & (F.col("row_hash") == F.col("_row_hash"))
    one = rows.dropDuplicates(key).join(copies.where("_copies > 0"), alike)
    made = one.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies"))))
    named = made.select(F.col("id").alias(id_col), F.col("text").alias(text_col),
                        F.col("given_source").alias(source_col), "row")
    return unpacked(named, docs.columns, id_col, text_col, source_col)
