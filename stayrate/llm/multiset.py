"""Document fingerprints by a homomorphic multiset hash.

Every paragraph is hashed to a wide vector of small signed numbers; the fingerprint of a document is the sum of the
vectors of its paragraphs, each lane modulo 2**24. Equal multisets of paragraphs have equal fingerprints in any order,
and a paragraph is added to or taken from a fingerprint by adding or subtracting its vector. A paragraph here is the
stretch between line breaks or sentence ends, trimmed of ASCII white space.

A lane is one half-byte of a hash, as an odd number from -15 to 15. Lanes are zero-mean and independent, so while they
do not wrap (no paragraph 500,000 times) the cosine of two fingerprints estimates that of the two multisets, with a
standard error of at most one over the root of the number of lanes (0.09); it is clipped to 0..1, equal fingerprints
have likeness 1.

Null and empty texts have the zero fingerprint: likeness 1 to one another, 0 to all else. Ids are whole numbers, other
types are an error. The next document is the one with the next smaller id, after the smallest comes the largest; a null
id counts as the smallest, rows that repeat an id follow one another by text. A single row is its own next document.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from stayrate.session import cut

LANES = 128
MODULUS = 1 << 24
PER_HASH = 16
#: Two half-bytes of a hash, 32 bits apart, are summed in one long.
HALVES, LOW = (15 << 32) + 15, (1 << 32) - 1
BLANK = " \t\n\x0b\x0c\r"


def paragraphs(text: Column) -> Column:
    parts = F.split(F.coalesce(text, F.lit("")), r"[\r\n]+|(?<=[.!?])\s+")
    return F.filter(F.transform(parts, lambda p: F.trim(p, F.lit(BLANK))), lambda p: p != "")


def with_sums(docs: DataFrame, text_col: str, into: str) -> DataFrame:
    """``docs`` plus a struct: the number of paragraphs, and the sums of their half-bytes, two lanes in a long."""
    seeds = range(LANES // PER_HASH)
    hashed = docs.withColumn("_parts", paragraphs(F.col(text_col))).withColumns({
        f"_h{seed}": _hashes(F.col("_parts"), seed) for seed in seeds})
    sums = [_sum(F.col(f"_h{i}"), 4 * at) for i in seeds for at in range(PER_HASH // 2)]
    return hashed.withColumn(into, F.struct(F.size("_parts").alias("n"), F.array(*sums).alias("sums"))).drop(
        "_parts", *[f"_h{i}" for i in seeds])


def _hashes(parts: Column, seed: int) -> Column:
    return F.transform(parts, lambda part: F.xxhash64(F.lit(seed), part))


def _sum(hashes: Column, shift: int) -> Column:
    """No text has the 2**27 paragraphs that would carry from one lane to the other."""
    taken = lambda h: (F.shiftrightunsigned(h, shift) if shift else h).bitwiseAND(F.lit(HALVES))
    return F.aggregate(hashes, F.lit(0).cast("long"), lambda a, h: a + taken(h))


def lanes(sums: Column) -> Column:
    """The fingerprint: LANES numbers from 0 to 2**24 - 1."""
    lane = lambda half: F.pmod(2 * half - 15 * sums["n"], F.lit(MODULUS).cast("long"))
    return F.flatten(F.transform(sums["sums"], lambda s: F.array(
        lane(s.bitwiseAND(F.lit(LOW))), lane(F.shiftrightunsigned(s, 32)))))


def with_vector(docs: DataFrame, text_col: str, into: str) -> DataFrame:
    """``docs`` plus the fingerprint of a whole text."""
    return with_sums(docs, text_col, into).withColumn(into, lanes(F.col(into)))


def added(a: Column, b: Column) -> Column:
    """Fingerprint of two documents taken together."""
    return F.zip_with(a, b, lambda x, y: F.pmod(x + y, F.lit(MODULUS).cast("long")))


def removed(a: Column, b: Column) -> Column:
    """Fingerprint ``a`` without the paragraphs of ``b``."""
    return F.zip_with(a, b, lambda x, y: F.pmod(x - y, F.lit(MODULUS).cast("long")))


def text_of(fingerprint: Column) -> Column:
    """Six hexadecimal digits per lane."""
    return F.lower(F.array_join(F.transform(fingerprint, lambda x: F.lpad(F.hex(x), 6, "0")), ""))


def signed(fingerprint: Column) -> Column:
    return F.transform(fingerprint, lambda x: F.when(x >= MODULUS // 2, x - MODULUS).otherwise(x))


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0).cast("long"), lambda s, v: s + v).cast("double")


def _cosine(a: Column, b: Column, norm_a: Column, norm_b: Column) -> Column:
    size = F.sqrt(norm_a) * F.sqrt(norm_b)
    return F.when(a == b, 1.0).when(size == 0, 0.0).otherwise(
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), _dot(a, b) / size)))


def likeness(a: Column, b: Column) -> Column:
    """Clipped cosine of two fingerprints."""
    x, y = signed(a), signed(b)
    return _cosine(x, y, _dot(x, x), _dot(y, y))


def with_next(docs: DataFrame, id_col: str, fields: list[str], buckets: int | None = None,
              derive: Callable[[DataFrame], DataFrame] = lambda rows: rows, derived: tuple[str, ...] = ()) -> DataFrame:
    """``docs`` plus ``next``: a struct of ``fields`` of the row with the next smaller id (after the last: the first).

    ``derive`` adds the columns ``derived`` to every row once its place is known; ``next`` holds them too.

    Rows are dealt into ranges of ids of about equal size and moved once; the first row of every range is given to the
    range before it as well. The number of ranges follows the shuffle partitions of the session. The last field
    decides between rows of one id.
    """
    spark = docs.sparkSession
    if not isinstance(docs.schema[id_col].dataType, T.IntegralType):
        raise TypeError(f"{id_col} must hold whole numbers")
    buckets = buckets or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    key, tie = F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63))), fields[-1]
    quantiles = [F.lit(i / buckets) for i in range(1, buckets)]
    at = docs.agg(F.percentile_approx(key, F.array(*quantiles), 20 * buckets)).first()[0] if quantiles else []
    edges = sorted(set(at or []))
    bucket = F.lit(0)
    if edges:
        bucket = F.size(F.filter(F.lit(edges).cast("array<long>"), lambda e: e >= key))
    placed = docs.withColumn("_key", key).withColumn("_bucket", bucket)
    top = placed.groupBy("_bucket").agg(F.max("_key").alias("top")).orderBy("_bucket").collect()
    if not top:
        return derive(placed).withColumn("next", F.struct(*fields, *derived)).drop("_key", "_bucket")
    tops = {r["_bucket"]: r["top"] for r in top}
    order = sorted(tops)
    before = spark.createDataFrame(
        [(b, tops[b], order[i - 1]) for i, b in enumerate(order)], "_bucket int, _key long, _before int")
    heads = placed.join(F.broadcast(before), ["_bucket", "_key"]).groupBy("_before").agg(
        F.min(F.struct(tie, *fields[:-1])).alias("head"))
    heads = cut(heads.select(F.col("_before").alias("_bucket"), "head"))
    extra = heads.select("_bucket", *[F.col(f"head.{f}").alias(f) for f in fields], F.lit(True).alias("_extra"))
    every = derive(placed.withColumn("_extra", F.lit(False)).unionByName(extra, allowMissingColumns=True))
    window = Window.partitionBy("_bucket").orderBy("_extra", F.desc("_key"), tie)
    return every.withColumn("next", F.lead(F.struct(*fields, *derived)).over(window)).where(~F.col("_extra")).drop(
        "_key", "_bucket", "_extra")


def edited(text: Column, following: Column) -> Column:
    """The text with its last third replaced by the first as many code points (or all) of the following one."""
    third = F.floor(F.length(text) / 3).cast("int")
    return F.concat(F.left(text, F.length(text) - third), F.left(following, third))


def compared(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, n_chars, edited_sha256, fingerprint, edited_fingerprint (vectors), near_edited, near_next."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("body"))
    rows = with_next(rows, "id", ["id", "body"], derive=lambda r: with_sums(r, "body", "sums"), derived=("sums",))
    done = rows.select("id", F.length("body").cast("long").alias("n_chars"), "sums", F.col("next.sums").alias("next_sums"),
                       edited(F.col("body"), F.col("next.body")).alias("after"))
    done = with_sums(done, "after", "after_sums")
    sides = {"own": "sums", "next": "next_sums", "after": "after_sums"}
    done = done.withColumns({f"{side}_fp": lanes(F.col(name)) for side, name in sides.items()})
    done = done.withColumns({f"{side}_x": signed(F.col(f"{side}_fp")) for side in sides})
    done = done.withColumns({f"{side}_n": _dot(F.col(f"{side}_x"), F.col(f"{side}_x")) for side in sides})
    near = {side: _cosine(F.col("own_x"), F.col(f"{side}_x"), F.col("own_n"), F.col(f"{side}_n")) for side in ("after", "next")}
    return done.select(
        F.col("id").alias(id_col), "n_chars", F.sha2(F.col("after").cast("binary"), 256).alias("edited_sha256"),
        F.col("own_fp").alias("fingerprint"), F.col("after_fp").alias("edited_fingerprint"),
        near["after"].alias("near_edited"), near["next"].alias("near_next"))
