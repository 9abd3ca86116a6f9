"""The two-level building blocks against brute force, with keys that own a large share of the rows."""

import random
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stayrate.functions import ranking
from stayrate.functions.columns import magnitude_bucket
from stayrate.functions.ranking import add_hash_rank, add_neighbour, add_rank, exact_quantile
from stayrate.operators.exploration import rank_sums, two_sided_normal_p


@pytest.mark.parametrize("following", [True, False])
@pytest.mark.parametrize("heavy_rows", [50, 10_000])
def test_neighbour_equals_window(spark, following, heavy_rows):
    rng = random.Random(1)
    rows = [("hot" if rng.random() < 0.4 else f"k{rng.randrange(30)}", date(2024, 1, 1) + timedelta(days=rng.randrange(60)), i, i * 1.5)
            for i in range(600)]
    df = spark.createDataFrame(rows, "key string, day date, id long, v double")
    found = add_neighbour(df, "key", "day", "id", {"nv": "v", "nd": "day"}, following, heavy_rows)
    step = F.lead if following else F.lag
    w = W.partitionBy("key").orderBy("day", "id")
    plain = df.select("*", step("v").over(w).alias("nv"), step("day").over(w).alias("nd"))
    assert found.count() == 600
    assert sorted(found.select(plain.columns).collect(), key=lambda r: r.id) == sorted(plain.collect(), key=lambda r: r.id)


def test_neighbour_deals_rows_into_bounded_tasks(spark, monkeypatch):
    monkeypatch.setattr(ranking, "PART_ROWS", 100)
    df = spark.range(4000).selectExpr("id", "id % 500 AS key", "date_add(DATE'2024-01-01', cast(id % 7 AS int)) AS day")
    found = add_neighbour(df, "key", "day", "id", {"nid": "id"}).withColumn("part", F.spark_partition_id())
    sizes = [r["count"] for r in found.groupBy("part").count().collect()]
    assert sum(sizes) == 4000 and max(sizes) <= 400
    assert ranking.spread(df, 700, "key") is df


def test_rank_equals_row_number(spark):
    rng = random.Random(2)
    df = spark.createDataFrame([(i % 2, i, round(rng.gauss(0, 50), 3)) for i in range(500)], "g int, id long, v double")
    ranked = add_rank(df, ["g"], magnitude_bucket(F.col("v"), 4), ["v", "id"], "r")
    plain = df.withColumn("r", F.row_number().over(W.partitionBy("g").orderBy("v", "id")).cast("bigint"))
    assert sorted(ranked.select(plain.columns).collect()) == sorted(plain.collect())


def test_hash_rank_is_a_permutation(spark):
    ranks = add_hash_rank(spark.range(300).withColumn("k", F.col("id").cast("string")), [], "k", 7, "r", buckets=16)
    assert sorted(r.r for r in ranks.collect()) == list(range(1, 301))


def test_buckets_keep_order(spark):
    values = [-1e6, -5.5, -5.4, -1e-6, 0.0, 1e-6, 0.3, 0.31, 2.0, 1e5, 1e9]
    df = spark.createDataFrame([(v,) for v in values], "v double").withColumn("b", magnitude_bucket(F.col("v")))
    buckets = [r.b for r in sorted(df.collect())]
    assert buckets == sorted(buckets)


@pytest.mark.parametrize("q", [0.0, 0.5, 0.9, 0.95, 1.0])
def test_quantile_equals_numpy(spark, q):
    rng = random.Random(3)
    values = [7.25] * 100 + [round(rng.expovariate(0.01), 2) for _ in range(211)]
    found = exact_quantile(spark.createDataFrame([(v,) for v in values], "v double"), "v", q, "x").first().x
    assert found == pytest.approx(np.quantile(values, q), abs=1e-9)


def test_rank_sums_with_ties(spark):
    """Half of all values are equal; average ranks and the tie term by hand."""
    rng = random.Random(4)
    rows = [(int(rng.random() < 0.3), 1.0 if rng.random() < 0.5 else round(rng.random() * 3, 1)) for _ in range(200)]
    got = rank_sums(spark.createDataFrame([("f", *r) for r in rows], "feature string, churn_label int, value double"),
                    ["feature"], "value", F.col("churn_label") == 0).first()
    ordered = sorted(v for _, v in rows)
    rank = {v: (ordered.index(v) + 1 + len(ordered) - ordered[::-1].index(v)) / 2 for v in set(ordered)}
    assert got.rank_sum == sum(rank[v] for label, v in rows if label == 0)
    assert got.tie_term == sum(ordered.count(v) ** 3 - ordered.count(v) for v in set(ordered))
    u1 = got.rank_sum - got.n1 * (got.n1 + 1) / 2
    pairs = sum((a > b) + 0.5 * (a == b) for la, a in rows if la == 0 for lb, b in rows if lb == 1)
    assert u1 == pairs


def test_normal_tail(spark):
    import math

    zs = [0.0, 0.5, 1.96, 3.29, 6.0]
    rows = spark.createDataFrame([(z,) for z in zs], "z double").select("z", two_sided_normal_p(F.col("z")).alias("p")).collect()
    for row in rows:
        assert row.p == pytest.approx(math.erfc(row.z / math.sqrt(2)), rel=1e-7)
