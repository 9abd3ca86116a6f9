"""Late rows, repeated rows, file-by-file arrival and gaps at the limit."""

import os
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from stayrate.session import scratch_path
from stayrate.streaming import alerts, usage

T0 = datetime(2024, 1, 1)
SCHEMA = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def write_files(spark, *batches):
    """One file per batch, in order of arrival."""
    folder = scratch_path(spark, "events-in")
    os.makedirs(folder)
    for i, rows in enumerate(batches):
        part = scratch_path(spark, "part")
        spark.createDataFrame([(e, ts, u, "click", 1.0, None) for e, ts, u in rows], SCHEMA).coalesce(1).write.parquet(part)
        name = next(f for f in os.listdir(part) if f.endswith(".parquet"))
        target = f"{folder}/events-{i}.parquet"
        with open(f"{part}/{name}", "rb") as source, open(target, "wb") as out:
            out.write(source.read())
        os.utime(target, (1_700_000_000 + i, 1_700_000_000 + i))
    return folder


def test_daily_usage_merges_batches_late_and_repeated_rows(spark):
    folder = write_files(
        spark,
        [(1, T0, 7), (2, T0 + timedelta(hours=1), 7)],
        [(2, T0 + timedelta(hours=1), 7), (3, T0 + timedelta(hours=2), 7), (4, T0 + timedelta(days=5), 7)],
        [(6, T0 + timedelta(days=5, hours=1), 7)],
        [(5, T0 + timedelta(hours=3), 7)],
    )
    found = usage.daily_usage(usage.read_events(spark, folder, files_per_batch=1)).collect()
    # event 2 arrives twice and counts once; event 5 comes five days late and counts
    assert {r.usage_date.day: r.events for r in found} == {1: 4, 6: 2}


@pytest.mark.parametrize("files_per_batch", [None, 1])
def test_events_without_an_id_all_count(spark, files_per_batch):
    folder = write_files(
        spark, [(None, T0, 7), (None, T0 + timedelta(minutes=1), 8), (None, T0, 7), (1, T0, 7)],
        [(None, T0 + timedelta(hours=1), 7), (1, T0, 7)])
    found = usage.daily_usage(usage.read_events(spark, folder, files_per_batch)).collect()
    assert {r.user_id: r.events for r in found} == {7: 4, 8: 1}


def shuffled(spark, sf_dir, files):
    """The events of the smallest tables in many files, out of order."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").toPandas().sample(frac=1, random_state=3)
    import pyarrow as pa
    import pyarrow.parquet as pq

    folder = scratch_path(spark, "events-shuffled")
    os.makedirs(folder)
    schema = pq.read_schema(f"{sf_dir}/events.parquet")
    for i in range(files):
        pq.write_table(pa.Table.from_pandas(rows.iloc[i::files], schema, preserve_index=False), f"{folder}/events-{i:04d}.parquet")
    return folder


@pytest.mark.parametrize("signal", [usage.daily_usage, usage.sliding_logins, usage.sessions])
def test_many_files_in_any_order_give_the_rows_of_one_file(spark, sf_dir, signal):
    one = signal(usage.read_events(spark, sf_dir)).collect()
    many = signal(usage.read_events(spark, shuffled(spark, sf_dir, 300), files_per_batch=80)).collect()
    assert sorted(one) == sorted(many) and one


def test_session_gap_over_thirty_minutes_splits(spark):
    folder = write_files(spark, [
        (1, T0, 1), (2, T0 + timedelta(minutes=30), 1), (3, T0 + timedelta(minutes=60, seconds=1), 1),
        (4, T0 + timedelta(days=9), 2)])
    rows = usage.sessions(usage.read_events(spark, folder)).orderBy("session_start").collect()
    assert [(r.user_id, r.events, float(r.session_minutes), r.is_open) for r in rows] == [
        (1, 2, 30.0, False), (1, 1, 0.0, False), (2, 1, 0.0, True)]


def test_alerts_need_a_rise(spark):
    folder = scratch_path(spark, "scores-in")
    rows = [("A", 1, "Low", "2024-01-01"), ("A", 2, "High", "2024-02-01"), ("A", 3, "Medium", "2024-03-01"),
            ("A", 4, "Critical", "2024-04-01"), ("B", 1, "High", "2024-01-01"), ("B", 2, "High", "2024-02-01")]
    df = spark.createDataFrame(rows, "customer_id string, score_id bigint, risk_tier string, d string")
    df.select("customer_id", "score_id", "risk_tier", F.to_date("d").alias("scored_at")).write.parquet(folder)
    found = alerts.run_alerts(spark, folder).orderBy("scored_at").collect()
    assert [(r.customer_id, r.previous_tier, r.risk_tier) for r in found] == [("A", "Low", "High"), ("A", "Medium", "Critical")]


@pytest.mark.parametrize("newest_first", [True, False])
def test_alerts_in_any_order_of_files(spark, newest_first):
    """Three runs of 50 customers in 20 files each; the middle run takes back a rise of the last one."""
    import pandas as pd

    folder = scratch_path(spark, "score-files")
    os.makedirs(folder)
    runs = [("Low", "2024-01-01"), ("High", "2024-02-01"), ("High", "2024-03-01")]
    for i, (tier, day) in enumerate(runs):
        for part in range(20):
            ids = [f"C{k:02d}" for k in range(part, 50, 20)]
            frame = pd.DataFrame({"customer_id": ids, "score_id": [i * 100 + int(c[1:]) for c in ids], "risk_tier": tier,
                                  "scored_at": [datetime.fromisoformat(day).date()] * len(ids)})
            path = f"{folder}/run-{i}-{part:02d}.parquet"
            frame.to_parquet(path, index=False)
            age = -i if newest_first else i
            os.utime(path, (1_700_000_000 + age * 100 + part, 1_700_000_000 + age * 100 + part))
    found = alerts.run_alerts(spark, folder, files_per_batch=17).collect()
    assert sorted((r.customer_id, str(r.scored_at), r.previous_tier, r.risk_tier) for r in found) == [
        (f"C{k:02d}", "2024-02-01", "Low", "High") for k in range(50)]


def test_compaction_folds_the_partials(spark):
    source, target = scratch_path(spark, "versions"), scratch_path(spark, "compacted")
    for batch, rows in enumerate([[(1, 2), (2, 3)], [(2, 4)]]):
        spark.createDataFrame(rows, "k int, events long").write.parquet(f"{source}/batch_id={batch}")
    usage.compact(spark, source, target, lambda rows: rows.groupBy("k").agg(F.sum("events").alias("events")))
    assert sorted((r.k, r.events, r.batch_id) for r in spark.read.parquet(target).collect()) == [(1, 2, 1), (2, 7, 1)]
