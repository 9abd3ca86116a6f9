"""Usage signals kept current from an event stream; no row is lost to its order of arrival.

Repeats of an event are dropped by a state store behind a watermark, so the state holds a day's ids and not all of them.
What the state store does not let through, repeats and rows behind the watermark, is looked up in a ledger of ids, in the
folders of its own days only: rows that are new there are merged and counted as late. Every micro-batch writes partial
aggregates to a folder named by the batch, so a repeated batch replaces itself, and readers add the partials up. An event
without an id cannot be told to be a repeat: every such row counts.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stayrate.functions.columns import fixed
from stayrate.session import cut, exists, scratch_path
from stayrate.sources.fixtures import RAW_SCHEMAS
from stayrate.streaming.state import run_batches

GAP_MINUTES = 30
#: How long the state store remembers an event, in event time.
DELAY = "1 day"


class Upkeep(NamedTuple):
    """Partial aggregates by batch, and the number of rows of each batch that came behind the watermark."""

    partials: DataFrame
    late: DataFrame


def read_events(spark: SparkSession, folder: str, files_per_batch: int | None = None) -> DataFrame:
    """Event files as a stream; all files there are in one batch unless ``files_per_batch`` is given."""
    reader = spark.readStream.schema(RAW_SCHEMAS["events"])
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(f"{folder}/events*.parquet")  # files, or folders of part files


def daily_partials(events: DataFrame) -> DataFrame:
    """Events, kinds of events and total value per user and day, ready to be added up."""
    return events.groupBy("user_id", F.col("day").alias("usage_date")).agg(
        F.count(F.lit(1)).alias("events"), F.collect_set("event_type").alias("kinds"),  # a closed, short list
        F.sum(F.col("value").cast("decimal(28,2)")).alias("total_value"),
    )


def slot_partials(events: DataFrame) -> DataFrame:
    """First and last event and their number per user and half hour; one slot never holds parts of two sessions."""
    slot = F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / (60 * GAP_MINUTES))
    return events.groupBy("user_id", slot.alias("slot")).agg(
        F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count(F.lit(1)).alias("events"))


def run_partials(stream: DataFrame, partials: Callable[[DataFrame], DataFrame], name: str) -> Upkeep:
    """Process what is available; the partials and late rows of all batches, under their batch ids."""
    spark = stream.sparkSession
    target = scratch_path(spark, name)
    marked = stream.withColumn("day", F.to_date("ts"))
    # versions without rows, so that a stream without data finds the folders
    empty = partials(spark.createDataFrame([], marked.schema))
    empty.write.parquet(f"{target}/partials/batch_id=-1")
    spark.createDataFrame([], "late_rows bigint").write.parquet(f"{target}/late/batch_id=-1")
    key = ["event_id", "day"]
    timed = marked.where("event_id is not null").withColumn("at", F.col("ts").cast("timestamp"))
    once = timed.withWatermark("at", DELAY).dropDuplicatesWithinWatermark(key).drop("at")
    # both views of a batch in one query: what the state store lets through, and all that came
    both = once.withColumn("on_time", F.lit(True)).union(marked.withColumn("on_time", F.lit(False)))

    def keep(batch: DataFrame, batch_id: int) -> None:
        rows = cut(batch)
        fresh, came = rows.where("on_time").drop("on_time"), rows.where("not on_time").drop("on_time")
        left = came.where("event_id is not null").dropDuplicates(key).join(fresh.select(*key), key, "left_anti")
        left = cut(left.select(came.columns))
        late = left.join(_ledger(spark, f"{target}/ids", left, batch_id), key, "left_anti").select(came.columns)
        counted = fresh.unionByName(late).unionByName(came.where("event_id is null"))
        partials(counted).write.mode("overwrite").parquet(f"{target}/partials/batch_id={batch_id}")
        late.agg(F.count(F.lit(1)).alias("late_rows")).write.mode("overwrite").parquet(f"{target}/late/batch_id={batch_id}")
        ids = fresh.select(*key).unionByName(late.select(*key)).withColumn("batch_id", F.lit(batch_id))
        ids.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "batch_id").parquet(f"{target}/ids")

    run_batches(both, keep, f"{name}-checkpoint")
    return Upkeep(
        spark.read.schema(f"{_ddl(empty)}, batch_id bigint").parquet(f"{target}/partials"),
        spark.read.schema("late_rows bigint, batch_id bigint").parquet(f"{target}/late"))


def _ledger(spark: SparkSession, path: str, rows: DataFrame, batch_id: int) -> DataFrame:
    """Ids that earlier batches have counted for the days of these rows; no other day's folder is listed."""
    days = [r["day"] for r in rows.select("day").distinct().collect()]  # bounded by the calendar
    folders = [f for f in (f"{path}/day={d}" for d in days) if exists(spark, f)]
    schema = "event_id bigint, day date, batch_id bigint"
    if not folders:
        return spark.createDataFrame([], schema).select("event_id", "day")
    known = spark.read.schema(schema).option("basePath", path).parquet(*folders)
    return known.where(F.col("batch_id") < batch_id).select("event_id", "day")


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"{c} {t}" for c, t in df.dtypes)


def daily_usage(events: DataFrame) -> DataFrame:
    """Events, kinds of events and total value per user and day."""
    return summed_days(run_partials(events, daily_partials, "usage-daily").partials)


def summed_days(days: DataFrame) -> DataFrame:
    return days.groupBy("user_id", "usage_date").agg(
        F.sum("events").alias("events"), F.size(F.array_distinct(F.flatten(F.collect_list("kinds")))).alias("event_types"),
        F.sum("total_value").cast("decimal(28,2)").alias("total_value"),
    )


def sliding_logins(events: DataFrame) -> DataFrame:
    """Events per user in every trailing seven days, moving by one day."""
    days = run_partials(events, daily_partials, "engagement-sliding").partials
    start = F.explode(F.sequence(F.date_sub("usage_date", 6), F.col("usage_date")))
    return days.select("user_id", "events", start.alias("window_start")).groupBy("user_id", "window_start").agg(
        F.sum("events").alias("logins_7d")
    ).select(
        "user_id", "window_start", F.date_add("window_start", 7).alias("window_end"), "logins_7d",
        fixed(F.col("logins_7d") / F.lit(7.0), 4).alias("logins_per_day"),
    )


def sessions(events: DataFrame) -> DataFrame:
    """All sessions: runs of events of a user with no gap over 30 minutes.

    ``is_open``: the newest event of all is not later than a next event of the session may be.
    """
    slots = run_partials(events, slot_partials, "session-minutes").partials.groupBy("user_id", "slot").agg(
        F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"), F.sum("events").alias("events"))
    gap = F.expr(f"interval {GAP_MINUTES} minutes")
    by_user = Window.partitionBy("user_id").orderBy("slot")  # two rows per active hour of a user
    opens = F.when(F.col("first_ts") <= F.lag("last_ts").over(by_user) + gap, 0).otherwise(1)
    numbered = slots.withColumn("opens", opens).withColumn("nth", F.sum("opens").over(by_user))
    found = numbered.groupBy("user_id", "nth").agg(
        F.min("first_ts").alias("session_start"), F.max("last_ts").alias("last_ts"), F.sum("events").alias("events"))
    newest = slots.agg(F.max("last_ts")).first()[0]
    micros = F.unix_micros(F.col("last_ts").cast("timestamp")) - F.unix_micros(F.col("session_start").cast("timestamp"))
    return found.select(
        "user_id", "session_start", "events", fixed(micros / F.lit(60e6), 4).alias("session_minutes"),
        (F.lit(newest).cast("timestamp_ntz") <= F.col("last_ts") + gap).alias("is_open"),
    )


def compact(spark: SparkSession, source: str, target: str, merge: Callable[[DataFrame], DataFrame]) -> None:
    """Fold all partials written so far into one, in a folder of its own that later batches go on in."""
    rows = spark.read.parquet(source)
    last = rows.agg(F.max("batch_id")).first()[0]
    merge(rows.drop("batch_id")).write.mode("overwrite").parquet(f"{target}/batch_id={last}")
