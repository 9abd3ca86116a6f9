"""Alerts when a customer's risk tier rises from one scoring run to the next, whatever the order of arrival.

Runs of a customer are ordered by (scored_at, score_id). A micro-batch evaluates all runs of the customers it has
scores of, so a run that arrives late also corrects what was said about the next one; readers take the newest verdict
on each score.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stayrate.operators.kpi import tier_rank
from stayrate.session import scratch_path

_SCORES = "customer_id string, score_id bigint, risk_tier string, scored_at date"
_VERDICTS = f"{_SCORES}, previous_tier string, rises boolean"


def read_scores(spark: SparkSession, folder: str, files_per_batch: int | None = None) -> DataFrame:
    """Score files as a stream; all files there are in one batch unless ``files_per_batch`` is given."""
    reader = spark.readStream.schema(_SCORES)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def verdicts(scores: DataFrame) -> DataFrame:
    """Every score with the tier before it and whether the tier rose."""
    runs = Window.partitionBy("customer_id").orderBy("scored_at", "score_id")
    before = F.lag("risk_tier").over(runs)
    rises = F.col("previous_tier").isNotNull() & (tier_rank(F.col("risk_tier")) < tier_rank(F.col("previous_tier")))
    return scores.withColumn("previous_tier", before).withColumn("rises", F.coalesce(rises, F.lit(False)))


def run_alerts(spark: SparkSession, folder: str, files_per_batch: int | None = None) -> DataFrame:
    """Process what is available; one row per rise."""
    target, checkpoint = scratch_path(spark, "alerts"), scratch_path(spark, "alerts-checkpoint")
    spark.createDataFrame([], _SCORES).write.parquet(f"{target}/scores/batch_id=-1")
    spark.createDataFrame([], _VERDICTS).write.parquet(f"{target}/verdicts/batch_id=-1")

    def keep(batch: DataFrame, batch_id: int) -> None:
        stored = spark.read.schema(f"{_SCORES}, batch_id bigint").parquet(f"{target}/scores")
        batch.write.mode("overwrite").parquet(f"{target}/scores/batch_id={batch_id}")
        arrived = spark.read.schema(_SCORES).parquet(f"{target}/scores/batch_id={batch_id}")
        history = stored.where(F.col("batch_id") < batch_id).drop("batch_id").join(
            arrived.select("customer_id").distinct(), "customer_id", "left_semi")
        known = history.unionByName(arrived).dropDuplicates(["customer_id", "scored_at", "score_id"])
        verdicts(known).write.mode("overwrite").parquet(f"{target}/verdicts/batch_id={batch_id}")

    query = (
        read_scores(spark, folder, files_per_batch).writeStream.option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).foreachBatch(keep).start()
    )
    query.awaitTermination()
    every = spark.read.schema(f"{_VERDICTS}, batch_id bigint").parquet(f"{target}/verdicts")
    newest = every.groupBy("customer_id", "scored_at", "score_id").agg(
        F.max_by(F.struct("previous_tier", "risk_tier", "rises"), "batch_id").alias("v"))
    return newest.where("v.rises").select("customer_id", "scored_at", "v.previous_tier", "v.risk_tier")
