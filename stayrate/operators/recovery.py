"""Recovery operations: who needs action, what was done, what it saved, what it could save."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stayrate.functions.columns import fixed, ratio
from stayrate.operators.kpi import latest_scores


def action_queue(scores: DataFrame, customers: DataFrame, actions: DataFrame, n: int = 100) -> DataFrame:
    """The n Critical accounts with most revenue at risk and no pending action; ranks follow the limit."""
    pending = actions.where(F.col("outcome") == "pending").select("customer_id")
    waiting = latest_scores(scores).where(F.col("risk_tier") == "Critical").join(pending, "customer_id", "left_anti")
    first = (
        waiting.join(customers.select("customer_id", "company_name", "csm_owner"), "customer_id")
        .select("customer_id", "company_name", "csm_owner", "churn_probability", "revenue_at_risk", "top_driver_1")
        .orderBy(F.desc("revenue_at_risk"), "customer_id")
        .limit(n)
    )
    return first.withColumn("priority", F.row_number().over(W.orderBy(F.desc("revenue_at_risk"), "customer_id")))


def recovery_kpis(scores: DataFrame, actions: DataFrame) -> DataFrame:
    needing = latest_scores(scores).agg(F.count_if(F.col("risk_tier").isin("Critical", "High")))
    saved = F.col("outcome") == "saved"
    return actions.agg(
        F.count(F.lit(1)).alias("actions_taken"),
        F.count_if(saved).alias("saves"),
        F.sum(F.when(saved, F.col("saved_mrr"))).cast("decimal(28,2)").alias("revenue_saved"),
        fixed(ratio(F.count_if(saved), F.count(F.lit(1))), 4).alias("recovery_rate"),
    ).select(needing.scalar().alias("needing_action"), "*")


def save_rate_by_intervention(actions: DataFrame) -> DataFrame:
    """Saves over closed actions; pending ones do not count."""
    saved, closed = F.col("outcome") == "saved", F.col("outcome").isin("saved", "lost")
    return actions.groupBy("intervention").agg(
        F.count(F.lit(1)).alias("actions"),
        F.count_if(closed).alias("closed"),
        F.count_if(saved).alias("saves"),
        fixed(ratio(F.count_if(saved), F.count_if(closed)), 4).alias("save_rate"),
        F.sum("saved_mrr").cast("decimal(28,2)").alias("saved_mrr"),
    )


def recovery_scenario(
    scores: DataFrame, rates: Sequence[float] = (0.10, 0.25, 0.50), tiers: Sequence[str] = ("Critical", "High")
) -> DataFrame:
    """Annual revenue protected if a share of the chosen tiers' revenue at risk is recovered."""
    exposed = latest_scores(scores).where(F.col("risk_tier").isin(list(tiers))).agg(
        F.sum("revenue_at_risk").cast("decimal(28,2)").alias("monthly_at_risk"), F.count(F.lit(1)).alias("customers")
    )
    options = F.array(*[F.lit(str(r)).cast("decimal(5,4)") for r in rates])
    return exposed.select(F.explode(options).alias("rate"), "customers", "monthly_at_risk").select(
        F.col("rate").cast("double").alias("recovery_rate"), "customers", "monthly_at_risk",
        F.round(F.col("monthly_at_risk") * 12 * F.col("rate"), 2).cast("decimal(28,2)").alias("protected_annual"),
    )
