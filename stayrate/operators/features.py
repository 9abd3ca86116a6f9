"""Point-in-time customer features: one aggregation per fact table, every fact bounded by ``as_of``."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stayrate.functions.columns import (
    complete_months, days_before, fixed, flag, mean_of, mean_where, ratio,
)
from stayrate.functions.ranking import exact_quantile

_CONTRACT_COLUMNS = [
    "contract_id", "contract_type", "start_date", "end_date", "monthly_charges", "num_products", "has_addon",
    "discount_pct", "status", "churned_at",
]


def known_end(as_of: date, prefix: str = "") -> Column:
    """The contract end as it could be known at as_of: ends set by later events are hidden."""
    churned_at, status, end = (F.col(prefix + c) for c in ("churned_at", "status", "end_date"))
    ended_later = F.coalesce(churned_at > F.lit(as_of), F.lit(False)) | (
        status.isin("Upgraded", "Downgraded") & F.coalesce(end > F.lit(as_of), F.lit(False))
    )
    return F.when(~ended_later, end)


def in_force(day: Column) -> Column:
    """Contract runs on a day. An Active contract past its end is overdue for renewal, not over."""
    open_ended = (F.col("status") == "Active") | F.col("end_date").isNull()
    return (F.col("start_date") <= day) & (open_ended | (F.col("end_date") > day))


def contract_state(
    contracts: DataFrame, as_of: date, active_by: str = "status", horizon: int | None = None
) -> DataFrame:
    """One row per customer from one pass over the contracts: live contract, revenue, MRR movement, label.

    ``status``: the live contract is the newest whose snapshot status is Active. ``dates``: the newest
    started by as_of and not churned by then, and only months and ends known by as_of count: for use at
    any past as_of. With a horizon the churn label of (as_of, as_of + horizon] is added.
    """
    if active_by not in ("status", "dates"):
        raise ValueError(f"active_by must be 'status' or 'dates', not {active_by!r}")
    now, then = F.lit(as_of), days_before(as_of, 90)
    started = F.col("start_date") <= now
    charges, none = F.col("monthly_charges"), F.lit(0).cast("decimal(12,2)")
    order = F.struct("start_date", "contract_id")
    running = in_force(now)
    if active_by == "status":
        candidate, current = started & (F.col("status") == "Active"), F.col("status") == "Active"
        until = F.coalesce("end_date", now)
    else:
        candidate, current = started, running
        until = F.least(F.coalesce(known_end(as_of), now), now)

    def total(condition: Column, amount: Column = charges) -> Column:
        return F.sum(F.when(started & condition, amount).otherwise(none)).cast("decimal(28,2)")

    measures = [
        F.max_by(F.struct(*_CONTRACT_COLUMNS), F.when(candidate, order)).alias("live"),
        total(current).alias("current_mrr"),
        F.sum(F.when(started, charges * complete_months(F.col("start_date"), until)))
        .cast("decimal(28,2)").alias("total_lifetime_revenue"),
        # contract_id is the primary key: no distinct needed, so no second shuffle
        F.count(F.when(started, F.col("contract_id"))).alias("num_contracts"),
        (F.max(F.when(started, charges)) - F.min(F.when(started, charges))).cast("decimal(28,2)").alias("mrr_expansion"),
        (F.max_by(charges, F.when(started, order)) - F.min_by(charges, F.when(started, order)))
        .cast("decimal(28,2)").alias("mrr_delta"),
        total(running).alias("mrr_now"),
        total(in_force(then)).alias("mrr_then"),
        F.count_if(started & (F.col("status") == "Upgraded") & (F.col("end_date") <= now)).alias("upgrades"),
    ]
    last_start = as_of
    if horizon is not None:
        last_start = as_of + timedelta(days=horizon)
        gone = (F.col("churned_at") > now) & (F.col("churned_at") <= F.lit(last_start))
        measures.append(F.max(flag(gone)).alias("churn_label"))
    state = contracts.where(F.col("start_date") <= F.lit(last_start)).groupBy("customer_id").agg(*measures)
    if active_by == "dates":
        churned = F.coalesce(F.col("live.churned_at") <= now, F.lit(False))
        end = known_end(as_of, "live.")
        state = state.withColumn(
            "live", F.when(~churned, F.col("live").withField("end_date", end))
        )
    return state


def live_contract(contracts: DataFrame, as_of: date, active_by: str = "status") -> DataFrame:
    """The one contract of each customer that is live at as_of."""
    state = contract_state(contracts, as_of, active_by)
    return state.where(F.col("live").isNotNull()).select("customer_id", "live.*")


def account(customers: DataFrame, state: DataFrame, as_of: date, compat: bool = False) -> DataFrame:
    """Contract, account and revenue signals of customers with a live contract.

    ``compat`` keeps only the month component of the tenure (0..11).
    """
    months = complete_months(F.col("acquisition_date"), F.lit(as_of))
    end = F.col("live.end_date")
    rest = [c for c in state.columns if c not in ("customer_id", "live")]
    return state.where(F.col("live").isNotNull()).join(customers, "customer_id").select(
        "customer_id",
        (months % 12 if compat else months).alias("tenure_months"),
        "live.contract_type", "live.monthly_charges", "live.num_products",
        F.col("live.has_addon").cast("int").alias("has_addon"),
        "live.discount_pct",
        flag(end <= F.lit(as_of + timedelta(days=90))).alias("renewal_due_90d"),
        flag(end <= F.lit(as_of)).alias("renewal_overdue"),
        "industry", "company_size", "region",
        flag(F.col("csm_owner").isNotNull()).alias("csm_assigned"),
        *rest,
    )


TENURE = [
    "customer_id", "tenure_months", "contract_type", "monthly_charges", "num_products", "has_addon", "discount_pct",
    "renewal_due_90d", "industry", "company_size", "region", "csm_assigned",
]
REVENUE = ["customer_id", "current_mrr", "total_lifetime_revenue", "num_contracts", "mrr_expansion", "mrr_delta"]


def tenure(
    customers: DataFrame, contracts: DataFrame, as_of: date, active_by: str = "status", compat: bool = False
) -> DataFrame:
    rows = account(customers, contract_state(contracts, as_of, active_by), as_of, compat)
    return rows.select(*TENURE, "renewal_overdue")


def revenue(contracts: DataFrame, as_of: date, active_by: str = "status") -> DataFrame:
    """MRR, lifetime revenue and its spread over all contracts of a customer."""
    return contract_state(contracts, as_of, active_by).select(*REVENUE)


def billing(events: DataFrame, as_of: date) -> DataFrame:
    kind, day = F.col("event_type"), F.col("event_date")
    return (
        events.where(day <= F.lit(as_of))
        .groupBy("customer_id")
        .agg(
            F.count_if((kind == "Late Payment") & (day >= days_before(as_of, 180))).alias("payment_delays_6m"),
            F.count_if((kind == "Dispute") & (day >= days_before(as_of, 365))).alias("disputes_12m"),
            F.max("days_overdue").alias("max_days_overdue"),
            F.sum(F.when((kind == "Payment") & (day >= days_before(as_of, 90)), F.col("amount")))
            .cast("decimal(28,2)").alias("total_paid_90d"),
        )
    )


def engagement(usage: DataFrame, as_of: date) -> DataFrame:
    day, logins = F.col("usage_date"), F.col("logins")
    last30 = day >= days_before(as_of, 30)
    base = day.between(days_before(as_of, 90), days_before(as_of, 61))
    adopted = F.when(
        F.col("total_features") > 0, F.try_divide(F.col("features_used").cast("double"), F.col("total_features"))
    ).otherwise(0.0)
    now, before = F.col("login_freq_30d"), F.col("_before")
    return (
        usage.where(day.between(days_before(as_of, 90), F.lit(as_of)))
        .groupBy("customer_id")
        .agg(
            mean_where(last30, logins).alias("login_freq_30d"),
            F.sum(F.when(last30, logins)).alias("total_logins_30d"),
            mean_where(last30, F.col("session_minutes")).alias("avg_session_min_30d"),
            fixed(F.avg(F.when(last30, adopted)), 6).alias("feature_adoption_30d"),
            mean_of(logins).alias("login_freq_90d"),
            F.max(day).alias("last_active_date"),
            mean_where(base, logins).alias("_before"),
        )
        .select(
            "customer_id", "login_freq_30d", "total_logins_30d", "avg_session_min_30d", "feature_adoption_30d",
            "login_freq_90d", "last_active_date",
            F.datediff(F.lit(as_of), F.col("last_active_date")).alias("days_since_login"),
            fixed(F.when(before > 0, (now - before) / before).otherwise(0.0), 6).alias("usage_trend_pct"),
        )
    )


def support(tickets: DataFrame, as_of: date) -> DataFrame:
    opened, csat = F.col("opened_at").cast("date"), F.col("csat_score")
    last90 = opened >= days_before(as_of, 90)
    return (
        tickets.where(opened.between(days_before(as_of, 365), F.lit(as_of)))
        .groupBy("customer_id")
        .agg(
            F.count_if(last90).alias("tickets_90d"),
            F.count_if(last90 & F.col("priority").isin("High", "Critical")).alias("critical_tickets_90d"),
            mean_of(F.col("resolution_days")).alias("avg_resolution_days"),
            mean_of(csat).alias("avg_csat"),
            F.max(csat).alias("max_csat"),
            F.max_by(csat, F.when(csat.isNotNull(), F.struct("opened_at", "ticket_id"))).alias("last_csat"),
            F.count_if((csat <= 2) & (opened >= days_before(as_of, 180))).alias("low_csat_tickets_6m"),
        )
    )


def nps(responses: DataFrame, as_of: date) -> DataFrame:
    """Newest response per customer; undated ones only where nothing else exists."""
    day = F.col("survey_date")
    return (
        responses.where((day <= F.lit(as_of)) | day.isNull())
        .groupBy("customer_id")
        .agg(F.max(F.struct("survey_date", "response_id", "nps_score")).alias("r"))
        .select(
            "customer_id", "r.nps_score", "r.survey_date",
            F.datediff(F.lit(as_of), F.col("r.survey_date")).alias("days_since_nps"),
        )
    )


def risk_parts() -> dict[str, Column]:
    """The four 0..1 risk parts on a joined row of tenure, engagement, billing, support and nps columns."""
    since_login = F.coalesce(F.col("days_since_login"), F.lit(90))
    delays = F.coalesce(F.col("payment_delays_6m"), F.lit(0))
    load = F.coalesce(F.col("tickets_90d"), F.lit(0)) * F.coalesce(F.col("avg_resolution_days"), F.lit(1.0))
    return {
        "recency_risk": F.least(since_login / F.lit(30.0), F.lit(3.0)) / 3.0,
        "payment_risk": F.least(delays * F.lit(0.3), F.lit(1.0)),
        "support_risk": F.least(load / 50.0, F.lit(1.0)),
        "sentiment_risk": F.coalesce((1.0 - F.col("nps_score") / F.lit(100.0)) / 2.0, F.lit(0.5)),
    }


def join_signals(base: DataFrame, *signals: DataFrame) -> DataFrame:
    """Left joins on customer_id; every input is already one row per customer."""
    for signal in signals:
        base = base.join(signal, "customer_id", "left")
    return base


def risk(base: DataFrame, billed: DataFrame, engaged: DataFrame, supported: DataFrame, surveyed: DataFrame) -> DataFrame:
    joined = join_signals(base.select("customer_id"), engaged, billed, supported, surveyed)
    return joined.select("customer_id", *[fixed(part, 6).alias(name) for name, part in risk_parts().items()])


# fixed values: feature = (source column, default where the customer has no such facts)
DEFAULTS = {
    "payment_delays_6m": ("payment_delays_6m", 0),
    "disputes_12m": ("disputes_12m", 0),
    "max_days_overdue": ("max_days_overdue", 0),
    "login_frequency_30d": ("login_freq_30d", 0.0),
    "feature_adoption_rate": ("feature_adoption_30d", 0.0),
    "avg_session_minutes": ("avg_session_min_30d", 0.0),
    "last_login_days_ago": ("days_since_login", 90),
    "usage_trend_30d": ("usage_trend_pct", -0.5),
    "num_support_tickets": ("tickets_90d", 0),
    "avg_resolution_days": ("avg_resolution_days", 0.0),
    "csat_score": ("avg_csat", 3.0),
    "low_csat_tickets_6m": ("low_csat_tickets_6m", 0),
    "nps_score": ("nps_score", 0),
    "days_since_nps": ("days_since_nps", 365),
    "total_revenue": ("total_lifetime_revenue", 0),
    "mrr_expansion": ("mrr_expansion", 0),
}


def session_scale(engaged: DataFrame) -> Column:
    """95th percentile of the mean session minutes, as a scalar subquery."""
    minutes = engaged.select(fixed(F.col("avg_session_min_30d"), 6).alias("minutes"))
    return exact_quantile(minutes, "minutes", 0.95, "p95").scalar()


def commercial_columns(minutes: Column, scale: Column) -> list[Column]:
    """MRR trend over 90 days, upgrades (at most 5), session depth; on a row with contract state."""
    trend = ratio(F.col("mrr_now") - F.col("mrr_then"), F.col("mrr_then"))
    depth = F.least(F.coalesce(ratio(fixed(minutes, 6), scale), F.lit(0.0)), F.lit(1.0))
    return [
        fixed(F.coalesce(trend, F.lit(0.0)), 6).alias("mrr_trend_90d"),
        F.least(F.col("upgrades"), F.lit(5)).cast("int").alias("expansion_events"),
        fixed(depth, 6).alias("session_depth_score"),
    ]


def commercial(contracts: DataFrame, engaged: DataFrame, as_of: date) -> DataFrame:
    sessions = engaged.select("customer_id", "avg_session_min_30d")
    return contract_state(contracts, as_of).join(sessions, "customer_id", "left").select(
        "customer_id", *commercial_columns(F.col("avg_session_min_30d"), session_scale(engaged))
    )


def final_features(
    accounts: DataFrame, billed: DataFrame, engaged: DataFrame, supported: DataFrame, surveyed: DataFrame,
    also: Sequence[Column | str] = (),
) -> DataFrame:
    """All signals with defaults and the composite risk. ``also`` adds columns of the joined row."""
    joined = join_signals(accounts, billed, engaged, supported, surveyed)
    total = sum((part * 0.25 for part in risk_parts().values()), F.lit(0.0))
    kinds = dict(joined.dtypes)
    filled = [
        F.coalesce(F.col(source), F.lit(default).cast(kinds[source])).alias(name)
        for name, (source, default) in DEFAULTS.items()
    ]
    return joined.select(*TENURE, *filled, fixed(total, 4).alias("composite_risk_score"), *also)
