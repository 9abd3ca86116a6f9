"""Revenue at risk and executive KPI tables."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stayrate.functions.columns import fixed, mean_of, month_of, month_start_from, ratio
from stayrate.functions.ranking import add_neighbour, exact_quantile
from stayrate.operators.features import live_contract
from stayrate.sources.schemas import COMPANY_SIZES

_DRIVERS = ["top_driver_1", "top_driver_2", "top_driver_3"]


def _money(value: Column) -> Column:
    return value.cast("decimal(28,2)")


def _whole(value: Column) -> Column:
    return F.round(value, 0).cast("bigint")


def tier_rank(tier: Column) -> Column:
    return F.when(tier == "Critical", 1).when(tier == "High", 2).when(tier == "Medium", 3).otherwise(4)


def latest_scores(scores: DataFrame) -> DataFrame:
    """The newest score of every customer; equal dates are settled by the higher score id."""
    columns = [c for c in scores.columns if c != "customer_id"]
    return (
        scores.groupBy("customer_id")
        .agg(F.max_by(F.struct(*columns), F.struct("scored_at", "score_id")).alias("s"))
        .select("customer_id", "s.*")
    )


def _exposure(scores: DataFrame, contracts: DataFrame, customers: DataFrame, as_of: date) -> DataFrame:
    live = live_contract(contracts, as_of).select("customer_id", "monthly_charges", "contract_type")
    people = customers.select("customer_id", "company_name", "industry", "company_size", "csm_owner", "region")
    return latest_scores(scores).join(live, "customer_id").join(people, "customer_id")


def _risk_sums() -> list[Column]:
    charges, p = F.col("monthly_charges"), F.col("churn_probability")
    return [
        F.count(F.lit(1)).alias("customers"),
        F.sum(p).alias("p"),
        F.sum(charges).alias("mrr"),
        F.sum(charges * p).alias("loss"),
    ]


def _risk_measures() -> list[Column]:
    mrr, loss = F.col("mrr"), F.col("loss")
    return [
        "customers",
        fixed(ratio(F.col("p"), F.col("customers")), 3).alias("avg_churn_prob"),
        _whole(mrr).alias("total_mrr"),
        _whole(loss).alias("expected_monthly_loss"),
        _whole(loss * 12).alias("expected_annual_loss"),
        _whole(mrr * 12).alias("total_acv"),
    ]


def revenue_at_risk(scores: DataFrame, contracts: DataFrame, customers: DataFrame, as_of: date) -> DataFrame:
    keys = ["risk_tier", "industry", "company_size"]
    sums = _exposure(scores, contracts, customers, as_of).groupBy(*keys).agg(*_risk_sums())
    return sums.select(*keys, *_risk_measures()).orderBy(
        tier_rank(F.col("risk_tier")), F.desc("expected_monthly_loss"), "industry", "company_size"
    )


def risk_rollup(scores: DataFrame, contracts: DataFrame, customers: DataFrame, as_of: date) -> DataFrame:
    """Totals, per tier, per tier and industry. Customers are summed once; the rollup adds up those sums."""
    finest = _exposure(scores, contracts, customers, as_of).groupBy("risk_tier", "industry").agg(*_risk_sums())
    rolled = finest.rollup("risk_tier", "industry").agg(
        F.grouping_id().alias("g"), *[F.sum(c).alias(c) for c in ("customers", "p", "mrr", "loss")]
    )
    level = F.when(F.col("g") == 0, "tier_industry").when(F.col("g") == 1, "tier").otherwise("total")
    return rolled.select(level.alias("level"), "risk_tier", "industry", *_risk_measures())


def churn_trend(contracts: DataFrame, as_of: date, months: int = 24) -> DataFrame:
    """Contract starts and churns per month, the rate on starts: the published definition."""
    start, gone = F.col("start_date"), F.col("churned_at")
    starts = (
        contracts.where(F.col("status").isin("Active", "Churned") & (start <= F.lit(as_of)))
        .groupBy(month_of(start).alias("month")).agg(F.count(F.lit(1)).alias("customers_active"))
        .where(F.col("month") >= F.add_months(F.lit(as_of), -months))
    )
    churns = (
        contracts.where((F.col("status") == "Churned") & (gone <= F.lit(as_of)))
        .groupBy(month_of(gone).alias("month"))
        .agg(F.count(F.lit(1)).alias("churned"), F.sum("monthly_charges").alias("lost"))
    )
    churned = F.coalesce("churned", F.lit(0))
    return starts.join(churns, "month", "left").select(
        "month", "customers_active", churned.alias("churned_count"),
        _money(F.coalesce(F.col("lost"), F.lit(0).cast("decimal(22,2)"))).alias("churned_mrr"),
        fixed(ratio(churned, F.col("customers_active")) * 100, 2).alias("monthly_churn_rate_pct"),
    )


def _on_month_spine(monthly: DataFrame, as_of: date) -> DataFrame:
    """Every month from the first one present to as_of; absent months get zeros.

    Each month fills the gap up to the next one present, so the input is computed once. The window runs
    over one row per calendar month.
    """
    measures = [c for c in monthly.columns if c != "month"]
    kinds = dict(monthly.dtypes)
    following = F.coalesce(F.lead("month").over(W.orderBy("month")), F.add_months(month_of(F.lit(as_of)), 1))
    months = F.sequence("_own", F.add_months(following, -1), F.expr("interval 1 month"))
    filled = monthly.withColumn("_own", F.col("month")).withColumn("_months", months)
    filled = filled.select("_own", *measures, F.explode("_months").alias("month"))
    own = F.col("month") == F.col("_own")
    return filled.select(
        "month", *[F.when(own, F.col(m)).otherwise(F.lit(0).cast(kinds[m])).alias(m) for m in measures]
    )


def churn_rate_monthly(contracts: DataFrame, as_of: date) -> DataFrame:
    """Churned in the month over contracts in force at its start.

    Each contract adds one at its first month start and takes one off at the first month start after its
    end: one pass and a running sum over months instead of a range join.
    """
    start, gone = F.col("start_date"), F.col("churned_at")
    ends = F.when(F.col("status") != "Active", F.col("end_date"))
    churned = (F.col("status") == "Churned") & (gone <= F.lit(as_of))

    def change(month: Column, active, lost, money) -> Column:
        return F.struct(
            month.alias("month"), F.lit(active).alias("active"), F.lit(lost).alias("churned"), money.alias("churned_mrr")
        )

    nothing = F.lit(0).cast("decimal(12,2)")
    changes = contracts.where(start <= F.lit(as_of)).select(F.explode(F.array(
        change(month_start_from(start), 1, 0, nothing),
        change(month_start_from(ends), -1, 0, nothing),
        change(F.when(churned, month_of(gone)), 0, 1, F.col("monthly_charges")),
    )).alias("c")).select("c.*").where(F.col("month") <= month_of(F.lit(as_of)))
    monthly = changes.groupBy("month").agg(
        F.sum("active").alias("active"), F.sum("churned").alias("churned"), F.sum("churned_mrr").alias("churned_mrr")
    )
    # one row per calendar month: the unpartitioned window is bounded by the calendar
    upto = W.orderBy("month").rowsBetween(W.unboundedPreceding, W.currentRow)
    return (
        _on_month_spine(monthly, as_of)
        .withColumn("active_at_start", F.sum("active").over(upto))
        .select(
            "month", "active_at_start", "churned", _money(F.col("churned_mrr")).alias("churned_mrr"),
            fixed(ratio(F.col("churned"), F.col("active_at_start")) * 100, 4).alias("churn_rate_pct"),
        )
    )


def churn_forecast(
    contracts: DataFrame, as_of: date, months: int = 24, ahead: int = 3, target_pct: float = 2.5
) -> DataFrame:
    """Linear trend of the monthly rate over the last full months, with a 1.96 sd band."""
    this_month = month_of(F.lit(as_of))
    first = F.add_months(this_month, -months)
    x = F.months_between("month", first) + 1
    history = churn_rate_monthly(contracts, as_of).where((F.col("month") >= first) & (F.col("month") < this_month))
    y = F.col("churn_rate_pct")
    fit = history.withColumn("x", x).agg(
        F.regr_slope(y, F.col("x")).alias("slope"), F.regr_intercept(y, F.col("x")).alias("base"),
        F.regr_syy(y, F.col("x")).alias("syy"), F.regr_sxy(y, F.col("x")).alias("sxy"), F.count(y).alias("n"),
    )
    spread = F.sqrt(F.greatest(F.col("syy") - F.col("slope") * F.col("sxy"), F.lit(0.0)) / (F.col("n") - 2)) * 1.96
    mid = F.col("base") + F.col("slope") * (F.lit(months) + F.col("step"))
    return (
        fit.select("*", F.explode(F.sequence(F.lit(1), F.lit(ahead))).alias("step"))
        .select(
            F.add_months(this_month, F.col("step") - 1).alias("month"),
            fixed(mid, 4).alias("forecast_pct"),
            fixed(mid - spread, 4).alias("lower_pct"),
            fixed(mid + spread, 4).alias("upper_pct"),
        )
        .withColumn("above_target", F.col("forecast_pct") > target_pct)
    )


def top_accounts(scores: DataFrame, contracts: DataFrame, customers: DataFrame, as_of: date, n: int = 50) -> DataFrame:
    return (
        _exposure(scores, contracts, customers, as_of)
        .where(F.col("risk_tier").isin("Critical", "High"))
        .select(
            "customer_id", "company_name", "industry", "company_size", "csm_owner", "contract_type", "monthly_charges",
            "churn_probability", "risk_tier", "revenue_at_risk", "top_driver_1", "top_driver_2",
            "recommended_action",
        )
        .orderBy(F.desc("revenue_at_risk"), "customer_id")
        .limit(n)
    )


def driver_frequency(scores: DataFrame) -> DataFrame:
    return (
        latest_scores(scores)
        .unpivot(["churn_probability", "revenue_at_risk"], _DRIVERS, "place", "driver")
        .where(F.col("driver").isNotNull())
        .groupBy("driver")
        .agg(
            F.count(F.lit(1)).alias("customer_count"),
            fixed(mean_of(F.col("churn_probability")), 3).alias("avg_churn_prob"),
            _whole(F.sum("revenue_at_risk")).alias("total_revenue_at_risk"),
        )
    )


def tiles(scores: DataFrame, contracts: DataFrame, actions: DataFrame, as_of: date) -> DataFrame:
    """Five headline figures in one row; the churn rate is that of the last full month."""
    last_month = F.add_months(month_of(F.lit(as_of)), -1)
    rate = churn_rate_monthly(contracts, as_of).where(F.col("month") == last_month).select("churn_rate_pct")
    saves = actions.agg(fixed(ratio(F.count_if(F.col("outcome") == "saved"), F.count(F.lit(1))), 4))
    figures = latest_scores(scores).agg(
        F.count(F.lit(1)).alias("total_customers"),
        _money(F.sum("revenue_at_risk")).alias("revenue_at_risk"),
        fixed(mean_of(F.col("churn_probability")), 4).alias("avg_churn_probability"),
    )
    return figures.select(
        "*", rate.scalar().alias("monthly_churn_rate_pct"), saves.scalar().alias("recovery_rate")
    )


def tier_distribution(scores: DataFrame) -> DataFrame:
    counts = latest_scores(scores).groupBy("risk_tier").agg(F.count(F.lit(1)).alias("customers"))
    total = F.sum("customers").over(W.partitionBy())  # four rows
    return counts.select("risk_tier", "customers", fixed(ratio(F.col("customers"), total) * 100, 2).alias("share_pct"))


def mrr_waterfall(contracts: DataFrame, as_of: date) -> DataFrame:
    """Monthly recurring revenue: opening, new, expansion, contraction, churn, closing."""
    started = contracts.where(F.col("start_date") <= F.lit(as_of))
    linked = add_neighbour(
        started, "customer_id", "start_date", "contract_id",
        {"prior_charges": "monthly_charges", "prior_status": "status"}, following=False,
    )
    charges, prior = F.col("monthly_charges"), F.col("prior_charges")
    continued = prior.isNotNull() & (F.col("prior_status") != "Churned")
    step = charges - prior
    zero = F.lit(0).cast("decimal(13,2)")

    def move(month: Column, **amounts: Column) -> Column:
        kinds = ("new", "expansion", "contraction", "churn")
        return F.struct(
            month.alias("month"), *[amounts.get(k, zero).cast("decimal(13,2)").alias(k) for k in kinds]
        )

    lost = (F.col("status") == "Churned") & (F.col("churned_at") <= F.lit(as_of))
    moves = linked.select(F.explode(F.array(
        move(
            month_of(F.col("start_date")),
            new=F.when(~continued, charges).otherwise(zero),
            expansion=F.when(continued & (step > 0), step).otherwise(zero),
            contraction=F.when(continued & (step < 0), step).otherwise(zero),
        ),
        move(F.when(lost, month_of(F.col("churned_at"))), churn=-charges),
    )).alias("m")).select("m.*").where(F.col("month").isNotNull())
    kinds = ["new", "expansion", "contraction", "churn"]
    monthly = moves.groupBy("month").agg(*[_money(F.sum(k)).alias(k) for k in kinds])
    upto = W.orderBy("month").rowsBetween(W.unboundedPreceding, W.currentRow)  # one row per calendar month
    net = sum((F.col(k) for k in kinds[1:]), F.col("new"))
    return (
        _on_month_spine(monthly, as_of)
        .withColumn("closing", _money(F.sum(net).over(upto)))
        .select("month", _money(F.col("closing") - net).alias("opening"), *kinds, "closing")
    )


def risk_register(
    scores: DataFrame, contracts: DataFrame, customers: DataFrame, as_of: date,
    tiers: Sequence[str] | None = None, sizes: Sequence[str] | None = None, contract_types: Sequence[str] | None = None,
) -> DataFrame:
    """Every scored customer with colour band and top-decile mark; the slicers act after the mark is set."""
    rows = _exposure(scores, contracts, customers, as_of)
    threshold = exact_quantile(latest_scores(scores), "revenue_at_risk", 0.9, "threshold").scalar()
    p = F.col("churn_probability")
    band = F.when(p >= 0.70, "red").when(p >= 0.50, "orange").when(p >= 0.30, "yellow").otherwise("green")
    register = rows.select(
        "customer_id", "company_name", "company_size", "industry", "contract_type", "monthly_charges",
        "churn_probability", "risk_tier", "revenue_at_risk", band.alias("colour_band"),
        (F.col("revenue_at_risk").cast("double") >= threshold).alias("top_decile"),
    )
    for column, wanted in (("risk_tier", tiers), ("company_size", sizes), ("contract_type", contract_types)):
        if wanted is not None:
            register = register.where(F.col(column).isin(list(wanted)))
    return register


def probability_histogram(scores: DataFrame, bins: int = 20) -> DataFrame:
    place = F.least(F.floor(F.col("churn_probability") * bins), F.lit(bins - 1)).cast("int")
    counts = latest_scores(scores).groupBy(place.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    edges = scores.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return edges.join(counts, "bin", "left").select(
        "bin", (F.col("bin") / F.lit(float(bins))).alias("low"), ((F.col("bin") + 1) / F.lit(float(bins))).alias("high"),
        F.coalesce("n", F.lit(0)).alias("customers"),
    )


def register_pivot(scores: DataFrame, contracts: DataFrame, customers: DataFrame, as_of: date) -> DataFrame:
    """Company rows by segment columns: MRR, mean probability, revenue at risk."""
    rows = _exposure(scores, contracts, customers, as_of)
    wide = rows.groupBy("company_name").pivot("company_size", COMPANY_SIZES).agg(
        _money(F.sum("monthly_charges")).alias("mrr"),
        fixed(mean_of(F.col("churn_probability")), 4).alias("avg_prob"),
        _money(F.sum("revenue_at_risk")).alias("revenue"),
    )
    return wide.select(
        "company_name",
        *[F.col(f"`{c}`").alias(c.lower().replace("-", "_")) for c in wide.columns if c != "company_name"],
    )


def churn_by_contract(frame: DataFrame) -> DataFrame:
    return frame.groupBy("contract_type").agg(
        F.count(F.lit(1)).alias("customers"),
        F.sum("churn_label").alias("churned"),
        fixed(mean_of(F.col("churn_label")) * 100, 2).alias("churn_rate_pct"),
    )
