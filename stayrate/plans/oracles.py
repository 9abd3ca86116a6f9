"""DuckDB statements that state each query's result independently, over the driver's tables.

``CTES`` holds the fixture views and reusable intermediate tables; ``statement`` prepends those a body
needs, in dependency order.
"""

from __future__ import annotations

import re

AS_OF = "DATE '2001-08-01'"

CTES: dict[str, str] = {}


def _months(start: str, end: str) -> str:
    span = f"age(cast({end} as timestamp), cast({start} as timestamp))"
    return f"cast(date_part('year', {span}) * 12 + date_part('month', {span}) as int)"


def _fixed(value: str, digits: int) -> str:
    return f"cast(round(cast({value} as decimal(28,8)), {digits}) as double)"


def _mean(value: str, condition: str | None = None) -> str:
    kept = value if condition is None else f"case when {condition} then {value} end"
    return f"cast(sum({kept}) as double) / nullif(count({kept}), 0)"


def _ago(days: int) -> str:
    return f"({AS_OF} - {days})"


def _unit(seed: int, *parts: str) -> str:
    text = " || '|' || ".join([f"'{seed}'", *[f"cast({p} as varchar)" for p in parts]])
    return f"(('0x' || substr(md5({text}), 1, 13))::bigint / 4503599627370496.0::double)"


def _cust(key: str) -> str:
    return f"concat('CUST-', lpad(cast({key} as varchar), 9, '0'))"


def statement(body: str) -> str:
    """Prefix a SELECT with the CTEs it names, directly or through other CTEs."""
    order: list[str] = []

    def need(text: str) -> None:
        for name in CTES:
            if name not in order and re.search(rf"\b(from|join)\s+{name}\b", text):
                need(CTES[name])
                if name not in order:
                    order.append(name)

    need(body)
    if not order:
        return body.strip()
    heads = ",\n".join(f"{name} as (\n{CTES[name].strip()}\n)" for name in order)
    return f"with {heads}\n{body.strip()}"


# ---------------------------------------------------------------- fixture views (FIXTURES.md section 2)
CTES["customers"] = f"""
select {_cust('c_custkey')} customer_id, c_name company_name, c_mktsegment industry,
  case when c_acctbal < 4500 then 'SMB' when c_acctbal < 8000 then 'Mid-Market' else 'Enterprise' end company_size,
  coalesce(cast(f.first_dt as date), DATE '1995-01-01') acquisition_date,
  case when c_custkey % 5 < 2 then concat('CSM-', cast(c_custkey % 10 as varchar)) end csm_owner,
  r_name region, c_custkey
from customer
left join (select o_custkey, min(o_orderdate) first_dt from orders group by o_custkey) f on f.o_custkey = c_custkey
left join nation on n_nationkey = c_nationkey
left join region on r_regionkey = n_regionkey
"""
CTES["contracts"] = f"""
select o_orderkey contract_id, {_cust('o_custkey')} customer_id,
  case when o_orderpriority in ('1-URGENT','2-HIGH') then 'Monthly'
       when o_orderpriority in ('3-MEDIUM','4-NOT SPECIFIED') then 'Annual' else 'Multi-year' end contract_type,
  d start_date,
  case when nd is not null then nd when o_orderstatus = 'F' then d + 60
       when o_orderkey % 3 = 0 then null else d + 365 end end_date,
  amt monthly_charges, cast(1 + o_orderkey % 4 as int) num_products, o_orderkey % 5 < 2 has_addon,
  cast((o_orderkey % 6) * 5 as int) discount_pct,
  case when nd is null and o_orderstatus = 'F' then 'Churned' when nd is null then 'Active'
       when namt >= amt then 'Upgraded' else 'Downgraded' end status,
  case when nd is null and o_orderstatus = 'F' then d + 60 end churned_at
from (
  select *, cast(o_orderdate as date) d, cast(o_totalprice as decimal(12,2)) amt,
    lead(cast(o_orderdate as date)) over (partition by o_custkey order by o_orderdate, o_orderkey) nd,
    lead(cast(o_totalprice as decimal(12,2))) over (partition by o_custkey order by o_orderdate, o_orderkey) namt
  from orders)
"""
CTES["billing_events"] = f"""
select l_orderkey * 8 + l_linenumber event_id, {_cust('o_custkey')} customer_id, cast(l_shipdate as date) event_date,
  case when l_returnflag = 'N' then 'Payment' when l_returnflag = 'A' and l_linestatus = 'O' then 'Late Payment'
       when l_returnflag = 'A' then 'Writeoff' when l_linestatus = 'O' then 'Dispute' else 'Refund' end event_type,
  cast(l_extendedprice as decimal(12,2)) amount,
  case when l_returnflag = 'A' and l_linestatus = 'O' then cast(l_quantity as int) else 0 end days_overdue
from lineitem join orders on l_orderkey = o_orderkey
"""
CTES["product_usage"] = f"""
select any_value(o_custkey) * 100000 + datediff('day', DATE '1970-01-01', usage_date) usage_id, customer_id, usage_date, cast(count(*) as int) logins, cast(sum(l_quantity) as decimal(18,2)) session_minutes,
  cast(count(distinct l_partkey % 5) as int) features_used, 5 total_features, cast(sum(l_linenumber) as int) api_calls
from (
  select o_custkey, {_cust('o_custkey')} customer_id, l_quantity, l_partkey, l_linenumber,
    DATE '2001-08-01' - cast(floor(datediff('day', cast(l_shipdate as date), DATE '2001-11-04') / 8.0) as int) usage_date
  from lineitem join orders on l_orderkey = o_orderkey)
group by customer_id, usage_date
"""
CTES["support_tickets"] = f"""
select o_orderkey ticket_id, {_cust('o_custkey')} customer_id, o_orderdate opened_at,
  case when o_orderpriority = '1-URGENT' then 'Critical' when o_orderpriority = '2-HIGH' then 'High'
       when o_orderpriority = '3-MEDIUM' then 'Medium' else 'Low' end priority,
  case when o_orderkey % 4 = 0 then null else cast(1 + o_orderkey % 5 as int) end csat_score,
  cast((o_orderkey % 60) * 0.25 as decimal(6,2)) resolution_days
from orders
"""
CTES["nps_responses"] = f"""
select o_orderkey response_id, {_cust('o_custkey')} customer_id, cast(o_orderdate as date) survey_date,
  cast(((o_orderkey * 37) % 21 - 10) * 10 as int) nps_score
from orders where o_orderkey % 2 = 0
"""
CTES["churn_scores"] = """
select z.customer_id, z.score_id, z.scored_at, z.p churn_probability,
  case when p >= 0.70 then 'Critical' when p >= 0.50 then 'High' when p >= 0.30 then 'Medium' else 'Low' end risk_tier,
  cast(round(co.monthly_charges * p, 2) as decimal(12,2)) revenue_at_risk,
  d1 top_driver_1, d2 top_driver_2, d3 top_driver_3,
  case when p >= 0.7 then 'Immediate CSM outreach + retention offer within 48h'
       when p >= 0.5 then 'Schedule health check call within 1 week'
       when p >= 0.3 then 'Automated nurture sequence + feature adoption push'
       else 'Standard success cadence — monitor monthly' end recommended_action
from (
  select customer_id, c_custkey * 2 + k score_id,
    case when k = 0 then DATE '2001-07-01' else DATE '2001-08-01' end scored_at,
    cast(cast((c_custkey * 7919 + k * 104729) % 10001 as decimal(12,4)) / 10000 as decimal(6,4)) p,
    case c_custkey % 3 when 0 then 'feature_adoption_rate' when 1 then 'nps_score' else 'payment_delays_6m' end d1,
    case when c_custkey % 7 < 5 then 'usage_trend_30d' end d2,
    case when c_custkey % 7 < 2 then 'contract_type' end d3
  from customers cross join (select 0 k union all select 1 k) kk) z
join contracts co on co.customer_id = z.customer_id and co.status = 'Active'
"""
CTES["recovery_actions"] = """
select c_custkey action_id, cs.customer_id, cs.scored_at actioned_at,
  case cast(floor(c_custkey / 2.0) as int) % 4 when 0 then 'exec_outreach' when 1 then 'csm_call'
       when 2 then 'auto_email' else 'discount_offer' end intervention,
  case when c_custkey % 7 < 3 then 'saved' when c_custkey % 7 < 5 then 'lost' else 'pending' end outcome,
  case when c_custkey % 7 < 3 then co.monthly_charges else cast(0 as decimal(12,2)) end saved_mrr
from churn_scores cs
join customers c on c.customer_id = cs.customer_id
join contracts co on co.customer_id = cs.customer_id and co.status = 'Active'
where cs.scored_at = DATE '2001-08-01' and cs.risk_tier in ('Critical', 'High') and c_custkey % 2 = 0
"""

# ---------------------------------------------------------------- features
_KNOWN_END = f"""case when churned_at > {AS_OF} then null
  when status in ('Upgraded', 'Downgraded') and end_date > {AS_OF} then null else end_date end"""


def _tenure(pool: str, end: str) -> str:
    return f"""
select customer_id, {_months('acquisition_date', AS_OF)} tenure_months, contract_type, monthly_charges, num_products,
  cast(has_addon as int) has_addon, discount_pct,
  case when known_end <= {AS_OF} + 90 then 1 else 0 end renewal_due_90d,
  case when known_end <= {AS_OF} then 1 else 0 end renewal_overdue,
  industry, company_size, region, case when csm_owner is null then 0 else 1 end csm_assigned
from (
  select co.*, {end} known_end,
    row_number() over (partition by co.customer_id order by start_date desc, contract_id desc) nth
  from contracts co where start_date <= {AS_OF} {pool}) live
join customers using (customer_id)
where nth = 1"""


CTES["f_tenure"] = _tenure("and status = 'Active'", "end_date")
CTES["f_tenure_dates"] = _tenure("", _KNOWN_END) + f" and (churned_at is null or churned_at > {AS_OF})"
CTES["f_billing"] = f"""
select customer_id,
  sum(case when event_type = 'Late Payment' and event_date >= {_ago(180)} then 1 else 0 end)::bigint payment_delays_6m,
  sum(case when event_type = 'Dispute' and event_date >= {_ago(365)} then 1 else 0 end)::bigint disputes_12m,
  max(days_overdue) max_days_overdue,
  cast(sum(case when event_type = 'Payment' and event_date >= {_ago(90)} then amount end) as decimal(28,2)) total_paid_90d
from billing_events where event_date <= {AS_OF} group by customer_id
"""
_R30 = f"usage_date >= {_ago(30)}"
CTES["f_engagement"] = f"""
select customer_id, login_freq_30d, total_logins_30d, avg_session_min_30d, feature_adoption_30d, login_freq_90d,
  last_active_date, cast({AS_OF} - last_active_date as int) days_since_login,
  {_fixed('case when before > 0 then (login_freq_30d - before) / before else 0 end', 6)} usage_trend_pct
from (
  select customer_id, {_mean('logins', _R30)} login_freq_30d,
    sum(case when {_R30} then logins end)::bigint total_logins_30d,
    {_mean('session_minutes', _R30)} avg_session_min_30d,
    {_fixed(f"avg(case when {_R30} then case when total_features > 0 then features_used::double / total_features else 0 end end)", 6)} feature_adoption_30d,
    {_mean('logins')} login_freq_90d, max(usage_date) last_active_date,
    {_mean('logins', f'usage_date between {_ago(90)} and {_ago(61)}')} before
  from product_usage where usage_date between {_ago(90)} and {AS_OF} group by customer_id)
"""
CTES["f_support"] = f"""
select customer_id, sum((day >= {_ago(90)})::int)::bigint tickets_90d,
  sum((day >= {_ago(90)} and priority in ('High', 'Critical'))::int)::bigint critical_tickets_90d,
  {_mean('resolution_days')} avg_resolution_days, {_mean('csat_score')} avg_csat, max(csat_score) max_csat,
  max(case when nth = 1 then csat_score end) last_csat,
  sum((day >= {_ago(180)} and coalesce(csat_score, 9) <= 2)::int)::bigint low_csat_tickets_6m
from (
  select *, cast(opened_at as date) as day, row_number() over (
    partition by customer_id order by csat_score is null, opened_at desc, ticket_id desc) nth
  from support_tickets where cast(opened_at as date) between {_ago(365)} and {AS_OF})
group by customer_id
"""
CTES["f_nps"] = f"""
select customer_id, nps_score, survey_date, cast({AS_OF} - survey_date as int) days_since_nps
from (
  select *, row_number() over (partition by customer_id order by survey_date desc nulls last, response_id desc) nth
  from nps_responses where survey_date is null or survey_date <= {AS_OF})
where nth = 1
"""


def _revenue(current: str, until: str) -> str:
    return f"""
select customer_id,
  cast(sum(case when {current} then monthly_charges else 0 end) as decimal(28,2)) current_mrr,
  cast(sum(monthly_charges * {_months('start_date', until)}) as decimal(28,2)) total_lifetime_revenue,
  count(distinct contract_id) num_contracts,
  cast(max(monthly_charges) - min(monthly_charges) as decimal(28,2)) mrr_expansion,
  cast(max(case when newest = 1 then monthly_charges end) - max(case when oldest = 1 then monthly_charges end)
    as decimal(28,2)) mrr_delta
from (
  select *, row_number() over (partition by customer_id order by start_date desc, contract_id desc) newest,
    row_number() over (partition by customer_id order by start_date, contract_id) oldest
  from contracts where start_date <= {AS_OF})
group by customer_id"""


def _in_force(day: str) -> str:
    return f"(start_date <= {day} and (status = 'Active' or end_date is null or end_date > {day}))"


CTES["f_revenue"] = _revenue("status = 'Active'", f"coalesce(end_date, {AS_OF})")
CTES["f_revenue_dates"] = _revenue(_in_force(AS_OF), f"least(coalesce({_KNOWN_END}, {AS_OF}), {AS_OF})")

_PARTS = {
    "recency_risk": "least(coalesce(days_since_login, 90) / 30.0::double, 3) / 3",
    "payment_risk": "least(coalesce(payment_delays_6m, 0) * 0.3::double, 1)",
    "support_risk": "least(coalesce(tickets_90d, 0) * coalesce(avg_resolution_days, 1) / 50, 1)",
    "sentiment_risk": "coalesce((1 - nps_score / 100.0::double) / 2, 0.5)",
}
_SIGNALS = """left join f_billing using (customer_id) left join f_engagement using (customer_id)
left join f_support using (customer_id) left join f_nps using (customer_id)"""
CTES["f_risk"] = f"""
select customer_id, {', '.join(f'{_fixed(v, 6)} {k}' for k, v in _PARTS.items())}
from f_tenure {_SIGNALS}
"""


def _final(tenure: str, revenue: str) -> str:
    return f"""
select customer_id, tenure_months, contract_type, monthly_charges, num_products, has_addon, discount_pct,
  renewal_due_90d, industry, company_size, region, csm_assigned,
  coalesce(payment_delays_6m, 0) payment_delays_6m, coalesce(disputes_12m, 0) disputes_12m,
  coalesce(max_days_overdue, 0) max_days_overdue, coalesce(login_freq_30d, 0) login_frequency_30d,
  coalesce(feature_adoption_30d, 0) feature_adoption_rate, coalesce(avg_session_min_30d, 0) avg_session_minutes,
  coalesce(days_since_login, 90) last_login_days_ago, coalesce(usage_trend_pct, -0.5::double) usage_trend_30d,
  coalesce(tickets_90d, 0) num_support_tickets, coalesce(avg_resolution_days, 0) avg_resolution_days,
  coalesce(avg_csat, 3) csat_score, coalesce(low_csat_tickets_6m, 0) low_csat_tickets_6m,
  coalesce(nps_score, 0) nps_score, coalesce(days_since_nps, 365) days_since_nps,
  coalesce(total_lifetime_revenue, cast(0 as decimal(28,2))) total_revenue,
  coalesce(mrr_expansion, cast(0 as decimal(28,2))) mrr_expansion,
  {_fixed(f"({' + '.join(f'({v}) * 0.25::double' for v in _PARTS.values())})", 4)} composite_risk_score
from {tenure} {_SIGNALS} left join {revenue} using (customer_id)"""


CTES["f_final"] = _final("f_tenure", "f_revenue")
CTES["f_final_dates"] = _final("f_tenure_dates", "f_revenue_dates")
CTES["f_commercial"] = f"""
select customer_id, {_fixed('coalesce(cast(mrr_now - mrr_then as double) / nullif(cast(mrr_then as double), 0), 0)', 6)} mrr_trend_90d,
  cast(least(ups, 5) as int) expansion_events,
  {_fixed('least(coalesce(session_min / nullif(p95, 0), 0), 1)', 6)} session_depth_score
from (
  select customer_id, sum(case when {_in_force(AS_OF)} then monthly_charges else 0 end) mrr_now,
    sum(case when {_in_force(_ago(90))} then monthly_charges else 0 end) mrr_then,
    sum((status = 'Upgraded' and end_date <= {AS_OF})::int) ups
  from contracts where start_date <= {AS_OF} group by customer_id)
left join (select customer_id, {_fixed('avg_session_min_30d', 6)} session_min from f_engagement) using (customer_id)
cross join (select quantile_cont({_fixed('avg_session_min_30d', 6)}, 0.95) p95 from f_engagement)
"""
CTES["frame"] = f"""
select customer_id, contract_type, industry, company_size, tenure_months, monthly_charges, total_revenue, num_products,
  has_addon, payment_delays_6m, discount_pct, login_frequency_30d, feature_adoption_rate, session_depth_score,
  last_login_days_ago, num_support_tickets, avg_resolution_days, csat_score, nps_score, csm_assigned,
  expansion_events, mrr_trend_90d, usage_trend_30d, case when gone.customer_id is null then 0 else 1 end churn_label
from f_final_dates left join f_commercial using (customer_id)
left join (select distinct customer_id from contracts where churned_at > {AS_OF} and churned_at <= {AS_OF} + 90) gone
  using (customer_id)
"""

ORACLES: dict[str, str] = {
    "feat_tenure": statement("select * from f_tenure"),
    "feat_billing": statement("select * from f_billing"),
    "feat_engagement": statement("select * from f_engagement"),
    "feat_support": statement("select * from f_support"),
    "feat_nps": statement("select * from f_nps"),
    "feat_revenue": statement("select * from f_revenue"),
    "feat_risk": statement("select * from f_risk"),
    "feat_final": statement("select * from f_final"),
    "feat_commercial": statement("select * from f_commercial"),
    "training_set": statement("select * from frame"),
}

# ---------------------------------------------------------------- sources and quality
_PROFILED = ["customers", "contracts", "billing_events", "product_usage", "support_tickets", "nps_responses",
             "churn_scores", "recovery_actions"]
ORACLES["load_tables"] = statement("\nunion all ".join(
    f"select '{t}' table_name, count(*) as rows, count(distinct customer_id) customers from {t}" for t in _PROFILED))

_NOT_NULL = {
    "customers": ["customer_id", "company_name", "acquisition_date"],
    "contracts": ["contract_id", "start_date", "monthly_charges", "customer_id"],
    "billing_events": ["event_id", "event_date", "customer_id"],
    "product_usage": ["usage_id", "usage_date", "customer_id"],
    "support_tickets": ["ticket_id", "opened_at", "customer_id"],
}
ORACLES["dq_not_null"] = statement("\nunion all ".join(
    f"select '{t}' table_name, '{c}' column_name, count(*) - count({c}) violations from {t}"
    for t, columns in _NOT_NULL.items() for c in columns))

_DOMAINS = {
    ("customers", "company_size"): "'SMB', 'Mid-Market', 'Enterprise'",
    ("contracts", "contract_type"): "'Monthly', 'Annual', 'Multi-year'",
    ("contracts", "status"): "'Active', 'Churned', 'Upgraded', 'Downgraded'",
    ("billing_events", "event_type"): "'Payment', 'Late Payment', 'Refund', 'Dispute', 'Writeoff'",
    ("support_tickets", "priority"): "'Low', 'Medium', 'High', 'Critical'",
    ("churn_scores", "risk_tier"): "'Critical', 'High', 'Medium', 'Low'",
}
ORACLES["dq_domain"] = statement("\nunion all ".join(
    f"select '{t}' table_name, '{c}' column_name, {c} as value, count(*) as rows, coalesce({c} in ({d}), true) allowed "
    f"from {t} group by {c}" for (t, c), d in _DOMAINS.items()))

_RANGES = {("support_tickets", "csat_score"): (1, 5), ("nps_responses", "nps_score"): (-100, 100),
           ("churn_scores", "churn_probability"): (0, 1)}
ORACLES["dq_range"] = statement("\nunion all ".join(
    f"select '{t}' table_name, '{c}' column_name, min({c})::double lowest, max({c})::double highest, "
    f"count(*) filter ({c} < {lo} or {c} > {hi}) violations from {t}" for (t, c), (lo, hi) in _RANGES.items()))

_KEYS = [("customers", "customer_id"), ("contracts", "contract_id"), ("support_tickets", "ticket_id"),
         ("nps_responses", "response_id"), ("churn_scores", "score_id"), ("billing_events", "event_id"),
         ("product_usage", "usage_id"), ("product_usage", "customer_id, usage_date")]
ORACLES["dq_primary_key"] = statement("\nunion all ".join(
    f"select '{t}' table_name, '{k}' key_columns, count(*) as keys, count(*) filter (n > 1) duplicated_keys, "
    f"(sum(n) - count(*))::bigint surplus_rows from (select {k}, count(*) n from {t} group by {k})"
    for t, k in _KEYS))

_CHILDREN = ["contracts", "billing_events", "product_usage", "support_tickets", "nps_responses", "churn_scores"]
ORACLES["dq_foreign_key"] = statement("\nunion all ".join(
    f"select '{t}' table_name, count(distinct customer_id) orphan_customers, count(*) orphan_rows from {t} "
    "where customer_id not in (select customer_id from customers)" for t in _CHILDREN))

ORACLES["dq_single_active"] = statement("""
select customer_id, count(*) filter (status = 'Active') active_contracts, count(*) contracts from contracts
group by customer_id having count(*) filter (status = 'Active') <> 1
""")

# ---------------------------------------------------------------- cohorts and survival
CTES["c_sizes"] = f"""
select cast(date_trunc('month', acquisition_date) as date) cohort_month, count(*) cohort_size
from customers where acquisition_date <= {AS_OF} group by 1
"""
CTES["c_retention"] = f"""
select cohort_month, cohort_size, period_number, retained_customers,
  {_fixed('retained_customers::double / cohort_size * 100', 1)} retention_rate_pct
from (
  select cast(date_trunc('month', acquisition_date) as date) cohort_month,
    cast(datediff('month', acquisition_date, event_date) as int) period_number,
    count(distinct customer_id) retained_customers
  from billing_events join customers using (customer_id)
  where event_type = 'Payment' and event_date <= {AS_OF} group by 1, 2)
join c_sizes using (cohort_month)
where period_number >= 0
"""
ORACLES["cohort_retention"] = statement("select * from c_retention")
_CELLS = ", ".join(
    f"case when cast(cohort_month + interval {p} month as date) <= date_trunc('month', {AS_OF}) "
    f"then coalesce(max(retention_rate_pct) filter (period_number = {p}), 0) end m{p}" for p in range(12))
ORACLES["cohort_grid"] = statement(f"""
select cohort_month, s.cohort_size, {_CELLS}
from c_sizes s left join c_retention r using (cohort_month) group by cohort_month, s.cohort_size
""")
CTES["km"] = f"""
select company_size, t, events, at_risk, {_fixed('''case when max((events = at_risk)::int) over upto = 1 then 0
    else exp(sum(case when events < at_risk then ln(1 - events::double / at_risk) else 0 end) over upto) end''', 6)} survival
from (
  select company_size, t, events, sum(leaving) over (
    partition by company_size order by t desc rows unbounded preceding)::bigint at_risk
  from (
    select company_size, t, sum(gone)::bigint events, count(*) leaving
    from (
      select company_size, coalesce(churned_at <= {AS_OF}, false)::int gone,
        {_months('acquisition_date', f'(case when churned_at <= {AS_OF} then churned_at else {AS_OF} end)')} t
      from (select *, row_number() over (partition by customer_id order by start_date desc, contract_id desc) nth
            from contracts where start_date <= {AS_OF})
      join customers using (customer_id) where nth = 1)
    group by company_size, t))
window upto as (partition by company_size order by t rows unbounded preceding)
"""
ORACLES["km_survival"] = statement("select * from km")
ORACLES["km_median"] = statement("""
select company_size, min(t) filter (survival <= 0.5) median_months, max(at_risk) customers, sum(events)::bigint events
from km group by company_size
""")

# ---------------------------------------------------------------- revenue at risk, KPIs
CTES["latest"] = """
select * exclude (nth) from (
  select *, row_number() over (partition by customer_id order by scored_at desc, score_id desc) nth from churn_scores)
where nth = 1
"""
CTES["exposure"] = """
select l.*, co.monthly_charges, co.contract_type, cu.company_name, cu.industry, cu.company_size, cu.csm_owner
from latest l join contracts co on co.customer_id = l.customer_id and co.status = 'Active'
join customers cu on cu.customer_id = l.customer_id
"""
_MEASURES = f"""count(*) customers, {_fixed(_mean('churn_probability'), 3)} avg_churn_prob,
  round(sum(monthly_charges), 0)::bigint total_mrr,
  round(sum(monthly_charges * churn_probability), 0)::bigint expected_monthly_loss,
  round(sum(12 * monthly_charges * churn_probability), 0)::bigint expected_annual_loss,
  round(sum(12 * monthly_charges), 0)::bigint total_acv"""
ORACLES["latest_scores"] = statement("select * from latest")
ORACLES["revenue_at_risk"] = statement(
    f"select risk_tier, industry, company_size, {_MEASURES} from exposure group by all")
ORACLES["risk_rollup"] = statement(f"""
select 'tier_industry' as level, risk_tier, industry, {_MEASURES} from exposure group by risk_tier, industry
union all select 'tier', risk_tier, null, {_MEASURES} from exposure group by risk_tier
union all select 'total', null, null, {_MEASURES} from exposure
""")
ORACLES["churn_trend_as_written"] = statement(f"""
select s.month, customers_active, coalesce(churned, 0) churned_count,
  cast(coalesce(lost, 0) as decimal(28,2)) churned_mrr,
  {_fixed('coalesce(churned, 0)::double / customers_active * 100', 2)} monthly_churn_rate_pct
from (select cast(date_trunc('month', start_date) as date) as month, count(*) customers_active from contracts
      where status in ('Active', 'Churned') and start_date <= {AS_OF} group by 1) s
left join (select cast(date_trunc('month', churned_at) as date) as month, count(*) churned, sum(monthly_charges) lost
      from contracts where status = 'Churned' and churned_at <= {AS_OF} group by 1) c on c.month = s.month
where s.month >= {AS_OF} - interval 24 month
""")
CTES["months"] = f"""
select cast(unnest(generate_series(
  (select date_trunc('month', min(start_date)) from contracts), date_trunc('month', {AS_OF}), interval 1 month)) as date) as month
"""
# stated the slow way, as a join of months and intervals, to check the running sums
CTES["monthly"] = f"""
select month, active_at_start, coalesce(churned, 0)::bigint churned, cast(coalesce(lost, 0) as decimal(28,2)) churned_mrr,
  {_fixed('coalesce(churned, 0)::double / nullif(active_at_start, 0) * 100', 4)} churn_rate_pct
from (
  select month, count(contract_id) active_at_start
  from months left join contracts on {_in_force('month')} and start_date <= {AS_OF} group by month)
left join (select cast(date_trunc('month', churned_at) as date) as month, count(*) churned, sum(monthly_charges) lost
  from contracts where status = 'Churned' and churned_at <= {AS_OF} group by 1) using (month)
where month >= (select min(case when day(start_date) = 1 then start_date
  else cast(date_trunc('month', start_date) + interval 1 month as date) end) from contracts)
"""
ORACLES["churn_rate_monthly"] = statement("select * from monthly")
ORACLES["churn_forecast"] = statement(f"""
select cast(date_trunc('month', {AS_OF}) + to_months(step - 1) as date) as month, {_fixed('mid', 4)} forecast_pct,
  {_fixed('mid - 1.96 * sd', 4)} lower_pct, {_fixed('mid + 1.96 * sd', 4)} upper_pct,
  {_fixed('mid', 4)} > 2.5 above_target
from (
  select unnest([1, 2, 3]) step, base + slope * (24 + step) mid, sd
  from (
    select regr_slope(y, x) slope, regr_intercept(y, x) base,
      sqrt(greatest(regr_syy(y, x) - regr_slope(y, x) * regr_sxy(y, x), 0) / (count(*) - 2)) sd
    from (select churn_rate_pct y, 1.0::double + datediff('month', {AS_OF} - interval 24 month, month) x from monthly
          where month >= date_trunc('month', {AS_OF}) - interval 24 month and month < date_trunc('month', {AS_OF}))))
""")
ORACLES["top_accounts"] = statement("""
select customer_id, company_name, industry, company_size, csm_owner, contract_type, monthly_charges, churn_probability,
  risk_tier, revenue_at_risk, top_driver_1, top_driver_2, recommended_action
from exposure where risk_tier in ('Critical', 'High') order by revenue_at_risk desc, customer_id limit 50
""")
ORACLES["driver_frequency"] = statement(f"""
select driver, count(*) customer_count, {_fixed(_mean('churn_probability'), 3)} avg_churn_prob,
  round(sum(revenue_at_risk), 0)::bigint total_revenue_at_risk
from (select unnest([top_driver_1, top_driver_2, top_driver_3]) driver, churn_probability, revenue_at_risk from latest)
where driver is not null group by driver
""")
ORACLES["kpi_tiles"] = statement(f"""
select count(*) total_customers, cast(sum(revenue_at_risk) as decimal(28,2)) revenue_at_risk,
  {_fixed(_mean('churn_probability'), 4)} avg_churn_probability,
  (select churn_rate_pct from monthly where month = {AS_OF} - interval 1 month) monthly_churn_rate_pct,
  (select {_fixed("count(*) filter (outcome = 'saved')::double / count(*)", 4)} from recovery_actions) recovery_rate
from latest
""")
ORACLES["tier_distribution"] = statement(f"""
select risk_tier, count(*) customers, {_fixed('count(*)::double / (select count(*) from latest) * 100', 2)} share_pct
from latest group by risk_tier
""")
_WATERFALL = ["new", "expansion", "contraction", "churn"]
ORACLES["mrr_waterfall"] = statement(f"""
select month, cast(sum(new + expansion + contraction + churn) over (order by month) - new - expansion - contraction - churn
    as decimal(28,2)) opening, new, expansion, contraction, churn,
  cast(sum(new + expansion + contraction + churn) over (order by month) as decimal(28,2)) closing
from (
  select month, {', '.join(f"cast(coalesce(sum(amount) filter (kind = '{k}'), 0) as decimal(28,2)) {k}" for k in _WATERFALL)}
  from months left join (
    select cast(date_trunc('month', start_date) as date) as month,
      case when prior is null or prior_status = 'Churned' then 'new'
           when monthly_charges > prior then 'expansion' else 'contraction' end kind,
      case when prior is null or prior_status = 'Churned' then monthly_charges else monthly_charges - prior end amount
    from (select *, lag(monthly_charges) over w prior, lag(status) over w prior_status from contracts
          window w as (partition by customer_id order by start_date, contract_id))
    where start_date <= {AS_OF}
    union all
    select cast(date_trunc('month', churned_at) as date), 'churn', -monthly_charges from contracts
    where status = 'Churned' and churned_at <= {AS_OF}) using (month)
  group by month)
""")
ORACLES["risk_register"] = statement("""
select customer_id, company_name, company_size, industry, contract_type, monthly_charges, churn_probability, risk_tier,
  revenue_at_risk, case when churn_probability >= 0.7 then 'red' when churn_probability >= 0.5 then 'orange'
    when churn_probability >= 0.3 then 'yellow' else 'green' end colour_band,
  revenue_at_risk::double >= (select quantile_cont(revenue_at_risk::double, 0.9) from latest) top_decile
from exposure
""")
ORACLES["probability_histogram"] = statement("""
select cast(bin as int) bin, bin / 20.0::double low, (bin + 1) / 20.0::double high, count(customer_id) customers
from (select unnest(range(20)) bin)
left join (select customer_id, least(cast(floor(churn_probability * 20) as int), 19) bin from latest) using (bin)
group by bin
""")
_PIVOT = ", ".join(
    f"cast(sum(monthly_charges) filter (company_size = '{s}') as decimal(28,2)) {n}_mrr, "
    f"{_fixed(_mean('churn_probability', f'company_size = {chr(39)}{s}{chr(39)}'), 4)} {n}_avg_prob, "
    f"cast(sum(revenue_at_risk) filter (company_size = '{s}') as decimal(28,2)) {n}_revenue"
    for s, n in (("SMB", "smb"), ("Mid-Market", "mid_market"), ("Enterprise", "enterprise")))
ORACLES["register_pivot"] = statement(f"select company_name, {_PIVOT} from exposure group by company_name")
ORACLES["churn_by_contract"] = statement(f"""
select contract_type, count(*) customers, sum(churn_label)::bigint churned,
  {_fixed(_mean('churn_label') + ' * 100', 2)} churn_rate_pct from frame group by contract_type
""")

# ---------------------------------------------------------------- recovery
ORACLES["action_queue"] = statement("""
select row_number() over (order by revenue_at_risk desc, customer_id)::int priority, *
from (
  select customer_id, company_name, csm_owner, churn_probability, revenue_at_risk, top_driver_1
  from latest join customers using (customer_id)
  where risk_tier = 'Critical' and customer_id not in (select customer_id from recovery_actions where outcome = 'pending')
  order by revenue_at_risk desc, customer_id limit 100)
""")
_SAVED = "count(*) filter (outcome = 'saved')"
ORACLES["recovery_kpis"] = statement(f"""
select (select count(*) from latest where risk_tier in ('Critical', 'High')) needing_action, count(*) actions_taken,
  {_SAVED} saves, cast(sum(saved_mrr) filter (outcome = 'saved') as decimal(28,2)) revenue_saved,
  {_fixed(f'{_SAVED}::double / count(*)', 4)} recovery_rate
from recovery_actions
""")
ORACLES["save_rate_by_intervention"] = statement(f"""
select intervention, count(*) actions, count(*) filter (outcome <> 'pending') closed, {_SAVED} saves,
  {_fixed(f"{_SAVED}::double / nullif(count(*) filter (outcome <> 'pending'), 0)", 4)} save_rate,
  cast(sum(saved_mrr) as decimal(28,2)) saved_mrr
from recovery_actions group by intervention
""")
ORACLES["recovery_scenario"] = statement("""
select rate::double recovery_rate, customers, monthly_at_risk,
  cast(round(12 * monthly_at_risk * rate, 2) as decimal(28,2)) protected_annual
from (select count(*) customers, cast(sum(revenue_at_risk) as decimal(28,2)) monthly_at_risk,
        unnest([0.10::decimal(5,4), 0.25::decimal(5,4), 0.50::decimal(5,4)]) rate
      from latest where risk_tier in ('Critical', 'High'))
""")

# ---------------------------------------------------------------- feature engineering
_INTERACTIONS = {
    "support_per_tenure": "num_support_tickets::double / (tenure_months + 1)",
    "revenue_per_month": "monthly_charges::double",
    "revenue_per_product": "monthly_charges::double / nullif(num_products, 0)",
    "engagement_score": "0.4::double * login_frequency_30d + 10.5::double * feature_adoption_rate + 7.5::double * session_depth_score",
}
_RAW = {
    "recency_risk": "greatest(least(last_login_days_ago / 30.0::double, 3), 0)",
    "payment_risk": "case payment_delays_6m when 0 then 0 when 1 then 0.3::double when 2 then 0.6::double "
                    "when 3 then 0.9::double when 4 then 1.2::double end",
    "support_risk": "greatest(least(num_support_tickets * avg_resolution_days / 10, 5), 0)",
    "sentiment_risk": "(1 - nps_score / 100.0::double) / 2",
}
_RAW_ALL = {**_RAW, "composite_risk_score": _fixed(f"({' + '.join(f'({v}) / 4' for v in _RAW.values())})", 4)}
_FLAGS = {
    "flag_low_engagement": "login_frequency_30d < 3", "flag_payment_issues": "payment_delays_6m >= 2",
    "flag_high_support": "num_support_tickets >= 5", "flag_low_nps": "nps_score < 0",
    "flag_declining_mrr": "mrr_trend_90d < -0.05::double", "flag_low_adoption": "feature_adoption_rate < 0.25::double",
}
_FLAGS_ALL = {k: f"({v})::int" for k, v in _FLAGS.items()}
_FLAGS_ALL["total_risk_flags"] = " + ".join(f"({v})::int" for v in _FLAGS.values())
_HOT = {
    f"{c}_{v}": f"({c} = '{v}')::int" for c, values in {
        "contract_type": ["Monthly", "Annual", "Multi-year"],
        "industry": ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"],
        "company_size": ["SMB", "Mid-Market", "Enterprise"]}.items() for v in values
}
_NUMERIC = [
    "tenure_months", "monthly_charges", "total_revenue", "num_products", "has_addon", "payment_delays_6m", "discount_pct",
    "login_frequency_30d", "feature_adoption_rate", "session_depth_score", "last_login_days_ago", "num_support_tickets",
    "avg_resolution_days", "csat_score", "nps_score", "csm_assigned", "expansion_events", "mrr_trend_90d",
    "usage_trend_30d",
]


def _list(columns: dict[str, str], digits: int | None = None) -> str:
    return ", ".join(f'{v if digits is None else _fixed(v, digits)} "{k}"' for k, v in columns.items())


ORACLES["fe_interactions"] = statement(f"select customer_id, {_list(_INTERACTIONS, 6)} from frame")
ORACLES["fe_risk_raw"] = statement(f"select customer_id, {_list(_RAW_ALL, 6)} from frame")
ORACLES["fe_tenure_bucket"] = statement("""
select customer_id, tenure_months, case when tenure_months between 1 and 6 then '0-6m'
  when tenure_months between 7 and 12 then '6-12m' when tenure_months between 13 and 24 then '12-24m'
  when tenure_months between 25 and 48 then '24-48m' when tenure_months between 49 and 9999 then '48m+' end tenure_bucket
from frame
""")
ORACLES["fe_flags"] = statement(f"select customer_id, {_list(_FLAGS_ALL)} from frame")
ORACLES["fe_onehot"] = statement(f"select customer_id, {_list(_HOT)} from frame")
_MATRIX = {**{c: c for c in _NUMERIC}, **_INTERACTIONS, **_RAW_ALL, **_FLAGS_ALL, **_HOT}
ORACLES["fe_matrix"] = statement(f"select customer_id, {_list(_MATRIX, 6)}, churn_label from frame")

_TERMS = {
    "contract_monthly": "1.2::double * (contract_type = 'Monthly')::int",
    "contract_multi_year": "-0.9::double * (contract_type = 'Multi-year')::int",
    "num_support_tickets": "0.08::double * num_support_tickets",
    "payment_delays_6m": "0.12::double * payment_delays_6m",
    "login_frequency_30d": "-0.1::double * login_frequency_30d",
    "feature_adoption_rate": "-1.8::double * feature_adoption_rate",
    "nps_score": "-0.015::double * nps_score",
    "tenure_capped": "-0.08::double * (greatest(least(tenure_months, 24), 0) / 24.0::double)",
    "last_login_months": "0.15::double * (last_login_days_ago / 30.0::double)",
    "csm_assigned": "-0.25::double * csm_assigned",
    "mrr_trend_90d": "-1.2::double * mrr_trend_90d",
}
CTES["card"] = f"""
select customer_id, 1 / (1 + exp(-(-2.5::double + {' + '.join(_TERMS.values())}))) raw, churn_label from frame
"""
ORACLES["scorecard"] = statement(f"select customer_id, {_fixed('raw', 6)} probability, churn_label from card")

# ---------------------------------------------------------------- exploration
ORACLES["churn_overview"] = statement(f"""
select churn_label, count(*) customers, {_fixed('count(*)::double / (select count(*) from frame) * 100', 2)} share_pct,
  cast(sum(monthly_charges) as decimal(28,2)) monthly_revenue
from frame group by churn_label
""")
ORACLES["revenue_lost_by_size"] = statement("""
select company_size, count(*) churned, cast(round(sum(monthly_charges) / 1000, 2) as decimal(28,2)) revenue_lost_thousands
from frame where churn_label = 1 group by company_size
""")
_DRIVERS = ["login_frequency_30d", "feature_adoption_rate", "nps_score", "num_support_tickets", "payment_delays_6m",
            "mrr_trend_90d"]
CTES["long_drivers"] = "\nunion all ".join(
    f"select '{c}' feature, churn_label, {c}::double as value from frame" for c in _DRIVERS)


def _histogram(source: str, keys: str, bins: int) -> str:
    by = keys.split(", ")
    same = " and ".join(f"e.{k} = r.{k}" for k in by)
    return f"""
select {', '.join(f'e.{k}' for k in by)}, e.bin, {_fixed('any_value(low) + e.bin * any_value(width)', 6)} bin_start,
  count(r.value) customers, {_fixed('count(r.value) / (any_value(total) * any_value(width))', 6)} density
from (
  select {keys}, total, cast(unnest(range({bins})) as int) bin, case when lo = hi then lo - 0.5 else lo end low,
    case when lo = hi then 1.0::double / {bins} else (hi - lo) / {bins} end width
  from (select {keys}, min(value) lo, max(value) hi, count(*) total from {source} group by {keys})) e
left join {source} r on {same} and least(cast(floor((r.value - low) / width) as int), {bins - 1}) = e.bin
group by {', '.join(f'e.{k}' for k in by)}, e.bin"""


ORACLES["class_histogram"] = statement(_histogram("long_drivers", "feature, churn_label", 40))
ORACLES["class_means"] = statement(
    f"select feature, churn_label, {_fixed('avg(value)', 6)} mean from long_drivers group by feature, churn_label")
CTES["u_test"] = """
select feature, n_retained, n_churned, rank_sum - n_retained::double * (n_retained + 1) / 2 u, tie_term,
  n_retained::double * n_churned mm, n_retained + n_churned::double n
from (
  select feature, count(*) filter (churn_label = 0) n_retained, count(*) filter (churn_label = 1) n_churned,
    sum(case when churn_label = 0 then mid_rank end) rank_sum, sum(ties * ties - 1) tie_term
  from (select feature, churn_label, count(*) over (partition by feature, value)::double ties,
          rank() over (partition by feature order by value) + (count(*) over (partition by feature, value) - 1) / 2.0::double mid_rank
        from long_drivers)
  group by feature)
"""
_Z = _fixed("(greatest(u, mm - u) - mm / 2 - 0.5) / nullif(sqrt(mm / 12 * (n + 1 - tie_term / (n * (n - 1)))), 0)", 6)
_SIMPSON = """list_sum(list_transform(range(1201), lambda i:
  (case when i in (0, 1200) then 1 when i % 2 = 1 then 4 else 2 end)::double
  * exp(-greatest(z, 0) * (i * 0.01::double) - (i * 0.01::double) * (i * 0.01::double) / 2)))"""
ORACLES["mann_whitney"] = statement(f"""
select feature, n_retained, n_churned, u, tie_term, z, p_value,
  case when p_value < 0.001 then '***' when p_value < 0.01 then '**' when p_value < 0.05 then '*' else 'ns' end stars
from (
  select *, {_fixed(f"least(exp(-greatest(z, 0) * greatest(z, 0) / 2) * {_SIMPSON} * (0.01::double / 3) * 2 / sqrt(2 * pi()), 1)", 6)} p_value
  from (select *, {_Z} z from u_test))
""")
_CORRELATED = ["tenure_months", "monthly_charges", "login_frequency_30d", "feature_adoption_rate", "num_support_tickets",
               "avg_resolution_days", "nps_score", "payment_delays_6m", "mrr_trend_90d", "session_depth_score",
               "last_login_days_ago", "churn_label"]
ORACLES["correlation_matrix"] = statement("\nunion all ".join(
    f"select '{a}' feature_a, '{b}' feature_b, {_fixed(f'corr({a}::double, {b}::double)', 6)} pearson from frame"
    for i, a in enumerate(_CORRELATED) for b in _CORRELATED[:i]))
ORACLES["driver_lift"] = statement("\nunion all ".join(f"""
select '{c}' driver, {t}::double threshold, count(*) filter ({c} < {t}) customers_below,
  {_fixed(_mean('churn_label', f'{c} < {t}'), 6)} churn_rate_below, {_fixed(_mean('churn_label', f'{c} >= {t}'), 6)} churn_rate_above,
  {_fixed(f"({_mean('churn_label', f'{c} < {t}')}) / nullif({_mean('churn_label', f'{c} >= {t}')}, 0)", 4)} lift
from frame""" for c, t in (("feature_adoption_rate", "0.25"), ("login_frequency_30d", "3.0"))))
_HIT = "payment_delays_6m >= 2"
ORACLES["rule_accuracy"] = statement(f"""
select count(*) filter ({_HIT}) flagged, count(*) filter ({_HIT} and churn_label = 1) true_positives,
  {_fixed(f'count(*) filter (({_HIT}) = (churn_label = 1))::double / count(*)', 6)} accuracy,
  {_fixed(f'count(*) filter ({_HIT} and churn_label = 1)::double / nullif(count(*) filter ({_HIT}), 0)', 6)} as precision,
  {_fixed(f'count(*) filter ({_HIT} and churn_label = 1)::double / nullif(sum(churn_label), 0)', 6)} recall
from frame
""")
ORACLES["nps_slope"] = statement(
    f"select count(*) customers, {_fixed('regr_slope(churn_label::double, nps_score::double) * 1000', 6)} points_per_10_nps from frame")

# ---------------------------------------------------------------- evaluation of the scorecard
CTES["scored"] = "select 'scorecard' model, customer_id, churn_label, raw probability from card"
ORACLES["auc_roc"] = statement(f"""
select model, {_fixed("(sum(case when churn_label = 1 then mid_rank end) - pos * (pos + 1) / 2) / (pos * neg)", 6)} auc_roc
from (
  select *, rank() over (partition by model order by probability)
      + (count(*) over (partition by model, probability) - 1) / 2.0::double mid_rank,
    sum(churn_label) over (partition by model)::double pos, sum(1 - churn_label) over (partition by model)::double neg
  from scored)
group by model, pos, neg
""")
ORACLES["brier"] = statement(
    f"select model, {_fixed('avg((probability - churn_label) * (probability - churn_label))', 6)} brier from scored group by model")
CTES["cells"] = """
select model, count(*) filter (probability >= 0.5 and churn_label = 1) tp, count(*) filter (probability >= 0.5 and churn_label = 0) fp,
  count(*) filter (probability < 0.5 and churn_label = 1) fn, count(*) filter (probability < 0.5 and churn_label = 0) tn
from scored group by model
"""
ORACLES["confusion_matrix"] = statement("""
select model, 0 actual, 0 predicted, tn customers from cells union all select model, 0, 1, fp from cells
union all select model, 1, 0, fn from cells union all select model, 1, 1, tp from cells
""")


def _safe(a: str, b: str) -> str:
    return f"coalesce(({a})::double / nullif({b}, 0), 0)"


_CLASS = {"0": (_safe("tn", "tn + fn"), _safe("tn", "tn + fp"), _safe("2 * tn", "2 * tn + fn + fp")),
          "1": (_safe("tp", "tp + fp"), _safe("tp", "tp + fn"), _safe("2 * tp", "2 * tp + fp + fn"))}
_ACC = _safe("tp + tn", "tp + tn + fp + fn")
_REPORT = {
    "0": (*_CLASS["0"], "tn + fp"), "1": (*_CLASS["1"], "tp + fn"), "accuracy": (_ACC, _ACC, _ACC, "tp + tn + fp + fn"),
    "macro avg": (*[f"({a} + {b}) / 2" for a, b in zip(_CLASS["0"], _CLASS["1"])], "tp + tn + fp + fn"),
    "weighted avg": (*[f"({a} * (tn + fp) + {b} * (tp + fn)) / (tp + tn + fp + fn)"
                       for a, b in zip(_CLASS["0"], _CLASS["1"])], "tp + tn + fp + fn"),
}
ORACLES["classification_report"] = statement("\nunion all ".join(
    f"select model, '{k}' as label, {_fixed(p, 6)} as precision, {_fixed(r, 6)} recall, {_fixed(f, 6)} f1, {s} support from cells"
    for k, (p, r, f, s) in _REPORT.items()))
CTES["steps"] = """
select model, threshold, sum(pos) over (partition by model order by threshold desc)::double tp,
  sum(neg) over (partition by model order by threshold desc)::double fp,
  sum(pos) over (partition by model) positives, sum(neg) over (partition by model) negatives
from (select model, probability threshold, sum(churn_label) pos, sum(1 - churn_label) neg from scored group by 1, 2)
"""
ORACLES["roc_curve"] = statement(f"""
select model, {_fixed('threshold', 6)} threshold, {_fixed('fp / negatives', 6)} fpr, {_fixed('tp / positives', 6)} tpr from steps
union all select * from (select distinct model, null::double, 0.0::double, 0.0::double from scored)
""")
ORACLES["pr_curve"] = statement(f"""
select model, {_fixed('threshold', 6)} threshold, {_fixed('tp / (tp + fp)', 6)} as precision, {_fixed('tp / positives', 6)} recall from steps
union all select * from (select distinct model, null::double, 1.0::double, 0.0::double from scored)
""")
CTES["scored_values"] = f"select churn_label, {_fixed('probability', 4)} as value from scored"
ORACLES["score_density"] = statement(_histogram("scored_values", "churn_label", 50))
ORACLES["calibration_bins"] = statement(f"""
select model, b as bin, count(customer_id) customers, {_fixed('avg(probability)', 6)} mean_predicted,
  {_fixed(_mean('churn_label'), 6)} observed_rate
from (select distinct model, b from scored, (select cast(unnest(range(10)) as int) b))
left join (select *, least(cast(floor(probability * 10) as int), 9) b from scored) using (model, b)
group by 1, 2
""")

# ---------------------------------------------------------------- explanation of the scorecard
CTES["phi"] = "\nunion all ".join(
    f"select customer_id, company_size, '{k}' feature, {_fixed(f'({v}) - avg({v}) over ()', 6)} phi from frame"
    for k, v in _TERMS.items())
ORACLES["shap_global"] = statement(f"select feature, {_fixed('avg(abs(phi))', 6)} mean_abs_phi from phi group by feature")
ORACLES["shap_by_segment"] = statement(
    f"select company_size, feature, {_fixed('avg(abs(phi))', 6)} mean_abs_phi from phi group by company_size, feature")
CTES["top3"] = """
select customer_id, max(feature) filter (nth = 1) top_driver_1, max(feature) filter (nth = 2) top_driver_2,
  max(feature) filter (nth = 3) top_driver_3
from (select customer_id, case when phi > 0 then feature end feature,
        row_number() over (partition by customer_id order by phi desc, feature) nth from phi)
group by customer_id
"""
ORACLES["top_drivers"] = statement("select * from top3")

# ---------------------------------------------------------------- scoring
CTES["output"] = f"""
select customer_id, company_size, industry, contract_type, monthly_charges, tenure_months, nps_score, num_support_tickets,
  login_frequency_30d, p churn_probability, false in_train,
  case when p >= 0.7 then 'Critical' when p >= 0.5 then 'High' when p >= 0.3 then 'Medium' else 'Low' end risk_tier,
  cast(round(monthly_charges * p, 2) as decimal(14,2)) revenue_at_risk_monthly,
  case when p >= 0.7 then 'Immediate CSM outreach + retention offer within 48h'
       when p >= 0.5 then 'Schedule health check call within 1 week'
       when p >= 0.3 then 'Automated nurture sequence + feature adoption push'
       else 'Standard success cadence — monitor monthly' end recommended_action,
  {AS_OF} scored_at, 'scorecard-v1' model_version, top_driver_1, top_driver_2, top_driver_3
from (select customer_id, cast({_fixed('raw', 4)} as decimal(6,4)) p from card)
join frame using (customer_id) join top3 using (customer_id)
"""
ORACLES["risk_tiers"] = statement("select customer_id, churn_probability, risk_tier from output")
ORACLES["score_output"] = statement("select * from output")
ORACLES["write_scores"] = ORACLES["score_output"]
ORACLES["tier_summary"] = statement("""
select coalesce(risk_tier, 'Total') risk_tier, count(*) customers,
  cast(sum(revenue_at_risk_monthly) as decimal(28,2)) monthly_at_risk,
  cast(sum(revenue_at_risk_monthly) * 12 as decimal(28,2)) annual_at_risk
from output group by rollup (risk_tier)
""")
ORACLES["tier_migration"] = statement("""
select a.risk_tier previous_tier, b.risk_tier current_tier, count(*) customers
from (select * from churn_scores where scored_at = DATE '2001-07-01') a
full join (select * from churn_scores where scored_at = DATE '2001-08-01') b using (customer_id)
group by 1, 2
""")

# ---------------------------------------------------------------- splits
ORACLES["stratified_split"] = statement(f"""
select customer_id, churn_label, nth > quota in_train
from (
  select customer_id, churn_label, round(count(*) over (partition by churn_label) * 0.2) quota,
    row_number() over (partition by churn_label order by {_unit(42, 'customer_id')}, customer_id) nth
  from frame)
""")

# ---------------------------------------------------------------- batch twins of the streaming queries
ORACLES["usage_daily_stream"] = statement("""
select user_id, cast(ts as date) usage_date, count(*) as events, cast(count(distinct event_type) as int) event_types,
  cast(sum(cast(value as decimal(28,2))) as decimal(28,2)) total_value
from events group by 1, 2
""")
ORACLES["engagement_sliding"] = statement(f"""
select user_id, window_start, window_start + 7 window_end, count(*) logins_7d, {_fixed('count(*) / 7.0::double', 4)} logins_per_day
from (select user_id, cast(ts as date) - cast(unnest(range(7)) as int) window_start from events)
group by user_id, window_start
""")
ORACLES["session_minutes_stream"] = statement(f"""
select user_id, min(ts) session_start, count(*) as events,
  {_fixed('(epoch_us(max(ts)) - epoch_us(min(ts))) / 60e6::double', 4)} session_minutes,
  (select max(ts) from events) <= max(ts) + interval 30 minute is_open
from (
  select user_id, ts, sum(opens) over (partition by user_id order by ts, event_id rows unbounded preceding) nth
  from (select *, case when ts - lag(ts) over (partition by user_id order by ts, event_id) <= interval 30 minute then 0 else 1 end opens
        from events))
group by user_id, nth
""")
ORACLES["tier_change_alerts"] = statement("""
select customer_id, b.scored_at, a.risk_tier previous_tier, b.risk_tier risk_tier
from (select * from churn_scores where scored_at = DATE '2001-07-01') a
join (select * from churn_scores where scored_at = DATE '2001-08-01') b using (customer_id)
where list_position(['Critical', 'High', 'Medium', 'Low'], b.risk_tier) < list_position(['Critical', 'High', 'Medium', 'Low'], a.risk_tier)
""")

# ---------------------------------------------------------------- balancing, by brute force over all minority pairs
CTES["split"] = f"""
select customer_id, nth > quota in_train
from (
  select customer_id, round(count(*) over (partition by churn_label) * 0.2) quota,
    row_number() over (partition by churn_label order by {_unit(42, 'customer_id')}, customer_id) nth
  from frame)
"""
_COMPLETE = {**_MATRIX, "payment_risk": "0.3::double * payment_delays_6m"}
_COMPLETE["composite_risk_score"] = _fixed(
    "(" + " + ".join(f"({_COMPLETE[part]}) / 4" for part in _RAW) + ")", 4)
CTES["train_matrix"] = f"""
select customer_id, churn_label, [{', '.join(f'({v})::double' for v in _COMPLETE.values())}] x
from frame join split using (customer_id) where in_train
"""
CTES["points"] = f"""
select customer_id, x, missing // n + (row_number() over (order by u, customer_id) <= missing % n)::int copies
from (
  select customer_id, x, {_unit(45, 'customer_id')} u, count(*) over () n,
    (select count(*) filter (churn_label = 0) - count(*) filter (churn_label = 1) from train_matrix) missing
  from train_matrix where churn_label = 1)
"""
CTES["spread"] = f"""
select list(sd order by i) sds from (
  select i, case when stddev_pop(x[i]) = 0 then 1 else stddev_pop(x[i]) end sd
  from points, (select unnest(range(1, {len(_COMPLETE) + 1})) i) group by i)
"""
CTES["scaled"] = f"""
select customer_id, x, list_transform(range(1, {len(_COMPLETE) + 1}), lambda i: x[i] / sds[i]) z from points cross join spread
"""
CTES["near"] = """
select p.customer_id a, q.x bx, row_number() over (partition by p.customer_id order by list_distance(p.z, q.z), q.customer_id) nth
from scaled p join scaled q on p.customer_id <> q.customer_id
qualify nth <= 5
"""
CTES["balanced"] = f"""
select customer_id, churn_label, false synthetic, x from train_matrix
union all
select customer_id || '#' || copy, 1, true,
  list_transform(range(1, {len(_COMPLETE) + 1}), lambda i: x[i] + share * (coalesce(bx[i], x[i]) - x[i]))
from (
  select *, {_unit(47, 'customer_id', 'copy')} share,
    cast(floor({_unit(46, 'customer_id', 'copy')} * coalesce((select max(nth) from near where a = customer_id), 0)) as int) + 1 pick
  from (select customer_id, x, unnest(range(1, copies + 1)) copy from points))
left join near on a = customer_id and nth = pick
"""
_UNPACKED = ", ".join(f'{_fixed(f"x[{i}]", 3)} "{name}"' for i, name in enumerate(_COMPLETE, 1))
ORACLES["smote"] = statement(f"select customer_id, {_UNPACKED}, churn_label, synthetic from balanced")
_NAMES = ", ".join(f"'{name}'" for name in _COMPLETE)
ORACLES["standardize"] = statement(f"""
select list_extract([{_NAMES}], i) feature, {_fixed('avg(x[i])', 3)} mean, {_fixed('stddev_samp(x[i])', 3)} sd
from balanced, (select cast(unnest(range(1, {len(_COMPLETE) + 1})) as int) i) group by i
""")
