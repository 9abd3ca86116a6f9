"""The seven retention tables, derived from a TPC-H-like star schema (FIXTURES.md section 2)."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stayrate.functions.ranking import add_neighbour, spread
from stayrate.operators.scoring import action
from stayrate.sources.tables import Tables, bound_by_day

AS_OF = date(2001, 8, 1)
AS_OF_EVENTS = date(2024, 1, 31)
FIRST_SCORING = date(2001, 7, 1)

# ship days are compressed 8:1 towards the clock; the origin is fixed with the fixture
_USAGE_ORIGIN = date(2001, 11, 4)
_USAGE_CLOCK = date(2001, 8, 1)
_USAGE_FACTOR = 8

RAW_SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
                "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
                "l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
}

_ORIGINS = {
    "customers": "customer", "contracts": "orders", "billing_events": "lineitem", "product_usage": "lineitem",
    "support_tickets": "orders", "nps_responses": "orders", "churn_scores": "orders", "recovery_actions": "orders",
}


def _customer_id(key: str) -> Column:
    return F.concat(F.lit("CUST-"), F.lpad(F.col(key).cast("string"), 9, "0"))


class FixtureTables(Tables):
    def __init__(self, spark: SparkSession, sf_dir: str):
        super().__init__(spark)
        self.sf_dir = sf_dir.rstrip("/")

        self._raw: dict[str, DataFrame] = {}
        self._counted: dict[str, int] = {}

    def raw(self, name: str) -> DataFrame:
        """A driver table with its declared schema: no footer is read to plan a query."""
        if name not in self._raw:
            self._raw[name] = self.spark.read.schema(RAW_SCHEMAS[name]).parquet(f"{self.sf_dir}/{name}.parquet")
        return self._raw[name]

    def raw_rows(self, name: str) -> int:
        """Rows of a driver table; the footers of its files tell."""
        if name not in self._counted:
            self._counted[name] = self.raw(name).count()
        return self._counted[name]

    def about_rows(self, name: str) -> int:
        """Bounded by the driver table that its rows come from."""
        return self.raw_rows(_ORIGINS[name])

    def _read(self, name: str, since: date | None, until: date | None) -> DataFrame:
        return getattr(self, f"_{name}")(since, until)

    def _customers(self, since, until) -> DataFrame:
        first = self.raw("orders").groupBy("o_custkey").agg(F.min("o_orderdate").alias("first_dt"))
        balance = F.col("c_acctbal")
        return (
            self.raw("customer")
            .join(first, F.col("c_custkey") == F.col("o_custkey"), "left")
            .join(self.raw("nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
            .join(self.raw("region"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
            .select(
                _customer_id("c_custkey").alias("customer_id"),
                F.col("c_name").alias("company_name"),
                F.col("c_mktsegment").alias("industry"),
                F.when(balance < 4500, "SMB").when(balance < 8000, "Mid-Market").otherwise("Enterprise").alias("company_size"),
                F.coalesce(F.col("first_dt").cast("date"), F.lit(date(1995, 1, 1))).alias("acquisition_date"),
                F.when(
                    F.col("c_custkey") % 5 < 2, F.concat(F.lit("CSM-"), (F.col("c_custkey") % 10).cast("string"))
                ).alias("csm_owner"),
                F.col("r_name").alias("region"),
                "c_custkey",
            )
        )

    def _contracts(self, since, until) -> DataFrame:
        orders = self.raw("orders").select(
            "o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority",
            F.col("o_orderdate").cast("date").alias("d"),
            F.col("o_totalprice").cast("decimal(12,2)").alias("amt"),
        )
        s = add_neighbour(orders, "o_custkey", "d", "o_orderkey", {"nd": "d", "namt": "amt"})
        last, closed = F.col("nd").isNull(), F.col("o_orderstatus") == "F"
        priority, key = F.col("o_orderpriority"), F.col("o_orderkey")
        return s.select(
            key.alias("contract_id"),
            _customer_id("o_custkey").alias("customer_id"),
            F.when(priority.isin("1-URGENT", "2-HIGH"), "Monthly")
            .when(priority.isin("3-MEDIUM", "4-NOT SPECIFIED"), "Annual")
            .otherwise("Multi-year").alias("contract_type"),
            F.col("d").alias("start_date"),
            F.when(~last, F.col("nd"))
            .when(closed, F.date_add("d", 60))
            .when(key % 3 == 0, F.lit(None).cast("date"))
            .otherwise(F.date_add("d", 365)).alias("end_date"),
            F.col("amt").alias("monthly_charges"),
            (1 + key % 4).cast("int").alias("num_products"),
            (key % 5 < 2).alias("has_addon"),
            ((key % 6) * 5).cast("int").alias("discount_pct"),
            F.when(last & closed, "Churned")
            .when(last, "Active")
            .when(F.col("namt") >= F.col("amt"), "Upgraded")
            .otherwise("Downgraded").alias("status"),
            F.when(last & closed, F.date_add("d", 60)).alias("churned_at"),
        )

    def _lines(self, since: date | None, until: date | None) -> DataFrame:
        lines = bound_by_day(self.raw("lineitem"), "l_shipdate", since, until)
        orders = self.raw("orders").select("o_orderkey", "o_custkey")
        most = self.raw_rows("lineitem")
        lines, orders = spread(lines, most, "l_orderkey"), spread(orders, most, "o_orderkey")
        return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))

    def _billing_events(self, since, until) -> DataFrame:
        returned, open_line = F.col("l_returnflag"), F.col("l_linestatus") == "O"
        late = (returned == "A") & open_line
        return self._lines(since, until).select(
            (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("event_id"),
            _customer_id("o_custkey").alias("customer_id"),
            F.col("l_shipdate").cast("date").alias("event_date"),
            F.when(returned == "N", "Payment")
            .when(late, "Late Payment")
            .when(returned == "A", "Writeoff")
            .when(open_line, "Dispute")
            .otherwise("Refund").alias("event_type"),
            F.col("l_extendedprice").cast("decimal(12,2)").alias("amount"),
            F.when(late, F.col("l_quantity").cast("int")).otherwise(0).alias("days_overdue"),
        )

    def _product_usage(self, since, until) -> DataFrame:
        def ship_day(usage: date, last_of_block: bool) -> date:
            back = (_USAGE_CLOCK - usage).days * _USAGE_FACTOR
            return _USAGE_ORIGIN - timedelta(days=back + (0 if last_of_block else _USAGE_FACTOR - 1))

        lines = self._lines(
            None if since is None else ship_day(since, last_of_block=False),
            None if until is None else ship_day(until, last_of_block=True),
        )
        behind = F.floor(F.datediff(F.lit(_USAGE_ORIGIN), F.col("l_shipdate").cast("date")) / F.lit(8.0)).cast("int")
        feature_bit = F.call_function("shiftleft", F.lit(1), (F.col("l_partkey") % 5).cast("int"))
        placed = lines.select(
            "o_custkey", F.date_sub(F.lit(_USAGE_CLOCK), behind).alias("usage_date"),
            "l_quantity", "l_linenumber", feature_bit.alias("feature_bit"),
        )
        return (
            spread(placed, self.raw_rows("lineitem"), "o_custkey", "usage_date")
            .groupBy("o_custkey", "usage_date")
            .agg(
                F.count(F.lit(1)).cast("int").alias("logins"),
                F.sum("l_quantity").cast("decimal(18,2)").alias("session_minutes"),
                # five features at most: a bit set needs no second shuffle for the distinct count
                F.bit_count(F.bit_or("feature_bit")).cast("int").alias("features_used"),
                F.lit(5).alias("total_features"),
                F.sum("l_linenumber").cast("int").alias("api_calls"),
            )
            .withColumns({
                "customer_id": _customer_id("o_custkey"),
                "usage_id": F.col("o_custkey") * 100_000 + F.datediff("usage_date", F.lit(date(1970, 1, 1))),
            })
            .drop("o_custkey")
        )

    def _support_tickets(self, since, until) -> DataFrame:
        priority, key = F.col("o_orderpriority"), F.col("o_orderkey")
        return bound_by_day(self.raw("orders"), "o_orderdate", since, until).select(
            key.alias("ticket_id"),
            _customer_id("o_custkey").alias("customer_id"),
            F.col("o_orderdate").alias("opened_at"),
            F.when(priority == "1-URGENT", "Critical").when(priority == "2-HIGH", "High")
            .when(priority == "3-MEDIUM", "Medium").otherwise("Low").alias("priority"),
            F.when(key % 4 != 0, (1 + key % 5).cast("int")).alias("csat_score"),
            ((key % 60) * F.lit(0.25)).cast("decimal(6,2)").alias("resolution_days"),
        )

    def _nps_responses(self, since, until) -> DataFrame:
        key = F.col("o_orderkey")
        return bound_by_day(self.raw("orders"), "o_orderdate", since, until).where(key % 2 == 0).select(
            key.alias("response_id"),
            _customer_id("o_custkey").alias("customer_id"),
            F.col("o_orderdate").cast("date").alias("survey_date"),
            (((key * 37) % 21 - 10) * 10).cast("int").alias("nps_score"),
        )

    def _churn_scores(self, since, until) -> DataFrame:
        key, run = F.col("c_custkey"), F.col("k")
        live = self.get("contracts").where(F.col("status") == "Active").select("customer_id", "monthly_charges")
        drawn = ((key * 7919 + run * 104729) % 10001).cast("decimal(12,4)") / 10000
        p = F.col("churn_probability")
        return (
            self.raw("customer")
            .select("c_custkey", F.explode(F.array(F.lit(0), F.lit(1))).alias("k"))
            .select(
                _customer_id("c_custkey").alias("customer_id"),
                (key * 2 + run).alias("score_id"),
                F.when(run == 0, F.lit(FIRST_SCORING)).otherwise(F.lit(AS_OF)).alias("scored_at"),
                drawn.cast("decimal(6,4)").alias("churn_probability"),
                F.when(key % 3 == 0, "feature_adoption_rate").when(key % 3 == 1, "nps_score")
                .otherwise("payment_delays_6m").alias("top_driver_1"),
                F.when(key % 7 < 5, "usage_trend_30d").alias("top_driver_2"),
                F.when(key % 7 < 2, "contract_type").alias("top_driver_3"),
            )
            .join(live, "customer_id")
            .select(
                "customer_id", "score_id", "scored_at", "churn_probability",
                F.when(p >= 0.70, "Critical").when(p >= 0.50, "High").when(p >= 0.30, "Medium")
                .otherwise("Low").alias("risk_tier"),
                F.round(F.col("monthly_charges") * p, 2).cast("decimal(12,2)").alias("revenue_at_risk"),
                "top_driver_1", "top_driver_2", "top_driver_3",
            )
            .withColumn("recommended_action", action(F.col("risk_tier")))
        )

    def _recovery_actions(self, since, until) -> DataFrame:
        key = F.col("c_custkey")
        live = self.get("contracts").where(F.col("status") == "Active").select("customer_id", "monthly_charges")
        arm = F.floor(key / F.lit(2.0)).cast("int") % 4
        flagged = self.get("churn_scores").where(
            (F.col("scored_at") == F.lit(AS_OF)) & F.col("risk_tier").isin("Critical", "High")
        )
        return (
            flagged.join(self.get("customers").select("customer_id", "c_custkey"), "customer_id")
            .where(key % 2 == 0)
            .join(live, "customer_id")
            .select(
                key.alias("action_id"), "customer_id", F.col("scored_at").alias("actioned_at"),
                F.when(arm == 0, "exec_outreach").when(arm == 1, "csm_call").when(arm == 2, "auto_email")
                .otherwise("discount_offer").alias("intervention"),
                F.when(key % 7 < 3, "saved").when(key % 7 < 5, "lost").otherwise("pending").alias("outcome"),
                F.when(key % 7 < 3, F.col("monthly_charges")).otherwise(F.lit(0).cast("decimal(12,2)")).alias("saved_mrr"),
            )
        )
