"""The stored layout of the tables: facts in folders by month, everything with a customer in buckets by customer.

It takes the place of indexes on (customer, date): a date bound leaves whole folders unread, and aggregates and joins by
customer find their rows already dealt, so that they need no exchange.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stayrate.sources.schemas import EVENT_DAY, NULLABLE_DAYS, SCHEMAS
from stayrate.sources.tables import Tables, bound_by_day

KEY = "customer_id"


def write_layout(tables: Tables, root: str, database: str, buckets: int = 256) -> None:
    """Write all tables below ``root`` and name them in a database of the session's catalogue; a rewrite replaces them."""
    spark = tables.spark
    spark.sql(f"create database if not exists `{database}`")
    for name in SCHEMAS:
        rows = tables.get(name)
        rows = rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in SCHEMAS[name] if f.name in rows.columns])
        day = EVENT_DAY.get(name)
        if day:
            rows = rows.withColumn("month", F.trunc(day, "month"))
        # one file per month and bucket
        writer = rows.repartition(buckets, KEY).write.mode("overwrite").bucketBy(buckets, KEY).sortBy(KEY)
        if day:
            writer = writer.partitionBy("month")
        writer.option("path", f"{root.rstrip('/')}/{name}").format("parquet").saveAsTable(f"`{database}`.`{name}`")


class LayoutTables(Tables):
    """Tables written by ``write_layout``."""

    def __init__(self, spark: SparkSession, database: str):
        super().__init__(spark)
        self.database = database

    def _read(self, name: str, since: date | None, until: date | None) -> DataFrame:
        df = self.spark.table(f"`{self.database}`.`{name}`")
        if name not in EVENT_DAY:
            return df
        within = F.lit(True)
        if since is not None:
            within = within & (F.col("month") >= F.lit(since.replace(day=1)))
        if until is not None:
            within = within & (F.col("month") <= F.lit(until.replace(day=1)))
        if since is not None or until is not None:
            df = df.where(within | F.col("month").isNull() if EVENT_DAY[name] in NULLABLE_DAYS else within)
        return bound_by_day(df.drop("month"), EVENT_DAY[name], since, until)
