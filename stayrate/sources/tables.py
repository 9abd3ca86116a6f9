"""Access to the input tables: stored as parquet, csv or behind JDBC.

``get(name, since, until)`` bounds a fact table by its event day in the scan itself, so file pruning and
predicate pushdown apply before any operator sees a row.
"""

from __future__ import annotations

from datetime import date, datetime, time, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stayrate.sources.schemas import EVENT_DAY, NULLABLE_DAYS, SCHEMAS


class Tables:
    """Base: a named set of tables with memoised, unbounded readers."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self._known: dict[tuple, DataFrame] = {}

    def get(self, name: str, since: date | None = None, until: date | None = None) -> DataFrame:
        key = (name, since, until)
        if key not in self._known:
            self._known[key] = self._read(name, since, until)
        return self._known[key]

    def about_rows(self, name: str) -> int:
        """About how many rows a table has, for dealing them into tasks; 0 where only reading it all would tell."""
        return 0

    def _read(self, name: str, since: date | None, until: date | None) -> DataFrame:
        raise NotImplementedError


def bound_by_day(df: DataFrame, column: str, since: date | None, until: date | None) -> DataFrame:
    """Keep days since..until (inclusive) with plain comparisons that reach the scan.

    Undated survey responses are kept: only the operator knows what a missing day means there.
    """
    is_day = dict(df.dtypes)[column] == "date"

    def at(day: date) -> Column:
        return F.lit(day) if is_day else F.lit(datetime.combine(day, time())).cast("timestamp_ntz")

    within = F.lit(True)
    if since is not None:
        within = within & (F.col(column) >= at(since))
    if until is not None:
        within = within & (F.col(column) < at(until + timedelta(days=1)))
    if since is None and until is None:
        return df
    return df.where(within | F.col(column).isNull() if column in NULLABLE_DAYS else within)


class StoredTables(Tables):
    """One folder per table below a root, in a file format with declared schemas."""

    def __init__(self, spark: SparkSession, root: str, file_format: str = "parquet", **options: str):
        super().__init__(spark)
        self.root, self.file_format, self.options = root.rstrip("/"), file_format, options

    def about_rows(self, name: str) -> int:
        return self.get(name).count() if self.file_format == "parquet" else 0

    def _read(self, name: str, since: date | None, until: date | None) -> DataFrame:
        options = {"header": "true", **self.options} if self.file_format == "csv" else self.options
        df = (
            self.spark.read.format(self.file_format)
            .schema(SCHEMAS[name])
            .options(**options)
            .load(f"{self.root}/{name}")
        )
        return bound_by_day(df, EVENT_DAY[name], since, until) if name in EVENT_DAY else df


class JdbcTables(Tables):
    """Tables in a relational database.

    Every table is read in parallel: facts bounded on both sides by day, any other read by the numeric or date
    column that ``splits`` names with its lowest and highest value. Without one it is refused, not read through a
    single connection.
    """

    def __init__(
        self, spark: SparkSession, url: str, partitions: int = 64,
        splits: dict[str, tuple[str, str, str]] | None = None, **options: str,
    ):
        super().__init__(spark)
        self.url, self.partitions, self.splits, self.options = url, partitions, splits or {}, options

    def _read(self, name: str, since: date | None, until: date | None) -> DataFrame:
        reader = self.spark.read.format("jdbc").options(url=self.url, dbtable=name, **self.options)
        day = EVENT_DAY.get(name)
        split = self.splits.get(name)
        if day and since and until:
            split = (day, str(since), str(until + timedelta(days=1)))
        if not split:
            raise ValueError(f"{name}: name a split column with its bounds in splits")
        column, low, high = split
        df = reader.options(
            partitionColumn=column, lowerBound=low, upperBound=high, numPartitions=str(self.partitions)
        ).load()
        wanted = [F.col(f.name).cast(f.dataType).alias(f.name) for f in SCHEMAS[name] if f.name in df.columns]
        df = df.select(*wanted)
        return bound_by_day(df, day, since, until) if day else df
