"""What several of the text operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(key: str, folds: int) -> Column:
    """crc32 of the key as text, modulo ``folds``; a null key counts as empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % folds


def packed(df: DataFrame, *named: str) -> DataFrame:
    """The named columns, and all others inside one column ``row``, where their names clash with nothing."""
    rest = [F.col(f"`{c}`") for c in df.columns if c not in named]
    return df.select(*named, F.struct(F.lit(0).alias("_"), *rest).alias("row"))


def unpacked(df: DataFrame, columns: list[str], *named: str) -> DataFrame:
    """The columns of the table that ``packed`` got, the named ones as they are now."""
    return df.select(*[F.col(c) if c in named else F.col("row").getField(c).alias(c) for c in columns])


def map_rows(df: DataFrame, schema: str, work: Callable[..., Iterable[tuple]], flush: int = 2_000) -> DataFrame:
    """Run ``work(*columns)`` on every Arrow batch; it yields output rows, sent on in pieces of ``flush`` rows.

    ``work`` gets one Python list per column of ``df`` and may keep nothing between batches.
    """
    fields: StructType = _parse_datatype_string(schema)
    arrow = to_arrow_schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for batch in batches:
            for row in work(*(column.to_pylist() for column in batch.columns)):
                rows.append(row)
                if len(rows) >= flush:
                    yield _batch(rows, arrow)
                    rows = []
        if rows:
            yield _batch(rows, arrow)

    return df.mapInArrow(run, fields)


def _batch(rows: list[tuple], arrow: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)
