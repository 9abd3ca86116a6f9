"""Running a stateful query over what is available, with its state in RocksDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from stayrate.session import scratch_path

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def run_batches(stream: DataFrame, keep: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """Hand every micro-batch to ``keep``, until no more data is available. The session's own settings stay as they are."""
    spark = stream.sparkSession
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ROCKSDB)
    try:
        query = (
            stream.writeStream.option("checkpointLocation", scratch_path(spark, checkpoint)).outputMode(mode)
            .trigger(availableNow=True).foreachBatch(keep).start()
        )
    finally:
        spark.conf.set(_PROVIDER, before)
    query.awaitTermination()
