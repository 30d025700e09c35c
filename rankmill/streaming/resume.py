"""Incremental processing: work on new files only, with the progress kept in a checkpoint."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from rankmill.operators.history import pending


def process_new_files(spark: SparkSession, source: str, schema: StructType, sink: str, checkpoint: str, work: Callable[[DataFrame], DataFrame], key: str) -> StreamingQuery:
    """Runs ``work`` once over the rows of files that arrived since the last call and appends the results.

    A batch that is replayed after a failure skips keys that are already in the sink.
    """

    def batch(df: DataFrame, _: int) -> None:
        try:
            df = pending(df, spark.read.parquet(sink), key)
        except Exception as e:  # no sink yet
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
        work(df).write.mode("append").parquet(sink)

    stream = spark.readStream.schema(schema).parquet(source)
    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def resume(items: DataFrame, done: DataFrame | None, key: str, work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The batch form: only items that are not done are worked on."""
    return work(items if done is None else pending(items, done, key))
