"""Incremental ingest: files that appear become work orders in the memory, each once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.query import StreamingQuery

from ..operators import store


def ingest_stream(stream: DataFrame, path: str, checkpoint: str, defect: str, action: str, final: str | None, entered: str, available_now: bool = True) -> StreamingQuery:
    """Append what is new of each micro-batch to the memory at path.

    Batches run one after another; a batch that runs again finds its rows by their hash and adds none twice.
    """

    def batch(df: DataFrame, number: int) -> None:
        store.append_training(df.sparkSession, store.training_rows(df, defect, action, final, entered), path, f"batch {number}")

    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def watch(spark: SparkSession, path: str, schema: str, form: str = "parquet") -> DataFrame:
    """Files of a folder as a stream."""
    return spark.readStream.schema(schema).format(form).load(path)
