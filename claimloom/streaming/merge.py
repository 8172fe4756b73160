"""The history as the state of a stream: each micro-batch of records is merged into it as a batch would be."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from claimloom.operators.history import merge_observations
from claimloom.operators.records import normalize_records
from claimloom.sources.files import replace_table


def merging_writer(records: DataFrame, history_path: str, checkpoint: str) -> DataStreamWriter:
    """A writer that merges a stream of observed records into the table at ``history_path``; start it with ``.start()``.

    Late batches widen first and last sightings, so no watermark drops them. Merging is idempotent, so a batch that is replayed
    after a failure gives the same history.
    """

    def merge(batch: DataFrame, number: int) -> None:
        if batch.isEmpty():
            return
        history = batch.sparkSession.read.parquet(history_path)
        replace_table(merge_observations(history, normalize_records(batch)), history_path)

    return records.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).outputMode("append")


def windowed_counts(events: DataFrame, at: str = "ts", by: str = "event_type", width: str = "1 day", late: str = "2 days") -> DataFrame:
    """Counts by tumbling window, for streams and tables alike; on a stream, windows close ``late`` after their end."""
    return events.withColumn("__at", F.col(at).cast("timestamp")).withWatermark("__at", late).groupBy(F.window("__at", width).alias("w"), by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), by, "n")


