"""Structured Streaming: cells that arrive as a stream. Beyond the reference's surface.

``running_cells`` keeps the sums of all cells; ``upsert_cells`` writes them to a folder in
the layout of a table; ``windowed_totals`` totals samples in event-time windows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def _timed(stream: DataFrame, time: str) -> DataFrame:
    """Watermarks want an instant; a local time is one in the session's time zone."""
    return stream.withColumn(time, F.col(time).cast("timestamp"))


def first_sent(stream: DataFrame, cell: str, loaded_at: str, delay: str = "60 days") -> DataFrame:
    """Each cell once: rows sent again within the delay are dropped, and the state with them."""
    return _timed(stream, loaded_at).withWatermark(loaded_at, delay).dropDuplicatesWithinWatermark([cell])


def running_cells(stream: DataFrame, obs: str = "obs_id", samp: str = "samp_id", value: str = "value") -> DataFrame:
    """``(obs_id, samp_id, value)`` sums so far; to be written in update or complete mode."""
    rows = stream.where(F.col(value).isNotNull() & F.col(obs).isNotNull() & F.col(samp).isNotNull())
    return rows.groupBy(F.col(obs).alias("obs_id"), F.col(samp).alias("samp_id")).agg(F.sum(value).alias("value"))


def windowed_totals(stream: DataFrame, time: str, window: str = "1 day", delay: str = "7 days", samp: str = "samp_id", value: str = "value") -> DataFrame:
    """``(start, samp_id, n, total)`` of each event-time window; rows later than the delay are dropped."""
    w = _timed(stream, time).withWatermark(time, delay).groupBy(F.window(time, window).alias("w"), F.col(samp).alias("samp_id"))
    return w.agg(F.count(value).alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), "samp_id", "n", "total")


def append_batches(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Writes the cells of each micro-batch, summed, to a folder of its own.

    A batch that is run again overwrites its folder, so each row counts once. The table's
    cells are the sums over all folders (``appended_cells``).
    """

    def write(batch: DataFrame, number: int) -> None:
        running_cells(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def appended_cells(spark, path: str) -> DataFrame:
    return running_cells(spark.read.parquet(path)).where("value <> 0")
