"""Streams of dataset files: the batch expressions on streaming frames."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.operators.split import seeded


def read_stream(spark: SparkSession, path: str, schema: str, kind: str = "parquet", files_at_once: int = 64) -> DataFrame:
    """Files of a folder as they come; a schema is needed."""
    return spark.readStream.format(kind).schema(schema).option("maxFilesPerTrigger", files_at_once).load(path)


def split_stream(rows: DataFrame, key: str, share: float, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(train, validation) by a hash of the key: a row is on the same side in every batch and run."""
    place = F.conv(F.substring(seeded(key, seed), 1, 8), 16, 10).cast("long") / float(1 << 32)
    return rows.where(place >= share), rows.where(place < share)


def concatenated(streams: list[DataFrame]) -> DataFrame:
    out = streams[0]
    for s in streams[1:]:
        out = out.unionByName(s)
    return out


def write_shuffled(rows: DataFrame, path: str, checkpoint: str, key: str, seed: int = 42):
    """Writes each micro-batch in seeded order.  A batch is the shuffle's buffer.

    A batch that is written again after a failure replaces itself.
    """

    def put(batch: DataFrame, number: int) -> None:
        batch.withColumn("__h", seeded(key, f"{seed}-{number}")).repartitionByRange("__h").sortWithinPartitions("__h").drop("__h").write.mode("overwrite").parquet(f"{path}/batch={number}")

    return rows.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def write_stream(rows: DataFrame, path: str, checkpoint: str):
    return rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed(events: DataFrame, ts: str, window: str, late: str, by: list[str], value: str) -> DataFrame:
    """Counts and sums by event-time window, with a watermark for late rows."""
    out = events.withWatermark(ts, late).groupBy(F.window(ts, window), *by).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return out.select(F.col("window.start").alias("start"), *by, "n", "total")


def write_complete(rows: DataFrame, path: str, checkpoint: str):
    """Writes an aggregate's whole result at path; each micro-batch replaces the one before it, and so does one that is written again."""

    def put(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(path)

    return rows.writeStream.foreachBatch(put).outputMode("complete").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def progress(listener: Callable[[dict], None]):
    """A query listener that is told rows per second and batch of each micro-batch."""
    from pyspark.sql.streaming import StreamingQueryListener

    class Progress(StreamingQueryListener):
        def onQueryStarted(self, event):
            pass

        def onQueryProgress(self, event):
            p = event.progress
            listener({"batch": p.batchId, "rows": p.numInputRows, "rows_per_second": p.processedRowsPerSecond})

        def onQueryIdle(self, event):
            pass

        def onQueryTerminated(self, event):
            pass

    return Progress()
