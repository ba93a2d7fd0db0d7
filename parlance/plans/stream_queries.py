"""Queries that run as streams over files and end when they are read."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.plans.registry import Tables, query
from parlance.sources.stages import is_file, shared_folder
from parlance.streaming import streams


def stream(t: Tables, name: str) -> DataFrame:
    """A table's files as a stream, whether the table is a file or a folder."""
    schema = getattr(t, name).schema
    reader = t.spark.readStream.schema(schema).option("recursiveFileLookup", True)
    path = f"{t.sf_dir}/{name}.parquet"
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(t.sf_dir) if is_file(t.spark, path) else reader.parquet(path)


@query("""SELECT CAST(epoch(time_bucket(INTERVAL '6 hours', ts, TIMESTAMP '1970-01-01')) AS BIGINT) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL""")
def stream_windows(t: Tables) -> DataFrame:
    """Counts and sums of event-time windows of six hours; the stream is complete when its files are read."""
    # event time counts from the epoch in whatever time zone the session has
    events = stream(t, "events").withColumn("ts", F.expr("timestamp_micros(timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01', ts))"))
    rows = streams.windowed(events, "ts", "6 hours", "1 hour", ["event_type"], "value")
    folder = f"{shared_folder(t.spark)}/stream-{uuid.uuid4().hex}"
    streams.write_complete(rows, f"{folder}/rows", f"{folder}/checkpoint").awaitTermination()
    return t.spark.read.parquet(f"{folder}/rows").select(F.unix_timestamp("start").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("""SELECT doc_id, CAST(('0x' || substr(md5(doc_id || '|42'), 1, 8)) AS BIGINT) / 4294967296 < 0.1::DOUBLE AS validation FROM documents""")
def stream_split(t: Tables) -> DataFrame:
    """A stream's rows on either side of a hash split, written by micro-batches and read again."""
    rows = stream(t, "documents").select("doc_id")
    train, validation = streams.split_stream(rows, "doc_id", 0.1)
    both = streams.concatenated([train.withColumn("validation", F.lit(False)), validation.withColumn("validation", F.lit(True))])
    folder = f"{shared_folder(t.spark)}/stream-{uuid.uuid4().hex}"
    streams.write_stream(both, f"{folder}/rows", f"{folder}/checkpoint").awaitTermination()
    return t.spark.read.parquet(f"{folder}/rows")
