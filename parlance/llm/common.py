"""Helpers that several corpus operators share."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Arrow's own allocators keep what a Python worker frees; the system's gives it back.
pa.set_memory_pool(pa.system_memory_pool())

#: White space and words as every contract of these operators has them.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

#: Rows that may be broadcast as a set of ids (about 16 MB); beyond it a shuffled join is used.
BROADCAST_IDS = 1_000_000


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder that the cluster names; set one only where there is none, as in tests."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        sc.setCheckpointDir(shared or os.path.join(tempfile.gettempdir(), "parlance-checkpoints"))


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage: the rows are in the shared checkpoint folder, so lost executors cost no recomputation."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def text_of(text: str | Column) -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def side(rows: DataFrame) -> DataFrame:
    """Narrow rows that are kept (checkpointed) as a side of a join: broadcast if they are few enough, so that a key's rows on the other side stay where they are."""
    return F.broadcast(rows) if rows.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else rows


def drop_ids(docs: DataFrame, ids: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """docs without the rows whose id is in ids (one column named id_col, no nulls).

    The ids are broadcast if they are few enough, so that the texts stay where
    they are; otherwise both sides are shuffled.  Rows with a null id stay.
    """
    ids = durable(ids.distinct())
    return docs.join(side(ids), id_col, "left_anti").select(*docs.columns)


_TABLES: dict = {}


def worker_table(build):
    """build(...), kept by a Python worker for its next tasks; a worker keeps the table of one operator only."""

    def get(*how):
        key = build.__module__, build.__qualname__, how
        if key not in _TABLES:
            _TABLES.clear()
            _TABLES[key] = build(*how)
        return _TABLES[key]

    return get


def drop_tables() -> None:
    """What operators without tables call in a worker before they start."""
    _TABLES.clear()


#: Rows and bytes in an Arrow batch, so that a batch of very long documents still fits a Python worker.
BATCH_ROWS, BATCH_BYTES = 256, 16 << 20


def small_batches(spark: SparkSession) -> None:
    """Bound the rows and bytes that Spark sends to a Python worker at once.

    Settings of the session that are tighter stay.  A plan reads them when it runs,
    which is after its operator has returned, so they aren't taken back.
    """
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        name = f"spark.sql.execution.arrow.{name}"
        number, unit = re.fullmatch(r"(-?\d+)([kmg]?)b?", spark.conf.get(name).strip().lower()).groups()
        if not 0 < int(number) << {"": 0, "k": 10, "m": 20, "g": 30}[unit] <= most:
            spark.conf.set(name, most)


def spread(docs: DataFrame) -> DataFrame:
    """docs over all cores, if a table of few files and row groups would leave cores idle; for work that costs more than a shuffle.

    Tables of many files are as they were: only those of fewer files than cores are asked
    how many of their partitions have rows, which reads no column.
    """
    cores = docs.sparkSession.sparkContext.defaultParallelism
    if len(docs.inputFiles()) >= cores or docs.select(F.spark_partition_id().alias("p")).distinct().limit(cores).count() >= cores:
        return docs
    return docs.repartition(cores)


def written(df: DataFrame, name: str, **options) -> DataFrame:
    """The rows as a Parquet table in the shared checkpoint folder, read again."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Bits of a filter: 2 MB, whatever the input.
FILTER_BITS = 1 << 24


def bit_filter(keys: DataFrame, key: str) -> np.ndarray:
    """A bit for each value modulo FILTER_BITS of the long column key; other values are surely not in keys.

    The bits are gathered with map-side combination in 64-bit words, so at most
    FILTER_BITS / 64 rows come to the driver.  On very large inputs the filter
    fills up and lets everything pass; what uses it must be right then too.
    """
    bit = F.pmod(F.col(key), F.lit(FILTER_BITS))
    words = keys.select(F.shiftright(bit, 6).alias("at"), F.expr("shiftleft(1L, CAST(pmod(`" + key + "`, 64) AS INT))").alias("bit"))
    rows = words.groupBy("at").agg(F.bit_or("bit").alias("bits")).toPandas()
    out = np.zeros(FILTER_BITS // 64, np.int64)
    out[rows["at"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.int64)
    return out


def may_contain(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether each of the 64-bit keys (signed) may be among those of a filter."""
    at = keys.astype(np.int64) & np.int64(FILTER_BITS - 1)
    return (bits[at >> 6] >> (at & 63)) & 1 == 1
