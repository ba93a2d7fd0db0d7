"""Sinks.  Tables are Parquet; the other formats are for exchange."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str, columns: list[str]) -> None:
    """Columns in this order; arrays and structs as JSON; doubles in the shortest form that reads back the same."""
    flat = [F.to_json(c).alias(c) if df.schema[c].dataType.typeName() in ("array", "struct", "map") else F.col(c) for c in columns]
    df.select(*flat).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_json_array(df: DataFrame, path: str, order: str, rows: int = 100_000) -> None:
    """An indented JSON array in one file, for exports of at most so many rows; more is an error, not a cut."""
    import json

    got = df.orderBy(order).limit(rows + 1).toJSON().collect()
    if len(got) > rows:
        raise ValueError(f"more than {rows} rows don't belong into one JSON array")
    text = json.dumps([json.loads(x) for x in got], ensure_ascii=False, indent=2)
    df.sparkSession.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def write_predictions(df: DataFrame, path: str, prompt: str = "prompt", predict: str = "predict", label: str = "label") -> None:
    df.select(F.col(prompt).alias("prompt"), F.col(predict).alias("predict"), F.col(label).alias("label")).write.mode("overwrite").json(path)


def fill_last(ids, pad: int):
    """Ids with leading fill moved to the end, as decoders want them."""
    kept = F.filter(ids, lambda x: x != pad)
    return F.concat(kept, F.array_repeat(F.lit(pad), F.size(ids) - F.size(kept)))


def write_reward_predictions(df: DataFrame, path: str) -> None:
    df.select(F.round("chosen", 2).alias("chosen"), F.round("rejected", 2).alias("rejected")).write.mode("overwrite").json(path)


def write_tokens(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_summary(df: DataFrame, path: str, by: str = "model") -> None:
    """Metrics as JSON lines in a folder for each model."""
    df.write.mode("overwrite").partitionBy(by).json(path)


def append_log(df: DataFrame, path: str) -> None:
    """Log records without their nulls."""
    df.write.mode("append").option("ignoreNullFields", True).json(path)


def write_in_parts(df: DataFrame, path: str, key: str) -> int:
    """Writes the rows whose keys aren't written yet, so that an interrupted run goes on; how many were left."""
    from parlance.sources.stages import exists, remaining

    left = df
    if exists(df.sparkSession, f"{path}/_SUCCESS"):
        left = remaining(df, df.sparkSession.read.parquet(path), key)
    n = left.count()
    if n:
        left.write.mode("append").parquet(path)
    return n
