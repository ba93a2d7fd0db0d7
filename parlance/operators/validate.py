"""Checks of ids, rows and arguments.  Checks return the offending rows; ``require_none`` turns them into an error."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def require_none(bad: DataFrame, what: str) -> None:
    """Fails with a few examples if there is any row."""
    if some := bad.take(3):
        raise ValueError(f"{what}: {some}")


def repeated(rows: DataFrame, key: str) -> DataFrame:
    """Keys that several rows have, and how many."""
    return rows.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def missing(rows: DataFrame, others: DataFrame, key: str) -> DataFrame:
    """Keys of rows that others don't have."""
    return rows.select(key).join(others.select(key), key, "left_anti")


def same_ids(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys that only one of the two has, and which one."""
    return missing(a, b, key).withColumn("only_in", F.lit("first")).unionByName(missing(b, a, key).withColumn("only_in", F.lit("second")))


def aligned(judges: dict[str, DataFrame], key: str, content: str) -> DataFrame:
    """Rows of judges that don't describe what the others describe: per key the number of judges and of contents."""
    rows = [df.select(key, F.xxhash64(content).alias("h"), F.lit(name).alias("judge")) for name, df in judges.items()]
    every = rows[0]
    for r in rows[1:]:
        every = every.unionByName(r)
    out = every.groupBy(key).agg(F.count_distinct("judge").alias("judges"), F.count_distinct("h").alias("contents"))
    return out.where((F.col("judges") != len(judges)) | (F.col("contents") != 1))


def same_counts(rates: DataFrame, key: str, judge: str, responses: str) -> DataFrame:
    """Keys whose judges scored different numbers of responses."""
    return rates.groupBy(key).agg(F.count_distinct(F.size(responses)).alias("sizes")).where("sizes > 1")


def required_columns(rows: DataFrame, names: list[str]) -> None:
    if lacking := [n for n in names if n not in rows.columns]:
        raise ValueError(f"columns are missing: {lacking}")


def with_set(rows: DataFrame, expected: str, column: str = "set") -> DataFrame:
    """rows with their set, the expected one where there is none; another one fails the job."""
    own = F.coalesce(F.col(column), F.lit(expected)) if column in rows.columns else F.lit(expected)
    wrong = F.raise_error(F.concat(F.lit("unexpected set "), own)).cast("string")
    return rows.withColumn(column, F.when(own == expected, own).otherwise(wrong))


def expanded_counts(rows: DataFrame, key: str, n: int) -> DataFrame:
    """Keys that don't have exactly n rows."""
    return rows.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") != n)


def same_table(a: DataFrame, b: DataFrame) -> bool:
    """Whether two tables have the same rows, each as often."""
    b = b.select(*a.columns)
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


@dataclass
class DataArguments:
    """What a data preparation is asked for; inconsistent wishes are errors."""

    datasets: tuple[str, ...] = ()
    eval_datasets: tuple[str, ...] = ()
    mix: str = "concat"
    probabilities: tuple[float, ...] | None = None
    streaming: bool = False
    val_size: float = 0.0
    max_samples: int | None = None
    mask_history: bool = False
    train_on_prompt: bool = False
    cutoff: int = 2048
    packing: bool = False
    neat_packing: bool = False

    def __post_init__(self):
        if self.mix not in ("concat", "interleave_under", "interleave_over"):
            raise ValueError(f"unknown mixing {self.mix}")
        if self.eval_datasets and self.val_size > 1e-6:
            raise ValueError("a validation share can't go with validation datasets")
        if not self.datasets and self.val_size > 1e-6:
            raise ValueError("a validation share needs datasets")
        if self.probabilities is not None:
            if self.mix == "concat":
                raise ValueError("probabilities go with interleaving only")
            if len(self.probabilities) != len(self.datasets):
                raise ValueError("there must be a probability for each dataset")
        if self.streaming and 1e-6 < self.val_size < 1:
            raise ValueError("a stream is split by a number of rows")
        if self.streaming and self.max_samples is not None:
            raise ValueError("a stream has no max_samples")
        if self.mask_history and self.train_on_prompt:
            raise ValueError("masked history can't go with training on prompts")
        if self.neat_packing:
            self.packing = True
