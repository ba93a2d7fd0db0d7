"""Exact deduplication by a heavy-hitter split.

A frequent-items sketch (Misra-Gries counters, merged map-side) names the
digests that may be frequent.  Their groups are counted exactly, and the
verified winners - at most ``HEAVY`` rows - are broadcast, so that copies of a
frequent text are decided where they are read and never meet in one task.
Every other digest goes through an ordinary shuffle: its size and first row are
aggregated map-side and joined to its rows, which adaptive execution may split.
The sketch's error bound keeps such a group below ``3.5 / TRACKED`` of all rows.

Defined results: a null text is an empty one, so null and empty texts are
copies of each other.  Among copies the smallest doc_id stays, null ids come
last, and of rows repeated with the same id one stays.  Texts of any length are
read whole.  An empty table gives an empty result.  Other columns, whatever
their names, are kept by ``dedup`` and ignored by ``decide``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parlance.llm.common import SPACE, durable, spread, text_of

#: Frequent digests that are taken from the sketch, and counters that a sketch has.
HEAVY, TRACKED = 256, 2048
#: Sketches are merged in two steps, the first over so many groups of tasks.
FAN_IN = 64


def digest_of(text: str = "text") -> Column:
    """SHA-256 of the text with each run of white space as one space."""
    return F.sha2(F.regexp_replace(text_of(text), SPACE, " "), 256)


def frequent(digests: DataFrame, heavy: int = HEAVY, tracked: int = TRACKED) -> list[str]:
    """The digests that Misra-Gries counters report as the most frequent: heavy of them at most."""
    part = digests.groupBy(F.pmod(F.spark_partition_id(), F.lit(FAN_IN)).alias("part"))
    sketches = part.agg(F.expr(f"approx_top_k_accumulate(digest, {tracked})").alias("sketch"))
    # Grouped by a constant: a partition without rows then has no sketch instead of one without a type, which can't be merged.
    top = sketches.groupBy(F.lit(1)).agg(F.expr(f"approx_top_k_estimate(approx_top_k_combine(sketch, {tracked}), {heavy})").alias("top"))
    return [x["item"] for row in top.collect() for x in row["top"] or [] if x["count"] > 1]


def groups(rows: DataFrame) -> DataFrame:
    """Exact size and first row of each group of copies: digest, w_size, w_id, w_row."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row"))
    found = rows.groupBy("digest").agg(F.count("*").alias("w_size"), first.alias("w")).where("w_size > 1")
    return found.select("digest", "w_size", F.col("w.doc_id").alias("w_id"), F.col("w.row").alias("w_row"))


def winners(rows: DataFrame, heavy: list[str]) -> DataFrame:
    """The groups that are frequent."""
    return groups(rows.where(F.col("digest").isin(heavy)))


def decide(docs: DataFrame, heavy: int = HEAVY, tracked: int = TRACKED) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row for each row of docs."""
    rows = durable(spread(docs.select("doc_id", "text")).select("doc_id", digest_of().alias("digest"), F.monotonically_increasing_id().alias("row")))
    found = durable(winners(rows, frequent(rows, heavy, tracked)))

    def decided(marked: DataFrame) -> DataFrame:
        single = F.col("w_size").isNull()
        keep = F.when(single, F.col("doc_id")).otherwise(F.col("w_id"))
        return marked.select("doc_id", keep.alias("keep_id"), F.coalesce("w_size", F.lit(1).cast("long")).alias("group_size"), (single | (F.col("row") == F.col("w_row"))).alias("kept"), F.col("digest").alias("text_sha256"))

    hot = rows.join(F.broadcast(found), "digest")
    cold = rows.join(F.broadcast(found.select("digest")), "digest", "left_anti")
    return decided(hot).unionByName(decided(cold.join(groups(cold), "digest", "left")))


def dedup(docs: DataFrame, heavy: int = HEAVY, tracked: int = TRACKED) -> DataFrame:
    """The rows of docs that stay, with all their columns.

    Copies of a frequent text go before any shuffle; what is left meets by digest.
    """
    rows = durable(docs.select("doc_id", digest_of().alias("digest"), F.monotonically_increasing_id().alias("row")))
    found = durable(winners(rows, frequent(rows, heavy, tracked)).select(F.col("digest").alias("__dedup_digest"), F.col("w_id").alias("__dedup_id"), F.lit(True).alias("__dedup_hot")))
    marked = docs.withColumn("__dedup_digest", digest_of()).join(F.broadcast(found), "__dedup_digest", "left")
    left = marked.where(F.col("__dedup_hot").isNull() | F.col("doc_id").eqNullSafe(F.col("__dedup_id")))
    order = W.partitionBy("__dedup_digest").orderBy(F.col("doc_id").asc_nulls_last())
    return left.withColumn("__dedup_n", F.row_number().over(order)).where("__dedup_n = 1").select(*docs.columns)
