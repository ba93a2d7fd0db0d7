"""Packing of examples into sequences of one length."""

from __future__ import annotations

from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.operators.encode import PAD
from parlance.schemas import IGNORE


def knapsacks(lengths: list[int], capacity: int) -> list[list[int]]:
    """Groups of places: each takes the longest length that still fits, again and again.  Lengths over the capacity are left out."""
    order = sorted((n, k) for k, n in enumerate(lengths) if n <= capacity)
    sizes = [n for n, _ in order]
    out = []
    while sizes:
        left, group = capacity, []
        while (at := bisect_right(sizes, left)) > 0:
            left -= sizes.pop(at - 1)
            group.append(order.pop(at - 1)[1])
        out.append(group)
    return out


def packed(rows: DataFrame, batch: str, key: str, length: str, cutoff: int) -> DataFrame:
    """batch, key, knapsack, place: where each row of a batch is packed.  Rows longer than the cutoff less 1 are left out.

    Packing is sequential inside a batch, whose size its column bounds; batches are packed side by side.
    """

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by(key)
        groups = knapsacks(table.column(length).to_pylist(), cutoff - 1)
        keys, own = table.column(key), table.column(batch)
        at = [k for g in groups for k in g]
        return pa.table({batch: own.take(pa.array(at, pa.int64())), key: keys.take(pa.array(at, pa.int64())), "knapsack": pa.array([i for i, g in enumerate(groups) for _ in g], pa.int32()), "place": pa.array([j for g in groups for j in range(len(g))], pa.int32())})

    kind = lambda c: rows.schema[c].dataType.simpleString()
    return rows.select(batch, key, length).groupBy(batch).applyInArrow(run, f"{batch} {kind(batch)}, {key} {kind(key)}, knapsack int, place int")


def sequences(rows: DataFrame, plan: DataFrame, batch: str, key: str, cutoff: int, neat: bool = True) -> DataFrame:
    """input_ids, attention_mask and labels of each knapsack, filled up to the cutoff.

    With neat the mask numbers the packed examples from 1 and is 0 in the fill.
    """
    each = F.sort_array(F.collect_list(F.struct("place", "input_ids", "labels")))
    out = plan.join(rows.select(key, "input_ids", "labels"), key).groupBy(batch, "knapsack").agg(each.alias("x"))
    ids, labels = F.flatten(F.transform("x", lambda x: x["input_ids"])), F.flatten(F.transform("x", lambda x: x["labels"]))
    mask = F.flatten(F.transform("x", lambda x, k: F.array_repeat((k + 1).cast("int") if neat else F.lit(1), F.size(x["input_ids"]))))
    fill = lambda a, v: F.concat(a, F.array_repeat(F.lit(v), F.lit(cutoff) - F.size(a)))
    return out.select(batch, "knapsack", fill(ids, PAD).alias("input_ids"), fill(mask, 0 if neat else 1).alias("attention_mask"), fill(labels, IGNORE).alias("labels"))


def lengths_of(mask: Column) -> Column:
    """Lengths of the numbered examples of a mask."""
    return F.filter(F.transform(F.sequence(F.lit(1), F.greatest(F.array_max(mask), F.lit(1))), lambda k: F.size(F.filter(mask, lambda x: x == k))), lambda n: n > 0)


def boundaries(rows: DataFrame, key: str, mask: str) -> DataFrame:
    """key, id, length and cumulative length of each numbered example of a row."""
    each = rows.select(key, F.posexplode(lengths_of(F.col(mask))).alias("__k", "length"), F.col(mask).alias("__m"))
    sums = F.aggregate(F.slice(lengths_of(F.col("__m")), F.lit(1), F.col("__k") + 1), F.lit(0), lambda a, b: a + b)
    return each.select(key, (F.col("__k") + 1).alias("id"), "length", sums.alias("cumulative"))


def attended(mask: Column) -> Column:
    """0-based places that aren't fill."""
    return F.filter(F.transform(mask, lambda x, k: F.when(x != 0, k)), lambda k: k.isNotNull())


def block_mask(mask: Column) -> Column:
    """Rows of 1 and 0: place i sees place j of its own example up to itself."""
    return F.transform(mask, lambda x, i: F.transform(mask, lambda y, j: F.when((x != 0) & (x == y) & (j <= i), 1).otherwise(0)))
