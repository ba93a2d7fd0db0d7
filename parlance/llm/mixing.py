"""Mixing sources to target weights by Sainte-Lague apportionment.

Targets come from water-filling: the mixture's words are shared by weight, a
source's share stops at ``cap`` times its size, and the excess is shared again.
The mixture is cut into blocks of ``block`` words; sources get whole blocks by
the highest quotients target / (2 seats + 1).  A source's documents are dealt to
shards by a hash, about ``SHARD_DOCS`` to each, and in the same way its blocks
go to the shards with the highest quotients size / (2 seats + 1), where a shard
stops at cap times its size; words that make no whole block go to the first
shards with room.  In a shard the documents stand in a seeded order; full epochs
over them come first, and a seeded run of consecutive words is the rest, so that
all but two documents of a shard are taken whole.

A source of more than ``FAN`` shards (256,000 documents) is apportioned in
levels: its blocks go to FAN groups of shards at most, those of a group to its
parts, and so on, so no task ever sees more than FAN rows of a source, however
many documents it has.  Only the table of sources (one row each) comes to the
driver.  Sizes are counted in one pass; another one sends each text through one
shuffle, to its shard.

Defined results: a null text has no words; a null source is a source of its
own, the last one; empty documents take 0 words; repeated rows are separate
documents; reruns agree as the order is that of seeded hashes, doc_id, size and
text.  An empty table gives an empty result.  All columns of the input are kept
by ``mix`` and ignored otherwise, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parlance.llm.common import WORD, durable, spread, text_of

WEIGHTS, SHARE, CAP = (5, 2, 1), 1.5, 2
BLOCK, SHARD_DOCS, FAN, SEED = 64, 256, 1000, 17


def words_of(text: str = "text") -> Column:
    return F.regexp_count(text_of(text), F.lit(WORD)).cast("long")


def water_fill(sizes: list[int], weights: list[float], total: float, cap: float = CAP) -> list[float]:
    """Shares of total by weight, none above cap times its size while others have room.

    Sources are filled in the order of cap * size / weight: one is full if the
    unit that is left, when all before it are full, is above that.
    """
    left, weight, full = float(total), sum(weights), set()
    for i in sorted(range(len(sizes)), key=lambda i: cap * sizes[i] / weights[i]):
        if left / weight <= cap * sizes[i] / weights[i]:
            break
        full.add(i)
        left, weight = left - cap * sizes[i], weight - weights[i]
    return [float(cap * sizes[i]) if i in full else left / weight * weights[i] for i in range(len(sizes))]


def highest_quotients(shares, seats: int, most=None) -> list[int]:
    """Seats by the highest quotients share / (2 n + 1), up to most[i] of each; ties go to the first.

    Rounding with the ideal divisor comes close; from there seats are added, taken
    back or exchanged one at a time until none that is held has a lower quotient
    than one that isn't.
    """
    shares = np.asarray(shares, np.float64)
    most = np.full(len(shares), np.iinfo(np.int64).max) if most is None else np.asarray(most, np.int64)
    most = np.where(shares > 0, most, 0)
    if not len(shares) or seats <= 0 or not most.any():
        return [0] * len(shares)
    seats = min(seats, sum(most.tolist()))
    out = np.minimum(np.floor(shares * (seats / shares.sum()) + 0.5).astype(np.int64), most)
    more = np.where(out < most, shares / (2 * out + 1), -1.0)
    least = np.where(out > 0, shares / np.maximum(2 * out - 1, 1), np.inf)

    def move(i: int, by: int) -> None:
        out[i] += by
        more[i] = shares[i] / (2 * out[i] + 1) if out[i] < most[i] else -1.0
        least[i] = shares[i] / (2 * out[i] - 1) if out[i] else np.inf

    while True:
        gap = seats - int(out.sum())
        up, down = int(np.argmax(more)), len(out) - 1 - int(np.argmin(least[::-1]))
        if gap > 0:
            move(up, 1)
        elif gap < 0:
            move(down, -1)
        elif (more[up], -up) > (least[down], -down) and up != down:
            move(up, 1)
            move(down, -1)
        else:
            return out.tolist()


def deal(sizes, words: int, cap: float = CAP, block: int = BLOCK) -> list[int]:
    """The words of each shard of a source or group: whole blocks by quotients, then what is left to the first with room."""
    sizes = np.asarray(sizes, np.int64)
    held = np.floor(cap * sizes).astype(np.int64)
    out = np.array(highest_quotients(sizes, words // block, held // block), np.int64) * block
    room = held - out
    return (out + np.clip(words - out.sum() - (np.cumsum(room) - room), 0, room)).tolist()


def source_table(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP, block: int = BLOCK) -> list[tuple]:
    """(source, size, docs, target, words) of each source in code point order, null last; words is what the mixture takes."""
    rows = sizes.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("docs")).collect()
    rows = sorted(rows, key=lambda r: (r["source"] is None, r["source"] or ""))
    size = [r["size"] for r in rows]
    targets = water_fill(size, [weights[i % len(weights)] for i in range(len(rows))], share * sum(size), cap)
    quotas = highest_quotients(targets, int(sum(size) * min(share, cap) / block + 0.5))
    return [(r["source"], r["size"], r["docs"], t, min(q * block, int(cap * r["size"]))) for r, t, q in zip(rows, targets, quotas, strict=True)]


def shard_words(shards: DataFrame, words: DataFrame, levels: int, cap: float, block: int, fan: int) -> DataFrame:
    """s, h, words of each shard.  shards: s, h, size; words: s, words of each source, by the number s."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("part")
        return pa.table({"s": table["s"], "h": table["part"], "words": pa.array(deal(table["size"].to_numpy(), table["words"][0].as_py(), cap, block), pa.int64())})

    groups = words.select("s", F.lit(0).cast("long").alias("h"), "words")
    for level in range(1, levels + 1):
        parts = shards.groupBy("s", F.expr(f"h div {fan ** (levels - level)}L").alias("part")).agg(F.sum("size").alias("size"))
        parts = parts.withColumn("h", F.expr(f"part div {fan}L") if level > 1 else F.lit(0).cast("long"))
        groups = parts.join(groups, ["s", "h"]).groupBy("s", "h").applyInArrow(run, "s int, h long, words long")
    return groups


def plan(docs: DataFrame, size: Column | None = None, weights=WEIGHTS, share: float = SHARE, cap: float = CAP, block: int = BLOCK, seed: int = SEED, shard_docs: int = SHARD_DOCS, fan: int = FAN) -> DataFrame:
    """row, a struct of the columns of docs, with size, source_size, target, taken, and how the words are taken.

    epochs counts whole copies; words first to last (exclusive) are taken once
    more.  size is the number of words, counted in text if it isn't given.
    """
    spark = docs.sparkSession
    digits = lambda of, at: F.conv(F.substring(of, at, 15), 16, 10).cast("long")
    hashed = F.md5(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(str(seed))))
    tie = F.xxhash64("text") if "text" in docs.columns else F.lit(0).cast("long")
    rows = docs.select(F.struct("*").alias("row"), "source", F.coalesce(words_of() if size is None else size, F.lit(0)).alias("size"), hashed.alias("hash"), F.col("doc_id").alias("id"), tie.alias("tie"))
    sizes = durable(rows.select("source", "size", digits("hash", 16).alias("place")))
    found = source_table(sizes, weights, share, cap, block)
    count = [max(1, -(-docs_ // shard_docs)) for _, _, docs_, _, _ in found]
    table = [(k, name, n, of, target, words) for k, ((name, of, _, target, words), n) in enumerate(zip(found, count, strict=True))]
    table = spark.createDataFrame(table, "s int, name string, shards long, source_size long, target double, words long")
    levels = 1
    while fan**levels < max(count, default=1):
        levels += 1

    def in_shards(df: DataFrame, place: Column, *more: str) -> DataFrame:
        """df with the number of its source, the shard, and more of the table."""
        keep = df.columns
        return df.join(table, F.col("source").eqNullSafe(F.col("name"))).select(*keep, "s", F.pmod(place, F.col("shards")).alias("h"), *more)

    shards = durable(in_shards(sizes, F.col("place")).groupBy("s", "h").agg(F.sum("size").alias("size")))
    quotas = durable(shard_words(shards, table.select("s", "words"), levels, cap, block, fan))

    dealt = in_shards(rows, digits("hash", 16), "source_size", "target").withColumn("order", digits("hash", 1))
    # the join with the shards' words goes by the keys of the windows, so a row is sent once
    shard = W.partitionBy("s", "h")
    dealt = dealt.withColumn("end", F.sum("size").over(shard.orderBy("order", "id", "size", "tie").rowsBetween(W.unboundedPreceding, 0)))
    out = dealt.join(quotas.join(shards.withColumnRenamed("size", "of"), ["s", "h"]), ["s", "h"])
    out = out.withColumn("epochs", F.expr("IF(of > 0, words div of, 0)"))
    out = out.withColumn("rest", F.col("words") - F.col("epochs") * F.col("of"))
    places = F.expr(f"(of - rest) div {block} + 1")
    out = out.withColumn("start", block * F.pmod(digits(F.md5(F.concat_ws("|", "s", "h", F.lit(str(seed)))), 1), places))
    begin = F.col("end") - F.col("size")
    out = out.withColumn("first", F.least(F.col("size"), F.greatest(F.lit(0), F.col("start") - begin)))
    out = out.withColumn("last", F.greatest(F.col("first"), F.least(F.col("size"), F.col("start") + F.col("rest") - begin)))
    out = out.withColumn("taken", F.col("epochs") * F.col("size") + F.col("last") - F.col("first"))
    return out.select("row", "size", "source_size", "target", "taken", "epochs", "first", "last")


def taken(docs: DataFrame, **how) -> DataFrame:
    """doc_id, size, source_size, target, taken: one row for each row of docs."""
    sized = durable(spread(docs.select("doc_id", "source", "text")).select("doc_id", "source", words_of().alias("size")))
    return plan(sized, F.col("size"), **how).select("row.doc_id", "size", "source_size", "target", "taken")


def mix(docs: DataFrame, **how) -> DataFrame:
    """The mixture itself, with the columns of docs: a row for each whole copy and one for a part.

    A part has its words joined by one space, and its own n_chars if docs has that column.
    """
    part = F.col("last") - F.col("first")
    whole = part == F.col("size")
    copies = F.col("epochs") + F.when((part > 0) & whole, 1).otherwise(0)
    kinds = F.concat(F.array_repeat(F.lit(True), copies.cast("int")), F.when((part > 0) & ~whole, F.array(F.lit(False))).otherwise(F.array().cast("array<boolean>")))
    rows = plan(docs, **how).withColumn("whole", F.explode(kinds))
    words = F.regexp_extract_all(text_of("row.text"), F.lit(WORD), F.lit(0))
    cut = F.concat_ws(" ", F.slice(words, (F.col("first") + 1).cast("int"), part.cast("int")))
    made = {"text": F.when(F.col("whole"), F.col("row.text")).otherwise(cut)}
    if "n_chars" in docs.columns:
        made["n_chars"] = F.when(F.col("whole"), F.col("row.n_chars")).otherwise(F.length(cut).cast("long"))
    return rows.select(*[made.get(c, F.col("row")[c]).alias(c) for c in docs.columns])
