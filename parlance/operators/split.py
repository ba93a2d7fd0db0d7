"""Splits, samples, schedules and mixtures.

Whatever is random is the order of md5(key | seed): it is the same in every run,
on every cluster and in every engine.  A global rank comes from counts by hash
prefix or by range and never from a window over all rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parlance.schemas import SET_ORDER
from parlance.sources.stages import materialized


def seeded(key: str | Column, seed: int | str) -> Column:
    """The seeded order of a key."""
    key = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat_ws("|", key.cast("string"), F.lit(str(seed))))


def ranked(rows: DataFrame, key: str | Column, seed: int | str, name: str = "rn") -> DataFrame:
    """rows with their 1-based rank in the seeded order of a key, without a window over all rows.

    A rank is the rank among the hashes with the same first four digits, and the
    rows before these, which are counted by 65,536 groups at most.
    """
    rows = rows.withColumn("__h", seeded(key, seed)).withColumn("__p", F.substring("__h", 1, 4))
    sizes = rows.groupBy("__p").agg(F.count("*").alias("__n"))
    before = sizes.select("__p", (F.sum("__n").over(W.orderBy("__p").rowsBetween(W.unboundedPreceding, 0)) - F.col("__n")).alias("__before"))
    out = rows.withColumn("__r", F.row_number().over(W.partitionBy("__p").orderBy("__h", key))).join(F.broadcast(before), "__p")
    return out.withColumn(name, F.col("__r") + F.col("__before")).drop("__h", "__p", "__r", "__before")


def running_total(rows: DataFrame, order: list[str], value: Column, name: str, group: str | None = None) -> DataFrame:
    """rows with the sum of value up to and with each row, in an order without ties, in each group if there is one.

    value is a number, or a struct of numbers that are summed each.

    Rows are sorted by range; a row's total is that of its range so far and of
    the ranges before it.  So neither the table nor a group with a third of it is
    one task.
    """
    keys = [group] if group else []
    parts = materialized(rows.withColumn("__rt_v", value).repartitionByRange(*keys, *order).withColumn("__rt_p", F.spark_partition_id()))
    kind = parts.schema["__rt_v"].dataType
    each = lambda f, *columns: F.struct(*[f(*[F.col(c)[x] for c in columns]).alias(x) for x in kind.names]) if kind.typeName() == "struct" else f(*map(F.col, columns))
    sums = parts.groupBy(*keys, "__rt_p").agg(each(F.sum, "__rt_v").alias("__rt_s"))
    upto = (W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))).orderBy("__rt_p").rowsBetween(W.unboundedPreceding, 0)
    before = sums.select(F.col("__rt_p").alias("__rt_q"), *[F.col(g).alias("__rt_g") for g in keys], each(lambda s: F.sum(s).over(upto) - s, "__rt_s").alias("__rt_before"))
    same = parts["__rt_p"] == before["__rt_q"]
    if group:
        same = same & parts[group].eqNullSafe(before["__rt_g"])
    inside = W.partitionBy("__rt_p", *keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    own = each(lambda v: F.sum(v).over(inside), "__rt_v")
    out = parts.withColumn("__rt_own", own).join(before, same)
    return out.withColumn(name, each(lambda a, b: a + b, "__rt_own", "__rt_before")).drop("__rt_v", "__rt_p", "__rt_q", "__rt_g", "__rt_own", "__rt_before")


def numbered(rows: DataFrame, order: list[str], name: str = "rn", group: str | None = None) -> DataFrame:
    """rows with their 1-based rank in an order without ties, in each group if there is one."""
    return running_total(rows, order, F.lit(1).cast("long"), name, group)


def top_n(rows: DataFrame, groups: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each group.  A group is first cut to n rows in each of 64 parts, so it may be large."""
    salt = F.pmod(F.xxhash64(*order), F.lit(64))
    first = rows.withColumn("__salt", salt).withColumn("__r", F.row_number().over(W.partitionBy(*groups, "__salt").orderBy(*order))).where(F.col("__r") <= n)
    return first.withColumn("__r", F.row_number().over(W.partitionBy(*groups).orderBy(*order))).where(F.col("__r") <= n).drop("__r", "__salt")


def stratified(rows: DataFrame, strata: list[str], key: str, n: int, seed: int = 42, on_small: str = "skip") -> DataFrame:
    """rows with split: of each stratum n keys are test, the rest train.

    A stratum with fewer than n rows has no test rows (on_small = "skip") or
    fails the job ("raise").
    """
    order = F.struct(seeded(key, seed).alias("h"), F.col(key).alias("k"))
    best = top_n(rows.select(*strata, order.alias("o")), strata, [F.col("o")], n)
    counts = rows.groupBy(*strata).agg(F.count("*").alias("__n"))
    same = reduce(lambda a, b: a & b, [best[s].eqNullSafe(counts[s]) for s in strata])
    enough = F.when(F.col("__n") < n, F.raise_error(F.lit("a stratum is too small")).cast("boolean")).otherwise(True) if on_small == "raise" else F.col("__n") >= n
    test = best.join(counts, same).where(enough).select(F.col("o.k").alias("__k"))
    return rows.join(test, rows[key] == F.col("__k"), "left").withColumn("split", F.when(F.col("__k").isNotNull(), "test").otherwise("train")).drop("__k")


def by_ids(rows: DataFrame, ids: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(train, test) by a list of held-out ids."""
    return rows.join(ids, key, "left_anti"), rows.join(ids, key, "left_semi")


def train_validation(rows: DataFrame, key: str, size: float, seed: int = 42) -> DataFrame:
    """rows with split: validation are the first size rows, or the floor of that share, in seeded order."""
    total = rows.count()
    n = int(size) if size >= 1 else int(total * size)
    return ranked(rows, key, seed).withColumn("split", F.when(F.col("rn") <= n, "validation").otherwise("train")).drop("rn")


def sample_n(rows: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """Exactly n rows: a seeded order of all, and where n is larger, further passes in orders of their own seeds.

    The column draw numbers the passes.
    """
    total = rows.count()
    if total == 0 or n <= 0:
        return rows.withColumn("draw", F.lit(0)).limit(0)
    whole, rest = divmod(n, total)
    last = ranked(rows, key, f"{seed}-{whole}").where(F.col("rn") <= rest).drop("rn").withColumn("draw", F.lit(whole))
    if not whole:
        return last
    return rows.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(whole - 1)))).unionByName(last)


def buckets(rows: DataFrame, key: str, sizes: list[tuple[str, int]], seed: int = 42) -> DataFrame:
    """rows with bucket: disjoint samples of the given sizes in seeded order; null beyond them."""
    upto, bucket = 0, F.lit(None).cast("string")
    cases = []
    for name, size in sizes:
        upto += size
        cases.append((upto, name))
    for most, name in reversed(cases):
        bucket = F.when(F.col("rn") <= most, F.lit(name)).otherwise(bucket)
    return ranked(rows, key, seed).withColumn("bucket", bucket).drop("rn")


def renumbered(rows: DataFrame, order: list[str], prefix: str, start: int) -> DataFrame:
    """rows with dialogue_id, numbered from start in order."""
    out = numbered(rows, order)
    return out.withColumn("dialogue_id", F.format_string(f"{prefix}%06d", F.col("rn") - 1 + start)).drop("rn")


def pair_schedule(spark, emotions: tuple[str, ...], repeats: int, per_request: int, seed: int = 42) -> DataFrame:
    """request, place and an ordered pair of emotions: all pairs, each repeats times, in seeded order."""
    e = spark.createDataFrame([(x,) for x in emotions], "emotion string")
    pairs = e.select(F.col("emotion").alias("human"), F.explode(F.array(*map(F.lit, emotions))).alias("chatbot"))
    each = pairs.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(repeats))))
    rows = ranked(each.withColumn("pair", F.concat_ws("-", "human", "chatbot", F.col("copy").cast("string"))), "pair", seed)
    return rows.select(F.floor((F.col("rn") - 1) / per_request).alias("request"), ((F.col("rn") - 1) % per_request).alias("place"), "human", "chatbot")


def per_group(rows: DataFrame, group: str, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows of each group in seeded order, as a support set."""
    return top_n(rows, [group], [seeded(key, seed), F.col(key)], n)


def concatenated(sets: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), sets)


def set_rank(column: str = "set", strict: bool = False) -> Column:
    """The place of a set; an unknown one comes last, or fails the job if strict."""
    out = F.lit(len(SET_ORDER)) if not strict else F.raise_error(F.concat(F.lit("unknown set "), F.col(column))).cast("int")
    for k, name in reversed(list(enumerate(SET_ORDER))):
        out = F.when(F.col(column) == name, F.lit(k)).otherwise(out)
    return out


def merged(sets: list[DataFrame], order: str, strict: bool = False) -> DataFrame:
    """All sets in set order, each in its own order."""
    return concatenated(sets).orderBy(set_rank(strict=strict), order)


def interleaved(rows: DataFrame, source: str, order: str, stop: str = "first_exhausted") -> DataFrame:
    """rows in turn from each source, numbered by turn: until the first source ends, or until all have, starting over."""
    sizes = rows.groupBy(source).agg(F.count("*").alias("__n"))
    low, high = sizes.agg(F.min("__n"), F.max("__n")).first()
    turns = numbered(rows, [order], "turn", source).withColumn("turn", (F.col("turn") - 1).cast("int"))
    if stop == "first_exhausted":
        return turns.where(F.col("turn") < low)
    again = turns.join(sizes, source)
    times = F.sequence(F.lit(0), F.floor((F.lit(high) - 1 - F.col("turn")) / F.col("__n")))
    return again.withColumn("__k", F.explode(times)).withColumn("turn", F.col("turn") + F.col("__k") * F.col("__n")).drop("__k", "__n")


def drawn(rows: DataFrame, source: str, order: str, probabilities: dict[str, float], seed: int = 42, stop: str = "first_exhausted") -> DataFrame:
    """rows of sources that are drawn by chance, with position: each source's rows in turn, until one or all of them have ended.

    Which source stands at a position follows from a hash of it, so the mixture is
    laid out by counting and joined to the rows; a source that starts over repeats
    its rows.  Only the sizes of the sources, one for each probability, come to the driver.
    """
    spark, names = rows.sparkSession, list(probabilities)
    sizes = {r[source]: r["n"] for r in rows.where(F.col(source).isin(names)).groupBy(source).agg(F.count("*").alias("n")).collect()}
    if set(sizes) != set(names):
        raise ValueError(f"sources without rows: {sorted(set(names) - set(sizes))}")
    total, upto = sum(probabilities.values()), []
    for name in names:
        upto.append((name, sum(probabilities[x] for x in names[: len(upto) + 1]) / total))
    pick = min if stop == "first_exhausted" else max
    n = int(1.25 * pick(sizes[x] * total / probabilities[x] for x in names)) + 100
    while True:
        chance = F.conv(F.substring(seeded("position", seed), 1, 8), 16, 10).cast("long") / float(1 << 32)
        of = F.lit(names[-1])
        for name, end in reversed(upto[:-1]):
            of = F.when(chance < end, F.lit(name)).otherwise(of)
        places = spark.range(n).withColumnRenamed("id", "position").withColumn("__of", of)
        places = materialized(numbered(places, ["position"], "__k", "__of"))
        most = F.create_map(*[F.lit(x) for item in sizes.items() for x in item])
        ends = [r["position"] for r in places.where(F.col("__k") == F.try_element_at(most, F.col("__of"))).select("position").collect()]
        if len(ends) == len(names) or (ends and stop == "first_exhausted"):
            break
        n *= 2
    kept = places.where(F.col("position") <= pick(ends)).withColumn("__k", (F.col("__k") - 1) % F.try_element_at(most, F.col("__of")) + 1)
    own = numbered(rows.where(F.col(source).isin(names)), [order], "__r", source)
    return own.join(kept, (own[source] == kept["__of"]) & (own["__r"] == kept["__k"])).drop("__of", "__k", "__r")


def first_seen(rows: DataFrame, column: str, order: str) -> DataFrame:
    """Distinct values in the order in which they first stand."""
    return rows.groupBy(column).agg(F.min(order).alias("first")).orderBy("first")


def labels_of(rows: DataFrame, *columns: str) -> DataFrame:
    """The union of the values of several columns."""
    return rows.select(F.explode(F.array(*columns)).alias("label")).distinct()


def head(rows: DataFrame, order: str, n: int, offset: int = 0) -> DataFrame:
    return rows.orderBy(order).offset(offset).limit(n)
