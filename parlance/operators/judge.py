"""From judges' rates to preference pairs.

Everything stays keyed by dialogue and response: judges are long rows, not
positional columns, and texts are joined after pairs are made.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parlance.functions.score import rescale_z
from parlance.functions.text import id_prefix


def zscore(rates: DataFrame, by: list[str], value: str = "rate") -> DataFrame:
    """rates with z, the value standardised over each group with the sample deviation; null for groups of one row.

    The groups' means and deviations are aggregated first and joined, so a judge
    with a third of all rows is no single window.
    """
    stats = rates.groupBy(*by).agg(F.avg(value).alias("__mean"), F.stddev_samp(value).alias("__std"))
    out = rates.join(stats, by)
    return out.withColumn("z", F.try_divide(F.col(value) - F.col("__mean"), F.col("__std"))).drop("__mean", "__std")


def rescaled(rates: DataFrame, by: list[str], value: str = "rate") -> DataFrame:
    """rates with z and rescaled, an integer around 5 that isn't clamped."""
    return zscore(rates, by, value).withColumn("rescaled", rescale_z(F.col("z")))


def overall(rates: DataFrame, dialogue: str = "dialogue_id", response: str = "response", value: str = "rescaled") -> DataFrame:
    """Mean and sample deviation over judges of each response, and its dense rank in the dialogue, best first."""
    means = rates.groupBy(dialogue, response).agg(F.avg(value).alias("mean_overall"), F.stddev_samp(value).alias("std_overall"))
    return means.withColumn("rank", F.dense_rank().over(W.partitionBy(dialogue).orderBy(F.col("mean_overall").desc())))


def rank_arrays(ranks: DataFrame, dialogue: str = "dialogue_id", response: str = "response") -> DataFrame:
    """The ranks of each dialogue's responses as an array in response order."""
    return ranks.groupBy(dialogue).agg(F.transform(F.sort_array(F.collect_list(F.struct(response, "rank"))), lambda x: x["rank"]).alias("ranks"))


def with_sentinel(ranks: Column, modified: Column) -> Column:
    """The ranks, and for a modified dialogue one more response that is worse than all."""
    return F.when(modified, F.concat(ranks, F.array(F.array_max(ranks) + 1))).otherwise(ranks)


def winner_loser(ranks: Column) -> Column:
    """(winner, loser) of all pairs of 1-based places with different ranks, by first and second place."""
    n = F.size(ranks)
    at = lambda k: F.get(ranks, k - 1)
    ordered = lambda i, j: F.when(at(i) < at(j), F.struct(i.alias("winner"), j.alias("loser"))).when(at(i) > at(j), F.struct(j.alias("winner"), i.alias("loser")))
    rest = lambda i: F.when(i < n, F.transform(F.sequence(i + 1, F.greatest(n, i + 1)), lambda j: ordered(i, j)))
    pairs = F.flatten(F.filter(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), rest), lambda a: a.isNotNull()))
    return F.filter(pairs, lambda p: p.isNotNull())


def preference_pairs(ranks: DataFrame, keep: list[str], column: str = "ranks") -> DataFrame:
    """keep, pair_no (order of generation), winner, loser: a row for each pair."""
    return ranks.select(*keep, F.posexplode(winner_loser(F.col(column))).alias("pair_no", "pair")).select(*keep, "pair_no", F.col("pair.winner").alias("winner"), F.col("pair.loser").alias("loser"))


def preference_ids(pairs: DataFrame, dialogue: str = "dialogue_id", order: str = "pair_no", prefix: str = "RLAIFEP-", digits: int = 4) -> DataFrame:
    """pairs with preference_id: what follows the dialogue's first dash, and a running number from 0 in it."""
    n = F.row_number().over(W.partitionBy(dialogue).orderBy(order)) - 1
    return pairs.withColumn("preference_id", F.concat(F.lit(prefix), id_prefix(F.col(dialogue)), F.lit("-"), F.format_string(f"%0{digits}d", n)))


def pick(target: Column, predictions: Column, index: Column) -> Column:
    """Response 1 is the target, k the prediction k - 1."""
    return F.when(index == 1, target).otherwise(F.get(predictions, index - 2))


def drop_equal(pairs: DataFrame, winner: str = "winner_response", loser: str = "loser_response") -> DataFrame:
    """Pairs whose two texts differ; a pair with a missing text stays."""
    return pairs.where(~F.coalesce(F.col(winner) == F.col(loser), F.lit(False)))


def lookup_levels(rows: DataFrame, source: DataFrame, value: str, by_id: str, by_all: list[str], by_one: str, default) -> DataFrame:
    """rows with value found by id, else by all of by_all, else by by_one if that names one source row, else default."""
    one = lambda keys, name: source.groupBy(*keys).agg(F.min_by(value, by_id).alias(name), F.count("*").alias(f"{name}_n"))
    out = rows.join(one([by_id], "__a").drop("__a_n"), by_id, "left").join(one(by_all, "__b").drop("__b_n"), by_all, "left")
    unique = one([by_one], "__c").where("__c_n = 1").drop("__c_n")
    return out.join(unique, by_one, "left").withColumn(value, F.coalesce("__a", "__b", "__c", F.lit(default))).drop("__a", "__b", "__c")


def mandatory_lookup(rows: DataFrame, source: DataFrame, key: str, order: str) -> DataFrame:
    """rows with the first source row of their key; a key without one fails the job."""
    first = source.withColumn("__n", F.row_number().over(W.partitionBy(key).orderBy(order))).where("__n = 1").drop("__n").withColumn("__found", F.lit(True))
    joined = rows.join(first, key, "left")
    return joined.where(F.when(F.col("__found").isNull(), F.raise_error(F.concat(F.lit("no row for "), F.col(key).cast("string"))).isNull()).otherwise(True)).drop("__found")


def judge_statistics(rates: DataFrame, judge: str = "judge", value: str = "rate") -> DataFrame:
    """Mean and population deviation of each judge's rates."""
    return rates.groupBy(judge).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.count("*").alias("n"))


def judge_differences(rates: DataFrame, keys: list[str], judge: str = "judge", value: str = "rate") -> DataFrame:
    """Mean difference of each two judges over what both rated."""
    other = rates.select(*keys, F.col(judge).alias("other"), F.col(value).alias("__other"))
    return rates.join(other, keys).where(F.col(judge) < F.col("other")).groupBy(judge, "other").agg(F.avg(F.col(value) - F.col("__other")).alias("mean_difference"), F.count("*").alias("n"))
