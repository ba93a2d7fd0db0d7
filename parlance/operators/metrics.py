"""Evaluation and training metrics."""

from __future__ import annotations

import math
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from parlance.functions.score import let, percent, running, total
from parlance.operators.split import numbered, running_total
from parlance.schemas import IGNORE
from parlance.sources.stages import materialized


def classification(rows: DataFrame, by: list[str], truth: str = "y_true", pred: str = "y_pred") -> DataFrame:
    """hits, total, accuracy and macro F1, precision and recall of each group and, with nulls in by, of all rows.

    Labels are those that are true or predicted in the group; what would be
    divided by 0 is 0.  One confusion count of all groups is the only pass over
    the rows.
    """
    level = F.grouping_id().alias("__level")
    cells = rows.groupBy(*by, truth, pred).agg(F.count("*").alias("__n"))
    cells = cells.groupingSets([[*by, truth, pred], [truth, pred]], *by, truth, pred).agg(F.sum("__n").alias("__n"), level) if by else cells.withColumn("__level", F.lit(0))
    keys = ["__level", *by]
    sides = cells.select(*keys, F.explode(F.array(F.struct(F.col(truth).alias("label"), F.lit(True).alias("is_true")), F.struct(F.col(pred).alias("label"), F.lit(False).alias("is_true")))).alias("x"), "__n", (F.col(truth) == F.col(pred)).alias("hit"))
    label = sides.groupBy(*keys, "x.label").agg(
        F.sum(F.when(F.col("hit") & F.col("x.is_true"), F.col("__n")).otherwise(0)).alias("tp"),
        F.sum(F.when(F.col("x.is_true"), F.col("__n")).otherwise(0)).alias("true"),
        F.sum(F.when(~F.col("x.is_true"), F.col("__n")).otherwise(0)).alias("pred"),
    )
    zero = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    tp, true, pred_n = F.col("tp"), F.col("true"), F.col("pred")
    out = label.groupBy(*keys).agg(
        F.sum("tp").alias("hits"), F.sum("true").alias("total"), zero(F.sum("tp"), F.sum("true")).alias("accuracy"), F.avg(zero(2 * tp, true + pred_n)).alias("f1"), F.avg(zero(tp, pred_n)).alias("precision"), F.avg(zero(tp, true)).alias("recall")
    )
    return out.drop("__level")


def agreement(rows: DataFrame, user: Column, chatbot: Column, third: Column, by: list[str] = ()) -> DataFrame:
    """Counts and percentages of three agreements."""
    parts = {"user": user, "chatbot": chatbot, "neutral": third}
    out = rows.groupBy(*by).agg(F.count("*").alias("total_examples"), *[F.sum(F.coalesce(c.cast("int"), F.lit(0))).alias(f"{k}_correct") for k, c in parts.items()])
    return out.select(*by, "total_examples", *[c for k in parts for c in (f"{k}_correct", percent(F.col(f"{k}_correct"), F.col("total_examples")).alias(f"{k}_percentage"))])


def mean_tags(rows: DataFrame, text: str) -> Column:
    return F.avg(F.size(F.regexp_extract_all(text, F.lit(r"\(.*?\)"), F.lit(0))))


def token_accuracy(rows: DataFrame, pred: str = "pred", labels: str = "labels") -> DataFrame:
    """Mean over rows of the share of right predictions among labels that count; pred[t] belongs to labels[t + 1]."""
    after = F.slice(labels, F.lit(2), F.greatest(F.size(labels) - 1, F.lit(0)))
    hits = F.zip_with(F.slice(pred, F.lit(1), F.greatest(F.size(pred) - 1, F.lit(0))), after, lambda p, y: F.when(y != IGNORE, (p == y).cast("int")))
    kept = F.filter(hits, lambda x: x.isNotNull())
    return rows.withColumn("accuracy", F.try_divide(total(kept), F.size(kept)))


def reward_accuracy(rows: DataFrame) -> DataFrame:
    """Share of pairs whose chosen reward is higher."""
    return rows.agg(F.avg((F.col("chosen") > F.col("rejected")).cast("int")).alias("accuracy"), F.count("*").alias("n"))


def category_accuracy(rows: DataFrame, category: str, right: Column, total_name: str = "Average") -> DataFrame:
    """Accuracy in percent of each category, and of all rows under total_name."""
    out = rows.withColumn("__right", right.cast("int")).rollup(category).agg(F.avg("__right").alias("__a"), F.count("*").alias("n"), F.grouping(category).alias("__all"))
    return out.select(F.when(F.col("__all") == 1, total_name).otherwise(F.col(category)).alias("category"), (100 * F.col("__a")).alias("accuracy"), "n")


def score_lines(scores: DataFrame) -> DataFrame:
    """scores with line, the text of a score log."""
    return scores.withColumn("line", F.format_string("%15s: %.2f", "category", "accuracy"))


def length_cdf(rows: DataFrame, length: str, interval: int = 1000) -> DataFrame:
    """bin, n, running count and running percentage.  The window runs over bins, which are few, not over rows."""
    bins = rows.groupBy((F.floor(F.col(length) / interval) * interval).alias("bin")).agg(F.count("*").alias("n"))
    upto = W.orderBy("bin").rowsBetween(W.unboundedPreceding, W.currentRow)
    out = bins.withColumn("running", F.sum("n").over(upto))
    return out.withColumn("percentage", 100.0 * F.col("running") / F.sum("n").over(W.partitionBy(F.lit(0))))


def learning_rate(rows: DataFrame, labels: str, padded: str, cutoff: int, batch: int, base: float = 3e-4, base_batch: int = 4_194_304, divide_by: float = 1.0) -> DataFrame:
    """Share of labels that count, tokens of an effective batch, and a learning rate by the root of their ratio."""
    kept = F.size(F.filter(labels, lambda x: x != IGNORE))
    out = rows.agg(F.sum(kept).alias("valid"), F.sum(padded).alias("all"))
    ratio = F.try_divide(F.col("valid"), F.col("all"))
    tokens = batch * cutoff * ratio
    return out.select(ratio.alias("valid_ratio"), tokens.alias("batch_tokens"), (base * F.sqrt(tokens / base_batch) / divide_by).alias("learning_rate"))


def preference_batches(rows: DataFrame, batch: str, beta: float = 0.1) -> DataFrame:
    """Means of rewards, accuracies, margins and log-probabilities of each batch."""
    c, r = beta * F.col("logps_chosen"), beta * F.col("logps_rejected")
    return rows.groupBy(batch).agg(
        F.avg(c).alias("rewards_chosen"), F.avg(r).alias("rewards_rejected"), F.avg((c > r).cast("int")).alias("accuracy"), F.avg(c - r).alias("margin"), F.avg("logps_chosen").alias("logps_chosen"), F.avg("logps_rejected").alias("logps_rejected")
    )


def feedback_sums(rows: DataFrame, by: list[str]) -> DataFrame:
    """Counts, sums and means of rewards by by, which holds whether a response is desired."""
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.sum("reward").alias("reward_sum")).withColumn("reward_mean", F.try_divide("reward_sum", "n"))


def feedback_margin(sums: DataFrame, key: str) -> DataFrame:
    """Mean reward of desired less that of undesired responses; null if one of them is missing."""
    of = lambda d: F.max(F.when(F.col("desired") == d, F.col("reward_mean")))
    return sums.groupBy(key).agg((of(True) - of(False)).alias("margin"))


def running_mean(rows: DataFrame, by: list[str], order: str, value: str, n: str) -> DataFrame:
    """rows with the mean so far of value, weighted by n, of each group; a group may hold a third of all rows."""
    grouped = rows.withColumn("__g", F.to_json(F.struct(*by), {"ignoreNullFields": "false"}))
    sums = running_total(grouped, [order], F.struct((F.col(value) * F.col(n)).alias("v"), F.col(n).alias("n")), "__s", "__g")
    return sums.withColumn("running", F.col("__s.v") / F.col("__s.n")).drop("__g", "__s")


def smoothed(rows: DataFrame, by: list[str], order: str, value: str, part: int = 1024) -> DataFrame:
    """Exponential smoothing of each series; the weight w grows with its length.

    A value is w times the one before it and 1 - w times the row's own.  A series is
    cut into parts of so many rows, each smoothed from 0; what a part begins with
    follows from the last values of the parts before it, and fades by w with each row.
    """
    grouped = rows.select(*by, F.col(order).alias("__o"), F.col(value).cast("double").alias("__v"), F.to_json(F.struct(*by), {"ignoreNullFields": "false"}).alias("__g"))
    placed = numbered(grouped, ["__o"], "__i", "__g").withColumn("__c", F.floor((F.col("__i") - 1) / part))
    inside = F.sort_array(F.collect_list(F.struct("__i", "__o", "__v")))
    parts = materialized(placed.groupBy("__g", *by, "__c").agg(inside.alias("__s")))
    fade = lambda a, x: F.struct((a["w"] * x["w"]).alias("w"), (a["v"] * x["w"] + x["v"]).alias("v"))

    w = F.col("__w")
    lengths = parts.groupBy("__g").agg(F.sum(F.size("__s")).alias("__n"), F.min_by(F.get("__s", F.lit(0))["__v"], "__c").alias("__first"))
    lengths = lengths.withColumn("__w", 1.8 * (1 / (1 + F.exp(-0.05 * F.col("__n"))) - 0.5))
    own = running(F.transform("__s", lambda x: F.struct(w.alias("w"), ((1 - w) * x["__v"]).alias("v"))), fade)
    parts = materialized(parts.join(lengths, "__g").withColumn("__out", own))
    ends = parts.groupBy("__g").agg(F.sort_array(F.collect_list(F.struct("__c", F.element_at("__out", -1).alias("x")))).alias("__e"), F.first("__first").alias("__f"))
    # before the first part stands the first value itself
    begins = F.concat(F.array(F.struct(F.lit(1.0).alias("w"), F.col("__f").alias("v"))), F.transform("__e", lambda e: F.struct(e["x"]["w"].alias("w"), e["x"]["v"].alias("v"))))
    begins = ends.select("__g", F.posexplode(running(begins, fade)).alias("__c", "__b")).select("__g", F.col("__c").cast("long"), "__b.v")
    out = parts.join(begins, ["__g", "__c"]).select(*by, "v", F.explode(F.arrays_zip(F.col("__s").alias("s"), F.col("__out").alias("o"))).alias("x"))
    return out.select(*by, F.col("x.s.__o").alias(order), (F.col("v") * F.col("x.o.w") + F.col("x.o.v")).alias("smoothed"))


def effective_tokens_per_second(rows: DataFrame, ids: str, epochs: float, seconds: float) -> DataFrame:
    return rows.agg((F.sum(F.size(ids)) * epochs / seconds).alias("tokens_per_second"))


def rouge_n(a: Column, b: Column, n_grams) -> Column:
    """F of the distinct n-grams of two word arrays, in percent, to four places."""

    def score(s: Column) -> Column:
        # 2 p r / (p + r) with p = both / x and r = both / y
        both = F.size(F.array_intersect(s["x"], s["y"]))
        return F.bround(100 * F.coalesce(F.try_divide(2.0 * both, F.size(s["x"]) + F.size(s["y"])), F.lit(0.0)), 4)

    return let(F.struct(F.array_distinct(n_grams(a)).alias("x"), F.array_distinct(n_grams(b)).alias("y")), score)


def _lcs(a: list, b: list) -> int:
    """Length of the longest common subsequence; the columns of its table are the bits of one number."""
    places: dict = {}
    for j, y in enumerate(b):
        places[y] = places.get(y, 0) | 1 << j
    every = (1 << len(b)) - 1
    row = every
    for x in a:
        hit = row & places.get(x, 0)
        row = (row + hit | row - hit) & every
    return len(b) - row.bit_count()


@F.pandas_udf(DoubleType())
def rouge_l(hypothesis: pd.Series, reference: pd.Series) -> pd.Series:
    """F of the longest common subsequence of words, in percent, to four places."""

    def one(a: str, b: str) -> float:
        x, y = (a or "").split(), (b or "").split()
        both = _lcs(x, y) if x and y else 0
        return round(100 * 2 * both / (len(x) + len(y)), 4) if both else 0.0

    return pd.Series([one(a, b) for a, b in zip(hypothesis, reference, strict=True)], dtype="float64")


def _bleu(hypothesis: str, reference: str) -> float:
    """BLEU-4 of characters; n-gram orders without a match are halved once more each (smoothing method 3)."""
    if not hypothesis:
        return 0.0
    logs, halving = [], 1
    for n in range(1, 5):
        h = Counter(hypothesis[i : i + n] for i in range(len(hypothesis) - n + 1))
        r = Counter(reference[i : i + n] for i in range(len(reference) - n + 1))
        hit, every = sum((h & r).values()), max(1, sum(h.values()))
        if n == 1 and not hit:
            return 0.0
        if not hit:
            hit, halving = 1 / 2**halving, halving + 1
        logs.append(math.log(hit / every))
    brevity = 1.0 if len(hypothesis) > len(reference) else math.exp(1 - len(reference) / len(hypothesis))
    return round(100 * brevity * math.exp(sum(logs) / 4), 4)


@F.pandas_udf(DoubleType())
def bleu_4(hypothesis: pd.Series, reference: pd.Series) -> pd.Series:
    return pd.Series([_bleu(a or "", b or "") for a, b in zip(hypothesis, reference, strict=True)], dtype="float64")
