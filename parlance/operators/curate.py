"""Candidate curation: joins of predictions, similarity, scores, choice and negatives."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.functions.score import combine, distinct_n, dot_matrix, length_score, let, rescale_distinct, row_mean
from parlance.functions.text import collapse, words


def joined_by_place(source: DataFrame, predictions: list[DataFrame], place: str = "pos", how: str = "inner") -> DataFrame:
    """source with the predict column of each file of predictions as predict_sft_0, predict_sft_1, ...

    Rows are matched by an explicit place that was given at ingest; inner ends
    with the shortest file.
    """
    out = source
    for k, p in enumerate(predictions):
        out = out.join(p.select(place, F.col("predict").alias(f"predict_sft_{k}")), place, how)
    return out


def wide_models(results: DataFrame, models: list[str], first: str = "0", chosen: str = "candidate") -> DataFrame:
    """One row for each dialogue with every model's first and chosen candidate, from rows dialogue_id, model, first, candidate."""
    cells = [F.max(F.when(F.col("model") == m, F.col(c))).alias(f"predict_sft_{m}_{c}") for m in models for c in (first, chosen)]
    out = results.groupBy("dialogue_id").agg(F.count_distinct("model").alias("__n"), *cells)
    return out.where(F.col("__n") == len(models)).drop("__n")


def content_identity(rows: DataFrame, source: DataFrame, keys: list[str], ids: list[str], order: str) -> DataFrame:
    """rows with the ids of the source row whose keys are equal but for white space; of several the last in order."""
    # texts meet as digests: neither side sends them, and an id column is all that is grouped
    content = F.sha2(F.to_json(F.array(*[collapse(F.col(k)) for k in keys])), 256).alias("__content")
    build = source.select(content, *ids, F.col(order).alias("__order")).groupBy("__content").agg(F.max_by(F.struct(*ids), "__order").alias("__ids"))
    out = rows.withColumn("__content", content).join(build, "__content", "left")
    return out.select(*rows.columns, *[F.col(f"__ids.{i}").alias(i) for i in ids])


def unmatched(rows: DataFrame, ids: list[str]) -> DataFrame:
    return rows.where(F.col(ids[0]).isNull())


def candidate_scores(target: Column, candidates: Column, vectors: Column, references: int = 2, alpha=0.4, beta=0.4, gamma=0.2) -> Column:
    """Scores of candidates after the first references - 1; vectors: of the target, then of all candidates.

    Similarity is the mean one to the first references texts, the length's
    reference the mean length of these.
    """
    mean = lambda a: F.aggregate(F.slice(a, F.lit(1), F.lit(references)), F.lit(0.0), lambda s, v: s + v) / references

    def scores(x: Column) -> Column:
        def score(k: Column) -> Column:
            both = [F.get(x["texts"], F.lit(0)), F.get(x["texts"], k)]
            distinct = (distinct_n(both, 2) + distinct_n(both, 3)) / 2
            return combine(mean(F.get(x["matrix"], k)), rescale_distinct(distinct), length_score(F.get(x["lengths"], k), mean(x["lengths"])), alpha, beta, gamma)

        return F.transform(F.sequence(F.lit(references), F.size(x["texts"]) - 1), score)

    texts = F.concat(F.array(target), candidates)
    lengths = F.transform(texts, lambda t: F.size(words(t)).cast("double"))
    return let(F.struct(dot_matrix(vectors).alias("matrix"), texts.alias("texts"), lengths.alias("lengths")), scores)


def best(scores: Column) -> Column:
    """1-based place of the highest score, the first of equal ones."""
    return F.array_position(scores, F.array_max(scores)).cast("int")


def bottom(scores: Column, k: int = 3) -> Column:
    """0-based places of the k lowest scores, lowest first, ties by place."""
    return F.transform(F.slice(F.array_sort(F.transform(scores, lambda s, i: F.struct(s.alias("s"), i.alias("i")))), 1, k), lambda x: x["i"])


def seeded_pick(options: Column, key: Column, seed: int = 42) -> Column:
    """One of the options, by a hash of key and seed: the same in every run and on every cluster."""
    return F.get(options, F.pmod(F.conv(F.substring(F.md5(F.concat_ws("|", key.cast("string"), F.lit(str(seed)))), 1, 8), 16, 10).cast("long"), F.size(options)).cast("int"))


def without(array: Column, place: Column) -> Column:
    """The array without its element at a 0-based place."""
    return F.filter(array, lambda x, i: i != place)


def drop_one_of_worst(rows: DataFrame, key: str, scores: str = "scores", candidates: str = "candidates", k: int = 3, seed: int = 42) -> DataFrame:
    """rows without one candidate and its score: one of the k with the lowest scores, by a seeded pick."""
    picked = rows.withColumn("__k", seeded_pick(bottom(F.col(scores), k), F.col(key), seed))
    return picked.withColumns({candidates: without(F.col(candidates), F.col("__k")), scores: without(F.col(scores), F.col("__k"))}).withColumnRenamed("__k", "dropped")


def negatives(rows: DataFrame, key: str, share: Column, modified: str, label: str, seed: int = 43) -> DataFrame:
    """Where share is true, one more of the three worst candidates goes; elsewhere the modified response goes, label "None"."""
    worst = seeded_pick(bottom(F.col("scores")), F.col(key), seed)
    return rows.withColumns(
        {
            "candidates": F.when(share, without(F.col("candidates"), worst)).otherwise(F.col("candidates")),
            "scores": F.when(share, without(F.col("scores"), worst)).otherwise(F.col("scores")),
            modified: F.when(~share, F.lit(None).cast("string")).otherwise(F.col(modified)),
            label: F.when(~share, F.lit("None")).otherwise(F.col(label)),
        }
    )


def replaced_segment(segments: Column, place: Column, text: Column) -> Column:
    """The segments joined by spaces, the one at a 0-based place replaced."""
    return F.array_join(F.transform(segments, lambda x, i: F.when(i == place, text).otherwise(x)), " ")


def other_emotion(current: Column, emotions: tuple[str, ...], key: Column, seed: int = 44) -> Column:
    """A seeded emotion that isn't contained in the current one."""
    return seeded_pick(F.filter(F.array(*map(F.lit, emotions)), lambda e: ~F.contains(current, e)), key, seed)


def weight_sweep(parts: DataFrame, weights: list[tuple[float, float, float]], similarity="similarity", distinct="distinct", length="length") -> DataFrame:
    """mean, population deviation and their ratio (0 for mean 0) of the score under each weighting, in one pass."""
    each = F.explode(F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(("alpha", "beta", "gamma"), w, strict=True)]) for w in weights])).alias("w")
    rows = parts.select(each, similarity, distinct, length)
    score = F.col("w.alpha") * (1 - F.col(similarity)) + F.col("w.beta") * F.col(distinct) + F.col("w.gamma") * F.col(length)
    out = rows.select("w.alpha", "w.beta", "w.gamma", score.alias("score")).groupBy("alpha", "beta", "gamma").agg(F.avg("score").alias("mean"), F.stddev_pop("score").alias("std"))
    return out.withColumn("cv", F.when(F.col("mean") == 0, F.lit(0.0)).otherwise(F.col("std") / F.col("mean")))


def sweep_choice(sweep: DataFrame) -> DataFrame:
    """The weightings with the highest mean and with the lowest ratio."""
    w = F.struct("alpha", "beta", "gamma")
    return sweep.agg(F.max_by(w, "mean").alias("by_mean"), F.min_by(w, "cv").alias("by_cv"))


def mean_similarities(vectors: Column) -> Column:
    return F.transform(dot_matrix(vectors), row_mean)


def coalesced(columns: list[str], default=None) -> Column:
    return reduce(lambda a, b: F.coalesce(a, b), [F.col(c) for c in columns] + ([F.lit(default)] if default is not None else []))
