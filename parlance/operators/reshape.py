"""Long and wide forms of dialogues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.functions.text import numbered
from parlance.schemas import MESSAGE

#: Label numbers of the daily dialogues.
DAILY_EMOTIONS = ("neutral", "anger", "disgust", "fear", "happiness", "sadness", "surprise")


def daily_segments(dialogues: DataFrame) -> DataFrame:
    """One row for each turn of id, dialog and emotion arrays, with ids, speaker by parity and the label's name."""
    labels = F.create_map(*[F.lit(x) for k, name in enumerate(DAILY_EMOTIONS) for x in (k, name)])
    each = dialogues.select("id", F.posexplode(F.arrays_zip("dialog", "emotion")).alias("turn", "x"))
    did = numbered("DAILYD-", F.col("id"))
    return each.select(
        F.concat(did, F.format_string("-%04d", "turn")).alias("UID"), did.alias("DID"), "turn", F.when(F.col("turn") % 2 == 0, "A").otherwise("B").alias("SID"), F.col("x.dialog").alias("SEG"), F.try_element_at(labels, F.col("x.emotion")).alias("EMOTION")
    )


def with_turns(rows: DataFrame, dialogue: str, turns: int) -> DataFrame:
    """Rows of dialogues with exactly so many turns."""
    right = rows.groupBy(dialogue).count().where(F.col("count") == turns).select(dialogue)
    return rows.join(right, dialogue, "left_semi")


def collected(rows: DataFrame, dialogue: str, order: str, fields: list[str], name: str = "turns") -> DataFrame:
    """The turns of each dialogue in order, as an array of structs."""
    each = F.sort_array(F.collect_list(F.struct(order, *fields)))
    return rows.groupBy(dialogue).agg(F.transform(each, lambda x: F.struct(*[x[f].alias(f) for f in fields])).alias(name))


def conversations(rows: DataFrame) -> DataFrame:
    """conv_id and messages of rows conv_id, turn, role, text."""
    return collected(rows.withColumnsRenamed({"text": "content"}), "conv_id", "turn", ["role", "content"], "messages")


def peeled(messages: Column) -> Column:
    """The messages without a leading system message."""
    return F.when(F.get(messages, F.lit(0))["role"] == "system", F.slice(messages, F.lit(2), F.greatest(F.size(messages) - 1, F.lit(0)))).otherwise(messages)


def dialogue_record(turns: Column, system: Column) -> Column:
    """system, history of all turns but the last, instruction and output of the last one; turns: array of (user, assistant)."""
    last = F.element_at(turns, -1)
    return F.struct(system.alias("system"), F.slice(turns, F.lit(1), F.size(turns) - 1).alias("history"), last["user"].alias("instruction"), F.lit("").alias("input"), last["assistant"].alias("output"))


def turn_pairs(messages: Column) -> Column:
    """(user, assistant) of each two messages; an odd last one is left out."""
    n = F.floor(F.size(messages) / 2).cast("int")
    pair = lambda k: F.struct(F.get(messages, 2 * k)["content"].alias("user"), F.get(messages, 2 * k + 1)["content"].alias("assistant"))
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), pair)).otherwise(F.expr("CAST(array() AS array<struct<user:string,assistant:string>>)"))


def exported(system: Column, history: Column, prompt: Column) -> Column:
    """A preference record's conversation: system, human and gpt in turn, and the prompt."""
    said = lambda role, text: F.struct(F.lit(role).alias("from"), text.alias("value"))
    pairs = F.flatten(F.transform(history, lambda h: F.array(said("human", h["user"]), said("gpt", h["assistant"]))))
    return F.concat(F.array(said("system", system)), pairs, F.array(said("human", prompt)))


def user_turns(segments: DataFrame) -> DataFrame:
    """The USER rows of segments as turns: SEG becomes PROMPT, COMPLETION holds the three tagged responses."""
    parts = [F.format_string(f"(%s) %s", F.col(f"EMOTION_RESPONSE_{k}"), F.col(f"RESPONSE_{k}")) for k in (1, 2, 3)]
    return segments.where("SID = 'USER'").withColumnRenamed("SEG", "PROMPT").withColumn("COMPLETION", F.concat_ws(" ", *parts))


def aliased(records: DataFrame, names: dict[str, str], drop: tuple[str, ...] = ("input",)) -> DataFrame:
    """records with columns renamed and others dropped, as metric and merge steps expect them."""
    return records.drop(*drop).withColumnsRenamed(names)


def renamed_candidates(candidates: list[str], prefix: str = "predict_") -> list[Column]:
    """Candidate columns in their order as predict_1, predict_2, ..."""
    return [F.col(c).alias(f"{prefix}{k}") for k, c in enumerate(candidates, 1)]


EMPTY_MESSAGES = f"CAST(array() AS array<{MESSAGE}>)"
