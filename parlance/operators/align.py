"""Alignment of chat datasets to one schema of prompt, response, system and tools."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.schemas import MESSAGE

NONE = f"CAST(array() AS array<{MESSAGE}>)"


@dataclass
class Tags:
    """How a source names roles."""

    role: str = "from"
    content: str = "value"
    user: str = "human"
    assistant: str = "gpt"
    observation: str = "observation"
    function: str = "function_call"
    system: str = "system"


@dataclass
class Columns:
    """Which columns a source has; None for those that it lacks."""

    prompt: str | None = "instruction"
    query: str | None = "input"
    response: str | None = "output"
    history: str | None = None
    system: str | None = None
    tools: str | None = None
    messages: str | None = "conversations"
    chosen: str | None = None
    rejected: str | None = None
    kto_tag: str | None = None
    images: str | None = None
    videos: str | None = None
    audios: str | None = None
    tags: Tags = field(default_factory=Tags)
    ranking: bool = False


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def feedback(response: Column, desired: Column) -> Column:
    """A judged response and the empty one: first if it is desired, second if not."""
    given, empty = message("assistant", response), message("assistant", F.lit(""))
    return F.when(desired, F.array(given, empty)).otherwise(F.array(empty, given))


def _rest(df: DataFrame, c: Columns) -> list[Column]:
    text = lambda name: F.col(name) if name else F.lit("")
    media = lambda name: F.col(name) if name else F.lit(None).cast("array<string>")
    return [text(c.tools).alias("_tools"), media(c.images).alias("_images"), media(c.videos).alias("_videos"), media(c.audios).alias("_audios")]


def from_instructions(df: DataFrame, c: Columns, keep: list[str] = ()) -> DataFrame:
    """Instruction records: history pairs, then prompt and query that aren't empty as one user message.

    The response is, in this order, a judged one, a chosen and a rejected one, a
    plain one, or none.
    """
    history = F.expr(NONE)
    if c.history:
        pairs = F.transform(c.history, lambda h: F.array(message("user", h["user"]), message("assistant", h["assistant"])))
        history = F.coalesce(F.flatten(pairs), F.expr(NONE))
    asked = F.array(*[F.col(x) for x in (c.prompt, c.query) if x]) if c.prompt or c.query else F.array().cast("array<string>")
    asked = F.array_join(F.filter(asked, lambda x: x.isNotNull() & (x != "")), "\n")
    response = F.expr(NONE)
    if c.response:
        response = F.when(F.col(c.response).isNotNull(), F.array(message("assistant", F.col(c.response)))).otherwise(response)
    if c.ranking:
        both = F.array(message("assistant", F.col(c.chosen)), message("assistant", F.col(c.rejected)))
        response = F.when(F.col(c.chosen).isNotNull() & F.col(c.rejected).isNotNull(), both).otherwise(response)
    if c.kto_tag:
        response = F.when(F.col(c.kto_tag).isNotNull(), feedback(F.col(c.response), F.col(c.kto_tag))).otherwise(response)
    system = F.col(c.system) if c.system else F.lit("")
    return df.select(*keep, F.concat(history, F.array(message("user", asked))).alias("_prompt"), response.alias("_response"), system.alias("_system"), *_rest(df, c))


def from_messages(df: DataFrame, c: Columns, keep: list[str] = ()) -> DataFrame:
    """Message lists: a leading system message is peeled off, roles are mapped and must alternate.

    Even places take user and observation, odd ones assistant and function
    messages.  A plain list must have an even length and ends in the response; a
    list to be ranked has an odd length and the two responses apart.  A broken
    row gets empty arrays, which the stage filters drop.
    """
    t = c.tags
    said = F.transform(c.messages, lambda m: F.struct(m[t.role].alias("role"), m[t.content].alias("content")))
    leading = F.coalesce(F.get(F.col("__said"), F.lit(0))["role"] == F.lit(t.system), F.lit(False))
    out = df.withColumn("__said", F.coalesce(said, F.expr(NONE)))
    own = F.col(c.system) if c.system else F.lit("")
    out = out.withColumn("__system", F.when(leading, F.get("__said", F.lit(0))["content"]).otherwise(own))
    out = out.withColumn("__said", F.when(leading, F.slice("__said", F.lit(2), F.greatest(F.size("__said") - 1, F.lit(0)))).otherwise(F.col("__said")))
    # a tag that the registry unset is no role
    roles = F.create_map(*[F.lit(x) for pair in ((t.user, "user"), (t.assistant, "assistant"), (t.observation, "observation"), (t.function, "function")) if pair[0] for x in pair])
    asks, answers = ([x for x in tags if x] for tags in ((t.user, t.observation), (t.assistant, t.function)))
    wrong = F.exists(F.transform("__said", lambda m, k: F.when(k % 2 == 0, m["role"].isin(asks)).otherwise(m["role"].isin(answers))), lambda ok: ~F.coalesce(ok, F.lit(False)))
    broken = wrong | (F.size("__said") % 2 != (1 if c.ranking else 0)) | (F.size("__said") == 0)
    mapped = F.transform("__said", lambda m: F.struct(F.try_element_at(roles, m["role"]).alias("role"), m["content"].alias("content")))
    if c.ranking:
        answer = lambda name: F.struct(F.try_element_at(roles, F.col(name)[t.role]).alias("role"), F.col(name)[t.content].alias("content"))
        good = F.col(c.chosen)[t.role].isin(answers) & F.col(c.rejected)[t.role].isin(answers)
        broken = broken | ~F.coalesce(good, F.lit(False))
        prompt, response = mapped, F.array(answer(c.chosen), answer(c.rejected))
    else:
        prompt, response = F.slice(mapped, F.lit(1), F.greatest(F.size("__said") - 1, F.lit(0))), F.slice(mapped, F.greatest(F.size("__said"), F.lit(1)), F.lit(1))
        if c.kto_tag:
            response = F.when(F.col(c.kto_tag).isNotNull(), feedback(F.get(response, F.lit(0))["content"], F.col(c.kto_tag))).otherwise(response)
    none = F.expr(NONE)
    return out.select(*keep, F.when(broken, none).otherwise(prompt).alias("_prompt"), F.when(broken, none).otherwise(response).alias("_response"), F.col("__system").alias("_system"), *_rest(df, c))


#: What a stage needs of a row: a text to train on, or an odd number of messages and so many responses.
ODD = "size(_prompt) % 2 = 1"
NEEDED = {"pt": "size(_prompt) >= 1", "sft": f"{ODD} AND size(_response) = 1", "rm": f"{ODD} AND size(_response) >= 2", "kto": f"{ODD} AND size(_response) >= 2", "ppo": ODD}
#: Preference training loads its data as reward modelling does.
NEEDED["dpo"] = NEEDED["rm"]
RANKED = ("rm", "dpo")


def well_formed(aligned: DataFrame, stage: str) -> DataFrame:
    """The aligned rows that a stage can use."""
    return aligned.where(NEEDED[stage])


def check_stage(stage: str, ranking: bool) -> None:
    """Ranked data goes with reward modelling and preference training, and only with these."""
    if stage not in NEEDED:
        raise ValueError(f"unknown stage {stage}")
    if (stage in RANKED) != ranking:
        raise ValueError("ranked data is for reward modelling and preference training, and these need ranked data")


def with_media_paths(aligned: DataFrame, files: DataFrame, media_dir: str, column: str = "_images") -> DataFrame:
    """Paths that exist under media_dir get that folder in front; files has the column path with existing paths.

    Rows are matched by row and place, so one path that all rows name is no large group.
    """
    rows = aligned.withColumn("__row", F.monotonically_increasing_id())
    each = rows.select("__row", F.posexplode(column).alias("__k", "__p")).withColumn("path", F.concat(F.lit(media_dir.rstrip("/") + "/"), "__p"))
    found = each.join(files.select("path").distinct().withColumn("__is", F.lit(True)), "path", "left")
    paths = found.groupBy("__row").agg(F.transform(F.sort_array(F.collect_list(F.struct("__k", F.when(F.col("__is"), F.col("path")).otherwise(F.col("__p")).alias("p")))), lambda x: x["p"]).alias("__paths"))
    return rows.join(paths, "__row", "left").withColumn(column, F.coalesce("__paths", column)).drop("__row", "__paths")
