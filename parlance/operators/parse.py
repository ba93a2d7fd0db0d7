"""Parsers from free text to typed rows, as column expressions that are exploded."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.functions.text import MISSING, lines, lstrip, normalize_completion, numbered, restore_tags, step, strip, tagged
from parlance.operators.split import running_total

LINES, TURNS = 6, 4


def dialogue_blocks(text: Column, dialogues: int) -> Column:
    """The texts after 'Dialogue i:' markers up to the next marker that is there; empty for a missing one.

    The character after a marker is dropped.
    """
    marks = [f"Dialogue {k}:" for k in range(1, dialogues + 1)]
    at = [F.nullif(F.instr(text, m), F.lit(0)) for m in marks]
    end = F.length(text) + 1
    blocks = []
    for k, mark in enumerate(marks):
        start = at[k] + len(mark) + 1
        stop = F.coalesce(*at[k + 1 :], end)
        blocks.append(F.coalesce(F.substring(text, start, F.greatest(F.lit(0), stop - start)), F.lit("")))
    return F.array(*blocks)


def two_dialogues(text: Column, as_found: bool = False) -> Column:
    """The two blocks of a completion, each after its marker and one more character.

    Without the second marker the first block is the rest of the text.  With
    as_found it then lacks its last character, as it does where a marker that
    isn't found counts as place -1.
    """
    first, second = F.instr(text, "Dialogue 1:"), F.instr(text, "Dialogue 2:")
    stop = F.when(second > 0, second).otherwise(F.length(text) + (0 if as_found else 1))
    one = F.when(first > 0, F.substring(text, first + 12, F.greatest(F.lit(0), stop - first - 12))).otherwise("")
    return F.array(one, F.when(second > 0, F.substring(text, second + 12, F.length(text))).otherwise(""))


def turn(chunk: Column, missing: bool = True) -> Column:
    """A turn's fields from up to six lines: user, three responses with their emotions, explanation."""
    line = lambda k: F.get(chunk, F.lit(k))
    has = lambda k, x: F.when(F.size(chunk) > k, x).otherwise(MISSING)
    tag = lambda k: tagged(line(k), missing)
    return F.struct(
        has(0, tag(0)["text"]).alias("user"), has(0, tag(0)["emotion"]).alias("user_emotion"), has(1, tag(1)["text"]).alias("response_1"), has(1, tag(1)["emotion"]).alias("response_1_emotion"), has(4, step(line(4), "Step 3:")).alias("response_2"),
        has(2, tag(2)["emotion"]).alias("response_2_emotion"), has(5, tag(5)["text"]).alias("response_3"), has(5, tag(5)["emotion"]).alias("response_3_emotion"), has(3, step(line(3), "Step 2:")).alias("explanation"),
    )


def turns(block: Column, missing: bool = True) -> Column:
    """The turns of a block, up to four; turns without lines are left out."""
    all_lines = lines(lstrip(block))
    chunks = F.transform(F.sequence(F.lit(0), F.lit(TURNS - 1)), lambda k: F.slice(all_lines, k * LINES + 1, LINES))
    return F.transform(F.filter(chunks, lambda c: F.size(c) > 0), lambda c: turn(c, missing))


def segments(generations: DataFrame, completion: str, order: str, dialogues: int = 3, prefix: str = "CHATGPT") -> DataFrame:
    """One USER and one CHATBOT row for each parsed turn.  Dialogues are numbered over rows in their order.

    The numbers come from running totals of the rows' counts of dialogues; texts aren't sorted for it.
    """
    blocks = F.filter(dialogue_blocks(normalize_completion(F.col(completion)), dialogues), lambda b: b != "")
    parsed = generations.withColumn("__blocks", blocks)
    counts = running_total(parsed.select(order, F.size("__blocks").cast("long").alias("__n")), [order], F.col("__n"), "__upto")
    counts = counts.select(order, (F.col("__upto") - F.col("__n")).alias("__first"))
    each = parsed.join(counts, order).select(order, "__first", F.posexplode("__blocks").alias("k", "block"))
    each = each.select((F.col("__first") + F.col("k")).alias("number"), F.posexplode(turns(F.col("block"))).alias("t", "turn"))
    both = F.explode(F.array(F.lit("USER"), F.lit("CHATBOT"))).alias("SID")
    rows = each.select("number", "t", "turn", both).withColumn("place", 2 * F.col("t") + F.when(F.col("SID") == "USER", 0).otherwise(1))
    x = F.col("turn")
    user = F.col("SID") == "USER"
    uid = F.concat(numbered(f"{prefix}-", F.col("number")), F.format_string("-%04d", F.col("place")))
    return rows.select(
        uid.alias("UID"), numbered("RLAIFE-", F.col("number")).alias("DIALOGUE_ID"), "SID", F.when(user, x["user"]).otherwise(F.concat_ws(" ", x["response_1"], x["response_2"], x["response_3"])).alias("SEG"),
        F.when(user, F.array(x["user_emotion"])).otherwise(F.array(x["response_1_emotion"], x["response_2_emotion"], x["response_3_emotion"])).alias("EMOTION"), x["explanation"].alias("EXPLANTATION"),
        *[x[f"response_{k}"].alias(f"RESPONSE_{k}") for k in (1, 2, 3)], *[x[f"response_{k}_emotion"].alias(f"EMOTION_RESPONSE_{k}") for k in (1, 2, 3)],
    )


def rating_prompt(text: Column) -> Column:
    """history, prompt and responses by number of a rendered rating prompt; null if it hasn't seven conversation lines."""
    between = lambda x, a, b: strip(F.split_part(F.substring(x, F.instr(x, a) + len(a), F.length(x)), F.lit(b), F.lit(1)))
    said = lines(between(text, "Human-Chatbot conversation:\n", "\n\nThere are "))
    bare = lambda k, who: strip(F.regexp_replace(F.get(said, F.lit(k)), f"^{who}: ", ""))
    history = F.array(*[F.struct(bare(k, "Human").alias("user"), restore_tags(bare(k + 1, "Chatbot"), bare(k, "Human")).alias("assistant")) for k in (0, 2, 4)])
    answers = F.regexp_replace(between(text, "different possible chatbot answers, from A1 to A", "\n\nBase the scoring"), r"^[^\n]*\n", "")
    pattern = F.lit(r"(?ms)^A(\d+)\s*[-:]\s*(.*?)(?=^A\d+\s*[-:]|\z)")
    numbers, texts = F.regexp_extract_all(answers, pattern, F.lit(1)), F.regexp_extract_all(answers, pattern, F.lit(2))
    prompt = bare(6, "Human")
    responses = F.map_from_entries(F.zip_with(numbers, texts, lambda n, t: F.struct(n.cast("int").alias("k"), restore_tags(strip(t), prompt).alias("v"))))
    return F.when(F.size(said) == 7, F.struct(history.alias("history"), prompt.alias("prompt"), responses.alias("responses")))


def human_assistant(text: Column, human: str, assistant: str) -> Column:
    """(role, content) of the parts after human and assistant marks, in order; what precedes the first mark is dropped.

    Marks are plain texts, such as a blank line and 'Human: '.
    """
    import re

    h, a = re.escape(human), re.escape(assistant)
    pattern = F.lit(rf"(?s)({h}|{a})(.*?)(?={h}|{a}|\z)")
    marks, parts = F.regexp_extract_all(text, pattern, F.lit(1)), F.regexp_extract_all(text, pattern, F.lit(2))
    return F.zip_with(marks, parts, lambda m, p: F.struct(F.when(m == human, "user").otherwise("assistant").alias("role"), p.alias("content")))


def preference_text(chosen: Column, rejected: Column, human: str = "\n\nHuman: ", assistant: str = "\n\nAssistant: ") -> Column:
    """history pairs, instruction, chosen and rejected answer of two transcripts that differ in the last answer."""
    said, other = human_assistant(chosen, human, assistant), human_assistant(rejected, human, assistant)
    n = F.size(said)
    pairs = F.floor((n - 2) / 2).cast("int")
    pair = lambda k: F.struct(F.get(said, 2 * k)["content"].alias("user"), F.get(said, 2 * k + 1)["content"].alias("assistant"))
    history = F.when(pairs > 0, F.transform(F.sequence(F.lit(0), F.greatest(pairs - 1, F.lit(0))), pair)).otherwise(F.expr("CAST(array() AS array<struct<user:string,assistant:string>>)"))
    return F.struct(history.alias("history"), F.get(said, n - 2)["content"].alias("instruction"), F.element_at(said, -1)["content"].alias("chosen"), F.element_at(other, -1)["content"].alias("rejected"))


def alternating(data: Column) -> Column:
    """(from, value) of a list of texts in turn; an odd last one goes, and a list that then has fewer than two is null."""
    n = F.size(data) - F.size(data) % 2
    said = F.transform(F.slice(data, F.lit(1), n), lambda x, k: F.struct(F.when(k % 2 == 0, "human").otherwise("gpt").alias("from"), x.alias("value")))
    return F.when(n >= 2, said)


#: How completions of model families are cleaned: a pattern, and what replaces it.  Families that aren't listed stay as they are.
CLEANERS = {
    "after_answer": (r"(?s)^.*A:", ""),
    "first_line": (r"(?s)\n.*$", ""),
    "to_option": (r"(?s)(\([A-Z]\)).*$", "$1"),
    "no_trailing_dots": (r"\.+\s*$", ""),
    "before_question": (r"(?s)Q:.*$", ""),
}


def cleaned_completion(completion: Column, family: Column, cleaners: dict[str, list[str]]) -> Column:
    """The completion after the cleaners of its family, a list of names in CLEANERS; lines are joined and stripped."""
    out = completion
    for name, steps in cleaners.items():
        x = completion
        for s in steps:
            x = F.regexp_replace(x, *CLEANERS[s])
        out = F.when(family == name, x).otherwise(out)
    return strip(F.regexp_replace(out, r"\s*[\r\n]+\s*", " "))
