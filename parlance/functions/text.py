"""Text functions of the dialogue parsers, all as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Python's str.split and strip have it.
WS = r"[\s\x0B\x1C-\x1F\x85\p{Z}]"
MISSING = "None"


def strip(x: Column) -> Column:
    return F.regexp_replace(x, rf"^{WS}+|{WS}+$", "")


def lstrip(x: Column) -> Column:
    return F.regexp_replace(x, rf"^{WS}+", "")


def words(x: Column) -> Column:
    """Words between white space; none for an empty text."""
    return F.filter(F.split(x, rf"{WS}+"), lambda w: w != "")


def collapse(x: Column) -> Column:
    """Runs of white space as one space, none at the ends; null as empty."""
    return strip(F.regexp_replace(F.coalesce(x, F.lit("")), rf"{WS}+", " "))


def clean(x: Column) -> Column:
    """Without line feeds, one pass of double to single spaces, stripped."""
    return strip(F.replace(F.replace(x, F.lit("\n"), F.lit("")), F.lit("  "), F.lit(" ")))


def normalize_completion(x: Column) -> Column:
    """Double line feeds to single ones, zero-width spaces away."""
    return F.replace(F.replace(x, F.lit("\n\n"), F.lit("\n")), F.lit("​"), F.lit(""))


def lines(x: Column) -> Column:
    """The lines of a text, as Python's splitlines has them for line feeds and carriage returns."""
    out = F.split(x, r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85  ]")
    out = F.when(F.element_at(out, -1) == "", F.slice(out, F.lit(1), F.size(out) - 1)).otherwise(out)
    return F.when(x == "", F.array().cast("array<string>")).otherwise(out)


def tagged(line: Column, missing: bool = True) -> Column:
    """(emotion, text) of '(EMOTION) text'.

    With missing, a line without one of the brackets gives "None" twice.
    Without, places that aren't found count as -1, so the emotion is the line
    without its last character and the text is the whole line.
    """
    first, last = F.instr(line, "("), F.instr(line, ")")
    emotion = F.substring(line, first + 1, F.greatest(F.lit(0), last - first - 1))
    text = lstrip(F.substring(line, last + 1, F.length(line)))
    if missing:
        found = (first > 0) & (last > 0)
        return F.struct(F.when(found, emotion).otherwise(MISSING).alias("emotion"), F.when(found, text).otherwise(MISSING).alias("text"))
    short = F.substring(line, first + 1, F.greatest(F.lit(0), F.length(line) - 1 - first))
    return F.struct(F.when(last > 0, emotion).otherwise(short).alias("emotion"), F.when(last > 0, text).otherwise(lstrip(line)).alias("text"))


def step(line: Column, label: str) -> Column:
    """The text after a label, "None" without it."""
    at = F.instr(line, label)
    return F.when(at > 0, lstrip(F.substring(line, at + len(label), F.length(line)))).otherwise(MISSING)


def three_tags(x: Column) -> Column:
    """The first three '(...)', padded with empty strings."""
    return F.slice(F.concat(F.regexp_extract_all(x, F.lit(r"(?d)\(.*?\)"), F.lit(0)), F.array(*[F.lit("")] * 3)), 1, 3)


def places(x: Column, mark: str) -> Column:
    """1-based places of a one-character mark."""
    return F.filter(F.transform(F.split(x, ""), lambda c, i: F.when(c == mark, i + 1)), lambda p: p.isNotNull())


def split_response(x: Column) -> Column:
    """([u1, u2, u3], [e1, e2, e3]) of a response with up to three '(EMOTION) text' parts; absent ones are empty.

    Opening and closing brackets are found independently of each other.
    """
    opens, closes = places(x, "("), places(x, ")")
    at = lambda a, k: F.get(a, F.lit(k))
    emotions = [F.coalesce(strip(F.substring(x, at(opens, k) + 1, F.greatest(F.lit(0), at(closes, k) - at(opens, k) - 1))), F.lit("")) for k in range(3)]
    texts = [F.coalesce(strip(F.substring(x, at(closes, k) + 1, F.greatest(F.lit(0), F.coalesce(at(opens, k + 1), F.length(x) + 1) - at(closes, k) - 1))), F.lit("")) for k in range(3)]
    return F.struct(F.array(*texts).alias("utterances"), F.array(*emotions).alias("emotions"))


def pair_emotions(prompt: Column, target: Column) -> Column:
    """The human's emotion, first tag of the prompt, and the chatbot's, second tag of the target."""
    tag = lambda x, k: strip(F.get(F.regexp_extract_all(x, F.lit(r"\(([^)]*)\)"), F.lit(1)), F.lit(k)))
    return F.struct(tag(prompt, 0).alias("human"), tag(target, 1).alias("chatbot"))


def role_tags(x: Column) -> Column:
    """A response with (EMPATHY) and (QUESTION) in place of the first and last emotion tag.

    Of a response with two tags the tail is split at its last sentence end if it
    ends with a question mark.
    """
    opens, closes = places(x, "("), places(x, ")")
    o, c = (lambda k: F.get(opens, F.lit(k))), (lambda k: F.get(closes, F.lit(k)))
    cut = lambda first, last: strip(F.substring(x, first, F.greatest(F.lit(0), last - first)))
    end = F.length(x) + 1
    empathy, second, tail = cut(c(0) + 1, o(1)), cut(o(1), c(1) + 1), cut(c(1) + 1, end)
    splits = (F.regexp_extract(tail, r"(?s)^(.*[.!?]) (.*)$", 1) != "") & tail.endswith("?")
    emotion = F.when(splits, strip(F.regexp_extract(tail, r"(?s)^(.*[.!?]) (.*)$", 1))).otherwise("")
    question = F.when(splits, strip(F.regexp_extract(tail, r"(?s)^(.*[.!?]) (.*)$", 2))).otherwise(tail)
    joined = lambda e, q: F.concat(F.lit("(EMPATHY) "), empathy, F.lit(" "), second, F.lit(" "), e, F.lit(" (QUESTION) "), q)
    two = strip(F.replace(joined(emotion, question), F.lit("  "), F.lit(" ")))
    three = joined(cut(c(1) + 1, o(2)), cut(c(2) + 1, end))
    return F.when((F.size(opens) == 2) & (F.size(closes) == 2), two).otherwise(three)


def restore_tags(response: Column, human: Column) -> Column:
    """The inverse: the human's emotion for (EMPATHY) at the start, (NEUTRAL) for (QUESTION)."""
    emotion = F.regexp_extract(strip(human), r"^\(([^)]+)\)", 1)
    put = F.regexp_replace(strip(response), F.lit(r"^\(EMPATHY\)"), F.concat(F.lit("("), emotion, F.lit(")")))
    return F.replace(put, F.lit("(QUESTION)"), F.lit("(NEUTRAL)"))


def ratings(x: Column, extra: tuple[str, ...] = ()) -> Column:
    """Rating lines 'A1: Empathy: 5,Chatbot Emotion: 7,Question: 9' as triples; what is no number becomes null."""
    kept = F.filter(F.split(F.rtrim(x, F.lit("\n")), "\n"), lambda line: strip(line) != "")

    def number(part: Column) -> Column:
        for word in ("Empathy:", "Chatbot Emotion:", "Question:", *extra):
            part = F.replace(part, F.lit(word), F.lit(""))
        return strip(part).try_cast("int")

    return F.transform(kept, lambda line: F.transform(F.split(strip(F.substring(line, 5, 1 << 30)), ","), number))


def first_emotion(completion: Column, options: dict[str, str], emotions: tuple[str, ...]) -> Column:
    """The emotion of a completion: an option token, in the order of options; else the first emotion word; else none."""
    flat = F.lower(F.regexp_replace(completion, r"\p{Punct}", " "))
    found = [F.when(completion.contains(token), F.lit(emotion)) for token, emotion in options.items()]
    return F.coalesce(*found, *[F.when(flat.contains(e), F.lit(e)) for e in emotions], F.lit("none"))


def numbered(prefix: str, n: Column, digits: int = 6) -> Column:
    """prefix and the number with leading zeros; longer numbers aren't cut."""
    return F.format_string(f"{prefix}%0{digits}d", n.cast("long"))


def id_prefix(x: Column) -> Column:
    """What follows the first dash."""
    return F.substring(x, F.instr(x, "-") + 1, F.length(x))
