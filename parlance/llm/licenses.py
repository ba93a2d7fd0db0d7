"""Licence scans: an automaton finds tags and notice phrases, a parser evaluates expressions.

One Aho-Corasick automaton holds all phrases and the identifier tag and is run
over the words of a text.  Where it finds a tag, the rest of that line is read
as a licence expression: a shunting-yard parser orders ``with`` before ``and``
before ``or``, and the expression is evaluated to the licences that it names and
a permissiveness, which ``and`` lowers to the strictest part, ``or`` raises to
the freest, and ``with`` raises by half of what is missing to 1.

Defined results: a null or empty text has no words, no labels, a score of 0 and
null word places; texts are scanned whole; overlapping phrases all count;
an expression that can't be parsed names the known licences in it; repeated
rows give repeated rows; an empty table gives an empty result; other columns are
not read.
"""

from __future__ import annotations

import re
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from parlance.llm.common import small_batches, spread, text_of

#: The phrases that count as base matches, and their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Phrases of licence notices beyond them, as words, and their labels.
NOTICES = {
    "permission is hereby granted free of charge": "mit",
    "licensed under the apache": "apache",
    "redistribution and use in source and binary forms": "bsd",
    "bsd license": "bsd",
    "permission to use copy modify and or distribute this software": "isc",
    "mozilla public license": "mpl",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "eclipse public license": "epl",
    "creative commons attribution": "cc-by",
    "cc by sa": "cc-by-sa",
    "cc by nc": "cc-by-nc",
    "cc by nd": "cc-by-nd",
    "cc0": "cc0",
    "public domain dedication": "cc0",
    "all rights reserved": "proprietary",
}
TAG = "spdx license identifier"
#: Starts of identifiers, longest first where one begins another, and labels.
IDENTIFIERS = (("agpl", "agpl"), ("lgpl", "lgpl"), ("gpl", "gpl"), ("apache", "apache"), ("mit", "mit"), ("bsd", "bsd"), ("isc", "isc"), ("mpl", "mpl"), ("epl", "epl"), ("cc0", "cc0"), ("cc-by-sa", "cc-by-sa"), ("cc-by-nc", "cc-by-nc"), ("cc-by-nd", "cc-by-nd"), ("cc-by", "cc-by"))
#: How much a licence permits, from 0 to 1.
PERMITS = {"cc0": 1.0, "mit": 1.0, "isc": 1.0, "bsd": 0.95, "apache": 0.9, "cc-by": 0.85, "mpl": 0.6, "epl": 0.6, "lgpl": 0.5, "cc-by-sa": 0.5, "gpl": 0.3, "agpl": 0.2, "cc-by-nd": 0.2, "cc-by-nc": 0.2, "proprietary": 0.0}
UNKNOWN = 0.4
RANK = {"or": 1, "and": 2, "with": 3}

#: A-Z to lower case and all other bytes that aren't in a word to a space.
WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
TAG_LINE = re.compile(r"spdx-license-identifier[ \t]*:[ \t]*([^\r\n]*)", re.IGNORECASE | re.ASCII)
TOKEN = re.compile(r"[()]|[A-Za-z0-9.+:-]+")


def label_of(identifier: str) -> str | None:
    low = identifier.lower()
    return next((label for start, label in IDENTIFIERS if low.startswith(start)), None)


def to_postfix(tokens: list[str]) -> list[str]:
    """Shunting-yard: operands as they come, operators by rank, brackets resolved.  ValueError if it is no expression."""
    out, waiting, operand = [], [], True
    for token in tokens:
        low = token.lower()
        if token == "(":
            if not operand:
                raise ValueError(token)
            waiting.append(token)
        elif token == ")":
            while waiting and waiting[-1] != "(":
                out.append(waiting.pop())
            if operand or not waiting:
                raise ValueError(token)
            waiting.pop()
        elif low in RANK:
            if operand:
                raise ValueError(token)
            while waiting and RANK.get(waiting[-1], 0) >= RANK[low]:
                out.append(waiting.pop())
            waiting.append(low)
            operand = True
        else:
            if not operand:
                raise ValueError(token)
            out.append(token)
            operand = False
    if operand or "(" in waiting:
        raise ValueError("it ends early")
    return out + waiting[::-1]


def expression_end(tokens: list[str]) -> int:
    """How many tokens the longest expression at the start has; 0 if there is none."""
    end, depth, operand = 0, 0, True
    for k, token in enumerate(tokens, 1):
        if token == ")":
            if operand or not depth:
                break
            depth -= 1
        elif token.lower() in RANK:
            if operand:
                break
            operand = True
            continue
        elif not operand:
            break
        elif token == "(":
            depth += 1
            continue
        operand = False
        if not depth:
            end = k
    return end


def evaluate(expression: str) -> tuple[set[str], float]:
    """The licences that an expression names, and how much it permits.

    Text after the longest expression at the start of the line, such as the end
    of a comment, is ignored.
    """
    tokens = TOKEN.findall(expression)
    end = expression_end(tokens)
    if not end:
        return {x for t in tokens if (x := label_of(t))}, UNKNOWN if tokens else 0.0
    stack: list[tuple[set[str], float]] = []
    for token in to_postfix(tokens[:end]):
        if token not in RANK:
            label = label_of(token)
            stack.append(({label} if label else set(), PERMITS.get(label, UNKNOWN)))
            continue
        (b, y), (a, x) = stack.pop(), stack.pop()
        stack.append({"and": (a | b, min(x, y)), "or": (a | b, max(x, y)), "with": (a, x + (1 - x) / 2)}[token])
    return stack[0]


@lru_cache(maxsize=1)
def automaton() -> ahocorasick.Automaton:
    """Each phrase with a space before and after it, so that matches are whole words."""
    out = ahocorasick.Automaton()
    for phrase, label in [*NOTICES.items(), *BASE.items(), (TAG, None)]:
        out.add_word(f" {phrase} ", (len(phrase) + 2, label, phrase in BASE))
    out.make_automaton()
    return out


def scan(text: str) -> dict:
    """n_words, n_base, first_word, last_word, base_labels, labels, score of one text."""
    words = text.encode().translate(WORDS).split()
    joined = (b" " + b" ".join(words) + b" ").decode("latin-1")
    base, labels, n_base, first, last, tagged = set(), set(), 0, len(joined), -1, False
    for end, (length, label, is_base) in automaton().iter(joined):
        if label is None:
            tagged = True
            continue
        labels.add(label)
        if is_base:
            base.add(label)
            n_base, first, last = n_base + 1, min(first, end - length + 1), max(last, end - length + 1)
    # the word at a place has as many spaces before it as there are words before it
    at = [joined.count(" ", 0, k) if n_base else None for k in (first, last)]
    permits = [PERMITS[x] for x in labels]
    if tagged:
        for line in TAG_LINE.findall(text):
            named, most = evaluate(line)
            labels |= named
            permits.append(most)
    return {"n_words": len(words), "n_base": n_base, "first_word": at[0], "last_word": at[1], "base_labels": ",".join(sorted(base)), "labels": ",".join(sorted(labels)), "score": min(permits, default=0.0)}


def scans(docs: DataFrame) -> DataFrame:
    """doc_id and what scan() finds: one row for each row of docs.  score is that of the strictest licence found."""
    small_batches(docs.sparkSession)
    kinds = {"n_words": pa.int64(), "n_base": pa.int64(), "first_word": pa.int64(), "last_word": pa.int64(), "base_labels": pa.string(), "labels": pa.string(), "score": pa.float64()}

    def run(batches):
        for batch in batches:
            found = [scan(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array([f[k] for f in found], kind) for k, kind in kinds.items()]], ["doc_id", *kinds])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return spread(docs.select("doc_id", text_of("text").alias("text"))).mapInArrow(run, f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
