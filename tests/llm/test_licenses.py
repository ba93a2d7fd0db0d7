import random
import re
import time

import pytest

from parlance.llm import licenses


@pytest.mark.parametrize(
    ("text", "labels", "score"),
    [
        ("MIT", {"mit"}, 1.0),
        ("MIT OR GPL-3.0-only", {"mit", "gpl"}, 1.0),
        ("MIT AND GPL-3.0-only", {"mit", "gpl"}, 0.3),
        ("GPL-2.0 WITH Classpath-exception-2.0", {"gpl"}, 0.65),
        ("GPL-2.0-only OR MIT AND Apache-2.0", {"gpl", "mit", "apache"}, 0.9),
        ("(GPL-2.0-only OR MIT) AND LGPL-2.1", {"gpl", "mit", "lgpl"}, 0.5),
        ("Apache-2.0 */", {"apache"}, 0.9),
        ("AND OR", set(), 0.4),
        ("((MIT)", {"mit"}, 0.4),
        ("", set(), 0.0),
    ],
)
def test_expressions(text, labels, score):
    got = licenses.evaluate(text)
    assert got[0] == labels and got[1] == pytest.approx(score)


@pytest.mark.parametrize("n", [31, 32, 33, 500])
def test_long_expressions(n):
    many = " AND ".join(["MIT"] * n)
    for text in (f"{many} AND GPL-3.0-only", f"({many} AND GPL-3.0-only)", f"{many} AND GPL-3.0-only */ end", "(" * n + f"{many} AND GPL-3.0-only" + ")" * n):
        assert licenses.evaluate(text) == ({"mit", "gpl"}, 0.3)


def test_longest_expression_at_the_start():
    rnd = random.Random(4)
    for _ in range(5000):
        tokens = rnd.choices(["MIT", "x", "AND", "or", "WITH", "(", ")"], k=rnd.randint(0, 12))
        ends = []
        for end in range(1, len(tokens) + 1):
            try:
                licenses.to_postfix(tokens[:end])
                ends.append(end)
            except ValueError:
                pass
        assert licenses.expression_end(tokens) == max(ends, default=0)


def test_postfix():
    assert licenses.to_postfix("a OR b AND c WITH d".split()) == ["a", "b", "c", "d", "with", "and", "or"]
    for wrong in (["a", "b"], ["(", "a"], ["a", ")"], ["OR"], ["a", "AND"], ["(", ")"]):
        with pytest.raises(ValueError):
            licenses.to_postfix(wrong)


def brute(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    hits = [(k, label) for phrase, label in licenses.BASE.items() for p in [phrase.split()] for k in range(len(words) - len(p) + 1) if words[k : k + len(p)] == p]
    at = [k for k, _ in hits]
    return len(words), len(hits), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in hits}))


def check(df, got):
    texts = {}
    for r in df.collect():
        texts.setdefault(r["doc_id"], r["text"] or "")
    for r in got:
        assert tuple(r)[1:6] == brute(texts[r["doc_id"]])
        assert set(filter(None, r["base_labels"].split(","))) <= set(filter(None, r["labels"].split(","))) and 0 <= r["score"] <= 1


def test_documents(documents):
    got = licenses.scans(documents).collect()
    assert len(got) == documents.count()
    check(documents, got)


def test_phrases(spark):
    rows = [(1, "MIT-License\nApache  License mit license"), (2, "cc by cc by by"), (3, "xmit license mit licenses"), (4, "GNU General Public License CC BY-SA 4.0"), (5, "é MIT é License"), (6, "# SPDX-License-Identifier: MIT OR Apache-2.0\n"), (7, "gnu general gnu general public license")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = licenses.scans(df).collect()
    check(df, got)
    by_id = {r["doc_id"]: r for r in got}
    assert by_id[1]["n_base"] == 3 and by_id[4]["labels"] == "cc-by,cc-by-sa,gpl" and by_id[6]["labels"] == "apache,mit" and by_id[6]["score"] == 1.0


def parsed(tokens):
    """(labels, permits, tokens read) of the expression at the start by recursive descent, or None."""
    made = {"and": lambda a, b: (a[0] | b[0], min(a[1], b[1])), "or": lambda a, b: (a[0] | b[0], max(a[1], b[1])), "with": lambda a, b: (a[0], a[1] + (1 - a[1]) / 2)}

    def level(k, ops=("or", "and", "with")):
        if not ops:
            if k >= len(tokens) or tokens[k] == ")" or tokens[k].lower() in made:
                return None
            if tokens[k] == "(":
                inside = level(k + 1)
                return (inside[0], inside[1] + 1) if inside and tokens[inside[1] : inside[1] + 1] == [")"] else None
            label = licenses.label_of(tokens[k])
            return ({label} - {None}, licenses.PERMITS.get(label, licenses.UNKNOWN)), k + 1
        left = level(k, ops[1:])
        while left and left[1] < len(tokens) and tokens[left[1]].lower() == ops[0]:
            right = level(left[1] + 1, ops[1:])
            if not right:
                break
            left = made[ops[0]](left[0], right[0]), right[1]
        return left

    return level(0)


def brute_labels(text):
    """labels and score as the docstring has them, without the automaton and the shunting-yard parser."""
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
    line = " " + " ".join(words) + " "
    labels = {label for phrase, label in [*licenses.NOTICES.items(), *licenses.BASE.items()] if f" {phrase} " in line}
    permits = [licenses.PERMITS[x] for x in labels]
    if f" {licenses.TAG} " in line:
        for said in re.findall(r"(?ia)spdx-license-identifier[ \t]*:[ \t]*([^\r\n]*)", text):
            tokens = re.findall(r"[()]|[A-Za-z0-9.+:-]+", said)
            got = parsed(tokens)
            if got is None:
                named, most = {licenses.label_of(t) for t in tokens} - {None}, licenses.UNKNOWN if tokens else 0.0
            else:
                named, most = got[0]
            labels |= named
            permits.append(most)
    return ",".join(sorted(labels)), pytest.approx(min(permits, default=0.0))


def test_labels_and_score(documents, texts):
    rnd = random.Random(6)
    tokens = ["MIT", "Apache-2.0", "GPL-3.0-only", "x", "AND", "or", "WITH", "(", ")", "*/", "CC-BY-SA-4.0"]
    phrases = ["all rights reserved", "Mozilla Public License", "gnu lesser", "cc0", "Permission is hereby granted, free of charge,", "words", "SPDX-License-Identifier: MIT", "spdx license identifier"]
    made = [" ".join(rnd.choices(phrases, k=3)) + "\n# SPDX-License-Identifier: " + " ".join(rnd.choices(tokens, k=rnd.randint(0, 9))) + "\n" + rnd.choice(phrases) for _ in range(3000)]
    for text in [*texts.values(), *made]:
        found = licenses.scan(text)
        assert (found["labels"], found["score"]) == brute_labels(text), text


def test_every_licence_of_very_long_expressions():
    names = ["MIT"] * 10_000
    assert licenses.evaluate(" OR ".join([*names, "GPL-2.0", "Apache-2.0"])) == ({"mit", "gpl", "apache"}, 1.0)
    assert licenses.scan("SPDX-License-Identifier: " + " OR ".join(["MIT"] * 40 + ["GPL-2.0", "Apache-2.0"]))["labels"] == "apache,gpl,mit"


def test_many_matches_take_linear_time():
    start = time.time()
    found = licenses.scan("an MIT License, so " * 500_000)
    assert time.time() - start < 20
    assert (found["n_words"], found["n_base"], found["first_word"], found["last_word"]) == (2_000_000, 500_000, 1, 1_999_997)


def test_awkward_rows(awkward, nothing):
    got = licenses.scans(awkward).collect()
    assert len(got) == awkward.count()
    check(awkward, got)
    assert licenses.scans(nothing).count() == 0
