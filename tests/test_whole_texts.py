"""Queries over conversations read their texts to the end."""

import random
import re

import pytest

from parlance.plans import load

QUERIES, _ = load()


@pytest.fixture(scope="module")
def said():
    rnd = random.Random(12)
    parts = ["word ", "some more words. ", "(SAD) ", "(CALM)", "(", ")", "\n"]
    return [(c, k, ("user", "assistant")[k % 2], "a start of more than fifty characters without a tag " + "".join(rnd.choices(parts, k=rnd.randint(0, 40)))) for c in range(12) for k in range(7)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory, said):
    path = str(tmp_path_factory.mktemp("whole"))
    spark.createDataFrame(said, "conv_id long, turn int, role string, text string").coalesce(1).write.parquet(f"{path}/conversations.parquet")
    return path


def tags(k, text):
    bare = text.replace("(", "").replace(")", "")
    response = (f"(ANGER) so bad. (JOY) {text} (NEUTRAL) why {k}?", f"(FEAR) oh no (CALM) {bare}. Is it {k}?", text)[k % 3]
    return re.findall(r"\(.*?\)", response)


def test_tags(spark, folder, said):
    found = {(c, k): tags(k, text) for c, k, _, text in said}
    three = {at: (x + [""] * 3)[:3] for at, x in found.items()}
    assert {(r["conv_id"], r["turn"]): r["tags"] for r in QUERIES["three_tags"](spark, folder).collect()} == {at: "|".join(x) for at, x in three.items()}
    of = lambda rows, c: [x for (conv, _), x in rows.items() if conv == c]
    for r in QUERIES["mean_tags"](spark, folder).collect():
        n = [len(x) for x in of(found, r["conv_id"])]
        assert r["mean_tags"] == pytest.approx(sum(n) / len(n), abs=1e-6)
    for r in QUERIES["tag_agreement"](spark, folder).collect():
        x = of(three, r["conv_id"])
        assert (r["user_correct"], r["chatbot_correct"], r["neutral_correct"]) == tuple(sum(t[i] == want for t in x) for i, want in enumerate(("(ANGER)", "(CALM)", "(NEUTRAL)")))
    assert {(r["conv_id"], r["turn"]): (r["human"], r["chatbot"]) for r in QUERIES["pair_emotions"](spark, folder).collect()} == {(c, k): (role.upper(), ("JOY", "CALM", None)[k % 3]) for c, k, role, _ in said}


def test_generations(spark, folder, said):
    got = QUERIES["parse_generations"](spark, folder).where("SID = 'USER'").select("UID", "SEG").orderBy("UID").collect()
    want = [re.sub(r"[\r\n]+", " ", text) for _, _, _, text in sorted(said) for _ in range(3)]
    assert [r["SEG"] for r in got] == want


def test_tool_calls(spark, tmp_path):
    text = 'Let me look this up for you first.\nAction: look_up\nAction Input: {"q": 1}'
    spark.createDataFrame([(1, 1, "assistant", text), (1, 3, "assistant", "nothing to call " * 9)], "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r["turn"]: (r["name"], r["arguments"]) for r in QUERIES["tool_extract"](spark, str(tmp_path)).collect()}
    assert got == {1: ("look_up", '{"q": 1}'), 3: ("tool_3", '{"k": 3}')}
