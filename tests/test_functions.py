"""Column functions against values worked out by hand or in plain Python."""

import math
import re

import pytest
from pyspark.sql import functions as F

from parlance.functions import score, text
from parlance.operators import judge, pack


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values()) or (1,)], list(values) or ["x"])
    return row.select(column.alias("y")).first()["y"]


@pytest.mark.parametrize(
    ("source", "target", "cutoff", "want"),
    [(3000, 2000, 1000, (600, 400)), (2000, 3000, 1000, (400, 600)), (1000, 100, 1000, (900, 100)), (100, 1000, 1000, (100, 900)), (100, 500, 1000, (100, 500)), (500, 100, 1000, (500, 100)), (10, 10, 1000, (10, 10))],
)
def test_budget(spark, source, target, cutoff, want):
    assert tuple(one(spark, score.budget(F.col("s"), F.col("t"), cutoff), s=source, t=target)) == want


@pytest.mark.parametrize("z", [-0.5, 0.5, 1.5, 2.5, 0.49, -4.5, 6.2])
def test_rescale_rounds_halves_to_even_without_clamp(spark, z):
    assert one(spark, score.rescale_z(F.col("z")), z=z) == round(z + 5)


@pytest.mark.parametrize("line", ["(JOY) hello there", "( a )  b (c) d", "no tags", ")(", "", "(x"])
def test_tagged(spark, line):
    a, b = line.find("("), line.find(")")
    want = ("None", "None") if -1 in (a, b) else (line[a + 1 : b], line[b + 1 :].lstrip())
    assert tuple(one(spark, text.tagged(F.col("x")), x=line)) == want


def in_three(x):
    opens = [m.start() for m in re.finditer(r"\(", x)]
    closes = [m.start() for m in re.finditer(r"\)", x)]
    said, named = [], []
    for k in range(3):
        o, c = (opens[k] if k < len(opens) else None), (closes[k] if k < len(closes) else None)
        named.append(x[o + 1 : c].strip() if o is not None and c is not None else "")
        stop = opens[k + 1] if k + 1 < len(opens) else len(x)
        said.append(x[c + 1 : stop].strip() if c is not None else "")
    return said, named


@pytest.mark.parametrize("x", ["(A) one (B) two (C) three?", "(A) one. (B) two", "nothing", "", "(A)(B)(C)"])
def test_split_response(spark, x):
    got = one(spark, text.split_response(F.col("x")), x=x)
    assert (got["utterances"], got["emotions"]) == in_three(x)


@pytest.mark.parametrize(
    ("x", "want"),
    [
        ("(ANGER) bad. (JOY) good. (NEUTRAL) why?", "(EMPATHY) bad. (JOY) good. (QUESTION) why?"),
        ("(ANGER) bad. (JOY) Good day. Why so?", "(EMPATHY) bad. (JOY) Good day. (QUESTION) Why so?"),
        ("(ANGER) bad. (JOY) one part only", "(EMPATHY) bad. (JOY) (QUESTION) one part only"),
    ],
)
def test_role_tags(spark, x, want):
    assert one(spark, text.role_tags(F.col("x")), x=x) == want


def test_restored_tags(spark):
    got = one(spark, text.restore_tags(F.col("x"), F.lit("(FEAR) oh")), x="(EMPATHY) a (JOY) b (QUESTION) c?")
    assert got == "(FEAR) a (JOY) b (NEUTRAL) c?"


def test_ratings(spark):
    raw = "A1: Empathy: 5,Chatbot Emotion: 7,Question: 9\n\nA2: Empathy: - 3, Chatbot Emotion: x,Question: 1\n"
    assert one(spark, text.ratings(F.col("x"), ("-",)), x=raw) == [[5, 7, 9], [3, None, 1]]


def test_white_space_is_that_of_all_scripts(spark):
    assert one(spark, text.collapse(F.col("x")), x=" a   b　\t\nc ") == "a b c"
    assert one(spark, text.words(F.col("x")), x="") == []
    assert one(spark, text.clean(F.col("x")), x=" a\n    b ") == "a  b"


def test_ids(spark):
    assert one(spark, text.numbered("RLAIFE-", F.col("n")), n=12345678) == "RLAIFE-12345678"
    assert one(spark, text.id_prefix(F.col("x")), x="RLAIFE-000012-3") == "000012-3"


@pytest.mark.parametrize("n", [1, 2, 3, 5])
def test_distinct_n(spark, n):
    texts = ["a b a b", "a b c", ""]
    pooled = [tuple(w[i : i + n]) for t in texts for w in [t.split()] for i in range(len(w) - n + 1)]
    want = len(set(pooled)) / len(pooled) if pooled else 0.0
    assert one(spark, score.distinct_n([F.lit(t) for t in texts], n)) == pytest.approx(want)


def test_length_and_expression_scores(spark):
    assert one(spark, score.length_score(F.lit(10.0), F.lit(10.0))) == 1.0
    assert one(spark, score.length_score(F.lit(2.0), F.lit(10.0))) == pytest.approx(math.exp(-1))
    assert [one(spark, score.expression_score(F.lit(s), F.lit(lv))) for s, lv in ((1, 1), (9, 1), (5, 3), (-4, 5))] == [9, 1, 9, 0]


def test_losses(spark):
    ls = lambda x: -math.log1p(math.exp(-x)) if x >= 0 else x - math.log1p(math.exp(x))
    assert one(spark, score.pair_loss(F.lit(-900.0), F.lit(900.0))) == pytest.approx(1800)
    c, r = -0.4, -1.1
    odds = (c - r) - (math.log1p(-math.exp(c)) - math.log1p(-math.exp(r)))
    assert one(spark, score.orpo_loss(F.lit(c), F.lit(r))) == pytest.approx(-c - 0.1 * ls(odds))
    assert one(spark, score.simpo_loss(F.lit(c), F.lit(r))) == pytest.approx(-ls(0.1 * (c - r - 5)))


def test_masked_log_probabilities(spark):
    got = one(spark, score.masked_logps(F.lit([-1.0, -2.0, -3.0]), F.lit([5, -100, 6, 7])))
    assert tuple(got) == (-5.0, 2)


@pytest.mark.parametrize("ranks", [[1, 2, 3], [2, 2, 1], [1], [1, 1], [3, 1, 2, 1]])
def test_pairs(spark, ranks):
    n = len(ranks)
    want = [(i + 1, j + 1) if ranks[i] < ranks[j] else (j + 1, i + 1) for i in range(n) for j in range(i + 1, n) if ranks[i] != ranks[j]]
    assert [tuple(p) for p in one(spark, judge.winner_loser(F.col("r")), r=ranks)] == want


def test_sentinel(spark):
    assert one(spark, judge.with_sentinel(F.col("r"), F.lit(True)), r=[1, 3, 2]) == [1, 3, 2, 4]
    assert one(spark, judge.with_sentinel(F.col("r"), F.lit(False)), r=[1, 3, 2]) == [1, 3, 2]


def test_packed_masks(spark):
    rows = spark.createDataFrame([(0, [1, 1, 2, 2, 2, 0]), (1, [1, 2, 2, 3, 3, 3])], "row int, mask array<int>")
    got = rows.select("row", pack.lengths_of(F.col("mask")).alias("n"), pack.attended(F.col("mask")).alias("at"), pack.block_mask(F.col("mask")).alias("m")).orderBy("row").collect()
    assert [r["n"] for r in got] == [[2, 3], [1, 2, 3]]
    assert got[0]["at"] == [0, 1, 2, 3, 4]
    assert got[0]["m"] == [[1, 0, 0, 0, 0, 0], [1, 1, 0, 0, 0, 0], [0, 0, 1, 0, 0, 0], [0, 0, 1, 1, 0, 0], [0, 0, 1, 1, 1, 0], [0, 0, 0, 0, 0, 0]]
    ends = [r["cumulative"] for r in pack.boundaries(rows, "row", "mask").orderBy("row", "id").collect()]
    assert ends == [2, 5, 1, 3, 6]


def test_knapsacks():
    lengths = [5, 3, 8, 2, 7, 20]
    groups = pack.knapsacks(lengths, 10)
    assert sorted(k for g in groups for k in g) == [0, 1, 2, 3, 4]
    assert all(sum(lengths[k] for k in g) <= 10 for g in groups)
    assert [lengths[k] for k in groups[0]] == [8, 2]
