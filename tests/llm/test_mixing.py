import collections
import hashlib
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from parlance.llm import mixing


def highest_quotients(targets, seats):
    out = [0] * len(targets)
    for _ in range(seats):
        k = max(range(len(targets)), key=lambda i: (targets[i] / (2 * out[i] + 1), -i))
        out[k] += 1
    return out


@pytest.mark.parametrize("targets", [[5.0, 2.0, 1.0], [1.0], [3.3, 3.3, 3.3, 0.1], [100.0, 1.0, 1.0, 1.0, 1.0]])
@pytest.mark.parametrize("seats", [1, 2, 7, 20, 101])
def test_seats(targets, seats):
    assert mixing.highest_quotients(targets, seats) == highest_quotients(targets, seats)
    assert mixing.highest_quotients([0.0, 0.0], seats) == [0, 0]


def test_shard_quotas_are_plain_quotients():
    assert mixing.deal([6400] + [26] * 10, 104 * 64) == [104 * 64] + [0] * 10
    rnd = random.Random(2)
    for _ in range(300):
        sizes = [rnd.choice([0, 1, 26, 64, 640, 6400, rnd.randint(0, 9000)]) for _ in range(rnd.randint(1, 40))]
        words = rnd.randint(0, 2 * sum(sizes))
        most, seats = [2 * n // 64 for n in sizes], [0] * len(sizes)
        for _ in range(words // 64):
            free = [i for i in range(len(sizes)) if seats[i] < most[i]]
            if not free:
                break
            seats[max(free, key=lambda i: (sizes[i] / (2 * seats[i] + 1), -i))] += 1
        assert mixing.highest_quotients(sizes, words // 64, most) == seats
        got = mixing.deal(sizes, words)
        assert sum(got) == words and all(64 * k <= g <= 2 * n for k, g, n in zip(seats, got, sizes, strict=True))
        assert len([1 for k, g, n in zip(seats, got, sizes, strict=True) if 64 * k < g < 2 * n]) <= 1


def brute_mix(rows, shard_docs, fan):
    """taken of each doc_id, by plain loops; rows: doc_id, source, size."""
    names = sorted({r[1] for r in rows}, key=lambda s: (s is None, s or ""))
    size = [sum(r[2] for r in rows if r[1] == s) for s in names]
    weight = [(5, 2, 1)[i % 3] for i in range(len(names))]
    full, left = set(), 0.0
    while True:
        left = 1.5 * sum(size) - sum(2 * size[i] for i in full)
        rest = sum(w for i, w in enumerate(weight) if i not in full)
        over = {i for i in range(len(names)) if i not in full and left / rest * weight[i] > 2 * size[i] + 1e-9}
        if not over:
            break
        full |= over
    target = [2.0 * size[i] if i in full else left / rest * weight[i] for i in range(len(names))]
    blocks = highest_quotients(target, int(1.5 * sum(size) / 64 + 0.5))
    digits = lambda text, at: int(hashlib.md5(text.encode()).hexdigest()[at - 1 : at + 14], 16)
    levels, out = 1, {}
    count = [max(1, -(-sum(r[1] == s for r in rows) // shard_docs)) for s in names]
    while fan**levels < max(count):
        levels += 1
    for s, name in enumerate(names):
        shards = {}
        for doc_id, source, n in rows:
            if source == name:
                h = f"{doc_id}|17"
                shards.setdefault(digits(h, 16) % count[s], []).append((digits(h, 1), doc_id, n))
        words = {(): min(64 * blocks[s], 2 * size[s])}
        for level in range(1, levels + 1):
            parts = {}
            for h, docs in shards.items():
                path = tuple(h // fan ** (levels - k) for k in range(1, level + 1))
                parts[path] = parts.get(path, 0) + sum(d[2] for d in docs)
            words = {p: w for up, most in words.items() for inside in [sorted(p for p in parts if p[:-1] == up)] for p, w in zip(inside, mixing.deal([parts[p] for p in inside], most), strict=True)}
        for h, docs in shards.items():
            n, take = sum(d[2] for d in docs), words[tuple(h // fan ** (levels - k) for k in range(1, levels + 1))]
            epochs, rest = divmod(take, n) if n else (0, 0)
            start = 64 * (digits(f"{s}|{h}|17", 1) % ((n - rest) // 64 + 1))
            line = [d for _, d, k in sorted(docs) for _ in range(k)]
            once = collections.Counter(line[start : start + rest])
            for _, d, k in docs:
                out[d] = (target[s], epochs * k + once[d])
    return out


@pytest.mark.parametrize(("shard_docs", "fan"), [(256, 1000), (5, 1000), (3, 4), (2, 2)])
def test_taken_agrees_with_brute_force(spark, shard_docs, fan):
    rnd = random.Random(shard_docs)
    rows = [(k, rnd.choice(["a", "a", "a", "a", "b", "c", None, "d"]), rnd.choice([0, 1, 5, 30, 300, rnd.randint(0, 2000)])) for k in range(400)]
    df = spark.createDataFrame([(k, s, "w " * n) for k, s, n in rows], "doc_id long, source string, text string")
    got = mixing.taken(df, shard_docs=shard_docs, fan=fan).collect()
    want = brute_mix(rows, shard_docs, fan)
    assert {r["doc_id"]: (pytest.approx(r["target"]), r["taken"]) for r in got} == want
    for s in {r[1] for r in rows}:
        ids = [r[0] for r in rows if r[1] == s]
        assert abs(sum(want[d][1] for d in ids) - want[ids[0]][0]) <= mixing.BLOCK


def test_columns_named_like_the_operators_own(spark):
    df = spark.createDataFrame([(k, "s", "a b c d", 99, 7) for k in range(30)], "doc_id long, source string, text string, mix_size long, size int").withColumn("taken", F.lit("x")).withColumn("row", F.lit(1)).withColumn("words", F.lit(2))
    got = mixing.taken(df).collect()
    assert {r["size"] for r in got} == {4} and sum(r["taken"] for r in got) == 3 * mixing.BLOCK
    assert mixing.mix(df).columns == df.columns

def test_water_filling():
    assert mixing.water_fill([100, 100, 100], [5, 2, 1], 450) == [200.0, pytest.approx(500 / 3), pytest.approx(250 / 3)]
    assert mixing.water_fill([10, 1000], [5, 2], 1515)[0] == 20.0
    assert mixing.water_fill([], [], 0) == []


def test_targets_are_met(documents, texts):
    got = mixing.taken(documents).collect()
    assert len(got) == documents.count()
    size, target, taken = Counter(), {}, Counter()
    source = {r["doc_id"]: r["source"] for r in documents.select("doc_id", "source").collect()}
    for r in got:
        assert r["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", texts[r["doc_id"]])) and 0 <= r["taken"] <= 2 * r["size"]
        s = source[r["doc_id"]]
        size[s] += r["size"]
        taken[s] += r["taken"]
        target[s] = r["target"]
    assert sum(target.values()) == pytest.approx(1.5 * sum(size.values()))
    for s in size:
        assert target[s] <= 2 * size[s] + 1e-6 and abs(taken[s] - target[s]) <= mixing.BLOCK
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, mixing.taken(documents.repartition(5)).collect()), key=repr)


def test_many_shards(spark):
    df = spark.range(5000).selectExpr("id AS doc_id", "CASE WHEN id % 3 = 0 THEN 'hot' ELSE concat('s', id % 7) END AS source", "repeat('w ', CAST(1 + id % 50 AS INT)) AS text")
    got = mixing.taken(df).join(df.select("doc_id", "source"), "doc_id").groupBy("source").agg({"taken": "sum", "target": "max"}).collect()
    for r in got:
        assert abs(r["sum(taken)"] - r["max(target)"]) <= mixing.BLOCK


def test_many_shards_at_the_cap(spark):
    df = spark.range(60_000).selectExpr("id AS doc_id", "IF(id < 30000, 'a', 'b') AS source", "CAST(IF(id < 30000, 1 + id % 7, 20 + id % 7) AS LONG) AS n")
    planned = mixing.plan(df, F.col("n")).cache()
    got = {r["source"]: r for r in planned.groupBy("row.source").agg({"taken": "sum", "target": "max", "source_size": "max"}).collect()}
    assert got["a"]["max(target)"] == 2 * got["a"]["max(source_size)"]
    for r in got.values():
        assert abs(r["sum(taken)"] - r["max(target)"]) <= mixing.BLOCK
    assert planned.where("taken > 2 * size").count() == 0


def test_mixture_has_what_the_plan_takes(documents):
    planned = {r["doc_id"]: r["taken"] for r in mixing.taken(documents).collect()}
    got = mixing.mix(documents)
    assert got.columns == documents.columns
    words = Counter()
    for r in got.collect():
        words[r["doc_id"]] += len((r["text"] or "").split())
    assert {k: v for k, v in planned.items() if v} == {k: v for k, v in words.items() if v}


def test_awkward_rows(awkward, nothing):
    got = mixing.taken(awkward).collect()
    assert len(got) == awkward.count() and all(r["taken"] <= 2 * r["size"] for r in got)
    assert {r["taken"] for r in got if r["doc_id"] in (2, 3, 4)} == {0}
    assert mixing.mix(awkward).columns == awkward.columns
    assert mixing.taken(nothing).count() == 0 and mixing.mix(nothing).count() == 0
