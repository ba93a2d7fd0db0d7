import random
import time

import numpy as np
import pytest

from parlance.llm import ngram_join, oracles, queries
from parlance.llm.components import components
from tests.oracle import same


def brute(rows):
    """doc_id, set size, component of (doc_id, text) rows, by comparing all sets."""
    sets = []
    for i, t in rows:
        w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "").encode().split()
        sets.append((i, frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()))
    group = list(range(len(sets)))

    def root(x):
        while group[x] != x:
            x = group[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                group[root(a)] = root(b)
    least = {}
    for k, (i, _) in enumerate(sets):
        if i is not None:
            least[root(k)] = min(i, least.get(root(k), i))
    return sorted(((i, len(s), least.get(root(k)) if s else i) for k, (i, s) in enumerate(sets)), key=repr)


def joined(df, **how):
    return sorted((tuple(r) for r in ngram_join.components_of(df, **how).collect()), key=repr)


def test_sql(spark, sf_dir):
    same(queries.op1_ngram_join(spark, sf_dir), oracles.OP1, sf_dir)


@pytest.mark.parametrize("hot", [ngram_join.HOT, 300])
def test_near_copies_and_a_common_passage(spark, hot):
    rnd = random.Random(4)
    words = [f"w{k}" for k in range(400)]
    base, passage = rnd.choices(words, k=120), rnd.choices(words, k=60)
    rows = []
    for k in range(60):  # a large group of near copies, not all of which link directly
        text = list(base)
        for _ in range(rnd.randint(0, 6)):
            text[rnd.randrange(len(text))] = rnd.choice(words)
        rows.append((k, " ".join(text)))
    for k in range(60, 120):  # documents that only share a passage
        own = rnd.choices(words, k=rnd.randint(20, 150))
        rows.append((k, " ".join(own[:10] + passage + own[10:])))
    for k in range(120, 150):  # exact thresholds: chains of documents that lose words at the end
        rows.append((k, " ".join(f"v{j}" for j in range(100 - (k - 120)))))
    rows += [(150 + k, "one two three") for k in range(3)] + [(160, "ONE two\tthree"), (161, "one two four"), (162, "one"), (163, "a b c d e"), (164, "a b c d e f")]
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert joined(df, hot=hot, bucket=500) == brute(rows)
    if hot == 300:
        assert joined(df, hot=hot, bucket=500, bits=4) == brute(rows)


def test_large_blocks(spark):
    """A block of 20 times hot: near copies of several texts with a passage in common, which sizes and cuts take apart."""
    rnd = random.Random(14)
    words = [f"w{k}" for k in range(5000)]
    passage, rows = rnd.choices(words, k=25), []
    for family in range(12):
        base = rnd.choices(words, k=60 + 12 * family)
        for _ in range(25):
            text = passage + base
            for _ in range(rnd.randint(0, 4)):
                text[rnd.randrange(len(text))] = rnd.choice(words)
            rows.append((len(rows), " ".join(text)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = brute(rows)
    for hot in (40_000, 2_000):
        assert joined(df, hot=hot, bucket=20_000) == want


def near_copies(n, size, rnd):
    base = np.array([rnd.getrandbits(64) for _ in range(size)], np.uint64)
    out = []
    for _ in range(n):
        x = base.copy()
        for k in rnd.sample(range(size), size // 30):
            x[k] = rnd.getrandbits(64)
        out.append(np.unique(x))
    return out


def test_near_copies_cost_their_size():
    rnd, took = random.Random(3), []
    for n in (1500, 6000):
        sets = near_copies(n, 150, rnd)
        start = time.time()
        assert len(ngram_join.search(sets)) == n - 1
        took.append(time.time() - start)
    assert took[1] < 12 * took[0] + 1, took


def test_search_is_exact():
    rnd = np.random.default_rng(1)
    for _ in range(30):
        base = np.unique(rnd.integers(0, 1 << 62, 80, np.uint64))
        sets = [np.unique(np.concatenate((rnd.choice(base, rnd.integers(40, len(base)), replace=False), rnd.integers(0, 1 << 62, rnd.integers(0, 15), np.uint64)))) for _ in range(25)]
        want = {(a, b) for a in range(25) for b in range(a) if ngram_join.links(len(np.intersect1d(sets[a], sets[b])), len(sets[a]), len(sets[b]))}
        for asked in (None, [k % 3 == 0 for k in range(25)]):
            got = ngram_join.search(sets, asked)
            assert all((max(p), min(p)) in want for p in got)
            seen = {(a, b) for a, b in want if asked is None or asked[a] or asked[b]}
            assert groups(25, got) == groups(25, seen)


def groups(n, edges):
    group = list(range(n))
    for _ in range(n):
        for a, b in edges:
            group[a] = group[b] = min(group[a], group[b])
    return group


def test_components(spark):
    rnd = random.Random(7)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(200)] + [(1000 + k, 1001 + k) for k in range(80)] + [(5000, 5001 + k) for k in range(100)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long").repartition(6)).collect()}
    want = dict.fromkeys(x for e in edges if e[0] != e[1] for x in e)
    for x in want:
        want[x] = x
    for _ in range(200):
        for a, b in edges:
            if a != b:
                want[a] = want[b] = min(want[a], want[b])
    assert got == want
    df = spark.createDataFrame(edges, "a long, b long").repartition(6)
    assert {r["node"]: r["root"] for r in components(df, few=10).collect()} == want
    assert components(df.where("a = b")).count() == 0 and components(df.where("a = b"), few=-1).count() == 0


def test_one_of_each_group_stays(documents):
    kept = {r["doc_id"] for r in ngram_join.keep_one(documents).collect()}
    assert kept == {r["component_id"] for r in ngram_join.components_of(documents).collect()}


def test_awkward_rows(awkward, nothing):
    assert joined(awkward) == brute([(r["doc_id"], r["text"]) for r in awkward.collect()])
    assert ngram_join.keep_one(awkward).columns == awkward.columns
    assert ngram_join.components_of(nothing).count() == 0 and ngram_join.keep_one(nothing).count() == 0
