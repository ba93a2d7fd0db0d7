import random

import public_tokenizers
import pytest

from parlance.llm import token_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_splicing():
    lib, rnd = token_counts.load(PATH), random.Random(2)
    letters = "abTHE      \n\t\r\x0b\x0c\x1c\x1f\x85\xa0 　᠎'’stld0123é中🎉.,!-_<|>"
    for _ in range(700):
        text = "".join(rnd.choices(letters, k=rnd.randint(0, 300)))
        if rnd.random() < 0.3:
            text += "ab" * rnd.randint(1, 90) + text
        if rnd.random() < 0.2:
            text = text[:9] + "<|endoftext|>" + text[9:] + " " * 60 + "x"
        want = len(lib.encode(text, add_special_tokens=False).ids)
        for chunk, overlap in ((16, 4), (40, 8), (64, 40)):
            assert token_counts.count_huge(lib, text, chunk, overlap) == want


def test_runs_of_short_texts(monkeypatch):
    lib, rnd = token_counts.load(PATH), random.Random(6)
    monkeypatch.setattr(token_counts, "KNOWN", 9_000)
    monkeypatch.setattr(token_counts, "TOGETHER", 500)
    count = token_counts.Counter(lib)
    assert count.by_runs
    letters = "abTHE      \n\t\r\x0b\x1c\x85\xa0 　'’stld0123é中🎉.,!-_<|>"
    plain = "abTHE      \n\t\r'’stld0123é中🎉.,!-_<|>"
    texts = ["".join(rnd.choices(rnd.choice((letters, plain, plain)), k=rnd.randint(0, 90))) + rnd.choice(("", "<|endoftext|>", " <|endoftext|> x", "  ", "漢字" * 60)) for _ in range(3000)]
    assert count.short(texts) == [len(e.ids) for e in lib.encode_batch(texts, add_special_tokens=False)]
    assert all(len(run) < token_counts.LONG for run in [*count.known, *count.known.old]) and count.known.size < 20_000


def test_every_row(documents, texts):
    lib = token_counts.load(PATH)
    for r in token_counts.counts(documents, PATH, chunk=2_000, overlap=64).collect():
        n = len(lib.encode(texts[r["doc_id"]], add_special_tokens=False).ids)
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(texts[r["doc_id"]].encode()), n, n > 512)


def test_tokenizers_without_proven_boundaries(spark, tmp_path):
    lib = token_counts.load(PATH).from_file(PATH)
    lib.add_special_tokens(["x x x"])  # has white space, so places before white space prove nothing
    path = f"{tmp_path}/special.json"
    lib.save(path)
    assert not token_counts.Counter(lib).by_runs
    rows = [(k, "x " * k) for k in range(20, 120)]
    want = {k: len(lib.encode(t, add_special_tokens=False).ids) for k, t in rows}
    assert any(token_counts.count_huge(lib, t, 8, 1) != want[k] for k, t in rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(2)
    assert {r["doc_id"]: r["n_tokens"] for r in token_counts.counts(df, path, chunk=8, overlap=1).collect()} == want


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "piece_bpe_32k.model"])
def test_other_tokenizers(documents, texts, name):
    path = public_tokenizers.path(name)
    lib = token_counts.load(path)
    assert not token_counts.Counter(lib).by_runs
    want = (lambda t: len(lib.encode(t))) if name.endswith(".model") else (lambda t: len(lib.encode(t, add_special_tokens=False).ids))
    for r in token_counts.counts(documents, path, chunk=200, overlap=8).collect():
        assert r["n_tokens"] == want(texts[r["doc_id"]])


def test_awkward_rows(awkward, nothing):
    lib = token_counts.load(PATH)
    want = sorted((r["doc_id"] or 0, len(lib.encode(r["text"] or "", add_special_tokens=False).ids)) for r in awkward.collect())
    assert sorted((r["doc_id"] or 0, r["n_tokens"]) for r in token_counts.counts(awkward, PATH).collect()) == want
    assert token_counts.counts(nothing, PATH).count() == 0
