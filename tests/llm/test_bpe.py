import hashlib
import random

import public_tokenizers
from tokenizers import Tokenizer

from parlance.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIB = Tokenizer.from_file(PATH)


def test_matches_library(documents, texts):
    for r in bpe.digests(documents, PATH).collect():
        ids = LIB.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(LIB.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_odd_characters():
    rnd = random.Random(5)
    letters = "abTHE  \n\t\r\x0b\x0c\x1c\x1f\x85\xa0 　᠎'’stldvm0123²½٣éß中🎉👨‍👩‍👧.,!-_<|>endoftext​́"
    bpe_of = bpe.Bpe(PATH)
    cases = ["".join(rnd.choices(letters, k=rnd.randint(0, 40))) for _ in range(3000)] + ["", " ", "a" * 3000, "<|endoftext|>", "x<|endoftext|> <|endoftext|>", "it's they'll"]
    for text, got in zip(cases, bpe_of.encode_batch(cases), strict=True):
        want = LIB.encode(text, add_special_tokens=False).ids
        assert got == want and bpe_of.decode(got) == LIB.decode(want, skip_special_tokens=False)


def test_small_tables_are_emptied(monkeypatch):
    monkeypatch.setattr(bpe, "TOGETHER", 60)
    cases = [f"word{k} again and word{k % 7} again" for k in range(200)]
    cases += ["漢字仮名" * 40 + f" x{k}" for k in range(20)]
    small = bpe.Bpe(PATH, 6_000)
    assert list(small.encode_batch(cases)) == [e.ids for e in LIB.encode_batch(cases, add_special_tokens=False)]
    assert all(len(run) < bpe.LONG for run in [*small.known, *small.known.old]) and small.known.size < 12_000


def test_awkward_rows_and_round_trip(awkward, nothing):
    awkward = awkward.selectExpr("*", "1 AS __text", "2 AS _")
    coded = bpe.encode(awkward, PATH)
    assert set(coded.columns) == set(awkward.columns) - {"text"}
    back = bpe.decode(coded, PATH)
    want = sorted((r["doc_id"] or 0, r["text"] or "") for r in awkward.collect())
    assert sorted((r["doc_id"] or 0, r["text"]) for r in back.collect()) == want
    assert bpe.encode(nothing, PATH).count() == 0 and bpe.digests(nothing, PATH).count() == 0
    empty = bpe.digests(awkward, PATH).where("doc_id = 2").first()
    assert empty["n_tokens"] == 0 and empty["ids_sha256"] == hashlib.sha256(b"").hexdigest()
