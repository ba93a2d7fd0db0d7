import hashlib
import random
import zlib

from parlance.llm import media


def described(text):
    raw = text.encode()
    payload = raw + b" " * (-len(raw) % 192 or (0 if raw else 192))
    wav = media.to_wav(payload)
    return (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(wav), hashlib.sha256(wav).hexdigest(), media.feature(payload))


def slow_gear(data):
    h, out = 0, []
    for b in data:
        h = ((h << 1) + int(media.GEAR[b])) & 0xFFFFFFFF
        out.append(h)
    return out


def test_gear_hash_and_chunks():
    rnd = random.Random(3)
    for n in (0, 1, 5, 31, 32, 33, 400, 3000):
        data = rnd.randbytes(n)
        assert media.gear(data).tolist() == slow_gear(data)
    data = rnd.randbytes(60_000)
    parts = media.chunks(data)
    assert b"".join(parts) == data and all(media.LEAST <= len(p) <= media.MOST for p in parts[:-1])
    moved = set(media.chunks(b"something in front" + data))
    assert len(moved & set(parts)) > len(parts) / 2


def test_every_row(documents, texts):
    got = media.media(documents).collect()
    assert len(got) == documents.count()
    for r in got:
        assert tuple(r)[1:] == described(texts[r["doc_id"]])


def test_shared_chunks_are_stored_once(spark):
    rnd = random.Random(9)
    passage = "".join(rnd.choices("abcdefghij ", k=40_000))
    df = spark.createDataFrame([(k, f"start {k} " * 300 + passage + f" end {k}") for k in range(5)] + [(9, "same"), (10, "same")], "doc_id long, text string").repartition(3)
    store = media.Store(df, media.durable(media.listed(df)))
    assert store.chunks.count() > 5 and store.chunks.select("digest").distinct().count() == store.chunks.count()
    assert store.copied_files.count() == 1
    inline = store.files.selectExpr("aggregate(inline, 0L, (s, x) -> s + coalesce(length(x), 0)) AS n").groupBy().sum("n").first()[0]
    assert inline < 2 * 40_000
    got = {r["doc_id"]: tuple(r)[1:] for r in media.media(df).collect()}
    assert got == {r["doc_id"]: described(r["text"]) for r in df.collect()}


def test_awkward_rows(awkward, nothing):
    want = sorted(((r["doc_id"] or 0), *described(r["text"] or "")) for r in awkward.collect())
    assert sorted(((r["doc_id"] or 0), *tuple(r)[1:]) for r in media.media(awkward).collect()) == want
    assert media.media(nothing).count() == 0
