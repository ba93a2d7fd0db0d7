"""Media columns: payloads as audio samples, stored in content-defined chunks.

A payload becomes a WAV file of unsigned 8-bit mono samples, byte for byte.  A
rolling gear hash over the file places chunk cuts, so equal passages make equal
chunks wherever they stand.  The digests of chunks and files are counted in a
shuffle without bytes.  The store then has three tables: files, each with its
ordered chunk list and the bytes of the chunks that no other file has; files
that several rows have, deduplicated; and chunks that several files have,
deduplicated by digest.  To read a file back, the chunks that it shares are
joined by digest, all chunks are put together in list order, and the file's
digest is verified before features are computed.

A task learns which digests are shared from a bit filter of bounded size.  A
digest that the filter takes for shared by mistake is stored as a shared one, so
results don't depend on it.  Only distinct files are stored and read back, and
a task stores a digest once, so a text that a third of all rows repeat costs a
few rows in each task.  Chunks that very many places borrow come to these by
broadcast, so a passage that a third of all files share meets nobody in one task.

Defined results: a null text is an empty one, whose payload is one unit of
spaces; payloads of any length are stored whole; repeated rows give repeated
rows; an empty table gives an empty result; other columns are not read.  A file
that doesn't verify fails the job: it means that the store was damaged.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.llm.common import bit_filter, durable, may_contain, small_batches, spread, text_of, written

#: Payloads are padded with PAD to a positive multiple of UNIT bytes; samples a second.
UNIT, PAD, RATE = 192, b" ", 8_000
#: Least and most bytes of a chunk; a cut stands where the top CUT_BITS of the gear hash are 0 (one place in 1024).
LEAST, MOST, CUT_BITS = 256, 8_192, 10
#: Chunks that a larger share than 1 / HOT_SHARE of all borrowed places names are broadcast: 8 MB at most.
HOT_SHARE = 1_000
#: Bytes of a chunk's digest.
DIGEST = 16
#: Bytes that the 32-bit gear hash looks back.
WINDOW = 32
GEAR = np.random.Generator(np.random.PCG64(2024)).integers(0, 1 << 32, 256, np.uint32)


def to_wav(payload: bytes) -> bytes:
    """The payload as a WAV file of 8-bit samples."""
    with io.BytesIO() as out:
        with wave.open(out, "wb") as w:
            w.setnchannels(1)
            w.setsampwidth(1)
            w.setframerate(RATE)
            w.writeframes(payload)
        return out.getvalue()


def from_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as w:
        return w.readframes(w.getnframes())


def payload_of(text: str) -> tuple[bytes, int]:
    """The padded payload of a text, and its bytes without padding."""
    raw = text.encode()
    return raw + PAD * (-len(raw) % UNIT or (0 if raw else UNIT)), len(raw)


def gear(data: bytes) -> np.ndarray:
    """The gear hash at each byte: h = 2 h + GEAR[byte], in which the last WINDOW bytes count, by doubling."""
    h, span = GEAR[np.frombuffer(data, np.uint8)], 1
    while span < WINDOW:
        if len(h) > span:
            h = np.concatenate((h[:span], h[span:] + (h[:-span] << np.uint32(span))))
        span *= 2
    return h


def chunks(data: bytes) -> list[bytes]:
    """Content-defined chunks of LEAST to MOST bytes; only the last may be shorter."""
    places = np.flatnonzero(gear(data) >> np.uint32(32 - CUT_BITS) == 0) + 1
    out, start = [], 0
    while len(data) - start > LEAST:
        k = np.searchsorted(places, start + LEAST)
        end = min(int(places[k]) if k < len(places) else len(data), start + MOST, len(data))
        out.append(data[start:end])
        start = end
    if start < len(data):
        out.append(data[start:])
    return out


def digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=DIGEST).digest()


def feature(payload: bytes) -> str:
    """Length in ms, mean, root mean square around the middle, zero crossings and peak of the samples."""
    x = np.frombuffer(payload, np.uint8).astype(np.int64) - 128
    crossings = int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))
    return f"ms={len(x) * 1000 // RATE};mean={x.sum() / len(x):.4f};rms={np.sqrt((x * x).sum() / len(x)):.4f};zc={crossings};peak={int(np.abs(x).max())}"


def listed(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media_key, media_bytes, chunk_list of each row: the digests, end to end, without bytes."""

    def run(batches):
        for batch in batches:
            keys, sizes, n, lists = [], [], [], []
            for text in batch.column("text").to_pylist():
                payload, raw = payload_of(text)
                media = to_wav(payload)
                keys.append(hashlib.sha256(media).digest())
                sizes.append(len(media))
                n.append(raw)
                lists.append(b"".join(digest(c) for c in chunks(media)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), pa.array(lists, pa.binary())], ["doc_id", "n_bytes", "media_key", "media_bytes", "chunk_list"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", text_of("text").alias("text")).mapInArrow(run, f"doc_id {kind}, n_bytes long, media_key binary, media_bytes long, chunk_list binary")


def key_of(hashed: bytes) -> int:
    """The first 8 bytes of a digest as a signed number."""
    return int.from_bytes(hashed[:8], "big", signed=True)


def digests_of(chunk_list: str) -> Column:
    """The digests of a chunk list as an array."""
    count = (F.length(chunk_list) / DIGEST).cast("int")
    return F.transform(F.sequence(F.lit(1), count), lambda k: F.substring(chunk_list, (k - 1) * DIGEST + 1, F.lit(DIGEST)))


def shared_keys(rows: DataFrame) -> DataFrame:
    """key of each file that several rows have, and of each chunk that several files have."""
    number = lambda column: F.conv(F.hex(F.substring(column, 1, 8)), 16, -10).cast("long")
    files = rows.groupBy(number("media_key").alias("key")).count().where("count > 1").select("key")
    chunk = rows.select(number("media_key").alias("file"), F.explode(digests_of("chunk_list")).alias("chunk"))
    several = chunk.groupBy(number("chunk").alias("key")).agg(F.min("file").alias("a"), F.max("file").alias("b")).where("a <> b").select("key")
    return several.unionByName(files)


class Store:
    """The three tables: files and copied_files (media_key, chunk_list, inline), chunks (digest, data).

    inline has null for a chunk whose bytes are in chunks.
    """

    def __init__(self, docs: DataFrame, rows: DataFrame):
        spark = docs.sparkSession
        bits = spark.sparkContext.broadcast(bit_filter(shared_keys(rows), "key"))

        def run(batches):
            seen: set[bytes] = set()
            for batch in batches:
                kinds, keys, lists, inlines = [], [], [], []
                for text in batch.column("text").to_pylist():
                    media = to_wav(payload_of(text)[0])
                    name = hashlib.sha256(media).digest()
                    parts = chunks(media)
                    codes = [digest(c) for c in parts]
                    shared = may_contain(bits.value, np.array([key_of(name), *map(key_of, codes)], np.int64))
                    if shared[0] and name in seen:
                        continue
                    if len(seen) > 100_000:
                        seen.clear()
                    seen.update([name] if shared[0] else [])
                    kinds.append("copied" if shared[0] else "file")
                    keys.append(name)
                    lists.append(b"".join(codes))
                    inlines.append([None if s else c for c, s in zip(parts, shared[1:], strict=True)])
                    for c, code, s in zip(parts, codes, shared[1:], strict=True):
                        if s and code not in seen:
                            seen.add(code)
                            kinds.append("chunk")
                            keys.append(code)
                            lists.append(b"")
                            inlines.append([c])
                yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.string()), pa.array(keys, pa.binary()), pa.array(lists, pa.binary()), pa.array(inlines, pa.list_(pa.binary()))], ["kind", "media_key", "chunk_list", "inline"])

        raw = docs.select(text_of("text").alias("text")).mapInArrow(run, "kind string, media_key binary, chunk_list binary, inline array<binary>")
        stored = written(raw, "media-files", compression="zstd")
        self.files = stored.where("kind = 'file'").drop("kind")
        self.copied_files = written(stored.where("kind = 'copied'").drop("kind").dropDuplicates(["media_key"]), "media-copied", compression="zstd")
        chunk = stored.where("kind = 'chunk'").groupBy("media_key").agg(F.first("inline").alias("inline"))
        self.chunks = written(chunk.select(F.col("media_key").alias("digest"), F.col("inline")[0].alias("data")), "media-chunks", compression="zstd")

    def read(self) -> DataFrame:
        """media_key, parts: the bytes of each file's chunks in order."""
        files = self.files.unionByName(self.copied_files)
        borrows = F.exists("inline", lambda x: x.isNull())
        own = files.where(~borrows).select("media_key", F.col("inline").alias("parts"))
        rest = files.where(borrows)
        # only the places of borrowed chunks meet the chunk table, and they come back to their file
        asked = rest.select("media_key", F.posexplode(F.arrays_zip(digests_of("chunk_list").alias("digest"), "inline")).alias("pos", "c"))
        asked = durable(asked.where("c.inline IS NULL").select("media_key", "pos", F.col("c.digest").alias("digest")))
        # a chunk that one in HOT_SHARE of all places borrows is one of fewer than HOT_SHARE, of MOST bytes each: these are broadcast
        times = durable(asked.groupBy("digest").agg(F.count("*").alias("n")))
        hot = times.where(F.col("n") > (times.agg(F.sum("n")).first()[0] or 0) / HOT_SHARE).select("digest")
        often = F.broadcast(durable(self.chunks.join(F.broadcast(hot), "digest")))
        seldom = asked.join(often.select("digest"), "digest", "left_anti").join(self.chunks, "digest")
        lent = asked.join(often, "digest").unionByName(seldom).groupBy("media_key").agg(F.map_from_entries(F.collect_list(F.struct("pos", "data"))).alias("lent"))
        parts = F.transform("inline", lambda part, k: F.coalesce(part, F.try_element_at("lent", k)))
        return own.unionByName(rest.join(lent, "media_key").select("media_key", parts.alias("parts")))


def verified(files: DataFrame) -> DataFrame:
    """media_key and what is computed from the bytes read back: payload_bytes, payload_sha256, tail_crc32, media_sha256, feature."""
    kinds = {"media_key": pa.binary(), "payload_bytes": pa.int64(), "payload_sha256": pa.string(), "tail_crc32": pa.int64(), "media_sha256": pa.string(), "feature": pa.string()}

    def run(batches):
        for batch in batches:
            out = []
            for key, parts in zip(batch.column("media_key").to_pylist(), batch.column("parts").to_pylist(), strict=True):
                media = b"".join(parts)  # a chunk that is missing is null, and fails here
                name = hashlib.sha256(media).digest()
                if name != key:
                    raise ValueError(f"the stored file {key.hex()} reads back as {name.hex()}")
                payload = from_wav(media)
                out.append((key, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), name.hex(), feature(payload)))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds.values())], list(kinds))

    return files.mapInArrow(run, "media_key binary, payload_bytes long, payload_sha256 string, tail_crc32 long, media_sha256 string, feature string")


def media(docs: DataFrame) -> DataFrame:
    """One row for each row of docs: its file stored, read back, verified, and described."""
    small_batches(docs.sparkSession)
    docs = spread(docs.select("doc_id", "text"))
    rows = durable(listed(docs))
    found = verified(Store(docs, rows).read())
    # many rows may have one file: adaptive execution splits such a key
    out = rows.select("doc_id", "n_bytes", "media_key", "media_bytes").join(found, "media_key")
    return out.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
