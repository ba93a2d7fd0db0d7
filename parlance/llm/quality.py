"""Quality classifier: logistic regression on hashed word n-grams, trained with FTRL-proximal.

A text becomes its hashed words and word pairs, each weighted by the root of its
share among them - a vector of length 1 - so a score is one sparse dot product.
Words are runs of letters and digits or of other signs.  The model is fitted on the driver from a
bounded sample of labelled rows, the ``SAMPLE`` rows with the smallest hashes of
doc_id, whose features are made on the executors; of a text with more than
``MOST`` features the heaviest train.  Scoring covers every row and all features.

Defined results: a null or empty text has no features and gets the score of the
bias; texts of any length are read whole; rows whose label or doc_id is null
don't train; several labels of one doc_id are averaged; repeated rows each
train, within the sample, and give repeated rows; without any labelled row every score is 0.5; an empty table
gives an empty result; other columns are kept by ``keep_good`` and not read by
``scores``.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm.common import drop_tables, small_batches, spread, text_of

#: Labelled rows that train at most, and features of each; bits of a feature's hash; score from which a text is predicted good.
SAMPLE, MOST, BITS, THRESHOLD = 6_000, 4_096, 18, 0.3
#: FTRL-proximal: learning rate, its offset, penalties, passes over the sample.
ALPHA, BETA, L1, L2, EPOCHS = 4.0, 1.0, 0.01, 0.01, 8
WORDS = re.compile(r"[^\W_]+|[^\w\s]+|_+")
#: Words that a worker's table of hashes may have before it is emptied.
KNOWN = 200_000


class Hashes(dict):
    """word -> 64-bit hash, kept for the next text."""

    def __missing__(self, word: str) -> int:
        if len(self) >= KNOWN:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def features(text: str, hashes: Hashes, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct feature numbers of a text and their weights: its words and word pairs, in any letter case."""
    words = WORDS.findall(text.lower())
    one = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    two = (one[:-1] * np.uint64(0x9E3779B97F4A7C15)) ^ (one[1:] >> np.uint64(7))
    both = np.concatenate((one, two * np.uint64(0xC2B2AE3D27D4EB4F))) >> np.uint64(64 - bits)
    found, times = np.unique(both.astype(np.int32), return_counts=True)
    return found, np.sqrt(times / max(1, len(both))).astype(np.float32)


def margin(weights: np.ndarray, bias: float, text: str, hashes: Hashes, bits: int = BITS) -> float:
    """The logit of a text: the dot product of its features and their weights."""
    found, x = features(text, hashes, bits)
    return bias + float(weights[found] @ x)


def heaviest(found: np.ndarray, x: np.ndarray, most: int = MOST) -> tuple[np.ndarray, np.ndarray]:
    """The features of the most weight, in their order; ties go to the smallest numbers."""
    if len(found) <= most:
        return found, x
    keep = np.sort(np.argsort(-x, kind="stable")[:most])
    return found[keep], x[keep]


def train(rows: list[tuple[np.ndarray, np.ndarray, float]], bits: int = BITS, epochs: int = EPOCHS) -> tuple[np.ndarray, float]:
    """Weights and bias after passes of follow-the-regularised-leader updates, in the order of rows."""
    size = (1 << bits) + 1  # the last one is the bias, without L1
    z, n = np.zeros(size), np.zeros(size)
    bias = np.array([size - 1])
    rows = [(np.concatenate((found, bias)), np.append(x, 1.0).astype(np.float64), label) for found, x, label in rows]

    def weights(z_at: np.ndarray, root: np.ndarray) -> np.ndarray:
        pull = np.clip(z_at, -L1, L1)
        pull[-1] = 0
        return (pull - z_at) / (root / ALPHA + (BETA / ALPHA + L2))

    for _ in range(epochs):
        for at, x, label in rows:
            z_at, n_at = z[at], n[at]
            root = np.sqrt(n_at)
            w = weights(z_at, root)
            g = (1 / (1 + math.exp(-max(-35.0, min(35.0, float(w @ x))))) - label) * x
            n_at += g * g
            z[at] = z_at + g - (np.sqrt(n_at) - root) / ALPHA * w
            n[at] = n_at
    w = weights(z, np.sqrt(n))
    return w[:-1].astype(np.float32), float(w[-1])


def fold(doc_id: str = "doc_id"):
    """crc32 of doc_id as text, modulo 5; 0 is held out."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(5))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, bits: int = BITS) -> tuple[np.ndarray, float]:
    """Train on the rows of docs that labels.quality marks and that aren't held out."""
    small_batches(docs.sparkSession)
    marks = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.avg("quality").alias("mark")).where(fold() != 0)
    # at most sample rows, whatever the input: small enough to broadcast
    marks = marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select("doc_id", text_of("text").alias("text")).join(F.broadcast(marks), "doc_id")
    rows = rows.repartition(docs.sparkSession.sparkContext.defaultParallelism)  # the sample may stand in a few partitions

    def run(batches):
        drop_tables()
        hashes = Hashes()
        for batch in batches:
            found = [heaviest(*features(t, hashes, bits)) for t in batch.column("text").to_pylist()]
            parts = [pa.array([f[k].tobytes() for f in found], pa.binary()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("mark"), *parts], ["doc_id", "mark", "found", "x"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    made = rows.mapInArrow(run, f"doc_id {kind}, mark double, found binary, x binary")
    # repeated doc_ids have more rows than marks: again the first ones by hash, at most sample * MOST features
    order = made.orderBy(F.xxhash64("doc_id"), "doc_id", "found", "x").limit(sample).collect()
    return train([(np.frombuffer(r["found"], np.int32), np.frombuffer(r["x"], np.float32), float(r["mark"] >= 0.5)) for r in order], bits)


def scores(docs: DataFrame, model: tuple[np.ndarray, float], bits: int = BITS) -> DataFrame:
    """doc_id, held_out, score, predicted: one row for each row of docs."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 4 << bits bytes, whatever the input

    def run(batches):
        drop_tables()
        (weights, bias), hashes = shared.value, Hashes()
        for batch in batches:
            z = np.array([margin(weights, bias, t, hashes, bits) for t in batch.column("text").to_pylist()], np.float64)
            score = 1 / (1 + np.exp(-np.clip(z, -35, 35)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    held = F.coalesce(fold() == 0, F.lit(False)).alias("held_out")
    return spread(docs).select("doc_id", held, text_of("text").alias("text")).mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, model: tuple[np.ndarray, float], bits: int = BITS) -> DataFrame:
    """The rows of docs whose text is predicted good, with all their columns.

    A row is judged by its own text where it is read; nothing is shuffled.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        drop_tables()
        (weights, bias), hashes, least = shared.value, Hashes(), np.log(THRESHOLD / (1 - THRESHOLD))
        for batch in batches:
            good = [margin(weights, bias, t or "", hashes, bits) >= least for t in batch.column("text").to_pylist()]
            yield batch.filter(pa.array(good, pa.bool_()))

    return spread(docs).mapInArrow(run, docs.schema)
