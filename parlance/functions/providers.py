"""Boundaries to models: generation, ratings, embeddings, rewards and tokenizers.

A provider is a function of a batch of texts.  It runs in Arrow batches with
retries; offline stubs make every relational step run without a network.
"""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

Provider = Callable[[list[str]], list]


def with_retries(provider: Provider, tries: int = 3, wait: float = 1.0) -> Provider:
    """The provider, asked again after waits that double; the last failure is raised."""

    def run(texts: list[str]) -> list:
        for k in range(tries):
            try:
                return provider(texts)
            except Exception:
                if k == tries - 1:
                    raise
                time.sleep(wait * 2**k)
        return []

    return run


def with_fallback(provider: Provider, default=None) -> Provider:
    """The provider for a batch, or for each text alone if the batch fails; a text that fails alone gets the default."""

    def run(texts: list[str]) -> list:
        try:
            return provider(texts)
        except Exception:
            out = []
            for t in texts:
                try:
                    out += provider([t])
                except Exception:
                    out.append(default)
            return out

    return run


def apply(rows: DataFrame, provider: Provider, column: str, out: str, kind: str = "string", batch: int = 32) -> DataFrame:
    """rows with what the provider says to each text, in batches; rows with a finished key are best removed before."""
    arrow = {"string": pa.string(), "double": pa.float64(), "array<float>": pa.list_(pa.float32()), "array<int>": pa.list_(pa.int32())}[kind]
    names = rows.columns

    def run(batches):
        for b in batches:
            texts, said = b.column(column).to_pylist(), []
            for k in range(0, len(texts), batch):
                said += provider([t or "" for t in texts[k : k + batch]])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(said, arrow)], [*names, out])

    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields], f"`{out}` {kind}"])
    return rows.mapInArrow(run, schema)


def _digest(text: str) -> bytes:
    return hashlib.sha256(text.encode()).digest()


def stub_generation(texts: list[str]) -> list[str]:
    """A completion that depends on the prompt alone."""
    return [f"(NEUTRAL) {_digest(t).hex()[:8]} ({('ANGER', 'FEAR', 'SADNESS', 'DISGUST', 'HAPPINESS', 'SURPRISE')[_digest(t)[0] % 6]}) {_digest(t).hex()[8:16]} (NEUTRAL) why?" for t in texts]


def stub_ratings(texts: list[str], answers: int = 10) -> list[str]:
    line = "A{k}: Empathy: {a},Chatbot Emotion: {b},Question: {c}"
    return ["\n".join(line.format(k=k + 1, a=d[k] % 9 + 1, b=d[k + 10] % 9 + 1, c=d[k + 20] % 9 + 1) for k in range(answers)) for d in map(_digest, texts)]


def stub_embeddings(texts: list[str], size: int = 64) -> list[list[float]]:
    out = []
    for t in texts:
        v = np.random.Generator(np.random.PCG64(int.from_bytes(_digest(t)[:8], "big"))).standard_normal(size)
        out.append((v / np.linalg.norm(v)).astype(np.float32).tolist())
    return out


def stub_rewards(texts: list[str]) -> list[float]:
    return [int.from_bytes(_digest(t)[:4], "big") / 2**32 for t in texts]


def stub_tokens(texts: list[str]) -> list[list[int]]:
    return [[int.from_bytes(_digest(w)[:2], "big") for w in t.split()] for t in texts]
