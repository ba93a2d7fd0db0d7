"""Token counts of whole texts, huge ones by overlapping chunks that are spliced.

A huge text is encoded in chunks that overlap, with offsets.  Two neighbours are
spliced at a boundary that both have and that is proven stable: a place in the
overlap where text ends and white space begins.  A byte-level pre-tokenizer never
puts both sides of such a place into one piece, its look-ahead never reaches back
across it, and BPE works inside pieces, so what stands left of it doesn't depend
on the right side nor the other way round.  If an overlap has no such boundary,
it is widened, up to the rest of the text.

A short text is cut at all its stable boundaries, and each distinct run between
them is encoded once by a worker, which keeps what it knows of short runs within
``KNOWN`` bytes.  Texts with white space other than space, tab and line ends go to
the tokenizer whole, and so do all texts, huge ones too, if the tokenizer isn't a
byte-level one as described, for which no boundary is proven.

Defined results: a null text is empty and has 0 tokens; special strings in a
text are matched as the tokenizer's file says; repeated rows give repeated rows;
an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from parlance.llm.common import small_batches, spread, text_of, worker_table

#: Characters of a chunk and of the first overlap; tokens that a text may have before it is over the limit.
CHUNK, OVERLAP, LIMIT = 16_384, 256, 512
#: Text ends and white space begins.  Only characters that every library takes for white space, or for none.
STABLE = re.compile(r"(?<=[^\s\x1c-\x1f\x85᠎​﻿])(?=[ \t\n\r])")
#: A run from one stable boundary to the next, in a text without ODD characters.
RUNS = re.compile(r"[ \t\n\r]*[^ \t\n\r]+|[ \t\n\r]+")
ODD = re.compile("[\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200b\u2028\u2029\u202f\u205f\u2060\u3000\ufeff]")
#: Bytes of the runs that a worker knows, about; when they are more, these become the old ones, and the old ones go.
KNOWN = 60 << 20
#: Characters from which a run isn't kept: lines of languages without spaces, encoded data.
LONG = 64
#: Characters of short texts whose unknown runs are encoded together.
TOGETHER = 2_000_000


class Known(dict):
    """run -> number of its tokens.  A run that isn't known is noted as missing."""

    def __init__(self, old: dict[str, int]):
        super().__init__()
        self.old, self.missing, self.size = dict(old), set(), 0

    def __missing__(self, run: str) -> int:
        n = self.old.get(run)
        if n is None:
            self.missing.add(run)
            return 0
        self.keep(run, n)
        return n

    def keep(self, run: str, n: int) -> None:
        self[run] = n
        if len(run) < LONG:
            self.size += 160 + 2 * len(run)

    def forget(self) -> None:
        """Drop the long runs among those that were missing."""
        for run in self.missing:
            if len(run) >= LONG:
                del self[run]
        self.missing = set()


def cuts_at_runs(tokenizer: Tokenizer) -> bool:
    """Whether the tokenizer is one for which the boundaries are proven: byte-level BPE, nothing before it, specials without white space."""
    spec = json.loads(tokenizer.to_str())
    pre = spec.get("pre_tokenizer") or {}
    plain = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and spec["model"]["type"] == "BPE" and not spec.get("normalizer")
    return plain and not any(re.search(r"\s", t["content"]) or t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"])


class Counter:
    """Numbers of tokens of texts, with the runs that a worker knows."""

    def __init__(self, tokenizer: Tokenizer | SentencePieceProcessor):
        self.tokenizer, self.known = tokenizer, Known({})
        self.by_runs = isinstance(tokenizer, Tokenizer) and cuts_at_runs(tokenizer)

    def whole(self, texts: list[str]) -> list[int]:
        if isinstance(self.tokenizer, SentencePieceProcessor):
            return [len(ids) for ids in self.tokenizer.encode(texts, num_threads=1)]
        return [len(e) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def short(self, texts: list[str]) -> list[int]:
        """Of texts without a bound on their number, taken together up to TOGETHER characters."""
        out, start = [], 0
        while start < len(texts):
            end, size = start, 0
            while end < len(texts) and (end == start or size + len(texts[end]) <= TOGETHER):
                size += len(texts[end])
                end += 1
            out += self._short(texts[start:end])
            start = end
        return out

    def _short(self, texts: list[str]) -> list[int]:
        whole = [not self.by_runs or ODD.search(t) is not None for t in texts]
        of_whole = iter(self.whole([t for t, w in zip(texts, whole, strict=True) if w]))
        if self.known.size > KNOWN:
            self.known = Known(self.known)
        runs = [None if w else RUNS.findall(t) for t, w in zip(texts, whole, strict=True)]
        of_run = self.known.__getitem__
        out = [next(of_whole) if r is None else sum(map(of_run, r)) for r in runs]
        if missing := list(self.known.missing):
            lack = [r is not None and not self.known.missing.isdisjoint(r) for r in runs]
            for run, n in zip(missing, self.whole(missing), strict=True):
                self.known.keep(run, n)
            out = [sum(map(of_run, r)) if again else n for n, r, again in zip(out, runs, lack, strict=True)]
            self.known.forget()
        return out


@worker_table
def counter(path: str) -> Counter:
    return Counter(load(path))


@lru_cache(maxsize=2)
def load(path: str) -> Tokenizer | SentencePieceProcessor:
    """The tokenizer of a file: sentencepiece for .model, tokenizers for any other."""
    if path.endswith(".model"):
        return SentencePieceProcessor(model_file=path)
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark has a worker for each core
    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def splice_point(text: str, low: int, high: int, left: set[int], right: set[int]) -> int | None:
    """The first stable place in [low, high) that is a token boundary on both sides."""
    return next((at.start() for at in STABLE.finditer(text, low, high) if at.start() in left and at.start() in right), None)


def count_huge(tokenizer: Tokenizer, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
    """Tokens of a text, encoded chunk by chunk."""

    def offsets(a: int, b: int) -> list[int]:
        return [a + s for s, _ in tokenizer.encode(text[a:b], add_special_tokens=False).offsets]

    total, start, end = 0, 0, min(chunk, len(text))
    left = offsets(start, end)
    while end < len(text):
        wide = overlap
        while True:
            begin, stop = max(start, end - wide), min(len(text), end - min(wide, end - start) + chunk + wide)
            right = offsets(begin, stop)
            # the last place of the left chunk is where it was cut, which proves nothing
            at = splice_point(text, begin + 1, end, set(left), set(right))
            if at is not None or begin == start:
                break
            wide *= 2
        if at is None:
            # no stable place in the whole left chunk: the right one, which begins where it does, takes its place
            left, end = right, stop
            chunk = max(chunk, end - start)
            continue
        total += sum(x < at for x in left)
        left, start, end = [x for x in right if x >= at], at, stop
    return total + len(left)


def counts(docs: DataFrame, path: str, chunk: int = CHUNK, overlap: int = OVERLAP, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit: one row for each row of docs."""
    small_batches(docs.sparkSession)

    def run(batches):
        count = counter(path)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            spliced = [count.by_runs and len(t) > chunk for t in texts]
            of_others = iter(count.short([t for t, s in zip(texts, spliced, strict=True) if not s]))
            n = [count_huge(count.tokenizer, t, chunk, overlap) if s else next(of_others) for t, s in zip(texts, spliced, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"]
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return spread(docs).select("doc_id", text_of("text").alias("text")).mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
