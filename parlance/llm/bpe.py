"""Byte-level BPE encoding and decoding with prefixes shared in a trie.

In a BPE encoding the last token of every prefix of a word decides the whole
encoding: it is the one vocabulary entry that ends the prefix and may stand
after the last token of what precedes it.  The distinct words of a batch form a
trie; a depth-first walk over it carries the last token of each prefix, so a
prefix that many words share is encoded once.  The trie is held as the sorted
list of the words: consecutive words share the path up to their common prefix,
which is how far the walk goes back before it descends again.

The vocabulary file is a parameter; it is read on every executor and never
copied.  Special strings of the file are matched in the text first, as its
library does.

Defined results: a null text is empty and has no tokens; texts of any length
are encoded whole (the walk isn't recursive); repeated rows give repeated rows;
an empty table gives an empty result; other columns are kept by ``encode``,
except that its own ``ids`` and ``n_tokens`` replace columns of these names.
"""

from __future__ import annotations

import gc
import json
import re
from collections.abc import Iterable, Iterator
from hashlib import sha256
from itertools import chain
from os.path import commonprefix

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm.common import small_batches, spread, text_of, worker_table

#: Fixed value: the pre-tokenizer's pattern of byte-level vocabularies.
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: A run of white space with the text after it.  No piece goes from text to white space, so pieces never cross these.
BLANK = "\t-\r \x85\xa0  -     　"
RUNS = re.compile(f"[{BLANK}]*[^{BLANK}]+|[{BLANK}]+")
#: Bytes of a worker's table of known runs, about; when it is full, it becomes the old table, and the old one goes.
KNOWN = 120 << 20
#: Characters from which a run isn't kept: lines of languages without spaces, encoded data.
LONG = 64
#: Pairs of neighbours that are remembered.
PAIRS = 150_000
#: Characters of texts whose unknown words share one trie.
TOGETHER = 4_000_000


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabulary files."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Known(dict):
    """run -> its tokens.  A run that isn't known gets a list that is filled in later, and is noted as missing."""

    def __init__(self, old: dict[str, list[int]]):
        super().__init__()
        self.old, self.missing, self.size = dict(old), [], 0

    def __missing__(self, run: str) -> list[int]:
        tokens = self.old.get(run)
        if tokens is None:
            tokens = []
            self.missing.append(run)
        self[run] = tokens
        if len(run) < LONG:
            self.size += 220 + 14 * len(run)  # the entry, its string, and a token for every two characters
        return tokens

    def forget(self) -> None:
        """Drop the long runs among those that were missing."""
        for run in self.missing:
            if len(run) >= LONG:
                del self[run]
        self.missing = []


class Bpe:
    """The vocabulary of a byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str, most: int = KNOWN):
        self.most = most
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        as_byte = byte_alphabet()
        vocab = {bytes(as_byte[c] for c in text): n for text, n in spec["model"]["vocab"].items() if all(c in as_byte for c in text)}
        special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.bytes_of = {n: raw for raw, n in vocab.items()} | {n: text.encode() for text, n in special.items()}
        self.text_of = {n: str(n) for n in self.bytes_of}
        self.ids = {raw: n for raw, n in vocab.items() if n not in set(special.values())}
        self.special = special
        self.split_special = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        #: last three bytes -> lengths of the tokens that end so, longest first; 2 is always tried, 1 is what remains
        lengths: dict[bytes, set[int]] = {}
        for raw in self.ids:
            if len(raw) >= 3:
                lengths.setdefault(raw[-3:], set()).add(len(raw))
        self.ending = {tail: (*sorted(found, reverse=True), 2) for tail, found in lengths.items()}
        #: merged pair -> rank; token -> rank of the merge that makes it (-1: a byte), and the halves it is made of.
        self.pair, self.made, self.left, self.right = {}, dict.fromkeys(self.ids.values(), -1), {}, {}
        raw_of = {text: bytes(as_byte[c] for c in text) for text in spec["model"]["vocab"] if all(c in as_byte for c in text)}
        for rank, merge in enumerate(spec["model"]["merges"]):
            a, b = (raw_of[x] for x in (merge.split(" ") if isinstance(merge, str) else merge))
            whole, a, b = self.ids[a + b], self.ids[a], self.ids[b]
            self.pair[a, b] = rank
            if self.made[whole] < 0:
                self.made[whole], self.left[whole], self.right[whole] = rank, a, b
        self.known = Known({})
        self.pairs: dict[tuple[int, int], bool] = {}

    def stays(self, a: int, b: int) -> bool:
        """Whether BPE leaves token b after token a: no merge across their border comes before their own.

        The merges that made a and b are taken back, the last one first; of
        equal ranks BPE does the left one first, so the right one is taken back.
        """
        pair, made, before = self.pair, self.made, len(self.pair)
        while True:
            if pair.get((a, b), before) < before:
                return False
            if made[a] > made[b]:
                before, a = made[a], self.right[a]
            elif made[b] >= 0:
                before, b = made[b] + 1, self.left[b]
            else:
                return True

    def walk(self, words: set[bytes]) -> Iterator[tuple[bytes, tuple[int, ...]]]:
        """(word, its tokens) of distinct words, in depth-first order of their trie."""
        ids, pairs, stays, bytes_of = self.ids, self.pairs, self.stays, self.bytes_of
        token_of, sizes_of, known_pair, two = ids.get, self.ending.get, pairs.get, (2,)
        path, last = b"", [-1]
        for word in sorted(words):
            del last[len(commonprefix((path, word))) + 1 :]
            path = word
            for end in range(len(last), len(word) + 1):
                for size in sizes_of(word[end - 3 : end], two) if end > 2 else two[: end - 1]:
                    start = end - size
                    if start < 0 or (token := token_of(word[start:end])) is None:
                        continue
                    if not start:
                        break
                    pair = last[start], token
                    good = known_pair(pair)
                    if good is None:
                        good = pairs[pair] = stays(*pair)
                    if good:
                        break
                else:
                    token = ids[word[end - 1 : end]]
                last.append(token)
            out, end = [], len(word)
            while end:
                out.append(last[end])
                end -= len(bytes_of[last[end]])
            yield word, tuple(reversed(out))

    def learn(self, runs: list[str]) -> None:
        """Fill in the tokens of runs that the table has no tokens for yet: all their unknown pieces over one trie."""
        if len(self.pairs) > PAIRS:
            self.pairs.clear()
        known, old, new, code = self.known.get, self.known.old.get, [], {}
        for run in runs:
            parts = PIECES.findall(run)
            new.append((self.known[run], parts))
            for x in parts:
                if x not in code:
                    code[x] = known(x) or old(x)
        for raw, tokens in self.walk({x.encode() for x, tokens in code.items() if not tokens}):
            code[raw.decode()] = tokens
        for tokens, parts in new:
            tokens.extend(code[parts[0]] if len(parts) == 1 else chain.from_iterable([code[x] for x in parts]))

    def encode_batch(self, texts: list[str]) -> Iterator[list[int]]:
        """The tokens of each text.  Texts are taken together up to TOGETHER characters."""
        start = 0
        while start < len(texts):
            if self.known.size > self.most:
                self.known = Known(self.known)
            of_run, end, size, found = self.known.__getitem__, start, 0, []
            while end < len(texts) and (end == start or size + len(texts[end]) <= TOGETHER):
                found.append([[[self.special[part]]] if k % 2 else list(map(of_run, RUNS.findall(part))) for k, part in enumerate(self.parts(texts[end]))])
                size += len(texts[end])
                end += 1
            self.learn(self.known.missing)
            self.known.forget()
            for parts in found:
                yield list(chain.from_iterable(chain.from_iterable(parts)))
            start = end

    def parts(self, text: str) -> list[str]:
        """The text between special strings, and at odd places these."""
        return self.split_special.split(text) if self.split_special else [text]

    def decode(self, ids: Iterable[int]) -> str:
        """The text of tokens, special ones too; bytes that aren't UTF-8 become U+FFFD."""
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


@worker_table
def load(path: str, most: int = KNOWN) -> Bpe:
    gc.disable()  # the tables have no cycles, and a worker would go through all of them again and again
    return Bpe(path, most)


def _encoded(path: str, keep: list[str], results, most: int = KNOWN):
    """A function for mapInArrow over the columns of keep and the text: the former, then what results makes of (bpe, ids)."""

    def run(batches):
        bpe = load(path, most)
        for batch in batches:
            rows = [results(bpe, ids) for ids in bpe.encode_batch(batch.column(len(keep)).to_pylist())]
            made = {name: [r[name] for r in rows] for name in results(bpe, [])}
            fields = {name: pa.array(v, pa.list_(pa.int32()) if name == "ids" else None if v and isinstance(v[0], str) else pa.int64() if name == "n_tokens" else pa.string()) for name, v in made.items()}
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], *fields.values()], [*keep, *fields])

    return run


def _schema(docs: DataFrame, keep: list[str], more: str) -> str:
    return ", ".join([*[f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep], more])


def encode(docs: DataFrame, path: str, text: str = "text", known: int = KNOWN) -> DataFrame:
    """docs with ids array<int> and n_tokens long in place of the text.

    A worker's tables of runs hold about 2 * known bytes; smaller ones cost time, not results.
    """
    small_batches(docs.sparkSession)
    keep = [c for c in docs.columns if c not in (text, "ids", "n_tokens")]
    run = _encoded(path, keep, lambda bpe, ids: {"ids": ids, "n_tokens": len(ids)}, known)
    return spread(docs).select(*keep, text_of(text).alias("_" * (1 + max(map(len, docs.columns))))).mapInArrow(run, _schema(docs, keep, "ids array<int>, n_tokens long"))


def decode(coded: DataFrame, path: str) -> DataFrame:
    """coded with text in place of ids."""
    small_batches(coded.sparkSession)
    keep = [c for c in coded.columns if c not in ("ids", "text")]

    def run(batches):
        bpe = load(path)
        for batch in batches:
            texts = [bpe.decode(ids or []) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(texts, pa.string())], [*keep, "text"])

    return coded.select(*keep, "ids").mapInArrow(run, _schema(coded, keep, "text string"))


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: the encoding and its decoding, as digests."""
    small_batches(docs.sparkSession)

    def results(bpe: Bpe, ids: list[int]) -> dict:
        listed = ",".join(map(bpe.text_of.__getitem__, ids))
        return {"n_tokens": len(ids), "ids_sha256": sha256(listed.encode()).hexdigest(), "decoded_sha256": sha256(bpe.decode(ids).encode()).hexdigest()}

    rows = spread(docs).select("doc_id", text_of("text"))
    return rows.mapInArrow(_encoded(path, ["doc_id"], results), _schema(docs, ["doc_id"], "n_tokens long, ids_sha256 string, decoded_sha256 string"))
