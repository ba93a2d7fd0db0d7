"""N-gram Jaccard self-join: documents whose shingle sets overlap by 80 % and more.

The search is the T-occurrence problem: two sets of sizes s and t link only if
they share at least T = ceil(0.8 max(s, t)) shingles, so a document links with
those that occur T times on the inverted lists of its shingles.

1. Every text becomes its set of 64-bit shingle hashes.  Equal sets are one node
   from then on, whatever the number of copies.
2. A counting sketch of fixed size estimates how frequent shingles are; rare
   before frequent, then by hash, is the order of all sets.  Linked sets share
   one of their first s - T + 1 shingles, and their sizes differ by a quarter at
   most.  Along these, nodes are joined to blocks: a link never leaves a block.
   Each task joins its own nodes first and sends one interval of sizes for each
   shingle, so the list of a shingle is as long as the number of tasks, not as
   the number of documents that have it.
3. A block of more than HOT shingles is cut again: nodes that don't share enough
   shingles with the rest of it altogether leave it, the shingles of the others are
   counted anew, apart for each block, and steps 1 and 2 are repeated with these
   counts until blocks are small or don't shrink.
4. In each block, lists are built over all shingles of its nodes and searched by
   DivideSkip: short lists are merged by a heap, nodes that occur often enough on
   them are looked up in the L long lists by binary search, and nodes with the
   required overlap link.  Counts there are exact set intersections.  A node is
   first compared with the one that stands first on most of its lists; what is
   connected with it then needs no search and goes from the lists, so a group of
   near copies costs about its size and not its pairs.
5. A block that is still too large is one group of near copies as a rule.  Its hub,
   which shares most with a sample, takes all nodes that link with it; only the
   others are queries.  Sizes differ by a quarter at most in a link, so nodes are
   dealt to bands of sizes, and chunks of queries are searched against chunks of
   the bands next to theirs.

Nodes that are connected already aren't compared again, so a group of near
copies isn't expanded into its pairs, and no link between different groups is
lost.  Sizes of tasks are bounded by HOT, BUCKET and the sketch; none depends on
how the documents repeat.

Sets are the same if two 64-bit hashes of them are: the first names the node, the
second is compared where copies are grouped, and names the sets of a name that
two different sets have.  A shingle is a 64-bit hash, so two different ones count
as one with a chance of 5e-20 a pair; nothing else here is left to chance.

Defined results: a null or empty text, and one without words, has no shingles
and links with nothing; a shorter text is one shingle; texts are read whole;
repeated rows are copies of each other; a null doc_id belongs to a component but
never names it; an empty table gives an empty result; other columns are kept by
``keep_one`` and not read by ``components_of``.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm.common import drop_ids, drop_tables, durable, side, small_batches, spread, text_of
from parlance.llm.components import components

#: Words of a shingle; least overlap in hundredths of the union.
N, PERCENT = 5, 80
#: Counters of the frequency sketch, and the slices in which tasks send them.
COUNTERS, SLICES = 1 << 22, 64
SHIFT = np.uint64(42)  # a token's counter is its top bits
#: Postings of a bucket and shingles of a group of small blocks, about; shingles from which a block is split; postings that a task holds.
BUCKET, GROUP, HOT, HELD = 200_000, 200_000, 100_000, 400_000
#: Times that a large block is cut again, as long as that makes the large ones a tenth smaller.
CUTS = 4
#: DivideSkip's weight of a lookup in a long list against a step of the merge.
MU = 0.0085
#: Entries up to which a heap merges the short lists; more are merged run by run.  Long lists that are looked up at once.
HEAP, AT_ONCE = 1_000, 16
#: Nodes of a split block among which its hub is chosen, about.
SAMPLE = 64
#: Words that a worker's table of hashes may have, and nodes that a task remembers, before they are emptied.
KNOWN = 200_000

POSTING = np.dtype([("token", "<u8"), ("key", "<i8"), ("low", "<u4"), ("high", "<u4")])
SHARED = np.dtype([("token", "<u8"), ("key", "<i8"), ("done", "?")])
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


class Hashes(dict):
    """word -> 64-bit hash, kept for the next text."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= KNOWN:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def shingles(text: str, hashes: Hashes) -> np.ndarray:
    """The sorted distinct shingle hashes of a text.  Words are split at ASCII white space, A-Z count as a-z."""
    words = text.encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < N:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=N)], np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    last = len(h) - N + 1
    out = h[:last] * _ODD[0]
    for k in range(1, N):
        out += h[k : k + last] * _ODD[k]
    out ^= out >> np.uint64(29)
    out *= _ODD[1]
    out ^= out >> np.uint64(32)
    out.sort()
    return out[np.concatenate(([True], out[1:] != out[:-1]))]


def key_of(tokens: np.ndarray, clashing: frozenset[int] = frozenset(), bits: int = 64) -> int:
    """The node of a set: a signed 64-bit hash of all its shingles, or another one where different sets have the first."""
    key = (xxhash.xxh3_64_intdigest(tokens.tobytes()) >> (64 - bits)) - (1 << 63)
    return check_of(tokens) if key in clashing else key


def check_of(tokens: np.ndarray) -> int:
    """A second hash of a set."""
    return xxhash.xxh3_64_intdigest(tokens.tobytes(), seed=N) - (1 << 63)


def required(size: int) -> int:
    """The least overlap with any set that links with one of this size."""
    return -(-PERCENT * size // 100)


def links(overlap, a, b):
    return 100 * overlap >= PERCENT * (a + b - overlap)


def _seen(seen: set, key: int) -> bool:
    """Whether a task has met a node before."""
    if key in seen:
        return True
    if len(seen) >= KNOWN:
        seen.clear()
    seen.add(key)
    return False


class Sketch:
    """The frequencies of a task's shingles."""

    def __init__(self):
        self.counts, self.waiting, self.size = np.zeros(COUNTERS, np.uint32), [], 0

    def add(self, tokens: np.ndarray) -> None:
        self.waiting.append(tokens)
        self.size += len(tokens)
        if self.size > HELD:
            self.count()

    def count(self) -> None:
        if self.waiting:
            self.counts += np.bincount((np.concatenate(self.waiting) >> SHIFT).astype(np.int64), minlength=COUNTERS).astype(np.uint32)
            self.waiting, self.size = [], 0

    def slices(self) -> tuple[pa.Array, pa.Array]:
        """slice, blob of each slice."""
        self.count()
        pack = zstandard.ZstdCompressor(1)
        return pa.array(range(SLICES), pa.int32()), pa.array([pack.compress(part.tobytes()) for part in np.split(self.counts, SLICES)], pa.binary())


def profile(docs: DataFrame, bits: int = 64) -> DataFrame:
    """doc_id, n, key, check of each row, and slice, blob: slices of each task's sketch of its distinct sets."""

    def run(batches):
        drop_tables()
        hashes, seen, sketch, kind = Hashes(), set(), Sketch(), None
        names = ["doc_id", "n", "key", "check", "slice", "blob"]
        for batch in batches:
            kind = batch.schema.field("doc_id").type
            n, keys, checks = [], [], []
            for text in batch.column("text").to_pylist():
                tokens = shingles(text, hashes)
                n.append(len(tokens))
                keys.append(key_of(tokens, bits=bits) if len(tokens) else None)
                checks.append(check_of(tokens) if len(tokens) else None)
                if len(tokens) and not _seen(seen, checks[-1]):
                    sketch.add(tokens)
            none = pa.nulls(len(n))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(x, pa.int64()) for x in (n, keys, checks)], none.cast(pa.int32()), none.cast(pa.binary())], names)
        if kind is not None:
            none = pa.nulls(SLICES)
            yield pa.RecordBatch.from_arrays([none.cast(kind), *[none.cast(pa.int64())] * 3, *sketch.slices()], names)

    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n long, key long, check long, slice int, blob binary")


def levels(slices: DataFrame) -> np.ndarray:
    """A byte for each counter of the summed sketch: eight steps for each doubling of the count."""

    def run(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, blob in zip(batch.column("slice").to_pylist(), batch.column("blob").to_pylist(), strict=True):
                sums[k] = sums.get(k, 0) + np.frombuffer(zstandard.decompress(blob), np.uint32).astype(np.uint64)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([np.floor(8 * np.log2(1 + s)).clip(0, 255).astype(np.uint8).tobytes() for s in sums.values()], pa.binary())], ["slice", "blob"])

    parts = slices.repartition(SLICES, "slice").mapInArrow(run, "slice int, blob binary").collect()  # COUNTERS bytes in all
    out = np.zeros((SLICES, COUNTERS // SLICES), np.uint8)
    for part in parts:
        out[part["slice"]] = np.frombuffer(part["blob"], np.uint8)
    return out.reshape(-1)


def first_tokens(tokens: np.ndarray, level: np.ndarray) -> np.ndarray:
    """The rarest size - T + 1 shingles of a set: sets that link share one of them."""
    take = len(tokens) - required(len(tokens)) + 1
    order = (level[(tokens >> SHIFT).astype(np.int64)].astype(np.uint64) << np.uint64(56)) | (tokens >> np.uint64(8))
    return tokens[np.argsort(order, kind="stable")[:take].copy()]


def near_in_size(postings: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Joins postings of one shingle whose sizes may link: a, b are edges, and a posting for each joined interval is left."""
    p = postings[np.lexsort((postings["low"], postings["token"]))]
    if not len(p):
        return p, np.empty(0, np.int64), np.empty(0, np.int64)
    # highest size so far in the run of a shingle: runs are told apart by an offset that no size reaches
    run = np.cumsum(np.concatenate(([0], (p["token"][1:] != p["token"][:-1]).astype(np.int64))))
    high = np.maximum.accumulate(p["high"].astype(np.int64) + (run << 33)) - (run << 33)
    new = np.ones(len(p), bool)
    new[1:] = (run[1:] != run[:-1]) | (PERCENT * p["low"][1:].astype(np.int64) > 100 * high[:-1])
    start = np.flatnonzero(new)
    group = np.cumsum(new) - 1
    joined = p[start].copy()
    joined["high"] = high[np.concatenate((start[1:], [len(p)])) - 1]
    first = p["key"][start][group]
    return joined, first[~new], p["key"][~new]


def unique_edges(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keep = a != b
    pairs = np.unique(np.stack((np.minimum(a, b)[keep], np.maximum(a, b)[keep])), axis=1)
    return pairs[0], pairs[1]


def candidate_edges(rows: DataFrame, sets_of, level: np.ndarray, buckets: int) -> DataFrame:
    """a, b: edges along which the nodes of each block hang together.  sets_of: batches -> (shingles, node) of each set, or None at a batch's end."""
    shared = rows.sparkSession.sparkContext.broadcast(level)

    def send(held: list[tuple[np.ndarray, int, int]]) -> pa.RecordBatch:
        """Of a task's sets the joined postings by bucket, and its edges in one bucket of these."""
        sizes = [len(t) for t, _, _ in held]
        p = np.empty(sum(sizes), POSTING)
        p["token"] = np.concatenate([t for t, _, _ in held])
        p["key"] = np.repeat(np.array([k for _, k, _ in held], np.int64), sizes)
        p["low"] = p["high"] = np.repeat(np.array([n for _, _, n in held], np.uint32), sizes)
        p, a, b = near_in_size(p)
        a, b = unique_edges(a, b)
        bucket = (p["token"] % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        p, bucket = p[order], bucket[order]
        start = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
        parts = [x.tobytes() for x in np.split(p, start[1:])]
        edges = [b""] * len(parts)
        edges[0] = np.stack((a, b)).tobytes()
        return pa.RecordBatch.from_arrays([pa.array(bucket[start], pa.int64()), pa.array(parts, pa.binary()), pa.array(edges, pa.binary())], ["bucket", "postings", "edges"])

    def postings(batches):
        held, n = [], 0
        for tokens, key in sets_of(batches):
            held.append((first_tokens(tokens, shared.value), key, len(tokens)))
            n += len(held[-1][0])
            if n > HELD:
                yield send(held)
                held, n = [], 0
        if held:
            yield send(held)

    def meet(table: pa.Table) -> pa.Table:
        p = np.concatenate([np.frombuffer(x, POSTING) for x in table.column("postings").to_pylist()])
        _, a, b = near_in_size(p)
        sent = [np.frombuffer(x, np.int64).reshape(2, -1) for x in table.column("edges").to_pylist() if x]
        a, b = unique_edges(np.concatenate([a, *[s[0] for s in sent]]), np.concatenate([b, *[s[1] for s in sent]]))
        return pa.table({"a": a, "b": b})

    return rows.mapInArrow(postings, "bucket long, postings binary, edges binary").groupBy("bucket").applyInArrow(meet, "a long, b long")


def text_edges(docs: DataFrame, level: np.ndarray, buckets: int, clashing: frozenset[int], bits: int) -> DataFrame:
    """Edges of the sets of all texts."""

    def sets_of(batches):
        drop_tables()
        hashes, seen = Hashes(), set()
        for batch in batches:
            for text in batch.column("text").to_pylist():
                tokens = shingles(text, hashes)
                if len(tokens) and not _seen(seen, key := key_of(tokens, clashing, bits)):
                    yield tokens, key

    return candidate_edges(docs.select("text"), sets_of, level, buckets)


def of_block(tokens: np.ndarray, block: int) -> np.ndarray:
    """The shingles of a set as those of its block: what two blocks have is told apart."""
    return tokens ^ np.uint64(xxhash.xxh3_64_intdigest(block.to_bytes(8, "little", signed=True)))


def _sets_in_blocks(batches):
    for batch in batches:
        for block, key, tokens in zip(*[batch.column(c).to_pylist() for c in ("block", "key", "tokens")], strict=True):
            yield of_block(np.frombuffer(tokens, np.uint64), block), key


def cut_again(nodes: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """key, block of the nodes of large blocks after another cut, by the frequencies in each block.  nodes: block, key, n, tokens."""

    def count(batches):
        sketch, some = Sketch(), False
        for tokens, _ in _sets_in_blocks(batches):
            sketch.add(tokens)
            some = True
        if some:
            yield pa.RecordBatch.from_arrays(list(sketch.slices()), ["slice", "blob"])

    level = levels(nodes.mapInArrow(count, "slice int, blob binary"))
    total = nodes.agg(F.sum("n")).first()[0] or 0
    edges = candidate_edges(nodes, _sets_in_blocks, level, max(1, total * (100 - PERCENT) // 100 // bucket))
    return components(edges).withColumnsRenamed({"node": "key", "root": "block"})


class Labels:
    """Components of places as labels in an array: the smaller component takes the label of the larger one."""

    def __init__(self, n: int):
        self.of, self.members = np.arange(n), [[k] for k in range(n)]

    def join(self, a: int, b: int) -> bool:
        a, b = int(self.of[a]), int(self.of[b])
        if a == b:
            return False
        if len(self.members[a]) < len(self.members[b]):
            a, b = b, a
        self.of[self.members[b]] = a
        self.members[a] += self.members[b]
        self.members[b] = []
        return True


def ranges(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first, first + 1, ... of each range, count numbers long, end to end."""
    begin = np.cumsum(count) - count
    return np.arange(int(count.sum())) + np.repeat(first - begin, count)


def merge(entries: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """All entries in order; those from one cut to the next ascend.  A heap merges few; many are merged as runs, which a stable sort does."""
    if len(entries) > HEAP:
        return np.sort(entries, kind="stable")
    entries, cuts = entries.tolist(), cuts.tolist()
    return np.array(list(heapq.merge(*[entries[a:b] for a, b in zip(cuts, cuts[1:]) if a < b])), np.int64)


def search(sets: list[np.ndarray], queries: list[bool] | None = None) -> list[tuple[int, int]]:
    """Links that join the sets to their components, as pairs of places; T-occurrence search by DivideSkip.

    Without queries each set is searched among those not larger than it; with
    queries only these sets are, among all.
    """
    size = np.array([len(s) for s in sets], np.int64)
    order = np.argsort(size, kind="stable")
    size = size[order]
    token = np.concatenate([sets[i] for i in order])
    node = np.repeat(np.arange(len(sets)), size)
    at = np.argsort(token, kind="stable")  # nodes ascend on each list
    token, node = token[at], node[at]
    new = np.concatenate(([True], token[1:] != token[:-1]))
    start = np.flatnonzero(new)
    length = np.diff(np.concatenate((start, [len(token)])))
    which = np.cumsum(new) - 1
    posting = which * len(sets) + node
    useful = np.flatnonzero(length[which] > 1)
    own = useful[np.argsort(node[useful], kind="stable")]  # places on lists, by node
    bounds = np.searchsorted(node[own], np.arange(len(sets) + 1))
    groups, out = Labels(len(sets)), []
    label = groups.of

    def join(x: int, y: int) -> None:
        if groups.join(x, y):
            out.append((int(order[x]), int(order[y])))

    def overlap_of(x: int, y: int) -> int:
        a, b = sets[order[x]], sets[order[y]]
        return int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())

    for x in range(len(sets)):
        if queries is not None and not queries[order[x]]:
            continue
        s = int(size[x])
        need = required(s)
        places = own[bounds[x] : bounds[x + 1]]
        first = start[which[places]]
        count = places - first if queries is None else length[which[places]]
        if int((count > (queries is not None)).sum()) < need:
            continue
        low = int(np.searchsorted(size, need))
        high = x if queries is None else int(np.searchsorted(size, 100 * s // PERCENT, "right"))
        if low >= high:
            continue
        first, count = first[count > 0], count[count > 0]
        # the node that is first on most lists
        heads = node[first]
        heads = heads[(heads >= low) & (heads < high) & (label[heads] != label[x])]
        if len(heads):
            found_at, times = np.unique(heads, return_counts=True)
            y = int(found_at[np.argmax(times)])
            if links(overlap_of(x, y), s, int(size[y])):
                join(x, y)
        if (label[low:high] == label[x]).all():
            continue
        longest = np.argsort(-count, kind="stable")
        skip = min(need - 1, int(need / (MU * math.log2(max(2, int(count.max()))) + 1)))
        chosen = longest[skip:]
        # what stands on the short lists: places of each list, one list after the other
        begin = np.cumsum(count[chosen]) - count[chosen]
        entries = node[ranges(first[chosen], count[chosen])]
        stays = (entries >= low) & (entries < high) & (label[entries] != label[x])
        if not stays.any():
            continue
        cuts = np.concatenate(([0], np.cumsum(np.add.reduceat(stays.astype(np.int64), begin))))
        merged = merge(entries[stays], cuts)
        ends = np.flatnonzero(np.concatenate((merged[1:] != merged[:-1], [True])))
        overlap = np.diff(ends, prepend=-1)
        cand = merged[ends]
        near = overlap >= need - skip
        cand, overlap = cand[near], overlap[near]
        for done in range(0, skip, AT_ONCE):
            if not len(cand):
                break
            lists = longest[done : min(skip, done + AT_ONCE)]
            if 8 * len(cand) * len(lists) > int(count[lists].sum()):
                # candidates on most of the lists: reading these costs less than the lookups
                overlap += np.bincount(node[ranges(first[lists], count[lists])], minlength=len(sets))[cand]
            else:
                # a binary search for each candidate in each list, by places in all postings, which ascend by list and node
                wanted = (which[first[lists]][:, None] * len(sets) + cand).ravel()
                hit = np.searchsorted(posting, wanted)
                overlap += (posting[np.minimum(hit, len(posting) - 1)] == wanted).reshape(len(lists), -1).sum(0)
            alive = overlap + skip - done - len(lists) >= need
            cand, overlap = cand[alive], overlap[alive]
        for y in cand[links(overlap, s, size[cand])].tolist():
            join(x, y)
    return out


def _block_search(table: pa.Table) -> pa.Table:
    """a, b: links of the blocks of a group.  A row has block, key, tokens and maybe query."""
    blocks: dict[int, dict[int, tuple[np.ndarray, bool]]] = {}
    query = table.column("query").to_pylist() if "query" in table.column_names else [True] * len(table)
    for block, key, tokens, q in zip(table.column("block").to_pylist(), table.column("key").to_pylist(), table.column("tokens").to_pylist(), query, strict=True):
        nodes = blocks.setdefault(block, {})
        nodes[key] = (np.frombuffer(tokens, np.uint64), q or (key in nodes and nodes[key][1]))
    a, b = [], []
    for nodes in blocks.values():
        keys = list(nodes)
        asked = [q for _, q in nodes.values()]
        for x, y in search([t for t, _ in nodes.values()], None if all(asked) else asked):
            a.append(keys[x])
            b.append(keys[y])
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _hub(table: pa.Table) -> pa.Table:
    """Of a sample of a block the node that shares most shingles with the others."""
    keys = table.column("key").to_pylist()
    sets = [np.frombuffer(t, np.uint64) for t in table.column("tokens").to_pylist()]
    token, times = np.unique(np.concatenate(sets), return_counts=True)
    best = max(range(len(sets)), key=lambda i: (times[np.searchsorted(token, sets[i])].sum() / len(sets[i]), keys[i]))
    return pa.table({"block": table.column("block").slice(0, 1), "hub": pa.array([keys[best]], pa.int64()), "hub_tokens": pa.array([sets[best].tobytes()], pa.binary())})


def _with_hub(table: pa.Table) -> pa.Table:
    """key, linked: whether each node of a chunk links with the hub, which is the row with is_hub."""
    rows = list(zip(table.column("key").to_pylist(), table.column("tokens").to_pylist(), table.column("is_hub").to_pylist(), strict=True))
    hub = next((np.frombuffer(t, np.uint64) for _, t, is_hub in rows if is_hub), None)
    keys, out = [], []
    for key, tokens, is_hub in rows:
        if not is_hub:
            x = np.frombuffer(tokens, np.uint64)
            keys.append(key)
            out.append(hub is not None and bool(links(int((hub[np.minimum(np.searchsorted(hub, x), len(hub) - 1)] == x).sum()), len(x), len(hub))))
    return pa.table({"key": pa.array(keys, pa.int64()), "linked": pa.array(out, pa.bool_())})


def linkable(nodes: DataFrame) -> DataFrame:
    """key of the nodes of which enough shingles also stand in other nodes of their block; the others link with nothing.

    A task counts what its own nodes share and sends a shingle at most twice, so
    a list is as long as the number of tasks.
    """

    def send(held: list[tuple[int, int, int, np.ndarray]]):
        block = np.repeat(np.array([h[0] for h in held], np.int64), [len(h[3]) for h in held])
        parts = np.repeat(np.array([h[1] for h in held], np.uint64), [len(h[3]) for h in held])
        key = np.repeat(np.array([h[2] for h in held], np.int64), [len(h[3]) for h in held])
        token = np.concatenate([h[3] for h in held])
        order = np.lexsort((token, block))
        block, parts, key, token = block[order], parts[order], key[order], token[order]
        new = np.concatenate(([True], (token[1:] != token[:-1]) | (block[1:] != block[:-1])))
        times = np.bincount(np.cumsum(new) - 1)
        several = np.repeat(times > 1, times)
        own, hits = np.unique(key[several], return_counts=True)
        # of a shingle that several nodes of the task have, two postings say that it is shared
        first = np.flatnonzero(new)
        sent = np.unique(np.concatenate((first, first[times > 1] + 1)))
        at, bucket = block[sent], (token[sent] % parts[sent]).astype(np.int64)
        done = several[sent]
        order = np.lexsort((bucket, at))
        at, bucket, tokens, keys, done = at[order], bucket[order], token[sent][order], key[sent][order], done[order]
        cut = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1]) | (bucket[1:] != bucket[:-1]))))
        blobs = [x.tobytes() for x in np.split(np.rec.fromarrays((tokens, keys, done), dtype=SHARED), cut[1:])]
        counts = [b""] * len(cut)
        counts[0] = np.stack((own, hits)).astype(np.int64).tobytes()
        return pa.RecordBatch.from_arrays([pa.array(at[cut]), pa.array(bucket[cut]), pa.array(blobs, pa.binary()), pa.array(counts, pa.binary())], ["block", "bucket", "postings", "counts"])

    def postings(batches):
        held, n = [], 0
        for batch in batches:
            for block, parts, key, tokens in zip(*[batch.column(c).to_pylist() for c in ("block", "parts", "key", "tokens")], strict=True):
                held.append((block, parts, key, np.frombuffer(tokens, np.uint64)))
                n += len(held[-1][3])
            if n > HELD:
                yield send(held)
                held, n = [], 0
        if held:
            yield send(held)

    def meet(table: pa.Table) -> pa.Table:
        p = np.concatenate([np.frombuffer(x, SHARED) for x in table.column("postings").to_pylist()])
        p = p[np.argsort(p["token"], kind="stable")]
        times = np.bincount(np.cumsum(np.concatenate(([True], p["token"][1:] != p["token"][:-1]))) - 1)
        key, hits = np.unique(p["key"][np.repeat(times > 1, times) & ~p["done"]], return_counts=True)
        sent = [np.frombuffer(x, np.int64).reshape(2, -1) for x in table.column("counts").to_pylist() if x]
        return pa.table({"key": np.concatenate([key, *[x[0] for x in sent]]), "hits": np.concatenate([hits.astype(np.int64), *[x[1] for x in sent]])})

    sent = nodes.select("block", "parts", "key", "tokens").mapInArrow(postings, "block long, bucket long, postings binary, counts binary")
    hits = sent.groupBy("block", "bucket").applyInArrow(meet, "key long, hits long").groupBy("key").agg(F.sum("hits").alias("hits"))
    return hits.join(nodes.select("key", "n"), "key").where(100 * F.col("hits") >= PERCENT * F.col("n")).select("key")


def split_links(nodes: DataFrame, hot: int = HOT) -> DataFrame:
    """a, b: links of blocks that are too large for one task.  nodes: block, key, n, tokens."""
    part = lambda column, parts: F.pmod(F.xxhash64(F.lit(3), column), parts)
    every = lambda parts: F.explode(F.sequence(F.lit(0).cast("long"), F.col(parts) - 1))
    sizes = durable(nodes.groupBy("block").agg(F.count("*").alias("nodes"), F.ceil(F.sum("n") / hot).alias("chunks")))
    placed = nodes.join(side(sizes), "block").withColumn("i", part("key", F.col("chunks")))
    sampled = placed.where(part("key", F.greatest(F.lit(1), F.floor(F.col("nodes") / SAMPLE))) == 0).select("block", "key", "tokens")
    # A block whose sample is empty has no hub, and all its nodes are queries.
    hubs = durable(sampled.groupBy("block").applyInArrow(_hub, "block long, hub long, hub_tokens binary"))
    sent = hubs.join(side(sizes), "block").select("block", every("chunks").alias("i"), F.col("hub").alias("key"), F.col("hub_tokens").alias("tokens"), F.lit(True).alias("is_hub"))
    near = placed.select("block", "i", "key", "tokens", F.lit(False).alias("is_hub")).unionByName(sent)
    near = durable(near.groupBy("block", "i").applyInArrow(_with_hub, "key long, linked boolean"))
    by_hub = near.where("linked").join(nodes.select("key", "block"), "key").join(side(durable(hubs.select("block", "hub"))), "block").where("hub <> key").select(F.col("hub").alias("a"), F.col("key").alias("b"))

    # a link's sizes are in one band or in two neighbouring ones: a band's ends differ by a quarter, as those of a link at most do
    banded = nodes.withColumn("band", F.floor(F.log(F.col("n").cast("double")) / math.log(100 / PERCENT)))
    asking = banded.join(near.where("NOT linked").select("key"), "key", "left_semi")
    asking = asking.withColumn("band", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)))
    chunks = banded.groupBy("block", "band").agg(F.ceil(F.sum("n") / hot).alias("chunks"))
    parts = durable(chunks.join(asking.groupBy("block", "band").agg(F.ceil(F.sum("n") / hot).alias("q_chunks")), ["block", "band"]))
    index = banded.join(side(parts), ["block", "band"]).select("block", "band", "key", "tokens", F.lit(False).alias("query"), part("key", F.col("chunks")).alias("i"), every("q_chunks").alias("j"))
    asked = asking.join(side(parts), ["block", "band"]).select("block", "band", "key", "tokens", F.lit(True).alias("query"), every("chunks").alias("i"), part("key", F.col("q_chunks")).alias("j"))
    found = index.unionByName(asked).groupBy("block", "band", "i", "j").applyInArrow(_block_search, "a long, b long")
    return by_hub.unionByName(found)


def with_sets(docs: DataFrame, nodes: DataFrame, clashing: frozenset[int], bits: int) -> DataFrame:
    """nodes (key, least, and others) with the shingles of each.

    Only the document with a node's smallest doc_id is read for it, so copies
    send nothing.  The nodes are broadcast if they are few enough for that;
    otherwise the documents are shuffled by doc_id.
    """
    nodes = side(nodes)

    def run(batches):
        hashes = Hashes()
        for batch in batches:
            sets = [shingles(t, hashes) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([key_of(x, clashing, bits) for x in sets], pa.int64()), pa.array([x.tobytes() for x in sets], pa.binary())], ["doc_id", "of", "tokens"])

    chosen = docs.join(nodes.select(F.col("least").alias("id")), F.col("doc_id").eqNullSafe(F.col("id")), "left_semi")
    sets = chosen.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, of long, tokens binary")
    return sets.join(nodes, (F.col("of") == F.col("key")) & F.col("doc_id").eqNullSafe(F.col("least"))).drop("doc_id", "of")


def shrunk(nodes: DataFrame, hot: int, bucket: int) -> tuple[DataFrame | None, DataFrame | None]:
    """Nodes in blocks of at most hot shingles, and those in larger ones, after cuts of the large blocks; None for no nodes."""
    calm, before = None, None
    for _ in range(CUTS):
        sizes = durable(nodes.groupBy("block").agg(F.sum("n").alias("shingles")))
        nodes = durable(nodes.join(side(sizes), "block"))
        small = nodes.where(F.col("shingles") <= hot).drop("shingles")
        calm = small if calm is None else calm.unionByName(small)
        nodes = nodes.where(F.col("shingles") > hot)
        left = nodes.agg(F.sum("n")).first()[0]
        if left is None or (before is not None and 10 * left > 9 * before):
            return calm, None if left is None else nodes.drop("shingles")
        before = left
        nodes = nodes.withColumn("parts", F.ceil(F.col("shingles") / bucket)).drop("shingles")
        nodes = durable(nodes.join(linkable(nodes), "key", "left_semi").drop("parts"))
        nodes = nodes.drop("block").join(cut_again(nodes, bucket), "key").select("block", "key", "n", "tokens")
    return calm, nodes


def linked_nodes(docs: DataFrame, keys: DataFrame, slices: DataFrame, clashing: frozenset[int], hot: int = HOT, bucket: int = BUCKET, bits: int = 64) -> DataFrame:
    """node, root of every node that links with another one.  keys: key, n, least of each node."""
    total = keys.agg(F.sum("n")).first()[0] or 0
    edges = text_edges(docs, levels(slices), max(1, total * (100 - PERCENT) // 100 // bucket), clashing, bits)
    nodes = durable(components(edges).withColumnsRenamed({"node": "key", "root": "block"}).join(keys, "key"))
    sizes = durable(nodes.groupBy("block").agg(F.sum("n").alias("shingles")))
    small, large = (durable(sizes.where(which).select("block")) for which in (F.col("shingles") <= hot, F.col("shingles") > hot))
    calm = with_sets(docs, durable(nodes.join(side(small), "block")), clashing, bits).select("block", "key", "n", "tokens")
    crowded = None
    if not large.isEmpty():
        found = durable(with_sets(docs, durable(nodes.join(side(large), "block")), clashing, bits).select("block", "key", "n", "tokens"))
        more, crowded = shrunk(found, hot, bucket)
        calm = calm.unionByName(more)
    groups = total // GROUP + 1
    found = calm.groupBy(F.pmod(F.xxhash64("block"), F.lit(groups)).alias("group")).applyInArrow(_block_search, "a long, b long")
    if crowded is not None:
        found = found.unionByName(split_links(durable(crowded), hot))
    return components(found)


def clashing_keys(rows: DataFrame) -> frozenset[int]:
    """The keys that different sets have: a few for each 1e10 documents."""
    clash = rows.groupBy("key").agg(F.min("check").alias("a"), F.max("check").alias("b")).where("a <> b").select("key")
    return frozenset(r["key"] for r in clash.collect())


def components_of(docs: DataFrame, hot: int = HOT, bucket: int = BUCKET, bits: int = 64) -> DataFrame:
    """doc_id, n_shingles, component_id: one row for each row of docs.

    bits is how many of a key's 64 bits are used; fewer make names clash, for tests.
    """
    small_batches(docs.sparkSession)
    docs = spread(docs.select("doc_id", text_of("text").alias("text")))
    both = durable(profile(docs, bits))
    rows = both.where("slice IS NULL").select("doc_id", "n", "key", "check")
    clashing = clashing_keys(rows.where("key IS NOT NULL"))
    if clashing:
        rows = rows.withColumn("key", F.when(F.col("key").isin(list(clashing)), F.col("check")).otherwise(F.col("key")))
    keys = durable(rows.where("key IS NOT NULL").groupBy("key").agg(F.max("n").alias("n"), F.min("doc_id").alias("least")))
    roots = linked_nodes(docs, keys, both.where("slice IS NOT NULL").select("slice", "blob"), clashing, hot, bucket, bits)
    keys = durable(keys.join(roots.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key")))
    named = keys.join(keys.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("key", "component_id")
    # copies share a key: adaptive execution splits one that many rows have
    out = rows.where("key IS NOT NULL").join(named, "key").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return out.unionByName(rows.where("key IS NULL").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id names their component: one document of each group, and all that link with nothing."""
    found = components_of(docs)
    return drop_ids(docs, found.where("doc_id <> component_id").select("doc_id"))
