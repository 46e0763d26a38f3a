"""Benchmark decontamination by suffix arrays over the training words.

Each shard (a block of training documents) gets a suffix array over its words, sorted by prefix doubling; only words
of the benchmark's vocabulary can start a match, so only their positions enter it, and a word outside that vocabulary
ends every match. Every suffix of every benchmark item is then searched by binary search, word by word, all of them
at once: the intervals after w words give all places of a window of w words, the last non-empty one the longest
verbatim match. A document place that leaves the interval of a suffix after w words shares w words with it, so the
longest match of every place, with any suffix, comes from the same search. Shards do not depend on each other, so nothing
is shuffled; the benchmark is sent to the executors in blocks of bounded size, and a worker takes one after the other
over the documents it holds. Results do not depend on how either side is cut.

Words: A-Z lower-cased, then runs of digits, a-z and everything beyond ASCII. A window is `window` consecutive words
of an item; an item with fewer words, but not none, is one window. Nulls and texts without words have no hits; items
with a null text have no window; a null item id is kept as a null id and left out of id lists. Repeated items each
count. A document with a null key is searched like any other, a repeated row gets equal results. A text of any length is
searched whole, as a shard of its own if it is over BLOCK_BYTES. Empty tables give no rows, or rows without hits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame, functions as F

from . import common

#: Benchmark bytes that are searched for at once; of a larger benchmark a worker holds one such part at a time.
PASS_BYTES = 8 << 20


@dataclass
class Queries:
    """One block of the benchmark: its vocabulary, its words as numbers from 1, and its items."""

    hashes: np.ndarray  # sorted word hashes of the vocabulary
    spelled: np.ndarray  # for each, where its bytes start and stop in data
    data: np.ndarray
    words: np.ndarray  # numbers of all words of all items
    firsts: np.ndarray  # first word of each item, len + 1
    ids: list
    window: int


def prepare(items: list[tuple], window: int) -> Queries:
    column = pa.array([text for _, text in items], pa.string())
    data, offsets = common.utf8(column)
    data = common.lowered(data)
    starts, stops, firsts = common.words(data, offsets, common.LETTERS)
    hashes = common.span_hash(common.prefix_hash(data), starts, stops)
    known, first, numbers = np.unique(hashes, return_index=True, return_inverse=True)
    spelled = np.stack([starts[first], stops[first]], 1) if len(first) else np.zeros((0, 2), np.int64)
    return Queries(known, spelled, data, numbers.astype(np.int64) + 1, firsts, [i for i, _ in items], window)


def numbered(data: np.ndarray, starts: np.ndarray, stops: np.ndarray, q: Queries) -> np.ndarray:
    """For each word its number in the vocabulary, or 0; equal hashes are confirmed byte by byte."""
    out = np.zeros(len(starts), np.int64)
    if not len(q.hashes) or not len(starts):
        return out
    hashes = common.span_hash(common.prefix_hash(data), starts, stops)
    bits = max(8, int(len(q.hashes) * 8).bit_length())
    present = np.zeros(1 << bits, bool)
    present[(q.hashes >> np.uint64(64 - bits)).astype(np.int64)] = True
    maybe = np.flatnonzero(present[(hashes >> np.uint64(64 - bits)).astype(np.int64)])
    at = np.minimum(np.searchsorted(q.hashes, hashes[maybe]), len(q.hashes) - 1)
    same = (q.hashes[at] == hashes[maybe]) & (q.spelled[at, 1] - q.spelled[at, 0] == stops[maybe] - starts[maybe])
    maybe, at = maybe[same], at[same]
    good = np.ones(len(maybe), bool)
    lengths = stops[maybe] - starts[maybe]
    active = np.arange(len(maybe))
    step = 0
    while len(active):
        good[active] &= data[starts[maybe[active]] + step] == q.data[q.spelled[at[active], 0] + step]
        step += 1
        active = active[(lengths[active] > step) & good[active]]
    out[maybe[good]] = at[good] + 1
    return out


def suffix_array(words: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """Positions at, sorted by the words from there on, to depth words at least; 0 ends a suffix."""
    n = len(words)
    bits = max(1, int(words.max(initial=1)).bit_length())
    width = max(1, 62 // bits)
    key = np.zeros(n, np.int64)
    padded = np.concatenate([words, np.zeros(width, np.int64)])
    alive = np.ones(n, bool)
    for j in range(width):
        own = padded[j : j + n]
        alive &= own > 0
        key = key << bits | np.where(alive, own, 0)
    order = np.argsort(key[at], kind="stable")
    sa = at[order]
    rank = np.zeros(n + 1, np.int64)  # from 1; 0: no suffix
    new = np.ones(len(sa), bool)
    new[1:] = key[sa[1:]] != key[sa[:-1]]
    # A group's rank is the place of its first member, so ranks stay right while parts of a group are sorted further.
    rank[sa] = np.flatnonzero(new)[np.cumsum(new) - 1] + 1
    ended = ~alive  # the suffix ended within the words sorted by: equal ones stay equal
    reach = width
    while reach < depth:
        single = np.ones(len(sa), bool)
        single[:-1] &= new[1:]
        single &= new
        left = np.flatnonzero(~single & ~ended[sa])
        if not len(left):
            break
        own = sa[left]
        second = rank[np.minimum(own + reach, n)]
        order = np.lexsort((second, rank[own]))
        # members of a group that have ended share its key and none of them is here, so the slots fit
        sa[left] = own[order]
        group, second = rank[own[order]], second[order]
        fresh = np.ones(len(left), bool)
        fresh[1:] = (group[1:] != group[:-1]) | (second[1:] != second[:-1])
        new[left] |= fresh
        begins = np.flatnonzero(new)
        rank[sa] = begins[np.cumsum(new) - 1] + 1
        ended = ended | (rank[np.minimum(np.arange(n) + reach, n)] == 0) | ended[np.minimum(np.arange(n) + reach, n - 1)]
        reach *= 2
    return sa


def search(words: np.ndarray, sa: np.ndarray, q: Queries, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every benchmark suffix the interval of sa after wanted words (empty if none), and for every place of sa the
    most words that any benchmark suffix shares with it."""
    m = len(q.words)
    item_end = np.repeat(q.firsts[1:], np.diff(q.firsts))
    low, high = np.zeros(m, np.int64), np.full(m, len(sa), np.int64)
    reach = np.zeros(len(sa), np.int64)
    kept = np.zeros((2, m), np.int64)
    padded = np.concatenate([words, [0]])
    n = len(words)
    depth = 0

    def left(start: np.ndarray, stop: np.ndarray) -> None:
        """These ranges of sa share depth words with a suffix, and no more; depth never falls from call to call."""
        size = stop - start
        if depth and (total := int(size.sum())):
            if total <= len(sa):
                reach[np.repeat(start - np.cumsum(size) + size, size) + np.arange(total)] = depth
            else:
                step = np.bincount(start, minlength=len(sa) + 1) - np.bincount(stop, minlength=len(sa) + 1)
                reach[np.cumsum(step)[:-1] > 0] = depth

    active = np.flatnonzero(high > low)
    while len(active):
        ended = active[active + depth >= item_end[active]]
        left(low[ended], high[ended])
        active = active[active + depth < item_end[active]]
        if not len(active):
            break
        target = q.words[active + depth]
        bounds = []
        for upper in (False, True):
            a, b = low[active].copy(), high[active].copy()
            while (go := a < b).any():
                mid = (a + b) >> 1
                own = padded[np.minimum(sa[np.minimum(mid, len(sa) - 1)] + depth, n)]
                right = go & ((own <= target) if upper else (own < target))
                a = np.where(right, mid + 1, a)
                b = np.where(go & ~right, mid, b)
            bounds.append(a)
        left(low[active], bounds[0])
        left(bounds[1], high[active])
        low[active], high[active] = bounds
        active = active[bounds[1] > bounds[0]]
        depth += 1
        full = active[wanted[active] == depth]
        kept[0, full], kept[1, full] = low[full], high[full]
    return kept[0], kept[1], reach


def located(q: Queries, sequence: np.ndarray) -> tuple[int, int]:
    """(item, word in it) of the first place of these words within one item."""
    at = np.flatnonzero(q.words == sequence[0])
    at = at[at + len(sequence) <= q.firsts[np.searchsorted(q.firsts, at, "right")]]
    for k in range(1, len(sequence)):
        at = at[q.words[at + k] == sequence[k]]
    item = int(np.searchsorted(q.firsts, at[0], "right")) - 1
    return item, int(at[0] - q.firsts[item])


def scan(block: pa.RecordBatch, q: Queries, least: int | None = None) -> list[tuple]:
    """For each text (n_words, flags of its hit words, items, words of its longest match, (item, its word, word of the text)).

    The places of a longest match are looked up where it has `least` words or more, else they are -1.
    """
    data, offsets = common.utf8(block.column("text"))
    data = common.lowered(data)
    starts, stops, firsts = common.words(data, offsets, common.LETTERS)
    numbers = numbered(data, starts, stops, q)
    n_docs = len(offsets) - 1
    doc_of = np.repeat(np.arange(n_docs), np.diff(firsts))
    # A word 0 between two texts: no match runs on into the next one.
    places = np.arange(len(numbers)) + doc_of
    spread = np.zeros(len(numbers) + n_docs, np.int64)
    spread[places] = numbers
    hit = np.zeros(len(spread) + 1, np.int64)
    items: list[set] = [set() for _ in range(n_docs)]
    best = np.zeros(n_docs, np.int64)
    where: list[tuple] = [(-1, -1, -1)] * n_docs
    at = np.flatnonzero(spread > 0)
    if len(at) and len(q.words):
        item_of = np.repeat(np.arange(len(q.ids)), np.diff(q.firsts))
        size = np.diff(q.firsts)[item_of]
        width = np.minimum(q.window, size)
        room = q.firsts[item_of + 1] - np.arange(len(q.words))
        wanted = np.where(room >= width, width, -1)
        sa = suffix_array(spread, at, int(size.max()))
        low, high, reach = search(spread, sa, q, wanted)
        owner = np.zeros(len(spread), np.int64)
        owner[places] = doc_of
        for s in np.flatnonzero(high > low):
            own = sa[low[s] : high[s]]
            hit[own] += 1
            hit[own + width[s]] -= 1
            for d in np.unique(owner[own]).tolist():
                items[d].add(int(item_of[s]))
        np.maximum.at(best, owner[sa], reach)
        if least is not None:
            first = np.full(n_docs, len(spread), np.int64)
            top = reach == best[owner[sa]]
            np.minimum.at(first, owner[sa[top]], sa[top])
            for d in np.flatnonzero(best >= max(1, least)).tolist():
                where[d] = (*located(q, spread[first[d] : first[d] + best[d]]), int(first[d] - d - firsts[d]))
    flags = np.cumsum(hit[:-1]) > 0
    return [(int(firsts[d + 1] - firsts[d]), flags[places[firsts[d] : firsts[d + 1]]], items[d], int(best[d]), where[d]) for d in range(n_docs)]


def benchmark_blocks(benchmark: DataFrame, key: str, text: str) -> Iterator[list[tuple]]:
    """The items, in blocks of PASS_BYTES at most (or one item), fetched part by part."""
    rows = benchmark.select(F.col(key).cast("string"), F.col(text).cast("string")).toLocalIterator()
    block: list[tuple] = []
    held = 0
    for item, body in rows:
        own = len((body or "").encode())
        if block and held + own > PASS_BYTES:
            yield block
            block, held = [], 0
        block.append((item, body))
        held += own
    yield block


def _shared(benchmark: DataFrame, window: int, key: str, text: str) -> list[Broadcast]:
    """The prepared blocks, each sent as soon as it is read: the driver holds one at a time."""
    return [benchmark.sparkSession.sparkContext.broadcast(prepare(block, window)) for block in benchmark_blocks(benchmark, key, text)]


def _each(shared: list[Broadcast]) -> Iterator[Queries]:
    """The blocks one after the other; of several, a worker keeps none behind."""
    for part in shared:
        yield part.value
        if len(shared) > 1:
            part.__dict__.pop("_value", None)


@dataclass
class Found:
    """What the blocks of the benchmark together say of one text."""

    flags: np.ndarray | None = None
    ids: tuple = ()
    longest: int = 0
    place: tuple = (None, -1, -1)


def _scanned(block: pa.RecordBatch, shared: list[Broadcast], least: int | None = None) -> list[Found]:
    out = [Found() for _ in range(block.num_rows)]
    for q in _each(shared):
        for f, (_, flags, own, longest, (item, word, at)) in zip(out, scan(block, q, least)):
            f.flags = flags if f.flags is None else f.flags | flags
            f.ids += tuple(q.ids[i] for i in own)
            # Of matches of one length the one that the text holds first counts, then the benchmark's first.
            if longest > f.longest or (longest == f.longest and 0 <= at < f.place[2]):
                f.longest, f.place = longest, (q.ids[item] if item >= 0 else None, word, at)
    return out


RESULT = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, longest_match long"


def hits(docs: DataFrame, benchmark: DataFrame, window: int = 10, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """Per document: n_words, n_hit, n_items, items_sha256, contaminated, longest_match (most words that it shares with a benchmark item)."""
    common.arrow_limits(docs.sparkSession)
    chosen = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    shared = _shared(benchmark, window, item, item_text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in common.blocks(batches, "text"):
            rows = []
            for doc, f in zip(block.column("doc_id").to_pylist(), _scanned(block, shared)):
                names = sorted(i for i in f.ids if i is not None)
                n_hit = int(f.flags.sum())
                rows.append((doc, len(f.flags), n_hit, len(f.ids), hashlib.sha256(",".join(names).encode()).hexdigest(), n_hit > 0, f.longest))
            kinds = [pa.int64()] * 4 + [pa.string(), pa.bool_(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=[x.split()[0] for x in RESULT.split(", ")])

    return chosen.mapInArrow(run, RESULT)


def matches(docs: DataFrame, benchmark: DataFrame, least: int = 5) -> DataFrame:
    """The longest verbatim match of each document, where it has `least` words or more: doc_id, item_id, item_word, doc_word, words.

    Of several of that length the first one in the document is given, at its first place in the benchmark.
    """
    common.arrow_limits(docs.sparkSession)
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, item_id string, item_word long, doc_word long, words long"
    shared = _shared(benchmark, least, "item_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in common.blocks(batches, "text"):
            found = [(d, *f.place, f.longest) for d, f in zip(block.column("doc_id").to_pylist(), _scanned(block, shared, least)) if f.longest >= least]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()])], names=[x.split()[0] for x in schema.split(", ")])

    return chosen.mapInArrow(run, schema)


def decontaminated(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """docs without the documents that hold a window of the benchmark; all columns stay as they are."""
    common.arrow_limits(docs.sparkSession)
    shared = _shared(benchmark, window, "item_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in common.blocks(batches, "text"):
            yield block.filter(pa.array([not f.flags.any() for f in _scanned(block, shared)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
