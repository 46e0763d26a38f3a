"""Suffix-array dedup: every byte inside a 200-byte string that starts somewhere else as well is removed.

1. Equal whole texts are grouped by their SHA-256, which names a text from here on; one row of each goes on.
2. Anchors: of every 200-byte window the 64-byte string with the least hash is its anchor, so equal windows have equal
   anchors at the same offset. Counting anchor hashes over the corpus leaves those that occur in two places.
3. Around each of these an anchored piece is cut: the bytes of all windows of that anchor. Equal pieces are counted
   first, with partial counts before the shuffle, so a passage that a third of all rows share is one row. All windows
   of a piece that occurs twice are covered.
4. The distinct pieces of one anchor meet in one task, where their window suffixes are sorted by mergesort: two suffixes
   are compared by their longest common extension, found by binary search over prefix polynomial hashes, and the byte
   behind it. Neighbours that share 200 bytes are confirmed byte by byte; where the bytes contradict the hashes, the
   class is put together again by its bytes.
5. An anchor with more than GROUP distinct pieces (a short phrase in ever new surroundings) would not fit a task: its
   windows are counted by their bytes in the same way as whole pieces, which gives the same result.

Windows are judged on the input. Nulls count as empty texts. Every row is judged by its own text: a row with a null key
takes part like any other, a repeated row is a copy of itself, rows that share a key but not the text do not touch each
other. Texts under 200 bytes lose nothing. Very long texts are cut into blocks that overlap by a window. An empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from . import common

WINDOW, ANCHOR = 200, 64
#: Distinct pieces of an anchor up to which they are sorted in one task.
GROUP = 4096
#: Bytes of one numpy pass; places within it fit into PLACE_BITS.
STRETCH, PLACE_BITS = 1 << 20, 26


def window_anchors(data: np.ndarray, offsets: np.ndarray, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(places, hashes, first windows, last windows) of the anchors of all windows of the texts between offsets.

    An anchor at a place serves the windows that start from first to last, all in one text.
    """
    nothing = np.zeros(0, np.int64)
    n = len(data) - window + 1
    sizes = np.diff(offsets)
    if n <= 0 or not (sizes >= window).any():
        return nothing, nothing.view(np.uint64), nothing, nothing
    grams = len(data) - anchor + 1
    at = np.arange(grams)
    hashes = common.span_hash(common.prefix_hash(data), at, at + anchor)
    keys = (hashes >> np.uint64(PLACE_BITS)) << np.uint64(PLACE_BITS) | at.astype(np.uint64)
    width = window - anchor + 1
    # Sliding minimum: the rest of one stretch of `width` keys and the beginning of the next cover any window.
    rows = -(-grams // width)
    padded = np.full(rows * width, np.uint64(0xFFFFFFFFFFFFFFFF), np.uint64)
    padded[:grams] = keys
    grid = padded.reshape(rows, width)
    forward = np.minimum.accumulate(grid, axis=1).ravel()
    backward = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(backward[:n], forward[width - 1 : width - 1 + n])
    room = np.repeat(offsets[1:], sizes) - np.arange(len(data))
    starts = np.flatnonzero(room[:n] >= window)
    places = (least[starts] & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64)
    new = np.ones(len(starts), bool)
    new[1:] = (places[1:] != places[:-1]) | (starts[1:] != starts[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(starts)]]) - 1
    return places[first], hashes[places[first]], starts[first], starts[last]


def stretches(data: np.ndarray, offsets: np.ndarray, window: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first text, bytes, offsets, place of each text's bytes in the whole text): blocks, long texts in overlapping parts."""
    sizes = np.diff(offsets)
    i, n = 0, len(sizes)
    while i < n:
        if sizes[i] > STRETCH:
            for at in range(0, int(sizes[i]) - window + 1, STRETCH - window + 1):
                part = data[offsets[i] + at : min(offsets[i] + at + STRETCH, offsets[i + 1])]
                yield i, part, np.array([0, len(part)]), np.array([at])
            i += 1
            continue
        j = i + 1
        while j < n and offsets[j + 1] - offsets[i] <= STRETCH:
            j += 1
        yield i, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], np.zeros(j - i, np.int64)
        i = j


def text_anchors(data: np.ndarray, offsets: np.ndarray, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, place, hash, first window, last window) of all anchors, places counted from the start of the text."""
    found = []
    for first, part, own, shift in stretches(data, offsets, window):
        place, hashes, low, high = window_anchors(part, own, window, anchor)
        text = np.searchsorted(own, low, "right") - 1
        # texts of no bytes share an offset: the last of them is the one that has the bytes
        move = shift[text] - own[text]
        found.append((text + first, place + move, hashes, low + move, high + move))
    if not found:
        empty = np.zeros(0, np.int64)
        return empty, empty, empty.view(np.uint64), empty, empty
    text, place, hashes, low, high = (np.concatenate(x) for x in zip(*found))
    # A long text's parts may share an anchor: it counts once, with all its windows.
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (place[1:] != place[:-1])
    first = np.flatnonzero(new)
    return text[first], place[first], hashes[first], np.minimum.reduceat(low, first) if len(first) else low, np.maximum.reduceat(high, first) if len(first) else high


class Suffixes:
    """Suffixes of one byte array, compared over `limit` bytes by prefix hashes and binary search."""

    def __init__(self, data: np.ndarray, limit: int):
        self.data = np.concatenate([data, np.zeros(limit + 1, np.uint8)])
        self.prefix = common.prefix_hash(self.data)
        self.power = common.powers(common.BASE, len(self.prefix))
        self.limit = limit

    def equal(self, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Whether size bytes from a hash like those from b; the factor brings both to the same power."""
        return (self.prefix[a + size] - self.prefix[a]) * self.power[b] == (self.prefix[b + size] - self.prefix[b]) * self.power[a]

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the longest common extension, limit at most."""
        low = np.where(self.equal(a, b, np.full(len(a), self.limit)), self.limit, 0)
        high = np.full(len(a), self.limit)
        while (go := np.flatnonzero(low < high)).size:
            mid = (low[go] + high[go] + 1) >> 1
            same = self.equal(a[go], b[go], mid)
            low[go[same]] = mid[same]
            high[go[~same]] = mid[~same] - 1
        return low

    def before(self, a: np.ndarray, b: np.ndarray, or_equal: bool) -> np.ndarray:
        shared = self.common(a, b)
        full = shared == self.limit
        return np.where(full, or_equal, self.data[a + shared] < self.data[b + shared])

    def same_bytes(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.empty(len(a), bool)
        for i in range(0, len(a), 4096):
            x, y = a[i : i + 4096, None] + np.arange(self.limit), b[i : i + 4096, None] + np.arange(self.limit)
            out[i : i + 4096] = (self.data[x] == self.data[y]).all(1)
        return out


def sorted_classes(suffixes: Suffixes, start: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """start, sorted by suffix within each class bounds[i]:bounds[i + 1], by mergesort: runs double, all merges of a round at once."""
    start = start.copy()
    sizes = np.diff(bounds)
    run = 1
    while run < sizes.max(initial=0):
        live = np.flatnonzero(sizes > run)
        base = np.repeat(bounds[live], sizes[live])
        size = np.repeat(sizes[live], sizes[live])
        at = np.arange(len(base)) - np.repeat(np.cumsum(sizes[live]) - sizes[live], sizes[live])
        pair = at // (2 * run) * 2 * run
        in_left = at - pair < run
        # Each suffix's place: its place in its own run and the number of suffixes of the other run before it.
        low = np.where(in_left, np.minimum(pair + run, size), pair)
        high = np.where(in_left, np.minimum(pair + 2 * run, size), np.minimum(pair + run, size))
        other = low.copy()
        own = start[base + at]
        while (go := np.flatnonzero(low < high)).size:
            mid = (low[go] + high[go]) >> 1
            against = start[base[go] + mid]
            left = in_left[go]
            goes_first = np.empty(len(go), bool)
            goes_first[left] = suffixes.before(against[left], own[go][left], False)
            goes_first[~left] = suffixes.before(against[~left], own[go][~left], True)
            low[go[goes_first]] = mid[goes_first] + 1
            high[go[~goes_first]] = mid[~goes_first]
        place = np.where(in_left, at + low - other, at - run + low - other)
        start[base + place] = own
        run *= 2
    return start


def repeated_windows(pieces: list[bytes], anchors: np.ndarray, anchor_hash: np.ndarray, window: int) -> np.ndarray:
    """Start (in the concatenated pieces) of each window that occurs twice among the windows of the pieces with its anchor hash.

    anchors: place of the anchor in its piece.
    """
    data = np.frombuffer(b"".join(pieces), np.uint8)
    sizes = np.array([len(p) for p in pieces], np.int64)
    counts = sizes - window + 1
    origin = np.cumsum(sizes) - sizes
    piece = np.repeat(np.arange(len(pieces)), counts)
    offset = np.arange(len(piece)) - np.repeat(np.cumsum(counts) - counts, counts)
    starts = origin[piece] + offset
    group = np.unique(anchor_hash, return_inverse=True)[1]
    # Windows can only be equal with the same anchor at the same offset: these are the classes.
    classes = group[piece] * (window + 1) + anchors[piece] - offset
    order = np.argsort(classes, kind="stable")
    starts, classes = starts[order], classes[order]
    bounds = np.concatenate([[0], np.flatnonzero(np.diff(classes)) + 1, [len(classes)]])
    big = np.repeat(np.diff(bounds) > 1, np.diff(bounds))
    starts, classes = starts[big], classes[big]
    if not len(starts):
        return starts
    bounds = np.concatenate([[0], np.flatnonzero(np.diff(classes)) + 1, [len(classes)]])
    suffixes = Suffixes(data, window)
    starts = sorted_classes(suffixes, starts, bounds)
    a, b = starts[:-1], starts[1:]
    near = np.flatnonzero(classes[:-1] == classes[1:])
    near = near[suffixes.equal(a[near], b[near], np.full(len(near), window))]
    same = suffixes.same_bytes(a[near], b[near])
    found = np.zeros(len(starts), bool)
    found[near[same]] = found[near[same] + 1] = True
    for wrong in np.unique(classes[near[~same]]).tolist():  # equal hashes of different bytes
        own = np.flatnonzero(classes == wrong)
        spelled = [data[x : x + window].tobytes() for x in starts[own].tolist()]
        seen = Counter(spelled)
        found[own] = [seen[x] > 1 for x in spelled]
    return np.sort(starts[found])


def runs(starts: np.ndarray, window: int) -> list[int]:
    """Maximal covered runs of windows that begin at the sorted starts: start, stop, start, stop ..."""
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) > window)
    return np.stack([starts[np.concatenate([[0], cut + 1])], starts[np.concatenate([cut, [len(starts) - 1]])] + window], 1).ravel().tolist()


def _merged(edges: list[int]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(zip(edges[::2], edges[1::2])):
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _sets(texts: DataFrame, window: int, anchor: int) -> DataFrame:
    """Per row of (doc_id, text): digest, n_bytes and the hashes of its anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in common.blocks(batches, "text"):
            data, offsets = common.utf8(block.column("text"))
            text, _, hashes, _, _ = text_anchors(data, offsets, window, anchor)
            raw = data.tobytes()
            digests = [hashlib.sha256(raw[a:b]).digest() for a, b in zip(offsets[:-1], offsets[1:])]
            ends = np.searchsorted(text, np.arange(len(digests) + 1))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(hashes.view(np.int64)))
            yield pa.RecordBatch.from_arrays([block.column("doc_id"), pa.array(digests, pa.binary()), pa.array(np.diff(offsets)), lists], names=["doc_id", "digest", "n_bytes", "anchors"])

    return texts.mapInArrow(run, "doc_id long, digest binary, n_bytes long, anchors array<long>")


def _pieces(hit: DataFrame, window: int, anchor: int) -> DataFrame:
    """The pieces of the repeated anchors (hashes in `repeated`) of each text; `name` stands for the piece and its anchor's place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in common.blocks(batches, "text"):
            data, offsets = common.utf8(block.column("text"))
            text, place, hashes, low, high = text_anchors(data, offsets, window, anchor)
            wanted = block.column("repeated")
            owner = np.repeat(np.arange(len(wanted), dtype=np.uint64), np.diff(wanted.offsets.to_numpy()))
            # A text and a hash as one number: an equal number of another pair only brings a piece that nothing equals.
            held = np.isin(hashes ^ common.mix(text.astype(np.uint64)), wanted.flatten().to_numpy().view(np.uint64) ^ common.mix(owner))
            text, place, hashes, low, high = (x[held] for x in (text, place, hashes, low, high))
            start, size = offsets[text] + low, high - low + window
            raw = data.tobytes()
            for i in range(0, len(text), 4000):
                j = slice(i, i + 4000)
                own = [raw[a : a + n] for a, n in zip(start[j].tolist(), size[j].tolist())]
                at = (place - low)[j]
                names = [hashlib.blake2b(p, digest_size=16, salt=k.to_bytes(8, "little")).digest() for p, k in zip(own, at.tolist())]
                columns = [block.column("tid").take(pa.array(text[j])), block.column("alone").take(pa.array(text[j])), pa.array(hashes[j].view(np.int64)), pa.array(low[j]), pa.array(at), pa.array(names, pa.binary()), pa.array(own, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["tid", "alone", "hash", "first", "anchor", "name", "piece"])

    return hit.mapInArrow(run, "tid long, alone boolean, hash long, first long, anchor long, name binary, piece binary")


def _sorted_pieces(pieces: DataFrame, window: int) -> DataFrame:
    """Covered runs (name, edges within the piece) of distinct pieces; those of one anchor lie together in a task."""

    def solve(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        block = pa.Table.from_batches(rows).combine_chunks()
        own, n, hashes = block.column("piece").to_pylist(), block.column("n").to_numpy(), block.column("hash").to_numpy()
        sizes = np.array([len(p) for p in own], np.int64)
        some = np.flatnonzero(np.isin(hashes, hashes[1:][hashes[1:] == hashes[:-1]]))  # rows are in the order of hashes
        starts = repeated_windows([own[i] for i in some.tolist()], block.column("anchor").to_numpy()[some], hashes[some], window)
        origin = np.cumsum(sizes[some]) - sizes[some]
        ends = np.searchsorted(starts, np.append(origin, sizes[some].sum()))
        edges: list[list[int]] = [[] for _ in own]
        for i, o, a, b in zip(some.tolist(), origin.tolist(), ends[:-1].tolist(), ends[1:].tolist()):
            if b > a:
                edges[i] = runs(starts[a:b] - o, window)
        for i in np.flatnonzero(n > 1).tolist():
            edges[i] = [0, int(sizes[i])]
        good = [i for i, e in enumerate(edges) if e]
        return pa.RecordBatch.from_arrays([block.column("name").combine_chunks().take(pa.array(good, pa.int64())), pa.array([edges[i] for i in good], pa.list_(pa.int64()))], names=["name", "edges"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            hashes = batch.column("hash").to_numpy()
            changes = (np.flatnonzero(hashes[1:] != hashes[:-1]) + 1).tolist()
            if held and held[-1].column("hash")[-1].as_py() != hashes[0]:
                changes.insert(0, 0)
            done = 0
            sizes = np.concatenate([[0], np.cumsum(pc.binary_length(batch.column("piece")).to_numpy())])
            for cut in changes:  # where a new anchor begins
                if size + sizes[cut] - sizes[done] >= STRETCH // 2:
                    if cut > done:
                        held.append(batch.slice(done, cut - done))
                    yield solve(held)
                    held, size, done = [], 0, cut
            held.append(batch.slice(done))
            size += int(sizes[-1] - sizes[done])
        if held:
            yield solve(held)

    return pieces.mapInArrow(run, "name binary, edges array<long>")


def _windows(pieces: DataFrame, window: int) -> DataFrame:
    """Each window of the distinct pieces: name, start, n, its bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, n, piece in zip(*(batch.column(c).to_pylist() for c in ("name", "n", "piece"))):
                count = len(piece) - window + 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * count, pa.binary()), pa.array(range(count), pa.int64()), pa.array([n] * count, pa.int64()), pa.array([piece[i : i + window] for i in range(count)], pa.binary())], names=["name", "start", "n", "bytes"]
                )

    return pieces.mapInArrow(run, "name binary, start long, n long, bytes binary")


def covered(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(one row per row of docs: doc_id, digest, n_bytes, copies and number (tid) of its text; per text that occurs once and
    has repeats: tid, text, edges of what is covered)."""
    spark = docs.sparkSession
    common.arrow_limits(spark)
    texts = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    sets = common.stored(spark, _sets(texts, window, anchor), "anchors")
    groups = sets.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    # A number for each text; it stays as it was written.
    groups = common.stored(spark, groups.withColumn("tid", F.monotonically_increasing_id()), "texts")
    # One row of each text stands for it; rows that are repeated whole come more than once, which changes no result, as
    # all that they hold occurs twice.
    chosen = groups.select(F.col("digest").alias("d"), "rep", "tid", (F.col("copies") == 1).alias("alone"))
    this = F.col("digest").eqNullSafe(F.col("d")) & F.col("doc_id").eqNullSafe(F.col("rep"))
    places = sets.join(chosen, this).select("tid", F.explode("anchors").alias("hash"))
    repeated = common.stored(spark, places.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("hash"), "repeated")
    per_text = places.join(repeated, "hash").groupBy("tid").agg(F.collect_set("hash").alias("repeated"))
    per_text = chosen.join(per_text.hint("merge"), "tid")
    named = texts.withColumn("digest", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))
    hit = common.stored(spark, named.join(per_text.hint("merge"), this).select("tid", "text", "alone", "repeated"), "hit")
    pieces = common.stored(spark, _pieces(hit, window, anchor), "pieces")
    distinct = common.stored(spark, pieces.groupBy("hash", "anchor", "name", "piece").agg(F.count(F.lit(1)).alias("n")), "distinct")
    many = common.stored(spark, distinct.groupBy("hash").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > GROUP).select("hash"), "many")
    few = distinct.join(many, "hash", "left_anti").repartition("hash").sortWithinPartitions("hash")
    windows = _windows(distinct.join(many, "hash", "left_semi").where("n = 1"), window)
    # Windows of pieces that occur twice are covered as they are, but count for the others.
    twice = _windows(distinct.join(many, "hash", "left_semi"), window).groupBy("bytes").agg(F.sum("n").alias("n")).where("n > 1").select("bytes")
    wide = windows.join(twice, "bytes").select("name", F.array("start", F.col("start") + window).alias("edges"))
    whole = distinct.join(many, "hash", "left_semi").where("n > 1").select("name", F.array(F.lit(0).cast("long"), F.length("piece").cast("long")).alias("edges"))
    solved = common.stored(spark, _sorted_pieces(few, window), "solved").unionByName(wide).unionByName(whole)
    placed = pieces.where("alone").select("tid", "first", "name").join(solved.hint("merge"), "name")
    edges = placed.select("tid", F.transform("edges", lambda e: e + F.col("first")).alias("edges")).groupBy("tid").agg(F.flatten(F.collect_list("edges")).alias("edges"))
    return sets.drop("anchors").join(groups.drop("rep"), "digest"), hit.where("alone").select("tid", "text").join(edges.hint("merge"), "tid")


def _cut(found: DataFrame) -> DataFrame:
    """tid, the bytes kept, their digest, removed bytes and removed runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in common.blocks(batches, "text"):
            rows = []
            for tid, text, edges in zip(*(block.column(c).to_pylist() for c in ("tid", "text", "edges"))):
                raw, spans = text.encode(), _merged(edges)
                ends = [0, *(x for s in spans for x in s), len(raw)]
                kept = b"".join(raw[a:b] for a, b in zip(ends[::2], ends[1::2]))
                rows.append((tid, kept, hashlib.sha256(kept).hexdigest(), len(raw) - len(kept), len(spans)))
            kinds = [pa.int64(), pa.binary(), pa.string(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["tid", "kept", "sha", "removed", "spans"])

    return found.mapInArrow(run, "tid long, kept binary, sha string, removed long, spans long")


def removed(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, key: str = "doc_id", text: str = "text", with_kept: bool = False) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256; with_kept: and, of documents that lose some of their
    bytes but not all, the bytes kept (else null)."""
    each, found = covered(docs, window, anchor, key, text)
    cut = _cut(found)
    joined = each.join((cut if with_kept else cut.drop("kept")).hint("merge"), "tid", "left")
    whole = (F.col("copies") > 1) & (F.col("n_bytes") >= window)
    partly = F.col("removed").isNotNull()
    return joined.select(
        "doc_id", "n_bytes",
        F.when(whole, F.col("n_bytes")).when(partly, F.col("removed")).otherwise(F.lit(0)).cast("long").alias("n_removed"),
        F.when(whole, F.lit(1)).when(partly, F.col("spans")).otherwise(F.lit(0)).cast("long").alias("n_spans"),
        F.when(whole, F.sha2(F.lit(b""), 256)).when(partly, F.col("sha")).otherwise(F.lower(F.hex("digest"))).alias("kept_sha256"),
        *([F.when(~whole, F.col("kept")).alias("kept")] if with_kept else []),
    )
