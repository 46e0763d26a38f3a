"""Line dedup: content-defined chunks of lines, of which a globally repeated one stays at its first place only.

A rolling hash over the hashes of WIDTH successive lines ends a chunk where it is divisible by DIVISOR, so boundaries
depend on the lines around them alone and survive shifts. Chunks of two lines or more are counted over the corpus by
a 128-bit hash; repeated ones are compared byte by byte with the first occurrence (smallest key, then the text's hash and
the place in it), which is kept, and then removed with one line break. Chunks of one line are never removed.

With runs=True (op2_lines and the pipeline) boundaries do not limit what is found: every two adjacent lines, and every
line of WORDS words or more, are counted and compared in the same way. Repeated pairs that overlap make a run, which
ends in both directions where a pair did not occur earlier; pairs of blank lines link what they stand between. A run
goes if it has WORDS words or holds the repeated pairs of a whole chunk, a line of WORDS words if it occurred earlier.
The first place of a line never goes, as every line that goes has an earlier place.

Nulls: a null text stays null and has no lines; a row with a null key takes part and comes after all others. An empty
text is one empty line. Rows that share a key but not the text are rows of their own; a row that is repeated whole counts
once, and its copies get equal results. Chunks without any word (blank lines) are left alone. A text of any length is
read whole. An empty table gives an empty result. Columns of any name pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import common

WIDTH, DIVISOR = 2, 3
#: Words of a run or a single line that make it worth removing.
WORDS = 10
_BREAK = np.array([b == 10 for b in range(256)])


def line_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, stop) of all lines, without their breaks; every text has one line at least."""
    breaks = np.flatnonzero(data == 10)
    n = len(offsets) - 1
    owner = np.searchsorted(offsets, breaks, "right") - 1
    text = np.concatenate([np.arange(n), owner])
    start = np.concatenate([offsets[:-1], breaks + 1])
    order = np.lexsort((start, text))
    text, start = text[order], start[order]
    stop = np.concatenate([start[1:] - 1, [len(data)]])
    last = np.ones(len(text), bool)
    last[:-1] = text[1:] != text[:-1]
    stop[last] = offsets[1:][text[last]]
    return text, start, stop


def chunks(data: np.ndarray, offsets: np.ndarray, width: int = WIDTH, divisor: int = DIVISOR) -> tuple[np.ndarray, ...]:
    """(text, place of the chunk in its text, start, stop, lines, hash, second hash) of all chunks."""
    text, start, stop = line_bounds(data, offsets)
    prefix = common.prefix_hash(data)
    hashes = common.span_hash(prefix, start, stop)
    place = np.arange(len(text)) - np.searchsorted(text, text)
    rolling = np.zeros(len(text), np.uint64)
    for k in range(width):
        own = np.zeros(len(text), np.uint64)
        own[k:] = hashes[: len(hashes) - k]
        rolling = common.mix(rolling * np.uint64(common.BASE) + np.where(place >= k, own, np.uint64(0)))
    ends = rolling % np.uint64(divisor) == 0
    ends[:-1] |= text[1:] != text[:-1]
    ends[-1:] = True
    close = np.flatnonzero(ends)
    first = np.concatenate([[0], close[:-1] + 1]) if len(close) else close
    owner, a, b = text[first], start[first], stop[close]
    second = 0xC2B2AE3D27D4EB4F
    other = common.span_hash(common.prefix_hash(data, second), a, b, second)
    return owner, np.arange(len(first)) - np.searchsorted(owner, owner), a, b, close - first + 1, common.span_hash(prefix, a, b), other


def _words(data: np.ndarray, offsets: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Words between white space of data[start:stop]."""
    starts, _, _ = common.words(data, offsets, common.NON_SPACE)
    return np.searchsorted(starts, stop) - np.searchsorted(starts, start)


def units(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """(text, place, start, stop, hash, second hash) of lines of WORDS words (at place 2 * line) and pairs of lines with a word (2 * line + 1)."""
    text, start, stop = line_bounds(data, offsets)
    line = np.arange(len(text)) - np.searchsorted(text, text)
    words = _words(data, offsets, start, stop)
    long = np.flatnonzero(words >= WORDS)
    pair = np.flatnonzero((text[1:] == text[:-1]) & (words[1:] + words[:-1] > 0))
    owner, place = np.concatenate([text[long], text[pair]]), np.concatenate([2 * line[long], 2 * line[pair] + 1])
    a, b = np.concatenate([start[long], start[pair]]), np.concatenate([stop[long], stop[pair + 1]])
    second = 0xC2B2AE3D27D4EB4F
    return owner, place, a, b, common.span_hash(common.prefix_hash(data), a, b), common.span_hash(common.prefix_hash(data, second), a, b, second)


def gone(data: np.ndarray, offsets: np.ndarray, text: np.ndarray, place: np.ndarray, width: int, divisor: int) -> np.ndarray:
    """Whether each line goes, where the units at these places (of units()) occurred earlier."""
    owner, start, stop = line_bounds(data, offsets)
    n = len(owner)
    words = _words(data, offsets, start, stop)
    firsts = np.searchsorted(owner, np.arange(len(offsets)))
    at = firsts[text] + place // 2
    out = np.zeros(n, bool)
    out[at[place % 2 == 0]] = True
    seen = np.zeros(n, bool)  # of a line and the next one
    seen[at[place % 2 == 1]] = True
    inner = np.zeros(n, bool)
    inner[:-1] = owner[1:] == owner[:-1]
    blank = inner.copy()
    blank[:-1] &= words[1:] + words[:-1] == 0
    # A pair of blank lines counts as the nearest other pairs on both its sides do.
    before = np.maximum.accumulate(np.where(blank, -1, np.arange(n)))
    after = np.minimum.accumulate(np.where(blank, n, np.arange(n))[::-1])[::-1]
    linked = np.where(blank, np.append(seen, False)[before] & np.append(seen, False)[after], seen)
    group = np.cumsum(np.concatenate([[True], ~linked[:-1]])[:n]) - 1
    _, _, _, _, lines, _, _ = chunks(data, offsets, width, divisor)
    first = np.cumsum(lines) - lines
    real = np.concatenate([[0], np.cumsum(seen)])  # a chunk's last line makes no pair inside it
    other = np.concatenate([[0], np.cumsum(seen | blank)])
    last = first + lines - 1
    whole = (real[last] > real[first]) & (other[last] - other[first] == lines - 1)
    inside = np.repeat(whole, lines)
    size = np.bincount(group)
    marked = np.bincount(group, words) >= WORDS
    marked[group[inside]] = True
    return out | inside | (marked & (size > 1))[group]


def _texts(docs: DataFrame, key: str, text: str) -> DataFrame:
    """doc_id, text, and the row's own pair of longs (at, of)."""
    at, of = common.row_key(F.col(key), F.col(text).cast("string"))
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), at.alias("at"), of.alias("of"))


def _counted(width: int, divisor: int, runs: bool):
    """What is counted of a block, (text, place, start, stop, hash, second hash): chunks of two lines or more, with some word, or units."""

    def own(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
        if runs:
            return units(data, offsets)
        text, place, a, b, lines, h1, h2 = chunks(data, offsets, width, divisor)
        some = np.concatenate([[0], np.cumsum(common.NON_SPACE[data])])
        good = np.flatnonzero((lines > 1) & (some[b] > some[a]))
        return tuple(x[good] for x in (text, place, a, b, h1, h2))

    return own


def _listed(texts: DataFrame, counted) -> DataFrame:
    """What is counted: at, of, place, h1, h2, n_bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in common.blocks(batches, "text"):
            data, offsets = common.utf8(block.column("text"))
            text, place, a, b, h1, h2 = counted(data, offsets)
            at, of = (block.column(c).take(pa.array(text)) for c in ("at", "of"))
            yield pa.RecordBatch.from_arrays([at, of, pa.array(place), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), pa.array(b - a)], names=["at", "of", "place", "h1", "h2", "n_bytes"])

    return texts.mapInArrow(run, "at long, of long, place long, h1 long, h2 long, n_bytes long")


def _taken(texts: DataFrame, counted) -> DataFrame:
    """The bytes of what is counted at `places` (array of struct place, first, h1) of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in common.blocks(batches, "text"):
            data, offsets = common.utf8(block.column("text"))
            text, place, a, b, h1, h2 = counted(data, offsets)
            at = {(t, p): i for i, (t, p) in enumerate(zip(text.tolist(), place.tolist()))}
            rows = []
            for t, (key, of, own) in enumerate(zip(*(block.column(c).to_pylist() for c in ("at", "of", "places")))):
                for r in own:
                    if (i := at.get((t, r["place"]))) is not None and int(h1.view(np.int64)[i]) == r["h1"]:
                        rows.append((key, of, r["place"], r["first"], r["h1"], int(h2.view(np.int64)[i]), data[a[i] : b[i]].tobytes()))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.binary()]
            columns = zip(*rows) if rows else [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["at", "of", "place", "first", "h1", "h2", "chunk"])

    return texts.mapInArrow(run, "at long, of long, place long, first boolean, h1 long, h2 long, chunk binary")


def repeated(docs: DataFrame, width: int = WIDTH, divisor: int = DIVISOR, key: str = "doc_id", text: str = "text", runs: bool = False) -> DataFrame:
    """at and of (a row's own pair of longs) and the places (array of struct place, h1) of its chunks, or units, that occurred earlier."""
    spark = docs.sparkSession
    common.arrow_limits(spark)
    texts = _texts(docs, key, text).where("text is not null").select("at", "of", "text")
    counted = _counted(width, divisor, runs)
    listed = common.stored(spark, _listed(texts, counted), "chunks")
    keys = ["h1", "h2", "n_bytes"]
    several = listed.groupBy(keys).agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("owner")).where("n > 1").drop("n")
    several = common.stored(spark, several, "several")
    occurring = listed.join(several, keys)
    # The first place under the smallest key: the rows of one key only.
    start = occurring.where("at = owner").groupBy(keys).agg(F.min(F.struct("of", "place")).alias("f"))
    start = common.stored(spark, several.join(start, keys).select(*keys, "owner", F.col("f.of").alias("owner_of"), F.col("f.place").alias("start")), "first")
    first = (F.col("at") == F.col("owner")) & (F.col("of") == F.col("owner_of")) & (F.col("place") == F.col("start"))
    marked = listed.join(start, keys).select("at", "of", "place", "h1", first.alias("first"))
    places = marked.groupBy("at", "of").agg(F.collect_set(F.struct("place", "first", "h1")).alias("places"))
    # Repeated chunks grow with the corpus: their places are never broadcast.
    taken = common.stored(spark, _taken(texts.join(places.hint("merge"), ["at", "of"]), counted), "taken")
    originals = taken.where("first").dropDuplicates(["h1", "h2", "at", "of", "place"]).select("h1", "h2", F.col("chunk").alias("original"))
    same = taken.where("not first").join(common.stored(spark, originals, "originals"), ["h1", "h2"]).where("chunk = original")
    return same.groupBy("at", "of").agg(F.collect_set(F.struct("place", "h1")).alias("places"))


def _remover(width: int, divisor: int, runs: bool):
    counted = _counted(width, divisor, runs)

    def dropped(data: np.ndarray, offsets: np.ndarray, known: list) -> tuple[np.ndarray, ...]:
        """(text, start, stop, lines, whether it goes) of the block's lines, or chunks."""
        own, place, _, _, h1, _ = counted(data, offsets)
        drop = {(t, r["place"], r["h1"]) for t, places in enumerate(known) for r in places or ()}
        hit = np.array([x in drop for x in zip(own.tolist(), place.tolist(), h1.view(np.int64).tolist())], bool)
        if runs:
            text, a, b = line_bounds(data, offsets)
            return text, a, b, np.ones(len(text), np.int64), gone(data, offsets, own[hit], place[hit], width, divisor)
        text, _, a, b, lines, _, _ = chunks(data, offsets, width, divisor)
        out = np.zeros(len(text), bool)
        out[np.searchsorted(text, own[hit]) + place[hit]] = True
        return text, a, b, lines, out

    def without(block: pa.RecordBatch) -> tuple[list, np.ndarray, np.ndarray]:
        """(texts, lines, lines removed) of a block with the columns text and places."""
        data, offsets = common.utf8(block.column("text"))
        texts = block.column("text").to_pylist()
        text, a, b, lines, out = dropped(data, offsets, block.column("places").to_pylist())
        raw = data.tobytes()
        n = len(texts)
        total, lost = np.bincount(text, lines, n), np.bincount(text, lines * out, n)
        bounds = np.searchsorted(text, np.arange(n + 1))
        for t in range(n):
            if texts[t] is None:
                total[t] = 0
            elif lost[t]:
                texts[t] = b"\n".join(raw[a[i] : b[i]] for i in range(bounds[t], bounds[t + 1]) if not out[i]).decode()
        return texts, total, lost

    return without


def digests(docs: DataFrame, width: int = WIDTH, divisor: int = DIVISOR, key: str = "doc_id", text: str = "text", runs: bool = False) -> DataFrame:
    """Per document: doc_id, n_lines, n_removed (lines) and kept_sha256 of the text that is left (null: of empty)."""
    import hashlib

    without = _remover(width, divisor, runs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in common.blocks(batches, "text"):
            texts, total, lost = without(block)
            sums = [hashlib.sha256((t or "").encode()).hexdigest() for t in texts]
            yield pa.RecordBatch.from_arrays([block.column("doc_id"), pa.array(total.astype(np.int64)), pa.array(lost.astype(np.int64)), pa.array(sums)], names=["doc_id", "n_lines", "n_removed", "kept_sha256"])

    places = repeated(docs, width, divisor, key, text, runs)
    return _texts(docs, key, text).join(places.hint("merge"), ["at", "of"], "left").mapInArrow(run, "doc_id long, n_lines long, n_removed long, kept_sha256 string")


def deduplicated(docs: DataFrame, width: int = WIDTH, divisor: int = DIVISOR, runs: bool = False) -> DataFrame:
    """docs with repeated chunks, or runs of lines, cut from text; all rows and other columns stay (a text may become empty)."""
    without = _remover(width, divisor, runs)
    column = [c.lower() for c in docs.columns].index("text")
    at, of, own = common.fresh(docs, "at", "of", "places")
    found = repeated(docs, width, divisor, runs=runs).select(F.col("at").alias(at), F.col("of").alias(of), F.col("places").alias(own))
    key, hashed = common.row_key(F.col("doc_id"), F.col("text").cast("string"))
    # The workers know columns by their place: the names of the table are its own.
    joined = docs.withColumns({at: key, of: hashed}).join(found.hint("merge"), [at, of], "left").select(*docs.columns, own)
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            named = pa.RecordBatch.from_arrays(batch.columns, names=[*(f"c{i}" if i != column else "text" for i in range(batch.num_columns - 1)), "places"])
            for block in common.blocks(iter([named]), "text"):
                texts, _, _ = without(block)
                columns = block.columns[:-1]
                columns[column] = pa.array(texts, pa.string())
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return joined.mapInArrow(run, schema)
