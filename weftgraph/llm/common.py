"""Shared plumbing of the corpus operators: bounded Arrow blocks, byte hashing and the shared work folder.

Conventions used by every operator of this subpackage:

* only the key and text columns are read from an input, so extra or clashing columns never matter;
* a null text counts as an empty text unless an operator says otherwise;
* a row with a null key is kept and keyed by null where the result is one row per input row.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..work import shared_dir, stored  # noqa: F401  (used through this module)

#: Text bytes that one numpy pass holds at a time; one longer text makes a block of its own.
BLOCK_BYTES = 1 << 21

#: Odd base of the polynomial hashes, with its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)

_powers: dict[int, np.ndarray] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores behind it until df has no column of that name."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def row_key(key: Column, text: Column) -> tuple[Column, Column]:
    """Two longs that tell rows apart by key and text: the key (null: the largest long), and a hash of the text and of whether the key is null."""
    return F.coalesce(key.cast("long"), F.lit((1 << 63) - 1)), F.xxhash64(text, key.isNull())


def arrow_limits(spark: SparkSession) -> None:
    """Keep the Arrow batches that reach Python small, whatever the length of the texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 * BLOCK_BYTES))


def blocks(batches: Iterator[pa.RecordBatch], column: str, limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches whose texts have about limit bytes at most, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes)
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + limit, "right")))
            yield batch.slice(start, stop - start)
            start = stop
    give_back()


def give_back() -> None:
    """Hand freed memory back to the system: idle workers stay beside those of the next stage."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all the texts of a column one after the other, and the len + 1 offsets; null counts as empty."""
    column = pc.fill_null(column.cast(pa.binary()), b"")
    wide = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[wide[0] : wide[-1]]
    return data, wide - wide[0]


def powers(base: int, n: int) -> np.ndarray:
    """base**0 ... base**(n - 1) modulo 2**64, kept between calls."""
    known = _powers.get(base)
    if known is None or len(known) < n:
        size = 1 << max(16, (n - 1).bit_length())
        known = np.full(size, base, np.uint64)
        known[0] = 1
        known = np.cumprod(known, dtype=np.uint64)
        if n <= 4 * BLOCK_BYTES:
            _powers[base] = known
    return known[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def prefix_hash(data: np.ndarray, base: int = BASE) -> np.ndarray:
    """P with P[j] - P[i] = base**i * hash(data[i:j]): n + 1 values modulo 2**64."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(base, len(data)), out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, stop: np.ndarray, base: int = BASE) -> np.ndarray:
    """Mixed hashes of data[start:stop], comparable across blocks."""
    inverse = INVERSE if base == BASE else pow(base, -1, 1 << 64)
    return mix((prefix[stop] - prefix[start]) * powers(inverse, len(prefix))[start])


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z, other bytes as they are."""
    return np.where((data >= 65) & (data <= 90), data | 32, data)


#: Bytes of words of digits, ASCII letters and everything beyond ASCII.
LETTERS = np.array([48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128 for b in range(256)])
#: Bytes of words between white space 0x20 and 0x09-0x0D.
NON_SPACE = np.array([not (b == 32 or 9 <= b <= 13) for b in range(256)])


def words(data: np.ndarray, offsets: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and stops of the maximal runs of member bytes that stay inside one text, and the first word of each text (len + 1)."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = member[data]
    step = np.diff(inside)
    starts, stops = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    cuts = offsets[1:-1]
    cuts = np.unique(cuts[(cuts > 0) & (cuts < len(data))])
    cuts = cuts[(inside[cuts] == 1) & (inside[cuts + 1] == 1)]  # a word that would run on into the next text
    if len(cuts):
        starts, stops = np.sort(np.concatenate([starts, cuts])), np.sort(np.concatenate([stops, cuts]))
    return starts, stops, np.searchsorted(starts, offsets)
