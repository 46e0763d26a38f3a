"""Byte-level BPE encoding and decoding by merge replay.

All distinct words of a block of documents are laid out as one array of symbols. An inverted index leads from each token
pair to the positions where it stands; the merges are replayed in rank order (pairs that make the same token together),
and a merge touches only its two neighbours in the index. Words do not influence each other, so replaying block by block
gives the ids that one index over the whole corpus would give, in bounded memory and without a shuffle.

Nulls: a null text is an empty text with no ids. Empty text: no ids. Very long texts make a block of their own.
Repeated rows are encoded each; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import common

#: Distinct words whose ids a worker remembers before it starts afresh, and the longest such word in characters.
MEMORY_WORDS, MEMORY_LENGTH = 200_000, 64
#: A vocabulary file above this size is refused, as it is sent to every executor.
MAX_VOCABULARY_BYTES = 64 << 20


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and rank of each line of a .tiktoken file."""
    with open(path, "rb") as f:
        content = f.read(MAX_VOCABULARY_BYTES + 1)
    if len(content) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"vocabulary over {MAX_VOCABULARY_BYTES} bytes")
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in content.splitlines() if line)}


class MergeReplay:
    """Encodes sets of words by replaying merges over an inverted index of token pairs."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.bytes = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        self.width = np.int64(max(ranks.values()) + 1)
        pairs = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left * int(self.width) + right] = rank
        self.keys = np.array(sorted(pairs), np.int64)
        self.values = np.array([pairs[k] for k in self.keys.tolist()] + [-1], np.int64)

    def merged(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of the token that each pair of symbols makes, or -1."""
        wanted = left * self.width + right
        at = np.searchsorted(self.keys, wanted)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == wanted, self.values[at], -1) if len(self.keys) else np.full(len(wanted), -1)

    def encode(self, vocabulary: list[bytes]) -> list[np.ndarray]:
        """The ids of each word. A word that is a token as a whole is that token."""
        out: list[np.ndarray] = [np.zeros(0, "<u4")] * len(vocabulary)
        rest = []
        for w, word in enumerate(vocabulary):
            if (whole := self.ranks.get(word)) is not None:
                out[w] = np.array([whole], "<u4")
            elif word:
                rest.append(w)
        if not rest:
            return out
        sizes = np.array([len(vocabulary[w]) for w in rest])
        symbols = self.bytes[np.frombuffer(b"".join(vocabulary[w] for w in rest), np.uint8)]
        self._replay(symbols, sizes)
        alive = symbols >= 0
        ends = np.cumsum(np.add.reduceat(alive, np.cumsum(sizes) - sizes))
        ids = symbols[alive].astype("<u4")
        for w, start, stop in zip(rest, [0, *ends[:-1].tolist()], ends.tolist()):
            out[w] = ids[start:stop]
        return out

    def _replay(self, symbols: np.ndarray, sizes: np.ndarray) -> None:
        """Merge symbols in place: a merged pair's first position takes the new id, its second one -1."""
        n = len(symbols)
        owner = np.repeat(np.arange(len(sizes)), sizes)
        ends = np.cumsum(sizes)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        after[ends - 1] = -1
        before[ends - sizes] = -1
        pair = np.full(n, -1)  # rank of the merge of the pair that begins at each position
        open_ = np.flatnonzero(after >= 0)
        pair[open_] = self.merged(symbols[open_], symbols[open_ + 1])
        index: dict[int, list[np.ndarray]] = {}  # by token pair
        waiting: dict[int, set[int]] = {}  # the pairs of each rank
        heap: list[int] = []

        def enter(places: np.ndarray) -> None:
            places = places[pair[places] >= 0]
            if not len(places):
                return
            keys = symbols[places] * self.width + symbols[after[places]]
            if len(places) > 1:
                order = np.argsort(keys, kind="stable")
                places, keys = places[order], keys[order]
            cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(keys)]):
                key = int(keys[a])
                if key in index:
                    index[key].append(places[a:b])
                    continue
                index[key] = [places[a:b]]
                rank = int(pair[places[a]])
                if rank in waiting:
                    waiting[rank].add(key)
                else:
                    waiting[rank] = {key}
                    heappush(heap, rank)

        enter(open_)
        while heap:
            rank = heappop(heap)
            parts = [part for key in waiting.pop(rank) for part in index.pop(key)]
            left = parts[0] if len(parts) == 1 else np.unique(np.concatenate(parts))
            left = left[pair[left] == rank]
            if not len(left):
                continue
            right, places = after[left], left
            if len(left) > 1 and (chained := left[1:] == right[:-1]).any():
                # Overlapping occurrences: from the left, every second one.
                place = np.arange(len(left))
                begin = np.maximum.accumulate(np.where(np.concatenate([[True], ~chained]), place, 0))
                left = left[(place - begin) % 2 == 0]
                right = after[left]
            if len(left) > 1 and (again := owner[left[1:]] == owner[left[:-1]]).any():
                left = self._in_turn(rank, places, left, right, again, symbols, after, before, owner, enter)
                right = after[left]
            beyond = after[right]
            symbols[left], symbols[right], pair[right] = rank, -1, -1
            after[left] = beyond
            inner = beyond >= 0
            before[beyond[inner]] = left[inner]
            pair[left] = -1
            pair[left[inner]] = self.merged(symbols[left[inner]], symbols[beyond[inner]])
            ahead = before[left]
            ahead = ahead[ahead >= 0]
            pair[ahead] = self.merged(symbols[ahead], np.full(len(ahead), rank))
            enter(np.concatenate([left, ahead]))

    def _in_turn(self, rank, places, left, right, again, symbols, after, before, owner, enter) -> np.ndarray:
        """The occurrences to merge now. Where one merge in a word brings up a pair of an earlier rank, that pair goes
        first: only the word's first occurrence is merged, the others are entered again."""
        beyond, ahead = after[right], before[left]
        touching = np.concatenate([[False], left[1:] == beyond[:-1]])
        early = np.zeros(len(left), bool)
        inner = np.flatnonzero(beyond >= 0)
        new = self.merged(np.full(len(inner), rank), symbols[beyond[inner]])
        early[inner] |= (new >= 0) & (new < rank)
        inner = np.flatnonzero(ahead >= 0)
        new = self.merged(np.where(touching[inner], rank, symbols[ahead[inner]]), np.full(len(inner), rank))
        early[inner] |= (new >= 0) & (new < rank)
        if not early.any():
            return left
        words = owner[left[early]]
        wait = np.concatenate([[False], again]) & np.isin(owner[left], words)
        enter(places[np.isin(owner[places], words)])
        return left[~wait]


class Tokenizer:
    """Whole texts to ids and back; words met before are remembered in bounded memory."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.find = regex.compile(pattern).findall
        self.replay = MergeReplay(ranks)
        self.known: dict[str, bytes] = {}

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """For each text its ids as little-endian unsigned 32-bit integers."""
        found = [self.find(text) if text else [] for text in texts]
        known = self.known
        if len(known) > MEMORY_WORDS:
            known.clear()
        new: set[str] = set()
        for each in found:
            new.update(set(each).difference(known))
        vocabulary = sorted(new)
        for word, ids in zip(vocabulary, self.replay.encode([w.encode() for w in vocabulary])):
            known[word] = ids.tobytes()
        out = [b"".join(map(known.__getitem__, each)) for each in found]
        for word in vocabulary:
            if len(word) > MEMORY_LENGTH:
                del known[word]
        return out

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.replay.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def _workers(df: DataFrame, vocabulary: str, pattern: str, emit, schema: str) -> DataFrame:
    spark = df.sparkSession
    common.arrow_limits(spark)
    shared = spark.sparkContext.broadcast(load_ranks(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = Tokenizer(shared.value, pattern)
        for block in common.blocks(batches, "text"):
            yield emit(tokenizer, block)

    return df.mapInArrow(run, schema)


def digests(docs: DataFrame, vocabulary: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: key, n_tokens, ids_sha256 of the ids as 32-bit integers and decoded_sha256 of the decoded bytes."""

    def emit(tokenizer: Tokenizer, block: pa.RecordBatch) -> pa.RecordBatch:
        ids = tokenizer.encode(block.column("text").to_pylist())
        return pa.RecordBatch.from_pydict({
            "doc_id": block.column("doc_id"),
            "n_tokens": pa.array([len(x) // 4 for x in ids], pa.int64()),
            "ids_sha256": [hashlib.sha256(x).hexdigest() for x in ids],
            "decoded_sha256": [hashlib.sha256(tokenizer.decode(x)).hexdigest() for x in ids],
        })

    chosen = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return _workers(chosen, vocabulary, pattern, emit, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encoded(docs: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """Documents with token_ids array<int> and n_tokens beside their own columns (a column of that name is replaced).

    The decoded ids are compared with the text on the way; a difference raises.
    """
    docs = docs.drop("token_ids", "n_tokens")
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields]

    def emit(tokenizer: Tokenizer, block: pa.RecordBatch) -> pa.RecordBatch:
        texts = block.column("text").to_pylist()
        ids = tokenizer.encode(texts)
        for text, own in zip(texts, ids):
            if tokenizer.decode(own) != (text or "").encode():
                raise ValueError("decoding does not give the text back")
        offsets = np.cumsum([0, *(len(x) // 4 for x in ids)])
        values = pa.array(np.frombuffer(b"".join(ids), "<u4").astype(np.int32))
        lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)
        return pa.RecordBatch.from_arrays([*block.columns, lists, pa.array(np.diff(offsets), pa.int64())], names=[*block.schema.names, "token_ids", "n_tokens"])

    return _workers(docs, vocabulary, pattern, emit, ", ".join([*fields, "token_ids array<int>", "n_tokens long"]))


def decoded(tokens: DataFrame, vocabulary: str, ids: str = "token_ids") -> DataFrame:
    """tokens with a column decoded (binary): the bytes of the ids; null ids give null, an unknown id raises."""
    shared = tokens.sparkSession.sparkContext.broadcast(load_ranks(vocabulary))

    import pandas as pd

    def back(columns):
        table = {rank: token for token, rank in shared.value.items()}  # once for a task, not for a batch
        for column in columns:
            yield pd.Series([None if own is None else b"".join(map(table.__getitem__, own.tolist())) for own in column], dtype=object)

    back.__annotations__ = {"columns": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return tokens.withColumn("decoded", F.pandas_udf(back, "binary")(F.col(ids)))
