"""Language identification by cross-parsing entropy.

A suffix automaton of labelled text is built for each language. A text is cut greedily into phrases, each the longest
string from its place on that the automaton knows; the fewer phrases a text needs for its length, the closer it is to
the language. The language with the fewest normalised phrases wins.

Texts are read as code points: letters by their single-code-point lower case, every run of other characters as one
space. The parse starts anew every SEGMENT symbols, so all texts of a block advance together in one numpy pass. Moves of
an automaton are kept sparsely, so its size follows the text learned from, not the alphabet.

Learned from are whole rows, never parts of them: for each language up to TRAIN_ROWS different texts and TRAIN_CHARS code
points, those of 200 to 8,000 code points first, then shorter and then longer ones.

Nulls: a null text, or one without letters, gets `und` and score 0. Rows with a null language are never learned from.
Repeated rows are learned from once and get equal results. A row with a null key is judged like any other. Ties go to
the language that sorts first. If nothing was learned every text is `und`, and an empty table gives an empty result. A
text of any length is judged whole; a block of texts is held at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from . import common

#: Different labelled texts learned from for each language at most (those whose hash comes first), and their code points
#: together: a text that would go beyond them is passed over, unless it is the first one.
TRAIN_ROWS, TRAIN_CHARS = 64, 48_000
SEGMENT = 512

_tables: dict[str, np.ndarray] = {}


def lower_table() -> np.ndarray:
    """For each code point its lower-case letter (itself where that is not one code point), 0 for what is no letter."""
    if "lower" not in _tables:
        out = np.zeros(0x110000, np.int32)
        for c in range(0x110000):
            ch = chr(c)
            if ch.isalpha():
                low = ch.lower()
                out[c] = ord(low) if len(low) == 1 else c
        _tables["lower"] = out
    return _tables["lower"]


def normalised(points: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(letters with 0 for a run of others, text of each symbol, letters of each text) of the code points of texts that end at ends."""
    symbols = lower_table()[points]
    owner = np.repeat(np.arange(len(ends)), np.diff(np.concatenate([[0], ends])))
    keep = symbols > 0
    keep[1:] |= (symbols[:-1] > 0) & (owner[1:] == owner[:-1])
    letters = np.bincount(owner[symbols > 0], minlength=len(ends))
    return symbols[keep], owner[keep], letters


class SuffixAutomaton:
    """All substrings of a sequence of small integers, as states with one transition for each next symbol."""

    def __init__(self, sequence: list[int]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        last = 0
        for symbol in sequence:
            last = self._add(last, symbol)

    def _add(self, last: int, symbol: int) -> int:
        new = len(self.next)
        self.next.append({})
        self.length.append(self.length[last] + 1)
        self.link.append(0)
        p = last
        while p >= 0 and symbol not in self.next[p]:
            self.next[p][symbol] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][symbol]
            if self.length[p] + 1 == self.length[q]:
                self.link[new] = q
            else:
                copy = len(self.next)
                self.next.append(dict(self.next[q]))
                self.length.append(self.length[p] + 1)
                self.link.append(self.link[q])
                while p >= 0 and self.next[p].get(symbol) == q:
                    self.next[p][symbol] = copy
                    p = self.link[p]
                self.link[q] = self.link[new] = copy
        return new

    def packed(self, n_symbols: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(base of each state, owner and target of each cell): the move of a state by a symbol stands in cell base + symbol
        if the state owns that cell. States with many moves are laid out first, each at the first place of a fixed
        pseudo-random sequence where it fits; four times as many cells as moves keep the search short."""
        room = 4 * sum(map(len, self.next)) + n_symbols
        owner, target, base = [-1] * (room + n_symbols), [0] * (room + n_symbols), [0] * len(self.next)
        turn, place = 0, 0
        for state in sorted(range(len(self.next)), key=lambda state: (-len(self.next[state]), state)):
            moves = self.next[state]
            if not moves:
                break
            tries = 0
            while any(owner[place + symbol] >= 0 for symbol in moves):
                turn += 1
                h = turn * common.BASE & (1 << 64) - 1
                place = (h ^ h >> 29) * common.BASE % (1 << 64) % room
                if (tries := tries + 1) % 10_000 == 0:
                    owner += [-1] * room
                    target += [0] * room
                    room *= 2
            base[state] = place
            for symbol, to in moves.items():
                owner[place + symbol], target[place + symbol] = state, to
        return np.array(base, np.int32), np.array(owner, np.int32), np.array(target, np.int32)


class Model:
    """The automata of all languages over one alphabet; symbol 0 is the space, the last one any unlearned letter."""

    def __init__(self, texts: dict[str, list[str]]):
        self.languages = sorted(texts)
        learned = []
        for language in self.languages:
            joined = "\n".join(texts[language])
            points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
            learned.append(normalised(points, np.array([len(points)]))[0])
        alphabet = np.unique(np.concatenate([np.zeros(1, np.int32), *learned]))
        self.unknown = len(alphabet)
        self.symbol = np.full(0x110000, self.unknown, np.int32)
        self.symbol[alphabet] = np.arange(len(alphabet))
        self.tables = [SuffixAutomaton(self.symbol[own].tolist()).packed(self.unknown + 1) for own in learned]

    def phrases(self, lanes: np.ndarray, lengths: np.ndarray, table: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
        """Phrases that each lane (a row of symbols, the longest first) needs."""
        base, owner, target = table
        # From the start the moves are looked up most often: they get a table of their own.
        begin = np.where(owner[base[0] : base[0] + self.unknown + 1] == 0, target[base[0] : base[0] + self.unknown + 1], 0)
        state = np.zeros(len(lanes), np.int64)
        count = np.zeros(len(lanes), np.int64)
        ends = np.searchsorted(-lengths, -np.arange(lanes.shape[1]), "left")  # lanes longer than the step
        columns = np.ascontiguousarray(lanes.T)
        for step in range(lanes.shape[1]):
            n = ends[step]
            if not n:
                break
            symbols = columns[step, :n]
            old = state[:n]
            cell = base[old] + symbols
            new = np.where(owner[cell] == old, target[cell], 0)
            broken = np.flatnonzero(new == 0)  # the phrase ends before this symbol, which begins the next one
            fresh = broken[old[broken] > 0]
            new[broken] = begin[symbols[broken]]
            count[:n][fresh] += 1
            lost = broken[new[broken] == 0]  # a symbol that the language does not know is a phrase of its own
            count[lost] += 1
            state[:n] = new
        count += state > 0
        return count

    def predict(self, texts: pa.Array) -> tuple[list[str], list[float]]:
        strings = ["" if t is None else t for t in texts.to_pylist()]
        points = np.frombuffer("".join(strings).encode("utf-32-le"), np.uint32)
        ends = np.cumsum([len(t) for t in strings], dtype=np.int64)
        symbols, owner, letters = normalised(points, ends)
        n = len(strings)
        if not self.languages or not len(symbols):
            return ["und"] * n, [0.0] * n
        symbols = self.symbol[symbols]
        starts = np.searchsorted(owner, np.arange(n))
        offset = np.arange(len(symbols)) - starts[owner]
        first = np.flatnonzero(offset % SEGMENT == 0)
        sizes = np.diff(np.concatenate([first, [len(symbols)]]))
        order = np.argsort(-sizes, kind="stable")
        lane_of = np.empty(len(first), np.int64)
        lane_of[order] = np.arange(len(first))
        lanes = np.zeros((len(first), int(sizes.max())), np.int32)
        lanes[np.repeat(lane_of, sizes), offset % SEGMENT] = symbols
        lengths = sizes[order]
        totals = np.bincount(owner, minlength=n)
        rates = np.empty((len(self.languages), n))
        for k, table in enumerate(self.tables):
            counts = self.phrases(lanes, lengths, table)
            per_text = np.bincount(owner[first[order]], weights=counts, minlength=n)
            rates[k] = per_text / np.maximum(totals, 1)
        best = rates.argmin(0)
        lowest = rates.min(0)
        rest = np.sort(rates, 0)[1] if len(self.languages) > 1 else np.ones(n)
        scores = np.where(rest > 0, (rest - lowest) / np.maximum(rest, 1e-12), 0.0)
        good = letters > 0
        return [self.languages[b] if g else "und" for b, g in zip(best, good)], np.where(good, np.clip(scores, 0, 1), 0.0).tolist()


def sample(labelled: DataFrame, rows: int = TRAIN_ROWS, chars: int = TRAIN_CHARS) -> dict[str, list[str]]:
    """The texts learned from for each language, by the columns lang and text.

    Only hashes and lengths are ranked; each task's part of the ranking is cut before the shuffle (window group limit), so
    a language that most rows share does not gather in one task. Then the chosen texts alone are fetched.
    """
    usable = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text", F.xxhash64("text").alias("h"))
    size = F.length("text")
    different = usable.groupBy("lang", "h").agg(F.min(F.when(size.between(200, 8000), 0).when(size < 200, 1).otherwise(size)).alias("order"), F.min(size).alias("size"))
    place = F.row_number().over(W.partitionBy("lang").orderBy("order", "h"))
    ranked = different.withColumn("place", place).where(F.col("place") <= rows).collect()
    wanted = []
    for lang in sorted({r["lang"] for r in ranked}):
        held = 0
        for r in sorted((r for r in ranked if r["lang"] == lang), key=lambda r: r["place"]):
            if not held or held + r["size"] <= chars:
                held += r["size"]
                wanted.append((lang, r["h"]))
    if not wanted:
        return {}
    # At most `rows` hashes a language.
    chosen = labelled.sparkSession.createDataFrame(wanted, "lang string, h long")
    texts = usable.join(F.broadcast(chosen), ["lang", "h"]).groupBy("lang", "h").agg(F.min("text").alias("text"))
    out: dict[str, list[str]] = {}
    for lang, _, text in sorted(texts.collect()):
        out.setdefault(lang, []).append(text)
    return out


def fitted(labelled: DataFrame, rows: int = TRAIN_ROWS, chars: int = TRAIN_CHARS) -> Model:
    """A model of the columns lang and text."""
    return Model(sample(labelled, rows, chars))


def identified(docs: DataFrame, model: Model, *extra: Column, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: doc_id, lang_pred, score, and the extra columns, which only pass through."""
    spark = docs.sparkSession
    common.arrow_limits(spark)
    shared = spark.sparkContext.broadcast(model)
    chosen = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), *extra)
    passed = [f for f in chosen.schema.fields if f.name not in ("text",)]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in passed), "lang_pred string", "score double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in common.blocks(batches, "text"):
            languages, scores = shared.value.predict(block.column("text"))
            kept = [block.column(f.name) for f in passed]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(languages, pa.string()), pa.array(scores, pa.float64())], names=[*(f.name for f in passed), "lang_pred", "score"])

    return chosen.mapInArrow(run, schema)


def held_out(key: str = "doc_id") -> Column:
    """Whether crc32 of the id as text leaves 2 modulo 4; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 4 == 2, F.lit(False))
