"""Quality classifier: a weak-label model over heuristic labellers, and a hashed linear scorer learned from its posteriors.

Seven labellers each vote good, bad or abstain on a document; any kind of bad text they look for is seen by two of them.
Votes of all documents are counted by pattern (3**7 patterns at most); expectation-maximisation over these counts
estimates each labeller's accuracies on good and on bad documents and the share of good ones. The posteriors of a
bounded sample of documents are the training labels of a logistic scorer on hashed byte trigrams and word shapes, which
then scores every document's whole text.

Nulls: a null text, or one without words, gets no vote and the score of an empty feature vector, and is kept: it gives
no evidence against itself. Repeated rows get equal scores and count once in the sample. A row with a null key is scored
like any other. Texts of any length are scored whole. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import common

#: Different texts that the scorer learns from at most (those whose hash comes first), and the longest one among them.
TRAIN_ROWS, TRAIN_CHARS = 3000, 20_000
#: Hashed features, and features that stand for the whole text (shares of symbols, capitals, repeated words, bars).
BUCKETS, DENSE = 1 << 14, 5
#: Rate of bad votes on good documents expected of a labeller, and the share of all documents that this counts for
#: beside those seen. It tells the two classes apart; the estimate follows the votes.
FALSE_ALARM, ANCHOR = 0.01, 0.02
#: Posterior of good that a document of no, one, two or more bad votes starts with.
FIRST = np.array([0.95, 0.6, 0.1, 0.02])
LABELLERS = ("symbols", "capitals", "repeats", "bars", "variety", "long words", "letters")

#: Bytes of letters, digits and the marks of prose.
_PROSE = np.array([48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128 or b in b".,;:'\"()-?" for b in range(256)])
_KIND = np.array([3 if 48 <= b <= 57 else 1 if 97 <= b <= 122 or b >= 128 else 2 if 65 <= b <= 90 else 4 if b in b"#$%&*!@^~=<>\\_+" else 5 if b == 124 else 0 for b in range(256)])


def measures(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(words of each text, shares (n, DENSE), distinct share of words, mean word length in bytes, share of prose bytes) of the texts."""
    n = len(offsets) - 1
    sizes = np.maximum(np.diff(offsets), 1)
    kinds = _KIND[data]
    owner = np.repeat(np.arange(n), np.diff(offsets))
    per = np.bincount(owner * 6 + kinds, minlength=6 * n).reshape(n, 6).astype(float)
    letters = per[:, 1] + per[:, 2]
    starts, stops, firsts = common.words(data, offsets, common.NON_SPACE)
    counts = np.diff(firsts)
    hashes = common.span_hash(common.prefix_hash(common.lowered(data)), starts, stops)
    text = np.repeat(np.arange(n), counts)
    again = np.bincount(text[1:][(hashes[1:] == hashes[:-1]) & (text[1:] == text[:-1])], minlength=n)
    order = np.lexsort((hashes, text))
    fresh = np.ones(len(text), bool)
    fresh[1:] = (text[order][1:] != text[order][:-1]) | (hashes[order][1:] != hashes[order][:-1])
    distinct = np.bincount(text[order][fresh], minlength=n)
    total = np.maximum(counts, 1)
    # A few bytes or words more in each denominator: a short text's shares say little.
    shares = np.stack([per[:, 4] / (sizes + 20), per[:, 2] / (letters + 20), again / (counts + 8), per[:, 5] / (counts + 8), counts > 0], 1)
    mean = np.bincount(text, stops - starts, n) / total
    prose = np.bincount(owner[_PROSE[data]], minlength=n) / np.maximum(np.bincount(text, stops - starts, n), 1)
    return counts, shares, distinct / total, mean, prose


def votes(counts: np.ndarray, shares: np.ndarray, variety: np.ndarray, mean: np.ndarray, prose: np.ndarray) -> np.ndarray:
    """(n, 7) votes: 1 good, -1 bad, 0 abstain. Short texts give little evidence: most labellers abstain on them."""
    enough = counts >= 8

    def vote(bad, good):
        return np.where(enough & bad, -1, np.where(enough & good, 1, 0))

    symbols, capitals, repeats, bars = shares[:, 0], shares[:, 1], shares[:, 2], shares[:, 3]
    return np.stack([
        vote(symbols > 0.04, symbols < 0.01),
        vote(capitals > 0.4, capitals < 0.15),
        vote(repeats > 0.25, repeats < 0.05),
        vote(bars > 0.25, bars < 0.02),
        vote(variety < 0.2, variety > 0.4),
        vote(mean > 40, mean < 20),
        vote(prose < 0.92, prose > 0.96),
    ], 1)


def expectation_maximisation(patterns: np.ndarray, weights: np.ndarray, rounds: int = 2000) -> tuple[np.ndarray, float, np.ndarray]:
    """(accuracies (labeller, [on bad, on good]), share of good documents, posterior of good for each pattern).

    A vote is right with the labeller's accuracy on the document's class; votes are independent given the class and an
    abstention says nothing. Both accuracies are estimated; that on good documents with a prior of FALSE_ALARM bad votes,
    which weighs as much as ANCHOR of the documents at every size.
    """
    k = patterns.shape[1] if len(patterns) else len(LABELLERS)
    if not len(patterns):
        return np.full((k, 2), 0.5), 0.5, np.zeros(0)
    bad, good = patterns == -1, patterns == 1
    posterior = FIRST[np.minimum(bad.sum(1), len(FIRST) - 1)]
    total = weights.sum()
    share, hit, alarm = 0.9, np.full(k, 0.5), np.full(k, FALSE_ALARM)
    for _ in range(rounds):
        p, q = weights * (1 - posterior), weights * posterior
        share = float((q.sum() + 1) / (total + 2))
        hit = (p @ bad + 1) / (p @ (bad | good) + 2)
        alarm = (q @ bad + FALSE_ALARM * (ANCHOR * total + 1)) / (q @ (bad | good) + ANCHOR * total + 1)
        logs = np.log((1 - share) / share) + bad @ np.log(hit / alarm) + good @ np.log((1 - hit) / (1 - alarm))
        new = 1 / (1 + np.exp(np.clip(logs, -50, 50)))
        settled = np.abs(new - posterior).max() < 1e-9
        posterior = new
        if settled:
            break
    return np.stack([hit, 1 - alarm], 1), share, posterior


def _hashed(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Bucket of the byte trigram that starts at each byte (zeros follow a text), letters lower-cased."""
    low = np.concatenate([common.lowered(data), np.zeros(2, np.uint8)]).astype(np.uint32)
    second, third = low[1:-1].copy(), low[2:].copy()
    sizes, ends = np.diff(offsets), offsets[1:]
    second[ends[sizes > 0] - 1] = third[ends[sizes > 0] - 1] = third[ends[sizes > 1] - 2] = 0
    code = low[:-2] << 16 | second << 8 | third
    return ((code * np.uint32(2654435761)) >> np.uint32(32 - 14)).astype(np.int64)


def linear_scores(data: np.ndarray, offsets: np.ndarray, shares: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Probability of good for each text: mean weight of its trigrams, and its shares."""
    own = np.concatenate([np.zeros(1), np.cumsum(weights[:BUCKETS][_hashed(data, offsets)])])
    sizes = np.diff(offsets) + 100
    z = (own[offsets[1:]] - own[offsets[:-1]]) / sizes * SCALE + (shares * DENSE_SCALE) @ weights[BUCKETS:-1] + weights[-1]
    return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


#: Brings the mean of the trigram weights and the shares to the size of the other terms.
SCALE, DENSE_SCALE = 10.0, np.array([20.0, 5.0, 5.0, 5.0, 1.0])


def learn(data: np.ndarray, offsets: np.ndarray, shares: np.ndarray, target: np.ndarray, rounds: int = 300) -> np.ndarray:
    """Weights of a ridge-penalised logistic scorer, by full-batch Adam; classes count alike."""
    n = len(target)
    if not n:
        out = np.zeros(BUCKETS + DENSE + 1)
        out[-1] = 5.0
        return out
    rows, columns, values = [], [], []
    for a in range(0, n, 100):  # some texts at a time: the trigrams of all would take many times their size
        own = offsets[a : a + 101]
        slot = np.repeat(np.arange(len(own) - 1), np.diff(own)) * BUCKETS + _hashed(data[own[0] : own[-1]], own - own[0])
        cells, count = np.unique(slot, return_counts=True)
        rows.append(a + cells // BUCKETS)
        columns.append(cells % BUCKETS)
        values.append(count / (np.diff(own) + 100)[cells // BUCKETS] * SCALE)
    row, column, value = (np.concatenate(x) for x in (rows, columns, values))
    dense = shares * DENSE_SCALE
    good, bad = max(target.sum(), 1.0), max((1 - target).sum(), 1.0)
    cost = (target / good + (1 - target) / bad) / 2
    w = np.zeros(BUCKETS + DENSE + 1)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, rounds + 1):
        z = np.bincount(row, value * w[column], minlength=n) + dense @ w[BUCKETS:-1] + w[-1]
        error = (1 / (1 + np.exp(-np.clip(z, -50, 50))) - target) * cost
        gradient = np.concatenate([np.bincount(column, value * error[row], minlength=BUCKETS), dense.T @ error, [error.sum()]]) + 1e-5 * w
        m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient**2
        w -= 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
    return w


def _texts(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))


def sampled(chosen: DataFrame, rows: int) -> DataFrame:
    """The `rows` different texts of 1 to TRAIN_CHARS code points whose hash comes first.

    The hash below which they lie is found from the number of different hashes; texts beyond it are not moved.
    """
    usable = chosen.where(F.length("text").between(1, TRAIN_CHARS)).select("text", F.xxhash64("text").alias("h"))
    different = usable.agg(F.approx_count_distinct("h", 0.05)).first()[0]
    wanted = 1.3 * rows + 10 * rows**0.5 + 100  # the estimate is within 0.05 as a standard deviation, the sample within a root
    below = -(1 << 63) + int(min(1.0, wanted / max(1, different)) * ((1 << 64) - 1))
    return usable.where(F.col("h") <= F.lit(min(below, (1 << 63) - 1))).groupBy("h").agg(F.min("text").alias("text")).orderBy("h").limit(rows).select("text")


def fitted(docs: DataFrame, rows: int = TRAIN_ROWS, key: str = "doc_id", text: str = "text") -> tuple[np.ndarray, dict]:
    """(weights of the scorer, report): votes are counted over all documents, the scorer learns from `rows` of them."""
    spark = docs.sparkSession
    common.arrow_limits(spark)
    chosen = _texts(docs, key, text)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[bytes, int] = {}
        for block in common.blocks(batches, "text"):
            own, number = np.unique(votes(*measures(*common.utf8(block.column("text")))).astype(np.int8), axis=0, return_counts=True)
            for p, c in zip(own, number.tolist()):
                totals[p.tobytes()] = totals.get(p.tobytes(), 0) + c
        yield pa.RecordBatch.from_pydict({"pattern": pa.array(list(totals), pa.binary()), "n": pa.array(list(totals.values()), pa.int64())})

    counted = chosen.mapInArrow(count, "pattern binary, n long").groupBy("pattern").agg(F.sum("n").alias("n")).collect()
    patterns = np.array([np.frombuffer(r[0], np.int8) for r in counted], np.int64).reshape(-1, len(LABELLERS))
    accuracy, share, posterior = expectation_maximisation(patterns, np.array([r[1] for r in counted], float))
    known = {p.astype(np.int8).tobytes(): q for p, q in zip(patterns, posterior)}
    learned = sampled(chosen, rows).toArrow().combine_chunks()
    column = learned.column("text").combine_chunks() if learned.num_rows else pa.array([], pa.string())
    column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    data, offsets = common.utf8(column)
    shares, own = np.zeros((0, DENSE)), np.zeros((0, len(LABELLERS)), np.int8)
    for block in common.blocks(iter([pa.RecordBatch.from_arrays([column], names=["text"])]), "text", common.BLOCK_BYTES // 2):
        measured = measures(*common.utf8(block.column("text")))
        shares, own = np.concatenate([shares, measured[1]]), np.concatenate([own, votes(*measured).astype(np.int8)])
    # A text on which no labeller votes teaches nothing: it counts as good, like the documents that the filter keeps.
    target = np.array([known.get(p.tobytes(), 1.0) if p.any() else 1.0 for p in own])
    report = {"share_good": share, "accuracies": dict(zip(LABELLERS, accuracy.tolist()))}
    weights = learn(data, offsets, shares, target)
    common.give_back()
    return weights, report


def _score(batch: pa.RecordBatch, weights: np.ndarray) -> np.ndarray:
    data, offsets = common.utf8(batch.column("text"))
    counts, shares, _, _, _ = measures(data, offsets)
    return np.where(counts > 0, linear_scores(data, offsets, shares, weights), 1.0)


def scored(docs: DataFrame, weights: np.ndarray, key: str = "doc_id", text: str = "text", threshold: float = 0.5) -> DataFrame:
    """Per document: doc_id, score (0 to 1) and kept (score >= threshold)."""
    common.arrow_limits(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in common.blocks(batches, "text"):
            scores = _score(block, weights)
            yield pa.RecordBatch.from_arrays([block.column("doc_id"), pa.array(scores), pa.array(scores >= threshold)], names=["doc_id", "score", "kept"])

    return _texts(docs, key, text).mapInArrow(run, "doc_id long, score double, kept boolean")


def filtered(docs: DataFrame, weights: np.ndarray, threshold: float = 0.5) -> DataFrame:
    """docs without those that score below the threshold; all columns stay."""
    common.arrow_limits(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in common.blocks(batches, "text"):
            yield block.filter(pa.array(_score(block, weights) >= threshold))

    return docs.mapInArrow(run, docs.schema)
