"""The measures, votes, estimates and scores of the quality classifier from their rules, document by document."""

import math
import re

import pytest

pytest.importorskip("public_tokenizers")

import numpy as np
import pyarrow as pa
from corpus import frame, rows, texts
from weftgraph.llm import common, quality


def brute_votes(text):
    raw = (text or "").encode()
    words = re.findall(rb"[^\x20\x09-\x0d]+", raw)
    low = [w.lower() for w in words]
    n = len(words)
    if n < 8:
        return (0,) * 7
    capitals = len(re.findall(rb"[A-Z]", raw))
    letters = capitals + len(re.findall(rb"[a-z\x80-\xff]", raw))
    shares = (
        len(re.findall(rb"[#$%&*!@^~=<>\\_+]", raw)) / (len(raw) + 20), capitals / (letters + 20),
        sum(a == b for a, b in zip(low, low[1:])) / (n + 8), raw.count(b"|") / (n + 8), len(set(low)) / n,
        sum(map(len, words)) / n, len(re.findall(rb"[0-9A-Za-z\x80-\xff.,;:'\"()?-]", raw)) / sum(map(len, words)),
    )
    limits = [(0.04, 0.01), (0.4, 0.15), (0.25, 0.05), (0.25, 0.02), (0.2, 0.4), (40, 20), (0.92, 0.96)]
    falling = (4, 6)
    return tuple(((s < bad) if i in falling else (s > bad)) * -1 + ((s > good) if i in falling else (s < good)) for i, (s, (bad, good)) in enumerate(zip(shares, limits)))


def test_votes_are_those_of_the_rules():
    own = texts()
    got = quality.votes(*quality.measures(*common.utf8(pa.array(own, pa.string()))))
    assert [tuple(v) for v in got.tolist()] == [brute_votes(t) for t in own]
    assert len({tuple(v) for v in got.tolist()}) > 4


def brute_em(votes, rounds):
    """One document at a time, the same model: prior of FALSE_ALARM with the weight of ANCHOR of the documents."""
    n, k = len(votes), len(votes[0])
    good = [quality.FIRST[min(sum(v == -1 for v in doc), 3)] for doc in votes]
    anchor = quality.ANCHOR * n + 1
    for _ in range(rounds):
        share = (sum(good) + 1) / (n + 2)
        hit, alarm = [], []
        for j in range(k):
            cast = [(g, d[j]) for g, d in zip(good, votes) if d[j]]
            hit.append((sum(1 - g for g, v in cast if v < 0) + 1) / (sum(1 - g for g, _ in cast) + 2))
            alarm.append((sum(g for g, v in cast if v < 0) + quality.FALSE_ALARM * anchor) / (sum(g for g, _ in cast) + anchor))
        new = []
        for doc in votes:
            a, b = share, 1 - share
            for j, v in enumerate(doc):
                if v:
                    a *= alarm[j] if v < 0 else 1 - alarm[j]
                    b *= hit[j] if v < 0 else 1 - hit[j]
            new.append(a / (a + b))
        good = new
    return hit, alarm, share, good


def test_estimates_are_those_of_brute_force():
    rnd = np.random.default_rng(5)
    truth = rnd.random(400) < 0.7
    votes = np.where(rnd.random((400, 7)) < np.where(truth[:, None], 0.05, 0.5), -1, 1) * (rnd.random((400, 7)) < 0.9)
    patterns, at, weights = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    accuracy, share, posterior = quality.expectation_maximisation(patterns, weights.astype(float), rounds=25)
    hit, alarm, own_share, good = brute_em(votes.tolist(), 25)
    assert np.allclose(accuracy[:, 0], hit) and np.allclose(accuracy[:, 1], 1 - np.array(alarm)) and math.isclose(share, own_share)
    assert np.allclose(posterior[at.ravel()], good)


@pytest.mark.parametrize("alarm", [0.0, 0.01, 0.02, 0.05, 0.1])
@pytest.mark.parametrize("share", [0.5, 0.8])
def test_accuracies_are_found_with_false_alarms(alarm, share):
    rnd = np.random.default_rng(1)
    truth = rnd.random(20000) < share
    sensitivity = np.array([0.5, 0.4, 0.3, 0.6, 0.5, 0.2])
    votes = np.where(rnd.random((20000, 6)) < np.where(truth[:, None], alarm, sensitivity), -1, 1)
    patterns, weights = np.unique(votes, axis=0, return_counts=True)
    accuracy, found, _ = quality.expectation_maximisation(patterns, weights.astype(float))
    assert abs(found - share) < 0.08 and np.abs(accuracy[:, 0] - sensitivity).max() < 0.07 and np.abs(1 - accuracy[:, 1] - alarm).max() < 0.04


def test_scores_are_those_of_the_rule(spark):
    weights, _ = quality.fitted(frame(spark))
    got = {r.doc_id: r.score for r in quality.scored(frame(spark), weights).collect()}
    for doc, text, *_ in rows():
        raw = (text or "").encode()
        low = bytes(b | 32 if 65 <= b <= 90 else b for b in raw) + b"\0\0"
        total = sum(weights[((low[i] << 16 | low[i + 1] << 8 | low[i + 2]) * 2654435761 % 2**32) >> 18] for i in range(len(raw)))
        counts, shares, *_ = quality.measures(*common.utf8(pa.array([text], pa.string())))
        z = total / (len(raw) + 100) * quality.SCALE + float((shares[0] * quality.DENSE_SCALE) @ weights[quality.BUCKETS : -1]) + weights[-1]
        assert math.isclose(got[doc], 1 / (1 + math.exp(-z)) if counts[0] else 1.0, rel_tol=1e-6, abs_tol=1e-9)


def test_sample_is_the_same_for_any_partitioning_and_copies(spark):
    own = [(i, f"text number {i} of some length", *rows()[0][2:]) for i in range(500)] + [(1000 + i, "the same text again", *rows()[0][2:]) for i in range(500)] + [(None, "another one", *rows()[0][2:])]
    some = quality.sampled(frame(spark, own).select("doc_id", "text"), 60)
    other = quality.sampled(frame(spark, own[::-1]).repartition(9).select("doc_id", "text"), 60)
    a, b = ([r.text for r in x.collect()] for x in (some, other))
    assert a == b and len(a) == len(set(a)) == 60
