"""Longest verbatim matches and their places, by brute force over all pairs of places; the same for any blocks."""

import random
import re

import pytest

pytest.importorskip("public_tokenizers")

from corpus import frame, rows, texts
from weftgraph.llm import common, decontam

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(text, items):
    """(words, place in the text, number of the item, place in it): the longest, then the first in the text, then in the benchmark."""
    own, best = words(text), (0, 0, 0, 0)
    for n, (_, item) in enumerate(items):
        other = words(item)
        for i in range(len(own)):
            for j in range(len(other)):
                k = 0
                while i + k < len(own) and j + k < len(other) and own[i + k] == other[j + k]:
                    k += 1
                best = max(best, (k, -i, -n, -j))
    return best[0], -best[1], -best[2], -best[3]


@pytest.mark.parametrize("cut", ["whole", "passes", "shards"])
def test_longest_matches(spark, monkeypatch, cut):
    rnd = random.Random(9)
    few = [" ".join(rnd.choices("abcde", k=rnd.randint(0, 25))) for _ in range(40)]
    own = texts()
    twelve = " ".join(own[16].split()[3:15])
    some = [(i, t) for i, t in enumerate(few)] + [(None, few[3]), (4, few[9]), (50, twelve), (51, "x " + twelve), (52, twelve.upper()), (53, own[16]), (None, None), (54, "")]
    items = [(1, " ".join(rnd.choices("abcdef", k=14))), (2, None), (3, "e d c b a e d c"), (None, " ".join(rnd.choices("abc", k=9))), (5, ""), (6, twelve), (6, twelve)]
    if cut == "passes":
        monkeypatch.setattr(decontam, "PASS_BYTES", 20)
    if cut == "shards":
        monkeypatch.setattr(common.blocks, "__defaults__", (60,))
    docs = frame(spark, [(d, t, *rows()[0][2:]) for d, t in some])
    benchmark = spark.createDataFrame(items, "item_id long, text string").coalesce(1)
    expected = [(d, *brute(t, items)) for d, t in some]
    got = sorted(((r.doc_id, r.longest_match) for r in decontam.hits(docs, benchmark).collect()), key=str)
    assert got == sorted(((d, k) for d, k, *_ in expected), key=str) and sum(k == 12 for _, k in got) >= 4
    found = sorted((tuple(r) for r in decontam.matches(docs, benchmark, least=3).collect()), key=str)
    assert found == sorted(((d, None if items[n][0] is None else str(items[n][0]), j, i, k) for d, k, i, n, j in expected if k >= 3), key=str)
