import hashlib
import re
from collections import Counter, defaultdict

import pytest

pytest.importorskip("public_tokenizers")

from corpus import empty, frame, rows
from weftgraph.llm import minhash, suffix


def brute_removed(window):
    own = [(d, (t or "").encode()) for d, t, *_ in rows()]
    counts = Counter(t[i : i + window] for _, t in own for i in range(len(t) - window + 1))
    out = {}
    for doc, t in own:
        gone = bytearray(len(t))
        for i in range(len(t) - window + 1):
            if counts[t[i : i + window]] > 1:
                gone[i : i + window] = b"\1" * window
        kept = bytes(b for b, g in zip(t, gone) if not g)
        out[doc] = (len(t), sum(gone), sum(gone[i] and not (i and gone[i - 1]) for i in range(len(t))), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize(("group", "stretch"), [(128, 1 << 20), (1, 1 << 20), (128, 450)])
def test_suffix_dedup(spark, monkeypatch, group, stretch):
    monkeypatch.setattr(suffix, "GROUP", group)
    monkeypatch.setattr(suffix, "STRETCH", stretch)
    got = {r.doc_id: tuple(r)[1:] for r in suffix.removed(frame(spark)).collect()}
    expected = brute_removed(200)
    assert got == expected and sum(v[1] > 0 for v in expected.values()) > 6


def test_suffix_dedup_of_nothing(spark):
    assert suffix.removed(empty(spark)).count() == 0


def brute_components(percent, size=5):
    sets = {}
    for doc, text, *_ in rows():
        own = re.findall(rb"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "").encode())
        sets[doc] = {tuple(own[i : i + size]) for i in range(len(own) - size + 1)} if len(own) >= size else {tuple(own)} if own else set()
    links = defaultdict(set)
    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= percent * len(sets[a] | sets[b]):
                links[a].add(b)
                links[b].add(a)
    out = {}
    for doc in sorted(sets):
        if doc not in out:
            todo = [doc]
            while todo:
                node = todo.pop()
                if node not in out:
                    out[node] = doc
                    todo += links[node]
    return {d: (len(sets[d]), c, c == d) for d, c in out.items()}


@pytest.mark.parametrize("percent", [85, 30])
def test_near_duplicates(spark, percent):
    got = {r.doc_id: tuple(r)[1:] for r in minhash.grouped(frame(spark), percent).collect()}
    expected = brute_components(percent)
    if percent == 85:  # at 30 the buckets are not made for every link, but no false one may appear
        assert got == expected and sum(not v[2] for v in expected.values()) >= 3
    assert all(expected[d][1] == expected[v[1]][1] for d, v in got.items())


def test_stage_keeps_one_of_each(spark):
    docs = frame(spark)
    kept = minhash.deduplicated(docs, 85)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {d for d, v in brute_components(85).items() if v[2]}
    assert minhash.grouped(empty(spark)).count() == 0


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, i) for i in range(101, 140)] + [(7, 7)]
    got = {r.node: r.component for r in minhash.components(spark, spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(31)} | {i: 100 for i in range(100, 140)}


def test_links_between_members_of_a_star(spark):
    """Copies of copies around the threshold: many are linked with each other, but not with their centre."""
    import random

    rnd = random.Random(11)
    vocabulary = ["".join(rnd.choices("abcdefghij", k=5)) for _ in range(3000)]
    base = rnd.choices(vocabulary, k=90)
    texts = [base]
    for _ in range(90):
        own = list(rnd.choice(texts))
        for _ in range(rnd.randint(1, 3)):
            at = rnd.randrange(len(own))
            own[at : at + rnd.randint(0, 1)] = rnd.choices(vocabulary, k=rnd.randint(0, 2))
        texts.append(own)
    sets = [{tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in texts]
    home = list(range(len(texts)))

    def find(a):
        while home[a] != a:
            a = home[a]
        return a

    for a in range(len(texts)):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                home[max(x, y)] = min(x, y)
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in minhash.grouped(docs, 85).collect()}
    assert got == {i: find(i) for i in range(len(texts))} and len(set(got.values())) > 1
