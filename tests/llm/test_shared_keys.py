"""Null keys, and one key with several texts: every row is judged by its own text."""

import hashlib
from collections import Counter

import pytest

pytest.importorskip("public_tokenizers")

from corpus import frame, rows, texts
from weftgraph.llm import lines, minhash, suffix


def shared_rows():
    own = texts()
    extra = [(None, own[16]), (None, own[7]), (None, own[7]), (16, own[7] + " more"), (16, own[16]), (17, own[8]), (3, own[20] + "\n" + own[21]), (None, None), (None, "a text of its own " * 20)]
    return rows() + [(d, t, *rows()[0][2:]) for d, t in extra]


def test_suffix_dedup_by_row(spark, monkeypatch):
    some = shared_rows()
    own = [(d, (t or "").encode()) for d, t, *_ in some]
    counts = Counter(t[i : i + 200] for _, t in own for i in range(len(t) - 199))
    expected = []
    for doc, t in own:
        gone = bytearray(len(t))
        for i in range(len(t) - 199):
            if counts[t[i : i + 200]] > 1:
                gone[i : i + 200] = b"\1" * 200
        kept = bytes(b for b, g in zip(t, gone) if not g)
        expected.append((doc, len(t), sum(gone), sum(gone[i] and not (i and gone[i - 1]) for i in range(len(t))), hashlib.sha256(kept).hexdigest()))
    for group in (4096, 1, 0):
        monkeypatch.setattr(suffix, "GROUP", group)
        got = [tuple(r) for r in suffix.removed(frame(spark, some)).collect()]
        assert sorted(got, key=str) == sorted(expected, key=str)
    kept = {r.kept_sha256: r.kept for r in suffix.removed(frame(spark, some), with_kept=True).collect() if r.kept is not None}
    assert kept and all(hashlib.sha256(bytes(k)).hexdigest() == h for h, k in kept.items())


def test_lines_by_row(spark):
    line = "one two three four five six seven eight nine ten"
    other = "ten nine eight seven six five four three two one"
    some = [(1, line), (1, "x\n" + other + "\n" + line), (None, line + "\ny"), (None, other), (None, None), (2, line), (2, line), (3, "nothing here is repeated")]
    for order in (some, some[::-1]):
        docs = frame(spark, [(d, t, *rows()[0][2:]) for d, t in order])
        got = sorted(((r.doc_id, r.text) for r in lines.deduplicated(docs, runs=True).collect()), key=str)
        by_key = {d: [t for k, t in got if k == d] for d, _ in got}
        # Of the two rows of key 1 that hold the line, the one whose text's hash is smaller keeps it.
        assert by_key[2] == ["", ""] and by_key[3] == ["nothing here is repeated"]
        assert sorted(by_key[1]) in (sorted([line, "x\n" + other]), sorted(["", "x\n" + other + "\n" + line]))
        assert sorted(by_key[None], key=str) == sorted(["y", "", None], key=str)
    clashing = docs.withColumns({"own_places": docs.doc_id, "at": docs.doc_id, "OF": docs.doc_id, "places_": docs.doc_id})
    out = lines.deduplicated(clashing, runs=True)
    assert out.schema == clashing.schema and out.count() == len(some)
    assert {(r.doc_id, r.places, r["at"]) for r in out.collect()} == {(d, "clash", d) for d, _ in some}


def test_near_duplicates_by_row(spark):
    near = lambda t: t.replace(" ", " changed ", 1)
    own = texts()
    some = [(5, own[7]), (5, own[8] + own[20]), (3, near(own[7])), (None, near(own[8] + own[20])), (None, own[16]), (None, own[16]), (9, own[16]), (None, own[21]), (None, own[21]), (7, None), (None, ""), (8, "one"), (8, "one"), (4, own[22])]
    expected = [(5, 3), (5, 5), (3, 3), (None, 5), (None, 9), (None, 9), (9, 9), (None, None), (None, None), (7, 7), (None, None), (8, 8), (8, 8), (4, 4)]
    for order in (some, some[::-1]):
        docs = frame(spark, [(d, t, *rows()[0][2:]) for d, t in order])
        got = sorted(((r.doc_id, r.component_id, r.kept) for r in minhash.grouped(docs, 70).collect()), key=str)
        assert got == sorted(((d, c, d == c) for d, c in expected), key=str)
        clashing = docs.withColumns({"at": docs.doc_id, "Of": docs.text, "node": docs.text, "of_": docs.text})
        kept = minhash.deduplicated(clashing, 70)
        assert kept.schema == clashing.schema
        assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted(((d, t) for (d, t), (_, c) in zip(some, expected) if d == c), key=str)
