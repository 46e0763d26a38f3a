import random
import re

import pytest

pytest.importorskip("public_tokenizers")

import numpy as np
from corpus import SCHEMA, empty, frame, rows
from weftgraph.llm import lines, queries


def brute(own):
    """Texts by key after removal, from the rule itself over all lines and pairs of lines in the order of keys."""
    size = lambda x: len(re.findall(rb"[^\x20\x09-\x0d]+", x))
    seen, out = set(), {}
    for doc, text in own:
        if text is None:
            out[doc] = None
            continue
        split = text.encode().split(b"\n")
        n = len(split)
        pairs, gone = [], [False] * n
        for i, line in enumerate(split):
            gone[i] = size(line) >= lines.WORDS and line in seen
            seen.add(line)
            if i + 1 < n:
                pair = (line, split[i + 1])
                pairs.append(None if not size(line) + size(split[i + 1]) else pair in seen)
                seen.add(pair)
        linked = []
        for i, p in enumerate(pairs):
            sides = [next((q for q in s if q is not None), False) for s in (pairs[i::-1], pairs[i:])]
            linked.append(all(sides) if p is None else p)
        data = text.encode()
        counts = lines.chunks(np.frombuffer(data, np.uint8), np.array([0, len(data)]))[4].tolist()
        whole, first = set(), 0
        for k in counts:
            own_pairs = pairs[first : first + k - 1]
            if any(own_pairs) and all(p is not False for p in own_pairs):
                whole |= set(range(first, first + k))
            first += k
        start = 0
        for i in range(n):
            if i == n - 1 or not linked[i]:
                run = range(start, i + 1)
                if len(run) > 1 and (sum(size(split[j]) for j in run) >= lines.WORDS or whole & set(run)):
                    for j in run:
                        gone[j] = True
                start = i + 1
        out[doc] = b"\n".join(x for j, x in enumerate(split) if not gone[j] and j not in whole).decode()
    return out


def planted():
    """(rows, passages by the key of their second place): passages of 1 to 12 lines between lines of their own."""
    rnd = random.Random(11)
    prose = lambda n: " ".join("".join(rnd.choices("abcdefgh", k=6)) for _ in range(n))
    out, later = [], {}
    for k in range(120):
        passage = [prose(60)] if k % 6 == 0 else [prose(rnd.choice([4, 25])) for _ in range((1, 2, 3, 4, 6, 12)[k % 6])] + [prose(30)]
        if k % 4 == 1:
            passage[1:1] = ["", "", ""]
        for doc in (k, 1000 + k):
            out.append((doc, "\n".join([prose(5), prose(30), *passage, prose(30), prose(3)]), None, "s", None, "", "", 0))
        later[1000 + k] = passage
    out += [(2000, "}\n\n}\nx", None, "s", None, "", "", 0), (2001, "y\n}\n\n}\n" + "a\na\n" * 8, None, "s", None, "", "", 0)]
    return out, later


def test_runs_are_those_of_brute_force(spark):
    own, later = planted()
    for some in (own, sorted({r[:2] for r in rows()})):
        expected = brute(sorted(r[:2] for r in some))
        docs = frame(spark, [(*r[:2], None, "s", None, "", "", 0) for r in some])
        out = lines.deduplicated(docs, runs=True)
        assert out.schema == docs.schema and {r.doc_id: r.text for r in out.collect()} == expected
        removed = {r.doc_id: r.n_removed for r in lines.digests(docs, runs=True).collect()}
        assert {d for d, n in removed.items() if n} == {d for d, t in some if t != expected[d]} if len(some[0]) == 2 else removed[1000] == 1
    got = {r.doc_id: r.text.split("\n") for r in lines.deduplicated(frame(spark, own), runs=True).collect()}
    assert all(len(got[d]) == 4 and not set(p) & set(got[d]) for d, p in later.items())
    assert all(got[d] == t.split("\n") for d, t, *_ in own if d < 1000)
    assert lines.deduplicated(empty(spark), runs=True).count() == 0


def test_rows_that_share_a_key_lose_only_what_they_hold(spark):
    line = "one two three four five six seven eight nine ten"
    docs = spark.createDataFrame([(1, line, *rows()[0][2:]), (2, line, *rows()[0][2:]), (2, "another text", *rows()[0][2:])], SCHEMA)
    assert sorted(r.text for r in lines.deduplicated(docs, runs=True).collect()) == ["", "another text", line]


def test_query_counts_single_lines(spark, tmp_path):
    line = "one two three four five six seven eight nine ten"
    spark.createDataFrame([(1, "a\n" + line), (2, line + "\nb")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert {r.doc_id: r.n_removed for r in queries.op2_lines(spark, str(tmp_path)).collect()} == {1: 0, 2: 1}
