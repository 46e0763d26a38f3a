import hashlib
import re
import zlib

import pytest

pytest.importorskip("public_tokenizers")

from corpus import SCHEMA, empty, frame, rows, texts
from weftgraph.llm import decontam, langid, licenses, lines, quality, secrets

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def items(spark):
    own = texts()
    long = words(own[16])
    found = [(1, " ".join(long[3:20])), (2, "one two"), (3, None), (4, ""), (5, "nothing of this kind is found anywhere in these texts at all"), (6, own[7]), (6, own[7])]
    return found, spark.createDataFrame(found, "item_id long, text string")


def brute_hits(found, window=10):
    windows = {}
    for n, (item, text) in enumerate(found):
        own = words(text)
        k = min(window, len(own))
        for s in range(len(own) - k + 1) if k else ():
            windows.setdefault(tuple(own[s : s + k]), set()).add((n, str(item)))
    out = {}
    for doc, text, *_ in rows():
        own = words(text)
        hit, names = [0] * len(own), set()
        for w, who in windows.items():
            for s in range(len(own) - len(w) + 1):
                if tuple(own[s : s + len(w)]) == w:
                    names |= who
                    hit[s : s + len(w)] = [1] * len(w)
        out[doc] = (len(own), sum(hit), len(names), hashlib.sha256(",".join(sorted(i for _, i in names)).encode()).hexdigest(), sum(hit) > 0)
    return out


@pytest.mark.parametrize("pass_bytes", [1 << 20, 100])
def test_decontamination(spark, monkeypatch, pass_bytes):
    monkeypatch.setattr(decontam, "PASS_BYTES", pass_bytes)
    found, benchmark = items(spark)
    docs = frame(spark).dropDuplicates(["doc_id"])
    got = {r.doc_id: tuple(r)[1:6] for r in decontam.hits(docs, benchmark).collect()}
    expected = brute_hits(found)
    assert got == expected and sum(v[4] for v in expected.values()) > 3
    clean = decontam.decontaminated(docs, benchmark)
    assert clean.columns == docs.columns and {r.doc_id for r in clean.collect()} == {d for d, v in expected.items() if not v[4]}
    longest = {r.doc_id: r.words for r in decontam.matches(docs, benchmark).collect()}
    assert longest[16] == 17
    assert decontam.hits(empty(spark), benchmark).count() == 0
    assert all(not r.contaminated for r in decontam.hits(docs, benchmark.limit(0)).collect())


def test_language_model(spark):
    def cuts(sequence, train):
        n = i = 0
        while i < len(sequence):
            j = i
            while j < len(sequence) and sequence[i : j + 1] in train:
                j += 1
            n, i = n + 1, max(j, i + 1)
        return n

    train = {"en": ["the cat sat on the mat and the dog"], "de": ["der hund und die katze sitzen auf der matte"], "fr": ["le chat est sur le tapis avec le chien"]}
    docs = [(i, t, l, "s", None, "", "", 0) for i, (l, ts) in enumerate(sorted(train.items())) for t in ts] + [(9, None, "en", "s", None, "", "", 0), (10, "12 !", "en", "s", None, "", "", 0), (11, "The dog sat", None, "s", None, "", "", 0)]
    frame_ = spark.createDataFrame(docs, SCHEMA)
    model = langid.fitted(frame_.where("doc_id < 9"))
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.identified(frame_, model).collect()}
    assert [got[i][0] for i in (0, 1, 2, 9, 10, 11)] == ["de", "en", "fr", "und", "und", "en"]
    assert all(0 <= s <= 1 for _, s in got.values())
    assert cuts("the dog", train["en"][0]) == 1
    nothing = langid.identified(frame_, langid.fitted(frame_.where("doc_id < 0"))).collect()
    assert {r.lang_pred for r in nothing} == {"und"}
    assert langid.identified(empty(spark), model).count() == 0
    flags = {r.doc_id: r.held_out for r in langid.identified(frame_, model, langid.held_out().alias("held_out")).collect()}
    assert flags == {d[0]: zlib.crc32(str(d[0]).encode()) % 4 == 2 for d in docs}


def test_cross_parsing_is_greedy():
    import random

    import numpy as np

    rnd = random.Random(3)
    for _ in range(60):
        train, text = "".join(rnd.choices("ab c", k=30)), "".join(rnd.choices("abcd ", k=50))
        model = langid.Model({"x": [train]})
        points = [np.frombuffer(t.encode("utf-32-le"), np.uint32) for t in (train, text)]
        known, symbols = (model.symbol[langid.normalised(p, np.array([len(p)]))[0]] for p in points)
        spell = lambda s: "".join(chr(97 + v) for v in s)
        n = i = 0
        sequence, source = spell(symbols), spell(known)
        while i < len(sequence):
            j = i
            while j < len(sequence) and sequence[i : j + 1] in source:
                j += 1
            n, i = n + 1, max(j, i + 1)
        assert model.phrases(symbols[None].astype(np.int32), np.array([len(symbols)]), model.tables[0])[0] == n


def test_line_dedup(spark):
    import numpy as np

    def chunked(text):
        data, offsets = np.frombuffer(text.encode(), np.uint8), np.array([0, len(text.encode())])
        _, place, a, b, n, _, _ = lines.chunks(data, offsets)
        return [(int(p), text.encode()[x:y], int(k)) for p, x, y, k in zip(place, a, b, n)]

    docs = frame(spark)
    own = sorted({r[:2] for r in rows()}, key=lambda r: r[0])
    first, drop = {}, {}
    for doc, text in own:
        for place, chunk, n in chunked(text) if text is not None else ():
            if n > 1 and chunk.split():
                if chunk in first:
                    drop.setdefault(doc, set()).add(place)
                first.setdefault(chunk, doc)
    assert drop
    expected = {d: t if d not in drop else b"\n".join(c for p, c, _ in chunked(t) if p not in drop[d]).decode() for d, t in own}
    out = lines.deduplicated(docs)
    assert out.schema == docs.schema
    got = out.collect()
    assert len(got) == len(rows()) and all(r.text == expected[r.doc_id] for r in got)
    digest = {r.doc_id: r for r in lines.digests(docs).collect()}
    assert all(digest[d].kept_sha256 == hashlib.sha256((t or "").encode()).hexdigest() for d, t in expected.items())
    assert {d for d, r in digest.items() if r.n_removed} == set(drop)
    assert lines.digests(empty(spark)).count() == 0 and lines.deduplicated(empty(spark)).count() == 0


def test_secrets(spark):
    assign = re.compile(secrets.ASSIGN, re.ASCII)

    def base(text):
        out = [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m[2]) >= 8]
        out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
        out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
        return sorted(out)

    extra = [(900, "key Zm9vYmFyMTIzNDU2Nzg5MGFiYw9Q1kLp0aZ é 😀 aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa1 " * 100, None, "s", None, "", "", 0)]
    docs = frame(spark, rows() + extra)
    found = 0
    for r in secrets.scanned(docs).collect():
        text = dict((d, t) for d, t, *_ in rows() + extra)[r.doc_id] or ""
        expected = base(text)
        spelled = [f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in expected]
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == i for _, k, _ in expected) for i in range(3))
        assert r.base_sha256 == hashlib.sha256(",".join(spelled).encode()).hexdigest() and set(spelled) <= set(filter(None, r.spans.split(",")))
        found += len(expected)
        if r.doc_id == 900:
            assert "random:4:39" in r.spans.split(",") and "random:44:" not in r.spans
    assert found >= 4 and secrets.scanned(empty(spark)).count() == 0


def test_licenses(spark):
    for r in licenses.scanned(frame(spark)).collect():
        text = dict((d, t) for d, t, *_ in rows())[r.doc_id]
        own = words(text)
        at, labels = [], set()
        for phrase, label in licenses.PHRASES.items():
            p = phrase.split()
            starts = [i for i in range(len(own) - len(p) + 1) if own[i : i + len(p)] == p]
            at += starts
            labels |= {label} if starts else set()
        hits = {}
        for line in (text or "").split("\n"):
            for label, ts in licenses.TEMPLATES.items():
                for t in ts:
                    share = len(set(t.split()) & set(words(line))) / len(set(t.split()))
                    if share >= licenses.THRESHOLD:
                        hits[label] = max(share, hits.get(label, 0))
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(own), len(at), min(at, default=None), max(at, default=None))
        assert r.base_labels == ",".join(sorted(labels)) and r.labels == ",".join(sorted(labels | set(hits)))
        assert r.score == (1.0 if at else max(hits.values(), default=0.0))
    assert licenses.scanned(empty(spark)).count() == 0


def test_quality(spark):
    docs = frame(spark)
    weights, report = quality.fitted(docs)
    assert 0 < report["share_good"] < 1 and set(report["accuracies"]) == set(quality.LABELLERS)
    scores = {r.doc_id: r for r in quality.scored(docs, weights).collect()}
    assert all(0 <= r.score <= 1 for r in scores.values()) and scores[0].kept and scores[1].kept
    own = texts()
    bad = [i for i, t in enumerate(own) if t and ("### " in t or "!! " in t or " | " in t)]
    assert bad and not any(scores[i].kept for i in bad) and all(scores[i].kept for i in range(14, 44))
    kept = quality.filtered(docs, weights)
    assert kept.schema == docs.schema and {r.doc_id for r in kept.collect()} == {i for i, r in scores.items() if r.kept}
    weights, _ = quality.fitted(empty(spark))
    assert all(r.kept for r in quality.scored(docs, weights).collect())


def test_expectation_maximisation_finds_accuracies():
    import numpy as np

    rnd = np.random.default_rng(1)
    truth = rnd.random(20000) < 0.8
    sensitivity = np.array([0.5, 0.4, 0.3, 0.6, 0.5, 0.2])
    votes = np.where(~truth[:, None] & (rnd.random((20000, 6)) < sensitivity), -1, 1)
    patterns, weights = np.unique(votes, axis=0, return_counts=True)
    accuracy, share, posterior = quality.expectation_maximisation(patterns, weights.astype(float))
    assert abs(share - 0.8) < 0.03 and np.abs(accuracy[:, 0] - sensitivity).max() < 0.05


def test_packed_automata_are_small_and_right():
    import random

    rnd = random.Random(6)
    for alphabet, size in (("ab", 300), ("abcdefghij ", 4000), ([chr(0x4E00 + i) for i in range(2500)], 9000)):
        sequence = [ord(c) - ord(alphabet[0]) if len(alphabet) > 20 else alphabet.index(c) for c in rnd.choices(alphabet, k=size)]
        automaton = langid.SuffixAutomaton(sequence)
        width = len(alphabet) + 1
        base, owner, target = automaton.packed(width)
        assert len(owner) <= 4 * sum(map(len, automaton.next)) + 2 * width
        for state, moves in enumerate(automaton.next):
            for symbol in range(min(width, 40)):
                cell = base[state] + symbol
                assert (target[cell] if owner[cell] == state else 0) == moves.get(symbol, 0)


def test_ties_go_to_the_first_language(spark):
    own = [(i, "same words in both", lang, "s", None, "", "", 0) for i, lang in enumerate(["zz", "aa", "zz"])] + [(None, "same words " * 500, None, "s", None, "", "", 0)]
    docs = spark.createDataFrame(own, SCHEMA)
    got = langid.identified(docs, langid.fitted(docs)).collect()
    assert {(r.lang_pred, r.score) for r in got} == {("aa", 0.0)} and len(got) == 4
    longest = spark.createDataFrame([(1, "a long text of its own " * 9000, "xx", "s", None, "", "", 0)], SCHEMA)
    assert [len(t) for t in langid.sample(longest)["xx"]] == [23 * 9000]
