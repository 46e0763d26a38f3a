"""The pipeline over a small corpus, stage by stage against brute force."""

import re

import pytest

pytest.importorskip("public_tokenizers")
pytest.importorskip("tiktoken")

from corpus import SCHEMA, empty, frame, rows, texts
from test_line_runs import brute
from test_text_operators import words
from test_tokens_media import ENCODING
from weftgraph.llm import quality

import corpus_pipeline


def kept_of_copies(own, percent=80, size=5):
    """Keys that are the smallest one of their component."""
    sets = {}
    for doc, text in own.items():
        w = re.findall(rb"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "").encode())
        sets[doc] = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()
    home = {d: d for d in sets}

    def find(a):
        while home[a] != a:
            a = home[a]
        return a

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                home[max(x, y)] = min(x, y)
    return {d for d in sets if find(d) == d}


def contaminated(text, items, window=10):
    own = words(text)
    for item in items:
        w = words(item)
        k = min(window, len(w))
        parts = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if k else set()
        if any(tuple(own[i : i + k]) in parts for i in range(len(own) - k + 1) if k):
            return True
    return False


def test_stages_are_those_of_brute_force(spark, tmp_path):
    own = texts()
    items = [" ".join(own[20].split()), "one two", None, "", own[16].split("\n")[0]]
    frame(spark).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    weights, _ = quality.fitted(docs)
    good = {r.doc_id for r in quality.scored(docs, weights).collect() if r.kept}
    now = {d: t for d, t, *_ in rows() if d in good}
    assert len(now) < len({r[0] for r in rows()})
    lined = brute(sorted(now.items()))
    assert lined != now
    once = {d: lined[d] for d in kept_of_copies(lined)}
    assert len(once) < len(lined)
    clean = {d: t for d, t in once.items() if not contaminated(t, items)}
    assert len(clean) < len(once)
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns == [*docs.columns, "token_ids", "n_tokens"]
    got = out.collect()
    repeated = [r[0] for r in rows()]
    assert sorted((r.doc_id, r.text) for r in got if r.text is not None) == sorted((d, t) for d, t in clean.items() if t is not None for _ in range(repeated.count(d)))
    for r in got:
        assert list(r.token_ids) == ENCODING.encode_ordinary(r.text or "") and r.n_tokens == len(r.token_ids) and r.n_chars == (None if r.text is None else len(r.text))


def test_stages_keep_columns_and_take_nothing(spark, tmp_path):
    nothing = empty(spark)
    nothing.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    odd = [(None, None), (None, "a b c"), (None, "a b c"), (1, ""), (1, "x"), (2, "word " * 300_000)]
    docs = spark.createDataFrame([(d, t, *rows()[0][2:]) for d, t in odd], SCHEMA)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.schema == docs.schema, name
        assert {r.doc_id for r in out.collect()} == {None, 1, 2}, name
