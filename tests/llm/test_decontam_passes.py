import pytest

pytest.importorskip("public_tokenizers")

from corpus import frame, rows, texts
from weftgraph.llm import decontam


def test_passes_keep_every_row_apart(spark, monkeypatch):
    own = texts()
    extra = [(None, own[i], *rows()[0][2:]) for i in (16, 7, 7, 0, 3)] + [(16, own[16], *rows()[0][2:]), (16, own[7], *rows()[0][2:])]
    docs = frame(spark, rows() + extra)
    found = [(1, " ".join(own[16].split()[3:20])), (2, "one two"), (None, own[7]), (6, own[7]), (6, own[7]), (7, own[35]), (8, "")]
    benchmark = spark.createDataFrame(found, "item_id long, text string")
    most = 6  # the longest match is a lower bound that differs between passes
    whole = sorted((tuple(r)[:most] for r in decontam.hits(docs, benchmark).collect()), key=str)
    monkeypatch.setattr(decontam, "PASS_BYTES", 100)
    assert len(list(decontam.benchmark_blocks(benchmark, "item_id", "text"))) > 2
    got = sorted((tuple(r)[:most] for r in decontam.hits(docs, benchmark).collect()), key=str)
    assert len(got) == len(rows()) + len(extra) and got == whole
    assert sum(r[0] is None for r in got) == 5 and max(r[3] for r in got) >= 3
