import hashlib
import zlib

import pytest

pytest.importorskip("public_tokenizers")

from corpus import frame
from weftgraph.llm import mpeg


def texts():
    return [("x" * (576 * (n - 1) + 521) + "TAG").ljust(576 * n, "y") for n in (1, 2, 3)]


@pytest.mark.parametrize("with_stream", [False, True])
def test_text_with_a_tag_near_its_end(spark, with_stream):
    docs = frame(spark, [(i, t, None, "s", None, "", "", 0) for i, t in enumerate(texts())])
    for r in mpeg.media(docs, with_stream=with_stream).collect():
        data = texts()[r.doc_id].encode()
        assert (r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-32:]))
        assert f"frames={r.doc_id + 1};" in r.feature and r.feature.endswith("junk=0")
        assert not with_stream or abs(r.duration_s - (r.doc_id + 1) * 1152 / 48000) < 1e-9


def test_real_tags_are_still_cut():
    for text in texts():
        data, n = mpeg.payload(text)
        got = mpeg.read(mpeg.write(data, n) + b"TAG".ljust(128, b"\xff"))
        assert got["payload"] == data and got["junk"] == 0
    assert mpeg.read(mpeg.write(data, n) + b"tail")["payload"] == data
