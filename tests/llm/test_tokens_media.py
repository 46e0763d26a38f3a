import hashlib
import random
import zlib

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")

from corpus import empty, frame, rows
from hypothesis import given, settings, strategies as st
from weftgraph.llm import bpe, mpeg

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
RANKS = bpe.load_ranks(PATH)
ENCODING = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def test_ids_are_the_librarys(spark):
    got = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.digests(frame(spark), PATH, public_tokenizers.PATTERN).collect()}
    expected = set()
    for doc, text, *_ in rows():
        ids = ENCODING.encode_ordinary(text or "")
        expected.add((doc, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert got == expected
    assert bpe.digests(empty(spark), PATH, public_tokenizers.PATTERN).count() == 0


def test_round_trip_keeps_columns(spark):
    docs = frame(spark)
    out = bpe.encoded(docs, PATH, public_tokenizers.PATTERN)
    assert out.columns == [*docs.columns, "token_ids", "n_tokens"]
    back = bpe.decoded(out, PATH).collect()
    assert len(back) == len(rows()) and all(bytes(r.decoded) == (r.text or "").encode() for r in back)


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=80))
def test_any_text(text):
    tokenizer = bpe.Tokenizer(RANKS, public_tokenizers.PATTERN)
    (ids,) = tokenizer.encode([text])
    assert np.frombuffer(ids, "<u4").tolist() == ENCODING.encode_ordinary(text) and tokenizer.decode(ids) == text.encode()


def test_replay_is_greedy_for_any_ranks():
    def greedy(word, ranks):
        parts = [bytes([c]) for c in word]
        while word not in ranks and (found := [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]):
            i = min(found)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [ranks[word]] if word in ranks else [ranks[p] for p in parts]

    rnd = random.Random(5)
    for _ in range(300):
        tokens = list({bytes(rnd.choices(b"abc", k=rnd.randint(2, 5))) for _ in range(rnd.randint(1, 14))})
        ranks = {bytes([b]): b for b in range(256)} | {t: 256 + i for i, t in enumerate(tokens)}
        words = [bytes(rnd.choices(b"abc", k=rnd.randint(1, 14))) for _ in range(5)]
        assert [x.tolist() for x in bpe.MergeReplay(ranks).encode(words)] == [greedy(w, ranks) for w in words]


def test_media_round_trip(spark):
    got = {r.doc_id: r for r in mpeg.media(frame(spark), with_stream=True).collect()}
    for doc, text, *_ in rows():
        raw = (text or "").encode()
        data = raw.ljust(max(1, -(-len(raw) // 576)) * 576, b"\xff")
        r = got[doc]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-32:]))
        assert (r.media_bytes, r.media_sha256) == (len(r.media), hashlib.sha256(bytes(r.media)).hexdigest())
        assert len(r.frame_offsets) == len(data) // 576 and abs(r.duration_s - len(r.frame_offsets) * 1152 / 48000) < 1e-9
    assert got[4].media_sha256 == got[5].media_sha256
    assert mpeg.media(empty(spark)).count() == 0


def test_resynchronises_and_checks():
    data, n = mpeg.payload("some text " * 300)
    stream = mpeg.write(data, n)
    got = mpeg.read(stream)
    assert got["payload"] == data and got["xing"][:2] == (len(data) // 576, len(stream) - (int(got["offsets"][0]) - 672)) and got["bad_checksums"] == 0
    noisy = mpeg.read(b"noise\xff\x00" + stream[stream.index(b"\xff\xfa") :] + b"tail")
    assert noisy["payload"] == data and noisy["junk"] >= 7
    broken = bytearray(stream)
    broken[int(got["offsets"][1]) + 10] ^= 1
    assert mpeg.read(bytes(broken))["bad_checksums"] == 1
    assert mpeg.read(b"")["payload"] == b"" and mpeg.read(b"\xff" * 50)["payload"] == b""
