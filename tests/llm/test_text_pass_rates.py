"""How text passes the randomness battery is counted on all letters of every text, wherever they stand."""

import math
import random
from collections import Counter

import pytest

pytest.importorskip("public_tokenizers")

from pyspark.sql import functions as F
from test_randomness_battery import brute
from weftgraph.llm import secrets

SIZES = [n - d for _, n, d in secrets.TEXT_FORMS]


def strings(letters, first):
    """(letters, form) of the strings of a text, from the form that it begins with."""
    at, k = 0, first
    while at < len(letters):
        size = SIZES[k % len(SIZES)]
        yield letters[min(at, len(letters) - size) :][:size], k % len(SIZES)
        at, k = at + size, k + 1


def test_all_letters_count(spark):
    rnd = random.Random(6)
    word = lambda: "".join(rnd.choices("etaoinshrdlucmwfgypbvk", k=rnd.randint(1, 9)))
    texts = [" ".join(word() for _ in range(n)) for n in (2000, 400, 90, 12)] + ["Sixteen letters a b", "a b c 1 2 3", "", "eighteen letters ab c"]
    docs = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    letters = F.lower(F.regexp_replace("text", "[^A-Za-z]+", ""))
    found = docs.select("i", secrets._as_text(F.col("text")).alias("t"), letters.alias("l"), F.pmod(F.xxhash64(letters), F.lit(len(SIZES))).alias("first")).collect()
    hashes = {}
    for r in found:
        own = list(strings(r.l, r.first if len(r.l) >= max(SIZES) else 0)) if len(r.l) >= min(SIZES) else []
        assert len(r.t) == len(own)
        hashes[r.i] = list(zip(r.t, own))
    assert sum(len(x) for x in hashes.values()) > 300 and len(hashes[4]) == 1 and not hashes[5] and not hashes[6] and len(hashes[7]) == 2
    parts = sorted({part for x in hashes.values() for _, (part, _) in x})
    numbers = dict(tuple(r) for r in spark.createDataFrame([(p,) for p in parts], "p string").select("p", F.xxhash64("p")).collect())
    for x in hashes.values():
        for got, (part, form) in x:
            name, n, d = secrets.TEXT_FORMS[form]
            digits = f"{(numbers[part] & ((1 << 62) - 1)) % 10_000:04}"[:d]
            token = part.upper() + digits.translate(str.maketrans("0189", "2345")) if name == "base32" else part + digits
            assert len(token) == n and got.stratum == list(secrets.ALPHABETS).index(name) * (secrets.MOST_CLASS + 1) + int(math.log2(n))
            p = max(brute(token, name), 1e-300)
            assert abs(got.bin - min(-4 * math.log2(p), secrets.BINS)) <= 1.02


def test_where_text_stands_does_not_matter(spark):
    """Text that passes behind a long one that does not: its share counts."""
    rnd = random.Random(7)
    flat = "".join(rnd.choices("abcdefghijklmnopqrstuvwxyz", k=60_000))
    some = "the " * 20_000 + flat
    rows = spark.createDataFrame([(some,)], "text string").select(F.explode(secrets._as_text(F.col("text"))).alias("t")).select("t.*")
    passed = Counter(r.bin < 27 for r in rows.collect())
    assert passed[True] > 1000 and passed[False] > 1500
