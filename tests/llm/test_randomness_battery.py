"""The randomness battery against the formulas written out, its p-values on random tokens, and reported tokens on planted ones."""

import math
import random

import pytest

pytest.importorskip("public_tokenizers")

from corpus import empty, frame, rows
from pyspark.sql import functions as F
from weftgraph.llm import secrets

NAMES = list(secrets.ALPHABETS)


def tail(z):
    return math.erfc(z / math.sqrt(2)) / 2


def brute(word, name):
    alphabet = secrets.ALPHABETS[name]
    values = [alphabet.index(c) for c in (word.lower() if name == "hex" else word.replace("-", "+").replace("_", "/"))]
    n, size = len(values), len(alphabet)
    x = (sum(values.count(v) ** 2 for v in range(size)) * size / n - n) * n / (n - 1)
    df = (size - 1) * n / (n - 1)
    c = 2 / (9 * df)
    chi = tail((max(x, 0) / df) ** (1 / 3) / math.sqrt(c) - (1 - c) / math.sqrt(c))
    high = [v * 2 >= size for v in values]
    a, b = sum(high), n - sum(high)
    runs = 1 + sum(x != y for x, y in zip(high, high[1:]))
    m = 2 * a * b / n + 1
    spread = (m - 1) * (m - 2) / (n - 1)
    turns = 2 * tail(abs(runs - m) / math.sqrt(spread) if spread > 0 else math.sqrt(n))
    mean = sum(values) / n
    square = sum((v - mean) ** 2 for v in values)
    serial = 2 * tail(abs(sum((p - mean) * (q - mean) for p, q in zip(values, values[1:])) / square + 1 / n) * math.sqrt(n) if square else math.sqrt(n))
    half = -sum(math.log(min(max(t, 1e-18), 1)) for t in (chi, turns, serial))
    return math.exp(-half) * (1 + half + half * half / 2)


def draw(rnd, name, size):
    word = "".join(rnd.choices(secrets.ALPHABETS[name], k=size))
    return word


def bins_of(spark, words):
    own = spark.createDataFrame(list(enumerate(words)), "i long, word string")
    found = own.select("i", F.explode(secrets._tested(F.col("word"))).alias("t")).select("i", "t.stratum", "t.bin", "t.start", "t.end")
    return {r.i: r for r in found.collect()}


def test_p_values_are_those_of_the_formulas(spark):
    rnd = random.Random(4)
    words = [draw(rnd, name, rnd.choice([20, 33, 64, 300])) for name in NAMES for _ in range(30)] + ["password1password1password1", "aaaaaaaaaaaaaaaaaaaaaaaaa1", "thequickbrownfoxjumps0123", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"]
    got = bins_of(spark, words)
    assert len(got) > 100
    for i, r in got.items():
        word = words[i][r.start : r.end]
        name = NAMES[r.stratum // (secrets.MOST_CLASS + 1)]
        p = max(brute(word, name), 1e-300)
        assert abs(r.bin - min(-4 * math.log2(p), secrets.BINS)) <= 1.02 and r.stratum % (secrets.MOST_CLASS + 1) == int(math.log2(len(word)))
    assert got[120].bin > 27 and got[121].bin > 27 and got[123].bin > 27


def test_random_tokens_have_uniform_p_values():
    rnd = random.Random(8)
    for name, size in (("hex", 20), ("base32", 24), ("base36", 32), ("base64", 20), ("base64", 64)):
        ps = [brute(draw(rnd, name, size), name) for _ in range(3000)]
        for limit in (0.01, 0.05, 0.25, 0.5):
            share = sum(p <= limit for p in ps) / len(ps)
            assert abs(share - limit) < 0.05 + 0.1 * limit, (name, size, limit, share)


def planted(rnd):
    """Texts with a random token, with a structured one of words and digits, and plain ones; the random ones."""
    words = "the of and to in is that for it was on are with as his they be at one have this from or had by hot word but what some we can out other were all there when up use your how said an each she which do their time if will way about many then them write would like so these her long make thing see him two has look more day could go come did number sound no most people my over know water than call first who may down side been now find".split()
    prose = lambda n: " ".join(rnd.choices(words, k=n))
    out, good = [], {}
    for i in range(1500):
        text = prose(rnd.randint(20, 120))
        if i % 3 == 0:
            token = draw(rnd, rnd.choice(["base36", "base64"]), rnd.choice([24, 32, 40]))
            if any(c.isdigit() for c in token) and any(c.isalpha() for c in token):
                good[i] = token
        elif i % 3 == 1:
            token = "".join(rnd.choices(words, k=9))[: rnd.randint(20, 40)] + str(rnd.randint(1, 2030))
        else:
            token = ""
        out.append((i, f"{text} {token} {prose(10)}", None, "s", None, "", "", 0))
    return out, good


def test_few_of_the_reported_tokens_are_structured(spark):
    some, good = planted(random.Random(2))
    right = wrong = 0
    for r in secrets.scanned(frame(spark, some)).collect():
        text = some[r.doc_id][1]
        for span in filter(None, r.spans.split(",")):
            kind, start, end = span.split(":")
            if kind == "random":
                hit = text[int(start) : int(end)] == good.get(r.doc_id)
                right, wrong = right + hit, wrong + (not hit)
    assert right > 0.7 * len(good) and wrong <= 0.07 * (right + wrong), (right, wrong, len(good))


def test_nothing_and_repeats(spark):
    assert secrets.scanned(empty(spark)).count() == 0
    token = draw(random.Random(3), "base64", 40)
    docs = frame(spark, [(d, t, *rows()[0][2:]) for d, t in [(None, token), (None, token), (1, None), (1, token), (2, "x " * 40_000 + token + " y" * 40_000)]])
    spans = sorted(r.spans for r in secrets.scanned(docs).collect())
    assert spans[0] == "" and len(set(spans[1:4])) == 1 and spans[4] == "random:80000:80040"
