"""Strings of text judged in compiled steps over rows: the same bins as the formulas give, for every form and for odd letters."""

import math
import random
from collections import Counter

import pytest

pytest.importorskip("public_tokenizers")

from pyspark.sql import functions as F
from test_randomness_battery import brute
from weftgraph.llm import secrets
from weftgraph.llm.native import table_through


def words(spark, strings):
    """The token that each (letters, form) makes, by plain Python."""
    table = spark.createDataFrame(strings, "letters string, form int").select("letters", "form", F.xxhash64("letters").alias("h"))
    for r in table.collect():
        name, _, d = secrets.TEXT_FORMS[r.form]
        digits = f"{(r.h & ((1 << 62) - 1)) % 10_000:04}"[:d]
        yield name, r.letters.upper() + digits.translate(str.maketrans("0189", "2345")) if name == "base32" else r.letters + digits


def test_sums_are_those_of_the_symbols(spark):
    rnd = random.Random(12)
    strings = []
    for form, (_, n, d) in enumerate(secrets.TEXT_FORMS):
        made = ["a" * (n - d), "z" * (n - d), ("az" * n)[: n - d], ("abcdefghijklmnopqrstuvwxyz" * 2)[: n - d], ("zyxwvutsrqponmlkjihgfedcba" * 2)[: n - d]]
        strings += [(letters, form) for letters in made + ["".join(rnd.choices("abcdefghijklmnopqrstuvwxyz", k=n - d)) for _ in range(5)]]
    steps = secrets.STEPS[: secrets.STEPS.index(secrets._deviation_sums) + 1]
    got = table_through(spark.createDataFrame(strings, "letters string, form int").coalesce(1), steps, secrets.APART).collect()
    for r, (name, word) in zip(got, words(spark, strings), strict=True):
        alphabet = secrets.ALPHABETS[name]
        values = [alphabet.index(c) for c in word]
        high = [2 * v >= len(alphabet) for v in values]
        mean = sum(values) / len(values)
        assert (r.n, r.size, r.high) == (len(word), len(alphabet), sum(high))
        assert r.squares == sum(c * c for c in Counter(word).values()) and r.runs == 1 + sum(a != b for a, b in zip(high, high[1:]))
        assert math.isclose(r.square, sum((v - mean) ** 2 for v in values), rel_tol=1e-9, abs_tol=1e-6)
        assert math.isclose(r.product, sum((a - mean) * (b - mean) for a, b in zip(values, values[1:])), rel_tol=1e-9, abs_tol=1e-6)


def test_bins_over_rows(spark):
    rnd = random.Random(13)
    texts = [" ".join("".join(rnd.choices("etaoinshrdlucmwfgypbvkxqjz", k=rnd.randint(1, 9))) for _ in range(n)) for n in (900, 300, 40)] + ["a" * 500, "Été où 1 2 3", "", None]
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    strings = [(s.letters, s.form) for r in docs.select(secrets._strings(secrets._text("text")).alias("s")).collect() for s in r.s]
    expected = Counter()
    for name, word in words(spark, strings):
        stratum = list(secrets.ALPHABETS).index(name) * (secrets.MOST_CLASS + 1) + int(math.log2(len(word)))
        expected[stratum, min(math.floor(-4 * math.log2(max(brute(word, name), 1e-300))), secrets.BINS)] += 1
    rows = lambda table: Counter((r.stratum, r.bin) for r in table.select("stratum", "bin").collect())
    got = rows(secrets._strings_judged(docs, "text"))
    assert got == rows(docs.select(F.explode(secrets._as_text(secrets._text("text"))).alias("t")).select("t.*"))
    assert sum(got.values()) == sum(expected.values()) > 200
    # The tail of the formulas is exact, that of the operator to 1e-7: strings near a border may fall on its other side.
    assert sum((got - expected).values()) <= 0.02 * sum(expected.values())


def test_steps_are_compiled(spark):
    """The JVM compiles no method above 8,000 bytes; interpreted steps took over four times the CPU seconds."""
    docs = spark.createDataFrame([("text",)], "text string")
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = secrets._strings_judged(docs, "text").groupBy("stratum", "bin").count()._jdf.queryExecution().executedPlan()
        parts = getattr(getattr(spark._jvm, "org.apache.spark.sql.execution.debug.package$"), "MODULE$").codegenStringSeq(plan)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    assert parts.size() >= 3
    assert all(parts.apply(i)._3().maxMethodCodeSize() < 8000 for i in range(parts.size()))
