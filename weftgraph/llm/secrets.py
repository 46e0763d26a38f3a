"""Secret scans: fixed patterns, and a battery of randomness tests on encoded tokens. DataFrame functions only.

Tokens of 20 characters or more with digits and letters get an inferred encoding (hex, base32, base36, base64). Three
tests take the token as a uniform random string of that alphabet: chi-squared uniformity over the alphabet, Wald-Wolfowitz
runs about its middle, and lag-1 serial correlation; Fisher's rule combines their p-values. A p-value near 0 says that a
token is structured text; tokens above a limit are reported as spans of kind `random`, unless a base span covers them.

The limit bounds the false discoveries, structured tokens among the reported ones, within each encoding and length class
(powers of two): how often text of this corpus passes is counted on all letters of every text, cut end to end into strings
of letters with digits behind them; the tokens at or below LEAST give the number of structured ones. The limit is the
lowest p-value at which the structured tokens expected above it are Q of all tokens above it at most.

Three scans, no shuffle of texts: the first two only count p-values, of tokens and of strings of text. Nulls count as
empty texts. An empty text has no spans. Texts of any length are scanned whole; repeated rows get equal results and count
each; an empty table gives none.
"""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column, DataFrame, functions as F

from .native import chi_squared_deviation, chi_squared_spread, let, matches, table_through, tail_share, tail_side, through

#: Fixed patterns of the base kinds, in their order.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
KINDS = ("assign", "access", "hex", "random")
#: "=" only as padding at the end, so that the value of NAME=value is a token of its own.
TOKEN = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])(?=[0-9+/_-]*+[A-Za-z])[A-Za-z0-9+/_-]{20,}+(?:=++(?![A-Za-z0-9+/_-]))?+"
ALPHABETS = {
    "hex": "0123456789abcdef",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base36": "0123456789abcdefghijklmnopqrstuvwxyz",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
}
#: Share of structured tokens among the reported ones; p-value up to which a token is never reported.
Q, LEAST = 0.05, 0.01
#: p-values are counted by the quarter powers of two down to 2**(-BINS / 4); length classes end at MOST_CLASS.
BINS, MOST_CLASS = 240, 12
#: Lengths of the strings that show how text passes, from and to: the short ones of two length classes, as short text
#: passes more often. Longer tokens are judged like the longer ones of these.
TEXT_LENGTHS = ((20, 25), (32, 39))
#: (encoding, length, digits at the end) of these strings, in turn. The first ones are the shortest.
TEXT_FORMS = [(e, n, 4 if n == 20 else (n + i) % 4 + 1) for a, b in TEXT_LENGTHS for n in range(a, b + 1) for i, e in enumerate(("base32", "base36", "base64"))]
#: Longs of eight symbols that hold such a string; what its digits are worth above their codes, when letters are worth theirs.
LONGS = 5
MORE = {"base32": 9.0, "base36": -25.0, "base64": 11.0}


def _spans(text: Column, pattern: str, kind: int, good=None) -> Column:
    found = matches(text, pattern)
    found = F.filter(found, good) if good else found
    return F.transform(found, lambda m: F.struct(m["start"].alias("start"), F.lit(kind).alias("kind"), (m["start"] + F.length(m["word"])).alias("end")))


def _encoding(word: Column) -> Column:
    return (
        F.when(word.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$"), "hex").when(word.rlike("^[A-Z2-7]+$"), "base32")
        .when(word.rlike("^[a-z0-9]+$"), "base36").when(word.rlike("^[A-Za-z0-9+/_-]+$"), "base64")
    )


# The p-value in steps (see native.through), from doubles about a token of n symbols below size. squares: of the counts of
# symbols, summed; high: symbols in the upper half; runs: of high and low ones; square and product: sums of deviations from
# the mean, squared, and multiplied by the one before. What a step does not need it hands on in x["kept"].


def _degrees(x) -> dict[str, Column]:
    n, size = x["n"], x["size"]
    # With few symbols a cell the variance is smaller by (n - 1) / n than that of a chi-squared variable of size - 1.
    kept = {k: x[k] for k in ("kept", "n", "high", "runs", "square", "product")}
    return kept | {"chi": (x["squares"] * size / n - n) * n / (n - 1), "df": (size - 1) * n / (n - 1), "mean": 2 * x["high"] * (n - x["high"]) / n + 1, "root": F.sqrt(n)}


def _spreads(x) -> dict[str, Column]:
    n, mean = x["n"], x["mean"]
    serial = F.when(x["square"] > 0, F.abs(x["product"] / x["square"] + 1 / n) * x["root"]).otherwise(x["root"])
    kept = {k: x[k] for k in ("kept", "root", "chi", "df")}
    return kept | {"spread": (mean - 1) * (mean - 2) / (n - 1), "off": F.abs(x["runs"] - mean), "serial": serial, "cube": chi_squared_spread(x["df"])}


def _deviations(x) -> dict[str, Column]:
    uniformity = chi_squared_deviation(x["chi"], x["df"], x["cube"])
    return {"kept": x["kept"], "z0": uniformity, "z1": F.when(x["spread"] > 0, x["off"] / F.sqrt(x["spread"])).otherwise(x["root"]), "z2": x["serial"]}


def _shares(x) -> dict[str, Column]:
    return {k: x[k] for k in ("kept", "z0", "z1", "z2")} | {f"t{i}": tail_share(x[f"z{i}"]) for i in range(3)}


def _sides(x) -> dict[str, Column]:
    return {k: x[k] for k in ("kept", "z0", "z1", "z2")} | {f"side{i}": tail_side(x[f"z{i}"], x[f"t{i}"]) for i in range(3)}


def _fisher(x) -> dict[str, Column]:
    tails = [factor * F.when(x[f"z{i}"] >= 0, x[f"side{i}"]).otherwise(1 - x[f"side{i}"]) for i, factor in enumerate((1, 2, 2))]
    return {"kept": x["kept"], "half": functools.reduce(lambda a, t: a - F.ln(F.least(F.greatest(t, F.lit(1e-18)), F.lit(1.0))), tails, F.lit(0.0))}


def _p_value(x) -> dict[str, Column]:
    half = x["half"]
    return {"kept": x["kept"], "p": F.exp(-half) * (1 + half + half * half / 2)}


P_VALUE = (_degrees, _spreads, _deviations, _shares, _sides, _fisher, _p_value)


def battery(values: Column, counts: Column, size: Column) -> Column:
    """Combined p-value of the three tests on an array of symbol values below size, with the count of each symbol."""
    places = F.sequence(F.lit(1), F.size(values) - 1)

    def sums(m: Column) -> Column:
        return F.struct(
            F.lit(0).alias("kept"), F.size(values).cast("double").alias("n"), size.cast("double").alias("size"),
            F.aggregate(counts, F.lit(0.0), lambda a, c: a + c * c).alias("squares"),
            F.size(F.filter(values, lambda v: v * 2 >= size)).cast("double").alias("high"),
            (F.size(F.filter(places, lambda i: (values[i] * 2 >= size) != (values[i - 1] * 2 >= size))) + 1).cast("double").alias("runs"),
            F.aggregate(values, F.lit(0.0), lambda a, v: a + (v - m) * (v - m)).alias("square"),
            F.aggregate(places, F.lit(0.0), lambda a, i: a + (values[i] - m) * (values[i - 1] - m)).alias("product"),
        )

    middle = F.aggregate(values, F.lit(0.0), lambda a, v: a + v) / F.size(values)
    return let(let(middle, sums), lambda x: through(x, P_VALUE))["p"]


def _stratum(number: Column, length: Column) -> Column:
    return (number * (MOST_CLASS + 1) + F.least(F.floor(F.log2(length.cast("double"))), F.lit(MOST_CLASS))).cast("int")


def _bin(p: Column) -> Column:
    return F.least(F.floor(-4 * F.log2(F.greatest(p, F.lit(1e-300)))), F.lit(BINS)).cast("int")


def _judged(x: Column) -> Column:
    """struct<start, end, stratum, bin> of a struct<start, end, word, encoding>."""
    number = F.array_position(F.array(*(F.lit(name) for name in ALPHABETS)), x["encoding"]).cast("int") - 1
    plain = F.when(x["encoding"] == "hex", F.lower(x["word"])).otherwise(F.translate(x["word"], "-_", "+/"))
    alphabet = F.array(*(F.lit(a) for a in ALPHABETS.values()))[number]

    def tested(o: Column) -> Column:
        symbols = F.filter(F.split(o["alphabet"], ""), lambda c: c != "")
        counts = F.transform(symbols, lambda c: (F.length(o["plain"]) - F.length(F.replace(o["plain"], c, F.lit("")))).cast("double"))
        values = F.transform(F.filter(F.split(o["plain"], ""), lambda c: c != ""), lambda c: F.instr(o["alphabet"], c) - 1)
        return let(F.struct(values.alias("values"), counts.alias("counts"), F.length(o["alphabet"]).alias("size")), lambda v: battery(v["values"], v["counts"], v["size"]))

    p = let(F.struct(alphabet.alias("alphabet"), plain.alias("plain")), tested)
    return F.struct(x["start"].alias("start"), x["end"].alias("end"), _stratum(number, F.length(x["word"])).alias("stratum"), _bin(p).alias("bin"))


def _tested(text: Column) -> Column:
    """array<struct<start, end, stratum, bin>> of the tokens with an encoding."""

    def named(m: Column) -> Column:
        def own(word: Column) -> Column:
            return F.struct(m["start"].alias("start"), (m["start"] + F.length(m["word"])).alias("end"), word.alias("word"), _encoding(word).alias("encoding"))

        return let(F.regexp_replace(m["word"], "=+$", ""), own)

    usable = F.filter(F.transform(matches(text, TOKEN), named), lambda x: (F.length(x["word"]) >= 20) & x["encoding"].isNotNull())
    return F.transform(usable, _judged)


def _listed_by(values, form: Column) -> Column:
    return F.array(*(F.lit(v) for v in values))[form]


def _strings(text: Column) -> Column:
    """array of struct<letters, form>: all letters of the text in strings of TEXT_FORMS in turn.

    A hash chooses the form that a text begins with. The last string ends with the text and may overlap the one before;
    a text of fewer letters than the shortest string has none.
    """
    sizes = [n - d for _, n, d in TEXT_FORMS]
    turns, whole = len(sizes), sum(sizes)
    begins = [sum((sizes * 2)[:k]) for k in range(2 * turns)]

    def strings(own: Column) -> Column:
        """From letters and the number of the first form; a block holds each form once."""
        letters, first = own["letters"], own["first"]

        def of_block(block: Column) -> Column:
            begun = F.filter(F.sequence(first, first + turns - 1), lambda k: _listed_by(begins, k) - _listed_by(begins, first) < block["size"])

            def string(k: Column) -> Column:
                at, size = _listed_by(begins, k) - _listed_by(begins, first), _listed_by(sizes, k % turns)
                part = F.when(at + size <= block["size"], F.substring(block["letters"], at + 1, size)).otherwise(F.substring(letters, -size, size))
                return F.struct(part.alias("letters"), (k % turns).alias("form"))

            return F.transform(begun, string)

        sized = lambda x: let(F.struct(x.alias("letters"), F.length(x).alias("size")), of_block)
        return F.flatten(F.transform(F.regexp_extract_all(letters, F.lit(f".{{1,{whole}}}"), F.lit(0)), sized))

    letters = F.lower(F.regexp_replace(text, "[^A-Za-z]+", ""))
    # Short texts begin with the shortest strings, so that these reach all their letters.
    own = lambda x: F.struct(x.alias("letters"), F.when(F.length(x) < max(sizes), 0).otherwise(F.pmod(F.xxhash64(x), F.lit(turns))).cast("int").alias("first"))
    return let(let(letters, own), lambda o: F.when(F.length(o["letters"]) >= min(sizes), strings(o)).otherwise(F.array().cast("array<struct<letters:string,form:int>>")))


# The steps that judge a string of letters and a form: the sums of the battery by counting bits, each symbol of the string
# being one bit of a long. x is a struct, or a table, with the columns that the step before gives.

#: The lower bits of a code, which is that of ASCII: letters 1 to 26, digits 16 to 25.
BITS = tuple(f"bit{k}" for k in range(5))


def _sum(terms) -> Column:
    return functools.reduce(lambda a, b: a + b, terms)


def _any(masks) -> Column:
    return functools.reduce(lambda a, b: a.bitwiseOR(b), masks)


def _ones(mask: Column) -> Column:
    return F.bit_count(mask).cast("double")


def _before(mask: Column) -> Column:
    """The mask with each bit at the place of the next symbol."""
    return F.shiftright(mask, 8).bitwiseOR(F.shiftleft(mask.bitwiseAND(F.lit(255)), 57))


def _per_encoding(form: Column, base32: Column, base36: Column, base64: Column) -> Column:
    """The one for the encoding of the form."""
    of = lambda name: form.isin([i for i, (e, _, _) in enumerate(TEXT_FORMS) if e == name])
    return F.when(of("base32"), base32).when(of("base36"), base36).otherwise(base64)


def _bytes_of_string(x) -> dict[str, Column]:
    """The letters and the digits behind them, in hexadecimal. Letters stay lower-case, base32 or not."""
    number = F.substring(F.lpad((F.xxhash64(x["letters"]).bitwiseAND(F.lit((1 << 62) - 1)) % 10_000).cast("string"), 4, "0"), F.lit(1), _listed_by((d for _, _, d in TEXT_FORMS), x["form"]))
    digits = _per_encoding(x["form"], F.translate(number, "0189", "2345"), number, number)
    return {"form": x["form"], "hex": F.rpad(F.hex(F.concat(x["letters"], digits)), 16 * LONGS, "0")}


def _longs(x) -> dict[str, Column]:
    return {"form": x["form"]} | {f"long{j}": F.coalesce(F.conv(F.substring(x["hex"], 16 * j + 1, 16), 16, 10).cast("long"), F.lit(0).cast("long")) for j in range(LONGS)}


def _planes(x) -> dict[str, Column]:
    """bit0 to bit4: of the codes; all: of any symbol; letter. Symbol p of long j is bit 8 * (7 - p) + j of each."""
    plane = lambda k: _any(F.shiftleft(F.shiftright(x[f"long{j}"], k).bitwiseAND(F.lit(0x0101010101010101)), j) for j in range(LONGS))
    return {"form": x["form"]} | {bit: plane(k) for k, bit in enumerate(BITS)} | {"all": plane(5), "letter": plane(6)}


def _groups(x) -> dict[str, Column]:
    """Symbols by the upper two bits of their codes, letters (group0 to group3) and digits (group6 and group7), and by the lower three."""
    bit = lambda k, value: x[BITS[k]] if value else F.bitwise_not(x[BITS[k]])
    digit = x["all"].bitwiseAND(F.bitwise_not(x["letter"]))
    groups = {f"group{g}": x["letter"].bitwiseAND(bit(4, g & 2)).bitwiseAND(bit(3, g & 1)) for g in range(4)} | {f"group{g}": digit.bitwiseAND(bit(3, g & 1)) for g in (6, 7)}
    lower = {f"lower{v}": bit(2, v & 4).bitwiseAND(bit(1, v & 2)).bitwiseAND(bit(0, v & 1)) for v in range(8)}
    return {"form": x["form"], "all": x["all"], "digit": digit} | {bit: x[bit] for bit in BITS} | groups | lower


def _counts(x) -> dict[str, Column]:
    """How often each symbol stands there, and which are high."""
    group = lambda c: (ord(c) & 31) // 8 + 4 * c.isdigit()

    def high(name: str) -> Column:
        alphabet = ALPHABETS[name].lower() if name == "base32" else ALPHABETS[name]
        masks = []
        for g in (0, 1, 2, 3, 6, 7):
            own = [c for c in ALPHABETS["base36"] if c in alphabet and group(c) == g]
            above = [c for c in own if alphabet.index(c) * 2 >= len(alphabet)]
            if above:
                masks.append(x[f"group{g}"] if above == own else x[f"group{g}"].bitwiseAND(_any(x[f"lower{ord(c) & 7}"] for c in above)))
        return _any(masks)

    kept = {k: x[k] for k in ("form", "all", "digit", *BITS)}
    counts = {f"n_{c}": _ones(x[f"group{group(c)}"].bitwiseAND(x[f"lower{ord(c) & 7}"])) for c in ALPHABETS["base36"]}
    return kept | {"high": _per_encoding(x["form"], high("base32"), high("base36"), high("base64"))} | counts


def _befores(x) -> dict[str, Column]:
    """Squares of the counts, runs; the masks moved to the next symbol, where there is one."""
    moved = {f"before_{k}": _before(x[k]).bitwiseAND(x["all"]) for k in ("digit", *BITS)}
    changes = x["high"].bitwiseXOR(_before(x["high"])).bitwiseAND(x["all"]).bitwiseAND(F.lit(~(1 << 56)))
    kept = {k: x[k] for k in ("form", "digit", *BITS)}
    sums = {"n": _ones(x["all"]), "squares": _sum(x[f"n_{c}"] * x[f"n_{c}"] for c in ALPHABETS["base36"]), "high": _ones(x["high"]), "runs": _ones(changes) + 1.0}
    return kept | moved | sums


def _sums(x) -> dict[str, Column]:
    """Sums of values, of their squares and of their products with the one before.

    A value is a code and for digits what the encoding adds to it, less a constant, on which nothing depends.
    """
    bits, befores = [x[bit] for bit in BITS], [x[f"before_{bit}"] for bit in BITS]
    digit, before = x["digit"], x["before_digit"]
    ones = lambda masks: _sum(_ones(mask) * F.lit(float(1 << k)) for k, mask in masks)
    with_ = lambda masks, mask: ((k, m.bitwiseAND(mask)) for k, m in enumerate(masks))
    products = lambda a, b: ((k + j, m.bitwiseAND(o)) for k, m in enumerate(a) for j, o in enumerate(b))
    return {k: x[k] for k in ("form", "n", "squares", "high", "runs")} | {
        "more": _listed_by((MORE[e] for e, _, _ in TEXT_FORMS), x["form"]),
        "code": ones(enumerate(bits)), "digits": _ones(digit), "first": ones(with_(bits, F.lit(1 << 56))), "code_before": ones(enumerate(befores)), "digits_before": _ones(before),
        "code_code": ones(products(bits, bits)), "code_digits": ones(with_(bits, digit)),
        "next_code": ones(products(bits, befores)), "next_digits": ones(with_(bits, before)) + ones(with_(befores, digit)), "both_digits": _ones(digit.bitwiseAND(before)),
    }


def _moments(x) -> dict[str, Column]:
    more = x["more"]
    return {k: x[k] for k in ("form", "n", "squares", "high", "runs")} | {
        "sum": x["code"] + more * x["digits"], "without_first": x["code"] + more * x["digits"] - x["first"], "without_last": x["code_before"] + more * x["digits_before"],
        "own": x["code_code"] + 2.0 * more * x["code_digits"] + more * more * x["digits"], "next": x["next_code"] + more * x["next_digits"] + more * more * x["both_digits"],
    }


def _deviation_sums(x) -> dict[str, Column]:
    n, total = x["n"], x["sum"]
    square = (n * x["own"] - total * total) / n
    product = (n * n * x["next"] - n * total * (x["without_first"] + x["without_last"]) + (n - 1.0) * total * total) / (n * n)
    size = _listed_by((float(len(ALPHABETS[e])) for e, _, _ in TEXT_FORMS), x["form"])
    return {"kept": x["form"]} | {k: x[k] for k in ("n", "squares", "high", "runs")} | {"size": size, "square": square, "product": product}


def _stratum_and_bin(x) -> dict[str, Column]:
    strata = (list(ALPHABETS).index(e) * (MOST_CLASS + 1) + int(math.log2(n)) for e, n, _ in TEXT_FORMS)
    return {"stratum": _listed_by(strata, x["kept"]), "bin": _bin(x["p"])}


STEPS = (_bytes_of_string, _longs, _planes, _groups, _counts, _befores, _sums, _moments, _deviation_sums, *P_VALUE, _stratum_and_bin)
#: The large ones.
APART = (_counts, _befores, _sums)


def _as_text(text: Column) -> Column:
    """array of struct<stratum, bin>: all letters of the text in strings of TEXT_FORMS in turn, as tokens."""
    return F.transform(_strings(text), lambda x: through(x, STEPS))


def _strings_judged(docs: DataFrame, text: str) -> DataFrame:
    """stratum and bin of each string of all texts, as by _as_text."""
    return table_through(docs.select(F.explode(_strings(_text(text))).alias("s")).select("s.letters", "s.form"), STEPS, APART)


def _text(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def reported_bins(docs: DataFrame, text: str = "text", q: float = Q) -> dict[int, int]:
    """For each stratum the first bin that is not reported (bins count -4 log2 p), over all documents.

    At most strata x bins rows reach the driver, whatever the corpus.
    """
    tokens = docs.select(F.explode(_tested(_text(text))).alias("t")).select(F.lit(True).alias("token"), "t.stratum", "t.bin")
    strings = _strings_judged(docs, text).select(F.lit(False).alias("token"), "stratum", "bin")
    counted = tokens.unionAll(strings).groupBy("token", "stratum", "bin").agg(F.count(F.lit(1)).alias("n")).collect()
    per: dict[bool, dict[int, dict[int, int]]] = {True: {}, False: {}}
    for token, stratum, bin_, n in counted:
        per[token].setdefault(stratum, {})[bin_] = n
    last = math.ceil(-4 * math.log2(LEAST))
    names = list(ALPHABETS)
    found = {}
    for stratum, bins in per[True].items():
        number, length = divmod(stratum, MOST_CLASS + 1)
        like = names.index("base36") if names[number] == "hex" else number  # text has hardly any hex of its own
        null = per[False].get(like * (MOST_CLASS + 1) + min(length, int(math.log2(TEXT_LENGTHS[-1][1]))), {})
        total = sum(null.values())

        def passing(bin_: int) -> float:
            """Share of text with a p-value above that of the bin."""
            return sum(n for b, n in null.items() if b < bin_) / total if total else 0.0

        structured = sum(n for b, n in bins.items() if b >= last) / max(1 - passing(last), 0.5)
        found[stratum] = max((b for b in range(last + 1) if structured * passing(b) <= q * sum(n for c, n in bins.items() if c < b)), default=0)
    return found


def found(docs: DataFrame, key: str = "doc_id", text: str = "text", q: float = Q) -> DataFrame:
    """doc_id, base and random: arrays of struct start, kind (its number), end, sorted."""
    limits = reported_bins(docs, text, q)
    chosen = docs.select(F.col(key).cast("long").alias("doc_id"), _text(text).alias("text"))
    base = F.array_sort(F.concat(
        _spans(F.col("text"), ASSIGN, 0, lambda m: F.length(F.regexp_extract(m["word"], ASSIGN, 2)) >= 8),
        _spans(F.col("text"), ACCESS, 1), _spans(F.col("text"), HEX, 2),
    ))
    known = F.create_map(*(F.lit(x) for pair in (limits or {-1: 0}).items() for x in pair))
    loose = F.filter(_tested(F.col("text")), lambda t: t["bin"] < F.coalesce(F.try_element_at(known, t["stratum"]), F.lit(0)))
    random = F.transform(loose, lambda t: F.struct(t["start"].alias("start"), F.lit(3).alias("kind"), t["end"].alias("end")))
    both = chosen.select("doc_id", let(F.struct(base.alias("base"), random.alias("random")), lambda x: x).alias("x"))
    return both.select("doc_id", let(F.col("x"), lambda x: F.struct(
        x["base"].alias("base"),
        F.filter(x["random"], lambda r: ~F.exists(x["base"], lambda b: (b["start"] <= r["start"]) & (b["end"] >= r["end"]))).alias("random"),
    )).alias("x")).select("doc_id", "x.base", "x.random")


def _listed(spans: Column) -> Column:
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))), ",")


def scanned(docs: DataFrame, key: str = "doc_id", text: str = "text", q: float = Q) -> DataFrame:
    """Per document: doc_id, n_assign, n_access, n_hex, base_sha256 and spans."""
    own = found(docs, key, text, q)
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return own.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(_listed(F.col("base")).cast("binary"), 256).alias("base_sha256"), _listed(F.array_sort(F.concat("base", "random"))).alias("spans"),
    )
