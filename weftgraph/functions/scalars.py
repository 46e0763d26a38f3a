"""Scalar functions of the engine as Column expressions; register() offers three of them to SQL."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession, functions as F

#: Where a name or path falls into parts: other characters, aB, ABc.
_CUTS = r"[^\p{IsAlphabetic}\p{IsDigit}]+|(?<=\p{Ll})(?=\p{Lu})|(?<=\p{Lu})(?=\p{Lu}\p{Ll})"
_DIGITS = r"|(?<=[0-9])(?=[^0-9])|(?<=[^0-9])(?=[0-9])"
TEST_WORDS = ("test", "tests", "spec", "specs", "testing")


def _col(value) -> Column:
    return F.col(value) if isinstance(value, str) else value


def strings(values) -> Column:
    values = list(values)
    return F.array(*(F.lit(v) for v in values)) if values else F.array().cast("array<string>")


def subwords(name) -> Column:
    """The lower-cased parts of an identifier, one space apart; empty with fewer than two."""
    parts = F.filter(F.split(_col(name), _CUTS + _DIGITS), lambda p: p != "")
    return F.when(F.size(parts) <= 1, "").otherwise(F.lower(F.array_join(parts, " ")))


def leaf_name(name) -> Column:
    """What stands behind the last `::`, then behind the last dot."""
    return F.element_at(F.split(F.element_at(F.split(_col(name), "::"), -1), r"\."), -1)


def is_test_path(path) -> Column:
    """Whether a part of the path is a test word."""
    return F.arrays_overlap(F.transform(F.split(_col(path), _CUTS), lambda p: F.lower(p)), strings(TEST_WORDS))


def id_segment(text) -> Column:
    """Lower-case ASCII letters and digits, runs of others as one underscore, none at the ends."""
    return F.trim(F.lower(F.regexp_replace(_col(text), "[^A-Za-z0-9]+", "_")), F.lit("_"))


def qualified_id(*parts) -> Column:
    """Segments of project, path and name joined by dots; empty ones are dropped. A path may hold several segments."""
    segments = F.flatten(F.array(*(F.split(_col(p), "[/.]") for p in parts)))
    return F.array_join(F.filter(F.transform(segments, id_segment), lambda s: s != ""), ".")


def top_segment(path) -> Column:
    return F.when(F.instr(_col(path), "/") > 0, F.substring_index(_col(path), "/", 1)).otherwise("")


def directory(path) -> Column:
    return F.regexp_extract(_col(path), r"^(.*)/[^/]*$", 1)


def extension(path) -> Column:
    return F.lower(F.regexp_extract(_col(path), r"\.([^./]+)$", 1))


def file_stem(path) -> Column:
    return F.regexp_extract(_col(path), r"([^/]+?)(?:\.[^./]*)?$", 1)


def joined_path(directory_, module) -> Column:
    """module against a directory, with `.` and `..` resolved; `..` above the root is dropped."""
    segments = F.concat(F.split(_col(directory_), "/"), F.split(_col(module), "/"))
    steps = F.aggregate(
        segments, F.array().cast("array<string>"),
        lambda done, s: F.when((s == "") | (s == "."), done).when(s == "..", F.when(F.size(done) > 0, F.slice(done, F.lit(1), F.size(done) - 1)).otherwise(done)).otherwise(F.concat(done, F.array(s))),
    )
    return F.array_join(steps, "/")


def route_id(method, path) -> Column:
    return F.concat(F.lit("route."), F.regexp_replace(_col(path), "[^A-Za-z0-9]", "_"), F.lit("."), F.upper(_col(method)))


def joined_route(prefix, path) -> Column:
    """Both parts with single slashes between and one in front."""
    parts = F.filter(F.split(F.concat(_col(prefix), F.lit("/"), _col(path)), "/+"), lambda p: p != "")
    return F.concat(F.lit("/"), F.array_join(parts, "/"))


def unsafe_path_reason(path) -> Column:
    """Why a stored path is not relative to the repository, or null."""
    p = _col(path)
    segments = F.split(p, "/")
    return (
        F.when(p == "", "empty").when(F.instr(p, "\0") > 0, "nul byte").when(F.instr(p, "\\") > 0, "backslash")
        .when(p.startswith("/"), "absolute").when(p.rlike("^[A-Za-z]:"), "drive prefix")
        .when(F.array_contains(segments, ".") | F.array_contains(segments, ".."), "dot segment").when(F.array_contains(segments, ""), "empty segment")
    )


def language_family(path) -> Column:
    """Languages that call each other count as one family."""
    e = extension(path)
    return (
        F.when(e.isin("ts", "tsx", "mts", "cts", "js", "jsx", "mjs", "cjs"), "script").when(e.isin("kt", "kts", "java"), "jvm")
        .when(e.isin("c", "h", "cpp", "cc", "cxx", "hpp", "hh", "hxx"), "c").when(e.isin("py", "pyi"), "python").otherwise(e)
    )


def display_label(id_, name, file_path, line) -> Column:
    """`container.name (file:line)`; the container is left out where it repeats the name or the file's stem."""
    before = F.try_element_at(F.split(_col(id_), r"\."), F.lit(-2))
    shown = before.isNotNull() & (before != id_segment(name)) & (before != id_segment(file_stem(file_path)))
    return F.concat(F.when(shown, F.concat(before, F.lit("."))).otherwise(""), _col(name), F.lit(" ("), _col(file_path), F.lit(":"), _col(line).cast("string"), F.lit(")"))


def receiver(text) -> Column:
    """struct<kind, name> of what stands before the last dot of a call."""
    t = F.trim(_col(text))
    plain = F.regexp_extract(t, r"^(?:self|this)\.([A-Za-z_$][A-Za-z0-9_$]*)$", 1)
    kind = F.when(t.isNull() | (t == ""), "Bare").when(t.isin("self", "this"), "SelfThis").when(t.isin("super", "super()"), "Super").when(plain != "", "Field").otherwise("Named")
    return F.struct(kind.alias("kind"), F.when(kind == "Field", plain).when(kind == "Named", t).alias("name"))


def hub_score(pagerank, fan_in, fan_out) -> Column:
    return F.log1p(_col(fan_in).cast("double")) * F.log1p(_col(fan_out).cast("double")) + _col(pagerank)


def risk(fan_in, complexity, tested) -> Column:
    """Exposure times complexity; doubled without a resolved test."""
    exposure = F.greatest(F.log1p(_col(fan_in).cast("double")), F.lit(0.35))
    return exposure * (1 + _col(complexity) / 10) * F.when(_col(tested) == "Resolved", 1.0).otherwise(2.0)


def risk_tier(value) -> Column:
    return F.when(_col(value) >= 6, "HIGH").when(_col(value) >= 2.5, "MED").otherwise("LOW")


def embed_text(name, label, file_path, text) -> Column:
    return F.concat(_col(name), F.lit(" "), _col(label), F.lit(" in "), _col(file_path), F.lit("\n"), F.substring(F.coalesce(_col(text), F.lit("")), 1, 2000))


def dot(a, b) -> Column:
    """Over the shorter of both lengths, in double precision."""
    pairs = F.zip_with(_col(a), _col(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))


def norm(a) -> Column:
    return F.sqrt(F.aggregate(_col(a), F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a, b) -> Column:
    size = norm(a) * norm(b)
    return F.when(size > 0, dot(a, b) / size).otherwise(0.0)


def normalised(a) -> Column:
    """L2-normalised; a zero vector stays as it is. The length is computed once, not for each element."""
    own = _col(a)
    return F.transform(F.array(norm(a)), lambda n: F.when(n > 0, F.transform(own, lambda x: (x.cast("double") / n).cast("float"))).otherwise(own))[0]


def search_terms(query: str, least: int = 3, most: int = 8) -> list[str]:
    """Distinct words of a query, in order, in lower case."""
    import re

    words = [w.lower() for w in re.split(r"\W+", query) if len(w) >= least]
    return list(dict.fromkeys(words))[:most]


def register(spark: SparkSession) -> None:
    """wg_subwords, wg_leaf_name and wg_is_test_path for SQL, as SQL functions that Catalyst inlines."""
    cut = lambda p: "r'" + p + "'"
    words = ", ".join(f"'{w}'" for w in TEST_WORDS)
    for name, kind, body in (
        ("wg_leaf_name", "STRING", "element_at(split(element_at(split(name, '::'), -1), '[.]'), -1)"),
        ("wg_is_test_path", "BOOLEAN", f"arrays_overlap(transform(split(name, {cut(_CUTS)}), p -> lower(p)), array({words}))"),
        ("wg_subwords", "STRING", f"if(size(filter(split(name, {cut(_CUTS + _DIGITS)}), p -> p <> '')) <= 1, '', lower(array_join(filter(split(name, {cut(_CUTS + _DIGITS)}), p -> p <> ''), ' ')))"),
    ):
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(name STRING) RETURNS {kind} RETURN {body}")
