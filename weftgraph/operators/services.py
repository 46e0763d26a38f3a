"""Dead code, review of a change, renaming: answers put together from evidence."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.scalars import is_test_path, risk, risk_tier
from ..work import stored
from .coverage import test_evidence
from .lookups import degrees

#: Names that a runtime calls by convention; `run` is none of them here, as it is a plain name in most code.
EXCLUDED_NAMES = ("main", "init", "new", "setup", "constructor")
#: Reference kinds that stand where a symbol is defined.
DEFINITION_KINDS = ("public_export", "ffi_export", "macro_registration", "framework_registration")


def dead_code(nodes: DataFrame, edges: DataFrame, calls: DataFrame) -> DataFrame:
    """Functions and methods outside tests that no edge, and no call site of their name, leads to."""
    own = nodes.where("label IN ('Function', 'Method')").where(~is_test_path("file_path"))
    if "is_test" in nodes.columns:
        own = own.where("is_test IS NULL")
    called = edges.where("relation IN ('Calls', 'Tests')").select(F.col("dst").alias("id"))
    named = calls.select(F.col("leaf_name").alias("name")).distinct()
    return own.join(called, "id", "left_anti").join(named, "name", "left_anti").select("id", "name", "file_path", "line_start")


def dead_code_batch(nodes: DataFrame, edges: DataFrame, calls: DataFrame, limit: int = 100, offset: int = 0) -> DataFrame:
    return dead_code(nodes, edges, calls).orderBy("file_path", "line_start", "id").offset(offset).limit(limit)


def dead_code_assessed(nodes: DataFrame, edges: DataFrame, calls: DataFrame, refs: DataFrame, handlers: DataFrame) -> DataFrame:
    """Each unreached function with its class: excluded, candidate, unknown or indirectly_referenced.

    A reference at a definition counts only in the file of the function. handlers: ids of route handlers.
    """
    own = dead_code(nodes, edges, calls)
    near = refs.select(F.col("leaf_name").alias("name"), "kind", F.col("file_path").alias("ref_file"))
    seen = own.select("id", "name", "file_path").join(near, "name").where(~F.col("kind").isin(*DEFINITION_KINDS) | (F.col("ref_file") == F.col("file_path")))
    kinds = seen.groupBy("id").agg(F.collect_set("kind").alias("kinds"))
    joined = own.join(kinds, "id", "left").join(handlers.select("id").distinct().withColumn("h", F.lit(1)), "id", "left")
    only = lambda kind: F.array_except("kinds", F.array(F.lit(kind))) == F.array().cast("array<string>")
    verdict = (
        F.when(F.col("name").isin(*EXCLUDED_NAMES), "excluded").when(F.col("h") == 1, "indirectly_referenced").when(F.col("kinds").isNull(), "candidate")
        .when(only("unknown_indirect") | only("public_export"), "unknown").otherwise("indirectly_referenced")
    )
    return joined.select("id", "name", "file_path", "line_start", verdict.alias("verdict"))


def review_rows(nodes: DataFrame, edges: DataFrame, calls: DataFrame, changed: DataFrame) -> DataFrame:
    """Symbols of the changed paths (column file_path) with fan-in, tests, risk and tier, the riskiest first."""
    own = nodes.where("label IN ('Function', 'Method')").join(changed.select("file_path").distinct(), "file_path", "left_semi")
    complexity = F.coalesce(F.col("complexity"), F.lit(1)) if "complexity" in nodes.columns else F.lit(1)
    # Only what leads to these symbols, and sites of their names, is looked at.
    wanted = stored(nodes.sparkSession, own.select("id", "name", "label"), "review")
    led = edges.join(wanted.select(F.col("id").alias("dst")), "dst", "left_semi")
    sites = calls.join(wanted.select(F.col("name").alias("leaf_name")).distinct(), "leaf_name", "left_semi")
    fans = degrees(led).join(wanted, "id", "left_semi").select("id", "fan_in")
    joined = own.join(fans, "id", "left").join(test_evidence(wanted, led, sites), "id", "left").fillna({"fan_in": 0, "evidence": "None"})
    value = risk("fan_in", complexity, "evidence")
    return joined.select("id", "name", "file_path", "fan_in", "evidence", value.alias("risk"), risk_tier(value).alias("tier")).orderBy(F.desc("risk"), "id")


def vanished_symbols(base: DataFrame, nodes: DataFrame, renames: DataFrame, changed: DataFrame) -> DataFrame:
    """Symbols of the base revision (name, file_path) that are gone: with their file, in a rename, or from a file that stayed.

    renames: (old_path, new_path); changed: (file_path, kind) with kind A, M, D, R or C.
    """
    moved = base.join(renames.select(F.col("old_path").alias("file_path"), "new_path"), "file_path", "left").withColumn("now", F.coalesce("new_path", "file_path"))
    here = nodes.select("name", F.col("file_path").alias("now"), F.lit(1).alias("here")).distinct()
    gone = moved.join(here, ["name", "now"], "left").where("here IS NULL")
    deleted = changed.where("kind = 'D'").select("file_path", F.lit(1).alias("deleted")).distinct()
    kind = F.when(F.col("deleted") == 1, "FileDeleted").when(F.col("new_path").isNotNull(), "LostInRename").otherwise("RemovedFromFile")
    return gone.join(deleted, "file_path", "left").select("name", "file_path", kind.alias("disposition"))


def review_hints(cochanges: DataFrame, changed: DataFrame, least: int = 3) -> DataFrame:
    """Files that usually change with a changed one but did not."""
    own = changed.select("file_path").distinct()
    both = cochanges.select(F.col("file_a").alias("file_path"), F.col("file_b").alias("other"), "n").union(cochanges.select("file_b", "file_a", "n"))
    near = both.join(own, "file_path", "left_semi").join(own.select(F.col("file_path").alias("other")), "other", "left_anti")
    return near.where(F.col("n") >= least).groupBy("other").agg(F.max("n").alias("n")).orderBy(F.desc("n"), "other")


def parse_name_status(output: bytes) -> list[tuple[str, str, str]]:
    """(kind, path, old path) rows of NUL-separated `git diff --name-status -z`; renames and copies carry two paths."""
    parts = [p.decode("utf-8", "replace") for p in output.split(b"\0") if p]
    rows, i = [], 0
    while i < len(parts):
        kind = parts[i][:1]
        if kind in "RC" and i + 2 < len(parts):
            rows.append((kind, parts[i + 2], parts[i + 1]))
            i += 3
        elif i + 1 < len(parts):
            rows.append((kind, parts[i + 1], parts[i + 1]))
            i += 2
        else:
            break
    return rows


def identifier_spans(text: str, name: str) -> list[tuple[int, int]]:
    """Places of a name as a whole identifier."""
    return [m.span() for m in re.finditer(rf"(?<![\w$]){re.escape(name)}(?![\w$])", text)]


def rename_plan(spark: SparkSession, nodes: DataFrame, coverage: DataFrame, files: DataFrame, old: str, new: str, accounted: DataFrame) -> tuple[list, str | None]:
    """(edits, reason against): only with one definition, complete coverage and every identifier accounted for.

    files: (file_path, text); accounted: (file_path, n) identifiers that definition, calls, imports and references explain.
    """
    if nodes.where(F.col("name") == old).where("label NOT IN ('File', 'Document')").limit(2).count() != 1:
        return [], "not exactly one definition"
    if not coverage.where(F.col("callee_name") == old).where("dropped > 0").isEmpty():
        return [], "unresolved call sites"
    pattern = rf"(?<![\w$]){re.escape(old)}(?![\w$])"
    found = files.where(F.col("text").rlike(pattern)).select("file_path", F.regexp_count("text", F.lit(pattern)).alias("found"), F.regexp_replace("text", pattern, re.sub(r"([\\$])", r"\\\1", new)).alias("text"))
    loose = found.join(accounted, "file_path", "left").where("found <> coalesce(n, 0)")
    if not loose.isEmpty():
        return [], "identifiers that the graph does not explain"
    return [tuple(r) for r in found.select("file_path", "found", "text").collect()], None


def staleness(listing: DataFrame, manifest: DataFrame) -> DataFrame:
    """(file_path, state): added, removed or touched since the manifest was written."""
    now, then = listing.select("file_path", F.col("mtime").alias("now")), manifest.select("file_path", F.col("mtime").alias("then"))
    joined = now.join(then, "file_path", "full_outer")
    state = F.when(F.col("then").isNull(), "added").when(F.col("now").isNull(), "removed").when(F.col("now") != F.col("then"), "touched")
    return joined.select("file_path", state.alias("state")).where("state IS NOT NULL")


