"""Evidence and coverage: how much of what the text says about a name the resolved graph accounts for."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.scalars import extension, is_test_path
from ..schema import SCRIPT_EXTENSIONS
from .lookups import nearest_definition


def external_bound(calls: DataFrame, imports: DataFrame) -> DataFrame:
    """Call sites in scripts whose callee, or named receiver, is imported from another package; each row once.

    The two ways are two equi-joins, not one join with an OR.
    """
    outer = imports.where(~F.substring("module", 1, 1).isin(".", "/", "#")).select("file_path", F.col("name").alias("imported")).distinct()
    own = calls.where(extension("file_path").isin(*SCRIPT_EXTENSIONS))
    by_name = own.join(outer, (own["file_path"] == outer["file_path"]) & (own["callee_name"] == outer["imported"]), "left_semi")
    rest = own.where(F.col("receiver_name").isNotNull())
    by_receiver = rest.join(outer, (rest["file_path"] == outer["file_path"]) & (rest["receiver_name"] == outer["imported"]) & (rest["callee_name"] != rest["receiver_name"]), "left_semi")
    both = by_name.unionByName(by_receiver.join(outer, (by_receiver["file_path"] == outer["file_path"]) & (by_receiver["callee_name"] == outer["imported"]), "left_anti"))
    return both


def not_external(calls: DataFrame, imports: DataFrame) -> DataFrame:
    outer = imports.where(~F.substring("module", 1, 1).isin(".", "/", "#")).select("file_path", F.col("name").alias("imported")).distinct()
    script = extension(calls["file_path"]).isin(*SCRIPT_EXTENSIONS)
    kept = calls.join(outer, script & (calls["file_path"] == outer["file_path"]) & (calls["callee_name"] == outer["imported"]), "left_anti")
    return kept.join(outer, extension(kept["file_path"]).isin(*SCRIPT_EXTENSIONS) & (kept["file_path"] == outer["file_path"]) & (kept["receiver_name"] == outer["imported"]), "left_anti")


def resolved_pairs(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(caller_id, callee_name) of unambiguous calls."""
    calls = edges.where("relation = 'Calls' AND confidence <> 'Ambiguous'")
    return calls.join(nodes.select(F.col("id").alias("dst"), "name"), "dst").select(F.col("src").alias("caller_id"), F.col("name").alias("callee_name")).distinct()


def _tally(sites: DataFrame, resolved: DataFrame, *by: str) -> DataFrame:
    marked = sites.join(resolved.withColumn("hit", F.lit(1)), ["caller_id", "callee_name"], "left")
    out = marked.groupBy(*by).agg(F.count(F.lit(1)).alias("total"), F.count("hit").alias("resolved"))
    return out.withColumn("dropped", F.greatest(F.col("total") - F.col("resolved"), F.lit(0)))


def coverage_for_callers(nodes: DataFrame, edges: DataFrame, calls: DataFrame, imports: DataFrame, name: str | None = None) -> DataFrame:
    """Per callee name (or for one): call sites not bound to another package, those resolved, and the rest."""
    sites = not_external(calls if name is None else calls.where(F.col("callee_name") == name), imports)
    return _tally(sites, resolved_pairs(nodes, edges), "callee_name")


def resolvable(nodes: DataFrame, calls: DataFrame, imports: DataFrame) -> DataFrame:
    names = nodes.where("label IN ('Function', 'Method', 'Class')").select(F.col("name").alias("callee_name")).distinct()
    return not_external(calls, imports).join(names, "callee_name", "left_semi")


def coverage_for_callees(nodes: DataFrame, edges: DataFrame, calls: DataFrame, imports: DataFrame, caller: str | None = None) -> DataFrame:
    """Per caller: its sites that name something of this repository, those resolved, and the rest."""
    own = calls if caller is None else calls.where(F.col("caller_id") == caller)
    return _tally(resolvable(nodes, own, imports), resolved_pairs(nodes, edges), "caller_id")


def external_bound_count(calls: DataFrame, imports: DataFrame) -> DataFrame:
    return external_bound(calls, imports).agg(F.count(F.lit(1)).alias("n"))


def unresolved_callee_names(nodes: DataFrame, edges: DataFrame, calls: DataFrame, imports: DataFrame) -> DataFrame:
    """(caller_id, callee_name) that name something here, are no route and lead to no edge."""
    sites = resolvable(nodes, calls.where(~F.col("callee_name").startswith("route.")), imports)
    return sites.select("caller_id", "callee_name").distinct().join(resolved_pairs(nodes, edges), ["caller_id", "callee_name"], "left_anti")


def unresolved_site_files(nodes: DataFrame, calls: DataFrame, imports: DataFrame, name: str, attribute_to: str | None = None) -> DataFrame:
    """Files with a site of that name that do not define it; on demand those nearest to one definition."""
    own = nodes.where(F.col("name") == name)
    files = not_external(calls.where(F.col("callee_name") == name), imports).select("file_path").distinct().join(own.select("file_path").distinct(), "file_path", "left_anti")
    if attribute_to is None:
        return files
    near = nearest_definition(files.withColumn("name", F.lit(name)), own)
    return near.where(F.col("id") == attribute_to).select(F.col("site").alias("file_path"))


def type_usages(name: str, calls: DataFrame, refs: DataFrame, inherits: DataFrame, fields: DataFrame, variables: DataFrame, imports: DataFrame, type_refs: DataFrame) -> DataFrame:
    """Files that use the name, each with the alphabetically first kind of evidence."""
    parts = [
        (calls, "callee_name", "call"), (calls, "receiver_name", "receiver"), (refs, "leaf_name", "reference"), (inherits, "super_name", "inherits"),
        (fields, "type_name", "field"), (variables, "type_name", "local"), (imports, "name", "import"), (type_refs, "type_name", "type"),
    ]
    frames = [df.where(F.col(column) == name).select("file_path", F.lit(kind).alias("evidence")) for df, column, kind in parts if df is not None]
    whole = frames[0]
    for frame in frames[1:]:
        whole = whole.union(frame)
    return whole.groupBy("file_path").agg(F.min("evidence").alias("evidence"))


def test_evidence(nodes: DataFrame, edges: DataFrame, calls: DataFrame) -> DataFrame:
    """Per function or method: Resolved (a Tests edge), TextualOnly (a site in a test file), None."""
    own = nodes.where("label IN ('Function', 'Method')").select("id", "name")
    resolved = edges.where("relation = 'Tests'").select(F.col("dst").alias("id")).distinct().withColumn("r", F.lit(1))
    textual = calls.where(is_test_path("file_path")).select(F.col("leaf_name").alias("name")).distinct().withColumn("t", F.lit(1))
    joined = own.join(resolved, "id", "left").join(textual, "name", "left")
    return joined.select("id", F.when(F.col("r") == 1, "Resolved").when(F.col("t") == 1, "TextualOnly").otherwise("None").alias("evidence"))


def file_coverage(files: DataFrame, nodes: DataFrame, manifest: DataFrame) -> DataFrame:
    symbols = nodes.where("label <> 'File'").select("file_path").distinct().withColumn("s", F.lit(1))
    known = manifest.select("file_path").distinct().withColumn("m", F.lit(1))
    joined = files.join(symbols, "file_path", "left").join(known, "file_path", "left")
    return joined.select("file_path", F.when(F.col("s") == 1, "IndexedWithSymbols").when(F.col("m") == 1, "IndexedWithoutSymbols").otherwise("NotIndexed").alias("coverage"))


def audit(edges: DataFrame, oracle: DataFrame) -> DataFrame:
    """Per justification: syntactic edges whose source the oracle covers, those it confirms, and their share."""
    covered = oracle.select("src").distinct()
    own = edges.where("relation = 'Calls'").join(covered, "src", "left_semi").join(oracle.select("src", "dst").distinct().withColumn("hit", F.lit(1)), ["src", "dst"], "left")
    out = own.groupBy("justification").agg(F.count(F.lit(1)).alias("verifiable"), F.count("hit").alias("confirmed"))
    return out.withColumn("precision", F.col("confirmed") / F.col("verifiable"))


def sample_indices(seed: int, population: int, size: int) -> list[int]:
    """Distinct indices below population from a 64-bit xorshift sequence (shifts 13, 7, 17), for spot audits."""
    state, found = seed or 1, []
    mask = (1 << 64) - 1
    while len(found) < min(size, population):
        state ^= (state << 13) & mask
        state ^= state >> 7
        state ^= (state << 17) & mask
        if (index := state % population) not in found:
            found.append(index)
    return found
