"""Incremental indexing: what changed, what that touches, and whether a partial run gives what a full one would."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def changes(listing: DataFrame, manifest: DataFrame) -> DataFrame:
    """(file_path, sha256, mtime, state) of the listing against the manifest.

    same: equal time; refreshed: equal content with another time; parse: new or changed; vanished: no longer listed.
    """
    now = listing.select("file_path", "sha256", "mtime")
    then = manifest.select("file_path", F.col("sha256").alias("old_sha"), F.col("mtime").alias("old_mtime"))
    joined = now.join(then, "file_path", "full_outer")
    state = F.when(F.col("sha256").isNull(), "vanished").when(F.col("mtime") == F.col("old_mtime"), "same").when(F.col("sha256") == F.col("old_sha"), "refreshed").otherwise("parse")
    return joined.select("file_path", "sha256", "mtime", state.alias("state"))


def file_shapes(nodes: DataFrame, others: dict[str, DataFrame]) -> DataFrame:
    """(file_path, functions map name -> signature, rest): definitions, and everything beside function bodies in one text."""
    functions = nodes.where("label IN ('Function', 'Method')").groupBy("file_path").agg(F.map_from_entries(F.array_sort(F.collect_set(F.struct("id", F.concat_ws("|", "name", "label"))))).alias("functions"))
    items = nodes.where("label NOT IN ('Function', 'Method', 'File')").select("file_path", F.concat_ws("|", F.lit("node"), "id", "label").alias("item"))
    for kind, frame in others.items():
        columns = [c for c in frame.columns if c not in ("file_path", "line")]
        items = items.unionByName(frame.select("file_path", F.concat_ws("|", F.lit(kind), *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns)).alias("item")))
    rest = items.groupBy("file_path").agg(F.array_join(F.array_sort(F.collect_set("item")), "\n").alias("rest"))
    return functions.join(rest, "file_path", "full_outer")


def shape_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(file_path, body_only, dirty names, beyond): which definitions came or went, and whether more than functions changed."""
    a, b = (s.select("file_path", F.col("functions").alias(f"f_{n}"), F.col("rest").alias(f"r_{n}")) for s, n in ((old, "old"), (new, "new")))
    joined = a.join(b, "file_path", "full_outer")
    entries = lambda c: F.coalesce(F.map_entries(c), F.array().cast("array<struct<key:string,value:string>>"))
    lost, came = F.array_except(entries("f_old"), entries("f_new")), F.array_except(entries("f_new"), entries("f_old"))
    dirty = F.array_distinct(F.transform(F.concat(lost, came), lambda e: F.split(e["value"], r"\|")[0]))
    beyond = ~F.col("r_old").eqNullSafe(F.col("r_new"))
    return joined.select("file_path", (F.size(dirty) == 0).alias("same_functions"), dirty.alias("dirty"), beyond.alias("beyond")).withColumn("body_only", F.col("same_functions") & ~F.col("beyond"))


def wave(changed: DataFrame, dirty: DataFrame, calls: DataFrame) -> DataFrame:
    """Changed files and those with a site that names a dirty definition (column name)."""
    near = calls.join(dirty.select(F.col("name").alias("leaf_name")).distinct(), "leaf_name", "left_semi").select("file_path")
    return changed.select("file_path").union(near).distinct()


def partial_allowed(shapes: DataFrame, inherits: DataFrame, vanished: DataFrame, files: int, full: bool, compiler_edges: bool, most_share: float = 0.5) -> tuple[bool, str]:
    """(whether a partial run is safe, why not)."""
    if full:
        return False, "a full run was asked for"
    if compiler_edges:
        return False, "compiler edges have to be merged again"
    if not vanished.isEmpty():
        return False, "files vanished"
    if not shapes.where("beyond").isEmpty():
        return False, "more than functions changed"
    if shapes.count() > most_share * max(files, 1):
        return False, "most files changed"
    names = shapes.select(F.explode("dirty").alias("name")).distinct()
    touched = names.join(inherits.select(F.col("super_name").alias("name")).union(inherits.select("impl_name")).distinct(), "name", "left_semi")
    return (False, "an inherited name changed") if not touched.isEmpty() else (True, "")


def merged_edges(old: DataFrame, fresh: DataFrame, files: DataFrame) -> DataFrame:
    """Edges after a partial run: those of other files, and the fresh ones of the files in the wave."""
    kept = old.join(files.select(F.col("file_path").alias("src_file")).distinct(), "src_file", "left_anti")
    return kept.unionByName(fresh, allowMissingColumns=True)
