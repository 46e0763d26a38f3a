"""From source text to a committed graph: parse, resolve, rank and store; refresh() for changed files only."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators import graph, incremental, resolution, vectors
from ..operators.lookups import cochange_pairs, defines_edges, degrees, without_dangling
from ..sources.files import document_nodes
from ..sources.parser import parsed
from ..store import GraphStore
from ..work import stored

TABLES = ("nodes", "calls", "symbol_refs", "inherits", "fields", "imports", "locals", "type_refs")


def evidence(store: GraphStore, files: DataFrame, project: str) -> None:
    """Parse the files and let their rows replace what the store has of them."""
    found = parsed(files, project)
    for name in TABLES:
        rows = found[name].dropDuplicates(["id"]) if name == "nodes" else found[name]
        store.save_by_file(name, rows, files)


def _edges(store: GraphStore, ambiguous: bool, files: DataFrame | None = None) -> DataFrame:
    """Edges by syntax: of all files, or of those with their source in some files."""
    t = store.table
    nodes = t("nodes")
    calls = resolution.call_edges(store.spark, nodes, t("calls"), t("inherits"), t("fields"), t("locals"), t("imports"), ambiguous, files)
    inheritance = resolution.inheritance_edges(nodes, t("inherits")).withColumns({"tier": F.lit("TreeSitter"), "confidence": F.lit("Extracted")})
    rest = inheritance.unionByName(defines_edges(nodes), allowMissingColumns=True)
    if files is not None:
        rest = rest.join(files.select(F.col("file_path").alias("src_file")).distinct(), "src_file", "left_semi")
    return calls.unionByName(rest, allowMissingColumns=True)


def resolve(store: GraphStore, ambiguous: bool = False, files: DataFrame | None = None) -> None:
    """All edges from the stored evidence; with files those of these files, beside what the store has of the others."""
    edges = _edges(store, ambiguous, files)
    if files is not None:
        edges = incremental.merged_edges(store.table("edges"), edges, files)
    compiler = store.table("edges").where("tier = 'Scip'")
    store.replace("edges", without_dangling(store.table("nodes"), resolution.superseded(edges, compiler)))
    store.replace("hyperedges", resolution.implementer_hyperedges(store.table("edges")))


def _listing(files: DataFrame) -> DataFrame:
    """(file_path, text, sha256, mtime); what is missing is computed from the text."""
    if "sha256" not in files.columns:
        files = files.withColumn("sha256", F.sha2(F.coalesce("text", F.lit("")), 256))
    return files if "mtime" in files.columns else files.withColumn("mtime", F.xxhash64("sha256"))


def _shapes(store: GraphStore, files: DataFrame) -> DataFrame:
    own = lambda name: store.table(name).join(files.select("file_path").distinct(), "file_path", "left_semi")
    return incremental.file_shapes(own("nodes"), {name: own(name) for name in ("inherits", "fields", "imports", "type_refs")})


def refresh(store: GraphStore, files: DataFrame, project: str, full: bool = False, ambiguous: bool = False, analytics: bool = True) -> str:
    """Bring the store up to a listing of all files (file_path, text and, if known, sha256 and mtime) and commit.

    Files are parsed where their content changed, and forgotten where they vanished. Only sites that the change can touch
    are resolved again where that gives what a full run would. Returns unchanged, partial, or full and the reason.
    """
    spark, listing = store.spark, _listing(files)
    state = stored(spark, incremental.changes(listing, store.table("manifest")), "changes")
    parse, vanished = state.where("state = 'parse'"), state.where("state = 'vanished'")
    touched = state.where("state IN ('parse', 'refreshed')").select("file_path", "sha256", "mtime")
    if touched.isEmpty() and vanished.isEmpty():
        return "unchanged"
    outcome = "unchanged"
    if not (parse.isEmpty() and vanished.isEmpty()):
        before = stored(spark, _shapes(store, parse), "shapes")
        evidence(store, listing.join(parse.select("file_path"), "file_path", "left_semi"), project)
        if not vanished.isEmpty():
            store.delete_files(vanished)
            store.delete_files(vanished, ("manifest",))
        shapes = stored(spark, incremental.shape_changes(before, _shapes(store, parse)), "shapes")
        compiler = not store.table("edges").where("tier = 'Scip'").isEmpty()
        fine, why = incremental.partial_allowed(shapes, store.table("inherits"), vanished, state.count(), full, compiler)
        if fine:
            dirty = shapes.select(F.explode("dirty").alias("name"))
            resolve(store, ambiguous, stored(spark, incremental.wave(parse, dirty, store.table("calls")), "wave"))
        else:
            resolve(store, ambiguous)
        outcome = "partial" if fine else f"full: {why}"
        if analytics:
            analyse(store)
    store.upsert("manifest", touched)
    store.commit()
    return outcome


def analyse(store: GraphStore) -> None:
    nodes, edges = store.table("nodes"), store.table("edges")
    store.update_analytics(graph.analyse(store.spark, nodes.select("id"), edges).join(degrees(edges), "id", "left"))


def index(store: GraphStore, files: DataFrame, project: str, analytics: bool = True) -> int:
    """Index the files (file_path, text) and commit; returns the generation."""
    evidence(store, files, project)
    resolve(store)
    if analytics:
        analyse(store)
    store.upsert("manifest", _listing(files).select("file_path", "sha256", "mtime"))
    return store.commit()


def ingest(store: GraphStore, documents: DataFrame) -> int:
    """Documents (source, text) as searchable nodes, one for each chunk; those of a source replace its earlier ones."""
    own = document_nodes(documents).withColumn("metadata", F.create_map(F.lit("text"), F.col("text"), F.lit("content_type"), F.lit("text")))
    rows = own.withColumn("doc_text", F.substring("text", 1, 8000)).drop("text")
    store.save_by_file("nodes", rows, documents.select(F.col("source").alias("file_path")))
    return store.commit()


def history(store: GraphStore, commits: DataFrame) -> int:
    """Files that change together, from (commit_id, file_path) rows."""
    store.replace("cochanges", cochange_pairs(commits))
    return store.commit()


def embed(store: GraphStore, embedder: vectors.Embedder, model: str, changed: DataFrame | None = None) -> int:
    """Vectors of all nodes but files, or of those in changed files (file_path), stamped with the model's name.

    Another model than the stamped one embeds everything again.
    """
    nodes = store.table("nodes").withColumn("text", F.try_element_at("metadata", F.lit("text")))
    if changed is not None and store.meta("embed_model") == model:
        nodes = nodes.join(changed.select("file_path").distinct(), "file_path", "left_semi")
        fresh = vectors.embedded(nodes, embedder)
        old = store.table("vectors").join(fresh.select("id"), "id", "left_anti").join(store.table("nodes").select("id"), "id", "left_semi")
        store.replace("vectors", old.unionByName(fresh))
    else:
        store.replace("vectors", vectors.embedded(nodes, embedder))
    store.set_meta("embed_model", model)
    return store.commit()
