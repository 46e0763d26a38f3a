"""Registered queries of the versioned store, of incremental indexing, and of the answers over a stored graph.

Each opens a store of its own in the shared work folder.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from .fixtures_graph import Tables
from .operators import incremental, lookups, search, vectors
from .plans import indexing
from .plans.navigation import Navigator
from .registry import query
from .store import GraphStore
from .work import shared_dir


def _store(spark: SparkSession) -> GraphStore:
    return GraphStore(spark, f"{shared_dir(spark)}/store-{uuid.uuid4().hex}")


def _node_rows(t: Tables, name: str = "concat('fn_', s)", where: str = "true") -> DataFrame:
    return t.sup().where(where).selectExpr("concat('fn.', s) AS id", f"{name} AS name", "'Function' AS label", "concat('f', s % 9) AS file_path", "CAST(s AS INT) AS line_start")


def _edge_rows(t: Tables, line: str = "1", where: str = "true", tier: str = "TreeSitter") -> DataFrame:
    return t.sup().where(where).selectExpr("concat('fn.', s) AS src", "concat('fn.', s + 1) AS dst", "'Calls' AS relation", f"'{tier}' AS tier", "concat('f', s % 9) AS src_file", f"CAST({line} AS INT) AS src_line")


@query("SELECT 'fn.' || s AS id, CASE WHEN s % 2 = 0 THEN 'late_' || s ELSE 'fn_' || s END AS name FROM sup")
def store_upsert_nodes(spark, sf):
    """New rows replace old ones of their key; of several new ones the last by order stays."""
    t, store = Tables(spark, sf), _store(spark)
    store.upsert("nodes", _node_rows(t))
    store.commit()
    early, late = (_node_rows(t, f"concat('{n}_', s)", "s % 2 = 0").withColumn("seq", F.lit(i)) for i, n in enumerate(("early", "late")))
    store.upsert("nodes", late.unionByName(early), order="seq")
    store.commit()
    return store.table("nodes").select("id", "name")


@query("SELECT 'fn.' || s AS src, 'fn.' || (s + 1) AS dst, CASE WHEN s % 3 = 0 THEN 2 ELSE 1 END AS src_line FROM sup")
def store_upsert_edges(spark, sf):
    t, store = Tables(spark, sf), _store(spark)
    store.upsert("edges", _edge_rows(t))
    store.upsert("edges", _edge_rows(t, "2", "s % 3 = 0"))
    store.commit()
    return store.table("edges").select("src", "dst", "src_line")


@query("SELECT 'fn.' || s AS src, CASE WHEN s % 3 = 0 THEN 1 ELSE 2 END AS src_line FROM sup")
def store_keep_existing(spark, sf):
    t, store = Tables(spark, sf), _store(spark)
    store.upsert("edges", _edge_rows(t, where="s % 3 = 0"))
    store.upsert("edges", _edge_rows(t, "2"), keep_existing=True)
    store.commit()
    return store.table("edges").select("src", "src_line")


@query("SELECT 'fn.' || s AS caller_id, CASE WHEN s % 9 < 4 THEN 'new' ELSE 'old' END AS callee_name FROM sup WHERE NOT (s % 9 < 4 AND s % 2 = 1)")
def store_save_by_file(spark, sf):
    """The rows of four files are replaced, by fewer than there were."""
    t, store = Tables(spark, sf), _store(spark)
    rows = lambda name, where: t.sup().where(where).selectExpr("concat('fn.', s) AS caller_id", f"'{name}' AS callee_name", "1 AS line", "concat('f', s % 9) AS file_path")
    store.replace("calls", rows("old", "true"))
    store.commit()
    store.save_by_file("calls", rows("new", "s % 9 < 4 AND s % 2 = 0"), t.sup().where("s % 9 < 4").selectExpr("concat('f', s % 9) AS file_path"))
    store.commit()
    return store.table("calls").select("caller_id", "callee_name")


@query("SELECT kind, id FROM (SELECT s, 'node' AS kind, 'fn.' || s AS id FROM sup UNION ALL SELECT s, 'vector', 'fn.' || s FROM sup UNION ALL SELECT s, 'import', 'x' || s FROM sup) WHERE s % 9 <> 2")
def store_delete_file(spark, sf):
    """Everything of one file goes: its nodes, their vectors and its rows in the other tables."""
    t, store = Tables(spark, sf), _store(spark)
    store.replace("nodes", _node_rows(t))
    store.replace("vectors", t.sup().selectExpr("concat('fn.', s) AS id", "array(1.0F, 2.0F) AS embedding"))
    store.replace("imports", t.sup().selectExpr("concat('f', s % 9) AS file_path", "concat('x', s) AS name", "'m' AS module"))
    store.commit()
    store.delete_files(spark.createDataFrame([("f2",)], "file_path string"))
    store.commit()
    parts = [store.table(n).select(F.lit(k).alias("kind"), F.col(c).alias("id")) for n, k, c in (("nodes", "node", "id"), ("vectors", "vector", "id"), ("imports", "import", "name"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("SELECT 'fn.' || s AS src FROM sup WHERE NOT (s % 9 = 1) AND NOT (s % 9 = 2 AND s % 2 = 0)")
def store_delete_edges(spark, sf):
    """All edges of one source file, and those of one tier of another."""
    t, store = Tables(spark, sf), _store(spark)
    store.replace("edges", _edge_rows(t, where="s % 2 = 0").unionByName(_edge_rows(t, where="s % 2 = 1", tier="Scip")))
    one = lambda f: spark.createDataFrame([(f,)], "file_path string")
    store.delete_edges(one("f1"))
    store.delete_edges(one("f2"), tier="TreeSitter")
    store.commit()
    return store.table("edges").select("src")


@query("SELECT 'f' || s AS file_path, CASE WHEN s % 2 = 0 THEN 'new' ELSE 'old' END AS sha256, CAST(s AS BIGINT) AS mtime FROM sup WHERE s % 5 <> 0")
def store_manifest(spark, sf):
    t, store = Tables(spark, sf), _store(spark)
    rows = lambda sha, where: t.sup().where(where).selectExpr("concat('f', s) AS file_path", f"'{sha}' AS sha256", "s AS mtime")
    store.upsert("manifest", rows("old", "true"))
    store.upsert("manifest", rows("new", "s % 2 = 0"))
    store.delete_files(t.sup().where("s % 5 = 0").selectExpr("concat('f', s) AS file_path"), ("manifest",))
    store.commit()
    return store.table("manifest")


@query("SELECT 'h' || (s % 4) AS id, count(*) AS n FROM sup WHERE s % 4 = 3 % 4 GROUP BY s % 4")
def store_hyperedges(spark, sf):
    """Members of a hyperedge are replaced as a whole; lookup by one of them."""
    t, store = Tables(spark, sf), _store(spark)
    members = lambda where: t.sup().where(where).groupBy((F.col("s") % 4).alias("h")).agg(F.collect_list(F.struct(F.concat(F.lit("fn."), "s").alias("node_id"), F.lit("member").alias("role"))).alias("members")).selectExpr("concat('h', h) AS id", "'Group' AS relation", "members")
    store.upsert("hyperedges", members("s < 4"))
    store.upsert("hyperedges", members("true"))
    store.commit()
    return store.hyperedges_for("fn.3").select("id", F.size("members").cast("long").alias("n"))


@query("SELECT 'fn.' || s AS id, CASE WHEN s % 2 = 0 THEN s % 5 END AS community, CASE WHEN s % 2 = 0 THEN s / 8.0 END AS pagerank FROM sup")
def store_analytics(spark, sf):
    t, store = Tables(spark, sf), _store(spark)
    store.replace("nodes", _node_rows(t))
    store.update_analytics(t.sup().where("s % 2 = 0").selectExpr("concat('fn.', s) AS id", "CAST(s % 5 AS INT) AS community", "CAST(s / 8.0D AS DOUBLE) AS pagerank"))
    store.commit()
    return store.table("nodes").select("id", "community", "pagerank")


@query("SELECT true AS same_for_any_order, true AS differs_with_content, true AS without_analytics")
def store_canonical_hash(spark, sf):
    t = Tables(spark, sf)
    first, second, third = _store(spark), _store(spark), _store(spark)
    for store, nodes in ((first, _node_rows(t)), (second, _node_rows(t).repartition(7).orderBy(F.desc("id"))), (third, _node_rows(t, "concat('fn_', s + 1)"))):
        store.replace("nodes", nodes)
        store.replace("edges", _edge_rows(t))
        store.commit()
    a, b, c = (s.canonical_hash() for s in (first, second, third))
    second.update_analytics(_node_rows(t).select("id", F.lit(0.5).alias("pagerank")))
    return spark.createDataFrame([(a == b, a != c, second.canonical_hash() == a)], "same_for_any_order boolean, differs_with_content boolean, without_analytics boolean")


@query("SELECT 3 AS generation, 'b' AS value, true AS refused, (SELECT count(*) FROM sup) AS nodes")
def store_generations(spark, sf):
    """Commits count generations, a rollback leaves no trace, and of two writers on one generation the second is refused."""
    t, store = Tables(spark, sf), _store(spark)
    store.replace("nodes", _node_rows(t))
    store.set_meta("key", "a")
    store.commit()
    store.replace("nodes", _node_rows(t).limit(0))
    store.set_meta("key", "lost")
    store.rollback()
    other = GraphStore(spark, store.root)
    store.set_meta("key", "b")
    store.commit()
    refused = False
    try:
        other.set_meta("key", "c")
        other.commit()
    except Exception:
        refused = True
    store.commit()
    again = GraphStore(spark, store.root)
    return again.table("nodes").agg(F.lit(again.generation).alias("generation"), F.lit(again.meta("key")).alias("value"), F.lit(refused).alias("refused"), F.count(F.lit(1)).alias("nodes"))


@query("SELECT 'r1/n' AS path, 'about ' || s AS summary FROM sup WHERE s = 1 UNION ALL SELECT 'r1', 'about ' || s FROM sup WHERE s = 2")
def store_contexts(spark, sf):
    t, store = Tables(spark, sf), _store(spark)
    store.replace("contexts", t.sup().selectExpr("CASE s WHEN 1 THEN 'r1/n' WHEN 2 THEN 'r1' ELSE concat('z', s) END AS path", "concat('about ', s) AS summary", "s AS added_at"))
    store.commit()
    return store.contexts_for("r1/n7.ts").select("path", "summary")


@query("SELECT 'fn.' || s AS src, 'fn.' || (s + 1) AS dst FROM sup WHERE s + 1 IN (SELECT s FROM sup)")
def store_export_import(spark, sf):
    """An exported graph, checked and made current elsewhere; edges that lead nowhere do not come along."""
    t, store = Tables(spark, sf), _store(spark)
    store.replace("nodes", _node_rows(t))
    store.replace("edges", _edge_rows(t))
    store.commit()
    path = f"{store.root}-export"
    store.export(path)
    other = _store(spark)
    other.import_(path)
    return other.table("edges").select("src", "dst")


@query("SELECT 'nodes' AS \"table\", '../x' || s AS path, 'dot segment' AS reason FROM sup WHERE s % 3 = 0 UNION ALL SELECT 'manifest', '/y' || s, 'absolute' FROM sup WHERE s % 4 = 0")
def store_unsafe_paths(spark, sf):
    t, store = Tables(spark, sf), _store(spark)
    store.replace("nodes", _node_rows(t).withColumn("file_path", F.expr("CASE WHEN line_start % 3 = 0 THEN concat('../x', line_start) ELSE 'a/b' END")))
    store.replace("manifest", t.sup().selectExpr("CASE WHEN s % 4 = 0 THEN concat('/y', s) ELSE 'a/b' END AS file_path"))
    store.commit()
    return store.unsafe_paths()


@query("SELECT 'f' || s AS file_path, CASE s % 5 WHEN 0 THEN 'same' WHEN 1 THEN 'refreshed' WHEN 2 THEN 'parse' WHEN 3 THEN 'vanished' ELSE 'parse' END AS state FROM sup")
def change_scan(spark, sf):
    """Equal time: same; equal content: refreshed; changed or new: parse; no longer listed: vanished."""
    t = Tables(spark, sf)
    then = t.sup().where("s % 5 <> 4").selectExpr("concat('f', s) AS file_path", "'a' AS sha256", "10L AS mtime")
    now = t.sup().where("s % 5 <> 3").selectExpr("concat('f', s) AS file_path", "CASE WHEN s % 5 = 2 THEN 'b' ELSE 'a' END AS sha256", "CASE WHEN s % 5 = 0 THEN 10L ELSE 11L END AS mtime")
    return incremental.changes(now, then).select("file_path", "state")


def _shapes(t: Tables, changed: bool) -> DataFrame:
    own = t.sup().where("NOT (s % 7 = 1 AND s % 2 = 0)") if changed else t.sup()
    nodes = own.selectExpr("concat('fn.', s) AS id", "concat('fn_', s) AS name", "'Function' AS label", "concat('f', s % 7) AS file_path")
    fields = t.sup().selectExpr("concat('class.', s) AS class_id", ("CASE WHEN s % 7 = 2 THEN 'y' ELSE 'x' END" if changed else "'x'") + " AS field_name", "concat('f', s % 7) AS file_path")
    return incremental.file_shapes(nodes, {"field": fields})


@query("SELECT 'f' || (s % 7) AS file_path, s % 7 NOT IN (1, 2) AS body_only, coalesce(string_agg(CASE WHEN s % 7 = 1 AND s % 2 = 0 THEN 'fn_' || s END, ',' ORDER BY 'fn_' || s), '') AS dirty, s % 7 = 2 AS beyond FROM sup GROUP BY s % 7")
def shape_changes(spark, sf):
    """What a new parse changes beside function bodies: f1 lost every second function, f2 has other fields."""
    t = Tables(spark, sf)
    found = incremental.shape_changes(_shapes(t, False), _shapes(t, True))
    return found.select("file_path", "body_only", F.array_join(F.array_sort("dirty"), ",").alias("dirty"), "beyond")


@query("SELECT DISTINCT 'f' || (s % 9) AS file_path FROM sup WHERE s % 9 = 4 OR s * 3 % 40 IN (7, 8)")
def incremental_wave(spark, sf):
    """The changed file, and all with a site that names a changed definition."""
    t = Tables(spark, sf)
    calls = t.sup().selectExpr("concat('fn_', s * 3 % 40) AS leaf_name", "concat('f', s % 9) AS file_path")
    dirty = spark.createDataFrame([("fn_7",), ("fn_8",)], "name string")
    return incremental.wave(spark.createDataFrame([("f4",)], "file_path string"), dirty, calls)


@query("SELECT * FROM (VALUES ('full', 'a full run was asked for'), ('compiler', 'compiler edges have to be merged again'), ('vanished', 'files vanished'), ('beyond', 'more than functions changed'), ('most', 'most files changed'), ('inherited', 'an inherited name changed'), ('none', '')) x(case_name, reason)")
def partial_fallback(spark, sf):
    """Why a partial run is not allowed, one case for each condition."""
    t = Tables(spark, sf)
    clean = t.sup().where("s < 3").selectExpr("concat('f', s) AS file_path", "array('fn_1') AS dirty", "false AS beyond")
    beyond = clean.withColumn("beyond", F.lit(True))
    nothing = spark.createDataFrame([], "file_path string")
    names = lambda n: spark.createDataFrame([(n, "Base")], "impl_name string, super_name string")
    cases = {
        "full": (clean, names("x"), nothing, 100, True, False), "compiler": (clean, names("x"), nothing, 100, False, True),
        "vanished": (clean, names("x"), clean.select("file_path"), 100, False, False), "beyond": (beyond, names("x"), nothing, 100, False, False),
        "most": (clean, names("x"), nothing, 4, False, False), "inherited": (clean, names("fn_1"), nothing, 100, False, False), "none": (clean, names("x"), nothing, 100, False, False),
    }
    return spark.createDataFrame([(k, incremental.partial_allowed(*c)[1]) for k, c in cases.items()], "case_name string, reason string")


@query("SELECT 'fn.' || s AS src, CASE WHEN s % 9 < 3 THEN 2 ELSE 1 END AS src_line FROM sup")
def merged_edges(spark, sf):
    """Edges after a partial run over three files: theirs are fresh, the others stay."""
    t = Tables(spark, sf)
    wave = t.sup().where("s % 9 < 3").selectExpr("concat('f', s % 9) AS file_path").distinct()
    return incremental.merged_edges(_edge_rows(t), _edge_rows(t, "2", "s % 9 < 3"), wave).select("src", "src_line")


def _graph(t: Tables) -> Navigator:
    """The projection as a stored graph."""
    store = _store(t.spark)
    store.replace("nodes", t.nodes().withColumns({"community": F.length("name") % 5, "pagerank": F.lit(0.25)}))
    store.replace("edges", t.edges())
    calls = t.calls().drop("receiver_name")
    store.replace("calls", calls)
    store.replace("imports", t.imports())
    store.replace("symbol_refs", t.refs())
    store.replace("inherits", t.inherits())
    store.replace("cochanges", lookups.cochange_pairs(t.commits()))
    store.commit()
    return Navigator(store)


SHARED = "SELECT max_by(name, label) FROM (SELECT label, min(name) AS name FROM (SELECT label, name FROM star_nodes WHERE label IN ('Method', 'Class') GROUP BY ALL HAVING count(*) > 1) GROUP BY label)"


@query(f"SELECT n.id, count(DISTINCT e.src) AS resolved_callers FROM star_nodes n LEFT JOIN star_edges e ON e.dst = n.id AND e.relation = 'Calls' WHERE n.name = ({SHARED}) GROUP BY n.id")
def nav_callers(spark, sf):
    """Callers of a name with several definitions (methods, or else classes): the candidates with their resolved callers."""
    found = _graph(Tables(spark, sf))
    several = found.nodes.where("label IN ('Method', 'Class')").groupBy("label", "name").count().where("count > 1").groupBy("label").agg(F.min("name").alias("name"))
    return found.callers(several.agg(F.max_by("name", "label")).first()[0]).data.select("id", "resolved_callers")


@query("SELECT id, name FROM star_nodes WHERE id IN (SELECT dst FROM star_edges WHERE relation = 'Calls' AND src = 'customer.7')")
def nav_callees(spark, sf):
    return _graph(Tables(spark, sf)).callees("customer.7").data.select("id", "name")


@query("SELECT id, name, file_path, line_start FROM star_nodes WHERE id = 'supplier.7'")
def nav_node(spark, sf):
    return _graph(Tables(spark, sf)).node("supplier.7").data.select("id", "name", "file_path", "line_start")


@query("WITH d AS (SELECT DISTINCT src AS id, 1 AS depth FROM star_edges WHERE dst = (SELECT min(id) FROM star_nodes WHERE name = 'supply_7')), u AS (SELECT DISTINCT e.src AS id, 2 AS depth FROM star_edges e JOIN d ON d.id = e.dst) SELECT id, CAST(min(depth) AS INTEGER) AS depth FROM (SELECT * FROM d UNION ALL SELECT * FROM u) GROUP BY id ORDER BY 2, 1 LIMIT 200")
def nav_impact(spark, sf):
    return _graph(Tables(spark, sf)).impact("supply_7").data.select("id", "depth")


@query("SELECT CAST(length(name) % 5 AS INTEGER) AS community, count(*) AS size, array_to_string(list_slice(list_sort(list(name)), 1, 3), ',') AS names FROM (SELECT DISTINCT ON (id) * FROM star_nodes WHERE label = 'Function') GROUP BY 1")
def nav_communities(spark, sf):
    t = Tables(spark, sf)
    found = _graph(t)
    found.tables["nodes"] = found.nodes.where("label = 'Function'").withColumn("name", F.concat("name", F.lit("")))
    rows = found.nodes.select("community", "name", "id")
    sample = rows.groupBy("community").agg(F.slice(F.array_sort(F.collect_list("name")), 1, 3).alias("names"))
    return found.communities().data.select("community", "size").join(sample, "community").select("community", "size", F.array_join("names", ",").alias("names"))


@query("SELECT section, key, n FROM (SELECT 'labels' AS section, label AS key, count(*) AS n FROM star_nodes GROUP BY label UNION ALL SELECT 'routes', '', 0)")
def nav_architecture(spark, sf):
    found = _graph(Tables(spark, sf)).architecture()
    return found["labels"].select(F.lit("labels").alias("section"), F.col("label").alias("key"), "n").union(found["routes"].select(F.lit("routes"), F.lit(""), "n"))


@query("SELECT 1 AS generation, (SELECT count(*) FROM star_nodes) AS nodes, (SELECT count(*) FROM star_edges) AS edges, false AS embedder, false AS audit_stale")
def nav_stats(spark, sf):
    found = _graph(Tables(spark, sf)).stats()
    return spark.createDataFrame([tuple(found[c] for c in ("generation", "nodes", "edges", "embedder", "audit_stale"))], "generation int, nodes long, edges long, embedder boolean, audit_stale boolean")


@query("WITH p AS (SELECT a.file_path AS file_a, b.file_path AS file_b, count(*) AS n FROM commits a JOIN commits b ON a.commit_id = b.commit_id AND a.file_path < b.file_path WHERE a.commit_id IN (SELECT commit_id FROM commits GROUP BY commit_id HAVING count(*) BETWEEN 2 AND 30) GROUP BY ALL HAVING count(*) >= 2), b AS (SELECT file_b AS file_path, n FROM p WHERE file_a = 'click_3' UNION ALL SELECT file_a, n FROM p WHERE file_b = 'click_3') SELECT file_path, n FROM b ORDER BY n DESC, file_path LIMIT 10")
def nav_co_changes(spark, sf):
    return _graph(Tables(spark, sf)).co_changes("click_3").data


@query("SELECT DISTINCT a.id AS a_id, b.name AS b_name FROM star_nodes a JOIN star_edges e ON e.src = a.id AND e.relation = 'UsesType' JOIN star_nodes b ON b.id = e.dst WHERE a.id = 'supplier.7' ORDER BY 1, 2 LIMIT 30")
def nav_graph_query(spark, sf):
    return _graph(Tables(spark, sf)).graph_query("MATCH (a:Method)-[:UsesType]->(b) WHERE a.id = 'supplier.7' RETURN a.id, b.name LIMIT 30").data


@query("SELECT name, id FROM star_nodes WHERE label IN ('Function', 'Method', 'Class') AND list_contains(string_split(lower(name), '_'), 'building') AND list_has_any(string_split(lower(name), '_'), ['7', '70', '71', '72', '73', '74', '75', '76', '77', '78', '79'])")
def search_prefix_and(spark, sf):
    """All subword prefixes: `building` and a part that starts with 7."""
    own = Tables(spark, sf).nodes().where("label IN ('Function', 'Method', 'Class')")
    hits = search.bm25(own, ["building", "7"], prefix=True, every=True)
    return own.join(hits, "id", "left_semi").select("id", "name")


@query("SELECT CAST(vec_id AS VARCHAR) AS id, CASE WHEN vec_id % 2 = 0 THEN 1.0 ELSE round(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])) / list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])), 4) END AS length FROM embeddings")
def vectors_upsert(spark, sf):
    """Vectors of unit length; new ones replace old ones, those of another dimension are left out."""
    own = Tables(spark, sf).read("embeddings").select(F.col("vec_id").cast("string").alias("id"), "embedding")
    size = own.select(F.size("embedding")).first()[0]
    new = own.where("id % 2 = 0").withColumn("embedding", F.transform("embedding", lambda x: x * F.lit(2).cast("float")))
    wrong = own.withColumn("embedding", F.slice("embedding", 1, 3)).withColumn("id", F.concat(F.lit("short"), "id"))
    out = vectors.upserted(vectors.normalised_vectors(own, size), new.unionByName(wrong), size)
    return out.select("id", F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x), 4).alias("length"))


@query("SELECT 'supplier.' || s_suppkey AS id, CAST(1 AS INTEGER) AS n FROM supplier WHERE s_suppkey % 3 = 0")
def semantic_hits(spark, sf):
    """Nodes by an injected embedder: one direction for every remainder, so a third of the nodes is at score 1."""
    t = Tables(spark, sf)
    nodes = t.nodes().where("label = 'Method'")
    key = F.split("id", r"\.")[1].cast("int") % 3
    own = nodes.select("id", F.array(*((key == i).cast("float") for i in range(3))).alias("embedding"))
    found, degraded = vectors.semantic_search(nodes, own, "anything", 100_000, lambda texts: [[1.0, 0.0, 0.0]] * len(texts), "m", "m")
    return found.where(F.col("score") > 0.99).select("id", F.lit(int(not degraded)).alias("n"))


@query("SELECT 'doc.src_' || doc_id || '.0' AS id, 'Document' AS label, CAST(length(trim(text)) AS INTEGER) AS size FROM documents WHERE trim(text, ' ' || chr(10) || chr(9) || chr(13)) <> '' AND doc_id % 50 <> 0 UNION ALL SELECT 'doc.src_' || doc_id || '.0', 'Document', 3 FROM documents WHERE doc_id % 50 = 0")
def ingest_documents(spark, sf):
    """All documents as nodes of a store; every fiftieth is ingested anew with another text."""
    t, store = Tables(spark, sf), _store(spark)
    own = t.read("documents").select(F.concat(F.lit("src-"), "doc_id").alias("source"), "text", "doc_id")
    indexing.ingest(store, own)
    indexing.ingest(store, own.where("doc_id % 50 = 0").withColumn("text", F.lit("new")))
    return store.table("nodes").select("id", "label", F.length(F.element_at("metadata", F.lit("text"))).alias("size"))


@query("WITH p AS (SELECT a.file_path AS file_a, b.file_path AS file_b, count(*) AS n FROM commits a JOIN commits b ON a.commit_id = b.commit_id AND a.file_path < b.file_path WHERE a.commit_id IN (SELECT commit_id FROM commits GROUP BY commit_id HAVING count(*) BETWEEN 2 AND 30) GROUP BY ALL HAVING count(*) >= 2) SELECT file_a, file_b, n FROM p ORDER BY n DESC, file_a, file_b LIMIT 20000")
def ingest_history(spark, sf):
    t, store = Tables(spark, sf), _store(spark)
    indexing.history(store, t.commits())
    return store.table("cochanges")


@query("SELECT 'fn.' || s AS id, CASE WHEN s % 9 = 4 THEN 2.0 ELSE 1.0 END AS model, 'two' AS stamp FROM sup")
def semantic_index(spark, sf):
    """Vectors of all nodes, then again of those in a changed file, then, by another model, of all but that file's."""
    t, store = Tables(spark, sf), _store(spark)
    store.replace("nodes", _node_rows(t))
    store.commit()
    one = lambda axis: lambda texts: [[float(axis == 1), float(axis == 2)]] * len(texts)
    indexing.embed(store, one(2), "one")
    indexing.embed(store, one(1), "two", spark.createDataFrame([("f1",)], "file_path string"))
    indexing.embed(store, one(2), "two", spark.createDataFrame([("f4",)], "file_path string"))
    return store.table("vectors").select("id", (F.col("embedding")[0] + 2 * F.col("embedding")[1]).cast("double").alias("model"), F.lit(store.meta("embed_model")).alias("stamp"))


@query("SELECT * FROM (VALUES ('as indexed', 'Fresh'), ('touched', 'Stale'), ('one less', 'Stale'), ('not told', 'Unknown')) x(listing, freshness)")
def nav_freshness(spark, sf):
    t, store = Tables(spark, sf), _store(spark)
    listing = t.sup().selectExpr("concat('f', s) AS file_path", "'a' AS sha256", "s AS mtime")
    store.replace("nodes", _node_rows(t))
    store.replace("manifest", listing)
    store.commit()
    cases = {"as indexed": lambda: listing, "touched": lambda: listing.withColumn("mtime", F.expr("mtime + mtime % 2")), "one less": lambda: listing.where("mtime > 0"), "not told": None}
    return spark.createDataFrame([(k, Navigator(store, listing=v).important(1).freshness) for k, v in cases.items()], "listing string, freshness string")
