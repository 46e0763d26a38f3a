"""The registered queries, each with the SQL that gives the same rows, over the projection of the benchmark tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from .fixtures_graph import Tables
from .functions import scalars as S
from .operators import coverage, graph, lookups, resolution, search, services, vectors
from .plans import cypher
from .registry import ORACLE, QUERIES, Query, query
from .sources import files

SOME = "supply_7"  # a name that several suppliers share
START, TARGET = "(SELECT min(src) FROM chain_edges)", "(SELECT min(dst) FROM chain_edges)"


def _fans(t: Tables) -> DataFrame:
    return lookups.degrees(t.edges())


@query("SELECT p_partkey, CASE WHEN length(regexp_replace(trim(regexp_replace(p_name, '[^A-Za-z0-9]+', ' ', 'g')), '[^ ]', '', 'g')) = 0 AND NOT regexp_matches(p_name, '[A-Za-z][0-9]|[0-9][A-Za-z]|[a-z][A-Z]') THEN '' ELSE lower(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(p_name, '[^A-Za-z0-9]+', ' ', 'g'), '([a-z])([A-Z])', '\\1 \\2', 'g'), '([A-Z])([A-Z][a-z])', '\\1 \\2', 'g'), '([A-Za-z])([0-9])', '\\1 \\2', 'g'), '([0-9])([A-Za-z])', '\\1 \\2', 'g'))) END AS parts FROM part")
def fn_subwords(spark, sf):
    return Tables(spark, sf).read("part").select("p_partkey", S.subwords("p_name").alias("parts"))


@query("SELECT page_id, string_split(string_split(url, '::')[-1], '.')[-1] AS leaf FROM pages")
def fn_leaf_name(spark, sf):
    return Tables(spark, sf).read("pages").select("page_id", S.leaf_name("url").alias("leaf"))


@query("SELECT page_id, CASE WHEN instr(url, '/') > 0 THEN string_split(url, '/')[1] ELSE '' END AS top FROM pages")
def fn_top_segment(spark, sf):
    return Tables(spark, sf).read("pages").select("page_id", S.top_segment("url").alias("top"))


@query("SELECT page_id, trim(lower(regexp_replace(url, '[^A-Za-z0-9]+', '_', 'g')), '_') AS segment FROM pages")
def fn_normalize_id(spark, sf):
    return Tables(spark, sf).read("pages").select("page_id", S.id_segment("url").alias("segment"))


@query(r"SELECT doc_id, list_has_any(string_split_regex(lower(regexp_replace(regexp_replace(text, '(\p{Lu})(\p{Lu}\p{Ll})', '\1 \2', 'g'), '(\p{Ll})(\p{Lu})', '\1 \2', 'g')), '[^\p{L}\p{Nd}]+'), ['test', 'tests', 'spec', 'specs', 'testing']) AS is_test FROM documents")
def fn_is_test_path(spark, sf):
    return Tables(spark, sf).read("documents").select("doc_id", S.is_test_path("text").alias("is_test"))


@query("SELECT id, name, file_path FROM star_nodes WHERE id IN (SELECT src FROM star_edges WHERE relation = 'Calls' AND dst IN (SELECT id FROM star_nodes WHERE name = 'supply_7'))")
def callers_of(spark, sf):
    t = Tables(spark, sf)
    return lookups.callers_of(t.nodes(), t.edges(), SOME).select("id", "name", "file_path")


@query("SELECT id, name FROM star_nodes WHERE id IN (SELECT dst FROM star_edges WHERE relation = 'Calls' AND src = 'customer.7')")
def callees_of(spark, sf):
    t = Tables(spark, sf)
    return lookups.callees_of(t.nodes(), t.edges(), "customer.7").select("id", "name")


@query("SELECT n.id, n.label, n.file_path, n.line_start, count(DISTINCT e.src) AS resolved_callers FROM star_nodes n LEFT JOIN star_edges e ON e.dst = n.id AND e.relation = 'Calls' AND e.confidence <> 'Ambiguous' WHERE n.name = 'supply_7' GROUP BY ALL")
def definitions_of(spark, sf):
    t = Tables(spark, sf)
    return lookups.definitions_of(t.nodes(), t.edges(), SOME)


@query("SELECT id, name, line_start FROM star_nodes WHERE file_path = 'r0/n0' AND label <> 'File'")
def symbols_in_file(spark, sf):
    return lookups.symbols_in_file(Tables(spark, sf).nodes(), "r0/n0").select("id", "name", "line_start")


@query("SELECT id, CAST(sum(i) AS BIGINT) AS fan_in, CAST(sum(o) AS BIGINT) AS fan_out FROM (SELECT dst AS id, 1 AS i, 0 AS o FROM star_edges WHERE relation = 'Calls' UNION ALL SELECT src, 0, 1 FROM star_edges WHERE relation = 'Calls') GROUP BY id")
def fan_in_out(spark, sf):
    return _fans(Tables(spark, sf))


@query("SELECT label, count(*) AS n FROM star_nodes GROUP BY label")
def nodes_by_label(spark, sf):
    return lookups.counts_by(Tables(spark, sf).nodes(), "label")


@query("SELECT relation, count(*) AS n FROM star_edges GROUP BY relation")
def edges_by_relation(spark, sf):
    return lookups.counts_by(Tables(spark, sf).edges(), "relation")


@query("SELECT file_path, count(*) AS n FROM star_calls WHERE callee_name = 'supply_7' GROUP BY file_path")
def call_sites_by_file(spark, sf):
    return lookups.call_sites_by_file(Tables(spark, sf).calls(), SOME)


EXTERNAL = "regexp_matches(c.file_path, '[.]ts$') AND EXISTS (SELECT 1 FROM star_imports i WHERE i.file_path = c.file_path AND i.name = c.callee_name AND left(i.module, 1) NOT IN ('.', '/', '#'))"
RESOLVED = "SELECT DISTINCT e.src AS caller_id, n.name AS callee_name FROM star_edges e JOIN star_nodes n ON n.id = e.dst WHERE e.relation = 'Calls' AND e.confidence <> 'Ambiguous'"


@query(f"SELECT c.callee_name, count(*) AS total, count(r.caller_id) AS resolved, count(*) - count(r.caller_id) AS dropped FROM star_calls c LEFT JOIN ({RESOLVED}) r ON r.caller_id = c.caller_id AND r.callee_name = c.callee_name WHERE NOT ({EXTERNAL}) GROUP BY c.callee_name")
def coverage_callers(spark, sf):
    t = Tables(spark, sf)
    return coverage.coverage_for_callers(t.nodes(), t.edges(), t.calls(), t.imports())


INREPO = "c.callee_name IN (SELECT name FROM star_nodes WHERE label IN ('Function', 'Method', 'Class'))"


@query(f"SELECT c.caller_id, count(*) AS total, count(r.caller_id) AS resolved, count(*) - count(r.caller_id) AS dropped FROM star_calls c LEFT JOIN ({RESOLVED}) r ON r.caller_id = c.caller_id AND r.callee_name = c.callee_name WHERE NOT ({EXTERNAL}) AND {INREPO} GROUP BY c.caller_id")
def coverage_callees(spark, sf):
    t = Tables(spark, sf)
    return coverage.coverage_for_callees(t.nodes(), t.edges(), t.calls(), t.imports())


@query(f"SELECT count(*) AS n FROM star_calls c WHERE {EXTERNAL}")
def external_bound_sites(spark, sf):
    t = Tables(spark, sf)
    return coverage.external_bound_count(t.calls(), t.imports())


@query(f"SELECT DISTINCT c.caller_id, c.callee_name FROM star_calls c WHERE NOT ({EXTERNAL}) AND {INREPO} AND NOT EXISTS (SELECT 1 FROM ({RESOLVED}) r WHERE r.caller_id = c.caller_id AND r.callee_name = c.callee_name)")
def unresolved_names(spark, sf):
    t = Tables(spark, sf)
    return coverage.unresolved_callee_names(t.nodes(), t.edges(), t.calls(), t.imports())


@query(f"SELECT DISTINCT c.file_path FROM star_calls c WHERE c.callee_name = 'supply_7' AND NOT ({EXTERNAL}) AND c.file_path NOT IN (SELECT file_path FROM star_nodes WHERE name = 'supply_7')")
def unresolved_site_files(spark, sf):
    t = Tables(spark, sf)
    return coverage.unresolved_site_files(t.nodes(), t.calls(), t.imports(), SOME)


@query("""SELECT file_path, min(evidence) AS evidence FROM (SELECT file_path, 'call' AS evidence FROM star_calls WHERE callee_name = 'supply_8' UNION ALL SELECT file_path, 'reference' FROM star_refs WHERE leaf_name = 'supply_8' UNION ALL SELECT file_path, 'inherits' FROM star_inherits WHERE super_name = 'supply_8' UNION ALL SELECT file_path, 'import' FROM star_imports WHERE name = 'supply_8'
UNION ALL SELECT 'field/' || s, 'field' FROM sup WHERE s % 60 = 8 UNION ALL SELECT 'local/' || (s % 3), 'local' FROM sup WHERE s % 60 = 8 UNION ALL SELECT 'local/' || (s % 2), 'type' FROM sup WHERE s % 60 = 8 UNION ALL SELECT 'receiver/' || s, 'receiver' FROM sup WHERE s % 60 = 8) GROUP BY file_path""")
def type_usages(spark, sf):
    t = Tables(spark, sf)
    name, eighth = "concat('supply_', s % 60)", t.sup()
    calls = t.calls().select("callee_name", "receiver_name", "file_path").unionByName(eighth.selectExpr("'x' AS callee_name", f"{name} AS receiver_name", "concat('receiver/', s) AS file_path"))
    own = lambda path: eighth.selectExpr(f"{name} AS type_name", f"{path} AS file_path")
    return coverage.type_usages("supply_8", calls, t.refs(), t.inherits(), own("concat('field/', s)"), own("concat('local/', s % 3)"), t.imports(), own("concat('local/', s % 2)"))


DEAD = "SELECT n.id, n.name, n.file_path, n.line_start FROM star_nodes n WHERE label IN ('Function', 'Method') AND NOT EXISTS (SELECT 1 FROM star_edges e WHERE e.dst = n.id AND e.relation IN ('Calls', 'Tests')) AND n.name NOT IN (SELECT callee_name FROM star_calls)"


@query(DEAD)
def dead_code(spark, sf):
    t = Tables(spark, sf)
    return services.dead_code(t.nodes(), t.edges(), t.calls())


@query(f"{DEAD} ORDER BY n.file_path, n.line_start, n.id LIMIT 50 OFFSET 10")
def dead_code_batch(spark, sf):
    t = Tables(spark, sf)
    return services.dead_code_batch(t.nodes(), t.edges(), t.calls(), limit=50, offset=10)


FREE = "SELECT n.id, n.name, n.file_path, n.line_start FROM star_nodes n WHERE label IN ('Function', 'Method') AND NOT EXISTS (SELECT 1 FROM star_edges e WHERE e.dst = n.id AND e.relation IN ('Calls', 'Tests'))"


@query(f"""SELECT d.id, d.name, d.file_path, d.line_start, CASE WHEN k.kinds IS NULL THEN 'candidate' WHEN k.kinds = ['unknown_indirect'] OR k.kinds = ['public_export'] THEN 'unknown' ELSE 'indirectly_referenced' END AS verdict FROM ({FREE}) d
LEFT JOIN (SELECT d.id, list_sort(list(DISTINCT r.kind)) AS kinds FROM ({FREE}) d JOIN star_refs r ON r.leaf_name = d.name WHERE r.kind NOT IN ('public_export', 'framework_registration') OR r.file_path = d.file_path GROUP BY d.id) k ON k.id = d.id""")
def dead_code_assess(spark, sf):
    t = Tables(spark, sf)
    nothing = t.nodes().limit(0)
    return services.dead_code_assessed(t.nodes(), t.edges(), t.calls().limit(0), t.refs(), nothing.select("id"))


@query("""SELECT n.id, n.name, n.file_path, CAST(coalesce(f.fan_in, 0) AS BIGINT) AS fan_in, 'None' AS evidence, round(greatest(ln(1 + coalesce(f.fan_in, 0)), 0.35) * 1.1 * 2, 6) AS risk,
CASE WHEN greatest(ln(1 + coalesce(f.fan_in, 0)), 0.35) * 2.2 >= 6 THEN 'HIGH' WHEN greatest(ln(1 + coalesce(f.fan_in, 0)), 0.35) * 2.2 >= 2.5 THEN 'MED' ELSE 'LOW' END AS tier
FROM star_nodes n LEFT JOIN (SELECT dst, count(*) AS fan_in FROM star_edges WHERE relation = 'Calls' GROUP BY dst) f ON f.dst = n.id WHERE n.label IN ('Function', 'Method') AND n.file_path IN ('r0/n0', 'r1/n1', 'r1/n2')""")
def review_risk(spark, sf):
    t = Tables(spark, sf)
    changed = spark.createDataFrame([("r0/n0",), ("r1/n1",), ("r1/n2",)], "file_path string")
    return services.review_rows(t.nodes(), t.edges(), t.calls(), changed).withColumn("risk", F.round("risk", 6))


PAIRS = "SELECT a.file_path AS file_a, b.file_path AS file_b, count(*) AS n FROM commits a JOIN commits b ON a.commit_id = b.commit_id AND a.file_path < b.file_path WHERE a.commit_id IN (SELECT commit_id FROM commits GROUP BY commit_id HAVING count(*) BETWEEN 2 AND 30) GROUP BY ALL HAVING count(*) >= 2"


@query(PAIRS)
def cochange_pairs(spark, sf):
    return lookups.cochange_pairs(Tables(spark, sf).commits())


@query(f"WITH p AS ({PAIRS}) SELECT file_b AS file_path, n FROM p WHERE file_a = 'click_3' UNION ALL SELECT file_a, n FROM p WHERE file_b = 'click_3'")
def cochanges_for(spark, sf):
    return lookups.cochanges_for(lookups.cochange_pairs(Tables(spark, sf).commits()), "click_3")


@query("SELECT DISTINCT name AS a_name, file_path AS a_file FROM star_nodes WHERE label = 'Method' AND name ILIKE '%LY_7%' ORDER BY 1, 2 LIMIT 1000")
def cypher_contains(spark, sf):
    t = Tables(spark, sf)
    return cypher.run("MATCH (a:Method) WHERE a.name CONTAINS 'LY_7' RETURN a.name, a.file LIMIT 1000", t.nodes(), t.edges())


@query("SELECT DISTINCT a.id AS a_id, b.name AS b_name FROM star_nodes a JOIN star_edges e ON e.src = a.id AND e.relation = 'Calls' JOIN star_nodes b ON b.id = e.dst WHERE b.name = 'supply_7' AND a.file_path ILIKE 'r1/%' ORDER BY 1, 2 LIMIT 1000")
def cypher_one_hop(spark, sf):
    t = Tables(spark, sf)
    return cypher.run("MATCH (a)-[:Calls]->(b) WHERE b.name = 'supply_7' AND a.file STARTS WITH 'R1/' RETURN a.id, b.name LIMIT 1000", t.nodes(), t.edges())


@query("SELECT DISTINCT a.name AS a_name, c.name AS c_name FROM star_nodes a JOIN star_edges e ON e.src = a.id AND e.relation = 'Calls' JOIN star_nodes b ON b.id = e.dst JOIN star_edges f ON f.src = b.id AND f.relation = 'UsesType' JOIN star_nodes c ON c.id = f.dst WHERE a.label = 'Function' AND a.id = 'customer.7' AND c.label = 'Class' ORDER BY 1, 2 LIMIT 1000")
def cypher_two_hop(spark, sf):
    t = Tables(spark, sf)
    return cypher.run("MATCH (a:Function)-[:Calls]->(b)-[:UsesType]->(c:Class) WHERE a.id = 'customer.7' RETURN a.name, c.name LIMIT 1000", t.nodes(), t.edges())


@query("SELECT CAST(n_regionkey AS VARCHAR) AS region, CAST(count(*) AS VARCHAR) AS n FROM nation GROUP BY n_regionkey")
def sql_readonly(spark, sf):
    Tables(spark, sf).read("nation").createOrReplaceTempView("wg_nation")
    return cypher.query_readonly(spark, "SELECT n_regionkey AS region, count(*) AS n FROM wg_nation GROUP BY n_regionkey")


def _edge(t: Tables, column: str) -> str:
    return t.chain().agg(F.min(column)).first()[0]


@query(f"WITH RECURSIVE w(id, depth) AS (SELECT {TARGET}, 0 UNION SELECT e.src, w.depth + 1 FROM w JOIN chain_edges e ON e.dst = w.id WHERE w.depth < 5) SELECT id, CAST(min(depth) AS INTEGER) AS depth FROM w GROUP BY id HAVING min(depth) > 0")
def blast_radius(spark, sf):
    t = Tables(spark, sf)
    return graph.blast_radius(spark, t.chain(), _edge(t, "dst"))


@query(f"WITH RECURSIVE w(id, depth) AS (SELECT {START}, 0 UNION SELECT e.dst, w.depth + 1 FROM w JOIN chain_edges e ON e.src = w.id WHERE w.depth < 6) SELECT id, CAST(min(depth) AS INTEGER) AS depth FROM w GROUP BY id HAVING min(depth) > 0")
def flow_from(spark, sf):
    t = Tables(spark, sf)
    return graph.flow_from(spark, t.chain().withColumn("relation", F.lit("Calls")), _edge(t, "src"))


@query(f"""WITH RECURSIVE w(id, depth) AS (SELECT {START}, 0 UNION SELECT e.dst, w.depth + 1 FROM w JOIN chain_edges e ON e.src = w.id WHERE w.depth < 12),
d AS (SELECT id, min(depth) AS depth FROM w GROUP BY id), t AS (SELECT max(id) AS id, max(depth) AS depth FROM d WHERE depth = (SELECT max(depth) FROM d)),
p AS (SELECT d.id, d.depth, (SELECT min(e.src) FROM chain_edges e JOIN d q ON q.id = e.src WHERE e.dst = d.id AND q.depth = d.depth - 1) AS parent FROM d),
b(id, step) AS (SELECT id, depth FROM t UNION SELECT p.parent, b.step - 1 FROM b JOIN p ON p.id = b.id WHERE b.step > 0)
SELECT CAST(step AS INTEGER) AS step, id FROM b""")
def shortest_path(spark, sf):
    t = Tables(spark, sf)
    start = _edge(t, "src")
    near = graph.reach(spark, t.chain(), spark.range(1).select(F.lit(start).alias("id")), 12)
    return graph.shortest_path(spark, t.chain(), start, near.agg(F.max(F.struct("depth", "id"))).first()[0]["id"])


def _ranks(damping: float, teleport: str, rounds: int = 50) -> str:
    parts = ["v AS MATERIALIZED (SELECT id, (SELECT count(*) FROM chain_nodes) AS n FROM chain_nodes)", f"base AS MATERIALIZED (SELECT id, CAST({teleport} AS DOUBLE) AS t, (SELECT count(*) FROM chain_edges e WHERE e.src = v.id) AS o FROM v)", "r0 AS MATERIALIZED (SELECT id, t AS r FROM base)"]
    for k in range(rounds):
        parts.append(f"r{k + 1} AS MATERIALIZED (SELECT base.id, ({1 - damping} + {damping} * (SELECT coalesce(sum(x.r), 0) FROM r{k} x JOIN base b ON b.id = x.id WHERE b.o = 0)) * base.t + {damping} * coalesce(g.s, 0) AS r FROM base LEFT JOIN (SELECT e.dst, sum(x.r / b.o) AS s FROM chain_edges e JOIN r{k} x ON x.id = e.src JOIN base b ON b.id = e.src GROUP BY e.dst) g ON g.dst = base.id)")
    return f"WITH {', '.join(parts)} SELECT id, round(r * 1e6, 1) AS rank FROM r{rounds}"


def _vertices(t: Tables) -> DataFrame:
    return t.chain().select(F.col("src").alias("id")).union(t.chain().select("dst")).distinct()


@query(_ranks(0.85, "1.0 / n"))
def pagerank(spark, sf):
    t = Tables(spark, sf)
    return graph.pagerank(spark, _vertices(t), t.chain()).select("id", F.round(F.col("rank") * 1e6, 1).alias("rank"))


@query(_ranks(0.6, f"CASE WHEN id = {START} THEN 1.0 ELSE 0.0 END"))
def personalized_pagerank(spark, sf):
    t = Tables(spark, sf)
    return graph.personalized_pagerank(spark, _vertices(t), t.chain(), [_edge(t, "src")]).select("id", F.round(F.col("rank") * 1e6, 1).alias("rank"))


@query("""SELECT n.id, n.name, round(ln(1 + coalesce(i.c, 0)) * ln(1 + coalesce(o.c, 0)) + (n.line_start % 7) / 8.0, 6) AS score FROM star_nodes n LEFT JOIN (SELECT dst, count(*) AS c FROM star_edges WHERE relation = 'Calls' GROUP BY dst) i ON i.dst = n.id
LEFT JOIN (SELECT src, count(*) AS c FROM star_edges WHERE relation = 'Calls' GROUP BY src) o ON o.src = n.id WHERE n.label IN ('Function', 'Method', 'Class', 'Interface', 'Route') ORDER BY score DESC, n.id LIMIT 15""")
def hub_important(spark, sf):
    t = Tables(spark, sf)
    return graph.important(t.nodes(), t.nodes().select("id", (F.col("line_start") % 7 / 8).alias("rank")), _fans(t)).select("id", "name", F.round("score", 6).alias("score"))


@query("SELECT s.id, 'task' AS kind FROM (SELECT src AS id, count(*) AS c FROM star_edges WHERE relation = 'Calls' GROUP BY src) s WHERE c >= 3 AND s.id NOT IN (SELECT dst FROM star_edges WHERE relation = 'Calls') AND s.id NOT IN ('customer.1', 'customer.4') UNION ALL SELECT id, 'route' FROM star_nodes WHERE id IN ('customer.1', 'customer.4', 'supplier.2') UNION ALL SELECT id, 'main' FROM star_nodes WHERE name = 'supply_3'")
def entry_points(spark, sf):
    t = Tables(spark, sf)
    nodes = t.nodes().withColumn("name", F.when(F.col("name") == "supply_3", "main").otherwise(F.col("name")))
    return graph.entry_points(nodes, _fans(t), nodes.where("id IN ('customer.1', 'customer.4', 'supplier.2')").select("id"))


@query("""WITH RECURSIVE o AS (SELECT o_orderkey AS id, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS next FROM orders), w(entry, id, depth) AS (SELECT id, id, 0 FROM o UNION ALL SELECT w.entry, o.next, depth + 1 FROM w JOIN o ON o.id = w.id WHERE w.depth < 6 AND o.next IS NOT NULL)
SELECT CAST(entry AS VARCHAR) AS entry, count(*) AS size, round(CAST(sum(id % 4) AS DOUBLE) * ln(1 + count(*)), 6) AS criticality FROM w WHERE depth > 0 GROUP BY entry""")
def flows_criticality(spark, sf):
    """Every order leads to the next one of its customer; all orders are entries, with ranks from 0 to 3."""
    orders = Tables(spark, sf).read("orders")
    following = F.lead("o_orderkey").over(W.partitionBy("o_custkey").orderBy("o_orderkey"))
    steps = orders.select(F.col("o_orderkey").cast("string").alias("src"), following.cast("string").alias("dst")).where("dst IS NOT NULL").withColumn("relation", F.lit("Calls"))
    ids = orders.select(F.col("o_orderkey").cast("string").alias("id"), (F.col("o_orderkey") % 4).cast("double").alias("rank"))
    return graph.flows(spark, steps, ids.select("id"), ids).withColumn("criticality", F.round("criticality", 6))


@query()
def communities(spark, sf):
    t = Tables(spark, sf)
    return graph.communities(spark, _vertices(t), t.chain())[0]


@query()
def betweenness(spark, sf):
    t = Tables(spark, sf)
    return graph.betweenness(spark, _vertices(t), t.chain()).select("id", F.round("betweenness", 3).alias("betweenness"))


@query("SELECT 'n' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS id, CAST(dense_rank() OVER (ORDER BY (SELECT min(m.n_nationkey) FROM nation m WHERE m.n_regionkey = nation.n_regionkey)) - 1 AS BIGINT) AS community FROM nation")
def communities_of_regions(spark, sf):
    """Nations linked to all others of their region: the communities are the regions, numbered as they first appear."""
    own = Tables(spark, sf).read("nation").select(F.concat(F.lit("n"), F.lpad(F.col("n_nationkey").cast("string"), 2, "0")).alias("id"), "n_regionkey")
    pairs = own.selectExpr("id AS src", "n_regionkey").join(own.selectExpr("id AS dst", "n_regionkey"), "n_regionkey").where("src < dst").select("src", "dst")
    return graph.communities(spark, own.select("id"), pairs)[0]


@query("SELECT 'n' || n_nationkey AS id, CAST(n_nationkey * (24 - n_nationkey) AS DOUBLE) AS betweenness FROM nation")
def betweenness_of_a_path(spark, sf):
    """Nations in a row: i of the 25 stands between i and 24 - i others."""
    own = Tables(spark, sf).read("nation")
    steps = own.where("n_nationkey < 24").selectExpr("concat('n', n_nationkey) AS src", "concat('n', n_nationkey + 1) AS dst")
    return graph.betweenness(spark, own.selectExpr("concat('n', n_nationkey) AS id"), steps)


TERMS = ("idiot", "worthless")


def _documents(t: Tables) -> DataFrame:
    return t.read("documents").select(F.col("doc_id").cast("string").alias("id"), F.concat(F.lit("d"), "doc_id").alias("name"), F.lit("Document").alias("label"), F.lit("").alias("parts"), F.substring("text", 1, 8000).alias("doc_text"), F.col("source").alias("file_path"))


def _bm25_sql() -> str:
    words = "list_filter(string_split_regex(lower(left(text, 8000)), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')"
    tf = ", ".join(f"CAST(len(list_filter(w, lambda x: x = '{t}')) AS DOUBLE) AS tf{i}" for i, t in enumerate(TERMS))
    df = ", ".join(f"count(*) FILTER (tf{i} > 0) AS df{i}" for i in range(len(TERMS)))
    score = " + ".join(f"ln(1 + (n - df{i} + 0.5) / (df{i} + 0.5)) * tf{i} * 2.2 / (tf{i} + 1.2 * (0.25 + 0.75 * size / avgsize))" for i in range(len(TERMS)))
    some = " OR ".join(f"tf{i} > 0" for i in range(len(TERMS)))
    return f"WITH w AS (SELECT doc_id, {words} AS w FROM documents), c AS (SELECT doc_id, len(w) AS size, {tf} FROM w), s AS (SELECT count(*) AS n, avg(size) AS avgsize, {df} FROM c) SELECT CAST(doc_id AS VARCHAR) AS id, round({score}, 5) AS score FROM c, s WHERE {some}"


@query(_bm25_sql())
def fts_bm25(spark, sf):
    return search.bm25(_documents(Tables(spark, sf)), list(TERMS)).select("id", F.round("score", 5).alias("score"))


@query("SELECT id, name FROM star_nodes WHERE regexp_matches(name, '_7[0-9]$') ORDER BY id LIMIT 20")
def search_regex(spark, sf):
    return search.search_regex(Tables(spark, sf).nodes(), "_7[0-9]$").select("id", "name")


@query()
def search_smart(spark, sf):
    return search.search_smart(Tables(spark, sf).nodes(), "buildingSeven 7").select("id", "name", F.round("score", 4).alias("score"))


@query("""WITH q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 0) SELECT CAST(vec_id AS VARCHAR) AS id, round(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(q.e AS DOUBLE[])) / sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) / sqrt(list_dot_product(CAST(q.e AS DOUBLE[]), CAST(q.e AS DOUBLE[]))), 4) AS score FROM embeddings, q
ORDER BY list_dot_product(CAST(embedding AS DOUBLE[]), CAST(q.e AS DOUBLE[])) / sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) DESC, 1 LIMIT 10""")
def knn_cosine(spark, sf):
    own = Tables(spark, sf).read("embeddings").select(F.col("vec_id").cast("string").alias("id"), "embedding")
    wanted = own.where("id = '0'").first()["embedding"]
    return vectors.knn(vectors.normalised_vectors(own), wanted, 10).withColumn("score", F.round("score", 4))


@query("SELECT id, name FROM (SELECT DISTINCT id, name FROM routes) WHERE name LIKE 'GET /1%' ORDER BY name, id LIMIT 5 OFFSET 2")
def routes_list(spark, sf):
    own = Tables(spark, sf).routes().select("id", "name").distinct().withColumn("label", F.lit("Route"))
    return lookups.routes(own, "/1", "GET", 2, 5).select("id", "name")


@query("SELECT e.src, e.dst FROM star_edges e WHERE relation = 'UsesType' AND e.dst NOT IN (SELECT id FROM star_nodes WHERE label <> 'Class' OR line_start % 3 <> 0)")
def dangling_edges(spark, sf):
    t = Tables(spark, sf)
    some = t.nodes().where("label <> 'Class' OR line_start % 3 <> 0")
    return lookups.dangling(some, t.edges()).select("src", "dst")


@query("SELECT n.id, e.id AS class_id FROM (SELECT * FROM star_nodes WHERE label = 'Method') n JOIN (SELECT * FROM star_nodes WHERE label = 'Function') e ON e.file_path = n.file_path AND e.line_start <= n.line_start AND n.line_end <= e.line_end")
def innermost_class(spark, sf):
    own = Tables(spark, sf).nodes().where("label IN ('Method', 'Function')")
    classes = own.withColumn("label", F.when(F.col("label") == "Function", "Class").otherwise("Function"))
    return lookups.innermost_class(classes, ("Class",)).select("id", "class_id")


@query("SELECT 'customer' AS justification, count(*) AS verifiable, count(*) FILTER (CAST(split_part(dst, '.', 2) AS INTEGER) % 2 = 0) AS confirmed FROM star_edges WHERE relation = 'Calls' AND src IN (SELECT src FROM star_edges WHERE relation = 'Calls' AND CAST(split_part(dst, '.', 2) AS INTEGER) % 2 = 0)")
def audit_tally(spark, sf):
    edges = Tables(spark, sf).edges().where("relation = 'Calls'").withColumn("justification", F.lit("customer"))
    even = edges.where(F.split("dst", r"\.")[1].cast("int") % 2 == 0)
    return coverage.audit(edges, even).select("justification", "verifiable", "confirmed")


@query("SELECT page_id, CASE WHEN url = '' THEN 'empty' WHEN instr(url, chr(92)) > 0 THEN 'backslash' WHEN url[1] = '/' THEN 'absolute' WHEN regexp_matches(url, '^[A-Za-z]:') THEN 'drive prefix' WHEN list_contains(string_split(url, '/'), '.') OR list_contains(string_split(url, '/'), '..') THEN 'dot segment' WHEN list_contains(string_split(url, '/'), '') THEN 'empty segment' END AS reason FROM pages")
def fn_unsafe_path(spark, sf):
    return Tables(spark, sf).read("pages").select("page_id", S.unsafe_path_reason("url").alias("reason"))


CHUNKS = r"""WITH RECURSIVE p AS (SELECT doc_id, list_filter(list_transform(string_split(replace(text, chr(10), chr(10) || chr(10)), chr(10) || chr(10)), lambda x: trim(regexp_replace(x, '^\s+|\s+$', '', 'g'))), lambda x: x <> '') AS ps FROM documents WHERE text IS NOT NULL),
u AS (SELECT doc_id, unnest(range(1, len(ps) + 1)) AS i, unnest(list_transform(ps, lambda x: strlen(x))) AS bytes, unnest(list_transform(ps, lambda x: length(x))) AS chars FROM p),
w(doc_id, i, used, n, chars) AS (SELECT doc_id, i, bytes, 1, chars FROM u WHERE i = 1 UNION ALL SELECT u.doc_id, u.i, CASE WHEN used + bytes > 1500 THEN bytes ELSE used + 2 + bytes END, CASE WHEN used + bytes > 1500 THEN n + 1 ELSE n END, u.chars FROM w JOIN u ON u.doc_id = w.doc_id AND u.i = w.i + 1)"""


@query(f"{CHUNKS} SELECT d.doc_id, CASE WHEN d.text IS NOT NULL THEN CAST(coalesce(max(w.n), 0) AS INTEGER) END AS n FROM documents d LEFT JOIN w ON w.doc_id = d.doc_id GROUP BY d.doc_id, d.text")
def doc_chunks(spark, sf):
    """Every line as a paragraph of its own."""
    return Tables(spark, sf).read("documents").select("doc_id", F.size(files.chunks(F.replace("text", F.lit("\n"), F.lit("\n\n")))).alias("n"))


@query(f"{CHUNKS} SELECT 'doc.src_' || doc_id || '.' || (n - 1) AS id, 'Document' AS label, CAST(sum(chars) + 2 * (count(*) - 1) AS INTEGER) AS size FROM w GROUP BY doc_id, n")
def document_nodes(spark, sf):
    own = Tables(spark, sf).read("documents").select(F.concat(F.lit("src-"), "doc_id").alias("source"), F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text"))
    return files.document_nodes(own).select("id", "label", F.length("text").alias("size"))


def _evidence(t: Tables) -> dict[str, DataFrame]:
    """Supplier methods and customer functions as definitions, one bare or member call for each order line."""
    spark = t.spark
    nodes = t.nodes().withColumns({"language": F.lit("python"), "file_path": F.concat("file_path", F.lit(".py"))})
    home = t.read("nation").select("n_nationkey", F.concat(F.lit("r"), "n_regionkey", F.lit("/n"), "n_nationkey", F.lit(".py")).alias("home"))
    orders = t.read("orders").join(t.read("customer"), F.col("c_custkey") == F.col("o_custkey")).join(F.broadcast(home), F.col("c_nationkey") == F.col("n_nationkey"))
    # Orders get their files before the lines meet them, so that the lines are dealt out once.
    lines = t.read("lineitem").join(orders.select("o_orderkey", "o_custkey", "home"), F.col("o_orderkey") == F.col("l_orderkey"))
    calls = lines.select(F.concat(F.lit("customer."), "o_custkey").alias("caller_id"), F.concat(F.lit("supply_"), F.col("l_suppkey") % 60).alias("callee_name"), F.col("l_linenumber").alias("line"), F.col("home").alias("file_path"), F.struct(F.lit("Bare").alias("kind"), F.lit(None).cast("string").alias("name")).alias("receiver"), F.lit(None).cast("string").alias("enclosing_class"))
    hidden = t.read("customer").where("c_custkey % 11 = 0").select(F.concat(F.lit("customer."), "c_custkey").alias("caller_id"), F.concat(F.lit("supply_"), F.col("c_custkey") % 60).alias("var_name"), F.lit("").alias("type_name"), F.lit("x").alias("file_path"))
    empty = lambda schema: spark.createDataFrame([], schema)
    return {
        "nodes": nodes, "calls": calls, "variables": hidden, "inherits": empty("impl_name string, super_name string, kind string, file_path string"),
        "fields": empty("class_id string, field_name string, type_name string, file_path string"), "imports": empty("file_path string, name string, module string"),
    }


@query("""WITH f AS (SELECT id, name, file_path FROM star_nodes WHERE label IN ('Function', 'Method')),
c AS (SELECT DISTINCT 'customer.' || o_custkey AS src, 'supply_' || (l_suppkey % 60) AS name, 'r' || n_regionkey || '/n' || n_nationkey AS file_path FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN nation ON c_nationkey = n_nationkey
  WHERE NOT (o_custkey % 11 = 0 AND l_suppkey % 60 = o_custkey % 60)),
here AS (SELECT name, file_path, min(id) AS dst FROM f GROUP BY ALL HAVING count(DISTINCT id) = 1), alone AS (SELECT name, min(id) AS dst, min(file_path) AS target FROM f GROUP BY name HAVING count(DISTINCT id) = 1)
SELECT c.src, coalesce(here.dst, alone.dst) AS dst, CASE WHEN here.dst IS NOT NULL THEN 'SameFileUnique' ELSE 'GlobalUnique' END AS justification FROM c LEFT JOIN here ON here.name = c.name AND here.file_path = c.file_path LEFT JOIN alone ON alone.name = c.name
WHERE here.dst IS NOT NULL OR (alone.dst IS NOT NULL AND split_part(alone.target, '/', 1) = split_part(c.file_path, '/', 1))""")
def resolve_calls(spark, sf):
    own = _evidence(Tables(spark, sf))
    return resolution.call_edges(spark, **own).where("relation = 'Calls'").select("src", "dst", "justification")


@query("""SELECT kind, least(n, 20) AS n FROM (SELECT 'dangling' AS kind, count(*) AS n FROM star_edges WHERE dst IN (SELECT id FROM star_nodes WHERE label = 'Class' AND line_start % 3 = 0)
UNION ALL SELECT 'justification', count(*) FROM star_edges WHERE relation = 'Calls') WHERE n > 0""")
def validate_graph(spark, sf):
    t = Tables(spark, sf)
    edges = t.edges().withColumns({"tier": F.lit("TreeSitter"), "justification": F.lit(None).cast("string")})
    found = lookups.violations(t.nodes().where("label <> 'Class' OR line_start % 3 <> 0"), edges)
    return found.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def queries() -> dict[str, Query]:
    from . import queries_rules, queries_store  # noqa: F401  (they register themselves)

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(ORACLE)
