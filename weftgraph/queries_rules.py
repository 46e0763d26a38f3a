"""Registered queries of call resolution, inheritance and evidence, one for each rule, over suppliers as code.

Each supplier is a class `class.s` with one method `class.s.m` named m_(s % 7), and a function `fn.s` named fn_(s % 40)
below it, in the file of its nation. Inheritance leads from each class to the next one unless s % 3 = 0.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .fixtures_graph import Tables
from .operators import coverage, lookups, resolution, services
from .registry import query

FILE = "concat('r', r, '/n', n, '.ts') AS file_path"
LINES = "CAST({} AS INT) AS line_start", "CAST({} AS INT) AS line_end"
INPUTS = {
    "inherits": "impl_name string, super_name string, kind string, file_path string", "fields": "class_id string, field_name string, type_name string, file_path string",
    "variables": "caller_id string, var_name string, type_name string, file_path string", "imports": "file_path string, name string, module string",
}


def _node(rows: DataFrame, id_: str, name: str, label: str, first: str, last: str, file: str = FILE, language: str = "typescript") -> DataFrame:
    return rows.selectExpr(f"{id_} AS id", f"{name} AS name", f"'{label}' AS label", f"'{language}' AS language", file, LINES[0].format(first), LINES[1].format(last))


def _nodes(t: Tables) -> DataFrame:
    s = t.sup()
    classes = _node(s, "concat('class.', s)", "concat('Class_', s)", "Class", "100 * s", "100 * s + 50")
    methods = _node(s, "concat('class.', s, '.m')", "concat('m_', s % 7)", "Method", "100 * s + 1", "100 * s + 3")
    return classes.union(methods).union(_functions(s))


def _functions(s: DataFrame) -> DataFrame:
    return _node(s, "concat('fn.', s)", "concat('fn_', s % 40)", "Function", "100 * s + 60", "100 * s + 70")


def _calls(rows: DataFrame, callee: str, kind: str = "Bare", receiver: str = "CAST(NULL AS STRING)", caller: str = "concat('fn.', s)", file: str = FILE) -> DataFrame:
    return rows.selectExpr(f"{caller} AS caller_id", f"{callee} AS callee_name", "1 AS line", file, f"named_struct('kind', '{kind}', 'name', {receiver}) AS receiver", "concat('class.', s) AS enclosing_class")


def _above(t: Tables) -> DataFrame:
    return t.sup().where("s % 3 <> 0").selectExpr("concat('Class_', s) AS impl_name", "concat('Class_', s + 1) AS super_name", "'Extends' AS kind", FILE)


def _resolved(t: Tables, nodes: DataFrame, calls: DataFrame, **more) -> DataFrame:
    options = {k: v for k, v in more.items() if k not in INPUTS}
    own = {k: more.get(k, t.spark.createDataFrame([], schema)) for k, schema in INPUTS.items()}
    return resolution.call_edges(t.spark, nodes, calls, own["inherits"], own["fields"], own["variables"], own["imports"], **options)


def _edges(found: DataFrame) -> DataFrame:
    return found.where("relation = 'Calls'").select("src", "dst", "justification")


def _climb(start: str, wanted: str, justification: str, where: str = "true") -> str:
    """From the class that start gives up to the first one with the wanted method; both ends in one region."""
    return f"""WITH RECURSIVE up(s, c) AS (SELECT sup.s, k.s FROM sup JOIN sup k ON k.s = {start} WHERE {where} UNION ALL SELECT up.s, k.s FROM up JOIN sup k ON k.s = up.c + 1 JOIN sup ON sup.s = up.s WHERE up.c % 3 <> 0 AND up.c % 7 <> {wanted})
SELECT 'fn.' || up.s AS src, 'class.' || up.c || '.m' AS dst, {justification} AS justification FROM up JOIN sup ON sup.s = up.s JOIN sup b ON b.s = up.c WHERE up.c % 7 = {wanted} AND sup.r = b.r"""


@query(_climb("sup.s", "(sup.s * 5) % 7", "'SelfThisMember'"))
def resolve_self(spark, sf):
    t = Tables(spark, sf)
    return _edges(_resolved(t, _nodes(t), _calls(t.sup(), "concat('m_', s * 5 % 7)", "SelfThis"), inherits=_above(t)))


@query(_climb("sup.s * 3 % 10 + 1", "sup.s % 7", "'FieldTypeMember'"))
def resolve_field(spark, sf):
    t = Tables(spark, sf)
    fields = t.sup().selectExpr("concat('class.', s) AS class_id", "'repo' AS field_name", "concat('Class_', s * 3 % 10 + 1) AS type_name", FILE)
    return _edges(_resolved(t, _nodes(t), _calls(t.sup(), "concat('m_', s % 7)", "Field", "'repo'"), inherits=_above(t), fields=fields))


@query(_climb("CASE WHEN sup.s % 4 = 0 THEN sup.s * 7 % 10 + 1 ELSE sup.s * 3 % 10 + 1 END", "sup.s % 7", "CASE WHEN sup.s % 4 = 0 THEN 'FieldTypeMember' ELSE 'LocalVarType' END", "sup.s % 4 <> 1"))
def resolve_local(spark, sf):
    """A typed local decides, one without a type hides the field of its name, and without a local the field counts."""
    t = Tables(spark, sf)
    own = t.sup().where("s % 4 <> 0").selectExpr("concat('fn.', s) AS caller_id", "'svc' AS var_name", "CASE WHEN s % 4 = 1 THEN '' ELSE concat('Class_', s * 3 % 10 + 1) END AS type_name", FILE)
    fields = t.sup().selectExpr("concat('class.', s) AS class_id", "'svc' AS field_name", "concat('Class_', s * 7 % 10 + 1) AS type_name", FILE)
    return _edges(_resolved(t, _nodes(t), _calls(t.sup(), "concat('m_', s % 7)", "Named", "'svc'"), inherits=_above(t), fields=fields, variables=own))


@query("""SELECT 'fn.' || a.s AS src, min('dup.' || b.s || '.m') AS dst, 'LocalVarType' AS justification FROM sup a JOIN sup b ON b.r = a.r AND b.n = (a.n + 5) % 25 AND b.s % 5 = a.s % 5 GROUP BY a.s HAVING count(*) = 1""")
def resolve_type_by_import(spark, sf):
    """A type whose name several classes have is told by the file that the caller's file imports it from."""
    t = Tables(spark, sf)
    s = t.sup()
    classes = _node(s, "concat('dup.', s)", "concat('Dup_', s % 5)", "Class", "100 * s", "100 * s + 50")
    twins = _node(s, "concat('twin.', s)", "concat('Dup_', s % 5)", "Class", "1", "2", "'far/off.py' AS file_path")
    methods = _node(s, "concat('dup.', s, '.m')", "'get'", "Method", "100 * s + 1", "100 * s + 3")
    own = s.selectExpr("concat('fn.', s) AS caller_id", "'svc' AS var_name", "concat('Dup_', s % 5) AS type_name", FILE)
    imports = s.selectExpr(FILE, "concat('Dup_', s % 5) AS name", "concat('./n', (n + 5) % 25) AS module").distinct()
    return _edges(_resolved(t, classes.union(twins).union(methods).union(_functions(s)), _calls(s, "'get'", "Named", "'svc'"), variables=own, imports=imports))


BARE = """WITH c AS (SELECT s, n, r, s * 3 % 40 AS k FROM sup),
here AS (SELECT c.s, min(f.s) AS d FROM c JOIN sup f ON f.n = c.n AND f.s % 40 = c.k GROUP BY c.s HAVING count(*) = 1),
near AS (SELECT c.s, min(f.s) AS d FROM c JOIN sup f ON f.n = (c.n + 5) % 25 AND f.r = c.r AND f.s % 40 = c.k GROUP BY c.s HAVING count(*) = 1),
alone AS (SELECT s % 40 AS k, min(s) AS d FROM sup GROUP BY ALL HAVING count(*) = 1),
p AS (SELECT c.*, coalesce(here.d, near.d, alone.d) AS d, CASE WHEN here.d IS NOT NULL THEN 'SameFileUnique' WHEN near.d IS NOT NULL THEN 'ImportNarrowed' ELSE 'GlobalUnique' END AS j FROM c LEFT JOIN here USING (s) LEFT JOIN near USING (s) LEFT JOIN alone ON alone.k = c.k)
SELECT 'fn.' || p.s AS src, 'fn.' || p.d AS dst, p.j AS justification FROM p JOIN sup b ON b.s = p.d WHERE p.d <> p.s AND (p.j = 'ImportNarrowed' OR b.r = p.r)"""


def _bare(t: Tables, **more) -> DataFrame:
    s = t.sup()
    imports = s.selectExpr(FILE, "concat('fn_', s * 3 % 40) AS name", "concat('./n', (n + 5) % 25) AS module").distinct()
    return _edges(_resolved(t, _nodes(t), _calls(s, "concat('fn_', s * 3 % 40)"), imports=imports, **more))


@query(BARE)
def resolve_import(spark, sf):
    return _bare(Tables(spark, sf))


@query(f"{BARE} AND p.n % 2 = 0")
def resolve_files(spark, sf):
    """Resolution of the sites of some files only, against everything."""
    t = Tables(spark, sf)
    return _bare(t, only_files=t.sup().where("n % 2 = 0").selectExpr(FILE).distinct())


@query("""WITH c AS (SELECT s, n, s * 3 % 10 AS k FROM sup), here AS (SELECT c.s, min(f.s) AS d FROM c JOIN sup f ON f.n = c.n AND f.s % 3 = c.s % 3 AND f.s % 10 = c.k GROUP BY c.s HAVING count(*) = 1),
pack AS (SELECT c.s, min(f.s) AS d FROM c JOIN sup f ON f.n = c.n AND f.s % 10 = c.k GROUP BY c.s HAVING count(*) = 1), alone AS (SELECT s % 10 AS k, min(s) AS d FROM sup GROUP BY ALL HAVING count(*) = 1),
p AS (SELECT c.s, c.n, coalesce(here.d, pack.d, alone.d) AS d, CASE WHEN here.d IS NOT NULL THEN 'SameFileUnique' WHEN pack.d IS NOT NULL THEN 'PackageScope' ELSE 'GlobalUnique' END AS j FROM c LEFT JOIN here USING (s) LEFT JOIN pack USING (s) LEFT JOIN alone ON alone.k = c.k)
SELECT 'g.' || p.s AS src, 'g.' || p.d AS dst, p.j AS justification FROM p JOIN sup b ON b.s = p.d WHERE p.d <> p.s AND b.n = p.n""")
def resolve_package(spark, sf):
    t = Tables(spark, sf)
    file = "concat('p', n, '/f', s % 3, '.go') AS file_path"
    nodes = _node(t.sup(), "concat('g.', s)", "concat('g_', s % 10)", "Function", "100 * s", "100 * s + 5", file, "go")
    return _edges(_resolved(t, nodes, _calls(t.sup(), "concat('g_', s * 3 % 10)", caller="concat('g.', s)", file=file)))


@query("""WITH k AS (SELECT n, count(*) AS c FROM sup GROUP BY n) SELECT 'fn.' || a.s AS src, 'amb.' || b.s AS dst, CASE WHEN k.c = 1 THEN 'GlobalUnique' ELSE 'Ambiguous' END AS justification, CASE WHEN k.c = 1 THEN 'Inferred' ELSE 'Ambiguous' END AS confidence
FROM sup a JOIN k ON k.n = (a.n + 1) % 25 AND k.c <= 5 JOIN sup b ON b.n = k.n""")
def resolve_ambiguous(spark, sf):
    t = Tables(spark, sf)
    file = "concat('x/f', s, '.ts') AS file_path"
    nodes = _node(t.sup(), "concat('amb.', s)", "concat('amb_', n)", "Function", "1", "5", file)
    return _resolved(t, nodes, _calls(t.sup(), "concat('amb_', (n + 1) % 25)", file=file), ambiguous=True).select("src", "dst", "justification", "confidence")


@query("SELECT DISTINCT 'fn.' || page_id AS src, id AS dst, 'HttpPath' AS justification FROM routes WHERE page_id % 2 = 0")
def http_hub_edges(spark, sf):
    t = Tables(spark, sf)
    routes = t.routes()
    nodes = routes.select("id", "name").distinct().selectExpr("id", "name", "'Route' AS label", "'typescript' AS language", "'r/web.ts' AS file_path", "1 AS line_start", "1 AS line_end")
    calls = routes.withColumn("s", F.col("page_id"))
    made = _calls(calls, "CASE WHEN page_id % 2 = 0 THEN id ELSE 'route._missing_.GET' END", file="'r/web.ts' AS file_path")
    return _resolved(t, nodes, made).where("relation = 'HttpCalls'").select("src", "dst", "justification")


@query("SELECT 'fn.' || s AS src, 'u.' || s AS dst, x.relation FROM sup CROSS JOIN (VALUES ('Calls'), ('Tests')) x(relation) WHERE x.relation = 'Calls' OR s % 2 = 0")
def tests_projection(spark, sf):
    t = Tables(spark, sf)
    nodes = _node(t.sup(), "concat('u.', s)", "concat('uniq_', s)", "Function", "1", "5", "concat('r', r, '/u.ts') AS file_path")
    file = "CASE WHEN s % 2 = 0 THEN concat('r', r, '/tests/n', n, '.ts') ELSE concat('r', r, '/n', n, '.ts') END AS file_path"
    return _resolved(t, nodes, _calls(t.sup(), "concat('uniq_', s)", file=file)).select("src", "dst", "relation")


def _types(t: Tables) -> DataFrame:
    return _nodes(t).withColumn("label", F.when((F.col("label") == "Class") & (F.col("line_start") % 400 == 0), "Interface").otherwise(F.col("label")))


@query("SELECT 'class.' || a.s AS src, 'class.' || b.s AS dst, CASE WHEN b.s % 4 = 0 THEN 'Implements' ELSE 'Inherits' END AS relation FROM sup a JOIN sup b ON b.s = a.s + 1 WHERE a.s % 3 <> 0")
def inheritance_edges(spark, sf):
    t = Tables(spark, sf)
    return resolution.inheritance_edges(_types(t), _above(t)).select("src", "dst", "relation")


@query("SELECT 'implement.iface.' || (s % 6) AS id, string_agg('class.' || s || ':implementer', ',' ORDER BY 'class.' || s) || ',iface.' || (s % 6) || ':interface' AS members FROM sup WHERE s % 5 <> 0 GROUP BY s % 6 HAVING count(*) > 1")
def implementer_hyperedges(spark, sf):
    own = Tables(spark, sf).sup().where("s % 5 <> 0").selectExpr("concat('class.', s) AS src", "concat('iface.', s % 6) AS dst", "'Implements' AS relation")
    found = resolution.implementer_hyperedges(own)
    return found.select("id", F.array_join(F.transform("members", lambda m: F.concat(m["node_id"], F.lit(":"), m["role"])), ",").alias("members"))


COMPILER = "SELECT DISTINCT 'customer.' || o_custkey AS src, 'supplier.' || l_suppkey AS dst FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_suppkey % 5 = 0"


@query(f"SELECT src, dst, CASE WHEN max(tier) = 'a' THEN 'TreeSitter' ELSE 'Scip' END AS tier FROM (SELECT src, dst, 'a' AS tier FROM star_edges WHERE relation = 'Calls' UNION ALL SELECT src, dst, 'b' FROM ({COMPILER})) GROUP BY src, dst")
def merge_supersede(spark, sf):
    """Compiler-grade edges take the place of syntactic ones with their key and are added where there is none."""
    t = Tables(spark, sf)
    old = t.edges().where("relation = 'Calls'").select("src", "dst", "relation").withColumn("tier", F.lit("TreeSitter"))
    lines = t.read("lineitem").where("l_suppkey % 5 = 0").join(t.read("orders"), F.col("o_orderkey") == F.col("l_orderkey"))
    new = lines.selectExpr("concat('customer.', o_custkey) AS src", "concat('supplier.', l_suppkey) AS dst", "'Calls' AS relation", "'Scip' AS tier").distinct()
    return resolution.superseded(old, new).select("src", "dst", "tier")


@query("SELECT 'file.' || n AS src, x.p || s || x.q AS dst FROM sup CROSS JOIN (VALUES ('class.', ''), ('class.', '.m'), ('fn.', '')) x(p, q)")
def defines_edges(spark, sf):
    t = Tables(spark, sf)
    files = _node(t.sup().select("n", "r").distinct(), "concat('file.', n)", "concat('n', n)", "File", "0", "0")
    return lookups.defines_edges(_nodes(t).union(files)).select("src", "dst")


@query("SELECT 'class.' || s || '.m' AS id, 'class.' || s AS class_id FROM sup")
def smallest_class(spark, sf):
    """Methods in the smallest of the classes around them: here each class lies in an outer one of twice the lines."""
    t = Tables(spark, sf)
    outer = _node(t.sup(), "concat('outer.', s)", "concat('Outer_', s)", "Class", "100 * s - 20", "100 * s + 55")
    return lookups.innermost_class(_nodes(t).where("label <> 'Function'").union(outer)).select("id", "class_id")


@query("""SELECT s, CASE WHEN s % 4 = 0 THEN 'class.' || s WHEN s % 4 = 1 THEN 'class.' || s || '.m' WHEN s % 4 = 2 THEN 'class.' || s ELSE 'fn.' || s END AS id FROM sup""")
def span_lookup(spark, sf):
    """A node that starts on the line, else the latest start whose span holds it."""
    t = Tables(spark, sf)
    sites = t.sup().selectExpr("s", FILE, "CAST(100 * s + CASE s % 4 WHEN 0 THEN 0 WHEN 1 THEN 2 WHEN 2 THEN 30 ELSE 60 END AS INT) AS line")
    return lookups.span_lookup(sites, _nodes(t)).select("s", "id")


@query("""WITH f AS (SELECT DISTINCT 'r' || r || '/x/n' || n || '.ts' AS site, r FROM sup), d AS (SELECT 'fn.' || s AS id, 'r' || r || '/n' || n || '.ts' AS file_path, r FROM sup WHERE s % 40 = 7)
SELECT site, id FROM (SELECT site, id, row_number() OVER (PARTITION BY site ORDER BY CASE WHEN f.r = d.r THEN 1 ELSE 0 END DESC, d.file_path, d.id) AS place FROM f CROSS JOIN d) WHERE place = 1""")
def nearest_definition(spark, sf):
    t = Tables(spark, sf)
    sites = t.sup().selectExpr("concat('r', r, '/x/n', n, '.ts') AS file_path").distinct().withColumn("name", F.lit("fn_7"))
    return lookups.nearest_definition(sites, _functions(t.sup())).select("site", "id")


@query("""SELECT 'u.' || s AS id, CASE WHEN s % 3 = 0 THEN 'Resolved' WHEN s % 3 = 1 THEN 'TextualOnly' ELSE 'None' END AS evidence FROM sup""")
def test_evidence(spark, sf):
    t = Tables(spark, sf)
    nodes = _node(t.sup(), "concat('u.', s)", "concat('uniq_', s)", "Function", "1", "5")
    edges = t.sup().where("s % 3 = 0").selectExpr("'t' AS src", "concat('u.', s) AS dst", "'Tests' AS relation")
    calls = t.sup().selectExpr("concat('uniq_', s) AS leaf_name", "CASE WHEN s % 3 = 1 THEN 'a/tests/x.ts' ELSE 'a/latest/x.ts' END AS file_path")
    return coverage.test_evidence(nodes, edges, calls)


@query("SELECT 'f' || s AS file_path, CASE WHEN s % 2 = 0 THEN 'IndexedWithSymbols' WHEN s % 3 = 0 THEN 'IndexedWithoutSymbols' ELSE 'NotIndexed' END AS coverage FROM sup")
def file_coverage(spark, sf):
    t = Tables(spark, sf)
    path = "concat('f', s) AS file_path"
    return coverage.file_coverage(t.sup().selectExpr(path), t.sup().where("s % 2 = 0").selectExpr(path, "'Function' AS label"), t.sup().where("s % 3 = 0").selectExpr(path))


@query("""SELECT * FROM (SELECT 'class.' || s AS owner, 'repo' AS name, 'Class_' || (s % 10) AS type_name, 'r' || r || '/n' || n || '.ts' AS file_path FROM sup WHERE s % 10 = 3
UNION SELECT 'fn.' || s, 'Class_3', 'T', 'r' || r || '/n' || n || '.ts' FROM sup WHERE s % 4 = 1) ORDER BY file_path, owner, name LIMIT 25""")
def field_matches(spark, sf):
    t = Tables(spark, sf)
    fields = t.sup().selectExpr("concat('class.', s) AS class_id", "'repo' AS field_name", "concat('Class_', s % 10) AS type_name", FILE)
    variables = t.sup().selectExpr("concat('fn.', s) AS caller_id", "'Class_3' AS var_name", "CASE WHEN s % 4 = 1 THEN 'T' ELSE '' END AS type_name", FILE)
    return lookups.field_matches(fields, variables, "Class_3")


@query("SELECT 'class.' || a.s AS id, 'Class_' || a.s AS name FROM sup a WHERE a.s % 3 <> 0 AND a.s % 10 = 3 AND EXISTS (SELECT 1 FROM sup b WHERE b.s = a.s + 1)")
def implementers_of(spark, sf):
    """Classes with an inheritance edge into any of the classes that share a name."""
    t = Tables(spark, sf)
    edges = resolution.inheritance_edges(_types(t), _above(t)).withColumn("confidence", F.lit("Extracted"))
    nodes = _types(t).withColumn("name", F.when(F.col("label").isin("Class", "Interface") & (F.col("line_start") % 1000 == 400), "Four").otherwise(F.col("name")))
    return lookups.implementers_of(nodes, edges, "Four").select("id", "name")


@query("SELECT src, dst, relation FROM star_edges WHERE src IN (SELECT id FROM star_nodes WHERE label <> 'Class' OR line_start % 3 <> 0) AND dst IN (SELECT id FROM star_nodes WHERE label <> 'Class' OR line_start % 3 <> 0)")
def heal_dangling(spark, sf):
    t = Tables(spark, sf)
    return lookups.without_dangling(t.nodes().where("label <> 'Class' OR line_start % 3 <> 0"), t.edges()).select("src", "dst", "relation")


@query("SELECT 'fn_' || s AS name, 'f' || (s % 9) AS file_path, CASE WHEN s % 9 = 0 THEN 'FileDeleted' WHEN s % 9 = 1 THEN 'LostInRename' ELSE 'RemovedFromFile' END AS disposition FROM sup WHERE s % 4 = 0")
def vanished_symbols(spark, sf):
    """Symbols of a base revision that are gone: every fourth one; f0 was deleted, f1 became g1."""
    t = Tables(spark, sf)
    base = t.sup().selectExpr("concat('fn_', s) AS name", "concat('f', s % 9) AS file_path")
    now = t.sup().where("s % 4 <> 0").selectExpr("concat('fn_', s) AS name", "CASE WHEN s % 9 = 1 THEN 'g1' ELSE concat('f', s % 9) END AS file_path")
    moved = spark.createDataFrame([("f1", "g1")], "old_path string, new_path string")
    changed = spark.createDataFrame([("f0", "D"), ("g1", "R"), ("f2", "M")], "file_path string, kind string")
    return services.vanished_symbols(base, now, moved, changed)


@query("""WITH p AS (SELECT a.file_path AS file_a, b.file_path AS file_b, count(*) AS n FROM commits a JOIN commits b ON a.commit_id = b.commit_id AND a.file_path < b.file_path WHERE a.commit_id IN (SELECT commit_id FROM commits GROUP BY commit_id HAVING count(*) BETWEEN 2 AND 30) GROUP BY ALL HAVING count(*) >= 2),
b AS (SELECT file_a AS f, file_b AS other, n FROM p UNION ALL SELECT file_b, file_a, n FROM p) SELECT other, max(n) AS n FROM b WHERE f IN ('click_3', 'view_1') AND other NOT IN ('click_3', 'view_1') AND n >= 3 GROUP BY other""")
def review_hints(spark, sf):
    t = Tables(spark, sf)
    changed = spark.createDataFrame([("click_3",), ("view_1",)], "file_path string")
    return services.review_hints(lookups.cochange_pairs(t.commits()), changed)


@query("SELECT 'f' || s AS file_path, CASE WHEN s % 3 = 0 THEN 'added' WHEN s % 3 = 1 THEN 'removed' ELSE 'touched' END AS state FROM sup WHERE NOT (s % 3 = 2 AND s % 2 = 0)")
def staleness(spark, sf):
    t = Tables(spark, sf)
    now = t.sup().where("s % 3 <> 1").selectExpr("concat('f', s) AS file_path", "s AS mtime")
    then = t.sup().where("s % 3 <> 0").selectExpr("concat('f', s) AS file_path", "s + s % 2 AS mtime")
    return services.staleness(now, then)
