import random

import pytest
from pyspark.sql import functions as F
from weftgraph.operators import coverage, graph, lookups, search, services
from weftgraph.plans import cypher
from weftgraph.plans.navigation import Navigator
from weftgraph.store import GraphStore


def edges(spark, pairs, relation="Calls"):
    return spark.createDataFrame([(a, b, relation, "Inferred") for a, b in pairs], "src string, dst string, relation string, confidence string")


def ids(spark, names):
    return spark.createDataFrame([(n,) for n in names], "id string")


def test_pagerank_is_the_plain_iteration(spark):
    rnd = random.Random(1)
    names = [f"n{i}" for i in range(12)]
    pairs = [(rnd.choice(names[:9]), rnd.choice(names)) for _ in range(30)]  # with parallel edges and dangling vertices
    for seeds, damping in (([], 0.85), (["n1", "n1", "n2"], 0.6)):
        t = {n: seeds.count(n) / len(seeds) if seeds else 1 / 12 for n in names}
        rank = dict(t)
        for _ in range(50):
            new = {n: 0.0 for n in names}
            loose = sum(rank[n] for n in names if all(a != n for a, _ in pairs))
            for a, b in pairs:
                new[b] += rank[a] / sum(x == a for x, _ in pairs)
            rank = {n: (1 - damping + damping * loose) * t[n] + damping * new[n] for n in names}
        frame = graph.personalized_pagerank(spark, ids(spark, names), edges(spark, pairs), seeds) if seeds else graph.pagerank(spark, ids(spark, names), edges(spark, pairs))
        got = {r.id: r.rank for r in frame.collect()}
        assert all(abs(got[n] - rank[n]) < 1e-12 for n in names) and abs(sum(got.values()) - 1) < 1e-9


def test_paths_and_reach(spark):
    e = edges(spark, [("a", "b"), ("b", "c"), ("a", "x"), ("x", "c"), ("c", "d"), ("d", "a")])
    assert [r.id for r in graph.shortest_path(spark, e, "a", "d").orderBy("step").collect()] == ["a", "b", "c", "d"]
    assert graph.shortest_path(spark, e, "a", "zz").count() == 0
    assert {(r.id, r.depth) for r in graph.blast_radius(spark, e, "c", 1).collect()} == {("b", 1), ("x", 1)}
    assert {(r.id, r.depth) for r in graph.flow_from(spark, e, "a", 2).collect()} == {("b", 1), ("x", 1), ("c", 2)}


def test_two_triangles_with_a_bridge(spark):
    pairs = [("a", "b"), ("b", "c"), ("c", "a"), ("d", "e"), ("e", "f"), ("f", "d"), ("c", "d")]
    names = "abcdef"
    found, quality = graph.communities(spark, ids(spark, names), edges(spark, pairs))
    home = {r.id: r.community for r in found.collect()}
    assert quality == "Exact" and home["a"] == home["b"] == home["c"] != home["d"] == home["e"] == home["f"]
    between = {r.id: r.betweenness for r in graph.betweenness(spark, ids(spark, names), edges(spark, pairs)).collect()}
    assert between["c"] == 7 and between["d"] == 7 and between["b"] == 4
    spread, quality = graph.communities(spark, ids(spark, names), edges(spark, pairs), most_edges=3)
    assert quality == "Approximate" and spread.count() == 6
    assert set(graph.layout(list(names), pairs, rounds=5)) == set(names)


def test_query_language():
    q = cypher.parse("MATCH (a:Function)-[:Calls]->(b) WHERE a.name = 'x AND y' AND b.file CONTAINS '50%' RETURN a.name, b.line LIMIT 7")
    assert q.relations == ["Calls"] and q.conditions == [("a", "name", "=", "x AND y"), ("b", "file", "CONTAINS", "50%")] and q.limit == 7
    for bad in ("MATCH (a) RETURN b.name", "MATCH (a) RETURN a.nope", "MATCH (a)-[:X]->(b)-[:X]->(c)-[:X]->(d) RETURN a.id", "MATCH (a) WHERE a.name > 3 RETURN a.id", "MATCH (a) RETURN a.id; DROP", "SELECT 1"):
        with pytest.raises(cypher.CypherError):
            cypher.parse(bad)


def test_read_only_sql(spark):
    spark.range(3).createOrReplaceTempView("some")
    assert sorted(r[0] for r in cypher.query_readonly(spark, "-- c\nSELECT id, null AS n FROM some").collect()) == ["0", "1", "2"]
    for bad in ("DROP TABLE some", "INSERT INTO some VALUES (1)", "WITH x AS (SELECT 1) INSERT INTO some SELECT * FROM x"):
        with pytest.raises(Exception):
            cypher.query_readonly(spark, bad)


def test_joins_of_spans_and_prefixes(spark):
    nodes = spark.createDataFrame([("c1", "C", "Class", "f", 1, 50), ("c2", "D", "Class", "f", 10, 20), ("m", "m", "Method", "f", 12, 14), ("n", "n", "Method", "f", 30, 31)], "id string, name string, label string, file_path string, line_start int, line_end int")
    assert {(r.id, r.class_id) for r in lookups.innermost_class(nodes).collect()} == {("m", "c2"), ("n", "c1")}
    sites = spark.createDataFrame([("f", 12), ("f", 13), ("f", 40), ("f", 99)], "file_path string, line int")
    assert {(r.line, r.id) for r in lookups.span_lookup(sites, nodes).collect()} == {(12, "m"), (13, "m"), (40, "c1")}
    near = lookups.nearest_definition(spark.createDataFrame([("a/b/x.py", "g")], "file_path string, name string"), spark.createDataFrame([("1", "g", "a/b/y.py"), ("2", "g", "a/z.py")], "id string, name string, file_path string"))
    assert near.first().id == "1"
    assert services.parse_name_status(b"M\0a.py\0R100\0old.py\0new.py\0D\0x\0") == [("M", "a.py", "a.py"), ("R", "new.py", "old.py"), ("D", "x", "x")]
    assert services.identifier_spans("go(gopher, go)", "go") == [(0, 2), (11, 13)]
    assert len(set(coverage.sample_indices(7, 100, 20))) == 20 and coverage.sample_indices(7, 3, 20) != []
    assert search.reranked([1, 2, 3], lambda rows: "3,1") == [3, 1, 2] and search.reranked([1, 2], lambda rows: "x") == [1, 2]


def test_answers(spark, tmp_path):
    store = GraphStore(spark, str(tmp_path / "g"))
    nodes = [("p.a.load", "load", "Function", "a.py", 1), ("p.a.save", "save", "Function", "a.py", 5), ("p.b.run", "run", "Function", "b.py", 1), ("p.b.idle", "idle", "Function", "b.py", 9), ("p.a.file", "a.py", "File", "a.py", 1)]
    store.replace("nodes", spark.createDataFrame([(*n, 0, 0.2) for n in nodes], "id string, name string, label string, file_path string, line_start int, community int, pagerank double"))
    store.replace("edges", edges(spark, [("p.b.run", "p.a.load"), ("p.b.run", "p.a.save"), ("p.a.save", "p.a.load")]))
    store.replace("calls", spark.createDataFrame([("p.b.run", "load", 2, "b.py", "load"), ("p.b.run", "save", 3, "b.py", "save"), ("p.b.run", "print", 4, "b.py", "print"), ("p.a.save", "load", 6, "a.py", "load")], "caller_id string, callee_name string, line int, file_path string, leaf_name string"))
    store.commit()
    n = Navigator(store)
    callers = n.callers("load")
    assert {r.id for r in callers.data.collect()} == {"p.b.run", "p.a.save"} and callers.coverage.first().resolved == 2 and callers.generation == 1
    assert {r.id for r in n.callees("p.b.run").data.collect()} == {"p.a.load", "p.a.save"} and n.callees("p.b.run").notes["unresolved"].count() == 0
    assert [r.id for r in n.path("run", "load").data.orderBy("step").collect()] == ["p.b.run", "p.a.load"]
    assert {(r.id, r.depth) for r in n.impact("load").data.collect()} == {("p.b.run", 1), ("p.a.save", 1)}
    assert {r.id for r in n.dead_code().data.collect()} == {"p.b.run", "p.b.idle"}
    assert n.search("load").data.first().id == "p.a.load" and n.important(1).data.count() == 1
    assert n.graph_query("MATCH (a)-[:Calls]->(b) WHERE b.name = 'save' RETURN a.id").data.first().a_id == "p.b.run"
    assert n.semantic("save").notes["degraded"] and n.stats()["nodes"] == 5
    assert {name: frame.count() for name, frame in n.report().items()}["overview"] == 2
    assert n.communities().data.first()["size"] == 4 and n.architecture()["labels"].count() == 2
