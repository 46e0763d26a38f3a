from pyspark.sql import functions as F
from weftgraph.functions import scalars as S


def values(spark, rows, schema, column):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column).collect()]


def test_names_and_paths(spark):
    one = lambda items: [(i,) for i in items]
    assert values(spark, one(["HTTPServer2Go_x", "plain", "getUser", "", "a_b", "X1"]), "n string", S.subwords("n")) == ["http server 2 go x", "", "get user", "", "a b", "x 1"]
    assert values(spark, one(["a::b::c.d", "x.y", "z", "p::q"]), "n string", S.leaf_name("n")) == ["d", "y", "z", "q"]
    assert values(spark, one(["LoginUITests.swift", "contest.py", "src/test/a.py", "a_spec.rb", "latest.js", "testing/x"]), "n string", S.is_test_path("n")) == [True, False, True, True, False, True]
    assert values(spark, one(["F-G", "b/c", "__x__", "é"]), "n string", S.id_segment("n")) == ["f_g", "b_c", "x", ""]
    assert values(spark, [("A", "b/c.x", "F-G")], "p string, q string, r string", S.qualified_id("p", "q", "r")) == ["a.b.c.x.f_g"]
    assert values(spark, one(["a/b", "a", ""]), "n string", S.top_segment("n")) == ["a", "", ""]
    assert values(spark, [("a/b", "../c"), ("a", "./d/./e"), ("", "../x")], "d string, m string", S.joined_path("d", "m")) == ["a/c", "a/d/e", "x"]
    assert values(spark, [("get", "/a/{b}")], "m string, p string", S.route_id("m", "p")) == ["route._a__b_.GET"]
    assert values(spark, [("api/", "/x//y"), ("", "")], "a string, b string", S.joined_route("a", "b")) == ["/api/x/y", "/"]
    assert values(spark, one(["", "a\\b", "/a", "c:x", "a/../b", "a//b", "a/b.py"]), "n string", S.unsafe_path_reason("n")) == ["empty", "backslash", "absolute", "drive prefix", "dot segment", "empty segment", None]


def test_receivers_labels_and_scores(spark):
    got = values(spark, [(None,), ("self",), ("this.repo",), ("super",), ("a.b",), ("svc",)], "t string", S.receiver("t"))
    assert [(r.kind, r.name) for r in got] == [("Bare", None), ("SelfThis", None), ("Field", "repo"), ("Super", None), ("Named", "a.b"), ("Named", "svc")]
    rows = [("p.svc.run", "run", "app/m.py", 3), ("p.m.run", "run", "app/m.py", 3)]
    assert values(spark, rows, "i string, n string, f string, l int", S.display_label("i", "n", "f", "l")) == ["svc.run (app/m.py:3)", "run (app/m.py:3)"]
    tier = values(spark, [(0, 1, "Resolved"), (10, 10, "None"), (5, 5, "None")], "f int, c int, t string", S.risk_tier(S.risk("f", "c", "t")))
    assert tier == ["LOW", "HIGH", "MED"]
    vectors = [([3.0, 4.0], [3.0, 4.0, 9.0]), ([0.0, 0.0], [1.0, 0.0])]
    assert [round(x, 6) for x in values(spark, vectors, "a array<float>, b array<float>", S.dot("a", "b"))] == [25.0, 0.0]
    assert [list(map(lambda x: round(x, 6), v)) for v in values(spark, vectors, "a array<float>, b array<float>", S.normalised("a"))] == [[0.6, 0.8], [0.0, 0.0]]
    assert S.search_terms("Load the the config_file x", least=3) == ["load", "the", "config_file"]


def test_sql_functions(spark):
    S.register(spark)
    row = spark.sql("SELECT wg_leaf_name('a::b.c'), wg_is_test_path('x/FooTests.kt'), wg_subwords('loadUser2')").first()
    assert tuple(row) == ("c", True, "load user 2")
    assert spark.range(1).select(F.expr("wg_subwords('one')")).first()[0] == ""
