import pytest
from pyspark.sql import functions as F
from weftgraph.operators import resolution as R

NODES = "id string, name string, label string, language string, file_path string, line_start int, line_end int"
CALLS = "caller_id string, callee_name string, line int, file_path string, receiver struct<kind:string,name:string>, enclosing_class string"


def world(spark):
    n = lambda i, name, label, file, a, b, lang="typescript": (i, name, label, lang, file, a, b)
    nodes = [
        n("a.run", "run", "Function", "app/a.ts", 1, 5), n("a.help", "help", "Function", "app/a.ts", 7, 9),
        n("b.load", "load", "Function", "app/b.ts", 1, 3), n("c.load", "load", "Function", "app/c.ts", 1, 3),
        n("b.lone", "lone", "Function", "app/b.ts", 5, 6), n("z.far", "far", "Function", "lib/z.ts", 1, 2),
        n("s.svc", "Svc", "Class", "app/s.ts", 1, 20), n("s.svc.get", "get", "Method", "app/s.ts", 2, 4), n("s.svc.all", "all", "Method", "app/s.ts", 5, 8),
        n("s.base", "Base", "Class", "app/base.ts", 1, 9), n("s.base.ping", "ping", "Method", "app/base.ts", 2, 3),
        n("d1.repo", "Repo", "Class", "app/d1/repo.ts", 1, 9), n("d1.repo.find", "find", "Method", "app/d1/repo.ts", 2, 3),
        n("d2.repo", "Repo", "Class", "app/d2/repo.ts", 1, 9), n("d2.repo.find", "find", "Method", "app/d2/repo.ts", 2, 3),
        n("g1.pack", "pack", "Function", "go/p/x.go", 1, 2, "go"), n("g2.pack", "pack", "Function", "go/q/x.go", 1, 2, "go"), n("g1.use", "use", "Function", "go/p/y.go", 1, 2, "go"),
        n("t.check", "check", "Function", "app/tests/a.test.ts", 1, 4), n("route.u.GET", "GET /u", "Route", "app/a.ts", 1, 1),
        n("py.m", "m", "Function", "py/pkg/m.py", 1, 2, "python"), n("py.w", "work", "Function", "py/pkg/util.py", 1, 2, "python"), n("py.w2", "work", "Function", "py/other.py", 1, 2, "python"),
    ]
    c = lambda who, callee, file, kind="Bare", name=None, cls=None, line=1: (who, callee, line, file, (kind, name), cls)
    calls = [
        c("a.run", "help", "app/a.ts"), c("a.run", "help", "app/a.ts", line=2), c("a.run", "load", "app/a.ts"), c("a.help", "load", "app/n.ts"), c("a.run", "lone", "app/a.ts"),
        c("a.run", "far", "app/a.ts"), c("a.run", "run", "app/a.ts"), c("s.svc.all", "get", "app/s.ts", "SelfThis", None, "s.svc"), c("s.svc.all", "ping", "app/s.ts", "SelfThis", None, "s.svc"),
        c("s.svc.all", "find", "app/s.ts", "Field", "repo", "s.svc"), c("a.run", "get", "app/a.ts", "Named", "svc"), c("a.run", "get", "app/a.ts", "Named", "mystery"),
        c("s.svc.get", "find", "app/s.ts", "Named", "repo", "s.svc"), c("s.svc.all", "find", "app/s.ts", "Named", "repo", "s.svc"), c("g1.use", "pack", "go/p/y.go"),
        c("t.check", "help", "app/tests/a.test.ts"), c("a.run", "route.u.GET", "app/a.ts"), c("py.m", "work", "py/pkg/m.py"), c("a.help", "lone", "app/a.ts"),
    ]
    make = spark.createDataFrame
    return {
        "nodes": make(nodes, NODES), "calls": make(calls, CALLS),
        "inherits": make([("Svc", "Base", "Extends", "app/s.ts")], "impl_name string, super_name string, kind string, file_path string"),
        "fields": make([("s.svc", "repo", "Repo", "app/s.ts")], "class_id string, field_name string, type_name string, file_path string"),
        "variables": make([("a.run", "svc", "Svc", "app/a.ts"), ("a.help", "lone", "", "app/a.ts"), ("s.svc.get", "repo", "", "app/s.ts")], "caller_id string, var_name string, type_name string, file_path string"),
        "imports": make([("app/a.ts", "load", "./b"), ("app/s.ts", "Repo", "./d2/repo"), ("py/pkg/m.py", "work", "pkg.util")], "file_path string, name string, module string"),
    }


def test_tiers_and_gates(spark):
    w = world(spark)
    got = {(r.src, r.dst, r.relation): r.justification for r in R.call_edges(spark, **w).collect()}
    assert got == {
        ("a.run", "a.help", "Calls"): "SameFileUnique", ("a.run", "b.load", "Calls"): "ImportNarrowed", ("a.run", "b.lone", "Calls"): "GlobalUnique",
        ("s.svc.all", "s.svc.get", "Calls"): "SelfThisMember", ("s.svc.all", "s.base.ping", "Calls"): "SelfThisMember", ("s.svc.all", "d2.repo.find", "Calls"): "FieldTypeMember",
        ("a.run", "s.svc.get", "Calls"): "LocalVarType", ("g1.use", "g1.pack", "Calls"): "PackageScope", ("t.check", "a.help", "Calls"): "GlobalUnique", ("t.check", "a.help", "Tests"): "GlobalUnique",
        ("a.run", "route.u.GET", "HttpCalls"): "HttpPath", ("py.m", "py.w", "Calls"): "ImportNarrowed",
    }


def test_ambiguous_and_partial(spark):
    w = world(spark)
    both = {(r.src, r.dst) for r in R.call_edges(spark, **w, ambiguous=True).where("confidence = 'Ambiguous'").collect()}
    assert both == {("a.help", "b.load"), ("a.help", "c.load")}
    some = spark.createDataFrame([("app/s.ts",)], "file_path string")
    full = {tuple(r) for r in R.call_edges(spark, **w).where("src_file = 'app/s.ts'").collect()}
    assert {tuple(r) for r in R.call_edges(spark, **w, only_files=some).collect()} == full


def test_inheritance(spark):
    w = world(spark)
    extra = spark.createDataFrame([("i.face", "Face", "Interface", "java", "x.java", 1, 2), ("i.one", "One", "Class", "java", "x.java", 3, 4), ("i.two", "Two", "Class", "java", "x.java", 5, 6)], NODES)
    rows = spark.createDataFrame([("One", "Face", "Extends", "x.java"), ("Two", "Face", "Implements", "x.java"), ("Svc", "Base", "Implements", "app/s.ts"), ("One", "Repo", "Extends", "x.java")], w["inherits"].schema)
    edges = R.inheritance_edges(w["nodes"].unionByName(extra), rows)
    assert {(r.src, r.dst, r.relation) for r in edges.collect()} == {("i.one", "i.face", "Implements"), ("i.two", "i.face", "Implements"), ("s.svc", "s.base", "Inherits")}
    (hyper,) = R.implementer_hyperedges(edges).collect()
    assert [(m.node_id, m.role) for m in hyper.members] == [("i.one", "implementer"), ("i.two", "implementer"), ("i.face", "interface")]


def test_compiler_edges_replace(spark):
    old = spark.createDataFrame([("a", "b", "Calls", "TreeSitter"), ("a", "c", "Calls", "TreeSitter")], "src string, dst string, relation string, tier string")
    new = old.where(F.col("dst") == "b").withColumn("tier", F.lit("Scip"))
    assert sorted((r.dst, r.tier) for r in R.superseded(old, new).collect()) == [("b", "Scip"), ("c", "TreeSitter")]


def test_nothing(spark):
    w = {k: v.limit(0) for k, v in world(spark).items()}
    assert R.call_edges(spark, **w).count() == 0
