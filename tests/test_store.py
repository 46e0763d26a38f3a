import pytest
from weftgraph.operators import incremental as I
from weftgraph.store import GraphStore, StoreError

EDGES = "src string, dst string, relation string, tier string, src_file string"


def nodes(spark, *rows):
    return spark.createDataFrame([(i, i, "Function", f) for i, f in rows], "id string, name string, label string, file_path string")


def test_versions_upserts_and_deletes(spark, tmp_path):
    s = GraphStore(spark, str(tmp_path / "g"))
    assert s.generation == 0 and s.table("nodes").count() == 0
    s.replace("nodes", nodes(spark, ("a", "x.py"), ("b", "y.py")))
    s.replace("edges", spark.createDataFrame([("a", "b", "Calls", "TreeSitter", "x.py"), ("a", "gone", "Calls", "TreeSitter", "x.py")], EDGES))
    s.set_meta("root", "/r")
    assert s.commit() == 1 and GraphStore(spark, s.root).meta("root") == "/r"
    before = s.canonical_hash()
    s.upsert("edges", spark.createDataFrame([("a", "b", "Calls", "Scip", "x.py")], EDGES), keep_existing=True)
    assert s.canonical_hash() == before
    s.upsert("edges", spark.createDataFrame([("a", "b", "Calls", "Scip", "x.py")], EDGES))
    assert {(r.dst, r.tier) for r in s.table("edges").collect()} == {("b", "Scip"), ("gone", "TreeSitter")} and s.canonical_hash() != before
    s.rollback()
    assert s.canonical_hash() == before
    s.update_analytics(spark.createDataFrame([("a", 7)], "id string, community int"))
    assert {r.id: r.community for r in s.table("nodes").collect()} == {"a": 7, "b": None} and s.canonical_hash() == before
    s.delete_files(spark.createDataFrame([("x.py",)], "file_path string"))
    assert [r.id for r in s.table("nodes").collect()] == ["b"]
    s.delete_edges(tier="TreeSitter")
    assert s.table("edges").count() == 0
    other = GraphStore(spark, s.root)
    s.commit()
    with pytest.raises(StoreError):
        other.commit()


def test_export_and_import(spark, tmp_path):
    s = GraphStore(spark, str(tmp_path / "g"))
    s.replace("nodes", nodes(spark, ("a", "x.py"), ("b", "y.py")))
    s.replace("edges", spark.createDataFrame([("a", "b", "Calls", "Scip", "x.py"), ("a", "gone", "Calls", "Scip", "x.py")], EDGES))
    s.commit()
    s.export(str(tmp_path / "out"))
    t = GraphStore(spark, str(tmp_path / "h"))
    assert t.import_(str(tmp_path / "out")) == 1 and [r.dst for r in t.table("edges").collect()] == ["b"]
    with pytest.raises(StoreError):
        GraphStore(spark, str(tmp_path / "i")).import_(str(tmp_path / "out"), most_rows=1)
    s.replace("nodes", nodes(spark, ("a", "../x.py")))
    s.commit()
    s.export(str(tmp_path / "bad"))
    with pytest.raises(StoreError):
        t.import_(str(tmp_path / "bad"))
    assert t.generation == 1


def test_changes_and_shapes(spark):
    make = lambda rows: spark.createDataFrame(rows, "file_path string, sha256 string, mtime long")
    got = {r.file_path: r.state for r in I.changes(make([("a", "1", 1), ("b", "1", 2), ("c", "2", 2), ("d", "1", 1)]), make([("a", "1", 1), ("b", "1", 1), ("c", "1", 1), ("e", "1", 1)])).collect()}
    assert got == {"a": "same", "b": "refreshed", "c": "parse", "d": "parse", "e": "vanished"}
    imports = spark.createDataFrame([("x.py", "n", "m")], "file_path string, name string, module string")
    old = I.file_shapes(nodes(spark, ("f", "x.py"), ("g", "y.py")), {"imports": imports})
    new = I.file_shapes(nodes(spark, ("f", "x.py"), ("h", "y.py")), {"imports": imports.limit(0)})
    shapes = {r.file_path: r for r in I.shape_changes(old, new).collect()}
    assert shapes["x.py"].beyond and not shapes["x.py"].dirty and sorted(shapes["y.py"].dirty) == ["g", "h"]
    calls = spark.createDataFrame([("z.py", "g"), ("w.py", "q")], "file_path string, leaf_name string")
    dirty = spark.createDataFrame([("g",), ("h",)], "name string")
    assert {r.file_path for r in I.wave(spark.createDataFrame([("y.py",)], "file_path string"), dirty, calls).collect()} == {"y.py", "z.py"}
