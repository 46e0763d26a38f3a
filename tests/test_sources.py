from pyspark.sql import functions as F
from weftgraph.plans import indexing
from weftgraph.sources import files as S, parser
from weftgraph.store import GraphStore
from weftgraph.streaming import watch

PY = '''from app.util import helper
class Base:
    def ping(self):
        return 1
class Svc(Base):
    repo: Repo
    def run(self, x):
        if x and x > 1:
            self.ping()
        helper(x)
        return Other().go()
@app.get("/users")
def users():
    s = Svc()
    s.run(1)
'''
TS = '''import { load as fetchIt, Thing } from "./b";
// call(comment)
export class A extends Thing implements I {
  svc: Service;
  run(x: number): void { this.svc.go(); fetchIt(x); "str(".length; }
}
function top() { const a = new A(); a.run(1); app.get("/x", h); }
const arrow = async (q) => { top(); };
'''


def test_python_evidence():
    out = parser.parse_file("p", "app/m.py", PY)
    assert {(n[0], n[2]) for n in out["nodes"]} == {("p.app.m.file", "File"), ("p.app.m.base", "Class"), ("p.app.m.base.ping", "Function"), ("p.app.m.svc", "Class"), ("p.app.m.svc.run", "Function"), ("route._users.GET", "Route"), ("p.app.m.users", "Function")}
    calls = {(c[0], c[1], c[4]) for c in out["calls"]}
    assert {("p.app.m.svc.run", "ping", ("SelfThis", None)), ("p.app.m.svc.run", "helper", ("Bare", None)), ("p.app.m.users", "run", ("Named", "s"))} <= calls
    assert ("Svc", "Base", "Extends", "app/m.py") in out["inherits"] and ("app/m.py", "helper", "app.util") in out["imports"]
    assert ("p.app.m.users", "s", "Svc", "app/m.py") in out["locals"] and ("p.app.m.svc", "repo", "Repo", "app/m.py") in out["fields"]
    assert next(n[7] for n in out["nodes"] if n[0] == "p.app.m.svc.run") == 3
    assert [n[2] for n in parser.parse_file("p", "x.py", "def (")["nodes"]] == ["File"]


def test_script_evidence():
    out = parser.parse_file("p", "a.ts", TS)
    assert {(n[0], n[2]) for n in out["nodes"]} == {("p.a.file", "File"), ("p.a.a", "Class"), ("p.a.a.run", "Method"), ("p.a.top", "Function"), ("p.a.arrow", "Function"), ("route._x.GET", "Route")}
    assert {(c[0], c[1], c[4]) for c in out["calls"]} == {("p.a.a.run", "go", ("Field", "svc")), ("p.a.a.run", "fetchIt", ("Bare", None)), ("p.a.top", "run", ("Named", "a")), ("p.a.top", "get", ("Named", "app")), ("p.a.arrow", "top", ("Bare", None))}
    assert {("A", "Thing", "Extends", "a.ts"), ("A", "I", "Implements", "a.ts")} == set(out["inherits"])
    assert {("a.ts", "fetchIt", "./b"), ("a.ts", "Thing", "./b")} == set(out["imports"]) and ("p.a.top", "a", "A", "a.ts") in out["locals"]


def test_index_tree_and_stream(spark, tmp_path):
    tree = tmp_path / "tree"
    for path, text in {"app/m.py": PY, "app/util.py": "def helper(x):\n    return x\n", "node_modules/x.py": "def no(): pass\n", "README.md": "Title\n\n" + "word " * 400 + "\n\nend", "yarn.lock": "x"}.items():
        (tree / path).parent.mkdir(parents=True, exist_ok=True)
        (tree / path).write_text(text)
    found = S.read_tree(spark, str(tree))
    assert {r.file_path for r in found.collect()} == {"app/m.py", "app/util.py", "README.md"}
    assert {r.file_path for r in S.read_tree(spark, str(tree), ignore=("*.md",)).collect()} == {"app/m.py", "app/util.py"}
    docs = S.document_nodes(found.where("file_path = 'README.md'").select(F.col("file_path").alias("source"), "text")).collect()
    assert [d.id for d in docs] == ["doc.readme_md.0", "doc.readme_md.1", "doc.readme_md.2"] and docs[0].name == "Title"
    store = GraphStore(spark, str(tmp_path / "g"))
    code = found.where(F.col("file_path").endswith(".py"))
    assert indexing.index(store, code, "p", analytics=False) == 1
    edges = {(r.src, r.dst, r.justification) for r in store.table("edges").where("relation = 'Calls'").collect()}
    assert edges == {("p.app.m.svc.run", "p.app.m.base.ping", "SelfThisMember"), ("p.app.m.svc.run", "p.app.util.helper", "ImportNarrowed"), ("p.app.m.users", "p.app.m.svc.run", "LocalVarType")}
    before = store.canonical_hash()
    snip = {r.id: r.snippet for r in S.snippets(code, store.table("nodes")).collect()}
    assert snip["p.app.m.base.ping"].strip().startswith("def ping")
    # A stream of file versions ends in the same graph as a full run.
    box = tmp_path / "box"
    code.select("file_path", "text", "mtime").write.json(str(box))
    other = GraphStore(spark, str(tmp_path / "h"))

    def index(s, changed):
        indexing.evidence(s, changed, "p")
        indexing.resolve(s)

    watch.watch(spark, str(box), other, index, str(tmp_path / "cp"), None).awaitTermination()
    assert GraphStore(spark, other.root).canonical_hash() == before
    assert not watch.applied(GraphStore(spark, other.root), code.select("file_path", "text", "mtime"), index)


def test_aliases_and_occurrences(spark):
    known = S.AliasMap({"tsconfig.json": '{"compilerOptions": {"baseUrl": ".", "paths": {"@/*": ["src/*"], "@/deep/*": ["deep/*",], "exact": ["src/e"]}}} // c', "pkg/tsconfig.json": '{"compilerOptions": {"paths": {"~/*": ["./lib/*"]}}}'})
    assert [known.resolve("a.ts", m) for m in ("@/x", "@/deep/y", "exact", "react")] == ["/src/x", "/deep/y", "/src/e", None]
    assert known.resolve("pkg/a.ts", "~/q") == "/pkg/lib/q" and known.resolve("a.ts", "src/k", frozenset({"src"})) == "/src/k"
    imports = spark.createDataFrame([("a.ts", "n", "@/x")], "file_path string, name string, module string")
    assert S.aliased(imports, {"tsconfig.json": '{"compilerOptions": {"paths": {"@/*": ["src/*"]}}}'}).first().module == "/src/x"
    nodes = spark.createDataFrame([("f", "Function", "a.ts", 1, 5), ("g", "Function", "a.ts", 7, 9), ("C", "Class", "b.ts", 1, 9)], "id string, label string, file_path string, line_start int, line_end int")
    at = "symbol string, file_path string, line int"
    got = S.occurrence_edges(spark.createDataFrame([("s1", "a.ts", 7), ("s2", "b.ts", 1)], at), spark.createDataFrame([("s1", "a.ts", 3), ("s2", "a.ts", 4), ("s1", "a.ts", 8), ("s1", "z.ts", 1)], at), nodes)
    assert {(r.src, r.dst, r.relation) for r in got.collect()} == {("f", "g", "Calls"), ("f", "C", "UsesType")}
