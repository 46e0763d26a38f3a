"""Evidence of the brace languages on small files of each."""

import pytest
from weftgraph.sources.parser import parse_file

CASES = {
    "a.rs": (
        """use crate::store::{Store, load};
// fn no() {}
pub struct Repo { name: String, store: Store }
pub trait Ping { fn ping(&self); }
impl Ping for Repo {
    fn ping(&self) { if self.ok() { self.store.save(); } }
}
impl Repo {
    pub fn new<T>(x: T) -> Self { let s = Store::open("fn fake() {"); load(); s.flush() }
}
fn main() { let r: Repo = Repo::new(1); helper::<u8>(2); }
""",
        {("Repo", "Class"), ("Ping", "Interface"), ("ping", "Method"), ("new", "Method"), ("main", "Function")},
        {("ping", "ok", "SelfThis"), ("ping", "save", "Field"), ("new", "open", "Named"), ("new", "load", "Bare"), ("new", "flush", "Named"), ("main", "new", "Named"), ("main", "helper", "Bare")},
        {("Repo", "Ping", "Implements")}, {("Store", "crate::store"), ("load", "crate::store")},
    ),
    "a.go": (
        """package a
import (
    "fmt"
    j "encoding/json"
)
type Repo struct {
    name string
    store Store
}
func (r *Repo) Save(x int) error { if x > 0 { r.store.Put(x) }; return nil }
func main() { fmt.Println("x"); helper(func() { inner() }) }
""",
        {("Repo", "Class"), ("Save", "Method"), ("main", "Function")},
        {("save", "Put", "Named"), ("main", "Println", "Named"), ("main", "helper", "Bare"), ("main", "inner", "Bare")},
        set(), {("fmt", "fmt"), ("j", "encoding/json")},
    ),
    "A.java": (
        """import java.util.List;
public class Repo extends Base implements Ping, Pong {
    private Store store;
    public Repo(Store s) { this.store = s; }
    @Override public int save(int x) throws E { if (x > 0 && x < 9) { return store.put(x); } other(); Item i = new Item(3); return this.size(); }
    abstract void none();
}
interface Ping { void ping(); }
""",
        {("Repo", "Class"), ("Ping", "Interface"), ("Repo", "Method"), ("save", "Method")},
        {("save", "put", "Named"), ("save", "other", "Bare"), ("save", "size", "SelfThis")},
        {("Repo", "Base", "Extends"), ("Repo", "Ping", "Implements"), ("Repo", "Pong", "Implements")}, {("List", "java.util.List")},
    ),
    "a.kt": (
        """import a.b.Store
import a.c.Item as Thing
class Repo(private val store: Store) : Base(), Ping {
    val size: Int = 0
    fun save(x: Int): Int { val t = Thing(x); when (x) { 1 -> store.put(x) }; return help() }
}
fun String.help() { println(this) }
""",
        {("Repo", "Class"), ("save", "Method"), ("help", "Function")},
        {("save", "Thing", "Bare"), ("save", "put", "Named"), ("save", "help", "Bare"), ("help", "println", "Bare")},
        {("Repo", "Base", "Extends"), ("Repo", "Ping", "Extends")}, {("Store", "a.b.Store"), ("Thing", "a.c.Item")},
    ),
    "a.swift": (
        """import Foundation
class Repo: Base, Ping {
    let store: Store
    func save(_ x: Int) -> Bool { guard x > 0 else { return false }; return self.store.put(x) && check() }
}
extension Repo: Pong { func more() { save(1) } }
""",
        {("Repo", "Class"), ("save", "Method"), ("more", "Method")},
        {("save", "put", "Field"), ("save", "check", "Bare"), ("more", "save", "Bare")},
        {("Repo", "Base", "Extends"), ("Repo", "Ping", "Extends"), ("Repo", "Pong", "Extends")}, {("Foundation", "Foundation")},
    ),
    "a.cpp": (
        """#include "x.h"
namespace n {
class Repo : public Base {
 public:
  int save(int x) const { return store->put(x); }
  Store* store;
};
int Repo::load(int y) { for (;;) { save(y); } }
static int helper(int z) { return other(z); }
}
int main() { n::Repo r; r.save(1); return 0; }
""",
        {("Repo", "Class"), ("save", "Method"), ("load", "Method"), ("helper", "Function"), ("main", "Function")},
        {("save", "put", "Named"), ("load", "save", "Bare"), ("helper", "other", "Bare"), ("main", "save", "Named")},
        {("Repo", "Base", "Extends")}, set(),
    ),
    "a.cs": (
        """using System;
namespace N {
    public class Repo : Base, IPing {
        private Store store;
        public int Save(int x) { var t = new Item(x); return this.store.Put(x) + Help(); }
    }
}
""",
        {("Repo", "Class"), ("Save", "Method")}, {("save", "Put", "Field"), ("save", "Help", "Bare")}, {("Repo", "Base", "Extends"), ("Repo", "IPing", "Extends")}, set(),
    ),
}


@pytest.mark.parametrize("path", CASES)
def test_evidence(path):
    text, nodes, calls, inherits, imports = CASES[path]
    got = parse_file("p", path, text)
    assert {(n[1], n[2]) for n in got["nodes"] if n[2] != "File"} == nodes
    assert {(c[0].split(".")[-1], c[1], c[4][0]) for c in got["calls"]} == calls
    assert {r[:3] for r in got["inherits"]} == inherits and {r[1:] for r in got["imports"]} == imports
    assert all(n[5] <= n[6] <= text.count("\n") + 1 for n in got["nodes"])


def test_methods_belong_to_their_class():
    assert {n[0] for n in parse_file("p", "a.rs", CASES["a.rs"][0])["nodes"]} >= {"p.a.repo", "p.a.repo.ping", "p.a.repo.new"}
    assert {n[0] for n in parse_file("p", "a.go", CASES["a.go"][0])["nodes"]} >= {"p.a.repo.save"}
    assert ("p.a.repo", "store", "Store", "a.rs") in parse_file("p", "a.rs", CASES["a.rs"][0])["fields"]
    assert ("p.a.repo", "store", "Store", "A.java") in parse_file("p", "A.java", CASES["A.java"][0])["fields"]
    assert ("p.a.repo.save", "i", "Item", "A.java") in parse_file("p", "A.java", CASES["A.java"][0])["locals"]


def test_ruby_and_shell():
    ruby = "require_relative 'lib/store'\nclass Repo < Base\n  def save(x) # put(x)\n    if x > 0 && ok?(x)\n      @store.put(x)\n    end\n    self.check(\"no(1)\")\n  end\n  def size = 3\nend\ndef main\n  helper(1)\nend\n"
    got = parse_file("p", "a.rb", ruby)
    assert {(n[1], n[2], n[5], n[6], n[7]) for n in got["nodes"] if n[2] != "File"} >= {("Repo", "Class", 2, 10, None), ("save", "Method", 3, 8, 3), ("main", "Function", 11, 13, 1)}
    assert {(c[0], c[1], c[4]) for c in got["calls"]} == {("p.a.repo.save", "ok?", ("Bare", None)), ("p.a.repo.save", "put", ("Field", "store")), ("p.a.repo.save", "check", ("SelfThis", None)), ("p.a.main", "helper", ("Bare", None))}
    assert got["inherits"] == [("Repo", "Base", "Extends", "a.rb")] and got["imports"] == [("a.rb", "store", "lib/store")]
    shell = "#!/bin/bash\nhelp() {\n  echo no\n}\nfunction run {\n  if help; then\n    build --all && deploy | log\n  fi\n  x=$(find_it a)\n}\nrun\n"
    got = parse_file("p", "a.sh", shell)
    assert {(n[1], n[2], n[5], n[6]) for n in got["nodes"] if n[2] != "File"} == {("help", "Function", 2, 4), ("run", "Function", 5, 10)}
    assert {(c[0], c[1]) for c in got["calls"]} == {("p.a.run", c) for c in ("help", "build", "deploy", "log", "find_it")}


@pytest.mark.parametrize("path", CASES)
def test_broken_files_are_read_to_their_end(path):
    text = CASES[path][0]
    for cut in range(0, len(text), 7):
        parse_file("p", path, text[:cut])
        parse_file("p", path, text[cut:])


def test_imports_of_python_and_scripts():
    assert {r[1:] for r in parse_file("p", "a.py", "import os.path\nimport a.b as c\nfrom d import e as f\n")["imports"]} == {("os", "os"), ("c", "a.b"), ("f", "d")}
    assert {r[1:] for r in parse_file("p", "a.ts", "export { a, b as c } from './x'\nexport * as n from './y'\nimport * as m from './z'\nexport { q }\n")["imports"]} == {("a", "./x"), ("c", "./x"), ("n", "./y"), ("m", "./z")}
