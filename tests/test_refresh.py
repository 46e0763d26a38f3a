"""A partial run gives what a full one would, for edits of many kinds."""

import random

import pytest
from weftgraph.plans import indexing
from weftgraph.store import GraphStore

FILES = {
    "app/a.py": "from app.b import load\n\ndef run():\n    help()\n    load()\n\ndef help():\n    return 1\n",
    "app/b.py": "def load():\n    return lone()\n\ndef lone():\n    return 2\n",
    "app/c.py": "class Base:\n    def ping(self):\n        return 0\n\nclass Sub(Base):\n    def all(self):\n        return self.ping()\n",
    "app/tests/test_a.py": "def check():\n    run()\n    extra()\n",
    "lib/z.py": "def far():\n    return 3\n",
}
EDITS = {
    "a body": ({"app/b.py": FILES["app/b.py"].replace("return 2", "help2 = 5\n    return help2")}, "partial"),
    "a function renamed": ({"app/a.py": FILES["app/a.py"].replace("help", "aid")}, "partial"),
    "a namesake": ({"app/b.py": FILES["app/b.py"] + "\ndef run():\n    return 1\n"}, "partial"),
    "an import more": ({"app/a.py": "from lib.z import far\n" + FILES["app/a.py"]}, "full"),
    "a file less": ({"lib/z.py": None}, "full"),
    "nothing": ({}, "unchanged"),
}


def listing(spark, files):
    return spark.createDataFrame(sorted(files.items()), "file_path string, text string")


@pytest.fixture(scope="module")
def base(spark, tmp_path_factory):
    store = GraphStore(spark, str(tmp_path_factory.mktemp("base")))
    indexing.index(store, listing(spark, FILES), "p", analytics=False)
    return store


@pytest.mark.parametrize("name", EDITS)
def test_partial_is_full(spark, tmp_path, base, name):
    changed, expected = EDITS[name]
    after = {p: t for p, t in (FILES | changed).items() if t is not None}
    store = GraphStore(spark, str(tmp_path / "s"))
    for table in ("nodes", "edges", "calls", "symbol_refs", "inherits", "fields", "imports", "locals", "type_refs", "manifest", "hyperedges"):
        store.replace(table, base.table(table))
    store.commit()
    found = indexing.refresh(store, listing(spark, after), "p", analytics=False)
    assert found.split(":")[0] == expected
    whole = GraphStore(spark, str(tmp_path / "w"))
    indexing.index(whole, listing(spark, after), "p", analytics=False)
    assert store.canonical_hash() == whole.canonical_hash()
    assert {r.file_path for r in store.table("manifest").collect()} == set(after)
    assert indexing.refresh(store, listing(spark, after), "p", analytics=False) == "unchanged"
