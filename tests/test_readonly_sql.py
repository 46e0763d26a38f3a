"""What read-only SQL may not do, and small things that are easily lost: scratch folders, vectors of unit length, renames."""

import os

import pytest
from pyspark.sql import functions as F
from weftgraph import work
from weftgraph.functions import scalars
from weftgraph.plans import cypher


def test_only_views_and_harmless_functions(spark, tmp_path):
    spark.range(3).createOrReplaceTempView("some_rows")
    spark.range(3).write.parquet(f"{tmp_path}/t")
    for fine in ("SELECT count(*) FROM some_rows", "WITH a AS (SELECT id FROM some_rows), b AS (SELECT * FROM a) SELECT max(id) FROM b", "SELECT (SELECT max(id) FROM some_rows) AS x"):
        assert cypher.query_readonly(spark, fine).count() == 1
    for bad in (
        "SELECT reflect('java.lang.System', 'getProperty', 'user.home')", "SELECT java_method('java.lang.System', 'getenv')", f"SELECT * FROM parquet.`{tmp_path}/t`",
        f"SELECT * FROM some_rows WHERE id IN (SELECT id FROM parquet.`{tmp_path}/t`)", "INSERT INTO some_rows SELECT 1", "DROP VIEW some_rows",
    ):
        with pytest.raises(ValueError):
            cypher.query_readonly(spark, bad)


def test_scratch_is_deleted(spark):
    with work.scratch(spark) as folder:
        kept = work.stored(spark, spark.range(5), "rows")
        assert kept.count() == 5
        path = folder.removeprefix("file:")
        assert os.path.isdir(path)
    assert not os.path.exists(path)
    assert work.stored(spark, spark.range(2), "rows").count() == 2


def test_vectors_get_unit_length(spark):
    rows = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],), (None,)], "v array<float>")
    got = [r.n for r in rows.select(scalars.normalised("v").alias("n")).collect()]
    assert [round(x, 6) for x in got[0]] == [0.6, 0.8] and got[1] == [0.0, 0.0] and got[2] is None


def test_new_names_may_hold_dollar_signs(spark):
    from weftgraph.operators import services

    nodes = spark.createDataFrame([("a", "old", "Function", "f.js")], "id string, name string, label string, file_path string")
    cover = spark.createDataFrame([("old", 0)], "callee_name string, dropped long")
    files = spark.createDataFrame([("f.js", "old(old)")], "file_path string, text string")
    edits, why = services.rename_plan(spark, nodes, cover, files, "old", "$new", files.select("file_path", F.lit(2).alias("n")))
    assert why is None and edits == [("f.js", 2, "$new($new)")]
