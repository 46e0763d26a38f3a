"""Names with many definitions: calls do not meet each of them, whichever tier looks."""

from pyspark.sql import functions as F
from weftgraph.operators import resolution as R

CALLS, SAME = 4000, 100


def test_calls_do_not_meet_every_namesake(spark):
    many = spark.range(SAME).select("id", F.explode(F.array(*(F.struct(F.lit(n).alias("name"), F.lit(f).alias("file_path"), F.lit(language).alias("language")) for n, f, language in (("here", "a/x.go", "go"), ("there", "a/y.go", "go"), ("pack", "a/z.go", "go"))))).alias("x"))
    many = many.select(F.concat_ws(".", "x.name", F.col("id").cast("string")).alias("id"), "x.name", F.lit("Function").alias("label"), "x.language", "x.file_path")
    lone = spark.createDataFrame([("lone.0", "lone", "Function", "go", "a/y.go")], many.schema)
    callers = spark.range(CALLS).select(F.concat(F.lit("caller."), "id").alias("id"), F.concat(F.lit("caller_"), "id").alias("name"), F.lit("Function").alias("label"), F.lit("go").alias("language"), F.lit("a/x.go").alias("file_path"))
    nodes = many.unionByName(lone).unionByName(callers).withColumns({"line_start": F.lit(1), "line_end": F.lit(2)})
    sites = callers.select(F.col("id").alias("caller_id"), F.explode(F.array(*(F.lit(n) for n in ("here", "there", "pack", "lone")))).alias("callee_name"))
    calls = sites.select("caller_id", "callee_name", F.lit(1).alias("line"), F.lit("a/x.go").alias("file_path"), F.struct(F.lit("Bare").alias("kind"), F.lit(None).cast("string").alias("name")).alias("receiver"), F.lit(None).cast("string").alias("enclosing_class"))
    empty = lambda schema: spark.createDataFrame([], schema)
    imports = spark.createDataFrame([("a/x.go", "there", "./y.go"), ("a/x.go", "lone", "./y.go")], "file_path string, name string, module string")
    written = lambda: spark.sparkContext._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()
    before = written()
    edges = R.call_edges(
        spark, nodes, calls, empty("impl_name string, super_name string, kind string, file_path string"), empty("class_id string, field_name string, type_name string, file_path string"),
        empty("caller_id string, var_name string, type_name string, file_path string"), imports,
    ).collect()
    assert {(r.dst, r.justification) for r in edges} == {("lone.0", "ImportNarrowed")} and len({r.src for r in edges}) == len(edges) == CALLS
    # Each of 16,000 calls with each of 100 namesakes would be over 30 MB.
    assert written() - before < 4e6
