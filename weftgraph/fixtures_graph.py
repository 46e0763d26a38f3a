"""The benchmark tables seen as a code graph: nations are files, customers functions, suppliers methods, parts classes.

Every definition has the same meaning in Spark and in the SQL of ORACLE, so queries can be checked table by table.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from .functions.scalars import strings
from .work import stored

ORACLE = {
    "star_nodes": """
        SELECT 'nation.' || n_nationkey AS id, n_name AS name, 'File' AS label, 'r' || n_regionkey || '/n' || n_nationkey AS file_path, 0 AS line_start, 0 AS line_end FROM nation
        UNION ALL SELECT 'customer.' || c_custkey, lower(c_mktsegment) || '_' || (c_custkey % 200), 'Function', 'r' || n_regionkey || '/n' || n_nationkey, CAST(10 * c_custkey + 1 AS INTEGER), CAST(10 * c_custkey + 9 AS INTEGER) FROM customer JOIN nation ON c_nationkey = n_nationkey
        UNION ALL SELECT 'supplier.' || s_suppkey, 'supply_' || (s_suppkey % 60), 'Method', 'r' || n_regionkey || '/n' || n_nationkey, CAST(10 * s_suppkey + 1 AS INTEGER), CAST(10 * s_suppkey + 9 AS INTEGER) FROM supplier JOIN nation ON s_nationkey = n_nationkey
        UNION ALL SELECT 'part.' || p_partkey, p_name, 'Class', 'parts/' || p_brand, CAST(10 * p_partkey + 1 AS INTEGER), CAST(10 * p_partkey + 9 AS INTEGER) FROM part""",
    "star_edges": """
        SELECT 'nation.' || c_nationkey AS src, 'customer.' || c_custkey AS dst, 'Defines' AS relation, 'Extracted' AS confidence FROM customer
        UNION ALL SELECT 'nation.' || s_nationkey, 'supplier.' || s_suppkey, 'Defines', 'Extracted' FROM supplier
        UNION ALL SELECT DISTINCT 'customer.' || o_custkey, 'supplier.' || l_suppkey, 'Calls', 'Inferred' FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_suppkey % 7 <> 3
        UNION ALL SELECT DISTINCT 'supplier.' || l_suppkey, 'part.' || l_partkey, 'UsesType', 'Inferred' FROM lineitem""",
    "star_calls": """
        SELECT 'customer.' || o_custkey AS caller_id, CASE WHEN l_partkey % 10 = 9 THEN 'extern_' || (l_partkey % 3) ELSE 'supply_' || (l_suppkey % 60) END AS callee_name, l_linenumber AS line,
        'r' || n_regionkey || '/n' || n_nationkey || CASE WHEN c_custkey % 2 = 0 THEN '.ts' ELSE '.py' END AS file_path
        FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""",
    "star_imports": """
        SELECT DISTINCT 'r' || n_regionkey || '/n' || n_nationkey || '.ts' AS file_path, 'supply_' || (s_suppkey % 60) AS name, CASE WHEN s_suppkey % 3 = 0 THEN 'lodash' ELSE './local' END AS module FROM supplier JOIN nation ON s_nationkey = n_nationkey""",
    "star_refs": """
        SELECT p_type AS name, 'supply_' || (p_partkey % 60) AS leaf_name, CASE p_partkey % 5 WHEN 0 THEN 'function_value' WHEN 1 THEN 'callback' WHEN 2 THEN 'unknown_indirect' WHEN 3 THEN 'public_export' ELSE 'framework_registration' END AS kind, 'r' || (p_size % 5) || '/n' || (p_partkey % 25) AS file_path, p_size AS line FROM part WHERE p_partkey % 60 < 20""",
    "star_inherits": """
        SELECT 'supply_' || (s_suppkey % 60) AS impl_name, 'supply_' || ((s_suppkey + 1) % 60) AS super_name, CASE WHEN s_suppkey % 2 = 0 THEN 'Implements' ELSE 'Extends' END AS kind, 'r0/n0' AS file_path FROM supplier WHERE s_suppkey % 4 = 0""",
    "chain_edges": """
        SELECT DISTINCT CAST(src AS VARCHAR) AS src, CAST(dst AS VARCHAR) AS dst FROM (
          SELECT o_custkey AS src, lead(o_custkey) OVER (ORDER BY o_orderkey) AS dst FROM orders) WHERE dst IS NOT NULL AND src <> dst""",
    "chain_nodes": "SELECT src AS id FROM chain_edges UNION SELECT dst FROM chain_edges",
    "commits": "SELECT DISTINCT CAST(user_id AS VARCHAR) || '@' || CAST(date_trunc('day', ts) AS VARCHAR) AS commit_id, event_type || '_' || CAST(event_id % 12 AS VARCHAR) AS file_path FROM events",
    "sup": "SELECT s_suppkey AS s, n_nationkey AS n, n_regionkey AS r FROM supplier JOIN nation ON s_nationkey = n_nationkey",
    "routes": "SELECT 'route.' || regexp_replace('/' || CAST(page_id % 40 AS VARCHAR) || '/p', '[^A-Za-z0-9]', '_', 'g') || '.GET' AS id, page_id, 'GET /' || CAST(page_id % 40 AS VARCHAR) || '/p' AS name FROM pages",
}


def oracle(body: str) -> str:
    """A query over the views above, with those it names, and those they name, in front."""
    import re

    known = list(ORACLE)
    wanted: set[str] = set()
    todo = [body]
    while todo:
        text = todo.pop()
        for name in known:
            if name not in wanted and re.search(rf"\b{name}\b", text):
                wanted.add(name)
                todo.append(ORACLE[name])
    order = sorted(wanted, key=lambda n: (n == "chain_nodes", known.index(n)))
    recursive = re.match(r"\s*WITH RECURSIVE\b(.*)", body, re.S)
    views = [f"{n} AS ({ORACLE[n]})" for n in order]
    if recursive:
        return f"WITH RECURSIVE {', '.join([*views, recursive[1].strip()])}"
    plain = re.match(r"\s*WITH\b(.*)", body, re.S)
    if plain:
        return f"WITH {', '.join([*views, plain[1].strip()])}"
    return f"WITH {', '.join(views)} {body}" if views else body


#: Projections written once for an application and folder of tables: a graph is stored, then queried.
_kept: dict[tuple[str, str, str], DataFrame] = {}


def kept(build):
    """The method's rows, stored when they are first asked for."""

    @functools.wraps(build)
    def read(self) -> DataFrame:
        key = (self.spark.sparkContext.applicationId, self.sf_dir, build.__name__)
        if key not in _kept:
            _kept[key] = stored(self.spark, build(self), build.__name__)
        return _kept[key]

    return read


class Tables:
    """The views as DataFrames over one folder of tables; the larger ones are stored on first use."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def _home(self) -> DataFrame:
        return self.read("nation").select("n_nationkey", F.concat(F.lit("r"), "n_regionkey", F.lit("/n"), "n_nationkey").alias("home"))

    @kept
    def nodes(self) -> DataFrame:
        key = lambda kind, k: F.concat(F.lit(f"{kind}."), k)
        lines = lambda k: [(10 * F.col(k) + 1).cast("int").alias("line_start"), (10 * F.col(k) + 9).cast("int").alias("line_end")]
        # nation has a fixed 25 rows
        home = F.broadcast(self._home())
        files = self.read("nation").join(home, "n_nationkey").select(key("nation", "n_nationkey").alias("id"), F.col("n_name").alias("name"), F.lit("File").alias("label"), F.col("home").alias("file_path"), F.lit(0).alias("line_start"), F.lit(0).alias("line_end"))
        customers = self.read("customer").join(home, F.col("c_nationkey") == F.col("n_nationkey")).select(key("customer", "c_custkey"), F.concat(F.lower("c_mktsegment"), F.lit("_"), F.col("c_custkey") % 200), F.lit("Function"), "home", *lines("c_custkey"))
        suppliers = self.read("supplier").join(home, F.col("s_nationkey") == F.col("n_nationkey")).select(key("supplier", "s_suppkey"), F.concat(F.lit("supply_"), F.col("s_suppkey") % 60), F.lit("Method"), "home", *lines("s_suppkey"))
        parts = self.read("part").select(key("part", "p_partkey"), "p_name", F.lit("Class"), F.concat(F.lit("parts/"), "p_brand"), *lines("p_partkey"))
        return files.union(customers).union(suppliers).union(parts)

    @kept
    def edges(self) -> DataFrame:
        key = lambda kind, k: F.concat(F.lit(f"{kind}."), k)
        defines = self.read("customer").select(key("nation", "c_nationkey").alias("src"), key("customer", "c_custkey").alias("dst")).union(self.read("supplier").select(key("nation", "s_nationkey"), key("supplier", "s_suppkey")))
        lines = self.read("lineitem")
        calls = lines.where("l_suppkey % 7 <> 3").join(self.read("orders"), F.col("o_orderkey") == F.col("l_orderkey")).select("o_custkey", "l_suppkey").distinct().select(key("customer", "o_custkey"), key("supplier", "l_suppkey"))
        uses = lines.select("l_suppkey", "l_partkey").distinct().select(key("supplier", "l_suppkey"), key("part", "l_partkey"))
        kind = lambda df, r, c: df.withColumns({"relation": F.lit(r), "confidence": F.lit(c)})
        return kind(defines, "Defines", "Extracted").union(kind(calls, "Calls", "Inferred")).union(kind(uses, "UsesType", "Inferred"))

    @kept
    def calls(self) -> DataFrame:
        lines = self.read("lineitem").join(self.read("orders"), F.col("o_orderkey") == F.col("l_orderkey")).join(self.read("customer"), F.col("o_custkey") == F.col("c_custkey"))
        lines = lines.join(F.broadcast(self._home()), F.col("c_nationkey") == F.col("n_nationkey"))
        callee = F.when(F.col("l_partkey") % 10 == 9, F.concat(F.lit("extern_"), F.col("l_partkey") % 3)).otherwise(F.concat(F.lit("supply_"), F.col("l_suppkey") % 60))
        file = F.concat("home", F.when(F.col("c_custkey") % 2 == 0, ".ts").otherwise(".py"))
        return lines.select(F.concat(F.lit("customer."), "o_custkey").alias("caller_id"), callee.alias("callee_name"), F.col("l_linenumber").alias("line"), file.alias("file_path"), callee.alias("leaf_name"), F.lit(None).cast("string").alias("receiver_name"))

    def imports(self) -> DataFrame:
        own = self.read("supplier").join(F.broadcast(self._home()), F.col("s_nationkey") == F.col("n_nationkey"))
        return own.select(F.concat("home", F.lit(".ts")).alias("file_path"), F.concat(F.lit("supply_"), F.col("s_suppkey") % 60).alias("name"), F.when(F.col("s_suppkey") % 3 == 0, "lodash").otherwise("./local").alias("module")).distinct()

    def refs(self) -> DataFrame:
        kinds = ["function_value", "callback", "unknown_indirect", "public_export", "framework_registration"]
        return self.read("part").where("p_partkey % 60 < 20").select(F.col("p_type").alias("name"), F.concat(F.lit("supply_"), F.col("p_partkey") % 60).alias("leaf_name"), strings(kinds)[(F.col("p_partkey") % 5).cast("int")].alias("kind"), F.concat(F.lit("r"), F.col("p_size") % 5, F.lit("/n"), F.col("p_partkey") % 25).alias("file_path"), F.col("p_size").alias("line"))

    def inherits(self) -> DataFrame:
        return self.read("supplier").where("s_suppkey % 4 = 0").select(F.concat(F.lit("supply_"), F.col("s_suppkey") % 60).alias("impl_name"), F.concat(F.lit("supply_"), (F.col("s_suppkey") + 1) % 60).alias("super_name"), F.when(F.col("s_suppkey") % 2 == 0, "Implements").otherwise("Extends").alias("kind"), F.lit("r0/n0").alias("file_path"))

    @kept
    def chain(self) -> DataFrame:
        """Cyclic graph over customers: each order leads to the next one's customer.

        The successor is found without gathering the orders: range-partitioned rows are sorted, and the first row of
        each partition is joined to the last one of the partition before it.
        """
        own = self.read("orders").select("o_orderkey", "o_custkey")
        parts = own.repartitionByRange("o_orderkey").withColumn("part", F.spark_partition_id())
        inside = W.partitionBy("part").orderBy("o_orderkey")
        led = parts.withColumn("next", F.lead("o_custkey").over(inside)).withColumn("key_next", F.lead("o_orderkey").over(inside))
        heads = parts.groupBy("part").agg(F.min_by("o_custkey", "o_orderkey").alias("head"))
        # One row per partition: a count bounded by the number of partitions.
        heads = heads.withColumn("before", F.lag("part").over(W.orderBy("part"))).select(F.col("before").alias("part"), "head")
        full = led.join(F.broadcast(heads), "part", "left").withColumn("dst", F.when(F.col("key_next").isNotNull(), F.col("next")).otherwise(F.col("head")))
        return full.where("dst IS NOT NULL AND dst <> o_custkey").select(F.col("o_custkey").cast("string").alias("src"), F.col("dst").cast("string").alias("dst")).distinct()

    def sup(self) -> DataFrame:
        """Suppliers as plain numbers: key s, nation n, region r."""
        return self.read("supplier").join(F.broadcast(self.read("nation")), F.col("s_nationkey") == F.col("n_nationkey")).selectExpr("s_suppkey AS s", "n_nationkey AS n", "n_regionkey AS r")

    def commits(self) -> DataFrame:
        return self.read("events").select(F.concat(F.col("user_id").cast("string"), F.lit("@"), F.date_trunc("day", "ts").cast("string")).alias("commit_id"), F.concat("event_type", F.lit("_"), F.col("event_id") % 12).alias("file_path")).distinct()

    def routes(self) -> DataFrame:
        path = F.concat(F.lit("/"), F.col("page_id") % 40, F.lit("/p"))
        return self.read("pages").select(F.concat(F.lit("route."), F.regexp_replace(path, "[^A-Za-z0-9]", "_"), F.lit(".GET")).alias("id"), "page_id", F.concat(F.lit("GET "), path).alias("name"))
