"""Point lookups, degrees, co-change pairs and other joins and counts over the graph tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.scalars import directory


def find_by_name(nodes: DataFrame, name: str) -> DataFrame:
    return nodes.where(F.col("name") == name)


def nodes_by_label(nodes: DataFrame, label: str) -> DataFrame:
    return nodes.where(F.col("label") == label)


def symbols_in_file(nodes: DataFrame, file_path: str) -> DataFrame:
    return nodes.where((F.col("file_path") == file_path) & (F.col("label") != "File")).orderBy("line_start", "id")


def edges_for_node(edges: DataFrame, id_: str) -> DataFrame:
    return edges.where((F.col("src") == id_) | (F.col("dst") == id_))


def edges_by_justification(edges: DataFrame) -> DataFrame:
    return edges.groupBy("justification").agg(F.count(F.lit(1)).alias("n"))


def incoming(nodes: DataFrame, edges: DataFrame, relations: tuple[str, ...], name: str) -> DataFrame:
    """Sources of the relations into nodes of that name, each once."""
    targets = nodes.where(F.col("name") == name).select(F.col("id").alias("dst"))
    found = edges.where(F.col("relation").isin(*relations)).join(targets, "dst", "left_semi").select(F.col("src").alias("id"), "confidence").distinct()
    return found.join(nodes, "id")


def callers_of(nodes: DataFrame, edges: DataFrame, name: str) -> DataFrame:
    return incoming(nodes, edges, ("Calls",), name)


def callers_of_id(nodes: DataFrame, edges: DataFrame, id_: str) -> DataFrame:
    return edges.where((F.col("relation") == "Calls") & (F.col("dst") == id_)).select(F.col("src").alias("id"), "confidence").distinct().join(nodes, "id")


def implementers_of(nodes: DataFrame, edges: DataFrame, name: str) -> DataFrame:
    return incoming(nodes, edges, ("Implements", "Inherits"), name)


def callees_of(nodes: DataFrame, edges: DataFrame, id_: str) -> DataFrame:
    return edges.where((F.col("relation") == "Calls") & (F.col("src") == id_)).select(F.col("dst").alias("id")).distinct().join(nodes, "id")


def definitions_of(nodes: DataFrame, edges: DataFrame, name: str) -> DataFrame:
    """Symbols of that name with the number of callers resolved to each."""
    own = nodes.where((F.col("name") == name) & ~F.col("label").isin("File", "Document")).select("id", "label", "file_path", "line_start")
    counts = edges.where((F.col("relation") == "Calls") & (F.col("confidence") != "Ambiguous")).join(own.select(F.col("id").alias("dst")), "dst", "left_semi").groupBy(F.col("dst").alias("id")).agg(F.countDistinct("src").alias("resolved_callers"))
    return own.join(counts, "id", "left").withColumn("resolved_callers", F.coalesce("resolved_callers", F.lit(0)))


def degrees(edges: DataFrame) -> DataFrame:
    """fan_in and fan_out over unambiguous calls, of the nodes that have one."""
    calls = edges.where((F.col("relation") == "Calls") & (F.col("confidence") != "Ambiguous"))
    ends = calls.select(F.col("dst").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")).union(calls.select("src", F.lit(0), F.lit(1)))
    return ends.groupBy("id").agg(F.sum("i").alias("fan_in"), F.sum("o").alias("fan_out"))


def counts_by(frame: DataFrame, *columns: str) -> DataFrame:
    return frame.groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))


def indexed_files(nodes: DataFrame) -> DataFrame:
    return nodes.select("file_path").distinct()


def call_sites_by_file(calls: DataFrame, name: str) -> DataFrame:
    return counts_by(calls.where(F.col("callee_name") == name), "file_path")


def refs_for_leaf(refs: DataFrame, leaf: str) -> DataFrame:
    return refs.where(F.col("leaf_name") == leaf)


def defines_edges(nodes: DataFrame) -> DataFrame:
    """Each file defines the nodes of the same path."""
    files = nodes.where("label = 'File'").select(F.col("id").alias("src"), "file_path")
    own = nodes.where("label NOT IN ('File', 'Route', 'Document')").select(F.col("id").alias("dst"), "file_path")
    return own.join(files, "file_path").select("src", "dst", F.lit("Defines").alias("relation"), F.lit("TreeSitter").alias("tier"), F.lit("Extracted").alias("confidence"), F.col("file_path").alias("src_file"))


def innermost_class(nodes: DataFrame, labels: tuple[str, ...] = ("Class", "Interface", "Enum")) -> DataFrame:
    """Function and method ids with the smallest class of the same file around them."""
    inner = nodes.where("label IN ('Function', 'Method')").select("id", "name", "file_path", "line_start", "line_end")
    outer = nodes.where(F.col("label").isin(*labels)).select(F.col("id").alias("class_id"), "file_path", F.col("line_start").alias("a"), F.col("line_end").alias("b"))
    held = inner.join(outer, "file_path").where("a <= line_start AND line_end <= b AND class_id <> id")
    return held.groupBy("id", "name").agg(F.min_by("class_id", F.struct(F.col("b") - F.col("a"), "class_id")).alias("class_id"))


def span_lookup(sites: DataFrame, nodes: DataFrame) -> DataFrame:
    """For each site (file_path, line) the node that starts on its line, else the latest start whose span holds it."""
    spans = nodes.where("label <> 'File'").select("id", "file_path", "line_start", "line_end")
    held = sites.join(spans, "file_path").where("line_start <= line AND (line <= line_end OR line = line_start)")
    best = held.groupBy(*sites.columns).agg(F.max_by("id", F.struct((F.col("line_start") == F.col("line")).cast("int"), "line_start", "id")).alias("id"))
    return best


def shared_prefix(a: Column, b: Column) -> Column:
    """Leading path segments that two paths share."""
    same = F.zip_with(F.split(a, "/"), F.split(b, "/"), lambda x, y: F.coalesce(x == y, F.lit(False)))
    return F.coalesce(F.nullif(F.array_position(same, False).cast("int"), F.lit(0)) - 1, F.size(same))


def nearest_definition(files: DataFrame, definitions: DataFrame) -> DataFrame:
    """For each file the definition (id, file_path) of the same name with the longest shared path, ties by path then id."""
    pairs = files.select(F.col("file_path").alias("site"), "name").join(definitions.select("id", "name", "file_path"), "name")
    best = W.partitionBy("site", "name").orderBy(shared_prefix(F.col("site"), F.col("file_path")).desc(), "file_path", "id")
    return pairs.withColumn("place", F.row_number().over(best)).where("place = 1").drop("place")


def cochange_pairs(commits: DataFrame, least: int = 2, top: int = 20_000) -> DataFrame:
    """Unordered file pairs of commits with 2 to 30 files, counted; a commit gives 435 pairs at most."""
    sized = commits.groupBy("commit_id").agg(F.array_sort(F.collect_set("file_path")).alias("files")).where(F.size("files").between(2, 30))
    pairs = sized.select(F.posexplode("files").alias("i", "file_a"), "files").select("file_a", F.explode(F.slice("files", F.col("i") + 2, F.size("files"))).alias("file_b"))
    return pairs.groupBy("file_a", "file_b").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).orderBy(F.desc("n"), "file_a", "file_b").limit(top)


def cochanges_for(cochanges: DataFrame, file_path: str) -> DataFrame:
    both = cochanges.where(F.col("file_a") == file_path).select(F.col("file_b").alias("file_path"), "n").union(cochanges.where(F.col("file_b") == file_path).select("file_a", "n"))
    return both.orderBy(F.desc("n"), "file_path")


def field_matches(fields: DataFrame, variables: DataFrame, name: str, limit: int = 25) -> DataFrame:
    """Fields of that name or type, and typed locals, as one set."""
    own = fields.where((F.col("field_name") == name) | (F.col("type_name") == name)).select(F.col("class_id").alias("owner"), F.col("field_name").alias("name"), "type_name", "file_path")
    typed = variables.where(((F.col("var_name") == name) | (F.col("type_name") == name)) & (F.col("type_name") != "")).select("caller_id", "var_name", "type_name", "file_path")
    return own.union(typed).distinct().orderBy("file_path", "owner", "name").limit(limit)


def dangling(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    ids = nodes.select("id")
    lost = lambda end: edges.join(ids, edges[end] == ids["id"], "left_anti")
    return lost("src").unionByName(lost("dst")).dropDuplicates(["src", "dst", "relation"])


def without_dangling(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    ids = nodes.select("id")
    return edges.join(ids, edges["src"] == ids["id"], "left_semi").join(ids, F.col("dst") == ids["id"], "left_semi")


def violations(nodes: DataFrame, edges: DataFrame, most: int = 20) -> DataFrame:
    """Up to `most` rows each of dangling edges, ids outside [a-z0-9_.], and syntactic calls without a justification."""
    lost = dangling(nodes, edges).select(F.lit("dangling").alias("kind"), F.concat_ws(" ", "src", "relation", "dst").alias("what"))
    odd = nodes.where(~F.col("id").rlike("^[a-z0-9_.]+$") & ~F.col("label").isin("Route", "Document")).select(F.lit("id"), "id")
    bare = edges.where("relation = 'Calls' AND tier = 'TreeSitter' AND (justification IS NULL OR justification = '')").select(F.lit("justification"), F.concat_ws(" ", "src", "dst"))
    first = lambda df: df.orderBy("what").limit(most)
    return first(lost).union(first(odd.toDF("kind", "what"))).union(first(bare.toDF("kind", "what")))


def routes(nodes: DataFrame, prefix: str = "", method: str = "", offset: int = 0, limit: int = 100) -> DataFrame:
    own = nodes.where("label = 'Route'")
    if method:
        own = own.where(F.upper(F.substring_index("name", " ", 1)) == method.upper())
    if prefix:
        own = own.where(F.substring_index("name", " ", -1).startswith(prefix))
    return own.orderBy("name", "id").offset(offset).limit(limit)


def dominant_directory(nodes: DataFrame, group: str = "community") -> DataFrame:
    """The most frequent two-level directory of each group; ties to the smaller one."""
    two = F.array_join(F.slice(F.split(directory("file_path"), "/"), 1, 2), "/")
    counted = nodes.groupBy(group, two.alias("prefix")).agg(F.count(F.lit(1)).alias("n"))
    return counted.groupBy(group).agg(F.min_by("prefix", F.struct(-F.col("n"), "prefix")).alias("prefix"))


