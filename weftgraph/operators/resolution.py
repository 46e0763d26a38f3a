"""Call sites to edges by evidence: each tier proposes a target only where it is the only one, and the first tier with
a proposal decides. A proposal that a gate refuses is dropped and never retried by a later tier.

Inputs are the tables nodes, calls, inherits, fields, locals and imports. Every step is an aggregate that keeps keys with
exactly one candidate and an equi-join with these; only the walk up the class hierarchy goes in rounds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.scalars import directory, is_test_path, joined_path, language_family, top_segment
from ..schema import CALLABLE_LABELS
from ..work import stored
from .lookups import innermost_class

CLASS_LABELS = ("Class", "Interface", "Enum", "Type")
#: Levels of ancestors that a member is looked for in.
MOST_LEVELS = 32
#: Languages in which a bare call may mean a member of the class around it.
IMPLICIT_THIS = ("swift", "kotlin", "java", "cpp", "ruby", "csharp")
#: What may stand behind an imported path: fixed values.
SUFFIXES = ("", ".ts", ".tsx", ".js", ".jsx", ".mjs", "/index.ts", "/index.js")
#: The columns of a call site.
SITE = ["caller_id", "callee_name", "line", "file_path", "kind", "receiver_name", "enclosing_class"]
#: What decides, with the caller's language, what a bare call proposes.
PLACE = ["file_path", "callee_name"]


def only_one(frame: DataFrame, keys: list[str], target: str) -> DataFrame:
    """keys with exactly one distinct target; the others are dropped."""
    return frame.groupBy(*keys).agg(F.min(target).alias(target), F.countDistinct(target).alias("n")).where("n = 1").drop("n")


def call_sites(calls: DataFrame) -> DataFrame:
    """Call sites with the columns of their receivers; repeated ones give one edge all the same."""
    return calls.select("caller_id", "callee_name", "line", "file_path", F.col("receiver.kind").alias("kind"), F.col("receiver.name").alias("receiver_name"), "enclosing_class")


def methods(nodes: DataFrame) -> DataFrame:
    """(class_id, name, id): functions inside the smallest class around them, or whose id extends a class's id."""
    inside = innermost_class(nodes).select("class_id", "name", "id")
    classes = nodes.where(F.col("label").isin(*CLASS_LABELS)).select(F.col("id").alias("class_id"))
    nested = nodes.where(F.col("label").isin(*CALLABLE_LABELS)).withColumn("class_id", F.regexp_extract("id", r"^(.*)\.[^.]*$", 1)).join(classes, "class_id", "left_semi").select("class_id", "name", "id")
    return nested.unionByName(inside.join(nested.select("id"), "id", "left_anti")).distinct()


def parents(nodes: DataFrame, inherits: DataFrame) -> DataFrame:
    """(class_id, parent_id) where both names have one class."""
    classes = only_one(nodes.where(F.col("label").isin(*CLASS_LABELS)).select("name", "id"), ["name"], "id")
    lower = inherits.join(classes.select(F.col("name").alias("impl_name"), F.col("id").alias("class_id")), "impl_name")
    return lower.join(classes.select(F.col("name").alias("super_name"), F.col("id").alias("parent_id")), "super_name").select("class_id", "parent_id").where("class_id <> parent_id").distinct()


def resolved_members(spark: SparkSession, wanted: DataFrame, members: DataFrame, above: DataFrame) -> DataFrame:
    """wanted (class_id, name) -> (class_id, name, target): the nearest level of ancestors with the method, if it has one there."""
    front = stored(spark, wanted.select("class_id", "name").dropna().distinct().withColumn("start", F.col("class_id")), "members")
    seen = front
    found = None
    for _ in range(MOST_LEVELS):
        if front.isEmpty():
            break
        hits = front.join(members.withColumnRenamed("id", "target"), ["class_id", "name"]).select("start", "name", "target")
        hits = stored(spark, hits, "hits")
        found = hits if found is None else found.unionByName(hits)
        up = front.join(hits.select("start", "name").distinct(), ["start", "name"], "left_anti").join(above, "class_id").select(F.col("parent_id").alias("class_id"), "name", "start").distinct()
        front = stored(spark, up.join(seen, ["start", "class_id", "name"], "left_anti"), "members")
        seen = seen.unionByName(front)
    found = front.select("start", "name", F.col("name").alias("target")).limit(0) if found is None else found
    return only_one(found, ["start", "name"], "target").withColumnRenamed("start", "class_id")


def import_targets(imports: DataFrame, nodes: DataFrame) -> DataFrame:
    """(file_path, name, target_file): files that the single import of a name can mean.

    Relative and root modules are tried with the known suffixes; dotted ones match files that end in that path.
    """
    single = only_one(imports, ["file_path", "name"], "module")
    files = nodes.select(F.col("file_path").alias("target_file")).distinct()
    module = F.col("module")
    based = F.when(module.startswith("/"), F.regexp_replace(module, "^/+", "")).when(module.startswith("./") | module.startswith("../") | module.isin(".", ".."), joined_path(directory("file_path"), module))
    tried = single.withColumn("base", based).where("base IS NOT NULL").select("file_path", "name", F.explode(F.array(*(F.concat("base", F.lit(s)) for s in SUFFIXES))).alias("target_file"))
    paths = tried.join(files, "target_file")
    dotted = single.where(module.rlike(r"^\.*[A-Za-z_][\w.]*$") & F.col("file_path").rlike(r"\.pyi?$")).withColumn("tail", F.translate(F.regexp_replace("module", r"^\.+", ""), ".", "/"))
    # Every file under each of its path's tails: as many rows as it has segments.
    python = files.where(F.col("target_file").rlike(r"\.pyi?$")).withColumn("p", F.split(F.regexp_replace(F.regexp_replace("target_file", r"\.pyi?$", ""), "/__init__$", ""), "/"))
    tails = python.select("target_file", F.explode(F.transform(F.sequence(F.lit(1), F.size("p")), lambda i: F.array_join(F.slice(F.col("p"), i, F.size("p")), "/"))).alias("tail"))
    return paths.select("file_path", "name", "target_file").unionByName(dotted.join(tails, "tail").select("file_path", "name", "target_file")).distinct()


def types_of(wanted: DataFrame, nodes: DataFrame, targets: DataFrame) -> DataFrame:
    """wanted (file_path, type_name) -> both and class_id: the only class of that name, or the only one that the file imports."""
    wanted = wanted.select("file_path", "type_name").distinct()
    classes = nodes.where(F.col("label").isin(*CLASS_LABELS)).select(F.col("name").alias("type_name"), F.col("id").alias("class_id"), F.col("file_path").alias("target_file"))
    unique = only_one(classes, ["type_name"], "class_id")
    direct = wanted.join(unique, "type_name").select("file_path", "type_name", "class_id")
    rest = wanted.join(unique, "type_name", "left_anti")
    narrowed = rest.join(targets.withColumnRenamed("name", "type_name"), ["file_path", "type_name"]).join(classes, ["type_name", "target_file"])
    return direct.unionByName(only_one(narrowed, ["file_path", "type_name"], "class_id"))


def bare_proposals(bare: DataFrame, functions: DataFrame, targets: DataFrame) -> DataFrame:
    """(file_path, callee_name, scope, target, justification): what bare calls of a name in a file propose.

    Callers in Go have a tier more. Where it decides there is a row for the scope go and one for the others, whose target
    is null if they find nothing; elsewhere there is one row of the scope any.
    """
    places = bare.select(*PLACE).distinct()
    here = functions.select(F.col("name").alias("callee_name"), "file_path", F.col("id").alias("target"))
    imported = targets.withColumnRenamed("name", "callee_name").join(here.withColumnRenamed("file_path", "target_file"), ["target_file", "callee_name"])
    go = functions.where("language = 'go'").select(directory("file_path").alias("dir"), F.col("name").alias("callee_name"), F.col("id").alias("target"))
    # Definitions that are not the only ones go before any call meets them: a name may have many in a file.
    tiers = [
        (places.join(only_one(here, PLACE, "target"), PLACE), "SameFileUnique", 2), (places.join(only_one(imported, PLACE, "target"), PLACE), "ImportNarrowed", 3),
        (places.withColumn("dir", directory("file_path")).join(only_one(go, ["dir", "callee_name"], "target"), ["dir", "callee_name"]), "PackageScope", 4),
        (places.join(only_one(here.select("callee_name", "target"), ["callee_name"], "target"), "callee_name"), "GlobalUnique", 5),
    ]
    whole = None
    for frame, justification, tier in tiers:
        rows = frame.select(*PLACE, F.struct("target", F.lit(justification).alias("justification")).alias("p"), F.lit(tier).alias("tier_no"))
        whole = rows if whole is None else whole.unionByName(rows)
    first = whole.groupBy(*PLACE).agg(F.min_by("p", "tier_no").alias("go"), F.min_by("p", F.when(F.col("tier_no") != 4, F.col("tier_no"))).alias("other"))
    row = lambda scope, p: F.struct(F.lit(scope).alias("scope"), F.col(p)["target"].alias("target"), F.col(p)["justification"].alias("justification"))
    listed = F.when(F.col("go").eqNullSafe(F.col("other")), F.array(row("any", "go"))).otherwise(F.array(row("go", "go"), row("other", "other")))
    return first.select(*PLACE, F.inline(listed))


def member_calls(spark: SparkSession, nodes: DataFrame, own: DataFrame, inherits: DataFrame, fields: DataFrame, variables: DataFrame, targets: DataFrame, implicit: DataFrame) -> DataFrame:
    """Call sites with target and justification, of those that name a member of a class or of an ancestor."""
    this = own.where("kind = 'SelfThis' AND enclosing_class IS NOT NULL").withColumn("class_id", F.col("enclosing_class"))
    typed_fields = only_one(fields.select(F.col("class_id").alias("enclosing_class"), F.col("field_name").alias("receiver_name"), "type_name"), ["enclosing_class", "receiver_name"], "type_name")
    by_field = own.where("kind = 'Field'").join(typed_fields, ["enclosing_class", "receiver_name"])
    # A local hides a field of its name even where its type is not known ('').
    scoped = variables.select("caller_id", F.col("var_name").alias("receiver_name"), "type_name").distinct()
    local = only_one(scoped, ["caller_id", "receiver_name"], "type_name")
    named_calls = own.where("kind = 'Named'")
    by_local = named_calls.join(local.where("type_name <> ''"), ["caller_id", "receiver_name"])
    unhidden = named_calls.join(scoped.select("caller_id", "receiver_name").distinct(), ["caller_id", "receiver_name"], "left_anti").join(typed_fields, ["enclosing_class", "receiver_name"])

    def through(frame: DataFrame) -> DataFrame:
        return frame.join(types_of(frame, nodes, targets), ["file_path", "type_name"])

    # A call has one kind of receiver, so all members are looked up in one walk.
    climbs = [(this, "SelfThisMember"), (through(by_field), "FieldTypeMember"), (through(by_local), "LocalVarType"), (through(unhidden), "FieldTypeMember"), (implicit, "SelfThisMember")]
    wanted = None
    for frame, justification in climbs:
        rows = frame.select(*SITE, "class_id", F.lit(justification).alias("justification"))
        wanted = rows if wanted is None else wanted.unionByName(rows)
    wanted = stored(spark, wanted, "wanted").withColumn("name", F.col("callee_name"))
    # Without a call that needs them neither methods nor ancestors are looked for.
    if wanted.isEmpty():
        return wanted.withColumn("target", F.col("name")).select(*SITE, "target", "justification")
    members, above = stored(spark, methods(nodes), "methods"), stored(spark, parents(nodes, inherits), "parents")
    return wanted.join(resolved_members(spark, wanted, members, above), ["class_id", "name"]).select(*SITE, "target", "justification")


def _near() -> Column:
    """Whether a call may lead into the target's file: one of its own languages and top folder, or an imported one."""
    same = (language_family(F.col("file_path")) == language_family(F.col("target_file"))) & (top_segment("file_path") == top_segment("target_file"))
    return (F.col("justification") == "ImportNarrowed") | same


def call_edges(spark: SparkSession, nodes: DataFrame, calls: DataFrame, inherits: DataFrame, fields: DataFrame, variables: DataFrame, imports: DataFrame, ambiguous: bool = False, only_files: DataFrame | None = None) -> DataFrame:
    """Calls, Tests and HttpCalls edges; only_files (file_path) limits the sites, not what they can resolve to.

    ambiguous adds edges to each of 2 to 5 namesakes of bare calls that no tier resolves, marked Ambiguous.

    What calls have in common (class and name of a member, file and name of a bare call) is resolved once and joined to
    them; what is refused by then, calls never meet.
    """
    if only_files is not None:
        calls = calls.join(only_files.select("file_path").distinct(), "file_path", "left_semi")
    own = stored(spark, call_sites(calls), "calls")
    targets = stored(spark, import_targets(imports, nodes), "targets")
    functions = stored(spark, nodes.where(F.col("label").isin(*CALLABLE_LABELS)).select("id", "name", "file_path", "language"), "functions")
    file_of = nodes.select(F.col("id").alias("target"), F.col("file_path").alias("target_file"))
    callers = nodes.select(F.col("id").alias("caller_id"), F.col("language").alias("caller_language"))
    bare = own.where("kind = 'Bare'")
    shadows = variables.select("caller_id", F.col("var_name").alias("callee_name")).distinct()
    seen = lambda frame: frame.join(shadows, ["caller_id", "callee_name"], "left_anti")
    implicit = seen(bare.where(F.col("enclosing_class").isNotNull())).join(callers.where(F.col("caller_language").isin(*IMPLICIT_THIS)), "caller_id").withColumn("class_id", F.col("enclosing_class"))
    climbed = stored(spark, member_calls(spark, nodes, own, inherits, fields, variables, targets, implicit), "climbed")
    over = climbed.where("kind = 'Bare'").select("caller_id", "enclosing_class", "callee_name").distinct()
    proposed = stored(spark, bare_proposals(bare, functions, targets), "proposed")
    by_language = not proposed.where("scope <> 'any'").isEmpty()

    def placed(rows: DataFrame) -> DataFrame:
        """Bare calls with the columns of those of the rows that hold for them, but those that a member or local decides."""
        found = bare.join(rows.where("scope = 'any'"), PLACE)
        if by_language:
            two = bare.join(rows.where("scope <> 'any'"), PLACE).join(callers, "caller_id", "left")
            found = found.unionByName(two.where(F.col("caller_language").eqNullSafe("go") == (F.col("scope") == "go")).drop("caller_language"))
        return seen(found.join(over, ["caller_id", "enclosing_class", "callee_name"], "left_anti"))

    near = stored(spark, proposed.where("target IS NOT NULL").join(file_of, "target").where(_near()), "near")
    columns = [*SITE, "target", "justification"]
    kept = placed(near).select(*columns).unionByName(climbed.join(file_of, "target").where(_near()).select(*columns)).where("caller_id <> target")
    edge = lambda df, relation, confidence, justification: df.select(F.col("caller_id").alias("src"), F.col("target").alias("dst"), relation.alias("relation"), F.lit("TreeSitter").alias("tier"), F.lit(confidence).alias("confidence"), F.col("file_path").alias("src_file"), F.col("line").alias("src_line"), justification.alias("justification"))
    relations = F.when(is_test_path("file_path"), F.array(F.lit("Calls"), F.lit("Tests"))).otherwise(F.array(F.lit("Calls")))
    out = edge(kept, F.explode(relations), "Inferred", F.col("justification"))
    routes = nodes.where("label = 'Route'").select(F.col("id").alias("target"))
    http = own.where(F.col("callee_name").startswith("route.")).withColumn("target", F.col("callee_name")).join(routes, "target", "left_semi")
    out = out.unionByName(edge(http, F.lit("HttpCalls"), "Extracted", F.lit("HttpPath")))
    if ambiguous:
        loose = seen(bare.join(proposed.select(*PLACE).distinct(), PLACE, "left_anti").join(over, ["caller_id", "enclosing_class", "callee_name"], "left_anti"))
        loose = loose.select(*SITE).unionByName(placed(proposed).where("target IS NULL").select(*SITE))
        named = nodes.where(F.col("label").isin(*CALLABLE_LABELS)).groupBy(F.col("name").alias("callee_name")).agg(F.count(F.lit(1)).alias("n")).where("n BETWEEN 2 AND 5")
        namesakes = nodes.where(F.col("label").isin(*CALLABLE_LABELS)).select(F.col("name").alias("callee_name"), F.col("id").alias("target"), F.col("file_path").alias("target_file")).join(named, "callee_name", "left_semi")
        many = loose.join(namesakes, "callee_name").withColumn("justification", F.lit("Ambiguous"))
        out = out.unionByName(edge(many.where(_near()).where("caller_id <> target"), F.lit("Calls"), "Ambiguous", F.lit("Ambiguous")))
    return first_of_key(out)


def first_of_key(edges: DataFrame) -> DataFrame:
    """One edge for each (src, dst, relation): the first by line."""
    keys = ["src", "dst", "relation"]
    rest = [c for c in edges.columns if c not in keys]
    best = edges.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct((F.col("confidence") == "Ambiguous").cast("int"), "src_line", "src_file")).alias("x"))
    return best.select(*keys, "x.*").select(*edges.columns)


def inheritance_edges(nodes: DataFrame, inherits: DataFrame) -> DataFrame:
    """Implements or Inherits edges where both names are unique; an interface or class as target decides before the syntax."""
    own = nodes.where("label <> 'File'").select("name", "id", "label")
    unique = only_one(own.select("name", "id"), ["name"], "id").join(own.select("id", "label"), "id")
    low = unique.select(F.col("name").alias("impl_name"), F.col("id").alias("src"))
    high = unique.select(F.col("name").alias("super_name"), F.col("id").alias("dst"), "label")
    joined = inherits.join(low, "impl_name").join(high, "super_name").where("src <> dst")
    relation = F.when(F.col("label") == "Interface", "Implements").when(F.col("label") == "Class", "Inherits").when(F.col("kind") == "Implements", "Implements").otherwise("Inherits")
    return joined.select("src", "dst", relation.alias("relation"), F.col("file_path").alias("src_file")).distinct()


def implementer_hyperedges(edges: DataFrame) -> DataFrame:
    """Interfaces with two implementers or more: id, members (implementers and the interface)."""
    own = edges.where("relation = 'Implements'").groupBy("dst").agg(F.array_sort(F.collect_set("src")).alias("who")).where(F.size("who") > 1)
    members = F.concat(F.transform("who", lambda w: F.struct(w.alias("node_id"), F.lit("implementer").alias("role"))), F.array(F.struct(F.col("dst").alias("node_id"), F.lit("interface").alias("role"))))
    return own.select(F.concat(F.lit("implement."), "dst").alias("id"), F.lit("Implement").alias("relation"), members.alias("members"))


def superseded(edges: DataFrame, compiler: DataFrame) -> DataFrame:
    """Compiler-grade edges in place of syntactic ones with the same key."""
    return edges.join(compiler.select("src", "dst", "relation"), ["src", "dst", "relation"], "left_anti").unionByName(compiler, allowMissingColumns=True)


