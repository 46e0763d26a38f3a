"""Source trees, documents, path aliases, compiler occurrences and commit history as DataFrames."""

from __future__ import annotations

import fnmatch
import json
import posixpath
import re
import subprocess

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.scalars import extension
from ..operators.lookups import span_lookup

# What is read as code and as documents.
CODE_EXTENSIONS = ("rs", "py", "pyi", "js", "jsx", "mjs", "cjs", "ts", "mts", "cts", "tsx", "go", "swift", "kt", "kts", "java", "c", "h", "cpp", "cc", "cxx", "hpp", "hh", "hxx", "rb", "cs", "sh", "bash")
DOCUMENT_EXTENSIONS = ("md", "markdown", "mdx", "rst", "adoc", "asciidoc", "txt", "strings", "stringsdict", "po", "xliff", "xlf", "arb")
LOCKFILES = ("package-lock.json", "yarn.lock", "pnpm-lock.yaml", "composer.lock", "poetry.lock", "Cargo.lock", "Gemfile.lock", "go.sum", "podfile.lock")
SKIPPED_FOLDERS = (
    "target", "node_modules", ".venv", "venv", "env", "Pods", "build", "dist", ".git", ".gradle", ".next", ".nuxt", "__pycache__", ".cache", "DerivedData", "vendor",
    ".idea", ".vscode", "out", ".dart_tool", ".mypy_cache", ".pytest_cache", ".tox", "bin", "obj", ".svn", ".hg", ".terraform", "coverage", "Carthage", ".bundle",
    "bower_components", ".yarn", ".pnp",
)
MOST_BYTES = 1_500_000
CHUNK_BYTES, NAME_CHARS = 1500, 60


def read_tree(spark: SparkSession, root: str, ignore: tuple[str, ...] = ()) -> DataFrame:
    """(file_path, text, sha256, mtime) of the files under a root that count as code or documents, read by the executors.

    ignore: glob patterns on the relative path. Names and sizes are filtered before any content is read.
    """
    base = root.rstrip("/") + "/"
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(base)
    path = F.regexp_replace(F.col("path"), "^[a-z]+:/*", "/")
    relative = F.expr("substring(p, instr(p, r) + length(r))")
    own = found.withColumns({"p": path, "r": F.lit(re.sub("^[a-z]+:/*", "/", base))}).withColumn("file_path", relative)
    folders = F.arrays_overlap(F.split("file_path", "/"), F.array(*(F.lit(x) for x in SKIPPED_FOLDERS)))
    keep = classified(F.col("file_path"), F.col("length")).isNotNull() & ~folders
    for pattern in ignore:
        keep = keep & ~F.col("file_path").rlike(fnmatch.translate(pattern).replace(r"\Z", "$").replace(r"\z", "$"))
    return own.where(keep).select("file_path", F.decode("content", "UTF-8").alias("text"), F.sha2("content", 256).alias("sha256"), (F.unix_micros("modificationTime") * 1000).alias("mtime"))


def classified(path: Column, length: Column) -> Column:
    """code, document or null."""
    e = extension(path)
    usable = (length <= MOST_BYTES) & ~F.element_at(F.split(path, "/"), -1).isin(*LOCKFILES)
    return F.when(usable & e.isin(*CODE_EXTENSIONS), "code").when(usable & e.isin(*DOCUMENT_EXTENSIONS), "document")


def git_files(spark: SparkSession, root: str) -> DataFrame | None:
    """(file_path) of tracked and of untracked, not ignored files; None where the root is no repository."""
    done = subprocess.run(["git", "-C", root, "ls-files", "-z", "--cached", "--others", "--exclude-standard"], capture_output=True)
    if done.returncode:
        return None
    return spark.createDataFrame([(p,) for p in done.stdout.decode("utf-8", "replace").split("\0") if p], "file_path string")


def git_commits(spark: SparkSession, root: str, most: int = 1000) -> DataFrame:
    """(commit_id, file_path) of the last commits without merges."""
    done = subprocess.run(["git", "-C", root, "log", "--no-merges", "--name-only", f"-n{most}", "--format=%x00%H"], capture_output=True)
    rows = [(block.split("\n")[0], line) for block in done.stdout.decode("utf-8", "replace").split("\0") for line in block.split("\n")[1:] if line]
    return spark.createDataFrame(rows, "commit_id string, file_path string")


def snippets(files: DataFrame, nodes: DataFrame, most: int = 400) -> DataFrame:
    """(id, snippet): the lines of each node's span, `most` at most."""
    joined = nodes.join(files.select("file_path", F.split("text", "\n").alias("lines")), "file_path")
    size = F.least(F.col("line_end") - F.col("line_start") + 1, F.lit(most))
    return joined.select("id", F.array_join(F.slice("lines", F.greatest("line_start", F.lit(1)), F.greatest(size, F.lit(0))), "\n").alias("snippet"))


def chunks(text: Column, most: int = CHUNK_BYTES) -> Column:
    """array<string>: paragraphs (parts between blank lines) put together while they stay within `most` bytes."""
    parts = F.filter(F.transform(F.split(text, "\n\n"), lambda p: F.trim(F.regexp_replace(p, r"^\s+|\s+$", ""))), lambda p: p != "")
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def step(state: Column, part: Column) -> Column:
        full = (state["open"] != "") & (F.octet_length(state["open"]) + F.octet_length(part) > most)
        done = F.when(full, F.concat(state["done"], F.array(state["open"]))).otherwise(state["done"])
        return F.struct(done.alias("done"), F.when(full | (state["open"] == ""), part).otherwise(F.concat(state["open"], F.lit("\n\n"), part)).alias("open"))

    return F.aggregate(parts, start, step, lambda s: F.when(s["open"] == "", s["done"]).otherwise(F.concat(s["done"], F.array(s["open"]))))


def plain_text(html: Column) -> Column:
    """HTML without scripts, styles and tags, with the common entities."""
    text = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1>", " ")
    text = F.regexp_replace(F.regexp_replace(text, r"(?i)</(p|div|h[1-6]|li|tr)>", "\n\n"), r"(?s)<[^>]*>", " ")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(text, "[ \t]+", " "))


def document_nodes(documents: DataFrame) -> DataFrame:
    """(source, text) -> one Document node for each chunk, named by its first line that is not blank."""
    listed = documents.select("source", F.posexplode(chunks(F.col("text"))).alias("i", "text"))
    first = F.regexp_extract("text", r"(?m)^\s*(\S.*?)\s*$", 1)
    name = F.when(first == "", F.concat("source", F.lit(" #"), "i")).otherwise(F.substring(first, 1, NAME_CHARS))
    stem = F.trim(F.lower(F.regexp_replace("source", "[^A-Za-z0-9]+", "_")), F.lit("_"))
    return listed.select(F.concat(F.lit("doc."), stem, F.lit("."), "i").alias("id"), name.alias("name"), F.lit("Document").alias("label"), F.col("source").alias("file_path"), "text")


def occurrence_edges(definitions: DataFrame, references: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges of a compiler index: definitions (symbol, file_path, line), references (symbol, file_path, line).

    The first definition of a symbol by file and line wins; both ends become nodes by their span.
    """
    first = definitions.groupBy("symbol").agg(F.min(F.struct("file_path", "line")).alias("d")).select("symbol", "d.file_path", "d.line")
    target = span_lookup(first, nodes).select("symbol", F.col("id").alias("dst"))
    source = span_lookup(references.select("symbol", "file_path", "line").distinct(), nodes).select("symbol", F.col("id").alias("src"), F.col("file_path").alias("src_file"), F.col("line").alias("src_line"))
    labels = nodes.select(F.col("id").alias("dst"), "label")
    found = source.join(target, "symbol").join(labels, "dst").where("src <> dst")
    relation = F.when(F.col("label").isin("Function", "Method"), "Calls").when(F.col("label").isin("Class", "Interface", "Enum", "Type"), "UsesType")
    edges = found.select("src", "dst", relation.alias("relation"), "src_file", "src_line").where("relation IS NOT NULL")
    best = edges.groupBy("src", "dst", "relation").agg(F.min(F.struct("src_file", "src_line")).alias("s"))
    return best.select("src", "dst", "relation", F.lit("Scip").alias("tier"), F.lit("Extracted").alias("confidence"), "s.src_file", "s.src_line", F.lit("Scip").alias("justification"))


class AliasMap:
    """Path aliases of tsconfig-like files: the nearest scope above a file, its longest matching pattern, the first target."""

    def __init__(self, configs: dict[str, str]):
        self.scopes: list[tuple[str, str | None, list[tuple[str, str, str]]]] = []
        for path, text in configs.items():
            try:
                options = json.loads(re.sub(r",\s*([}\]])", r"\1", re.sub(r'("(?:[^"\\]|\\.)*")|//[^\n]*|/\*.*?\*/', lambda m: m[1] or "", text, flags=re.S))).get("compilerOptions", {})
            except ValueError:
                continue
            scope = posixpath.dirname(path)
            base = posixpath.normpath(posixpath.join(scope, options["baseUrl"])) if "baseUrl" in options else None
            rules = [(*(p.split("*", 1) if "*" in p else (p, None)), ts[0]) for p, ts in (options.get("paths") or {}).items() if ts]
            rules.sort(key=lambda r: (-len(r[0]), r[0], r[1] or ""))
            self.scopes.append((scope, base, [(a, b, posixpath.normpath(posixpath.join(base or scope, t))) for a, b, t in rules]))
        self.scopes.sort(key=lambda s: -len(s[0]))

    def resolve(self, importer: str, module: str, folders: frozenset[str] = frozenset()) -> str | None:
        """/path from the root, or None; folders: those that exist under the base, for plain names."""
        for scope, base, rules in self.scopes:
            if scope and not importer.startswith(scope + "/"):
                continue
            for before, after, target in rules:
                if after is None and module == before:
                    return "/" + target
                if after is not None and module.startswith(before) and module.endswith(after) and len(module) >= len(before) + len(after):
                    return "/" + target.replace("*", module[len(before) : len(module) - len(after)], 1)
            if base is not None and not module.startswith(".") and posixpath.normpath(posixpath.join(base, module.split("/")[0])) in folders:
                return "/" + posixpath.normpath(posixpath.join(base, module))
            return None
        return None


def aliased(imports: DataFrame, configs: dict[str, str], folders: frozenset[str] = frozenset()) -> DataFrame:
    """imports with modules replaced by what the aliases make of them."""
    known = AliasMap(configs)

    @F.pandas_udf("string")
    def resolve(files, modules):
        return type(files)([known.resolve(f, m, folders) or m for f, m in zip(files, modules)])

    return imports.withColumn("module", resolve("file_path", "module"))
