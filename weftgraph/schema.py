"""Table schemas and closed vocabularies of the graph. A graph is a set of DataFrames with these columns."""

from __future__ import annotations

SCHEMA_VERSION = 1

TABLES = {
    "nodes": "id string, name string, parts string, doc_text string, label string, language string, file_path string, line_start int, line_end int, community int, pagerank double, betweenness double, complexity int, fan_in int, fan_out int, is_test boolean, metadata map<string,string>",
    "edges": "src string, dst string, relation string, tier string, confidence string, src_file string, src_line int, justification string",
    "hyperedges": "id string, relation string, label string, confidence string, tier string, members array<struct<node_id:string,role:string>>",
    "calls": "caller_id string, callee_name string, line int, file_path string, receiver struct<kind:string,name:string>, enclosing_class string, leaf_name string",
    "symbol_refs": "name string, leaf_name string, kind string, file_path string, line int",
    "inherits": "impl_name string, super_name string, kind string, file_path string",
    "fields": "class_id string, field_name string, type_name string, file_path string",
    "imports": "file_path string, name string, module string",
    "locals": "caller_id string, var_name string, type_name string, file_path string",
    "type_refs": "file_path string, type_name string",
    "manifest": "file_path string, sha256 string, mtime long",
    "cochanges": "file_a string, file_b string, n long",
    "contexts": "path string, summary string, added_at long",
    "vectors": "id string, embedding array<float>",
}

#: Keys by which the store replaces rows.
KEYS = {"nodes": ["id"], "edges": ["src", "dst", "relation"], "hyperedges": ["id"], "manifest": ["file_path"], "cochanges": ["file_a", "file_b"], "contexts": ["path", "summary"], "vectors": ["id"]}
#: Tables whose rows belong to the file in file_path.
BY_FILE = ("nodes", "calls", "symbol_refs", "inherits", "fields", "imports", "locals", "type_refs")

# The closed vocabularies of the data model.
NODE_LABELS = ("Project", "Package", "Folder", "File", "Module", "Class", "Function", "Method", "Interface", "Enum", "Type", "Route", "Resource", "Document", "Image", "Figure", "Topic", "Concept")
TIERS = ("Scip", "TreeSitter", "Llm", "Ingest")
CONFIDENCES = ("Extracted", "Inferred", "Ambiguous")
REFERENCE_KINDS = ("direct_call", "function_value", "callback", "ffi_export", "macro_registration", "framework_registration", "public_export", "unknown_indirect")
SYMBOL_LABELS = ("Function", "Method", "Class", "Interface", "Enum", "Type")
RANKED_LABELS = ("Function", "Method", "Class", "Interface", "Route")
CALLABLE_LABELS = ("Function", "Method")
HTTP_METHODS = ("get", "post", "put", "patch", "delete", "head", "options", "trace", "connect", "all", "any", "use", "route", "ws", "websocket")
#: Files whose imports tell that a name comes from another package.
SCRIPT_EXTENSIONS = ("ts", "tsx", "mts", "cts", "js", "jsx", "mjs", "cjs")
