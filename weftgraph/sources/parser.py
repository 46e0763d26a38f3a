"""Source text to evidence rows. Python is read by its own syntax tree; TypeScript and JavaScript by a tokenizer that
knows functions, classes, methods, imports and calls. What is not understood gives no rows: a missing edge is better
than a wrong one. Files are parsed on the executors, one row of nested evidence each, and then split into tables."""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..functions.scalars import leaf_name, subwords
from ..work import stored
from . import braces, lines

_RECEIVER = "struct<kind:string,name:string>"
EVIDENCE = {
    "nodes": "array<struct<id:string,name:string,label:string,language:string,file_path:string,line_start:int,line_end:int,complexity:int,is_test:boolean>>",
    "calls": f"array<struct<caller_id:string,callee_name:string,line:int,file_path:string,receiver:{_RECEIVER},enclosing_class:string>>",
    "inherits": "array<struct<impl_name:string,super_name:string,kind:string,file_path:string>>",
    "fields": "array<struct<class_id:string,field_name:string,type_name:string,file_path:string>>",
    "imports": "array<struct<file_path:string,name:string,module:string>>",
    "locals": "array<struct<caller_id:string,var_name:string,type_name:string,file_path:string>>",
    "type_refs": "array<struct<file_path:string,type_name:string>>",
    "symbol_refs": "array<struct<name:string,kind:string,file_path:string,line:int>>",
}
HTTP_NAMES = ("get", "post", "put", "patch", "delete", "head", "options")
_BRANCHES = (ast.If, ast.For, ast.While, ast.AsyncFor, ast.ExceptHandler, ast.With, ast.IfExp, ast.BoolOp, ast.comprehension, ast.Assert, ast.match_case)


def _segment(text: str) -> str:
    return re.sub("[^A-Za-z0-9]+", "_", text).lower().strip("_")


def _id(project: str, path: str, *names: str) -> str:
    stem = re.sub(r"\.[^./]+$", "", path)
    return ".".join(s for s in map(_segment, [project, *stem.split("/"), *names]) if s)


def _empty() -> dict[str, list]:
    return {k: [] for k in EVIDENCE}


def _receiver(text: str | None) -> tuple[str, str | None]:
    if not text:
        return "Bare", None
    if text in ("self", "this", "cls"):
        return "SelfThis", None
    if text in ("super", "super()"):
        return "Super", None
    m = re.fullmatch(r"(?:self|this)\.([A-Za-z_$][\w$]*)", text)
    return ("Field", m[1]) if m else ("Named", text)


class _Python(ast.NodeVisitor):
    def __init__(self, project: str, path: str):
        self.project, self.path, self.out = project, path, _empty()
        self.file_id = _id(project, path)
        self.names: list[str] = []
        self.function, self.cls = self.file_id, None

    def node(self, item: ast.AST, label: str) -> str:
        own = _id(self.project, self.path, *self.names)
        complexity = None
        if label in ("Function", "Method"):
            complexity, todo = 1, list(item.body)
            while todo:
                n = todo.pop()
                if not isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)):
                    complexity += isinstance(n, _BRANCHES)
                    todo += ast.iter_child_nodes(n)
        test = True if item.name.startswith("test_") else None
        self.out["nodes"].append((own, item.name, label, "python", self.path, item.lineno, item.end_lineno or item.lineno, complexity, test))
        return own

    def visit_ClassDef(self, item: ast.ClassDef) -> None:
        held = self.names, self.function, self.cls
        self.names = [*self.names, item.name]
        self.cls = self.node(item, "Class")
        for base in item.bases:
            if name := _dotted(base):
                self.out["inherits"].append((item.name, name.split(".")[-1], "Extends", self.path))
                self.out["type_refs"].append((self.path, name.split(".")[-1]))
        for d in item.decorator_list:
            self.reference(d, "framework_registration")
            self.visit(d)
        for child in item.body:
            if isinstance(child, ast.AnnAssign) and isinstance(child.target, ast.Name) and (kind := _dotted(child.annotation)):
                self.out["fields"].append((self.cls, child.target.id, kind.split(".")[-1], self.path))
            self.visit(child)
        self.names, self.function, self.cls = held

    def visit_FunctionDef(self, item) -> None:
        held = self.names, self.function
        self.names = [*self.names, item.name]
        for d in item.decorator_list:
            self.reference(d, "framework_registration")
            self.route(d, item)
            self.visit(d)
        self.function = self.node(item, "Function")
        arguments = [*item.args.posonlyargs, *item.args.args, *item.args.kwonlyargs, *(a for a in (item.args.vararg, item.args.kwarg) if a)]
        for a in arguments:
            if a.arg not in ("self", "cls"):
                kind = _dotted(a.annotation) if a.annotation else None
                self.out["locals"].append((self.function, a.arg, kind.split(".")[-1] if kind else "", self.path))
        for child in item.body:
            self.visit(child)
        self.names, self.function = held

    visit_AsyncFunctionDef = visit_FunctionDef

    def reference(self, item: ast.AST, kind: str) -> None:
        target = item.func if isinstance(item, ast.Call) else item
        if name := _dotted(target):
            self.out["symbol_refs"].append((name, kind, self.path, item.lineno))

    def route(self, item: ast.AST, function) -> None:
        if isinstance(item, ast.Call) and isinstance(item.func, ast.Attribute) and item.func.attr in HTTP_NAMES and item.args and not re.search(r"(^|/)(tests?|spec)(/|_|\.)", self.path):
            first = item.args[0]
            if isinstance(first, ast.Constant) and isinstance(first.value, str) and len(first.value) <= 200:
                path = "/" + "/".join(p for p in first.value.split("/") if p)
                method = item.func.attr.upper()
                own = f"route.{re.sub('[^A-Za-z0-9]', '_', path)}.{method}"
                self.out["nodes"].append((own, f"{method} {path}", "Route", "python", self.path, function.lineno, function.lineno, None, None))

    def visit_Call(self, item: ast.Call) -> None:
        name = _dotted(item.func)
        if isinstance(item.func, ast.Attribute):
            owner = _dotted(item.func.value) or ("super()" if isinstance(item.func.value, ast.Call) and _dotted(item.func.value.func) == "super" else "?")
            self.out["calls"].append((self.function, item.func.attr, item.lineno, self.path, _receiver(owner), self.cls))
        elif name:
            self.out["calls"].append((self.function, name, item.lineno, self.path, ("Bare", None), self.cls))
        for a in [*item.args, *(k.value for k in item.keywords)]:
            if isinstance(a, (ast.Name, ast.Attribute)):
                self.reference(a, "callback")
        self.generic_visit(item)

    def visit_Assign(self, item: ast.Assign) -> None:
        kind = _dotted(item.value.func) if isinstance(item.value, ast.Call) else None
        typed = kind.split(".")[-1] if kind and kind.split(".")[-1][:1].isupper() else ""
        for target in item.targets:
            if isinstance(target, ast.Name) and self.function != self.file_id:
                self.out["locals"].append((self.function, target.id, typed, self.path))
            elif typed and self.cls and (m := re.fullmatch(r"self\.(\w+)", _dotted(target) or "")):
                self.out["fields"].append((self.cls, m[1], typed, self.path))
        if isinstance(item.value, (ast.Name, ast.Attribute)):
            self.reference(item.value, "function_value")
        self.generic_visit(item)

    def visit_Import(self, item: ast.Import) -> None:
        self.out["imports"] += [(self.path, a.asname or a.name.split(".")[0], a.name if a.asname else a.name.split(".")[0]) for a in item.names]

    def visit_ImportFrom(self, item: ast.ImportFrom) -> None:
        module = "." * item.level + (item.module or "")
        self.out["imports"] += [(self.path, a.asname or a.name, module) for a in item.names]


def _dotted(item: ast.AST | None) -> str | None:
    if isinstance(item, ast.Name):
        return item.id
    if isinstance(item, ast.Attribute) and (left := _dotted(item.value)):
        return f"{left}.{item.attr}"
    if isinstance(item, ast.Constant) and isinstance(item.value, str) and item.value.isidentifier():
        return item.value
    return None


_SCRIPT = re.compile(
    r"(?P<skip>//[^\n]*|/\*.*?\*/|'(?:[^'\\\n]|\\.)*'|\"(?:[^\"\\\n]|\\.)*\"|`(?:[^`\\]|\\.)*`)|(?P<word>[A-Za-z_$][\w$]*)|(?P<line>\n)|(?P<sign>=>|\?\.|[^\s\w])",
    re.S,
)
#: Words before a parenthesis that are no calls: fixed values of the language.
_KEYWORDS = frozenset("if for while switch catch return function typeof await new super import require constructor else do throw in of void delete yield case instanceof async".split())


def _script(project: str, path: str, text: str) -> dict[str, list]:
    out, file_id = _empty(), _id(project, path)
    tokens: list[tuple[str, str, int]] = []
    line = 1
    for m in _SCRIPT.finditer(text):
        if m.lastgroup in ("word", "sign"):
            tokens.append((m.lastgroup, m[0], line))
        elif m.lastgroup == "skip" and m[0][0] in "'\"":
            tokens.append(("text", m[0][1:-1], line))
        line += m[0].count("\n")
    language = "typescript" if re.search(r"\.[mc]?tsx?$", path) else "javascript"
    scopes: list[tuple[int, str, str, int]] = []  # depth, id, kind, node index
    depth, i, n = 0, 0, len(tokens)
    pending: tuple[str, str, int] | None = None
    value = lambda k: tokens[k][1] if 0 <= k < n else ""
    kind_at = lambda k: tokens[k][0] if 0 <= k < n else ""

    def closing(k: int) -> int:
        level = 0
        for j in range(k, n):
            level += (value(j) == "(") - (value(j) == ")")
            if level == 0:
                return j
        return n

    while i < n:
        kind, word, at = tokens[i]
        function = next((s[1] for s in reversed(scopes) if s[2] in ("Function", "Method")), file_id)
        cls = next((s[1] for s in reversed(scopes) if s[2] == "Class"), None)
        in_class = bool(scopes) and scopes[-1][2] == "Class" and scopes[-1][0] == depth
        if kind == "sign" and word == "{":
            depth += 1
            if pending and pending[0]:
                own = (scopes[-1][1] + "." + _segment(pending[0])) if scopes else _id(project, path, pending[0])
                out["nodes"].append([own, pending[0], pending[1], language, path, pending[2], at, None, None])
                scopes.append((depth, own, pending[1], len(out["nodes"]) - 1))
            pending = None
        elif kind == "sign" and word == "}":
            if scopes and scopes[-1][0] == depth:
                out["nodes"][scopes.pop()[3]][6] = at
            depth -= 1
        elif kind == "word" and word == "import":
            j = i + 1
            names: list[str] = []
            while j < n and kind_at(j) != "text" and value(j) not in (";", "("):
                if kind_at(j) == "word" and value(j) not in ("from", "type", "as"):
                    if value(j - 1) == "as" and names:
                        names[-1] = value(j)
                    else:
                        names.append(value(j))
                j += 1
            if kind_at(j) == "text":
                out["imports"] += [(path, name, value(j)) for name in names]
                i = j
        elif kind == "word" and word == "export" and value(i + 1) in ("{", "*"):
            # names that another module is asked for: export { a, b as c } from "m", export * as n from "m"
            j, names = i + 1, []
            while j < n and kind_at(j) != "text" and value(j) != ";":
                if value(j) == "}" and value(j + 1) != "from":
                    break
                if kind_at(j) == "word" and value(j) not in ("from", "type", "as"):
                    names = [*(names[:-1] if value(j - 1) == "as" else names), value(j)]
                j += 1
            if kind_at(j) == "text":
                out["imports"] += [(path, name, value(j)) for name in names]
            i = j
        elif kind == "word" and word in ("class", "interface") and kind_at(i + 1) == "word":
            pending = (value(i + 1), "Class" if word == "class" else "Interface", at)
            j, how = i + 2, None
            while j < n and value(j) != "{":
                if value(j) in ("extends", "implements"):
                    how = value(j)
                elif how and kind_at(j) == "word" and value(j - 1) in ("extends", "implements", ","):
                    out["inherits"].append((pending[0], value(j), "Extends" if how == "extends" else "Implements", path))
                j += 1
            i = j - 1
        elif kind == "word" and word == "function" and kind_at(i + 1) == "word":
            pending = (value(i + 1), "Function", at)
            i = min(closing(i + 2), n) if value(i + 2) == "(" else i + 1
        elif kind == "word" and word in ("const", "let", "var") and kind_at(i + 1) == "word" and value(i + 2) == "=" and (value(i + 3) == "(" or (value(i + 3) == "async" and value(i + 4) == "(")):
            start = i + 3 if value(i + 3) == "(" else i + 4
            end = closing(start)
            if value(end + 1) == "=>" and value(end + 2) == "{":
                pending = (value(i + 1), "Function", at)
                i = end + 1
        elif kind == "word" and word in ("const", "let", "var") and kind_at(i + 1) == "word" and function != file_id:
            typed = value(i + 4) if value(i + 2) == "=" and value(i + 3) == "new" else ""
            out["locals"].append((function, value(i + 1), typed, path))
            i += 1
        elif in_class and kind == "word" and value(i + 1) == "(" and word not in _KEYWORDS - {"constructor"}:
            end = closing(i + 1)
            j = end + 1
            while j < n and value(j) not in ("{", ";", "}"):
                j += 1
            if value(j) == "{":
                pending = (word, "Method", at)
                i = j - 1
        elif in_class and kind == "word" and value(i + 1) == ":" and kind_at(i + 2) == "word":
            out["fields"].append((cls, word, value(i + 2), path))
            i += 2
        elif kind == "word" and value(i + 1) == "(" and word not in _KEYWORDS:
            j, owner = i - 1, []
            while value(j) in (".", "?.") and kind_at(j - 1) == "word":
                owner.insert(0, value(j - 1))
                j -= 2
            receiver = _receiver(".".join(owner)) if owner else (("Named", "?") if value(i - 1) in (".", "?.") else ("Bare", None))
            if value(i - 1) != "new":
                out["calls"].append((function, word, at, path, receiver, cls))
            if owner and word in HTTP_NAMES and kind_at(i + 2) == "text" and value(i + 2).startswith("/") and len(value(i + 2)) <= 200 and not re.search(r"(^|/)(tests?|spec)(/|_|\.)|\.(test|spec)\.", path):
                route = f"route.{re.sub('[^A-Za-z0-9]', '_', value(i + 2))}.{word.upper()}"
                out["nodes"].append((route, f"{word.upper()} {value(i + 2)}", "Route", language, path, at, at, None, None))
        i += 1
    return out


def parse_file(project: str, path: str, text: str) -> dict[str, list]:
    """Evidence of one file; a file that does not parse is a File node and nothing else."""
    out = _empty()
    if re.search(r"\.pyi?$", path):
        visitor = _Python(project, path)
        try:
            visitor.visit(ast.parse(text))
            out = visitor.out
        except (SyntaxError, ValueError, RecursionError):
            pass
        language = "python"
    elif re.search(r"\.([mc]?[jt]s|[jt]sx)$", path):
        out = _script(project, path, text)
        language = "typescript" if re.search(r"\.[mc]?tsx?$", path) else "javascript"
    else:
        own = (path, text, out, _id(project, path), lambda *names: _id(project, path, *names), _receiver)
        language = braces.read(*own) or lines.read(*own) or path.rsplit(".", 1)[-1]
    out["nodes"].insert(0, (_id(project, path) + ".file", path.split("/")[-1], "File", language, path, 1, text.count("\n") + 1, None, None))
    return out


def parsed(files: DataFrame, project: str) -> dict[str, DataFrame]:
    """(file_path, text) -> the evidence tables; the files are parsed once."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for i in range(0, len(frame), 50):
                part = frame.iloc[i : i + 50]
                found = [parse_file(project, path, text or "") for path, text in zip(part["file_path"], part["text"])]
                yield pd.DataFrame({k: [[_row(k, r) for r in rows[k]] for rows in found] for k in EVIDENCE})

    nested = files.select("file_path", "text").mapInPandas(run, ", ".join(f"{k} {v}" for k, v in EVIDENCE.items()))
    return split(stored(files.sparkSession, nested, "parsed"))


_FIELDS = {k: re.findall(r"(?:<|,)(\w+):(?!struct)|(receiver):", v) for k, v in EVIDENCE.items()}


def _row(kind: str, values) -> dict:
    names = {"calls": ("caller_id", "callee_name", "line", "file_path", "receiver", "enclosing_class")}.get(kind) or [a or b for a, b in _FIELDS[kind]]
    row = dict(zip(names, values))
    if kind == "calls":
        row["receiver"] = {"kind": row["receiver"][0], "name": row["receiver"][1]}
    return row


def split(nested: DataFrame) -> dict[str, DataFrame]:
    """The tables of nested evidence, with their derived columns."""
    tables = {k: nested.select(F.inline(k)) for k in EVIDENCE}
    tables["nodes"] = tables["nodes"].withColumn("parts", subwords("name"))
    tables["calls"] = tables["calls"].withColumns({"leaf_name": leaf_name("callee_name"), "receiver_name": F.col("receiver.name")})
    tables["symbol_refs"] = tables["symbol_refs"].withColumn("leaf_name", leaf_name("name"))
    return tables
