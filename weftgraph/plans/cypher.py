"""A small read-only graph query language and plain read-only SQL.

    MATCH (v[:Label])(-[:RELATION]->(v[:Label])){0,2} [WHERE c [AND c ...]] RETURN v.p[, v.p ...] [LIMIT n]

Conditions are v.p = 'x', v.p CONTAINS 'x' and v.p STARTS WITH 'x', where the latter two ignore case. Results are
distinct and sorted; property columns are named v_p. A tokenizer reads the text, so keywords inside quotes are text.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

DEFAULT_LIMIT, MOST_ROWS = 50, 1000
PROPERTIES = {"name": "name", "file": "file_path", "file_path": "file_path", "line": "line_start", "line_start": "line_start", "label": "label", "kind": "label", "language": "language", "lang": "language", "id": "id", "pagerank": "pagerank"}
_TOKEN = re.compile(r"\s*(?:(?P<string>'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(?P<word>[A-Za-z_][A-Za-z0-9_]*)|(?P<number>\d+)|(?P<sign>->|[()\[\]:.,=\-*]))")


class CypherError(ValueError):
    pass


@dataclass
class Query:
    vertices: list[tuple[str, str | None]] = field(default_factory=list)
    relations: list[str | None] = field(default_factory=list)
    conditions: list[tuple[str, str, str, str]] = field(default_factory=list)
    returns: list[tuple[str, str]] = field(default_factory=list)
    limit: int = DEFAULT_LIMIT


class _Reader:
    def __init__(self, text: str):
        self.tokens: list[tuple[str, str]] = []
        at = 0
        text = text.strip().rstrip(";")
        while at < len(text.rstrip()):
            m = _TOKEN.match(text, at)
            if not m:
                raise CypherError(f"unexpected text at {at}")
            kind = m.lastgroup
            value = m[kind]
            self.tokens.append((kind, re.sub(r"\\(.)", r"\1", value[1:-1]) if kind == "string" else value))
            at = m.end()
        self.at = 0

    def peek(self, word: str) -> bool:
        return self.at < len(self.tokens) and self.tokens[self.at][0] != "string" and self.tokens[self.at][1].upper() == word

    def take(self, word: str) -> bool:
        if found := self.peek(word):
            self.at += 1
        return found

    def need(self, word: str) -> None:
        if not self.take(word):
            raise CypherError(f"{word} expected")

    def value(self, kind: str) -> str:
        if self.at >= len(self.tokens) or self.tokens[self.at][0] != kind:
            raise CypherError(f"{kind} expected")
        self.at += 1
        return self.tokens[self.at - 1][1]


def parse(text: str) -> Query:
    r, q = _Reader(text), Query()

    def vertex() -> None:
        r.need("(")
        name = r.value("word") if r.at < len(r.tokens) and r.tokens[r.at][0] == "word" else f"_{len(q.vertices)}"
        label = r.value("word") if r.take(":") else None
        r.need(")")
        q.vertices.append((name, label))

    def prop() -> tuple[str, str]:
        name = r.value("word")
        if name not in {v for v, _ in q.vertices}:
            raise CypherError(f"unknown variable {name}")
        r.need(".")
        own = r.value("word")
        if own not in PROPERTIES:
            raise CypherError(f"unknown property {own}")
        return name, own

    r.need("MATCH")
    vertex()
    while r.take("-"):
        r.need("[")
        if r.at < len(r.tokens) and r.tokens[r.at][0] == "word":
            r.value("word")
        q.relations.append(r.value("word") if r.take(":") else None)
        r.need("]")
        r.need("->")
        vertex()
    if len(q.relations) > 2:
        raise CypherError("at most 2 hops")
    if r.take("WHERE"):
        while True:
            name, own = prop()
            kind = "=" if r.take("=") else "CONTAINS" if r.take("CONTAINS") else "STARTS" if r.take("STARTS") else None
            if kind is None:
                raise CypherError("=, CONTAINS or STARTS WITH expected")
            if kind == "STARTS":
                r.need("WITH")
            kind_of = r.tokens[r.at][0] if r.at < len(r.tokens) else ""
            q.conditions.append((name, own, kind, r.value("number" if kind_of == "number" else "string")))
            if not r.take("AND"):
                break
    r.need("RETURN")
    q.returns.append(prop())
    while r.take(","):
        q.returns.append(prop())
    if r.take("LIMIT"):
        q.limit = min(int(r.value("number")), MOST_ROWS)
    if r.at != len(r.tokens):
        raise CypherError(f"unexpected {r.tokens[r.at][1]}")
    return q


def _condition(column: Column, kind: str, value: str) -> Column:
    if kind == "=":
        return column.cast("string") == value
    escaped = re.sub(r"([%_\\])", r"\\\1", value)
    return column.cast("string").ilike(f"%{escaped}%" if kind == "CONTAINS" else f"{escaped}%")


def run(text: str, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The query's rows. Filters of each variable, and its columns alone, go below the joins."""
    q = parse(text)
    wanted: dict[str, set[str]] = {v: {"id"} for v, _ in q.vertices}
    for v, p in [*q.returns, *((v, p) for v, p, _, _ in q.conditions)]:
        wanted[v].add(PROPERTIES[p])
    have = set(nodes.columns)

    def side(place: int) -> DataFrame:
        v, label = q.vertices[place]
        own = nodes if label is None else nodes.where(F.col("label") == label)
        for name, p, kind, value in q.conditions:
            if name == v:
                own = own.where(_condition(F.col(PROPERTIES[p]) if PROPERTIES[p] in have else F.lit(None), kind, value))
        return own.select(*((F.col(c) if c in have else F.lit(None).cast("string")).alias(f"{place}_{c}") for c in sorted(wanted[v])))

    out = side(0)
    for hop, relation in enumerate(q.relations):
        steps = edges if relation is None else edges.where(F.col("relation") == relation)
        steps = steps.select(F.col("src").alias(f"{hop}_id"), F.col("dst").alias(f"{hop + 1}_id"))  # the result is made distinct
        out = out.join(steps, f"{hop}_id").join(side(hop + 1), f"{hop + 1}_id")
    first = {}
    for place, (v, _) in enumerate(q.vertices):
        if v in first:
            out = out.where(F.col(f"{first[v]}_id") == F.col(f"{place}_id"))
        else:
            first[v] = place
    names: dict[str, Column] = {}
    for v, p in q.returns:
        names.setdefault(f"{v}_{p}", F.col(f"{first[v]}_{PROPERTIES[p]}"))
    rows = out.select(*(c.alias(n) for n, c in names.items())).distinct()
    return rows.orderBy(*names).limit(q.limit)


#: Functions that reach beyond the rows.
FORBIDDEN = r"(?i)\b(?:reflect|java_method|try_reflect|read_files|input_file_name|current_user|session_user|version|parse_url|from_xml|python_worker_logs)\b(?=\s*\()"


def query_readonly(spark: SparkSession, sql: str, limit: int = 500) -> DataFrame:
    """Rows of one SELECT or WITH statement over the session's views, all values as text (null: empty)."""
    text = re.sub(r"^(\s|--[^\n]*\n|/\*.*?\*/)*", "", sql, flags=re.S)
    if not re.match(r"(?i)(select|with)\b", text):
        raise ValueError("only SELECT and WITH are allowed")
    parsed = spark._jsparkSession.sessionState().sqlParser().parsePlan(text).toString()
    if re.search(r"(?m)^\W*'?(Insert|Create|Drop|Delete|Update|Merge|Set|Alter|Truncate|Replace)\w*", parsed):
        raise ValueError("only queries are allowed")
    if found := set(re.findall(FORBIDDEN, text)):
        raise ValueError(f"not allowed: {', '.join(sorted(found))}")
    # A relation in two parts may be a format and a path: only views of the session are read.
    views = {t.name.lower() for t in spark.catalog.listTables() if t.isTemporary}
    inner = {n.lower() for n in re.findall(r"(?i)[\w`]+(?=\s+as\s*\()", text)}
    for name in re.findall(r"'UnresolvedRelation \[([^\]]*)\]", parsed):
        if name.lower() not in views | {n.strip("`") for n in inner}:
            raise ValueError(f"no such view: {name}")
    found = spark.sql(text)
    return found.select(*(F.coalesce(F.when(F.lit(t == "binary"), F.lit("<blob>")).otherwise(F.col(f"`{c}`").cast("string")), F.lit("")).alias(c) for c, t in found.dtypes)).limit(limit)
