"""Evidence from languages with braces by their tokens: Rust, Go, Java, Kotlin, Swift, C, C++ and C#.

Only what the tokens tell for certain becomes evidence: definitions with a body, calls inside them, base types, typed
fields and locals, imports of names. Anything else is passed over.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

_TOKEN = re.compile(
    r"""(?P<skip>//[^\n]*|/\*.*?\*/|\#[ \t]*(?:include|define|pragma|if|ifdef|ifndef|endif|else|undef|region|endregion)[^\n]*)
    |(?P<text>\"\"\".*?\"\"\"|@?"(?:\\.|[^"\\\n])*"|`[^`]*`|'(?:\\.[^']*|[^'\\\n])')|(?P<word>[A-Za-z_][A-Za-z0-9_]*)|(?P<sign>::|->|=>|&&|\|\||\?\.|[^\sA-Za-z0-9_])""",
    re.S | re.X,
)
BRANCHES = ("if", "for", "while", "case", "catch", "when", "match", "guard", "&&", "||", "foreach")
KEYWORDS = frozenset(
    """if else for while do switch case return match when loop new throw throws try catch finally func fn fun def class struct enum interface trait protocol impl extension object
    import package use using namespace mod pub public private protected internal static final abstract override virtual const let var val mut ref in is as async await yield sizeof typeof
    defer go select range type where guard init deinit constructor super this self unsafe move dyn inline extern template typename operator delete default lock fixed checked assert""".split()
)

#: Words of these that are names where a keyword stands in front of functions.
PLAIN_NAMES = ("new", "default", "delete", "fixed", "checked", "get", "set")


@dataclass(frozen=True)
class Language:
    """How a language spells its definitions."""

    name: str
    function: str | None = None  # keyword in front of a function's name; None: a name, parameters and a body
    types: dict = field(default_factory=dict)  # keyword: label
    bases: tuple = (":",)  # what stands in front of base types
    typed_after: bool = False  # name: Type, and not Type name
    variables: tuple = ()  # keywords in front of a variable
    imports: str | None = None


JAVA_TYPES = {"class": "Class", "interface": "Interface", "enum": "Enum", "record": "Class"}
LANGUAGES = {
    "rs": Language("rust", "fn", {"struct": "Class", "enum": "Enum", "trait": "Interface", "impl": "impl"}, (), True, ("let",), "use"),
    "go": Language("go", "func", {"struct": "Class", "interface": "Interface"}, (), False, ("var",), "import"),
    "java": Language("java", None, JAVA_TYPES, ("extends", "implements"), False, (), "import"),
    "kt": Language("kotlin", "fun", {"class": "Class", "interface": "Interface", "object": "Class"}, (":",), True, ("val", "var"), "import"),
    "swift": Language("swift", "func", {"class": "Class", "struct": "Class", "enum": "Enum", "protocol": "Interface", "extension": "impl", "actor": "Class"}, (":",), True, ("let", "var"), "import"),
    "c": Language("c", None, {"struct": "Class", "enum": "Enum"}, (), False, (), None),
    "cpp": Language("cpp", None, {"class": "Class", "struct": "Class", "enum": "Enum", "namespace": "space"}, (":",), False, (), None),
    "cs": Language("csharp", None, {"class": "Class", "interface": "Interface", "struct": "Class", "enum": "Enum", "record": "Class", "namespace": "space"}, (":",), False, ("var",), "using"),
}
SAME = {"kts": "kt", "h": "cpp", "hpp": "cpp", "cc": "cpp", "cxx": "cpp", "hh": "cpp", "hxx": "cpp"}


def language_of(path: str) -> Language | None:
    extension = path.rsplit(".", 1)[-1].lower()
    return LANGUAGES.get(SAME.get(extension, extension))


class Reader:
    """One pass over the tokens of a file, with the definitions around the present place."""

    def __init__(self, language: Language, path: str, text: str, out: dict[str, list], file_id: str, name_id, receiver):
        self.language, self.path, self.out, self.file_id, self.name_id, self.receiver = language, path, out, file_id, name_id, receiver
        self.tokens = self.listed(text)
        self.scopes: list[dict] = []  # depth, id, label, name, node (its place among the nodes, or None)
        self.types: set[str] = set()

    @staticmethod
    def listed(text: str) -> list[tuple[str, str, int]]:
        """Kind, text and line of each token."""
        starts = [m.end() for m in re.finditer("\n", text)]
        found, line = [], 0
        for m in _TOKEN.finditer(text):
            while line < len(starts) and starts[line] <= m.start():
                line += 1
            if m.lastgroup != "skip":
                found.append((m.lastgroup, m[0], line + 1))
        return found

    def value(self, i: int) -> str:
        return self.tokens[i][1] if 0 <= i < len(self.tokens) else ""

    def word(self, i: int) -> bool:
        return 0 <= i < len(self.tokens) and self.tokens[i][0] == "word"

    def closing(self, i: int, opening: str = "(", end: str = ")") -> int:
        """Place of the sign that closes the one at i; the end of the file without one."""
        level = 0
        for j in range(i, len(self.tokens)):
            level += (self.value(j) == opening) - (self.value(j) == end)
            if level == 0:
                return j
        return len(self.tokens)

    def generic(self, i: int) -> int:
        """Behind type parameters that begin at i, if any do."""
        if self.value(i) != "<":
            return i
        j = self.closing(i, "<", ">")
        return j + 1 if j - i < 60 else i

    def inner(self, *labels: str) -> dict | None:
        return next((s for s in reversed(self.scopes) if s["label"] in labels), None)

    def opened(self, name: str, label: str, line: int, depth: int, bases=(), owner: str | None = None) -> None:
        if label in ("impl", "space"):
            own = None if label == "space" else next((n[0] for n in self.out["nodes"] if n[1] == name and n[2] in ("Class", "Enum", "Interface")), self.name_id(name))
            self.scopes.append({"depth": depth, "id": own, "label": label, "name": name, "node": None})
        else:
            own = f"{owner}.{name.lower()}" if owner else self.name_id(*(s["name"] for s in self.scopes if s["label"] != "space"), name)
            self.out["nodes"].append([own, name, label, self.language.name, self.path, line, line, 1 if label in ("Function", "Method") else None, None])
            self.scopes.append({"depth": depth, "id": own, "label": label, "name": name, "node": len(self.out["nodes"]) - 1})
        for base, kind in bases:
            self.out["inherits"].append((name, base, kind, self.path))

    def read(self) -> None:
        lang, out = self.language, self.out
        depth, i = 0, 0
        pending: tuple | None = None  # name, label, line, bases, owner
        while i < len(self.tokens):
            kind, word, line = self.tokens[i]
            if word == "{":
                depth += 1
                if pending:
                    self.opened(*pending[:3], depth, *pending[3:])
                pending = None
            elif word == "}":
                if self.scopes and self.scopes[-1]["depth"] == depth:
                    closed = self.scopes.pop()
                    if closed["node"] is not None:
                        out["nodes"][closed["node"]][6] = line
                depth -= 1
            elif word == ";" and pending and pending[1] not in ("Function", "Method"):
                pending = None
            elif word in BRANCHES and (f := self.inner("Function", "Method")) and f["node"] is not None:
                out["nodes"][f["node"]][7] += 1
            if kind != "word":
                i += 1
                continue
            if word == lang.imports and not self.scopes:
                i = self.imported(i)
                continue
            if lang.name == "go" and word == "type" and self.word(i + 1) and self.value(i + 2) in lang.types:
                pending = (self.value(i + 1), lang.types[self.value(i + 2)], line)
                i += 3
                continue
            if lang.name != "go" and word in lang.types and (self.word(i + 1) or word == "impl") and self.value(i - 1) not in (".", "::"):
                found = self.type_head(i)
                if found:
                    pending, i = found
                    continue
            if lang.function and word == lang.function:
                found = self.function_head(i)
                if found:
                    pending, i = found
                    continue
            elif lang.function is None and self.value(i + 1) == "(" and word not in KEYWORDS and not self.inner("Function", "Method"):
                found = self.plain_function(i)
                if found:
                    pending, i = found
                    continue
            self.use(i)
            i += 1
        out["type_refs"] += sorted((self.path, t) for t in self.types)

    def bases_of(self, i: int) -> tuple[list, int]:
        """Base types from the head of a type at i to its body."""
        found, kind, j = [], None, i
        while j < len(self.tokens) and self.value(j) not in ("{", ";"):
            v = self.value(j)
            if v == "(":
                j = self.closing(j)
            elif v == "<":
                j = self.generic(j) - 1 if self.generic(j) > j else j
            elif v in self.language.bases:
                kind = "Implements" if v == "implements" else "Extends"
            elif kind and self.word(j) and v not in KEYWORDS and self.value(j + 1) not in (".", "::"):
                found.append((v, kind))
            elif v == "where":
                kind = None
            j += 1
        return found, j

    def type_head(self, i: int):
        label = self.language.types[self.value(i)]
        j = self.generic(i + 1)
        if not self.word(j):
            return None
        name, line = self.value(j), self.tokens[i][2]
        if label == "impl" and self.language.name == "rust":
            end = next((k for k in range(j, min(j + 80, len(self.tokens))) if self.value(k) in ("{", ";", "where")), None)
            if end is None:
                return None
            names = [k for k in range(j, end) if self.value(k) == "for"]
            plain = lambda a, b: next((self.value(k) for k in range(a, b) if self.word(k) and self.value(k + 1) != "::" and self.value(k) not in KEYWORDS), None)
            if names:
                trait, own = plain(j, names[0]), plain(names[0] + 1, end)
                bases = [(trait, "Implements")] if trait else []
            else:
                own, bases = plain(j, end), []
            while end < len(self.tokens) and self.value(end) not in ("{", ";"):
                end += 1
            return ((own, "impl", line, bases), end) if own else None
        if label == "space":
            while self.value(j + 1) in (".", "::"):
                j += 2
            return ((name, "space", line), j + 1) if self.value(j + 1) == "{" else None
        bases, end = self.bases_of(j + 1)
        if self.value(end) != "{":
            return None
        if self.language.typed_after and self.value(self.generic(j + 1)) == "(":  # properties of a constructor
            self.parameters(self.generic(j + 1), self.name_id(*(s["name"] for s in self.scopes if s["label"] != "space"), name))
        return (name, label, line, bases), end

    def parameters(self, i: int, owner: str) -> None:
        end = self.closing(i)
        for j in range(i, end):
            if self.value(j) in self.language.variables and self.word(j + 1) and self.value(j + 2) == ":" and self.word(j + 3):
                self.out["fields"].append((owner, self.value(j + 1), self.value(j + 3), self.path))

    def function_head(self, i: int):
        line, j, owner, label = self.tokens[i][2], i + 1, None, None
        if self.language.name == "go" and self.value(j) == "(":
            end = self.closing(j)
            named = [self.value(k) for k in range(j, end) if self.word(k)]
            j, label = end + 1, "Method"
            if named:
                owner = next((n[0] for n in self.out["nodes"] if n[1] == named[-1] and n[2] in ("Class", "Interface")), self.name_id(named[-1]))
        j = self.generic(j)
        if not self.word(j):
            return None
        name = self.value(j)
        while self.value(j + 1) == "." and self.word(j + 2):  # an extension function: the last part is its name
            j, name = j + 2, self.value(j + 2)
        start = self.generic(j + 1)
        if self.value(start) != "(":
            return None
        end = self.closing(start) + 1
        while end < len(self.tokens) and self.value(end) not in ("{", ";", "}", "=") and not (self.value(end) == self.language.function):
            end += 1
        label = label or ("Method" if self.scopes and self.scopes[-1]["label"] in ("Class", "Interface", "Enum", "impl") else "Function")
        if owner is None and self.scopes and self.scopes[-1]["label"] == "impl":
            owner = self.scopes[-1]["id"]
        return ((name, label, line, (), owner), end) if self.value(end) == "{" else (None, end)

    def plain_function(self, i: int):
        """Type name(parameters) ... {, or a constructor, which has its class's name."""
        around = self.scopes[-1] if self.scopes else None
        in_type = around is not None and around["label"] in ("Class", "Interface", "Enum")
        if around is not None and not in_type and around["label"] != "space":
            return None
        before = self.value(i - 1)
        constructor = in_type and self.value(i) == around["name"]
        typed = (self.word(i - 1) and before not in ("return", "new", "else", "throw", "case")) or before in ("*", "&", ">", "]", "?")
        qualified = before == "::" and self.word(i - 2)
        if not (constructor or typed or qualified):
            return None
        j = self.closing(i + 1) + 1
        while j < len(self.tokens) and self.value(j) not in ("{", ";", "}", "="):
            j += 1
        if self.value(j) != "{":
            return None
        owner = self.name_id(self.value(i - 2)) if qualified else None
        return (self.value(i), "Method" if in_type or qualified else "Function", self.tokens[i][2], (), owner), j

    def imported(self, i: int) -> int:
        """Names that an import brings, with the module they come from."""
        lang, path = self.language.name, self.path
        if lang == "go":
            stop = self.closing(i + 1) if self.value(i + 1) == "(" else i + 3
            for j in range(i + 1, min(stop, len(self.tokens))):
                if self.tokens[j][0] == "text":
                    module = self.value(j)[1:-1]
                    named = self.word(j - 1) and self.value(j - 1) != "import"
                    self.out["imports"].append((path, self.value(j - 1) if named else module.rsplit("/", 1)[-1], module))
            return stop + 1 if self.value(i + 1) == "(" else next((j for j in range(i + 1, min(i + 4, len(self.tokens))) if self.tokens[j][0] == "text"), i) + 1
        line, j, parts = self.tokens[i][2], i + 1, []
        while j < len(self.tokens) and self.value(j) not in (";", "{", "}", "=") and (lang in ("rust", "java", "csharp") or self.tokens[j][2] == line):
            parts.append(self.value(j))
            j += 1
        names = [p for p in parts if re.match(r"[A-Za-z_]", p) and p not in ("static", "as", "pub", "self", "func", "class", "struct")]
        if lang == "rust" and self.value(j) == "{":
            end = self.closing(j, "{", "}")
            module = "::".join(names)
            for k in range(j + 1, end):
                if self.word(k) and self.value(k + 1) in (",", "}") and self.value(k) != "self":
                    self.out["imports"].append((path, self.value(k), module))
            return end + 1
        if names and lang != "csharp" and "*" not in parts:
            name = names[-1]
            source = [n for n in names if n != name] if "as" in parts else names
            self.out["imports"].append((path, name, (("::" if lang == "rust" else ".").join(source)) or name))
        return j

    def use(self, i: int) -> None:
        """A call, a typed local or field, or a type that is named."""
        word, line = self.value(i), self.tokens[i][2]
        function = self.inner("Function", "Method")
        cls = self.inner("Class", "Interface", "Enum", "impl")
        if word[0].isupper() and word not in KEYWORDS:
            self.types.add(word)
        lang = self.language
        in_type = bool(self.scopes) and self.scopes[-1]["label"] in ("Class", "Interface")
        if word in lang.variables and self.word(i + 1):
            j = i + 2 if self.value(i + 1) == "mut" else i + 1
            typed = ""
            if lang.typed_after and self.value(j + 1) == ":" and self.word(j + 2):
                typed = self.value(j + 2)
            elif self.value(j + 1) == "=":
                k = j + 2 + (self.value(j + 2) in ("new", "await"))
                if self.word(k) and self.value(k)[0].isupper() and self.value(self.generic(k + 1)) in ("(", "::", "{"):
                    typed = self.value(k)
            if function:
                self.out["locals"].append((function["id"], self.value(j), typed, self.path))
            elif in_type and typed:
                self.out["fields"].append((self.scopes[-1]["id"], self.value(j), typed, self.path))
        elif in_type and lang.name in ("rust",) and self.value(i + 1) == ":" and self.word(i + 2) and word not in KEYWORDS:
            self.out["fields"].append((self.scopes[-1]["id"], word, self.value(i + 2), self.path))
        elif in_type and lang.name == "go" and self.word(i + 1) and self.tokens[i + 1][2] == line and (i == 0 or self.tokens[i - 1][2] < line):
            self.out["fields"].append((self.scopes[-1]["id"], word, self.value(i + 1), self.path))
        elif lang.name in ("java", "csharp", "cpp", "c") and word not in KEYWORDS and self.word(i + 1) and self.value(i + 1) not in KEYWORDS and self.value(i + 2) in (";", "=") and self.value(i - 1) not in (".", "::", "->"):
            if in_type:
                self.out["fields"].append((self.scopes[-1]["id"], self.value(i + 1), word, self.path))
            elif function:
                self.out["locals"].append((function["id"], self.value(i + 1), word if word[0].isupper() else "", self.path))
        after = self.generic(i + 2 if self.value(i + 1) == "::" and self.value(i + 2) == "<" else i + 1)
        plain = word not in KEYWORDS or (word in PLAIN_NAMES and lang.function is not None)
        if function and self.value(after) == "(" and plain and self.value(i - 1) not in ("new", lang.function):
            owner, j = [], i
            while self.value(j - 1) in (".", "::", "->", "?.") and self.word(j - 2):
                owner.insert(0, self.value(j - 2))
                j -= 2
            if self.value(j - 1) in (".", "?.", "->", "::"):
                receiver = ("Named", "?")
            else:
                receiver = self.receiver(".".join(owner)) if owner else ("Bare", None)
                if owner == ["Self"]:
                    receiver = ("SelfThis", None)
            self.out["calls"].append((function["id"], word, line, self.path, receiver, cls["id"] if cls else None))


def read(path: str, text: str, out: dict[str, list], file_id: str, name_id, receiver) -> str | None:
    """Add the evidence of a file to out; its language, or None where it is not one of these."""
    language = language_of(path)
    if language is not None:
        Reader(language, path, text, out, file_id, name_id, receiver).read()
    return language.name if language else None
