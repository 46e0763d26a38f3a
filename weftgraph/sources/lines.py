"""Evidence from Ruby and shell scripts by their lines: a definition ends at the closing line of its own indentation."""

from __future__ import annotations

import re

RUBY_HEAD = re.compile(r"^(\s*)(class|module|def)\s+(?:self\.)?([A-Za-z_][\w:]*[?!=]?)(?:\s*<\s*([A-Z][\w:]*))?")
RUBY_CALL = re.compile(r"(?:([A-Za-z_@][\w.@]*)(?:\.|::|&\.))?\b([a-z_]\w*[?!]?)\(")
RUBY_WORDS = frozenset("if unless while until case when return puts yield and or not super defined? raise require require_relative".split())
RUBY_BRANCH = re.compile(r"\b(?:if|unless|while|until|when|rescue)\b|&&|\|\|")
SHELL_HEAD = re.compile(r"^(\s*)(?:function\s+([A-Za-z_][\w-]*)\s*(?:\(\))?|([A-Za-z_][\w-]*)\s*\(\))\s*\{?\s*$")
#: A word where a command stands; words that lead in one count as its beginning.
SHELL_CALL = re.compile(r"(?:^|[;&|(])(?:\s*(?:then|do|else|if|elif|while|until|!)\s)*\s*([A-Za-z_][\w-]*)(?=[\s;)|&]|$)(?!\s*=|\s*\(\))")
SHELL_WORDS = frozenset("if then else elif fi for while until do done case esac in function return local export echo printf read set unset shift exit cd test true false eval exec source trap declare readonly time".split())
SHELL_BRANCH = re.compile(r"\b(?:if|elif|while|until|for)\b|&&|\|\|")


def _plain(line: str) -> str:
    """The line without its strings and comment."""
    return re.sub(r"#.*", "", re.sub(r"\"(?:\\.|[^\"\\])*\"|'[^']*'", '""', line))


def read(path: str, text: str, out: dict[str, list], file_id: str, name_id, receiver) -> str | None:
    """Add the evidence of a file to out; its language, or None where it is not one of these."""
    if path.endswith(".rb"):
        language, head, call, words, branch, closing = "ruby", RUBY_HEAD, RUBY_CALL, RUBY_WORDS, RUBY_BRANCH, "end"
    elif re.search(r"\.(sh|bash)$", path):
        language, head, call, words, branch, closing = "bash", SHELL_HEAD, SHELL_CALL, SHELL_WORDS, SHELL_BRANCH, "}"
    else:
        return None
    scopes: list[tuple[int, str, str, list]] = []  # indentation, name, label, node
    for number, line in enumerate(text.split("\n"), 1):
        plain, indent = _plain(line), len(line) - len(line.lstrip())
        if plain.strip() == closing:
            while scopes and scopes[-1][0] > indent:
                scopes.pop()
            if scopes and scopes[-1][0] == indent:
                scopes.pop()[3][6] = number
                continue
        if language == "ruby" and (m := re.match(r"\s*require(?:_relative)?\s+['\"]([^'\"]+)", line)):
            out["imports"].append((path, m[1].rsplit("/", 1)[-1], m[1]))
        found = head.match(line)
        if found:
            name = found[3] or found[2] if language == "bash" else found[3]
            kind = found[2] if language == "ruby" else "def"
            inside = any(s[2] == "Class" for s in scopes)
            label = "Class" if kind in ("class", "module") else "Method" if inside else "Function"
            node = [name_id(*(s[1] for s in scopes), name), name, label, language, path, number, number, None if label == "Class" else 1, None]
            out["nodes"].append(node)
            if language == "ruby" and found[4]:
                out["inherits"].append((name, found[4].rsplit("::", 1)[-1], "Extends", path))
            if not re.search(r"\bend\s*$|^\s*def\s+[\w.?!]+\s*(?:\([^)]*\))?\s*=\s", plain):
                scopes.append((indent, name, label, node))
            continue
        function = next((s for s in reversed(scopes) if s[2] != "Class"), None)
        if function is None:
            continue
        function[3][7] += len(branch.findall(plain))
        cls = next((s[3][0] for s in reversed(scopes) if s[2] == "Class"), None)
        for m in call.finditer(plain):
            owner, name = (m[1], m[2]) if language == "ruby" else (None, m[1])
            if name in words:
                continue
            if owner and owner.startswith("@") and "." not in owner:
                kind = ("Field", owner.lstrip("@"))
            else:
                kind = receiver(owner)
            out["calls"].append((function[3][0], name, number, path, kind, cls))
    return language
