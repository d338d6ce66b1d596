"""Source parsers: (source, path) to symbols, imports, calls and a count of syntax errors.

Python goes through the standard ``ast``, and through the lexical parser where that fails. The other eight languages are
read by one tokenizer and one scope tracker, driven by a ``Lang`` description. Parsers never raise: what they can't make
out is counted. ``parse_files`` runs them over a table of files in Arrow batches.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Languages by file extension.
EXTENSIONS = {"py": "python", "js": "javascript", "jsx": "javascript", "ts": "typescript", "tsx": "typescript", "go": "go", "java": "java", "rs": "rust", "cs": "csharp", "rb": "ruby", "php": "php"}
RESULT = (
    "path string, language string, symbols array<struct<name: string, qualified_name: string, kind: string, line_start: int, line_end: int, is_exported: boolean, decorators: array<string>, signature: string>>, "
    "imports array<struct<imported_name: string, module_path: string, line: int, is_external: boolean, original_name: string>>, calls array<struct<caller_name: string, callee_name: string, line: int>>, syntax_error_count int"
)


@dataclass
class Parsed:
    symbols: list[dict] = field(default_factory=list)
    imports: list[dict] = field(default_factory=list)
    calls: list[dict] = field(default_factory=list)
    errors: int = 0

    def symbol(self, name: str, qualified: str, kind: str, start: int, end: int, exported: bool, signature: str, decorators: list[str] | None = None) -> dict:
        s = {"name": name, "qualified_name": qualified, "kind": kind, "line_start": start, "line_end": end, "is_exported": exported, "decorators": decorators or [], "signature": signature}
        self.symbols.append(s)
        return s

    def imported(self, name: str, module: str, line: int, external: bool, original: str | None = None) -> None:
        self.imports.append({"imported_name": name, "module_path": module, "line": line, "is_external": external, "original_name": original})

    def call(self, caller: str, callee: str, line: int) -> None:
        self.calls.append({"caller_name": caller, "callee_name": callee, "line": line})


# --- Python ----------------------------------------------------------------------------------------------------------


class _PythonVisitor(ast.NodeVisitor):
    def __init__(self, source: str):
        self.out, self.lines, self.stack = Parsed(), source.splitlines(), []

    def _line(self, n: int) -> str:
        return self.lines[n - 1].strip() if 0 < n <= len(self.lines) else ""

    def _define(self, node, name: str, kind: str) -> None:
        top = not self.stack
        qualified = ".".join([*(s for s, _ in self.stack), name])
        marks = [ast.unparse(d) for d in getattr(node, "decorator_list", [])]
        self.out.symbol(name, qualified, kind, node.lineno, node.end_lineno or node.lineno, top and not name.startswith("_"), self._line(node.lineno), marks)
        self.stack.append((name, kind))
        for child in ast.iter_child_nodes(node):
            self.visit(child)
        self.stack.pop()

    def visit_FunctionDef(self, node):  # noqa: N802
        self._define(node, node.name, "method" if self.stack else "function")

    visit_AsyncFunctionDef = visit_FunctionDef  # noqa: N815

    def visit_ClassDef(self, node):  # noqa: N802
        self._define(node, node.name, "class")

    def visit_Lambda(self, node):  # noqa: N802
        self._define(node, f"lambda_line_{node.lineno}", "function")

    def visit_Assign(self, node):  # noqa: N802
        if not self.stack:
            for t in node.targets:
                if isinstance(t, ast.Name):
                    self.out.symbol(t.id, t.id, "constant" if t.id.isupper() else "variable", node.lineno, node.end_lineno or node.lineno, not t.id.startswith("_"), self._line(node.lineno))
        self.generic_visit(node)

    def visit_Import(self, node):  # noqa: N802
        for a in node.names:
            self.out.imported(a.name, a.name, node.lineno, True)

    def visit_ImportFrom(self, node):  # noqa: N802
        module = "." * node.level + (node.module or "")
        for a in node.names:
            self.out.imported(a.name, module, node.lineno, not node.level)

    def visit_Call(self, node):  # noqa: N802
        """Only the callee is followed, in a loop: chains of calls may be long. A call among another's arguments is not
        recorded."""
        while isinstance(node, ast.Call | ast.Attribute):
            if isinstance(node, ast.Attribute):
                node = node.value
                continue
            callee = self.written(node.func)
            if callee and "\n" not in callee:
                self.out.call(".".join(s for s, _ in self.stack) or "<module>", callee, node.lineno)
            node = node.func
        self.visit(node)

    def written(self, node) -> str:
        try:
            return ast.unparse(node)
        except RecursionError:  # as it stands in the source, if on one line
            if node.lineno != node.end_lineno:
                return ""
            return self.lines[node.lineno - 1].encode()[node.col_offset : node.end_col_offset].decode("utf-8", "replace")


def parse_python(source: str, path: str) -> Parsed:
    """What can't be parsed, or nests too deep to be walked, is read line by line and counts as one error."""
    try:
        visitor = _PythonVisitor(source)
        visitor.visit(ast.parse(source))
        return visitor.out
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        out = Parsed(errors=1)
        for i, line in enumerate(source.splitlines(), 1):
            if m := re.match(r"(\s*)(?:async\s+)?(def|class)\s+(\w+)", line):
                kind = "class" if m[2] == "class" else "method" if m[1] else "function"
                out.symbol(m[3], m[3], kind, i, i, not m[1] and not m[3].startswith("_"), line.strip())
        return out


# --- brace languages and Ruby ----------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Lang:
    name: str
    separator: str
    #: keyword -> kind of the symbol it defines; a kind of "scope" only qualifies names
    defines: dict[str, str]
    line_comment: str = r"//"
    strings: str = r"\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'"
    #: the visibility keyword that exports; None: see ``exported``
    public: str | None = None
    #: callees keep their dots
    dotted: bool = False
    keywords: frozenset = frozenset()


_CONTROL = "if for while switch catch return else do try new in of typeof await yield throw match loop unsafe move delete void sizeof using lock foreach elseif case default where select go defer range function fn func def class super"
_KEYS = frozenset(_CONTROL.split())
LANGS = {
    "javascript": Lang("javascript", ".", {"function": "function", "class": "class"}, strings=r"\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`", dotted=True),
    "typescript": Lang("typescript", ".", {"function": "function", "class": "class", "interface": "interface", "type": "type_alias", "enum": "enum"}, strings=r"\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`", dotted=True),
    "go": Lang("go", ".", {"func": "function", "type": "class", "const": "constant", "var": "variable"}, strings=r"\"(?:\\.|[^\"\\\n])*\"|`[^`]*`|'(?:\\.|[^'\\\n])*'", dotted=True),
    "java": Lang("java", ".", {"class": "class", "interface": "interface", "enum": "enum", "record": "class"}, public="public"),
    "csharp": Lang("csharp", ".", {"class": "class", "interface": "interface", "enum": "enum", "struct": "class", "record": "class", "namespace": "scope"}, public="public", dotted=True),
    "rust": Lang("rust", "::", {"fn": "function", "struct": "class", "enum": "enum", "trait": "trait", "const": "constant", "static": "constant", "type": "type_alias", "mod": "scope", "impl": "scope"}, strings=r"b?r#*\"(?:[^\"])*\"#*|b?\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])'", public="pub"),
    "php": Lang("php", "\\", {"function": "function", "class": "class", "interface": "interface", "trait": "trait", "enum": "enum"}, line_comment=r"//|\#(?!\[)"),
    "ruby": Lang("ruby", "::", {"def": "method", "class": "class", "module": "module"}, line_comment=r"\#"),
}


def lex(source: str, lang: Lang) -> list[tuple[str, int, str]]:
    """(text, line, kind) of the tokens, comments left out; kinds are id, str, num and op."""
    block = r"/\*.*?(?:\*/|\Z)" if lang.name != "ruby" else r"(?m:^=begin.*?^=end)"
    token = re.compile(
        rf"(?P<skip>{block}|(?:{lang.line_comment})[^\n]*|[ \t\r\f\v]+)|(?P<nl>\n)|(?P<str>{lang.strings})|(?P<id>[$@]*[A-Za-z_\u0080-\uffff][\w$]*[?!]?(?=\s*\(|\b|[^=]))|(?P<num>\d[\w.]*)|(?P<op>=>|->|::|\.\.\.|.)", re.S
    )
    out, line = [], 1
    for m in token.finditer(source):
        kind = m.lastgroup
        if kind in ("str", "id", "num", "op"):
            text = m[0]
            if kind == "id" and text[-1] in "?!" and lang.name not in ("ruby", "rust"):
                out += [(text[:-1], line, "id"), (text[-1], line, "op")]
            else:
                out.append((text, line, kind))
        elif kind == "nl" and lang.name == "ruby":
            out.append(("\n", line, "op"))
        line += m[0].count("\n")
    return out


@dataclass
class _Scope:
    kind: str
    name: str
    symbol: dict | None
    depth: int


class _Reader:
    """Walks the tokens of one file; scopes open at braces (or at Ruby's keywords) and name what they hold."""

    def __init__(self, source: str, lang: Lang):
        self.lang, self.out, self.lines = lang, Parsed(), source.splitlines()
        self.t = lex(source, lang)
        self.scopes: list[_Scope] = []
        self.pending: tuple[str, str, dict | None] | None = None
        self.depth, self.marks, self.exports = 0, [], set()

    def text(self, i: int) -> str:
        return self.t[i][0] if 0 <= i < len(self.t) else ""

    def close(self, i: int, a: str = "(", b: str = ")") -> int:
        """The place of the bracket that closes the one at i."""
        n = 0
        while i < len(self.t):
            n += (self.t[i][0] == a) - (self.t[i][0] == b)
            if n == 0:
                return i
            i += 1
        return len(self.t)

    def qualified(self, name: str) -> str:
        return self.lang.separator.join([*(s.name for s in self.scopes if s.name), name])

    def owner(self) -> _Scope | None:
        return next((s for s in reversed(self.scopes) if s.kind in ("class", "scope", "interface", "trait", "enum", "module")), None)

    def caller(self) -> str:
        inside = [s for s in self.scopes if s.kind in ("function", "method")]
        if not inside:
            return "<package>" if self.lang.name == "go" else "<module>"
        return inside[-1].symbol["qualified_name"]

    def prefix(self, i: int) -> list[str]:
        """The words before a definition, back to the last statement."""
        out, k = [], i - 1
        while k >= 0 and self.t[k][0] not in ("{", "}", ";", "\n") and (self.t[k][2] == "id" or self.t[k][0] in (")", "(", "]")):
            out.append(self.t[k][0])
            k -= 1
        return out

    def exported(self, name: str, before: list[str]) -> bool:
        kind = self.lang.name
        if kind == "go":
            return name[:1].isupper()
        if kind in ("ruby", "php"):
            return True
        if kind in ("javascript", "typescript"):
            return "export" in before
        return self.lang.public in before

    def define(self, name: str, kind: str, i: int, before: list[str], opens: bool = True, qualified: str | None = None) -> None:
        line = self.t[i][1]
        signature = self.lines[line - 1].strip() if line <= len(self.lines) else ""
        s = self.out.symbol(name, qualified or self.qualified(name), kind, line, line, self.exported(name, before), signature, self.marks)
        self.marks = []
        if opens:
            self.pending = (kind, name, s)

    def read(self) -> Parsed:
        i, n = 0, len(self.t)
        if self.lang.name in ("javascript", "typescript"):
            self.out.symbol("<module>", "<module>", "module", 0, 0, False, "")
        while i < n:
            i = max(i + 1, self.step(i))
        while self.scopes:
            self.pop(self.t[-1][1] if self.t else 0)
            self.out.errors += self.lang.name != "ruby"
        for s in self.out.symbols:
            if s["name"] in self.exports:
                s["is_exported"] = True
        return self.out

    def pop(self, line: int) -> None:
        s = self.scopes.pop()
        if s.symbol is not None:
            s.symbol["line_end"] = line

    def step(self, i: int) -> int:
        text, line, kind = self.t[i]
        if self.lang.name == "ruby":
            return self.ruby(i)
        if text == "{":
            self.depth += 1
            if self.pending:
                k, name, s = self.pending
                self.scopes.append(_Scope(k, name, s, self.depth))
                self.pending = None
            return i + 1
        if text == "}":
            if self.scopes and self.scopes[-1].depth == self.depth:
                self.pop(line)
            self.depth -= 1
            if self.depth < 0:
                self.depth, self.out.errors = 0, self.out.errors + 1
            return i + 1
        if text == ";" and self.pending:
            self.pending = None
            return i + 1
        if kind == "op" and text == "#" and self.text(i + 1) == "[" and self.lang.name == "rust":
            end = self.close(i + 1, "[", "]")
            words = [self.text(k) for k in range(i + 2, end)]
            self.marks += ["test"] if words[:1] == ["test"] else []
            return end + 1
        if kind != "id":
            return i + 1
        before = self.text(i - 1)
        if text in ("import", "use", "using", "require", "export", "from", "module", "exports") and before != ".":
            end = self.imports(i)
            if end:
                return end
        if text in self.lang.defines and before not in (".", "->", "::") and self.t[i + 1 : i + 2]:
            end = self.definition(i)
            if end:
                return end
        if text in ("const", "let", "var") and self.lang.name in ("javascript", "typescript") and self.t[i + 1 : i + 2] and self.t[i + 1][2] == "id":
            return self.binding(i)
        return self.use(i)

    def definition(self, i: int) -> int:
        text, before, lang = self.t[i][0], self.prefix(i), self.lang.name
        kind = self.lang.defines[text]
        j = i + 1
        if lang == "rust" and text == "impl":
            words = []
            while j < len(self.t) and self.t[j][0] not in ("{", ";"):
                if self.t[j][0] == "<":
                    j = self.close(j, "<", ">")
                elif self.t[j][2] == "id":
                    words.append(self.t[j][0])
                j += 1
            named = words[words.index("for") + 1 :] if "for" in words else words
            self.pending = ("scope", named[0] if named else "", None)
            self.trait_impl = "for" in words
            return j
        if lang == "go" and text == "func" and self.text(j) == "(":
            end = self.close(j)
            kinds = [self.text(k) for k in range(j + 1, end) if self.t[k][2] == "id"]
            name = self.text(end + 1)
            if self.t[end + 1 : end + 2] and self.t[end + 1][2] == "id":
                owner = kinds[-1] if kinds else ""
                self.define(name, "method", end + 1, before, qualified=f"{owner}.{name}" if owner else name)
                return end + 2
            return 0
        if self.t[j][2] != "id":
            if lang == "go" and text in ("const", "var") and self.text(j) == "(":
                end = self.close(j)
                last = 0
                for k in range(j + 1, end):
                    if self.t[k][2] == "id" and self.t[k][1] != last:
                        last = self.t[k][1]
                        self.define(self.t[k][0], kind, k, before, opens=False)
                return end
            return 0
        name = self.text(j)
        if kind == "scope":
            full = name
            while self.text(j + 1) in (".", "\\", "::"):
                full += self.text(j + 1) + self.text(j + 2)
                j += 2
            if lang != "csharp":
                self.pending = ("scope", full, None)
            return j + 1
        if lang == "typescript" and text == "type" and self.text(j + 1) not in ("=", "<"):
            return 0
        if lang == "rust" and text == "const" and self.text(j + 1) not in (":",):
            return 0
        if lang == "go" and text == "type":
            nxt = self.text(j + 1)
            kind = {"struct": "class", "interface": "interface"}.get(nxt, "type_alias")
            self.define(name, kind, j, before, opens=nxt in ("struct", "interface"))
            return j + 2
        if kind == "function" and self.owner() is not None and not any(s.kind in ("function", "method") for s in self.scopes):
            kind = "method"
        if lang == "rust" and kind == "method" and getattr(self, "trait_impl", False) and self.owner() and self.owner().symbol is None:
            self.marks.append("trait_impl")
        opens = kind not in ("constant", "variable", "type_alias")
        self.define(name, kind, j, before, opens=opens)
        end = j + 1
        if kind in ("function", "method"):
            while end < len(self.t) and self.t[end][0] not in ("(", "{", ";"):
                end += 1
            if self.text(end) == "(":
                end = self.close(end) + 1
        return end

    def binding(self, i: int) -> int:
        """const name = ...: a function for arrows and function expressions, else a variable at the top."""
        name, j, before = self.text(i + 1), i + 2, self.prefix(i)
        while j < len(self.t) and self.t[j][0] not in ("=", ";", "{", "}", "\n"):
            j += 1
        if self.text(j) != "=":
            return i + 2
        k = j + 1
        if self.text(k) == "async":
            k += 1
        arrow = self.text(k) == "function" or (self.text(k) == "(" and self._arrow(self.close(k) + 1)) or (self.t[k : k + 1] and self.t[k][2] == "id" and self.text(k + 1) == "=>")
        if arrow:
            self.define(name, "function", i + 1, before)
            if self.text(k) == "(":
                k = self.close(k) + 1
            while k < len(self.t) and self.t[k][0] not in ("=>", "{"):
                k += 1
            if self.text(k) == "=>" and self.text(k + 1) != "{":
                return self.expression(k + 1)
            return k + 1 if self.text(k) == "=>" else k
        if not any(s.kind in ("function", "method") for s in self.scopes):
            if self.text(k) == "require":
                module = self.text(k + 2).strip("\"'`")
                self.out.imported(name, module, self.t[i][1], not module.startswith((".", "/")))
                return k + 4
            self.define(name, "constant" if name.isupper() else "variable", i + 1, before, opens=False)
        return j + 1

    def expression(self, i: int) -> int:
        """Reads the expression body of the pending arrow function, up to its end."""
        kind, name, s = self.pending
        self.pending, end, depth = None, i, 0
        while end < len(self.t):
            text, line, _ = self.t[end]
            if not depth and (text in (";", ",") or (end > i and line > self.t[end - 1][1] and text[0] not in ".?&|+:(" and self.text(end - 1) not in ("(", "=>", "&&", "+"))):
                break
            depth += (text in ("(", "[", "{")) - (text in (")", "]", "}"))
            if depth < 0:
                break
            end += 1
        self.scopes.append(_Scope(kind, name, s, -1))
        j = i
        while j < end:
            j = max(j + 1, self.step(j))
        self.pop(self.t[min(end, len(self.t)) - 1][1])
        return end

    def _arrow(self, k: int) -> bool:
        if self.text(k) == ":":
            while k < len(self.t) and self.t[k][0] not in ("=>", "{", ";", "="):
                k += 1
        return self.text(k) == "=>"

    def imports(self, i: int) -> int:
        text, line, lang = self.t[i][0], self.t[i][1], self.lang.name
        if lang in ("javascript", "typescript"):
            if text == "import" and self.text(i + 1) not in ("(", "."):
                j, names, star = i + 1, [], ""
                while j < len(self.t) and self.t[j][2] != "str" and self.t[j][0] != ";":
                    if self.t[j][2] == "id" and self.t[j][0] not in ("from", "type", "as"):
                        if self.text(j - 1) == "as":
                            if star == "*" or not names:
                                names.append((self.t[j][0], None))
                            else:
                                names[-1] = (self.t[j][0], names[-1][0])
                            star = ""
                        else:
                            names.append((self.t[j][0], None))
                    star = "*" if self.t[j][0] == "*" else star
                    j += 1
                module = self.text(j).strip("\"'`")
                for name, original in names or [(module, None)]:
                    self.out.imported(name, module, line, not module.startswith((".", "/")), original)
                return j + 1
            if text == "require" and self.text(i + 1) == "(" and self.text(i - 1) == "=":
                module = self.text(i + 2).strip("\"'`")
                k, names = i - 2, []
                if self.text(k) == "}":
                    while k >= 0 and self.text(k) != "{":
                        names += [self.text(k)] if self.t[k][2] == "id" else []
                        k -= 1
                for name in reversed(names):
                    self.out.imported(name, module, line, not module.startswith((".", "/")))
                return i + 4
            if text == "export":
                if self.text(i + 1) in ("{", "*"):
                    end = self.close(i + 1, "{", "}") if self.text(i + 1) == "{" else i + 1
                    names = [self.text(k) for k in range(i + 2, end) if self.t[k][2] == "id"]
                    if self.text(end + 1) == "from":
                        module = self.text(end + 2).strip("\"'`")
                        for name in names or ["*"]:
                            self.out.imported(name, module, line, not module.startswith((".", "/")))
                        return end + 3
                    self.exports.update(names)
                    return end + 1
                if self.text(i + 1) == "default" and self.t[i + 2 : i + 3] and self.t[i + 2][2] == "id" and self.text(i + 2) not in ("function", "class", "async"):
                    self.exports.add(self.text(i + 2))
                return 0
            if text in ("module", "exports"):
                j = i + 2 if text == "module" else i
                if self.text(j) != "exports":
                    return 0
                if self.text(j + 1) == "=" and self.text(j + 2) == "{":
                    end = self.close(j + 2, "{", "}")
                    self.exports.update(self.text(k) for k in range(j + 3, end) if self.t[k][2] == "id")
                    return end + 1
                if self.text(j + 1) == "=":
                    self.exports.add(self.text(j + 2))
                if self.text(j + 1) == ".":
                    self.exports.add(self.text(j + 2))
                    return j + 3
            return 0
        if lang == "go" and text == "import":
            end = self.close(i + 1) if self.text(i + 1) == "(" else i + 1
            for k in range(i + 1, end + 1):
                if self.t[k : k + 1] and self.t[k][2] == "str":
                    module = self.t[k][0].strip('"`')
                    self.out.imported(module.rsplit("/", 1)[-1], module, self.t[k][1], True)
            return end + 1
        if (lang, text) in (("java", "import"), ("csharp", "using"), ("php", "use"), ("rust", "use")):
            end = i + 1
            while end < len(self.t) and self.t[end][0] != ";":
                if self.t[end][0] in ("(", "=") or (self.t[end][0] == "{" and lang != "rust"):
                    return 0
                end += 1
            words = "".join(" as " if self.text(k) == "as" else self.text(k) for k in range(i + 1, end) if self.text(k) != "static")
            sep = {"rust": "::", "php": "\\"}.get(lang, ".")
            for path in self._expand(words):
                path, _, alias = path.partition(" as ")
                last = path.rsplit(sep, 1)[-1]
                external = lang != "rust" or path.split("::")[0] not in ("crate", "super", "self")
                self.out.imported(alias or last, path, line, external, last if alias else None)
            return end + 1
        return 0

    def _expand(self, path: str) -> list[str]:
        """a::{b, c::d} as a::b and a::c::d."""
        if "{" not in path:
            return [path]
        head, rest = path.split("{", 1)
        parts, depth, part = [], 0, ""
        for c in rest[: rest.rindex("}")] if "}" in rest else rest:
            depth += (c == "{") - (c == "}")
            if c == "," and not depth:
                parts.append(part)
                part = ""
            else:
                part += c
        return [x for p in [*parts, part] if p for x in self._expand(head + p)]

    def use(self, i: int) -> int:
        """An identifier that is neither a definition nor an import: a method's name, or a call."""
        text, line, _ = self.t[i]
        lang, nxt = self.lang.name, self.text(i + 1)
        owner = self.scopes[-1] if self.scopes else None
        if nxt == "(" and owner is not None and owner.kind in ("class", "interface", "enum", "trait") and text not in _KEYS and self.depth == owner.depth and self.text(i - 1) not in (".", "new", "=", "->", "::", "@"):
            end = self.close(i + 1)
            after = self.text(end + 1)
            typed = lang in ("java", "csharp")
            if after in ("{", "throws", ":", "=>", "where") or (typed and after == ";" and self.t[i - 1][2] in ("id", "op") and self.text(i - 1) not in ("{", "}", ";")):
                self.define(text, "method", i, self.prefix(i), opens=after != ";")
                return end + 1
        rust_macro = lang == "rust" and (text.endswith("!") or (nxt == "!" and self.text(i + 2) in ("(", "[", "{")))
        if (nxt == "(" or rust_macro) and (text not in _KEYS or (lang == "rust" and text == "new")):
            callee = text if not rust_macro or text.endswith("!") else text + "!"
            if self.lang.dotted:
                k = i
                while self.text(k - 1) in (".",) and k >= 2 and (self.t[k - 2][2] == "id" or self.text(k - 2) == ")"):
                    if self.text(k - 2) == ")":
                        break
                    callee = f"{self.text(k - 2)}.{callee}"
                    k -= 2
            self.out.call(self.caller(), callee.lstrip("$"), line)
        elif text[:1].isupper() and lang in ("javascript", "typescript") and self.text(i - 1) == "<" and self.text(i - 2) in ("(", "return", "=>", ">", "?", "&", ":"):
            self.out.call(self.caller(), text, line)
        return i + 1

    def ruby(self, i: int) -> int:
        text, line, kind = self.t[i]
        start = self.text(i - 1) in ("", "\n", ";")
        if kind != "id":
            return i + 1
        if text in ("require", "require_relative") and start:
            k = i + 1 + (self.text(i + 1) == "(")
            module = self.text(k).strip("\"'")
            self.out.imported(module.rsplit("/", 1)[-1], module, line, text == "require")
            return k + 1
        if text in ("class", "module") and start:
            name, j = self.text(i + 1), i + 1
            while self.text(j + 1) == "::":
                name, j = f"{name}::{self.text(j + 2)}", j + 2
            self.define(name, "class" if text == "class" else "module", i + 1, [])
            k, _, s = self.pending
            self.scopes.append(_Scope(k, name, s, 0))
            self.pending = None
            return j + 1
        if text == "def":
            j = i + 3 if self.text(i + 2) == "." else i + 1
            owner = [s.name for s in self.scopes if s.kind in ("class", "module")]
            name = self.text(j)
            self.define(name, "method" if owner else "function", j, [], qualified="::".join(owner) + f"#{name}" if owner else name)
            k, _, s = self.pending
            self.scopes.append(_Scope(k, "", s, 0))
            self.pending = None
            return j + 1
        if text in ("attr_reader", "attr_writer", "attr_accessor") and start:
            j = i + 1
            owner = [s.name for s in self.scopes if s.kind in ("class", "module")]
            while self.text(j) not in ("\n", ""):
                if self.t[j][2] == "id":
                    self.define(self.text(j), "method", j, [], opens=False, qualified="::".join(owner) + f"#{self.text(j)}")
                j += 1
            return j
        if text == "end":
            if self.scopes:
                self.pop(line)
            return i + 1
        if text in ("do", "begin", "case") or (text in ("if", "unless", "while", "until", "for") and start):
            self.scopes.append(_Scope("block", "", None, 0))
            return i + 1
        called = self.text(i + 1) == "(" or (start and self.text(i + 1) == "\n" and any(s.kind in ("function", "method") for s in self.scopes) and text not in ("private", "else", "ensure", "rescue", "self", "nil", "true", "false", "return"))
        if called and text[:1] not in "@$":
            self.out.call(self.caller(), text, line)
        return i + 1


def parse_lexical(source: str, path: str, lang: Lang) -> Parsed:
    try:
        return _Reader(source, lang).read()
    except (IndexError, RecursionError, ValueError):
        return Parsed(errors=1)


Parser = Callable[[str, str], Parsed]
#: Parsers by language; a plugin is a callable put here.
REGISTRY: dict[str, Parser] = {"python": parse_python, **{k: (lambda s, p, lang=lang: parse_lexical(s, p, lang)) for k, lang in LANGS.items()}}


def parse_files(files: DataFrame, registry: dict[str, Parser] | None = None) -> DataFrame:
    """The results of all (path, language, content) rows; a null content or an unknown language gives an empty result
    with one error. A custom ``registry`` must be importable or picklable."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parsers = registry or REGISTRY
        for b in batches:
            rows = []
            for path, language, content in zip(b.path, b.language, b.content, strict=True):
                parser = parsers.get(language)
                try:
                    p = parser(content, path) if parser and content is not None else Parsed(errors=1)
                except Exception:  # noqa: BLE001  whatever a parser or plugin raises costs its file one error, not the job
                    p = Parsed(errors=1)
                if re.search(r"(?:^|/)tests/(?:.*/)?test_[^/]*\.rs$", path or ""):
                    for s in p.symbols:
                        s["decorators"] = [*s["decorators"], "test"]
                rows.append((path, language, p.symbols, p.imports, p.calls, p.errors))
            yield pd.DataFrame(rows, columns=["path", "language", "symbols", "imports", "calls", "syntax_error_count"])

    return files.select("path", "language", "content").mapInPandas(run, RESULT)


def language_of(path: Column) -> Column:
    """The language of a path by its extension; null for others."""
    ext = F.regexp_extract(path, r"\.([A-Za-z]+)$", 1)
    out = F.lit(None).cast("string")
    for k, v in EXTENSIONS.items():
        out = F.when(ext == k, v).otherwise(out)
    return out
