"""Declarations in source files: functions, methods, types, constants.

Python is parsed by the language itself.  For Go, JavaScript, TypeScript and
Java a small reader blanks comments and strings, pairs the braces, and reads
declarations at the depth where they count: the top of a file, and bodies of
classes and interfaces.  It needs no grammar and does not check syntax; text
that it cannot make out is passed over.  Files are read in Arrow batches, each
where it lies.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knotlog.functions import paths

SCHEMA = "path string, kind string, name string, receiver string, exported boolean, line int, end_line int"
LANGUAGES = ("Go", "Python", "JavaScript", "TypeScript", "Java")

Entity = tuple[str, str, str, bool, int, int]  # kind, name, receiver, exported, first and last line

_QUIET = {
    "Go": re.compile(r'//[^\n]*|/\*.*?\*/|"(?:\\.|[^"\\\n])*"|`[^`]*`|' + r"'(?:\\.|[^'\\\n])+'", re.S),
    "Java": re.compile(r'//[^\n]*|/\*.*?\*/|""".*?"""|"(?:\\.|[^"\\\n])*"|' + r"'(?:\\.|[^'\\\n])+'", re.S),
    "JavaScript": re.compile(r'//[^\n]*|/\*.*?\*/|"(?:\\.|[^"\\\n])*"|' + r"'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`", re.S),
}


def masked(text: str, language: str) -> str:
    """``text`` with comments and strings as blanks; line breaks stay."""
    return _QUIET.get(language, _QUIET["JavaScript"]).sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text)


class Source:
    """Masked text with its pairs of braces and the depth of every place."""

    def __init__(self, text: str, language: str):
        self.text = masked(text, language)
        self.close: dict[int, int] = {}
        self.deep: list[tuple[int, int]] = [(0, 0)]
        stack: list[int] = []
        for m in re.finditer(r"[(){}\[\]]", self.text):
            if m[0] in "([{":
                stack.append(m.start())
            elif stack:
                self.close[stack.pop()] = m.start()
            self.deep.append((m.end(), len(stack)))
        self.starts = [0, *(m.end() for m in re.finditer("\n", self.text))]

    def line(self, at: int) -> int:
        """Number of the line of a place, from 1."""
        lo, hi = 0, len(self.starts)
        while hi - lo > 1:
            mid = (lo + hi) // 2
            lo, hi = (mid, hi) if self.starts[mid] <= at else (lo, mid)
        return lo + 1

    def members(self, a: int, b: int) -> Iterator[tuple[int, str, int, int]]:
        """Declarations between two places: start, header, place of the body's brace or -1, end."""
        at = start = a
        while at < b:
            m = re.compile(r"[;{(\[}]").search(self.text, at, b)
            if not m:
                return
            i = m.start()
            if m[0] in "([":
                at = self.close.get(i, b) + 1
                continue
            head = self.text[start:i]
            lead = len(head) - len(head.lstrip())
            if m[0] == "{":
                end = self.close.get(i, b - 1)
                # an initialiser's braces end with its semicolon
                if re.search(r"=\s*$|=[^{;]*[\])]\s*$", head):
                    at = end + 1
                    continue
                yield start + lead, head.strip(), i, end
                at = start = end + 1
            else:
                if m[0] == ";" and head.strip():
                    yield start + lead, head.strip(), -1, i
                at = start = i + 1

    def top(self, pattern: str) -> Iterator[re.Match]:
        """Matches at the start of a line outside of all brackets."""
        k = 0
        for m in re.finditer(pattern, self.text, re.M):
            while k + 1 < len(self.deep) and self.deep[k + 1][0] <= m.start():
                k += 1
            if self.deep[k][1] == 0:
                yield m

    def end(self, at: int) -> int:
        """Last place of a statement that goes on from ``at``: its line's end outside of brackets."""
        while True:
            m = re.compile(r"[\n({\[;]").search(self.text, at)
            if not m:
                return len(self.text)
            if m[0] in "\n;":
                return m.start()
            at = self.close.get(m.start(), len(self.text) - 1) + 1


def go(text: str) -> Iterator[Entity]:
    """Functions, methods, types and constants of a Go file."""
    s = Source(text, "Go")
    row = lambda kind, name, receiver, a, b: (kind, name, receiver, name[:1].isupper(), s.line(a), s.line(b))
    for m in s.top(r"^func\s*(?:\(\s*(?:\w+\s+)?\*?\s*(\w+)[^)]*\)\s*)?(\w+)\s*[(\[]"):
        yield row("method" if m[1] else "function", m[2], m[1] or "", m.start(), s.end(m.end() - 1))
    spec = re.compile(r"^[ \t]*([A-Za-z_]\w*)\b(?!\s*[:.])([^\n]*)", re.M)
    for word, kind in (("type", ""), ("const", "constant")):
        for m in s.top(rf"^{word}\b[ \t]*(\(|[A-Za-z_]\w*)"):
            at, stop = (m.end(), s.close.get(m.start(1), len(s.text))) if m[1] == "(" else (m.start(1), m.start(1) + 1)
            while found := (spec.search(s.text, at, stop) if m[1] == "(" else re.compile(r"(\w+)([^\n]*)").match(s.text, at)):
                end = s.end(found.start(1))
                what = kind or ("interface" if re.match(r"\s*(?:\[[^\]]*\]\s*)?interface\b", found[2]) else "struct")
                yield row(what, found[1], "", found.start(1), end)
                at = end + 1
                if m[1] != "(" or at >= stop:
                    break


_JS = r"^(export\s+)?(?:default\s+)?(?:declare\s+)?(?:abstract\s+)?(?:async\s+)?"


def javascript(text: str) -> Iterator[Entity]:
    """Functions, classes with methods, interfaces and constants of a JavaScript or TypeScript file."""
    s = Source(text, "JavaScript")
    for m in s.top(_JS + r"(function\s*\*?|class|interface)\s*(\w+)"):
        kind = m[2].rstrip(" *\t\n")
        brace = s.text.find("{", m.end())
        if kind == "function" and (args := s.text.find("(", m.end())) >= 0:
            brace = s.text.find("{", s.close.get(args, args))
        end = s.close.get(brace, len(s.text) - 1)
        yield kind, m[3], "", bool(m[1]), s.line(m.start()), s.line(end)
        if kind == "class" and brace >= 0:
            for at, head, body, stop in s.members(brace + 1, end):
                name = re.match(r"(?:(?:public|private|protected|static|async|readonly|override|abstract|get|set)\s+|\*\s*)*(#?\w+)\s*(?:<[^(]*>)?\(", head)
                if body >= 0 and name:
                    yield "method", name[1], m[3], True, s.line(at), s.line(stop)
    for m in s.top(r"^(export\s+)?(?:declare\s+)?(?:const|let)\s+(\w+)[^=\n]*(=)?[ \t]*"):
        arrow = m[3] and re.compile(r"(?:async\s+)?(?:\w+|\()").match(s.text, m.end())
        is_function = False
        if arrow:
            at = s.close.get(arrow.end() - 1, arrow.end()) + 1 if s.text[arrow.end() - 1] == "(" else arrow.end()
            is_function = bool(re.compile(r"\s*(?::[^=\n]*)?=>").match(s.text, at))
        yield "function" if is_function else "constant", m[2], "", bool(m[1]), s.line(m.start()), s.line(s.end(m.end()))


_JAVA_TYPE = re.compile(r"(?:^|\s)(class|interface|enum|@interface|record)\s+(\w+)")


def java(text: str) -> Iterator[Entity]:
    """Types with their methods and constants of a Java file; inner classes are named after their outer one."""
    s = Source(text, "Java")

    def has(head: str, word: str) -> bool:
        return re.search(rf"(?:^|\s){word}\s", head) is not None

    def inside(a: int, b: int, owner: str, kind: str) -> Iterator[Entity]:
        for at, head, body, stop in s.members(a, b):
            head = re.sub(r"@(?!interface\b)[\w.]+(\s*\([^)]*\))?\s*", "", head)
            public, lines = has(head, "public"), (s.line(at), s.line(stop))
            inner = _JAVA_TYPE.search(head) if body >= 0 else None
            if inner:
                if inner[1] == "class" and kind == "class":
                    yield from named(inner, f"{owner}.{inner[2]}", head, body, stop, lines)
            elif (m := re.search(r"(\w+)\s*\($", head.split("=")[0].split("(")[0] + "(")) and "=" not in head.split("(")[0] and "(" in head:
                yield "method", m[1], owner, public, *lines
            elif kind == "class" and has(head, "static") and has(head, "final") and (m := re.search(r"(\w+)\s*(?:\[\s*\]\s*)*(?:=|,|$)", head)):
                yield "constant", m[1], "", public, *lines

    def named(m: re.Match, name: str, head: str, body: int, stop: int, lines: tuple[int, int]) -> Iterator[Entity]:
        kind = {"@interface": "annotation", "record": "class"}.get(m[1], m[1])
        yield kind, name, "", has(head, "public"), *lines
        if kind in ("class", "interface"):
            yield from inside(body + 1, stop, name, kind)

    for at, head, body, stop in s.members(0, len(s.text)):
        m = _JAVA_TYPE.search(head)
        if m and body >= 0:
            yield from named(m, m[2], head, body, stop, (s.line(at), s.line(stop)))


def python(text: str) -> Iterator[Entity]:
    """Functions, classes with methods, and upper-case constants of a Python module."""
    for node in ast.parse(text).body:
        lines = node.lineno, node.end_lineno or node.lineno
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            yield "function", node.name, "", not node.name.startswith("_"), *lines
        elif isinstance(node, ast.ClassDef):
            yield "class", node.name, "", not node.name.startswith("_"), *lines
            for x in node.body:
                if isinstance(x, (ast.FunctionDef, ast.AsyncFunctionDef)):
                    yield "method", x.name, node.name, not x.name.startswith("_"), x.lineno, x.end_lineno or x.lineno
        elif isinstance(node, ast.Assign) and len(node.targets) == 1 and isinstance(node.targets[0], ast.Name) and node.targets[0].id.isupper():
            yield "constant", node.targets[0].id, "", not node.targets[0].id.startswith("_"), *lines


_READERS = {"Go": go, "Python": python, "JavaScript": javascript, "TypeScript": javascript, "Java": java}


def entities(files: DataFrame) -> DataFrame:
    """``path, kind, name, receiver, exported, line, end_line`` of the declarations in ``path, content``.

    A file of another language, or that does not parse, has none.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for path, language, content in zip(batch["path"], batch["language"], batch["content"], strict=True):
                try:
                    found = list(_READERS[language](bytes(content).decode("utf-8", "replace")))
                except (SyntaxError, ValueError, RecursionError):
                    continue
                out += [(path, *x) for x in sorted(found, key=lambda x: (x[4], x[5], x[1]))]
            yield pd.DataFrame(out, columns=[c.split()[0] for c in SCHEMA.split(", ")])

    own = files.select("path", paths.language(F.col("path")).alias("language"), "content").where(F.col("language").isin(*LANGUAGES))
    return own.mapInPandas(run, SCHEMA)
