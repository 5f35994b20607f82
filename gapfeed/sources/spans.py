"""Functions and methods of source files as line spans.

Python files are read with the standard parser. JavaScript, TypeScript, Rust and
Java files are scanned by line: a declaration opens a span that ends where its braces close
(those of strings and comments don't count; `approx` is set). One row of input is one file; files
are independent, so a map over them needs no shuffle. Go files are read by `go_source`.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from gapfeed.shipping import materialize

SCHEMA = "file string, span_pos int, name string, kind string, start_line int, end_line int, params array<string>, approx boolean"

_NAME = r"([A-Za-z_$][\w$]*)"
_DECLARATIONS = {
    "rust": re.compile(rf"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:async\s+|const\s+|unsafe\s+)*fn\s+{_NAME}\s*(?:<[^>]*>)?\s*\(([^)]*)\)?"),
    "java": re.compile(rf"^\s*(?:@\w+\s+)*(?:(?:public|protected|private|static|final|abstract|synchronized|native|default)\s+)*(?:<[^>]+>\s+)?[\w$.<>\[\], ?]+\s+{_NAME}\s*\(([^)]*)\)\s*(?:throws\s+[\w., ]+)?\s*\{{?\s*$"),
    "js": re.compile(rf"^\s*(?:export\s+)?(?:default\s+)?(?:(?:async\s+)?function\s*\*?\s*{_NAME}\s*\(([^)]*)\)|(?:const|let|var)\s+{_NAME}\s*=\s*(?:async\s*)?(?:\(([^)]*)\)|([A-Za-z_$][\w$]*))\s*=>)"),
}
_JAVA_CLASS = re.compile(r"\b(?:class|interface|enum|record)\s+([A-Za-z_]\w*)")
_JS_CLASS = re.compile(r"^\s*(?:export\s+)?(?:default\s+)?class\s+([A-Za-z_$][\w$]*)")
_JS_METHOD = re.compile(rf"^\s+(?:static\s+|async\s+|get\s+|set\s+)*{_NAME}\s*\(([^)]*)\)\s*\{{")
_RUST_IMPL = re.compile(r"^\s*(?:unsafe\s+)?impl\b(?:\s*<[^{]*?>)?\s+(?:[^{]*?\bfor\s+)?&?(?:\w+::)*([A-Za-z_]\w*)")
_CONTROL = frozenset("if for while switch catch return new else do try throw synchronized function".split())
#: Names of test helpers, which are no targets.
HELPERS = frozenset("describe it test beforeEach afterEach beforeAll afterAll expect".split())
_LANGUAGE = {".py": "python", ".rs": "rust", ".java": "java", ".js": "js", ".jsx": "js", ".ts": "js", ".tsx": "js", ".mjs": "js", ".cjs": "js"}


def python_spans(source: str) -> list[tuple[str, str, int, int, list[str]]] | None:
    """(name, kind, start, end, params) of a Python file, methods by class; None if it doesn't parse."""
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError):
        return None
    out, todo = [], [(n, "") for n in reversed(tree.body)]
    while todo:
        node, owner = todo.pop()
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            if not (node.name.startswith("__") and node.name.endswith("__")):
                a = node.args
                params = [x.arg for x in [*a.posonlyargs, *a.args, *([a.vararg] if a.vararg else []), *a.kwonlyargs, *([a.kwarg] if a.kwarg else [])]]
                if owner and params[:1] in (["self"], ["cls"]):
                    params = params[1:]
                out.append((f"{owner}.{node.name}" if owner else node.name, "method" if owner else "function", node.lineno, node.end_lineno, params))
        elif isinstance(node, ast.ClassDef):
            todo += [(n, node.name) for n in reversed(node.body)]
        else:
            todo += [(n, owner) for n in reversed(list(ast.iter_child_nodes(node))) if isinstance(n, ast.stmt)]
    return out


def parameters(raw: str) -> list[str]:
    """Names of a parameter list."""
    out = []
    for part in (p.strip() for p in raw.split(",")):
        if part and part not in ("self", "&self", "&mut self", "mut self"):
            name = part.split("=")[0].strip()
            out.append(name.split(":")[0].strip().removeprefix("mut ") if ":" in name else name.split()[-1] if name.split() else "")
    return [p for p in out if p]


_MASKED = re.compile("//[^\n]*|/\\*.*?(?:\\*/|\\Z)|\"(?:[^\"\\\\\n]|\\\\.)*\"?|`(?:[^`\\\\]|\\\\.)*`?|'(?:[^'\\\\\n]|\\\\.)*'", re.DOTALL)
_RUST_MASKED = re.compile("//[^\n]*|/\\*.*?(?:\\*/|\\Z)|\"(?:[^\"\\\\]|\\\\.)*\"?|'(?:[^'\\\\\n]|\\\\[^\n]{1,9})'", re.DOTALL)


def without_quoted(source: str, language: str) -> str:
    """A text of the same lines in which strings and comments are blanks, so that their braces don't count."""
    return (_RUST_MASKED if language == "rust" else _MASKED).sub(lambda m: re.sub(r"[^\n]", " ", m[0]), source)


def brace_end(lines: list[str], at: int) -> int:
    """The line (from 1) where the braces that open at or after a line close; the last line if they don't."""
    depth, opened = 0, False
    for i in range(at, len(lines)):
        for c in lines[i]:
            if c == "{":
                depth, opened = depth + 1, True
            elif c == "}":
                depth = max(0, depth - 1)
                if opened and not depth:
                    return i + 1
    return len(lines)


def brace_spans(source: str, language: str) -> list[tuple[str, str, int, int, list[str]]]:
    lines, bare = source.split("\n"), without_quoted(source, language).split("\n")
    out: list[tuple[str, str, int, int, list[str]]] = []
    owner, owner_end = "", 0
    for i, line in enumerate(lines):
        if i + 1 > owner_end and language in ("js", "rust"):
            owner = ""
        if language == "rust" and (m := _RUST_IMPL.match(line)):
            owner, owner_end = m[1], brace_end(bare, i)
            continue
        if language == "java" and (m := _JAVA_CLASS.search(line)) and not line.lstrip().startswith(("*", "//")):
            owner = m[1]
            continue
        if language == "js" and (m := _JS_CLASS.match(line)):
            owner, owner_end = m[1], brace_end(bare, i)
            continue
        m = _DECLARATIONS[language].match(line)
        if language == "js":
            if m:
                name, raw = (m[1], m[2]) if m[1] else (m[3], m[4] if m[4] is not None else m[5])
            elif owner and (m := _JS_METHOD.match(line)):
                name, raw = m[1], m[2]
            else:
                continue
            if name in HELPERS or name in _CONTROL or name.startswith(("test", "mock")):
                continue
        elif not m:
            continue
        else:
            name, raw = m[1], m[2]
            if name in _CONTROL or line.split("(")[0].split()[:1] and line.split()[0] in _CONTROL:
                continue
        owned = language in ("java", "js", "rust") and owner
        kind = "method" if owned else "function"
        out.append((f"{owner}.{name}" if owned else name, kind, i + 1, brace_end(bare, i), parameters(raw or "")))
    return out


def spans_of(path: str, source: str | None) -> list[tuple]:
    """The spans of one file in document order; none for unknown kinds of files, one of number -1 for a
    Python file that doesn't parse."""
    language = _LANGUAGE.get("." + path.rsplit(".", 1)[-1].lower()) if path and "." in path else None
    if language is None or not source:
        return []
    approx, found = language != "python", None
    if language == "python":
        found = python_spans(source)
        if found is None:
            return [(path, -1, None, None, None, None, None, True)]
    else:
        found = brace_spans(source, language)
    return [(path, i, *s, approx) for i, s in enumerate(sorted(found, key=lambda s: s[2]))]


def source_spans(files: DataFrame, path: str = "file", source: str = "source") -> DataFrame:
    """Spans of all files (path, source). Python files that don't parse are read by indentation."""
    from gapfeed.sources.scopes import python_scopes

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split()[0] for c in SCHEMA.split(", ")]
        for part in parts:
            yield pd.DataFrame([s for p, t in zip(part["file"], part["source"]) for s in spans_of(p, t)], columns=columns)

    files = files.selectExpr(f"`{path}` as file", f"`{source}` as source")
    read = materialize(files.mapInPandas(run, SCHEMA), "source-spans")
    rest = files.join(read.where("span_pos < 0").select("file").distinct().hint("merge"), "file", "left_semi")
    return read.where("span_pos >= 0").unionByName(python_scopes(rest))
