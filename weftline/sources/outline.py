"""Source files without the bodies of their functions, and snippets of them, with a map back to the original lines.

Bodies of brace languages are found by matched brackets over text whose strings and comments are blank; those of
Python come from its syntax tree, those of Ruby from ``def`` and ``end``.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame

#: What takes a body's place, what stands for a file that cannot be read, lines around a snippet's anchor (fixed values).
STRIPPED, STUB, LEAD, LINES, UNKNOWN_BYTES = "{ /* stripped */ }", "/* source omitted: it could not be parsed within its limits */", 3, 40, 1024
BRACES = ("java", "go", "rust", "kotlin", "csharp", "php", "swift", "scala", "cpp", "typescript", "javascript")
WHOLE = ("protobuf", "yaml")
_NOISE = re.compile(r"//[^\n]*|/\*.*?\*/|\"\"\".*?\"\"\"|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\.)*`", re.S)
_CONTROL = re.compile(r"\b(?:if|else|for|while|switch|catch|do|try|finally|synchronized|match|when|select|with|using|lock|unless|guard|defer|loop)\b")
_TYPE = re.compile(r"\b(?:class|interface|struct|enum|trait|impl|namespace|module|object|protocol|extension|record|package|union|extern|mod|type)\b")


def _blank(text: str, language: str) -> str:
    if language in ("rust", "scala"):  # a quote may start a lifetime or a symbol
        text = re.sub(r"'(?=[A-Za-z_]\w*\b(?!'))", " ", text)
    return _NOISE.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text)


def _brace_bodies(text: str, language: str) -> list[tuple[int, int, str]]:
    """(start, end, replacement) of outermost function bodies."""
    clean, out = _blank(text, language), []
    stack: list[tuple[int, bool]] = []  # opening offset, inside a function
    for m in re.finditer(r"[{}]", clean):
        if m[0] == "}":
            if stack:
                start, body = stack.pop()
                if body and not any(inside for _, inside in stack):
                    out.append((start, m.end(), STRIPPED))
            continue
        head = clean[max(clean.rfind(c, 0, m.start()) for c in ";{}") + 1 : m.start()]
        arrow = head.rstrip().endswith("=>")
        called = ")" in head and not _CONTROL.search(head.rsplit(")", 1)[0].split("(", 1)[0])
        body = arrow or (called and not _TYPE.search(head.split("(", 1)[0]) and not head.rstrip().endswith(("=", "(", ",", ":", "return")))
        if language == "go" and re.search(r"\b(?:struct|interface)\s*$", head):
            body = False
        stack.append((m.start(), body))
    return sorted(out)


def _python_bodies(text: str) -> list[tuple[int, int, str]]:
    lines = [0, *(m.end() for m in re.finditer("\n", text))]
    raw = text.encode()
    at = lambda line, col: lines[line - 1] + len(raw[len(text[: lines[line - 1]].encode()) :][:col].decode(errors="ignore"))
    out = []

    def walk(node: ast.AST) -> None:
        for child in ast.iter_child_nodes(node):
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef)):
                body = child.body
                doc = ast.get_docstring(child, clean=False) is not None
                rest = body[1:] if doc else body
                if rest:
                    first = min([rest[0].lineno, *(d.lineno for d in getattr(rest[0], "decorator_list", []))])
                    start = at(first, rest[0].col_offset) if first == rest[0].lineno else at(first, 0)
                    out.append((start, at(rest[-1].end_lineno, rest[-1].end_col_offset), "..."))
            else:
                walk(child)

    walk(ast.parse(text))
    return sorted(out)


def _ruby_bodies(text: str) -> list[tuple[int, int, str]]:
    out, depth, start, at = [], 0, None, 0
    opens = re.compile(r"^\s*(?:def|class|module|if|unless|case|while|until|for|begin)\b|\bdo\b(?:\s*\|[^|]*\|)?\s*$")
    for line in text.splitlines(keepends=True):
        plain = re.sub(r"#.*|\"[^\"]*\"|'[^']*'", "", line)
        if opens.search(plain) and not re.search(r"\bend\s*$", plain):
            if start is None and re.match(r"\s*def\b", plain):
                start, depth = at + len(line.rstrip("\n")), 0
            elif start is not None:
                depth += 1
        elif re.match(r"\s*end\b", plain) and start is not None:
            if depth == 0:
                indent = line[: len(line) - len(line.lstrip())]
                out.append((start, at + len(indent), f"\n{indent}  # stripped\n{indent}"))
                start = None
            else:
                depth -= 1
        at += len(line)
    return out


def splice(text: str, parts: Sequence[tuple[int, int, str]]) -> tuple[str, list[tuple[int, int]]]:
    """(text with parts replaced, first and last original line of every output line); parts that overlap are left."""
    out: list[str] = []
    spans: list[list[int]] = [[1, 1]]
    line = 1

    def put(piece: str, first: int, last: int) -> None:
        """Text that stands for the original lines first to last."""
        for k, bit in enumerate(piece.split("\n")):
            if k:
                spans.append([first, last])
            if bit:
                spans[-1] = [min(spans[-1][0], first), max(spans[-1][1], last)]
        out.append(piece)

    def keep(piece: str) -> None:
        nonlocal line
        for k, bit in enumerate(piece.split("\n")):
            if k:
                line += 1
                spans.append([line, line])
            if bit:
                spans[-1] = [min(spans[-1][0], line), max(spans[-1][1], line)]
        out.append(piece)

    at = 0
    for a, b, new in sorted(parts):
        if a < at or b < a:
            continue
        keep(text[at:a])
        last = line + text.count("\n", a, b)
        put(new, line, last)
        line, at = last, b
    keep(text[at:])
    done = "".join(out)
    if done.endswith("\n"):
        spans.pop()
    return done, [tuple(s) for s in spans]


def outline(text: str, language: str | None, with_bodies: bool = False) -> tuple[str, list[tuple[int, int]], bool]:
    """(text, line map, bounded): a source without function bodies; ``bounded`` where only a stub can be given."""
    if with_bodies or language in WHOLE:
        return *splice(text, []), False
    try:
        if language == "python":
            return *splice(text, _python_bodies(text)), False
        if language == "ruby":
            return *splice(text, _ruby_bodies(text)), False
        if language in BRACES:
            return *splice(text, _brace_bodies(text, language)), False
    except (SyntaxError, ValueError, RecursionError):
        return STUB, [(1, max(1, text.count("\n") + 1))], True
    if len(text.encode()) > UNKNOWN_BYTES:
        return STUB, [(1, max(1, text.count("\n") + 1))], True
    return *splice(text, []), False


def verified_anchor(path: str, lines: list[str], query: str, anchor: int | None) -> int | None:
    """An indexed line is trusted if the lines around it mention the query, or it is line 1 of a file of that name."""
    if not anchor or not 0 < anchor <= len(lines):
        return None
    q = query.lower()
    near = lines[max(0, anchor - 1 - LEAD) : anchor - 1 + LINES]
    stem = path.rsplit("/", 1)[-1].rsplit(".", 1)[0].lower()
    return anchor if any(q in x.lower() for x in near) or (anchor == 1 and q in stem) else None


def snippet(path: str, text: str, language: str | None, query: str, anchor: int | None = None, with_bodies: bool = False) -> dict | None:
    """line and text of what a hit shows: the outline around its anchor, else around the first line that mentions the query."""
    lines = text.split("\n")
    line = verified_anchor(path, lines, query, anchor)
    if line is None:
        line = next((n for n, x in enumerate(lines, 1) if query.lower() in x.lower()), None)
        if line is None:
            return None
    shown, spans, bounded = outline(text, language, with_bodies)
    if bounded:
        return {"line": line, "snippet": shown}
    at = next((k for k, (a, b) in enumerate(spans) if a <= line <= b), 0)
    rows = shown.split("\n")[max(0, at - LEAD) : at + LINES - LEAD]
    return {"line": line, "snippet": "\n".join(rows)}


SNIPPETS = "file_path string, line int, snippet string"


def snippets(page: DataFrame, files: DataFrame, query: str, with_bodies: bool = False) -> DataFrame:
    """Snippets of a page of hits (file_path, anchor), joined with the files' texts (file_path, language, text)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, language, text, anchor in zip(b["file_path"], b["language"], b["text"], b["anchor"], strict=True):
                found = snippet(path, text, language, query, None if pd.isna(anchor) else int(anchor), with_bodies)
                if found:
                    rows.append((path, found["line"], found["snippet"]))
            yield pd.DataFrame(rows, columns=["file_path", "line", "snippet"])

    return files.where("text is not null").join(page, "file_path").select("file_path", "language", "text", "anchor").mapInPandas(run, SNIPPETS)


OUTLINES = "file_path string, text string, line_map array<struct<first:int,last:int>>, bounded boolean"


def outlines(files: DataFrame) -> DataFrame:
    """Outlines of (file_path, language, text)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, language, text in zip(b["file_path"], b["language"], b["text"], strict=True):
                shown, spans, bounded = outline(text, language)
                rows.append((path, shown, [{"first": x, "last": y} for x, y in spans], bounded))
            yield pd.DataFrame(rows, columns=["file_path", "text", "line_map", "bounded"])

    return files.where("text is not null").select("file_path", "language", "text").mapInPandas(run, OUTLINES)
