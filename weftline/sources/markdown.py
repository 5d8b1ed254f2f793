"""Markdown files as heading sections, with frontmatter and a budget: one file in, its sections out.

The budget and the merging of what lies beyond it depend on what came before in the file, so a file is read in
order by one task; files are independent.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline import schema

#: Limits (fixed values): budget per byte of a file and at least, what a section costs besides its text, a description.
PER_BYTE, FLOOR, SECTION_COST, DESCRIPTION = 3, 64 * 1024, 200, 512
_HEADING = re.compile(r"\s*(#{1,6}) ")
_KEY = re.compile(r"[A-Za-z0-9_.-]+\s*$")


def lines_of(text: str) -> list[str]:
    """Lines without their ends; a last line end opens no line."""
    out = text.split("\n")
    if out[-1] == "":
        out.pop()
    return [x[:-1] if x.endswith("\r") else x for x in out]


def _is_metadata(line: str, mark: str) -> bool:
    line = line.rstrip()
    if not line or line[0] in " \t#" or (mark == ":" and (line == "-" or line.startswith("- "))) or (mark == "=" and line.startswith("[")):
        return True
    key, found, _ = line.partition(mark)
    return bool(found and _KEY.fullmatch(key))


def frontmatter(text: str) -> tuple[int, str | None, str | None]:
    """(lines it takes, name, description) of a block between ``---`` or ``+++`` at the start; (0, None, None) for none.

    A block must be closed, and each of its lines look like metadata; else it is prose between rules.
    """
    rows = lines_of(text)
    mark = {"---": ":", "+++": "="}.get(rows[0].lstrip("﻿").rstrip()) if rows else None
    if not mark:
        return 0, None, None
    close = "---" if mark == ":" else "+++"
    found: dict[str, str] = {}
    open_key, folded = None, []
    for n, line in enumerate(rows[1:], 2):
        if open_key and line[:1] in (" ", "\t"):
            folded.append(line.strip())
            continue
        if open_key:
            if value := " ".join(folded).strip():
                found[open_key] = value
            open_key, folded = None, []
        if line.rstrip() == close:
            return n, found.get("name"), found.get("description")
        if not _is_metadata(line, mark):
            break
        key, has, value = line.partition(mark)
        if not has or line[:1] in (" ", "\t") or key.rstrip() not in ("name", "description"):
            continue
        value = value.strip()
        if value in ("", ">", "|", ">-", "|-"):
            open_key = key.rstrip()
        elif plain := value.strip("\"'").strip():
            found[key.rstrip()] = plain
    return 0, None, None


def sections(path: str, text: str) -> list[dict]:
    """Sections in order: title, level, start_line, end_line, content (without the heading; empty ones go).

    What stands before a heading is titled by the frontmatter's name or the file's stem.  Beyond the budget
    headings open no section any more: the rest of the file is the last one.
    """
    rows = lines_of(text)
    skip, name, description = frontmatter(text)
    budget, spent, merged = max(PER_BYTE * len(text.encode()), FLOOR), 0, False
    stem = re.sub(r"(?<=.)\.[^.]*$", "", path.rsplit("/", 1)[-1]) or "Document"
    title, level, start, body, out = name or stem, 1, skip + 1, [], []

    def close(end: int) -> None:
        nonlocal spent, merged
        content = "\n".join(body)
        out.append({"title": title, "level": level, "start_line": start, "end_line": end, "content": content})
        spent += SECTION_COST + 2 * len(content.encode())
        merged = spent + SECTION_COST > budget

    for n in range(skip, len(rows)):
        heading = None if merged else _HEADING.match(rows[n])
        if not heading:
            body.append(rows[n])
            continue
        if body:
            close(n)
            body = []
        title, level, start = rows[n][heading.end(1) :].strip(), len(heading[1]), n + 1
    if body:
        close(max(len(rows), start))
    if description and out:
        out[0]["content"] = f"description: {description[:DESCRIPTION]}\n{out[0]['content']}"
    return out


def markdown_sections(texts: DataFrame) -> DataFrame:
    """Sections of (file_path, text)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in schema.SECTIONS.split(", ")]
        for b in batches:
            rows = [{"file_path": p} | s for p, t in zip(b["file_path"], b["text"], strict=True) for s in sections(p, t)]
            yield pd.DataFrame(rows, columns=names)

    return texts.where("text is not null").select("file_path", "text").mapInPandas(run, schema.SECTIONS)


def replace_files(kept: DataFrame, fresh: DataFrame) -> DataFrame:
    """Sections with those of re-read files exchanged: theirs go, the fresh ones are added."""
    return kept.join(fresh.select("file_path").distinct(), "file_path", "left_anti").unionByName(fresh)


def canonical_lines(found: DataFrame) -> DataFrame:
    """line: one id-free line per section, for a fingerprint."""
    return found.select(F.to_json(F.array(F.lit("doc"), "file_path", "title", F.col("level").cast("string"), F.col("start_line").cast("string"), F.col("end_line").cast("string"), "content")).alias("line"))
