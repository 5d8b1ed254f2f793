"""Protobuf texts: services, methods and messages, and the wire schema, from one small tokenizer."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_NUMBER = 536_870_911
#: The commonest kinds first; a line end is a token, so that lines are counted on the way.
_TOKEN = re.compile(r"[A-Za-z_.][\w.]*|[{}()\[\]<>=;,:+\n]|-?\d[\w.]*|-|//[^\n]*|/\*.*?\*/|\"[^\"\\]*(?:\\.[^\"\\]*)*\"|'[^'\\]*(?:\\.[^'\\]*)*'", re.S)


def tokens(text: str) -> Iterator[tuple[str, int]]:
    """Tokens and their lines."""
    line = 1
    for t in _TOKEN.findall(text):
        if t == "\n":
            line += 1
        else:
            yield t, line
            if t[0] in "/\"'":
                line += t.count("\n")


class Parser:
    """Walks declarations; unknown statements are skipped to their end."""

    def __init__(self, text: str):
        self.comment_before: dict[int, str] = {}
        self.words: list[str] = []
        self.lines: list[int] = []
        last = None
        for word, line in tokens(text):
            if word[0] == "/":
                last = word
            else:
                if last is not None:
                    self.comment_before[len(self.words)] = last
                    last = None
                self.words.append(word)
                self.lines.append(line)
        self.size = len(self.words)
        self.at = 0
        self.package = ""
        self.imports: list[str] = []
        self.nodes: list[dict] = []
        self.fields: list[dict] = []
        self.enums: list[dict] = []
        self.reserved: list[dict] = []
        self.messages: list[str] = []

    def peek(self, k: int = 0) -> str:
        return self.words[self.at + k] if self.at + k < self.size else ""

    def next(self) -> str:
        at = self.at
        self.at = at + 1
        return self.words[at] if at < self.size else ""

    def line(self) -> int:
        """Line of the token read last; at the end, of the last one."""
        return self.lines[min(self.at, self.size) - 1] if self.size else 1

    def skip_statement(self) -> None:
        depth = 0
        while self.at < self.size:
            t = self.next()
            depth += (t == "{") - (t == "}")
            if depth <= 0 and t in (";", "}"):
                return

    def close(self) -> int:
        """Line of the bracket that closes an opened block, skipping what is inside."""
        depth = 1
        while depth and self.at < self.size:
            t = self.next()
            depth += (t == "{") - (t == "}")
        return self.line()

    def run(self, canonical: bool = True) -> "Parser":
        while self.at < self.size:
            word = self.peek()
            if word == "package":
                self.next()
                self.package = self.next()
                self.skip_statement()
            elif word == "import":
                self.next()
                if self.peek() in ("public", "weak"):
                    self.next()
                self.imports.append(self.next().strip("\"'"))
                self.skip_statement()
            elif word == "service":
                self.service(canonical)
            elif word == "message":
                self.message("")
            elif word == "enum":
                self.enum("")
            else:
                self.skip_statement()
        return self

    def node(self, kind: str, name: str, start: int, end: int, doc_at: int) -> None:
        self.nodes.append({"kind": kind, "name": name, "line_start": start, "line_end": end, "docstring": self.comment_before.get(doc_at)})

    def service(self, canonical: bool) -> None:
        doc, _, start = self.at, self.next(), self.line()
        name = self.next()
        self.next()
        mine = len(self.nodes)
        self.nodes.append({})
        end = start
        while self.at < self.size and self.peek() != "}":
            if self.peek() == "rpc":
                r_doc, _, r_start = self.at, self.next(), self.line()
                method = self.next()
                while self.at < self.size and self.peek() not in (";", "{"):
                    self.next()
                r_end = self.close() if self.next() == "{" else self.line()
                self.node("grpc_method", f"{name}.{method}" if canonical else method, r_start, r_end, r_doc)
            else:
                self.skip_statement()
        self.next()
        end = self.line()
        self.nodes[mine] = {"kind": "grpc_service", "name": name, "line_start": start, "line_end": end, "docstring": self.comment_before.get(doc)}

    def message(self, prefix: str) -> None:
        doc, _, start = self.at, self.next(), self.line()
        name = self.next()
        path = prefix + name
        self.messages.append(path)
        self.next()
        mine = len(self.nodes)
        self.nodes.append({})
        self.body(path, None)
        self.next()
        end = self.line()
        self.nodes[mine] = {"kind": "proto_message", "name": name, "line_start": start, "line_end": end, "docstring": self.comment_before.get(doc)}

    def body(self, path: str, oneof: str | None) -> None:
        while self.at < self.size and self.peek() != "}":
            word = self.peek()
            if word == "message" and self.peek(2) == "{":
                self.message(path + ".")
            elif word == "enum" and self.peek(2) == "{":
                self.enum(path + ".")
            elif word == "oneof" and self.peek(2) == "{":
                self.next()
                group = self.next()
                self.next()
                self.body(path, group)
                self.next()
            elif word == "reserved":
                self.next()
                self.ranges(path)
            elif word in ("option", "extensions", "extend", "group", ";"):
                self.skip_statement()
            else:
                self.field(path, oneof)

    def field(self, path: str, oneof: str | None) -> None:
        cardinality, key = "singular", None
        if self.peek() in ("optional", "required", "repeated"):
            cardinality = "repeated" if self.next() == "repeated" else "singular"
        kind = self.next()
        if kind == "map" and self.peek() == "<":
            self.next()
            key = self.next()
            self.next()
            kind = self.next()
            self.next()
            cardinality = "map"
        name, line = self.next(), self.line()
        if self.peek() != "=":
            self.skip_statement()
            return
        self.next()
        number = self.next()
        if number.isdigit():
            self.fields.append({"message": path, "number": int(number), "name": name, "cardinality": cardinality, "value_type": kind, "map_key": key, "oneof": oneof, "line": line})
        self.skip_statement()

    def ranges(self, path: str) -> None:
        while self.at < self.size:
            t = self.next()
            if t == ";":
                return
            if t[:1] in "\"'":
                self.reserved.append({"message": path, "lo": None, "hi": None, "name": t[1:-1]})
            elif t.lstrip("-").isdigit():
                hi = t
                if self.peek() == "to":
                    self.next()
                    hi = self.next()
                self.reserved.append({"message": path, "lo": int(t), "hi": MAX_NUMBER if hi == "max" else int(hi), "name": None})

    def enum(self, prefix: str) -> None:
        self.next()
        path = prefix + self.next()
        self.next()
        while self.at < self.size and self.peek() != "}":
            if self.peek() == "reserved":
                self.next()
                self.ranges(path)
            elif self.peek(1) == "=":
                name, line = self.next(), self.line()
                self.next()
                number = self.next()
                if number.lstrip("-").isdigit():
                    self.enums.append({"enum": path, "number": int(number), "name": name, "line": line})
                self.skip_statement()
            else:
                self.skip_statement()
        self.next()


def parse(text: str, canonical: bool = True) -> Parser:
    return Parser(text).run(canonical)


FIELDS = "source string, message string, number int, name string, cardinality string, value_type string, map_key string, oneof string, line int"


def fields(texts: DataFrame) -> DataFrame:
    """Message fields of schema texts.  texts: text, and source if there are several."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in FIELDS.split(", ")]
        for b in batches:
            rows = [{"source": source} | f for source, text in zip(b["source"], b["text"], strict=True) for f in parse(text or "").fields]
            frame = pd.DataFrame(rows, columns=names, dtype=object)
            yield frame.where(frame.notna(), None)

    source = F.col("source") if "source" in texts.columns else F.lit(None).cast("string").alias("source")
    return texts.select(source, "text").mapInPandas(run, FIELDS)
