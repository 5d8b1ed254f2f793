"""YAML files: properties as dotted keys, AsyncAPI and OpenAPI contracts, under budgets on what aliases repeat.

Parsing yields events, one at a time; an alias replays the events its anchor recorded.  A file whose replay or
output goes over its budget, or that does not parse, contributes nothing (``failed``).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import pandas as pd
from pyspark.sql import DataFrame

try:
    import yaml
except ImportError:  # every file is then reported as failed
    yaml = None

#: Budgets (fixed values): units per byte of input, and at least.
EVENTS_PER_BYTE, REPLAY_PER_BYTE, OUTPUT_PER_BYTE, FLOOR, DEPTH = 1, 4, 8, 64 * 1024, 128


class Refused(ValueError):
    """A file that goes over a budget or is no single mapping where one is asked for."""


class _Node:
    """kind: scalar, seq or map; a mapping's value is a list of (key node, value node)."""

    __slots__ = ("kind", "value", "plain", "tag")

    def __init__(self, kind: str, value, plain: bool = False, tag: str | None = None):
        self.kind, self.value, self.plain, self.tag = kind, value, plain, tag


def _events(text: str) -> Iterator:
    """Node events of the first document with aliases replayed, within the budgets."""
    size = len(text.encode())
    units, replayed = max(size * EVENTS_PER_BYTE, FLOOR), max(size * REPLAY_PER_BYTE, FLOOR)
    recorded: dict[str, list] = {}
    open_ones: list[list] = []  # [anchor, events, depth]
    used = out = 0
    for e in yaml.parse(text, Loader=getattr(yaml, "CSafeLoader", yaml.SafeLoader)):
        if isinstance(e, (yaml.StreamStartEvent, yaml.DocumentStartEvent)):
            continue
        if isinstance(e, (yaml.DocumentEndEvent, yaml.StreamEndEvent)):
            return
        if isinstance(e, yaml.AliasEvent):
            if e.anchor not in recorded:
                raise Refused(f"unknown alias {e.anchor}")
            step = recorded[e.anchor]
        else:
            step = [e]
            if isinstance(e, yaml.NodeEvent) and e.anchor:
                open_ones.append([e.anchor, [], 0])
        for x in step:
            if isinstance(e, yaml.AliasEvent):
                used += 1
                out += len(x.value.encode()) if isinstance(x, yaml.ScalarEvent) else 0
            for one in open_ones:
                one[1].append(x)
                used += 1
            if used > units or out > replayed:
                raise Refused("aliases repeat more than the file's budget")
            yield x
        change = 1 if isinstance(e, yaml.CollectionStartEvent) else -1 if isinstance(e, yaml.CollectionEndEvent) else 0
        for one in list(open_ones):
            one[2] += change
            if one[2] == 0:
                recorded[one[0]] = one[1]
                open_ones.remove(one)


def first_document(text: str) -> _Node | None:
    """The first document's tree; None for an empty stream."""
    if yaml is None:
        raise Refused("no YAML parser")
    events = _events(text)

    def build(e, depth: int) -> _Node:
        if depth > DEPTH:
            raise Refused("nested too deep")
        if isinstance(e, yaml.ScalarEvent):
            return _Node("scalar", e.value, bool(e.implicit[0]), e.tag)
        parts = []
        while not isinstance(x := next(events), yaml.CollectionEndEvent):
            parts.append(build(x, depth + 1))
        if isinstance(e, yaml.SequenceStartEvent):
            return _Node("seq", parts, tag=e.tag)
        return _Node("map", list(zip(parts[::2], parts[1::2], strict=True)), tag=e.tag)

    try:
        first = next(events, None)
        return None if first is None else build(first, 0)
    except yaml.YAMLError as e:
        raise Refused(str(e)) from e


@cache
def _resolver():
    """Tells a plain scalar's kind; it keeps nothing between scalars, so one does for all."""
    return yaml.SafeLoader("")


def _scalar(node: _Node) -> str | None:
    """A scalar as a property's text; None for null and tagged values."""
    if node.tag and not node.tag.startswith("tag:yaml.org,2002:"):
        return None
    if not node.plain:
        return node.value
    kind = _resolver().resolve(yaml.ScalarNode, node.value, (True, False))
    if kind == "tag:yaml.org,2002:null":
        return None
    if kind == "tag:yaml.org,2002:bool":
        return node.value.lower() if node.value.lower() in ("true", "false") else node.value
    return node.value


def _text(node: _Node) -> str | None:
    """A node as a key: its text if it is a string."""
    if node.kind != "scalar":
        return None
    kind = _resolver().resolve(yaml.ScalarNode, node.value, (True, False)) if node.plain else "tag:yaml.org,2002:str"
    return node.value if kind == "tag:yaml.org,2002:str" or node.value.lower() in ("on", "off", "yes", "no", "y", "n") else None


def properties(text: str) -> list[tuple[str, str]]:
    """(dotted key, value) of strings, numbers and truth values of the first document; lists and nulls are left out."""
    budget, used, out = max(len(text.encode()) * OUTPUT_PER_BYTE, FLOOR), 0, []

    def walk(node: _Node, prefix: str) -> None:
        nonlocal used
        if node.kind == "map":
            seen = set()
            for k, v in node.value:
                if k.kind == "scalar" and k.value in seen:
                    raise Refused(f"key {k.value} is there twice")
                seen.add(k.value if k.kind == "scalar" else id(k))
                key = _text(k)
                if key is not None:
                    walk(v, f"{prefix}.{key}" if prefix else key)
        elif node.kind == "scalar" and (value := _scalar(node)) is not None:
            used += len(prefix.encode()) + len(value.encode())
            if used > budget:
                raise Refused("flattened properties are over the file's budget")
            out.append((prefix, value))

    tree = first_document(text)
    if tree is not None:
        walk(tree, "")
    return out


def _child(node: _Node | None, name: str) -> _Node | None:
    if node is None or node.kind != "map":
        return None
    return next((v for k, v in node.value if _text(k) == name), None)


def _keys(node: _Node | None) -> list[str]:
    return [t for k, _ in node.value if (t := _text(k)) is not None] if node is not None and node.kind == "map" else []


def _line(lines: list[str], name: str, start: int, end: int | None = None) -> int | None:
    """1-based line from ``start`` on whose key or list item is ``name``."""
    for n in range(start, min(len(lines), end - 1 if end else len(lines)) + 1):
        head = lines[n - 1].strip().lstrip("-").strip()
        bare = head.split(":", 1)[0] if not head.startswith(("'", '"', "/")) else head
        if bare.strip("'\" ") == name or any(head.startswith(q + name + q) for q in ("'", '"')) or head.startswith(f"{name}:") or head == name:
            return n
    return None


def contracts(path: str, text: str, infer_topics: bool = False, async_files: tuple[str, ...] = (), open_files: tuple[str, ...] = ()) -> list[dict]:
    """Nodes of a specification: an event stream for each channel (a producer of it), an endpoint for each path and method."""
    low = path.lower()
    named = lambda files: any(low == f.lower() or low.endswith("/" + f.lower()) for f in files)
    is_async = named(async_files) if async_files else "asyncapi" in low or "asyncapi:" in text
    is_open = named(open_files) if open_files else "openapi" in low or "openapi:" in text or "swagger:" in text
    if not (is_async or is_open):
        return []
    tree, lines, out = first_document(text), text.split("\n"), []

    def node(name: str, kind: str, package: str, line: int, signature: str, topic: str | None = None) -> None:
        out.append({"name": name, "kind": kind, "package": package, "line_start": line, "line_end": line, "signature": signature, "topic": topic})

    if is_async:
        at = _line(lines, "channels", 1) or 1
        for name in _keys(_child(tree, "channels")):
            at = _line(lines, name, at) or at
            node(name, "event_stream", "asyncapi", at, f"channel {name}", name)
        topics = _child(tree, "topics") if infer_topics else None
        at = _line(lines, "topics", 1) or 1
        for item in topics.value if topics is not None and topics.kind == "seq" else []:
            if (name := _text(item)) is not None:
                at = _line(lines, name, at) or at
                node(name, "event_stream", "asyncapi", at, f"inferred topic {name}", name)
    if is_open:
        paths = _child(tree, "paths")
        found, at = [], _line(lines, "paths", 1) or 1
        for name in _keys(paths):
            own = _line(lines, name, at + 1)
            found.append((name, own))
            at = own or at
        for k, (name, own) in enumerate(found):
            end = next((x for _, x in found[k + 1 :] if x), None)
            for method in _keys(_child(paths, name)):
                line = (_line(lines, method, own, end) if own else None) or own or 1
                label = f"{method.upper()} {name}"
                node(label, "http_endpoint", "openapi", line, label)
    return out


PROPERTIES = "source string, key string, raw_value string, failed boolean"
CONTRACTS = "file_path string, repo_id int, local int, name string, kind string, package string, line_start int, line_end int, signature string, topic string, failed boolean"


def yaml_properties(texts: DataFrame) -> DataFrame:
    """Properties of (source, text); a refused file is one row with ``failed``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for source, text in zip(b["source"], b["text"], strict=True):
                try:
                    rows += [(source, k, v, False) for k, v in properties(text)]
                except Refused:
                    rows.append((source, None, None, True))
            yield pd.DataFrame(rows, columns=["source", "key", "raw_value", "failed"])

    return texts.where("text is not null").select("source", "text").mapInPandas(run, PROPERTIES)


def yaml_contracts(files: DataFrame, infer_topics: bool = False) -> DataFrame:
    """Contract nodes of (path, repo_id, text)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in CONTRACTS.split(", ")]
        for b in batches:
            rows = []
            for path, repo, text in zip(b["path"], b["repo_id"], b["text"], strict=True):
                base = {"file_path": path, "repo_id": repo, "failed": False}
                try:
                    rows += [base | {"local": k} | n for k, n in enumerate(contracts(path, text, infer_topics))]
                except Refused:
                    rows.append(base | {"failed": True})
            frame = pd.DataFrame(rows, columns=names, dtype=object)
            yield frame.where(frame.notna(), None)

    return files.where("text is not null").select("path", "repo_id", "text").mapInPandas(run, CONTRACTS)
