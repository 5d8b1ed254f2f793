"""Project files: manifests and package identity, import aliases, submodules, the engine's own configuration."""

from __future__ import annotations

import json
import os
import posixpath
import re
import tomllib
from collections.abc import Callable, Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Names of manifests in order of preference for a name, further build files, and folders by role (fixed values).
NAMED_MANIFESTS = ("go.mod", "package.json", "Cargo.toml", "pyproject.toml")
MANIFESTS = (*NAMED_MANIFESTS, "pom.xml", "build.gradle", "build.gradle.kts", "Pipfile", "setup.py", "Gemfile", "composer.json", "Package.swift")
CONTAINERS = ("services", "apps", "packages", "modules", "crates", "libs", "subprojects", "projects")
TECHNICAL = ("src", "lib", "cmd", "pkg", "internal", "proto", "api", "test", "tests")
MANIFEST_BYTES, WALK, EXTENDS = 64 * 1024, 32, 8
CONFIG_NAMES = (".agents/weftline.toml", "weftline.toml")


def parse_jsonc(text: str):
    """JSON with comments and commas before a closing bracket; None where it is not that."""
    token = re.compile(r'"(?:[^"\\]|\\.)*"|//[^\n]*|/\*.*?\*/', re.S)
    plain = token.sub(lambda m: m[0] if m[0].startswith('"') else " ", text.lstrip("﻿"))
    comma = re.compile(r'"(?:[^"\\]|\\.)*"|,(?=\s*[\]}])')
    try:
        return json.loads(comma.sub(lambda m: m[0] if m[0].startswith('"') else "", plain))
    except ValueError:
        return None


def declared_name(file: str, text: str) -> str | None:
    """The name that a manifest declares."""
    if len(text.encode()) > MANIFEST_BYTES:
        return None
    try:
        if file == "go.mod":
            found = re.search(r"^\s*module (.*)$", text, re.M)
            return found[1].strip().rsplit("/", 1)[-1] or None if found else None
        if file == "package.json":
            name = json.loads(text).get("name")
            return name.rsplit("/", 1)[-1] or None if isinstance(name, str) else None
        data = tomllib.loads(text)
        if file == "Cargo.toml":
            name = data.get("package", {}).get("name")
        else:
            name = data.get("project", {}).get("name") or data.get("tool", {}).get("poetry", {}).get("name")
        return name if isinstance(name, str) and name else None
    except (ValueError, AttributeError):
        return None


def manifest_names(files: DataFrame) -> DataFrame:
    """(dir, name) of every folder with a manifest: the declared name, else the folder's.  files: path, text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            at = b["path"].str.rsplit("/", n=1)
            rows = [(p[0], NAMED_MANIFESTS.index(p[1]), n) for p, t in zip(at, b["text"], strict=True) if p[-1] in NAMED_MANIFESTS and t and (n := declared_name(p[-1], t))]
            yield pd.DataFrame(rows, columns=["dir", "rank", "name"])

    name = F.element_at(F.split("path", "/"), -1)
    folder = F.regexp_replace("path", "/?[^/]*$", "")
    there = files.where(name.isin(*MANIFESTS)).select(folder.alias("dir")).distinct()
    named = files.where(name.isin(*NAMED_MANIFESTS)).select("path", "text").mapInPandas(run, "dir string, rank int, name string")
    best = named.groupBy("dir").agg(F.min_by("name", "rank").alias("declared"))
    rows = there.join(best, "dir", "left").select("dir", F.coalesce("declared", F.nullif(F.element_at(F.split("dir", "/"), -1), F.lit(""))).alias("name"))
    return rows.where("name is not null")


def packages(files: DataFrame, manifests: DataFrame) -> DataFrame:
    """(path, package): the declared package unless it is generic, else the nearest manifest's name, else the folder
    below a container folder, else the nearest folder that is not merely technical, else ``shared``.

    files: path, declared (may be null); manifests: dir, name.  Ancestor folders meet manifests by an equi-join.
    """
    parts = F.split(F.regexp_replace("path", "/?[^/]*$", ""), "/")
    rows = files.select("path", F.trim("declared").alias("declared"), parts.alias("parts"))
    up = F.transform(F.sequence(F.size("parts"), F.greatest(F.lit(1), F.size("parts") - WALK + 1)), lambda n: F.array_join(F.slice("parts", 1, n), "/"))
    dirs = rows.select(F.array_join("parts", "/").alias("folder"), F.explode(up).alias("dir")).distinct().join(manifests, "dir")
    nearest = dirs.groupBy("folder").agg(F.max_by("name", F.length("dir")).alias("manifest"))
    rows = rows.withColumn("folder", F.array_join("parts", "/")).join(nearest, "folder", "left")
    back = F.reverse("parts")
    held = F.filter(F.transform(back, lambda x, i: F.when(F.get(back, i + 1).isin(*CONTAINERS), x)), lambda x: x.isNotNull())
    plain = F.filter(back, lambda x: (x != "") & ~x.isin(*TECHNICAL))
    own = F.when((F.col("declared") != "") & (F.col("declared") != "main"), F.col("declared"))
    return rows.select("path", F.coalesce(own, "manifest", F.get(held, F.lit(0)), F.get(plain, F.lit(0)), F.lit("shared")).alias("package"))


def alias_layer(path: str, read: Callable[[str], str | None], jail: str, depth: int = 0) -> dict | None:
    """base_url and paths of a compiler configuration with what it extends (relative ones, eight deep; later ones
    and its own options win), read through ``read`` and only below ``jail``."""
    path = posixpath.normpath(path)
    if depth > EXTENDS or not path.startswith(jail.rstrip("/") + "/"):
        return None
    text = read(path)
    data = parse_jsonc(text) if text is not None else None
    if not isinstance(data, dict):
        return None
    folder, layer = posixpath.dirname(path), {"base_url": None, "paths": None}
    extends = data.get("extends")
    for spec in [extends] if isinstance(extends, str) else extends if isinstance(extends, list) else []:
        if not isinstance(spec, str) or spec[:1] not in (".", "/"):
            continue
        named = posixpath.normpath(posixpath.join(folder, spec))
        tries = (named, named + ".json", named + "/tsconfig.json")
        inherited = alias_layer(next((t for t in tries if read(t) is not None), named), read, jail, depth + 1)
        layer |= {k: v for k, v in (inherited or {}).items() if v is not None}
    options = data.get("compilerOptions")
    if isinstance(options, dict):
        if isinstance(options.get("baseUrl"), str):
            layer["base_url"] = posixpath.normpath(posixpath.join(folder, options["baseUrl"]))
        if isinstance(options.get("paths"), dict):
            layer["paths"] = (folder, {k: [t for t in v if isinstance(t, str)] for k, v in sorted(options["paths"].items()) if isinstance(v, list)})
    return layer


def alias_rules(configs: Mapping[str, str], jail: str) -> list[tuple[str, str, str]]:
    """(dir, prefix, replacement) of every configuration, for ``resolve.rewrite_aliases``: the first target of each
    pattern, relative to the configuration's folder; catch-all patterns are left out.  configs: path -> text."""
    out = []
    for path, text in sorted(configs.items()):
        folder, file = posixpath.split(path)
        if file == "package.json":
            imports = (parse_jsonc(text) or {}).get("imports")
            entries = {k: v for k, v in imports.items() if isinstance(v, str)} if isinstance(imports, dict) else {}
            rules = [(k, posixpath.normpath(posixpath.join(folder, v))) for k, v in entries.items()]
        else:
            layer = alias_layer(path, configs.get, jail) or {}
            if not layer.get("paths"):
                continue
            base = layer.get("base_url") or layer["paths"][0]
            rules = [(k, posixpath.normpath(posixpath.join(base, v[0]))) for k, v in layer["paths"][1].items() if v]
        for pattern, target in rules:
            prefix = pattern.split("*", 1)[0]
            if prefix and target.startswith(jail):
                out.append((folder, prefix, posixpath.relpath(target.split("*", 1)[0] or "/", folder) + ("/" if target.split("*", 1)[0].endswith("/") else "")))
    return out


def submodules(text: str) -> list[tuple[str, str]]:
    """(path, url) of a ``.gitmodules`` text."""
    out, path, url = [], None, None
    for line in [*text.split("\n"), "["]:
        if line.strip().startswith("["):
            if path and url:
                out.append((path, url))
            path = url = None
        elif m := re.match(r"\s*(path|url)\s*=\s*(.*?)\s*$", line):
            path, url = (m[2], url) if m[1] == "path" else (path, m[2])
    return out


def locate_config(explicit: str | None = None, folder: str | None = None) -> str | None:
    """The first that exists of the named file and the usual places, absolute."""
    folder = folder or os.getcwd()
    for name in ([explicit] if explicit else []) + list(CONFIG_NAMES):
        path = os.path.abspath(os.path.join(folder, name))
        if os.path.isfile(path):
            return path
    return None


#: Sections of the configuration and their keys.
CONFIG_KEYS = {
    "workspace": {"name", "roots", "exclude", "http_prefix", "http_prefixes", "aliases"}, "docs": {"aliases", "stop_words", "phrase_boost", "sanitize"},
    "contracts": {"patterns", "proto_dirs", "asyncapi_spec_files", "openapi_spec_files", "infer_string_topics"}, "policy": {"stop_rules", "skills"}, "audit": {"path"},
}


def load_config(path: str | None) -> dict:
    """A configuration file's sections; unknown sections and keys are errors; without a file the defaults."""
    if path is None:
        return {}
    with open(path, "rb") as f:
        data = tomllib.load(f)
    for section, body in data.items():
        unknown = {section} - CONFIG_KEYS.keys() or set(body) - CONFIG_KEYS[section]
        if unknown:
            raise ValueError(f"unknown configuration: {', '.join(sorted(unknown))}")
    return data


def health_checks(config: dict, roots: Sequence[str]) -> list[tuple[str, bool, str]]:
    """(check, good, detail): roots that exist, and prefix keys that name none of them."""
    from weftline.operators.roots import unmatched_keys

    out = [("root", os.path.isdir(r), r) for r in roots]
    lost = unmatched_keys(config.get("workspace", {}).get("http_prefixes", {}), roots)
    return [*out, ("http_prefixes", not lost, ", ".join(lost))]
