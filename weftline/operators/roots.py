"""Roots of a workspace: the root of a path, prefixes per root, suffix look-up, files a configuration governs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions import text as T
from weftline.sources.files import glob_regex

MAX_LISTED = 8


def most_specific_root(path: Column, roots: Sequence[str]) -> Column:
    """Index of the longest root that holds a path; null if none does.  Roots are configuration, a handful."""
    if not roots:
        return F.lit(None).cast("int")
    found = [F.when(T.under(path, F.lit(r.rstrip("/"))), F.struct(F.lit(r.rstrip("/").count("/")).alias("n"), F.lit(-k).alias("k"))) for k, r in enumerate(roots)]
    return -F.array_max(F.array(*found))["k"]


def root_relative_path(path: Column, roots: Sequence[str], hint: Column | None = None) -> Column:
    """``<root index>:<path below it>``; the hinted root counts if it holds the path; a path under no root stays."""
    at = most_specific_root(path, roots)
    if hint is not None:
        own = F.lit(False)
        for k, r in enumerate(roots):
            own = own | ((hint == k) & T.under(path, F.lit(r.rstrip("/"))))
        at = F.when(F.coalesce(own, F.lit(False)), hint).otherwise(at)
    out = path
    for k, r in enumerate(roots):
        size = len(r.rstrip("/"))
        out = F.when(at == k, F.concat(F.lit(f"{k}:"), F.substring(path, size + 2, 1 << 20))).otherwise(out)
    return out


def is_test_node(path: Column, roots: Sequence[str], repo: Column) -> Column:
    """Whether a node is test code, judged below its root: a checkout in a folder ``e2e`` is not all tests."""
    return T.is_test_path(F.regexp_replace(root_relative_path(path, roots, repo), r"^\d+:", ""))


def _relative(root: str, workspace: str | None) -> str:
    inside = workspace and (root == workspace or root.startswith(workspace.rstrip("/") + "/"))
    rel = root[len(workspace.rstrip("/")) :] if inside else root
    return "/".join(p for p in rel.split("/") if p) or "."


def key_specificity(key: str, root: str, workspace: str | None = None) -> tuple[int, int] | None:
    """How tightly a key names a root: (2, length) by name or path, (1, length) by a glob, None if not at all."""
    import re

    key = key.strip()
    while key.startswith("./"):
        key = key[2:]
    key, root = key.rstrip("/"), root.rstrip("/")
    names = (root.rsplit("/", 1)[-1], _relative(root, workspace), root)
    if not key:
        return None
    if key in names:
        return 2, len(key.encode())
    return (1, len(key.encode())) if any(re.fullmatch(glob_regex(key), n) for n in names) else None


def resolve_prefixes(prefixes: Mapping[str, str], roots: Sequence[str], uniform: str | None = None, workspace: str | None = None) -> list[str | None]:
    """HTTP prefix of every root: that of the key that names it most tightly (ties: the first key), else the uniform one."""
    out = []
    for r in roots:
        ranked = [(key_specificity(k, r, workspace), k) for k in sorted(prefixes)]
        best = max((x for x in ranked if x[0]), key=lambda x: x[0], default=None)
        out.append(prefixes[best[1]] if best else uniform)
    return out


def unmatched_keys(prefixes: Mapping[str, str], roots: Sequence[str], workspace: str | None = None) -> list[str]:
    return sorted(k for k in prefixes if not any(key_specificity(k, r, workspace) for r in roots))


def prefix_of(repo: Column, resolved: Sequence[str | None]) -> Column:
    out = F.lit(None).cast("string")
    for k, p in enumerate(resolved):
        if p is not None:
            out = F.when(repo == k, F.lit(p)).otherwise(out)
    return out


def resolve_suffix(files: DataFrame, target: str, canonical: Sequence[str] = ()) -> DataFrame:
    """(status, file_path): proto files that end in the parts of a path.

    bare: a file name alone is never resolved, its namesakes are listed; unique; canonical: the one under a
    canonical folder, with the others as copy; several; none: namesakes as closest.  files: file_path.
    """
    wanted = [p for p in target.split("/") if p not in ("", ".")]
    name = wanted[-1] if wanted else ""
    if len(wanted) < 2:
        same = files.where(F.lower(F.element_at(F.split("file_path", "/"), -1)) == name.lower()) if wanted else files.limit(0)
        return same.distinct().orderBy("file_path").limit(MAX_LISTED).select(F.lit("bare").alias("status"), "file_path")
    tail = "/".join(wanted)
    under = F.lit(False)
    for d in canonical:
        under = under | F.contains(F.concat(F.lit("/"), "file_path"), F.lit("/" + d.strip("/") + "/"))
    found = files.select("file_path").distinct().where(F.endswith(F.concat(F.lit("/"), "file_path"), F.lit("/" + tail))).withColumn("own", under)
    counts = found.agg(F.count(F.lit(1)).alias("n"), F.count_if("own").alias("c"))
    n, c = counts.select("n").scalar(), counts.select("c").scalar()
    status = F.when(n == 1, "unique").when(c == 1, F.when(F.col("own"), "canonical").otherwise("copy")).when((c > 1) & ~F.col("own"), F.lit(None)).otherwise("several")
    hits = found.select(status.alias("status"), "file_path").where("status is not null")
    near = files.select("file_path").distinct().where((F.element_at(F.split("file_path", "/"), -1) == name) & (n == 0))
    return hits.unionByName(near.orderBy("file_path").limit(MAX_LISTED).select(F.lit("closest").alias("status"), "file_path"))


def governed_scripts(changed: DataFrame, tracked: DataFrame, roots: Sequence[str]) -> DataFrame:
    """(repo_id, file_path): tracked scripts that a changed alias configuration governs.

    A package file governs its folder, a compiler configuration its whole root (any other may extend it).
    changed, tracked: file_path.  Scripts meet scopes by an equi-join on their ancestor folders.
    """
    name = F.element_at(F.split("file_path", "/"), -1)
    config = changed.where((name == "package.json") | name.rlike(r"^(?:ts|js)config.*\.json$"))
    root = F.array_join(F.slice(F.split("file_path", "/"), F.lit(1), F.element_at(F.array(*[F.lit(r.rstrip("/").count("/") + 1) for r in roots]), most_specific_root(F.col("file_path"), roots) + 1)), "/")
    scopes = config.select(F.when(name == "package.json", F.regexp_replace("file_path", "/[^/]*$", "")).otherwise(root).alias("scope")).where("scope is not null").distinct()
    scripts = tracked.where(T.extension(F.col("file_path")).isin(*T.SCRIPT_EXTENSIONS))
    parts = F.split("file_path", "/")
    up = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    met = scripts.withColumn("scope", F.explode(up)).join(scopes, "scope", "left_semi").select("file_path").distinct()
    return met.select(most_specific_root(F.col("file_path"), roots).alias("repo_id"), "file_path").where("repo_id is not null")


def expand_roots(found: Sequence[str], prohibited: Sequence[str] = ("/", "/etc", "/usr", "/var", "/root", "/home")) -> list[str]:
    """Listed root folders without repeats, in order; a prohibited one is an error."""
    out: list[str] = []
    for r in found:
        r = r.rstrip("/") or "/"
        if r in prohibited:
            raise ValueError(f"root is not allowed: {r}")
        if r not in out:
            out.append(r)
    return out


def inside(raw: str, roots: Sequence[str], aliases: Mapping[str, str] | None = None, anchor: str | None = None) -> str:
    """A path as an absolute one below a root, after aliases and an anchor folder; an error if it leaves them."""
    import posixpath
    import unicodedata

    path = unicodedata.normalize("NFC", raw)
    head, _, rest = path.partition("/")
    if aliases and head in aliases:
        path = aliases[head].rstrip("/") + ("/" + rest if rest else "")
    if not path.startswith("/"):
        path = posixpath.join(anchor or (roots[0] if roots else "/"), path)
    path = posixpath.normpath(path)
    if not any(path == r.rstrip("/") or path.startswith(r.rstrip("/") + "/") for r in roots):
        raise PermissionError(f"outside of all roots: {raw}")
    return path
