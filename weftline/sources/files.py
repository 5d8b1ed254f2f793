"""Scans: source trees, and the audit table."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline import schema
from weftline.operators import guard

#: What is not scanned unless configured otherwise (fixed values).
EXCLUDED = (
    "**/.env*", "**/secrets/**", "**/*.pem", "**/*.key", "**/id_rsa*", "**/id_ed25519*", "**/id_ecdsa*", "**/.npmrc", "**/.pypirc",
    "**/.dockercfg", "**/.docker/**", "**/.kube/**", "**/*.jks", "**/*.p12", "**/*.pfx", "**/*.keystore", "**/node_modules/**",
    "**/target/**", "**/build/**", "**/.venv/**", "**/.git/**",
)
#: Language by file extension (fixed values).
LANGUAGES = {
    "proto": "protobuf", "java": "java", "go": "go", "py": "python", "rs": "rust", "kt": "kotlin", "kts": "kotlin", "cs": "csharp",
    "rb": "ruby", "rake": "ruby", "php": "php", "phtml": "php", "swift": "swift", "scala": "scala", "sc": "scala", "ts": "typescript",
    "mts": "typescript", "cts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "mjs": "javascript",
    "cjs": "javascript", "vue": "vue", "svelte": "svelte", "astro": "astro", "cpp": "cpp", "cc": "cpp", "cxx": "cpp", "hpp": "cpp",
    "hh": "cpp", "hxx": "cpp", "h": "cpp", "yaml": "yaml", "yml": "yaml", "properties": "properties", "md": "markdown",
}


def language(path):
    ext = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    return F.element_at(F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv]), ext)


def glob_regex(pattern: str) -> str:
    """Regular expression of a glob over a whole relative path: ``**`` any parts, ``*`` and ``?`` inside one, ``{a,b}``, ``[ab]``."""
    out, k, depth = "", 0, 0
    while k < len(pattern):
        c = pattern[k]
        if pattern.startswith("**/", k) and (k == 0 or pattern[k - 1] == "/"):
            out, k = out + "(?:.*/)?", k + 3
            continue
        if pattern.startswith("**", k) and k + 2 == len(pattern):
            out, k = out + ".*", k + 2
            continue
        if c == "[" and (end := pattern.find("]", k + 2)) > 0:
            out, k = out + "[" + pattern[k + 1 : end].replace("!", "^", 1).replace("\\", "\\\\") + "]", end + 1
            continue
        if c == "{":
            out, depth = out + "(?:", depth + 1
        elif c == "}" and depth:
            out, depth = out + ")", depth - 1
        elif c == "," and depth:
            out += "|"
        else:
            out += "[^/]*" if c == "*" else "[^/]" if c == "?" else re.escape(c)
        k += 1
    return f"^{out}$"


def matches_glob(rel: Column, pattern: str) -> Column:
    return rel.rlike(glob_regex(pattern))


def is_excluded(rel: Column, patterns: Sequence[str] = EXCLUDED, root: Column | None = None) -> Column:
    """Whether a path relative to its root, or that with the root's name in front, matches an exclusion; ``.git`` always does."""
    out = rel.rlike(r"(?:^|/)\.git(?:/|$)")
    for p in patterns:
        out = out | matches_glob(rel, p)
        if root is not None:
            out = out | matches_glob(F.concat(F.element_at(F.split(root, "/"), -1), F.lit("/"), rel), p)
    return out


def path_excluded(path: Column, root: str, patterns: Sequence[str] = EXCLUDED) -> Column:
    """Whether a path is excluded under a root; null for a path that does not lie below it."""
    below = F.startswith(path, F.lit(root.rstrip("/") + "/"))
    return F.when(below, is_excluded(F.substring(path, len(root.rstrip("/")) + 2, 1 << 20), patterns, F.lit(root.rstrip("/"))))


def unmatched_patterns(files: DataFrame, patterns: Sequence[str], rel_col: str = "rel") -> DataFrame:
    """pattern, files: those that no file matches.  One pass; a count per pattern."""
    counts = files.agg(*[F.count_if(matches_glob(F.col(rel_col), p)).alias(f"p{k}") for k, p in enumerate(patterns)])
    rows = F.array(*[F.struct(F.lit(p).alias("pattern"), F.col(f"p{k}").alias("files")) for k, p in enumerate(patterns)])
    return counts.select(F.explode(rows).alias("x")).select("x.*").where("files = 0")


def outer_roots(roots: Sequence[str]) -> list[str]:
    """Roots that lie in no other: listing them lists every file once."""
    clean = sorted({r.rstrip("/") for r in roots})
    return [r for r in clean if not any(r != o and r.startswith(o + "/") for o in clean)]


def crawl(spark: SparkSession, roots: Sequence[str], exclude: Sequence[str] = EXCLUDED, depth: int = 10) -> DataFrame:
    """(repo_id, path, rel, language, length, content) of every file; each belongs to its most specific root.

    Paths are filtered on the path column before the content column is asked for, so what is excluded is listed
    but never read.  Nested roots are listed with the root around them, so no file comes twice.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(outer_roots(roots))
    path = F.regexp_replace("path", "^[a-z]+:/*", "/")
    # roots are configuration, a handful: the longest that contains the path wins
    rank = F.array_max(F.array(*[F.when(F.startswith(path, F.lit(r.rstrip("/") + "/")), F.struct(F.lit(len(r)).alias("n"), F.lit(k).alias("repo"), F.lit(r.rstrip("/")).alias("root"))) for k, r in enumerate(roots)]))
    rows = files.select(path.alias("path"), "length", "content", rank.alias("r")).where("r is not null")
    rows = rows.withColumn("rel", F.expr("substring(path, length(r.root) + 2)"))
    parts = F.split("rel", "/")
    rows = rows.where(~is_excluded(F.col("rel"), exclude, F.col("r.root")) & (F.size(parts) <= depth))
    return rows.select(F.col("r.repo").cast("int").alias("repo_id"), "path", "rel", language(F.col("path")).alias("language"), "length", "content")


def admitted(files: DataFrame) -> DataFrame:
    """``files`` plus text and reason (null: admitted)."""
    rows = files.withColumn("text", F.when(F.col("length") <= schema.CONTRACT_BYTES, F.try_validate_utf8(F.col("content").cast("string"))))
    reason = F.when(F.col("length") > schema.CONTRACT_BYTES, "oversized").when(F.col("text").isNull(), "binary").otherwise(guard.verdict(F.col("text"), F.col("path")))
    return rows.withColumn("reason", reason)


def doc_sections(texts: DataFrame) -> DataFrame:
    """Heading sections of Markdown texts (file_path, text): title, level, lines, content; text before a heading has level 0."""
    lines = texts.select("file_path", F.posexplode(F.split(F.regexp_replace("text", r"\r?\n$", ""), r"\r?\n")).alias("at", "line"))
    from pyspark.sql import Window

    w = Window.partitionBy("file_path").orderBy("at")
    mark = F.length(F.regexp_extract("line", r"^\s*(#{1,6}) ", 1))
    lines = lines.withColumn("level", mark).withColumn("n", F.sum(F.when(mark > 0, 1).otherwise(0)).over(w))
    return lines.groupBy("file_path", "n").agg(
        F.max("level").alias("level"),
        F.min_by(F.when(F.col("level") > 0, F.trim(F.regexp_replace("line", r"^\s*#{1,6} ", ""))).otherwise(F.lit("")), "at").alias("title"),
        (F.min("at") + 1).alias("start_line"), (F.max("at") + 1).alias("end_line"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "line"))), lambda x: x["line"]), "\n").alias("content"),
    ).drop("n")
