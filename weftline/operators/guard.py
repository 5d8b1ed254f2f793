"""Admission of files: size, binary, line length and nesting; secrets; properties."""

from __future__ import annotations

import re
import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline import schema
from weftline.functions import text as T

REASONS = ("oversized", "binary", "long_line", "nesting")
REDACTED = "[REDACTED_SECRET: USE_ENV_OR_LOCAL_FALLBACK]"


def size_budget(path: Column) -> Column:
    contract = path.rlike(r"(?i)\.proto$|(?:^|/)[^/]*(?:openapi|swagger|asyncapi)[^/]*\.(?:ya?ml|json)$|\.(?:graphql|gql)$")
    return F.when(contract, schema.CONTRACT_BYTES).otherwise(schema.SOURCE_BYTES)


def nesting_depth(text: Column) -> Column:
    """Deepest bracket nesting outside quotes, by a fold over the brackets only."""
    bare = F.regexp_replace(text, r"\x22(?:[^\x22\\\n]|\\.)*+\x22|'(?:[^'\\\n]|\\.)*+'|//[^\n]*+", "")
    marks = F.regexp_extract_all(bare, F.lit(r"[\[\](){}]"), F.lit(0))
    step = lambda acc, x: F.struct(
        F.greatest(F.lit(0), acc["d"] + F.when(x.isin("(", "[", "{"), 1).otherwise(-1)).alias("d"),
        F.greatest(acc["m"], acc["d"] + F.when(x.isin("(", "[", "{"), 1).otherwise(0)).alias("m"),
    )
    return F.aggregate(marks, F.struct(F.lit(0).alias("d"), F.lit(0).alias("m")), step, lambda acc: acc["m"])


def verdict(text: Column, path: Column | None = None, max_bytes: int = schema.SOURCE_BYTES) -> Column:
    """The first reason to refuse a file, null to admit it."""
    budget = F.lit(max_bytes) if path is None else size_budget(path)
    longest = F.array_max(F.transform(F.split(text, "\n"), lambda x: F.octet_length(x)))
    return (
        F.when(F.octet_length(text) > budget, "oversized")
        .when(F.locate("\x00", F.substring(text, 1, schema.SNIFF_BYTES)) > 0, "binary")
        .when(longest > schema.LINE_BYTES, "long_line")
        .when(nesting_depth(text) > schema.NESTING, "nesting")
    )


def summary(status: DataFrame) -> DataFrame:
    """Count per reason.  status: reason (null: admitted)."""
    return status.groupBy(F.coalesce("reason", F.lit("indexed")).alias("reason")).agg(F.count(F.lit(1)).alias("files"))


ASSIGNMENT = r"([A-Za-z_][A-Za-z0-9_.-]*)\s*[:=]\s*\x22([^\x22\n]+)\x22"


def secret_lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, line_no, key, redacted): lines that assign a quoted value to a secret-looking key."""
    lines = docs.where(F.col(text_col).rlike(ASSIGNMENT)).select(id_col, F.posexplode(F.split(text_col, "\n")).alias("at", "line"))
    key = F.regexp_extract("line", ASSIGNMENT, 1)
    hit = lines.withColumn("key", key).where((F.col("key") != "") & T.is_sensitive_key(F.col("key")))
    shown = F.regexp_replace("line", ASSIGNMENT, f'$1 = "{REDACTED}"')
    return hit.select(id_col, (F.col("at") + 1).alias("line_no"), "key", shown.alias("redacted"))


def parse_properties(texts: DataFrame) -> DataFrame:
    """(key, raw_value, source) of ``.properties`` texts: ``=`` first, else ``:``; # and ! comment.  texts: source, text."""
    lines = texts.select("source", F.posexplode(F.split("text", r"\r?\n")).alias("at", "line")).where(~F.trim("line").rlike("^[#!]|^$"))
    cut = F.when(F.contains("line", F.lit("=")), F.instr("line", "=")).otherwise(F.instr("line", ":"))
    rows = lines.withColumn("cut", cut).where("cut > 0")
    rows = rows.select("source", "at", F.trim(F.expr("substring(line, 1, cut - 1)")).alias("key"), F.trim(F.expr("substring(line, cut + 1)")).alias("raw_value"))
    return rows.groupBy("key").agg(F.max_by(F.struct("raw_value", "source"), F.struct("source", "at")).alias("x")).select("key", "x.raw_value", "x.source")


def resolve_placeholders(properties: DataFrame) -> DataFrame:
    """(key, value): every ``${name:default}`` replaced once by the raw value of ``name``, else its default; secrets masked."""
    parts = F.split("raw_value", r"\$\{[^}]*\}", -1)
    refs = F.regexp_extract_all("raw_value", F.lit(r"\$\{([^}]*)\}"), F.lit(1))
    rows = properties.select("key", "raw_value", parts.alias("parts"), refs.alias("refs"))
    each = rows.select("key", F.posexplode("refs").alias("at", "ref"))
    each = each.select("key", "at", F.regexp_extract("ref", "^([^:]*)", 1).alias("name"), F.regexp_extract("ref", "^[^:]*:(.*)$", 1).alias("default"), F.contains("ref", F.lit(":")).alias("has_default"), "ref")
    known = properties.select(F.col("key").alias("name"), F.when(T.is_sensitive_key(F.col("key")), F.lit(REDACTED)).otherwise(F.col("raw_value")).alias("found"))
    each = each.join(known, "name", "left").withColumn("text", F.coalesce("found", F.when(F.col("has_default"), F.col("default")), F.concat(F.lit("${"), "ref", F.lit("}"))))
    filled = each.groupBy("key").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "text"))), lambda x: x["text"]).alias("texts"))
    rows = rows.join(filled, "key", "left")
    value = F.concat(F.element_at("parts", 1), F.array_join(F.coalesce(F.zip_with("texts", F.slice("parts", F.lit(2), F.size("parts")), lambda a, b: F.concat(a, b)), F.expr("CAST(array() AS array<string>)")), ""))
    return rows.select("key", F.when(T.is_sensitive_key(F.col("key")), F.lit(REDACTED)).otherwise(value).alias("value"))


def redacted_count(values: DataFrame) -> DataFrame:
    """redacted: how many resolved values are masked.  values: key, value."""
    return values.agg(F.count_if(F.col("value") == REDACTED).alias("redacted"))


def valid_patterns(patterns: list[dict]) -> list[dict]:
    """The patterns whose expression compiles; the others are left out with a warning."""
    out = []
    for p in patterns:
        try:
            re.compile(p["regex"])
            out.append(p)
        except re.error as e:
            warnings.warn(f"pattern {p['name']}: {e}", stacklevel=2)
    return out


def _with_lines(text: Column, regex: str, group: int) -> Column:
    """array<struct<target, line>> of all matches: pieces between matches are only counted for their line ends."""
    hits = F.regexp_extract_all(text, F.lit(regex), F.lit(group))
    whole = F.regexp_extract_all(text, F.lit(regex), F.lit(0))
    ends = lambda parts: F.transform(parts, lambda x: F.regexp_count(x, F.lit("\n")))
    # line of a match: line ends in the pieces and matches before it
    steps = F.arrays_zip(F.slice(ends(F.split(text, regex, -1)), F.lit(1), F.size(hits)).alias("gap"), ends(whole).alias("own"), hits.alias("target"))
    start = F.expr("struct(1 AS line, CAST(array() AS array<struct<target:string,line:int>>) AS out)")

    def step(acc: Column, x: Column) -> Column:
        line = acc["line"] + x["gap"]
        return F.struct((line + x["own"]).alias("line"), F.concat(acc["out"], F.array(F.struct(x["target"].alias("target"), line.alias("line")))).alias("out"))

    return F.aggregate(steps, start, step, lambda acc: acc["out"])


def in_scope(path: Column, suffix_or_part: str | None) -> Column:
    """Whether a pattern's file scope (a suffix or a part of the path) takes a path; without a scope all."""
    if not suffix_or_part:
        return F.lit(True)
    return F.endswith(path, F.lit(suffix_or_part)) | F.contains(path, F.lit(suffix_or_part))


def _hit(p: dict):
    fixed = [F.lit(p["name"]).alias("name"), F.lit(p["kind"]).alias("kind")]
    confidence = F.lit(p.get("confidence", "heuristic")).alias("confidence")
    return lambda x: F.struct(*fixed, x["target"].alias("target"), x["line"].alias("line"), confidence)


def custom_patterns(docs: DataFrame, patterns: list[dict], id_col: str, text_col: str, path_col: str | None = None) -> DataFrame:
    """(id, name, kind, target, line, confidence): user-declared extractors.

    Each is {name, kind, regex, group, file, confidence}.  One scan of the table whatever the number of
    patterns: matches and their lines are found inside the row, and only these are exploded.
    """
    found = []
    for p in valid_patterns(patterns):
        applies = F.col(text_col).rlike(p["regex"])
        if path_col:
            applies = applies & in_scope(F.col(path_col), p.get("file"))
        own = F.transform(_with_lines(F.col(text_col), p["regex"], p.get("group", 1)), _hit(p))
        found.append(F.when(applies, own).otherwise(F.expr("CAST(array() AS array<struct<name:string,kind:string,target:string,line:int,confidence:string>>)")))
    rows = docs.select(F.col(id_col).alias("id"), F.explode(F.concat(*found) if found else F.expr("CAST(array() AS array<struct<name:string,kind:string,target:string,line:int,confidence:string>>)")).alias("x"))
    return rows.select("id", "x.*")


def silent_patterns(hits: DataFrame, patterns: list[dict], spark) -> DataFrame:
    """name: declared patterns that match nothing."""
    names = spark.createDataFrame([(p["name"],) for p in patterns], "name string")
    return names.join(hits.select("name").distinct(), "name", "left_anti")
