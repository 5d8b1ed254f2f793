"""Cross-site line dedup by distinct-site spread.

A line is compared by its trimmed, lower-cased text (64-bit hash), however short; blank lines are
never boilerplate.  One aggregation per line hash merges HyperLogLog sketches of
the sites it was seen on (map-side partial sketches, so a line on every page costs one sketch per
task).  Estimates outside ``near`` of the threshold decide at once; lines inside it get an exact
distinct count of their sites.  A line on ``min_sites`` sites or more is boilerplate: it stays in
its first document (lowest id) and is cut from all others.

Defined results: null text stays null; blank lines stay; a null site is one site of its own; a
document whose lines are all cut keeps its row with an empty text; the same line twice in its first
document stays twice; rows with equal ids are treated alike (the line stays in all rows of the lowest
id), so ties need no order; very long texts and lines are taken whole; an empty table gives an empty
result; other columns pass through untouched, whatever their names (internal ones start with w_, b_, __).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.store import materialize

MIN_SITES, NEAR, LG_K = 5, 0.3, 12


def line_key(line: Column) -> Column:
    """Hash of the normalised line; null where the line is blank."""
    normal = F.lower(F.trim(line))
    return F.when(normal.rlike(r"[^\x20\x09-\x0D]"), F.xxhash64(normal))


def boilerplate(docs: DataFrame, min_sites: int = MIN_SITES, near: float = NEAR, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source") -> tuple[DataFrame, DataFrame]:
    """(occurrences: w_id, w_site, w_key), (boilerplate lines: b_key, b_first)."""
    lines = docs.where(F.col(text_col).isNotNull()).select(
        F.col(id_col).alias("w_id"),
        F.coalesce(F.concat(F.lit("="), F.col(site_col).cast("string")), F.lit("")).alias("w_site"),
        F.explode_outer(F.split(text_col, "\n")).alias("w_line"),
    )
    seen = materialize(lines.select("w_id", "w_site", line_key(F.col("w_line")).alias("w_key")).where("w_key is not null"), "lines")
    spread = (
        seen.groupBy("w_key")
        .agg(F.hll_sketch_agg("w_site", F.lit(LG_K)).alias("sites"), F.min("w_id").alias("b_first"), F.count(F.lit(1)).alias("n"))
        .where(F.col("n") >= min_sites)
        .select("w_key", "b_first", F.hll_sketch_estimate("sites").alias("est"))
        .where(F.col("est") >= min_sites * (1 - near))
    )
    spread = materialize(spread, "line-spread")
    far = spread.where(F.col("est") > min_sites * (1 + near))
    close = spread.where(F.col("est") <= min_sites * (1 + near))
    exact = (
        seen.join(close.select(F.col("w_key").alias("k")), F.col("w_key") == F.col("k"), "left_semi")
        .groupBy("w_key").agg(F.countDistinct("w_site").alias("sites")).where(F.col("sites") >= min_sites)
    )
    close = close.join(exact.select(F.col("w_key").alias("k")), F.col("w_key") == F.col("k"), "left_semi")
    found = far.unionByName(close).select(F.col("w_key").alias("b_key"), "b_first")
    return seen, found


def dedup_lines(docs: DataFrame, min_sites: int = MIN_SITES, near: float = NEAR, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source") -> DataFrame:
    """All rows and columns of ``docs``, the text without boilerplate lines, plus __cut (their hashes, null if none)."""
    seen, found = boilerplate(docs, min_sites, near, id_col, text_col, site_col)
    cut = (
        seen.join(found, F.col("w_key") == F.col("b_key"))
        .where(F.col("w_id") > F.col("b_first"))
        .groupBy(F.col("w_id").alias("__cut_id")).agg(F.collect_set("w_key").alias("__cut"))
    )
    out = docs.join(cut, docs[id_col] == F.col("__cut_id"), "left").drop("__cut_id")
    lines = F.split(F.col(text_col), "\n")
    kept = F.filter(lines, lambda x: ~F.coalesce(F.array_contains(F.col("__cut"), line_key(x)), F.lit(False)))
    return out.withColumn(text_col, F.when(F.col("__cut").isNull(), F.col(text_col)).otherwise(F.array_join(kept, "\n")))


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_cut, clean_sha256."""
    before = docs.select(F.col("doc_id"), F.col("text"), F.col("source"), F.size(F.split(F.coalesce("text", F.lit("")), "\n")).cast("long").alias("n_lines"))
    out = dedup_lines(before)
    left = F.when(F.col("__cut").isNull(), F.col("n_lines")).when(F.col("text") == "", F.lit(0)).otherwise(F.size(F.split("text", "\n")))
    return out.select("doc_id", "n_lines", (F.col("n_lines") - left).cast("long").alias("n_cut"), F.sha2("text", 256).alias("clean_sha256"))


SQL = rf"""
WITH l AS (SELECT doc_id, coalesce('=' || source, '') AS site, unnest(string_split(text, chr(10))) AS line,
                  generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents WHERE text IS NOT NULL),
k AS (SELECT *, CASE WHEN regexp_matches(lower(trim(line)), '[^\x20\x09-\x0D]') THEN lower(trim(line)) END AS key FROM l),
b AS (SELECT key, min(doc_id) AS first_id FROM k WHERE key IS NOT NULL GROUP BY 1 HAVING count(DISTINCT site) >= {MIN_SITES}),
c AS (SELECT k.doc_id, count(*) AS n_lines, count(*) FILTER (b.key IS NOT NULL AND k.doc_id > b.first_id) AS n_cut,
             coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (b.key IS NULL OR k.doc_id <= b.first_id), '') AS text
      FROM k LEFT JOIN b ON k.key = b.key GROUP BY 1)
SELECT d.doc_id, coalesce(c.n_lines, 1)::BIGINT AS n_lines, coalesce(c.n_cut, 0)::BIGINT AS n_cut, sha256(c.text) AS clean_sha256
FROM documents d LEFT JOIN c ON d.doc_id = c.doc_id
"""
