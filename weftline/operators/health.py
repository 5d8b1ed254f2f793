"""Files that did not make it into an index: lists, counts, notes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Reasons in the order in which they are reported, with their labels, and limits (fixed values).
REASONS = {"oversized": "oversized", "binary": "binary (null byte)", "long_line": "long line", "nesting": "deep nesting", "read_error": "read error"}
MAX_REJECTED, NOTE_FILES, NOTE_BYTES, NOTE_TAIL = 10_000, 20, 2048, 160


def human_size(n: Column) -> Column:
    """``512 B``, ``4.2 KB``, ``1.2 MB``."""
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1 << 20, F.format_string("%.1f KB", n / 1024)).otherwise(F.format_string("%.1f MB", n / (1 << 20)))


def describe(reason: Column, size: Column, detail: Column) -> Column:
    label = F.create_map(*[F.lit(x) for kv in REASONS.items() for x in kv])[reason]
    return (
        F.when(reason == "oversized", F.concat(F.lit("oversized, "), human_size(size))).when(reason == "binary", F.lit(REASONS["binary"]))
        .when((reason == "long_line") & detail.isNotNull(), F.concat(F.lit("long line (longest "), human_size(detail), F.lit(")")))
        .when((reason == "nesting") & detail.isNotNull(), F.concat(F.lit("deep nesting (depth "), detail.cast("string"), F.lit(")")))
        .otherwise(F.concat(F.coalesce(label, reason), F.lit(", "), human_size(size)))
    )


def normalize(rejected: DataFrame, most: int = MAX_REJECTED) -> DataFrame:
    """One row per path, the last recorded, the first ``most`` by path.  rejected: path, reason, size, detail, recorded."""
    w = Window.partitionBy("path").orderBy(F.desc("recorded"))
    last = rejected.withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")
    return last.orderBy("path").limit(most)


def overflow(rejected: DataFrame, before: int = 0, most: int = MAX_REJECTED) -> Column:
    """Paths beyond the list: a high-water mark, as a scalar."""
    n = rejected.agg(F.countDistinct("path")).scalar()
    return F.greatest(F.lit(before), n - most, F.lit(0))


def replace(rejected: DataFrame, touched: DataFrame, fresh: DataFrame) -> DataFrame:
    """The list after a pass: touched paths lose their entry, this pass's rejections are added.  touched: path."""
    kept = rejected.join(touched.select("path").distinct(), "path", "left_anti")
    return normalize(kept.unionByName(fresh.select(*kept.columns)))


def changed(before: DataFrame, after: DataFrame) -> Column:
    """Whether two lists differ, as a scalar."""
    columns = [c for c in before.columns if c != "recorded"]
    a, b = before.select(*columns), after.select(*columns)
    return a.exceptAll(b).unionByName(b.exceptAll(a)).agg(F.count(F.lit(1)) > 0).scalar()


def retain(rejected: DataFrame, crawled: DataFrame) -> DataFrame:
    """Entries of paths that are still there."""
    return rejected.join(crawled.select("path").distinct(), "path", "left_semi")


def unchanged_rejects(files: DataFrame, rejected: DataFrame) -> DataFrame:
    """Files that were refused with the same time and size: not read again.  both: path, mtime, size."""
    known = rejected.select("path", "mtime", "size").distinct()
    return files.join(known, ["path", "mtime", "size"], "left_semi")


def matching(rejected: DataFrame, scope: Column) -> DataFrame:
    """Entries inside a scope (a predicate), in path order."""
    return rejected.where(scope).orderBy("path")


def totals(counters: DataFrame) -> DataFrame:
    """Counters of several passes added up, plus rejected: files refused or unreadable (parse failures are not)."""
    names = ("scanned", "indexed", "oversized", "guard", "read_error", "parse_failed", "non_source")
    sums = counters.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in names])
    return sums.withColumn("rejected", F.col("oversized") + F.col("guard") + F.col("read_error"))


def note_lines(rejected: DataFrame, files: int = NOTE_FILES, most: int = NOTE_BYTES) -> DataFrame:
    """(path, line, shown): the lines of a note in path order; shown while they fit the note's files and bytes.

    Only the first ``files`` entries are ordered (a top-n), and only they can be shown.
    """
    line = F.concat(F.lit("> - `"), F.replace("path", F.lit("`"), F.lit("'")), F.lit("`: "), describe(F.col("reason"), F.col("size"), F.col("detail")), F.lit("\n"))
    top = rejected.orderBy("path").limit(files).withColumn("line", line)
    w = Window.orderBy("path")  # at most ``files`` rows
    fits = F.sum(F.octet_length("line")).over(w) + NOTE_TAIL <= most
    return top.withColumn("fits", fits).withColumn("shown", F.min(F.col("fits").cast("int")).over(w) == 1).select("path", "line", "shown")


def scope_note(rejected: DataFrame) -> str | None:
    """The note of files that a search could not look into; None where there are none.  Collects 20 rows at most."""
    total = rejected.count()
    if not total:
        return None
    head = f"\n> [!WARNING]\n> **{total} file(s) in this scope are not indexed**, so the results above cannot include them.\n"
    rows = note_lines(rejected, most=NOTE_BYTES - len(head.encode())).orderBy("path").collect()
    shown = [r["line"] for r in rows if r["shown"]]
    rest = f"> - …and {total - len(shown)} more\n" if total > len(shown) else ""
    return head + "".join(shown) + rest


def summary_text(counters: DataFrame, rejected: DataFrame, paths: int = 10) -> str:
    """The health report: totals, counts by reason in their order, the first paths."""
    t = totals(counters).first()
    count = {r["reason"]: r["n"] for r in rejected.groupBy("reason").agg(F.count(F.lit(1)).alias("n")).collect()}
    out = [f"{t['scanned']} file(s) scanned, {t['indexed']} indexed, {sum(count.values())} not indexed"]
    if t["non_source"]:
        out.append(f"    ({t['non_source']} non-source file(s) skipped)")
    out += [f"    {label}: {count[r]}" for r, label in REASONS.items() if count.get(r)]
    rows = rejected.orderBy("path").limit(paths).select("path", describe(F.col("reason"), F.col("size"), F.col("detail")).alias("d")).collect()
    out += [f"    - {r['path']} ({r['d']})" for r in rows]
    more = sum(count.values()) - len(rows)
    return "\n".join(out + ([f"    - …and {more} more"] if more > 0 else []))


def changed_patterns(old: Sequence[dict], new: Sequence[dict]) -> list[dict]:
    """Patterns on one side only, as multisets; if only the order differs, all of the new ones."""
    if list(old) == list(new):
        return []
    left, added = list(old), []
    for p in new:
        if p in left:
            left.remove(p)
        else:
            added.append(p)
    return left + added or list(new)


def reload_plan(old: dict, new: dict, old_roots: Sequence[str], new_roots: Sequence[str]) -> tuple[str, list[dict]]:
    """What a changed configuration asks for: display (nothing is indexed anew), partial (some patterns) or full.

    Display settings are the keys ``display``, ``docs`` and ``policy``; custom patterns are ``patterns``.
    """
    inputs = lambda c: {k: v for k, v in c.items() if k not in ("display", "docs", "policy", "patterns", "http_prefix", "http_prefixes", "name")}
    if list(old_roots) != list(new_roots) or inputs(old) != inputs(new):
        return "full", []
    patterns = changed_patterns(old.get("patterns", []), new.get("patterns", []))
    return ("partial", patterns) if patterns else ("display", [])
