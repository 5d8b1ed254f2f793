"""Change data capture by content signatures, and batch twins of the debounced event stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def signatures(files: DataFrame, key: str, content: Column) -> DataFrame:
    """(key, size, hash)."""
    return files.select(F.col(key).alias("key"), F.octet_length(content).cast("long").alias("size"), F.sha2(content, 256).alias("hash"))


def changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(key, change): added, removed or modified; unchanged keys are dropped."""
    o = old.select("key", F.col("hash").alias("old_hash"))
    n = new.select("key", F.col("hash").alias("new_hash"))
    change = F.when(F.col("old_hash").isNull(), "added").when(F.col("new_hash").isNull(), "removed").when(F.col("old_hash") != F.col("new_hash"), "modified")
    return o.join(n, "key", "full_outer").select("key", change.alias("change")).where("change is not null")


def apply_changes(facts: DataFrame, fresh: DataFrame, changed: DataFrame, key: str) -> DataFrame:
    """Facts of the next generation: those of changed keys are dropped, fresh ones take their place."""
    touched = changed.select(F.col("key").alias(key))
    alive = changed.where("change != 'removed'").select(F.col("key").alias(key))
    return facts.join(touched, key, "left_anti").unionByName(fresh.join(alive, key, "left_semi"))


def latest(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The last version of every key."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("x")).select(key, "x.*")


def debounce(events: DataFrame, key: str, ts: str, quiet_ms: int) -> DataFrame:
    """Bursts of a key: events no more than ``quiet_ms`` apart.  (key, burst, first, last, n)."""
    w = Window.partitionBy(key).orderBy(ts)
    gap = F.unix_millis(ts) - F.unix_millis(F.lag(ts).over(w))
    rows = events.withColumn("new", F.when(gap.isNull() | (gap > quiet_ms), 1).otherwise(0)).withColumn("burst", F.sum("new").over(w.rangeBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(key, "burst").agg(F.min(ts).alias("first"), F.max(ts).alias("last"), F.count(F.lit(1)).alias("n"))


def evict(entries: DataFrame, quota: int, target: float = 0.8, bins: int = 4096) -> DataFrame:
    """Entries (id, bytes, last_access) that stay once the quota is passed: most recently used first, within ``target`` of it.

    The running sum is taken over at most ``bins`` bins of last_access, then inside each bin, so no task orders the table.
    """
    span = entries.agg(F.min("last_access").alias("low"), F.max("last_access").alias("high"), F.sum("bytes").alias("total")).first()
    if span["total"] is None or span["total"] <= quota:
        return entries
    width = max(1, -(-(span["high"] - span["low"] + 1) // bins))
    rows = entries.withColumn("bin", F.floor((F.col("last_access") - span["low"]) / width))
    newer = Window.orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, -1)
    base = rows.groupBy("bin").agg(F.sum("bytes").alias("b")).select("bin", F.coalesce(F.sum("b").over(newer), F.lit(0)).alias("base"))
    inside = Window.partitionBy("bin").orderBy(F.desc("last_access"), F.desc("id")).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.join(base, "bin").withColumn("run", F.col("base") + F.sum("bytes").over(inside))
    return rows.where(F.col("run") <= target * quota).select(*entries.columns)


def stat_changed(files: DataFrame, known: DataFrame) -> DataFrame:
    """Files that are new or whose time or size differs from what is known: only these are read.  both: key, mtime, size."""
    return files.join(known.select("key", "mtime", "size").distinct(), ["key", "mtime", "size"], "left_anti")


def check_and_update(read: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(keys whose content differs, signatures from now on).  read: key, mtime, size, hash of files that were read."""
    changed = read.join(known.select("key", F.col("hash").alias("old")), "key", "left").where(~F.col("hash").eqNullSafe(F.col("old"))).select("key")
    return changed, known.join(read.select("key"), "key", "left_anti").unionByName(read.select(*known.columns))


def reload_scope(events: DataFrame) -> DataFrame:
    """(root, full, paths): what a batch of events asks of each root: everything again after a reference change, an event of a
    folder or a vanished parent, else the distinct paths.  events: root, path, kind, is_dir, parent_exists."""
    whole = (F.col("kind") == "ref") | F.coalesce("is_dir", F.lit(False)) | ~F.coalesce("parent_exists", F.lit(True))
    rows = events.groupBy("root").agg(F.max(whole.cast("int")).alias("f"), F.sort_array(F.collect_set(F.when(F.col("kind") == "tree", F.col("path")))).alias("p"))
    return rows.select("root", (F.col("f") == 1).alias("full"), F.when(F.col("f") == 0, F.col("p")).otherwise(F.array().cast("array<string>")).alias("paths"))


class PageCache:
    """Pages by generation and key; one is given out only for the generation it was made in and unchanged files."""

    def __init__(self, most: int = 64):
        self.most, self.generation, self.pages = most, 0, {}

    def put(self, generation: int, key: tuple, page: str, stamps: dict[str, tuple[int, int]]) -> None:
        if generation != self.generation:
            self.generation, self.pages = generation, {}
        self.pages.pop(key, None)
        self.pages[key] = (page, stamps)
        while len(self.pages) > self.most:
            self.pages.pop(next(iter(self.pages)))

    def get(self, generation: int, key: tuple, stamp_of) -> str | None:
        if generation != self.generation or key not in self.pages:
            return None
        page, stamps = self.pages[key]
        if any(stamp_of(path) != stamp for path, stamp in stamps.items()):
            del self.pages[key]
            return None
        return page
