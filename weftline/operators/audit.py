"""Audit statistics and the tamper-evident hash chain."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline import schema
from weftline.functions import text as T

ZERO_HASH = "0" * 64
P95_SAMPLES = 20


def percentile(column: str, p: float) -> Column:
    """Nearest-rank percentile: an observed value."""
    return F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {column})")


def tool_stats(audit: DataFrame) -> DataFrame:
    """tool, calls, errors, p50, p95 (null under 20 samples).  audit: tool, status, duration."""
    return audit.groupBy("tool").agg(
        F.count(F.lit(1)).alias("calls"), F.count_if(F.col("status") != "SUCCESS").alias("errors"),
        percentile("duration", 0.5).alias("p50"), F.when(F.count("duration") >= P95_SAMPLES, percentile("duration", 0.95)).alias("p95"),
    )


def session_stats(audit: DataFrame) -> DataFrame:
    """session_id, calls, errors, first and last call in chain order."""
    return audit.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("calls"), F.count_if(F.col("status") != "SUCCESS").alias("errors"),
        F.min_by("timestamp", "entry_seq").alias("first_call"), F.max_by("timestamp", "entry_seq").alias("last_call"),
    )


def top_errors(audit: DataFrame, most: int = schema.TOP_ERRORS) -> DataFrame:
    counted = audit.where("status != 'SUCCESS'").groupBy("tool", "error").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("tool").orderBy(F.desc("n"), "error")
    return counted.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def restarts(starts: DataFrame, process: str = "daemon") -> DataFrame:
    """Starts beyond the first, by workspace.  starts: process, workspace."""
    n = starts.where(F.col("process") == process).groupBy("workspace").agg(F.count(F.lit(1)).alias("n"))
    return n.select("workspace", F.greatest(F.col("n") - 1, F.lit(0)).alias("restarts"))


#: Versions of the hash input: the first covers five fields, later ones all of them.
FIRST_VERSION, LATEST_VERSION = 1, 2


def args_digest(args: Column) -> Column:
    return F.sha2(args, 256)


def detail_signature(entry_hash: Column, detail: Column) -> Column:
    """Binds an error detail, which is outside the chain's hash, to its entry."""
    return F.sha2(F.concat(entry_hash, detail), 256)


def entry_hash(prev: Column, version: Column | None = None) -> Column:
    """SHA-256 over the previous hash and the entry's fields, without separators; null fields count as empty."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    first = [F.coalesce(prev, F.lit("")), text("timestamp"), text("session_id"), text("tool"), text("args_digest")]
    whole = F.sha2(F.concat(*first, text("status"), F.coalesce(F.to_json("files"), F.lit("")), text("redacted")), 256)
    return whole if version is None else F.when(version == FIRST_VERSION, F.sha2(F.concat(*first), 256)).otherwise(whole)


def verify_chain(audit: DataFrame) -> DataFrame:
    """Entries that break the chain: (entry_seq, reason), by the first rule broken.

    gap: not exactly one entry has the number before (the first is 0), or the number is not unique; link: the
    stored previous hash is not that entry's (64 zeros for the first); hash: the fields do not give the
    stored hash, by the entry's ``chain_version`` (absent or null: the latest); detail: an error detail
    without a valid signature, or a signature without a detail.  A null never hides a break.

    Every row stores its predecessor's hash, so each row is checked on its own against the row before it,
    found by an equi-join on entry_seq - 1: no global order, no single task.
    """
    for c, kind in (("chain_version", "int"), ("error_detail", "string"), ("error_detail_sig", "string")):
        if c not in audit.columns:
            audit = audit.withColumn(c, F.lit(None).cast(kind))
    by_seq = audit.groupBy("entry_seq").agg(F.count(F.lit(1)).alias("same"), F.first("entry_hash").alias("of_seq"))
    before = by_seq.select((F.col("entry_seq") + 1).alias("entry_seq"), F.col("of_seq").alias("expected"), F.col("same").alias("earlier"))
    rows = audit.join(by_seq.select("entry_seq", "same"), "entry_seq", "left").join(before, "entry_seq", "left")
    start = F.col("entry_seq") == 0
    expected = F.when(start, F.lit(ZERO_HASH)).otherwise(F.col("expected"))
    alone = (F.coalesce("same", F.lit(0)) == 1) & (F.coalesce(start, F.lit(False)) | (F.coalesce("earlier", F.lit(0)) == 1))
    version = F.coalesce("chain_version", F.lit(LATEST_VERSION))
    signed = F.coalesce(F.col("error_detail_sig") == detail_signature(F.col("entry_hash"), F.col("error_detail")), F.lit(False))
    neither = F.col("error_detail").isNull() & F.col("error_detail_sig").isNull()
    reason = (
        F.when(~alone, "gap").when(~F.col("prev_hash").eqNullSafe(expected), "link")
        .when(~F.col("entry_hash").eqNullSafe(entry_hash(F.col("prev_hash"), version)), "hash").when(~(signed | neither), "detail")
    )
    return rows.select("entry_seq", reason.alias("reason")).where("reason is not null")


def since(entries: DataFrame, spec: str, now: Column) -> DataFrame:
    """Entries of the last ``7d``, ``24h``, ``30m``, or ``all``.  entries: timestamp as text of either stored form."""
    m = re.fullmatch(r"(\d+)([dhm])", spec.strip())
    if spec.strip() == "all":
        return entries
    if not m:
        raise ValueError(f"not a time span: {spec}")
    seconds = int(m[1]) * {"d": 86_400, "h": 3_600, "m": 60}[m[2]]
    return entries.where(T.epoch_seconds(F.col("timestamp")) >= now - seconds)


def cache_totals(passes: DataFrame) -> DataFrame:
    """passes, hits, misses, errors of the index cache.  One row, zeros for an empty table."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c)
    return passes.agg(F.count(F.lit(1)).alias("passes"), total("hits"), total("misses"), total("errors"))


def latest_latency(metrics: DataFrame) -> DataFrame:
    """entry_seq, duration_us: the last latency recorded for an entry.  metrics: entry_seq, duration_us, recorded."""
    return metrics.groupBy("entry_seq").agg(F.max_by("duration_us", "recorded").alias("duration_us"))


def fingerprint(lines: DataFrame, column: str = "line", buckets: int = 4096) -> DataFrame:
    """One SHA-256 of a multiset of lines that does not depend on their order.

    A tree: lines are hashed, hash prefixes deal them to a power of ``buckets`` leaves, so that a leaf holds
    about ``buckets`` lines at most, however many there are; each leaf's sorted hashes are hashed, and
    so are the digests of ``buckets`` nodes at a time, level by level, up to the root.
    """
    hashed = lines.select(F.sha2(F.col(column), 256).alias("h"))
    levels, room, count = 1, buckets * buckets, lines.count()
    while count > room and levels < 4:
        levels, room = levels + 1, room * buckets
    prefix = F.conv(F.substring("h", 1, 8), 16, 10).cast("long") if levels == 1 else F.conv(F.substring("h", 1, 15), 16, 10).cast("long")
    nodes = hashed.groupBy((prefix % buckets**levels).alias("b")).agg(F.sha2(F.array_join(F.sort_array(F.collect_list("h")), "\n"), 256).alias("d"))
    joined = F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("b", "d"))), lambda x: x["d"]), "\n"), 256)
    for _ in range(levels - 1):
        nodes = nodes.groupBy((F.col("b") % buckets ** (levels - 1)).alias("up")).agg(joined.alias("d")).withColumnRenamed("up", "b")
        levels -= 1
    return nodes.agg(joined.alias("fingerprint"))
