"""Tables that grow: published generations of a snapshot, cached extractions, the audit trail as line files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import labels as L
from weftline.operators import audit


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def current_generation(spark: SparkSession, folder: str) -> int:
    """The newest published generation; 0 for none.  A generation counts once its mark is there."""
    fs, path = _fs(spark, folder)
    if not fs.exists(path):
        return 0
    names = [s.getPath().getName() for s in fs.listStatus(path)]
    return max((int(n[5:]) for n in names if n.startswith("done-")), default=0)


def install_snapshot(tables: dict[str, DataFrame], folder: str) -> int:
    """Writes the next generation and publishes it by one small file, so readers see all of it or nothing."""
    spark = next(iter(tables.values())).sparkSession
    generation = current_generation(spark, folder) + 1
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/gen-{generation}/{name}")
    fs, mark = _fs(spark, f"{folder}/done-{generation}")
    if not fs.createNewFile(mark):
        raise RuntimeError(f"generation {generation} was published by another writer")
    return generation


def read_snapshot(spark: SparkSession, folder: str, names: list[str], generation: int | None = None) -> dict[str, DataFrame]:
    generation = generation or current_generation(spark, folder)
    return {n: spark.read.parquet(f"{folder}/gen-{generation}/{n}") for n in names}


def put_batch(cache: DataFrame | None, entries: DataFrame, now: Column) -> DataFrame:
    """The cache with new entries: the latest of a key wins, and what was used is marked.  entries: key, value, bytes."""
    fresh = entries.withColumn("last_access", now)
    if cache is None:
        return fresh
    return cache.join(fresh.select("key").distinct(), "key", "left_anti").unionByName(fresh)


def with_cache(files: DataFrame, cache: DataFrame, extract, version: str, config: str) -> tuple[DataFrame, DataFrame]:
    """(facts, new entries): facts of files whose key is cached come from the cache, only the others are extracted.

    files: path, repo_id, content_hash and what ``extract`` reads; facts carry ``path``.  cache: key, facts as
    rows with ``key``.
    """
    keyed = files.withColumn("key", L.cache_key(F.lit(version), F.col("path"), F.col("content_hash"), F.col("repo_id"), F.lit(config)))
    hits = cache.join(keyed.select("key").distinct(), "key", "left_semi")
    misses = keyed.join(cache.select("key").distinct(), "key", "left_anti")
    fresh = extract(misses).join(misses.select("path", "key"), "path")
    return hits.unionByName(fresh.select(*hits.columns)), fresh


def pass_row(hits: int, misses: int, errors: int, spark: SparkSession) -> DataFrame:
    """One row for a pass over the cache, to be appended to the metrics."""
    return spark.createDataFrame([(hits, misses, errors)], "hits long, misses long, errors long").withColumn("timestamp", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"))


def append_entries(last: tuple[int, str] | None, rows: list[dict]) -> list[dict]:
    """Rows of the audit chain with their numbers and hashes, after the last (entry_seq, entry_hash).

    One writer appends; it holds the few rows of its calls, never the trail.
    """
    import hashlib
    import json

    seq, prev = (last[0] + 1, last[1]) if last else (0, audit.ZERO_HASH)
    out = []
    for r in rows:
        digest = hashlib.sha256(r["args"].encode()).hexdigest()
        files = json.dumps(r["files"], ensure_ascii=False, separators=(",", ":"))
        text = "".join([prev, r["timestamp"], r["session_id"], r["tool"], digest, r["status"], files, str(r["redacted"])])
        own = hashlib.sha256(text.encode()).hexdigest()
        detail = r.get("error_detail")
        row = {k: r[k] for k in ("timestamp", "session_id", "tool", "status", "files", "redacted")}
        out.append(row | {
            "entry_seq": seq, "prev_hash": prev, "args_digest": digest, "entry_hash": own, "chain_version": audit.LATEST_VERSION, "error_detail": detail,
            "error_detail_sig": hashlib.sha256((own + detail).encode()).hexdigest() if detail is not None else None,
        })
        seq, prev = seq + 1, own
    return out


ENTRIES = "entry_seq long, prev_hash string, timestamp string, session_id string, tool string, args_digest string, status string, files array<string>, redacted int, entry_hash string, chain_version int, error_detail string, error_detail_sig string"


def export_jsonl(entries: DataFrame, folder: str) -> None:
    """The trail as JSON lines in order; a range sort, so files follow each other."""
    entries.orderBy("entry_seq").write.json(folder)
