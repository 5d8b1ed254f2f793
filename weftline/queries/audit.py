"""Audit statistics over the events table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators import audit, cdc
from weftline.plans import projections as P
from weftline.queries.registry import register


def entries(spark: SparkSession, sf: str) -> DataFrame:
    e = P.read(spark, sf, "events")
    return e.select(
        F.col("event_id").alias("entry_seq"), F.col("ts").alias("timestamp"), F.col("user_id").alias("session_id"), F.col("event_type").alias("tool"),
        F.when(F.col("event_id") % 11 == 0, "ERROR").otherwise("SUCCESS").alias("status"), F.col("value").alias("duration"),
        F.concat(F.lit("k"), F.get_json_object("props", "$.k")).alias("error"),
    )


@register(
    "audit_tool_stats",
    """SELECT event_type AS tool, count(*)::BIGINT AS calls, (count(*) FILTER (event_id % 11 = 0))::BIGINT AS errors,
       quantile_disc(value, 0.5) AS p50, CASE WHEN count(value) >= 20 THEN quantile_disc(value, 0.95) END AS p95 FROM events GROUP BY 1""",
)
def audit_tool_stats(spark: SparkSession, sf: str) -> DataFrame:
    return audit.tool_stats(entries(spark, sf))


@register(
    "audit_sessions",
    """SELECT user_id AS session_id, count(*)::BIGINT AS calls, (count(*) FILTER (event_id % 11 = 0))::BIGINT AS errors,
       epoch_us(arg_min(ts, event_id)) AS first_us, epoch_us(arg_max(ts, event_id)) AS last_us FROM events GROUP BY 1""",
)
def audit_sessions(spark: SparkSession, sf: str) -> DataFrame:
    s = audit.session_stats(entries(spark, sf))
    return s.select("session_id", "calls", "errors", F.unix_micros(F.col("first_call").cast("timestamp")).alias("first_us"), F.unix_micros(F.col("last_call").cast("timestamp")).alias("last_us"))


@register(
    "audit_top_errors",
    """WITH c AS (SELECT event_type AS tool, 'k' || json_extract_string(props, '$.k') AS error, count(*)::BIGINT AS n FROM events WHERE event_id % 11 = 0 GROUP BY 1, 2)
       SELECT tool, error, n, rank FROM (SELECT *, (row_number() OVER (PARTITION BY tool ORDER BY n DESC, error))::INTEGER AS rank FROM c) WHERE rank <= 3""",
)
def audit_top_errors(spark: SparkSession, sf: str) -> DataFrame:
    return audit.top_errors(entries(spark, sf))


@register(
    "audit_top_targets",
    """SELECT user_id AS target, count(*)::BIGINT AS n FROM events GROUP BY 1 ORDER BY n DESC, target LIMIT 10""",
)
def audit_top_targets(spark: SparkSession, sf: str) -> DataFrame:
    e = entries(spark, sf)
    return e.groupBy(F.col("session_id").alias("target")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "target").limit(10)


@register(
    "audit_window",
    """SELECT event_type AS tool, count(*)::BIGINT AS calls FROM events WHERE epoch_us(ts) >= (SELECT max(epoch_us(ts)) - 7 * 86400 * 1000000::BIGINT FROM events) GROUP BY 1""",
)
def audit_window(spark: SparkSession, sf: str) -> DataFrame:
    e = entries(spark, sf).withColumn("us", F.unix_micros(F.col("timestamp").cast("timestamp")))
    last = e.agg(F.max("us")).scalar()
    return e.where(F.col("us") >= last - 7 * 86400 * 1_000_000).groupBy("tool").agg(F.count(F.lit(1)).alias("calls"))


def _chain(spark: SparkSession, sf: str) -> DataFrame:
    """Entries of which every odd one follows its even one, with changes by number: fields changed or nulled after
    hashing, a null link, details with and without a signature, both versions, and a missing entry."""
    e = P.read(spark, sf, "events").select(F.col("event_id").alias("entry_seq"))
    k = F.col("entry_seq")
    rows = e.select(
        "entry_seq", F.concat(F.lit("t"), k).alias("timestamp"), F.concat(F.lit("s"), k % 7).alias("session_id"), F.concat(F.lit("tool"), k % 3).alias("tool"),
        audit.args_digest(k.cast("string")).alias("args_digest"), F.lit("SUCCESS").alias("status"), F.array(F.concat(F.lit("/f/"), k)).alias("files"), F.lit(0).alias("redacted"),
    ).withColumn("chain_version", F.when(k % 20 == 13, 1).when(k % 20 == 15, 1).otherwise(2))
    even = rows.where("entry_seq % 2 = 0").withColumn("prev_hash", F.sha2(F.concat(F.lit("p"), k), 256))
    even = even.withColumn("entry_hash", audit.entry_hash(F.col("prev_hash")))
    odd = rows.where("entry_seq % 2 = 1").join(even.select((k + 1).alias("entry_seq"), F.col("entry_hash").alias("prev_hash")), "entry_seq")
    written = F.when(k % 20 == 15, F.lit(2)).otherwise(F.col("chain_version"))
    odd = odd.withColumn("entry_hash", audit.entry_hash(F.col("prev_hash"), written))
    odd = odd.withColumn("tool", F.when(k % 20 == 3, F.lit("other")).when(k % 20 == 5, F.lit(None)).otherwise(F.col("tool"))).withColumn("prev_hash", F.when(k % 20 != 7, F.col("prev_hash")))
    both = even.unionByName(odd.select(*even.columns))
    detail = F.when(k % 20 == 9, "unsigned").when(k % 20 == 11, "signed")
    return both.withColumns({"error_detail": detail, "error_detail_sig": F.when(k % 20 == 11, audit.detail_signature(F.col("entry_hash"), detail))}).where("entry_seq % 20 != 16")


@register(
    "audit_chain_verify",
    """SELECT event_id AS entry_seq, CASE WHEN event_id % 2 = 0 OR event_id % 20 = 7 THEN 'link' WHEN event_id % 20 IN (3, 5, 15) THEN 'hash' WHEN event_id % 20 = 9 THEN 'detail' ELSE 'gap' END AS reason
       FROM events WHERE event_id % 20 <> 16 AND (event_id % 2 = 0 OR event_id % 20 IN (3, 5, 7, 9, 15, 17))""",
)
def audit_chain_verify(spark: SparkSession, sf: str) -> DataFrame:
    return audit.verify_chain(_chain(spark, sf))


@register(
    "fingerprint",
    """WITH h AS (SELECT sha256(concat_ws('|', o_orderkey, o_custkey, o_orderstatus, o_orderpriority)) AS h FROM orders),
       b AS (SELECT ('0x' || substr(h, 1, 8))::BIGINT % 4096 AS b, sha256(string_agg(h, chr(10) ORDER BY h)) AS d FROM h GROUP BY 1)
       SELECT sha256(string_agg(d, chr(10) ORDER BY b)) AS fingerprint FROM b""",
)
def fingerprint(spark: SparkSession, sf: str) -> DataFrame:
    o = P.read(spark, sf, "orders")
    return audit.fingerprint(o.select(F.concat_ws("|", "o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority").alias("line")))


_SPLIT = "SELECT o_orderkey AS key, sha256(o_orderstatus || o_orderpriority) AS hash FROM orders WHERE o_orderkey % 10 <> 3"
_NEXT = "SELECT o_orderkey AS key, sha256(CASE WHEN o_orderkey % 10 = 4 THEN 'x' ELSE o_orderstatus END || o_orderpriority) AS hash FROM orders WHERE o_orderkey % 10 <> 7"


@register(
    "cdc_changes",
    f"""WITH o AS ({_SPLIT}), n AS ({_NEXT})
        SELECT coalesce(o.key, n.key) AS key, CASE WHEN o.key IS NULL THEN 'added' WHEN n.key IS NULL THEN 'removed' ELSE 'modified' END AS change
        FROM o FULL JOIN n ON o.key = n.key WHERE o.hash IS DISTINCT FROM n.hash""",
)
def cdc_changes(spark: SparkSession, sf: str) -> DataFrame:
    old, new = _versions(spark, sf)
    return cdc.changes(cdc.signatures(old, "o_orderkey", F.col("c")), cdc.signatures(new, "o_orderkey", F.col("c")))


def _versions(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    o = P.read(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    old = o.where("o_orderkey % 10 != 3").withColumn("c", F.concat("o_orderstatus", "o_orderpriority"))
    new = o.where("o_orderkey % 10 != 7").withColumn("c", F.concat(F.when(F.col("o_orderkey") % 10 == 4, F.lit("x")).otherwise(F.col("o_orderstatus")), "o_orderpriority"))
    return old, new


@register(
    "cdc_apply",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 4 AND o_orderstatus <> 'x' THEN 'x' ELSE o_orderstatus END || o_orderpriority AS c FROM orders WHERE o_orderkey % 10 <> 7""",
)
def cdc_apply(spark: SparkSession, sf: str) -> DataFrame:
    old, new = _versions(spark, sf)
    changed = cdc.changes(cdc.signatures(old, "o_orderkey", F.col("c")), cdc.signatures(new, "o_orderkey", F.col("c")))
    return cdc.apply_changes(old.select("o_orderkey", "c"), new.select("o_orderkey", "c"), changed, "o_orderkey")


@register(
    "debounce_batches",
    """WITH g AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR epoch_ms(ts) - epoch_ms(lag(ts) OVER w) > 3600000 THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
       b AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS burst FROM g)
       SELECT user_id, burst::BIGINT AS burst, epoch_us(min(ts)) AS first_us, epoch_us(max(ts)) AS last_us, count(*)::BIGINT AS n FROM b GROUP BY 1, 2""",
)
def debounce_batches(spark: SparkSession, sf: str) -> DataFrame:
    e = P.read(spark, sf, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    d = cdc.debounce(e, "user_id", "ts", 3_600_000)
    return d.select("user_id", F.col("burst").cast("long").alias("burst"), F.unix_micros("first").alias("first_us"), F.unix_micros("last").alias("last_us"), "n")


@register(
    "latest_version",
    """SELECT user_id, arg_max(event_type, event_id) AS event_type, max(event_id) AS event_id FROM events GROUP BY 1""",
)
def latest_version(spark: SparkSession, sf: str) -> DataFrame:
    return cdc.latest(P.read(spark, sf, "events").select("user_id", "event_type", "event_id"), "user_id", "event_id")


@register(
    "cache_eviction",
    """WITH e AS (SELECT doc_id AS id, strlen(text)::BIGINT AS bytes, (doc_id * 7919) % 1009 AS last_access FROM documents),
       r AS (SELECT *, sum(bytes) OVER (ORDER BY last_access DESC, id DESC ROWS UNBOUNDED PRECEDING) AS run, sum(bytes) OVER () AS total FROM e)
       SELECT id, bytes, last_access FROM r WHERE total <= 1000000 OR run <= 0.8 * 1000000""",
)
def cache_eviction(spark: SparkSession, sf: str) -> DataFrame:
    d = P.read(spark, sf, "documents")
    e = d.select(F.col("doc_id").alias("id"), F.octet_length("text").cast("long").alias("bytes"), (F.col("doc_id") * 7919 % 1009).alias("last_access"))
    return cdc.evict(e, 1_000_000)
