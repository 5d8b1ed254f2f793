"""Scalar functions checked on whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import text as T
from weftline.operators import guard
from weftline.plans import projections as P
from weftline.queries.registry import register


@register(
    "pascal_case",
    """SELECT p_partkey, list_aggregate(list_transform(list_filter(string_split_regex(p_name || '_x-' || p_type, '[-_./ ]'), lambda x: x <> ''), lambda x: upper(x[1]) || x[2:]), 'string_agg', '') AS pascal FROM part""",
)
def pascal_case(spark: SparkSession, sf: str) -> DataFrame:
    return P.read(spark, sf, "part").select("p_partkey", T.pascal_case(F.concat("p_name", F.lit("_x-"), "p_type")).alias("pascal"))


_RAW = """CASE p_partkey % 6 WHEN 0 THEN ' ''' || p_name || '.created'' ' WHEN 1 THEN 'Streams.EVENT_' || p_size WHEN 2 THEN 'typeof Topics.A_B' WHEN 3 THEN 'orders.created' WHEN 4 THEN 'lower.EVENT' ELSE '"Enum.Member"' END"""


@register(
    "topic_key",
    """SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN lower(p_name) || '.created' WHEN 1 THEN 'event_' || p_size WHEN 2 THEN 'a_b' WHEN 3 THEN 'orders.created' WHEN 4 THEN 'lower.event' ELSE 'enum.member' END AS key FROM part""",
)
def topic_key(spark: SparkSession, sf: str) -> DataFrame:
    raw = F.expr(_RAW.replace("' ''' || p_name || '.created'' '", "concat(' \\'', p_name, '.created\\' ')"))
    return P.read(spark, sf, "part").select("p_partkey", T.topic_key(raw).alias("key"))


@register("fold_rpc", "SELECT p_partkey, lower(regexp_replace(p_name || '_' || p_brand, '[^A-Za-z0-9]', '', 'g')) AS folded FROM part")
def fold_rpc(spark: SparkSession, sf: str) -> DataFrame:
    return P.read(spark, sf, "part").select("p_partkey", T.fold_rpc(F.concat_ws("_", "p_name", "p_brand")).alias("folded"))


@register(
    "module_key",
    """SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'src/p' || page_id WHEN 1 THEN 'src/p' || page_id WHEN 2 THEN 'src/p' || page_id || '.java' ELSE 'src/p' || page_id || '.test' END AS key FROM pages""",
)
def module_key(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("page_id")
    path = F.concat(F.lit("src/p"), k, F.when(k % 4 == 0, ".tsx").when(k % 4 == 1, ".d.ts").when(k % 4 == 2, ".java").otherwise(".test.js"))
    return P.read(spark, sf, "pages").select("page_id", T.module_key(path).alias("key"))


@register(
    "split_words",
    """SELECT p_partkey, 'my api key ' || lower(p_brand[1:1]) || p_size AS words FROM part""",
)
def split_words(spark: SparkSession, sf: str) -> DataFrame:
    return P.read(spark, sf, "part").select("p_partkey", F.array_join(T.split_words(F.concat(F.lit("myAPIKey."), F.substring("p_brand", 1, 1), "p_size")), " ").alias("words"))


@register(
    "sensitive_keys",
    """SELECT c_custkey, c_custkey % 7 IN (0, 1, 2, 4) AS sensitive FROM customer""",
)
def sensitive_keys(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey") % 7
    key = F.when(k == 0, "db.Password").when(k == 1, "serviceAuth").when(k == 2, "sign.key").when(k == 3, "author.name").when(k == 4, "apiKey").when(k == 5, "sort.key").otherwise("keyboard")
    return P.read(spark, sf, "customer").select("c_custkey", T.is_sensitive_key(key).alias("sensitive"))


@register(
    "test_paths",
    """SELECT c_custkey, c_custkey % 8 IN (0, 2, 3, 5) AS test FROM customer""",
)
def test_paths(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey") % 8
    path = (
        F.when(k == 0, "src/Tests/a.py").when(k == 1, "src/latest/a.py").when(k == 2, "src/a.spec.ts").when(k == 3, "src/OrderTest.java")
        .when(k == 4, "src/Attest.java").when(k == 5, "pkg/a_test.go").when(k == 6, "src/contest.rs").otherwise("src/testing.rs")
    )
    return P.read(spark, sf, "customer").select("c_custkey", T.is_test_path(path).alias("test"))


@register(
    "subject_match",
    """SELECT c_custkey, c_custkey % 8 IN (0, 2, 5, 6) AS matched FROM customer""",
)
def subject_match(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey") % 8
    case = lambda *v: F.element_at(F.array(*[F.lit(x) for x in v]), (k + 1).cast("int"))
    pattern = case("a.*.c", "a.*", "a.>", "a.>", "a/+/c", "a/#", "a/+", "*.b")
    topic = case("a.b.c", "a.b.c", "a.b.c", "a", "a/b/d", "a", "a/b", ".b")
    return P.read(spark, sf, "customer").select("c_custkey", T.subject_matches(pattern, topic).alias("matched"))


@register(
    "percent_labels",
    """SELECT c_nationkey, CASE WHEN sum(CASE WHEN c_acctbal > 0 THEN 1 ELSE 0 END) = 0 THEN 'n/a' ELSE printf('%.1f', 100.0::DOUBLE * count(*) FILTER (c_acctbal > 5000) / sum(CASE WHEN c_acctbal > 0 THEN 1 ELSE 0 END)) || '%' END AS share FROM customer GROUP BY 1""",
)
def percent_labels(spark: SparkSession, sf: str) -> DataFrame:
    c = P.read(spark, sf, "customer").groupBy("c_nationkey").agg(F.count_if(F.col("c_acctbal") > 5000).alias("n"), F.count_if(F.col("c_acctbal") > 0).alias("d"))
    return c.select("c_nationkey", T.percent(F.col("n"), F.col("d")).alias("share"))


@register(
    "properties_resolved",
    """SELECT 'k' || o_orderkey AS key, CASE o_orderkey % 3 WHEN 0 THEN o_orderstatus WHEN 1 THEN 'a-' || CASE WHEN (o_orderkey - 1) % 3 = 0 AND o_orderkey - 1 IN (SELECT o_orderkey FROM orders) THEN (SELECT o_orderstatus FROM orders p WHERE p.o_orderkey = orders.o_orderkey - 1) ELSE 'none' END || '-z' ELSE 'd-' || o_orderpriority END AS value FROM orders""",
)
def properties_resolved(spark: SparkSession, sf: str) -> DataFrame:
    o = P.read(spark, sf, "orders")
    k = F.col("o_orderkey")
    raw = F.when(k % 3 == 0, F.col("o_orderstatus")).when(k % 3 == 1, F.concat(F.lit("a-${k"), k - 1, F.lit(":none}-z"))).otherwise(F.concat(F.lit("d-${missing:"), "o_orderpriority", F.lit("}")))
    return guard.resolve_placeholders(o.select(F.concat(F.lit("k"), k).alias("key"), raw.alias("raw_value")))


@register(
    "properties_parsed",
    """SELECT 'a.' || s_suppkey AS key, 'v=' || s_name AS raw_value FROM supplier UNION ALL SELECT 'b.' || s_suppkey, s_name FROM supplier""",
)
def properties_parsed(spark: SparkSession, sf: str) -> DataFrame:
    s = P.read(spark, sf, "supplier")
    text = F.concat(F.lit("# note\n a."), "s_suppkey", F.lit(" = v="), "s_name", F.lit(" \n!x\n\nb."), "s_suppkey", F.lit(": "), "s_name")
    return guard.parse_properties(s.select(F.concat(F.lit("f"), "s_suppkey").alias("source"), text.alias("text"))).select("key", "raw_value")
