"""Schema compatibility over two projected versions of a schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators import wire
from weftline.plans import projections as P
from weftline.queries.registry import register

_TYPES = ["int32", "string", "bytes", "sint64", "double", "Msg"]


def _fields(spark: SparkSession, sf: str, version: int) -> DataFrame:
    """A message per brand, a field per part: some renamed, retyped, moved or dropped in version 2."""
    p = P.read(spark, sf, "part").select((F.col("p_partkey") % 40).alias("m"), F.floor(F.col("p_partkey") / 40).cast("int").alias("number"), F.col("p_partkey").alias("k"))
    k = F.col("k")
    kind = lambda i: F.element_at(F.array(*[F.lit(t) for t in _TYPES]), (i % 6 + 1).cast("int"))
    if version == 1:
        return p.where("k % 11 != 5").select(F.concat(F.lit("M"), "m").alias("message"), "number", F.concat(F.lit("f"), k).alias("name"), F.lit("singular").alias("cardinality"), kind(k).alias("value_type"))
    name = F.when(k % 13 == 1, F.concat(F.lit("g"), k)).otherwise(F.concat(F.lit("f"), k))
    return p.where("k % 11 != 7").select(F.concat(F.lit("M"), "m").alias("message"), "number", name.alias("name"), F.when(k % 17 == 2, "repeated").otherwise("singular").alias("cardinality"), kind(F.when(k % 19 == 3, k + 1).otherwise(k)).alias("value_type"))


def _typed(spark: SparkSession, sf: str, version: int) -> DataFrame:
    msg = spark.range(1).select(F.lit("Msg").alias("type_name"))
    return wire.wire_class(_fields(spark, sf, version), msg, msg.limit(0))


_SQL = """
 p AS (SELECT 'M' || (p_partkey % 40) AS message, (p_partkey // 40)::INTEGER AS number, p_partkey AS k FROM part),
 c AS (SELECT *, (k % 6)::INTEGER AS ot, ((CASE WHEN k % 19 = 3 THEN k + 1 ELSE k END) % 6)::INTEGER AS nt, k % 17 = 2 AS rep, k % 13 = 1 AS ren, k % 11 <> 5 AS in_o, k % 11 <> 7 AS in_n FROM p),
 b AS (SELECT message FROM c GROUP BY 1 HAVING bool_or(in_o) AND bool_or(in_n)),
 v AS (SELECT c.*, CASE WHEN ot = nt THEN 0 WHEN (ot, nt) IN ((1, 2), (2, 1), (2, 5), (5, 2)) THEN 0 ELSE 2 END AS val, ot IN (1, 2, 5) AND nt IN (1, 2, 5) AS del FROM c WHERE message IN (FROM b)),
 w AS (SELECT *, CASE WHEN NOT rep THEN val WHEN del THEN val ELSE 2 END AS verdict FROM v)
 SELECT message, number, CASE WHEN in_o AND NOT in_n THEN 'DeletedWithoutReserved' WHEN in_o AND ren THEN CASE WHEN verdict = 2 THEN 'FieldNumberReused' ELSE 'RenamedWarning' END ELSE 'IncompatibleType' END AS rule,
   'f' || k AS old_name, CASE WHEN in_n THEN CASE WHEN ren THEN 'g' ELSE 'f' END || k END AS new_name
 FROM w WHERE (in_o AND NOT in_n AND number % 5 <> 0) OR (in_o AND in_n AND (ren OR verdict = 2))"""


@register("wire_diff_fields", f"WITH {_SQL}")
def wire_diff_fields(spark: SparkSession, sf: str) -> DataFrame:
    none = spark.range(0).select(F.lit("").alias("message"), F.lit(0).alias("lo"), F.lit(0).alias("hi"), F.lit("").alias("name"))
    numbers = _fields(spark, sf, 1).where("number % 5 = 0").select("message", F.col("number").alias("lo")).distinct()
    kept = numbers.select("message", "lo", F.col("lo").alias("hi"), F.lit(None).cast("string").alias("name"))
    return wire.diff_fields(_typed(spark, sf, 1), _typed(spark, sf, 2), none, kept)


@register(
    "wire_diff_enums",
    """WITH s AS (SELECT 'E' || (s_suppkey % 10) AS enum, s_suppkey AS k, (s_suppkey // 10)::INTEGER AS number FROM supplier)
       SELECT enum, number, CASE WHEN k % 7 = 2 THEN 'EnumValueDeletedWithoutReserved' ELSE 'EnumRenamedWarning' END AS rule FROM s WHERE k % 7 IN (2, 3) AND enum IN (SELECT enum FROM s WHERE k % 7 <> 2)""",
)
def wire_diff_enums(spark: SparkSession, sf: str) -> DataFrame:
    s = P.read(spark, sf, "supplier").select(F.concat(F.lit("E"), F.col("s_suppkey") % 10).alias("enum"), F.floor(F.col("s_suppkey") / 10).cast("int").alias("number"), F.col("s_suppkey").alias("k"))
    old = s.select("enum", "number", F.concat(F.lit("V"), "k").alias("name"))
    new = s.where("k % 7 != 2").select("enum", "number", F.concat(F.when(F.col("k") % 7 == 3, "W").otherwise("V"), "k").alias("name"))
    none = spark.range(0).select(F.lit("").alias("enum"), F.lit(0).alias("lo"), F.lit(0).alias("hi"))
    return wire.diff_enums(old, new, none, none)
