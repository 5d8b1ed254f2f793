"""Wire-format compatibility of two versions of a schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Scalar types by wire class (fixed values).
WIRE_CLASSES = {
    "varint": ("int32", "uint32", "int64", "uint64", "bool"),
    "zigzag": ("sint32", "sint64"),
    "fixed32": ("fixed32", "sfixed32"),
    "fixed64": ("fixed64", "sfixed64"),
    "float": ("float",), "double": ("double",), "string": ("string",), "bytes": ("bytes",),
}
COMPATIBLE, UNKNOWN, INCOMPATIBLE = 0, 1, 2
FIELDS = "message string, number int, name string, cardinality string, value_type string"


def wire_class(fields: DataFrame, messages: DataFrame, enums: DataFrame) -> DataFrame:
    """``fields`` plus cls.  messages, enums: (type_name) of the same version; both are declared names, a few per file."""
    kind = F.lit(None).cast("string")
    for name, types in WIRE_CLASSES.items():
        kind = F.when(F.col("value_type").isin(*types), name).otherwise(kind)
    m = messages.select(F.col("type_name").alias("value_type"), F.lit("message").alias("m")).distinct()
    e = enums.select(F.col("type_name").alias("value_type"), F.lit("varint").alias("e")).distinct()
    rows = fields.join(m, "value_type", "left").join(e, "value_type", "left")
    return rows.withColumn("cls", F.coalesce(kind, "e", "m", F.lit("unresolved"))).drop("m", "e")


def same_type_name(a: Column, b: Column) -> Column:
    return (a == b) | F.endswith(a, F.concat(F.lit("."), b)) | F.endswith(b, F.concat(F.lit("."), a))


def value_verdict(a: Column, a_type: Column, b: Column, b_type: Column) -> Column:
    """Verdict of two value types, the first rule that applies."""
    named = lambda c: c.isin("message", "unresolved")
    one = lambda x, y: ((a == x) & (b == y)) | ((a == y) & (b == x))
    other = F.when(a == "unresolved", b).otherwise(a)
    return (
        F.when(named(a) & named(b) & same_type_name(a_type, b_type), COMPATIBLE)
        .when((a == "message") & (b == "message"), INCOMPATIBLE)
        .when(((a == "unresolved") | (b == "unresolved")) & (other.isin("unresolved", "varint", "bytes", "message")), UNKNOWN)
        .when((a == "unresolved") | (b == "unresolved"), INCOMPATIBLE)
        .when(one("string", "bytes") | one("bytes", "message"), COMPATIBLE)
        .otherwise(F.when(a == b, COMPATIBLE).otherwise(INCOMPATIBLE))
    )


def field_verdict(old: str, new: str) -> Column:
    """Verdict of two fields (struct columns with cardinality, value_type, cls)."""
    c = lambda side, name: F.col(f"{side}_{name}")
    value = value_verdict(c(old, "cls"), c(old, "value_type"), c(new, "cls"), c(new, "value_type"))
    delimited = lambda side: c(side, "cls").isin("string", "bytes", "message")
    maybe = lambda side: delimited(side) | (c(side, "cls") == "unresolved")
    return (
        F.when(c(old, "cardinality") == c(new, "cardinality"), value)
        .when((c(old, "cardinality") == "map") | (c(new, "cardinality") == "map"), INCOMPATIBLE)
        .when(delimited(old) & delimited(new), value)
        .when(maybe(old) & maybe(new), UNKNOWN)
        .otherwise(INCOMPATIBLE)
    )


def diff_fields(old: DataFrame, new: DataFrame, reserved_old: DataFrame, reserved_new: DataFrame) -> DataFrame:
    """(message, number, rule, old_name, new_name) for messages of both versions.

    old, new: fields with cls; reserved_*: (message, lo, hi, name).  A full outer join on (message, number);
    reserved single numbers and names are equi-joins, wider ranges a range join within a message.
    """
    both = old.select("message").distinct().join(new.select("message").distinct(), "message")
    side = lambda df, p: df.join(both, "message", "left_semi").groupBy("message", "number").agg(F.min_by(F.struct("name", "cardinality", "value_type", "cls"), "name").alias(p)).select("message", "number", *[F.col(f"{p}.{c}").alias(f"{p}_{c}") for c in ("name", "cardinality", "value_type", "cls")])
    rows = side(old, "o").join(side(new, "n"), ["message", "number"], "full_outer")
    moved_old = new.select("message", F.col("name").alias("o_name"), F.col("number").alias("moved_old")).groupBy("message", "o_name").agg(F.min("moved_old").alias("moved_old"))
    moved_new = old.select("message", F.col("name").alias("n_name"), F.col("number").alias("moved_new")).groupBy("message", "n_name").agg(F.min("moved_new").alias("moved_new"))
    rows = rows.join(moved_old, ["message", "o_name"], "left").join(moved_new, ["message", "n_name"], "left")

    def reserved(df: DataFrame, out: str, by_name: bool) -> DataFrame:
        k = df.select(F.col("message").alias("r_message"), "lo", "hi", F.col("name").alias("r_name"))
        left = rows.select("message", "number", "o_name")
        same = F.col("message") == F.col("r_message")
        hit = left.join(k.where("lo = hi"), same & (F.col("number") == F.col("lo"))).select("message", "number")
        hit = hit.union(left.join(k.where("lo < hi"), same & F.col("number").between(F.col("lo"), F.col("hi"))).select("message", "number"))
        if by_name:
            hit = hit.union(left.join(k, same & (F.col("o_name") == F.col("r_name"))).select("message", "number"))
        return hit.distinct().withColumn(out, F.lit(True))

    rows = rows.join(reserved(reserved_new, "kept", True), ["message", "number"], "left").join(reserved(reserved_old, "was", False), ["message", "number"], "left")
    verdict = field_verdict("o", "n")
    moved = (F.coalesce(F.col("moved_old") != F.col("number"), F.lit(False))) | (F.coalesce(F.col("moved_new") != F.col("number"), F.lit(False)))
    rule = (
        F.when(F.col("n_name").isNull(), F.when(F.col("kept").isNull(), "DeletedWithoutReserved"))
        .when(F.col("o_name").isNull(), F.when(F.col("was"), "FieldNumberReused"))
        .when(F.col("o_name") != F.col("n_name"), F.when(moved | (verdict == INCOMPATIBLE), "FieldNumberReused").otherwise("RenamedWarning"))
        .otherwise(F.when(verdict == INCOMPATIBLE, "IncompatibleType").when(verdict == UNKNOWN, "TypeWarning"))
    )
    return rows.select("message", "number", rule.alias("rule"), F.col("o_name").alias("old_name"), F.col("n_name").alias("new_name")).where("rule is not null")


def diff_enums(old: DataFrame, new: DataFrame, reserved_old: DataFrame, reserved_new: DataFrame) -> DataFrame:
    """(enum, number, rule): name sets per number are compared; a reserved name does not excuse a deleted number."""
    both = old.select("enum").distinct().join(new.select("enum").distinct(), "enum")
    side = lambda df, p: df.join(both, "enum", "left_semi").groupBy("enum", "number").agg(F.sort_array(F.collect_set("name")).alias(p))
    rows = side(old, "o").join(side(new, "n"), ["enum", "number"], "full_outer")
    o, n = old.select("enum", F.col("number").alias("was_at"), "name"), new.select("enum", F.col("number").alias("now_at"), "name")
    shift = o.join(n, ["enum", "name"]).where("was_at != now_at")
    moved = shift.select("enum", F.col("was_at").alias("number")).union(shift.select("enum", F.col("now_at").alias("number"))).distinct().withColumn("moved", F.lit(True))

    def reserved(df: DataFrame, out: str) -> DataFrame:
        k = df.select(F.col("enum").alias("r_enum"), "lo", "hi")
        return rows.join(k, (F.col("enum") == F.col("r_enum")) & F.col("number").between(F.col("lo"), F.col("hi"))).select("enum", "number", F.lit(True).alias(out)).distinct()

    rows = rows.join(moved, ["enum", "number"], "left").join(reserved(reserved_new, "kept"), ["enum", "number"], "left").join(reserved(reserved_old, "was"), ["enum", "number"], "left")
    rule = (
        F.when(F.col("n").isNull(), F.when(F.col("kept").isNull(), "EnumValueDeletedWithoutReserved"))
        .when(F.col("o").isNull(), F.when(F.col("was"), "EnumNumberReused"))
        .when(F.col("o") != F.col("n"), F.when(F.col("moved"), "EnumNumberReused").otherwise("EnumRenamedWarning"))
    )
    return rows.select("enum", "number", rule.alias("rule")).where("rule is not null")


def diff_texts(spark: SparkSession, old, new) -> DataFrame:
    """(scope, number, rule, old_name, new_name) between two parsed schema files: fields, enums, removed messages."""

    def tables(p) -> tuple[DataFrame, DataFrame, DataFrame]:
        fields = spark.createDataFrame([(f["message"], f["number"], f["name"], f["cardinality"], f["value_type"]) for f in p.fields], FIELDS)
        names = {f["message"] for f in p.fields} | {n["name"] for n in p.nodes if n and n["kind"] == "proto_message"}
        both = lambda xs: spark.createDataFrame(sorted({(y,) for x in xs for y in (x, x.rsplit(".", 1)[-1])}), "type_name string")
        typed = wire_class(fields, both(names), both({e["enum"] for e in p.enums}))
        reserved = spark.createDataFrame([(r["message"], r["lo"], r["hi"], r["name"]) for r in p.reserved], "message string, lo int, hi int, name string")
        return typed, reserved, spark.createDataFrame([(e["enum"], e["number"], e["name"]) for e in p.enums], "enum string, number int, name string")

    (f1, r1, e1), (f2, r2, e2) = tables(old), tables(new)
    fields = diff_fields(f1, f2, r1, r2).select(F.col("message").alias("scope"), "number", "rule", "old_name", "new_name")
    ranges = lambda r: r.where("lo is not null").select(F.col("message").alias("enum"), "lo", "hi")
    none = F.lit(None).cast("string")
    enums = diff_enums(e1, e2, ranges(r1), ranges(r2)).select(F.col("enum").alias("scope"), "number", "rule", none.alias("old_name"), none.alias("new_name"))
    gone = sorted({f["message"] for f in old.fields} - {f["message"] for f in new.fields} - {n["name"] for n in new.nodes if n})
    removed = spark.createDataFrame([(m, None, "RemovedMessage", None, None) for m in gone], "scope string, number int, rule string, old_name string, new_name string")
    return fields.unionByName(enums).unionByName(removed)
