"""RPC call records of typed clients: constants, handler references, inherited fields, traces.

A record is (node_id, record); its first character says what it is (fixed values): ``=`` a method call on a
known service, ``~`` one on a service inferred from a field's name, ``^`` one through a field of a base class,
``#`` a class's client field, ``$`` a string constant, ``@`` a handler's reference; none: a whole service.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline import schema
from weftline.functions import labels as L
from weftline.functions import text as T
from weftline.operators.resolve import pick_or_ambiguous

SEPARATOR = r"\|"


def _tagged(records: DataFrame, nodes: DataFrame, tag: str) -> DataFrame:
    own = nodes.select(F.col("id").alias("node_id"), "repo_id", "name", "file_path")
    rows = records.where(F.startswith("record", F.lit(tag))).withColumn("text", F.expr("substring(record, 2)"))
    return rows.join(own, "node_id")


def _unique_value(found: DataFrame, key: list[str], value: str) -> DataFrame:
    """Per key the one distinct value of its own repository's rows, else of all rows; keys with several go."""
    same = F.col("from_repo") == F.col("repo_id")
    groups = found.groupBy(*key).agg(F.collect_set(F.when(same, F.col(value))).alias("own"), F.collect_set(value).alias("every"))
    values = F.when(F.size("own") > 0, F.col("own")).otherwise(F.col("every"))
    return groups.withColumn("values", values).drop("own", "every")


def resolve_literals(exprs: DataFrame, constants: DataFrame) -> DataFrame:
    """(repo_id, expr, literal): quoted text as it is, else the one value of a constant of that very name.

    exprs: repo_id, expr; constants: repo_id, key, value.  The own repository's values win; several are none.
    """
    rows = exprs.select("repo_id", "expr").distinct().withColumn("plain", F.trim("expr"))
    quoted = F.regexp_extract("plain", r"^(?:'(.+)'|\x22(.+)\x22|`(.+)`)$", 0)
    text = rows.where(quoted != "").select("repo_id", "expr", F.expr("substring(plain, 2, length(plain) - 2)").alias("literal"))
    named = rows.where(quoted == "").join(constants.select(F.col("repo_id").alias("from_repo"), F.col("key").alias("plain"), "value"), "plain")
    named = _unique_value(named, ["repo_id", "expr"], "value").where(F.size("values") == 1)
    return text.unionByName(named.select("repo_id", "expr", F.element_at("values", 1).alias("literal")))


def constants(records: DataFrame, nodes: DataFrame) -> DataFrame:
    rows = _tagged(records, nodes, "$").where(F.contains("text", F.lit("=")))
    at = F.instr("text", "=")
    return rows.withColumn("at", at).select("repo_id", F.expr("substring(text, 1, at - 1)").alias("key"), F.expr("substring(text, at + 1)").alias("value"))


def handler_names(records: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node_id, name): handlers whose reference reduces to a method that exactly one proto file declares.

    A package in front of the service must be the method's; it narrows the methods before they are counted.
    """
    refs = _tagged(records, nodes, "@").withColumn("parts", F.split("text", SEPARATOR)).where(F.size("parts") >= 2)
    refs = refs.select("node_id", "repo_id", F.col("parts")[0].alias("service"), F.col("parts")[1].alias("method"))
    known = resolve_literals(refs.select("repo_id", F.explode(F.array("service", "method")).alias("expr")), constants(records, nodes))
    of = lambda c: known.select("repo_id", F.col("expr").alias(c), F.col("literal").alias(f"{c}_name"))
    rows = refs.join(of("service"), ["repo_id", "service"]).join(of("method"), ["repo_id", "method"])
    qualifier = F.regexp_extract("service_name", r"^(.*)\.[^.]*$", 1)
    rows = rows.select("node_id", qualifier.alias("package"), F.concat(T.bare_name(F.col("service_name")), F.lit("."), "method_name").alias("name"), F.contains("service_name", F.lit(".")).alias("qualified"))
    methods = nodes.where((F.col("kind") == "grpc_method") & F.endswith("file_path", F.lit(".proto"))).select(F.col("name").alias("declared"), F.col("package").alias("in_package"))
    met = rows.join(methods, (F.col("name") == F.col("declared")) & (~F.col("qualified") | (F.col("package") == F.col("in_package"))))
    counted = met.groupBy("node_id", "name").agg(F.count(F.lit(1)).alias("n")).where("n = 1")
    # several references of one handler that resolve apart: the last by name, as a map would keep one
    return counted.groupBy("node_id").agg(F.max("name").alias("name"))


def declared_as(records: DataFrame) -> DataFrame:
    """(node_id, text): a handler's arguments as written, cut at 120 characters."""
    rows = records.where(F.startswith("record", F.lit("@"))).withColumn("parts", F.split(F.expr("substring(record, 2)"), SEPARATOR)).where(F.size("parts") >= 2)
    written = ~F.get("parts", F.lit(2)).eqNullSafe("~")
    service, method = F.col("parts")[0], F.col("parts")[1]
    text = F.when((service == "") & written, method).when((service != "") & written, F.concat(service, F.lit(", "), method)).when(service != "", service)
    return rows.select("node_id", T.declared_as(text).alias("text")).where("text != ''")


def inherited_calls(records: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node_id, target, inferred): ``Base#field.method`` through the base class's one binding of the field.

    Bindings of the own repository win.  A field bound to a plain type only is no client (no row); one
    without a unique binding falls back to what its name suggests, flagged inferred.
    """
    calls = _tagged(records, nodes, "^")
    shape = r"^([^#]*)#([^.]*)\.(.*)$"
    calls = calls.where(F.col("text").rlike(shape)).select("node_id", "repo_id", *[F.regexp_extract("text", shape, k).alias(n) for k, n in ((1, "base"), (2, "field"), (3, "method"))])
    fields = _tagged(records, nodes, "#").where(F.contains("text", F.lit("=")))
    fields = fields.select(F.col("repo_id").alias("from_repo"), F.col("name").alias("base"), F.regexp_extract("text", "^([^=]*)=", 1).alias("field"), F.regexp_extract("text", "^[^=]*=(.*)$", 1).alias("service"))
    keys = calls.select("repo_id", "base", "field").distinct().join(fields, ["base", "field"])
    bound = _unique_value(keys, ["repo_id", "base", "field"], "service").withColumn("real", F.filter("values", lambda x: x != ""))
    rows = calls.join(bound, ["repo_id", "base", "field"], "left")
    plain = F.col("values").isNotNull() & (F.size("real") == 0)
    service = F.when(F.size("real") == 1, F.element_at("real", 1))
    named = T.service_of_field(F.col("field"))
    target = F.when(plain, F.lit(None)).otherwise(F.concat(F.coalesce(service, named), F.lit("."), "method"))
    return rows.select("node_id", target.alias("target"), service.isNull().alias("inferred")).where("target is not null")


def is_health_name(target: Column) -> Column:
    return F.lower(target).rlike(r"^grpc\.health\.v1\.health(?:\.|$)")


def is_health_service(nodes: DataFrame) -> Column:
    """The stock health service: declared in its own proto package, or seen in code only."""
    stock = F.lower(F.element_at(F.split("name", r"\."), 1)) == "health"
    proto = F.endswith("file_path", F.lit(".proto"))
    return F.col("kind").isin("grpc_service", "grpc_method") & stock & F.when(proto, F.col("package") == "grpc.health.v1").otherwise(F.col("kind") == "grpc_service")


def method_calls(records: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node_id, target, to_id, confidence) of method-level records, by full name only.

    exact, or heuristic where the service was inferred; several candidates are settled by the caller's
    package.  An inferred call of the method that its caller serves is dropped.
    """
    tagged = lambda tag, inferred: records.where(F.startswith("record", F.lit(tag))).select("node_id", F.expr("substring(record, 2)").alias("target"), F.lit(inferred).alias("inferred"))
    calls = tagged("=", False).unionByName(tagged("~", True)).unionByName(inherited_calls(records, nodes)).distinct()
    own = nodes.select(F.col("id").alias("node_id"), F.col("package").alias("repo_id"))  # settled by package
    proto = nodes.where((F.col("kind") == "grpc_method") & F.endswith("file_path", F.lit(".proto")) & ~is_health_service(nodes))
    cand = proto.select(F.col("id").alias("cand_id"), F.col("package").alias("cand_repo"), F.lower("name").alias("low"))
    facts = calls.where(~is_health_name(F.col("target"))).join(own, "node_id").withColumn("low", F.lower("target"))
    met = facts.join(cand, "low").select("node_id", "target", "inferred", "repo_id", "cand_id", "cand_repo", F.when(F.col("inferred"), "heuristic").otherwise("exact").alias("confidence"))
    chosen = pick_or_ambiguous(met, ["node_id", "target", "inferred"])
    served = handler_names(records, nodes).select("node_id", F.lower("name").alias("served"))
    rows = chosen.join(served, "node_id", "left")
    rows = rows.where(~(F.col("inferred") & F.coalesce(F.lower("target") == F.col("served"), F.lit(False))))
    return rows.select("node_id", "target", F.col("cand_id").alias("to_id"), "confidence")


def target_match(target: str) -> tuple[Column, Column, Column]:
    """(matches, confidence, is_symbol) of a gRPC node: the declaration itself, or a package or name that holds the text."""
    t = F.lit(target.strip())
    exact = (F.col("name") == t) | L.fqcn_equals(F.col("package"), F.col("name"), t)
    symbol = exact | (T.ascii_lower(F.col("name")) == T.ascii_lower(t)) | T.bare_names_match(F.col("name"), t)
    near = F.contains("package", t) | L.fqcn_contains(F.col("package"), F.col("name"), t)
    grpc = F.col("kind").isin("grpc_service", "grpc_method")
    return grpc & F.coalesce(symbol | near, F.lit(False)), F.when(exact, "exact").otherwise("heuristic"), F.coalesce(symbol, F.lit(False))


def anchors(nodes: DataFrame, target: str) -> tuple[DataFrame, DataFrame]:
    """(matches, related): where one node is the target itself, those that only hold its text are merely related."""
    matches, confidence, symbol = target_match(target)
    rows = nodes.where(matches).withColumns({"confidence": confidence, "is_symbol": symbol})
    some = F.coalesce(rows.agg(F.max(F.col("is_symbol").cast("int"))).scalar(), F.lit(0)) == 1
    related = some & ~F.col("is_symbol") & F.endswith("file_path", F.lit(".proto"))
    return rows.where(~some | F.col("is_symbol")), rows.where(related)


def enclosing_services(methods: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, service_id): the smallest service declaration around each method in its file."""
    services = nodes.where("kind = 'grpc_service'").select(F.col("id").alias("service_id"), "file_path", F.col("line_start").alias("s_start"), F.col("line_end").alias("s_end"))
    met = methods.select("id", "file_path", "line_start", "line_end").join(services, "file_path").where("s_start <= line_start and s_end >= line_end")
    return met.groupBy("id").agg(F.min_by("service_id", F.struct(F.col("s_end") - F.col("s_start"), "service_id")).alias("service_id"))


def trace(nodes: DataFrame, edges: DataFrame, records: DataFrame, target: str) -> DataFrame:
    """(role, id, confidence): definition, handler, client, may_call and related rows of an RPC.

    Handlers and clients are the target's own nodes in code and the ends of edges into its anchors (an exact
    edge raises a handler).  ``may_call``: callers of a method's service in files that hold no call that is
    resolved to the service's methods.
    """
    matched, related = anchors(nodes, target)
    proto = F.endswith("file_path", F.lit(".proto"))
    kept = matched.where(proto | F.col("is_symbol"))
    define = kept.where(proto).select(F.lit("definition").alias("role"), "id", "confidence")
    own = kept.where(~proto).select(F.when(F.startswith("name", F.lit("rpc:")), "client").otherwise("handler").alias("role"), "id", "confidence")
    into = edges.join(kept.select(F.col("id").alias("to_id")).distinct(), "to_id", "left_semi")
    ends = into.where("kind in ('implements', 'calls_rpc')").select(F.when(F.col("kind") == "implements", "handler").otherwise("client").alias("role"), F.col("from_id").alias("id"), "confidence")
    rank = schema.confidence_rank(F.col("confidence"))
    direct = own.unionByName(ends).groupBy("role", "id").agg(F.min(rank).alias("rank")).select("role", "id", schema.confidence_of(F.col("rank")).alias("confidence"))
    services = enclosing_services(kept.where("kind = 'grpc_method'"), nodes).select("service_id").distinct()
    names = services.join(nodes, F.col("service_id") == F.col("id")).select(F.lower("name").alias("service")).distinct()
    resolved = records.where(F.col("record").rlike("^[=#]")).select("node_id", F.lower(F.when(F.startswith("record", F.lit("=")), F.regexp_extract("record", r"^=(.*)\.[^.]*$", 1)).otherwise(F.regexp_extract("record", r"^#[^=]*=(.*)$", 1))).alias("service"))
    resolved = resolved.join(names, "service", "left_semi").select(F.col("node_id").alias("id"))
    files = resolved.union(direct.where("role = 'client'").select("id")).join(nodes, "id").select("file_path").distinct()
    callers = edges.where("kind = 'calls_rpc'").join(services, F.col("to_id") == F.col("service_id"), "left_semi").groupBy(F.col("from_id").alias("id")).agg(F.min(rank).alias("rank"))
    may = callers.join(nodes.select("id", "file_path"), "id").join(files, "file_path", "left_anti").select(F.lit("may_call").alias("role"), "id", schema.confidence_of(F.col("rank")).alias("confidence"))
    other = related.select(F.lit("related").alias("role"), "id", "confidence")
    return define.unionByName(direct).unionByName(may).unionByName(other)


def map_entry_compatible(key_type: Column, value_type: Column, entry: Column, verdict) -> Column:
    """Whether ``map<key, value>`` and a repeated entry message agree.

    entry: array<struct<number, cardinality, value_type>> of the message's fields; it must have exactly the
    singular fields 1 and 2.  verdict(a, b): compatibility of two types (0 good, 1 unknown, 2 bad); the worse counts.
    """
    of = lambda n: F.get(F.filter(entry, lambda f: (f["number"] == n) & (f["cardinality"] == "singular")), F.lit(0))
    shape = (F.size(entry) == 2) & of(1).isNotNull() & of(2).isNotNull()
    return F.when(shape, F.greatest(verdict(key_type, of(1)["value_type"]), verdict(value_type, of(2)["value_type"]))).otherwise(F.lit(2))


def first_by(rows: DataFrame, key: list[str], order: list) -> DataFrame:
    w = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")
