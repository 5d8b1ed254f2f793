"""A snapshot of facts, its derived edges, and the questions asked of them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline import schema
from weftline.functions import text as T
from weftline.operators import calls, resolve, topics


@dataclass(frozen=True)
class Snapshot:
    """Fact tables of one generation: nodes (schema.NODES), imports, producers and consumers
    (node_id, file_path, topic, heuristic), rpc_calls (node_id, target) and, from typed clients,
    rpc_records (node_id, record; see ``calls``)."""

    nodes: DataFrame
    imports: DataFrame
    producers: DataFrame
    consumers: DataFrame
    rpc_calls: DataFrame
    rpc_records: DataFrame | None = None


def topic_id(topic):
    """Id of a topic's hub: negative, so it never meets a declaration's."""
    return -(F.xxhash64(topic).bitwiseAND(F.lit(0x7FFFFFFFFFFFFFFF)))


def derive_edges(s: Snapshot) -> DataFrame:
    """All edges, one per (from, to, kind); of several the first pass wins: imports, topics, wildcards, implements, calls.

    A subscription to a subject pattern is linked with the producers of the topics it matches, unless all its
    consumers are Kafka topics or queues.  Calls on whole services and on methods (``rpc_records``) are both kept.
    """
    row = lambda df, f, t, kind, meta, n: df.select(F.col(f).alias("from_id"), F.col(t).alias("to_id"), F.lit(kind).alias("kind"), meta.alias("metadata"), "confidence", F.lit(n).alias("pass"))
    none = F.lit(None).cast("string")
    imports = row(resolve.resolve_imports(s.imports, s.nodes), "node_id", "to_id", "imports", F.col("target"), 1)
    hubs = topics.topic_edges(s.producers, s.consumers).withColumn("hub", topic_id(F.col("topic")))
    produced = row(hubs.where("kind = 'produces'"), "node_id", "hub", "produces", F.col("topic"), 2)
    consumed = row(hubs.where("kind = 'consumes'"), "hub", "node_id", "consumes", F.col("topic"), 2)
    subscribers = s.consumers.join(s.nodes.select(F.col("id").alias("node_id"), "kind"), "node_id")
    subjects = subscribers.where(~F.col("kind").isin("kafka_topic", "queue")).select("topic").distinct()
    subscriptions = s.consumers.join(subjects, "topic", "left_semi").select("node_id", F.col("topic").alias("pattern"))
    matched = topics.wildcard_edges(s.producers, subscriptions).withColumns({"hub": topic_id(F.col("pattern")), "confidence": F.lit("heuristic")})
    wild = row(matched, "node_id", "hub", "produces", F.col("topic"), 3)
    is_proto = F.endswith("file_path", F.lit(".proto"))
    protos = s.nodes.where((F.col("kind") == "grpc_method") & is_proto)
    handlers = s.nodes.where(F.col("kind").isin("grpc_method", "grpc_service") & ~is_proto)
    if s.rpc_records is not None:  # a handler whose reference is resolved goes by the method's name
        known = calls.handler_names(s.rpc_records, s.nodes).select(F.col("node_id").alias("id"), F.col("name").alias("served"))
        handlers = handlers.join(known, "id", "left").withColumn("name", F.coalesce("served", "name")).drop("served")
    served = row(resolve.implements(protos, handlers), "handler_id", "proto_id", "implements", none, 4)
    called = row(resolve.resolve_rpc(s.rpc_calls, s.nodes), "node_id", "to_id", "calls_rpc", F.col("target"), 5)
    everything = imports.unionByName(produced).unionByName(consumed).unionByName(wild).unionByName(served).unionByName(called)
    if s.rpc_records is not None:
        everything = everything.unionByName(row(calls.method_calls(s.rpc_records, s.nodes), "node_id", "to_id", "calls_rpc", F.col("target"), 6))
    w = Window.partitionBy("from_id", "to_id", "kind").orderBy("pass", schema.confidence_rank(F.col("confidence")), "metadata")
    return everything.withColumn("r", F.row_number().over(w)).where("r = 1").drop("r", "pass")


def grpc_trace(s: Snapshot, edges: DataFrame, target: str) -> DataFrame:
    """(role, id, name, file_path, line_start, confidence, via): proto definitions, handlers and clients of an RPC."""
    low = F.lit(target.lower())
    named = (F.lower("name") == low) | (F.lower(T.bare_name(F.col("name"))) == low)
    anchors = s.nodes.where(F.col("kind").isin("grpc_method", "grpc_service") & named)
    define = anchors.select(F.lit("definition").alias("role"), "id", F.lit("exact").alias("confidence"), F.lit(None).cast("bigint").alias("via"))
    into = edges.join(anchors.select(F.col("id").alias("to_id")), "to_id", "left_semi")
    ends = into.where("kind in ('implements', 'calls_rpc')").select(F.when(F.col("kind") == "implements", "handler").otherwise("client").alias("role"), F.col("from_id").alias("id"), "confidence", F.col("to_id").alias("via"))
    rows = define.unionByName(ends)
    return rows.join(s.nodes.select("id", "name", "file_path", "line_start"), "id").select("role", "id", "name", "file_path", "line_start", "confidence", "via")


def impact_matrix(s: Snapshot, edges: DataFrame, target: str, depth: int = 1) -> DataFrame:
    """(scope, role, id, repo_id, confidence, via): what a change of an RPC or a topic touches.

    A row is INTERNAL when its repository owns the contract (serves the RPC or produces the topic), else EXTERNAL.
    Of several rows for one (id, role, via) the strongest confidence stays, EXTERNAL first on a tie.
    """
    trace = grpc_trace(s, edges, target)
    rpc = trace.where("role != 'definition'").select("role", "id", "confidence", F.col("via").cast("string").alias("via"))
    walk = topics.impact_walk(s.producers, s.consumers, target, depth)
    flow = walk.where("node_id is not null").select("role", F.col("node_id").alias("id"), F.when(F.col("hop") == 1, "exact").otherwise("heuristic").alias("confidence"), F.col("topic").alias("via"))
    rows = rpc.unionByName(flow).join(s.nodes.select("id", "repo_id"), "id")
    owners = rows.where("role in ('handler', 'producer')").select(F.col("repo_id").alias("owner")).distinct()
    rows = rows.join(owners, F.col("repo_id") == F.col("owner"), "left")
    scope = F.when(F.col("owner").isNotNull() & (F.col("repo_id") != schema.NO_REPO), "INTERNAL").otherwise("EXTERNAL")
    rows = rows.withColumn("scope", scope).drop("owner")
    w = Window.partitionBy("id", "role", "via").orderBy(schema.confidence_rank(F.col("confidence")), "scope")
    return rows.withColumn("r", F.row_number().over(w)).where("r = 1").select("scope", "role", "id", "repo_id", "confidence", "via")


def ordered_matrix(matrix: DataFrame, nodes: DataFrame) -> DataFrame:
    """Rows of an impact matrix with their place, in reading order: scope, role, path, line, name, via (none first), id."""
    scope = F.when(F.col("scope") == "EXTERNAL", 0).otherwise(1)
    role = F.when(F.col("role") == "producer", 0).when(F.col("role") == "handler", 1).when(F.col("role") == "client", 2).otherwise(3)
    rows = matrix.join(nodes.select("id", "name", "file_path", "line_start"), "id")
    return rows.orderBy(scope, role, "file_path", "line_start", "name", F.col("via").asc_nulls_first(), "id")


def nodes_of_file(nodes: DataFrame, path: str) -> DataFrame:
    return nodes.where(F.col("file_path") == path)


def edges_on(nodes: DataFrame, edges: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id, arrow, kind, other_id, confidence) of edges that touch wanted nodes (id), imports aside; from both ends."""
    rows = edges.where("kind != 'imports'")
    out = rows.join(wanted.select(F.col("id").alias("from_id")), "from_id", "left_semi").select(F.col("from_id").alias("id"), F.lit("->").alias("arrow"), "kind", F.col("to_id").alias("other_id"), "confidence")
    into = rows.join(wanted.select(F.col("id").alias("to_id")), "to_id", "left_semi").select(F.col("to_id").alias("id"), F.lit("<-").alias("arrow"), "kind", F.col("from_id").alias("other_id"), "confidence")
    return out.unionByName(into).distinct()


def route_impact(nodes: DataFrame, edges: DataFrame, target: str, prefix: str = "", routes: int = 25, most: int = 12) -> DataFrame:
    """(rank, id, arrow, kind, other_id, confidence) of the handlers that serve a route and their edges.

    Only whole routes count (exactly, or a value in a parameter's place); handlers without an edge keep a
    row with nulls; ``routes`` handlers by rank and place, ``most`` edges each.
    """
    from weftline.operators import search

    table = routes_of(nodes)
    hits = search.find_routes(table, target, prefix).where("rank <= 1").select("id", "rank")
    first = hits.join(nodes.select("id", "file_path", "line_start"), "id").orderBy("rank", "file_path", "line_start", "id").limit(routes)
    w = Window.partitionBy("id").orderBy("arrow", "kind", "other_id")
    shown = edges_on(nodes, edges, first).withColumn("n", F.row_number().over(w)).where(F.col("n") <= most).drop("n")
    return first.select("rank", "id").join(shown, "id", "left").select("rank", "id", "arrow", "kind", "other_id", "confidence")


def routes_of(nodes: DataFrame) -> DataFrame:
    """(id, verb, path, file_path, line_start) of endpoints: their signature, else their name, read as ``VERB /path``."""
    own = F.when(T.split_verb(F.col("signature")).isNotNull(), F.col("signature")).otherwise(F.col("name"))
    rows = nodes.where("kind = 'http_endpoint'").withColumn("label", own).withColumn("verb", T.split_verb(F.col("label")))
    path = F.trim(F.regexp_replace(F.ltrim("label"), r"^\S+\s+", ""))
    return rows.where("verb is not null").select("id", "verb", path.alias("path"), "file_path", "line_start")


def canonical_lines(s: Snapshot, edges: DataFrame, place=None) -> DataFrame:
    """line: one line per node, edge and fact that names nodes by what they are, not by id; repeats are kept.

    ``place``: file path -> the path written, such as one relative to its root.
    """
    where = (place or (lambda c: c))(F.col("file_path"))
    parts = [where, *[F.col(c).cast("string") for c in ("line_start", "line_end", "kind", "name", "package", "repo_id", "signature", "docstring")]]
    keys = s.nodes.select("id", F.to_json(F.array(*[F.coalesce(p, F.lit("\x00")) for p in parts])).alias("key"))
    hubs = s.producers.select("topic").union(s.consumers.select("topic")).distinct().select(topic_id(F.col("topic")).alias("id"), F.to_json(F.array(F.lit("topic"), "topic")).alias("key"))
    named = keys.unionByName(hubs)
    line = lambda head, *cells: F.concat(F.lit(head + " "), F.to_json(F.array(*[F.coalesce(c, F.lit("\x00")) for c in cells]))).alias("line")
    of = lambda side: named.select(F.col("id").alias(f"{side}_id"), F.col("key").alias(side))
    linked = edges.join(of("from"), "from_id").join(of("to"), "to_id")
    lines = keys.select(F.concat(F.lit("node "), "key").alias("line")).unionByName(linked.select(line("edge", F.col("kind"), F.col("from"), F.col("to"), F.col("metadata"), F.col("confidence"))))
    for head, table, column in (("dep", s.imports, "target"), ("produces", s.producers, "topic"), ("consumes", s.consumers, "topic"), ("rpc_call", s.rpc_calls, "target")):
        facts = table.select(F.col("node_id").alias("id"), F.col(column).alias("x")).join(keys, "id")
        lines = lines.unionByName(facts.select(line(head, F.col("x"), F.col("key"))))
    return lines


def outermost(nodes: DataFrame) -> DataFrame:
    """Declarations that lie in no other of their file: those whose start no earlier (or equal but longer) one covers."""
    w = Window.partitionBy("file_path").orderBy("line_start", F.desc("line_end"), "id").rowsBetween(Window.unboundedPreceding, -1)
    return nodes.withColumn("reach", F.max("line_end").over(w)).where(F.col("reach").isNull() | (F.col("line_end") > F.col("reach"))).drop("reach")
