"""Tables of the contract graph, their vocabularies and the limits that change answers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Node kinds and edge kinds (fixed values).
NODE_KINDS = (
    "grpc_service", "grpc_method", "http_endpoint", "kafka_topic", "event_stream", "queue",
    "proto_message", "post_processor", "saga", "service_class", "interface", "module",
)
EDGE_KINDS = ("produces", "consumes", "calls_rpc", "implements", "imports", "dispatches_to")
CONFIDENCE = ("exact", "heuristic", "ambiguous")
TOPIC_KINDS = ("kafka_topic", "event_stream", "queue")
NO_REPO = 65535

NODES = (
    "id bigint, name string, kind string, file_path string, line_start int, line_end int, "
    "package string, repo_id int, signature string, docstring string"
)
IMPORTS = "node_id bigint, target string"
TOPIC_FACTS = "node_id bigint, topic string, heuristic boolean"
RPC_CALLS = "node_id bigint, tagged_target string"
EDGES = "from_id bigint, to_id bigint, kind string, metadata string, confidence string"
SECTIONS = "file_path string, title string, level int, start_line int, end_line int, content string"
PROPERTIES = "key string, raw_value string, source string"

#: Limits (fixed values).
SOURCE_BYTES, CONTRACT_BYTES, SNIFF_BYTES, LINE_BYTES, NESTING = 384 * 1024, 1536 * 1024, 4096, 1024, 64
WILDCARD_PRODUCERS, IMPACT_HOPS, SUBSTRING_MIN = 256, 5, 3
REPRESENTATIVES, TOP_ERRORS, PAGE_BYTES = 3, 3, 8192


def confidence_rank(c: Column) -> Column:
    return F.when(c == "exact", 0).when(c == "heuristic", 1).otherwise(2)


def confidence_of(rank: Column) -> Column:
    return F.when(rank == 0, "exact").when(rank == 1, "heuristic").otherwise("ambiguous")
