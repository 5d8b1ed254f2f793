"""Topic hubs, their edges, and bounded event-flow walks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline import schema
from weftline.functions import text as T
from weftline.plans.store import materialize


def topic_edges(producers: DataFrame, consumers: DataFrame) -> DataFrame:
    """(node_id, topic, kind, confidence): producer -> hub and hub -> consumer, one per (node, topic, kind)."""
    facts = producers.select("node_id", "topic", "heuristic", F.lit("produces").alias("kind")).unionByName(consumers.select("node_id", "topic", "heuristic", F.lit("consumes").alias("kind")))
    return facts.groupBy("node_id", "topic", "kind").agg(F.when(F.min("heuristic"), "heuristic").otherwise("exact").alias("confidence"))


def topic_hubs(edges: DataFrame) -> DataFrame:
    """topic, signature, producers, consumers."""
    return edges.groupBy("topic").agg(F.count_if(F.col("kind") == "produces").alias("producers"), F.count_if(F.col("kind") == "consumes").alias("consumers")).withColumn("signature", F.concat(F.lit("topic://"), "topic"))


def wildcard_edges(producers: DataFrame, subscriptions: DataFrame, most: int = schema.WILDCARD_PRODUCERS) -> DataFrame:
    """(pattern, topic, node_id) linked by a wildcard subscription, at most ``most`` per pattern by (topic, node).

    subscriptions: (node_id, pattern).  Distinct topics meet patterns by an equi-join on the separator and the
    first token (a topic's, or the wildcard), and the exact rule decides.  Producers that also consume
    the pattern are skipped.
    """
    patterns = subscriptions.where(T.is_subject_pattern(F.col("pattern"))).select("pattern").distinct()
    slash = F.contains("pattern", F.lit("/"))
    token = F.when(slash, F.element_at(F.split("pattern", "/"), 1)).otherwise(F.element_at(F.split("pattern", r"\."), 1))
    any_token = F.when(slash, token.isin("+", "#")).otherwise(token.isin("*", ">"))
    patterns = patterns.select("pattern", F.concat(F.when(slash, "/").otherwise("."), F.when(any_token, F.lit("")).otherwise(F.concat(F.lit("="), token))).alias("k"))
    topics = producers.select("topic").distinct()
    keys = F.array(F.lit("/"), F.lit("."), F.concat(F.lit("/="), F.element_at(F.split("topic", "/"), 1)), F.concat(F.lit(".="), F.element_at(F.split("topic", r"\."), 1)))
    pairs = topics.withColumn("k", F.explode(keys)).join(patterns, "k").where(T.subject_matches(F.col("pattern"), F.col("topic"))).select("topic", "pattern").distinct()
    rows = pairs.join(producers.select("topic", "node_id").distinct(), "topic")
    rows = rows.join(subscriptions.select("node_id", "pattern"), ["node_id", "pattern"], "left_anti")
    first = rows.groupBy("pattern", "node_id").agg(F.min("topic").alias("topic"))  # an edge that exists is not inserted again
    w = Window.partitionBy("pattern").orderBy("topic", "node_id")
    return first.withColumn("r", F.row_number().over(w)).where(F.col("r") <= most).select("pattern", "topic", "node_id")


def start_topics(facts: DataFrame, target: str) -> DataFrame:
    """topic: the keys a target means: that key; else the keys that hold it; if no key holds it, the same for its
    spelling with ``_`` in place of ``. : - /``.  facts: topic."""
    keys = facts.select("topic").distinct()
    raw = T.topic_key(F.lit(target))
    other = F.regexp_replace(raw, "[.:/-]", "_")
    flag = lambda c: F.coalesce(F.max(c), F.lit(False))
    told = [flag(test("topic", k)) for k in (raw, other) for test in (F.contains, lambda c, k: F.col(c) == k)]
    holds, equals, other_holds, other_equals = keys.agg(*told).first()  # four truth values
    key, exact = (other, other_equals) if not holds and other_holds else (raw, equals)
    return keys.where(F.col("topic") == key if exact else F.contains("topic", key))


def impact_walk(producers: DataFrame, consumers: DataFrame, topic: str, depth: int = 1) -> DataFrame:
    """(hop, role, node_id, topic) reached from a topic (see ``start_topics``) within ``depth`` (1..5) hops.

    A hop goes from frontier consumers to topics that they, or producers in their files, produce,
    and on to new consumers of those topics.  Topics and nodes count once, at their first hop; the
    frontier alone is joined against the facts, by equi-joins, and hops are bounded, so lineage is too.
    """
    depth = min(max(depth, 1), schema.IMPACT_HOPS)
    p, c = producers.select("node_id", "file_path", "topic").distinct(), consumers.select("node_id", "file_path", "topic").distinct()
    if depth > 1:  # a hop is read several times later; lineage must not multiply
        p, c = materialize(p, "walk-producers"), materialize(c, "walk-consumers")
    topics = start_topics(p.select("topic").union(c.select("topic")), topic).withColumn("hop", F.lit(1))
    if depth > 1:
        topics = materialize(topics, "walk-topics-1")
    start = p.join(topics.select("topic"), "topic", "left_semi").select(F.lit(1).alias("hop"), F.lit("producer").alias("role"), "node_id", "topic")

    def hop_of(found: DataFrame, hop: int) -> DataFrame:
        rows = found.groupBy("node_id").agg(F.min("file_path").alias("file_path"), F.min("topic").alias("topic")).withColumn("hop", F.lit(hop))
        return materialize(rows, f"walk-{hop}") if depth > 1 else rows

    frontier = reached = hop_of(c.join(topics.select("topic"), "topic"), 1)
    for hop in range(2, depth + 1):
        files = frontier.select("file_path").distinct()
        emitted = p.join(files, "file_path", "left_semi").select("topic").union(p.join(frontier.select("node_id"), "node_id", "left_semi").select("topic")).distinct()
        new_topics = materialize(emitted.join(topics, "topic", "left_anti").withColumn("hop", F.lit(hop)), f"walk-topics-{hop}")
        topics = topics.unionByName(new_topics)
        frontier = hop_of(c.join(new_topics.select("topic"), "topic").join(reached.select("node_id"), "node_id", "left_anti"), hop)
        reached = reached.unionByName(frontier)
    consumed = reached.select("hop", F.lit("consumer").alias("role"), "node_id", "topic")
    through = topics.select("hop", F.lit("topic").alias("role"), F.lit(None).cast("bigint").alias("node_id"), "topic")
    return start.unionByName(through).unionByName(consumed)
