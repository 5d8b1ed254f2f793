"""Topic hubs, wildcard subscriptions and impact walks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators import topics
from weftline.plans import projections as P
from weftline.queries.registry import register

_FACTS = """
 pr AS (SELECT DISTINCT l_suppkey * 1000000 + l_partkey + 1000000000000 AS node_id, 'f' || ((l_suppkey * 37 + l_partkey) % 500) AS file_path, 'part.' || l_partkey AS topic, l_suppkey % 3 = 0 AS heuristic FROM lineitem),
 co AS (SELECT DISTINCT o_custkey + 2000000000000 AS node_id, 'f' || (o_custkey % 700) AS file_path, 'part.' || l_partkey AS topic, o_custkey % 5 = 0 AS heuristic FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


@register(
    "topic_edges",
    f"""WITH {_FACTS} SELECT node_id, topic, 'produces' AS kind, CASE WHEN heuristic THEN 'heuristic' ELSE 'exact' END AS confidence FROM pr
        UNION ALL SELECT node_id, topic, 'consumes', CASE WHEN heuristic THEN 'heuristic' ELSE 'exact' END FROM co""",
)
def topic_edges(spark: SparkSession, sf: str) -> DataFrame:
    return topics.topic_edges(P.producers(spark, sf), P.consumers(spark, sf))


@register(
    "topic_hubs",
    f"""WITH {_FACTS}, e AS (SELECT topic, 1 AS p, 0 AS c FROM pr UNION ALL SELECT topic, 0, 1 FROM co)
        SELECT topic, sum(p)::BIGINT AS producers, sum(c)::BIGINT AS consumers, 'topic://' || topic AS signature FROM e GROUP BY 1""",
)
def topic_hubs(spark: SparkSession, sf: str) -> DataFrame:
    return topics.topic_hubs(topic_edges(spark, sf))


def _named(spark: SparkSession, sf: str) -> DataFrame:
    part = P.read(spark, sf, "part")
    topic = F.concat_ws(".", F.translate(F.lower("p_name"), " ", "."), F.col("p_size").cast("string"))
    return part.select(F.col("p_partkey").alias("node_id"), topic.alias("topic"), F.lit(False).alias("heuristic"))


_PATTERNS = [(1, "*.*.7"), (2, "red.>"), (3, "*.>"), (4, "plain.topic"), (5, "*"), (6, "*.*.*")]


@register(
    "wildcard_edges",
    """WITH t AS (SELECT p_partkey AS node_id, replace(lower(p_name), ' ', '.') || '.' || p_size AS topic FROM part),
       m AS (SELECT '*.*.7' AS pattern, '^[^.]+[.][^.]+[.]7$' AS r UNION ALL SELECT 'red.>', '^red[.].+$' UNION ALL SELECT '*.>', '^[^.]+[.].+$' UNION ALL SELECT '*', '^[^.]+$' UNION ALL SELECT '*.*.*', '^[^.]+[.][^.]+[.][^.]+$'),
       s AS (SELECT * FROM (VALUES (1, '*.*.7'), (2, 'red.>'), (3, '*.>'), (5, '*'), (6, '*.*.*')) v(node_id, pattern)),
       h AS (SELECT pattern, node_id, topic FROM t JOIN m ON regexp_matches(topic, r) WHERE NOT regexp_matches(topic, '(^|[.])([.]|$)') ),
       k AS (SELECT h.* FROM h ANTI JOIN s ON h.node_id = s.node_id AND h.pattern = s.pattern)
       SELECT pattern, topic, node_id FROM (SELECT *, row_number() OVER (PARTITION BY pattern ORDER BY encode(topic), node_id) AS r FROM k) WHERE r <= 256""",
)
def wildcard_edges(spark: SparkSession, sf: str) -> DataFrame:
    rows = [F.struct(F.lit(n).cast("long").alias("node_id"), F.lit(p).alias("pattern")) for n, p in _PATTERNS]
    subs = spark.range(1).select(F.explode(F.array(*rows)).alias("x")).select("x.*")
    return topics.wildcard_edges(_named(spark, sf), subs)


def _walk_sql(depth: int) -> str:
    steps = [
        "t1 AS (SELECT min(topic) AS topic FROM pr)",
        "c1 AS (SELECT co.node_id, min(co.file_path) AS file_path, min(co.topic) AS topic FROM co JOIN t1 ON co.topic = t1.topic GROUP BY 1)",
    ]
    seen_t, seen_c = ["SELECT topic FROM t1"], ["SELECT node_id FROM c1"]
    for h in range(2, depth + 1):
        steps.append(f"t{h} AS (SELECT DISTINCT topic FROM pr WHERE (file_path IN (SELECT file_path FROM c{h - 1}) OR node_id IN (SELECT node_id FROM c{h - 1})) AND topic NOT IN ({' UNION ALL '.join(seen_t)}))")
        steps.append(f"c{h} AS (SELECT co.node_id, min(co.file_path) AS file_path, min(co.topic) AS topic FROM co JOIN t{h} ON co.topic = t{h}.topic WHERE co.node_id NOT IN ({' UNION ALL '.join(seen_c)}) GROUP BY 1)")
        seen_t.append(f"SELECT topic FROM t{h}")
        seen_c.append(f"SELECT node_id FROM c{h}")
    parts = ["SELECT 1 AS hop, 'producer' AS role, node_id, pr.topic FROM pr JOIN t1 USING (topic)"]
    for h in range(1, depth + 1):
        parts += [f"SELECT {h}, 'topic', NULL, topic FROM t{h}", f"SELECT {h}, 'consumer', node_id, topic FROM c{h}"]
    return f"WITH {_FACTS}, {', '.join(steps)} {' UNION ALL '.join(parts)}"


def _impact(depth: int):
    def query(spark: SparkSession, sf: str) -> DataFrame:
        p = P.producers(spark, sf)
        topic = p.agg(F.min("topic")).first()[0]
        return topics.impact_walk(p, P.consumers(spark, sf), topic, depth)

    return query


for _depth in range(1, 6):
    register(f"impact_depth_{_depth}", _walk_sql(_depth))(_impact(_depth))


@register(
    "impact_chain_end",
    _walk_sql(3).replace("SELECT 1 AS hop, 'producer'", "SELECT node_id FROM (SELECT 1 AS hop, 'producer'", 1)
    + ") w WHERE role = 'consumer' AND hop < 3 AND node_id NOT IN (SELECT co.node_id FROM co WHERE file_path IN (SELECT file_path FROM pr)) AND node_id NOT IN (SELECT node_id FROM pr)",
)
def impact_chain_end(spark: SparkSession, sf: str) -> DataFrame:
    """Expanded consumers that neither produce nor share a file with a producer."""
    p, c = P.producers(spark, sf), P.consumers(spark, sf)
    walk = _impact(3)(spark, sf).where("role = 'consumer' and hop < 3").select("node_id")
    emits = c.join(p.select("file_path").distinct(), "file_path", "left_semi").select("node_id").union(p.select("node_id")).distinct()
    return walk.join(emits, "node_id", "left_anti")
