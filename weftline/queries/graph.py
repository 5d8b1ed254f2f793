"""Import resolution, dependents, symbol search and topology over the projected facts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline import schema
from weftline.functions import text as T
from weftline.operators import resolve, search, topology
from weftline.plans import projections as P
from weftline.queries.registry import register

NODES_SQL = """
 pn AS (SELECT p_partkey AS id, p_name AS name, CASE p_size % 5 WHEN 0 THEN 'interface' WHEN 1 THEN 'http_endpoint' WHEN 2 THEN 'grpc_method' ELSE 'service_class' END AS kind,
   '/r' || (p_partkey % 25) || CASE WHEN p_partkey % 7 = 0 THEN '/tests/' ELSE '/src/' END || p_brand || '/f' || (p_partkey % 200) || '.java' AS file_path,
   p_size AS line_start, p_brand AS package, (p_partkey % 25)::INTEGER AS repo_id FROM part),
 sn AS (SELECT s_suppkey + 1000000000000 AS id, s_name AS name, 'service_class' AS kind,
   '/r' || s_nationkey || CASE WHEN s_suppkey % 6 = 0 THEN '/tests/s' ELSE '/src/s' END || (s_suppkey % 40) || '.java' AS file_path,
   1 AS line_start, 'pkg' || (s_suppkey % 12) AS package, s_nationkey AS repo_id FROM supplier),
 imp AS (SELECT DISTINCT l_suppkey + 1000000000000 AS node_id, p_name AS target FROM lineitem JOIN part ON l_partkey = p_partkey)"""
EDGES_SQL = NODES_SQL + """,
 cand AS (SELECT i.node_id, i.target, s.repo_id, p.id AS to_id, p.repo_id AS cand_repo FROM imp i JOIN sn s ON s.id = i.node_id JOIN pn p ON p.name = i.target),
 cnt AS (SELECT *, count(*) OVER (PARTITION BY node_id, target) AS n, sum((cand_repo = repo_id)::INT) OVER (PARTITION BY node_id, target) AS s FROM cand),
 edg AS (SELECT node_id, target, to_id, CASE WHEN n = 1 OR s = 1 THEN 'heuristic' ELSE 'ambiguous' END AS confidence FROM cnt WHERE n = 1 OR s = 0 OR cand_repo = repo_id)"""


def edges(spark: SparkSession, sf: str) -> DataFrame:
    nodes = P.part_nodes(spark, sf).unionByName(P.supplier_nodes(spark, sf))
    return resolve.resolve_imports(P.import_facts(spark, sf), nodes)


@register("import_resolve", f"WITH {EDGES_SQL} SELECT node_id, target, to_id, confidence FROM edg")
def import_resolve(spark: SparkSession, sf: str) -> DataFrame:
    return edges(spark, sf)


@register(
    "import_resolve_by_package",
    f"""WITH {NODES_SQL}, f AS (SELECT s.id AS node_id, s.repo_id, 'Brand' || '.' || s.package AS x, p.package AS target FROM sn s JOIN (SELECT DISTINCT package FROM pn) p ON hash(s.id) IS NOT NULL AND s.id % 25 = ascii(right(p.package, 1)) % 25),
        e AS (SELECT s.id AS node_id, s.repo_id, p.package || '.' || p.name AS target, min(q.id) AS to_id FROM sn s JOIN pn p ON p.id = s.id - 1000000000000 JOIN pn q ON q.package = p.package AND q.name = p.name GROUP BY 1, 2, 3)
        SELECT node_id, target, to_id, 'exact' AS confidence FROM e""",
)
def import_resolve_by_package(spark: SparkSession, sf: str) -> DataFrame:
    return resolve.resolve_imports(_qualified(spark, sf), P.part_nodes(spark, sf).unionByName(P.supplier_nodes(spark, sf)))


def _qualified(spark: SparkSession, sf: str) -> DataFrame:
    """Every supplier imports a part by package and name."""
    own = P.supplier_nodes(spark, sf).select(F.col("id").alias("node_id"), (F.col("id") - P.SUPPLIER_BASE).alias("p"))
    return own.join(P.part_nodes(spark, sf), F.col("p") == F.col("id")).select("node_id", F.concat_ws(".", "package", "name").alias("target"))


def _target(spark: SparkSession, sf: str) -> str:
    return P.part_nodes(spark, sf).agg(F.min("name")).first()[0]


_DEP_SQL = NODES_SQL + ", dep AS (SELECT DISTINCT node_id AS id FROM imp WHERE target = (SELECT min(name) FROM pn) OR starts_with(target, (SELECT min(name) FROM pn) || '/'))"


def _dependents(spark: SparkSession, sf: str) -> DataFrame:
    none = spark.range(0).select(F.col("id").alias("from_id"), F.col("id").alias("to_id"), F.lit("imports").alias("kind"))
    return resolve.dependents(P.import_facts(spark, sf), P.part_nodes(spark, sf), none, _target(spark, sf))


@register("dependents_symbol", f"WITH {_DEP_SQL} SELECT id, 1 AS tier FROM dep")
def dependents_symbol(spark: SparkSession, sf: str) -> DataFrame:
    return _dependents(spark, sf)


@register("dependents_file", f"WITH {_DEP_SQL} SELECT file_path, min(line_start)::INTEGER AS line_start, count(*)::BIGINT AS symbols FROM dep JOIN sn USING (id) GROUP BY 1")
def dependents_file(spark: SparkSession, sf: str) -> DataFrame:
    rows = _dependents(spark, sf).select("id").join(P.supplier_nodes(spark, sf), "id")
    return rows.groupBy("file_path").agg(F.min("line_start").alias("line_start"), F.count(F.lit(1)).alias("symbols"))


@register("dependents_package", f"WITH {_DEP_SQL} SELECT repo_id, package, count(DISTINCT file_path)::BIGINT AS files, count(*)::BIGINT AS symbols FROM dep JOIN sn USING (id) GROUP BY 1, 2")
def dependents_package(spark: SparkSession, sf: str) -> DataFrame:
    return resolve.dependents_by_package(_dependents(spark, sf), P.supplier_nodes(spark, sf))


@register(
    "dependents_reps",
    f"""WITH {_DEP_SQL}, r AS (SELECT sn.*, contains(file_path, '/tests/') AS t FROM dep JOIN sn USING (id)),
        f AS (SELECT *, row_number() OVER (PARTITION BY repo_id, package, file_path ORDER BY t, line_start, name, id) AS r1 FROM r),
        p AS (SELECT *, (row_number() OVER (PARTITION BY repo_id, package ORDER BY t, file_path, line_start, name, id))::INTEGER AS rank FROM f WHERE r1 = 1)
        SELECT repo_id, package, rank, id, file_path, line_start::INTEGER AS line_start, name FROM p WHERE rank <= 3""",
)
def dependents_reps(spark: SparkSession, sf: str) -> DataFrame:
    none = spark.range(0).select(F.col("id").alias("to_id"))
    return resolve.representatives(_dependents(spark, sf), P.supplier_nodes(spark, sf), none)


_HITS = NODES_SQL + """, hits AS (SELECT id, name, kind, file_path, line_start::INTEGER AS line_start,
   (CASE WHEN lower(name) = 're' THEN 0 WHEN starts_with(lower(name), 're') THEN 1 WHEN contains(lower(name), 're') THEN 2 END)::INTEGER AS match,
   (CASE kind WHEN 'grpc_method' THEN 0 WHEN 'http_endpoint' THEN 1 WHEN 'interface' THEN 3 ELSE 4 END)::INTEGER AS kind_rank FROM pn WHERE contains(lower(name), 're'))"""


@register("symbol_search", f"WITH {_HITS} SELECT * FROM hits")
def symbol_search(spark: SparkSession, sf: str) -> DataFrame:
    return search.search_symbols(P.part_nodes(spark, sf), "re")


@register(
    "symbol_search_scoped",
    f"WITH {_HITS} SELECT * FROM hits WHERE starts_with(file_path, '/r1/')",
)
def symbol_search_scoped(spark: SparkSession, sf: str) -> DataFrame:
    return search.search_symbols(P.part_nodes(spark, sf), "re", "/r1")


_FILES = _HITS + ", files AS (SELECT DISTINCT ON (file_path) file_path, match, kind_rank, line_start, name FROM hits ORDER BY file_path, match, kind_rank, line_start, name)"


@register("symbol_search_files", f"WITH {_FILES} SELECT * FROM files")
def symbol_search_files(spark: SparkSession, sf: str) -> DataFrame:
    return search.rank_files(symbol_search(spark, sf))


@register(
    "page_by_budget",
    f"""WITH {_FILES}, p AS (SELECT *, (row_number() OVER w)::INTEGER AS position FROM files WINDOW w AS (ORDER BY match, kind_rank, file_path)),
        q AS (SELECT *, (sum(strlen(file_path) + strlen(name)) OVER (ORDER BY position))::BIGINT AS bytes FROM p WHERE position > 5 AND position <= 45)
        SELECT file_path, name, position, bytes FROM q WHERE bytes <= 700 OR position = 6""",
)
def page_by_budget(spark: SparkSession, sf: str) -> DataFrame:
    size = (F.octet_length("file_path") + F.octet_length("name")).cast("long")
    page = search.page_by_bytes(symbol_search_files(spark, sf), ["match", "kind_rank", "file_path"], size, 5, 40, 700)
    return page.select("file_path", "name", "position", "bytes")


_TOPO = EDGES_SQL + """, grp AS (SELECT id, repo_id::VARCHAR AS grp FROM pn UNION ALL SELECT id, repo_id::VARCHAR FROM sn),
 al_e AS (SELECT node_id, target, to_id, confidence, 'imports' AS kind FROM edg UNION ALL
   SELECT s.id, p.package || '.' || p.name, (SELECT min(q.id) FROM pn q WHERE q.package = p.package AND q.name = p.name), 'exact', 'calls_rpc' FROM sn s JOIN pn p ON p.id = s.id - 1000000000000),
 pl AS (SELECT e.*, a.grp AS from_grp, b.grp AS to_grp FROM al_e e JOIN grp a ON a.id = e.node_id JOIN grp b ON b.id = e.to_id),
 un AS (SELECT node_id, from_grp, target, kind, min(to_grp) AS to_grp, max(to_grp) AS last FROM pl WHERE confidence = 'ambiguous' GROUP BY 1, 2, 3, 4),
 al AS (SELECT from_grp, to_grp, kind, CASE confidence WHEN 'exact' THEN 0 ELSE 1 END AS rank FROM pl WHERE confidence <> 'ambiguous' UNION ALL SELECT from_grp, to_grp, kind, 1 FROM un WHERE to_grp = last),
 li AS (SELECT from_grp, to_grp, kind, count(*)::BIGINT AS count, CASE max(rank) WHEN 0 THEN 'exact' ELSE 'heuristic' END AS confidence FROM al WHERE from_grp <> to_grp GROUP BY 1, 2, 3),
 de AS (SELECT g.grp, count(*)::BIGINT AS contracts FROM grp g GROUP BY 1),
 dg AS (SELECT d.grp, contracts, coalesce((SELECT sum(count) FROM (SELECT from_grp AS g, count FROM li UNION ALL SELECT to_grp, count FROM li) x WHERE x.g = d.grp), 0)::BIGINT AS degree,
          coalesce((SELECT count(*) FROM al WHERE from_grp = to_grp AND from_grp = d.grp), 0)::BIGINT AS internal FROM de d)"""


def _topology(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    nodes = P.part_nodes(spark, sf).unionByName(P.supplier_nodes(spark, sf))
    imported = (*resolve.import_classes(P.import_facts(spark, sf), nodes), "imports")
    called = (*resolve.import_classes(_qualified(spark, sf), nodes), "calls_rpc")
    none = spark.createDataFrame([], schema.EDGES)
    return topology.build(none, nodes.select("id", F.col("repo_id").cast("string").alias("grp")), [imported, called])


@register("topology_links", f"WITH {_TOPO} SELECT * FROM li")
def topology_links(spark: SparkSession, sf: str) -> DataFrame:
    return _topology(spark, sf)[0].select("from_grp", "to_grp", "kind", "count", "confidence")


@register("topology_groups", f"WITH {_TOPO} SELECT grp, contracts, degree, internal, (row_number() OVER (ORDER BY degree DESC, contracts DESC, grp))::INTEGER AS rank FROM dg")
def topology_groups(spark: SparkSession, sf: str) -> DataFrame:
    return topology.rank_groups(_topology(spark, sf)[1]).select("grp", "contracts", "degree", "internal", "rank")


@register("topology_omitted", f"WITH {_TOPO} SELECT count(*)::BIGINT AS ambiguous_omitted FROM un WHERE to_grp <> last")
def topology_omitted(spark: SparkSession, sf: str) -> DataFrame:
    return _topology(spark, sf)[2]


@register(
    "topology_select",
    f"""WITH {_TOPO}, top AS (SELECT grp FROM dg ORDER BY degree DESC, contracts DESC, grp LIMIT 8),
        s AS (SELECT CASE WHEN from_grp IN (FROM top) THEN from_grp ELSE 'other' END AS from_grp, CASE WHEN to_grp IN (FROM top) THEN to_grp ELSE 'other' END AS to_grp, kind, count, CASE confidence WHEN 'exact' THEN 0 ELSE 1 END AS rank FROM li)
        SELECT from_grp, to_grp, kind, sum(count)::BIGINT AS count, CASE max(rank) WHEN 0 THEN 'exact' ELSE 'heuristic' END AS confidence FROM s WHERE from_grp <> to_grp GROUP BY 1, 2, 3""",
)
def topology_select(spark: SparkSession, sf: str) -> DataFrame:
    links, degrees, _ = _topology(spark, sf)
    return topology.select(links, degrees, 8).select("from_grp", "to_grp", "kind", "count", "confidence")


@register(
    "implements_candidates",
    f"""WITH {NODES_SQL}, a AS (SELECT id AS proto_id, name FROM pn WHERE kind = 'grpc_method'), b AS (SELECT id AS handler_id, CASE WHEN id % 3 = 0 THEN name WHEN id % 3 = 1 THEN lower(replace(name, ' ', '_')) ELSE 'x' || name END AS name FROM pn WHERE kind <> 'grpc_method')
        SELECT proto_id, handler_id, CASE WHEN a.name = b.name THEN 'exact' ELSE 'heuristic' END AS confidence FROM a JOIN b ON lower(replace(split_part(a.name, '.', -1), '_', '')) = lower(replace(split_part(b.name, '.', -1), '_', ''))
          OR list_aggregate(list_transform(list_filter(string_split_regex(b.name, '[-_./ ]'), lambda x: x <> ''), lambda x: upper(x[1]) || x[2:]), 'string_agg', '') = a.name""",
)
def implements_candidates(spark: SparkSession, sf: str) -> DataFrame:
    n = P.part_nodes(spark, sf)
    spelled = F.when(F.col("id") % 3 == 0, F.col("name")).when(F.col("id") % 3 == 1, F.lower(F.translate("name", " ", "_"))).otherwise(F.concat(F.lit("x"), "name"))
    return resolve.implements(n.where("kind = 'grpc_method'"), n.where("kind != 'grpc_method'").withColumn("name", spelled))


@register(
    "rpc_resolve",
    f"""WITH {NODES_SQL}, c AS (SELECT DISTINCT s.id AS node_id, s.repo_id, i.target FROM imp i JOIN sn s ON s.id = i.node_id),
        k AS (SELECT c.*, p.id AS to_id, p.repo_id AS cand_repo FROM c JOIN pn p ON p.kind = 'grpc_method' AND lower(p.name) = lower(c.target)),
        m AS (SELECT *, count(*) OVER w AS n, sum((cand_repo = repo_id)::INT) OVER w AS s FROM k WINDOW w AS (PARTITION BY node_id, target))
        SELECT node_id, target, to_id, CASE WHEN n = 1 OR s = 1 THEN 'exact' ELSE 'ambiguous' END AS confidence FROM m WHERE n = 1 OR s = 0 OR cand_repo = repo_id""",
)
def rpc_resolve(spark: SparkSession, sf: str) -> DataFrame:
    nodes = P.part_nodes(spark, sf).unionByName(P.supplier_nodes(spark, sf))
    return resolve.resolve_rpc(P.import_facts(spark, sf), nodes)
