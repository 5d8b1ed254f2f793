"""Extraction of texts that a table carries: scripts, specifications, properties, Markdown, protobuf; routes and labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import file_routes as R
from weftline.functions import labels as L
from weftline.functions import secrets as S
from weftline.functions import text as T
from weftline.operators import cdc, graph, health
from weftline.operators import guard as G
from weftline.plans import projections as P
from weftline.queries.registry import register
from weftline.sources import extract, markdown, outline, proto, yaml_files

K = "p_partkey"


def _part(spark: SparkSession, sf: str) -> DataFrame:
    return P.spread(spark, sf, "part", K)


def _text(*pieces) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in pieces])


def _files(spark: SparkSession, sf: str, text: Column, ext: str, language: str) -> DataFrame:
    k = F.col(K)
    return _part(spark, sf).select(_text("/r/src/f", k, ext).alias("path"), (k % 5).cast("int").alias("repo_id"), F.lit(language).alias("language"), text.alias("text"))


@register(
    "script_events",
    """SELECT '/r/src/f' || p_partkey || '.ts' AS file_path, 'producer' AS role, 'orders.b' || (p_partkey % 7) AS topic, FALSE AS heuristic FROM part WHERE p_partkey % 3 <> 2
       UNION ALL SELECT '/r/src/f' || p_partkey || '.ts', 'consumer', 'paid-' || p_partkey, FALSE FROM part WHERE p_partkey % 3 = 0
       UNION ALL SELECT '/r/src/f' || p_partkey || '.ts', 'consumer', 'order_paid', TRUE FROM part WHERE p_partkey % 3 = 1""",
)
def script_events(spark: SparkSession, sf: str) -> DataFrame:
    """Broker clients with constants, templates and imported names; a bus without a broker library makes no event."""
    k = F.col(K)
    kafka = _text("import { Kafka } from 'kafkajs';\nconst ORDERS = 'orders';\nconst kafka = new Kafka({});\nconst out = kafka.producer(), into = kafka.consumer({ groupId: 'g' });\nexport async function run() {\n  await out.send({ topic: `${ORDERS}.b", k % 7, "` });\n  await into.subscribe({ topics: ['paid-", k, "'] });\n  bus.send({ topic: 'no' });\n}\n")
    nats = _text("import { connect } from 'nats';\nimport { ORDER_PAID } from './topics';\nexport const T = { B: 'orders.b", k % 7, "' } as const;\nasync function run() { const nc = await connect({}); nc.publish(T.B, x); nc.subscribe(ORDER_PAID); }\n")
    plain = _text("export class Bus { go() { this.bus.publish('no", k, "'); emitter.emit('no'); } }\n")
    facts = extract.extract(_files(spark, sf, F.when(k % 3 == 0, kafka).when(k % 3 == 1, nats).otherwise(plain), ".ts", "typescript"))
    t = extract.tables(facts)
    pick = lambda name, role: t[name].select("file_path", F.lit(role).alias("role"), "topic", "heuristic")
    return pick("producers", "producer").unionByName(pick("consumers", "consumer"))


@register(
    "script_routes",
    """SELECT '/r/src/f' || p_partkey || '.ts' AS file_path, 'GET /api/v' || (p_partkey % 4) || '/users/:id' AS label, 5 AS line FROM part WHERE p_partkey % 2 = 0
       UNION ALL SELECT '/r/src/f' || p_partkey || '.ts', 'POST /health', 6 FROM part WHERE p_partkey % 2 = 0
       UNION ALL SELECT '/r/src/f' || p_partkey || '.ts', 'PATCH /items' || p_partkey || '/:id', 4 FROM part WHERE p_partkey % 2 = 1""",
)
def script_routes(spark: SparkSession, sf: str) -> DataFrame:
    """Routers mounted twice removed, and decorated controllers."""
    k = F.col(K)
    express = _text("import express from 'express';\nconst app = express();\nconst users = express.Router();\nconst v = express.Router();\nusers.get('/:id', show);\napp.post('/health', (q, r) => r.end());\nv.use('/users', users);\napp.use('/api/v", k % 4, "', v);\naxios.get('/no', cfg);\n")
    nest = _text("import { Controller, Patch } from '@nestjs/common';\n@Controller('items", k, "')\nexport class C {\n  @Patch(':id')\n  change() {}\n}\n")
    facts = extract.extract(_files(spark, sf, F.when(k % 2 == 0, express).otherwise(nest), ".ts", "typescript"))
    rows = graph.routes_of(extract.tables(facts)["nodes"])
    return rows.select("file_path", F.concat_ws(" ", "verb", "path").alias("label"), F.col("line_start").alias("line"))


@register(
    "python_facts",
    """SELECT '/r/src/f' || p_partkey || '.py' AS path, 'producer' AS what, 'created.' || p_partkey AS target FROM part UNION ALL SELECT '/r/src/f' || p_partkey || '.py', 'consumer', 'job' || (p_partkey % 9) FROM part
       UNION ALL SELECT '/r/src/f' || p_partkey || '.py', 'rpc_call', 'User' FROM part WHERE p_partkey % 2 = 0""",
)
def python_facts(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col(K)
    call = F.when(k % 2 == 0, "    users_pb2_grpc.UserStub(ch)\n").otherwise("    pass\n")
    text = _text("import users_pb2_grpc\n\ndef create():\n    producer.send('created.", k, "', b'')\n", call, "\n@shared_task\ndef job", k % 9, "():\n    pass\n")
    facts = extract.extract(_files(spark, sf, text, ".py", "python"))
    return facts.where("what in ('producer', 'consumer', 'rpc_call')").select("path", "what", "target")


@register(
    "proto_nodes",
    """SELECT '/r/src/f' || p_partkey || '.proto' AS path, 'grpc_service' AS kind, 'S' || (p_partkey % 11) AS name, 'pkg.v' || (p_partkey % 3) AS package FROM part
       UNION ALL SELECT '/r/src/f' || p_partkey || '.proto', 'grpc_method', 'S' || (p_partkey % 11) || '.Get' || p_partkey, 'pkg.v' || (p_partkey % 3) FROM part
       UNION ALL SELECT '/r/src/f' || p_partkey || '.proto', 'proto_message', 'M' || p_partkey, 'pkg.v' || (p_partkey % 3) FROM part""",
)
def proto_nodes(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col(K)
    text = _text('syntax = "proto3";\npackage pkg.v', k % 3, ";\n// A service.\nservice S", k % 11, " {\n  rpc Get", k, " (M", k, ") returns (M", k, ");\n}\nmessage M", k, " {\n  reserved 4;\n  string name = 1;\n}\n")
    facts = extract.extract(_files(spark, sf, text, ".proto", "protobuf"))
    return facts.where("what = 'node'").select("path", "kind", "name", "package")


@register(
    "wire_text_diff",
    """SELECT 'M' || p_partkey AS message, 1 AS number, 'f' || p_partkey AS name, 'singular' AS cardinality, CASE WHEN p_partkey % 2 = 0 THEN 'string' ELSE 'int32' END AS value_type, NULL::VARCHAR AS map_key FROM part
       UNION ALL SELECT 'M' || p_partkey, (2 + p_partkey % 5)::INTEGER, 'tags', 'repeated', 'bytes', NULL FROM part UNION ALL SELECT 'M' || p_partkey, 9, 'm', 'map', 'int64', 'string' FROM part""",
)
def wire_text_diff(spark: SparkSession, sf: str) -> DataFrame:
    """Fields read from schema texts."""
    k = F.col(K)
    text = _text("message M", k, " {\n  ", F.when(k % 2 == 0, "string").otherwise("int32"), " f", k, " = 1;\n  repeated bytes tags = ", (k % 5 + 2).cast("string"), ";\n  map<string, int64> m = 9;\n}\n")
    rows = _part(spark, sf).select(text.alias("text"))
    return proto.fields(rows).select("message", "number", "name", "cardinality", "value_type", "map_key")


@register(
    "spec_contracts",
    """SELECT '/r/src/f' || p_partkey || '.yaml' AS file_path, 'event_stream' AS kind, 'topic.' || p_partkey AS name, 3 AS line_start, 'topic.' || p_partkey AS topic FROM part WHERE p_partkey % 2 = 0
       UNION ALL SELECT '/r/src/f' || p_partkey || '.yaml', 'http_endpoint', m || ' /p' || p_partkey || '/{id}', l, NULL FROM part, (VALUES ('GET', 4), ('POST', 5)) v(m, l) WHERE p_partkey % 2 = 1""",
)
def spec_contracts(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col(K)
    asyncapi = _text("asyncapi: 2.0.0\nchannels:\n  topic.", k, ":\n    publish: {}\n")
    openapi = _text("openapi: 3.0.0\npaths:\n  /p", k, "/{id}:\n    get: {}\n    post: {}\n")
    rows = yaml_files.yaml_contracts(_files(spark, sf, F.when(k % 2 == 0, asyncapi).otherwise(openapi), ".yaml", "yaml"))
    return rows.where("not failed").select("file_path", "kind", "name", "line_start", "topic")


@register(
    "yaml_properties",
    """SELECT 's' || p_partkey AS source, 'server.port' AS key, (8000 + p_partkey % 100)::VARCHAR AS raw_value, FALSE AS failed FROM part WHERE p_partkey % 6 <> 5 UNION ALL SELECT 's' || p_partkey, 'copy.a.b', 'x' || p_partkey, FALSE FROM part WHERE p_partkey % 6 <> 5
       UNION ALL SELECT 's' || p_partkey, 'base.b', 'x' || p_partkey, FALSE FROM part WHERE p_partkey % 6 <> 5 UNION ALL SELECT 's' || p_partkey, NULL, NULL, TRUE FROM part WHERE p_partkey % 6 = 5""",
)
def yaml_properties(spark: SparkSession, sf: str) -> DataFrame:
    """Dotted keys of the first document through anchors; a file with a key twice gives nothing but a mark."""
    k = F.col(K)
    good = _text("server:\n  port: ", (k % 100 + 8000).cast("string"), "\n  list: [1]\n  none: ~\nbase: &b\n  b: x", k, "\ncopy:\n  a: *b\n---\nother: no\n")
    rows = _part(spark, sf).select(_text("s", k).alias("source"), F.when(k % 6 == 5, "a: 1\na: 2\n").otherwise(good).alias("text"))
    return yaml_files.yaml_properties(rows)


@register(
    "markdown_sections",
    """SELECT 'd' || doc_id || '.md' AS file_path, 'Guide ' || doc_id AS title, 1 AS level, 5 AS start_line, 5 AS end_line, 'description: about' || chr(10) || 'intro' AS content FROM documents
       UNION ALL SELECT 'd' || doc_id || '.md', 'Part', 2, 6, (6 + len(string_split(text, chr(10))))::INTEGER, text FROM documents""",
)
def markdown_sections(spark: SparkSession, sf: str) -> DataFrame:
    """Documents behind a frontmatter, an introduction and a heading."""
    d = P.read(spark, sf, "documents").select(_text("d", F.col("doc_id"), ".md").alias("file_path"), _text("---\nname: Guide ", F.col("doc_id"), "\ndescription: about\n---\nintro\n## Part\n", F.col("text"), "\n").alias("text"))
    return markdown.markdown_sections(d)


@register(
    "file_routes",
    """WITH k AS (SELECT p_partkey AS k, p_partkey % 6 AS c FROM part), r AS (SELECT k, unnest(CASE c WHEN 0 THEN ['GET /shop' || k || '/:id', 'POST /shop' || k || '/:id'] WHEN 1 THEN ['PAGE /about' || k]
         WHEN 2 THEN ['GET /api/users' || k || '/:id'] WHEN 3 THEN ['GET /u' || k || '/:id', 'PAGE /u' || k || '/:id'] WHEN 4 THEN ['ALL /api/x' || k] ELSE ['POST /k' || k] END) AS label FROM k) SELECT k AS id, label FROM r""",
)
def file_routes(spark: SparkSession, sf: str) -> DataFrame:
    """Routes by a file's place in six conventions."""
    k = F.col(K)
    c = k % 6
    path = (
        F.when(c == 0, _text("web/app/(group)/shop", k, "/[id]/route.ts")).when(c == 1, _text("app/about", k, "/page.tsx")).when(c == 2, _text("server/api/users", k, "/[id].get.ts"))
        .when(c == 3, _text("app/routes/u", k, ".$id.tsx")).when(c == 4, _text("pages/api/x", k, ".ts")).otherwise(_text("src/routes/k", k, "/+page.server.ts"))
    )
    a = lambda *xs: F.array(*[F.lit(x) for x in xs])
    exports = F.when(c == 0, a("GET", "POST", "helper")).when(c == 1, a("default")).when(c == 2, a("default", "default@defineEventHandler")).when(c == 3, a("loader", "default")).when(c == 4, a("default")).otherwise(a("actions"))
    imports = F.when(c.isin(1, 4), a("next")).when(c == 3, a("@remix-run/react")).otherwise(a("x"))
    rows = _part(spark, sf).select(k.alias("id"), F.explode(R.file_routes(path, exports, imports)).alias("r"))
    return rows.select("id", F.concat_ws(" ", "r.method", "r.path").alias("label"))


@register(
    "declaration_labels",
    """SELECT p_partkey AS id, CASE p_partkey % 6 WHEN 0 THEN 'class' WHEN 1 THEN 'function' WHEN 2 THEN 'struct' WHEN 3 THEN 'type alias' WHEN 4 THEN 'HTTP endpoint' END AS label,
         CASE WHEN strlen(n) <= 120 THEN n ELSE n[1:120] || '…' END AS shown FROM (SELECT *, repeat(p_brand, (1 + p_partkey % 20)::INTEGER) AS n FROM part)""",
)
def declaration_labels(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col(K)
    signature = (
        F.when(k % 6 == 0, _text("@Injectable({ id: ", k, " }) export abstract class C", k, " {")).when(k % 6 == 1, _text("pub(crate) async fn f", k, "()")).when(k % 6 == 2, _text("type S", k, " struct {"))
        .when(k % 6 == 3, _text("export type T", k, " = X")).otherwise(_text("strange", k))
    )
    kind = F.when(k % 6 == 4, "http_endpoint").otherwise("service_class")
    name = F.expr("repeat(p_brand, CAST(1 + p_partkey % 20 AS INT))")
    return _part(spark, sf).select(k.alias("id"), L.declaration_label(kind, signature).alias("label"), L.display_name(name).alias("shown"))


@register(
    "rejected_list",
    """WITH v AS (SELECT doc_id, strlen(text)::BIGINT AS size, list_max(list_transform(string_split(text, chr(10)), lambda x: strlen(x))) AS widest FROM documents),
       r AS (SELECT 'f' || lpad((doc_id % 300)::VARCHAR, 4, '0') AS path, CASE WHEN size > 8192 THEN 'oversized' ELSE 'long_line' END AS reason, size, doc_id AS recorded FROM v WHERE size > 8192 OR widest > 1024)
       SELECT path, reason, size FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY recorded DESC) AS r FROM r) WHERE r = 1 ORDER BY path LIMIT 100""",
)
def rejected_list(spark: SparkSession, sf: str) -> DataFrame:
    """Refused documents by path: the last outcome of each, the first 100 paths."""
    d = P.read(spark, sf, "documents").withColumn("reason", G.verdict(F.col("text"), max_bytes=8192)).where("reason is not null")
    rows = d.select(_text("f", F.lpad((F.col("doc_id") % 300).cast("string"), 4, "0")).alias("path"), "reason", F.octet_length("text").cast("long").alias("size"), F.lit(None).cast("long").alias("detail"), F.col("doc_id").alias("recorded"))
    return health.normalize(rows, 100).select("path", "reason", "size")


@register(
    "secret_exemptions",
    """SELECT p_partkey AS id, p_partkey % 6 <> 5 AS exempt FROM part""",
)
def secret_exemptions(spark: SparkSession, sf: str) -> DataFrame:
    """Values of secret keys that are none: the key's own name, a variable's name, references, truth values."""
    k = F.col(K)
    key = _text("ACCESS_TOKEN_", k)
    value = F.when(k % 6 == 0, _text("accessToken", k)).when(k % 6 == 1, _text("DB_PASSWORD_", k)).when(k % 6 == 2, _text("${X", k, "}")).when(k % 6 == 3, _text("{{ x", k, " }}")).when(k % 6 == 4, F.lit("false")).otherwise(_text("hunter", k))
    return _part(spark, sf).select(k.alias("id"), L.is_not_a_secret(key, value).alias("exempt"))


@register(
    "path_predicates",
    """SELECT p_partkey AS id, p_partkey % 5 = 0 AS skipped, p_partkey % 5 IN (1, 2) AS indexable, p_partkey % 5 IN (1, 2, 3) AS relevant, p_partkey % 5 = 2 AS generated FROM part""",
)
def path_predicates(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col(K)
    path = _text("r/p", k, F.when(k % 5 == 0, "/logo.png").when(k % 5 == 1, "/a.ts").when(k % 5 == 2, "/codegen/a_pb2.py").when(k % 5 == 3, "/tsconfig.app.json").otherwise("/notes.txt"))
    return _part(spark, sf).select(k.alias("id"), L.is_non_source(path).alias("skipped"), L.is_indexable_source(path).alias("indexable"), L.is_relevant_path(path).alias("relevant"), T.is_generated_path(path).alias("generated"))


@register(
    "error_messages",
    """SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN 'bad token=[REDACTED_SECRET: USE_ENV_OR_LOCAL_FALLBACK] in ~/f' || p_partkey WHEN 1 THEN 'invalid type: string <value>, expected u32 at ' || p_partkey
         WHEN 2 THEN 'a b ' || p_partkey ELSE repeat('x', 197) || '...' END AS message FROM part""",
)
def error_messages(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col(K)
    raw = (
        F.when(k % 4 == 0, _text("bad token=s3cr3t", k, " in /home/u", k, "/f", k)).when(k % 4 == 1, _text('invalid type: string "user, expected ', k, '", expected u32 at ', k))
        .when(k % 4 == 2, _text("a\n\t b ", k)).otherwise(F.lit("x" * 300))
    )
    return _part(spark, sf).select(k.alias("id"), S.sanitized_message(raw).alias("message"))


@register(
    "redacted_lines",
    """SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN 'const apiToken = [REDACTED_SECRET: USE_ENV_OR_LOCAL_FALLBACK];' WHEN 1 THEN 'password: dto.password' || p_partkey WHEN 2 THEN 'DB_SECRET = ''db_secret''' ELSE 'plain = ''v' || p_partkey || '''' END AS line FROM part""",
)
def redacted_lines(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col(K)
    line = F.when(k % 4 == 0, _text("const apiToken = 'v", k, "';")).when(k % 4 == 1, _text("password: dto.password", k)).when(k % 4 == 2, F.lit("DB_SECRET = 'db_secret'")).otherwise(_text("plain = 'v", k, "'"))
    return _part(spark, sf).select(k.alias("id"), S.redacted_line(line).alias("line"))


@register(
    "source_outlines",
    """SELECT '/r/src/f' || p_partkey || '.java' AS file_path, 'class C' || p_partkey || ' {' || chr(10) || '  int f(int x) { /* stripped */ }' || chr(10) || '}' || chr(10) AS text, '1-1,2-' || (4 + p_partkey % 3) || ',' || (5 + p_partkey % 3) || '-' || (5 + p_partkey % 3) AS lines FROM part""",
)
def source_outlines(spark: SparkSession, sf: str) -> DataFrame:
    """Bodies of one to three lines stripped, with the original lines of what is left."""
    k = F.col(K)
    text = _text("class C", k, " {\n  int f(int x) {\n", F.expr("repeat('    if (x > 0) { x--; }\\n', CAST(1 + p_partkey % 3 AS INT))"), "  }\n}\n")
    rows = outline.outlines(_files(spark, sf, text, ".java", "java").withColumnRenamed("path", "file_path"))
    return rows.select("file_path", "text", F.array_join(F.transform("line_map", lambda s: F.concat_ws("-", s["first"], s["last"])), ",").alias("lines"))


@register(
    "hit_snippets",
    """SELECT '/r/src/f' || p_partkey || '.py' AS file_path, (3 + p_partkey % 4)::INTEGER AS line, TRUE AS shown FROM part WHERE p_partkey % 5 <> 0""",
)
def hit_snippets(spark: SparkSession, sf: str) -> DataFrame:
    """The verified line of a hit, or the first that mentions the query; files that do not mention it have none."""
    k = F.col(K)
    text = _text(F.expr("repeat('# c\\n', CAST(2 + p_partkey % 4 AS INT))"), F.when(k % 5 == 0, "def other():\n").otherwise("def wanted():\n"), "    return 1\n")
    files = _files(spark, sf, text, ".py", "python").withColumnRenamed("path", "file_path")
    page = _part(spark, sf).select(_text("/r/src/f", k, ".py").alias("file_path"), F.when(k % 2 == 0, (k % 4 + 3).cast("int")).otherwise(900).alias("anchor"))
    rows = outline.snippets(page, files, "wanted")
    return rows.select("file_path", "line", F.contains("snippet", F.lit("def wanted():")).alias("shown"))


@register(
    "changed_content",
    """SELECT o_orderkey AS key FROM orders WHERE o_orderkey % 7 = 3 UNION ALL SELECT o_orderkey FROM orders WHERE o_orderkey % 7 = 5""",
)
def changed_content(spark: SparkSession, sf: str) -> DataFrame:
    """Files that are new or differ in time or size are read; of these the ones whose content differs have changed."""
    k = F.col("o_orderkey")
    o = P.read(spark, sf, "orders").select(k.alias("key"), F.sha2(F.concat_ws("|", k, "o_orderstatus"), 256).alias("hash"))
    k = F.col("key")
    known = o.where("key % 7 != 5").select("key", F.lit(1).alias("mtime"), (k % 100).alias("size"), "hash")
    now = o.select("key", F.when(k % 7 == 3, 2).when(k % 7 == 4, 2).otherwise(1).alias("mtime"), (k % 100).alias("size"), F.when(k % 7 == 3, F.sha2(F.concat("hash", F.lit("x")), 256)).otherwise(F.col("hash")).alias("hash"))
    read = now.join(cdc.stat_changed(now.select("key", "mtime", "size"), known), ["key", "mtime", "size"], "left_semi")
    return cdc.check_and_update(read.select("key", "mtime", "size", "hash"), known)[0]


@register(
    "reload_scopes",
    """SELECT user_id AS root, max((event_id % 50 = 0)::INT) = 1 AS full_, CASE WHEN max((event_id % 50 = 0)::INT) = 1 THEN 0 ELSE count(DISTINCT event_type) FILTER (event_id % 3 <> 0) END::INTEGER AS paths FROM events GROUP BY 1""",
)
def reload_scopes(spark: SparkSession, sf: str) -> DataFrame:
    """What each root's events ask for: everything after a reference change, else the distinct files."""
    k = F.col("event_id")
    kind = F.when(k % 50 == 0, "ref").when(k % 3 == 0, "activity").otherwise("tree")
    events = P.read(spark, sf, "events").select(F.col("user_id").alias("root"), F.col("event_type").alias("path"), kind.alias("kind"), F.lit(False).alias("is_dir"), F.lit(True).alias("parent_exists"))
    return cdc.reload_scope(events).select("root", F.col("full").alias("full_"), F.size("paths").alias("paths"))
