"""Wildcard edges, routes, canonical lines, sinks and pages."""

import json

import pytest
from pyspark.sql import functions as F

from tests.test_graph import workspace
from tests.test_operators import flow, node, nodes, pairs
from weftline import schema
from weftline.operators import audit, graph
from weftline.plans.store import materialize
from weftline.sinks import pages, payload, stores


@pytest.fixture(scope="module")
def world(spark):
    n = nodes(spark, [
        node(1, "GET /users/:id", "http_endpoint", "/a/u.ts", line=3), node(2, "list", "http_endpoint", "/a/l.ts", signature="GET /users"), node(3, "Svc", path="/a/s.ts"), node(4, "Sub", path="/b/s.ts", repo=1),
        node(5, "POST /users", "http_endpoint", "/a/u.ts", line=9), node(6, "Inner", path="/a/s.ts", line=2), node(7, "q", "queue", path="/b/q.ts", repo=1),
    ])
    imports = spark.createDataFrame([(4, "Svc")], schema.IMPORTS)
    s = graph.Snapshot(n, imports, flow(spark, [(1, "/a/u.ts", "users.created", False), (3, "/a/s.ts", "jobs.x", False)]), flow(spark, [(4, "/b/s.ts", "users.*", False), (7, "/b/q.ts", "jobs.*", False)]), spark.createDataFrame([], "node_id long, target string"))
    return s, materialize(graph.derive_edges(s), "edges")


def test_wildcards_are_edges(world):
    s, edges = world
    hub = edges.where("kind = 'consumes' and to_id = 4").first()["from_id"]
    got = pairs(edges.where("kind = 'produces'"), "from_id", "to_id", "metadata", "confidence")
    assert (1, hub, "users.created", "heuristic") in got and len(got) == 3  # a queue's pattern links nothing


def test_routes(world, spark):
    s, edges = world
    assert pairs(graph.routes_of(s.nodes), "id", "verb", "path") == {(1, "GET", "/users/:id"), (2, "GET", "/users"), (5, "POST", "/users")}
    got = pairs(graph.route_impact(s.nodes, edges, "GET /users/42"), "rank", "id", "arrow", "kind")
    assert got == {(1, 1, "->", "produces")}
    assert {i for _, i, a, _ in pairs(graph.route_impact(s.nodes, edges, "GET /users"), "rank", "id", "arrow", "kind") if a is None} == {2}
    assert graph.route_impact(s.nodes, edges, "GET /none").count() == 0
    assert pairs(graph.edges_on(s.nodes, edges, s.nodes.where("id = 4")), "id", "arrow", "kind") == {(4, "<-", "consumes")}
    assert pairs(graph.nodes_of_file(s.nodes, "/a/u.ts"), "id") == {(1,), (5,)}


def test_outermost(spark):
    n = nodes(spark, [node(1, "A", line=1), node(2, "B", line=2), node(3, "C", line=20), node(4, "D", path="/z.ts", line=3)])
    n = n.withColumn("line_end", F.when(F.col("id") == 1, 10).otherwise(F.col("line_start") + 1))
    assert pairs(graph.outermost(n), "id") == {(1,), (3,), (4,)}


def test_canonical_lines_do_not_know_ids(spark):
    s = workspace(spark)
    edges = materialize(graph.derive_edges(s), "edges")
    lines = graph.canonical_lines(s, edges)
    shift = lambda df, *cols: df.withColumns({c: F.col(c) + 1000 for c in cols})
    moved = graph.Snapshot(shift(s.nodes, "id"), shift(s.imports, "node_id"), shift(s.producers, "node_id"), shift(s.consumers, "node_id"), shift(s.rpc_calls, "node_id"))
    lines = materialize(lines, "lines")
    again = materialize(graph.canonical_lines(moved, materialize(graph.derive_edges(moved), "edges")), "lines")
    one, two = (audit.fingerprint(x).first()[0] for x in (lines, again))
    assert one == two and lines.count() == again.count()
    assert audit.fingerprint(graph.canonical_lines(s, edges, lambda p: F.concat(F.lit("0:"), p))).first()[0] != one
    assert audit.fingerprint(lines, buckets=2).first()[0] == audit.fingerprint(lines.repartition(7), buckets=2).first()[0]


def test_matrix_order_and_pages(spark):
    s = workspace(spark)
    edges = materialize(graph.derive_edges(s), "edges")
    rows = [r.asDict() for r in graph.ordered_matrix(graph.impact_matrix(s, edges, "ProcessPayment"), s.nodes).collect()]
    assert [(r["scope"], r["role"], r["id"]) for r in rows] == [("EXTERNAL", "client", 3), ("EXTERNAL", "client", 4), ("INTERNAL", "handler", 2)]
    page = pages.impact_matrix("ProcessPayment", rows, 0, 2, 3)
    assert page.count("| EXTERNAL |") == 2 and "Next page: offset 2." in page
    assert pages.impact_matrix("x", rows, 0, 3, 3, budget=10).count("| client |") == 1
    trace = [r.asDict() for r in graph.grpc_trace(s, edges, "ProcessPayment").collect()]
    text = pages.grpc_trace("Process`Payment", trace)
    assert "## Handlers (1)" in text and "`Process'Payment`" in text and "## Clients (2)" in text


def test_plain_pages():
    rows = [{"name": "A", "label": "class", "file_path": "/a.ts", "line_start": 3, "snippet": "x ``` y"}]
    page = pages.search_page("a", "/x", rows, 0, 5)
    assert "1-1 of 5" in page and "````" in page and "Next page: offset 1." in page and "No match." in pages.search_page("q", None, [], 0, 0)
    cut = pages.truncate("a\n```\n" + "x\n" * 1000, 100)
    assert len(cut.encode()) <= 100 and cut.count("```") == 2 and pages.truncate("short") == "short"
    deps = pages.dependents("T", "import", [{"repo_id": 0, "package": "p", "files": 1, "symbols": 2, "places": ["/a:1"]}, {"repo_id": 0, "package": "q", "files": 3, "symbols": 1}], ["web"])
    assert deps.index("**q**") < deps.index("**p**") and "## web" in deps
    edges = [f"-> e{k}" for k in range(20)]
    assert "and 8 more" in pages.route_impact("GET /a", [{"route": "GET /a", "file_path": "/a", "line_start": 1, "edges": edges}], hidden_tests=2)
    assert "Nearest:" in pages.route_impact("GET /b", [], [{"route": "GET /c", "file_path": "/c"}])
    assert "No match." in pages.doc_sections("q", []) and "## T" in pages.doc_sections("q", [{"title": "T", "file_path": "/d", "start_line": 1, "content": "c"}])
    assert pages.narrowing([("a", 1), ("b", 9)], 10).index("`b`") < pages.narrowing([("a", 1), ("b", 9)], 10).index("`a`")
    assert "and 1 more" in pages.topology_footer(2, 8, 3, 1, [(f"g{k}", 9 - k) for k in range(6)])


def test_payloads(spark, tmp_path):
    s = workspace(spark)
    edges = materialize(graph.derive_edges(s), "edges")
    data = json.loads(payload.payload(s.nodes, edges, "w", ["proto", "go", "ts"]))
    assert data["total_nodes"] == 6 and [n["file_path"] for n in data["nodes"]] == sorted(n["file_path"] for n in data["nodes"])
    assert all({e["from_id"], e["to_id"]} <= {n["id"] for n in data["nodes"]} for e in data["edges"]) and len(data["edges"]) == 4
    page = payload.html(json.dumps({"x": "</script><b>&"}), "a<b")
    assert "</script><b>" not in page and "a&lt;b" in page
    drawn = payload.mermaid(s.nodes, edges, ["proto", "go", "ts"])
    assert drawn.startswith("graph LR") and 'subgraph r0["proto"]' in drawn and "|implements|" in drawn
    payload.write_payload(s.nodes, edges, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out/nodes")).count() == 6


def test_generations(spark, tmp_path):
    folder = f"file://{tmp_path}/gen"
    assert stores.current_generation(spark, folder) == 0
    for k in (1, 2):
        assert stores.install_snapshot({"nodes": spark.range(k)}, folder) == k
    assert stores.read_snapshot(spark, folder, ["nodes"])["nodes"].count() == 2 and stores.read_snapshot(spark, folder, ["nodes"], 1)["nodes"].count() == 1


def test_cache(spark):
    files = spark.createDataFrame([("a", 0, "h1", "t1"), ("b", 0, "h2", "t2")], "path string, repo_id int, content_hash string, text string")
    seen = []

    def extract(df):
        seen.append(sorted(r["path"] for r in df.collect()))
        return df.select("path", F.upper("text").alias("fact"))

    empty = spark.createDataFrame([], "key string, path string, fact string")
    facts, fresh = stores.with_cache(files, empty, extract, "1", "c")
    cache = fresh.select("key", "path", "fact")
    again, none = stores.with_cache(files.withColumn("content_hash", F.when(F.col("path") == "b", "new").otherwise(F.col("content_hash"))), cache, extract, "1", "c")
    assert seen == [["a", "b"], ["b"]] and pairs(facts, "path", "fact") == pairs(again, "path", "fact") == {("a", "T1"), ("b", "T2")}
    kept = stores.put_batch(spark.createDataFrame([("k", "old", 1, 0), ("x", "y", 1, 0)], "key string, value string, bytes int, last_access int"), spark.createDataFrame([("k", "new", 2)], "key string, value string, bytes int"), F.lit(9))
    assert pairs(kept, "key", "value", "last_access") == {("k", "new", 9), ("x", "y", 0)}
    assert audit.cache_totals(stores.pass_row(3, 1, 0, spark)).first().asDict() == {"passes": 1, "hits": 3, "misses": 1, "errors": 0}


def entry(k, **more):
    return {"args": f"{{{k}}}", "timestamp": f"170000000{k}.000Z", "session_id": "s", "tool": "t", "status": "SUCCESS", "files": ["/ä b/\"x"], "redacted": 0} | more


def test_chain(spark, tmp_path):
    rows = stores.append_entries(None, [entry(k) for k in range(3)])
    rows += stores.append_entries((2, rows[-1]["entry_hash"]), [entry(3, status="ERROR", error_detail="why"), entry(4)])
    table = lambda rs: spark.createDataFrame([tuple(r.get(c.split()[0]) for c in stores.ENTRIES.split(", ")) for r in rs], stores.ENTRIES)
    broken = lambda rs: pairs(audit.verify_chain(table(rs)), "entry_seq", "reason")
    assert broken(rows) == set() and broken([]) == set()
    change = lambda n, **c: [r | c if r["entry_seq"] == n else r for r in rows]
    assert broken(change(2, tool="other")) == {(2, "hash")} and broken(change(2, tool=None)) == {(2, "hash")}
    assert broken(change(2, prev_hash=None)) == {(2, "link")} and broken(change(2, entry_hash=None)) == {(2, "hash"), (3, "link")}
    assert broken([r for r in rows if r["entry_seq"] != 1]) == {(2, "gap")} and broken([*rows, rows[1]]) == {(1, "gap"), (2, "gap")}
    assert broken(change(3, error_detail="else")) == broken(change(3, error_detail=None)) == broken(change(3, error_detail_sig=None)) == {(3, "detail")}
    assert broken(change(1, error_detail="new")) == {(1, "detail")} and broken(change(0, prev_hash="1" * 64)) == {(0, "link")}
    import hashlib

    r = rows[4]
    old = hashlib.sha256("".join([r["prev_hash"], r["timestamp"], r["session_id"], r["tool"], r["args_digest"]]).encode()).hexdigest()
    assert broken(change(4, chain_version=1, entry_hash=old)) == set() and broken(change(4, chain_version=1)) == {(4, "hash")}
    stores.export_jsonl(table(rows), str(tmp_path / "trail"))
    assert [r["entry_seq"] for r in spark.read.json(str(tmp_path / "trail")).orderBy("entry_seq").collect()] == [0, 1, 2, 3, 4]
    now = F.lit(1_700_000_004.0)
    assert audit.since(table(rows), "all", now).count() == 5 and audit.since(table(rows), "1m", now).count() == 5 and audit.since(table(rows), "24h", now + 86_398).count() == 3
    with pytest.raises(ValueError):
        audit.since(table(rows), "soon", now)


def test_start_topics(spark):
    from weftline.operators import topics

    facts = spark.createDataFrame([("event_created",), ("ws_event_created_feedback",), ("orders.eu",), ("orders.us",)], "topic string")
    start = lambda t: {r["topic"] for r in topics.start_topics(facts, t).collect()}
    assert start("EVENT_CREATED") == {"event_created"} == start("event.created") == start("Events.EVENT_CREATED")
    assert start("orders") == {"orders.eu", "orders.us"} and start("'orders.eu'") == {"orders.eu"} and start("nope") == set()
