"""Operators on small literal facts with exact expected rows."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weftline import schema
from weftline.functions import text as T
from weftline.operators import audit, cdc, guard, resolve, search, topics, topology, wire
from weftline.sources import files


def node(i, name, kind="service_class", path="/a/x.ts", package="pkg", repo=0, line=1, signature=None):
    return (i, name, kind, path, line, line + 5, package, repo, signature, None)


def nodes(spark, rows):
    return spark.createDataFrame(rows, schema.NODES)


def pairs(df, *columns):
    return {tuple(r[c] for c in columns) for r in df.collect()}


def test_resolve_imports_strategies(spark):
    n = nodes(spark, [
        node(1, "Importer", path="/a/src/i.ts", package="own"), node(2, "Money", package="com.pay", repo=1), node(3, "Money", package="com.pay", repo=2),
        node(4, "Unique", repo=5), node(5, "Twice", repo=1), node(6, "Twice", repo=2), node(7, "Local", repo=0), node(8, "Local", repo=3),
        node(9, "util", path="/a/src/util.ts"), node(10, "path", repo=7), node(11, "Deep", package="a/b", repo=4),
    ])
    facts = spark.createDataFrame([(1, t) for t in ("com.pay.Money", "Unique", "Twice", "Local", "./util", "path", "com.pay", "nope")], schema.IMPORTS)
    got = pairs(resolve.resolve_imports(facts, n), "target", "to_id", "confidence")
    assert got == {
        ("com.pay.Money", 2, "exact"), ("Unique", 4, "heuristic"), ("Twice", 5, "ambiguous"), ("Twice", 6, "ambiguous"),
        ("Local", 7, "heuristic"), ("./util", 9, "heuristic"), ("com.pay", 2, "ambiguous"), ("com.pay", 3, "ambiguous"),
    }


def test_resolution_does_not_depend_on_order_or_partitions(spark):
    rows = [node(i, f"n{i % 7}", repo=i % 3, package=f"p{i % 2}") for i in range(60)]
    facts = [(i, f"n{(i * 5) % 7}") for i in range(60)]
    want = None
    for k in (1, 4, 13):
        random.Random(k).shuffle(rows)
        random.Random(k).shuffle(facts)
        spark.conf.set("spark.sql.shuffle.partitions", str(k))
        got = pairs(resolve.resolve_imports(spark.createDataFrame(facts, schema.IMPORTS).repartition(k), nodes(spark, rows)), "node_id", "target", "to_id", "confidence")
        want = want or got
        assert got == want
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_dependents_tiers(spark):
    n = nodes(spark, [node(1, "Money", package="pay"), node(2, "Other", package="pay"), node(3, "User", package="u")])
    imports = spark.createDataFrame([(3, "lib/x"), (2, "pay"), (1, "my-lib")], schema.IMPORTS)
    edges = spark.createDataFrame([(3, 2, "calls_rpc", None, "exact")], schema.EDGES)
    assert pairs(resolve.dependents(imports, n, edges, "lib"), "id", "tier") == {(3, 1)}
    assert pairs(resolve.dependents(imports, n, edges, "Money"), "id", "tier") == {(2, 2)}
    assert pairs(resolve.dependents(imports.where("target != 'pay'"), n, edges, "Money"), "id", "tier") == {(3, 3)}
    assert pairs(resolve.dependents(imports, n, edges, "y-li"), "id", "tier") == {(1, 4)}
    assert pairs(resolve.dependents(imports, n, edges, "li"), "id", "tier") == set()


def test_rpc_and_implements(spark):
    n = nodes(spark, [node(1, "UserService", "grpc_service"), node(2, "pay.Billing.Charge", "grpc_method"), node(3, "Client"), node(4, "charge", signature="async fn charge(&self)")])
    calls = spark.createDataFrame([(3, "User"), (3, "Charge"), (3, "health")], "node_id long, target string")
    assert pairs(resolve.resolve_rpc(calls, n), "target", "to_id", "confidence") == {("User", 1, "exact"), ("Charge", 2, "heuristic")}
    handlers = nodes(spark, [node(4, "charge"), node(5, "handler", signature="fn ChargeCard(x)"), node(6, "rpc:Charge"), node(7, "pay.Billing.Charge"), node(8, "other")])
    got = pairs(resolve.implements(n.where("id = 2"), handlers), "handler_id", "confidence")
    assert got == {(4, "heuristic"), (5, "heuristic"), (7, "exact")}


def flow(spark, rows):
    return spark.createDataFrame(rows, "node_id long, file_path string, topic string, heuristic boolean")


def test_impact_walk_chain_cycle_and_depth(spark):
    p = flow(spark, [(100 + k, f"f{k}", f"chain:{k + 1}", False) for k in range(6)] + [(1, "src", "chain:0", False), (200, "f3", "chain:0", True)])
    c = flow(spark, [(300 + k, f"f{k}", f"chain:{k}", False) for k in range(6)])
    one = topics.impact_walk(p, c, "chain:0", 1)
    assert pairs(one.where("role = 'consumer'"), "hop", "node_id") == {(1, 300)}
    four = topics.impact_walk(p, c, "chain:0", 4)
    assert pairs(four.where("role = 'consumer'"), "hop", "node_id") == {(k + 1, 300 + k) for k in range(4)}
    assert pairs(topics.impact_walk(p, c, "chain:0", 99), "hop", "role", "topic") == pairs(topics.impact_walk(p, c, "chain:0", 5), "hop", "role", "topic")


def test_topic_edges_and_wildcards(spark):
    p = flow(spark, [(1, "a", "orders.created", True), (1, "a", "orders.created", False), (2, "b", "orders.eu.created", False), (3, "c", "orders..x", False)])
    edges = topics.topic_edges(p, flow(spark, [(9, "z", "orders.created", True)]))
    assert pairs(edges, "node_id", "kind", "confidence") == {(1, "produces", "exact"), (2, "produces", "exact"), (3, "produces", "exact"), (9, "consumes", "heuristic")}
    subs = spark.createDataFrame([(7, "orders.>"), (2, "orders.*"), (8, "plain")], "node_id long, pattern string")
    assert pairs(topics.wildcard_edges(p, subs), "pattern", "node_id") == {("orders.>", 1), ("orders.>", 2), ("orders.*", 1)}
    assert topics.wildcard_edges(p, subs, most=1).where("pattern = 'orders.>'").count() == 1


def naive_matches(pattern, topic):
    sep, one, rest = ("/", "+", "#") if "/" in pattern else (".", "*", ">")
    p, t = pattern.split(sep), topic.split(sep)
    if "" in t:
        return False
    for k, tok in enumerate(p):
        if tok == rest and k == len(p) - 1:
            return rest == "#" or len(t) > k
        if k >= len(t) or tok not in (one, t[k]):
            return False
    return len(p) == len(t)


def test_subject_matches_like_the_definition(spark):
    cases = []

    @settings(max_examples=400, database=None, deadline=None)
    @given(st.lists(st.sampled_from(["a", "b", "*", ">", "+", "#", ""]), min_size=1, max_size=4), st.lists(st.sampled_from(["a", "b", ""]), min_size=1, max_size=4), st.sampled_from("./"))
    def collect(p, t, sep):
        cases.append((sep.join(p), sep.join(t)))

    collect()
    df = spark.createDataFrame(cases, "p string, t string").select("p", "t", T.subject_matches(F.col("p"), F.col("t")).alias("m"))
    for r in df.collect():
        assert r["m"] == naive_matches(r["p"], r["t"]), (r["p"], r["t"])


def test_topology(spark):
    edges = spark.createDataFrame([(1, 2, "imports", "a", "exact"), (1, 3, "imports", "b", "ambiguous"), (1, 4, "imports", "b", "ambiguous"), (2, 1, "imports", "c", "ambiguous"), (2, 3, "imports", "c", "ambiguous"), (1, 5, "imports", "d", "exact")], schema.EDGES)
    groups = spark.createDataFrame([(1, "x"), (5, "x"), (2, "y"), (3, "z"), (4, "z")], "id long, grp string")
    links, degrees, omitted = topology.build(edges, groups)
    assert pairs(links, "from_grp", "to_grp", "count", "confidence") == {("x", "y", 1, "exact"), ("x", "z", 1, "heuristic")}
    assert pairs(degrees, "grp", "degree", "internal") == {("x", 2, 1), ("y", 1, 0), ("z", 1, 0)}
    assert omitted.first()[0] == 1
    assert pairs(topology.select(links, degrees, 1), "from_grp", "to_grp", "count") == {("x", "other", 2)}
    assert topology.mermaid(links).startswith("graph LR")


def test_docs_search_and_fuzzy(spark):
    s = spark.createDataFrame([("a.md", "Kubernetes", 1, 1, 2, "deploy the cluster"), ("b.md", "Other", 1, 1, 2, "kubernetes notes")], schema.SECTIONS)
    assert [(r["file_path"], r["score"]) for r in search.search_docs(s, "the k8s", stop_words=["the"], aliases={"k8s": "kubernetes"}).collect()] == [("a.md", 65), ("b.md", 25)]
    assert [(r["file_path"], r["score"]) for r in search.search_docs(s, "kubernets").collect()] == [("a.md", 8), ("b.md", 3)]
    assert search.search_docs(s, "zzz", fuzzy=False).count() == 0


@pytest.mark.parametrize("query,prefix,rank", [("GET /events/:id", None, 0), ("GET /events/42", None, 1), ("GET /events", None, 2), ("GET /:id", None, 3), ("POST /events/:id", None, None), ("GET /api/v1/events/:id", "/api/v1", 0), ("GET /", None, None)])
def test_routes(spark, query, prefix, rank):
    r = spark.createDataFrame([(1, "GET", "/Events/{eventId}?x", "a.ts", 1)], "id long, verb string, path string, file_path string, line_start int")
    got = search.find_routes(r, query, prefix).collect()
    assert [x["rank"] for x in got] == ([] if rank is None else [rank])


def test_wire_rules(spark):
    old = [("M", 1, "a", "singular", "int32"), ("M", 2, "b", "singular", "string"), ("M", 3, "c", "singular", "int32"), ("M", 4, "d", "singular", "int32"), ("M", 5, "e", "singular", "int32"), ("M", 6, "g", "singular", "string"), ("Gone", 1, "x", "singular", "int32")]
    new = [("M", 1, "a", "singular", "bool"), ("M", 2, "b", "repeated", "bytes"), ("M", 3, "c2", "singular", "int64"), ("M", 4, "d", "singular", "double"), ("M", 6, "z", "singular", "int32"), ("M", 9, "old", "singular", "int32")]
    none = spark.createDataFrame([], "type_name string")
    typed = lambda rows: wire.wire_class(spark.createDataFrame(rows, wire.FIELDS), none, none)
    reserved = "message string, lo int, hi int, name string"
    got = wire.diff_fields(typed(old), typed(new), spark.createDataFrame([("M", 8, 10, None)], reserved), spark.createDataFrame([("M", 20, 30, None)], reserved))
    assert pairs(got, "number", "rule") == {(3, "RenamedWarning"), (4, "IncompatibleType"), (5, "DeletedWithoutReserved"), (6, "FieldNumberReused"), (9, "FieldNumberReused")}
    kept = wire.diff_fields(typed(old), typed(new), spark.createDataFrame([], reserved), spark.createDataFrame([("M", None, None, "e")], reserved))
    assert (5, "DeletedWithoutReserved") not in pairs(kept, "number", "rule")


def chain(spark, n, broken=None):
    import hashlib
    import json

    prev, rows = "0" * 64, []
    for k in range(n):
        fields = (f"t{k}", f"s{k % 3}", "search", "d" * 8, "SUCCESS", [f"/a/{k}"], k % 2)
        text = prev + "".join(fields[:5]) + json.dumps(fields[5], separators=(",", ":")) + str(fields[6])
        h = hashlib.sha256(text.encode()).hexdigest()
        rows.append((k, prev, *fields, h))
        prev = h
    if broken is not None:
        r = list(rows[broken])
        r[6] = "ERROR"
        rows[broken] = tuple(r)
    return spark.createDataFrame(rows, "entry_seq long, prev_hash string, timestamp string, session_id string, tool string, args_digest string, status string, files array<string>, redacted int, entry_hash string")


def test_audit_chain(spark):
    assert audit.verify_chain(chain(spark, 30)).count() == 0
    assert pairs(audit.verify_chain(chain(spark, 30, broken=7)), "entry_seq", "reason") == {(7, "hash")}
    assert pairs(audit.verify_chain(chain(spark, 30).where("entry_seq != 9")), "entry_seq", "reason") == {(10, "gap")}


def test_fingerprint_ignores_order_and_counts_duplicates(spark):
    lines = [f"line {k % 50}" for k in range(200)]
    f = lambda rows: audit.fingerprint(spark.createDataFrame([(x,) for x in rows], "line string")).first()[0]
    assert f(lines) == f(lines[::-1]) != f(lines[:-1])


def test_percentile_rule(spark):
    rows = [("t", "SUCCESS", float(k)) for k in range(1, 20)]
    df = spark.createDataFrame(rows, "tool string, status string, duration double")
    assert audit.tool_stats(df).first()["p95"] is None
    assert audit.tool_stats(df.union(spark.createDataFrame([("t", "X", 20.0)], df.schema))).first()["p95"] == 19.0


def test_incremental_equals_full(spark):
    old = spark.createDataFrame([(k, f"v{k}") for k in range(20)], "key long, c string")
    new = spark.createDataFrame([(k, f"v{k}" if k % 3 else f"w{k}") for k in range(2, 24)], "key long, c string")
    sig = lambda df: cdc.signatures(df, "key", F.col("c"))
    changed = cdc.changes(sig(old), sig(new))
    assert pairs(cdc.apply_changes(old, new, changed, "key"), "key", "c") == pairs(new, "key", "c")
    assert cdc.changes(sig(new), sig(new)).count() == 0


def test_guards_and_secrets(spark):
    df = spark.createDataFrame([(1, "x" * 2000), (2, "a\x00b"), (3, "(" * 70 + ")" * 70), (4, '"((((" ok // (((('), (5, 'a = 1\nmy_token = "abc"\nname: "x"')], "id long, text string")
    got = dict(pairs(df.select("id", guard.verdict(F.col("text")).alias("v")), "id", "v"))
    assert got == {1: "long_line", 2: "binary", 3: "nesting", 4: None, 5: None}
    assert pairs(guard.secret_lines(df, "id", "text"), "id", "line_no", "key") == {(5, 2, "my_token")}


def test_placeholders(spark):
    p = spark.createDataFrame([("host", "h"), ("url", "http://${host}:${port:80}/${nope}"), ("db.password", "s3"), ("dsn", "x:${db.password}")], "key string, raw_value string")
    assert pairs(guard.resolve_placeholders(p), "key", "value") == {("host", "h"), ("url", "http://h:80/${nope}"), ("db.password", guard.REDACTED), ("dsn", f"x:{guard.REDACTED}")}


def test_custom_pattern_lines(spark):
    df = spark.createDataFrame([(1, "a\nemit('x')\n\nemit('y') emit('x')")], "id long, text string")
    got = guard.custom_patterns(df, [{"name": "e", "kind": "topic_producer", "regex": r"emit\('([^']+)'\)"}], "id", "text")
    assert sorted((r["target"], r["line"]) for r in got.collect()) == [("x", 2), ("x", 4), ("y", 4)]


def test_crawl(spark, tmp_path):
    (tmp_path / "a/inner").mkdir(parents=True)
    (tmp_path / "a/node_modules").mkdir()
    (tmp_path / "a/x.py").write_text("print(1)")
    (tmp_path / "a/node_modules/y.js").write_text("1")
    (tmp_path / "a/inner/z.md").write_text("intro\n# One\nbody\n## Two\nend\n")
    rows = files.crawl(spark, [str(tmp_path / "a"), str(tmp_path / "a/inner")])
    assert pairs(rows, "repo_id", "rel", "language") == {(0, "x.py", "python"), (1, "z.md", "markdown")}
    ok = files.admitted(rows)
    assert ok.where("reason is null").count() == 2
    md = files.doc_sections(ok.where("language = 'markdown'").select(F.col("path").alias("file_path"), "text"))
    assert sorted((r["level"], r["title"], r["start_line"], r["end_line"]) for r in md.collect()) == [(0, "", 1, 1), (1, "One", 2, 3), (2, "Two", 4, 5)]
