"""Call records, traces, roots and health lists on literal rows."""

import pytest
from pyspark.sql import functions as F

from tests.test_operators import node, nodes, pairs
from weftline import schema
from weftline.operators import calls, health, roots


def records(spark, rows):
    return spark.createDataFrame(rows, "node_id long, record string")


@pytest.fixture(scope="module")
def world(spark):
    n = nodes(spark, [
        node(1, "UserService.AddBadge", "grpc_method", "/p/user.proto", "demo.user", 0, 5), node(2, "UserService", "grpc_service", "/p/user.proto", "demo.user", 0, 1), node(3, "UserService.AddBadge", "grpc_method", "/q/user.proto", "other.user", 0, 5),
        node(4, "PayService.Charge", "grpc_method", "/p/pay.proto", "demo.pay", 0, 1), node(5, "PayService", "grpc_service", "/p/pay.proto", "demo.pay", 0, 1), node(6, "Handler", path="/a/h.ts", repo=1), node(7, "Consts", path="/a/c.ts", repo=1),
        node(8, "Base", path="/a/b.ts", repo=1), node(9, "Sub", path="/a/s.ts", repo=1, package="demo.user"), node(10, "Base", path="/z/b.ts", repo=2), node(11, "PayImpl", path="/a/i.ts", repo=1, package="demo.pay"), node(12, "May", path="/a/may.ts", repo=1),
        node(13, "Consts", path="/z/c.ts", repo=2), node(14, "ChargeNode", "grpc_method", "/p/node.proto", "demo.node"),
    ])
    r = records(spark, [
        (6, "@'demo.user.UserService'|METHODS.ADD"), (7, "$METHODS.ADD=AddBadge"), (13, "$METHODS.ADD=Other"), (11, "@SERVICE|'Charge'"), (7, "$SERVICE=PayService"), (6, "@x"), (12, "@''|'q'|~"),
        (8, "#users=UserService"), (10, "#users=OtherService"), (9, "^Base#users.AddBadge"), (9, "^Nope#payService.Charge"), (8, "#plain="), (9, "^Base#plain.x"), (9, "=PayService.Charge"), (9, "=grpc.health.v1.Health.Check"), (11, "~PayService.Charge"),
    ])
    return n, r


def test_literals(spark):
    exprs = spark.createDataFrame([(1, "'a b'"), (1, "K.X"), (2, "K.X"), (3, "K.X"), (1, "``"), (1, "none"), (1, '"q"')], "repo_id int, expr string")
    consts = spark.createDataFrame([(1, "K.X", "own"), (2, "K.X", "v1"), (2, "K.X", "v2"), (5, "K.X", "own")], "repo_id int, key string, value string")
    assert pairs(calls.resolve_literals(exprs, consts), "repo_id", "expr", "literal") == {(1, "'a b'", "a b"), (1, "K.X", "own"), (1, '"q"', "q")}


def test_handlers(world):
    n, r = world
    assert pairs(calls.handler_names(r, n), "node_id", "name") == {(6, "UserService.AddBadge"), (11, "PayService.Charge")}
    assert pairs(calls.declared_as(r), "node_id", "text") == {(6, "'demo.user.UserService', METHODS.ADD"), (11, "SERVICE, 'Charge'"), (12, "''")}


def test_inherited_and_method_calls(world):
    n, r = world
    assert pairs(calls.inherited_calls(r, n), "target", "inferred") == {("UserService.AddBadge", False), ("PayService.Charge", True)}
    got = pairs(calls.method_calls(r, n), "node_id", "target", "to_id", "confidence")
    assert got == {(9, "UserService.AddBadge", 1, "exact"), (9, "PayService.Charge", 4, "exact"), (9, "PayService.Charge", 4, "heuristic")}


def test_trace(spark, world):
    n, r = world
    edges = spark.createDataFrame([(11, 4, "implements", None, "exact"), (9, 4, "calls_rpc", None, "heuristic"), (12, 5, "calls_rpc", None, "exact"), (6, 5, "calls_rpc", None, "exact")], schema.EDGES)
    r = r.unionByName(records(r.sparkSession, [(6, "#pay=PayService")]))
    got = pairs(calls.trace(n, edges, r, "Charge"), "role", "id", "confidence")
    assert got == {("definition", 4, "heuristic"), ("handler", 11, "exact"), ("client", 9, "heuristic"), ("may_call", 12, "exact"), ("related", 14, "heuristic")}
    assert {i for role, i, _ in pairs(calls.trace(n, edges, r, "demo.pay"), "role", "id", "confidence") if role == "definition"} == {4, 5}


def test_map_entries(spark):
    entry = "array<struct<number:int,cardinality:string,value_type:string>>"
    good, bad = [(1, "singular", "string"), (2, "singular", "int32")], [(1, "singular", "string"), (2, "repeated", "int32")]
    df = spark.createDataFrame([(1, "string", "int32", good), (2, "string", "int64", good), (3, "string", "int32", bad), (4, "string", "int32", good[:1])], f"n int, k string, v string, e {entry}")
    verdict = lambda a, b: F.when(a == b, 0).when(a.isin("int32", "int64") & b.isin("int32", "int64"), 1).otherwise(2)
    assert pairs(df.select("n", calls.map_entry_compatible(F.col("k"), F.col("v"), F.col("e"), verdict).alias("x")), "n", "x") == {(1, 0), (2, 1), (3, 2), (4, 2)}


def test_roots(spark):
    places = ["/w/a", "/w/a/b", "/w/c"]
    df = spark.createDataFrame([("/w/a/x.ts", 0), ("/w/a/b/y.ts", 0), ("/w/ab/z.ts", 1), ("/w/c", 2), ("/w/a/b/y.ts", 1)], "p string, hint int")
    assert [r[0] for r in df.select(roots.most_specific_root(F.col("p"), places)).collect()] == [0, 1, None, 2, 1]
    assert [r[0] for r in df.select(roots.root_relative_path(F.col("p"), places, F.col("hint"))).collect()] == ["0:x.ts", "0:b/y.ts", "/w/ab/z.ts", "2:", "1:y.ts"]
    tests = spark.createDataFrame([("/e2e/app/src/x.ts", 0), ("/e2e/app/tests/x.ts", 0)], "p string, r int")
    assert [r[0] for r in tests.select(roots.is_test_node(F.col("p"), ["/e2e/app"], F.col("r"))).collect()] == [False, True]
    prefixes = {"gateway": "/api", "svc-*": "/s", "svc-a*": "/sa", "lost": "/l", "./x/": "/x"}
    assert roots.resolve_prefixes(prefixes, ["/w/gateway", "/w/svc-b", "/w/svc-a1", "/w/other", "/w/x"], "/u", "/w") == ["/api", "/s", "/sa", "/u", "/x"]
    assert roots.unmatched_keys(prefixes, ["/w/gateway", "/w/svc-b", "/w/svc-a1"], "/w") == ["./x/", "lost"]
    assert roots.expand_roots(["/a/", "/b", "/a"]) == ["/a", "/b"]
    with pytest.raises(ValueError):
        roots.expand_roots(["/"])
    assert roots.inside("x/../y", ["/r"]) == "/r/y" and roots.inside("lib/z", ["/r"], {"lib": "/r/q"}) == "/r/q/z"
    for bad in ("../x", "/etc/passwd", "/rr/x"):
        with pytest.raises(PermissionError):
            roots.inside(bad, ["/r"])


def test_suffix(spark):
    files = spark.createDataFrame([("/w/p/users/v1/a.proto",), ("/w/gen/users/v1/a.proto",), ("/w/p/pay/v1/a.proto",), ("/w/p/pay/v1/b.proto",)], "file_path string")
    find = lambda t, c=(): pairs(roots.resolve_suffix(files, t, c), "status", "file_path")
    assert find("v1/b.proto") == {("unique", "/w/p/pay/v1/b.proto")}
    assert find("users/v1/a.proto") == {("several", "/w/p/users/v1/a.proto"), ("several", "/w/gen/users/v1/a.proto")}
    assert find("users/v1/a.proto", ["w/p"]) == {("canonical", "/w/p/users/v1/a.proto"), ("copy", "/w/gen/users/v1/a.proto")}
    assert {s for s, _ in find("a.proto")} == {"bare"} and len(find("a.proto")) == 3
    assert find("x/b.proto") == {("closest", "/w/p/pay/v1/b.proto")} and find("") == set()


def test_governed_scripts(spark):
    path = lambda *p: spark.createDataFrame([(x,) for x in p], "file_path string")
    tracked = path("/w/a/src/x.ts", "/w/a/y.vue", "/w/a/src/z.py", "/w/b/q.js")
    assert pairs(roots.governed_scripts(path("/w/a/src/package.json"), tracked, ["/w/a", "/w/b"]), "repo_id", "file_path") == {(0, "/w/a/src/x.ts")}
    assert pairs(roots.governed_scripts(path("/w/a/src/tsconfig.lib.json", "/w/a/x.json"), tracked, ["/w/a", "/w/b"]), "repo_id", "file_path") == {(0, "/w/a/src/x.ts"), (0, "/w/a/y.vue")}


REJECTED = "path string, reason string, size long, detail long, recorded long"


def test_health(spark):
    rows = spark.createDataFrame([("/b", "binary", 9, None, 1), ("/a", "oversized", 1_300_000, None, 1), ("/a", "nesting", 50, 80, 2), ("/c", "long_line", 5000, 4300, 1)], REJECTED)
    assert pairs(health.normalize(rows), "path", "reason") == {("/a", "nesting"), ("/b", "binary"), ("/c", "long_line")}
    assert pairs(health.normalize(rows, 2), "path") == {("/a",), ("/b",)}
    assert spark.range(1).select(health.overflow(rows, 0, 2)).first()[0] == 1 and spark.range(1).select(health.overflow(rows, 7, 2)).first()[0] == 7
    after = health.replace(rows, spark.createDataFrame([("/a",), ("/b",)], "path string"), spark.createDataFrame([("/d", "binary", 1, None, 3)], REJECTED))
    assert pairs(after, "path") == {("/c",), ("/d",)}
    assert spark.range(1).select(health.changed(rows, after)).first()[0] and not spark.range(1).select(health.changed(after, after)).first()[0]
    assert pairs(health.retain(rows, spark.createDataFrame([("/c",)], "path string")), "path") == {("/c",)}
    assert [r["path"] for r in health.matching(health.normalize(rows), F.col("reason") != "binary").collect()] == ["/a", "/c"]
    note = health.scope_note(health.normalize(rows))
    assert "**3 file(s)" in note and "- `/a`: deep nesting (depth 80)\n" in note and "`/c`: long line (longest 4.2 KB)" in note and "more" not in note
    many = spark.range(50).selectExpr("concat('/f', lpad(id, 3, '0')) AS path", "'binary' AS reason", "id AS size", "CAST(NULL AS long) AS detail", "id AS recorded")
    note = health.scope_note(many)
    assert note.count("> - `") == 20 and "…and 30 more" in note and len(note.encode()) <= 2048
    assert health.scope_note(many.limit(0)) is None
    counters = spark.createDataFrame([(10, 6, 1, 2, 1, 0, 3), (5, 5, 0, 0, 0, 1, 0)], "scanned long, indexed long, oversized long, guard long, read_error long, parse_failed long, non_source long")
    assert health.totals(counters).first().asDict() == {"scanned": 15, "indexed": 11, "oversized": 1, "guard": 2, "read_error": 1, "parse_failed": 1, "non_source": 3, "rejected": 4}
    text = health.summary_text(counters, health.normalize(rows), 2)
    assert text.startswith("15 file(s) scanned, 11 indexed, 3 not indexed") and "    binary (null byte): 1" in text and "…and 1 more" in text
    known = spark.createDataFrame([("/a", 5, 10)], "path string, mtime long, size long")
    assert health.unchanged_rejects(spark.createDataFrame([("/a", 5, 10), ("/a", 6, 10)], "path string, mtime long, size long"), known).count() == 1


def test_reload_plans():
    base = {"index": 1, "patterns": [{"n": 1}, {"n": 2}], "docs": {}, "http_prefix": "/a"}
    assert health.reload_plan(base, base | {"http_prefix": "/b", "docs": {"x": 1}}, ["/r"], ["/r"]) == ("display", [])
    assert health.reload_plan(base, base | {"patterns": [{"n": 1}, {"n": 3}]}, ["/r"], ["/r"]) == ("partial", [{"n": 2}, {"n": 3}])
    assert health.reload_plan(base, base | {"patterns": [{"n": 2}, {"n": 1}]}, ["/r"], ["/r"]) == ("partial", [{"n": 2}, {"n": 1}])
    assert health.reload_plan(base, base | {"index": 2}, ["/r"], ["/r"])[0] == health.reload_plan(base, base, ["/r"], ["/s"])[0] == "full"
