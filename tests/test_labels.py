"""Labels, keys, file predicates and file routes on literal cases."""

import hashlib

import pytest
from pyspark.sql import functions as F

from weftline.functions import file_routes as R
from weftline.functions import labels as L
from weftline.functions import text as T
from weftline.sources import files

S = "string"


def apply(spark, function, cases, *kinds):
    """Results of a Column function for cases (argument tuples)."""
    names = [f"a{k}" for k in range(len(kinds))]
    rows = [(k, *(c if isinstance(c, tuple) else (c,))) for k, c in enumerate(cases)]
    df = spark.createDataFrame(rows, ", ".join(["n int", *(f"{n} {k}" for n, k in zip(names, kinds, strict=True))]))
    return [r["out"] for r in df.select("n", function(*map(F.col, names)).alias("out")).orderBy("n").collect()]


def check(spark, function, table, *kinds):
    assert apply(spark, function, list(table), *(kinds or (S,))) == list(table.values())


def test_names(spark):
    long = "é" * 100
    check(spark, L.display_name, {"short": "short", "x" * 120: "x" * 120, "x" * 121: "x" * 120 + "…", long: "é" * 60 + "…", "a" + long: "a" + "é" * 59 + "…", "": ""})
    check(spark, L.inline_code_text, {"a`b\nc": "a'b c", "`" * 130: "'" * 120 + "…"})
    check(spark, L.mermaid_text, {'a"<b>#`\nc': "a#quot;#lt;b#gt;#35;#96; c", "#quot;": "#35;quot;"})
    check(spark, lambda s: L.cut_bytes(s, 5), {"abcdef": "abcde", "ééé": "éé", "aéé": "aéé", "漢字": "漢", "": ""})


def test_declaration_labels(spark):
    check(spark, L.declaration_label, {
        ("service_class", "@Injectable({ a: f(x) }) export class X {"): "class", ("service_class", '@app.route("/") def f():'): "function", ("service_class", "pub(crate) async fn go()"): "function",
        ("service_class", "type X struct {"): "struct", ("interface", "type X interface {"): "interface", ("interface", "type X = Y"): "type alias", ("service_class", "fun interface X"): "interface",
        ("service_class", "export default function* gen()"): "function", ("service_class", "mystery thing"): None, ("service_class", None): None, ("grpc_method", "x"): "gRPC method", ("interface", None): "interface",
        ("service_class", "#[derive(Debug)] pub struct X;"): "struct", ("saga", ""): "saga", ("service_class", "export const a = 1"): "const", ("service_class", "@Oops(unterminated class X"): None,
    }, S, S)


def test_keys_and_budgets(spark):
    check(spark, L.section_budget, {1: 65536, 30_000: 90_000}, "int")
    check(spark, L.yaml_output_budget, {1: 65536, 10_000: 80_000}, "int")
    check(spark, L.alias_budget, {1: 65536, 70_000: 70_000}, "int")
    check(spark, L.search_page_entry_budget, {("ab", "é"): 48 * 1024 - 1536 - 384 - 4, ("x" * 50_000, None): 0, ("ab", None): 48 * 1024 - 1536 - 386}, S, S)
    check(spark, L.workspace_id, {("/w", "1"): hashlib.sha256(b"/w1").hexdigest()[:16]}, S, S)
    assert len(set(apply(spark, L.cache_key, [("1", "a", "bc", 1, "c"), ("1", "ab", "c", 1, "c"), ("1", "a", "bc", None, "c")], S, S, S, "int", S))) == 3
    good = "00-" + "ab" * 16 + "-" + "0" * 16 + "-01"
    check(spark, L.trace_id, {good: "ab" * 16, "00-zz-1-1": None, "": None, "00-" + "0" * 32 + "-1-01": None})
    check(spark, L.iso_millis, {0.0: "1970-01-01T00:00:00.000Z", 1_700_000_000.1236: "2023-11-14T22:13:20.124Z"}, "double")
    check(spark, L.normal_timestamp, {"1700000000.123Z": "2023-11-14T22:13:20.123Z", "2023-11-14T22:13:20.123Z": "2023-11-14T22:13:20.123Z", "never": "never"})
    check(spark, L.fqcn_equals, {("a.b", "C", "a.b.C"): True, ("a.b", "C", "a.b/C"): True, ("a", "b", "ab"): False}, S, S, S)
    check(spark, L.fqcn_contains, {("a.b", "Cat", "B/CA"): True, ("a", "b", "c"): False}, S, S, S)
    got = apply(spark, L.parse_handler_ref, ["S|m", "S|m|~", "S", "S||", "a|b|c", None], S)
    assert [tuple(x) if x else None for x in got] == [("S", "m", False), ("S", "m", True), None, None, None, None]
    check(spark, L.type_label, {("int32", "singular", None): "int32", ("int32", "repeated", None): "repeated int32", ("V", "map", "string"): "map<string, V>"}, S, S, S)
    check(spark, L.heading_level, {"# a": 1, "  ### b": 3, "#a": None, "####### x": None, "": None})


def test_guards(spark):
    check(spark, L.is_not_a_secret, {("REFRESH_TOKEN", "refresh_token"): True, ("password", "DB_PASSWORD"): True, ("k", "${X}"): True, ("k", "{{x}}"): True, ("k", "true"): True, ("k", "hunter2"): False, ("k", ""): False}, S, S)
    skills = {"smart": "s.md", "proto": "p.md", "proto-registry": "r.md"}
    check(spark, lambda t, x: L.recommend_skill(t, x, skills), {("smart", "anything"): "s.md", ("t", "the Proto-Registry/x"): "r.md", ("t", "a proto"): "p.md", ("t", "none"): None, ("t", None): None}, S, S)
    check(spark, lambda x: L.stop_rule(x, {"proto": "stop", "a/b": "deep"}), {"src/Proto/x": "stop", "proto": "stop", "src\\proto": "stop", "src/prototype": None, "x/a/b/c": "deep"})
    check(spark, L.base_error, {"main": None, "": "empty", "-x": "must not start with '-'", "a:b": "must not contain ':'", "a b": "must not contain whitespace or control characters", "x" * 257: "longer than 256 bytes"})
    check(spark, lambda p: L.allows_proto_path(p, ["api/"]), {"x/api/y.proto": True, "x/y.proto": False})
    assert apply(spark, lambda p: L.allows_proto_path(p, []), ["x"], S) == [True]


def test_file_predicates(spark):
    check(spark, L.is_non_source, {"a/yarn.lock": True, "a/b.PNG": True, "x.min.js": True, "a.ts": False, "png": False, "a/Cargo.toml": False})
    check(spark, L.is_indexable_source, {"a.hxx": True, "a.YML": True, "a.md": False, "a.vue": False, "a.phtml": True})
    check(spark, L.is_relevant_path, {
        "a/b.rs": True, "a/b.png": False, "node_modules/a.ts": False, "a/.git/HEAD": True, "a/.git/refs/x": True, "a/.git/objects/x": False, "tsconfig.base.json": True, "package.json": True, "x.json": False, "a.rs~": False, ".a.ts.swp": False,
    })
    check(spark, T.is_generated_path, {"a/Gen/x.ts": True, "a.d.ts": True, "x/codegen/a": True, "a.pb.cc": True, "a_pb2.py": True, "a_grpc.pb.go": True, "dist/a.js": False, "general/a.ts": False, "a.gen.go": True})
    check(spark, files.is_excluded, {"a/.env.local": True, "secrets/x": True, "a/b.pem": True, "id_rsa.pub": True, "x/node_modules/y.js": True, "dist/a.js": False, "bin/x": False, "a/.git/x": True, "vendor/a.go": False, "a/target": False, ".npmrc": True})
    check(spark, files.language, {"a.mts": "typescript", "a.hxx": "cpp", "a.rake": "ruby", "a.phtml": "php", "a.sc": "scala", "a.TXT": None})


@pytest.mark.parametrize(("glob", "yes", "no"), [
    ("**/*.pem", ["a.pem", "x/y.pem"], ["a.pemx"]), ("src/*.ts", ["src/a.ts"], ["src/b/a.ts"]), ("**/a/**", ["a/x", "y/a/z/w"], ["a", "ba/x"]), ("{a,b}?.[ch]", ["ax.c", "by.h"], ["cx.c", "ax.d"]), ("a+b", ["a+b"], ["aab"]),
])
def test_globs(spark, glob, yes, no):
    assert apply(spark, lambda p: files.matches_glob(p, glob), yes + no, S) == [True] * len(yes) + [False] * len(no)


def test_patterns_and_roots(spark):
    check(spark, lambda p: files.path_excluded(p, "/w/app"), {"/w/app/x.pem": True, "/w/app/x.ts": False, "/w/other/x.pem": None})
    rows = spark.createDataFrame([("a/x.ts",), ("secrets/k",)], "rel string")
    assert [r["pattern"] for r in files.unmatched_patterns(rows, ["**/secrets/**", "**/*.pem"]).collect()] == ["**/*.pem"]
    assert files.outer_roots(["/a/b", "/a", "/ab/", "/c"]) == ["/a", "/ab", "/c"]


def test_routes_of_places(spark):
    check(spark, R.join, {("/api/", "/users"): "/api/users", ("", "x"): "/x", ("", "*"): "*", ("/a", ""): "/a", ("", ""): "/", ("a", "b/"): "/a/b"}, S, S)
    check(spark, R.dynamic_segment, {"[id]": ":id", "[...rest]": "*rest", "[[...r]]": "*r?", "[[id]]": ":id?", "[id=int]": ":id", "(g)": None, "@slot": None, "x": "x"})
    check(spark, lambda p: R.route_of(F.split(p, ",")), {"a,[id]": "/a/:id", "a,(..)b": "/b", "a,b,(..)(..)c": "/c", "a,(...)b": "/b", "a,(.)b": "/a/b", "(g)": "/", "a,@s,b": "/a/b"})
    check(spark, R.remix_route, {"users.$id.edit": "/users/:id/edit", "_index": "/", "_auth.login": "/login", "sitemap[.]xml": "/sitemap.xml", "($lang).about": "/:lang?/about", "files.$": "/files/*", "(en).a_": "/en?/a"})
    check(spark, R.sfc_route, {"web/src/routes/a/[id]/+page.svelte": "/a/:id", "src/pages/blog/[slug].astro": "/blog/:slug", "src/pages/index.astro": "/", "src/pages/_x/a.astro": None, "src/lib/a.svelte": None, "src/routes/(g)/+page@x.svelte": "/"})
    check(spark, R.path_may_route, {"a/+page.ts": True, "x/api/y.ts": True, "src/x.ts": False, "application/x.ts": False})
    check(spark, R.looks_like_router, {"usersRouter": True, "api_routes": True, "app": True, "application": False, "appConfig": False, "mapper": False, "HTTPServer": False, "my-app": True})
    check(spark, lambda x: F.array_join(R.methods_of(F.split(x, ",")), ","), {"get,post,x": "GET,POST", "*": "ALL", "GET,get": "GET"})


def test_file_routes(spark):
    none = []
    cases = {
        ("web/src/routes/a/+server.ts", ("GET", "POST"), ()): ["GET /a", "POST /a"], ("src/routes/a/+page.server.ts", ("actions",), ()): ["POST /a"], ("src/routes/a/+page.ts", ("load",), ()): none,
        ("app/(shop)/items/[id]/route.ts", ("GET", "helper"), ()): ["GET /items/:id"], ("app/about/page.tsx", ("default",), ("next/link",)): ["PAGE /about"], ("app/about/page.tsx", ("default",), ("nextish",)): none,
        ("app/_private/route.ts", ("GET",), ()): none, ("server/api/users/[id].get.ts", ("default", "default@defineEventHandler"), ()): ["GET /api/users/:id"], ("server/routes/ping.ts", ("default", "default@h3.eventHandler"), ()): ["ALL /ping"],
        ("server/api/x.ts", ("default",), ()): none, ("app/routes/users.$id.tsx", ("loader", "action", "default"), ("@remix-run/react",)): ["GET /users/:id", "POST /users/:id", "PAGE /users/:id"], ("app/routes/_auth.tsx", ("default",), ("react-router",)): none,
        ("app/routes/users.$id/route.tsx", ("loader",), ("react-router",)): ["GET /users/:id"], ("src/pages/api/x.ts", ("GET",), ("astro",)): ["GET /api/x"], ("pages/api/users/[id].ts", ("default",), ("next",)): ["ALL /api/users/:id"],
        ("pages/index.tsx", ("default",), ("next",)): ["PAGE /"], ("pages/_app.tsx", ("default",), ("next",)): none, ("pages/x.css", ("default",), ("next",)): none,
    }
    rows = [(p, list(e), list(m)) for p, e, m in cases]
    got = apply(spark, lambda p, e, m: F.transform(R.file_routes(p, e, m), lambda x: F.concat_ws(" ", x["method"], x["path"])), rows, S, "array<string>", "array<string>")
    assert got == list(cases.values())


def test_file_routes_work_the_path_out_once(spark):
    df = spark.createDataFrame([("app/routes/u.$id.tsx", ["loader"], ["react-router"])], "p string, e array<string>, m array<string>")
    got = df.select(R.file_routes(F.concat(F.lit("marked/"), "p"), F.col("e"), F.col("m")).alias("r"))
    assert [(r["method"], r["path"]) for r in got.first()["r"]] == [("GET", "/u/:id")]
    assert got._jdf.queryExecution().optimizedPlan().toString().count("marked/") == 1
