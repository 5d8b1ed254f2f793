"""Markdown, YAML and project files on literal texts."""

import pytest

from tests.test_operators import node, nodes, pairs
from weftline import schema
from weftline.operators import resolve
from weftline.sources import markdown, projects, yaml_files


def test_frontmatter():
    assert markdown.frontmatter("---\nname: Guide\ndescription: >\n  two\n  lines\n---\n# A\n") == (6, "Guide", "two lines")
    assert markdown.frontmatter('+++\nname = "T"\n[x]\n+++\n') == (4, "T", None)
    assert markdown.frontmatter("---\nprose between rules here\n---\n") == (0, None, None)
    assert markdown.frontmatter("---\nname: x\n") == markdown.frontmatter("") == markdown.frontmatter("# a") == (0, None, None)
    assert markdown.frontmatter("---\nmeta:\n  name: inner\nname: outer\n- item\n---") == (6, "outer", None)


def test_sections(spark):
    text = "---\nname: Guide\ndescription: About\n---\nintro\n# One\n\n  ## Two \nbody\nmore\n####### no\n# Empty\n# Last\nend\n"
    got = [(s["title"], s["level"], s["start_line"], s["end_line"], s["content"]) for s in markdown.sections("docs/a.md", text)]
    assert got == [("Guide", 1, 5, 5, "description: About\nintro"), ("One", 1, 6, 7, ""), ("Two", 2, 8, 11, "body\nmore\n####### no"), ("Last", 1, 13, 14, "end")]
    assert [s["title"] for s in markdown.sections("x/read.me.md", "only text")] == ["read.me"] and markdown.sections("a.md", "") == []
    many = "".join(f"# h{k}\n{'x' * 100}\n" for k in range(2000))
    cut = markdown.sections("a.md", many)
    assert len(cut) < 2000 and cut[-1]["end_line"] == 4000 and sum(s["content"].count("x" * 100) for s in cut) == 2000
    df = spark.createDataFrame([("a.md", text), ("b.md", None), ("c.md", "# t\nx")], "file_path string, text string")
    found = markdown.markdown_sections(df)
    assert found.count() == 5 and found.columns == [c.split()[0] for c in schema.SECTIONS.split(", ")]
    swapped = markdown.replace_files(found, found.where("file_path = 'c.md'"))
    assert swapped.count() == 5 and markdown.canonical_lines(found).distinct().count() == 5


def test_yaml_properties(spark):
    text = "server:\n  port: 8080\n  name: 'svc'\n  on: true\n  none: null\nlist: [1, 2]\nbase: &b {x: 1}\ncopy: *b\ntagged: !T v\n---\nsecond: no\n"
    got = dict(yaml_files.properties(text))
    assert got == {"server.port": "8080", "server.name": "svc", "server.on": "true", "base.x": "1", "copy.x": "1"}
    for bad in ("a: 1\na: 2\n", "a: [", "a: *nope\n"):
        with pytest.raises(yaml_files.Refused):
            yaml_files.properties(bad)
    bomb = "a0: &a0 [" + ",".join(["x" * 50] * 10) + "]\n" + "".join(f"a{k}: &a{k} [" + ",".join([f"*a{k - 1}"] * 10) + "]\n" for k in range(1, 9))
    with pytest.raises(yaml_files.Refused):
        yaml_files.properties(bomb)
    assert yaml_files.properties("") == []
    df = spark.createDataFrame([("a.yml", "k: v"), ("b.yml", "a: ["), ("c.yml", None)], "source string, text string")
    assert pairs(yaml_files.yaml_properties(df), "source", "key", "raw_value", "failed") == {("a.yml", "k", "v", False), ("b.yml", None, None, True)}


def test_yaml_contracts(spark):
    text = "asyncapi: 2.0.0\nchannels:\n  orders.created:\n    publish: {}\n  'orders.paid': {}\ntopics:\n  - extra\nopenapi: 3.0.0\npaths:\n  /users/{id}:\n    parameters: []\n    get: {}\n  /pay:\n    post: {}\n"
    got = [(n["name"], n["kind"], n["line_start"], n["topic"]) for n in yaml_files.contracts("x/spec.yaml", text, True)]
    assert got == [
        ("orders.created", "event_stream", 3, "orders.created"), ("orders.paid", "event_stream", 5, "orders.paid"), ("extra", "event_stream", 7, "extra"),
        ("PARAMETERS /users/{id}", "http_endpoint", 11, None), ("GET /users/{id}", "http_endpoint", 12, None), ("POST /pay", "http_endpoint", 14, None),
    ]
    assert yaml_files.contracts("x.yaml", "a: 1") == [] and yaml_files.contracts("x.yaml", text, async_files=("other.yaml",), open_files=("other.yaml",)) == []
    df = spark.createDataFrame([("openapi.yaml", 1, "paths: {/a: {get: {}}}"), ("openapi-2.yaml", 1, "paths: [")], "path string, repo_id int, text string")
    assert pairs(yaml_files.yaml_contracts(df), "file_path", "name", "failed") == {("openapi.yaml", "GET /a", False), ("openapi-2.yaml", None, True)}


def test_manifests(spark):
    assert projects.declared_name("go.mod", "// x\nmodule github.com/acme/billing-service\n") == "billing-service"
    assert projects.declared_name("package.json", '{"name": "@acme/web"}') == "web" and projects.declared_name("package.json", "{") is None
    assert projects.declared_name("Cargo.toml", '[package]\nname = "core"\n') == "core" and projects.declared_name("pyproject.toml", '[tool.poetry]\nname = "p"\n') == "p"
    assert projects.declared_name("package.json", " " * 70_000) is None
    files = spark.createDataFrame([("/w/svc/go.mod", "module x/billing\n"), ("/w/svc/package.json", '{"name": "other"}'), ("/w/web/package.json", "{"), ("/w/j/pom.xml", None), ("/w/x.txt", "")], "path string, text string")
    found = projects.manifest_names(files)
    assert pairs(found, "dir", "name") == {("/w/svc", "billing"), ("/w/web", "web"), ("/w/j", "j")}
    code = spark.createDataFrame([
        ("/w/svc/internal/a.go", None), ("/w/svc/b.go", "main"), ("/w/svc/c.java", "com.acme"), ("/r/services/pay/src/x.py", ""), ("/r/tools/src/lib/x.py", None), ("src/x.py", None), ("x.py", None),
    ], "path string, declared string")
    got = pairs(projects.packages(code, found), "path", "package")
    assert got == {
        ("/w/svc/internal/a.go", "billing"), ("/w/svc/b.go", "billing"), ("/w/svc/c.java", "com.acme"), ("/r/services/pay/src/x.py", "pay"), ("/r/tools/src/lib/x.py", "tools"), ("src/x.py", "shared"), ("x.py", "shared"),
    }


def test_jsonc_and_aliases(spark):
    assert projects.parse_jsonc('{ // c\n "a": "http://x", /* y */ "b": [1, 2,], }') == {"a": "http://x", "b": [1, 2]} and projects.parse_jsonc("{") is None
    configs = {
        "/w/web/tsconfig.json": '{"extends": "./base", "compilerOptions": {"paths": {"@/*": ["src/*"], "*": ["x/*"], "@cfg": ["src/config"]}}}', "/w/web/base.json": '{"compilerOptions": {"baseUrl": "."}}',
        "/w/web/sub/package.json": '{"imports": {"#utils/*": "./lib/utils/*"}}', "/w/out/tsconfig.json": '{"extends": "../../etc/x"}',
    }
    rules = projects.alias_rules(configs, "/w")
    assert rules == [("/w/web/sub", "#utils/", "lib/utils/"), ("/w/web", "@/", "src/"), ("/w/web", "@cfg", "src/config")]
    aliases = spark.createDataFrame(rules, "dir string, prefix string, replacement string")
    n = nodes(spark, [
        node(1, "I", path="/w/web/pages/i.ts"), node(2, "utils", path="/w/web/src/lib/utils.ts"), node(3, "utils", path="/w/zzz/lib/utils.ts"), node(4, "Button", path="/w/web/src/Button/Button.tsx"), node(5, "log", path="/w/web/sub/lib/utils/log.js"),
        node(6, "S", path="/w/web/sub/s.ts"), node(7, "config", path="/w/web/src/config/index.ts"), node(8, "J", path="/w/J.java"), node(9, "utils", path="/w/web/src/lib/utils.vue"), node(10, "near", path="/w/web/pages/near.ts"), node(11, "near", path="/w/web/other/near.ts"),
    ])
    facts = spark.createDataFrame([(1, "@/lib/utils"), (1, "@/Button"), (1, "@cfg"), (6, "#utils/log.js"), (8, "@/lib/utils"), (1, "./near"), (1, "../other/near.js"), (8, "./near"), (1, "@/lib/utils.vue"), (1, "./missing")], schema.IMPORTS)
    rewritten = resolve.rewrite_aliases(facts, n, aliases)
    got = pairs(resolve.resolve_imports(rewritten, n), "node_id", "to_id", "confidence")
    assert got == {(1, 2, "ambiguous"), (1, 9, "ambiguous"), (1, 4, "heuristic"), (6, 5, "heuristic"), (1, 10, "heuristic"), (1, 11, "heuristic"), (8, 10, "ambiguous"), (8, 11, "ambiguous"), (1, 9, "heuristic"), (1, 7, "heuristic")}


def test_config(tmp_path):
    assert projects.submodules('[submodule "a"]\n\tpath = libs/a\n\turl = git@x:a.git\n[submodule "b"]\n path=b\n') == [("libs/a", "git@x:a.git")]
    assert projects.locate_config(folder=str(tmp_path)) is None
    (tmp_path / "weftline.toml").write_text('[workspace]\nname = "w"\nroots = ["a"]\n')
    assert projects.load_config(projects.locate_config(folder=str(tmp_path)))["workspace"]["roots"] == ["a"] and projects.load_config(None) == {}
    (tmp_path / "bad.toml").write_text("[workspace]\nnope = 1\n")
    with pytest.raises(ValueError):
        projects.load_config(str(tmp_path / "bad.toml"))
    checks = projects.health_checks({"workspace": {"http_prefixes": {"x": "/a"}}}, [str(tmp_path), "/none"])
    assert [c[1] for c in checks] == [True, False, False]
