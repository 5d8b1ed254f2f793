"""Tools over a snapshot built from texts, schema checks, the command line, incremental reloads."""

import pytest
from pyspark.sql import functions as F

from tests.test_operators import pairs
from tests.test_sources import PROTO
from weftline import tools
from weftline.operators import cdc
from weftline.sinks import stores
from weftline.sources import extract, proto

TS = "import { Kafka } from 'kafkajs';\nimport express from 'express';\nconst app = express();\nconst producer = new Kafka({}).producer();\nexport class UserController {\n  run() {\n    this.userClient.getUser({});\n    producer.send({ topic: 'users.created' });\n  }\n}\napp.get('/users/:id', show);\n"
TS2 = "import { Kafka } from 'kafkajs';\nimport { UserController } from './users';\nconst consumer = new Kafka({}).consumer({});\nexport class Mailer {\n  run(u: UserController) { consumer.subscribe({ topic: 'users.created' }); }\n}\n"


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    files = spark.createDataFrame([
        ("/w/proto/users.proto", 0, "protobuf", PROTO), ("/w/web/users.ts", 1, "typescript", TS), ("/w/mail/mailer.ts", 2, "typescript", TS2), ("/w/web/app/shop/[id]/route.ts", 1, "typescript", "export async function GET() {}\n"), ("/w/web/src/routes/about/+page.svelte", 1, "svelte", "<p>x</p>\n"),
        ("/w/spec/asyncapi.yaml", 0, "yaml", "asyncapi: 2.0.0\nchannels:\n  Orders.Paid: {}\n"), ("/w/docs/guide.md", 0, "markdown", "# Users\nHow users are created\n# Other\nx\n"),
    ], "path string, repo_id int, language string, text string")
    folder = f"file://{tmp_path_factory.mktemp('store')}/s"
    assert tools.build_snapshot(files, folder) == 1
    world = tools.load_world(spark, folder)
    world.files = files.select(F.col("path").alias("file_path"), "language", "text")
    world.sections = stores.read_snapshot(spark, folder, ["sections"])["sections"]
    world.roots, world.rules, world.skills = ["proto", "web", "mail"], {"forbidden": "Ask first."}, {"docs": "docs.md"}
    return folder, world


def test_search(store):
    _, world = store
    page = tools.call(world, "search", query="UserController")
    assert "`UserController` (class): `/w/web/users.ts`:5" in page and "/* stripped */" in page
    assert "mailer.ts" in tools.call(world, "search", query="u: usercontroller") and "No match." in tools.call(world, "search", query="zzz")
    assert "Next page: offset 1." in tools.call(world, "search", query="user", limit=1)


def test_other_tools(store):
    _, world = store
    assert "`/w/web/users.ts`" in tools.call(world, "trace", target="UserService.GetUser") and "Clients (1)" in tools.call(world, "trace", target="GetUser")
    impact = tools.call(world, "impact", target="users.created")
    assert "| INTERNAL | producer |" in impact and "| EXTERNAL | consumer |" in impact
    assert "`GET /users/:id`" in tools.call(world, "impact", target="GET /users/5") and "Nearest:" in tools.call(world, "impact", target="GET /users/5/none")
    assert "`GET /shop/:id`" in tools.call(world, "impact", target="GET /shop/7") and "asyncapi.yaml" in tools.call(world, "search", query="Orders.Paid")
    assert "| producer | `Orders.Paid` |" in tools.call(world, "impact", target="orders.paid") and world.snapshot.nodes.where("name = 'PAGE /about'").count() == 1
    assert "How users are created" in tools.call(world, "docs", query="users created").split("Playbook")[-1]
    assert tools.call(world, "docs", query="x").startswith("> Playbook: `docs.md`")
    for kind in tools.Granularity:
        assert "Mailer" in (text := tools.call(world, "dependents", target="./users", granularity=kind.value)) or "mail" in text
    assert "```mermaid" in tools.call(world, "topology", most=2) and "groups" in tools.call(world, "topology")
    assert "Ask first." in tools.call(world, "search", query="x", scope="src/Forbidden/y")
    with pytest.raises(KeyError):
        tools.call(world, "nope")
    with pytest.raises(TypeError):
        tools.call(world, "docs", nope=1)


def test_command_line(spark, store, tmp_path, capsys):
    folder, _ = store
    assert tools.main(["fingerprint", folder], spark) == 0
    one = capsys.readouterr().out
    assert tools.main(["fingerprint", folder], spark) == 0 and capsys.readouterr().out == one and len(one.strip()) == 64
    assert tools.main(["graph", folder], spark) == 0 and '"total_nodes"' in capsys.readouterr().out
    assert tools.main(["ask", folder, "search", "Mailer"], spark) == 0 and "mailer.ts" in capsys.readouterr().out
    rows = stores.append_entries(None, [{"args": "{}", "timestamp": "1700000000.000Z", "session_id": "s", "tool": "t", "status": "SUCCESS", "files": [], "redacted": 0}])
    trail = spark.createDataFrame([tuple(r.get(c.split()[0]) for c in stores.ENTRIES.split(", ")) for r in rows], stores.ENTRIES).withColumn("duration", F.lit(5.0))
    trail.write.parquet(str(tmp_path / "trail"))
    assert tools.main(["stats", str(tmp_path / "trail")], spark) == 0 and capsys.readouterr().out.startswith("t\t1\t0")
    (tmp_path / "weftline.toml").write_text(f'[workspace]\nroots = ["{tmp_path}"]\n')
    assert tools.main(["doctor", "--config", str(tmp_path / "weftline.toml"), "--trail", str(tmp_path / "trail")], spark) == 0 and "ok   audit chain" in capsys.readouterr().out
    (tmp_path / "weftline.toml").write_text('[workspace]\nroots = ["/nowhere/x"]\n')
    assert tools.main(["doctor", "--config", str(tmp_path / "weftline.toml")], spark) == 1


class FakeGit(tools.Git):
    def __init__(self, answers):
        self.answers = answers

    def run(self, *args):
        return self.answers.get(args)


def test_wire_check(spark):
    new = PROTO.replace("string name = 1;", "int32 name = 1;").replace("repeated int32 ids = 2 [packed = true];", "").replace("ACTIVE = 1", "LIVE = 1")
    show = {("show", "abc:users.proto"): PROTO}
    git = FakeGit(show | {("merge-base", "HEAD", "main"): "abc\n", ("rev-parse", "HEAD"): "def\n"})
    got = pairs(tools.check_wire(spark, git, "users.proto", new), "scope", "number", "rule")
    assert got == {("User", 1, "IncompatibleType"), ("User", 2, "DeletedWithoutReserved"), ("User.State", 1, "EnumRenamedWarning")}
    assert tools.check_wire(spark, git, "users.proto", PROTO).count() == 0
    gone = tools.check_wire(spark, git, "users.proto", PROTO.split("message User")[0])
    assert ("User", None, "RemovedMessage") in pairs(gone, "scope", "number", "rule")
    asked = FakeGit(show | {("rev-parse", "--verify", "--quiet", "v1^{commit}"): "abc"})
    assert asked.base("v1") == "abc" and asked.base("v2") is None
    for base in ("-x", "v2"):
        with pytest.raises(ValueError):
            tools.check_wire(spark, asked, "users.proto", new, base)
    with pytest.raises(ValueError):
        tools.check_wire(spark, git, "other.proto", new)


def test_incremental(spark):
    known = spark.createDataFrame([("a", 1, 10, "h1"), ("b", 1, 20, "h2")], "key string, mtime long, size long, hash string")
    files = spark.createDataFrame([("a", 1, 10), ("b", 2, 20), ("c", 1, 5)], "key string, mtime long, size long")
    assert pairs(cdc.stat_changed(files, known), "key") == {("b",), ("c",)}
    changed, after = cdc.check_and_update(spark.createDataFrame([("b", 2, 20, "h2"), ("c", 1, 5, "h3")], known.schema), known)
    assert pairs(changed, "key") == {("c",)} and pairs(after, "key", "mtime") == {("a", 1), ("b", 2), ("c", 1)}
    events = spark.createDataFrame([("r", "a", "tree", False, True), ("r", "a", "tree", None, None), ("r", "b", "activity", False, True), ("s", "x", "ref", False, True), ("t", "d", "tree", True, True), ("u", "e", "tree", False, False)], "root string, path string, kind string, is_dir boolean, parent_exists boolean")
    assert {(r["root"], r["full"], tuple(r["paths"])) for r in cdc.reload_scope(events).collect()} == {("r", False, ("a",)), ("s", True, ()), ("t", True, ()), ("u", True, ())}
    cache = cdc.PageCache(2)
    cache.put(1, ("q",), "page", {"f": (1, 2)})
    assert cache.get(1, ("q",), lambda p: (1, 2)) == "page" and cache.get(2, ("q",), lambda p: (1, 2)) is None and cache.get(1, ("q",), lambda p: (9, 9)) is None and cache.get(1, ("q",), lambda p: (1, 2)) is None
    for k in range(3):
        cache.put(2, (k,), "x", {})
    assert cache.get(2, (0,), None) is None and cache.get(2, (2,), None) == "x"


def test_parsed_texts_agree(spark):
    rows = spark.createDataFrame([("a", PROTO)], "source string, text string")
    assert [(r["message"], r["number"]) for r in proto.fields(rows).collect()] == [(f["message"], f["number"]) for f in proto.parse(PROTO).fields]
    assert extract.extract_text("x.unknown", None, "text")[0].nodes == []
