"""Outlines, snippets, records of typed clients, constants and use trees."""

from pyspark.sql import functions as F

from tests.test_operators import pairs
from weftline.sources import extract, outline, rpc_records
from weftline.sources.javascript import Script


def test_splice_maps_lines():
    text = "a\nf() {\n x\n y\n}\nb\n"
    out, spans = outline.splice(text, [(6, 15, "{ }")])
    assert out == "a\nf() { }\nb\n" and spans == [(1, 1), (2, 5), (6, 6)]
    assert outline.splice("x\ny", []) == ("x\ny", [(1, 1), (2, 2)]) and outline.splice("abc", [(0, 2, "Z"), (1, 3, "no")])[0] == "Zc"


def test_bodies():
    strip = lambda language, text: outline.outline(text, language)[0]
    assert strip("java", "class A {\n  int f(int x) throws E {\n    if (x) { return 1; }\n  }\n  int y = 1;\n}\n") == "class A {\n  int f(int x) throws E { /* stripped */ }\n  int y = 1;\n}\n"
    assert strip("go", "type S struct {\n  A int\n}\nfunc (s *S) F() (int, error) {\n  return 1, nil\n}\n") == "type S struct {\n  A int\n}\nfunc (s *S) F() (int, error) { /* stripped */ }\n"
    assert strip("rust", "impl<'a> X for Y {\n  fn f(&'a self) -> u8 {\n    1\n  }\n}\n") == "impl<'a> X for Y {\n  fn f(&'a self) -> u8 { /* stripped */ }\n}\n"
    assert strip("typescript", "export const f = (a) => {\n  return a;\n};\nclass A { m() { if (x) {} } p = { q: 1 }; }\n") == "export const f = (a) => { /* stripped */ };\nclass A { m() { /* stripped */ } p = { q: 1 }; }\n"
    assert strip("python", 'class A:\n    def f(self):\n        """Doc."""\n        return 1\n\ndef é(x): return "ü"\n') == 'class A:\n    def f(self):\n        """Doc."""\n        ...\n\ndef é(x): ...\n'
    assert strip("ruby", "class A\n  def f(x)\n    if x\n      1\n    end\n  end\nend\n") == "class A\n  def f(x)\n    # stripped\n  end\nend\n"
    assert strip("protobuf", "message A { }") == "message A { }" and outline.outline("x" * 2000, None)[2] and outline.outline("def (", "python") == (outline.STUB, [(1, 1)], True)
    assert strip("java", "int f() { String s = \"} {\"; // }\n }\n") == "int f() { /* stripped */ }\n"


def test_snippets(spark):
    text = "import x\n\n\n\n\n\ndef target():\n    secret = 1\n    return secret\n"
    got = outline.snippet("a/b.py", text, "python", "target", 7)
    assert got["line"] == 7 and "def target():" in got["snippet"] and "secret" not in got["snippet"]
    assert outline.snippet("a/b.py", text, "python", "target", 2)["line"] == 2 and outline.snippet("a/b.py", text, "python", "target", 99)["line"] == 7
    assert outline.snippet("a/b.py", text, "python", "nowhere", None) is None and outline.snippet("a/target.py", "\n" * 90, "python", "target", 1)["line"] == 1
    files = spark.createDataFrame([("a/b.py", "python", text), ("c.py", "python", "x = 1")], "file_path string, language string, text string")
    page = spark.createDataFrame([("a/b.py", 7), ("c.py", None)], "file_path string, anchor int")
    assert pairs(outline.snippets(page, files, "target"), "file_path", "line") == {("a/b.py", 7)}
    done = outline.outlines(files).where(F.col("file_path") == "a/b.py").first()
    assert "secret" not in done["text"] and (done["line_map"][7]["first"], done["line_map"][7]["last"]) == (8, 9)


CONTROLLER = """
const SERVICE = 'UserService';
export const METHODS = { ADD: 'AddUser' } as const;
enum E { A = 'a' }
class Base { protected users: UserServiceClient; plain: Helper;
  onModuleInit() { this.pay = this.client.getService<PayServiceClient>('PayService'); } }
class Sub extends Base { go() { this.users.getUser({}); this.orders.list(); } }
class Own { constructor(private readonly userService: UserServiceClient, private billingService: BillingService, private stockClient) {}
  @GrpcMethod(SERVICE, METHODS.ADD) add() { this.userService.add(1); this.billingService.charge(); this.stockClient.get(); }
  @GrpcMethod('UserService') findOne() {} }
"""


def test_records(spark):
    got = {r for _, r in rpc_records.records(Script(CONTROLLER))}
    assert got == {
        "$SERVICE=UserService", "$METHODS.ADD=AddUser", "$E.A=a", "#users=UserService", "#pay=PayService", "#userService=UserService", "^Base#users.getUser", "^Base#orders.list",
        "=UserService.add", "~StockService.get", "@SERVICE|METHODS.ADD", "@'UserService'|'FindOne'|~",
    }
    files = spark.createDataFrame([("a/c.ts", 0, "typescript", CONTROLLER)], "path string, repo_id int, language string, text string")
    t = extract.tables(extract.extract(files))
    assert {r["record"] for r in t["rpc_records"].collect()} == got


def test_go_and_rust():
    go = 'package main\n\nconst Topic = "orders"\n\nvar Other = envOr("T", "paid")\nvar Third = lookup("T", "no")\n\nfunc envOr(k, d string) string {\n\tif v := os.Getenv(k); v != "" {\n\t\treturn v\n\t}\n\treturn d\n}\n\nfunc Run() {\n\tw := kafka.Writer{Topic: Topic}\n\tx := kafka.Writer{Topic: Other}\n\tr := kafka.NewReader(kafka.ReaderConfig{Topic: "in"})\n\ty := kafka.Writer{Topic: Third}\n}\n'
    out, _ = extract.extract_text("a/m.go", "go", go)
    assert {(f["what"], f["target"]) for f in out.facts} == {("producer", "orders"), ("producer", "paid"), ("consumer", "in")}
    assert extract.use_paths("a::{b, c::{d as e, *}, self}") == ["a::b", "a::c::d", "a::c", "a"] and extract.use_paths("x::y::*") == ["x::y"] and extract.use_paths("z") == ["z"]
    out, _ = extract.extract_text("a/m.rs", "rust", "use crate::{pay::Money, user};\nfn f(m: Money) {}\nfn g() { user::x(); }\n")
    assert {(out.nodes[f["local"]]["name"], f["target"]) for f in out.facts if f["what"] == "import"} == {("f", "crate::pay::Money"), ("g", "crate::user")}
