"""Extraction from literal source texts, and the streams over file events."""

import json
import os

from pyspark.sql import functions as F

from weftline.sources import extract, proto
from weftline.streaming import gate

PROTO = """
syntax = "proto3";
package users.v1;
import "common/types.proto";
// Manages users.
service UserService {
  rpc GetUser (GetUserRequest) returns (User);
  rpc WatchUsers (stream Q) returns (stream User) { option deprecated = true; }
}
message User {
  reserved 4, 8 to 10, 100 to max;
  reserved "old";
  string name = 1;
  repeated int32 ids = 2 [packed = true];
  map<string, Address> homes = 3;
  oneof contact { string mail = 5; string phone = 6; }
  message Address { string street = 1; }
  enum State { UNKNOWN = 0; ACTIVE = 1; }
}
"""


def test_proto_nodes_and_wire_schema():
    p = proto.parse(PROTO)
    assert p.package == "users.v1" and p.imports == ["common/types.proto"]
    assert [(n["kind"], n["name"]) for n in p.nodes] == [("grpc_service", "UserService"), ("grpc_method", "UserService.GetUser"), ("grpc_method", "UserService.WatchUsers"), ("proto_message", "User"), ("proto_message", "Address")]
    assert p.nodes[0]["docstring"] == "// Manages users."
    assert [(f["message"], f["number"], f["name"], f["cardinality"], f["value_type"], f["map_key"], f["oneof"]) for f in p.fields] == [
        ("User", 1, "name", "singular", "string", None, None), ("User", 2, "ids", "repeated", "int32", None, None), ("User", 3, "homes", "map", "Address", "string", None),
        ("User", 5, "mail", "singular", "string", None, "contact"), ("User", 6, "phone", "singular", "string", None, "contact"), ("User.Address", 1, "street", "singular", "string", None, None),
    ]
    assert [(r["lo"], r["hi"], r["name"]) for r in p.reserved] == [(4, 4, None), (8, 10, None), (100, proto.MAX_NUMBER, None), (None, None, "old")]
    assert [(e["enum"], e["number"]) for e in p.enums] == [("User.State", 0), ("User.State", 1)]


def facts(path, language, text):
    out, failed = extract.extract_text(path, language, text)
    assert not failed
    return {(n["kind"], n["name"]) for n in out.nodes}, {(f["what"], out.nodes[f["local"]]["name"], f["target"]) for f in out.facts}


def test_python():
    text = "from shop.models import Order\nimport users_pb2_grpc\n\n@app.route('/orders', methods=['POST'])\ndef create():\n    Order()\n    producer.send('orders.created', b'')\n    users_pb2_grpc.UserStub(ch)\n\n@shared_task\ndef settle():\n    consumer.subscribe(['orders.paid'])\n\nclass Pay(pb.PayServicer):\n    pass\nclass PayServicer: pass\n"
    nodes, got = facts("svc/src/api.py", "python", text)
    assert {("http_endpoint", "create"), ("queue", "settle"), ("service_class", "Pay"), ("grpc_service", "PayServicer")} == nodes
    assert {("producer", "create", "orders.created"), ("rpc_call", "create", "User"), ("consumer", "settle", "settle"), ("consumer", "settle", "orders.paid"), ("import", "create", "shop.models.Order")} <= got
    assert ("import", "settle", "shop.models.Order") not in got
    assert extract.extract_text("a.py", "python", "def (")[1]


def test_other_languages():
    nodes, got = facts("a/Order.java", "java", 'package com.shop;\nimport com.pay.Money;\npublic class OrderService {\n  // "not" a call: kafka.send("no")\n  public void place(Money m) {\n    kafkaTemplate.send("orders.created", m);\n    UserGrpc.newBlockingStub(ch);\n  }\n}\n')
    assert {("service_class", "OrderService"), ("service_class", "place")} <= nodes
    assert {("producer", "place", "orders.created"), ("rpc_call", "place", "User"), ("import", "place", "com.pay.Money")} <= got and not any(t == "no" for _, _, t in got)
    nodes, got = facts("a/main.go", "go", 'package main\n\nimport (\n\tpb "shop/users"\n)\n\ntype Store interface {\n}\n\nfunc Run() {\n\tpb.NewUserServiceClient(conn)\n\tr.GET("/orders/:id", h)\n}\n')
    assert {("interface", "Store"), ("service_class", "Run"), ("http_endpoint", "GET /orders/:id")} <= nodes and ("rpc_call", "Run", "UserService") in got
    nodes, got = facts("a/x.ts", "typescript", "import { K } from './kafka';\nimport { Router } from 'express';\nexport class Feed {\n  run() { this.producer.send({ topic: 'feed.out' }); }\n}\nrouter.post('/feed', h);\n")
    assert {("service_class", "Feed"), ("http_endpoint", "POST /feed")} <= nodes and ("producer", "Feed", "feed.out") in got
    assert facts("a/only.ts", "typescript", "import './x';\n")[0] == {("module", "only")}


def test_extract_tables(spark):
    rows = [("svc/a.proto", 0, "protobuf", PROTO), ("svc/b.py", 1, "python", "def f():\n    q.publish('t')\n"), ("svc/c.py", 1, "python", "def ("), ("svc/d.txt", 1, None, "x"), ("svc/e.py", 1, "python", None)]
    t = extract.tables(extract.extract(spark.createDataFrame(rows, "path string, repo_id int, language string, text string")))
    assert t["nodes"].count() == 6 and t["nodes"].select("id").distinct().count() == 6
    assert [(r["file_path"], r["topic"]) for r in t["producers"].collect()] == [("svc/b.py", "t")]
    sites = spark.createDataFrame([("svc/a.proto", 7, "s")], "file_path string, line int, site string")
    near = extract.attribute(sites, t["nodes"]).join(t["nodes"].select("id", "name"), "id").first()
    assert near["name"] == "UserService.GetUser"


def stream(spark, folder, rows, schema):
    folder.mkdir()
    for k, batch in enumerate(rows):
        (folder / f"{k}.json").write_text("\n".join(json.dumps(r) for r in batch))
        os.utime(folder / f"{k}.json", (1_700_000_000 + 10 * k,) * 2)  # files are read in this order
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(folder))


def drain(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
    try:
        q.processAllAvailable()
        return df.sparkSession.table(name).collect()
    finally:
        q.stop()


def at(seconds):
    return f"2024-01-01T00:{int(seconds) // 60:02d}:{seconds % 60:06.3f}Z"


def test_debounced_stream(spark, tmp_path):
    events = [[{"root": "r", "path": p, "ts": at(s)} for p, s in (("a", 0.0), ("b", 0.1), ("a", 0.2), ("c", 5.0))], [{"root": "r", "path": "z", "ts": at(100)}], [{"root": "r", "path": "z", "ts": at(200)}]]
    got = drain(gate.debounced(stream(spark, tmp_path / "s", events, "root string, path string, ts timestamp")), "debounced")
    assert [(r["n"], list(r["paths"])) for r in sorted(got, key=lambda r: r["first"])][:2] == [(3, ["a", "b"]), (1, ["c"])]


def test_gate_rules():
    g = gate.Gate()
    assert g.step(0, "tree", "a") == [("pass", 0, ["a"], False, False, 0)]
    assert g.step(100, "activity", None) == g.step(200, "tree", "b") == g.step(250, "ref", None) == [] and g.due() == 550
    assert g.step(600, "tree", "c") == [("flush", 550, ["b"], True, False, 450), ("pass", 600, ["c"], False, False, 0)]
    g = gate.Gate()
    assert g.step(0, "busy", None) == g.step(400, "tree", "x") == [] and g.due() == 60_000  # a busy repository does not settle
    assert g.step(5_000, "free", None) == [] and g.due() == 5_300 and g.expire(5_299) == []
    assert g.expire(5_300) == [("flush", 5_300, ["x"], False, False, 5_300)] and g.due() is None
    g = gate.Gate()
    g.step(0, "busy", None)
    assert g.step(61_000, "tree", "y") == [("flush", 60_000, [], False, True, 60_000), ("pass", 61_000, ["y"], False, False, 0)]


def test_hold_gate_stream(spark, tmp_path):
    row = lambda kind, s, path=None: {"root": "r", "kind": kind, "path": path, "ts": at(s)}
    events = [[row("tree", 0.0, "a"), row("activity", 1.0), row("tree", 1.1, "b"), row("ref", 1.2)], [row("tree", 50, "c")], [row("tree", 120, "d")]]
    got = drain(gate.hold_gate(stream(spark, tmp_path / "g", events, "root string, kind string, path string, ts timestamp")), "gated")
    rows = [(r["action"], list(r["paths"]), r["ref"], r["held_ms"]) for r in sorted(got, key=lambda r: r["at"])]
    assert rows == [("pass", ["a"], False, 0), ("flush", ["b"], True, 200 + gate.SETTLE_MS), ("pass", ["c"], False, 0), ("pass", ["d"], False, 0)]


def test_lock_rule(spark):
    df = spark.createDataFrame([(None, None), (5, False), (40_000, False), (40_000, True), (40_000, None)], "age long, git boolean")
    assert [r[0] for r in df.select(gate.lock_is_live(F.col("age"), F.col("git"))).collect()] == [False, True, False, True, True]


def test_classify(spark):
    df = spark.createDataFrame([("a/.git/HEAD",), ("a/.git/index.lock",), ("a/src/x.py",)], "path string")
    assert [r[0] for r in df.select(gate.classify()).collect()] == ["ref", "activity", "tree"]
    assert df.where(F.col("path") == "").count() == 0
