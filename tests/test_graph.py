"""Derived edges, RPC traces and the impact matrix on a small polyglot workspace."""

from tests.test_operators import flow, node, nodes, pairs
from weftline import schema
from weftline.operators import graph


def workspace(spark):
    n = nodes(spark, [
        node(1, "PaymentService.ProcessPayment", "grpc_method", "/proto/pay.proto", repo=0), node(2, "process_payment", "grpc_method", "/go/pay.go", repo=1),
        node(3, "Checkout", path="/ts/a.ts", repo=2), node(4, "Refund", path="/ts/b.ts", repo=2), node(5, "Worker", path="/go/w.go", repo=1), node(6, "Money", package="pay", repo=1),
    ])
    imports = spark.createDataFrame([(3, "pay.Money"), (3, "pay.Money")], schema.IMPORTS)
    calls = spark.createDataFrame([(3, "PaymentService.ProcessPayment"), (4, "processpayment")], "node_id long, target string")
    return graph.Snapshot(n, imports, flow(spark, [(3, "/ts/a.ts", "paid", False)]), flow(spark, [(5, "/go/w.go", "paid", True)]), calls)


def test_edges_are_unique_and_typed(spark):
    edges = graph.derive_edges(workspace(spark))
    got = pairs(edges, "from_id", "to_id", "kind", "confidence")
    hub = next(t for f, t, k, _ in got if k == "produces")
    assert hub < 0
    assert got == {
        (3, 6, "imports", "exact"), (3, hub, "produces", "exact"), (hub, 5, "consumes", "heuristic"), (2, 1, "implements", "heuristic"),
        (3, 1, "calls_rpc", "exact"), (4, 1, "calls_rpc", "heuristic"),
    }


def test_trace_and_matrix(spark):
    s = workspace(spark)
    edges = graph.derive_edges(s)
    assert pairs(graph.grpc_trace(s, edges, "ProcessPayment"), "role", "id") == {("definition", 1), ("handler", 2), ("client", 3), ("client", 4)}
    assert pairs(graph.impact_matrix(s, edges, "ProcessPayment"), "scope", "role", "id", "confidence") == {("INTERNAL", "handler", 2, "heuristic"), ("EXTERNAL", "client", 3, "exact"), ("EXTERNAL", "client", 4, "heuristic")}
    assert pairs(graph.impact_matrix(s, edges, "paid"), "scope", "role", "id") == {("INTERNAL", "producer", 3), ("EXTERNAL", "consumer", 5)}
