"""Kinds and facts of declarations per language."""

from weftline.sources import extract


def facts(path, language, text):
    out, failed = extract.extract_text(path, language, text)
    assert not failed
    return {(n["kind"], n["name"]) for n in out.nodes}, {(f["what"], out.nodes[f["local"]]["name"], f["target"]) for f in out.facts}


def test_java():
    nodes, got = facts("a/A.java", "java", 'package x;\n@GrpcService\npublic class Pay extends PayGrpc.PayImplBase {\n  public Pay() {\n  }\n  @GetMapping("/p/{id}")\n  public String one() {\n  }\n  @KafkaListener(topics = {"paid"})\n  public void on(String s) {\n  }\n  void plain() {\n  }\n}\nclass Impl extends FooGrpc.FooImplBase {\n}\n')
    assert {("grpc_service", "Pay"), ("grpc_service", "Impl"), ("http_endpoint", "one"), ("kafka_topic", "paid"), ("service_class", "plain"), ("http_endpoint", "GET /p/{id}")} == nodes
    assert ("consumer", "paid", "paid") in got


def test_go():
    nodes, got = facts("a/m.go", "go", 'package m\n\ntype server struct {\n\tpb.UnimplementedPayServer\n}\n\nfunc (s *server) Charge(ctx context.Context) error {\n\treturn nil\n}\n\nfunc HandlePing(w http.ResponseWriter, r *http.Request) {\n}\n\nfunc HandleOther(x int) {\n}\n\nfunc main() {\n\tpb.RegisterPayServer(g, &server{})\n\tredis.NewCacheClient(x)\n\tpb.NewUserClient(c)\n}\n')
    assert {("grpc_method", "Charge"), ("http_endpoint", "HandlePing"), ("service_class", "HandleOther"), ("grpc_service", "Pay"), ("service_class", "server")} <= nodes
    assert {t for w, _, t in got if w == "rpc_call"} == {"User"}


def test_rust():
    nodes, _ = facts("a/m.rs", "rust", '#[tonic::async_trait]\nimpl Pay for Server {\n    async fn charge(&self) -> u8 {\n        1\n    }\n}\nimpl UserService for X {\n    fn get(&self) {}\n}\nimpl Display for X {\n    fn fmt(&self) {}\n}\n#[get("/ping")]\nasync fn ping() {}\n')
    assert {("grpc_service", "Pay"), ("grpc_method", "charge"), ("grpc_service", "UserService"), ("grpc_method", "get"), ("service_class", "fmt"), ("http_endpoint", "GET /ping")} <= nodes


def test_kotlin_and_csharp():
    nodes, got = facts("a/A.kt", "kotlin", 'package x\n@GrpcService\nclass Pay\nclass C {\n  @GetMapping("/x")\n  fun one() { }\n  @KafkaListener(topics = ["in"])\n  fun on() { }\n}\n')
    assert {("grpc_service", "Pay"), ("http_endpoint", "one"), ("kafka_topic", "in"), ("service_class", "C")} <= nodes and ("consumer", "in", "in") in got
    nodes, _ = facts("a/A.cs", "csharp", 'namespace X;\npublic class C {\n  public C(int x) { }\n  [HttpGet("/x")]\n  public async Task<int> One(int a) { return 1; }\n  private void Two() { if (a) { } }\n}\n')
    assert {("http_endpoint", "One"), ("service_class", "Two"), ("service_class", "C")} <= nodes and ("service_class", "if") not in nodes


def test_scripting_languages():
    nodes, _ = facts("app/users_controller.rb", "ruby", "class UsersController\n  def index\n  end\n  def initialize\n  end\n  def _hidden\n  end\nend\nclass Other\n  def go\n  end\nend\nget '/no'\n")
    assert {("http_endpoint", "index"), ("service_class", "initialize"), ("service_class", "_hidden"), ("service_class", "go")} <= nodes and not any("/no" in n for _, n in nodes)
    assert {("http_endpoint", "GET /yes"), ("http_endpoint", "resources :users")} <= facts("config/routes.rb", "ruby", "get '/yes'\nresources :users\n")[0]
    nodes, _ = facts("a/C.php", "php", "<?php\nclass UserController {\n  public function __construct() { }\n  #[Route('/u/{id}')]\n  public function show() { }\n  public function list() { }\n}\nRoute::get('/x', 'y');\n")
    assert {("http_endpoint", "/u/{id}"), ("http_endpoint", "list"), ("service_class", "__construct"), ("http_endpoint", "GET /x")} <= nodes


def test_swift_scala_cpp():
    assert {("http_endpoint", "handlePing"), ("service_class", "other"), ("http_endpoint", "GET /x"), ("interface", "P")} <= facts("a/A.swift", "swift", 'protocol P { }\nfunc handlePing() { }\nfunc other() { }\napp.get("x") { }\n')[0]
    assert {("http_endpoint", "GET /a"), ("http_endpoint", "POST /a"), ("http_endpoint", "ANY /b"), ("interface", "T")} <= facts("a/A.scala", "scala", 'trait T { }\nobject O {\n  path("a") { get { x } ~ post { y } }\n  pathPrefix("b") { z }\n}\n')[0]
    nodes, _ = facts("a/a.cpp", "cpp", "class Pay : public pay::Pay::Service {\n};\nclass I {\n  virtual void f() = 0;\n};\nclass K {\n  K() { }\n};\nStatus Pay::Charge(int x) {\n  if (x) { }\n}\nvoid HandleIt(int x) {\n}\nPay::~Pay() {\n}\nint plain() {\n}\n")
    assert {("grpc_service", "Pay"), ("interface", "I"), ("grpc_method", "Charge"), ("http_endpoint", "HandleIt"), ("service_class", "plain"), ("service_class", "K")} <= nodes and not any("~" in n for _, n in nodes)
