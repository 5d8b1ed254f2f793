"""Facts of source files: one row in, declarations and facts out.

Protobuf goes through its own tokenizer and Python through ``ast``; other languages are read with
declaration and call patterns over text whose comments are blanked out (no grammar library is
assumed).  Extraction is a narrow ``mapInPandas`` over (path, repo_id, language, text); a file that cannot be
parsed yields no facts and ``parse_failed``.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline import schema
from weftline.functions import file_routes as R
from weftline.functions import text as T
from weftline.plans.store import materialize
from weftline.sources import javascript, proto, rpc_records

FACTS = "path string, repo_id int, what string, local int, name string, kind string, line_start int, line_end int, package string, signature string, docstring string, target string, heuristic boolean"
_ARROW = {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_()}
VERBS = "get|post|put|patch|delete|head|options"


class Facts:
    def __init__(self, package: str):
        self.package, self.nodes, self.facts = package, [], []
        self._seen: set[tuple] = set()

    def node(self, name: str, kind: str, start: int, end: int, signature: str | None = None, doc: str | None = None) -> int:
        self.nodes.append({"what": "node", "local": len(self.nodes), "name": name, "kind": kind, "line_start": start, "line_end": end, "signature": signature, "docstring": doc})
        return len(self.nodes) - 1

    def fact(self, what: str, local: int, target: str, heuristic: bool = False) -> None:
        if target and (what, local, target, heuristic) not in self._seen:
            self._seen.add((what, local, target, heuristic))
            self.facts.append({"what": what, "local": local, "target": target, "heuristic": heuristic})

    def enclosing(self, line: int) -> int | None:
        """The smallest declaration around a line, the first on a tie."""
        around = [(n["line_end"] - n["line_start"], k) for k, n in enumerate(self.nodes) if n["line_start"] <= line <= n["line_end"]]
        return min(around)[1] if around else None


def package_of(path: str) -> str:
    """First directory that is not merely technical, else ``shared``."""
    technical = {"src", "main", "lib", "app", "apps", "packages", "services", "internal", "pkg", "cmd", "java", "kotlin", "python", "go", "test", "tests", "proto"}
    parts = [p for p in path.split("/")[:-1] if p]
    named = [p for p in parts if p.lower() not in technical]
    return named[-1] if named else "shared"


def _python(path: str, text: str, out: Facts) -> None:
    tree = ast.parse(text)
    lines = text.split("\n")

    def dotted(e: ast.AST) -> str:
        return f"{dotted(e.value)}.{e.attr}" if isinstance(e, ast.Attribute) else e.id if isinstance(e, ast.Name) else ""

    def text_of(e: ast.AST | None) -> str | None:
        return e.value if isinstance(e, ast.Constant) and isinstance(e.value, str) else None

    for n in ast.walk(tree):
        if isinstance(n, ast.ClassDef):
            served = n.name.endswith("Servicer") and not path.endswith("_pb2_grpc.py")
            out.node(n.name, "grpc_service" if served else "service_class", n.lineno, n.end_lineno, lines[n.lineno - 1].strip(), ast.get_docstring(n))
        elif isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)):
            kind, signature, task = "service_class", lines[n.lineno - 1].strip(), False
            for d in n.decorator_list:
                call = d if isinstance(d, ast.Call) else None
                name = dotted(call.func if call else d)
                head, _, tail = name.rpartition(".")
                if tail in ("task", "shared_task") or name == "shared_task":
                    kind, task = "queue", True
                elif head in ("app", "router", "api_router", "bp", "blueprint") and call and (tail == "route" or tail in VERBS.split("|")):
                    route = text_of(call.args[0]) if call.args else None
                    methods = next((k.value for k in call.keywords if k.arg == "methods"), None)
                    verb = tail.upper() if tail != "route" else (text_of(methods.elts[0]) or "GET").upper() if isinstance(methods, (ast.List, ast.Tuple)) and methods.elts else "GET"
                    if route is not None:
                        kind, signature = "http_endpoint", f"{verb} {route}"
            k = out.node(n.name, kind, n.lineno, n.end_lineno, signature, ast.get_docstring(n))
            if task:
                out.fact("consumer", k, n.name)
    if not out.nodes and text.strip():
        out.node(path.rsplit("/", 1)[-1].rsplit(".", 1)[0], "module", 1, len(lines))
    for n in ast.walk(tree):
        if isinstance(n, (ast.Import, ast.ImportFrom)):
            base = "." * getattr(n, "level", 0) + (getattr(n, "module", "") or "")
            for a in n.names:
                module = isinstance(n, ast.Import)
                local = (a.asname or a.name).split(".")[0]
                for k, node in enumerate(out.nodes):
                    body = "\n".join(lines[node["line_start"] - 1 : node["line_end"]])
                    if module or a.name == "*" or local in body:
                        out.fact("import", k, a.name if module else base if a.name == "*" else f"{base}.{a.name}" if base.strip(".") else a.name)
        elif isinstance(n, ast.Call) and isinstance(n.func, ast.Attribute):
            at = out.enclosing(n.lineno)
            k, method = (0 if at is None else at), n.func.attr
            if method in ("delay", "apply_async"):
                out.fact("producer", k, dotted(n.func.value).rsplit(".", 1)[-1])
            elif method in ("produce", "send", "send_and_wait", "publish"):
                topic = text_of(n.args[0]) if n.args else None
                topic = topic or next((text_of(w.value) for w in n.keywords if w.arg == "topic"), None)
                if topic:
                    out.fact("producer", k, topic)
            elif method == "subscribe":
                first = n.args[0] if n.args else None
                for e in first.elts if isinstance(first, (ast.List, ast.Tuple)) else [first]:
                    out.fact("consumer", k, text_of(e) or "")
            elif re.fullmatch(r"\w+Stub", method) and dotted(n.func.value).endswith("_pb2_grpc"):
                out.fact("rpc_call", k, method[:-4])
        elif isinstance(n, ast.Call) and isinstance(n.func, ast.Name) and n.func.id == "AIOKafkaConsumer":
            at = out.enclosing(n.lineno)
            for e in n.args:
                out.fact("consumer", 0 if at is None else at, text_of(e) or "")


def _protobuf(path: str, text: str, out: Facts) -> None:
    p = proto.parse(text)
    out.package = p.package or out.package
    for n in p.nodes:
        if n:
            out.node(n["name"], n["kind"], n["line_start"], n["line_end"], None, n["docstring"])
    for k in range(len(out.nodes)):
        for target in p.imports:
            out.fact("import", k, target)


#: Per language: declarations (kind, pattern with a name group), package, imports, and facts (what, pattern).
_IDENT = r"(?P<name>[A-Za-z_$][\w$]*)"
RULES: dict[str, dict] = {
    "java": {
        "package": r"^\s*package\s+([\w.]+)\s*;",
        "import": r"^\s*import\s+(?:static\s+)?([\w.]+(?:\.\*)?)\s*;",
        "nodes": [
            ("interface", rf"\binterface\s+{_IDENT}"), ("service_class", rf"\b(?:class|enum|record)\s+{_IDENT}"),
            ("service_class", rf"^\s*(?:public|protected|private|static|final|synchronized|\s)*[\w<>\[\], ?.]+\s+{_IDENT}\s*\([^;{{}}]*\)\s*(?:throws\s+[\w., ]+)?\{{"),
        ],
        "facts": [("producer", r"\b\w*[kK]afka\w*\s*\.\s*send\s*\(\s*\"([^\"]+)\""), ("rpc_call", r"\b(\w+)Grpc\s*\.\s*new(?:Blocking|Future)?Stub\s*\("), ("consumer", r"@KafkaListener\s*\([^)]*?topics\s*=\s*\{?\s*\"([^\"]+)\"")],
        "routes": [r"@(?P<verb>Get|Post|Put|Patch|Delete)Mapping\s*\(\s*(?:value\s*=\s*|path\s*=\s*)?\"(?P<path>[^\"]*)\""],
    },
    "go": {
        "package": r"^\s*package\s+(\w+)", "import": r"^\s*(?:import\s+)?(?:[\w.]+\s+)?\"([\w./-]+)\"\s*$",
        "nodes": [("interface", rf"^type\s+{_IDENT}\s+interface\b"), ("service_class", rf"^type\s+{_IDENT}\s+(?!interface\b)\S+"), ("service_class", rf"^func\s+(?:\([^)]*\)\s*)?{_IDENT}\s*[\[(]"), ("grpc_service", r"\bRegister(?P<name>\w+)Server\s*\(")],
        "facts": [("rpc_call", r"\b(?!(?:redis|http|mongo|s3|sqs|vault|elastic|sql|db|kafka|sarama)\.)\w+\.New(\w+)Client\s*\("), ("producer", r"(?:kafka\.Message|kafka\.Writer|WriterConfig|ProducerMessage)\s*\{[^}]*?Topic:\s*(?:\"([^\"]+)\"|(\w+))"), ("consumer", r"ReaderConfig\s*\{[^}]*?Topic:\s*(?:\"([^\"]+)\"|(\w+))")],
        "routes": [rf"\.\s*(?P<verb>(?i:{VERBS}))\s*\(\s*\"(?P<path>/[^\"]*)\"\s*,"],
    },
    "typescript": {
        "package": None, "import": r"(?:\bfrom\s+|\bimport\s+|\brequire\s*\(\s*|\bimport\s*\(\s*)['\"]([^'\"]+)['\"]",
        "nodes": [("interface", rf"^\s*(?:export\s+)?(?:declare\s+)?(?:interface|type)\s+{_IDENT}"), ("service_class", rf"^\s*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?(?:class|enum|namespace)\s+{_IDENT}"), ("service_class", rf"^(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*{_IDENT}"), ("service_class", rf"^(?:export\s+)?(?:const|let)\s+{_IDENT}\s*[:=]")],
        "facts": [], "routes": [],  # read from tokens, see _script
    },
    "rust": {
        "package": None, "import": r"^\s*(?:pub(?:\([^)]*\))?\s+)?use\s+([^;]+);",
        "nodes": [("interface", rf"^\s*(?:pub(?:\([^)]*\))?\s+)?trait\s+{_IDENT}"), ("service_class", rf"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:struct|enum)\s+{_IDENT}"), ("service_class", rf"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:async\s+)?(?:unsafe\s+)?fn\s+{_IDENT}")],
        "facts": [("producer", r"FutureRecord::to\(\s*\"([^\"]+)\""), ("consumer", r"\.subscribe\(\s*&\[\s*\"([^\"]+)\"")],
        "routes": [r"\.route\(\s*\"(?P<path>/[^\"]*)\"\s*,\s*(?P<verb>\w+)\s*\(", r"#\[(?P<verb>get|post|put|patch|delete)\(\s*\"(?P<path>[^\"]*)\""],
    },
    "kotlin": {
        "package": r"^\s*package\s+([\w.]+)", "import": r"^\s*import\s+([\w.]+(?:\.\*)?)",
        "nodes": [("interface", rf"\binterface\s+{_IDENT}"), ("service_class", rf"\b(?:class|object)\s+{_IDENT}"), ("service_class", rf"\bfun\s+(?:<[^>]*>\s*)?(?:[\w.]+\.)?{_IDENT}\s*\(")],
        "facts": [("producer", r"\.\s*(?:send|produce)\s*\(\s*(?:ProducerRecord\s*(?:<[^>]*>)?\s*\(\s*)?\"([^\"]+)\""), ("consumer", r"\.\s*subscribe\s*\(\s*(?:listOf|setOf|arrayListOf)?\s*\(?\s*\"([^\"]+)\"")],
        "routes": [r"@(?P<verb>Get|Post|Put|Delete)Mapping\s*\(\s*\"(?P<path>[^\"]*)\""],
    },
    "csharp": {
        "package": r"^\s*namespace\s+([\w.]+)", "import": r"^\s*using\s+([\w.]+)\s*;",
        "nodes": [("interface", rf"\binterface\s+{_IDENT}"), ("service_class", rf"\b(?:class|struct|record)\s+{_IDENT}")],
        "facts": [("producer", r"\.\s*Produce(?:Async)?\s*\(\s*(?:new\s+TopicPartition\s*\(\s*)?\"([^\"]+)\""), ("consumer", r"\.\s*Subscribe\s*\(\s*\"([^\"]+)\"")],
        "routes": [r"\[Http(?P<verb>Get|Post|Put|Patch|Delete)\s*\(\s*\"(?P<path>[^\"]*)\""],
    },
    "ruby": {"package": None, "import": r"^\s*require(?:_relative)?\s+['\"]([^'\"]+)['\"]", "nodes": [("service_class", r"^\s*class\s+(?P<name>[A-Z][\w:]*)"), ("interface", r"^\s*module\s+(?P<name>[A-Z][\w:]*)"), ("service_class", r"^\s*def\s+(?P<name>[\w.?!]+)")], "facts": [], "routes": [rf"^\s*(?P<verb>{VERBS}|resources)\s+(?:['\"]|:)(?P<path>/?[^'\",\s]+)"]},
    "php": {"package": r"^\s*namespace\s+([\w\\]+)\s*;", "import": r"^\s*use\s+([\w\\]+)", "nodes": [("interface", rf"\binterface\s+{_IDENT}"), ("service_class", rf"^\s*(?:abstract\s+|final\s+)*class\s+{_IDENT}"), ("service_class", rf"\bfunction\s+{_IDENT}\s*\(")], "facts": [], "routes": [r"Route::(?P<verb>get|post|put|patch|delete|any)\s*\(\s*['\"](?P<path>[^'\"]+)['\"]"]},
    "swift": {"package": None, "import": r"^\s*import\s+(\w+)", "nodes": [("interface", rf"\bprotocol\s+{_IDENT}"), ("service_class", rf"\b(?:class|struct|extension)\s+{_IDENT}"), ("service_class", rf"\bfunc\s+{_IDENT}")], "facts": [], "routes": [r"\.\s*(?P<verb>get|post|put|patch|delete)\s*\(\s*\"(?P<path>[^\"]+)\""]},
    "scala": {"package": r"^\s*package\s+([\w.]+)", "import": r"^\s*import\s+([\w.{}, _]+)", "nodes": [("interface", rf"\btrait\s+{_IDENT}"), ("service_class", rf"\b(?:class|object)\s+{_IDENT}")], "facts": [], "routes": []},
    "cpp": {"package": r"\bnamespace\s+([\w:]+)\s*\{", "import": r"^\s*#\s*include\s*[\"<]([^\">]+)[\">]", "nodes": [("grpc_service", rf"\b(?:class|struct)\s+{_IDENT}[^;{{]*:[^;{{]*::Service\b[^;{{]*\{{"), ("service_class", rf"\b(?:class|struct)\s+{_IDENT}(?![^;{{]*::Service)[^;{{()]*\{{")], "facts": [], "routes": []},
}
for _alias in ("javascript", "vue", "svelte", "astro"):
    RULES[_alias] = RULES["typescript"]
_BLANK = re.compile(r"//[^\n]*|/\*.*?\*/", re.S)


def _block_end(text: str, at: int) -> int:
    """Offset of the bracket that closes the block opened after ``at``; the line's end if none opens."""
    stop = text.find("\n", at)
    stop = len(text) if stop < 0 else stop
    start = text.find("{", at, stop + 200)
    if start < 0 or (text.find(";", at, start) >= 0):
        return stop
    depth = 0
    for m in re.compile(r"[{}]").finditer(text, start):
        depth += 1 if m[0] == "{" else -1
        if depth == 0:
            return m.end()
    return len(text)


def _ruby_end(lines: list[str], start: int) -> int:
    """Line of the ``end`` that stands as far in as the declaration; its own line if there is none."""
    indent = len(lines[start - 1]) - len(lines[start - 1].lstrip())
    return next((n for n in range(start + 1, len(lines) + 1) if lines[n - 1].strip() == "end" and len(lines[n - 1]) - len(lines[n - 1].lstrip()) == indent), start)


def _by_rules(path: str, text: str, out: Facts, rules: dict) -> None:
    clean = _BLANK.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text)
    line = lambda offset: clean.count("\n", 0, offset) + 1
    lines = text.split("\n")
    if rules["package"] and (m := re.search(rules["package"], clean, re.M)):
        out.package = m[1].replace("\\", ".")
    seen: set[tuple[str, int]] = set()
    for kind, pattern in rules["nodes"]:
        for m in re.finditer(pattern, clean, re.M):
            name, start = m["name"], line(m.start("name"))
            if (name, start) in seen or name in ("if", "for", "while", "switch", "return", "catch", "new", "else"):
                continue
            seen.add((name, start))
            end = _ruby_end(lines, start) if path.endswith((".rb", ".rake")) else line(_block_end(clean, m.end("name")))
            out.node(name, kind, start, end, lines[start - 1].strip())
    refine(path, text, clean, out)
    out.nodes.sort(key=lambda n: (n["line_start"], -n["line_end"]))
    for k, n in enumerate(out.nodes):
        n["local"] = k
    declared = rules["routes"] if not path.endswith((".rb", ".rake")) or "routes" in path else []
    for pattern in declared:
        for m in re.finditer(pattern, clean, re.M):
            verb = (m["verb"] or "any").upper()
            label = f"resources :{m['path']}" if verb == "RESOURCES" else f"{verb} /{m['path'].lstrip('/')}"
            out.node(label, "http_endpoint", line(m.start()), line(m.end()), label)
    if path.endswith((".scala", ".sc")):
        for m in re.finditer(r"\bpath(?:Prefix|End)?\s*\(\s*\"([^\"]+)\"[^)]*\)\s*\{", clean):
            inner = clean[m.end() : _block_end(clean, m.end() - 1)]
            for verb in dict.fromkeys(re.findall(r"\b(get|post|put|patch|delete)\s*\{", inner)) or ("any",):
                label = f"{verb.upper()} /{m[1].lstrip('/')}"
                out.node(label, "http_endpoint", line(m.start()), line(m.start()), label)
    if not out.nodes and clean.strip():
        out.node(path.rsplit("/", 1)[-1].rsplit(".", 1)[0], "module", 1, len(lines))
    for k, n in enumerate(out.nodes):
        if topic := n.pop("topic", None):
            out.fact("consumer", k, topic)
    named = go_constants(clean) if path.endswith(".go") else {}
    for what, pattern in rules["facts"]:
        for m in re.finditer(pattern, clean, re.S):
            at = out.enclosing(line(m.start()))
            target = m[1] if m.lastindex == 1 else m[2] and named.get(m[2])
            if target:
                out.fact(what, 0 if at is None else at, target)
    bodies = ["\n".join(lines[n["line_start"] - 1 : n["line_end"]]) for n in out.nodes]
    found = (m[1].strip() for m in re.finditer(rules["import"], clean, re.M))
    if path.endswith(".rs"):
        found = (p for tree in found for p in use_paths(tree))
    for target in dict.fromkeys(found):
        used = re.split(r"[./:\\]+", re.sub(r"\.\w+$", "", target) if "/" in target else target)[-1]
        for k, body in enumerate(bodies):
            if used in ("*", "") or "/" in target or used in body:
                out.fact("import", k, target)


SCRIPTS = ("typescript", "javascript", "vue", "svelte", "astro")
_MAY_ROUTE = re.compile(r"(?:^|/)\+[^/]*$|(?:^|/)(?:app|pages|routes|api)/")
COMPONENTS = ("vue", "svelte", "astro")


def _script(path: str, text: str, out: Facts) -> None:
    """Declarations and imports by pattern; events, routes and operations from tokens.

    A component file is read at its script parts, and is a node itself unless its name starts with ``+`` or is
    declared in it.
    """
    component = path.endswith(tuple("." + c for c in COMPONENTS))
    view = javascript.script_view(path, text) if component else text
    _by_rules(path, view, out, RULES["typescript"])
    stem = path.rsplit("/", 1)[-1].rsplit(".", 1)[0]
    lines = text.count("\n") + 1
    if component and not stem.startswith("+") and all(n["name"] != stem or n["kind"] == "module" for n in out.nodes):
        out.nodes = [n for n in out.nodes if n["kind"] != "module"]
        for k, n in enumerate(out.nodes):
            n["local"] = k
        out.node(stem, "service_class", 1, lines, None)
    if out.nodes and _MAY_ROUTE.search(path):  # what ``tables`` reads routes from
        script = javascript.Script(view)
        for name in javascript.exports(script):
            out.fact("export", 0, name)
        for module in script.imports:
            out.fact("module", 0, module)
    broker, http = javascript.mentions_broker(view), javascript.mentions_http(view)
    api = "trpc" in view or "TRPC" in view or "graphql" in view.lower()
    typed = "Client" in view or "Service" in view or "Grpc" in view or "enum " in view or "const " in view
    if not (broker or http or api or typed):
        return
    script = javascript.Script(view)
    for r in javascript.routes(script) if http else []:
        label = f"{r['method']} {r['path']}"
        out.node(label, "http_endpoint", r["line"], r["line"], label)
    for r in javascript.procedures(script) if api else []:
        out.node(r["name"], "http_endpoint", r["line"], r["line"], r["name"])
    for e in javascript.events(script) if broker else []:
        at = out.enclosing(e["line"])
        out.fact("producer" if e["role"] == "produce" else "consumer", 0 if at is None else at, e["name"], e["heuristic"])
    for line, record in rpc_records.records(script) if typed else []:
        at = out.enclosing(line)
        if at is not None:
            out.fact("rpc_record", at, record)


def use_paths(text: str, prefix: str = "") -> list[str]:
    """Paths of a Rust ``use`` tree: ``a::{b, c::*}`` -> ``a::b``, ``a::c::*`` ends as ``a::c``."""
    text = text.strip()
    if "{" in text:
        head = text[: text.index("{")].strip().removesuffix("::").strip()
        inner = text[text.index("{") + 1 : text.rindex("}") if "}" in text else len(text)]
        joined = "::".join(p for p in (prefix, head) if p)
        parts, depth, last = [], 0, 0
        for k, c in enumerate(inner + ","):
            depth += (c == "{") - (c == "}")
            if c == "," and depth == 0:
                parts.append(inner[last:k])
                last = k + 1
        return [p for part in parts for p in use_paths(part, joined)]
    path = text.split(" as ")[0].strip()
    path = path.removesuffix("::*")
    if path in ("", "self", "*"):
        return [prefix] if prefix and text else []
    return ["::".join(p for p in (prefix, path) if p)]


def go_constants(clean: str) -> dict[str, str]:
    """String constants of a Go file, and variables set by a function of the file that reads the environment with a
    literal to fall back on."""
    readers = {m[1] for m in re.finditer(r"func\s+(\w+)\s*\([^)]*\)\s*string\s*\{(.*?)\n\}", clean, re.S) if re.search(r"os\.(?:Getenv|LookupEnv)\(", m[2])}
    out = {m[1]: m[2] for m in re.finditer(r"\b(\w+)\s*(?:string\s*)?(?::=|=)\s*\"([^\"\n]*)\"\s*$", clean, re.M)}
    for m in re.finditer(r"\b(\w+)\s*(?:string\s*)?(?::=|=)\s*(\w+)\(\s*\"[^\"\n]*\"\s*,\s*\"([^\"\n]*)\"\s*\)", clean):
        if m[2] in readers:
            out[m[1]] = m[3]
    return out


#: Annotations and attributes that make a method an endpoint, and receivers whose clients are no RPC stubs (fixed values).
JAVA_ROUTES = (
    "GetMapping", "PostMapping", "PutMapping", "DeleteMapping", "PatchMapping", "RequestMapping", "GET", "POST", "PUT", "DELETE", "PATCH", "Path", "Get", "Post", "Put", "Delete", "Patch",
)
KOTLIN_ROUTES = ("GetMapping", "PostMapping", "PutMapping", "DeleteMapping", "RequestMapping")
GO_OTHER_CLIENTS = ("redis", "http", "mongo", "s3", "sqs", "vault", "elastic", "sql", "db", "kafka", "sarama")
_HANDLER = re.compile(r"[Hh]andle\w*|\w+Handler")


def _head(text_lines: list[str], start: int) -> str:
    """Annotation, attribute and decorator lines directly above a declaration, and its own line."""
    first = start - 1
    while first > 0 and re.match(r"\s*(?:@|#\[|\[\w)", text_lines[first - 1]):
        first -= 1
    return "\n".join(text_lines[first:start])


def _topic_of(head: str) -> str | None:
    m = re.search(r"@KafkaListener\s*\(([^)]*)\)", head, re.S)
    topics = m and re.search(r"topics\s*=\s*[\[{]?\s*\"([^\"]+)\"", m[1])
    return topics[1] if topics else None


def refine(path: str, text: str, clean: str, out: Facts) -> None:
    """Kinds that a declaration's surroundings decide: services, endpoints, listeners; constructors and destructors go."""
    ext, lines = path.rsplit(".", 1)[-1], text.split("\n")
    classes = [n for n in out.nodes if re.search(r"\b(?:class|struct|object|extension|impl|module|record|trait|interface|protocol)\b", n["signature"] or "")]

    def owner(n: dict) -> dict | None:
        around = [c for c in classes if c is not n and c["line_start"] <= n["line_start"] and n["line_end"] <= c["line_end"]]
        return min(around, key=lambda c: c["line_end"] - c["line_start"]) if around else None

    def annotated(head: str, names: tuple[str, ...]) -> bool:
        return bool(re.search(r"@(?:" + "|".join(names) + r")\b", head))

    body = lambda n: "\n".join(lines[max(0, n["line_start"] - 3) : n["line_end"]])
    served = set()
    if ext == "go":
        served = {m[1] for m in re.finditer(r"type\s+(\w+)\s+struct\s*\{[^}]*\bUnimplemented\w+Server\b", clean)} | {m[1] for m in re.finditer(r"Register\w+Server\s*\([^,]+,\s*&?(?:\w+\.)?(\w+)\s*[{)]", clean)}
    if ext == "rs":
        for m in re.finditer(r"((?:#\[[^\]]*\]\s*)*)impl(?:<[^>]*>)?\s+(?:\w+::)*(\w+)(?:<[^>]*>)?\s+for\s+(\w+)", clean):
            if "tonic::async_trait" in m[1] or m[2].endswith(("Server", "Service")):
                start = clean.count("\n", 0, m.start(2)) + 1
                out.node(m[2], "grpc_service", start, clean.count("\n", 0, _block_end(clean, m.end())) + 1, lines[start - 1].strip())
    drop = []
    for n in out.nodes:
        if n["kind"] not in ("service_class", "interface"):
            continue
        name, own, head = n["name"], owner(n), _head(lines, n["line_start"])
        first = lines[n["line_start"] - 1]
        is_class = n in classes
        if ext == "java":
            if is_class and n["kind"] == "service_class" and ("@GrpcService" in body(n) or re.search(r"\bextends\s+\S*Grpc\S*ImplBase", first)):
                n["kind"] = "grpc_service"
            elif not is_class and own and name == own["name"]:
                drop.append(n)
            elif not is_class and (topic := _topic_of(head)):
                n |= {"kind": "kafka_topic", "name": topic, "topic": topic}
            elif not is_class and annotated(head, JAVA_ROUTES):
                n["kind"] = "http_endpoint"
        elif ext in ("kt", "kts"):
            if is_class and "@GrpcService" in head:
                n["kind"] = "grpc_service"
            elif not is_class and (topic := _topic_of(head)):
                n |= {"kind": "kafka_topic", "name": topic, "topic": topic}
            elif not is_class and annotated(head, KOTLIN_ROUTES):
                n["kind"] = "http_endpoint"
        elif ext == "cs":
            if not is_class and re.search(r"\[(?:Http(?:Get|Post|Put|Delete|Patch)|Route)\b", head):
                n["kind"] = "http_endpoint"
        elif ext == "go" and first.startswith("func"):
            receiver = re.match(r"func\s*\(\s*\w*\s*\*?(\w+)", first)
            if receiver and receiver[1] in served:
                n["kind"] = "grpc_method"
            elif re.fullmatch(r"Handle\w*|\w+Handler", name) and re.search(r"ResponseWriter|Request|Context|Ctx", first):
                n["kind"] = "http_endpoint"
        elif ext == "rs" and re.search(r"\bfn\b", first):
            around = [s for s in out.nodes if s["kind"] == "grpc_service" and s["line_start"] < n["line_start"] <= n["line_end"] <= s["line_end"]]
            if around:
                n["kind"] = "grpc_method"
        elif ext in ("rb", "rake") and not is_class:
            if own and own["name"].endswith("Controller") and name != "initialize" and not name.startswith("_"):
                n["kind"] = "http_endpoint"
        elif ext in ("php", "phtml") and re.search(r"\bfunction\b", first):
            route = re.search(r"#\[Route\(\s*(?:path:\s*)?['\"]([^'\"]+)['\"]", head)
            if route:
                n |= {"kind": "http_endpoint", "name": route[1]}
            elif own and own["name"].endswith("Controller") and name != "__construct":
                n["kind"] = "http_endpoint"
        elif ext == "swift" and re.search(r"\bfunc\b", first):
            if re.fullmatch(r"handle\w*|\w+Handler", name):
                n["kind"] = "http_endpoint"
        elif ext in ("cpp", "cc", "cxx", "hpp", "hh", "hxx", "h") and is_class:
            inner = body(n)
            pure, others = len(re.findall(r"=\s*0\s*;", inner)), len(re.findall(r"\)\s*(?:const)?\s*(?:override)?\s*(?:\{|;)", inner))
            if pure and not others:
                n["kind"] = "interface"
    if ext in ("cpp", "cc", "cxx", "hpp", "hh", "hxx", "h"):
        services = {n["name"] for n in out.nodes if n["kind"] == "grpc_service"}
        for m in re.finditer(r"^[\w:<>&*, \t]+?[\s*&](?:(\w+)::)?(~?\w+)\s*\([^;{}]*\)\s*(?:const|override|noexcept|\s)*\{", clean, re.M):
            name, start = m[2], clean.count("\n", 0, m.start(2)) + 1
            if name.startswith("~") or m[1] == name or name in ("if", "for", "while", "switch", "catch", "return"):
                continue
            kind = "grpc_method" if m[1] in services else "http_endpoint" if _HANDLER.fullmatch(name) else "service_class"
            out.node(name, kind, start, clean.count("\n", 0, _block_end(clean, m.end() - 1)) + 1, lines[start - 1].strip())
    if ext == "cs":
        for m in re.finditer(r"^\s*((?:\[[^\]\n]*\]\s*)*)(?:public|private|protected|internal|static|async|virtual|override|\s)+[\w<>\[\]?., ]+\s(\w+)\s*\([^;{}]*\)\s*(?:\{|=>)", clean, re.M):
            start = clean.count("\n", 0, m.start(2)) + 1
            if any(c["name"] == m[2] for c in classes) or m[2] in ("if", "for", "while", "switch", "catch", "foreach", "using", "lock"):
                continue
            route = re.search(r"\[(?:Http(?:Get|Post|Put|Delete|Patch)|Route)\b", _head(lines, start))
            out.node(m[2], "http_endpoint" if route else "service_class", start, clean.count("\n", 0, _block_end(clean, m.end() - 1)) + 1, lines[start - 1].strip())
    out.nodes = [n for n in out.nodes if not any(n is d for d in drop)]


def extract_text(path: str, language: str | None, text: str) -> tuple[Facts, bool]:
    """(facts, parse_failed) of one file."""
    out = Facts(package_of(path))
    try:
        if language == "python":
            _python(path, text, out)
        elif language == "protobuf":
            _protobuf(path, text, out)
        elif language in SCRIPTS:
            _script(path, text, out)
        elif language in RULES:
            _by_rules(path, text, out, RULES[language])
        return out, False
    except (SyntaxError, ValueError, RecursionError):
        return Facts(package_of(path)), True


def extract(files: DataFrame) -> DataFrame:
    """Fact rows of (path, repo_id, language, text); ``what`` is node, import, producer, consumer, rpc_call, rpc_record, export, module, file or failed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = [pa.field(name, _ARROW[kind]) for name, kind in map(str.split, FACTS.split(", "))]
        for b in batches:
            rows, of_file = [], {"path": [], "repo_id": [], "package": []}
            for path, repo, language, text in zip(*[b.column(c).to_pylist() for c in ("path", "repo_id", "language", "text")], strict=True):
                out, failed = extract_text(path, language, text or "")
                before = len(rows)
                rows += out.nodes
                rows += out.facts
                if language in SCRIPTS and not failed and _MAY_ROUTE.search(path):
                    rows.append({"what": "file"})
                if failed:
                    rows.append({"what": "failed"})
                for name, value in (("path", path), ("repo_id", repo), ("package", out.package)):
                    of_file[name] += [value] * (len(rows) - before)
            columns = [of_file[f.name] if f.name in of_file else [r.get(f.name) for r in rows] for f in fields]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, fields, strict=True)], schema=pa.schema(fields))

    return files.where("text is not null").select("path", "repo_id", "language", "text").mapInArrow(run, FACTS)


def tables(facts: DataFrame) -> dict[str, DataFrame]:
    """nodes and the four fact tables; ids follow (path, local) and do not depend on partitioning.

    Ids come from a 63-bit hash of (path, local): no global order is needed to assign them.  The facts are written
    once; each table would extract every file again.
    """
    facts = materialize(facts, "facts")
    node_id = F.xxhash64("path", "local").bitwiseAND(F.lit(0x7FFFFFFFFFFFFFFF))
    rows = facts.withColumn("node_id", node_id)
    nodes = rows.where("what = 'node'").select(F.col("node_id").alias("id"), "name", "kind", F.col("path").alias("file_path"), "line_start", "line_end", "package", "repo_id", "signature", "docstring")
    nodes = nodes.unionByName(placed_routes(rows))
    pick = lambda what: rows.where(F.col("what") == what)
    return {
        "nodes": nodes,
        "imports": pick("import").select("node_id", "target"),
        "producers": pick("producer").select("node_id", F.col("path").alias("file_path"), T.topic_key(F.col("target")).alias("topic"), "heuristic"),
        "rpc_records": pick("rpc_record").select("node_id", F.col("target").alias("record")),
        "consumers": pick("consumer").select("node_id", F.col("path").alias("file_path"), T.topic_key(F.col("target")).alias("topic"), "heuristic"),
        "rpc_calls": pick("rpc_call").select("node_id", "target"),
    }


def placed_routes(rows: DataFrame) -> DataFrame:
    """Endpoints that files declare by their place and exports (see ``functions.file_routes``)."""
    files = rows.where("what in ('export', 'module', 'file')").groupBy("path", "repo_id").agg(
        F.collect_set(F.when(F.col("what") == "export", F.col("target"))).alias("exports"), F.collect_set(F.when(F.col("what") == "module", F.col("target"))).alias("modules"), F.first("package").alias("package"),
    ).where(R.path_may_route(F.col("path")))
    page = R.sfc_route(F.col("path"))
    own = F.when(page.isNotNull(), F.array(F.struct(F.lit("PAGE").alias("method"), page.alias("path")))).otherwise(F.array().cast(f"array<{R.ROUTE}>"))
    found = F.concat(R.file_routes(F.col("path"), F.col("exports"), F.col("modules")), own)
    routes = files.select("path", "repo_id", "package", F.explode(found).alias("r")).withColumn("label", F.concat_ws(" ", "r.method", "r.path"))
    one, none = F.lit(1), F.lit(None).cast("string")
    node_id = F.xxhash64("path", "label").bitwiseAND(F.lit(0x7FFFFFFFFFFFFFFF))
    return routes.select(
        node_id.alias("id"), F.col("label").alias("name"), F.lit("http_endpoint").alias("kind"), F.col("path").alias("file_path"), one.alias("line_start"), one.alias("line_end"),
        "package", "repo_id", F.col("label").alias("signature"), none.alias("docstring"),
    )


def attribute(sites: DataFrame, nodes: DataFrame) -> DataFrame:
    """Call sites (file_path, line, site) joined to the smallest enclosing declaration: (site, id)."""
    met = sites.join(nodes, "file_path").where(F.col("line").between(F.col("line_start"), F.col("line_end")))
    w = Window.partitionBy("file_path", "site").orderBy(F.col("line_end") - F.col("line_start"), "id")
    return met.withColumn("r", F.row_number().over(w)).where("r = 1").select("file_path", "site", "id")


assert schema.NODES  # the node layout above follows it
