"""The questions a user may ask, by name, and a command line over published snapshots.

Every tool takes a snapshot, its derived edges and arguments, and returns text of a bounded page; the tables it
asks stay in Spark.
"""

from __future__ import annotations

import argparse
import subprocess
import sys
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from enum import Enum
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import labels as L
from weftline.functions import text as T
from weftline.operators import audit, calls, graph, health, resolve, roots, search, topology, wire
from weftline.sinks import pages, payload, stores
from weftline.sources import markdown, outline, projects, proto, yaml_files


class Granularity(Enum):
    SYMBOL, FILE, PACKAGE = "symbol", "file", "package"


@dataclass
class World:
    """What tools look at."""

    snapshot: graph.Snapshot
    edges: DataFrame
    sections: DataFrame | None = None
    files: DataFrame | None = None  # file_path, language, text
    rejected: DataFrame | None = None
    roots: Sequence[str] = ()
    prefixes: dict[str, str] = field(default_factory=dict)
    rules: dict[str, str] = field(default_factory=dict)
    skills: dict[str, str] = field(default_factory=dict)


class Tool(Protocol):
    name: str
    arguments: dict[str, type]

    def run(self, world: World, **args) -> str: ...


REGISTRY: dict[str, Tool] = {}


def tool(name: str, **arguments: type) -> Callable:
    """Registers a function as a tool of that name and those arguments."""

    def add(function: Callable) -> Callable:
        class _Tool:
            run = staticmethod(function)

        _Tool.name, _Tool.arguments = name, arguments
        if name in REGISTRY:
            raise ValueError(f"tool {name} is registered twice")
        REGISTRY[name] = _Tool()
        return function

    return add


def call(world: World, name: str, **args) -> str:
    """Runs a tool: arguments are checked, a stop rule on the subject answers instead, output is cut to its cap."""
    if name not in REGISTRY:
        raise KeyError(f"no tool {name}; there are {', '.join(sorted(REGISTRY))}")
    unknown = set(args) - set(REGISTRY[name].arguments)
    if unknown:
        raise TypeError(f"{name} takes no {', '.join(sorted(unknown))}")
    subject = str(args.get("scope") or args.get("target") or args.get("query") or "")
    spark = world.snapshot.nodes.sparkSession
    told = spark.range(1).select(L.stop_rule(F.lit(subject), world.rules).alias("rule"), L.recommend_skill(F.lit(name), F.lit(subject), world.skills).alias("skill")).first()
    if told["rule"]:
        return f"> [!CAUTION]\n> {told['rule']}\n"
    text = REGISTRY[name].run(world, **args)
    return pages.truncate((f"> Playbook: {pages.code(told['skill'])}\n\n" if told["skill"] else "") + text)


@tool("search", query=str, scope=str, offset=int, limit=int, bodies=bool)
def _search(world: World, query: str, scope: str | None = None, offset: int = 0, limit: int = 10, bodies: bool = False) -> str:
    nodes = world.snapshot.nodes
    hits = search.search_symbols(nodes, query, scope)
    best = search.rank_files(hits)
    size = (F.octet_length("file_path") + F.octet_length("name")).cast("long")
    page = search.page_by_bytes(best, ["match", "kind_rank", "file_path"], size, offset, limit)
    rows = [r.asDict() for r in page.orderBy("position").collect()]
    if not rows and world.files is not None:
        return _full_text(world, query, scope, offset, limit)
    labels = {(r["file_path"], r["name"]): r["label"] for r in nodes.join(page.select("file_path", "name"), ["file_path", "name"], "left_semi").select("file_path", "name", L.declaration_label(F.col("kind"), F.col("signature")).alias("label")).collect()}
    shown = {}
    if world.files is not None and rows:
        anchors = page.select("file_path", F.col("line_start").alias("anchor"))
        shown = {r["file_path"]: r["snippet"] for r in outline.snippets(anchors, world.files, query, bodies).collect()}
    for r in rows:
        r |= {"label": labels.get((r["file_path"], r["name"])), "snippet": shown.get(r["file_path"])}
    note = health.scope_note(world.rejected) if world.rejected is not None else None
    return pages.search_page(query, scope, rows, offset, best.count()) + (note or "")


def fuzzy_page(files: DataFrame, query: str, scope: str | None, offset: int, limit: int) -> tuple[DataFrame, bool]:
    """(files that mention a text, whether there are more): one row beyond the page is asked for, so the scan may stop early."""
    rows = files.where(T.contains_ignore_ascii_case(F.col("text"), F.lit(query)))
    if scope not in (None, ".", "*"):
        rows = rows.where(T.under(F.col("file_path"), F.lit(scope)))
    top = rows.select("file_path").orderBy("file_path").limit(offset + limit + 1)
    more = top.count() > offset + limit
    return top.orderBy("file_path").offset(offset).limit(limit), more


def _full_text(world: World, query: str, scope: str | None, offset: int, limit: int) -> str:
    page, more = fuzzy_page(world.files, query, scope, offset, limit)
    found = outline.snippets(page.withColumn("anchor", F.lit(None).cast("int")), world.files, query).orderBy("file_path").collect()
    rows = [{"name": r["file_path"].rsplit("/", 1)[-1], "file_path": r["file_path"], "line_start": r["line"], "snippet": r["snippet"]} for r in found]
    return pages.search_page(query, scope, rows, offset, offset + len(rows) + more)


@tool("dependents", target=str, granularity=str)
def _dependents(world: World, target: str, granularity: str = "package") -> str:
    s = world.snapshot
    found = resolve.dependents(s.imports, s.nodes, world.edges, target)
    how = {1: "import", 2: "package", 3: "calls and implementations", 4: "mention"}.get((found.agg(F.min("tier")).first() or [None])[0], "nothing")
    if Granularity(granularity) is Granularity.FILE:
        rows = found.join(s.nodes, "id").groupBy("repo_id", "file_path").agg(F.count(F.lit(1)).alias("n")).orderBy("repo_id", "file_path").limit(200).collect()
        return "\n".join([f"# Dependents of {pages.code(target)}", "", f"Matched by {how}.", *(f"- {pages.code(r['file_path'])} ({r['n']})" for r in rows)]) + "\n"
    if Granularity(granularity) is Granularity.SYMBOL:
        rows = found.join(s.nodes, "id").orderBy("file_path", "line_start", "name").limit(200).collect()
        return "\n".join([f"# Dependents of {pages.code(target)}", "", f"Matched by {how}.", *(f"- {pages.code(r['name'])} {pages.code(r['file_path'])}:{r['line_start']}" for r in rows)]) + "\n"
    groups = resolve.dependents_by_package(found, s.nodes).orderBy(F.desc("files"), F.desc("symbols"), "repo_id", "package").limit(50)
    places: dict[tuple, list[str]] = {}
    for r in resolve.representatives(found, s.nodes, world.edges).join(groups, ["repo_id", "package"], "left_semi").orderBy("rank").collect():
        places.setdefault((r["repo_id"], r["package"]), []).append(f"{r['file_path']}:{r['line_start']}")
    rows = [r.asDict() | {"places": places.get((r["repo_id"], r["package"]), [])} for r in groups.collect()]
    return pages.dependents(target, how, rows, world.roots)


@tool("trace", target=str)
def _trace(world: World, target: str) -> str:
    s = world.snapshot
    if s.rpc_records is None:
        rows = graph.grpc_trace(s, world.edges, target)
    else:
        rows = calls.trace(s.nodes, world.edges, s.rpc_records, target).join(s.nodes.select("id", "name", "file_path", "line_start"), "id")
    return pages.grpc_trace(target, [r.asDict() for r in rows.orderBy("role", "file_path", "line_start").limit(300).collect()])


@tool("impact", target=str, depth=int, offset=int, limit=int)
def _impact(world: World, target: str, depth: int = 1, offset: int = 0, limit: int = 50) -> str:
    s = world.snapshot
    verb = target.split(" ", 1)[0].upper()
    if verb in ("GET", "POST", "PUT", "PATCH", "DELETE", "HEAD", "OPTIONS") and "/" in target:
        return _route(world, target)
    rows = graph.ordered_matrix(graph.impact_matrix(s, world.edges, target, depth), s.nodes)
    page = rows.offset(offset).limit(limit)
    return pages.impact_matrix(target, [r.asDict() for r in page.collect()], offset, limit, rows.count())


def _route(world: World, target: str) -> str:
    s = world.snapshot
    prefix = next(iter(world.prefixes.values()), "")
    found = graph.route_impact(s.nodes, world.edges, target, prefix)
    names = s.nodes.select(F.col("id").alias("other_id"), F.col("name").alias("other"), F.col("file_path").alias("other_file"))
    table = graph.routes_of(s.nodes).select("id", F.concat_ws(" ", "verb", "path").alias("route"), "file_path", "line_start")
    rows: dict[int, dict] = {}
    for r in found.join(table, "id").join(names, "other_id", "left").orderBy("rank", "file_path", "line_start", "id", "arrow", "kind").collect():
        row = rows.setdefault(r["id"], {"id": r["id"], "route": r["route"], "file_path": r["file_path"], "line_start": r["line_start"], "edges": []})
        if r["arrow"]:
            row["edges"].append(f"{r['arrow']} {r['kind']} {pages.code(r['other'] or r['other_id'])} ({r['confidence']})")
    near = [] if rows else [{"route": f"{r['verb']} {r['path']}", "file_path": r["file_path"]} for r in search.nearest_routes(graph.routes_of(s.nodes), target, 8).collect()]
    return pages.route_impact(target, list(rows.values()), near)


@tool("docs", query=str, limit=int)
def _docs(world: World, query: str, limit: int = 5) -> str:
    if world.sections is None:
        return pages.doc_sections(query, [])
    return pages.doc_sections(query, [r.asDict() for r in search.search_docs(world.sections, query, limit).collect()])


@tool("topology", most=int)
def _topology(world: World, most: int = 8) -> str:
    groups = world.snapshot.nodes.select("id", F.coalesce(F.col("repo_id").cast("string"), F.lit("shared")).alias("grp"))
    links, degrees, omitted = topology.build(world.edges, groups)
    shown = topology.select(links, degrees, most)
    order = degrees.orderBy(F.desc("degree"), F.desc("contracts"), "grp")
    hidden = [(r["grp"], r["degree"]) for r in order.offset(most).limit(6).collect()]
    footer = pages.topology_footer(min(most, degrees.count()), degrees.count(), links.count(), omitted.first()[0], hidden)
    return "```mermaid\n" + topology.mermaid(shown) + "\n```\n\n" + footer


# ---- schema checks against a revision


class Git:
    """The few reads of a repository that a check needs; a stand-in may replace it in tests."""

    def __init__(self, folder: str):
        self.folder = folder

    def run(self, *args: str) -> str | None:
        done = subprocess.run(["git", "-C", self.folder, *args], capture_output=True, text=True, timeout=30, check=False)
        return done.stdout if done.returncode == 0 else None

    def base(self, asked: str | None) -> str | None:
        """The asked revision, else where the work branched off the main line, else the last commit."""
        if asked is not None:
            found = self.run("rev-parse", "--verify", "--quiet", f"{asked}^{{commit}}")
            return found.strip() if found else None
        for main in ("origin/HEAD", "origin/main", "origin/master", "main", "master"):
            if found := self.run("merge-base", "HEAD", main):
                head = (self.run("rev-parse", "HEAD") or "").strip()
                if found.strip() != head:
                    return found.strip()
        found = self.run("rev-parse", "--verify", "--quiet", "HEAD")
        return found.strip() if found else None

    def show(self, revision: str, path: str) -> str | None:
        return self.run("show", f"{revision}:{path}")


def check_wire(spark: SparkSession, git: Git, path: str, text: str, base: str | None = None) -> DataFrame:
    """Rules that a schema file breaks against a revision: (message, number, rule, ...)."""
    if base is not None and (why := spark.range(1).select(L.base_error(F.lit(base))).first()[0]):
        raise ValueError(f"base {base!r}: {why}")
    revision = git.base(base)
    if revision is None:
        raise ValueError("there is no such revision")
    old = git.show(revision, path)
    if old is None:
        raise ValueError(f"{path} is not in {revision}")
    before, after = proto.parse(old), proto.parse(text)
    return wire.diff_texts(spark, before, after)


# ---- command line


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    """stats, graph, doctor, fingerprint over tables; tools over a published snapshot."""
    p = argparse.ArgumentParser(prog="weftline")
    sub = p.add_subparsers(dest="command", required=True)
    stats = sub.add_parser("stats", help="audit statistics")
    stats.add_argument("trail")
    stats.add_argument("--since", default="all")
    for name in ("graph", "fingerprint"):
        sub.add_parser(name).add_argument("store")
    doctor = sub.add_parser("doctor", help="configuration and audit checks")
    doctor.add_argument("--config")
    doctor.add_argument("--trail")
    ask = sub.add_parser("ask", help="a tool over a snapshot")
    ask.add_argument("store")
    ask.add_argument("tool", choices=sorted(REGISTRY))
    ask.add_argument("subject")
    a = p.parse_args(argv)
    spark = spark or SparkSession.builder.appName("weftline").getOrCreate()
    if a.command == "stats":
        trail = spark.read.parquet(a.trail)
        rows = audit.since(trail, a.since, F.unix_timestamp().cast("double"))
        for r in audit.tool_stats(rows).orderBy(F.desc("calls"), "tool").collect():
            print(f"{r['tool']}\t{r['calls']}\t{r['errors']}\t{r['p50']}\t{r['p95']}")
        return 0
    if a.command == "doctor":
        config = projects.load_config(projects.locate_config(a.config))
        checks = projects.health_checks(config, roots.expand_roots(config.get("workspace", {}).get("roots", [])))
        if a.trail:
            broken = audit.verify_chain(spark.read.parquet(a.trail)).orderBy("entry_seq").limit(1).collect()
            checks.append(("audit chain", not broken, f"entry {broken[0]['entry_seq']}: {broken[0]['reason']}" if broken else ""))
        for name, good, detail in checks:
            print(f"{'ok  ' if good else 'FAIL'} {name} {detail}".rstrip())
        return 0 if all(c[1] for c in checks) else 1
    world = load_world(spark, a.store)
    if a.command == "graph":
        print(payload.payload(world.snapshot.nodes, world.edges, "workspace", list(world.roots)))
    elif a.command == "fingerprint":
        print(audit.fingerprint(graph.canonical_lines(world.snapshot, world.edges)).first()[0])
    else:
        key = "query" if "query" in REGISTRY[a.tool].arguments else "target" if "target" in REGISTRY[a.tool].arguments else "most"
        print(call(world, a.tool, **{key: a.subject if key != "most" else int(a.subject)}))
    return 0


TABLES = ("nodes", "imports", "producers", "consumers", "rpc_calls", "rpc_records", "edges")


def load_world(spark: SparkSession, store: str) -> World:
    t = stores.read_snapshot(spark, store, list(TABLES))
    return World(graph.Snapshot(**{k: t[k] for k in TABLES[:-1]}), t["edges"])


def build_snapshot(files: DataFrame, store: str) -> int:
    """Crawled files (path, repo_id, language, text) to a published generation: extraction, edges, all tables."""
    from weftline.plans.store import materialize
    from weftline.sources import extract

    facts = materialize(extract.extract(files), "facts")
    tables = {k: v for k, v in extract.tables(facts).items() if k in TABLES}
    specs = materialize(yaml_files.yaml_contracts(files.where("language = 'yaml'")).where("not failed"), "contracts")
    specs = specs.withColumn("id", F.xxhash64("file_path", "local", "name").bitwiseAND(F.lit(0x7FFFFFFFFFFFFFFF)))
    none = F.lit(None).cast("string")
    tables["nodes"] = tables["nodes"].unionByName(specs.select("id", "name", "kind", "file_path", "line_start", "line_end", "package", "repo_id", "signature", none.alias("docstring")))
    declared = specs.where("topic is not null").select(F.col("id").alias("node_id"), "file_path", T.topic_key(F.col("topic")).alias("topic"), F.lit(False).alias("heuristic"))
    tables["producers"] = tables["producers"].unionByName(declared)
    edges = graph.derive_edges(graph.Snapshot(**tables))
    docs = files.where("language = 'markdown'").select(F.col("path").alias("file_path"), "text")
    return stores.install_snapshot(tables | {"edges": edges, "sections": markdown.markdown_sections(docs)}, store)


if __name__ == "__main__":
    sys.exit(main())
