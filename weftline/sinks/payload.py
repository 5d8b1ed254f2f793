"""A graph as JSON, Mermaid and a standalone page.  JSON is written by Spark; drawings take a bounded part only."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions import labels as L

MOST_NODES, MOST_EDGES = 2000, 5000


def graph_rows(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes in order of path, line, name, id with their label, and edges in order of their ends and kind."""
    shown = nodes.select("id", "name", "kind", "file_path", "line_start", "line_end", "package", "repo_id", L.declaration_label(F.col("kind"), F.col("signature")).alias("label"))
    return shown.orderBy("file_path", "line_start", "name", "id"), edges.select("from_id", "to_id", "kind", "metadata", "confidence").orderBy("from_id", "to_id", "kind", "metadata")


def write_payload(nodes: DataFrame, edges: DataFrame, folder: str) -> None:
    """``folder/nodes`` and ``folder/edges`` as JSON lines, each sorted; no size limit."""
    n, e = graph_rows(nodes, edges)
    n.write.json(f"{folder}/nodes")
    e.write.json(f"{folder}/edges")


def payload(nodes: DataFrame, edges: DataFrame, workspace: str, repos: list[str], most_nodes: int = MOST_NODES, most_edges: int = MOST_EDGES) -> str:
    """One JSON document of the first nodes in order and the edges among them, with the totals."""
    n, e = graph_rows(nodes, edges)
    top = n.limit(most_nodes)
    ids = top.select("id")
    inner = e.join(ids.withColumnRenamed("id", "from_id"), "from_id", "left_semi").join(ids.withColumnRenamed("id", "to_id"), "to_id", "left_semi")
    rows = [r.asDict() for r in top.collect()]
    links = [r.asDict() for r in inner.orderBy("from_id", "to_id", "kind", "metadata").limit(most_edges).collect()]
    data = {"workspace": workspace, "repos": repos, "total_nodes": nodes.count(), "total_edges": edges.count(), "nodes": rows, "edges": links}
    return json.dumps(data, ensure_ascii=False, separators=(",", ":"))


def mermaid(nodes: DataFrame, edges: DataFrame, repos: list[str], most: int = 200) -> str:
    """The nodes that have edges, by repository, and at most ``most`` edges."""
    some = edges.orderBy("from_id", "to_id", "kind").limit(most)
    ids = some.select(F.col("from_id").alias("id")).union(some.select(F.col("to_id").alias("id"))).distinct()
    shown = nodes.join(ids, "id").select("id", "repo_id", "file_path", "line_start", L.mermaid_text(L.display_name(F.col("name"))).alias("text")).orderBy("repo_id", "file_path", "line_start", "id").collect()
    at = {r["id"]: f"n{k}" for k, r in enumerate(shown)}
    out = ["graph LR"]
    for repo in dict.fromkeys(r["repo_id"] for r in shown):
        name = repos[repo] if repo is not None and 0 <= repo < len(repos) else "shared"
        out.append(f'  subgraph r{repo}["{_plain(name)}"]')
        out += [f'    {at[r["id"]]}["{r["text"]}"]' for r in shown if r["repo_id"] == repo]
        out.append("  end")
    style = {"exact": "-->", "heuristic": "-.->", "ambiguous": "-.->"}
    for r in some.orderBy("from_id", "to_id", "kind").collect():
        if r["from_id"] in at and r["to_id"] in at:
            out.append(f"  {at[r['from_id']]} {style[r['confidence']]}|{r['kind']}| {at[r['to_id']]}")
    return "\n".join(out)


def _plain(s: str) -> str:
    for mark, code in (("#", "#35;"), ('"', "#quot;"), ("<", "#lt;"), (">", "#gt;"), ("`", "#96;"), ("\n", " ")):
        s = s.replace(mark, code)
    return s


PAGE = """<!doctype html><html><head><meta charset="utf-8"><title>{title}</title><style>body{{font:14px system-ui;margin:2em}}table{{border-collapse:collapse}}td,th{{padding:.2em .8em;border-bottom:1px solid #ddd;text-align:left}}</style></head>
<body><h1>{title}</h1><input id="q" placeholder="filter"><p id="n"></p><table><thead><tr><th>name</th><th>kind</th><th>file</th><th>edges</th></tr></thead><tbody id="t"></tbody></table>
<script type="application/json" id="data">{data}</script><script>
const d=JSON.parse(document.getElementById('data').textContent),by={{}};
d.edges.forEach(e=>{{(by[e.from_id]??=[]).push('→ '+e.kind);(by[e.to_id]??=[]).push('← '+e.kind)}});
const t=document.getElementById('t'),q=document.getElementById('q');
function show(){{const s=q.value.toLowerCase();t.replaceChildren(...d.nodes.filter(n=>n.name.toLowerCase().includes(s)).slice(0,500).map(n=>{{const r=document.createElement('tr');
[n.name,n.label??n.kind,n.file_path+':'+n.line_start,(by[n.id]??[]).join(', ')].forEach(x=>{{const c=document.createElement('td');c.textContent=x;r.append(c)}});return r}}));
document.getElementById('n').textContent=d.total_nodes+' nodes, '+d.total_edges+' edges'}}
q.oninput=show;show();</script></body></html>"""


def html(document: str, title: str = "graph") -> str:
    """A page that holds a payload and shows it; nothing of the payload can end the script it stands in."""
    safe = document.replace("<", "\\u003c").replace(">", "\\u003e").replace("&", "\\u0026")
    return PAGE.format(title=title.replace("&", "&amp;").replace("<", "&lt;"), data=safe)
