"""Markdown answers of bounded results.  Callers hand over pages (a few dozen rows), never whole tables."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import groupby

from weftline.functions import labels as L

MATRIX_ROWS, ROUTE_ENTRIES, EDGE_LINES = 200, 25, 12


def code(s: object) -> str:
    """Inline code that nothing inside can end."""
    text = str(s).encode()[: L.NAME_BYTES].decode(errors="ignore")
    text += "…" if len(str(s).encode()) > L.NAME_BYTES else ""
    return "`" + text.replace("`", "'").replace("\n", " ").replace("\r", " ") + "`"


def truncate(text: str, budget: int = L.OUTPUT_BYTES) -> str:
    """A text of at most ``budget`` bytes, cut at a line's end; a fence that was cut open is closed."""
    if len(text.encode()) <= budget:
        return text
    note = "\n\n_(truncated)_\n"
    lines, size, out, fence = text.split("\n"), len(note) + 8, [], False
    for line in lines:
        size += len(line.encode()) + 1
        if size > budget:
            break
        out.append(line)
        fence ^= line.lstrip().startswith("```")
    return "\n".join(out) + ("\n```" if fence else "") + note


def search_page(query: str, scope: str | None, rows: Sequence[dict], offset: int, total: int) -> str:
    """Hits with place and label; says where the next page starts."""
    head = f"# Search: {code(query)}" + (f" in {code(scope)}" if scope else "")
    if not rows:
        return f"{head}\n\nNo match.\n"
    out = [head, "", f"{offset + 1}-{offset + len(rows)} of {total}", ""]
    for r in rows:
        label = f" ({r['label']})" if r.get("label") else ""
        out.append(f"- {code(r['name'])}{label}: {code(r['file_path'])}:{r['line_start']}")
        if r.get("snippet"):
            fence = "`" * max(3, _longest_run(r["snippet"]) + 1)
            out += [f"  {fence}", *("  " + x for x in r["snippet"].split("\n")), f"  {fence}"]
    if offset + len(rows) < total:
        out += ["", f"Next page: offset {offset + len(rows)}."]
    return "\n".join(out) + "\n"


def _longest_run(s: str) -> int:
    best = run = 0
    for c in s:
        run = run + 1 if c == "`" else 0
        best = max(best, run)
    return best


def dependents(target: str, how: str, rows: Sequence[dict], roots: Sequence[str]) -> str:
    """Dependents by root and package, with representatives.  rows: repo_id, package, files, symbols, places."""
    out = [f"# Dependents of {code(target)}", "", f"Matched by {how}." if rows else "None found."]
    for repo, group in groupby(sorted(rows, key=lambda r: r["repo_id"]), key=lambda r: r["repo_id"]):
        name = roots[repo] if 0 <= repo < len(roots) else "other"
        out += ["", f"## {name}", ""]
        for r in sorted(group, key=lambda r: (-r["files"], -r["symbols"], r["package"])):
            out.append(f"- **{r['package']}**: {r['files']} file(s), {r['symbols']} declaration(s)")
            out += [f"  - {code(p)}" for p in r.get("places", [])]
    return "\n".join(out) + "\n"


def grpc_trace(target: str, rows: Sequence[dict]) -> str:
    """Definition, handlers, clients, possible callers, related RPCs.  rows: role, name, file_path, line_start, confidence."""
    titles = {"definition": "Definition", "handler": "Handlers", "client": "Clients", "may_call": "May call", "related": "Related"}
    out = [f"# RPC {code(target)}"]
    for role, title in titles.items():
        own = sorted((r for r in rows if r["role"] == role), key=lambda r: (r["file_path"], r["line_start"], r["name"]))
        if own or role in ("definition", "handler", "client"):
            out += ["", f"## {title} ({len(own)})", ""]
            out += [f"- {code(r['name'])} {code(r['file_path'])}:{r['line_start']} ({r['confidence']})" for r in own] or ["None found."]
    return "\n".join(out) + "\n"


def impact_matrix(target: str, rows: Sequence[dict], offset: int, limit: int, total: int, budget: int = 8192) -> str:
    """A page of the matrix as a table: whole rows within the budget, one at least."""
    head = [f"# Impact of {code(target)}", "", f"{total} row(s)", "", "| scope | role | element | place | confidence | via |", "|---|---|---|---|---|---|"]
    out, size = [], sum(len(x.encode()) + 1 for x in head)
    for r in rows[:limit]:
        line = f"| {r['scope']} | {r['role']} | {code(r['name'])} | {code(r['file_path'])}:{r['line_start']} | {r['confidence']} | {code(r['via']) if r['via'] else '-'} |".replace("\n", " ")
        size += len(line.encode()) + 1
        if out and size > budget:
            break
        out.append(line)
    more = ["", f"Next page: offset {offset + len(out)}."] if offset + len(out) < total else []
    return "\n".join(head + out + more) + "\n"


def route_impact(target: str, rows: Sequence[dict], near: Sequence[dict] = (), hidden_tests: int = 0) -> str:
    """Handlers of a route with their edges, else the nearest routes.  rows: id, route, file_path, line_start, edges."""
    out = [f"# Route {code(target)}", ""]
    for r in rows[:ROUTE_ENTRIES]:
        out.append(f"- {code(r['route'])} {code(r['file_path'])}:{r['line_start']}")
        out += [f"  - {e}" for e in r["edges"][:EDGE_LINES]]
        if len(r["edges"]) > EDGE_LINES:
            out.append(f"  - and {len(r['edges']) - EDGE_LINES} more")
    if len(rows) > ROUTE_ENTRIES:
        out.append(f"- and {len(rows) - ROUTE_ENTRIES} more route(s)")
    if not rows:
        out += ["No handler declares it.", *(["", "Nearest:"] if near else []), *(f"- {code(n['route'])} {code(n['file_path'])}" for n in near)]
    if hidden_tests:
        out += ["", f"{hidden_tests} route(s) in tests are not shown."]
    return "\n".join(out) + "\n"


def doc_sections(query: str, rows: Sequence[dict]) -> str:
    out = [f"# Documentation: {code(query)}"]
    for r in rows:
        out += ["", f"## {r['title']}", "", f"{code(r['file_path'])}:{r['start_line']}", "", r["content"]]
    return "\n".join(out if rows else [*out, "", "No match."]) + "\n"


def narrowing(counts: Sequence[tuple[str, int]], total: int, most: int = 5) -> str:
    """What a search that is cut off says: its busiest folders."""
    top = sorted(counts, key=lambda c: (-c[1], c[0]))[:most]
    return "\n".join([f"{total} hits are too many to show. Busiest folders:", *(f"- {code(d)}: {n}" for d, n in top)]) + "\n"


def topology_footer(shown: int, groups: int, links: int, omitted: int, hidden: Sequence[tuple[str, int]] = ()) -> str:
    """Totals under a topology: groups shown, ambiguous links left out, the largest groups that are hidden."""
    out = [f"{shown} of {groups} groups, {links} links."]
    if omitted:
        out.append(f"{omitted} ambiguous link(s) left out.")
    if hidden:
        out.append("Hidden: " + ", ".join(f"{code(n)} ({d})" for n, d in hidden[:5]) + (f" and {len(hidden) - 5} more" if len(hidden) > 5 else "") + ".")
        out.append(f"Ask with focus {code(hidden[0][0])} to look inside.")
    return "\n".join(out) + "\n"
