"""Routes that a file's place declares: path algebra over Columns, no file is read."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names a module exports to answer a method (fixed values).
VERBS = ("GET", "POST", "PUT", "PATCH", "DELETE", "HEAD", "OPTIONS")
SCRIPTS = ("ts", "tsx", "js", "jsx", "mjs", "cjs", "mts", "cts")
#: Helpers whose call makes a default export a request handler (fixed values).
HANDLERS = (
    "defineEventHandler", "eventHandler", "defineNuxtRouteHandler", "defineCachedEventHandler", "defineWebSocketHandler", "defineLazyEventHandler", "cachedEventHandler",
)
#: Last words of names that stand for an app or a router (fixed values).
ROUTER_WORDS = ("app", "router", "routers", "route", "routes", "server", "fastify", "hono", "elysia", "koa")
ROUTE = "struct<method:string,path:string>"


def join(prefix: Column, path: Column) -> Column:
    """A prefix and a path with single slashes between them and none at the end."""
    a, b = F.regexp_replace(prefix, "/+$", ""), F.regexp_replace(path, "^/+", "")
    out = F.when((a == "") & (b == ""), "").when((a == "") & F.startswith(b, F.lit("*")), b).when(a == "", F.concat(F.lit("/"), b)).when(b == "", a).otherwise(F.concat(a, F.lit("/"), b))
    out = F.when(out.rlike("^[/*]"), out).otherwise(F.concat(F.lit("/"), out))
    return F.when(F.length(out) > 1, F.regexp_replace(out, "/+$", "")).otherwise(out)


def path_may_route(path: Column) -> Column:
    return path.rlike(r"(?:^|/)\+[^/]*$|(?:^|/)(?:app|pages|routes|api)(?:/|$)")


def dynamic_segment(seg: Column) -> Column:
    """``[id]`` -> ``:id``, ``[...rest]`` -> ``*rest``, ``[[x]]`` optional; null for ``(group)`` and ``@slot``."""
    name = lambda pattern: F.regexp_extract(seg, pattern, 1)
    return (
        F.when(seg.rlike(r"^\(.*\)$|^@"), F.lit(None).cast("string"))
        .when(seg.rlike(r"^\[\[\.\.\..*\]\]$"), F.concat(F.lit("*"), name(r"^\[\[(?:\.\.\.)+([^=]*).*\]\]$"), F.lit("?")))
        .when(seg.rlike(r"^\[\[.*\]\]$"), F.concat(F.lit(":"), name(r"^\[\[([^=]*?)(?:=.*)?\]\]$"), F.lit("?")))
        .when(seg.rlike(r"^\[\.\.\..*\]$"), F.concat(F.lit("*"), name(r"^\[\.\.\.([^=]*?)(?:=.*)?\]$")))
        .when(seg.rlike(r"^\[.*\]$"), F.concat(F.lit(":"), name(r"^\[([^=]*?)(?:=.*)?\]$")))
        .otherwise(seg)
    )


def route_of(parts: Column) -> Column:
    """Route of an array of folder names: groups and slots vanish, intercepting marks climb."""

    def step(kept: Column, raw: Column) -> Column:
        ups = F.regexp_extract(raw, r"^((?:\(\.\.\))+)", 1)
        left = F.when(F.startswith(raw, F.lit("(...)")), F.array().cast("array<string>")).otherwise(F.slice(kept, F.lit(1), F.greatest(F.size(kept) - (F.length(ups) / 4).cast("int"), F.lit(0))))
        seg = dynamic_segment(F.regexp_replace(raw, r"^(?:\(\.\.\.\)|(?:\(\.\.\))+|\(\.\))", ""))
        return F.when(F.coalesce(seg, F.lit("")) == "", left).otherwise(F.concat(left, F.array(seg)))

    return F.concat(F.lit("/"), F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/"))


def remix_route(stem: Column) -> Column:
    """Route of a flat-route file name: ``users.$id.edit`` -> ``/users/:id/edit``."""

    def one(raw: Column) -> Column:
        part = F.replace(F.regexp_replace(raw, "_+$", ""), F.lit("\x01"), F.lit("."))
        inner = F.regexp_extract(part, r"^\((.*)\)$", 1)
        return (
            F.when(part.isin("", "_index", "index") | F.startswith(part, F.lit("_")), F.lit(""))
            .when(part == "$", F.lit("/*")).when(F.startswith(part, F.lit("$")), F.concat(F.lit("/:"), F.substring(part, 2, 1 << 20)))
            .when(part.rlike(r"^\(\$.*\)$"), F.concat(F.lit("/:"), F.substring(inner, 2, 1 << 20), F.lit("?")))
            .when(part.rlike(r"^\(.*\)$"), F.concat(F.lit("/"), inner, F.lit("?"))).otherwise(F.concat(F.lit("/"), part))
        )

    parts = F.split(F.replace(stem, F.lit("[.]"), F.lit("\x01")), r"\.")
    out = F.array_join(F.transform(parts, one), "")
    return F.when(out == "", "/").otherwise(out)


def _after(path: Column, marker: str) -> Column:
    """Folders below the first ``marker`` (a folder, or two nested ones); null where the path has none."""
    found = rf"^(?:.*?/)?{marker}/((?:[^/]+/)*)[^/]*$"
    return F.when(path.rlike(found), F.filter(F.split(F.regexp_extract(path, found, 1), "/"), lambda x: x != ""))


def _leaf(parts: Column, stem: Column) -> Column:
    return F.when(stem == "index", parts).otherwise(F.concat(parts, F.array(stem)))


def _stem(path: Column) -> tuple[Column, Column]:
    name = F.element_at(F.split(path, "/"), -1)
    return F.regexp_replace(name, r"\.[^.]*$", ""), F.regexp_extract(name, r"\.([^.]*)$", 1)


def sfc_route(path: Column) -> Column:
    """Route of a component page by its place: SvelteKit pages and Astro pages."""
    stem, ext = _stem(path)
    kit, astro = _after(path, "src/routes"), _after(path, "src/pages")
    hidden = F.exists(astro, lambda d: F.startswith(d, F.lit("_"))) | F.startswith(stem, F.lit("_"))
    return (
        F.when((ext == "svelte") & ((stem == "+page") | F.startswith(stem, F.lit("+page@"))) & kit.isNotNull(), route_of(kit))
        .when((ext == "astro") & astro.isNotNull() & ~hidden, route_of(_leaf(astro, stem)))
    )


def references(imports: Column, *libraries: str) -> Column:
    """Whether one of the imported modules is a library or lies below it."""
    wanted = lambda m: F.coalesce(*[F.when((m == lib.rstrip("/")) | F.startswith(m, F.lit(lib.rstrip("/") + "/")), True) for lib in libraries], F.lit(False))
    return F.exists(imports, wanted)


def bound(body: Callable[[Column], Column], **values: Column) -> Column:
    """``body`` of a struct of values, each worked out once a row; a Column used twice is written out (and worked out) twice."""
    return F.get(F.transform(F.array(F.struct(*[v.alias(n) for n, v in values.items()])), body), F.lit(0))


def _facts(methods: Column, route: Column) -> Column:
    return F.transform(methods, lambda m: F.struct(m.alias("method"), route.alias("path")))


def file_routes(path: Column, exports: Column, imports: Column) -> Column:
    """array<struct<method, path>> that a script's place and exports declare; the first framework that fits decides.

    exports: names a module exports (``default`` for a default export, ``default@callee`` where that is a
    call); imports: modules it names.
    """

    def places(b: Column) -> Column:
        stem, ext = _stem(b["path"])
        folders = {"kit": "src/routes", "app": "app", "pages": "pages", "site": "src/pages", "api": "server/api", "routes": "server/routes", "remix": "app/routes"}
        verbs = F.filter(F.array(*[F.lit(v) for v in VERBS]), lambda v: F.array_contains(b["exports"], v))
        return bound(lambda p: _flat(p, b["exports"], b["imports"]), stem=stem, ext=ext, verbs=verbs, **{n: _after(b["path"], f) for n, f in folders.items()})

    return bound(places, path=path, exports=exports, imports=imports)


def _flat(p: Column, exports: Column, imports: Column) -> Column:
    """``_routes`` with the route of a flat-route file."""
    remix, stem = p["remix"], p["stem"]
    layout = lambda s: F.regexp_extract(s, r"([^.]*)$", 1).rlike("^_") & (F.regexp_extract(s, r"([^.]*)$", 1) != "_index")
    folder = F.get(remix, F.lit(0))
    flat = F.when((F.size(remix) == 0) & ~layout(stem), remix_route(stem)).when((F.size(remix) == 1) & stem.isin("route", "index") & ~layout(folder), remix_route(folder))
    return bound(lambda f: _routes(p, f["flat"], exports, imports), flat=flat)


def _routes(p: Column, flat: Column, exports: Column, imports: Column) -> Column:
    stem, ext, verbs = p["stem"], p["ext"], p["verbs"]
    has = lambda name: F.array_contains(exports, name)
    none = F.array().cast(f"array<{ROUTE}>")
    one = lambda method, route: F.array(F.struct(F.lit(method).alias("method") if isinstance(method, str) else method.alias("method"), route.alias("path")))
    kit, app, pages, api, routes, remix = [p[n] for n in ("kit", "app", "pages", "api", "routes", "remix")]

    svelte = F.when(stem == "+server", _facts(verbs, route_of(kit))).when(stem.isin("+page", "+page.server") & has("actions"), one("POST", route_of(kit))).otherwise(none)
    shown = app.isNotNull() & ~F.exists(app, lambda d: F.startswith(d, F.lit("_")))
    next_route, next_page = shown & (stem == "route") & (F.size(verbs) > 0), shown & (stem == "page") & has("default") & references(imports, "next")

    callee = lambda x: F.regexp_extract(x, r"^default@(?:.*\.)?([^.]+)$", 1)
    handles = has("default") & F.exists(exports, lambda x: callee(x).isin(*HANDLERS))
    pinned = stem.rlike(r"(?i).\.(?:" + "|".join(VERBS) + ")$")
    name = F.when(pinned, F.regexp_replace(stem, r"\.[^.]*$", "")).otherwise(stem)
    method = F.when(pinned, F.upper(F.regexp_extract(stem, r"\.([^.]*)$", 1))).otherwise(F.lit("ALL"))
    nitro = lambda parts: one(method, route_of(_leaf(parts, name)))

    remix_facts = F.concat(
        F.when(has("loader"), one("GET", flat)).otherwise(none), F.when(has("action"), one("POST", flat)).otherwise(none), F.when(has("default"), one("PAGE", flat)).otherwise(none),
    )
    is_remix = remix.isNotNull() & references(imports, "@remix-run/", "react-router", "@react-router/") & flat.isNotNull() & (F.size(remix_facts) > 0)

    astro_parts = F.coalesce(p["site"], pages)
    is_astro = pages.isNotNull() & (F.size(verbs) > 0) & references(imports, "astro")
    is_pages = pages.isNotNull() & has("default") & references(imports, "next") & ~F.startswith(stem, F.lit("_")) & (stem != "middleware")
    pages_method = F.when(F.get(pages, F.lit(0)) == "api", "ALL").otherwise("PAGE")
    return (
        F.when(~ext.isin(*SCRIPTS), none).when(F.startswith(stem, F.lit("+")) & kit.isNotNull(), svelte)
        .when(next_route, _facts(verbs, route_of(app))).when(next_page, one("PAGE", route_of(app)))
        .when(api.isNotNull() & handles, nitro(F.concat(F.array(F.lit("api")), api))).when(routes.isNotNull() & handles, nitro(routes))
        .when(is_remix, remix_facts).when(is_astro, _facts(verbs, route_of(_leaf(astro_parts, stem))))
        .when(is_pages, one(pages_method, route_of(_leaf(pages, stem)))).otherwise(none)
    )


def looks_like_router(name: Column) -> Column:
    """Whether the last word of a name stands for an app or a router."""
    words = F.split(F.lower(F.regexp_replace(F.regexp_replace(name, "([^A-Z_$-])([A-Z])", "$1_$2"), "[_$-]+$", "")), "[_$-]+")
    return F.element_at(words, -1).isin(*ROUTER_WORDS)


def methods_of(names: Column) -> Column:
    """Known methods among names, upper case; ``*`` means all."""
    upper = F.transform(names, lambda x: F.when(x == "*", "ALL").otherwise(F.upper(x)))
    return F.array_distinct(F.filter(upper, lambda x: x.isin(*VERBS, "ALL")))


def module_in(module: Column, libraries: list[str]) -> Column:
    """Whether a module is one of some libraries or lies below it."""
    return references(F.array(module), *libraries)
