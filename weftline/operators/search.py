"""Ranked symbol, document and route search, and paging by a byte budget."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline import schema
from weftline.functions import text as T


def match_rank(name: Column, query: str) -> Column:
    """0 exact, 1 prefix, 2 substring (ASCII case does not count); null otherwise."""
    low, q = T.ascii_lower(name), F.lit(query.translate(str.maketrans(T._UPPER, T._LOWER)))
    return F.when(low == q, 0).when(F.startswith(low, q), 1).when(F.contains(low, q), 2)


def kind_rank(kind: Column) -> Column:
    return (
        F.when(kind.isin("grpc_service", "grpc_method"), 0).when(kind == "http_endpoint", 1).when(kind.isin(*schema.TOPIC_KINDS), 2)
        .when(kind.isin("interface", "proto_message"), 3).when(kind == "service_class", 4).otherwise(5)
    )


def search_symbols(nodes: DataFrame, query: str, scope: str | None = None) -> DataFrame:
    """Hits with match and kind ranks; modules are never a result."""
    rows = nodes.where(F.col("kind") != "module")
    if scope not in (None, ".", "*"):
        rows = rows.where(T.under(F.col("file_path"), F.lit(scope)))
    return rows.select("id", "name", "kind", "file_path", "line_start", match_rank(F.col("name"), query).alias("match"), kind_rank(F.col("kind")).alias("kind_rank")).where("match is not null")


def rank_files(hits: DataFrame) -> DataFrame:
    """The best symbol of every file: (match, kind, line, name)."""
    best = hits.groupBy("file_path").agg(F.min(F.struct("match", "kind_rank", "line_start", "name")).alias("best"))
    return best.select("file_path", "best.*")


def page_by_bytes(rows: DataFrame, order: Sequence[Column | str], size: Column, offset: int, limit: int, budget: int = schema.PAGE_BYTES) -> DataFrame:
    """``limit`` rows from ``offset``, cut where their sizes pass ``budget``; one row at least.

    The page is bounded by offset + limit, so ordering is a take-ordered and the running sum sees a page only.
    """
    page = rows.orderBy(*order).limit(offset + limit)
    w = Window.orderBy(*order)
    page = page.withColumn("position", F.row_number().over(w)).where(F.col("position") > offset)
    run = F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return page.withColumn("bytes", run).where((F.col("bytes") <= budget) | (F.col("position") == offset + 1))


def normalize_query(query: str, stop_words: Sequence[str] = (), aliases: Mapping[str, str] | None = None) -> str:
    """Lower-case words without stop words; each remaining word replaced by its alias."""
    stop = {w.lower() for w in stop_words}
    words = [w for w in query.lower().split() if w not in stop]
    return " ".join((aliases or {}).get(w, w) for w in words)


def doc_score(query: str, boost: int = 50) -> Column:
    title, content = F.lower("title"), F.lower("content")
    points = F.when(F.contains(title, F.lit(query)), boost).otherwise(0) + F.when(F.contains(content, F.lit(query)), 20).otherwise(0)
    for word in query.split():
        points = points + F.when(F.contains(title, F.lit(word)), 15).otherwise(0) + F.when(F.contains(content, F.lit(word)), 5).otherwise(0)
    return points


def fuzzy_score(query: str) -> Column:
    """Per word of three bytes or more: 8 if a title token is close, 3 if a content token is."""
    points = F.lit(0)
    for word in query.split():
        if len(word.encode()) < 3:
            continue
        most = 1 if len(word.encode()) <= 4 else 2
        close = lambda t, word=word, most=most: (t == word) | F.levenshtein(t, F.lit(word), most).between(0, most)
        for column, gain in (("title", 8), ("content", 3)):
            tokens = F.filter(F.split(F.lower(column), r"[^\p{L}\p{N}]+"), lambda t: t != "")
            points = points + F.when(F.exists(tokens, lambda t: close(t)), gain).otherwise(0)
    return points


def search_docs(sections: DataFrame, query: str, most: int = 3, fuzzy: bool = True, boost: int = 50, stop_words: Sequence[str] = (), aliases: Mapping[str, str] | None = None) -> DataFrame:
    """The best sections; the fuzzy pass runs only where no section scores."""
    query = normalize_query(query, stop_words, aliases)
    if not query:
        return sections.withColumn("score", F.lit(0)).limit(0)
    order = [F.desc("score"), "file_path", "start_line", "title"]
    found = sections.withColumn("score", doc_score(query, boost)).where("score > 0").orderBy(*order).limit(most)
    if fuzzy and found.isEmpty():
        found = sections.withColumn("score", fuzzy_score(query)).where("score > 0").orderBy(*order).limit(most)
    return found


EXACT, VALUE, LEADING, FRAGMENT = 0, 1, 2, 3


def _fits(route: Column, query: Column, loose: bool) -> Column:
    """Same length, and each query segment fits its route segment."""
    one = lambda r, q: (r == q) | ((r == ":") if loose else F.lit(False))
    return (F.size(route) == F.size(query)) & F.forall(F.zip_with(route, query, lambda r, q: F.coalesce(one(r, q), F.lit(False))), lambda x: x)


def route_rank(route: Column, query: Sequence[str], prefix: Sequence[str] = ()) -> Column:
    """0 exact, 1 a value in a parameter's place, 2 leading segments, 3 a fragment; null if none.  The route is
    tried as declared, with the prefix, and without it."""
    q = F.array(*[F.lit(x) for x in query]) if query else F.expr("CAST(array() AS array<string>)")
    n = len(query)
    variants = [route]
    if prefix:
        pre = F.array(*[F.lit(x) for x in prefix])
        variants.append(F.concat(pre, route))
        variants.append(F.when(_fits(F.slice(route, 1, len(prefix)), pre, False), F.slice(route, F.lit(len(prefix) + 1), F.size(route))))
    each = lambda f: F.coalesce(*[F.when(f(v), True) for v in variants], F.lit(False))
    leading = each(lambda v: _fits(F.slice(v, 1, n), q, False)) if n else F.lit(False)
    inside = each(lambda v: (F.size(v) >= n) & F.exists(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(v) - n + 1)), lambda i: _fits(F.slice(v, i, F.lit(n)), q, False))) if n else F.lit(False)
    return F.when(each(lambda v: _fits(v, q, False)), EXACT).when(each(lambda v: _fits(v, q, True)), VALUE).when(leading, LEADING).when(inside, FRAGMENT)


def find_routes(routes: DataFrame, query: str, prefix: str | None = None, include_tests: bool = False) -> DataFrame:
    """Routes (id, verb, path, file_path, line_start) that match ``VERB /path`` or ``/path``, best first."""
    verb, path = _parse(query)
    rows = routes.withColumn("segs", T.path_segments(F.col("path")))
    if verb:
        rows = rows.where(F.col("verb") == verb)
    if not include_tests:
        rows = rows.where(~T.is_test_path(F.col("file_path")))
    return rows.withColumn("rank", route_rank(F.col("segs"), _segments(path), _segments(prefix or ""))).where("rank is not null")


def nearest_routes(routes: DataFrame, query: str, most: int = 5) -> DataFrame:
    """Routes of the same verb with the longest shared leading segments."""
    verb, path = _parse(query)
    wanted = _segments(path)
    rows = routes.where(F.col("verb") == verb) if verb else routes
    segs = T.path_segments(F.col("path"))
    shared = F.lit(0)
    for n in range(len(wanted), 0, -1):
        q = F.array(*[F.lit(x) for x in wanted[:n]])
        shared = F.when((shared == 0) & _fits(F.slice(segs, 1, n), q, True), F.lit(n)).otherwise(shared)
    return rows.withColumn("shared", shared).where("shared > 0").orderBy(F.desc("shared"), "path", "file_path", "id").limit(most)


def _parse(query: str) -> tuple[str | None, str]:
    head, _, rest = query.strip().partition(" ")
    return (head.upper(), rest.strip()) if rest and head.upper() in T.HTTP_VERBS else (None, query.strip())


def _segments(path: str) -> list[str]:
    import re

    parts = [p.strip() for p in re.split(r"[?#]", path)[0].split("/")]
    is_param = re.compile(r"\*\w*|:\w+(\(.*\))?[?*+]?|\$\w+|\$?\{[^{}]+\}|<[^<>]+>|\[[^\[\]]+\]").fullmatch
    return [":" if is_param(p) else p.lower() for p in parts if p]
