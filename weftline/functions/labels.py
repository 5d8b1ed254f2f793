"""Labels, names, keys and budgets as Column -> Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from weftline.functions import text as T

#: Limits (fixed values): bytes of a name, of an output, of what a page keeps free.
NAME_BYTES, OUTPUT_BYTES, PAGE_RESERVE, PAGE_OVERHEAD = 120, 48 * 1024, 1536, 384
BUDGET_FLOOR = 64 * 1024
#: Words that may stand before a declaration's keyword (fixed values).
MODIFIERS = (
    "export", "default", "declare", "pub", "public", "private", "protected", "internal", "static", "async", "final", "sealed", "unsafe", "extern",
    "open", "data", "case", "partial", "readonly", "abstract", "override", "companion", "inline", "suspend", "value",
)
#: Labels of kinds that say what a node declares (fixed values).
KIND_LABELS = {
    "grpc_service": "gRPC service", "grpc_method": "gRPC method", "http_endpoint": "HTTP endpoint", "kafka_topic": "Kafka topic", "event_stream": "event stream",
    "queue": "queue", "proto_message": "proto message", "post_processor": "post-processor", "saga": "saga", "module": "module",
}
#: Labels by the keyword of a declaration (fixed values).
KEYWORD_LABELS = {
    "class": "class", "object": "object", "function": "function", "func": "function", "def": "function", "fn": "function", "fun": "function", "sub": "function",
    "const": "const", "val": "const", "let": "variable", "var": "variable", "enum": "enum", "typedef": "type alias", "interface": "interface", "trait": "interface",
    "protocol": "interface", "struct": "struct", "record": "struct", "namespace": "namespace", "module": "namespace", "package": "namespace",
}


def section_budget(length: Column) -> Column:
    return F.greatest(length * 3, F.lit(BUDGET_FLOOR))


def yaml_output_budget(length: Column) -> Column:
    return F.greatest(length * 8, F.lit(BUDGET_FLOOR))


def alias_budget(length: Column) -> Column:
    return F.greatest(length, F.lit(BUDGET_FLOOR))


def search_page_entry_budget(query: Column, scope: Column) -> Column:
    used = PAGE_OVERHEAD + F.octet_length(query) + F.coalesce(F.octet_length(scope), F.lit(0))
    return F.greatest(F.lit(OUTPUT_BYTES - PAGE_RESERVE) - used, F.lit(0))


def cut_bytes(s: Column, most: int) -> Column:
    """The longest start of a text of at most ``most`` bytes of UTF-8."""
    # a text over the limit has a cut among its first ``most`` characters: the last position whose bytes fit
    wide = F.transform(F.split(F.substring(s, 1, most), ""), lambda c: F.octet_length(c))
    start = F.struct(F.lit(0).alias("b"), F.lit(0).alias("n"))
    fits = lambda acc, w: (acc["b"] + w <= most) & (acc["b"] >= 0)
    step = lambda acc, w: F.struct(F.when(fits(acc, w), acc["b"] + w).otherwise(F.lit(-1)).alias("b"), F.when(fits(acc, w), acc["n"] + F.when(w > 0, 1).otherwise(0)).otherwise(acc["n"]).alias("n"))
    return F.when(F.octet_length(s) <= most, s).otherwise(F.substring(s, F.lit(1), F.aggregate(wide, start, step, lambda acc: acc["n"])))


def display_name(s: Column) -> Column:
    """A name of at most 120 bytes, marked where it is cut."""
    return F.when(F.octet_length(s) <= NAME_BYTES, s).otherwise(F.concat(cut_bytes(s, NAME_BYTES), F.lit("…")))


def inline_code_text(s: Column) -> Column:
    """A name inside inline code: no backtick ends it, no line end breaks it."""
    return F.regexp_replace(F.replace(display_name(s), F.lit("`"), F.lit("'")), "[\\n\\r]", " ")


def mermaid_text(s: Column) -> Column:
    """A text inside a quoted Mermaid label, by entity codes."""
    out = F.replace(s, F.lit("#"), F.lit("\x01"))
    for mark, code in (('"', "#quot;"), ("<", "#lt;"), (">", "#gt;"), ("`", "#96;"), ("\x01", "#35;")):
        out = F.replace(out, F.lit(mark), F.lit(code))
    return F.regexp_replace(out, "[\\n\\r]", " ")


_ARGS = r"\((?:[^()]|\((?:[^()]|\([^()]*\))*\))*(?:\)|$)"


def skip_decorators(signature: Column) -> Column:
    """A signature without its leading decorators and attributes (arguments nested up to three deep)."""
    one = rf"(?:#\[(?:[^\[\]]|\[[^\[\]]*\])*(?:\]|$)|@[\p{{L}}\p{{N}}_.:]*(?:{_ARGS})?)"
    return F.ltrim(F.regexp_replace(F.regexp_replace(signature, r"^\s+", ""), rf"^(?:{one}\s*)+", ""))


def declaration_tokens(signature: Column) -> Column:
    """The words of a signature from its keyword on, without trailing punctuation."""
    words = F.filter(F.split(skip_decorators(F.coalesce(signature, F.lit(""))), r"\s+"), lambda x: x != "")
    bare = lambda w: F.coalesce(F.nullif(F.regexp_replace(w, r"[^\p{L}\p{N}=]+$", ""), F.lit("")), w)
    lead = lambda w: F.startswith(w, F.lit("pub(")) | bare(w).isin(*MODIFIERS)
    step = lambda acc, w: F.when((F.size(acc) == 0) & lead(w), acc).otherwise(F.concat(acc, F.array(bare(w))))
    return F.aggregate(words, F.array().cast("array<string>"), step)


def declaration_label(kind: Column, signature: Column) -> Column:
    """What a node declares, in words; null for a shape that is not known."""
    words = declaration_tokens(signature)
    keyword, second, third = F.get(words, F.lit(0)), F.get(words, F.lit(1)), F.get(words, F.lit(2))
    type_label = F.when(third == "struct", "struct").when(third == "interface", "interface").when(third == "=", "type alias").otherwise("type")
    of_kind = F.create_map(*[F.lit(x) for kv in KIND_LABELS.items() for x in kv])[kind]
    of_word = F.create_map(*[F.lit(x) for kv in KEYWORD_LABELS.items() for x in kv])[keyword]
    own = F.when(keyword == "type", type_label).when((keyword == "fun") & (second == "interface"), "interface").otherwise(of_word)
    return F.when(kind == "interface", F.when(keyword == "type", type_label).otherwise("interface")).when(kind == "service_class", own).otherwise(of_kind)


def fqcn_equals(package: Column, name: Column, target: Column) -> Column:
    return (F.concat(package, F.lit("."), name) == target) | (F.concat(package, F.lit("/"), name) == target)


def fqcn_contains(package: Column, name: Column, part: Column) -> Column:
    """Whether ``package/name`` holds a text, whatever the case of its ASCII letters."""
    return T.contains_ignore_ascii_case(F.concat(package, F.lit("/"), name), part)


def parse_handler_ref(ref: Column) -> Column:
    """(service, method, inferred) of ``service|method`` or ``service|method|~``; null for another shape."""
    parts = F.split(ref, r"\|")
    good = F.size(parts).isin(2, 3) & (F.get(parts, F.lit(0)) != "") & (F.get(parts, F.lit(1)) != "") & ((F.size(parts) == 2) | F.get(parts, F.lit(2)).isin("", "~"))
    return F.when(good, F.struct(parts[0].alias("service"), parts[1].alias("method"), (F.get(parts, F.lit(2)).eqNullSafe("~")).alias("inferred")))


def trace_id(traceparent: Column) -> Column:
    """Trace id of a W3C traceparent; null for another shape."""
    parts = F.split(traceparent, "-")
    found = F.get(parts, F.lit(1))
    return F.when((F.size(parts) >= 4) & found.rlike("^[0-9a-f]{32}$") & (found != "0" * 32), found)


def workspace_id(folder: Column, version: Column) -> Column:
    return F.substring(F.sha2(F.concat(folder, version), 256), 1, 16)


def cache_key(version: Column, path: Column, content_hash: Column, repo: Column, config: Column) -> Column:
    """Key of a cached extraction; a length before each part keeps them apart."""
    parts = [F.coalesce(c.cast("string"), F.lit("")) for c in (version, path, content_hash, repo, config)]
    return F.sha2(F.concat(*[F.concat(F.length(c).cast("string"), F.lit(":"), c) for c in parts]), 256)


def iso_millis(seconds: Column) -> Column:
    """``1970-01-01T00:00:00.000Z`` of epoch seconds, rounded to milliseconds."""
    return F.date_format(F.timestamp_millis(F.round(seconds * 1000).cast("long")), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def normal_timestamp(ts: Column) -> Column:
    """Either stored form as ISO-8601 with milliseconds; what is neither stays as it is."""
    return F.coalesce(iso_millis(T.epoch_seconds(ts)), ts)


def type_label(value_type: Column, cardinality: Column, map_key: Column) -> Column:
    """Display type of a message field."""
    return F.when(cardinality == "map", F.concat(F.lit("map<"), map_key, F.lit(", "), value_type, F.lit(">"))).when(cardinality == "repeated", F.concat(F.lit("repeated "), value_type)).otherwise(value_type)


def heading_level(line: Column) -> Column:
    """1 to 6 for a heading line, else null."""
    marks = F.length(F.regexp_extract(line, r"^\s*(#{1,6}) ", 1))
    return F.when(marks > 0, marks)


def is_not_a_secret(key: Column, value: Column) -> Column:
    """Values a secret-looking key commonly has that are none: its own name, a variable's name, a reference, a truth value."""
    env = F.contains(value, F.lit("_")) & value.rlike("^[A-Z][A-Z0-9_]*$")
    own = (value != "") & (T.fold_rpc(value) == T.fold_rpc(key))
    return own | env | F.startswith(value, F.lit("${")) | F.startswith(value, F.lit("{{")) | value.isin("true", "false", "null", "~")


def longest_key(subject: Column, keys: dict[str, str]) -> Column:
    """Value of the longest key that a text holds, whatever its case; of equally long ones the first by code point."""
    hits = F.array(*[F.when(F.contains(F.lower(subject), F.lit(k.lower())), F.struct(F.lit(-len(k)).alias("n"), F.lit(k).alias("k"), F.lit(v).alias("v"))) for k, v in keys.items()])
    return F.array_min(hits)["v"] if keys else F.lit(None).cast("string")


def recommend_skill(tool: Column, subject: Column, skills: dict[str, str]) -> Column:
    """Playbook for a call: that of the tool, else that of the longest key inside the subject."""
    exact = F.lit(None).cast("string")
    for k, v in skills.items():
        exact = F.when(tool == k, F.lit(v)).otherwise(exact)
    return F.coalesce(exact, longest_key(subject, skills))


def stop_rule(target: Column, rules: dict[str, str]) -> Column:
    """Rule of the first key (by code point) that is whole path segments of a target, whatever the case."""
    low = F.concat(F.lit("/"), F.replace(F.lower(target), F.lit("\\"), F.lit("/")), F.lit("/"))
    hits = [F.when(F.contains(low, F.lit("/" + k.lower().strip("/") + "/")), F.lit(v)) for k, v in sorted(rules.items())]
    return F.coalesce(*hits) if hits else F.lit(None).cast("string")


def base_error(base: Column) -> Column:
    """Why a text is no revision to compare with; null for a good one."""
    return (
        F.when(base == "", "empty").when(F.octet_length(base) > 256, "longer than 256 bytes").when(F.startswith(base, F.lit("-")), "must not start with '-'")
        .when(F.contains(base, F.lit(":")), "must not contain ':'").when(base.rlike(r"[\s\p{Cc}]"), "must not contain whitespace or control characters")
    )


def allows_proto_path(path: Column, parts: list[str]) -> Column:
    """Whether a proto file is in scope: no scope, or one of its parts in the path."""
    if not parts:
        return F.lit(True)
    out = F.lit(False)
    for p in parts:
        out = out | F.contains(path, F.lit(p))
    return out


#: Files without meaning for an index: lock files, and extensions of assets, archives and build products (fixed values).
LOCK_FILES = (
    "yarn.lock", "package-lock.json", "pnpm-lock.yaml", "npm-shrinkwrap.json", "bun.lockb", "Cargo.lock", "poetry.lock", "Pipfile.lock", "uv.lock",
    "Gemfile.lock", "composer.lock", "go.sum", "gradle.lockfile", "Podfile.lock",
)
ASSETS = (
    "png", "jpg", "jpeg", "gif", "webp", "ico", "bmp", "tif", "tiff", "icns", "heic", "ttf", "otf", "woff", "woff2", "eot", "zip", "gz", "tgz", "bz2", "xz",
    "7z", "tar", "jar", "war", "aar", "apk", "ipa", "mp3", "mp4", "mov", "wav", "ogg", "webm", "pdf", "doc", "docx", "docm", "xls", "xlsx", "xlsm", "ppt",
    "pptx", "pptm", "odt", "ods", "odp", "epub", "pages", "numbers", "rar", "dmg", "iso", "so", "dylib", "dll", "exe", "wasm", "class", "pyc", "o", "a", "lockb", "map",
)
#: Extensions whose files an index is rebuilt for, and those it can hold declarations of (fixed values).
RELEVANT = (
    "rs", "go", "java", "ts", "tsx", "mts", "cts", "js", "vue", "svelte", "astro", "jsx", "mjs", "cjs", "py", "kt", "kts", "cs", "rb", "rake", "php", "phtml",
    "swift", "scala", "sc", "proto", "yaml", "yml", "properties", "md",
)
INDEXABLE = (
    "proto", "java", "go", "py", "ts", "mts", "cts", "tsx", "js", "jsx", "mjs", "cjs", "rs", "kt", "kts", "cs", "rb", "rake", "php", "phtml", "swift", "scala", "sc",
    "cpp", "cc", "cxx", "hpp", "hh", "hxx", "h",
)


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def is_non_source(path: Column) -> Column:
    name = file_name(path)
    return name.isin(*LOCK_FILES) | name.rlike(r"\.min\.(?:js|css)$") | F.lower(T.extension(path)).isin(*ASSETS)


def is_indexable_source(path: Column) -> Column:
    return path.rlike(r"\.(?:" + "|".join(INDEXABLE) + ")$") | F.lower(T.extension(path)).isin("yaml", "yml")


def is_relevant_path(path: Column) -> Column:
    """Whether a change of a file asks for a new index."""
    name = file_name(path)
    git = path.rlike(r"(?:^|/)\.git/")
    config = (name.rlike(r"^(?:ts|js)config.*\.json$")) | (name == "package.json")
    quiet = path.rlike(r"(?:^|/)(?:target|node_modules)(?:/|$)") | name.rlike(r"~$|\.swp$")
    return ~quiet & F.when(git, path.rlike(r"^(?:[^/]*/)*?\.git/(?:HEAD|refs)(?:/|$)")).otherwise(config | T.extension(path).isin(*RELEVANT))
