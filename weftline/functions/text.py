"""Scalar functions as Column -> Column; nothing here leaves the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Substrings that mark a key as secret (fixed values).
SECRET_PARTS = (
    "password", "secret", "token", "credential", "passphrase", "private", "jwt", "cert",
    "apikey", "api_key", "api-key", "secret_key", "access_key", "signing_key", "auth_token",
)
#: What makes a key named ``key`` secret, and words that mark authorisation (fixed values).
KEY_PARTS = ("secret", "priv", "sign", "encrypt", "access", "token", "api", "cert")
AUTH_WORDS = ("auth", "authorization", "authn")
#: Directories that hold only tests, and dotted parts of test file names (fixed values).
TEST_DIRS = (
    "test", "tests", "__tests__", "__mocks__", "__fixtures__", "spec", "specs", "e2e", "test-utils", "test_utils", "testutils",
    "testing", "fixtures", "__test-utils__", "__test_utils__", "__testutils__", "__specs__", "__e2e__", "__testing__",
)
TEST_SUFFIXES = ("spec", "test", "e2e-spec", "e2e", "int-test", "it")
HTTP_VERBS = ("GET", "POST", "PUT", "PATCH", "DELETE", "HEAD", "OPTIONS")
#: Phrases that try to give instructions to a reader of documentation (fixed values).
INJECTION_PHRASES = (
    "<|im_start|>", "<|im_end|>", "<|system|>", "<|assistant|>", "<|user|>", "<system>", "</system>", "[system]", "[assistant]",
    "ignore previous instructions", "ignore all previous instructions", "disregard prior guidelines",
    "bypass safety checks", "output system prompt", "override authorization",
)
FILTERED = "[FILTERED_ADVERSARIAL_INPUT]"


def ascii_lower(s: Column) -> Column:
    """Lower-cases A-Z only."""
    return F.translate(s, _UPPER, _LOWER)


def ascii_upper(s: Column) -> Column:
    return F.translate(s, _LOWER, _UPPER)


def contains_ignore_ascii_case(text: Column, part: Column) -> Column:
    return F.contains(ascii_lower(text), ascii_lower(part))


def pascal_case(s: Column) -> Column:
    """Splits on ``_ - . /`` and space, capitalises each part's start, keeps the rest as it is."""
    parts = F.filter(F.split(s, "[_\\-./ ]"), lambda x: x != "")
    return F.array_join(F.transform(parts, lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.substring(x, 2, 1 << 30))), "")


def topic_key(raw: Column) -> Column:
    """Registry key of a topic: quotes and ``typeof`` removed, ``Enum.MEMBER`` reduced to the member, lower case."""
    bare = F.regexp_replace(F.trim(F.regexp_replace(F.trim(raw), "^['\"`]+|['\"`]+$", "")), r"^typeof +", "")
    member = bare.rlike(r"^[A-Z][A-Za-z0-9_$]*(\.[A-Za-z_$][A-Za-z0-9_$]*)*\.[A-Z0-9_]+$") & F.element_at(F.split(bare, r"\."), -1).rlike("^[A-Z_][A-Z0-9_]*$") & F.element_at(F.split(bare, r"\."), -1).rlike("[A-Z]")
    return F.lower(F.when(member, F.element_at(F.split(bare, r"\."), -1)).otherwise(bare))


def fold_rpc(s: Column) -> Column:
    return ascii_lower(F.regexp_replace(s, "[^A-Za-z0-9]", ""))


def bare_name(s: Column) -> Column:
    return F.element_at(F.split(s, r"\."), -1)


def folded_bare(s: Column) -> Column:
    return ascii_lower(F.translate(bare_name(s), "_", ""))


def bare_names_match(a: Column, b: Column) -> Column:
    return (folded_bare(a) == folded_bare(b)) & (folded_bare(a) != "")


def service_of_field(field: Column) -> Column:
    """``userClient`` / ``userService`` -> ``UserService``; null for anything else."""
    stem = F.regexp_extract(field, "^([a-z].*)(?:Client|Service)$", 1)
    return F.when(stem != "", F.concat(ascii_upper(F.substring(stem, 1, 1)), F.substring(stem, 2, 1 << 30), F.lit("Service")))


def package_part(s: Column) -> Column:
    """Package of a qualified name (split at the last ``::`` or ``.``), with ``::`` turned into ``.``; null if bare."""
    head = F.regexp_extract(s, r"^(.+?)(?:::|\.)([^.:]+)$", 1)
    return F.when(head != "", F.regexp_replace(head, "::", "."))


def name_part(s: Column) -> Column:
    tail = F.regexp_extract(s, r"^(.+?)(?:::|\.)([^.:]+)$", 2)
    return F.when(tail != "", tail)


#: What a module's file name may end in, and what makes a file a script or a component (fixed values).
MODULE_EXTENSIONS = (".d.ts", ".d.mts", ".d.cts", ".tsx", ".ts", ".mts", ".cts", ".jsx", ".js", ".mjs", ".cjs", ".json", ".vue", ".svelte", ".astro")
SCRIPT_EXTENSIONS = ("ts", "tsx", "mts", "cts", "js", "jsx", "mjs", "cjs", "vue", "svelte", "astro")
COMPONENT_EXTENSIONS = ("vue", "svelte", "astro")


def module_key(path: Column) -> Column:
    """Path without a module extension (a name that consists of one keeps it)."""
    ends = "|".join(re.escape(x) for x in MODULE_EXTENSIONS)
    return F.regexp_replace(path, rf"(?<=[^/])(?:{ends})$", "")


def clean_path(path: Column) -> Column:
    """Path without empty, ``.`` and ``..`` parts."""
    step = lambda kept, x: F.when(x.isin("", "."), kept).when(x == "..", F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(0)))).otherwise(F.concat(kept, F.array(x)))
    parts = F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step)
    return F.concat(F.when(F.startswith(path, F.lit("/")), "/").otherwise(""), F.array_join(parts, "/"))


def module_keys_of_import(directory: Column, target: Column) -> Column:
    """Keys of the files a relative import may name: the file, its ``index``, or the folder's file of its own name."""
    key = module_key(clean_path(F.concat(directory, F.lit("/"), target)))
    return F.array(key, F.concat(key, F.lit("/index")), F.concat(key, F.lit("/"), F.element_at(F.split(key, "/"), -1)))


def extension(path: Column) -> Column:
    return F.regexp_extract(path, r"[^/]\.([^./]+)$", 1)


_SPECIFIED = ("js", "jsx", "ts", "tsx", "mjs", "cjs", "mts", "cts", "json")


def fit_of_specifier(specifier: Column) -> Column:
    """What a specifier's extension asks of a file: a component's extension only such files, a script's never one."""
    named = extension(specifier)
    return F.when(named.isin(*COMPONENT_EXTENSIONS), named).when(named.isin(*_SPECIFIED), F.lit("script")).otherwise(F.lit("any"))


def fits_of_file(path: Column) -> Column:
    own = extension(path)
    return F.array(F.when(own.isin(*COMPONENT_EXTENSIONS), own).otherwise(F.lit("script")), F.lit("any"))


def split_words(s: Column) -> Column:
    """Lower-case words of a camelCase or separated key."""
    cut = F.regexp_replace(F.regexp_replace(s, "([a-z0-9])([A-Z])", "$1 $2"), "([A-Z]+)([A-Z][a-z])", "$1 $2")
    return F.filter(F.split(F.lower(cut), r"[._\- ]+"), lambda x: x != "")


def is_sensitive_key(key: Column) -> Column:
    low = F.lower(key)
    named_key = low.rlike(r"(?:^|[._-])key$") & low.rlike("|".join(KEY_PARTS))
    return low.rlike("|".join(SECRET_PARTS)) | named_key | F.arrays_overlap(split_words(key), F.array(*[F.lit(w) for w in AUTH_WORDS]))


def split_verb(s: Column) -> Column:
    """Upper-case HTTP verb in front of a route label; null if none."""
    verb = F.upper(F.regexp_extract(F.ltrim(s), r"(?i)^(" + "|".join(HTTP_VERBS) + r")\s+.+$", 1))
    return F.when(verb != "", verb)


def is_param(seg: Column) -> Column:
    ident = "[A-Za-z_][A-Za-z0-9_]*"
    return seg.rlike(rf"^(?:\*(?:{ident})?|:[\p{{L}}\p{{N}}_]+(?:\([^()]*(?:\([^()]*\)[^()]*)*\))?[?*+]?|\$(?:{ident}|\{{[^{{}}]+\}})|\{{[^{{}}]+\}}|<[^<>]+>|\[[^\[\]]+\])$")


def path_segments(path: Column) -> Column:
    """Segments of a path: ``:`` for a parameter, lower case otherwise; query, fragment and empty parts dropped."""
    parts = F.filter(F.transform(F.split(F.regexp_replace(path, r"[?#].*$", ""), "/"), lambda x: F.trim(x)), lambda x: x != "")
    return F.transform(parts, lambda x: F.when(is_param(x), F.lit(":")).otherwise(F.lower(x)))


def sanitize_injections(text: Column) -> Column:
    """Masks phrases that address the reader; at one place the shorter phrase wins."""
    quoted = [re.escape(p) for p in sorted(INJECTION_PHRASES, key=len)]
    return F.regexp_replace(text, "(?i)(?:" + "|".join(quoted) + ")", FILTERED)


def longest_backtick_run(text: Column) -> Column:
    runs = F.regexp_extract_all(text, F.lit("`+"), F.lit(0))
    return F.coalesce(F.array_max(F.transform(runs, lambda x: F.length(x))), F.lit(0))


def percent(n: Column, d: Column) -> Column:
    return F.when(d == 0, F.lit("n/a")).otherwise(F.concat(F.format_string("%.1f", 100.0 * n / d), F.lit("%")))


def epoch_seconds(ts: Column) -> Column:
    """Seconds of an ISO-8601 or ``secs.msZ`` timestamp text."""
    iso = F.unix_micros(F.to_timestamp(ts)) / 1e6
    return F.when(ts.rlike(r"^\d+\.\d+Z$"), F.regexp_extract(ts, r"^(\d+\.\d+)Z$", 1).cast("double")).when(ts.rlike(r"^\d{4}-"), iso)


def is_test_path(path: Column) -> Column:
    """A test directory on the way (any ASCII case), or a test-like file name."""
    dirs = "|".join(TEST_DIRS)
    name = F.element_at(F.split(path, "/"), -1)
    parts = F.split(name, r"\.")
    stem = F.element_at(parts, 1)
    dotted = F.arrays_overlap(F.slice(parts, 2, F.size(parts)), F.array(*[F.lit(x) for x in TEST_SUFFIXES]))
    cased = stem.rlike(r"^\p{Lu}.*(?:Test|Tests|IT)$") & (F.octet_length(stem) > 4)
    return path.rlike(rf"(?i)(?:^|/)(?:{dirs})(?:/|$)") | dotted | stem.rlike("_(?:test|spec)$|^test_") | cased


#: Directories of generated code, and marks in the names of generated files (fixed values).
GENERATED_DIRS = ("__generated__", "generated", "gen", "codegen", "proto-gen")
GENERATED_MARKS = (".generated.", ".gen.", ".pb.", "_pb.", "_pb2", "_grpc.")


def is_generated_path(path: Column) -> Column:
    """Code a generator wrote (ranks behind hand-written code)."""
    marks = "|".join(re.escape(x) for x in GENERATED_MARKS)
    return path.rlike(rf"(?i)(?:^|/)(?:{'|'.join(GENERATED_DIRS)})(?:/|$)") | path.rlike(rf"\.d\.ts$|(?:{marks})[^/]*$")


def under(path: Column, scope: Column) -> Column:
    """Component-wise prefix: the scope itself or something below it."""
    return (path == scope) | F.startswith(path, F.concat(scope, F.lit("/")))


def declared_as(text: Column) -> Column:
    return F.when(F.char_length(text) > 120, F.concat(F.substring(text, 1, 120), F.lit("..."))).otherwise(text)


def collapse_home(text: Column) -> Column:
    return F.regexp_replace(text, r"(?:/Users/|/home/|C:\\Users\\)[^/\\\s]+", "~")


def terminal_safe(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"\x1b\[[0-9;?]*[ -/]*[@-~]", ""), r"[\x00-\x1f\x7f]", " ")


def secret_blob(run: Column) -> Column:
    """32 letters and digits or more; with other signs it must mix digits, upper and lower case."""
    upper, lower = run.rlike("[A-Z]"), run.rlike("[a-z]")
    plain = run.rlike("^[A-Za-z0-9]+$")
    return (F.length(run) >= 32) & run.rlike("[0-9]") & F.when(plain, upper | lower).otherwise(upper & lower)


def is_subject_pattern(key: Column) -> Column:
    """Wildcard subjects: ``*`` and a final ``>`` between dots, or ``+`` and a final ``#`` between slashes."""
    return F.when(F.contains(key, F.lit("/")), key.rlike(r"(?:^|/)\+(?:/|$)|/#$")).otherwise(key.rlike(r"(?:^|\.)\*(?:\.|$)|(?:^|\.)>$"))


def _fits(pattern: Column, topic: Column, sep: str, one: str, rest: str) -> Column:
    p, t = F.split(pattern, sep), F.split(topic, sep)
    open_end = F.element_at(p, -1) == rest
    n = F.size(p) - F.when(open_end, 1).otherwise(0)
    same = F.forall(F.zip_with(F.slice(p, F.lit(1), n), F.slice(t, F.lit(1), n), lambda a, b: F.coalesce((a == one) | (a == b), F.lit(False))), lambda x: x)
    enough = F.when(open_end, F.size(t) >= n + (0 if rest == "#" else 1)).otherwise(F.size(t) == n)
    return same & enough & ~F.array_contains(t, "")


def subject_matches(pattern: Column, topic: Column) -> Column:
    """Whether a concrete topic is matched by a wildcard subject; a topic with an empty token matches nothing."""
    return F.when(F.contains(pattern, F.lit("/")), _fits(pattern, topic, "/", "+", "#")).otherwise(_fits(pattern, topic, r"\.", "*", ">"))
