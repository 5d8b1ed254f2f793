"""Secrets in free text and in source lines: spans, masking, error messages fit for storage.

Spans of several rules overlap and merge, so texts are read in Python, in Arrow batches, behind a cheap filter.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: What stands for a secret, keys and token starts that mark one, words before a key, length of a message (fixed values).
MASK = "[REDACTED_SECRET: USE_ENV_OR_LOCAL_FALLBACK]"
KEYS = ("password", "passwd", "secret", "token", "credential", "passphrase", "private", "jwt", "cert", "apikey", "api_key", "api-key", "access_key", "signing_key", "authorization")
PREFIXES = ("sk-", "ghp_", "gho_", "ghs_", "xoxb-", "xoxp-", "AKIA")
LEADS = ("const", "let", "var", "val", "final", "export", "declare", "readonly", "private", "public", "protected", "static")
MESSAGE_CHARS = 200
_LINE_KEYS = ("password", "secret", "token", "credential", "passphrase", "private", "jwt", "cert", "apikey", "api_key", "api-key", "secret_key", "access_key", "signing_key", "auth_token")
_KEY_PARTS, _AUTH = ("secret", "priv", "sign", "encrypt", "access", "token", "api", "cert"), ("auth", "authorization", "authn")

_STOP = r"[^\s\"',;&})>]"
_ASSIGNED = re.compile(rf"(?i:{'|'.join(map(re.escape, KEYS))})[A-Za-z0-9_-]*[\"' ]*[=:][ \"']*({_STOP}+)")
_BEARER, _BASIC = re.compile(rf"(?i:bearer )({_STOP}+)"), re.compile(rf"(?i:basic )({_STOP}+)")
_USERINFO, _LOST = re.compile(r"://([^/?#\"')\s]+)@"), re.compile(r"(?:^|(?<=[\s/\"'(<]))([^\s/\"'(<@]*:[^\s/\"'(<@]*)@")
_BLOB = re.compile(r"[A-Za-z0-9_.+=-]+")


def looks_like_key_material(run: str) -> bool:
    """32 letters and digits or more; with other signs it must mix digits, upper and lower case."""
    if len(run) < 32:
        return False
    digit, upper, lower = (any(f(c) for c in run) for f in (str.isdigit, str.isupper, str.islower))
    return digit and ((upper or lower) if re.fullmatch("[A-Za-z0-9]+", run) else (upper and lower))


def spans(text: str) -> list[tuple[int, int]]:
    """Start and end of secret values, merged and in order."""
    found = [m.span(1) for m in _ASSIGNED.finditer(text)]
    at = 0
    while m := _ASSIGNED.search(text, at):  # a key inside another one's value counts too
        found.append(m.span(1))
        at = m.start() + 1
    for pattern, least in ((_BEARER, 16), (_BASIC, 8)):
        for m in pattern.finditer(text):
            word = m[1]
            if len(word) >= least and re.fullmatch(r"[A-Za-z0-9_.+=/-]+", word) and (re.search("[0-9]", word) or (re.search("[A-Z]", word) and re.search("[a-z]", word))):
                found.append(m.span(1))
    found += [m.span(1) for m in _USERINFO.finditer(text)] + [m.span(1) for m in _LOST.finditer(text)]
    for m in _BLOB.finditer(text):
        blob, parts = m[0], m[0].split(".")
        jwt = len(parts) == 3 and len(blob) >= 20 and all(re.fullmatch("[A-Za-z0-9_-]+", p) for p in parts) and (blob.startswith("eyJ") or all(len(p) >= 10 for p in parts))
        if jwt or (len(blob) >= 16 and blob.startswith(PREFIXES)):
            found.append(m.span())
            continue
        start = m.start()
        for p in parts:
            if looks_like_key_material(p):
                found.append((start, start + len(p)))
            start += len(p) + 1
    merged: list[list[int]] = []
    for a, b in sorted(found):
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    return [(a, b) for a, b in merged]


def masked(text: str) -> str:
    out, at = [], 0
    for a, b in spans(text):
        out += [text[at:a], MASK]
        at = b
    return "".join(out) + text[at:]


def without_values(text: str) -> str:
    """A parser's complaint without the value it quotes (which may hold anything); what it expected stays."""
    marks = re.compile(r"invalid type: |invalid value: |unknown variant |unknown field ")
    out, at = "", 0
    while m := marks.search(text, at):
        out += text[at : m.end()]
        tail = text[m.end() :]
        quote, expected = re.search('["`]', tail), tail.find(", expected")
        if not quote or 0 <= expected < quote.start():
            at = m.end()
            continue
        body = r'(?:[^"\\]|\\.)*"' if quote[0] == '"' else r"[^`]*`"
        out += tail[: quote.start()] + "<value>"
        close = re.compile(body, re.S).match(tail, quote.end())
        if not close:
            return out
        at = m.end() + close.end()
    return out + text[at:]


def homeless(text: str, home: str | None = None) -> str:
    """A text with home folders as ``~``."""
    if home and len(home) > 1:
        text = text.replace(home, "~")
    text = re.sub(r"(?:(?<=[\s\"'(=:`])|^)/(?:Users|home)/[^/\\\"'\s]*", "~", text)
    return re.sub(r"[A-Za-z]:\\Users\\[^/\\\"'\s]*", "~", text)


def sanitize_message(raw: str, home: str | None = None) -> str:
    """An error message for storage: no quoted values, no secrets, no home folders, one line, 200 characters."""
    flat = " ".join(re.sub(r"[\x00-\x1f\x7f-\x9f]", " ", homeless(masked(without_values(raw)), home)).split())
    return flat if len(flat) <= MESSAGE_CHARS else flat[: MESSAGE_CHARS - 3] + "..."


def _sensitive(key: str) -> bool:
    low = key.lower()
    words = [w for w in re.split(r"[._\- ]+", re.sub("([A-Z]+)([A-Z][a-z])", r"\1 \2", re.sub("([a-z0-9])([A-Z])", r"\1 \2", key)).lower()) if w]
    named = re.search(r"(?:^|[._-])key$", low) and any(p in low for p in _KEY_PARTS)
    return any(p in low for p in _LINE_KEYS) or bool(named) or any(w in _AUTH for w in words)


def _no_secret(key: str, value: str) -> bool:
    fold = lambda s: re.sub("[^a-z0-9]", "", s.lower())
    env = "_" in value and re.fullmatch("[A-Z][A-Z0-9_]*", value)
    return bool((value and fold(value) == fold(key)) or env) or value.startswith(("${", "{{")) or value in ("true", "false", "null", "~")


def redact_line(line: str, is_code: bool = True) -> str:
    """A line whose secret-looking key is assigned a value, with the value masked; in code only a literal is one."""
    sep = re.search("[:=]", line)
    if not sep:
        return line
    words = line[: sep.start()].strip().lstrip("-").split()
    if not words or any(w not in LEADS for w in words[:-1]):
        return line
    key = words[-1].strip("\"'").rstrip("!?")
    if not key or not _sensitive(key):
        return line
    start, rest = sep.end(), line[sep.end() :]
    quote = re.search("[\"'`]", rest)
    if quote:
        close = rest.find(quote[0], quote.end())
        lead = rest[: quote.start()].strip()
        if close < 0 or _no_secret(key, rest[quote.end() : close]):
            return line
        if lead and (not is_code or not re.fullmatch(r"[A-Za-z0-9_<>| ]*", lead.rstrip("=").strip())):
            return line
        return line[: start + quote.start()] + MASK + line[start + close + 1 :]
    value = rest.strip().rstrip(",;").rstrip()
    if is_code or not value or value[0] in "{[|>&*#" or _no_secret(key, value):
        return line
    at = start + len(rest) - len(rest.lstrip())
    return line[:at] + MASK + line[at + len(value) :]


def _over(function, text: Column) -> Column:
    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(function, na_action="ignore")

    return run(text)


def sanitized_message(text: Column) -> Column:
    return _over(sanitize_message, text)


def redacted_line(line: Column, is_code: bool = True) -> Column:
    """Lines without a separator never reach Python."""
    worth = line.rlike("(?i)(?:pass|secret|token|credential|private|jwt|cert|key|auth).*[:=]")
    return F.when(worth, _over(lambda x: redact_line(x, is_code), F.when(worth, line))).otherwise(line)
