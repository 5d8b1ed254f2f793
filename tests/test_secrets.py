"""Spans of secrets, masked lines and messages."""

import pytest
from pyspark.sql import functions as F

from weftline.functions import secrets as S
from weftline.functions import text as T

M = S.MASK


@pytest.mark.parametrize(("text", "want"), [
    ("password=hunter2 x", f"password={M} x"), ('{"api_key": "abc", "n": 1}', f'{{"api_key": "{M}", "n": 1}}'), ("Authorization: Bearer abc", f"Authorization: {M} abc"), ("my token is fine", "my token is fine"),
    ("bearer of news", "bearer of news"), ("x bearer abcdefgh12345678 y", f"x bearer {M} y"), ("Basic dXNlcjpwYXNz", f"Basic {M}"), ("https://u:p@h/x", f"https://{M}@h/x"), ("https:/u:p@h", f"https:/{M}@h"), ("a@b.c", "a@b.c"),
    ("eyJhbGciOi.eyJzdWIi.abc_-1", M), ("key ghp_0123456789abcdef!", f"key {M}!"), ("sk-short", "sk-short"), ("A1" * 16, M), ("a" * 40, "a" * 40), ("ab-cd-" * 8, "ab-cd-" * 8), ("aB1-" * 8, M),
    ("commit 550e8400-e29b-41d4-a716-446655440000", "commit 550e8400-e29b-41d4-a716-446655440000"), ("", ""),
])
def test_spans(text, want):
    assert S.masked(text) == want


@pytest.mark.parametrize(("text", "want"), [
    ('invalid type: string "top, expected secret", expected u32', "invalid type: string <value>, expected u32"), ("unknown field `x`, expected one of `a`", "unknown field <value>, expected one of `a`"), ("invalid type: null, expected a string", "invalid type: null, expected a string"),
    ('invalid value: integer "open', "invalid value: integer <value>"), ("at /home/jo/x and (/Users/al/y) C:\\Users\\b\\z", "at ~/x and (~/y) ~\\z"), ("see/home/x", "see/home/x"), ("a\n\tb\x07 c", "a b c"), ("x" * 300, "x" * 197 + "..."), ("/opt/me/q", "~/q"),
])
def test_messages(text, want):
    assert S.sanitize_message(text, "/opt/me") == want


@pytest.mark.parametrize(("line", "code", "want"), [
    ('const password = "hunter2";', True, f"const password = {M};"), ("password!: string;", True, "password!: string;"), ("password: dto.password", True, "password: dto.password"), ('"token": "abc",', False, f'"token": {M},'),
    ("token: abc", False, f"token: {M}"), ("token: ${X}", False, "token: ${X}"), ("REFRESH_TOKEN = 'refresh_token'", True, "REFRESH_TOKEN = 'refresh_token'"), ('password: "DB_PASSWORD"', False, 'password: "DB_PASSWORD"'), ("https://secret:80", True, "https://secret:80"),
    ('the password: "x"', True, 'the password: "x"'), ('token = f("x")', True, 'token = f("x")'), ("apiKey: string = 'k'", True, f"apiKey: string = {M}"), ("- secret: v", False, f"- secret: {M}"), ("secret: [a]", False, "secret: [a]"), ("plain = 'x'", True, "plain = 'x'"),
])
def test_lines(line, code, want):
    assert S.redact_line(line, code) == want


def test_columns(spark):
    df = spark.createDataFrame([("token=abc at /home/x/y",), (None,), ("fine",)], "t string")
    assert [r[0] for r in df.select(S.sanitized_message(F.col("t"))).collect()] == [f"token={M} at ~/y", None, "fine"]
    lines = spark.createDataFrame([("const secret = 'v';",), (None,), ("x",)], "t string")
    assert [r[0] for r in lines.select(S.redacted_line(F.col("t"))).collect()] == [f"const secret = {M};", None, "x"]
    blobs = ["A1" * 16, "a" * 40, "ab1-" * 9, "aB1-" * 9, "a1" * 15]
    got = spark.createDataFrame([(b,) for b in blobs], "t string").select(T.secret_blob(F.col("t"))).collect()
    assert [r[0] for r in got] == [S.looks_like_key_material(b) for b in blobs] == [True, False, False, True, False]
