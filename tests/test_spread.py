"""Small tables that mean much work are dealt over many tasks, and every file is read once."""

from functools import cache

import pytest

from tests.conftest import DATA
from weftline import catalog
from weftline.plans import projections as P
from weftline.sources import extract, javascript, proto, yaml_files


@pytest.mark.parametrize("name", ["script_events", "script_routes", "yaml_properties", "python_facts", "proto_nodes", "file_routes"])
def test_rows_are_dealt_over_tasks(spark, monkeypatch, name):
    monkeypatch.setattr(P, "ROWS_PER_TASK", 20)
    df = catalog.queries()[name](spark, f"{DATA}/sf0.001")
    assert max(df.rdd.getNumPartitions(), len(df.inputFiles())) >= 8  # 200 parts


def test_scalar_kinds_are_told_by_one_resolver(monkeypatch):
    yaml = pytest.importorskip("yaml")
    built, plain = [], yaml.SafeLoader

    class Counted(plain):
        def __init__(self, *a):
            built.append(a)
            super().__init__(*a)

    monkeypatch.setattr(yaml, "SafeLoader", Counted)
    getattr(yaml_files, "_resolver", cache(int)).cache_clear()
    text = "".join(f"k{i}: {v}\n" for i, v in enumerate(["true", "TRUE", "~", "", "12", "1.5", "'~'", "2001-01-01", "no", "x"] * 5))
    got = yaml_files.properties(text)
    getattr(yaml_files, "_resolver", cache(int)).cache_clear()
    assert got == [(f"k{i}", v) for i, v in enumerate(["true", "true", None, None, "12", "1.5", "~", "2001-01-01", "no", "x"] * 5) if v is not None]
    assert len(built) <= 2  # not one for each scalar


def test_token_tests_do_not_count_tokens(monkeypatch):
    calls = []
    monkeypatch.setattr(javascript.Script, "__len__", lambda s: calls.append(1) or len(s.value))
    script = javascript.Script("import express from 'express';\nconst app = express();\n" + "app.get('/a', f);\n" * 50)
    assert [r["path"] for r in javascript.routes(script)] == ["/a"]
    assert not script.is_id(len(script.value)) and not script.is_op(-1, ";") and len(calls) < len(script.value)


def test_facts_are_built_without_pandas(spark):
    text = "@shared_task\ndef job():\n    pass\n"
    files = spark.createDataFrame([("/a.py", None, "python", text), ("/b.py", 3, "python", text), ("/c.py", 4, "python", "def (")], "path string, repo_id int, language string, text string").coalesce(1)
    facts = extract.extract(files)
    assert "MapInArrow" in facts._jdf.queryExecution().executedPlan().toString()
    got = sorted(map(tuple, facts.where("what in ('consumer', 'failed')").select("path", "repo_id", "what", "target", "heuristic").collect()))
    assert got == [("/a.py", None, "consumer", "job", False), ("/b.py", 3, "consumer", "job", False), ("/c.py", 4, "failed", None, None)]


def test_lines_of_protobuf_are_counted_once():
    calls = []

    class Counted(str):
        def count(self, *a):
            calls.append(a)
            return str.count(self, *a)

    text = Counted("/* a\nb */ package p;\n\n" + "message M {\r\n  string s = 1 [default = 'x\\\ny'];\n  int32 t = 2;\n}\n" * 50)
    p = proto.parse(text)
    assert [(f["name"], f["line"]) for f in p.fields] == [(n, 5 + 5 * i + at) for i in range(50) for n, at in (("s", 0), ("t", 2))]
    assert [(n["line_start"], n["line_end"]) for n in p.nodes] == [(4 + 5 * i, 8 + 5 * i) for i in range(50)]
    assert not calls  # not once for each token
