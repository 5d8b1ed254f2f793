"""Every stage of the pipeline against a plain computation on what it was given."""

import re
from collections import Counter

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from tests.llm.conftest import SCHEMA, documents
from tests.llm.test_queries import shingle_set
from weftline.llm import op4_mixing

COOKIES = "Accept all cookies to continue reading."
ITEM = "If a train leaves the old station at noon and travels west for hours, when will it arrive there?"


def text(seed, words=60):
    rng = np.random.default_rng(seed)
    return " ".join("".join(rng.choice(list("aeiourstlnmk"), rng.integers(2, 8))) for _ in range(words))


@pytest.fixture(scope="module")
def given(spark, tmp_path_factory):
    a, b, c = text(1), text(2), text(3)
    near_a, near_b = a.replace(a.split()[30], "zzz"), b.replace(b.split()[30], "yyy")
    rows = [
        (1, a), (2, a), (2, b), (3, near_a), (5, near_b), (5, near_b), (6, c), (6, c), (7, None), (7, ""), (8, " \t"), (9, "12345 !"), (10, text(4, 20_000)),
        (11, None, None, None), (12, text(5), None, "s0"), (13, "Solo", "en", None), (14, "Solo", "en", None), (15, f"{text(6)} {ITEM} {text(7)}"), (15, text(8)), (16, ITEM.lower()),
    ]
    rows += [(100 + k, f"{text(100 + k)}\n{COOKIES}", "en", f"s{k}") for k in range(8)] + [(120, COOKIES, "en", "s3"), (None, text(9)), (None, text(9))]
    bench = spark.createDataFrame([(1, ITEM), (2, None), (3, "")], "item_id long, text string")
    folder = str(tmp_path_factory.mktemp("pipeline"))
    bench.write.parquet(f"{folder}/benchmark.parquet")
    return documents(spark, rows), folder


def plain(df):
    return [(r["doc_id"], r["text"], r["source"]) for r in df.collect()]


def key(row):
    return tuple((x is not None, x) for x in row)


def test_stages(spark, given):
    docs, folder = given
    stages = dict(corpus_pipeline.STAGES)
    steps = [docs]
    for name in ("language_id", "line_dedup", "jaccard_join", "decontamination"):
        steps.append(corpus_pipeline.materialize(stages[name](spark, steps[-1], folder), f"test-{name}"))
        assert steps[-1].schema.names == docs.schema.names
    raw, told, cut, apart, clean = map(plain, steps)

    assert sorted(told, key=key) == sorted((r for r in raw if re.search("[a-z]", r[1] or "")), key=key)

    sites = {}
    for i, t, s in told:
        for line in t.split("\n"):
            sites.setdefault(line.strip(" ").lower(), []).append((s, i))
    common = {line: min(i for _, i in seen if i is not None) for line, seen in sites.items() if line.strip() and len({s for s, _ in seen}) >= 5}
    assert set(common) == {COOKIES.lower()}
    kept = [(i, "\n".join(x for x in t.split("\n") if i is None or i <= common.get(x.strip(" ").lower(), i)), s) for i, t, s in told]
    assert sorted(cut, key=key) == sorted(kept, key=key)

    sets = [shingle_set(t) for _, t, _ in cut]
    group = list(range(len(cut)))
    for x in range(len(cut)):
        for y in range(x):
            if sets[x] and 100 * len(sets[x] & sets[y]) >= 75 * len(sets[x] | sets[y]):
                old, new = group[x], group[y]
                group = [new if g == old else g for g in group]
    assert len(apart) == len(set(group)) < len(cut)
    of_row = {(i, t): g for (i, t, _), g in zip(cut, group, strict=True) if shingle_set(t)}
    for g in set(of_row.values()):
        members = [r for r, own in of_row.items() if own == g]
        left = [(i, t) for i, t, _ in apart if of_row.get((i, t)) == g]
        assert len(left) == 1 and left[0][0] == min((i for i, _ in members), key=lambda i: (i is not None, i))
    assert Counter(r for r in apart if not shingle_set(r[1])) == Counter(r for r in cut if not shingle_set(r[1]))

    low = " ".join(re.findall(r"\w+", ITEM.lower()))
    assert sorted(clean, key=key) == sorted((r for r in apart if low not in " ".join(re.findall(r"\w+", r[1].lower()))), key=key)
    assert {i for i, _, _ in apart} - {i for i, _, _ in clean} == {16} and (15, text(8), "s") in clean

    mixed = stages["mixing"](spark, steps[-1], folder).toPandas()
    con = duckdb.connect()
    con.register("documents", steps[-1].toArrow())
    want = con.sql(op4_mixing.SQL).df()
    order = ["doc_id", "size", "source_size", "taken"]
    as_text = lambda df: sorted(df[order].fillna(-1).astype(int).apply(tuple, axis=1))
    assert as_text(mixed) == as_text(want)


def test_one_row_of_each_class_stays(spark, tmp_path):
    a, b = text(21), text(22)
    rows = [(1, a), (2, a), (2, b), (3, a + " end"), (5, b + " end"), (5, b + " end")]
    out = plain(corpus_pipeline.jaccard_join(spark, documents(spark, rows), str(tmp_path)))
    assert [(i, t) for i, t, _ in sorted(out)] == [(1, a), (2, b)]
    out = corpus_pipeline.jaccard_join(spark, documents(spark, [(1, a), (1, a), (4, None), (4, None)]), str(tmp_path))
    assert sorted(r["doc_id"] for r in out.collect()) == [1, 4, 4]


def test_stages_beyond_what_is_broadcast(spark, given, monkeypatch):
    docs, folder = given
    stages = dict(corpus_pipeline.STAGES)
    keep = lambda: [sorted(map(str, stages[n](spark, docs, folder).collect())) for n in ("jaccard_join", "decontamination")]
    want = keep()
    monkeypatch.setattr(corpus_pipeline, "_small", lambda keys: keys)
    assert keep() == want


def test_an_empty_table_passes(spark, given):
    _, folder = given
    docs = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, folder).count() == 0
