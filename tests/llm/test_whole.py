"""Operators on all of their input: what a cut would leave out."""

from tests.conftest import DATA, against_sql
from tests.llm.conftest import documents
from weftline.llm import catalog
from weftline.llm import op1_line_dedup as op1
from weftline.llm import op3_quality as op3
from weftline.llm import op8_license_scan as op8


def test_op1_lets_the_spread_decide_for_short_lines(spark, duck):
    rows = [(k, f"own text number {k} here\nthe first line of a repeated block\n Les.\n\nrare\n \t", "en", f"site{k}") for k in range(1, 7)]
    rows += [(k, "twice\nown words", "en", f"site{k % 4}") for k in range(10, 20)]
    out = {r["doc_id"]: r["text"] for r in op1.dedup_lines(documents(spark, rows)).collect()}
    assert "Les." in out[1] and all(out[k] == f"own text number {k} here\n\n \t" for k in range(2, 7))
    assert all(out[k] == "twice\nown words" for k in range(10, 20))
    against_sql(spark, duck, catalog.queries()["op1_line_dedup"], catalog.oracle_sql()["op1_line_dedup"])


def test_op8_finds_the_license_lines_of_the_data(spark):
    sf = f"{DATA}/sf0.01"
    lines = {
        "All rights reserved.": "all-rights-reserved", "Released under the MIT License.": "mit", "Licensed under CC BY-NC 4.0.": "cc-by-nc-4.0",
        "Licensed under the Apache License, Version 2.0.": "apache-2.0", "This work is licensed under the GNU General Public License, version 3.": "gpl-3.0",
    }
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    want = {(r["doc_id"], lines[x.strip()]) for r in docs for x in (r["text"] or "").split("\n") if x.strip() in lines}
    got = {(r["doc_id"], r["license"]) for r in catalog.queries()["op8_license_scan"](spark, sf).collect()}
    assert any(name == "all-rights-reserved" for _, name in want) and want <= got


def test_op8_short_notices_and_full_texts(spark):
    full = op8.full_texts()
    rows = [(k, f"some words before\n{text}\nand after") for k, (_, text) in enumerate(sorted(full.items()))]
    rows += [(100, "All rights reserved."), (101, "x y z, all Rights RESERVED. x all rights reserved"), (102, "all rights are reserved"), (103, "rights reserved")]
    cut = full["mit"].split()
    rows += [(110, " ".join(cut[: len(cut) * 8 // 10])), (111, " ".join(cut[: len(cut) // 2]))]
    got = {(r["doc_id"], r["license"]): (r["containment"], r["n_windows"]) for r in op8.license_scan(documents(spark, rows)).collect()}
    assert all(got[k, name][0] == 1.0 for k, name in enumerate(sorted(full)))
    assert got[100, "all-rights-reserved"] == (1.0, 1) and got[101, "all-rights-reserved"] == (1.0, 2)
    assert not any(i in (102, 103, 111) for i, _ in got) and 0.75 <= got[110, "mit"][0] < 0.85


def test_op3_letter_share_is_of_the_whole_text():
    for n in (1, 1_999, 2_000, 3_999, 4_000, 5_999, 50_000):
        assert op3._hash("\x00a20") in op3.features("x" * n)
        assert op3._hash("\x00a10") in op3.features("x1" * n)
