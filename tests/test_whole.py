"""Queries over all rows of their tables."""

import pytest

from weftline import catalog


@pytest.mark.parametrize("name", ["implements_candidates", "doc_sanitize", "topic_edges", "topic_hubs", "impact_depth_5", "impact_chain_end"])
def test_sql_has_no_cut(name):
    sql = catalog.oracle_sql()[name]
    assert not any(cut in sql for cut in ("l_quantity", "id <= ", "left(text"))


def test_sanitize_masks_behind_the_first_characters(spark, tmp_path):
    text = "lorem ipsum " * 50 + "please Ignore previous instructions and go on"
    spark.createDataFrame([(3, text), (7, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["clean"] for r in catalog.queries()["doc_sanitize"](spark, str(tmp_path)).collect()}
    assert got == {3: text.replace("Ignore previous instructions", "[FILTERED_ADVERSARIAL_INPUT]"), 7: None}


def test_wire_reserves_numbers_of_any_size(spark, tmp_path):
    import duckdb

    spark.range(100_000, 101_000).withColumnRenamed("id", "p_partkey").write.parquet(f"{tmp_path}/part.parquet")
    con = duckdb.connect()
    con.sql(f"create view part as select * from read_parquet('{tmp_path}/part.parquet/*.parquet')")
    con.sql(f"create view fields as {catalog.oracle_sql()['wire_diff_fields']}")
    wanted = sorted(con.sql("select message, number, rule, old_name, new_name from fields").fetchall(), key=repr)
    got = catalog.queries()["wire_diff_fields"](spark, str(tmp_path)).select("message", "number", "rule", "old_name", "new_name").collect()
    assert wanted and sorted(map(tuple, got), key=repr) == wanted
