"""Documents whose lines look like headings, end in carriage returns or are empty at the end; one id with several texts."""

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq

from tests.conftest import canonical
from weftline import catalog

TEXTS = ["a\n# b\nc", "one\r\ntwo\r\n", "1\n2\n3\n4\n5\n", "", "\n", "x\n\n\n", "  ## é\n" * 7, "# h\n# h\n# h\n# h\n# h\n# h", "\r", None, "plain"]


def test_sections_of_odd_lines(spark, tmp_path):
    pq.write_table(pa.table({"doc_id": pa.array([*range(len(TEXTS)), 2, None], pa.int64()), "text": [*TEXTS, "1\n2", TEXTS[2]]}), tmp_path / "documents.parquet")
    df = catalog.queries()["doc_sections"](spark, str(tmp_path))
    con = duckdb.connect()
    con.sql(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet')")
    rel = con.sql(catalog.oracle_sql()["doc_sections"])
    columns = sorted(rel.columns)
    wanted = [dict(zip(rel.columns, r, strict=True)) for r in rel.fetchall()]
    assert canonical([r.asDict() for r in df.collect()], columns) == canonical(wanted, columns)
