import os
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parent.parent)
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, os.environ.get("PYTHONPATH", "")]))  # workers import the package too

DATA = "/root/testdata"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]").appName("tests")
        .config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('shared')}")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.sql(f"create view {t} as select * from read_parquet('{DATA}/sf0.001/{t}.parquet')")
    return con


def canonical(rows, columns):
    """Order-insensitive form of rows (dicts), doubles rounded."""

    def one(v):
        if isinstance(v, float):
            return None if v != v else f"{v:.9g}"
        return None if v is None else str(v)

    return sorted([tuple(one(r[c]) for c in columns) for r in rows], key=repr)


def against_sql(spark, duck, query, sql):
    """Asserts that a query's rows equal its SQL's on the smallest tables."""
    df = query(spark, f"{DATA}/sf0.001")
    columns = sorted(df.columns)
    rel = duck.sql(sql)
    assert sorted(rel.columns) == columns
    wanted = [dict(zip(rel.columns, r, strict=True)) for r in rel.fetchall()]
    assert canonical([r.asDict() for r in df.collect()], columns) == canonical(wanted, columns)
