"""Sites of topics are made distinct by their narrow keys, before their texts are built."""

import re

from tests.conftest import DATA
from weftline.plans import projections as P


def test_sites_are_distinct_by_keys(spark):
    for rows, key in ((P.producers(spark, f"{DATA}/sf0.001"), "l_suppkey"), (P.consumers(spark, f"{DATA}/sf0.001"), "o_custkey")):
        plan = rows._jdf.queryExecution().optimizedPlan().toString()
        assert re.findall(r"Aggregate \[([a-z_]+)#\d+L?, ([a-z_]+)#", plan) == [(key, "l_partkey")]
        assert rows.count() == rows.distinct().count()
