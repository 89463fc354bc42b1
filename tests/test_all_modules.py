"""What modules consist of is checked for all modules, also on the smallest tables."""

import duckdb
import pytest
from conftest import rows

from codefacts.plans.catalog import REGISTRY

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize(("name", "modules"), [("functions", 4), ("classes", 3), ("import_roots", 4)])
def test_all_modules_equal_the_oracle(spark, name, modules):
    q = REGISTRY[f"core_module_{name}"]
    con = duckdb.connect()
    for table in ("nation", "supplier", "customer", "part"):
        con.sql(f"create view {table} as select * from '{SF}/{table}.parquet'")
    cur = con.sql(q.oracle)
    got = q.run(spark, SF)
    assert rows(got, *cur.columns) == sorted(cur.fetchall(), key=repr)
    assert got.select("name").distinct().count() == modules
