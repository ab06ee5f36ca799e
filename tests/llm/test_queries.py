import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2] / "tools"))
from compare import canonical  # noqa: E402

from parolis.llm import registry  # noqa: E402

DATA = Path("/root/testdata/sf0.001")


@pytest.mark.skipif(not DATA.exists(), reason="no tables here")
@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query_runs_and_equals_its_sql(spark, name):
    got = registry.queries()[name](spark, str(DATA)).toPandas()
    sql = registry.oracle_sql().get(name)
    if sql is not None:
        con = duckdb.connect()
        for p in DATA.glob("*.parquet"):
            con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
        want = con.sql(sql).df()
        assert sorted(got.columns) == sorted(want.columns) and canonical(got) == canonical(want)
