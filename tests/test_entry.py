import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "tools"))
from compare import canonical  # noqa: E402

from parolis.plans import registry  # noqa: E402

DATA = Path("/root/testdata/sf0.001")


def connection():
    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def test_every_sql_has_a_query():
    assert set(registry.oracle_sql()) <= set(registry.queries()) and registry.FLAGSHIP in registry.queries()


@pytest.mark.skipif(not DATA.exists(), reason="no tables here")
def test_entry_has_rows_and_ships_the_package_once(spark):
    import __spark_entry__

    from parolis.runtime import ship

    assert __spark_entry__.entry(spark).count() > 0
    ship(spark)
    assert str(spark.sparkContext.listFiles).count("parolis.zip") == 1
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.skipif(not DATA.exists(), reason="no tables here")
@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query_runs_and_equals_its_sql(spark, name):
    got = registry.queries()[name](spark, str(DATA)).toPandas()
    sql = registry.oracle_sql().get(name)
    if sql is not None:
        want = connection().sql(sql).df()
        assert sorted(got.columns) == sorted(want.columns) and canonical(got) == canonical(want)


def test_no_machine_local_checkpoints_on_a_cluster():
    from types import SimpleNamespace

    from parolis.runtime import ensure_checkpoint_dir

    undefined = SimpleNamespace(isDefined=lambda: False)
    sc = SimpleNamespace(_jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: undefined)), master="spark://host:7077")
    with pytest.raises(RuntimeError):
        ensure_checkpoint_dir(SimpleNamespace(sparkContext=sc, conf=SimpleNamespace(get=lambda k, d: d)))
