"""Every query with SQL gives the same rows as DuckDB on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from ledgerloom import workload

SF = "/root/testdata/sf0.001"


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 6)
    return str(x) if hasattr(x, "isoformat") else x


@pytest.mark.parametrize("name", sorted(workload.oracle_sql()))
def test_same_rows(spark, name):
    con = duckdb.connect()
    for f in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    df = workload.queries()[name](spark, SF)
    got = con.execute(workload.oracle_sql()[name])
    names = [c[0] for c in got.description]
    assert sorted(df.columns) == sorted(names)
    key = lambda rows: sorted(repr([plain(x) for x in r]) for r in rows)
    assert key(df.select(*names).collect()) == key(got.fetchall())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
