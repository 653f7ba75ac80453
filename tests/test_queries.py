"""Every engine query against its SQL twin on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from quillgraph import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for f in Path(SF).glob("*.parquet"):
        con.sql(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{f}')")
    return con


def plain(rows):
    fix = lambda v: None if isinstance(v, float) and math.isnan(v) else v
    return sorted(tuple(map(fix, r)) for r in rows) if all(None not in r for r in rows) else sorted((tuple(map(fix, r)) for r in rows), key=repr)


@pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")
@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, sql, name):
    got, want = queries.QUERIES[name](spark, SF), sql.sql(queries.ORACLES[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert plain([tuple(r) for r in got.select(*[f"`{c}`" for c in columns]).collect()]) == plain(want.select(*[f'"{c}"' for c in columns]).fetchall())


def test_entry_point():
    import __spark_entry__ as entry

    assert {*queries.QUERIES} <= {*entry.queries()} and {*queries.ORACLES} <= {*entry.oracle_sql()}
