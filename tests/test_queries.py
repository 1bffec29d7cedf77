"""Every registered query of the library proper against its SQL on the smallest tables."""

import datetime
import math
import os

import duckdb
import pytest

from lodestone import plans
from lodestone.sources.tables import TABLES

SF = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 6) + 0.0)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return repr(v)


@pytest.mark.skipif(not os.path.isdir(SF), reason="the given tables are not here")
@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, name):
    df = plans.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    if name not in plans.ORACLES:
        assert got
        return
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    r = c.execute(plans.ORACLES[name])
    names = [x[0] for x in r.description]
    assert sorted(names) == columns
    assert sorted(tuple(plain(dict(zip(names, row, strict=True))[c]) for c in columns) for row in r.fetchall()) == got
