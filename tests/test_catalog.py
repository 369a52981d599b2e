"""Every catalogue query against DuckDB on the smallest tables."""

import math
import os

import pytest

from chronofold.plans import catalog

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return ""
    return repr(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_matches_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = catalog.queries()[name](spark, SF), con.execute(catalog.oracle_sql()[name])
    names = sorted(got.columns)
    assert names == sorted(d[0] for d in want.description)
    at = [[d[0] for d in want.description].index(n) for n in names]
    assert sorted(tuple(plain(r[n]) for n in names) for r in got.collect()) == sorted(tuple(plain(r[i]) for i in at) for r in want.fetchall())


def test_subtract_and_chain(spark):
    from chronofold.operators import intervals as I

    frame = lambda rows: spark.createDataFrame([("L1", a, b) for a, b in rows], "ifo string, start_us long, end_us long")
    spans = lambda df: sorted((r.start_us, r.end_us) for r in df.collect())
    assert spans(I.merge(frame([(0, 10), (5, 15), (12, 20), (30, 30)]))) == [(0, 20)]
    assert spans(I.subtract(frame([(0, 100), (200, 300)]), frame([(10, 20), (15, 30), (90, 210), (400, 500)]))) == [(0, 10), (30, 90), (210, 300)]
    assert spans(I.split(frame([(0, 250), (300, 400)]), 100)) == [(0, 100), (100, 200), (200, 250), (300, 400)]
    assert spans(I.subtract(frame([]), frame([(0, 1)]))) == []
