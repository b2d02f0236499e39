"""Every query of the reference's operators against its SQL in DuckDB."""

import duckdb
import pytest

from crestline import queries as Q

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(frame):
    names = sorted(frame.columns)
    plain = frame[names].astype(object)
    return sorted(map(str, plain.where(plain.notna(), None).itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", [f.__name__ for f in Q.FUNCTIONS])
def test_query(spark, name):
    with duckdb.connect() as db:
        for t in TABLES:
            db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
        want = db.execute(Q.SQL[name]).df()
    got = Q.queries()[name](spark, DIR).toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
