import math

import duckdb
import pytest

import tidemark.oracles
import tidemark.queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def _cell(v):
    if v is None:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return str(v) if not isinstance(v, (int, bool)) else v


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_cell(r[i]) for i in order) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(tidemark.oracles.ORACLES))
def test_against_sql(spark, db, name):
    df = tidemark.queries.QUERIES[name](spark, SF)
    cursor = db.execute(tidemark.oracles.ORACLES[name])
    names = [d[0] for d in cursor.description]
    assert sorted(df.columns) == sorted(names)
    assert _rows(df.columns, [tuple(r) for r in df.collect()]) == _rows(names, cursor.fetchall())


def test_every_query_has_sql_and_rows(db):
    assert set(tidemark.queries.QUERIES) == set(tidemark.oracles.ORACLES)
    # No user of the smallest tables has a number of 20 or more.
    assert {name for name, sql in tidemark.oracles.ORACLES.items() if not db.execute(sql).fetchone()} == {"lower_bound"}


def test_filtered_get_asks_every_key(spark, db):
    """Every key that is live in the log, and not only those with a change of an even number."""
    live = {r[0] for r in db.execute(tidemark.oracles.ORACLES["run_lookup"]).fetchall()}
    assert {r.k for r in tidemark.queries.QUERIES["filtered_get"](spark, SF).collect()} == live


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
