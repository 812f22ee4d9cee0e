"""Every registered query with an oracle against DuckDB over the smallest tables."""

import math

import duckdb
import pytest

from basketry.plans.catalogue import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def canonical(rows, columns):
    order = sorted(range(len(columns)), key=lambda k: columns[k])

    def plain(x):
        return "None" if x is None or (isinstance(x, float) and math.isnan(x)) else repr(x)

    return sorted(tuple(plain(r[k]) for k in order) for r in rows)


@pytest.mark.parametrize("name", sorted(n for n in ORACLES if not n.startswith("streaming")))
def test_query_equals_oracle(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    rel = duck.sql(ORACLES[name])
    assert sorted(df.columns) == sorted(rel.columns)
    assert canonical([tuple(r) for r in df.collect()], df.columns) == canonical(rel.fetchall(), rel.columns)
