"""Twin queries against their DuckDB SQL on the smallest tables."""

import duckdb
import pytest

from pixelmill.plans import catalogue

D = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    return con


def _plain(v):
    if v is None or v != v:
        return None
    return f"{v:.9g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_twin(spark, duck, name):
    got = catalogue.QUERIES[name](spark, D)
    cols = sorted(got.columns)
    ours = sorted((tuple(_plain(r[c]) for c in cols) for r in got.collect()), key=str)
    rel = duck.execute(catalogue.ORACLE_SQL[name])
    names = [c[0] for c in rel.description]
    theirs = sorted((tuple(_plain(r[names.index(c)]) for c in cols) for r in rel.fetchall()), key=str)
    assert sorted(names) == cols
    assert ours == theirs
    assert ours
