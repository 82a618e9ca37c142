"""Every query of the library beside its SQL twin in DuckDB."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry_module
from lodestrata import queries as library

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    if isinstance(v, (list, tuple)):
        return str([plain(x) for x in v])
    return str(v)


@pytest.mark.parametrize("name", list(library.ORACLES))
def test_twin(spark, duck, name):
    df = library.QUERIES[name](spark, SF)
    names = sorted(df.columns)
    mine = sorted(tuple(plain(r[c]) for c in names) for r in df.collect())
    found = duck.execute(library.ORACLES[name])
    at = [[d[0] for d in found.description].index(c) for c in names]
    assert len(found.description) == len(names)
    assert mine == sorted(tuple(plain(r[i]) for i in at) for r in found.fetchall())


def test_every_library_query_has_a_twin():
    assert set(library.ORACLES) == set(library.QUERIES)


def test_entry(spark):
    assert entry_module.entry(spark).count() >= 0
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())
    assert os.path.isdir(SF)
