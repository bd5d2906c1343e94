import importlib
import sys

import pytest

import __spark_entry__ as entry
from evidex.plans import registry

SF = "/root/testdata/sf0.001"


def test_every_query_has_rows_or_columns(spark):
    assert entry.entry(spark).count() > 0
    assert set(registry.oracle_sql()) <= set(registry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_without_the_llm_subpackage(monkeypatch):
    monkeypatch.setitem(sys.modules, "evidex.llm", None)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    alone = importlib.reload(entry)
    assert set(alone.queries()) == set(registry.queries()) and alone.oracle_sql() == registry.oracle_sql()
    monkeypatch.undo()
    importlib.reload(entry)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents pages benchmark labels conversations".split():
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = registry.queries()[name](spark, SF)
    want = con.sql(registry.oracle_sql()[name])
    order = sorted(df.columns)
    assert order == sorted(want.columns)
    clean = lambda v: round(float(v), 6) if isinstance(v, float) else v
    rows = lambda found, names: sorted((tuple(clean(r[names.index(c)]) for c in order) for r in found), key=str)
    assert rows(map(tuple, df.collect()), df.columns) == rows(want.fetchall(), want.columns)
