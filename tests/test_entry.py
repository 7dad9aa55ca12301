import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry
from foliant.plans.catalog import QUERIES
from foliant.plans.oracles import ORACLES


def normal(df):
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if df[c].dtype.kind == "f":
            df[c] = df[c].round(6)
    return sorted(map(repr, df.astype(object).where(df.notna(), None).itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_against_sql(spark, sf, name):
    got = QUERIES[name](spark, sf)
    if name not in ORACLES:
        assert got.count() >= 0
        return
    con = duckdb.connect()
    import os

    for t in os.listdir(sf):
        con.execute(f"create view {t[:-8]} as select * from '{sf}/{t}'")
    want = con.execute(ORACLES[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert normal(got.toPandas()) == normal(want)


def test_contract(spark, sf):
    assert len(entry.entry(spark).columns) == 3
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_core_imports_without_the_llm_subpackage():
    code = "import sys; sys.modules['foliant.llm'] = None; import __spark_entry__ as e; assert e.queries() and not any(k[0] == 'p' and k[1].isdigit() for k in e.queries())"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=entry.__file__.rpartition("/")[0])


def test_nothing_in_the_core_imports_the_llm_subpackage():
    from pathlib import Path

    root = Path(entry.__file__).parent / "foliant"
    assert not [p for p in root.rglob("*.py") if "llm" not in p.parts and "foliant.llm" in p.read_text()]
