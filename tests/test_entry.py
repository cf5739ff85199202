import os
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry
from eventframe import queries as own

SF = "/root/testdata/sf0.001"


def test_names_agree():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert [r["name"] for r in entry.entry(spark).collect()] == ["all", "two items", "expensive"]


def canonical(rows):
    def one(x):
        if isinstance(x, (list, tuple)):
            return tuple(map(one, x))
        return None if x is None or x != x else round(float(x), 4) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)

    return sorted((tuple(map(one, r)) for r in rows), key=str)


@pytest.mark.parametrize("name", list(own.oracle_sql()))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    want = con.execute(own.oracle_sql()[name])
    columns = sorted(d[0] for d in want.description)
    order = [[d[0] for d in want.description].index(c) for c in columns]
    got = own.queries()[name](spark, SF)
    assert sorted(got.columns) == columns
    assert canonical(got.select(*columns).collect()) == canonical([tuple(r[i] for i in order) for r in want.fetchall()])


def test_llm_is_optional():
    code = "import sys; sys.modules['eventframe.llm'] = None\nimport __spark_entry__ as e\nassert 'flagship' in e.queries() and 'op1_license_scan' not in e.queries()"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
