"""Every registered demand query against its SQL, or for its rows."""

import os

import pytest

from compare import DATA, rows, sql_rows
from tidegauge.plans.registry import ORACLES, QUERIES

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, name):
    assert rows(QUERIES[name](spark, DATA)) == sql_rows(ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_has_rows(spark, name):
    df = QUERIES[name](spark, DATA)
    assert df.count() > 0
    if name == "save_load_model":
        assert df.filter("difference <> 0").isEmpty()
    if name == "read_request_pages":
        from tidegauge.plans import analogues

        raw = analogues.raw(spark, DATA).drop("source_id", "run_id")
        assert df.select(*raw.columns).exceptAll(raw).isEmpty() and raw.exceptAll(df.select(*raw.columns)).isEmpty()


def test_entry_module():
    import __spark_entry__ as e

    assert set(QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
