import re

import pytest

from workload.check import compare
from workload.oracle import ORACLE
from workload.queries import QUERIES


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, connection, sf_dir, plan_of, name):
    """Equals its SQL; needs no Python workers and no cross joins."""
    df = QUERIES[name](spark, sf_dir)
    assert not re.search("CartesianProduct|BroadcastNestedLoopJoin|PythonUDF|ArrowEvalPython|MapInPandas", plan_of(df))
    fine, message = compare(connection, name, df)
    assert fine, message


def test_entry(spark):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert df.columns == ["id", "siret", "siren", "nom", "adresse", "code_postal", "commune", "ape", "search"]
    assert df.count() == 51
