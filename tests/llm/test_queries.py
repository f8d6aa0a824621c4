import pytest

from placebook.llm.queries import ORACLE, QUERIES
from workload.check import differences, rows_by_name


@pytest.mark.parametrize("name", ORACLE)
def test_query_equals_its_sql(spark, connection, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    got = rows_by_name(df.columns, [tuple(row) for row in df.collect()])
    result = connection.execute(ORACLE[name])
    names = [column[0] for column in result.description]
    expected = rows_by_name(names, result.fetchall())
    assert sorted(names) == sorted(df.columns)
    assert len(got) == len(expected) and not differences(got, expected)
