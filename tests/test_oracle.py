"""Every query against its SQL on whole tables."""

import pytest

from fieldsurvey.checks import QUERIES, SQL
from oracle import differences, oracle_rows


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_sql(spark, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    columns, expected = oracle_rows(sf_dir, SQL[name])
    assert expected
    assert differences(df.columns, [tuple(r) for r in df.collect()], columns, expected) == []
