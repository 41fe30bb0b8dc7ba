"""The DuckDB SQL of the operators against their queries on the smallest tables."""

import pytest

from colloquy.llm import queries
from colloquy.plans import compare
from tests.conftest import SF_SMALL


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    got = queries.QUERIES[name](spark, SF_SMALL)
    want = compare.duck(SF_SMALL).sql(queries.ORACLE_SQL[name])
    assert compare.canon(got.columns, [tuple(r) for r in got.collect()]) == compare.canon(list(want.columns), want.fetchall())
    assert compare.type_mismatches(got, want) == []
