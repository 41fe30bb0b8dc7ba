"""Row orders of sorted visuals and reports (the comparison with the SQL ignores order elsewhere)."""
import pytest

from colloquy.operators.visuals import VISUALS, months
from colloquy.plans import compare, load_all
from tests.conftest import SF_SMALL

ORDERED = [f"{v.vid}_{v.name}" for v in VISUALS if v.sort] + ["a16_month_by_call_type", "a16b_month_by_category", "a17_churn_radar"]


@pytest.mark.parametrize("name", ORDERED)
def test_rows_in_the_order_of_the_sql(spark, name):
    fn, sql = load_all()[name]
    got, want = fn(spark, SF_SMALL), compare.duck(SF_SMALL).sql(sql)
    order = [want.columns.index(c) for c in got.columns]
    rows = [tuple(compare._norm(v) for v in r) for r in got.collect()]
    assert rows == [tuple(compare._norm(r[i]) for i in order) for r in want.fetchall()]


def test_months():
    assert months("1999-11", "2000-02") == ["1999-11", "1999-12", "2000-01", "2000-02"]
