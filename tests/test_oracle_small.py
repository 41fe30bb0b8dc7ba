"""A cross-section of registered queries against their DuckDB SQL on sf0.001."""
import pytest

from colloquy.plans import compare
from tests.conftest import SF_SMALL

SAMPLE = ["a11_sentiment_vs_baseline", "d21_records", "d04_extract_issues", "a03_anomaly_report", "a04_escalation_report",
          "a15_account_impact", "a17_churn_radar", "a23_box_stats", "v09_churn_risk_table", "s09_lineage_upsert",
          "j08_apply_corrections", "d01_redact_documents", "d03_pii_vault", "t04_bm25_documents_top20",
          "t04b_bm25_records_chat_top5", "d31_transcript_metrics", "a14_month_over_month"]


@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_oracle(spark, name):
    res = compare.run(SF_SMALL, [name], spark=spark)
    assert res[name][0] == "OK", res[name]


def test_every_query_builds(spark):
    import __spark_entry__ as E
    qs, sql = E.queries(), E.oracle_sql()
    assert set(sql) <= set(qs) and len(qs) >= 130
    for name, fn in qs.items():
        assert fn(spark, SF_SMALL).columns, name
    assert E.entry(spark).count() == 3
