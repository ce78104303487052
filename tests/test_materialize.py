"""The issue table is the same whether the shared facts are derived on the fly or materialised."""

from opsledger.catalog.rules_q import all_issues

SF = "/root/testdata/sf0.001"


def test_materialized_issue_table_equal(spark):
    a = sorted(tuple(r) for r in all_issues(spark, SF).collect())
    b = sorted(tuple(r) for r in all_issues(spark, SF, materialize=True).collect())
    assert len(a) > 0 and a == b
