import __spark_entry__ as e
import pytest

from tests.oracle import differences, frames

SMALL = "/root/testdata/sf0.001"


def test_registry(spark):
    assert set(e.oracle_sql()) <= set(e.queries()) and e.entry(spark).count() == 200


@pytest.mark.parametrize("name", ["f10_cross_product_counts", "j2_assign_sites_rv", "a4_gene_block_stats", "n2_ttr", "w4_local_average", "m1_anova_statistics", "rd10_template_counts", "m14_fet_statistics"])
def test_sql_agrees(spark, name):
    assert differences(*frames(spark, name, SMALL)) == ""
