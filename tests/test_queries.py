"""Every registered catalog query against its SQL on the same tables."""

from __future__ import annotations

import os

import oracle
import pytest

from catalith import plans

DIR = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no tables")
@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, name):
    df = plans.QUERIES[name](spark, DIR)
    if name in plans.ORACLE_SQL:
        oracle.compare(df, plans.ORACLE_SQL[name], DIR)
    else:
        assert df.count() > 0


def test_a_page_is_taken_before_tags_are_joined(spark):
    plan = plans.QUERIES["list_files_page"](spark, DIR)._jdf.queryExecution().executedPlan().toString()
    assert "LocalTableScan" in plan and "LeftSemi, BuildRight" in plan and "rangepartitioning" not in plan
    # All that is left to scan are the tags.
    assert plan.count("FileScan") == 3 and "octet_length" not in plan
