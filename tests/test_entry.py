import os

import pytest

SMALL = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="test tables are not here")
def test_every_query_builds_and_runs_on_the_smallest_tables(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    core = [k for k in entry.queries() if not (k[0] == "p" and k[1].isdigit())]
    for name in core[:: max(1, len(core) // 12)]:
        entry.queries()[name](spark, SMALL).limit(5).collect()


def test_sql_belongs_to_queries():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) >= 120
