"""Each registered query against its SQL on the smallest tables."""

import pytest

import __spark_entry__
from windrift.jobs import registry


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["venue", "day_type", "sessions", "share"] and df.count() > 0


#: The others run the same plans over measures that these cover; the driver compares all.
FAST = [n for n in registry.ORACLE_SQL if n.split("_")[0] in {"e1", "e2", "e3", "e4", "e5", "e6", "e7", "e8", "e9", "t1", "t2", "t6", "p3", "p4", "p5", "h6", "h8", "h9", "d5", "a1", "a5", "c2", "c6", "c6c", "c10", "y3", "b1", "b2", "b3", "b4", "b5", "b7", "b12", "b16", "b16b", "b17", "b18", "r1", "r2", "r3", "r4", "a6b", "b9", "b14", "c6b", "c7", "c7b", "c9", "e6b", "s1", "s5", "s5b", "y6b"}]


@pytest.mark.parametrize("name", FAST)
def test_query_matches_sql(name, matches):
    matches(registry.QUERIES[name], registry.ORACLE_SQL[name])
