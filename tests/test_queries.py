"""Every registered query of the core runs, and equals its SQL where there is one."""

from pathlib import Path

import pytest
from compare import SF, same, views

from fathomline.plans import registry

pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no tables here")


@pytest.fixture(scope="module")
def con():
    return views()


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, con, name):
    if name in registry.ORACLES:
        same(con, spark, registry.QUERIES[name], registry.ORACLES[name])
    else:
        assert registry.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries()) and set(registry.QUERIES) <= set(__spark_entry__.queries())
    df = __spark_entry__.entry(spark)
    assert df.columns == ["qid", "chunk_id", "rank"] and df.count() > 0
