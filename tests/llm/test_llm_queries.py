"""Every registered training-data query runs, and equals its SQL where there is one."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
queries = pytest.importorskip("fathomline.llm.queries")
from compare import SF, same, views  # noqa: E402

pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no tables here")


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, name):
    if name in queries.ORACLES:
        same(views(), spark, queries.QUERIES[name], queries.ORACLES[name])
    else:
        assert queries.QUERIES[name](spark, SF).count() > 0
