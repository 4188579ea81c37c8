"""A search result used twice in one plan is the same both times."""

from pathlib import Path

import pytest
from compare import SF
from pyspark.sql import functions as F

from fathomline.operators import search
from fathomline.plans import reference

pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no tables here")


def test_fused_legs_used_twice(spark):
    fused = search.fuse(list(reference._legs(spark, SF, 20)), 20)
    lists = fused.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("collection", "rank", "chunk_id", "score"))).alias("l"))
    few = fused.filter("rank <= 5").groupBy("qid").agg(F.count("*").alias("n"))
    many = fused.groupBy("qid").agg(F.count("*").alias("m"))
    both = {r.qid: r.l for r in many.join(few, "qid").join(lists, "qid").collect()}
    assert both == {r.qid: r.l for r in lists.collect()} and len(both) == 160
