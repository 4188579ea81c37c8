"""Makes the package importable on every executor."""

from __future__ import annotations

import functools
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_PACKAGE = Path(__file__).resolve().parent


@functools.cache
def _archive() -> str:
    """The package as a zip, written once by the driver; Spark's file server gives it to the executors."""
    target = Path(tempfile.mkdtemp(prefix="fathomline-")) / "fathomline.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(_PACKAGE.rglob("*.py")):
            z.write(p, p.relative_to(_PACKAGE.parent))
    return str(target)


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """The package once for each application, and a setting for each session.

    Spark 4.1 takes a union of two equally partitioned tables as partitioned like them, and so leaves out the shuffle before an
    aggregate; where both exchanges are reused the rows of a key don't meet, and sums come out in parts (tests/test_union.py).
    """
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        spark.sparkContext.addPyFile(_archive())
        _shipped.add(app)
