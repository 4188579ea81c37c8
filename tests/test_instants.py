from datetime import datetime, timezone

import pytest

from fathomline.functions.instants import with_instant, with_source_instant


def us(*a):
    return int(datetime(*a, tzinfo=timezone.utc).timestamp()) * 1_000_000


CASES = [
    ("2025-03-30T01:30:00Z", None, us(2025, 3, 30, 1, 30)),
    ("2025-03-30 02:30:00", "Europe/Berlin", us(2025, 3, 30, 1, 30)),  # skipped: the offset before the change
    ("2025-10-26 02:30:00", "Europe/Berlin", us(2025, 10, 26, 0, 30)),  # twice: the earlier moment
    ("2025-11-02 01:30:00 America/New_York", "Asia/Tokyo", us(2025, 11, 2, 5, 30)),
    ("2025-03-16T12:46:00+05:30[Asia/Kolkata]", "UTC", us(2025, 3, 16, 7, 16)),
    ("01/Aug/25 3:47 AM", None, us(2025, 8, 1, 3, 47)),
    ("30/Oct/25 12:05 pm", None, us(2025, 10, 30, 12, 5)),
    ("Fri, 12 Dec 2025 12:33:09 GMT", "Asia/Tokyo", us(2025, 12, 12, 12, 33, 9)),
    ("20250507T120503Z", None, us(2025, 5, 7, 12, 5, 3)),
    ("2025/03/16 12:46", "Asia/Kolkata", us(2025, 3, 16, 7, 16)),
    ("2025-10-22T03:08:54.851000999Z", None, us(2025, 10, 22, 3, 8, 54) + 851000),
    ("2025-02-25 10:10:33,294", None, us(2025, 2, 25, 10, 10, 33) + 294000),
    ("2025-10-20 07:33:33 CEST", "UTC", us(2025, 10, 20, 5, 33, 33)),
    ("2025-10-20 07:33:33 -0330", None, us(2025, 10, 20, 11, 3, 33)),
    ("2025-10-20", None, us(2025, 10, 20)),
    ("1764548281.988911", None, 1764548281988911),
    ("1764547664217", None, 1764547664217000),
    ("1743015206000001", None, 1743015206000001),
    ("0", None, None), ("", None, None), ("  ", None, None), ("n/a", None, None), ("pending", None, None), (None, None, None),
    ("2025-13-45T99:00:00Z", None, None), ("2025-02-29T00:00:00Z", None, None), ("2024-02-29T00:00:00Z", None, us(2024, 2, 29)),
    ("2025-10-20 24:00:00", None, None), ("2025-10-20 10:00:00 Mars/Base", None, None), ("2025-10-20 10:00:00", "Mars/Base", None), ("9" * 30, None, None),
]


def test_forms(spark):
    df = spark.createDataFrame([(i, v, z) for i, (v, z, _) in enumerate(CASES)], "i int, v string, z string")
    got = {r.i: r.utc_us for r in with_instant(df, "v", zone_col="z").collect()}
    assert {i: got[i] for i in got} == {i: c[2] for i, c in enumerate(CASES)}


def test_clashing_columns_ties_and_empty(spark):
    df = spark.createDataFrame([("2025-01-01T00:00:00Z", 1), ("2025-01-01T00:00:00Z", 1)], "v string, utc_us int")
    assert [r.utc_us for r in with_instant(df, "v").collect()] == [us(2025, 1, 1)] * 2
    assert with_instant(df.limit(0), "v").collect() == []


def test_zones_of_sources(spark):
    rows = spark.createDataFrame([("2025-06-01 12:00:00", "a"), ("2025-06-01 12:00:00", "b"), ("2025-06-01 12:00:00", None)], "v string, s string")
    zones = spark.createDataFrame([("t", "a", "Asia/Tokyo"), ("t", "a", "Asia/Tokyo"), ("u", "b", "Asia/Tokyo")], "tab string, source_key string, zone_name string")
    got = {r.s: r.utc_us for r in with_source_instant(rows, "v", zones, "t", "s").collect()}
    assert got == {"a": us(2025, 6, 1, 3), "b": us(2025, 6, 1, 12), None: us(2025, 6, 1, 12)}


@pytest.mark.parametrize("value", ["2025-01-01T00:00:00Z" + " " * 5, "\t2025-01-01T00:00:00Z\n"])
def test_blanks_around(spark, value):
    assert with_instant(spark.createDataFrame([(value,)], "v string"), "v").first().utc_us == us(2025, 1, 1)
