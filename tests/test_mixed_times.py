"""Queries over times in mixed forms read every form, not the commonest one."""

import pytest
from test_instants import us

from fathomline.plans import registry

EPOCH = us(2025, 12, 1)  # microseconds


def at(minutes):
    return EPOCH + minutes * 60_000_000


@pytest.fixture(scope="module")
def chat(spark, tmp_path_factory):
    sf = str(tmp_path_factory.mktemp("mixed"))
    rows = [
        (1, "a", f"{at(0) // 10**6}.000000"), (2, "a", str(at(20) // 10**6)), (3, "a", str(at(40) // 10**3)), (4, "a", "2025-12-01T01:00:00Z"), (5, "a", "2025-12-01T02:31:00+01:00"), (5, "a", "2025-12-01T02:31:00+01:00"),
        (6, "b", "2025-12-02T00:00:00.5Z"), (7, "b", f"{at(0) // 10**6}.000000"), (8, "b", "pending"), (9, "b", None), (10, "c", "n/a"), (11, "c", "0"),
    ]
    spark.createDataFrame(rows, "msg_id bigint, channel_id string, ts string").write.parquet(f"{sf}/slack_messages.parquet")
    return sf


def test_windows_hold_every_message_with_a_time(spark, chat):
    got = {tuple(r) for r in registry.QUERIES["win01_windows"](spark, chat).select("channel_id", "start_us", "end_us", "n").collect()}
    assert got == {("a", at(0), at(60), 4), ("a", at(91), at(91), 1), ("b", at(0), at(0), 1), ("b", us(2025, 12, 2) + 500_000, us(2025, 12, 2) + 500_000, 1)}


def test_newest_of_any_form(spark, chat):
    assert {tuple(r) for r in registry.QUERIES["agg06_newest"](spark, chat).collect()} == {("a", "2025-12-01T02:31:00+01:00"), ("b", "2025-12-02T00:00:00.5Z")}
