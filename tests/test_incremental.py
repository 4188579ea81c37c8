import pytest
from pyspark.sql import functions as F

from fathomline.sources.incremental import SEEN, Ledger, due, due_records, seen_edits


def test_a_run_that_dies_is_repeated_and_nothing_twice(spark, tmp_path):
    data, state = f"{tmp_path}/in", f"{tmp_path}/state"
    spark.range(10).write.parquet(data)
    ledger = Ledger(spark, state)
    read = lambda: {"t": spark.read.parquet(data)}
    work = lambda new: new["t"].select(F.col("id") * 2)

    def die():
        raise RuntimeError("killed")

    with pytest.raises(RuntimeError):
        ledger.run(read(), work, before_commit=die)
    assert ledger.manifest().count() == 0
    assert ledger.run(read(), work).count() == 10
    assert ledger.run(read(), work) is None  # nothing new
    spark.range(10, 13).write.mode("append").parquet(data)
    assert ledger.run(read(), work).count() == 3
    # a file with content that was processed under the same path is no news
    total = spark.read.parquet(f"{state}/output").count()
    assert total == 13


def test_due(spark):
    t = "timestamp_ntz'2025-01-0{} 00:00:00'"
    rows = spark.sql(
        " union all ".join(
            f"select '{s}' source_type, {k} source_key, {r} record_key, {t.format(d)} fetched_at, cast({e} as bigint) edit_us"
            for s, k, r, d, e in [
                ("a", "'x'", "'same'", 1, 10), ("a", "'x'", "'same'", 3, 10), ("a", "'x'", "'newer'", 1, 10), ("a", "'x'", "'newer'", 3, 11),
                ("a", "'x'", "'unread'", 1, 10), ("a", "'x'", "'unread'", 3, "null"), ("a", "'x'", "'first'", 3, 5), ("a", "'x'", "'done'", 2, 5),
                ("a", "'x'", "'blank'", 1, "null"), ("a", "'x'", "'blank'", 3, 1), ("a", "'none'", "'any'", 1, 1), ("a", "'x'", "null", 3, 1), ("a", "'x'", "'newer'", 3, 11),
            ]
        )
    )
    runs = spark.sql(
        f"select 'a' source_type, 'x' source_key, 'ok' run_state, {t.format(2)} committed_until union all select 'a', 'x', 'failed', {t.format(9)} union all select 'a', 'none', 'failed', {t.format(9)} union all select 'a', 'x', 'ok', {t.format(1)}"
    )
    rows = rows.withColumn("cutoff", F.lit("clash")).withColumn("done", F.lit(1))
    assert sorted(r.record_key for r in due_records(rows, runs).collect()) == ["any", "blank", "first", "newer", "unread"]
    assert due_records(rows.limit(0), runs).count() == 0
    assert due_records(rows, runs.limit(0)).count() == 7


def test_a_file_that_arrives_after_a_crash_repeats_nothing(spark, tmp_path):
    data, ledger = f"{tmp_path}/in", Ledger(spark, f"{tmp_path}/state")
    spark.range(10).write.parquet(data)
    read = lambda: {"t": spark.read.parquet(data)}
    work = lambda new: new["t"].select("id")

    def die():
        raise RuntimeError("killed")

    with pytest.raises(RuntimeError):
        ledger.run(read(), work, before_commit=die)
    assert ledger.output("id bigint").count() == 0  # what a dead run wrote isn't read
    spark.range(10, 13).write.mode("append").parquet(data)
    ledger.run(read(), work)
    assert spark.read.parquet(f"{tmp_path}/state/output").count() == 13
    assert sorted(r.id for r in ledger.output("id bigint").collect()) == list(range(13))
    assert ledger.run(read(), work) is None and len(ledger.committed()) == 1
    spark.range(13, 15).write.mode("append").parquet(data)
    assert ledger.run(read(), work).count() == 2 and ledger.output("id bigint").count() == 15


def test_only_files_outside_the_manifest_are_worked_on(spark, tmp_path):
    """Two batches: what the first has committed decides on what the second takes."""
    versions = [("a", "x", "old", 5, True), ("a", "x", "new", 5, True), ("a", "x", "new", 6, False), ("a", "x", "late", 5, True), ("a", "x", "late", 4, False)]
    df = spark.createDataFrame(versions, "source_type string, source_key string, record_key string, edit_us bigint, done boolean")
    df.filter("done").drop("done").write.parquet(f"{tmp_path}/in")
    ledger, read = Ledger(spark, f"{tmp_path}/state"), lambda: {"v": spark.read.parquet(f"{tmp_path}/in")}
    ledger.run(read(), lambda new: seen_edits(new["v"]))
    df.filter("not done").drop("done").write.mode("append").parquet(f"{tmp_path}/in")
    seen, taken = ledger.output(SEEN), []
    found = ledger.run(read(), lambda new: taken.append(new["v"].count()) or due(new["v"], seen))
    assert taken == [2] and [r.record_key for r in found.collect()] == ["new"]
