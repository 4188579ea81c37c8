"""Ordered runs within keys, cut at flags or gaps, without putting a hot key into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def segments(df: DataFrame, keys: list[str], order: list[str], bucket: str, gap: tuple[str, int] | None = None, flag: str | None = None) -> DataFrame:
    """Adds rn, the row's number within keys, and break_rn, that of the last row that begins a segment.

    A row begins one if flag is true, or if gap = (column, most) and the column is more than
    ``most`` above that of the row before; with gap the first row of a key begins one too.
    break_rn is null before the first flag.

    bucket must not decrease along the order (a day of the time, say).  Windows run within
    (keys, bucket) only; one row for each bucket carries numbers and last values on to the next.
    """
    inner = Window.partitionBy(*keys, bucket).orderBy(*order)
    df = df.withColumn("__n", F.row_number().over(inner))
    if gap:
        column, most = gap
        df = df.withColumn("__prev", F.lag(column).over(inner))
        inside: Column = F.coalesce(F.col(column) - F.col("__prev") > most, F.lit(False))
        sums = [F.min(column).alias("__first"), F.max(column).alias("__last")]
    else:
        inside, sums = F.coalesce(F.col(flag), F.lit(False)), []
    df = df.withColumn("__cut", inside)
    per = df.groupBy(*keys, bucket).agg(F.count("*").alias("__rows"), F.max(F.when(F.col("__cut"), F.col("__n"))).alias("__cut_n"), *sums)
    along = Window.partitionBy(*keys).orderBy(bucket)
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("__off", F.coalesce(F.sum("__rows").over(before), F.lit(0)))
    if gap:
        per = per.withColumn("__head", F.coalesce(F.col("__first") - F.lag("__last").over(along) > gap[1], F.lit(True)))
        last = F.coalesce(F.col("__cut_n"), F.when(F.col("__head"), F.lit(1)))
    else:
        per = per.withColumn("__head", F.lit(False))
        last = F.col("__cut_n")
    per = per.withColumn("__carry", F.max(F.col("__off") + last).over(before))
    joined = df.join(per.select(*keys, bucket, "__off", "__head", "__carry"), [*keys, bucket])
    begins = F.col("__cut") | (F.col("__head") & (F.col("__n") == 1))
    rn = F.col("__off") + F.col("__n")
    own = F.max(F.when(begins, rn)).over(Window.partitionBy(*keys, bucket).orderBy("__n"))
    out = joined.withColumn("rn", rn).withColumn("break_rn", F.coalesce(own, F.col("__carry")))
    return out.drop("__n", "__prev", "__cut", "__off", "__head", "__carry")


DAY_US = 86_400_000_000


def gap_windows(df: DataFrame, keys: list[str], us: str, tie: str, gap_s: int, cap: int) -> DataFrame:
    """Adds window, the number within keys of the row that begins it: a window ends at a gap above gap_s or at cap rows."""
    days = df.withColumn("__day", F.floor(F.col(us) / DAY_US).cast("bigint"))
    cut = segments(days, keys, [us, tie], "__day", gap=(us, gap_s * 1_000_000))
    return cut.withColumn("window", F.col("break_rn") + cap * F.floor((F.col("rn") - F.col("break_rn")) / cap)).drop("rn", "break_rn", "__day")


def tie_safe(df: DataFrame, keys: list[str], time: str) -> DataFrame:
    """Adds commits: a run that stops after this row may move its cursor to the row's time.

    True for the last row of each time; a blank time never commits and isn't sorted: such
    rows stay where they are.  Rows meet by key and time, so a key of any size is spread over its times.
    """
    timed = F.coalesce(F.col(time), F.lit("")) != ""
    order = [c for c in df.columns if c not in keys and c != time]
    # of one time the greatest row commits; of equal rows one
    last = df.filter(timed).groupBy(*keys, time).agg(F.max(F.struct(*order)).alias("__last"))
    at = Window.partitionBy(*keys, time, *order).orderBy(F.lit(1))
    ranked = df.filter(timed).withColumn("__k", F.row_number().over(at)).join(last, [*keys, time], "left")
    marked = ranked.withColumn("commits", F.struct(*order).eqNullSafe(F.col("__last")) & (F.col("__k") == 1)).drop("__k", "__last")
    return marked.unionByName(df.filter(~timed).withColumn("commits", F.lit(False)))


def sweep(items: DataFrame, key: str, time: str, status: str) -> tuple[DataFrame, DataFrame]:
    """(items taken, one row with the cursor) of a sweep in order of time, blank times first.

    status: null or below 400: fetched; 429 and from 500: the service is to be left alone, the sweep
    ends before; other: this item is given up.  The cursor may stand at the time of an item that was
    fetched and after which a later time comes, or nothing; a blank time is always taken and never moves it.
    """
    at = F.struct(F.coalesce(F.col(time), F.lit("")).alias("t"), F.col(key).cast("string").alias("k"))
    code = F.coalesce(F.col(status), F.lit(200))
    rows = items.withColumn("__at", at).withColumn("__ok", code < 400)
    end = rows.filter((code == 429) | (code >= 500)).agg(F.min("__at").alias("e")).first()["e"]  # one place
    before = rows.withColumn("__in", F.lit(True) if end is None else F.col("__at") < F.struct(F.lit(end["t"]).alias("t"), F.lit(end["k"]).alias("k")))
    taken = before.filter("__in and __ok").drop("__at", "__ok", "__in")
    whole = before.filter(F.col("__at.t") != "").groupBy("__at.t").agg(F.min("__in").alias("all"), F.max_by("__ok", "__at").alias("last"))
    return taken, whole.filter("all and last").agg(F.max("t").alias("cursor"))
