"""Timestamps in mixed forms -> one instant in UTC microseconds.

All forms are compiled into ONE regular expression, an alternation whose
branches carry named groups.  A single ``regexp_replace`` turns a value into its
components (year, month, ..., zone) in one pass; calendar ranges are then checked
and the instant is assembled with integer day arithmetic.  Everything is a JVM
expression, so a scan stays inside whole-stage code generation.

Defined results
---------------
* null, blank, a word, zero, an impossible date or an unknown zone: null.
* A bare number counts seconds, milliseconds or microseconds since 1970, by size.
* An offset or zone inside the value holds; else the zone of ``zone_col``; else UTC.
* A local time that occurs twice is the earlier moment, a skipped one is read with
  the offset before the change.
* Missing parts are zero; digits beyond microseconds are dropped.
"""

from __future__ import annotations

import functools
import re
import zoneinfo

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Zone abbreviations and their offset in minutes.
ABBREVIATIONS = {
    "UTC": 0, "GMT": 0, "UT": 0, "Z": 0, "WET": 0, "WEST": 60, "BST": 60, "CET": 60, "CEST": 120,
    "EET": 120, "EEST": 180, "MSK": 180, "IST": 330, "JST": 540, "KST": 540, "AEST": 600, "AEDT": 660,
    "ACST": 570, "ACDT": 630, "AWST": 480, "NZST": 720, "NZDT": 780, "ART": -180, "BRT": -180,
    "NST": -210, "NDT": -150, "AST": -240, "ADT": -180, "EST": -300, "EDT": -240, "CST": -360,
    "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420, "AKST": -540, "AKDT": -480, "HST": -600,
}

_MONTH = (
    "jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?"
    "|sept?(?:ember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?"
)
_MONTH_STARTS = "janfebmaraprmayjunjulaugsepoctnovdec"
_ZONE = r"(?:utc|gmt)?[+-]\d{1,2}(?::?\d{2})?|[a-z]{1,5}|[a-z]+(?:/[a-z0-9_+-]+)+"


def _time(k: str) -> str:
    """Hours, minutes and what may follow them; k is the suffix of the group names."""
    return (
        rf"(?<H{k}>\d{{1,2}}):(?<M{k}>\d{{2}})(?::(?<S{k}>\d{{2}})(?:[.,](?<f{k}>\d+))?)?"
        rf"(?:\s*(?<p{k}>am|pm)\b)?(?:\s*(?<z{k}>{_ZONE}))?(?:\s*\[(?<b{k}>[a-z0-9_+/-]+)\])?"
    )


#: suffix of the group names -> branch
_BRANCHES = {
    "n": r"(?<n>\d{1,18})(?:\.(?<nf>\d+))?",
    "a": rf"(?<ya>\d{{4}})(?<sep>[-/.])(?<ma>\d{{1,2}})\k<sep>(?<da>\d{{1,2}})(?:(?:t|\s+|,\s*){_time('a')})?",
    "b": rf"(?<yb>\d{{4}})(?<mb>\d{{2}})(?<db>\d{{2}})t(?<Hb>\d{{2}})(?<Mb>\d{{2}})(?:(?<Sb>\d{{2}})(?:[.,](?<fb>\d+))?)?(?:\s*(?<zb>{_ZONE}))?",
    "c": rf"(?:[a-z]{{3,9}},?\s+)?(?<dc>\d{{1,2}})[\s-](?<mc>{_MONTH})[\s-](?<yc>\d{{4}}|\d{{2}})(?:,?\s+{_time('c')})?",
    "d": rf"(?<dd>\d{{1,2}})/(?<md>{_MONTH})/(?<yd>\d{{4}}|\d{{2}})(?:[\s:]+{_time('d')})?",
    "e": rf"(?:[a-z]{{3,9}},?\s+)?(?<me>{_MONTH})\s+(?<de>\d{{1,2}}),?\s+(?<ye>\d{{4}})(?:,?\s+(?:at\s+)?{_time('e')})?",
}
PATTERN = r"(?i)^\s*(?:" + "|".join(_BRANCHES.values()) + r")\s*$"
_FIELDS = {
    "y": "abcde", "m": "abcde", "d": "abcde", "H": "abcde", "M": "abcde", "S": "abcde", "f": "abcde",
    "p": "acde", "z": "abcde", "b": "acde",
}
_SEP = "\u0001"
#: All groups are named, so they count in the order of their names; numbers are found faster than names.
_GROUP = {name: f"${i}" for i, name in enumerate(re.findall(r"\(\?<(\w+)>", PATTERN), 1)}
REPLACEMENT = _SEP.join(["".join(_GROUP[k + s] for s in ss) for k, ss in _FIELDS.items()] + [_GROUP["n"], _GROUP["nf"]])
_AT = {k: i for i, k in enumerate([*_FIELDS, "n", "nf"])}


@functools.cache
def zone_names() -> tuple[str, ...]:
    """Names that may be looked up (a table of a few hundred, fixed by the zone database): those the JVM knows too."""
    names = {z for z in zoneinfo.available_timezones() if "/" in z or z in ("UTC", "GMT")}
    try:
        names &= set(SparkSession.active()._jvm.java.time.ZoneId.getAvailableZoneIds())
    except AttributeError:  # a remote session has no JVM at hand
        pass
    return tuple(sorted(names))


def _components(value: Column) -> Column:
    """One pass over the value; an array of one element where nothing matches."""
    return F.split(F.regexp_replace(value, PATTERN, REPLACEMENT), _SEP, -1)


def _days(y: Column, m: Column, d: Column) -> Column:
    """Days from 1970-01-01 of a proleptic Gregorian date, integers only."""
    div = lambda a, b: F.call_function("div", a, F.lit(b))
    a = F.when(m <= 2, 1).otherwise(0)
    yy, mm = y + 4800 - a, m + 12 * a - 3
    return (d + div(153 * mm + 2, 5) + 365 * yy + div(yy, 4) - div(yy, 100) + div(yy, 400) - 32045 - 2440588).cast("long")


def _month_days(y: Column, m: Column) -> Column:
    leap = ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)
    return F.when(m.isin(4, 6, 9, 11), 30).when(m == 2, F.when(leap, 29).otherwise(28)).otherwise(31)


def with_instant(df: DataFrame, value_col: str, out: str = "utc_us", zone_col: str | None = None) -> DataFrame:
    """Adds ``out`` (BIGINT, null where value_col names no moment) to df.

    Repeated rows stay repeated; the columns ``__i_*`` are used on the way and dropped,
    columns of df keep their names.
    """
    keep = df.columns
    c, f, h, v = "__i_c", "__i_f", "__i_h", "__i_us"
    raw = F.col(f"`{value_col}`").cast("string")
    # explode(array(x)) computes x once: neither a filter nor a projection above copies it below.
    df = df.select("*", F.explode(F.array(_components(raw))).alias(c))
    ok = F.size(c) == len(_AT)
    at = lambda k: F.when(ok, F.col(c)[_AT[k]])
    # the expression lets digits through only; an empty group isn't cast, as a cast that fails costs more than all the rest
    num = lambda k, kind="int": F.when(at(k) != "", at(k).cast(kind))
    name = F.lower(F.substring(at("m"), 1, 3))
    month = F.when(F.length(name) == 3, F.floor((F.instr(F.lit(_MONTH_STARTS), name) - 1) / 3).cast("int") + 1).otherwise(num("m"))
    year = F.when(F.length(at("y")) == 2, num("y") + 2000).otherwise(num("y"))
    part = lambda k: F.when(at(k) == "", 0).otherwise(num(k))
    df = df.select(
        "*",
        F.struct(
            year.alias("y"), month.alias("m"), num("d").alias("d"), part("H").alias("hh"), part("M").alias("mi"), part("S").alias("ss"),
            F.rpad(F.substring(at("f"), 1, 6), 6, "0").cast("int").alias("f"), F.lower(at("p")).alias("p"),
            F.when(at("z") != "", at("z")).when(at("b") != "", at("b")).alias("z"),
            num("n", "bigint").alias("n"), F.rpad(F.substring(at("nf"), 1, 6), 6, "0").cast("int").alias("nf"),
        ).alias(f),
    )
    df = df.withColumn(f, F.explode(F.array(F.col(f))))
    g = lambda k: F.col(f)[k]
    y, m, d, H, M, S, n = (g(k) for k in ("y", "m", "d", "hh", "mi", "ss", "n"))  # noqa: N806
    pm = g("p")
    hour = F.when(pm == "", H).when((H >= 1) & (H <= 12), H % 12 + F.when(pm == "pm", 12).otherwise(0))
    valid = (y >= 1) & m.between(1, 12) & (d >= 1) & (d <= _month_days(y, m)) & hour.between(0, 23) & (M <= 59) & (S <= 59)
    local = F.when(valid, ((_days(y, m, d) * 24 + hour) * 60 + M) * 60000000 + S.cast("long") * 1000000 + F.coalesce(g("f"), F.lit(0)))
    z = g("z")
    off = r"(?i)^(?:utc|gmt)?([+-])(\d{1,2}):?(\d{2})?$"
    offset = F.split(F.regexp_replace(z, off, f"$1{_SEP}$2{_SEP}$3"), _SEP, -1)
    own = F.coalesce(F.col(f"`{zone_col}`").cast("string"), F.lit("UTC")) if zone_col else F.lit("UTC")
    # another barrier: the local time and the parts of the offset are computed once, whatever the zone is
    df = df.select("*", F.explode(F.array(F.struct(local.alias("local"), offset.alias("o"), z.alias("z"), own.alias("own"), n.alias("n"), g("nf").alias("nf")))).alias(h)).drop(c, f)
    k = lambda name: F.col(h)[name]
    local, z, own, n, o = k("local"), k("z"), k("own"), k("n"), k("o")
    oh, om = o[1].cast("int"), F.when(o[2] != "", o[2].cast("int")).otherwise(0)
    shifted = F.when((oh <= 18) & (om <= 59), local - (oh * 60 + om) * F.when(o[0] == "-", -60000000).otherwise(60000000).cast("long"))
    fixed = F.create_map(*[F.lit(x) for kv in ABBREVIATIONS.items() for x in kv])[F.upper(z)]
    by_zone = lambda zone: F.when(zone.isin(*zone_names()), F.unix_micros(F.to_utc_timestamp(F.timestamp_micros(local), zone)))
    of_local = (
        F.when(local.isNull(), None)
        .when(F.size(o) == 3, shifted)
        .when(z.contains("/"), by_zone(z))
        .when(z.isNotNull(), local - fixed.cast("long") * 60000000)
        .when(own == "UTC", local)
        .otherwise(by_zone(own))
    )
    frac = F.coalesce(k("nf"), F.lit(0)).cast("long")
    of_number = (
        F.when((n == 0) & (frac == 0), None)
        .when(n < 100_000_000_000, n * 1_000_000 + frac)
        .when(n < 100_000_000_000_000, n * 1_000 + F.call_function("div", frac, F.lit(1000)))
        .when(n < 100_000_000_000_000_000, n)
    )
    df = df.select("*", F.explode(F.array(F.when(n.isNotNull(), of_number).otherwise(of_local))).alias(v))
    return df.select(*[F.col(f"`{x}`") for x in keep if x != out], F.col(v).alias(out))


def source_zones(zones: DataFrame, tab: str, key: str = "__zone_key", zone: str = "__zone") -> DataFrame:
    """One zone for each source of a table; of several the first by name."""
    return zones.filter((F.col("tab") == tab) & F.col("zone_name").isNotNull()).groupBy(F.col("source_key").alias(key)).agg(F.min("zone_name").alias(zone))


def with_source_instant(df: DataFrame, value_col: str, zones: DataFrame | None, tab: str, source_col: str | None, out: str = "utc_us") -> DataFrame:
    """with_instant with the zone of the row's source (repo, instance, host), UTC where the source has none.

    The table of zones is joined without a hint: Spark broadcasts it by its measured
    size and sorts or splits it where it has grown.
    """
    if zones is None or source_col is None:
        return with_instant(df, value_col, out)
    z = source_zones(zones, tab)
    joined = df.join(z, F.col(f"`{source_col}`") == F.col("__zone_key"), "left").drop("__zone_key")
    return with_instant(joined, value_col, out, "__zone").drop("__zone")
