"""Queries of the general data problems (2, 4, 6) over the project's tables."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.instants import ABBREVIATIONS, with_source_instant
from ..functions.shared import exists, shared_dir
from ..operators.gap_tree import cut_sessions, gap_tree
from ..sources.incremental import SEEN, Ledger, due, marked, seen_edits

#: table, row id, value, source of the zone
TIMES = (
    ("jira_tickets", "row_id", "updated", "instance"),
    ("slack_messages", "msg_id", "ts", None),
    ("session_logs", "entry_id", "entry_timestamp", "host"),
    ("issues", "row_id", "updated_at", "repo"),
)
SESSION_GAP_S = 1800


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    zones = table(spark, sf_dir, "source_zones")

    def one(tab: str, key: str, value: str, source: str | None) -> DataFrame:
        rows = table(spark, sf_dir, tab).select(*dict.fromkeys(c for c in (key, value, source) if c))
        df = with_source_instant(rows, value, zones, tab, source)
        return df.filter("utc_us is not null").select(F.lit(tab).alias("tab"), F.col(key).cast("long").alias("row_id"), "utc_us")

    return reduce(DataFrame.unionByName, [one(*x) for x in TIMES])


def _message_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "slack_messages").select("msg_id", "user_id", "ts").filter("user_id is not null")
    return gap_tree(with_source_instant(rows, "ts", None, "slack_messages", None), "user_id", "utc_us", "msg_id")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut_sessions(_message_tree(spark, sf_dir), SESSION_GAP_S * 1_000_000).select(
        F.col("entity").alias("user_id"), "start_us", "end_us", "n_events"
    )


def p2_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions at several settings, all cut from one tree."""
    tree = _message_tree(spark, sf_dir)
    cuts = [cut_sessions(tree, s * 1_000_000).withColumn("gap_s", F.lit(s)) for s in (60, 600, 1800, 3600, 28800)]
    return (
        reduce(DataFrame.unionByName, cuts)
        .groupBy("gap_s")
        .agg(F.count("*").alias("n_sessions"), F.sum("n_events").alias("n_events"), F.sum("duration_us").alias("duration_us"))
    )


#: source type of sync_runs, table, source key, record key, edit time, table of the zones
VERSIONS = (
    ("slite", "slite_pages", "default", "page_id", "last_edited_at"),
    ("jira", "jira_tickets", "instance", "ticket_key", "updated"),
    ("issues", "issues", "repo", "issue_number", "updated_at"),
)
_VERSION = "source_type string, source_key string, record_key string, edit_us bigint"


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The run after the last good one, over a ledger of its own.

    Versions are landed in two folders of files, those fetched up to their source's cut-off and later ones.  A first run
    commits the files of the first folder, with the latest edit of each record as its output; the next run
    lists both, drops what the manifest holds, and compares the rest with that output.
    """
    zones, runs = table(spark, sf_dir, "source_zones"), table(spark, sf_dir, "sync_runs")

    def versions(kind: str, tab: str, source: str, key: str, edit: str) -> DataFrame:
        where = None if source == "default" else source
        df = table(spark, sf_dir, tab).select(*([where] if where else []), key, edit, "fetched_at")
        df = with_source_instant(df, edit, zones, tab, where, "edit_us")
        src = F.col(where) if where else F.lit("default")
        return df.select(F.lit(kind).alias("source_type"), src.alias("source_key"), F.col(key).cast("string").alias("record_key"), "fetched_at", "edit_us")

    home = f"{shared_dir(spark)}/due-{uuid.uuid4().hex}"
    rows = marked(reduce(DataFrame.unionByName, [versions(*v) for v in VERSIONS]), runs)
    rows.withColumn("landed", F.when(F.col("done"), "before").otherwise("after")).drop("done").write.partitionBy("landed").parquet(f"{home}/landing")
    landed = lambda *names: spark.read.schema(_VERSION).parquet(*[f"{home}/landing/landed={n}" for n in names if exists(spark, f"{home}/landing/landed={n}")] or [f"{home}/landing"])
    ledger = Ledger(spark, f"{home}/ledger")
    if exists(spark, f"{home}/landing/landed=before"):
        ledger.run({"versions": landed("before")}, lambda new: seen_edits(new["versions"]))
    seen = ledger.output(SEEN)
    found = ledger.run({"versions": landed("before", "after")}, lambda new: due(new["versions"], seen))
    return found if found is not None else spark.createDataFrame([], "source_type string, source_key string, record_key string")


# ---- the same in SQL: by forms one after another, with the zones of the database ---------------------------------

_ISO = r"'^([0-9]{4})[-/]([0-9]{2})[-/]([0-9]{2})[T ]([0-9]{2}):([0-9]{2})(?::([0-9]{2})(?:[.,]([0-9]+))?)? ?(Z|[A-Z]{3,4}|[+-][0-9]{2}:?[0-9]{2}|[A-Z][a-z]+/[A-Za-z_/]+)?(\[[A-Za-z_/]+\])?$'"
_RFC = "'^[A-Z][a-z]{2}, ([0-9]{2} [A-Z][a-z]{2} [0-9]{4} [0-9]{2}:[0-9]{2}:[0-9]{2}) (GMT|[+-][0-9]{4})$'"
_COMPACT = "'^([0-9]{8}T[0-9]{6})Z$'"
_TICKET = "'^[0-9]{2}/[A-Z][a-z]{2}/[0-9]{2} [0-9]{1,2}:[0-9]{2} (AM|PM)$'"
_NUMBER = r"'^([0-9]{1,17})(?:\.([0-9]+))?$'"
_MINUTES = "CASE z " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in ABBREVIATIONS.items()) + " END"
_AT = "epoch_us(CASE WHEN timezone({0}, (l AT TIME ZONE {0}) - INTERVAL 1 HOUR) = l THEN (l AT TIME ZONE {0}) - INTERVAL 1 HOUR ELSE l AT TIME ZONE {0} END)"


def instants_sql(tab: str, columns: str, value: str, source: str | None) -> str:
    """SELECT columns, us: the instants of a table, null where there is none."""
    zone = f"(SELECT min(zone_name) FROM source_zones s WHERE s.tab = '{tab}' AND s.source_key = t.{source})" if source else "NULL"
    ex = lambda pattern, k: f"regexp_extract(v, {pattern}, {k})"
    local = f"""CASE WHEN regexp_matches(v, {_ISO}) THEN try_strptime({ex(_ISO, 1)} || '-' || {ex(_ISO, 2)} || '-' || {ex(_ISO, 3)} || ' ' || {ex(_ISO, 4)} || ':' || {ex(_ISO, 5)} || ':' || coalesce(nullif({ex(_ISO, 6)}, ''), '00'), '%Y-%m-%d %H:%M:%S')
 WHEN regexp_matches(v, {_RFC}) THEN try_strptime({ex(_RFC, 1)}, '%d %b %Y %H:%M:%S') WHEN regexp_matches(v, {_COMPACT}) THEN try_strptime({ex(_COMPACT, 1)}, '%Y%m%dT%H%M%S')
 WHEN regexp_matches(v, {_TICKET}) THEN try_strptime(v, '%d/%b/%y %I:%M %p') END"""
    z = f"CASE WHEN regexp_matches(v, {_ISO}) THEN {ex(_ISO, 8)} WHEN regexp_matches(v, {_RFC}) THEN {ex(_RFC, 2)} WHEN regexp_matches(v, {_COMPACT}) THEN 'Z' ELSE '' END"
    digits = lambda pattern, k: f"rpad(left({ex(pattern, k)}, 6), 6, '0')::BIGINT"
    n = f"{ex(_NUMBER, 1)}::BIGINT"
    return f"""SELECT * EXCLUDE (v, own, l, z, f), CASE
 WHEN regexp_matches(v, {_NUMBER}) THEN CASE WHEN {n} = 0 THEN NULL WHEN {n} < 100000000000 THEN {n} * 1000000 + {digits(_NUMBER, 2)} WHEN {n} < 100000000000000 THEN {n} * 1000 ELSE {n} END
 WHEN l IS NULL THEN NULL WHEN z = '' AND own IS NULL THEN epoch_us(l) + f WHEN z = '' THEN {_AT.format("own")} + f
 WHEN regexp_matches(z, '^[+-]') THEN epoch_us(l) + f - (CASE WHEN z[1] = '-' THEN -1 ELSE 1 END) * (z[2:3]::BIGINT * 60 + right(z, 2)::BIGINT) * 60000000
 WHEN contains(z, '/') THEN {_AT.format("z")} + f ELSE epoch_us(l) + f - ({_MINUTES}) * 60000000::BIGINT END AS us
 FROM (SELECT *, {local} AS l, {z} AS z, CASE WHEN regexp_matches(v, {_ISO}) THEN {digits(_ISO, 7)} ELSE 0 END AS f FROM (SELECT {columns}, trim({value}) AS v, {zone} AS own FROM {tab} t))"""


_EVENTS = f"""e AS (SELECT user_id, msg_id, min(us) AS us FROM ({instants_sql("slack_messages", "msg_id, user_id", "ts", None)}) WHERE us IS NOT NULL AND user_id IS NOT NULL GROUP BY ALL),
g AS (SELECT *, us - lag(us) OVER (PARTITION BY user_id ORDER BY us, msg_id) AS gap FROM e)"""
_EDITS = (
    f"SELECT 'slite' AS source_type, 'default' AS source_key, page_id AS record_key, fetched_at, us FROM ({instants_sql('slite_pages', 'page_id, fetched_at', 'last_edited_at', None)})"
    f" UNION ALL SELECT 'jira', instance, ticket_key, fetched_at, us FROM ({instants_sql('jira_tickets', 'instance, ticket_key, fetched_at', 'updated', 'instance')})"
    f" UNION ALL SELECT 'issues', repo, issue_number::VARCHAR, fetched_at, us FROM ({instants_sql('issues', 'repo, issue_number, fetched_at', 'updated_at', 'repo')})"
)
ORACLES: dict[str, str] = {
    "p2_found": f"""WITH {_EVENTS}, s AS (SELECT *, sum(CASE WHEN gap <= 1800000000 THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY us, msg_id) AS k FROM g)
SELECT user_id, min(us) AS start_us, max(us) AS end_us, count(*) AS n_events FROM s GROUP BY user_id, k""",
    "p2_settings": f"""WITH {_EVENTS}, s AS (SELECT g.*, gap_s, sum(CASE WHEN gap <= gap_s::BIGINT * 1000000 THEN 0 ELSE 1 END) OVER (PARTITION BY user_id, gap_s ORDER BY us, msg_id) AS k
 FROM g, (SELECT unnest([60, 600, 1800, 3600, 28800])::INT AS gap_s)), c AS (SELECT gap_s, user_id, k, count(*) AS n, max(us) - min(us) AS d FROM s GROUP BY ALL)
SELECT gap_s, count(*) AS n_sessions, sum(n)::BIGINT AS n_events, sum(d)::BIGINT AS duration_us FROM c GROUP BY gap_s""",
    "p4_found": " UNION ALL ".join(f"SELECT '{tab}' AS tab, row_id, us AS utc_us FROM ({instants_sql(tab, f'{key} AS row_id', value, source)}) WHERE us IS NOT NULL" for tab, key, value, source in TIMES),
    "p6_found": f"""WITH v AS ({_EDITS}), c AS (SELECT source_type, source_key, max(committed_until) AS cut FROM sync_runs WHERE run_state = 'ok' GROUP BY ALL),
w AS (SELECT v.*, coalesce(fetched_at <= cut, FALSE) AS done FROM v LEFT JOIN c USING (source_type, source_key)),
d AS (SELECT source_type, source_key, record_key, max(us) AS seen FROM w WHERE done GROUP BY ALL)
SELECT DISTINCT source_type, source_key, record_key FROM w LEFT JOIN d USING (source_type, source_key, record_key) WHERE NOT done AND (us IS NULL OR seen IS NULL OR us > seen)""",
}
QUERIES = {"p2_found": p2_found, "p2_settings": p2_settings, "p4_found": p4_found, "p6_found": p6_found}
