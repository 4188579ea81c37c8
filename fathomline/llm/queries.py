"""Queries of the training-data problems and the SQL beside them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.instants import with_source_instant
from ..plans.problems import instants_sql
from . import cuts
from .conversations import conversations
from .cuts import flagged, share
from .documented import functions, pairs
from .handwritten import not_by_hand
from .leaks import find_leaks
from .personal import Lexicon, find_places, learn, redact
from .tokens import encode


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _code(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "chunks").filter("collection = 'code_chunks'")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return functions(_code(spark, sf_dir), "chunk_id", "text", "metadata", "file_path")


def p1_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs(_code(spark, sf_dir), "chunk_id", "text", "metadata", "file_path")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p3_reasons(spark, sf_dir).select("repo", "file_path")


def p3_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return not_by_hand(table(spark, sf_dir, "file_hashes"), _code(spark, sf_dir))


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(tab, row_key, text) of the three tables with free text."""
    keys = {"documents": "doc_id", "slack_messages": "msg_id", "chunks": "chunk_id"}
    one = lambda tab, key: table(spark, sf_dir, tab).select(F.lit(tab).alias("tab"), F.col(key).cast("string").alias("row_key"), "text")
    return reduce(DataFrame.unionByName, [one(*x) for x in keys.items()])


def _lexicon(spark: SparkSession, sf_dir: str, texts: DataFrame) -> Lexicon:
    jira = table(spark, sf_dir, "jira_tickets")
    return learn(texts, [table(spark, sf_dir, "slack_users").select("real_name"), jira.select("reporter").distinct(), jira.select("assignee").distinct()])


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = _texts(spark, sf_dir)
    return find_places(texts, _lexicon(spark, sf_dir, texts))


def p5_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = _texts(spark, sf_dir)
    return redact(texts, _lexicon(spark, sf_dir, texts))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "session_logs").select("session_id", "entry_id", "entry_type", "message", "entry_timestamp", "host")
    timed = with_source_instant(rows, "entry_timestamp", table(spark, sf_dir, "source_zones"), "session_logs", "host")
    return conversations(timed, "session_id", "entry_id", "entry_type", "message", "utc_us")


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"), "doc_id", "text")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "benchmark"), "item_id", "text")


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = flagged(table(spark, sf_dir, "documents"), "doc_id", "text", "source")
    return marked.filter("cut").select(F.col("key").alias("doc_id"))


def p10_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return share(flagged(table(spark, sf_dir, "documents"), "doc_id", "text", "source"))


QUERIES: dict = {"p1_found": p1_found, "p1_pairs": p1_pairs, "p3_found": p3_found, "p3_reasons": p3_reasons, "p5_found": p5_found, "p5_redacted": p5_redacted, "p7_found": p7_found, "p8_ids": p8_ids, "p9_found": p9_found, "p10_found": p10_found, "p10_share": p10_share}
_Q = lambda x: "'" + x.replace("'", "''") + "'"
_P7 = rf"""
WITH t AS (SELECT DISTINCT session_id, entry_id, kind, m, us FROM (
  SELECT *, lower(trim(entry_type)) AS kind, CASE WHEN json_valid(message) THEN message END AS m FROM ({instants_sql("session_logs", "session_id, entry_id, entry_type, message", "entry_timestamp", "host")}))
  WHERE session_id IS NOT NULL AND entry_id IS NOT NULL AND kind IN ('user', 'assistant')),
p AS (SELECT *, CASE json_type(m, '$.content') WHEN 'VARCHAR' THEN json_extract_string(m, '$.content') WHEN 'ARRAY' THEN
  CASE WHEN list_contains(json_extract_string(m, '$.content[*].type'), 'tool_result') THEN NULL ELSE
  array_to_string(list_transform(list_filter(json_extract(m, '$.content[*]'), lambda b: json_extract_string(b, '$.type') = 'text'), lambda b: coalesce(json_extract_string(b, '$.text'), '')), chr(10)) END END AS said FROM t),
w AS (SELECT *, coalesce(regexp_matches(regexp_replace(regexp_replace(said, '(?s)<system-reminder\b[^>]*>.*?</system-reminder>', '', 'g'), '(?s)<local-command-[A-Za-z0-9-]+[^>]*>.*?</local-command-[A-Za-z0-9-]+>', '', 'g'), '\S'), FALSE) AS words,
  m IS NULL OR us IS NULL OR coalesce(lower(trim(json_extract_string(m, '$.role'))) <> kind, TRUE) AS bad FROM p),
k AS (SELECT session_id, entry_id, kind, us, lag(kind) OVER o AS before, lead(kind) OVER o AS after FROM w WHERE words WINDOW o AS (PARTITION BY session_id ORDER BY us, entry_id)),
keep AS (SELECT session_id FROM k GROUP BY 1 HAVING NOT bool_or((before IS NULL AND kind <> 'user') OR (kind = 'user' AND coalesce(after <> 'assistant', TRUE))))
SELECT session_id, (sum(CASE WHEN before = kind THEN 0 ELSE 1 END) OVER (PARTITION BY session_id ORDER BY us, entry_id))::INT AS turn_no, kind AS speaker, entry_id FROM k
WHERE session_id IN (SELECT session_id FROM keep) AND session_id NOT IN (SELECT session_id FROM w WHERE bad)"""
_END = "[.!?。！？…．؟।][\"'”’»」』)\\]*_`~]*$"
_CUTS = f"""
WITH d AS (SELECT doc_id, source, text, regexp_replace(text, {_Q(f"[\\s\u200b\ufeff]+$")}, '') AS t FROM documents WHERE regexp_matches(text, {_Q("[^\\s\u200b\ufeff]")})),
l AS (SELECT *, trim(split_part(replace(t, chr(13), chr(10)), chr(10), -1)) AS last FROM d),
s AS (SELECT doc_id, source, length(text) AS chars, strlen(text) AS bytes, text, CASE WHEN regexp_matches(t, {_Q(cuts.MARK)}) THEN 'mark' WHEN suffix(t, chr(65533)) THEN 'broken'
  WHEN ((length(t) - length(replace(t, '```', ''))) // 3) % 2 = 1 THEN 'open' WHEN regexp_matches(t, {_Q(cuts.DOTS)}) THEN 'dots' WHEN regexp_matches(t, {_Q(_END)}) THEN 'end'
  WHEN prefix(last, '|') AND NOT suffix(last, '|') THEN 'open' WHEN regexp_matches(last, {_Q(cuts.CHAT)}) THEN 'chat' WHEN regexp_matches(last, {_Q(cuts.LINE.replace("}+", "}"))}) THEN 'line' ELSE 'prose' END AS shape FROM l),
h AS (SELECT source, unit, n, count(DISTINCT text) AS texts FROM (SELECT source, text, 'chars' AS unit, chars AS n FROM s WHERE shape <> 'broken' UNION ALL SELECT source, text, 'bytes', bytes FROM s WHERE shape <> 'broken') GROUP BY ALL),
p AS (SELECT source, unit, max(n) AS top, arg_max(texts, n) AS at_top FROM h GROUP BY ALL),
b AS (SELECT p.*, coalesce((SELECT sum(texts) FROM h WHERE h.source IS NOT DISTINCT FROM p.source AND h.unit = p.unit AND n < top AND n >= top * 0.8), 0) / greatest(top * 0.2, 1) AS usual FROM p),
m AS (SELECT source, max(top) FILTER (unit = 'chars') AS mc, max(top) FILTER (unit = 'bytes') AS mb FROM b WHERE at_top >= {cuts.LEAST} AND at_top >= {cuts.PEAK} * usual GROUP BY 1),
f AS (SELECT s.*, coalesce(chars = mc, FALSE) OR coalesce(bytes = mb, FALSE) AS at_limit FROM s LEFT JOIN m ON m.source IS NOT DISTINCT FROM s.source),
c AS (SELECT *, shape IN ('mark', 'broken', 'open', 'prose') OR (at_limit AND shape IN ('dots', 'line', 'chat')) AS cut FROM f)"""
ORACLES: dict[str, str] = {
    "p7_found": _P7,
    "p10_found": f"{_CUTS} SELECT doc_id FROM c WHERE cut",
    "p10_share": f"{_CUTS} SELECT source, count(*) AS n_texts, count(*) FILTER (cut) AS n_cut, count(*) FILTER (cut AND at_limit) AS n_at_limit, round(count(*) FILTER (cut) / count(*), 6) AS share_cut FROM c GROUP BY 1",
}
