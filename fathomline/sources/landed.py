"""Records as services send them -> the rows that the engine's syncs take.

Values are JSON texts (``paged_api``, or any table with a column value and the source's name);
missing keys are nulls, a text that isn't JSON is no record.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_USER = "user STRUCT<login: STRING>"
_SAID = f"ARRAY<STRUCT<body: STRING, {_USER}, created_at: STRING, path: STRING>>"
_LABELS = "labels ARRAY<STRUCT<name: STRING>>"
ISSUE = f"number INT, title STRING, body STRING, state STRING, {_USER}, {_LABELS}, created_at STRING, updated_at STRING, pull_request STRING, comments_list {_SAID}"
CHANGE = f"number INT, title STRING, body STRING, state STRING, {_USER}, {_LABELS}, merged_at STRING, updated_at STRING, files ARRAY<STRUCT<filename: STRING, status: STRING, patch: STRING>>, comments {_SAID}"
_NAMED = "STRUCT<name: STRING>"
_PERSON = "STRUCT<displayName: STRING>"
TICKET = (
    f"key STRING, fields STRUCT<summary: STRING, description: STRING, status: {_NAMED}, issuetype: {_NAMED}, priority: {_NAMED}, reporter: {_PERSON}, assignee: {_PERSON}, labels: ARRAY<STRING>, created: STRING, updated: STRING, "
    f"comment: STRUCT<comments: ARRAY<STRUCT<author: {_PERSON}, body: STRING, created: STRING>>>>"
)
PAGE = "id STRING, title STRING, url STRING, updatedAt STRING, lastEditedAt STRING, content STRING, status INT"
MESSAGE = "ts STRING, text STRING, user STRING, thread_ts STRING, reply_count INT, subtype STRING"
USER = "id STRING, name STRING, real_name STRING, profile STRUCT<display_name: STRING>"


def _read(values: DataFrame, schema: str, key: str) -> DataFrame:
    v = F.from_json("value", schema)
    return values.select(*[c for c in values.columns if c != "value"], F.explode(F.array(v)).alias("v")).filter(F.col(f"v.{key}").isNotNull())


def issues(values: DataFrame, source: str) -> tuple[DataFrame, DataFrame]:
    """(issues, comments) as Engine.sync_issues takes them; source: the column with the repository."""
    r = _read(values, ISSUE, "number").withColumn("repo", F.col(source))
    flat = r.select(
        "repo", F.col("v.number").alias("issue_number"), "v.title", "v.body", F.col("v.state").alias("issue_state"), F.col("v.user.login").alias("author_login"), F.transform("v.labels", lambda x: x["name"]).alias("labels"),
        "v.created_at", "v.updated_at", "v.pull_request",
    )
    said = r.select("repo", F.col("v.number").alias("issue_number"), F.posexplode("v.comments_list").alias("pos", "c"))
    return flat, said.select("repo", "issue_number", "pos", F.col("c.user.login").alias("user"), "c.body", "c.created_at")


def changes(values: DataFrame, source: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(change requests, files, comments) as Engine.sync_changes takes them."""
    r = _read(values, CHANGE, "number").withColumn("repo", F.col(source)).withColumn("pr_number", F.col("v.number"))
    flat = r.select("repo", "pr_number", "v.title", "v.body", "v.state", F.col("v.user.login").alias("author"), F.transform("v.labels", lambda x: x["name"]).alias("labels"), "v.merged_at", "v.updated_at")
    files = r.select("repo", "pr_number", F.posexplode("v.files").alias("file_pos", "f")).select("repo", "pr_number", "file_pos", "f.filename", "f.status", "f.patch")
    said = r.select("repo", "pr_number", F.posexplode("v.comments").alias("pos", "c")).select("repo", "pr_number", "pos", F.col("c.user.login").alias("user"), "c.path", "c.body")
    return flat, files, said


def tickets(values: DataFrame, source: str) -> tuple[DataFrame, DataFrame]:
    """(tickets, comments) as Engine.sync_tickets takes them; source: the column with the instance. Document trees stay JSON."""
    r = _read(values, TICKET, "key").withColumn("instance", F.col(source)).withColumn("ticket_key", F.col("v.key"))
    f = lambda name, as_=None: F.col(f"v.fields.{name}").alias(as_ or name)
    flat = r.select(
        "instance", "ticket_key", f("summary"), f("description"), f("status.name", "ticket_status"), f("issuetype.name", "ticket_type"), f("reporter.displayName", "reporter"), f("assignee.displayName", "assignee"),
        f("priority.name", "priority"), f("labels"), f("created"), f("updated"),
    )
    said = r.select("instance", "ticket_key", F.posexplode("v.fields.comment.comments").alias("pos", "c"))
    return flat, said.select("instance", "ticket_key", "pos", F.col("c.author.displayName").alias("author"), "c.body", "c.created")


def pages(values: DataFrame) -> DataFrame:
    """Pages as Engine.sync_pages takes them."""
    r = _read(values, PAGE, "id")
    return r.select(F.col("v.id").alias("page_id"), "v.title", "v.url", F.coalesce("v.lastEditedAt", F.lit("")).alias("last_edited_at"), F.col("v.updatedAt").alias("updated_at"), "v.content", "v.status")


def messages(values: DataFrame, source: str) -> DataFrame:
    """Messages as Engine.sync_chat takes them; source: the column with the channel. A message is known by channel and ts."""
    r = _read(values, MESSAGE, "ts")
    key = F.xxhash64(F.col(source), F.col("v.ts"))
    return r.select(key.alias("msg_id"), F.col(source).alias("channel_id"), "v.ts", "v.text", F.col("v.user").alias("user_id"), "v.thread_ts", "v.reply_count", "v.subtype")


def users(values: DataFrame) -> DataFrame:
    """People as Engine.sync_chat takes them."""
    return _read(values, USER, "id").select(F.col("v.id").alias("user_id"), F.col("v.name").alias("handle"), "v.real_name", F.col("v.profile.display_name").alias("display_name"))


def session_entries(lines: DataFrame) -> DataFrame:
    """Entries as Engine.sync_sessions takes them, out of files.json_lines: a file is a session, its folder the project.

    The order of the lines is the order of the session; times are kept for display.
    """
    v = lambda path, kind="string": F.try_variant_get("entry", f"$.{path}", kind)
    name = F.regexp_extract("file", r"([^/]+)\.[^./]+$", 1)
    rows = lines.select(
        name.alias("session_id"), F.regexp_extract("file", r"([^/]+)/[^/]+$", 1).alias("folder"), (F.col("block") + 1).alias("block"), "line_no", v("type").alias("entry_type"),
        F.to_json(v("message", "variant")).alias("message"), v("timestamp").alias("entry_timestamp"), v("cwd").alias("cwd"), v("gitBranch").alias("git_branch"),
    )
    # one number that grows along the file: its place among the lines of the session
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("session_id").orderBy("block", "line_no")).cast("bigint")
    return rows.withColumn("entry_id", place).withColumn("us", place).drop("block", "line_no")
