"""Landed rows of chat and of assistant sessions -> what the chunkers take."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as tx
from ..functions.instants import with_instant
from .chunkers import display_name, with_mentions

#: Arguments of a tool call that are shown, and characters of each.
SHOWN_ARGUMENTS, SHOWN_CHARACTERS = 3, 60


def names(users: DataFrame) -> DataFrame:
    """(user_id, name) of users (user_id, handle, real_name, display_name)."""
    return users.select("user_id", display_name(F.col("user_id"), F.col("handle"), F.col("real_name"), F.col("display_name")).alias("name"))


def chat_lines(messages: DataFrame, users: DataFrame) -> DataFrame:
    """Each message once, with author and line (null: noise or blank); messages: msg_id, text, user_id, subtype and what else it has.

    Of a message delivered twice one counts.  users: user_id, name.
    """
    m = messages.dropDuplicates(["msg_id"])
    named = m.join(users, "user_id", "left").withColumn("author", F.coalesce("name", "user_id", F.lit("unknown"))).drop("name")
    noise = F.coalesce(F.col("subtype").isin(*tx.NOISE_SUBTYPES), F.lit(False))
    named = named.withColumn("text", F.when(~noise & (F.trim("text") != ""), F.trim("text")))
    named = with_mentions(named, "text", users, ["msg_id"])
    return named.withColumn("line", F.concat(F.lit("@"), F.col("author"), F.lit(": "), F.col("text")))


def chat_rows(messages: DataFrame, users: DataFrame) -> DataFrame:
    """chat_lines as chunkers.chat_chunks takes them: with the instant, messages without one left out, and the thread's root.

    messages: msg_id, channel_id, channel_name?, ts, text, user_id, thread_ts, reply_count, subtype.
    """
    m = with_instant(chat_lines(messages, users), "ts", "us").filter("us is not null")
    root = F.when((F.col("reply_count") > 0) | F.col("thread_ts").isNotNull(), F.coalesce("thread_ts", "ts"))
    channel = F.coalesce("channel_name", "channel_id") if "channel_name" in m.columns else F.col("channel_id")
    return m.select("channel_id", channel.alias("channel_name"), "ts", "us", "msg_id", "line", "author", root.alias("root"))


def answer(message: str | None) -> str:
    """What an assistant's message says: texts, and tool calls in short; thinking and unreadable messages say nothing."""
    try:
        content = json.loads(message).get("content") if message else None
    except (ValueError, AttributeError, RecursionError):
        return ""
    if isinstance(content, str):
        return content.strip()
    said = []
    for block in content if isinstance(content, list) else []:
        kind = block.get("type") if isinstance(block, dict) else None
        if kind == "text":
            said.append(block.get("text") or "")
        elif kind == "tool_use":
            given = block.get("input")
            shown = list(given.items())[:SHOWN_ARGUMENTS] if isinstance(given, dict) else []
            told = ", ".join(f"{k}={v[:SHOWN_CHARACTERS]!r}" if isinstance(v, str) else f"{k}=..." for k, v in shown)
            said.append(f"[tool:{block.get('name', '?')}({told})]")
    return "\n\n".join(x for x in said if isinstance(x, str) and x).strip()


@F.pandas_udf(T.StringType())
def answer_text(message: pd.Series) -> pd.Series:
    """answer() of a column: a tool's arguments come in the order of the text, which the JVM's VARIANT doesn't keep."""
    return message.map(answer)


def prompt_text(message):
    """What a user's message asks: text without tagged noise, null for results of tools and where nothing is left."""
    v = F.try_parse_json(message)
    blocks = F.try_variant_get(v, "$.content", "array<variant>")
    part = lambda b, k: F.coalesce(F.try_variant_get(b, f"$.{k}", "string"), F.lit(""))
    texts = F.transform(F.filter(blocks, lambda b: part(b, "type") == "text"), lambda b: part(b, "text"))
    result = F.exists(blocks, lambda b: part(b, "type") == "tool_result")
    plain = F.when(F.schema_of_variant(F.try_variant_get(v, "$.content", "variant")) == "STRING", F.try_variant_get(v, "$.content", "string"))
    said = F.when(blocks.isNotNull(), F.when(~result, F.array_join(texts, "\n"))).otherwise(plain)
    return F.nullif(tx.stripped(tx.without_noise(said)), F.lit(""))


def session_rows(rows: DataFrame) -> DataFrame:
    """Entries as chunkers.session_chunks takes them; rows: session_id, entry_id, entry_type, message, us and what else it has.

    Other types than user and assistant, rows without a session or a time are left out; an entry delivered again counts once.
    """
    kind = F.lower(F.trim("entry_type"))
    once = rows.filter(F.col("session_id").isNotNull() & F.col("us").isNotNull()).dropDuplicates(["session_id", "entry_id"]).withColumn("kind", kind).filter(F.col("kind").isin("user", "assistant"))
    keep = [c for c in ("cwd", "git_branch", "entry_timestamp") if c in rows.columns]
    return once.select(
        "session_id", "us", "entry_id", F.when(F.col("kind") == "user", prompt_text(F.col("message"))).alias("prompt"),
        F.when(F.col("kind") == "assistant", answer_text("message")).alias("answer"), *keep,
    )


def selected(messages: DataFrame, members: DataFrame, allowed: tuple[str, ...] = ()) -> DataFrame:
    """Messages of the allowed channels, or, where none is named, of those in members (channel_id)."""
    if allowed:
        return messages.filter(F.col("channel_id").isin(*allowed))
    return messages.join(members.select("channel_id").distinct(), "channel_id", "left_semi")


def threads(messages: DataFrame) -> DataFrame:
    """(root, channel_id, n_replies, root_id): what was replied to, with the message at its root (null where it isn't there)."""
    roots = messages.groupBy("channel_id", F.col("ts").alias("thread_ts")).agg(F.max("msg_id").alias("root_id"))
    replies = messages.filter("thread_ts is not null").groupBy("channel_id", "thread_ts").agg(F.countDistinct("msg_id").alias("n_replies"))
    return replies.join(roots, ["channel_id", "thread_ts"], "left").select(F.col("thread_ts").alias("root"), "channel_id", "n_replies", "root_id")


def newest(messages: DataFrame) -> DataFrame:
    """(channel_id, newest): the ts of each channel's newest message, as it is spelt (of equal times the last by spelling)."""
    m = with_instant(messages.select("channel_id", "ts"), "ts", "us").filter("us is not null")
    return m.groupBy("channel_id").agg(F.max_by("ts", F.struct("us", "ts")).alias("newest"))


def session_counts(rows: DataFrame) -> DataFrame:
    """One row: different sessions and entries."""
    return rows.agg(F.countDistinct("session_id").alias("n_sessions"), F.countDistinct("entry_id").alias("n_entries"))
