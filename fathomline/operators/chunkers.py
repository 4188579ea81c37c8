"""Documents, change requests, issues, tickets and chat -> chunks."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import CHARS_PER_TOKEN
from ..functions.text import CODE_MARK, adf_text, chunk_id, first_text, permalink, stripped, truncated
from .windows import gap_windows, segments

# Document suffix -> language; only markdown has sections.
DOCUMENTS = {".md": "markdown", ".mdx": "markdown", ".txt": "text", ".rst": "rst", ".html": "html", ".adoc": "asciidoc"}
_HEADING = re.compile(r"(?m)^(#{1,4})[^\S\n]+(.+)$")
_PARAGRAPH = re.compile(r"\n\s*\n")


def sections(text: str) -> list[tuple[str, str, int]]:
    """(path, content, level) of markdown; the path joins the open headings, a skipped level nests."""
    heads = list(_HEADING.finditer(text))
    starts, ends = [0, *[m.end() for m in heads]], [*[m.start() for m in heads], len(text)]
    levels, titles = [0, *[len(m[1]) for m in heads]], ["", *[m[2].strip() for m in heads]]
    out, open_ = [], ()
    for a, b, level, title in zip(starts, ends, levels, titles):
        open_ = (*open_[: level - 1], title) if level else ()
        if body := text[a:b].strip():
            out.append((" > ".join(open_) or "Document", body, level))
    return out


def paragraphs(text: str) -> list[tuple[str, str, int]]:
    """(label, content, 0) of plain text; blank paragraphs count in the labels only."""
    return [(f"Paragraph {i}", p.strip(), 0) for i, p in enumerate(_PARAGRAPH.split(text), 1) if p.strip()]


def pack(content: str, most: int, overlap: int) -> list[str]:
    """Pieces of about ``most`` characters along paragraphs, and along words where a paragraph is longer.

    Each piece begins with the last ``overlap`` characters of the one before.
    """
    if len(content) <= most:
        return [content]
    out: list[str] = []

    def grow(held: str, piece: str, joint: str) -> str:
        """held with piece; where that is too long, held is given out and its tail goes on."""
        if not held or len(held) + len(joint) + len(piece) <= most:
            return held + joint + piece if held else piece
        out.append(held.strip())
        return held[-overlap:] + joint + piece if overlap else piece

    held = ""
    for p in content.split("\n\n"):
        if len(p) <= most:
            held = grow(held, p, "\n\n")
            continue
        if held.strip():
            out.append(held.strip())
            held = ""
        rest = reduce(lambda run, word: grow(run, word, " "), p.split(" "), "")
        held = rest if rest.strip() else held
    return [*out, held.strip()] if held.strip() else out


DOC_FIELDS = "chunk_id string, section_path string, section_index int, chunk_index int, text string, entity_name string"


def document_chunks(docs: DataFrame, key: str, text: str, path: str | Column, prefix: str = "doc", max_tokens: int = 512, overlap_tokens: int = 50, markdown: bool | None = None) -> DataFrame:
    """Chunks of documents; ids hash prefix:path:section:index, the index counts through the document.

    path decides by its suffix whether there are sections (markdown overrides that).  A
    document is one row, cut where it lies, without a shuffle.  Null and blank texts: none.
    """
    most, overlap = max_tokens * CHARS_PER_TOKEN, overlap_tokens * CHARS_PER_TOKEN
    names = [key, *[f.split()[0] for f in DOC_FIELDS.split(", ")]]
    kinds = [pa.int32() if f.endswith(" int") else pa.string() for f in DOC_FIELDS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rows = [], []
            for k, (t, p) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                if not t:
                    continue
                p = p or ""
                ext = re.search(r"[^./\\](\.[^./\\]+)$", p)
                md = DOCUMENTS.get(ext[1].lower() if ext else "") == "markdown" if markdown is None else markdown
                index = 0
                for n, (label, content, _) in enumerate(sections(t) if md else paragraphs(t)):
                    for piece in pack(content, most, overlap):
                        digest = hashlib.sha256(f"{prefix}:{p}:{label}:{index}".encode()).hexdigest()[:16]
                        rows.append((digest, label, n, index, piece, label.split(" > ")[-1]))
                        at.append(k)
                        index += 1
            if rows:
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), *[pa.array(c, t) for c, t in zip(zip(*rows), kinds)]], names=names)

    path = F.col(path) if isinstance(path, str) else path
    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, F.col(text).cast("string").alias("__t"), path.cast("string").alias("__p")).mapInArrow(run, f"{key} {kind}, {DOC_FIELDS}")


def hunks(patch: Column) -> Column:
    """Array of the hunks of a unified diff; what stands before the first is one of its own. Null and '' have none."""
    parts = F.split(patch, r"\n(?=@@)")
    return F.when(patch != "", parts).otherwise(F.array().cast("array<string>"))


def change_chunks(prs: DataFrame, files: DataFrame, comments: DataFrame, max_tokens: int = 512) -> DataFrame:
    """prs: repo, pr_number, title, body; files: repo, pr_number, file_pos, filename, status, patch; comments: repo, pr_number, pos, user, path, body.

    Heads are stripped before they are cut; a file without a patch has no chunk, a comment without a user is by "unknown".
    """
    cut = lambda c: truncated(c, max_tokens, CODE_MARK)
    ids = lambda kind, i: chunk_id(F.col("repo"), F.concat(F.lit("pr"), F.col("pr_number").cast("string")), kind, i)
    head = F.concat(F.lit("# PR #"), F.col("pr_number").cast("string"), F.lit(": "), F.coalesce("title", F.lit("")), F.lit("\n\n"), F.coalesce("body", F.lit("")))
    out = ["chunk_id", "collection", "repo", "pr_number", "chunk_type", "file_path", "reviewer", "text"]
    none = F.lit(None).cast("string")
    about = prs.withColumns({"chunk_id": ids("description", F.lit(0)), "collection": F.lit("pr_diffs"), "chunk_type": F.lit("description"), "file_path": F.lit(""), "reviewer": none, "text": cut(stripped(head))}).select(*out)
    each = files.select("repo", "pr_number", "file_pos", "filename", "status", F.posexplode(hunks(F.col("patch"))).alias("hunk_pos", "hunk"))
    # the index of a hunk within its change request; a change request is small, so the window's groups are
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("repo", "pr_number").orderBy("file_pos", "hunk_pos")) - 1
    body = F.concat(F.lit("File: "), F.col("filename"), F.lit(" ("), F.coalesce("status", F.lit("modified")), F.lit(")\n"), F.col("hunk"))
    diffs = each.withColumn("n", n).withColumns({"chunk_id": ids("diff", F.col("n")), "collection": F.lit("pr_diffs"), "chunk_type": F.lit("diff"), "file_path": F.col("filename"), "reviewer": none, "text": cut(body)}).select(*out)
    who = F.coalesce("user", F.lit("unknown"))
    said = F.concat(F.lit("Review comment by "), who, F.lit(" on "), F.coalesce("path", F.lit("")), F.lit(":\n"), F.coalesce(F.col("body"), F.lit("")))
    talk = comments.withColumns({"chunk_id": ids("review_comment", F.col("pos")), "collection": F.lit("pr_discussions"), "chunk_type": F.lit("review_comment"), "file_path": F.coalesce("path", F.lit("")), "reviewer": who, "text": cut(said)}).select(*out)
    return about.unionByName(diffs).unionByName(talk)


def _about(head: Column, title: Column, body: Column, max_tokens: int) -> Column:
    """head title, a blank line, body: stripped, then cut."""
    return truncated(stripped(F.concat(F.lit("["), head, F.lit("] "), F.coalesce(title, F.lit("")), F.lit("\n\n"), F.coalesce(body, F.lit("")))), max_tokens, CODE_MARK)


def issue_text(repo: Column, number: Column, title: Column, body: Column, max_tokens: int = 512) -> Column:
    return _about(F.concat(repo, F.lit(" #"), number.cast("string")), title, body, max_tokens)


def ticket_text(instance: Column, key: Column, summary: Column, description: Column, max_tokens: int = 512) -> Column:
    return _about(F.concat(instance, F.lit(" "), key), summary, description, max_tokens)


def comment_text(user: Column, on: Column, body: Column, max_tokens: int = 512) -> Column:
    who = F.coalesce(user, F.lit("unknown"))
    return truncated(F.concat(F.lit("Comment by "), who, F.lit(" on "), on, F.lit(":\n\n"), F.coalesce(body, F.lit(""))), max_tokens, CODE_MARK)


def _or_empty(df: DataFrame, *names: str) -> Column:
    """The first of the columns that df has, '' for null and where it has none."""
    have = [n for n in names if n in df.columns]
    return F.coalesce(F.col(have[0]).cast("string"), F.lit("")) if have else F.lit("")


def _joined(df: DataFrame, name: str) -> Column:
    return F.coalesce(F.array_join(name, ","), F.lit("")) if name in df.columns else F.lit("")


def labelled(df: DataFrame, labels: str, take: tuple[str, ...], leave: tuple[str, ...]) -> DataFrame:
    """Rows with a label of take (any, where it is empty) and none of leave."""
    held = lambda names: F.coalesce(F.arrays_overlap(labels, F.array(*map(F.lit, names))), F.lit(False))
    df = df.filter(held(take)) if take else df
    return df.filter(~held(leave)) if leave else df


def issue_metadata(issues: DataFrame) -> DataFrame:
    """issues with their metadata flat: issue_title, issue_state, issue_author, issue_labels, created_at, updated_at."""
    cols = {
        "issue_title": _or_empty(issues, "title"), "issue_state": _or_empty(issues, "issue_state", "state"), "issue_author": _or_empty(issues, "author_login", "author"),
        "issue_labels": _joined(issues, "labels"), "created_at": _or_empty(issues, "created_at"), "updated_at": _or_empty(issues, "updated_at"),
    }
    return issues.withColumns(cols).drop("labels")


def ticket_metadata(tickets: DataFrame) -> DataFrame:
    """tickets with jira_instance, ticket_summary, ticket_status, ticket_type, reporter, assignee, priority, labels, created_at, updated_at."""
    cols = {
        "jira_instance": F.col("instance"), "ticket_summary": _or_empty(tickets, "summary"), "ticket_status": _or_empty(tickets, "ticket_status", "status"), "ticket_type": _or_empty(tickets, "ticket_type", "type"),
        "reporter": _or_empty(tickets, "reporter"), "assignee": _or_empty(tickets, "assignee"), "priority": _or_empty(tickets, "priority"), "labels": _joined(tickets, "labels"),
        "created_at": _or_empty(tickets, "created"), "updated_at": _or_empty(tickets, "updated"),
    }
    return tickets.withColumns(cols)


def change_metadata(prs: DataFrame) -> DataFrame:
    """(repo, pr_number, pr_title, pr_state, pr_author, pr_labels, merged_at)."""
    return prs.select(
        "repo", "pr_number", _or_empty(prs, "title").alias("pr_title"), _or_empty(prs, "pr_state", "state").alias("pr_state"), _or_empty(prs, "pr_author", "author").alias("pr_author"),
        _joined(prs, "labels").alias("pr_labels"), _or_empty(prs, "merged_at").alias("merged_at"),
    )


def issue_chunks(issues: DataFrame, max_tokens: int = 512) -> DataFrame:
    """issues (repo, issue_number, title, body, ...) with chunk_id, chunk_type and text of their descriptions."""
    number = F.concat(F.lit("issue"), F.col("issue_number").cast("string"))
    text = issue_text(F.col("repo"), F.col("issue_number"), F.col("title"), F.col("body"), max_tokens)
    return issues.withColumns({"chunk_id": chunk_id(F.col("repo"), number, "description", "0"), "chunk_type": F.lit("description"), "text": text})


def ticket_chunks(tickets: DataFrame, max_tokens: int = 512) -> DataFrame:
    """tickets (instance, ticket_key, summary, description as a document tree, ...) with chunk_id, chunk_type and text of their descriptions."""
    text = ticket_text(F.col("instance"), F.col("ticket_key"), F.col("summary"), adf_text(F.col("description")), max_tokens)
    return tickets.withColumns({"chunk_id": chunk_id(F.col("instance"), F.col("ticket_key"), "description", "0"), "chunk_type": F.lit("description"), "text": text})


def comment_chunks(comments: DataFrame, source: str, record: Column, user: Column, on: Column, body: Column, max_tokens: int = 512) -> DataFrame:
    """comments (source, pos, ...) with chunk_id, chunk_type, comment_author and text."""
    who = F.coalesce(user, F.lit("unknown"))
    return comments.withColumns({"chunk_id": chunk_id(F.col(source), record, "comment", F.col("pos")), "chunk_type": F.lit("comment"), "comment_author": who, "text": comment_text(user, on, body, max_tokens)})


def display_name(member_id: Column, handle: Column, real: Column, display: Column) -> Column:
    return F.coalesce(first_text(display, real, handle), member_id)


def with_mentions(df: DataFrame, text: str, users: DataFrame, key: list[str]) -> DataFrame:
    """text with <@ID> replaced by @name; users: user_id, name.

    Mentions are exploded and joined by id, so the table of users may be of any size; rows
    without a mention take no part in the shuffle.  key identifies a row of df.
    """
    ids = F.array_distinct(F.regexp_extract_all(F.col(text), F.lit(r"<@(U[A-Z0-9]+)>"), F.lit(1)))
    found = df.filter(F.col(text).contains("<@")).select(*key, F.explode(ids).alias("user_id")).join(users, "user_id", "left")
    named = found.groupBy(*key).agg(F.collect_list(F.struct("user_id", F.coalesce("name", "user_id").alias("name"))).alias("__m"))
    swap = F.aggregate(F.col("__m"), F.col(text), lambda acc, m: F.replace(acc, F.concat(F.lit("<@"), m["user_id"], F.lit(">")), F.concat(F.lit("@"), m["name"])))
    return df.join(named, key, "left").withColumn(text, F.when(F.col("__m").isNull(), F.col(text)).otherwise(swap)).drop("__m")


def chat_chunks(messages: DataFrame, gap_s: int = 1800, cap: int = 50, max_tokens: int = 512) -> DataFrame:
    """One chunk for each thread and each window of messages outside threads.

    messages: channel_id, channel_name, ts (text), us, msg_id, line (null: noise), author, root
    (the thread's ts for roots and replies, else null).  A window ends at a gap above gap_s or
    at cap messages; noise counts toward both.  Chunks without a line are left out.
    """
    from pyspark.sql import Window

    from ..functions.shared import written

    messages = written(messages.select("channel_id", "channel_name", "ts", "us", "msg_id", "line", "author", "root"), "messages")  # read several times below
    threads = messages.filter("root is not null").withColumn("key", F.col("root")).withColumn("chunk_type", F.lit("slack_thread"))
    cut = gap_windows(messages.filter("root is null"), ["channel_id"], "us", "msg_id", gap_s, cap)
    first = F.first("ts").over(Window.partitionBy("channel_id", "window").orderBy("us", "msg_id"))
    windows = cut.withColumn("key", first).withColumn("chunk_type", F.lit("slack_window")).drop("window")
    every = threads.unionByName(windows)
    own = ["channel_id", "channel_name", "chunk_type", "key"]
    # a text is cut at a length, so only the lines that reach it are collected; a thread of any size stays spread
    before = Window.partitionBy(*own).orderBy("us", "msg_id").rowsBetween(Window.unboundedPreceding, -1)
    seen = F.coalesce(F.sum(F.length("line") + 1).over(before), F.lit(0))
    lines = every.filter("line is not null").withColumn("__seen", seen).filter(F.col("__seen") <= max_tokens * CHARS_PER_TOKEN)
    lines = lines.groupBy(*own).agg(F.array_sort(F.collect_list(F.struct("us", "msg_id", "line"))).alias("l"))
    authors = every.groupBy(*own, "author").agg(F.min(F.struct("us", "msg_id")).alias("at"), F.count("*").alias("n")).groupBy(*own)
    authors = authors.agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "author"))), lambda x: x["author"]).alias("participants"), F.sum("n").alias("n_messages"))
    label = F.when(F.col("chunk_type") == "slack_thread", "thread").otherwise("conversation")
    body = F.concat(F.lit("[#"), F.col("channel_name"), F.lit("] "), label, F.lit(":\n"), F.array_join(F.transform("l", lambda x: x["line"]), "\n"))
    return lines.join(authors, own).select(
        chunk_id("slack", F.col("channel_id"), F.col("key")).alias("chunk_id"), "channel_id", "channel_name", "chunk_type", F.col("key").alias("ts"), truncated(body, max_tokens).alias("text"),
        "participants", permalink(F.col("channel_id"), F.col("key")).alias("permalink_path"), "n_messages",
    )


def chat_kinds(chunks: DataFrame) -> DataFrame:
    """(channel_id, n_threads, n_windows) of chat_chunks."""
    kind = lambda k: F.count_if(F.col("chunk_type") == k)
    return chunks.groupBy("channel_id").agg(kind("slack_thread").alias("n_threads"), kind("slack_window").alias("n_windows"))


def session_chunks(entries: DataFrame, max_tokens: int = 512) -> DataFrame:
    """Exchanges of sessions: a prompt opens one, the answers up to the next prompt belong to it.

    entries: session_id, us, entry_id, prompt (null or ''), answer (null or ''), and of the prompt cwd, git_branch, entry_timestamp
    where there are.  Answers before any prompt are left out; a prompt without an answer makes no chunk and takes no index.
    """
    from pyspark.sql import Window

    about = [c for c in ("cwd", "git_branch", "entry_timestamp") if c in entries.columns]
    e = entries.withColumn("bucket", F.floor(F.col("us") / 86_400_000_000).cast("bigint")).withColumn("__p", F.coalesce(F.col("prompt") != "", F.lit(False)))
    cut = segments(e, ["session_id"], ["us", "entry_id"], "bucket", flag="__p").filter("break_rn is not null")
    # a text is cut at a length: answers behind it aren't collected
    before = Window.partitionBy("session_id", "break_rn").orderBy("rn").rowsBetween(Window.unboundedPreceding, -1)
    seen = F.coalesce(F.sum(F.coalesce(F.length("answer"), F.lit(0))).over(before), F.lit(0))
    cut = cut.withColumn("__seen", seen).filter(F.col("__seen") <= max_tokens * CHARS_PER_TOKEN)
    said = F.filter(F.transform(F.array_sort(F.collect_list(F.struct("rn", "prompt", "answer"))), lambda x: x["answer"]), lambda a: a != "")
    of_prompt = lambda c: F.max(F.when(F.col("rn") == F.col("break_rn"), F.col(c))).alias(c)
    grouped = cut.groupBy("session_id", "break_rn").agg(*[of_prompt(c) for c in ("prompt", *about)], F.min("us").alias("us"), said.alias("answers"))
    full = grouped.withColumn("__a", stripped(F.array_join("answers", "\n\n"))).filter((F.col("__a") != "") & F.col("prompt").isNotNull())
    # exchanges of a session are numbered; one row for each exchange, not for each entry
    turn = (F.row_number().over(Window.partitionBy("session_id").orderBy("break_rn")) - 1).cast("int")
    body = F.concat(F.lit("User: "), F.col("prompt"), F.lit("\n\nAssistant: "), F.col("__a"))
    return full.withColumn("turn_index", turn).select(
        chunk_id("session", F.col("session_id"), F.col("turn_index")).alias("chunk_id"), "session_id", "turn_index", F.lit("session_exchange").alias("chunk_type"), "us", truncated(body, max_tokens).alias("text"), *about
    )
