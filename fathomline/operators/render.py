"""Hits and run statistics as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import CODE_MARK, first_text

PREVIEW = 50
COLUMNS = (
    "chunk_type", "issue_number", "issue_title", "issue_author", "comment_author", "ticket_key", "ticket_summary", "session_id", "project_dir", "timestamp", "git_branch",
    "channel_name", "page_id", "page_title", "page_url", "pr_number", "pr_title", "pr_author", "reviewer", "file_path", "section_path", "entity_name", "line_range", "language",
)


def preview(text: Column, lines: int = PREVIEW) -> Column:
    """The first lines of a text, with a mark where more follow."""
    parts = F.split(F.trim(text), "\n")
    return F.concat(F.array_join(F.slice(parts, 1, lines), "\n"), F.when(F.size(parts) > lines, CODE_MARK).otherwise(""))


def hit_text(hits: DataFrame) -> Column:
    """A block of text for each hit (rank, text and what COLUMNS it has)."""
    have = set(hits.columns)
    raw = lambda k: F.col(k).cast("string") if k in have else F.lit(None).cast("string")
    c = lambda k, default="": F.coalesce(raw(k), F.lit(default))
    kind = c("chunk_type")
    head = F.concat(F.lit("### "), F.col("rank").cast("string"), F.lit(". "))
    text_of = lambda *parts: F.concat(head, *[F.lit(p) if isinstance(p, str) else p for p in parts])
    fence = lambda mark, title, *more: F.concat_ws("\n", title, *more, F.lit(f"```{mark}") if isinstance(mark, str) else F.concat(F.lit("```"), mark), preview(F.col("text")), F.lit("```\n"))
    spoken = kind.isin("description", "comment")
    comment = kind == "comment"
    # participants is the only list among the columns
    people = F.when(F.size("participants") > 0, F.concat(F.lit(" ("), F.array_join("participants", ", "), F.lit(")"))).otherwise("") if "participants" in have else F.lit("")
    note = lambda label, value: F.when(value != "", F.concat(F.lit(label), value, F.lit("*")))
    # The heads of answers.
    return (
        F.when(raw("issue_number").isNotNull() & spoken, fence("", F.when(comment, text_of("[Issue #", c("issue_number"), "] Comment by ", c("comment_author"))).otherwise(text_of("[Issue #", c("issue_number"), "] ", c("issue_title"), " (by ", c("issue_author"), ")"))))
        .when(raw("ticket_key").isNotNull() & spoken, fence("", F.when(comment, text_of("[Jira ", c("ticket_key"), "] Comment by ", c("comment_author"))).otherwise(text_of("[Jira ", c("ticket_key"), "] ", c("ticket_summary")))))
        .when(kind == "session_exchange", fence("", text_of("[Session ", F.substring(c("session_id", "?"), 1, 8), "] ", c("project_dir"), F.when(c("git_branch") != "", F.concat(F.lit(" ("), c("git_branch"), F.lit(")"))).otherwise("")), note("*", c("timestamp"))))
        .when(kind.isin("slack_thread", "slack_window"), fence("", text_of("[Slack #", c("channel_name", "?"), "] ", F.when(kind == "slack_thread", "thread").otherwise("conversation"), people)))
        .when(kind == "slite_page", fence("", text_of("[Slite] ", c("page_title", "Untitled")), note("*Section: ", c("section_path")), note("*URL: ", c("page_url"))))
        .when(raw("pr_number").isNotNull(), fence("diff", F.when(kind == "review_comment", text_of("[PR #", c("pr_number"), "] Review comment by ", c("reviewer"), " on ", c("file_path"))).when(kind == "description", text_of("[PR #", c("pr_number"), "] ", c("pr_title"), " (by ", c("pr_author"), ")")).otherwise(text_of("[PR #", c("pr_number"), "] ", c("pr_title"), " — ", c("file_path")))))
        .when(kind == "document", fence("", text_of("[", F.coalesce(raw("entity_name"), c("section_path")), "] ", c("file_path", "unknown")), note("*Section: ", c("section_path"))))
        .otherwise(fence(c("language"), text_of(c("entity_name"), " (", c("file_path", "unknown"), F.when(c("line_range") != "", F.concat(F.lit(":"), c("line_range"))).otherwise(""), ")")))
    )


def render(hits: DataFrame) -> DataFrame:
    """(qid, answer): all hits of a query in order. Queries without hits have no row here; their answer is NOTHING."""
    each = hits.withColumn("__text", hit_text(hits))
    blocks = F.array_sort(F.collect_list(F.struct("rank", "__text")))
    return each.groupBy("qid").agg(F.array_join(F.transform(blocks, lambda b: b["__text"]), "\n").alias("answer"))


NOTHING = "No results found."


# ---- one sentence for a run


def _some(n: Column | None, *parts) -> Column:
    """The parts where n is above zero."""
    if n is None:
        return F.lit(None).cast("string")
    return F.when(n > 0, F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]))


def _sentence(joint: str, *parts: Column) -> Column:
    return F.concat(F.concat_ws(joint, *parts), F.lit("."))


def run_report(scanned: Column, indexed: Column, skipped: Column, removed: Column, empty: Column, failed: Column, chunks: Column) -> Column:
    """One sentence for the counters of an indexing run (changes.COUNTERS)."""
    always = F.format_string("Scanned %d files. Indexed %d files (%d chunks). Skipped %d unchanged files", scanned, indexed, chunks, skipped)
    return _sentence(". ", always, _some(empty, empty, " files produced no chunks"), _some(failed, failed, " files failed (see logs)"), _some(removed, "Removed ", removed, " deleted files"))


def folder_report(scanned: Column, indexed: Column, skipped: Column, removed: Column, empty: Column, failed: Column, chunks: Column) -> Column:
    """The same for a folder of documents outside any repository."""
    always = F.format_string("Scanned %d files. Indexed %d files (%d chunks).", scanned, indexed, chunks)
    return F.concat(always, F.coalesce(_some(failed, " ", failed, " files failed (see logs)."), F.lit("")))


def docs_report(scanned: Column, indexed: Column, skipped: Column, removed: Column, empty: Column, failed: Column, chunks: Column) -> Column:
    """The same for the documents of a repository."""
    always = F.format_string("Docs: indexed %d (%d chunks)", indexed, chunks)
    return _sentence(", ", always, _some(skipped, "skipped ", skipped, " unchanged"), _some(failed, failed, " failed"), _some(removed, "removed ", removed, " deleted"))


#: What each kind of source is called, and what is said of records that were skipped or failed.
SYNCED = {
    "prs": ("PRs", "PRs", "unchanged PRs"), "issues": ("issues", "issues", "issues (PRs or unchanged)"), "slite": ("Slite pages", "pages", "pages"), "jira": ("Jira tickets", "tickets", "tickets"),
}


def sync_report(kind: str, fetched: Column, indexed: Column, chunks: Column, skipped: Column, errored: Column | None = None) -> Column:
    """One sentence for a sync of change requests, issues, pages or tickets."""
    whole, part, left = SYNCED[kind]
    return _sentence(
        ". ", F.format_string(f"Fetched %d {whole}", fetched), F.format_string(f"Indexed %d {part} (%d chunks)", indexed, chunks), _some(skipped, "Skipped ", skipped, f" {left}"),
        _some(errored, "Errored ", errored, f" {part}"),
    )


def chat_report(scanned: Column, threads: Column, windows: Column, chunks: Column, skipped: Column, errored: Column | None = None) -> Column:
    always = F.format_string("Scanned %d Slack channels. Indexed %d threads + %d windows (%d chunks)", scanned, threads, windows, chunks)
    return _sentence(". ", always, _some(skipped, "Skipped ", skipped, " channels (no new messages)"), _some(errored, "Errored ", errored, " channels"))


def session_report(scanned: Column, indexed: Column, sessions: Column, chunks: Column, skipped: Column) -> Column:
    always = F.format_string("Scanned %d session files. Indexed %d files (%d sessions, %d chunks)", scanned, indexed, sessions, chunks)
    return _sentence(". ", always, _some(skipped, "Skipped ", skipped, " empty files"))
