"""Column expressions for texts, identifiers and paths; all stay in the JVM."""

from __future__ import annotations

import json
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import CHARS_PER_TOKEN

# Marks of a cut text.
CODE_MARK = "\n# ... (truncated)"
PLAIN_MARK = "\n... (truncated)"

# Lower-case suffix -> language.
LANGUAGES = {
    ".py": "python", ".js": "javascript", ".jsx": "javascript", ".ts": "typescript", ".tsx": "tsx", ".rs": "rust", ".go": "go",
    ".c": "c", ".h": "c", ".cpp": "cpp", ".cc": "cpp", ".cxx": "cpp", ".hpp": "cpp", ".cs": "csharp", ".vb": "vb", ".java": "java",
    ".rb": "ruby", ".php": "php", ".swift": "swift", ".kt": "kotlin", ".kts": "kotlin", ".scala": "scala", ".lua": "lua", ".r": "r",
    ".jl": "julia", ".ex": "elixir", ".exs": "elixir", ".hs": "haskell", ".ml": "ocaml", ".mli": "ocaml", ".sh": "bash", ".bash": "bash",
    ".toml": "toml", ".yaml": "yaml", ".yml": "yaml", ".json": "json", ".tf": "terraform", ".tfvars": "terraform", ".config": "xml",
}

# Phrases of licence grants in file headers.
LICENCE_MARKS = (
    "permission is hereby granted", "redistribution and use in source and binary", "licensed under the apache license",
    "gnu general public license", "without warranties or conditions of any kind", "spdx-license-identifier",
)

# Chat subtypes without content.
NOISE_SUBTYPES = ("channel_join", "channel_leave", "channel_topic", "channel_purpose", "channel_name", "channel_archive", "channel_unarchive", "bot_add", "bot_remove")

# Elements that are no words of a session.
NOISE_TAGS = (r"(?s)<system-reminder>.*?</system-reminder>", r"(?s)<local-command-[^>]+>.*?</local-command-[^>]+>")

#: What counts as blank at the ends of a text.
BLANKS = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u2028\u2029\u3000"

# Block nodes of a document tree.
BLOCKS = frozenset(
    ["paragraph", "heading", "blockquote", "codeBlock", "bulletList", "orderedList", "listItem", "table", "tableRow", "tableCell", "tableHeader", "rule", "panel", "expand", "mediaGroup", "mediaSingle"]
)


def chunk_id(*parts: Column | str) -> Column:
    """First 16 hex digits of the SHA-256 of the parts joined by colons."""
    return F.substring(F.sha2(F.concat_ws(":", *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]), 256), 1, 16)


def uuid5_url(name: Column) -> Column:
    """Name-based UUID (SHA-1) in the URL namespace."""
    space = F.unhex(F.lit("6ba7b8119dad11d180b400c04fd430c8"))
    h = F.sha1(F.concat(space, F.encode(name, "UTF-8")))
    variant = F.substring(F.lit("89ab"), (F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4 + 1), F.lit(1))
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))


def without_noise(text: Column) -> Column:
    """text without the elements of NOISE_TAGS."""
    return reduce(lambda t, tag: F.regexp_replace(t, tag, ""), NOISE_TAGS, text)


def stripped(text: Column) -> Column:
    """text without blanks at its ends."""
    return F.trim(text, F.lit(BLANKS))


def truncated(text: Column, max_tokens: int = 512, mark: str = PLAIN_MARK) -> Column:
    """At most max_tokens * 4 characters, with a mark where cut."""
    n = max_tokens * CHARS_PER_TOKEN
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit(mark))).otherwise(text)


def suffix(path: Column) -> Column:
    """The last suffix of the file's name in lower case, '' without one."""
    name = F.regexp_extract(path, r"([^/\\]*)$", 1)
    return F.lower(F.regexp_extract(name, r"[^.](\.[^.]+)$", 1))


def language(path: Column) -> Column:
    """Language by suffix, null for other files."""
    return F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])[suffix(path)]


def glob_regex(pattern: str) -> str:
    """An ignore pattern as an expression over whole relative paths (``rlike``, RE2 and Java alike).

    A pattern with a slash inside is rooted; one without matches a name at any depth, folders included.
    """
    p = pattern.rstrip("/")
    inner = "/" in p
    p = p.lstrip("/")
    out, k = "", 0
    while k < len(p):
        if p.startswith("**/", k):
            out, k = out + "(?:.*/)?", k + 3
        elif p.startswith("/**", k) and k + 3 == len(p):
            out, k = out + "/.+", k + 3
        elif p.startswith("**", k):
            out, k = out + ".*", k + 2
        elif p[k] == "*":
            out, k = out + "[^/]*", k + 1
        elif p[k] == "?":
            out, k = out + "[^/]", k + 1
        else:
            out, k = out + ("\\" + p[k] if p[k] in ".+()[]{}^$|\\" else p[k]), k + 1
    return ("^" if inner else "^(?:.*/)?") + out + "(?:/.*)?$"


def ignore_lines(text: str) -> list[str]:
    """Patterns of an ignore file, without comments and blanks."""
    return [x.strip() for x in text.splitlines() if x.strip() and not x.lstrip().startswith("#")]


def ignored(path: Column, patterns: list[str]) -> Column:
    """Whether the last pattern that matches excludes the path; ``!`` takes it in again."""
    return reduce(lambda acc, p: F.when(path.rlike(glob_regex(p.lstrip("!"))), F.lit(not p.startswith("!"))).otherwise(acc), patterns, F.lit(False))


def plain_path(path: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(path, r"[\\/]+", "/"), r"^(?:\./)+", "")


def entity_name(section_path: Column) -> Column:
    return F.element_at(F.split(section_path, " > "), -1)


def since_days(text: str) -> int | None:
    """'30d' -> 30; '' -> None."""
    import re

    if not text:
        return None
    m = re.fullmatch(r"(\d+)d", text.strip())
    if not m:
        raise ValueError(f"not a number of days: {text!r}")
    return int(m[1])


def iso_before(now: str, days: int) -> str:
    """The ISO time so many days before another one."""
    from datetime import datetime, timedelta

    return (datetime.fromisoformat(now.replace("Z", "+00:00")) - timedelta(days=days)).isoformat()


def says_something(text: Column, least: int = 40) -> Column:
    """Whether the head of a file is worth a chunk: not too short, and no licence."""
    low = F.lower(text)
    return (F.length(F.trim(text)) >= least) & ~reduce(lambda a, m: a | low.contains(m), LICENCE_MARKS, F.lit(False))


def first_text(*columns: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*[F.when(c != "", c) for c in columns])


def permalink(channel: Column, ts: Column) -> Column:
    return F.concat(F.lit("archives/"), channel, F.lit("/p"), F.replace(ts, F.lit("."), F.lit("")))


def jql_date(iso: Column) -> Column:
    """Wall clock of an ISO time to the minute: yyyy/MM/dd HH:mm."""
    parts = F.regexp_extract(iso, r"^(\d{4})-(\d{2})-(\d{2})[T ](\d{2}:\d{2})", 0)
    return F.when(parts != "", F.regexp_replace(parts, r"^(\d{4})-(\d{2})-(\d{2})[T ](\d{2}:\d{2})$", "$1/$2/$3 $4"))


def jql_since(jql: str, date: str) -> str:
    """The query with a condition on updated, before its ORDER BY where it has one."""
    import re

    head, order = jql, ""
    if m := re.search(r"(?i)\border\s+by\b", jql):
        head, order = jql[: m.start()], " " + jql[m.start() :]
    return f'{head} AND updated >= "{date}"{order}'


def tree_text(node: dict | str | None) -> str:
    """Text of a document tree: block children are set apart by blank lines, others joined.

    Walks with a stack of its own, so depth is no limit.
    """
    if node is None or isinstance(node, str):
        return node or ""
    done: dict[int, str] = {}
    stack = [(node, False)]
    while stack:
        at, seen = stack.pop()
        if not isinstance(at, dict):
            continue
        if "text" in at:
            done[id(at)] = at["text"] if isinstance(at["text"], str) else ""
            continue
        children = [c for c in (at.get("content") or []) if isinstance(c, dict)] if isinstance(at.get("content"), list) else []
        if not seen:
            stack.append((at, True))
            stack.extend((c, False) for c in children)
            continue
        apart = at.get("type") == "doc" or any(c.get("type") in BLOCKS for c in children)
        done[id(at)] = ("\n\n" if apart else "").join(t for c in children if (t := done.get(id(c), "")))
    return done.get(id(node), "")


@F.pandas_udf(T.StringType())
def adf_text(tree: pd.Series) -> pd.Series:
    """tree_text of a column of JSON; what isn't JSON is plain text, null stays ''. Recursion has no JVM expression."""

    def one(s: str | None) -> str:
        if s is None:
            return ""
        try:
            v = json.loads(s)
        except (ValueError, RecursionError):
            return s
        return tree_text(v) if isinstance(v, dict | str) else ""

    return tree.map(one)
