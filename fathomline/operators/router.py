"""From a free-text query and a scope to the collections that answer it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Collections, scopes, and the families of intent in order with their patterns and collections.
ALL = (
    "code_chunks", "pr_diffs", "pr_discussions", "issue_descriptions", "issue_discussions", "jira_descriptions", "jira_discussions",
    "slite_pages", "slack_messages", "documents", "session_logs",
)
SCOPES = {
    "code": ("code_chunks",),
    "prs": ("pr_diffs", "pr_discussions"),
    "issues": ("issue_descriptions", "issue_discussions"),
    "jira": ("jira_descriptions", "jira_discussions"),
    "slite": ("slite_pages",),
    "slack": ("slack_messages",),
    "docs": ("documents",),
    "sessions": ("session_logs",),
}
FAMILIES = (
    ("session", ("session_logs",), (
        r"\blast\s+(?:time|session|week|conversation)\b",
        r"\bearlier\s+(?:session|conversation|we|I)\b",
        r"\bwe\s+discussed\b", r"\bwe\s+talked\s+about\b",
        r"\bprevious(?:ly)?\s+(?:session|chat|conversation)\b",
        r"\bi\s+asked\s+claude\b", r"\bclaude\s+(?:told|said|suggested)\b",
        r"\bchat\s+history\b", r"\bsession\s+log\b",
    )),
    ("slack", ("slack_messages", "code_chunks"), (
        r"\bslack\b", r"\bdirect\s+message\b", r"\bdm(?:ed|s)?\b",
        r"#[a-z0-9][a-z0-9_-]*",
    )),
    ("slite", ("slite_pages", "documents"), (
        r"\bslite\b", r"\bwiki\b", r"\bknowledge\s+base\b", r"\binternal\s+doc\b",
    )),
    ("jira", ("jira_descriptions", "jira_discussions", "code_chunks"), (
        r"\bjira\b", r"\bsprint\b", r"\bepic\b", r"\bstory\b", r"\bstory\s+points?\b",
    )),
    ("issue", ("issue_descriptions", "issue_discussions", "jira_descriptions", "jira_discussions"), (
        r"\bbug\b", r"\bissue[sd]?\b", r"\bfeature\s+request\b", r"\breported?\b", r"\bfiled?\b", r"\bticket\b",
    )),
    ("pr", ("pr_diffs", "pr_discussions"), (
        r"\bwhy\s+did\s+we\b", r"\bwhy\s+was\b", r"\bwhy\s+were\b",
        r"\bwhen\s+did\s+we\b", r"\bwho\s+changed\b", r"\bwho\s+added\b", r"\bwho\s+removed\b",
        r"\bswitch(?:ed)?\s+(?:from|to)\b", r"\bmigrat(?:e|ed|ion)\b",
        r"\bchange(?:d|s)?\s+(?:the|to|from)\b", r"\bremov(?:e|ed)\b.*\bwhy\b",
        r"\bwhy\b.*\bremov(?:e|ed)\b", r"\bintroduc(?:e|ed)\b", r"\brevert(?:ed)?\b", r"\bdeprecated?\b",
    )),
    ("doc", ("documents", "code_chunks"), (
        r"\bpolicy\b", r"\bpolicies\b", r"\bspec(?:ification)?\b", r"\bdesign\s+doc\b",
        r"\barchitecture\b", r"\bdiagram\b", r"\bprocess\b", r"\bprocedure\b",
        r"\bguideline\b", r"\bstandard\b", r"\bconvention\b", r"\bdocument(?:ation)?\b",
        r"\bplaybook\b", r"\brunbook\b", r"\bonboarding\b", r"\btutorial\b",
        r"\bdescribe\s+the\b", r"\bwhat\s+does\s+the\s+(?:spec|doc|guide)\b",
    )),
    ("usage", ("code_chunks", "pr_diffs"), (
        r"\bwhere\s+is\b", r"\bwhere\s+are\b", r"\bwho\s+uses\b", r"\busage\s+of\b", r"\bcall(?:s|ed)\s+(?:from|by|in)\b",
    )),
    ("code", ("code_chunks",), (
        r"\bhow\s+does\b", r"\bhow\s+do\b", r"\bhow\s+is\b", r"\bwhat\s+does\b",
        r"\bimplement(?:s|ed|ation)?\b", r"\bdefin(?:e|ed|ition)\b",
    )),
)


def _any_of(patterns: tuple[str, ...]) -> str:
    """One expression for all patterns; those that begin at a word's edge share the test for it."""
    edge = [p[2:] for p in patterns if p.startswith(r"\b")]
    return "|".join([r"\b(?:" + "|".join(edge) + ")", *[p for p in patterns if not p.startswith(r"\b")]])


def intent(query: Column) -> Column:
    """The first family with a pattern in the query, 'all' without one; a null query is 'all'."""
    low = F.lower(query)
    out = F.lit("all")
    for name, _, patterns in reversed(FAMILIES):
        out = F.when(low.rlike(_any_of(patterns)), name).otherwise(out)
    return out


def route(query: Column, scope: Column | str = "all") -> Column:
    """ARRAY<STRING> of collections: by scope where it names one, else by intent."""
    scope = F.lit(scope) if isinstance(scope, str) else scope
    arrays = {name: F.array(*map(F.lit, c)) for name, c, _ in FAMILIES}
    kind = intent(query)
    auto = F.array(*map(F.lit, ALL))
    for name, a in arrays.items():
        auto = F.when(kind == name, a).otherwise(auto)
    for name, c in SCOPES.items():
        auto = F.when(scope == name, F.array(*map(F.lit, c))).otherwise(auto)
    return auto
