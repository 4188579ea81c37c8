"""Settings that change results, and where they come from: project file over user file over defaults."""

from __future__ import annotations

from dataclasses import dataclass, field, fields, is_dataclass
from pathlib import Path

CHARS_PER_TOKEN = 4


@dataclass(frozen=True)
class Embedding:
    max_tokens: int = 8192
    batch_size: int = 64
    dim: int = 256


@dataclass(frozen=True)
class Retrieval:
    top_k: int = 20
    final_k: int = 5
    rerank: bool = True
    rrf_k: int = 60
    max_per_source: int = 2
    repo_boost: float = 0.15


@dataclass(frozen=True)
class Code:
    chunk_max_tokens: int = 512
    max_file_bytes: int = 2_000_000
    include_doc_comments: bool = True
    doc_comment_max_lines: int = 30
    doc_budget: float = 0.25
    header_min_chars: int = 40
    index_file_headers: bool = True
    index_docs: bool = True
    ignore_files: tuple[str, ...] = (".gitignore", ".indexignore")
    exclude: tuple[str, ...] = ("*.min.js", "vendor/**", "node_modules/**", "*.lock", "*.generated.*")


@dataclass(frozen=True)
class Issues:
    chunk_max_tokens: int = 512
    include_labels: tuple[str, ...] = ()
    exclude_labels: tuple[str, ...] = ()
    backfill_days: int = 90


@dataclass(frozen=True)
class Documents:
    globs: tuple[str, ...] = ("**/*.md", "**/*.mdx", "**/*.txt", "**/*.rst", "**/*.html", "**/*.adoc")
    chunk_max_tokens: int = 512
    overlap_tokens: int = 50


@dataclass(frozen=True)
class Chat:
    gap_minutes: int = 30
    window_cap: int = 50
    chunk_max_tokens: int = 512
    channels: tuple[str, ...] = ()


@dataclass(frozen=True)
class Sessions:
    backfill_days: int = 60
    chunk_max_tokens: int = 512


@dataclass(frozen=True)
class Config:
    embedding: Embedding = field(default_factory=Embedding)
    retrieval: Retrieval = field(default_factory=Retrieval)
    code: Code = field(default_factory=Code)
    issues: Issues = field(default_factory=Issues)
    documents: Documents = field(default_factory=Documents)
    chat: Chat = field(default_factory=Chat)
    sessions: Sessions = field(default_factory=Sessions)


def _merge(kind: type, *layers: dict):
    """Layers from weak to strong; unknown keys are ignored."""
    given = {}
    for f in fields(kind):
        values = [x[f.name] for x in layers if isinstance(x, dict) and f.name in x]
        default = f.default_factory() if callable(f.default_factory) else f.default
        if is_dataclass(default):
            given[f.name] = _merge(type(default), *values)
        elif values:
            given[f.name] = _typed(values[-1], default)
    return kind(**given)


def _typed(value, default):
    """A value in the type of the setting; what can't be one is an error, not a surprise later on."""
    if isinstance(default, tuple):
        return tuple(value) if isinstance(value, list | tuple) else tuple(x.strip() for x in str(value).split(",") if x.strip())
    if isinstance(default, bool):
        if isinstance(value, bool):
            return value
        if str(value).strip().lower() not in ("true", "false", "yes", "no", "on", "off", "1", "0"):
            raise ValueError(f"not a truth value: {value!r}")
        return str(value).strip().lower() in ("true", "yes", "on", "1")
    return type(default)(value)


def load(project: str | None = None, user: str | None = None) -> Config:
    """Settings from up to two YAML files; a missing file is an empty one."""
    import yaml

    def read(p: str | None) -> dict:
        return (yaml.safe_load(Path(p).read_text()) or {}) if p and Path(p).exists() else {}

    return _merge(Config, read(user), read(project))


def put(path: str, key: str, value: str) -> None:
    """Sets section.name = value in a YAML file; the value is kept as text."""
    import yaml

    p = Path(path)
    data = (yaml.safe_load(p.read_text()) or {}) if p.exists() else {}
    *sections, name = key.split(".")
    at = data
    for s in sections:
        at = at.setdefault(s, {})
    at[name] = value
    p.write_text(yaml.safe_dump(data))
