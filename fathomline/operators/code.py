"""Code files -> chunks: one for each declared entity, one for the file's header, or one for the whole file.

Entities are functions, methods and type-like containers; members of containers are entities
of their own, the inside of functions isn't.  A chunk is the enclosing class (a line), the
comment directly above (a quarter of the budget at most) and the source, cut at the budget.
A file is one row and is chunked where it is read; nothing is shuffled.

Defined results: null, empty or blank text: no chunk; an unknown suffix: no chunk; a known
language without entities, or a file without any: one chunk for the file; files above the
size cap are left out before their text is read; duplicate ids: the last one counts.
"""

from __future__ import annotations

import ast
import bisect
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import CHARS_PER_TOKEN, Code
from ..functions.source_text import HIDDEN, closing, declarations, spans
from ..functions.text import CODE_MARK, LANGUAGES, LICENCE_MARKS

FIELDS = "chunk_id string, repo string, file_path string, text string, language string, entity_name string, entity_type string, line_range string, line_start int, line_end int, signature string, parent_entity string"
_NAME = r"(?P<name>[A-Za-z_$][\w$]*)"
_CONTAINERS = {
    "javascript": [("class_declaration", re.compile(rf"(?m)^[ \t]*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+{_NAME}"))],
    "typescript": [
        ("class_declaration", re.compile(rf"(?m)^[ \t]*(?:export\s+)?(?:default\s+)?(?:declare\s+)?(?:abstract\s+)?class\s+{_NAME}")),
        ("interface_declaration", re.compile(rf"(?m)^[ \t]*(?:export\s+)?(?:declare\s+)?interface\s+{_NAME}")),
        ("type_alias_declaration", re.compile(rf"(?m)^[ \t]*(?:export\s+)?(?:declare\s+)?type\s+{_NAME}[^=\n]*=")),
    ],
    "rust": [
        ("impl_item", re.compile(r"(?m)^[ \t]*(?:unsafe\s+)?impl\b(?:\s*<[^{]*?>)?\s*(?:[\w:<>, ]+\s+for\s+)?(?P<name>[A-Za-z_]\w*)")),
        ("struct_item", re.compile(rf"(?m)^[ \t]*(?:pub(?:\([^)]*\))?\s+)?struct\s+{_NAME}")),
        ("enum_item", re.compile(rf"(?m)^[ \t]*(?:pub(?:\([^)]*\))?\s+)?enum\s+{_NAME}")),
        ("trait_item", re.compile(rf"(?m)^[ \t]*(?:pub(?:\([^)]*\))?\s+)?(?:unsafe\s+)?trait\s+{_NAME}")),
        ("mod_item", re.compile(rf"(?m)^[ \t]*(?:pub(?:\([^)]*\))?\s+)?mod\s+{_NAME}")),
    ],
    "go": [("type_declaration", re.compile(rf"(?m)^[ \t]*type\s+{_NAME}"))],
    "csharp": [
        (f"{k}_declaration", re.compile(rf"(?m)^[ \t]*(?:(?:public|private|protected|internal|static|sealed|abstract|partial|readonly|ref|file)\s+)*{k}\s+(?:struct\s+|class\s+)?{_NAME}"))
        for k in ("class", "struct", "record", "interface", "enum")
    ],
    "java": [
        (f"{k}_declaration", re.compile(rf"(?m)^[ \t]*(?:(?:public|private|protected|static|final|abstract|sealed)\s+)*{k}\s+{_NAME}"))
        for k in ("class", "interface", "enum", "record")
    ],
}
_FUNCTION = {"javascript": "function_declaration", "typescript": "function_declaration", "rust": "function_item", "go": "function_declaration", "csharp": "method_declaration", "java": "method_declaration"}
_HOLDERS = {"class_declaration", "interface_declaration", "struct_declaration", "record_declaration", "impl_item", "trait_item", "type_declaration"}
_VB_LINE = re.compile(r"(?im)^[ \t]*End[ \t]+(?P<end>\w+)|^[ \t]*(?:(?:Public|Private|Protected|Friend|Shared|Overrides|Overridable|MustOverride|MustInherit|NotInheritable|Partial|ReadOnly|Default|Async)\s+)*(?P<kind>Class|Module|Structure|Interface|Enum|Sub|Function|Property|Event)\s+(?P<name>\w+)")
_TERRAFORM = re.compile(r'(?m)^(?P<kind>\w+)(?P<labels>(?:[ \t]+"[^"\n]*")*)[ \t]*\{')


def _python(text: str) -> list[tuple[str, str, int, int, str | None]]:
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return _python_lines(text)
    starts = [0, *[m.end() for m in re.finditer("\n", text)], len(text)]
    raw = text.encode()
    exact = len(raw) == len(text)
    out: list[tuple[str, str, int, int, str | None]] = []
    stack: list[tuple[ast.AST, str | None]] = [(n, None) for n in reversed(tree.body)]
    while stack:
        node, parent = stack.pop()
        if isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
            first = min([node.lineno, *[d.lineno for d in node.decorator_list]])
            line = text[starts[node.end_lineno - 1] : starts[node.end_lineno]]
            tail = node.end_col_offset if exact else len(line.encode()[: node.end_col_offset].decode("utf-8", "ignore"))
            begin = starts[first - 1]
            begin += len(text[begin : starts[first]]) - len(text[begin : starts[first]].lstrip())
            kind = "class_definition" if isinstance(node, ast.ClassDef) else "function_definition"
            out.append((node.name, "decorated_definition" if node.decorator_list else kind, begin, starts[node.end_lineno - 1] + tail, parent))
            if isinstance(node, ast.ClassDef):
                stack.extend((n, node.name) for n in reversed(node.body))
        else:
            stack.extend((n, parent) for n in reversed(list(ast.iter_child_nodes(node))) if isinstance(n, ast.stmt))
    return sorted(out, key=lambda x: x[2])


def _python_lines(text: str) -> list[tuple[str, str, int, int, str | None]]:
    """By indentation, for files that don't parse."""
    mask = spans(text, "python")[0]
    heads = [(m.start("k"), len(m["i"]), m["k"], m["n"]) for m in re.finditer(r"(?m)^(?P<i>[ \t]*)(?:async[ \t]+)?(?P<k>def|class)[ \t]+(?P<n>\w+)", mask)]
    out, open_ = [], []
    for at, indent, kind, name in heads:
        open_ = [x for x in open_ if x[0] < indent]
        end = len(text)
        for m in re.finditer(r"(?m)^(?P<i>[ \t]*)\S", mask[at:]):
            if m.start() and len(m["i"]) <= indent:
                end = at + m.start()
                break
        if not any(k == "def" for _, k, _ in open_):
            parent = next((n for _, k, n in reversed(open_) if k == "class"), None)
            out.append((name, "function_definition" if kind == "def" else "class_definition", at, at + len(text[at:end].rstrip()), parent))
        open_.append((indent, kind, name))
    return out


def entities(text: str, language: str) -> list[tuple[str, str, int, int, str | None]] | None:
    """(name, type, start, end, enclosing class) in order; None for languages without entities."""
    lang = "typescript" if language == "tsx" else language
    if lang == "python":
        return _python(text)
    if lang == "terraform":
        out = []
        for m in _TERRAFORM.finditer(text):
            if text[: m.start()].count("{") == text[: m.start()].count("}"):
                name = ".".join([m["kind"], *re.findall(r'"([^"]*)"', m["labels"])])
                out.append((name, "block", m.start(), closing(text, m.end() - 1), None))
        return out
    if lang == "vb":
        out, stack = [], []
        for m in _VB_LINE.finditer(text):
            if m["end"]:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][1].lower() == m["end"].lower():
                        name, kind, at, parent, inside = stack[k]
                        if not inside:
                            types = {"sub": "method_declaration", "function": "method_declaration", "property": "property_declaration", "event": "event_declaration"}
                            out.append((name, types.get(kind.lower(), f"{kind.lower()}_block"), at, m.end(), parent))
                        del stack[k:]
                        break
            else:
                holder = next((x[0] for x in reversed(stack) if x[1].lower() in ("class", "module", "structure", "interface")), None)
                stack.append((m["name"], m["kind"], m.start() + len(m.group()) - len(m.group().lstrip()), holder, any(x[1].lower() in ("sub", "function") for x in stack)))
        return sorted(out, key=lambda x: x[2])
    if lang not in _FUNCTION:
        return None
    mask = spans(text, lang)[0]
    found = [(name, _FUNCTION[lang], start, closing(mask, end - (mask[end - 1] == "{")), False) for start, _, end, name in declarations(mask, lang)]
    for kind, pattern in _CONTAINERS[lang]:
        for m in pattern.finditer(mask):
            start = m.start() + len(m.group()) - len(m.group().lstrip())
            found.append((m["name"], kind, start, closing(mask, m.end()), kind in _HOLDERS))
    out, open_ = [], []
    for name, kind, a, b, holds in sorted(found, key=lambda x: (x[2], -x[3])):
        open_ = [x for x in open_ if x[3] > a]
        if any(not x[4] for x in open_):
            continue  # inside a function
        parent = next((x[0] for x in reversed(open_) if x[1] not in ("type_declaration", "enum_declaration")), None)
        out.append((name, kind, a, b, parent))
        open_.append((name, kind, a, b, holds))
    return out


def chunk_file(repo: str, path: str, text: str, language: str, cfg: Code = Code()) -> list[tuple]:
    """Rows of FIELDS for one file."""
    text = text.removeprefix("\ufeff")
    if not text.strip():
        return []
    budget = cfg.chunk_max_tokens * CHARS_PER_TOKEN
    lines = [m.start() for m in re.finditer("\n", text)]
    line_of = lambda at: bisect.bisect_left(lines, at) + 1
    name_of_file = path.replace("\\", "/").rsplit("/", 1)[-1]

    def row(key: str, body: str, name: str, kind: str, first: int, last: int, signature: str | None, parent: str | None) -> tuple:
        raw = ":".join([*([repo] if repo else []), path, key, str(first)])
        body = body if len(body) <= budget else body[:budget] + CODE_MARK
        return (hashlib.sha256(raw.encode()).hexdigest()[:16], repo, path, body, language, name, kind, f"{first}-{last}", first, last, signature, parent)

    found = entities(text, language)
    if not found:
        return [row("__file__", text, name_of_file, "file", 1, text.count("\n") + 1, None, None)]
    lang = "typescript" if language == "tsx" else language
    groups: list[tuple[int, int]] = []
    strings: list[tuple[int, int]] = []
    if lang in HIDDEN:
        _, groups, strings = spans(text, lang)
    out: dict[str, tuple] = {}
    if cfg.index_file_headers and (head := _header(text, groups, strings if lang == "python" else [], cfg)):
        a, b, body = head
        r = row("__module_doc__", body, name_of_file, "module_doc", line_of(a), line_of(b), None, None)
        out[r[0]] = r
    for name, kind, a, b, parent in found:
        source = text[a:b]
        if not source.strip():
            continue
        parts = [f"# In class {parent}"] if parent else []
        if cfg.include_doc_comments and (doc := _comment_above(text, groups, a, cfg.doc_comment_max_lines)):
            most = int(budget * cfg.doc_budget)
            parts.append(doc if len(doc) <= most else doc[:most].rstrip() + " …")
        r = row(name, "\n".join([*parts, source]), name, kind, line_of(a), line_of(max(a, b - 1)), source.split("\n", 1)[0].strip(), parent)
        out[r[0]] = r
    return list(out.values())


def _comment_above(text: str, comments: list[tuple[int, int]], at: int, most: int) -> str | None:
    """Comments without a blank line between them and the declaration."""
    line = text.rfind("\n", 0, at) + 1
    if text[line:at].strip():
        at = line  # a wrapper such as export begins the line
    ends = [b for _, b in comments]
    k, taken = bisect.bisect_right(ends, at) - 1, []
    while k >= 0:
        gap = text[comments[k][1] : at]
        if gap.strip() or gap.count("\n") > 1:
            break
        begin = text.rfind("\n", 0, comments[k][0]) + 1
        if text[begin : comments[k][0]].strip():
            break  # behind code
        taken.append(comments[k])
        at = comments[k][0]
        k -= 1
    taken.reverse()
    while len(taken) > 1 and text.count("\n", taken[0][0], taken[-1][1]) + 1 > most:
        taken.pop(0)
    return text[taken[0][0] : taken[-1][1]].rstrip() or None if taken else None


def _header(text: str, comments: list[tuple[int, int]], strings: list[tuple[int, int]], cfg: Code) -> tuple[int, int, str] | None:
    """The comments, or the docstring, with which a file begins, if they say something."""
    at, first = 0, None
    for a, b in sorted([*comments, *strings]):
        if text[at:a].strip():
            break
        first, at = (a if first is None else first), b
    if first is None:
        return None
    body = "\n".join(x for x in text[first:at].strip().splitlines() if not x.startswith("#!") and "coding:" not in x).strip()
    low = body.lower()
    return None if len(body) < cfg.header_min_chars or any(m in low for m in LICENCE_MARKS) else (first, at, body)


def code_chunks(files: DataFrame, cfg: Code = Code()) -> DataFrame:
    """files: repo, file_path, text -> chunks (FIELDS) with error: null, or why a file could not be cut (its one row has no text)."""
    names = [*[f.split()[0] for f in FIELDS.split(", ")], "error"]
    kinds = [*[pa.int32() if f.endswith(" int") else pa.string() for f in FIELDS.split(", ")], pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for repo, path, text in zip(*[c.to_pylist() for c in batch.columns]):
                ext = re.search(r"[^./\\](\.[^./\\]+)$", path or "")
                lang = LANGUAGES.get(ext[1].lower()) if ext else None
                if lang and text:
                    try:
                        rows += [(*r, None) for r in chunk_file(repo or "", path, text, lang, cfg)]
                    except Exception as e:  # one file that can't be cut doesn't end the run
                        rows.append((None, repo, path, *[None] * (len(names) - 4), f"{type(e).__name__}: {e}"))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    return files.select(F.col("repo").cast("string"), F.col("file_path").cast("string"), F.col("text").cast("string")).mapInArrow(run, f"{FIELDS}, error string")
