"""Functions paired with their documentation, out of source text in seven languages.

Comment spans and declarations are extracted independently: one regular expression per
language finds comments and strings, which are blanked out of a mask of the same
length; declarations are then searched in the mask, so what stands in strings, comments and
examples declares nothing.  An as-of interval join takes, for each declaration, the
nearest comment that ends before it, and rejects it if anything but decorators or
attributes lies between, a blank line included.  In Python the docstring counts as well.

Every row is taken by itself: no shuffle, and a row is as large as its text.

Defined results: null and empty texts, unknown languages: no cases; unreadable metadata:
the language follows from the file's extension, then from the text; cut texts are read as far
as they go; repeated rows give repeated cases.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.source_text import ARGS, closing, declarations, guess, language, spans

LEAST_WORDS = 5

_NESTED = r"(?:[^\[\]]|\[(?:[^\[\]]|\[[^\[\]]*\])*\])*"
#: What may stand between a comment and the declaration.
_BETWEEN = {
    "python": re.compile(rf"[ \t]*\n(?:[ \t]*@[\w.]+[ \t]*(?:{ARGS})?[ \t]*\n)*[ \t]*"),
    "java": re.compile(rf"[ \t]*\n?(?:[ \t]*@[\w.]+[ \t]*(?:{ARGS})?[ \t]*\n?)*[ \t]*"),
    "typescript": re.compile(rf"[ \t]*\n?(?:[ \t]*@[\w.]+[ \t]*(?:{ARGS})?[ \t]*\n?)*[ \t]*"),
    "csharp": re.compile(rf"[ \t]*\n?(?:[ \t]*\[{_NESTED}\][ \t]*\n?)*[ \t]*"),
    "rust": re.compile(rf"[ \t]*\n?(?:[ \t]*\#!?\[{_NESTED}\][ \t]*\n?)*[ \t]*"),
    "go": re.compile(r"[ \t]*\n?[ \t]*"),
}
_BETWEEN["javascript"] = _BETWEEN["typescript"]
_BLANK = re.compile(r"\n[ \t]*\n")

# ---- what counts as documentation ------------------------------------------------------------------------------

_MARKS = re.compile(r"(?m)^[ \t]*(?:/\*+!?|\*+/|\*(?!/)|//+!?|\#+!?)[ \t]?|[ \t]*\*+/[ \t]*$")
_DIRECTIVE = re.compile(
    r"(?i)^\W*(?:noqa\b|type:\s*ignore|pylint:|flake8:|mypy:|pragma:|fmt:|isort:|yapf:|ruff:|nosec\b|eslint\b|eslint-|tslint:|jshint\b|jslint\b|prettier-|@ts-|ts-ignore|istanbul |c8 ignore|v8 ignore|webpack|"
    r"nolint|go:[a-z]+\b|\+build|lint:|nosonar|noinspection|checkstyle[:.]|@?suppresswarnings|spotless:|formatter:|resharper |rustfmt|clippy[: ]|clippy::|pragma |region\b|endregion\b|coverage:|@?formatter|stylelint|cspell|spell-?checker|sonar|codeql|biome-ignore|deno-lint|nopep8|cSpell)"
)
_TODO = re.compile(r"(?i)^\W*(?:todo|fixme|xxx|hack|tbd|wip|to be (?:done|documented|written)|needs? (?:doc|comment))\b")
_LICENCE = re.compile(r"(?i)^\W*copyright\b|copyright \(c\)|^\W*\(c\)|licen[sc]ed under|spdx-|all rights reserved")
_HEADER = re.compile(
    r"(?i)@generated|auto-?generated|code generated|do not (?:edit|modify)|generated (?:by|from)|(?:created|produced) automatically|\bthis file is part of|^\W*part of the .{1,60}\b(?:version|release|v) ?\d|"
    r"\bupstream https?://|^\W*[\w.-]+ v\d+(?:\.\d+)+\b|^\W*the .{1,60} contributors$"
)
_XML_OUT = re.compile(r"(?is)<(param|typeparam|returns?|exception|example|code|remarks-code|seealso|permission|value|c)\b[^>]*>.*?(?:</\1>|\Z)|</?[a-z][\w.-]*(?:\s[^<>]*)?/?>")
_FENCE = re.compile(r"(?s)```.*?(?:```|\Z)|~~~.*?(?:~~~|\Z)")
_INLINE = re.compile(r"\{@\w+[^{}]*\}|`[^`\n]*`")
_TAG = re.compile(r"^\s*(?:[@\\](?:[A-Za-z][\w-]*)|:(?:param|type|return|returns|rtype|raises?|arg|keyword|var|ivar|meta|yields?)\b[^:\n]*:)")
_SECTION = re.compile(
    r"(?i)^\s*#*\s*(?:args|arguments|parameters|params|returns?|yields?|raises?|throws?|examples?|usage|errors|panics|safety|see also|attributes|notes?-code)\s*:{1,2}\s*$"
    r"|^\s*#+\s*(?:examples?|arguments|parameters|returns?|errors|panics|safety|usage)\s*$"
)
_CODE_LINE = re.compile(
    r"[;{}]\s*$|^\s*(?:def|class|return|import|from|if|for|while|elif|else|try|except|with|func|fn|let|const|var|public|private|static)\b.*[:;({})=]\s*$|^\s*[\w.\[\]]+\s*(?:=|\+=|:=)\s*\S|^\s*[\w.]+\([^)]*\)\s*;?\s*$|^\s*return\b[^.]*$|^\s*>>>|^\s*\$ |^\s*@\w+\("
)
_WORDS = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
_PIECES = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[^\W\d_A-Z]+")


def prose(doc: str) -> list[str]:
    """Words of a comment or docstring that are prose."""
    text = _FENCE.sub("\n", _MARKS.sub("", doc))
    if "<" in text:
        text = _XML_OUT.sub(" ", text)
    out, skip, example = [], False, False
    for line in text.split("\n"):
        bare = line.strip()
        if not bare:
            skip = example = False
            continue
        if _SECTION.match(line) or _TAG.match(line):
            skip = True
            continue
        if bare.startswith(">>>"):
            example = True
        if skip or example or _HEADER.search(bare) or _DIRECTIVE.match(bare):
            continue
        if _TODO.match(bare) or _LICENCE.search(bare):
            skip = True  # the note, the licence goes on
            continue
        if _CODE_LINE.search(bare):
            continue
        out.append(_INLINE.sub(" ", line))
    return _WORDS.findall(" ".join(out)) if out else []


def counts(doc: str, name: str) -> bool:
    """Whether documentation is real: enough prose, and more than the words of the name."""
    found = prose(doc)
    if sum(map(_japanese, found)) or any(len(w) > 24 for w in found):
        found = [p for w in found for p in ([w] if not _japanese(w) else list(w))]
    if len(found) < LEAST_WORDS:
        return False
    own = {p.lower() for p in _PIECES.findall(name)} | {name.lower()}
    filler = {"the", "a", "an", "this", "that", "is", "of", "for", "to", "and", "function", "method"}
    more = [w for w in found if w.lower() not in own and w.lower() not in filler and w.lower().rstrip("s") not in own]
    return bool(more)


def _japanese(w: str) -> bool:
    return any("぀" <= c <= "鿿" for c in w)


# ---- spans ------------------------------------------------------------------------------------------------------


def _groups(text: str, comments: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Comments that begin a line; line comments in consecutive lines are one."""
    out: list[tuple[int, int]] = []
    for a, b in comments:
        line = text.rfind("\n", 0, a) + 1
        if text[line:a].strip():
            continue
        if out and not text.startswith("/*", a):
            c, d = out[-1]
            between = text[d:a]
            if not text.startswith("/*", c) and between.count("\n") == 1 and not between.strip():
                out[-1] = (c, b)
                continue
        out.append((a, b))
    return out


def _docstring(text: str, mask: str, strings: dict[int, int], at: int) -> str | None:
    """The string that is the first statement after the head that begins at ``at``."""
    depth, k, n = 0, at, len(mask)
    while k < n:
        c = mask[k]
        if c in "([{":
            depth += 1
        elif c in ")]}":
            depth -= 1
        elif c == ":" and depth == 0:
            break
        k += 1
    k += 1
    while k < n:
        c = text[k]
        if c in " \t\n\\":
            k += 1
        elif c == "#":
            k = text.find("\n", k)
            if k < 0:
                return None
        else:
            break
    if k >= n or k not in strings:
        return None
    raw = text[k : strings[k]]
    m = re.match(r"(?i)([rub]{0,2})(\"\"\"|'''|\"|')", raw)
    if not m or "b" in m[1].lower():
        return None
    body = raw[m.end() :]
    return body[: -len(m[2])] if body.endswith(m[2]) else body


def _body_end(mask: str, lang: str, start: int, head: int) -> int:
    """End of the function whose head ends at ``head``: of its block, or of the statement where it has none."""
    if lang != "python":
        return min(len(mask), closing(mask, head - (mask[head - 1] in "{;")))
    line = mask.rfind("\n", 0, start) + 1
    indent = len(mask[line:start].expandtabs())
    depth, k, n = 0, head, len(mask)
    while k < n and (mask[k] != ":" or depth):  # the colon that ends the head
        depth += (mask[k] in "([{") - (mask[k] in ")]}")
        k += 1
    end = mask.find("\n", k)
    if end < 0:
        return n
    if mask[k + 1 : end].strip():
        return end  # on one line
    last = end
    for m in _LINE.finditer(mask, end + 1):
        if m[0].strip() and len(m["indent"].expandtabs()) <= indent:
            break
        if m[0].strip():
            last = m.end()
    return last


_LINE = re.compile(r"(?m)^(?P<indent>[ \t]*).*$")


def clean(doc: str) -> str:
    """Documentation without comment marks and common indentation."""
    plain = _MARKS.sub("", doc)
    lines = [x.rstrip() for x in plain.strip("\n").split("\n")]
    first = 0 if plain.startswith("\n") else 1  # what follows an opening quote isn't indented
    deep = min((len(x) - len(x.lstrip()) for x in lines[first:] if x.strip()), default=0)
    return "\n".join([*[x.strip() for x in lines[:first]], *[x[deep:] for x in lines[first:]]]).strip()


def documented(text: str, lang: str) -> list[tuple[str, int, str, int, int]]:
    """(name, line of the name, documentation, start of the declaration, end of its head) of each function with real documentation; places in the text with plain line ends."""
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    mask, comments, strings = spans(text, lang)
    found = declarations(mask, lang)
    if not found:
        return []
    groups = _groups(text, comments)
    ends = [b for _, b in groups]
    literal = dict(strings)
    lines = [m.start() for m in re.finditer("\n", text)]
    out = []
    for start, place, end, name in found:
        doc = None
        k = bisect.bisect_right(ends, start) - 1  # as of the declaration: the last comment that ends before it
        if k >= 0:
            gap = text[ends[k] : start]
            if not _BLANK.search(gap) and _BETWEEN[lang].fullmatch(mask[ends[k] : start]):
                doc = text[slice(*groups[k])]
        if doc is not None and not counts(doc, name):
            doc = None
        if doc is None and lang == "python":
            doc = _docstring(text, mask, literal, end)
            if doc is not None and not counts(doc, name):
                doc = None
        if doc is not None:
            out.append((name, bisect.bisect_left(lines, place) + 1, doc, start, end))
    return out


def with_code(text: str, lang: str, found: list[tuple[str, int, str, int, int]]) -> list[tuple[int, int, str, str]]:
    """(start, end, code, documentation) of found functions: places count from 0 in the text as it is, whatever its line ends."""
    plain = text.replace("\r\n", "\n").replace("\r", "\n")
    mask = spans(plain, lang)[0]
    # plain places of the line ends that were two characters
    twice = [m.start() - i for i, m in enumerate(re.finditer("\r\n", text))] if "\r\n" in text else []
    out = []
    for _, _, doc, start, head in found:
        a, b = start, _body_end(mask, lang, start, head)
        a, b = a + bisect.bisect_left(twice, a), b + bisect.bisect_left(twice, b)
        out.append((a, b, text[a:b], clean(doc)))
    return out


def functions(chunks: DataFrame, chunk_id: str, text: str, metadata: str, path: str) -> DataFrame:
    """(chunk_id, func_name, decl_line) of every function with real documentation."""
    return _each(chunks, chunk_id, text, metadata, path, False)


def pairs(chunks: DataFrame, chunk_id: str, text: str, metadata: str, path: str) -> DataFrame:
    """(chunk_id, func_name, decl_line, start_pos, end_pos, code, documentation) of every function with real documentation.

    code is the text from start_pos (from 1) up to end_pos (the last character), as it stands; documentation is without marks.
    """
    return _each(chunks, chunk_id, text, metadata, path, True)


def _each(chunks: DataFrame, chunk_id: str, text: str, metadata: str, path: str, code: bool) -> DataFrame:
    fields = [("func_name", "string", pa.string()), ("decl_line", "int", pa.int32())]
    if code:
        fields += [("start_pos", "int", pa.int32()), ("end_pos", "int", pa.int32()), ("code", "string", pa.string()), ("documentation", "string", pa.string())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rows = [], []
            for i, (t, meta, p) in enumerate(zip(*[batch.column(k).to_pylist() for k in (1, 2, 3)])):
                if t and (lang := language(meta, p) or guess(t)):
                    found = documented(t, lang)
                    at += [i] * len(found)
                    rows += [(f[0], f[1], a + 1, b, c, d) for f, (a, b, c, d) in zip(found, with_code(t, lang, found))] if code else [f[:2] for f in found]
            if at:
                cols = [batch.column(0).take(pa.array(at)), *[pa.array(c, f[2]) for c, f in zip(zip(*rows), fields)]]
                yield pa.RecordBatch.from_arrays(cols, names=["chunk_id", *[f[0] for f in fields]])

    rows = chunks.select(F.col(chunk_id).cast("string"), text, metadata, path)
    return rows.mapInArrow(run, ", ".join(["chunk_id string", *[f"{n} {k}" for n, k, _ in fields]]))
