"""Source text in several languages: what is comment, string and code, and what is declared where.

One regular expression per language finds comments and strings; both are blanked out of a
mask of the same length, in which declarations are searched.  No grammar is needed, cut
and broken files are read as far as they go.
"""

from __future__ import annotations

import json
import re

_BLOCK = r"/\*[\s\S]*?(?:\*/|\Z)"
_DQ = r'"(?:\\.|[^"\\\n])*"?'
_SQ = r"'(?:\\.|[^'\\\n])*'?"
_CHAR = r"'(?:\\[^\n]{1,8}?|[^'\\\n])'"
_TICK = r"`(?:\\.|[^`\\])*(?:`|\Z)"
_TRIPLE = r'"""[\s\S]*?(?:"""|\Z)'
#: language -> what hides code: comments (group c) and strings
HIDDEN = {
    "python": re.compile(rf"(?P<c>\#[^\n]*)|(?i:\b[rubf]{{1,2}})?(?:{_TRIPLE}|'''[\s\S]*?(?:'''|\Z)|{_DQ}|{_SQ})"),
    "javascript": re.compile(rf"(?P<c>//[^\n]*|{_BLOCK})|{_TICK}|{_DQ}|{_SQ}|(?<=[=(,:!&|?{{}};\n])[ \t]*/(?![*/ ])(?:\\.|\[(?:\\.|[^\]\n])*\]|[^/\\\n\[])+/[a-z]*"),
    "go": re.compile(rf"(?P<c>//[^\n]*|{_BLOCK})|`[^`]*(?:`|\Z)|{_DQ}|{_CHAR}"),
    "java": re.compile(rf"(?P<c>//[^\n]*|{_BLOCK})|{_TRIPLE}|{_DQ}|{_CHAR}"),
    "csharp": re.compile(rf'(?P<c>//[^\n]*|{_BLOCK})|\$?"""[\s\S]*?(?:"""|\Z)|(?:\$?@|@\$)"(?:""|[^"])*(?:"|\Z)|\$?{_DQ}|{_CHAR}'),
    "rust": re.compile(rf'(?P<c>//[^\n]*|{_BLOCK})|\bb?r(?P<h>\#*)"[\s\S]*?(?:"(?P=h)|\Z)|b?"(?:\\[\s\S]|[^"\\])*(?:"|\Z)|b?{_CHAR}'),
}
HIDDEN["typescript"] = HIDDEN["javascript"]

ARGS = r"\((?:[^()]++|\((?:[^()]++|\([^()]*+\))*+\))*+\)"
_GENERIC = r"(?:<[^<>(){};]*(?:<[^<>(){};]*(?:<[^<>]*>[^<>]*)*>[^<>(){};]*)*>)"
_NO_NAME = {
    "javascript": frozenset(
        "if for while switch catch return new else do try throw typeof delete await yield in of instanceof function class super this import with case default var let const".split()
    ),
    "java": frozenset(
        "if for while switch catch return new else do try throw synchronized assert instanceof super this class interface enum import package case default".split()
    ),
    "csharp": frozenset(
        "if for foreach while switch catch return new else do try throw using lock fixed checked unchecked sizeof typeof nameof stackalloc when in is as base this class interface struct enum namespace case default".split()
    ),
}
_NO_NAME["typescript"] = _NO_NAME["javascript"]
_JS_HEAD = r"(?:(?:public|private|protected|static|async|readonly|override|abstract|declare|accessor|get|set)\s+)*+(?:\*\s*)?"
_MODIFIERS = {
    "java": r"(?:public|private|protected|static|final|abstract|synchronized|native|default|strictfp|transient)",
    "csharp": r"(?:public|private|protected|internal|static|virtual|override|abstract|async|sealed|extern|unsafe|new|partial|readonly)",
}
_TYPE = rf"[A-Za-z_][\w.]*{_GENERIC}?\??(?:\s*\[[,\s]*\])*\??"
_AFTER = {
    "java": r"\s*(?:throws\s+[\w.,\s]+)?(?=[{;]|\Z)",
    "csharp": r"\s*(?:where\s+\w+\s*:[^{;]+|:\s*(?:base|this)\s*\([^{;]*\)\s*)*(?=\{|;|=>|\Z)",
}


def _typed(lang: str) -> re.Pattern:
    m = _MODIFIERS[lang]
    return re.compile(
        rf"(?m)^[ \t]*(?P<head>(?:{m}\s+)*(?:{_GENERIC}\s*)?)(?:(?P<type>{_TYPE}|\([^()]*\)\??)\s+)?(?P<name>[A-Za-z_]\w*)\s*{_GENERIC}?\s*{ARGS}{_AFTER[lang]}"
    )


DECLARED = {
    "python": [re.compile(r"(?m)^[ \t]*(?:async[ \t]+)?def[ \t]+(?P<name>\w+)[ \t]*(?=[\[(])")],
    "go": [re.compile(r"(?m)^[ \t]*func[ \t]*(?:\([^)]*\)[ \t]*)?(?P<name>[^\W\d]\w*)[ \t]*(?=[\[(])")],
    "rust": [re.compile(r"(?m)^[ \t]*(?:pub(?:\s*\([^)]*\))?\s+)?(?:(?:default|const|async|unsafe|extern)\s+)*fn\s+(?P<name>\w+)")],
    "javascript": [
        re.compile(r"(?m)^[ \t]*(?:export\s+)?(?:default\s+)?(?:declare\s+)?(?:async\s+)?function\s*\*?\s*(?P<name>[\w$]+)\s*(?=[<(])"),
        re.compile(rf"(?m)^[ \t]*(?:export\s+)?(?:const|let|var)\s+(?P<name>[\w$]+)\s*(?::[^=\n]+(?:=>[^=\n]+)?)?=\s*(?:async\s*)?(?:function\b|{_GENERIC}?\s*{ARGS}\s*(?::[^={{;\n]+)?=>|[\w$]+\s*=>)"),
        re.compile(rf"(?m)^[ \t]*(?:(?:public|private|protected|static|readonly|override|declare)\s+)*(?P<name>[\w$#]+)\s*(?::[^=\n;]+)?=\s*(?:async\s*)?(?:function\b|{_GENERIC}?\s*{ARGS}\s*(?::[^={{;\n]+)?=>)"),
        re.compile(
            rf"(?m)^[ \t]*+(?P<head>{_JS_HEAD})(?!(?:if|for|while|switch|catch|return|with|function|await|new|throw|typeof|super|else|do)\b)(?P<name>[\w$#]++)\s*{_GENERIC}?\s*{ARGS}"
            rf"(?:\s*:(?:[^;={{}}()]++|{ARGS})++(?:\{{[^{{}}\n]*\}}[^;={{}}\n]*)?\s*(?=\{{|\Z)|\s*(?=\{{))"
        ),
        # a text that ends at the signature: without a modifier or a type it is no other than a call
        re.compile(rf"(?m)^[ \t]*+(?P<head>{_JS_HEAD.replace(')*+', ')++')})(?!(?:if|for|while|switch|catch|return|with|function|await|new|throw|typeof|super|else|do)\b)(?P<name>[\w$#]++)\s*{_GENERIC}?\s*{ARGS}\s*\Z"),
        re.compile(rf"(?m)^[ \t]*(?P<name>[\w$]+)\s*:\s*(?:async\s*)?(?:function\b\s*\*?[\w$]*\s*\(|{ARGS}\s*=>)"),
    ],
    "java": [_typed("java")],
    "csharp": [_typed("csharp")],
}
DECLARED["typescript"] = [
    *DECLARED["javascript"],
    re.compile(rf"(?m)^[ \t]*(?P<head>(?:(?:public|private|protected|static|abstract|override|declare)\s+)+)(?P<name>[\w$]+)\s*{_GENERIC}?\s*{ARGS}\s*(?::[^;={{]+)?;"),
]
EXTENSIONS = {"py": "python", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript", "ts": "typescript", "tsx": "typescript", "go": "go", "java": "java", "rs": "rust", "cs": "csharp"}


def spans(text: str, lang: str) -> tuple[str, list[tuple[int, int]], list[tuple[int, int]]]:
    """(mask, comments, strings): the mask is text with both blanked out."""
    parts, at, comments, strings = [], 0, [], []
    for m in HIDDEN[lang].finditer(text):
        a, b = m.span()
        if a == b:
            continue
        parts.append(text[at:a])
        hidden = text[a:b]
        parts.append("\n".join(" " * len(x) for x in hidden.split("\n")) if "\n" in hidden else " " * (b - a))
        (comments if m["c"] is not None else strings).append((a, b))
        at = b
    parts.append(text[at:])
    return "".join(parts), comments, strings


def declarations(mask: str, lang: str) -> list[tuple[int, int, int, str]]:
    """(start, name's place, end of the head, name), by place."""
    found: dict[int, tuple[int, int, int, str]] = {}
    for pattern in DECLARED[lang]:
        for m in pattern.finditer(mask):
            name = m["name"]
            if name in _NO_NAME.get(lang, ()):
                continue
            if lang in ("java", "csharp"):
                head, kind = m["head"] or "", m["type"]
                if kind in _NO_NAME[lang] or (kind and kind.split("<")[0] in ("return", "new", "throw", "else", "await", "yield", "record", "class", "struct", "enum", "interface", "namespace")):
                    continue
                ends = mask[m.end() : m.end() + 1]
                if kind is None and (ends not in ("{",) if not head.strip() else ends == ""):
                    continue
            start = m.start() + len(m.group()) - len(m.group().lstrip())
            found.setdefault(m.start("name"), (start, m.start("name"), m.end(), name))
    return [found[k] for k in sorted(found)]


_ENDS = re.compile(r"[{};]")


def closing(mask: str, at: int) -> int:
    """End of the block that opens at or after ``at``; of the statement where none opens."""
    k, depth = at, 0
    for m in _ENDS.finditer(mask, at):
        c = m.group()
        if c == "{":
            depth += 1
        elif c == "}":
            depth -= 1
            if depth <= 0:
                return m.end()
        elif depth == 0:
            return m.end()
        k = m.end()
    return len(mask) if depth else k


def language(metadata: str | None, path: str | None) -> str | None:
    meta = {}
    if metadata:
        try:
            meta = json.loads(metadata)
        except ValueError:
            # unreadable: take what can be taken
            meta = dict(re.findall(r'"(language|file_path)"\s*:\s*"([^"]*)"', metadata))
    if not isinstance(meta, dict):
        meta = {}
    lang = str(meta.get("language") or "").lower()
    lang = {"c#": "csharp", "golang": "go", "ts": "typescript", "js": "javascript", "py": "python", "rs": "rust", "cs": "csharp", "tsx": "typescript", "jsx": "javascript"}.get(lang, lang)
    if lang in HIDDEN:
        return lang
    for p in (path, meta.get("file_path")):
        if p and (ext := str(p).rsplit(".", 1)[-1].lower()) in EXTENSIONS:
            return EXTENSIONS[ext]
    return None


_GUESS = (
    ("python", re.compile(r"(?m)^\s*(?:async )?def \w+\(.*$|^from \w+ import |^import \w+$")),
    ("go", re.compile(r"(?m)^func |^package \w+$")),
    ("rust", re.compile(r"(?m)^\s*(?:pub(?:\(\w+\))? )?fn \w+|^use \w+::|^impl ")),
    ("csharp", re.compile(r"(?m)^using [\w.]+;|^namespace |\binternal\b|/// <summary>")),
    ("java", re.compile(r"(?m)^package [\w.]+;|^import [\w.]+;|\b(?:public|private|protected)\b.*\(.*\).*\{")),
    ("typescript", re.compile(r"(?m)\): \w+(?:<.*>)? (?:=> )?\{|\w: (?:string|number|boolean)\b")),
    ("javascript", re.compile(r"(?m)\bfunction\b|=> \{|^const |^class ")),
)


def guess(text: str) -> str | None:
    return next((lang for lang, p in _GUESS if p.search(text)), None)
