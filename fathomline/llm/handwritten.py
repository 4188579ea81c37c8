"""Files not written by hand: made by a tool, minified or bundled, copied from elsewhere, data kept as code.

1. Attribute files (``.gitattributes``) that mark paths as generated or vendored are parsed and
   resolved by glob precedence: the last match of the deepest folder wins, ``-attribute`` says
   that a path is written by hand, which nothing below overrules.
2. The text of a file: the notice at its head, the shape of its lines, the share of literals.
3. Patterns equivalent to attribute files are mined from the corpus and applied to repositories that declare
   nothing: folders and file-name parts under which files that are declared, or whose own text shows
   their origin, are clearly more common than elsewhere (``LIFT``, at ``Z`` deviations), in more than one
   repository, and which no other pattern explains.  Where a corpus is too small to show
   it, well-known patterns (``KNOWN``) stand in.
4. Equal content: a file with the hash of such a file is one, under whatever path.

Scale: chunks are reduced to a few numbers each before the shuffle by (repo, path), so a hot
repository is spread over its files; patterns are aggregated with partial sums by
repository; rules of a repository meet its files in salted parts; files without a hash meet nothing.

Defined results: null repo or path: no file; a file without chunks is judged by path and hash;
rows of one key repeated or older: the latest hash counts, every spelling is reported; unreadable
metadata is ignored; a null hash equals nothing.
"""

from __future__ import annotations

import functools
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.source_text import EXTENSIONS, HIDDEN

LIFT, Z = 1.5, 2.58  # a mined pattern: its share of files not by hand against that of all files, and the deviations by which it must be sure
ROUNDS = 3  # of dropping patterns that others explain
SALT = 16  # parts into which the files of a repository are split where they meet its rules

#: Paths that are generated or vendored by convention, in the syntax of attribute files.
KNOWN = """
vendor/** linguist-vendored
vendors/** linguist-vendored
**/third_party/** linguist-vendored
**/third-party/** linguist-vendored
**/thirdparty/** linguist-vendored
**/node_modules/** linguist-vendored
**/bower_components/** linguist-vendored
**/Godeps/** linguist-vendored
**/vendor/** linguist-vendored
external/** linguist-vendored
deps/src/** linguist-vendored
**/site-packages/** linguist-vendored
**/generated/** linguist-generated
**/__generated__/** linguist-generated
*_pb2.py linguist-generated
*_pb2_grpc.py linguist-generated
*.pb.go linguist-generated
*_pb.js linguist-generated
*_pb.ts linguist-generated
*.pb.cc linguist-generated
*.pb.h linguist-generated
*.g.cs linguist-generated
*.g.dart linguist-generated
*.designer.cs linguist-generated
*.generated.* linguist-generated
*_generated.* linguist-generated
*.gen.* linguist-generated
*.min.js linguist-generated
*.min.css linguist-generated
*.bundle.js linguist-generated
*-bundle.js linguist-generated
"""

# ---- attribute files --------------------------------------------------------------------------------------------


@functools.lru_cache(maxsize=4096)
def glob(pattern: str) -> re.Pattern | None:
    """A pattern of an attribute file as an expression over paths below its folder; None if it can't match files."""
    if not pattern or pattern.startswith("!") or pattern.endswith("/"):
        return None
    rooted = pattern.lstrip("/") if "/" in pattern.rstrip("*") or pattern.startswith("/") else f"**/{pattern}"
    out, k = "", 0
    while k < len(rooted):
        c = rooted[k]
        if rooted.startswith("**/", k):
            out, k = out + "(?:.*/)?", k + 3
        elif rooted.startswith("**", k):
            out, k = out + ".*", k + 2
        elif c == "*":
            out, k = out + "[^/]*", k + 1
        elif c == "?":
            out, k = out + "[^/]", k + 1
        elif c == "[" and (end := rooted.find("]", k + 2)) > 0:
            body = rooted[k + 1 : end]
            out, k = out + "[" + ("^" + body[1:] if body[0] in "!^" else body).replace("\\", "\\\\") + "]", end + 1
        elif c == "\\" and k + 1 < len(rooted):
            out, k = out + re.escape(rooted[k + 1]), k + 2
        else:
            out, k = out + re.escape(c), k + 1
    try:
        return re.compile(out + r"\Z")
    except re.error:
        return None


def rules_of(folder: str, text: str) -> list[tuple[str, str, str]]:
    """(folder, pattern, generated|vendored|hand), in order."""
    out = []
    for line in text.replace("\r", "").split("\n"):
        parts = line.split()
        if len(parts) < 2 or parts[0].startswith("#"):
            continue
        for a in parts[1:]:
            name, _, value = a.lstrip("-!").partition("=")
            if name in ("linguist-generated", "linguist-vendored", "gitlab-generated"):
                off = a[0] in "-!" or value.lower() in ("false", "0", "no")
                out.append((folder, parts[0], "hand" if off else name.rpartition("-")[2]))
    return out


def resolve(path: str, rules: list[tuple[str, str, str]]) -> str | None:
    """What rules say about a path: those of a deeper folder later, then the last match."""
    said = None
    for folder, pattern, kind in sorted(rules, key=lambda r: r[0].count("/") + bool(r[0])):
        below = path if not folder else path[len(folder) + 1 :] if path.startswith(folder + "/") else None
        if below is not None and (g := glob(pattern)) and g.match(below):
            said = kind
    return said


# ---- the text ---------------------------------------------------------------------------------------------------

_MADE = r"(?:generated|created|produced|written|emitted|built)"
_COPY = r"(?:copy|clone|fork|snapshot|mirror)"
_KEPT = r"(?:verbatim|unchanged|unmodified|as[- ]is|without (?:any )?(?:changes?|modifications?|edits?))"
GENERATED = re.compile(
    rf"(?i)@generated\b|<auto-?generated\b|\bauto-?generated (?:file|code|by|from)|\b(?:code|file|source|module) {_MADE} (?:automatically )?(?:by|from|with)\b|\b(?:automatically|auto|machine)[- ]{_MADE}\b"
    rf"|\b{_MADE} automatically\b|\bgenerated (?:by|from|with) .{{0,80}}(?:do not|don't|not) (?:be )?(?:edit|modif|change)|\bthis file (?:was|is|has been) (?:auto-?|automatically )?(?:generated|produced by)"
    r"|\bmanual changes will be (?:lost|overwritten)|\bgenerated file\b.{0,40}(?:do not|don't)|\bdo not (?:edit|modify)[^.]{0,40}\bgenerated\b"
)
VENDORED = re.compile(
    rf"(?i)\b(?:bundled|vendored|embedded|local|verbatim|unmodified|third[- ]party) {_COPY}\b|\b(?:imported|copied|taken|included|vendored) {_KEPT}\b|\bthis file is part of the [\w.-]+ (?:library|project|package|distribution)\b"
    r"|\b(?:vendored|copied|taken|adapted) (?:verbatim )?from https?://|\bvendored from\b|\bthird[- ]party code\b|\bupstream https?://|@license\b.{0,60}\bv?\d+\.\d+"
)
#: A line that denies it.
OURS = re.compile(rf"(?i)\b(?:not|never|no|isn't|wasn't|nothing)\b(?: \w+){{0,2}} (?:{_COPY}|copied|generated|vendored|bundled|imported|machine-made)\b|\bhand-?written\b|\bwritten by hand\b")
_NUMBER = re.compile(r"[-+]?\b(?:0[xX][0-9a-fA-F_]+|0b[01_]+|\d[\d_]*(?:\.\d+)?(?:[eE][-+]?\d+)?)[uUlLfFdDmMnN]{0,3}\b")
_STRING = re.compile(r"\"(?:\\.|[^\"\\\n])*(?:\"|\Z)|'(?:\\.|[^'\\\n])*(?:'|\Z)|`[^`]*(?:`|\Z)")
_WORD = re.compile(r"[^\W\d]\w*")
_CUT = re.compile(r"\n(?:# )?\.\.\. \(truncated\)\s*$")
_BASE64 = re.compile(r"[A-Za-z0-9+/=_-]{120,}|(?:\\x[0-9a-fA-F]{2}){40,}|(?:[0-9a-fA-F]{2}[ :]?){80,}")

MEASURES = ("tool int, vendor int, chars bigint, words bigint, literals bigint, blob bigint, code bigint, blanks bigint, lines bigint, longest bigint")


def measures(text: str, lang: str | None, first_line: int) -> tuple[int, ...]:
    """What one chunk shows: notices at its head, and sums over it."""
    text = _CUT.sub("", text.replace("\r\n", "\n"))
    tool = vendor = 0
    if first_line <= 3:
        for line in text.split("\n"):
            bare = line.strip()
            if not bare:
                continue
            if not re.match(r"//|/?\*|#(?!\[)|<!--|--|'''|\"\"\"|;", bare):
                if re.match(r"package |import |using |use |from |const \w+ = require|['\"]use strict", bare):
                    continue
                break  # the head ends where code begins
            if not OURS.search(bare):
                tool |= bool(GENERATED.search(bare))
                vendor |= bool(VENDORED.search(bare))
    hidden = HIDDEN.get(lang or "", HIDDEN["java"])
    literals: list[str] = []

    def out(m: re.Match) -> str:
        if m["c"] is not None or m.start() == m.end():
            return ""
        literals.append(m.group())
        return '""'

    code = hidden.sub(out, text)
    blob = sum(len(s) for s in literals if _BASE64.search(s))
    strings = sum(map(len, literals))
    bare, numbers = _NUMBER.subn(" ", code)
    words = sum(map(len, _WORD.findall(bare.replace('""', ""))))
    rows = [x for x in code.split("\n") if x.strip()]
    blanks = sum(c.isspace() for c in code)
    return (int(tool), int(vendor), len(code) + strings - 2 * len(literals), words, numbers + len(literals), blob, len(code), blanks, len(rows), max(map(len, rows), default=0))


def path_of(c: Column) -> Column:
    """A path in one spelling."""
    p = F.regexp_replace(F.trim(c), r"[\\/]+", "/")
    return F.regexp_replace(F.regexp_replace(p, r"^(?:\./)+", ""), r"^/|/(?:\./)+", "")


def _meta(metadata: str | None) -> dict:
    try:
        m = json.loads(metadata) if metadata else {}
        return m if isinstance(m, dict) else {}
    except ValueError:
        return {}


def evidence(chunks: DataFrame) -> DataFrame:
    """chunks: repo, file_path, text, metadata -> one row for each (repo, path) with the sums."""
    names = ["repo", "file_path", *[f.split()[0] for f in MEASURES.split(", ")]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for repo, path, text, metadata in zip(*[c.to_pylist() for c in batch.columns]):
                if not text:
                    continue
                meta = _meta(metadata)
                path, repo = path or meta.get("file_path"), repo or meta.get("repo")
                if isinstance(path, str) and isinstance(repo, str):
                    line = meta.get("line_start")
                    line = line if isinstance(line, int) else 1
                    rows.append((repo, path, *measures(text, EXTENSIONS.get(path.rsplit(".", 1)[-1].lower()), line)))
            if rows:
                kinds = [pa.string(), pa.string(), pa.int32(), pa.int32(), *[pa.int64()] * 8]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    each = chunks.select("repo", "file_path", "text", "metadata").mapInArrow(run, f"repo string, file_path string, {MEASURES}")
    total = [F.sum(k).alias(k) for k in ("chars", "words", "literals", "blob", "code", "blanks", "lines")]
    return each.groupBy("repo", path_of(F.col("file_path")).alias("path")).agg(F.max("tool").alias("tool"), F.max("vendor").alias("vendor"), F.max("longest").alias("longest"), *total)


def shown() -> tuple[Column, Column, Column, Column]:
    """tool, vendor, minified, data: what the sums of a file say."""
    c = F.col
    data = (c("chars") >= 200) & (c("words") < 0.15 * c("chars")) & ((c("literals") >= 30) | (c("blob") > 0.5 * c("chars")))
    mini = (c("longest") >= 300) & (c("code") > 150 * c("lines")) & (c("blanks") < 0.08 * c("code")) & (c("words") >= 0.15 * c("chars"))
    return c("tool") > 0, c("vendor") > 0, mini, data


# ---- mined patterns ---------------------------------------------------------------------------------------------

def path_parts(path: Column) -> Column:
    """Folders and the part before the extension, without numbers: what patterns are made of."""
    low = F.lower(path)
    plain = lambda x: F.regexp_replace(x, r"\d+", "#")
    folders = F.transform(F.filter(F.split(F.regexp_extract(low, "^(.*)/", 1), "/"), lambda x: x != ""), lambda x: F.concat(F.lit("dir:"), plain(x)))
    part = F.regexp_extract(F.regexp_extract(low, r"([^/]*)$", 1), r"[._-]([^._-]+)\.[^.]+$", 1)
    kind = F.when(part.rlike(r"^(?=.*\d)[0-9a-f]{8,}$"), "<hex>").otherwise(plain(part))
    return F.array_distinct(F.concat(folders, F.when(part != "", F.array(F.concat(F.lit("part:"), kind))).otherwise(F.array().cast("array<string>"))))


def mined(files: DataFrame) -> DataFrame:
    """files: repo, path, origin (null: not known to be other than by hand) -> (repo, path) under mined patterns."""
    from ..functions.shared import written

    hit = F.col("origin").isNotNull().cast("int")
    usual = files.agg(F.avg(hit)).first()[0] or 0.0  # one number
    parts = files.select("repo", "path", hit.alias("hit"), F.explode(path_parts(F.col("path"))).alias("part"))
    per = parts.groupBy("part", "repo").agg(F.sum("hit").alias("hits"), F.count("*").alias("files")).groupBy("part")
    per = per.agg(F.sum("hits").alias("h"), F.sum("files").alias("n"), F.count_if(F.col("hits") > 0).alias("repos"))
    # lower end of the share's interval after Wilson: sure of a few files as of many
    q, n = F.col("h") / F.col("n"), F.col("n")
    low = (q + Z * Z / (2 * n) - Z * F.sqrt(q * (1 - q) / n + Z * Z / (4 * n * n))) / (1 + Z * Z / n)
    found = per.filter((F.col("repos") > 1) & (low >= LIFT * usual)).select("part")
    held = written(parts.join(found, "part", "left_semi"), "mined")
    for _ in range(ROUNDS):
        # files that no other pattern holds must show it too; a pattern that is never alone stays
        alone = held.groupBy("repo", "path").agg(F.count("*").alias("k"), F.min("part").alias("part"), F.max("hit").alias("hit")).filter("k = 1")
        explained = alone.groupBy("part").agg(F.sum("hit").alias("h"), F.count("*").alias("n")).filter((F.col("h") + 0.5) / (F.col("n") + 1) < LIFT * usual)
        held = held.join(explained, "part", "left_anti")
    return held.select("repo", "path").distinct()


def by_rules(files: DataFrame, rules: DataFrame) -> DataFrame:
    """Adds said: what attribute files (rules: repo, rules ARRAY<STRUCT>) or else well-known patterns say."""
    known = rules_of("", KNOWN)
    tests = [(g, k) for _, p, k in known if (g := glob(p))]
    parts = rules.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    joined = files.withColumn("__salt", F.pmod(F.xxhash64("path"), F.lit(SALT)).cast("int")).join(parts, ["repo", "__salt"], "left").select("repo", "path", "rules")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            said = []
            for path, own in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                kind = resolve(path, [(r["folder"], r["pattern"], r["kind"]) for r in sorted(own, key=lambda r: r["k"])]) if own else None
                if kind is None and any(g.match(path) for g, _ in tests):
                    kind = "known"
                said.append(kind)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(said, pa.string())], names=["repo", "path", "said"])

    return joined.mapInArrow(run, "repo string, path string, said string")


def attribute_rules(chunks: DataFrame) -> DataFrame:
    """(repo, rules) of the attribute files among the chunks."""
    name = path_of(F.col("file_path"))
    files = chunks.filter(name.rlike(r"(?:^|/)\.gitattributes$") & F.col("text").isNotNull() & F.col("repo").isNotNull())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(repo, k, *r) for repo, path, text in zip(*[c.to_pylist() for c in batch.columns]) for k, r in enumerate(rules_of(path.rpartition("/")[0], text))]
            if rows:
                kinds = [pa.string(), pa.int32(), pa.string(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["repo", "k", "folder", "pattern", "kind"])

    each = files.select("repo", name.alias("path"), "text").mapInArrow(run, "repo string, k int, folder string, pattern string, kind string")
    return each.groupBy("repo").agg(F.collect_set(F.struct("k", "folder", "pattern", "kind")).alias("rules"))


def not_by_hand(file_hashes: DataFrame, chunks: DataFrame) -> DataFrame:
    """(repo, file_path, reason), as spelt in file_hashes."""
    from ..functions.shared import written

    listed = file_hashes.filter("repo is not null and file_path is not null").select("repo", "file_path", path_of(F.col("file_path")).alias("path"), F.lower(F.trim("hash")).alias("hash"), "last_indexed")
    latest = listed.groupBy("repo", "path").agg(F.max_by("hash", F.coalesce(F.col("last_indexed"), F.lit("1970-01-01").cast(listed.schema["last_indexed"].dataType))).alias("hash"))
    tool, vendor, mini, data = shown()
    seen = evidence(chunks).select("repo", "path", F.when(tool, "tool").when(vendor, "vendor").when(mini, "minified").when(data, "data").alias("origin"))
    files = written(latest.join(seen, ["repo", "path"], "left"), "files")
    said = by_rules(files, attribute_rules(chunks))
    judged = written(files.join(said, ["repo", "path"], "left"), "said")
    by_hand, declared = F.col("said").eqNullSafe("hand"), F.when(~F.col("said").isin("hand", "known"), F.col("said"))
    shows = F.when(~by_hand, F.coalesce(declared, F.when(F.col("origin") != "data", F.col("origin"))))
    told = mined(judged.select("repo", "path", shows.alias("origin"))).withColumn("mined", F.lit(True))
    judged = judged.join(told, ["repo", "path"], "left")
    reason = F.when(~by_hand, F.coalesce(declared, F.col("origin"), F.when(F.col("mined"), "mined"), F.when(F.col("said").isNotNull(), "known")))
    judged = judged.select("repo", "path", "hash", by_hand.alias("by_hand"), reason.alias("reason"))
    empty = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"  # of no content, equal everywhere
    copies = judged.filter((F.col("reason").isNotNull()) & (F.col("hash") != "") & (F.col("hash") != empty)).select("hash").distinct().withColumn("copy", F.lit(True))
    keyed = judged.withColumn("hash", F.coalesce("hash", F.concat(F.lit("\u0000"), "repo", F.lit("\u0000"), "path")))  # files without a hash are spread
    judged = keyed.join(copies, "hash", "left").select("repo", "path", F.coalesce("reason", F.when(F.col("copy") & ~F.col("by_hand"), "copy")).alias("reason")).filter("reason is not null")
    return listed.select("repo", "file_path", "path").distinct().join(judged, ["repo", "path"]).select("repo", "file_path", "reason")
