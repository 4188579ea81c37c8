"""Training-data operators against small brute-force versions and defined cases."""

import json
import random
import re

import pytest

pytest.importorskip("fathomline.llm")

from pyspark.sql import functions as F  # noqa: E402

from fathomline.llm import cuts, documented, handwritten, leaks, personal, tokens  # noqa: E402
from fathomline.llm.conversations import conversations  # noqa: E402

# ---- 1 functions and documentation ------------------------------------------------------------------------------

PY = '''import os

# Gives the sum of two small numbers.
def plain(a, b):
    return a + b

@cached(ttl=5)
@other
def decorated(x):
    """Walks all rows of the table once.

    Args:
        x: the thing
    """

# TODO: describe this one properly some day
def todo(): pass

# Sorts all rows of the shard by their age.

def blank_between(): pass

# noqa: C901
def directive(): pass

# def old(row):
#     return row.get('key')
def disabled(): pass

def fetch_page():
    """Fetch page."""

def params_only(a):
    """
    :param a: the first of all the many arguments
    :return: nothing at all in any case
    """

TEXT = """
# Real words in a string are no comment.
def inside(): pass
"""

class A:
    def __init__(self):
        \'\'\'Builds the object from all its parts.\'\'\'
    async def multi(
        self,
        a: dict[str, int] = {"k": 1},
    ) -> list:
        # keep late batches out
        """Collects every late batch of the day."""
'''


def found(text, lang):
    return [(n, i) for n, i, *_ in documented.documented(text, lang)]


def test_python():
    assert found(PY, "python") == [("plain", 4), ("decorated", 9), ("__init__", 45), ("multi", 47)]
    assert found(PY.replace("\n", "\r\n"), "python") == found(PY, "python")


def test_other_languages():
    js = '/**\n * Walks all rows of one shard.\n * @param a the row\n */\nexport const run = async (a) => {\n  let t = "/** Looks like a documented function. */ function fake() {}";\n}\n// Yields every row of the table.\n// eslint-disable-next-line\nfunction two() {}\nclass A {\n  /** Drops all stale rows of the day. */\n  static get(x) {\n    if (x) { y(); }\n  }\n  /** {@inheritDoc} */\n  constructor() {\n  }\n}\n'
    assert found(js, "javascript") == [("run", 5), ("two", 10), ("get", 13)]
    go = "package x\n\n// Name gives the rows back in their order.\nfunc (s *Store) Name(a int) error {\n}\n\n// query(row);\n// return row.key;\nfunc Old() {\n}\n"
    assert found(go, "go") == [("Name", 4)]
    rs = "/// Collects stale rows while the lock is held.\n#[inline]\npub(crate) fn a<'x>(s: &'x str) -> u8 {\n    1\n}\n/// ------\nfn b() {}\n"
    assert found(rs, "rust") == [("a", 3)]
    java = 'public class A {\n  /** Builds it from all of its parts. */\n  public A(String s) {\n  }\n  /** Returns the rows of one shard only. */\n  @Override\n  public List<Map<String, Row>> get(int a) throws IOException {\n    return call(a);\n  }\n}\n'
    assert found(java, "java") == [("A", 3), ("get", 7)]
    cs = "/// <summary>\n/// Checks every row of the open shard.\n/// </summary>\n/// <param name=\"a\">five words are in here now</param>\n[Obsolete]\npublic async Task<int> Check(int a)\n{\n}\n/// <summary>.</summary>\n/// <param name=\"a\">five words are in here now</param>\npublic void No() { }\n"
    assert found(cs, "csharp") == [("Check", 6)]


def test_pairs_rows(spark):
    rows = [("a", PY, '{"language": "python"}', None, "clash"), ("a", PY, '{"language": "python"}', None, "clash"), ("b", None, None, None, ""), ("c", "", "{", "x.py", ""), ("d", PY, '{"broken', "x.py", ""), ("e", "text only", None, "x.md", "")]
    df = spark.createDataFrame(rows, "chunk_id string, text string, metadata string, file_path string, func_name string")
    got = documented.pairs(df, "chunk_id", "text", "metadata", "file_path")
    assert sorted((r.chunk_id, r.n) for r in got.groupBy("chunk_id").agg(F.count("*").alias("n")).collect()) == [("a", 8), ("d", 4)]
    assert documented.pairs(df.limit(0), "chunk_id", "text", "metadata", "file_path").count() == 0


# ---- 3 files not written by hand --------------------------------------------------------------------------------


def test_attribute_rules():
    rules = handwritten.rules_of("", "*.js linguist-generated\nlib/** linguist-vendored=true\n# x\n*.md text\n") + handwritten.rules_of("lib/own", "*.js -linguist-generated\n* !linguist-vendored\n")
    said = lambda p: handwritten.resolve(p, rules)
    assert said("a/b.js") == "generated" and said("lib/a.py") == "vendored" and said("lib/own/a.js") == "hand" and said("src/a.py") is None
    assert handwritten.glob("[").match("[") and handwritten.glob("a/") is None


def test_files(spark):
    data = "DATA = [" + ", ".join(str(random.Random(1).randrange(10**5) + i) for i in range(200)) + "]"
    mini = "!function(){" + "".join(f"function a{i}(t,e){{return t?e[t]:{i}}}var b{i}=!0;" for i in range(40)) + "}();"
    hand = "// Ids generated here are stable; do not edit the page while a run is on.\nfunction run() {\n  const PATTERN = 'a|b|" + "|".join(f"word{i}" for i in range(80)) + "';\n  return other(PATTERN, 1, 2);\n}\n" * 3
    files = {
        "src/gen.py": "# Code generated by protoforge v3. DO NOT EDIT.\ndef f(): pass\n", "src/lib.go": "// x-y v1.2 - bundled copy, upstream https://x.example/1.2\npackage a\n", "src/d.py": data, "src/m.js": mini,
        "src/minify.js": hand, "vendor/x/y.py": "def z(): pass\n", "src/ok.py": "# Part of the mirror service, version 7. Ours, not a copy.\nx = 1\n", "src/copy.go": "package copied\n", "src/off.min.js": "var a = 1;\n",
        "src\\odd\\a_pb2.py": "x = 1\n", ".gitattributes": "src/off.min.js -linguist-generated\nsrc/marked/** linguist-generated\n", "src/marked/q.py": "y = 2\n",
    }
    chunks = spark.createDataFrame([("r", p.replace("\\", "/"), t, json.dumps({"file_path": p, "line_start": 1})) for p, t in files.items()] + [("r", None, None, None), (None, "x", "y", "[1]")], "repo string, file_path string, text string, metadata string")
    same = {"src/lib.go": "AA", "src/copy.go": "aa"}
    hashes = spark.createDataFrame([("r", p, same.get(p, f"h{i}"), None) for i, p in enumerate(files) if p != ".gitattributes"] + [("r", None, "x", None), ("r", "./src/gen.py", "h0", None)], "repo string, file_path string, hash string, last_indexed timestamp_ntz")
    got = {r.file_path: r.reason for r in handwritten.not_by_hand(hashes, chunks).collect()}
    assert got == {"src/gen.py": "tool", "./src/gen.py": "tool", "src/lib.go": "vendor", "src/d.py": "data", "src/m.js": "minified", "vendor/x/y.py": "known", "src/copy.go": "copy", "src\\odd\\a_pb2.py": "known", "src/marked/q.py": "generated"}
    assert handwritten.not_by_hand(hashes.limit(0), chunks.limit(0)).count() == 0


# ---- 5 personal data --------------------------------------------------------------------------------------------

LEX = personal.Lexicon({"marit", "noor"}, {"sorvali", "halloway-reyes"}, counting={"build", "lists"})


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Please ask Marit Sorvali today", [("name", "Marit Sorvali")]),
        ("SORVALI, NOOR wrote; M. Halloway-Reyes and Noor S. agreed, so did Marit K. Sorvali.", [("name", "SORVALI, NOOR"), ("name", "M. Halloway-Reyes"), ("name", "Noor S."), ("name", "Marit K. Sorvali")]),
        ("marit.sorvali@example.org and @marit_sorvali, <@U123>", [("email", "marit.sorvali@example.org")]),
        ("write to a.b (at) corp (dot) test or x_y at mail dot example dot net.", [("email", "a.b (at) corp (dot) test"), ("email", "x_y at mail dot example dot net")]),
        ("git@forge.example:a/b.git left-shift@22.4.1 @cached(ttl=9)", []),
        ("call (653) 555-0124, 415-555-0133, 1.701.555.0177, +49 30 23125 569, 07700 900619 or 06 39 98 18 08.", [("phone", "(653) 555-0124"), ("phone", "415-555-0133"), ("phone", "1.701.555.0177"), ("phone", "+49 30 23125 569"), ("phone", "07700 900619"), ("phone", "06 39 98 18 08")]),
        ("Trace 7f3a lists 10.433.555.0142; SKU-415-555-4836-X; Epoch 1735565000; +1, I agree", []),
        ("SSN 925 64 1182, id QQ 98 17 58 A, no. X54627173; Build 912-44-4947 of it", [("idnum", "925 64 1182"), ("idnum", "QQ 98 17 58 A"), ("idnum", "X54627173")]),
        ("lives at Flat 24, 109 Tilbarrow Road, Ostwick, tel.", [("address", "Flat 24, 109 Tilbarrow Road, Ostwick")]),
        ("at Calle Netherby 10, 32456 San Berrano and 23 rue de Tilbarrow, 89921 Villemorte", [("address", "Calle Netherby 10, 32456 San Berrano"), ("address", "23 rue de Tilbarrow, 89921 Villemorte")]),
        ("an Ostwickstraße 153, 80052 Graufeld. P.O. Box 7569, Ostwick.", [("address", "Ostwickstraße 153, 80052 Graufeld"), ("address", "P.O. Box 7569, Ostwick")]),
        ("The Main Street tile set has 35 layers", []),
        ("İİ Marit Sorvali", [("name", "Marit Sorvali")]),
        ("", []), (None, []),
    ],
)
def test_places(text, want):
    assert [(k, text[a:b]) for a, b, k in personal.Finder(LEX).places(text)] == want


def test_bootstrapping_and_redaction(spark):
    people = [(f"{g} {f}",) for g in ("Marit", "Noor", "Tobin") for f in ("Sorvali", "Kestrin", "Okonedo")] + [("Relay Bot",), (None,), ("",)]
    texts = [(f"Please contact {n} at once. The reporter, {n}, can wait. With Copper Lantern off.",) for n, in people if n and "Bot" not in n]
    texts += [("Please contact Zelda Quint at once. The reporter, Zelda Quint, can wait. Z. Quint and Quint, Zelda too.",), (None,), ("",), ("Kennziffer 900-11-2222 and Vorgang 900-11-3333",)]
    texts += [(f"Kennziffer QQ12345{i}C. Then Vorgang 900-11-333{i}, Vorgang {i}17 and Vorgang 4.{i}",) for i in range(5)]
    df = spark.createDataFrame(texts, "text string")
    lex = personal.learn(df, [spark.createDataFrame(people, "n string")])
    # nobody of this name is in a table; neither word is in the code
    assert {"zelda"} <= lex.given and {"quint"} <= lex.family and "copper" not in lex.given and "bot" not in lex.family and not lex.people
    assert "vorgang" in lex.counting and "kennziffer" not in lex.counting
    assert [k for *_, k in personal.Finder(lex).places("Kennziffer 900-11-2222 and Vorgang 900-11-3333")] == ["idnum"]
    # with the graph switched off nothing but the full names of the table is found
    off = personal.Finder(personal.Lexicon(people={("marit", "sorvali")}))
    assert off.places("Marit Sorvali, Sorvali, Marit, M. Sorvali and Zelda Quint; Vorgang 900-11-3333") == [(0, 13, "name"), (15, 29, "name"), (67, 78, "idnum")]
    rows = df.select(F.lit("t").alias("tab"), F.lit("k").alias("row_key"), "text")
    out = {r.text for r in personal.redact(rows, lex).collect()}
    assert "Please contact <NAME> at once. The reporter, <NAME>, can wait. <NAME> and <NAME> too." in out and None in out and "" in out
    assert personal.find_places(rows.limit(0), lex).count() == 0
    assert personal.learn(df.limit(0), [spark.createDataFrame([], "n string")]) == personal.Lexicon()


# ---- 7 conversations --------------------------------------------------------------------------------------------


def brute(rows):
    sessions = {}
    for s, e, k, m, t in set(rows):
        k = (k or "").strip().lower()
        if s is None or e is None or k not in ("user", "assistant"):
            continue
        try:
            j = json.loads(m)
        except (TypeError, ValueError):
            j = None
        j = j if isinstance(j, dict) else {}
        c = j.get("content")
        words = c if isinstance(c, str) else "" if not isinstance(c, list) or any(b["type"] == "tool_result" for b in c) else "\n".join(b["text"] for b in c if b["type"] == "text")
        words = re.sub(r"(?s)<(system-reminder|local-command-[\w-]+)>.*?</\1>", "", words)
        sessions.setdefault(s, []).append((t is not None, t or 0, e, k, j.get("role") != k or t is None, bool(words.strip())))
    out = set()
    for s, x in sessions.items():
        x.sort()
        w = [(e, k) for *_, e, k, _, ok in x if ok]
        if any(bad for *_, bad, _ in x) or not w or w[0][1] != "user" or w[-1][1] == "user" or any(a[1] == b[1] == "user" for a, b in zip(w, w[1:])):
            continue
        turn, last = 0, None
        for e, k in w:
            turn += k != last
            last = k
            out.add((s, turn, k, e))
    return out


def test_conversations(spark):
    rng = random.Random(5)
    text = lambda s: rng.choice([s, [{"type": "text", "text": s}], [{"type": "thinking", "thinking": "x"}, {"type": "text", "text": s}]])
    rows, n = [], 0
    for s in [f"s{i}" for i in range(80)] + ["hot"]:
        for _ in range(400 if s == "hot" else rng.randrange(1, 5)):
            for k in ("user", "assistant", "assistant")[: rng.choice([2, 3]) if s == "hot" or rng.random() < 0.9 else 1]:
                n += 1
                m = json.dumps({"role": k if s == "hot" or rng.random() < 0.98 else "x", "content": text(rng.choice(["hello", "<system-reminder>a\nb</system-reminder> hi"]))})
                rows.append((s, n, rng.choice([k, k.upper(), f" {k} "]), m, n * 10 if s == "hot" or rng.random() < 0.99 else None))
                if rng.random() < 0.2:
                    n += 1
                    rows.append((s, n, "user", json.dumps({"role": "user", "content": [{"type": "tool_result", "content": "x"}]}), n * 10))
    rows += rows[:30] + [(None, 1, "user", "{}", 1), ("z", 5, "system", None, None), ("bad", 6, "user", "{", 5), ("empty", 7, "user", '{"role": "user", "content": "<local-command-stdout>x</local-command-stdout>"}', 7)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "session_id string, entry_id bigint, kind string, message string, us bigint").withColumn("part", F.lit("clash"))
    got = {tuple(r) for r in conversations(df, "session_id", "entry_id", "kind", "message", "us").collect()}
    assert got == brute(rows) and any(s == "hot" for s, *_ in got)
    assert conversations(df.limit(0), "session_id", "entry_id", "kind", "message", "us").count() == 0


# ---- 8 tokens ---------------------------------------------------------------------------------------------------


def test_tokens_match_the_public_encoder(spark):
    import tiktoken

    entries = tokens.read_ranks()
    h = tokens.PerfectHash(entries)
    assert sorted(h.slots) == list(range(len(entries))) and all(h.get(w) == i for i, w in enumerate(entries)) and h.get(b"\xff\xfe\xfd") == -1
    theirs = tiktoken.Encoding("own", pat_str=tokens.PATTERN, mergeable_ranks={w: i for i, w in enumerate(entries)}, special_tokens={})
    rng = random.Random(2)
    letters = " \n\t\r\x1c\x1f 　.,'sdmtllveabcABC123éß日本🙂﻿​"
    texts = [None, "", "<|endoftext|> it's", "x" * 5000, "  \n\n   def f():\n        pass  "] + ["".join(rng.choice(letters) for _ in range(rng.randrange(30))) for _ in range(500)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: r.ids for r in tokens.encode(df, "doc_id", "text").collect()}
    assert got == {i: theirs.encode_ordinary(t or "") for i, t in enumerate(texts)}
    assert tokens.encode(df.limit(0), "doc_id", "text").count() == 0


# ---- 9 leaks ----------------------------------------------------------------------------------------------------

SHARED = "Read the passage below with care and answer the question at its end in one short sentence."


def items():
    rng = random.Random(4)
    words = [f"{a}{b}" for a in ("ba", "ko", "li", "mu", "ne") for b in ("ra", "st", "tle", "von", "wick", "zor", "gim", "pel")]
    return [(i, SHARED + " " + " ".join(f"{' '.join(rng.choice(words) for _ in range(14))}." for _ in range(4))) for i in range(20)]


def test_leaks(spark):
    rng, its = random.Random(6), dict(items())
    own = its[3].removeprefix(SHARED).split()
    dense = lambda k: " ".join(w if i % k else "changed" for i, w in enumerate(own))
    docs = [
        (1, "Intro text. " + its[3] + " The end."), (2, SHARED + " something else entirely"), (3, "> **" + " ".join(own[5:20]).upper() + "**"), (4, "so " + " ".join(own[5:19]) + " stop"),
        (5, dense(6)), (6, dense(3)), (7, None), (8, ""), (9, "\t".join(own[:30]) + " “" + " — ".join(own[30:]) + "”"), (10, " ".join(rng.sample(own, len(own)))),
    ]
    df = spark.createDataFrame(docs + docs[:1], "doc_id bigint, text string").withColumn("item_id", F.lit(0))
    its_df = spark.createDataFrame([*its.items(), (99, None), (98, ""), (97, SHARED)], "item_id bigint, text string")
    got = leaks.find_leaks(df, "doc_id", "text", its_df, "item_id", "text")
    assert sorted({tuple(r) for r in got.collect()}) == [(1, 3), (3, 3), (5, 3), (9, 3)]
    assert leaks.find_leaks(df, "doc_id", "text", its_df.limit(0), "item_id", "text").count() == 0
    assert leaks.find_leaks(df.limit(0), "doc_id", "text", its_df, "item_id", "text").count() == 0


def test_alignment_counts_words_in_order():
    import numpy as np

    a = np.arange(1, 41)
    assert leaks.aligned(a, np.concatenate([[99] * 5, a, [98] * 3])) == 40
    assert leaks.aligned(a, np.array([x for i, x in enumerate(a) if i % 5])) == 32
    assert leaks.aligned(a, a[::-1].copy()) == 1


# ---- 10 cuts ----------------------------------------------------------------------------------------------------


def test_cuts(spark):
    rng = random.Random(8)
    prose = lambda n: "".join(rng.choice(["some ", "words ", "here. ", "and ", "there "]) for _ in range(n))
    rows = [(i, (prose(100) + "zz")[:200].rstrip(" .") .ljust(200, "x"), "limited") for i in range(30)]
    rows += [(100 + i, (prose(80)[: rng.randrange(50, 180)]).rstrip(" .") + ".", "limited") for i in range(100)]
    rows += [(300, ("a" * 199) + ".", "limited")]
    endings = {
        400: ("It ends well.", False), 401: ("It breaks off in the mid", True), 402: ("text\n... (truncated)", True), 403: ("bro�", True), 404: ("x\n- a list item", False), 405: ("x\n| a | b |", False),
        406: ("x\n| a | b", True), 407: ("x\n## Heading words", False), 408: ("```\ncode(1)\n```", False), 409: ("```\ncode(1)", True), 410: ("See https://x.example/a/1", False), 411: ("@bob: same thing", False),
        412: ("And so on...", False), 413: ("Ende。", False), 414: ("well done?\n— the crew", False), 415: ("  \n", False), 416: (None, False), 417: ("", False), 418: ('He said "no."', False),
    }
    rows += [(k, t, None) for k, (t, _) in endings.items()] + rows[:2]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string").withColumn("cut", F.lit(1))
    marked = cuts.flagged(df, "doc_id", "text", "source")
    got = {r.key for r in marked.filter("cut").collect()}
    assert got == {k for k, (_, c) in endings.items() if c} | set(range(30))
    share = {r.source: (r.n_cut, r.n_at_limit) for r in cuts.share(marked).collect()}
    assert share["limited"] == (32, 32) and share[None][1] == 0
    assert cuts.flagged(df.limit(0), "doc_id", "text", "source").count() == 0


def test_long_last_lines(spark):
    """A last line of any length is what it is: a list item, a row of a table, of data, of chat."""
    words = " ".join(["word"] * 200)
    texts = [f"Intro.\n- {words}", f"Intro.\n| {words} | {words} |", f"Intro.\n{','.join(['cell'] * 50_000)}", f"Intro.\n@bob: {words}", f"Intro.\n{words}", f"Intro {words}." + ")" * 700, "a " * 100_000 + "end", " " * 200_000 + "It ends." + " \n" * 50_000, f"Intro.\n| {words} | {words}"]
    df = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id bigint, text string, source string")
    got = {r.key: (r.shape, r.cut) for r in cuts.flagged(df, "doc_id", "text", "source").collect()}
    assert got == {0: ("line", False), 1: ("line", False), 2: ("line", False), 3: ("chat", False), 4: ("prose", True), 5: ("end", False), 6: ("prose", True), 7: ("end", False), 8: ("open", True)}
