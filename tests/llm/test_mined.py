"""Mined path patterns: what carries them, what explains them away, what overrules them."""

import json

import pytest

pytest.importorskip("fathomline.llm")

from fathomline.llm import handwritten  # noqa: E402


def _files(spark):
    notice = "// tool output. Code generated by protoforge v3. DO NOT EDIT.\npackage a\n"
    hand = "package a\nfunc run() {}\n"
    files = {}
    for r in range(4):
        for k in range(40):
            files[f"r{r}", f"src/plain{k}/file{k}.go"] = hand
            if k < 10:  # half of these show where they come from, in no folder with a well-known name
                files[f"r{r}", f"web/stamped/out{k}.go"] = notice if k % 2 else hand
            if k >= 30:
                files[f"r{r}", f"web/own/page{k}.go"] = hand
    files["lone", "odd/one.go"] = files["lone", "odd/two.go"] = notice  # one repository alone proves nothing
    files["lone", "odd/three.go"] = hand
    files["told", "stamped/kept.go"] = hand
    files["told", ".gitattributes"] = "stamped/** -linguist-generated\n"
    files["told", "deep/.gitattributes"] = "out/*.go linguist-generated\n"
    files["told", "deep/out/x.go"] = files["told", "out/x.go"] = hand
    return files


def test_mined_patterns(spark):
    files = _files(spark)
    chunks = spark.createDataFrame([(r, p, t, json.dumps({"line_start": 1})) for (r, p), t in files.items()], "repo string, file_path string, text string, metadata string")
    hashes = spark.createDataFrame([(r, p, f"{r}{p}", None) for r, p in files if not p.endswith("attributes")], "repo string, file_path string, hash string, last_indexed timestamp_ntz")
    got = {(r.repo, r.file_path): r.reason for r in handwritten.not_by_hand(hashes, chunks).collect()}
    assert {k for k, v in got.items() if v == "mined"} == {(f"r{r}", f"web/stamped/out{k}.go") for r in range(4) for k in range(0, 10, 2)}
    assert not any(p.startswith(("web/own", "src/")) for _, p in got)  # web is explained by stamped
    assert ("lone", "odd/three.go") not in got and ("told", "stamped/kept.go") not in got and ("told", "out/x.go") not in got
    assert got["told", "deep/out/x.go"] == "generated"


@pytest.mark.parametrize(
    ("line", "tool", "vendor"),
    [
        ("// Produced automatically by the schema compiler.", 1, 0), ("// This module was emitted by modgen", 0, 0), ("// Machine-generated from rows.yaml", 1, 0),
        ("// Taken unchanged from the other project, see its page.", 0, 1), ("// local copy, upstream https://x.example", 0, 1), ("// Never a copy of anything.", 0, 0), ("// Not generated by any tool.", 0, 0), ("// Licence of ours: MIT. Code generated by protoforge.", 1, 0),
    ],
)
def test_notices(line, tool, vendor):
    assert handwritten.measures(line + "\npackage a\n", "go", 1)[:2] == (tool, vendor)
