"""Pairs of code and description: the code is the slice of the source, the description has no marks."""

import pytest

pytest.importorskip("fathomline.llm")

from fathomline.llm import documented  # noqa: E402

DOC = "Walks all rows of the open shard."
CASES = {
    "python": ("import os\n\nclass A:\n    @cached\n", "    def run(\n        self, a={1: 2},\n    ):\n        \"\"\"\n        Walks all rows of the open shard.\n\n          Indented.\n        \"\"\"\n        text = '''\nno end\n'''\n# a comment at the margin\n        return a", "\n\n    x = 1\n"),
    "java": (f"class A {{\n  /** {DOC} */\n  @Override\n", '  public int run(int a) {\n    if (a > 0) { return "}".length(); }\n    return 1;\n  }', "\n  int b;\n}\n"),
    "csharp": (f"class A\n{{\n    /// <summary>{DOC}</summary>\n", "    public int Run(int a)\n    {\n        return a; // }\n    }", "\n}\n"),
    "go": (f"package a\n\n// run: {DOC}\n", "func run(a int) error {\n\tfor {\n\t}\n}", "\n\nfunc other() {}\n"),
    "rust": (f"/// {DOC}\n#[inline]\n", "pub fn run<'a>(x: &'a str) -> char {\n    '}'\n}", "\nfn b() {}\n"),
    "javascript": (f"/**\n * {DOC}\n */\n", "export const run = async (a) => {\n  return `}`;\n}", "\nlet b = 1;\n"),
    "typescript": (f"abstract class A {{\n  // {DOC}\n", "  abstract run(a: number): void;", "\n  b = 1;\n}\n"),
}


@pytest.mark.parametrize("ends", ["\n", "\r\n", "\r"])
@pytest.mark.parametrize("lang", sorted(CASES))
def test_code_is_the_slice(lang, ends):
    before, code, after = CASES[lang]
    text = (before + code + after).replace("\n", ends)
    found = documented.documented(text, lang)
    assert len(found) == 1
    [(a, b, got, doc)] = documented.with_code(text, lang, found)
    assert got == text[a:b] == code.replace("\n", ends).lstrip(" ")
    lines = doc.split("\n")
    assert lines[0].removeprefix("run: ").replace("<summary>", "").replace("</summary>", "") == DOC and not any(x.lstrip().startswith(("/", "*", "#")) for x in lines)
    if lang == "python":
        assert lines == [DOC, "", "  Indented."]


@pytest.mark.parametrize(
    ("doc", "counts"),
    [
        ("Opens the bundled copy of the parser tables for reading.", True), ("Opens the local copy of the parser tables for reading.", True), ("Use it at your own risk while the shard is open.", True),
        ("Licensed under the terms found in the file.\nAny use without that file is at your own risk.", False), ("x-y v1.2.3 - bundled copy, upstream https://x.example/releases", False),
        ("Part of the mirror service, version 7. Made by this very team.", False), ("Tells whether the rows are ours or theirs to keep.", True), ("Copyright the crew of this ship; all of it.", False),
    ],
)
def test_notices_are_no_documentation(doc, counts):
    text = "".join(f"// {x}\n" for x in doc.split("\n")) + "func run() {\n}\n"
    assert bool(documented.documented(text, "go")) is counts
