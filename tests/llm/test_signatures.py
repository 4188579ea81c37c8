import pytest

pytest.importorskip("fathomline.llm")

from fathomline.llm import documented  # noqa: E402

DOC = "/** Walks all rows of the open shard once. */\n"


@pytest.mark.parametrize("signature", ["foo(): (string | null) {\n}", "foo(a):\n  Promise<string> {\n}", "static foo(a)", "foo(a): string", "foo(): { a: string } {\n}", "foo(a) {\n}"])
def test_methods_of_any_return_type(signature):
    assert [n for n, *_ in documented.documented(DOC + signature, "typescript")] == ["foo"]


def test_a_call_is_no_declaration():
    assert documented.documented(DOC + "foo(a)", "typescript") == []
