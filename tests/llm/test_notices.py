import pytest

pytest.importorskip("fathomline.llm")

from fathomline.llm import handwritten  # noqa: E402


@pytest.mark.parametrize("lines", [0, 14, 15, 60])
def test_notice_below_a_long_header(lines):
    head = "// Licensed to the crew under their own terms.\n" * lines
    shown = lambda t: handwritten.measures(t, "go", 1)[:2]
    assert shown(head + "// Code generated by protoforge v3. DO NOT EDIT.\npackage a\n") == (1, 0)
    assert shown(head + "// x v1.2 - bundled copy\npackage a\n") == (0, 1)
    assert shown(head + "func a() {}\n// Code generated by protoforge v3. DO NOT EDIT.\n") == (0, 0)
